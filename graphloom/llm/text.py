"""Vectorised text primitives over Arrow string buffers.

Every operator of this subpackage that has to look inside a text does it here, with numpy over the
UTF-8 bytes of a whole Arrow batch instead of a Python loop over documents or words.  A *word* is a
maximal run of ASCII letters, ASCII digits and non-ASCII bytes, lower-cased; everything else
separates words.  Hashes are 64-bit, the same on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.  Only a bound on scratch memory: a longer text is a slice by itself.
SLICE_BYTES = 1 << 20
#: Bytes whose running hash is held at once; results don't depend on it.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[ord("A") : ord("Z") + 1] = True
_WORD[128:] = True
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """``base ** i mod 2**64`` for i below n at least, grown by doubling and kept in the worker."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        table = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            step = np.uint64(pow(base, filled, 1 << 64))
            table[filled : 2 * filled] = table[:filled] * step
            filled *= 2
        if size <= 1 << 22:  # a very long text's table isn't kept
            _powers[base] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def mix_one(h: int) -> int:
    """`mix` for a single Python integer."""
    return int(mix(np.array([h & (2**64 - 1)], np.uint64))[0])


def clean(column: pa.Array) -> pa.Array:
    """The column as valid UTF-8 strings, with "" for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def lower(column: pa.Array) -> pa.Array:
    """Unicode lower case; bytes that aren't UTF-8 become U+FFFD."""
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace").lower() for x in column.cast(pa.binary()).to_pylist()], pa.string())


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the offset at which each text begins."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.zeros(0, np.uint8) if raw is None else np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes that together cover the column."""
    _, offsets = buffers(column)
    start, n = 0, len(column)
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; `span_hash` turns any two places of it into the hash of the bytes between."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(data))[: len(data)], out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of data[start:stop], independent of where it lies."""
    return (running[stop] - running[start]) * _power_table(_INVERSE, len(running))[start]


def hash_spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """`span_hash` of spans whose starts and whose stops rise, with the running hash of one block in memory at a time."""
    out, head = np.zeros(len(start), np.uint64), np.uint64(0)
    i = j = 0
    for a in range(0, len(data), BLOCK_BYTES):
        b = min(a + BLOCK_BYTES, len(data))
        running, power = prefix_hash(data[a:b]), np.uint64(pow(_BASE, a, 1 << 64))
        last = b == len(data)
        to = len(start) if last else int(np.searchsorted(start, b))
        out[i:to] -= head + running[start[i:to] - a] * power
        i = to
        to = len(stop) if last else int(np.searchsorted(stop, b))
        out[j:to] += head + running[stop[j:to] - a] * power
        j = to
        head = np.uint64((int(head) + int(running[-1]) * int(power)) & (2**64 - 1))
    for a in range(0, len(start), BLOCK_BYTES):
        at = start[a : a + BLOCK_BYTES]
        # base ** -at as the product of a power for the block and one within it
        block, within = at // BLOCK_BYTES, at % BLOCK_BYTES
        far = np.array([pow(_INVERSE, int(x) * BLOCK_BYTES, 1 << 64) for x in range(int(block[0]), int(block[-1]) + 1)], np.uint64)
        out[a : a + BLOCK_BYTES] *= far[block - block[0]] * _power_table(_INVERSE, BLOCK_BYTES)[within]
    return out


def gram_hash(running: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes at each place from 0 to len - n."""
    count = len(running) - n
    return (running[n:] - running[:count]) * _power_table(_INVERSE, len(running))[:count] if count > 0 else np.zeros(0, np.uint64)


class Words:
    """Words of a slice of texts: hash, byte span and the word range of each text."""

    def __init__(self, column: pa.Array, offsets: np.ndarray | None = None):
        self.data, self.offsets = buffers(column)
        if offsets is not None:
            self.offsets = offsets  # other borders than those of the texts, e.g. of paragraphs
        starts, stops = [], []
        # block by block: the masks of a long text never stand in memory as a whole
        for a in range(0, len(self.data), BLOCK_BYTES):
            b = min(a + BLOCK_BYTES, len(self.data))
            inside = _WORD[self.data[max(a - 1, 0) : b + 1]]
            if not a:
                inside = np.append(False, inside)
            if b == len(self.data):
                inside = np.append(inside, False)
            border = np.zeros(b - a + 1, bool)  # a text ends ahead of this place
            border[self.offsets[np.searchsorted(self.offsets, a) : np.searchsorted(self.offsets, b, "right")] - a] = True
            own = inside[1:-1]
            starts.append(np.flatnonzero(own & (~inside[:-2] | border[:-1])) + a)
            stops.append(np.flatnonzero(own & (~inside[2:] | border[1:])) + a + 1)
        none = np.zeros(0, np.int64)
        self.start, self.stop = np.concatenate([none, *starts]), np.concatenate([none, *stops])
        #: words of text i are first[i] : first[i + 1]
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = mix(hash_spans(self.data, self.start, self.stop))

    def text_of(self) -> np.ndarray:
        """The text each word lies in."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def unique(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, a word that has each, and for every word which of them it has."""
        return np.unique(self.hash, return_index=True, return_inverse=True)

    def distinct(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words of each text, given `unique`'s inverse and size: numbers, and their ranges."""
        pairs = np.unique(self.text_of() * n + which)
        texts = len(self.offsets) - 1
        return pairs % max(n, 1), np.searchsorted(pairs, np.arange(texts + 1) * n)

    def spaced(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the given words with a space at either side of each, and where each begins."""
        start, length = self.start[words], self.stop[words] - self.start[words]
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum(length + 2, out=at[1:])
        out = np.full(at[-1], 32, np.uint8)
        done = np.cumsum(length) - length
        k = np.arange(int(length.sum()))
        out[k + np.repeat(at[:-1] + 1 - done, length)] = self.data[k + np.repeat(start - done, length)]
        return out, at

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and the range of them each text has.

        A text of fewer than k words, but at least one, has one shingle of all its words.
        """
        return shingle_hashes(self.hash, self.first, k)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """See `Words.shingles`; works for any sequence of hashes cut into ranges by `first`."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    begin = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], count)
    length = np.repeat(np.minimum(n, k), count)
    out = np.zeros(len(begin), np.uint64)
    for j in range(k):
        more = length > j
        if more.all():
            out = out * np.uint64(_BASE) + words[begin + j]
        else:
            out[more] = out[more] * np.uint64(_BASE) + words[begin[more] + j]
    return mix(out + np.uint64(k)), at


def segment_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]], 0 for an empty range; `at` doesn't fall."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, at[full], axis=0)
    return out


def segment_max(values: np.ndarray, at: np.ndarray, empty: float = 0.0) -> np.ndarray:
    """Maxima of values[at[i]:at[i + 1]], `empty` for an empty range."""
    out = np.full((len(at) - 1, *values.shape[1:]), empty, values.dtype)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(values, at[full], axis=0)
    return out


def take_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places start[0] .. start[0] + length[0] - 1, start[1] .. and so on."""
    done = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - done, length)
