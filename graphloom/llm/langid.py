"""Languages of a text as a mixture, by expectation-maximisation over n-gram likelihoods.

Each language has a trigram model over lower-cased UTF-8 bytes, fitted on texts that carry its label;
digits count as one symbol and every run of separators as a space.  A word's likelihood under a
language is the product over its bytes.  A text is a mixture: EM estimates the proportions, and the set
of languages is chosen by penalised likelihood (BIC), dropping one language after another for as long
as that raises the score.  An extra component that gives every byte the same chance stands for "no
language known": a text that is mostly that, or has no words, is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import text as tx
from graphloom.llm.common import hashed_fraction, integer, keep_rows, per_slice, texts

TRI_BITS, BI_BITS = 17, 13
ALPHA = 0.02
SYMBOLS = 64
#: Chance of each byte under no language.
UNKNOWN = 1 / 64
#: Texts that each language's model is fitted on at most; one text with a word is enough for a model.
MAX_TRAIN = 1500
#: Languages up to which a whole slice of text is handled at once; with more of them slices are smaller.
SLICE_LANGUAGES = 16
EM_ROUNDS = 12
#: What makes a word, as a pattern: an ASCII letter or digit, or anything beyond ASCII.
WORD = r"[0-9A-Za-z]|[^\x00-\x7F]"
#: BIC weighs a language as this many parameters.
PENALTY = 6.0


def _grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigram and bigram of each byte that follows a spaced word's first space, and their ranges."""
    b = data.astype(np.uint32)
    b[(b >= 48) & (b <= 57)] = 48
    before = np.empty_like(b)
    before[:1], before[1:] = 32, b[:-1]
    begin = at[:-1]
    third = np.empty_like(b)
    third[:1], third[1:] = 32, before[:-1]
    third[begin + 1] = 32
    own = np.ones(len(b), bool)
    own[begin] = False
    two = (third[own] << 8) | before[own]
    three = (two << 8) | b[own]
    tri = (three * np.uint32(2654435761)) >> np.uint32(32 - TRI_BITS)
    bi = (two * np.uint32(2246822519)) >> np.uint32(32 - BI_BITS)
    return tri, bi, at - np.arange(len(at))


@dataclass
class Model:
    names: list[str]
    tri: np.ndarray  # languages x 2**TRI_BITS, log of smoothed counts
    bi: np.ndarray
    unknown: float = float(np.log(UNKNOWN))
    penalty: float = PENALTY

    def word_likelihoods(self, words: tx.Words, sample: np.ndarray) -> np.ndarray:
        """Log likelihood of each of the given words: a column for each language, the last for none."""
        data, at = words.spaced(sample)
        tri, bi, at = _grams(data, at)
        out = np.empty((len(sample), len(self.names) + 1), np.float64)
        for i in range(len(self.names)):
            out[:, i] = tx.segment_sum(self.tri[i][tri] - self.bi[i][bi], at)
        out[:, -1] = np.diff(at) * self.unknown
        return out

    def mixtures(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proportions (rows x languages + 1), log likelihood a byte, and number of words."""
        column = tx.lower(tx.clean(column))
        if len(self.names) > SLICE_LANGUAGES:
            # tables of words x languages: fewer words at a time, so that memory doesn't grow with the languages
            parts = [self._mixtures(column.slice(a, b - a)) for a, b in tx.slices(column, tx.SLICE_BYTES * SLICE_LANGUAGES // len(self.names))]
            if len(parts) > 1:
                return tuple(np.concatenate(x) for x in zip(*parts))
            if parts:
                return parts[0]
        return self._mixtures(column)

    def _mixtures(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = tx.Words(column)
        _, sample, which = words.unique()
        like = self.word_likelihoods(words, sample)
        n = np.diff(words.first)
        top = like.max(axis=1) if len(like) else np.zeros(0)
        chance = np.exp(like - top[:, None]).astype(np.float32)
        shares, fit = _select(chance[which], words.first, self.penalty)
        size = tx.segment_sum((words.stop - words.start + 1).astype(np.float64), words.first)
        total = fit + tx.segment_sum(top[which], words.first)
        return shares, total / np.maximum(size, 1), n


def _em(chance: np.ndarray, doc: np.ndarray, first: np.ndarray, shares: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after EM from the given start, and the log likelihood with them."""
    n = np.maximum(np.diff(first), 1)[:, None]
    for last in range(rounds + 1):
        weighed = chance * shares.astype(np.float32)[doc]
        mass = np.maximum(weighed.sum(axis=1), np.float32(1e-30))
        if last == rounds:
            return shares, tx.segment_sum(np.log(mass).astype(np.float64), first)
        weighed /= mass[:, None]
        shares = np.column_stack([tx.segment_sum(weighed[:, i].astype(np.float64), first) for i in range(shares.shape[1])]) / n
    return shares, np.zeros(len(n))


def _select(chance: np.ndarray, first: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Best set of components for each text by BIC: proportions, 0 outside the set, and log likelihood."""
    rows, parts = len(first) - 1, chance.shape[1]
    n = np.diff(first)
    doc = np.repeat(np.arange(rows), n)
    shares, fit = _em(chance, doc, first, np.full((rows, parts), 1 / parts), 6)
    price = penalty * 0.5 * np.log(np.maximum(n, 2))
    # a component with hardly a word of the text costs more than it can bring
    active = (shares * n[:, None] >= 0.5) | (shares == shares.max(axis=1, keepdims=True))
    best, best_fit = shares * active, fit
    best /= np.maximum(best.sum(axis=1, keepdims=True), 1e-12)
    open_ = np.flatnonzero((active.sum(axis=1) > 1) & (n > 0))
    score = fit - price * active.sum(axis=1)
    while len(open_):
        trial = best[open_].copy()
        trial[trial <= 0] = np.inf
        trial_drop = trial.argmin(axis=1)
        start = best[open_].copy()
        start[np.arange(len(open_)), trial_drop] = 0
        start /= np.maximum(start.sum(axis=1, keepdims=True), 1e-12)
        counts = n[open_]
        own_first = np.zeros(len(open_) + 1, np.int64)
        np.cumsum(counts, out=own_first[1:])
        at = np.arange(own_first[-1]) + np.repeat(first[:-1][open_] - own_first[:-1], counts)
        single = (start > 0).sum(axis=1).max(initial=0) <= 1
        now, now_fit = _em(chance[at], np.repeat(np.arange(len(open_)), counts), own_first, start, 0 if single else EM_ROUNDS)
        now_score = now_fit - price[open_] * (now > 0).sum(axis=1)
        better = now_score >= score[open_]
        won = open_[better]
        best[won], best_fit[won], score[won] = now[better], now_fit[better], now_score[better]
        open_ = won[(best[won] > 0).sum(axis=1) > 1]
    best[n == 0] = 0
    return best, best_fit


def counts_table(docs: DataFrame, lang_col: str = "lang") -> DataFrame:
    """(lang, kind, bucket, n): trigram (3) and bigram (2) counts of labelled texts."""

    def run(batches):
        for batch in batches:
            column = tx.lower(tx.clean(batch.column(1)))
            langs = batch.column(2).to_pylist()
            for a, b in tx.slices(column):
                words = tx.Words(column.slice(a, b - a))
                own = words.text_of()
                for lang in sorted(set(langs[a:b])):
                    mine = np.flatnonzero(np.isin(own, [i for i in range(b - a) if langs[a + i] == lang]))
                    tri, bi, _ = _grams(*words.spaced(mine))
                    for kind, buckets in ((3, tri), (2, bi)):
                        values, n = np.unique(buckets, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array([kind] * len(values), pa.int32()), pa.array(values, pa.int64()), pa.array(n, pa.int64())], ["lang", "kind", "bucket", "n"])

    return texts(docs, "doc_id", "text", lang_col).mapInArrow(run, "lang string, kind int, bucket long, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, lang_col: str = "lang", max_train: int = MAX_TRAIN, seed: int = 11) -> Model:
    """A model for each label that has a text with a word, from all its texts or a seeded sample of about `max_train`."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col("text").rlike(WORD))
    sizes = labelled.groupBy(lang_col).count().collect()
    if not sizes:
        return Model([], np.zeros((0, 1 << TRI_BITS), np.float32), np.zeros((0, 1 << BI_BITS), np.float32))
    large = [r for r in sizes if r[1] > max_train]
    # rows without an id are sampled by their text
    by = F.coalesce(integer(F.col("doc_id")), F.xxhash64("text"))
    taken = ~F.col(lang_col).isin([r[0] for r in large]) if large else F.lit(True)
    for r in large:
        taken = taken | ((F.col(lang_col) == r[0]) & hashed_fraction(by, max_train / r[1], seed))
    names = sorted(r[0] for r in sizes)
    tri, bi = np.zeros((len(names), 1 << TRI_BITS)), np.zeros((len(names), 1 << BI_BITS))
    # at most (2**17 + 2**13) rows a language, however large the corpus
    found = counts_table(labelled.where(taken), lang_col).toArrow()
    place = {name: i for i, name in enumerate(names)}
    row = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    kind, bucket, n = (found.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    for k, to in ((3, tri), (2, bi)):
        to[row[kind == k], bucket[kind == k]] = n[kind == k]
    return Model(names, np.log(tri + ALPHA).astype(np.float32), np.log(bi + ALPHA * SYMBOLS).astype(np.float32))


def accepted(shares: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A text with words whose known languages make up half of it at least."""
    return (n > 0) & (shares[:, :-1].sum(axis=1) >= 0.5)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, languages, proportions, top, bits_per_byte, accepted) of every row.

    Languages come by falling proportion, ties by name; "und" is the part of no known language.  A null,
    empty or wordless text has no languages and isn't accepted.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict:
        m = held.value
        shares, per_byte, n = m.mixtures(batch.column(1))
        names = np.array([*m.names, "und"], object)
        order = np.argsort(-shares, axis=1, kind="stable")
        languages, proportions = [], []
        for own, o in zip(np.round(shares, 4), order):
            o = [i for i in o if own[i] > 0]
            languages.append(names[o].tolist())
            proportions.append(own[o].tolist())
        return {"doc_id": batch.column(0), "languages": languages, "proportions": proportions, "top": [x[0] if x else None for x in languages], "bits_per_byte": np.round(-per_byte / np.log(2), 4), "accepted": accepted(shares, n)}

    return per_slice(texts(docs, id_col, text_col), make, "doc_id long, languages array<string>, proportions array<double>, top string, bits_per_byte double, accepted boolean")


def drop_unknown(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text is accepted, all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def mask(column: pa.Array) -> np.ndarray:
        shares, _, n = held.value.mixtures(column)
        return accepted(shares, n)

    return keep_rows(docs, mask, text_col)
