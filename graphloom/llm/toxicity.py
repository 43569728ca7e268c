"""Toxicity: a character n-gram linear classifier with naive Bayes log-count ratios as feature scales.

The features of a text are the hashed character n-grams (3 to 6 bytes, within words, with the word's
borders) of its distinct words.  Each is scaled by the log ratio of its smoothed counts in toxic and in
other texts, and a logistic regression is fitted on the scaled features.  The fitted table gives every
word a score once; a text's logit is the bias plus the sum over its distinct words, so a text of any
length is scored whole.  The threshold is chosen on held-out texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import text as tx
from graphloom.llm.common import integer, keep_rows, per_slice, texts, tidy

SIZES = (3, 4, 5, 6)
BITS = 20
#: Labelled texts of either class that the classifier is fitted on at most.
MAX_TRAIN = 4000
#: Share of the sample that is held out to choose the threshold.
HELD_OUT = 0.25
MAX_FALSE_ALARMS = 0.002
#: N-grams that are counted at a time; a bound on scratch memory.
AT_ONCE = 1 << 20


def word_grams(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of spaced words, and the range of them each word has."""
    word = np.repeat(np.arange(len(at) - 1), np.diff(at))
    running = tx.prefix_hash(data)
    buckets, owners = [], []
    for n in SIZES:
        h = tx.gram_hash(running, n) if len(data) >= n else np.zeros(0, np.uint64)
        if len(data) == n:
            h = running[n:] - running[:1]
        inside = np.flatnonzero(word[: len(h)] == word[n - 1 : n - 1 + len(h)])
        buckets.append((tx.mix(h[inside] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int32))
        owners.append(word[inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], np.searchsorted(owner[order], np.arange(len(at)))


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    threshold: float
    accuracy: float = 0.0
    recall: float = 0.0
    false_alarms: float = 0.0

    def logits(self, column: pa.Array) -> np.ndarray:
        words = tx.Words(tx.lower(tx.clean(column)))
        known, sample, which = words.unique()
        own, at = words.distinct(which, len(known))
        buckets, grams = word_grams(*words.spaced(sample))
        score = tx.segment_sum(self.weight[buckets].astype(np.float64), grams)
        return self.bias + tx.segment_sum(score[own], at)


def _vocabulary(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text as numbers, with their ranges, and the n-gram buckets of each word, with theirs.

    Slice by slice, so that only the result takes memory.
    """
    column = tx.lower(tx.clean(column))
    names, sizes, buckets = [], [], []
    pairs, counts = [], []
    for a, b in tx.slices(column):
        part = tx.Words(column.slice(a, b - a))
        known, sample, which = part.unique()
        own, at = part.distinct(which, len(known))
        pairs.append(known[own])
        counts.append(np.diff(at))
        made, grams = word_grams(*part.spaced(sample))
        new = np.flatnonzero(~np.isin(known, np.concatenate(names))) if names else np.arange(len(known))
        length = np.diff(grams)[new]
        names.append(known[new])
        sizes.append(length)
        buckets.append(made[tx.take_ranges(grams[:-1][new], length)])
    name = np.concatenate(names) if names else np.zeros(0, np.uint64)
    order = np.argsort(name)
    numbers = order[np.searchsorted(name[order], np.concatenate(pairs) if pairs else name)].astype(np.int32)
    ranges = lambda x: np.concatenate([[0], np.cumsum(np.concatenate(x) if x else np.zeros(0, np.int64))]).astype(np.int64)
    return numbers, ranges(counts), np.concatenate(buckets) if buckets else np.zeros(0, np.int32), ranges(sizes)


def fit(column: pa.Array, toxic: np.ndarray, seed: int = 7, rounds: int = 150, l2: float = 1e-3) -> Model:
    """Fits on texts and 0/1 labels; without both classes the model calls nothing toxic.

    An n-gram counts from the fourth text on, so a handful of labels makes a model that knows few of them.
    """
    toxic = np.asarray(toxic, np.float64)
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(np.zeros(1 << BITS, np.float32), -10.0, 0.0)
    own, at, buckets, grams = _vocabulary(column)
    words = len(grams) - 1
    doc = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(at))
    gram_word = np.repeat(np.arange(words, dtype=np.int32), np.diff(grams))
    held = np.random.default_rng(seed).random(len(toxic)) < HELD_OUT
    if not 0 < toxic[~held].sum() < (~held).sum():
        held[:] = False  # too few to hold any out
    train = ~held

    def counts(mask: np.ndarray) -> np.ndarray:
        per_word = np.bincount(own[mask[doc]], minlength=words)
        out = np.zeros(1 << BITS)
        for a in range(0, len(buckets), AT_ONCE):
            out += np.bincount(buckets[a : a + AT_ONCE], per_word[gram_word[a : a + AT_ONCE]], 1 << BITS)
        return out

    positive, negative = counts(train & (toxic == 1)), counts(train & (toxic == 0))
    total = max(positive.sum() + negative.sum(), 1.0)
    share = positive.sum() / total
    # smoothing in proportion to the classes: an n-gram that was never seen says nothing
    p = (positive + 4 * share) / max(positive.sum(), 1.0)
    q = (negative + 4 * (1 - share)) / max(negative.sum(), 1.0)
    ratio = np.where(positive + negative >= 4, np.log(np.maximum(p, 1e-12) / np.maximum(q, 1e-12)), 0.0)
    used = np.flatnonzero(np.abs(ratio) > 0.7)
    column_of = np.full(1 << BITS, -1, np.int32)
    column_of[used] = np.arange(len(used))
    live = column_of[buckets] >= 0
    feature, feature_word = column_of[buckets[live]], gram_word[live]
    del buckets, gram_word, grams, live
    scale = ratio[used]

    w, bias = np.full(len(used), 0.1), -2.0
    balance = np.where(toxic == 1, 0.5 / max(toxic[train].sum(), 1), 0.5 / max((1 - toxic)[train].sum(), 1)) * train
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, rounds + 1):
        score = np.bincount(feature_word, (w * scale)[feature], words)
        z = bias + np.bincount(doc, score[own], len(toxic))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * balance
        by_word = np.bincount(own, error[doc], words)
        grad = np.append(np.bincount(feature, by_word[feature_word], len(used)) * scale + l2 * w / max(len(used), 1) ** 0.5, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weight = np.zeros(1 << BITS, np.float32)
    weight[used] = w * scale
    model = Model(weight, float(bias), 0.0)
    z = bias + np.bincount(doc, np.bincount(feature_word, (w * scale)[feature], words)[own], len(toxic))
    judged = held if 0 < toxic[held].sum() < held.sum() else train
    return choose(model, z[judged], toxic[judged])


def choose(model: Model, z: np.ndarray, toxic: np.ndarray) -> Model:
    """Sets the threshold with the best recall whose false alarms stay below the limit."""
    clean, bad = np.sort(z[toxic == 0]), np.sort(z[toxic == 1])
    floor = clean[max(0, int(np.ceil(len(clean) * (1 - MAX_FALSE_ALARMS))) - 1)]
    above = bad[bad > floor]
    model.threshold = float((floor + above[0]) / 2 if len(above) else floor + 1.0)
    model.recall = float((bad >= model.threshold).mean())
    model.false_alarms = float((clean >= model.threshold).mean())
    model.accuracy = float(((z >= model.threshold) == (toxic == 1)).mean())
    return model


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, seed: int = 7) -> Model:
    """Fits on a seeded sample of at most about `max_train` labelled texts of either class.

    Labels without an id or a value are left out; an id labelled both ways counts as toxic.
    """
    known = labels.select(integer(F.col("doc_id")).alias("id"), F.col("toxic").try_cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, max_train / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, max_train / max(1, sizes.get(0, 0)))))
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))
    # at most about 2 * max_train ids of 12 bytes, whatever the size of the corpus
    found = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    blob = found.groupBy().applyInArrow(_fit_table, "weight binary, bias double, threshold double, accuracy double, recall double, false_alarms double").first()
    if blob is None:
        return Model(np.zeros(1 << BITS, np.float32), -10.0, 0.0)
    return Model(np.frombuffer(blob[0], np.float32), *blob[1:])


def _fit_table(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("doc_id")
    model = fit(rows.column("text").combine_chunks(), rows.column("toxic").to_numpy())
    tidy()
    return pa.table({"weight": pa.array([model.weight.tobytes()], pa.binary()), **{k: [getattr(model, k)] for k in ("bias", "threshold", "accuracy", "recall", "false_alarms")}})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, logit, toxic) of every row; a null, empty or wordless text gets the bias and is clean."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict:
        z = held.value.logits(batch.column(1))
        return {"doc_id": batch.column(0), "logit": np.round(z, 6), "toxic": z >= held.value.threshold}

    return per_slice(texts(docs, id_col, text_col), make, "doc_id long, logit double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that aren't toxic, all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda column: held.value.logits(column) < held.value.threshold, text_col)
