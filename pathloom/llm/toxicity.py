"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams (orders ``ORDERS``, lower-cased, hashed to 2^``BITS`` buckets) of the whole
text. A feature's value is the log ratio of its smoothed document counts in toxic and clean training texts (Wang and
Manning 2012); a logistic regression with L2 penalty is fitted on these values by AdaGrad. Only text and label go into it.

The classifier is fitted on a bounded sample: the ``SAMPLE_ROWS`` labelled documents of the training folds with the
least hash of their id; of several rows of one id the text with the least hash. Fitting streams over them in one task; all other work is one pass over the documents, whose
workers get the weights (2^BITS floats, 1 MB).

Null and empty texts score the intercept; several labels of a document count as toxic if one is; labels without a document
are passed over; where labelled rows are all of one kind every score is that kind's (1 or 0, to 1e-17), and 0 without any; ties at
0.5 are predicted toxic; repeated documents get equal rows; rows with null ids are scored and are in the held-out fold of
none (null); other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDERS = (3, 4, 5)
BITS = 18
#: Labelled documents that are used for fitting, at most.
SAMPLE_ROWS = 8000
FOLDS = 5
EPOCHS, RATE, PENALTY, LEAST_DOCS = 6, 0.05, 1e-5, 3


class Grams:
    """Distinct n-gram buckets of texts."""

    def __init__(self):
        import numpy as np

        self.last = np.zeros(1 << BITS, np.int64)
        self.at = 0

    def of(self, text: str | None):
        import numpy as np

        code = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        u, parts, h = np.uint64, [], code
        for n in range(2, max(ORDERS) + 1):
            if len(code) < n:
                break
            h = h[:-1] * u(0x9E3779B97F4A7C15) + code[n - 1 :]
            if n in ORDERS:
                parts.append(((h ^ (h >> u(29))) * u(0xBF58476D1CE4E5B9 + 2 * n) >> u(64 - BITS)).astype(np.int64))
        if not parts:
            return np.zeros(0, np.int64)
        found = np.concatenate(parts)
        mark = np.arange(self.at, self.at + len(found))  # of equal buckets the last one written stays
        self.at += len(found)
        self.last[found] = mark
        return found[self.last[found] == mark]


def fit(rows: Iterator[tuple[str | None, int]], seed: int = 7) -> tuple:
    """(weights of the buckets, intercept) from texts and labels."""
    import numpy as np

    grams, lists, labels = Grams(), [], []
    for text, label in rows:
        lists.append(grams.of(text).astype(np.int32))
        labels.append(label)
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return np.zeros(1 << BITS, np.float32), 40.0 if share else -40.0
    counts = [np.ones(1 << BITS), np.ones(1 << BITS)]
    seen = np.zeros(1 << BITS, np.int64)
    for found, label in zip(lists, labels, strict=True):
        counts[int(label)][found] += 1
        seen[found] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[seen < LEAST_DOCS] = 0
    lists = [found[ratio[found] != 0] for found in lists]
    w, sums, b, b_sum = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6), math.log(share / (1 - share)), 1e-6
    rng, size = np.random.default_rng(seed), 32
    for _ in range(EPOCHS):
        order = rng.permutation(len(lists))
        for i in range(0, len(order), size):
            some = order[i : i + size]
            idx = np.concatenate([lists[k] for k in some])
            n = np.array([len(lists[k]) for k in some])
            who = np.repeat(np.arange(len(some)), n)
            z = np.bincount(who, w[idx] * ratio[idx], len(some)) + b
            g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[some]
            grad = np.bincount(idx, g[who] * ratio[idx], 1 << BITS) / len(some) + PENALTY * w
            sums += grad * grad
            w -= RATE * grad / np.sqrt(sums)
            step = g.mean()
            b_sum += step * step
            b -= RATE * step / math.sqrt(b_sum)
    return (w * ratio).astype(np.float32), float(b)


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and label of the training sample, one row for each of ``rows`` ids at most, which the join's small side has."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    there = known.where(common.crc_mod("doc_id", FOLDS) != 0).join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    one = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("tie"), "text")).alias("t"), F.max("label").alias("label"))
    return one.select("doc_id", "t.text", F.col("label").cast("int").alias("label"))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple:
    """The weights and intercept, fitted by one task on the bounded sample, in the order of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for whole in batches:
                for part in common.slices(whole):
                    yield from zip(common.values(part, "text"), common.values(part, "label"), strict=True)

        w, b = fit(pairs())
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], names=["w", "b"])

    import numpy as np

    one = sample(docs, labels, rows).repartition(1).sortWithinPartitions("doc_id")
    row = one.mapInArrow(run, "w binary, b double").first()
    return (np.frombuffer(bytes(row["w"]), np.float32), row["b"]) if row else (np.zeros(1 << BITS, np.float32), -40.0)


def scorer(model: tuple):
    """A function from a text to its score."""
    w, b = model
    grams = Grams()

    def score(text: str | None) -> float:
        z = float(w[grams.of(text)].sum()) + b
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, z))))

    return score


def scores(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for whole in batches:
            for part in common.slices(whole):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([score(t) for t in common.values(part, "text")], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    found = scores(docs, train(docs, labels, rows))
    return found.select("doc_id", (common.crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, all their columns, that are not predicted toxic; texts are not moved."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for whole in batches:
            for part in common.slices(whole):
                yield part.filter(pa.array([score(t) < 0.5 for t in common.values(part, "text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
