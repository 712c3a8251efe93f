"""Operator 6: toxicity by a character n-gram linear classifier with naive Bayes log-count ratios.

Features are the n-grams of 3 to 5 characters of each lower-case word with a space at both ends, hashed to
BUCKETS. A feature's value in a document is its share of the document's n-grams times the feature's naive
Bayes log-count ratio, the logarithm of its smoothed frequency in toxic against other documents; over these
a logistic regression with an L2 penalty is fitted. As the score is linear, a word scores the sum over its
n-grams, so scoring hashes each distinct word of a batch once, and a document takes the mean over its words'
n-grams: one scan, no shuffle, and a model of BUCKETS floats of fixed size.

Fitted in one task on at most SAMPLE labelled rows (half of them from each class at most; those with the
least hash of doc_id, and then of the text, whatever the number of rows that share an id). A held-out fifth sets the threshold, by F1 at the true share of the classes.

Defined cases: null and blank texts score null and aren't toxic; null labels and ids don't train; of
several labels of a document the highest counts; with labels of one class only, or none, nothing is
toxic and the score is the share of toxic labels (0 if there are none); rows given twice are scored twice;
other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import BASE, mix, rows_of, slices, words_of

SAMPLE = 4_000
BUCKETS = 1 << 18
ORDERS = (3, 4, 5)


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of these words, in order of the words, and each word's number of them."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = pc.binary_join_element_wise("", pc.utf8_lower(words), "", " ")
    size = pc.utf8_length(padded).to_numpy().astype(np.int64)
    data = np.frombuffer("".join(padded.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)  # a character each
    word = np.repeat(np.arange(len(words)), size)
    left = np.cumsum(size)[word] - np.arange(len(data))
    key, which = [], []
    rolled = np.zeros(len(data), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(data) >= n:
            rolled[: len(data) - n + 1] = rolled[: len(data) - n + 1] * BASE + data[n - 1 :]
        if n in ORDERS:
            fit = np.flatnonzero(left >= n)
            key.append(mix(rolled[fit] + np.uint64(n << 56)) & np.uint64(BUCKETS - 1))
            which.append(word[fit])
    key, which = np.concatenate(key), np.concatenate(which)
    order = np.argsort(which, kind="stable")
    return key[order].astype(np.int64), np.bincount(which, minlength=len(words))


@dataclass(frozen=True)
class NBModel:
    weights: np.ndarray  # ratio times coefficient, by bucket
    bias: float
    threshold: float

    def score(self, text: pa.Array) -> np.ndarray:
        """The probability of toxicity of each text; NaN for those without words."""
        words, offsets = words_of(text)
        total, n = np.zeros(len(text)), np.zeros(len(text))
        if len(words):
            coded = words.dictionary_encode()
            key, size = grams(coded.dictionary)
            word_sum = np.bincount(np.repeat(np.arange(len(size)), size), self.weights[key], len(size))
            code, row = coded.indices.to_numpy(), rows_of(offsets)
            total = np.bincount(row, word_sum[code], len(text))
            n = np.bincount(row, size[code], len(text))
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 / (1 + np.exp(-np.clip(self.bias + total / n, -30, 30)))


def fit(text: pa.Array, y: np.ndarray, share: float, rounds: int = 150, penalty: float = 1e-4) -> NBModel:
    """share: of toxic rows among all labelled ones; the classes are weighted back to it for the threshold."""
    if len(y) == 0 or y.min() == y.max():
        s = min(max(share, 1e-9), 1 - 1e-9)
        return NBModel(np.zeros(BUCKETS, np.float32), float(np.log(s / (1 - s))), 2.0)
    words, offsets = words_of(text)
    coded = words.dictionary_encode()
    key, size = grams(coded.dictionary)
    begin = np.cumsum(size) - size
    # (document, bucket) counts
    row, code = rows_of(offsets), coded.indices.to_numpy()
    rows, cols, vals = [], [], []
    for a in range(0, len(y), 256):
        b = min(a + 256, len(y))
        w = slice(int(offsets[a]), int(offsets[b]))
        pair, times = np.unique(row[w] * len(size) + code[w], return_counts=True)
        r, c = pair // len(size), pair % len(size)
        n = size[c]
        flat = np.repeat(begin[c] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.repeat(r, n) * BUCKETS + key[flat]
        cell, at = np.unique(both, return_inverse=True)
        vals.append(np.bincount(at, np.repeat(times, n)).astype(np.float32))
        rows.append((cell // BUCKETS).astype(np.int32))
        cols.append((cell % BUCKETS).astype(np.int32))
    rows, cols, vals = map(np.concatenate, (rows, cols, vals))
    all_n = np.maximum(np.bincount(rows, vals, len(y)), 1)
    vals = (vals / all_n[rows]).astype(np.float32)
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    train = ~held
    # naive Bayes log-count ratios over presence
    p = 1 + np.bincount(cols[train[rows] & (y[rows] > 0)], minlength=BUCKETS)
    q = 1 + np.bincount(cols[train[rows] & (y[rows] == 0)], minlength=BUCKETS)
    ratio = np.log((p / (y[train].sum() + 2)) / (q / ((1 - y[train]).sum() + 2))).astype(np.float32)
    x = vals * ratio[cols] * 100
    indptr = np.searchsorted(rows, np.arange(len(y) + 1))
    empty = np.diff(indptr) == 0
    z_of = lambda w: np.where(empty, 0, np.add.reduceat(np.append(x * w[cols], np.float32(0)), indptr[:-1]))
    w, b = np.ones(BUCKETS, np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    n_train = train.sum()
    for t in range(1, rounds + 1):  # Adam, full batch
        g = np.where(train, 1 / (1 + np.exp(-np.clip(z_of(w) + b, -30, 30))) - y, 0) / n_train
        gw = np.bincount(cols, x * g[rows], BUCKETS).astype(np.float32) + penalty * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w = w - 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b = b - 0.1 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    test = held if held.any() else train
    prob = 1 / (1 + np.exp(-np.clip(z_of(w) + b, -30, 30)))[test]
    truth = y[test]
    weight = np.where(truth > 0, share / truth.mean(), (1 - share) / (1 - truth.mean()))
    order = np.argsort(-prob, kind="stable")
    hit, fired = np.cumsum((weight * truth)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (fired + (weight * truth).sum())
    k = int(np.argmax(f1))
    below = prob[order][k + 1] if k + 1 < len(order) else 0.0
    return NBModel((w * ratio * 100).astype(np.float32), float(b), float((prob[order][k] + below) / 2))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> NBModel:
    """Fits in one task on at most ``sample`` labelled rows; the model comes back as bytes."""
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("y")).dropna().groupBy("l_id").agg((F.max("y") > 0).cast("int").alias("y"))
    count = {int(r["y"]): r["count"] for r in known.groupBy("y").count().collect()}
    share = count.get(1, 0) / max(1, sum(count.values()))
    half = lambda y: known.filter(F.col("y") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(sample // 2)
    chosen = half(1).unionByName(half(0))  # at most SAMPLE rows of two numbers, so it can be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("l_id"), "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "l_id")
    rows = rows.orderBy(F.xxhash64("l_id"), "l_id", F.xxhash64("text")).limit(sample)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("l_id", "ascending"), ("text", "ascending")])
        mixed = np.random.default_rng(5).permutation(table.num_rows)
        table = table.take(pa.array(mixed))
        model = fit(table.column("text").combine_chunks(), table.column("y").to_numpy().astype(np.float64), share)
        return pa.table({"weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": [model.bias], "threshold": [model.threshold]})

    got = rows.select("l_id", "text", "y", F.lit(0).alias("one")).groupBy("one").applyInArrow(run, "weights binary, bias double, threshold double").first()
    if got is None:
        return fit(pa.array([], pa.string()), np.zeros(0), share)
    return NBModel(np.frombuffer(bytes(got.weights), np.float32), got.bias, got.threshold)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, toxicity, toxic: a row for each document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches):
        for batch in slices(batches):
            score = model.value.score(batch.column(1))
            none = np.isnan(score)
            toxic = np.where(none, False, score >= model.value.threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, mask=none), pa.array(toxic)], names=["doc_id", "toxicity", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, toxicity double, toxic boolean")
