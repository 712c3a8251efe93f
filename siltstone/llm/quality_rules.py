"""Operator 10: quality by a sparse rule ensemble over document statistics.

Boosted trees of depth 3 are grown on the statistics of labelled documents; every path from a root to a node
is a conjunctive rule; a lasso logistic regression (FISTA, the penalty chosen on a held-out fifth) keeps a
few of the rules; and those are compiled into one Spark column expression over the statistics, which are
built-in column expressions too. Scoring is a projection: no shuffle and no Python.

Fitted on at most SAMPLE labelled rows, those with the least hash of doc_id; only their statistics (a dozen
numbers each) reach the driver. Everything else covers all documents.

Defined cases: null text counts as empty; documents without words score 0 and are rejected; null labels
and null ids don't train; of several labels of a document the lowest counts; with labels of one class
only, or none, every document with words scores the share of good labels (1 if there are none); rows given
twice are scored twice; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
TREES = 40
DEPTH = 3
THRESHOLD = 0.5
SYMBOLS = "#$%&*|"


def statistics(text: Column | str = "text") -> dict[str, Column]:
    """Statistics of a text; all are built-in expressions."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    bare = F.btrim(t, F.lit(" \t\n\r\f\x0b"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\r\f\x0B]+"))
    lines = F.split(t, "\n")
    chars = F.greatest(F.length(t), F.lit(1))
    n = F.greatest(F.size(words), F.lit(1))
    without = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return {
        "words": F.size(words).cast("double"),
        "word_length": F.length(bare) / n,
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "symbols": sum((without(c) for c in SYMBOLS), F.lit(0)) / n,
        "bars": without("|") / n,
        "shouts": without("!") / n,
        "stops": without(".") / n,
        "commas": without(",") / n,
        "capitals": F.regexp_count(t, F.lit(r"\p{Lu}")) / chars,
        "digits": F.regexp_count(t, F.lit(r"[0-9]")) / chars,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_length": chars / F.size(lines),
    }


NAMES = ["words", "word_length", "distinct_words", "symbols", "bars", "shouts", "stops", "commas", "capitals", "digits", "distinct_lines", "line_length"]


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is above, value) hold."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, value in self.terms:
            out &= (x[:, k] > value) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, above, value in self.terms:
            c = F.col(NAMES[k])
            out = out & ((c > value) if above else (c <= value))
        return out


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]

    def column(self) -> Column:
        """The probability of good quality, over the columns of statistics()."""
        z = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights):
            z = z + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.when(F.col("words") > 0, 1 / (1 + F.exp(-z))).otherwise(F.lit(0.0))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + sum((w * r.holds(x) for r, w in zip(self.rules, self.weights)), np.zeros(len(x)))
        return np.where(x[:, 0] > 0, 1 / (1 + np.exp(-z)), 0.0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = 0.2, least: int = 10) -> list[Rule]:
    """The paths of boosted trees, without repeats, in a fixed order."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)  # bin > b: x > edges[b]
    f, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    rng = np.random.default_rng(11)
    for _ in range(trees):
        p = _sigmoid(f)
        g, h = y - p, p * (1 - p)
        use = rng.random(len(y)) < 0.5
        stack = [(np.ones(len(y), bool), ())]
        while stack:
            inside, terms = stack.pop()
            rows = np.flatnonzero(inside & use)
            best = (1e-6, -1, -1)
            if len(terms) < depth and len(rows) >= 2 * least:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for k, e in enumerate(edges):
                    if not len(e):
                        continue
                    n = np.bincount(binned[rows, k], minlength=len(e) + 1)
                    sg, sh = (np.cumsum(np.bincount(binned[rows, k], v[rows], len(e) + 1))[:-1] for v in (g, h))
                    left = np.cumsum(n)[:-1]
                    gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                    gain[(left < least) | (len(rows) - left < least)] = 0
                    b = int(np.argmax(gain))
                    if gain[b] > best[0]:
                        best = (gain[b], k, b)
            _, k, b = best
            if k < 0:
                r = np.flatnonzero(inside)
                f[r] += rate * g[r].sum() / (h[r].sum() + 1)
                continue
            for above in (False, True):
                more = (*terms, (k, above, float(edges[k][b])))
                rules[tuple(sorted(more))] = None
                stack.append((inside & ((binned[:, k] > b) == above), more))
    return [Rule(t) for t in rules]


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, start: tuple[float, np.ndarray], rounds: int = 400) -> tuple[float, np.ndarray]:
    """L1 logistic regression by FISTA; the bias isn't penalised. Columns are scaled by their deviation."""
    step = 4 * len(y) / (np.linalg.norm(a, 2) ** 2 + len(y))
    b, w = start
    vb, v, t = b, w, 1.0
    for _ in range(rounds):
        r = _sigmoid(a @ v + vb) - y
        nb, nw = vb - step * r.mean(), v - step * (a.T @ r) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, v = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return b, w


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """The model for statistics x and labels y (1: good)."""
    if len(y) == 0 or y.min() == y.max():
        share = 1.0 if len(y) == 0 else float(y[0])
        return RuleModel(30.0 if share else -30.0, (), ())
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        held = np.zeros(len(y), bool)
    rules = grow(x[~held], y[~held])
    a = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    scale = np.maximum(a[~held].std(axis=0), 1e-3)
    a = a / scale
    fit_a, fit_y = a[~held], y[~held]
    largest = np.abs(fit_a.T @ (fit_y - fit_y.mean())).max(initial=0) / len(fit_y)
    state, best = (float(np.log(fit_y.mean() / (1 - fit_y.mean()))), np.zeros(a.shape[1])), None
    for share in (0.5, 0.2, 0.1, 0.05, 0.02, 0.01):
        state = lasso(fit_a, fit_y, largest * share, state)
        t = held if held.any() else ~held
        p = np.clip(_sigmoid(a[t] @ state[1] + state[0]), 1e-6, 1 - 1e-6)
        loss = -np.mean(y[t] * np.log(p) + (1 - y[t]) * np.log(1 - p))
        if best is None or loss < best[0] - 1e-4:
            best = (loss, state)
    b, w = best[1]
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel(float(b), tuple(rules[k] for k in kept), tuple(float(w[k] / scale[k]) for k in kept))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """Fits on at most ``sample`` labelled documents."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("l_quality"))
        .dropna()
        .groupBy("l_id")
        .agg(F.min("l_quality").alias("l_quality"))
        .orderBy(F.xxhash64("l_id"), "l_id")
        .limit(sample)
    )
    # the sample has at most SAMPLE rows of two numbers, so it can be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("l_id"), "text").join(F.broadcast(chosen), "l_id")
    numbers = rows.select("l_id", "l_quality", *(c.cast("double").alias(n) for n, c in statistics().items()))
    numbers = numbers.orderBy(F.xxhash64("l_id"), "l_id", *NAMES).limit(sample).toPandas()  # also where many rows share an id
    numbers = numbers.sort_values(["l_id", *NAMES])
    numbers = numbers[numbers.words > 0]
    mixed = np.random.default_rng(3).permutation(len(numbers))
    return fit(numbers[NAMES].to_numpy(float)[mixed], (numbers.l_quality.to_numpy() > 0).astype(float)[mixed])


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs (any columns) and a column ``quality_score``; statistics stand aside in a struct, so no name clashes."""
    held = [F.col(c).alias(f"_d{i}") for i, c in enumerate(docs.columns)]
    text = f"_d{docs.columns.index('text')}"
    # a filter on the score must stay above the statistics, or each rule would work them out again: it can't pass a random column
    wide = docs.select(*held).select("*", *(c.cast("double").alias(n) for n, c in statistics(text).items()), F.rand(0).alias("_above"))
    score = F.when(F.col("_above") >= 0, model.column())
    return wide.select(*(F.col(f"_d{i}").alias(c) for i, c in enumerate(docs.columns)), score.alias("quality_score"))


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, quality_score, keep: a row for each document."""
    slim = docs.select("doc_id", "text")
    return scored(slim, train(slim, labels, sample)).select("doc_id", "quality_score", (F.col("quality_score") >= threshold).alias("keep"))


def good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier keeps, all columns as they are."""
    rows = scored(docs, train(docs, labels, sample)).toDF(*(f"_d{i}" for i in range(len(docs.columns))), "_score")
    return rows.filter(F.col("_score") >= threshold).select(*(F.col(f"_d{i}").alias(c) for i, c in enumerate(docs.columns)))
