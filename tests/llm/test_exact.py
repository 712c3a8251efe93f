"""The operators against brute force, exact identities and held-out accuracy."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from siltstone.llm import ann, mixing, quality_rules, simhash_vp, substring_dedup, suffix_dedup, toxicity
from siltstone.llm.text import PIECE

SF = "/root/testdata/sf0.001"


def brute_cut(docs, n):
    """docs: (id, text). The rule of repeats.py, window by window."""
    seen, gone = set(), {}
    order = sorted(range(len(docs)), key=lambda i: docs[i][0])
    for i in order:
        w = docs[i][1].split()
        gone[i] = set()
        for p in range(len(w) - n + 1):
            key = tuple(w[p : p + n])
            if key in seen:
                gone[i].update(range(p, p + n))
            seen.add(key)
    out = {}
    for i, (d, t) in enumerate(docs):
        out[d] = "".join(p for k, p in enumerate(PIECE.findall(t)) if k not in gone[i])
    return out


def test_cover_property():
    for v, cover in substring_dedup.COVERS.items():
        c = set(cover)
        for d in range(v):
            assert any(s in c and (s + d) % v in c for s in range(v))


def test_repeats_against_brute_force(spark):
    r = random.Random(5)
    docs = []
    for i in range(60):
        w = [r.choice("ab") for _ in range(r.randint(0, 60))]
        if docs and r.random() < 0.6:
            other = r.choice(docs)[1].split()
            a = r.randint(0, len(other))
            w[len(w) // 2 : len(w) // 2] = other[a : a + 30]
        docs.append((i, " ".join(w)))
    want = brute_cut(docs, 12)
    t = spark.createDataFrame(docs, "doc_id long, text string")
    for out in (substring_dedup.substring_dedup(t, 12, 7), suffix_dedup.suffix_dedup(t, 12, 4)):
        assert {x.doc_id: x.text for x in out.collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60), st.integers(1, 9))
def test_suffix_sort(tokens, depth):
    t = np.array(tokens + [7] * depth, np.uint64)
    s = suffix_dedup.Suffixes(t, depth)
    at = np.arange(len(tokens))
    _, order = s.sort(np.zeros(len(at), np.int64), at)
    keys = [tuple(t[i : i + depth]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(len(tokens)))


def test_vantage_point_pairs_are_exact(spark):
    r = np.random.default_rng(3)
    f = r.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    near = f[:200].copy()
    for row in near:
        for b in r.choice(128, r.integers(0, 30), replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    f = np.unique(np.concatenate([f, near]), axis=0)
    d = np.bitwise_count(f[:, None, 0] ^ f[None, :, 0]).astype(int) + np.bitwise_count(f[:, None, 1] ^ f[None, :, 1])
    i, j = np.nonzero(np.triu(d <= 23, 1))
    s = f.view(np.int64)
    want = Counter(frozenset([tuple(s[a]), tuple(s[b])]) for a, b in zip(i, j))
    t = spark.createDataFrame([tuple(map(int, x)) for x in s], "f0 long, f1 long")
    for depth, home in ((3, 1000), (4, 1000), (3, 20)):  # the last: leaves in groups
        assert Counter(frozenset([(p.a0, p.a1), (p.b0, p.b1)]) for p in simhash_vp.pairs(t, 23, depth, home).collect()) == want


def test_near_copies_fall_together(spark):
    r = random.Random(1)
    base = [[f"w{r.randint(0, 4000)}" for _ in range(200)] for _ in range(30)]
    docs = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:15]):
        c = list(w)
        for p in r.sample(range(200), 6):
            c[p] = f"x{p}"
        docs.append((100 + i, " ".join(c).replace("w1", "W1")))
    groups = simhash_vp.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(sorted(g.doc_ids) for g in groups) == [[i, 100 + i] for i in range(15)]


def test_permutation_and_round_trip(spark):
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(i * 7 % 50 + 1)), "a" if i % 3 else "b") for i in range(90)], "doc_id long, text string, source string")
    pieces = mixing.packed(docs, 16).groupBy("src", "b").agg({"pos": "min"}).count()
    src = mixing.sources(mixing.counted(docs), 16)
    total = {r.src: r.blocks for r in src.collect()}
    assert pieces == sum(total.values())
    stream = {}
    for r in sorted(mixing.packed(docs, 16).collect(), key=lambda r: (r.src, r.b, r.pos)):
        stream.setdefault(r.src, []).extend(r.piece.split(" "))
    for s in ("a", "b"):
        want = [w for d in docs.filter(f"source = '{s}'").orderBy("doc_id").collect() for w in [*d.text.split(" "), mixing.END]]
        assert stream[f"s{s}"] == want
    slots = mixing.slots(src, 8).collect()
    for s, n in total.items():
        for epoch in {x.epoch for x in slots if x.src == s}:
            b = [x.block for x in slots if x.src == s and x.epoch == epoch]
            assert len(set(b)) == len(b) and set(b) <= set(range(n))  # no block twice in an epoch


def test_weights_are_met(spark):
    docs = spark.createDataFrame([(i, "w " * 100, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    out = Counter(r.source for r in mixing.mixed(docs, {"a": 3, "b": 1}, block=20, shard=64).select("source").collect())
    assert out["a"] / sum(out.values()) == pytest.approx(0.75, abs=0.05)


def test_ann_recall(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = t.orderBy("vec_id").toPandas()
    m = np.array(x.embedding.tolist())
    s = m @ m.T
    np.fill_diagonal(s, -9)
    true = {(a, b) for a, row in zip(x.vec_id, np.argsort(-s, axis=1)[:, :10]) for b in x.vec_id.values[row]}
    found = {(r.vec_id, r.neighbour_id) for r in ann.neighbours(t).collect()}
    assert len(true & found) >= 0.9 * len(true)
    every = {(r.vec_id, r.neighbour_id) for r in ann.neighbours(t, radius=64, home=20).collect()}  # shards in groups
    assert len(true & every) >= 0.999 * len(true)  # rounding may swap ties


def _labelled(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    x = d.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    return x.sample(1600, random_state=2).reset_index(drop=True)


def test_held_out_accuracy(spark):
    x = _labelled(spark)
    a, b = x[:1100], x[1100:]
    model = toxicity.fit(pa.array(a.text.tolist()), a.toxic.to_numpy(float), float(x.toxic.mean()), rounds=100)
    fired = model.score(pa.array(b.text.tolist())) >= model.threshold
    assert (fired == (b.toxic > 0)).mean() > 0.95
    df = spark.createDataFrame(x[["doc_id", "text", "quality"]])
    n = df.select("doc_id", "quality", *(c.cast("double").alias(k) for k, c in quality_rules.statistics().items())).orderBy("doc_id").toPandas()
    names = quality_rules.NAMES
    assert names == list(quality_rules.statistics())
    m = quality_rules.fit(n[names].to_numpy(float)[:1100], n.quality.to_numpy(float)[:1100])
    test = n[1100:]
    p = m.predict(test[names].to_numpy(float))
    assert ((p >= 0.5) == (test.quality > 0)).mean() > 0.97
    assert 0 < len(m.rules) < 100
    again = {r.doc_id: r.quality_score for r in quality_rules.scored(df.select("doc_id", "text"), m).select("doc_id", "quality_score").collect()}
    assert [again[i] for i in test.doc_id] == pytest.approx(list(p))  # the compiled column is the model


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality_rules.train(docs, labels)
    stats = docs.select("doc_id", *(c.cast("double").alias(k) for k, c in quality_rules.statistics().items())).toPandas()
    p = model.predict(stats[quality_rules.NAMES].to_numpy(float))
    ids = sorted(i for i, ok in zip(stats.doc_id, p >= 0.5) if ok)
    prints = {i: simhash_vp.fingerprints(pa.array([rows[i]]))[1][0] for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= 23:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = [i for i in ids if find(i) == i]
    cut = brute_cut([(i, rows[i]) for i in ids], 50)
    cut = {i: t for i, t in cut.items() if t.strip()}
    items = [r.text.split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 13]) for w in items for k in range(len(w) - 12)} | {tuple(w) for w in items if 8 <= len(w) < 13}
    left = {i: t for i, t in cut.items() if not any(tuple(t.split()[k : k + n]) in grams for n in range(8, 14) for k in range(len(t.split()) - n + 1))}
    source = {r.doc_id: r.source for r in docs.collect()}
    stream = {}
    for i in sorted(left):
        stream.setdefault(source[i], []).extend([*left[i].split(), mixing.END])
    n = sum(-(-len(s) // mixing.BLOCK) for s in stream.values())
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(out) == n and sorted((r.shard, r.slot) for r in out) == [(k // mixing.SHARD, k % mixing.SHARD) for k in range(n)]
    for r in out:
        assert r.text == " ".join(stream[r.source][r.block * mixing.BLOCK : (r.block + 1) * mixing.BLOCK])
