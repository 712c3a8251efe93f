"""Cases of the first round of advice."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import ann, katz_words, queries


def brute_words(texts, least=katz_words.LEAST):
    """log P of each text over words, order 3, by the formulas, from dictionaries."""
    docs = [t.split() for t in texts]
    c = [Counter(tuple(w[i : i + n]) for w in docs for i in range(len(w) - n + 1)) for n in range(4)]
    d = katz_words.discounts({(n, r): k for n in (2, 3) for r, k in Counter(c[n].values()).items()}, 3)
    total, distinct = sum(c[1].values()), len(c[1])
    follow = {}
    for n in (2, 3):
        for g, r in c[n].items():
            follow.setdefault(g[:-1], {})[g[-1]] = r

    def p(h, w):
        if not h:
            return (c[1][(w,)] + 1) / (total + distinct + 1)
        rows = follow.get(h, {})
        kept = {x: r for x, r in rows.items() if r >= (least if len(h) == 2 else 1)}
        if not kept:
            return p(h[1:], w)
        ch = sum(rows.values())
        mass = {x: d.get((len(h) + 1, r), 1.0) * r / ch for x, r in kept.items()}
        m, low = sum(mass.values()), sum(p(h[1:], x) for x in kept)
        scale = ch / ((ch + 1) * m) if m > 1 - 1e-12 else 1.0
        return mass[w] * scale if w in kept else (1 - m * scale) / (1 - low) * p(h[1:], w)

    return [sum(math.log(p(tuple(w[max(0, i - 2) : i]), w[i])) for i in range(len(w))) for w in docs]


def prose(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(["ab", "cd", "é", "ab cd ab", "gh", f"w{r.randint(0, 9)}", "ij  kl\n"]) for _ in range(r.randint(1, 40))) for _ in range(n)]


def test_op7_scores_word_trigrams_of_all_documents(spark, tmp_path):
    texts = [*prose(60, 3), "one", "ab cd"]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[1]), (90, None), (91, " \n")]
    want = dict(zip(rows, brute_words([t or "" for _, t in rows])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (queries.op7_katz_scoring(spark, str(tmp_path)), katz_words.scored(docs, 300), katz_words.scored(docs, 300, 20), katz_words.scored(docs, 300, 20, slice_bytes=200, n_frequent=3)):  # one bucket, many, spread words, words spelled out
        out = out.collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((i is None, i or 0) for i, _ in rows)
        for r in out:
            text = dict(rows)[r.doc_id]
            assert r.n_bytes == len((text or "").encode())
            if r.doc_id in (90, 91):
                assert r.log_prob is None and r.bits_per_byte is None
            else:
                assert r.log_prob == pytest.approx(want[r.doc_id, text], rel=1e-9)
                assert r.bits_per_byte == pytest.approx(-r.log_prob / r.n_bytes / math.log(2))


def test_op7_keeps_trigrams_seen_once_if_told(spark):
    texts = prose(40, 8)
    out = katz_words.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 500, least=1).orderBy("doc_id").collect()
    assert [r.log_prob for r in out] == pytest.approx(brute_words(texts, 1), rel=1e-9)


def test_op7_shuffled_words_score_worse(spark):
    r = random.Random(5)
    sentences = [[f"w{r.randint(0, 300)}" for _ in range(12)] for _ in range(60)]
    texts = [" ".join(w for s in r.sample(sentences, 20) for w in s) for _ in range(60)]
    shuffled = texts[0].split()
    r.shuffle(shuffled)
    docs = spark.createDataFrame([*enumerate(texts), (100, " ".join(shuffled))], "doc_id long, text string")
    bits = {x.doc_id: x.bits_per_byte for x in katz_words.scored(docs).collect()}
    assert bits[100] > 1.5 * max(b for i, b in bits.items() if i < 100)
    assert katz_words.scored(docs.limit(0)).count() == 0


def test_op5_sparse_regions_get_their_neighbours(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 64))
    x = np.concatenate([centres[r.integers(0, 40, 1170)] + 0.01 * r.normal(size=(1170, 64)), r.normal(size=(30, 64))])
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for row in ann.neighbours(t).collect():
        found.setdefault(row.vec_id, set()).add(row.neighbour_id)
    assert all(len(found.get(i, ())) == 10 for i in range(1200))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    true = np.argsort(-s, axis=1)[:, :10]
    assert all(len(found[i] & set(true[i].tolist())) >= 9 for i in range(1170, 1200))


def test_op5_many_vectors_of_one_id_take_one_place(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=64)
    near = [(7, (base + 0.001 * r.normal(size=64)).tolist()) for _ in range(15)]
    rest = [(i, (base + 0.1 * r.normal(size=64)).tolist()) for i in range(100, 130)]
    t = spark.createDataFrame([(1, base.tolist()), *near, *rest], "vec_id long, embedding array<float>")
    found = [x.neighbour_id for x in ann.neighbours(t, radius=64).collect() if x.vec_id == 1]
    assert len(found) == len(set(found)) == 10 and 7 in found
