"""Round 2's findings: op5's search, against brute force; op7's hashes and sorts, which cost most of its time."""

import duckdb
import numpy as np
import pyarrow as pa
import xxhash

from siltstone.llm import ann, katz_words, queries

SF = "/root/testdata/sf0.1"


def brute(ids, x, k, every):
    """(vec_id, rank, neighbour_id, cosine): each id by the best of its vectors, ties to the smaller id."""
    x = np.asarray(x, np.float32).astype(float)
    norm = np.sqrt((x * x).sum(1))
    best = {}
    for a in np.flatnonzero(ids % every == 0):
        own = best.setdefault(int(ids[a]), {})
        for b, s in zip(ids.tolist(), np.round(x @ x[a] / norm / norm[a], 6).tolist()):
            if b != ids[a]:
                own[b] = max(s, own.get(b, -2))
    return {(a, r + 1, b, s) for a, own in best.items() for r, (s, b) in enumerate(sorted(((s, b) for b, s in own.items()), key=lambda p: (-p[0], p[1]))[:k])}


def got(rows):
    return {(r.vec_id, r["rank"], r.neighbour_id, r.cosine) for r in rows.collect()}


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")


def test_op5_asks_for_every_fiftieth_id_against_all(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    want = brute(t.vec_id.to_numpy(), np.array(t.embedding.tolist()), 10, 50)
    assert len(want) == 400 and got(queries.op5_ann(spark, SF)) == want


def test_op5_blocks_repeats_and_ties(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(700, 20)), np.repeat(r.normal(size=(6, 20)), 30, axis=0), r.integers(-1, 2, (200, 20)) + 0.0])
    ids = np.concatenate([r.permutation(700), 1000 + r.permutation(180), r.integers(-400, 400, 200)])  # copies under many ids; ids with many vectors
    x[~x.any(axis=1)] = 1
    want = brute(ids, x, 10, 5)
    for name, value in (("VECTORS_BLOCK", 60), ("QUERIES_BLOCK", 50), ("SMALL", 100), ("TILE", (32, 16)), ("CHUNK", 1000), ("HELD", 500)):
        monkeypatch.setattr(ann, name, value)
    assert got(ann.nearest(table(spark, ids, x).repartition(3), every=5, home=200)) == want


def test_op5_work_in_proportion_to_the_queries(monkeypatch):
    r = np.random.default_rng(9)
    x = r.normal(size=(20_000, 64)).astype(np.float32)
    scored = []
    cosines = ann.cosines
    monkeypatch.setattr(ann, "cosines", lambda q, y: scored.append(len(q)) or cosines(q, y))
    best = ann.Best(np.arange(0, 20_000, 50), x[::50], 10)
    for a in range(0, 20_000, 4096):
        best.add(np.arange(a, min(a + 4096, 20_000)), x[a : a + 4096])
    out = best.batch()
    assert out.num_rows == 4000 and sum(scored) < 400 * 150  # of 400 * 20,000 pairs


def test_op5_of_all_vectors_is_exact(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = t.toPandas()
    assert got(ann.neighbours(t)) == brute(x.vec_id.to_numpy(), np.array(x.embedding.tolist()), 10, 1)


def test_op5_as_its_sql(spark):
    r = np.random.default_rng(10)
    odd = [(None, [1.0, 2.0]), (50, None), (50, [1.0]), (50, [0.0, 0.0]), (50, [1.0, None]), (50, [float("nan"), 1.0]), (50, [1.0, float("-inf")]), (50, [])]
    t = spark.createDataFrame([(i, r.integers(-3, 4, 2).astype(float).tolist()) for i in [*range(0, 400, 2), *range(0, 400, 10)]] + odd, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("embeddings", t.toArrow())
    want = set(con.sql(queries.SQL["op5_ann"]).fetchall())
    assert len(want) == 80 and got(ann.nearest(t, every=ann.EVERY)) == want


def test_op7_calls_no_function_for_each_word(monkeypatch):
    called = []
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda w: called.append(w.encode() if isinstance(w, str) else bytes(w)) or 5)
    long = "x" * 100
    own, x, m, y, row = katz_words.places(pa.array([" ".join(f"w{i}" for i in range(1000)), None, f"w1 {long} w2"]))
    assert called == [long.encode()] and len(own) == 1002 and len(set(own.tolist())) == 1002
    assert own[m[1000]] == own[m[1]] and own[m[1002]] == own[m[2]] and own[y[1002]] == own[x[0]] == katz_words.NONE and row[1000] == 2


def test_op7_hashes_tell_words_apart_wherever_they_stand():
    r = np.random.default_rng(7)
    words = ["a", "a\0", "\0", "\0\0", "é", "ab" * 4, "ab" * 4 + "\0"] + ["q" * n for n in range(2, 150)]
    words += ["".join(map(chr, r.integers(97, 99, n))) for n in r.integers(1, 40, 3000)]
    words = list(dict.fromkeys(words))
    of = dict(zip(words, katz_words.hashed(pa.array(words)).tolist()))
    assert len(set(of.values())) == len(words)
    mixed = [words[i] for i in r.permutation(len(words))]
    for column in (pa.array(mixed), pa.array(mixed, pa.large_string()), pa.array([""] + ["z"] + mixed)[2:]):
        assert katz_words.hashed(column).tolist() == [of[w] for w in mixed]
    assert len(katz_words.hashed(pa.array([], pa.string()))) == 0


def test_op7_sorts_as_numpy_does():
    r = np.random.default_rng(9)
    for key in (r.integers(0, 50, 1000), r.integers(0, 1 << 40, 1000), np.zeros(0, np.int64), np.zeros(3, np.int64)):
        for span in (1 << 40, 1 << 62):  # with their places in one number, and without
            assert all(map(np.array_equal, katz_words.ordered(key, span), (np.sort(key), np.argsort(key, kind="stable"))))
            assert all(map(np.array_equal, katz_words.numbered(key, span), np.unique(key, return_inverse=True, return_counts=True)))
        assert np.array_equal(katz_words.once(key - 7), np.unique(key - 7))
