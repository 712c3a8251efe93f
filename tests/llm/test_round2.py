"""Classifiers against brute force and on held-out rows, hot passages, verification of equal hashes, huge texts."""

import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import decontaminate, html_extract, katz_words, mixing, quality_rules, repeats, simhash_vp, substring_dedup, suffix_dedup, toxicity

SF = "/root/testdata/sf0.01"
MASK = (1 << 64) - 1


def mixed64(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def brute_grams(word):
    """The buckets of a word's character n-grams, one by one."""
    padded = f" {word.lower()} "
    out = []
    for n in toxicity.ORDERS:
        for i in range(len(padded) - n + 1):
            h = 0
            for c in padded[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) & MASK
            out.append(mixed64((h + (n << 56)) & MASK) % toxicity.BUCKETS)
    return out


def split(text):
    return [w for w in re.split(r"[ \t\n\r\f\v]+", text or "") if w]


def halves(spark, column):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("doc_id % 3 = 0").select("doc_id", "quality", "toxic")
    own = docs.join(F.broadcast(labels.select("doc_id")), "doc_id").cache()
    return own, labels.filter("doc_id % 2 = 0"), {r.doc_id: r[column] for r in labels.filter("doc_id % 2 = 1").collect()}


def test_op6_scores_as_brute_force_and_holds_on_other_rows(spark):
    docs, known, held = halves(spark, "toxic")
    rows = toxicity.toxicity(docs, known).collect()
    model = toxicity.train(docs, known)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in sorted(rows)[:60]:
        grams = [k for w in split(texts[r.doc_id]) for k in brute_grams(w)]
        if not grams:
            assert r.toxicity is None and not r.toxic
            continue
        z = model.bias + float(np.mean(model.weights[grams].astype(float)))
        assert r.toxicity == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), rel=1e-5) and r.toxic == (r.toxicity >= model.threshold)
    right = [r.toxic == (held[r.doc_id] > 0) for r in rows if r.doc_id in held]
    assert len(right) > 300 and np.mean(right) > 0.95


def test_op6_counts_characters_not_bytes():
    import pyarrow as pa

    key, size = toxicity.grams(pa.array(["é", "naïve", "😀x"]))
    assert size.tolist() == [1, 5 + 4 + 3, 2 + 1]
    assert key.tolist() == brute_grams("é") + [k for w in ("naïve", "😀x") for k in brute_grams(w)]


def brute_statistics(text):
    t = text or ""
    words, lines = split(t), t.split("\n")
    bare, n, chars = t.strip(" \t\n\r\f\v"), max(1, len(words)), max(1, len(t))
    upper = sum(unicodedata.category(c) == "Lu" for c in t)
    return [
        len(words), len(bare) / n, len(set(words)) / n, sum(t.count(c) for c in quality_rules.SYMBOLS) / n, t.count("|") / n, t.count("!") / n, t.count(".") / n, t.count(",") / n,
        upper / chars, len(re.findall("[0-9]", t)) / chars, len(set(lines)) / len(lines), chars / len(lines),
    ]


def test_op10_scores_as_brute_force_and_holds_on_other_rows(spark):
    docs, known, held = halves(spark, "quality")
    rows = {r.doc_id: r for r in quality_rules.quality(docs, known).collect()}
    model = quality_rules.train(docs, known)
    for i, text in sorted((r.doc_id, r.text) for r in docs.collect())[:300]:
        x = brute_statistics(text)
        z = model.bias
        for rule, w in zip(model.rules, model.weights):
            z += w if all((x[k] > value) == above for k, above, value in rule.terms) else 0.0
        want = 1 / (1 + math.exp(-z)) if x[0] else 0.0
        assert rows[i].quality_score == pytest.approx(want, rel=1e-9) and rows[i].keep == (want >= quality_rules.THRESHOLD)
    right = [rows[i].keep == (q > 0) for i, q in held.items() if i in rows]
    assert len(right) > 300 and np.mean(right) > 0.97


def test_classifiers_with_repeated_rows_and_conflicting_labels(spark):
    r = random.Random(1)
    bad = [(i, " ".join(r.choice(["zork", "blag", "grim"]) for _ in range(40)), 0, 1) for i in range(0, 60, 2)]
    good = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + r.choice([".", ",", ""]) for _ in range(40)), 1, 0) for i in range(1, 60, 2)]
    rows = [*bad, *good, *bad[:5], *[bad[0]] * 50]  # rows given twice and often
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = [(i, q, t) for i, _, q, t in [*bad, *good]] + [(1, 0, 1), (1, 1, 0), (2, None, None)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels, sample=40).collect()  # the sample is less than the rows of one id
    assert len(out) == len(rows)
    by = {x.doc_id: x.toxicity for x in out}
    assert np.mean([by[i] for i in range(0, 60, 2)]) > np.mean([by[i] for i in range(3, 60, 2)])
    out = quality_rules.quality(docs, labels, sample=40).collect()
    assert len(out) == len(rows) and len({(x.doc_id, x.quality_score) for x in out}) == 60
    known = toxicity.train(docs, labels)
    assert known.weights.shape == (toxicity.BUCKETS,)


def test_op2_one_passage_in_many_documents(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    n = 3000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("a"), F.col("id").cast("string"), F.lit(f" {passage} z"), F.col("id").cast("string")).alias("text"))
    for f in (suffix_dedup.suffix_dedup, substring_dedup.substring_dedup):
        out = {r.doc_id: (r.text, r.removed_words) for r in f(docs).collect()}
        assert out[0] == (f"a0 {passage} z0", 0)
        assert all(out[i] == (f"a{i} z{i}", 60) for i in range(1, n))


def test_op2_large_buckets_are_merged(spark, monkeypatch):
    """Chunks of a few strips: buckets go on over chunks, equal strips are held once."""
    import pyarrow as pa

    batches = []
    for k in range(40):
        words = " ".join(f"w{i}" for i in range(k // 20 * 3, k // 20 * 3 + 14))
        batches.append(pa.RecordBatch.from_arrays([pa.array([k]), pa.array([5 << 32]), pa.array([7 + k // 20]), pa.array([2], pa.int32()), pa.array([3], pa.int32()), pa.array([words])], names=["k_id", "at", "h", "ahead", "starts", "words"]))
    held = suffix_dedup._held([b.set_column(5, "words", b.column(5).dictionary_encode()) for b in batches])
    assert len(held.column("words").combine_chunks().dictionary) == 2
    rest = suffix_dedup._compact(held.slice(20))
    assert len(rest.column("words").combine_chunks().dictionary) == 1 and rest.column("words").to_pylist() == held.column("words").to_pylist()[20:]
    found = suffix_dedup._later(held, 12)
    assert found.num_rows == 19 * 3 * 2 and set(found.column(0).to_pylist()) == set(range(40)) - {0, 20}


def test_op8_compares_words_before_it_cuts(spark):
    """Places that claim a first place with other words are not cut; of a run only the windows that are equal are."""
    a = " ".join(f"x{i}" for i in range(20))
    b = " ".join([*(f"x{i}" for i in range(15)), *(f"y{i}" for i in range(5))])
    docs = spark.createDataFrame([(1, a), (2, b), (3, "z " * 20)], "doc_id long, text string")
    keys = repeats.keyed(docs)
    text = {r.k_id: r.k_text & 0xFFFFFFFF for r in keys.collect()}
    rows = [(d, p << 32 | text[d], (1, p << 32 | text[1])) for d in (2, 3) for p in range(11)]
    claims = spark.createDataFrame(rows, "k_id long, at long, lo struct<k_id: long, at: long>")
    found = {r.k_id: (r.text, r.removed_words) for r in substring_dedup.cut_where_equal(keys, claims, 10).collect()}
    assert found == {1: (a, 0), 2: (b[b.index("y0") :], 15), 3: ("z " * 20, 0)}


def huge():
    r = random.Random(9)
    words = " ".join(r.choice(["abc", "defg", "hi", "jklmn"]) + str(r.randint(0, 99999)) for _ in range(250_000))
    return [(1, words), (2, "q" * 3_000_000), (3, "q" * 3_000_000 + " tail"), (4, words)]


def test_huge_texts_and_tokens(spark, tmp_path):
    """Texts of several megabytes, and a single token of several."""
    rows = huge()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for f in (suffix_dedup.suffix_dedup, substring_dedup.substring_dedup):
        out = {r.doc_id: r.removed_words for r in f(docs).select("doc_id", "removed_words").collect()}
        assert out == {1: 0, 2: 0, 3: 0, 4: 250_000}
    bench = spark.createDataFrame([(1, " ".join(rows[0][1].split()[200_000:200_020])), (2, "tail")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.doc_word) for r in decontaminate.contaminated(docs, bench).collect()) == [(1, 1, 200_000), (3, 2, 1), (4, 1, 200_000)]
    assert sum(r.n_words for r in mixing.mixed(docs).select("n_words").collect()) >= 500_000
    assert {r.doc_id: r.n_bytes for r in katz_words.scored(docs).collect()} == {i: len(t) for i, t in rows}
    assert [g.doc_ids for g in simhash_vp.near_duplicates(docs).collect()] == [[1, 4]]
    pages = spark.createDataFrame([(i, "http://h", f"<p>{t}</p>") for i, t in rows], "page_id long, url string, html string")
    out = {r.page_id: (r.n_words, r.removed_words) for r in html_extract.main_text(pages).select("page_id", "n_words", "removed_words").collect()}
    assert out == {1: (0, 250_000), 2: (1, 0), 3: (2, 0), 4: (0, 250_000)}
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 4 and quality_rules.quality(docs, labels).count() == 4


def brute_blocks(pages, n):
    """Of (page, host, words) the main words, window by window."""
    where = {}
    for page, host, words in pages:
        for p in range(len(words) - n + 1):
            where.setdefault((host, tuple(words[p : p + n])), set()).add(page)
    out = {}
    for page, host, words in pages:
        gone = {q for p in range(len(words) - n + 1) if len(where[host, tuple(words[p : p + n])]) > 1 for q in range(p, p + n)}
        out[page] = " ".join(w for p, w in enumerate(words) if p not in gone)
    return out


@pytest.mark.parametrize("size", [1 << 30, 500])
def test_op4_against_brute_force(spark, size):
    r = random.Random(4)
    shared = [" ".join(r.choice("abc") for _ in range(r.randint(3, 12))) for _ in range(8)]
    pages = []
    for i in range(60):
        parts = [r.choice(shared) if r.random() < 0.5 else " ".join(r.choice("abcdefg") for _ in range(r.randint(1, 15))) for _ in range(r.randint(0, 6))]
        pages.append((i, f"http://h{i % 3}/{i}", "".join(f"<p>{x}</p>" for x in parts)))
    want = brute_blocks([(i, i % 3, h.replace("<p>", " ").replace("</p>", " ").split()) for i, _, h in pages], 5)
    out = html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5, "page_id"), 5, 3, size)
    assert {x.page_id: x.text.replace("\n", " ") for x in out.collect()} == want


def test_pipeline_docstrings_name_the_cases():
    for _, stage in corpus_pipeline.STAGES:
        assert all(w in stage.__doc__.lower() for w in ("null", "empty", "twice"))
