"""Each operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import random

import duckdb
import pytest

import corpus_pipeline
from siltstone.llm import ann, decontaminate, html_extract, katz_words, mixing, quality_rules, queries, repeats, simhash_vp, substring_dedup, suffix_dedup, toxicity

CLASH = "k_id string, at int, h long, removed_words string, words int, n int, c0 int, text2 string, shard int, _score double, chunk int, key int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))


LONG = words(20_000, 1)
A = words(120, 2)


def rows():
    extra = ("x", 1, 2, None, 3, 4, 5, "y", 6, 0.5, 7, 8)
    base = [
        (None, words(80, 3), "en", "s1"), (1, None, "en", "s1"), (2, "", None, "s1"), (3, " \n\t ", "en", None), (4, LONG, "en", "s2"), (5, A, "en", "s1"), (5, A, "en", "s1"),
        (6, A, "en", "s2"), (7, "one two", "de", None), (8, A + " " + words(70, 4), "en", "s1"), (8, words(60, 5), "en", "s1"), (9, "w " * 300, "en", "s2"), (None, None, None, None),
    ]
    return [(i, t, lang, s, None if t is None else len(t), *extra) for i, t, lang, s in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None), (9, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def got(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("f", [suffix_dedup.suffix_dedup, substring_dedup.substring_dedup])
def test_repeats(docs, empty, f):
    out = f(docs)
    assert out.columns == [*docs.columns, "removed_words"]
    rows_ = out.collect()
    assert len(rows_) == len(rows())
    by = {}
    for r in rows_:
        by.setdefault(r[0], []).append((r[1], r[-1]))
    assert by[5] == [(A, 0), (A, 0)]  # a row given twice is one document
    assert by[6] == [("", 120)]
    assert sorted(x[1] for x in by[8]) == [0, 120]
    assert by[4] == [(LONG, 0)] and by[1] == [(None, 0)] and by[2] == [("", 0)]
    assert by[9][0] == ("w ", 299)  # one period of a periodic text stays
    left = repeats.what_is_left(out, docs.columns)
    assert left.columns == docs.columns and 6 not in [r[0] for r in left.collect()]
    assert {r[0]: r[4] for r in left.collect()}[9] == 2
    assert f(empty).count() == 0


def test_near_duplicates(docs, empty):
    groups = got(simhash_vp.near_duplicates(docs))
    assert any(g["kept_id"] == 5 and g["doc_ids"] == [5, 5, 6] and g["n_docs"] == 3 for g in groups)
    kept = simhash_vp.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r[0] is not None, r[0] or 0) for r in kept.collect())
    assert (True, 6) not in ids and ids.count((True, 5)) == 1 and (True, 1) in ids and (True, 2) in ids and (True, 3) in ids
    assert simhash_vp.near_duplicates(empty).count() == 0 and simhash_vp.without_near_duplicates(empty).count() == 0


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, " ".join(A.split()[10:40])), (2, None), (3, ""), (None, " ".join(LONG.split()[500:520])), (1, " ".join(A.split()[10:40]))], "item_id long, text string")
    found = got(decontaminate.contaminated(docs, bench))
    assert sorted((r["doc_id"], r["item_id"] or 0, r["match_words"], r["doc_word"], r["item_word"]) for r in found) == [(4, 0, 20, 500, 0), (5, 1, 30, 10, 0), (5, 1, 30, 10, 0), (6, 1, 30, 10, 0), (8, 1, 30, 10, 0)]
    assert got(decontaminate.contaminated(docs, bench, chunk_bytes=100)) != [] and sorted(map(str, got(decontaminate.contaminated(docs, bench, chunk_bytes=100)))) == sorted(map(str, found))
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows()) - 5
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == len(rows())
    assert decontaminate.contaminated(empty, bench).count() == 0


def test_decontamination_of_any_length_as_in_sql(spark):
    """Items of one word up, ties, repeated rows and items, null ids and texts, as in the SQL."""
    common = "the of and the of and the of and the of and the of and"
    docs = [(1, "x the of and y"), (1, "x the of and y"), (None, "the of and"), (2, None), (3, " "), (4, f"q {common} z {common}"), (5, "lone"), (6, "the of"), (7, "a b c d e f g h i j k l m n o p the a b c d e f g h i j k l m n o p")]
    items = [(1, "the of and"), (1, "the of and"), (2, "lone"), (3, None), (4, ""), (None, common), (5, "0 a b c d e f g h i j k l m n o p 1"), (5, "of and y")]
    out = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    con = duckdb.connect()
    for name, key, data in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.sql(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", data)
    want = sorted(map(str, con.sql(queries.DECONTAMINATION_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in out.collect()) == want
    assert any(eval(x)[:2] == (5, 2) for x in want) and str((7, 5, 16, 0, 1)) in want  # the earliest of two equal places
    few = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), short_item=8)
    assert {r.item_id for r in few.collect()} == {None, 5}


def test_mixing(docs, empty):
    out = got(mixing.mixed(docs, block=64, shard=8))
    assert {r["source"] for r in out} <= {"s1", "s2", None} and {r["source"] for r in out} >= {"s1", "s2"}
    assert [r["slot"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"])) if r["shard"] == 0] == list(range(8))
    assert all(r["n_words"] == len(r["text"].split(" ")) <= 64 for r in out)
    assert mixing.mixed(empty).count() == 0
    assert {r["source"] for r in got(mixing.mixed(docs, {"s1": 1, "nothing": 5}, block=64, shard=8))} == {"s1"}


def test_mixing_ties_as_in_sql(spark):
    """Rows given twice, null ids, ids far apart and a null source, as in the SQL."""
    many = [(1, "a b c " * 300, "s"), (1, "a b c " * 300, "s"), (None, "q w e " * 200, "s"), (None, "z z", "s"), (-5, "neg one", "s"), (1 << 62, "x y " * 900, None), (7, None, "s"), (3, " ", "s"), (-(1 << 62), "u v", "s"), (1, "aa b", "s")]
    out = sorted(tuple(r) for r in mixing.mixed(spark.createDataFrame(many, "doc_id long, text string, source string")).collect())
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", many)
    assert out == sorted(con.sql(mixing.SQL).fetchall())
    first = next(r for r in out if r[2] == "s" and r[4] == 0)
    assert first[7] is None and first[6] == 2  # the texts without an id come first
    huge = mixing.mixed(spark.createDataFrame(many, "doc_id long, text string, source string"), {"s": 1 << 40}, block=64)
    assert huge.count() == len({r.block for r in huge.collect()})


def test_toxicity(docs, empty, labels, no_labels):
    out = got(toxicity.toxicity(docs, labels))
    assert len(out) == len(rows())
    assert all((r["toxicity"] is None) == (r["doc_id"] in (1, 2, 3) or (r["doc_id"] is None and r["toxicity"] is None)) for r in out)
    assert not any(r["toxic"] for r in out if r["toxicity"] is None)
    assert not any(r["toxic"] for r in got(toxicity.toxicity(docs, no_labels)))
    assert toxicity.toxicity(empty, labels).count() == 0


def test_quality(docs, empty, labels, no_labels):
    out = got(quality_rules.quality(docs, labels))
    assert len(out) == len(rows()) and all(r["quality_score"] == 0 and not r["keep"] for r in out if r["doc_id"] in (1, 2, 3))
    kept = quality_rules.good(docs, no_labels)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {None, 4, 5, 6, 7, 8, 9}
    assert quality_rules.good(empty, labels).count() == 0


def test_katz(docs, empty):
    out = got(katz_words.scored(docs))
    assert len(out) == len(rows())
    assert all((r["log_prob"] is None) == (r["doc_id"] in (1, 2, 3) or (r["doc_id"] is None and not r["n_bytes"])) for r in out)
    assert sorted(r["n_bytes"] for r in out)[-1] == len(LONG)
    five = [r["log_prob"] for r in out if r["doc_id"] == 5]
    assert len(five) == 2 and five[0] == pytest.approx(five[1])
    assert katz_words.scored(empty).count() == 0


def test_ann(spark):
    v = [[1.0, 0.0, 0.1], [0.9, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.9, 0.1]]
    data = [(i, x, i) for i, x in enumerate(v)] + [(0, v[0], 9), (None, v[1], 1), (7, None, 1), (8, [0.0, 0.0, 0.0], 1), (9, [1.0], 1), (10, [1.0, None, 0.0], 1), (11, [1.0, float("nan"), 0.0], 1)]
    t = spark.createDataFrame(data, "vec_id long, embedding array<float>, shard int")
    out = got(ann.neighbours(t, 2))
    assert {r["vec_id"] for r in out} == {0, 1, 2, 3}
    assert {(r["vec_id"], r["neighbour_id"]) for r in out if r["rank"] == 1} == {(0, 1), (1, 0), (2, 3), (3, 2)}
    assert ann.neighbours(t.limit(0)).count() == 0


def test_html(spark):
    foot = "same footer on every page of this host here"
    long_ = " ".join(f"w{i}" for i in range(5000))
    data = [
        (1, "http://a.org/1", f"<html><head><title>x</title></head><body><p>first page text</p><script>var a='</p>'</script><div>{foot}</div></body></html>"), (2, "http://A.org:80/2", f"<p>second one</p><div>{foot}</div>"),
        (3, "http://b.org/", f"<p>other host</p><div>{foot}</div>"), (4, None, f"no url {foot}"), (4, None, f"no url {foot}"), (5, "http://a.org/3", None), (6, "http://a.org/4", ""), (None, "http://c.org", f"<p>{long_}"),
    ]
    t = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS at", "'z' AS text")
    for size in (html_extract.BUCKET_BYTES, 2000):  # one bucket, many
        out = {}
        for r in got(html_extract.main_text(t, bucket_bytes=size)):
            out.setdefault(r["page_id"], []).append((r["text"], r["removed_words"]))
        assert out[1] == [("first page text", 9)] and out[2] == [("second one", 9)]
        assert out[3] == [(f"other host {foot}", 0)] and out[4] == [(f"no url {foot}", 0)] * 2
        assert out[5] == [(None, 0)] and out[6] == [("", 0)] and out[None] == [(long_, 0)]
    assert html_extract.main_text(t.limit(0)).count() == 0


def test_html_entities_and_open_elements(spark):
    data = [(1, None, "<p>caf&eacute; &#8217;q&#x2019; a&nbsp;b&#10;c &amp;lt; &bogus; &#x1; R&amp;D</p>"), (2, None, "<script>var open = 1; <p>x"), (3, None, "<div>a<b>c</b")]
    out = {r["page_id"]: r["text"] for r in got(html_extract.main_text(spark.createDataFrame(data, "page_id long, url string, html string")))}
    assert out[1] == "café ’q’ a b c &lt; &bogus; &#x1; R&D"
    assert out[2] == "var open = 1; x" and out[3] == "a c</b"


def test_pipeline_stages_on_edges(spark, docs, empty, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(A.split()[:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, empty):
        now = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            if k < 4:
                assert out.columns == table.columns
            else:
                out.count()
            now = out
