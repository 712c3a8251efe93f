import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siltstone.operators import catalog, search
from siltstone.plans.engine import Engine, Providers, build_records, ingest
from siltstone.sources import files


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_bm25(spark):
    docs = spark.createDataFrame([("1", "a b"), ("2", "a"), ("3", "c")], "id string, content string")
    score = lambda q: {r.id: r.score for r in search.bm25(docs, q).collect()}
    assert score(["a"]) == pytest.approx({"1": 0.390192, "2": 0.523548, "3": 0.0}, abs=1e-6)
    assert score(["a", "a"]) == pytest.approx({"1": -0.195564, "2": -0.262403, "3": 0.0}, abs=1e-6)
    assert search.bm25_topk(docs, "a a").count() == 0 and search.bm25_topk(docs, "?!").count() == 0
    assert ids(search.bm25_topk(docs, "a b", conjunctive=True)) == ["1"]


def ranked(spark, rows):
    return spark.createDataFrame([(i, s, n + 1) for n, (i, s) in enumerate(rows)], "id string, score double, rank int")


def test_fusion(spark):
    out = search.fused([ranked(spark, [("x", 0.9), ("y", 0.8)]), ranked(spark, [("z", 1.0), ("y", 0.5)])]).orderBy(*search.fused_order()).collect()
    assert [(r.id, r.score) for r in out] == [("y", 0.8), ("x", 0.9), ("z", 1.0)]
    tie = search.fused([ranked(spark, [("x", 1.0)]), ranked(spark, [("z", 1.0)])]).orderBy(*search.fused_order()).collect()
    assert [r.id for r in tie] == ["x", "z"]


def test_limits(spark):
    rows = spark.createDataFrame([("1", "/a/b", "chunk"), ("2", "/a/bc", None), ("3", "/a/b/d", "summary")], "id string, parent_directory string, record_type string")
    get = lambda **k: sorted(r.id for r in search.filtered(rows, **k).collect())
    assert get(folder="/a/b") == ["1", "3"] and get(folder="/a/b", prefix_compat=True) == ["1", "2", "3"]
    assert get(record_types=[]) == [] and get(record_types=["chunk"]) == ["1", "2"] and get() == ["1", "2", "3"]


def test_cosine_prefilters(spark):
    rows = spark.createDataFrame([(f"c{i:02}", [1.0, 0.0], "chunk") for i in range(60)] + [(f"s{i:02}", [0.6, 0.8], "summary") for i in range(40)] + [("n", None, "summary"), ("z", [0.0, 0.0], "summary")], "id string, vector array<float>, record_type string")
    hits = search.cosine_topk(rows, [1.0, 0.0], 10, record_types=["summary"]).collect()
    assert len(hits) == 10 and hits[0].score == pytest.approx(0.6, abs=1e-6)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    (d / "a").mkdir()
    (d / "a" / "one.txt").write_text("alpha beta gamma")
    (d / "a" / "_two.md").write_bytes(b"alpha \xff delta")
    (d / "a" / "copy.txt").write_text("alpha beta gamma")
    (d / ".hidden").mkdir()
    (d / ".hidden" / "x.txt").write_text("secret")
    (d / "page.html").write_text("<h1>Title</h1><p>body</p>")
    (d / "s.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhello")
    with zipfile.ZipFile(d / "z.zip", "w") as z:
        z.writestr("in/ok.txt", "zipped words")
        z.writestr("../bad.txt", "no")
    with tarfile.open(d / "t.tar.gz", "w:gz") as t:
        for name in ("ok.txt", "../bad.txt"):
            m = tarfile.TarInfo(name)
            m.size = 3
            t.addfile(m, io.BytesIO(b"tar"))
    return str(d)


def test_sources(spark, folder):
    every = {r.filename: r for r in files.scan_all(spark, folder).collect()}
    assert set(every) == {"one.txt", "_two.md", "copy.txt", "page.html", "s.srt", "z.zip", "t.tar.gz"}
    assert every["one.txt"].file_hash == every["copy.txt"].file_hash and every["t.tar.gz"].file_type == "archive"
    assert {r.filename for r in files.scan(spark, folder).collect()} == set(every) - {"_two.md"}
    text = {r.filename: r.content for r in files.texts(files.scan_all(spark, folder)).collect()}
    assert text["_two.md"] == "alpha \ufffd delta" and text["page.html"] == "# Title\n\nbody"
    assert [(c.start, c.text) for c in files.cues(files.scan_all(spark, folder)).collect()] == [(1.0, "hello")]
    inside = sorted(r.absolute_path.rsplit("/", 2)[-1] for r in files.unpacked(files.scan_all(spark, folder)).collect())
    assert inside == ["ok.txt", "ok.txt"]
    assert not files.safe_member("../x") and not files.safe_member("/etc/x") and not files.safe_member("C:\\x") and files.safe_member("a/../b")


def test_ingest_and_search(spark, folder, tmp_path):
    table = catalog.Catalog(spark, f"file://{tmp_path}/table")
    assert table.records().count() == 0
    source = files.texts(files.scan_all(spark, folder)).drop("file_modified_at", "size")
    n = ingest(table, source)
    assert n == 6 and ingest(table, source) == 0  # three contents, each a chunk and a summary
    e = Engine(table.records(), providers=Providers(scorer=search.overlap_scorer))
    r = e.search("find alpha delta")
    assert r.verdict == "pass" and r.results.first().filename == "_two.md" and "Results for" in r.answer
    nothing = e.search("zebra")
    assert nothing.verdict == "exhausted" and nothing.retries == 0  # the same query again would find the same
    assert [x.filename for x in e.find_documents("alpha beta").limit(1).collect()] in (["one.txt"], ["copy.txt"])
    assert {x.name: x.value for x in e.status().collect()}["total_files"] == 3
    assert e.folders().count() == 2
    assert table.delete_by_folder(f"{folder}/a") == 4 and table.records().count() == 2
    assert table.delete_by_path(f"{folder}/page.html") == 2
    assert table.upsert(spark.createDataFrame([("q", "text")], "id string, content string")) == 1
    assert table.records().first().record_type == "chunk"


def test_hybrid_limits_and_copies(spark):
    f = catalog.with_metadata(spark.createDataFrame([("/a/1.txt", "red green"), ("/a/2.txt", "red green"), ("/ab/3.txt", "red blue")], "absolute_path string, content string"))
    assert build_records(f).select("absolute_path").distinct().count() == 2
    r = catalog.written(build_records(f, copies=True))
    e = Engine(r)
    hits = e.retrieve("red", folder="/a")[0]
    assert {x.absolute_path for x in hits.collect()} == {"/a/1.txt", "/a/2.txt"}
    assert {x.record_type for x in e.retrieve("red", "chunk")[0].collect()} == {"chunk"}
    assert {x.record_type for x in e.retrieve("red", "summary")[0].collect()} == {"summary"}


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_debounce(spark):
    from siltstone.streaming.ingest import debounced

    rows = spark.sql("SELECT 1 AS user_id, timestamp_millis(x) AS ts, e AS event_type FROM VALUES (0, 'a'), (499, 'b'), (999, 'c'), (1500, 'd') AS t(x, e)")
    assert [(r.event_type, r.n_events) for r in debounced(rows).orderBy("ts").collect()] == [("c", 3), ("d", 1)]


def test_queries_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for t in ("documents", "pages", "embeddings", "orders", "part", "events", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    for name in ("upsert_latest", "list_folders", "clip_windows", "frame_schedule", "recent_history", "progress_rollup", "bm25_topk"):
        got = entry.queries()[name](spark, d)
        columns = sorted(got.columns)
        want = con.sql(entry.oracle_sql()[name]).df()[columns]
        assert sorted(map(tuple, got.select(*columns).toPandas().astype(str).values)) == sorted(map(tuple, want.astype(str).values)), name


def test_lsh_recall(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    v = t.filter("vec_id = 0").first().embedding
    exact = {r.vec_id for r in search.cosine_topk(t, v, 10, key="vec_id", vector="embedding").collect()}
    found = {r.vec_id for r in search.lsh_topk(t, v, 10, key="vec_id", vector="embedding").collect()}
    assert len(exact & found) >= 6 and 0 in found
    assert F is not None
