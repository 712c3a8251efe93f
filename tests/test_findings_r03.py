"""Round 3's findings on the engine's queries."""

import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siltstone.functions import folds
from siltstone.functions import text as tx
from siltstone.operators import catalog, search
from siltstone.plans.engine import Engine
from siltstone.sources import files
from siltstone.streaming.ingest import file_stream


def test_f1_an_answer_from_records_without_times(spark):
    rows = [(f"/c/{n}.txt#0", t, "chunk", f"/c/{n}.txt", f"{n}.txt", "/c", "document", "") for n, t in enumerate(["alpha beta", "gamma delta", "epsilon"])]
    names = "id, content, record_type, absolute_path, filename, parent_directory, file_type, summary".split(", ")
    records = spark.createDataFrame(rows, names).withColumn("vector", tx.hashed_vector()("content"))
    found = Engine(records).search("alpha beta")
    assert found.verdict == "pass" and "[1] Excerpt of 0.txt\nalpha beta" in found.answer


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The documents as one file, and as a folder of files."""
    d = tmp_path_factory.mktemp("tables")
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows.filter("doc_id < 80").repartition(3).write.parquet(str(d / "many" / "documents.parquet"))
    rows.filter("doc_id < 80").coalesce(1).write.parquet(str(d / "aside"))
    (d / "one").mkdir()
    next((d / "aside").glob("*.parquet")).rename(d / "one" / "documents.parquet")
    (d / "one" / "others.parquet").write_bytes(b"")
    return d


@pytest.mark.parametrize("of, within", [("one", ""), ("many", "/*.parquet")])
def test_f2_a_stream_of_a_table_of_one_or_many_files(spark, tables, of, within):
    got = {(r.record_type, r.n, r.files) for r in entry.queries()["stream_ingest"](spark, str(tables / of)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tables / of}/documents.parquet{within}')")
    assert got == set(con.sql(entry.oracle_sql()["stream_ingest"]).fetchall()) and len(got) == 2


def test_f2_patterns_still_choose(spark, tables, tmp_path):
    rows = file_stream(spark, str(tables / "many" / "documents.parquet"), spark.read.parquet(str(tables / "many" / "documents.parquet")).schema, "*-00001-*.parquet")
    q = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    n = spark.read.parquet(str(tmp_path / "out")).agg(F.count("*")).first()[0]
    assert 0 < n < 80


SOME = [None, "", " \n\t ", "one", "Zwölf Boxkämpfer … İ K 'a b-c", "x " * 3000, " ".join(f"w{n}" for n in range(1234)), "# T\n\n" + "A b c. " * 400, "\U0001f600" * 300]


@pytest.mark.parametrize("name", ["chunk_plaintext", "ingest_chunks", "summary_records", "hashed_embedding"])
def test_f3_texts_go_through_python_once(spark, name):
    rows = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython [") == 1


def test_f3_records_in_one_pass(spark):
    files = catalog.with_metadata(spark.createDataFrame([(f"/c/{n}.{'png' if n == 3 else 'txt'}", t) for n, t in enumerate(SOME)], "absolute_path string, content string"))
    chunks = catalog.chunk_records(files, 100)
    want = chunks.unionByName(catalog.summary_records(chunks), allowMissingColumns=True).withColumn("vector", tx.hashed_vector()("content"))
    got = catalog.searchable(files, 100)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df.select(*(F.coalesce(c, F.lit("")) if c == "summary" else c for c in sorted(want.columns))).collect()))
    assert rows(got) == rows(want) and got.filter("record_type = 'summary'").count() == 5


def test_f3_windows_and_vectors_as_expressions_give_them(spark):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(SOME)], "n int, t string")
    for r in rows.select("t", tx.word_windows(100)("t").alias("a"), tx.plain_chunks("t", 100).alias("b"), tx.hashed_vector()("t").alias("v"), F.transform(tx.tokens("t"), lambda t: tx.bucket(t)).alias("k")).collect():
        assert r.t is None or r.a == r.b
        n = [float((r.k or []).count(i)) for i in range(64)]
        norm = sum(x * x for x in n) ** 0.5
        assert r.v == pytest.approx([x / norm if norm else 0.0 for x in n], abs=1e-12)


def test_f6_counts_of_terms(spark):
    rows = spark.createDataFrame([("The the K dogs",), (None,), ("dog THE",)], "t string")
    counted = rows.select(search.term_counts(["the", "k", "dog"])("t").alias("a"), search.term_counts(["dog"], stem=True)("t").alias("b"), search.term_frequencies("t").alias("m")).collect()
    assert [r.a for r in counted] == [[4, 2, 1, 0], [0, 0, 0, 0], [2, 1, 0, 1]] and [r.b for r in counted] == [[4, 1], [0, 0], [2, 1]]
    assert [r.m for r in counted] == [{"the": 2, "k": 1, "dogs": 1}, {}, {"dog": 1, "the": 1}]


FUNCTIONS = {
    "F3 word_windows": lambda: tx.word_windows(), "F3 hashed_vector": lambda: tx.hashed_vector(), "F6 term_counts": lambda: search.term_counts(["the", "of"]), "F9 term_frequencies": lambda: search.term_frequencies,
    "F10 markdown_chunks": lambda: folds.markdown_chunks(), "F8 document_chunks": lambda: folds.document_chunks(), "F12 cover_density": lambda: search.cover_density(["the", "of"]), "html_markdown": lambda: folds.html_markdown,
}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_f3_to_f13_a_slice_of_a_batch_at_a_time(spark, name):
    """A batch of 20 MB, of which Python holds a few: before, all texts and results were Python objects."""
    texts = [" ".join(f"w{(n * k) % 997}" for k in range(900)) for n in range(4500)]
    batch = pa.array(texts)
    run = FUNCTIONS[name]().func
    del texts
    list(run(iter([batch.slice(0, 10)])))
    tracemalloc.start()
    try:
        assert sum(len(out) for out in run(iter([batch]))) == len(batch)
        assert tracemalloc.get_traced_memory()[1] < 12e6
    finally:
        tracemalloc.stop()


def test_f8_members_of_archives_a_few_at_a_time():
    held = [len(f) for f in files._frames((f"/{n}", None, 300_000, b"x" * 300_000) for n in range(20))]
    assert sum(held) == 20 and max(held) <= 4
