import pytest
from pyspark.sql import functions as F

from siltstone.functions import folds
from siltstone.functions import text as tx
from siltstone.operators import catalog
from siltstone.schema import Settings


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, tx.tokens(F.lit("Don't C++ -x e-mail été K9 naïve '90s"))) == ["don't", "c++", "x", "e-mail", "t", "k9", "na", "ve", "90s"]


def test_classification(spark):
    names = ["a.TAR.GZ", "a.gz", "x", ".bashrc", "a.JPG", "b.srt", "c.ass", "d.txt", "/x/.y/e.mp4"]
    got = [r.t for r in spark.createDataFrame([(n,) for n in names], "n string").select(tx.file_type("n").alias("t")).collect()]
    assert got == ["archive", "archive", "unknown", "unknown", "image", "subtitle", "subtitle", "document", "video"]
    assert one(spark, tx.hidden(F.lit("/a/.b/c"))) and not one(spark, tx.hidden(F.lit("/a/b")))


def test_plain_chunks(spark):
    c = one(spark, tx.plain_chunks(F.lit(" ".join(map(str, range(1000))))))
    assert [len(x.split()) for x in c] == [500, 500, 150] and [x.split()[0] for x in c] == ["0", "425", "850"]
    assert one(spark, tx.plain_chunks(F.lit(" \n "))) == []


def sizes(chunks):
    return [len(c.split()) for c in chunks]


def test_markdown_chunks():
    para = lambda k, n: " ".join(f"p{k}" for _ in range(n))
    assert sizes(folds.split_markdown("\n\n".join(para(k, 200) for k in range(6)))) == [400, 400, 400]
    c = folds.split_markdown("\n\n".join(para(k, 50) for k in range(20)))
    assert sizes(c) == [500, 500, 100] and [x.split()[0] for x in c] == ["p0", "p9", "p18"]
    sentences = " ".join(" ".join([f"s{k}"] * 19) + f" s{k}." for k in range(60))
    c = folds.split_markdown(sentences)
    assert sizes(c) == [500, 500, 320] and [x.split()[0] for x in c] == ["s0", "s22", "s44"]
    c = folds.split_markdown(sentences, overlap=0)
    assert sizes(c) == [500, 500, 240] and [x.split()[0] for x in c] == ["s0", "s24", "s48"]
    assert sizes(folds.split_markdown(" ".join(["w"] * 1200))) == [1200]
    thirty = " ".join(" ".join([f"s{k}"] * 19) + f" s{k}." for k in range(30))
    assert sizes(folds.split_markdown(f"small para\n\n{thirty}\n\ntail para")) == [2, 500, 160, 2]
    assert folds.split_markdown(" \n\n ") == [] == folds.split_markdown(None)


def test_subtitles(spark):
    srt = "1\n00:00:01,000 --> 00:00:04,500\nhello\nthere\n\n2\n00:01:05,010 --> 00:01:09,250\nworld\n"
    assert [tuple(c) for c in one(spark, tx.subtitle_cues(F.lit(srt)))] == [(1.0, 4.5, "hello there"), (65.01, 69.25, "world")]
    vtt = "WEBVTT\n\n00:01.000 --> 00:04.500\nhi\n\n00:00:05.000 --> 00:00:09.250\nho"
    assert [tuple(c) for c in one(spark, tx.subtitle_cues(F.lit(vtt), "vtt"))] == [(1.0, 4.5, "hi"), (5.0, 9.25, "ho")]
    assert one(spark, tx.seconds(F.lit("00:05"))) == 0.0 and one(spark, tx.seconds(F.lit("01:02:03,5"))) == 3723.005
    cues = spark.createDataFrame([("a", float(s), s + 2.0, f"c{s}") for s in (0, 10, 27, 31, 40, 80)], "f string, start double, end double, text string")
    got = [(r.timestamp_start, r.timestamp_end, r.content) for r in folds.subtitle_windows(cues, "f").orderBy("chunk_index").collect()]
    assert got == [(0.0, 29.0, "c0 c10 c27"), (27.0, 42.0, "c27 c31 c40"), (80.0, 82.0, "c80")]


def test_clips_and_frames(spark):
    assert [tuple(c) for c in one(spark, tx.clip_windows(F.lit(25.0)))] == [(0.0, 20.0), (10.0, 25.0), (20.0, 25.0)]
    assert len(one(spark, tx.clip_windows(F.lit(None).cast("double")))) == 30
    with pytest.raises(ValueError):
        tx.clip_windows(F.lit(1.0), 10, 10)
    row = spark.range(1).select(F.lit(60).alias("n"), F.lit(0.0).alias("fps")).select(tx.frame_schedule("n", "fps").alias("x")).first().x
    assert [(r.frame, r.start, r.end) for r in row] == [(0, 0.0, 1.0), (25, 1.0, 2.0), (50, 2.0, 3.0)]


def test_representative_text(spark):
    rows = spark.createDataFrame([("p", i, f"p#{i}", "x" * 300) for i in range(4)], "absolute_path string, chunk_index int, id string, content string")
    assert len(catalog.representative_text(rows, 1000).first().text) == 1006
    assert [catalog.summary_budget(c) for c in (0, 500, 900, 4096, 8192, 1_000_000)] == [4000, 500, 500, 13136, 20000, 20000]


def test_settings():
    for bad in ({"top_k": 0}, {"clip_overlap": 20}, {"chunk_overlap": 1.0}, {"relevance_threshold": 2}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_markup_to_markdown():
    assert folds.html_to_markdown("<h1>T</h1><p>a  b<script>x</script></p><ul><li>c</ul>") == "# T\n\na b\n\n- c"
    assert folds.html_to_markdown(None) is None
