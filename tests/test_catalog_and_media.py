import json
import struct
import zipfile

import pytest

from siltstone.functions.images import described, image_info
from siltstone.operators import catalog, media, search
from siltstone.plans import providers
from siltstone.plans.engine import Engine, build_records, ingest, register_functions
from siltstone.schema import EXTENSIONS, MIME, Settings
from siltstone.sources import files
from siltstone.streaming import ingest as streams


def records(spark, *rows):
    return spark.createDataFrame([(i, p, p.rsplit("/", 1)[0], c) for i, p, c in rows], "id string, absolute_path string, parent_directory string, content string")


def held(table, version=None):
    return sorted((r.id, r.content) for r in table.records(version).collect())


@pytest.fixture
def table(spark, tmp_path):
    return catalog.Catalog(spark, f"file://{tmp_path}/table")


def test_commits(spark, table):
    assert held(table) == [] and table.versions() == []
    assert table.append(records(spark, ("1", "/a/x", "one"), ("2", "/a/b/y", "two"))) == 2
    assert table.upsert(records(spark, ("2", "/a/b/y", "old"), ("2", "/a/b/y", "zwei"), ("3", "/ab/z", "three"))) == 2  # one row an id
    assert held(table) == [("1", "one"), ("2", "zwei"), ("3", "three")]
    assert table.replace_paths(records(spark, ("", "/a/x", "")), records(spark, ("1b", "/a/x", "eins"))) == 1
    assert held(table) == [("1b", "eins"), ("2", "zwei"), ("3", "three")] and held(table, 1) == [("1", "one"), ("2", "two")]
    assert table.delete_by_folder("/a") == 2 and held(table) == [("3", "three")]
    assert table.append(records(spark, ("4", "/a/new", "four"))) == 1 and held(table) == [("3", "three"), ("4", "four")]  # a deletion doesn't reach later rows
    assert table.delete_by_path("/nowhere") == 0 and table.delete_by_path("/ab/z") == 1
    assert table.keep_only(records(spark, ("", "/other", ""))) == 1 and held(table) == []
    table.compact()
    removed = table.expire()
    assert removed > 0 and held(table) == [] and len(table.versions()) == 1


def test_a_writer_that_dies_leaves_the_table(spark, table, monkeypatch):
    table.append(records(spark, ("1", "/a/x", "one")))
    real = catalog.Catalog._commit

    def dies(self, parts):
        raise OSError("lost")

    monkeypatch.setattr(catalog.Catalog, "_commit", dies)
    with pytest.raises(OSError):
        table.upsert(records(spark, ("1", "/a/x", "zwei")))
    monkeypatch.setattr(catalog.Catalog, "_commit", real)
    at, fs = table._fs()
    half = fs.create(at("_log/.half"), False)  # a commit that was begun and never renamed
    half.write(bytearray(b"[{"))
    half.close()
    assert held(table) == [("1", "one")]
    assert table.upsert(records(spark, ("1", "/a/x", "zwei"))) == 1 and held(table) == [("1", "zwei")]


def test_many_commits_are_compacted(spark, table, monkeypatch):
    monkeypatch.setattr(catalog.Catalog, "COMPACT", 3)
    for k in range(6):
        table.upsert(records(spark, (str(k % 2), "/a/x", f"v{k}")))
    assert held(table) == [("0", "v4"), ("1", "v5")] and len(table._parts()) <= 4
    assert not table.needs_reindex("") or table.by_hash("nothing").count() == 0


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\0" * 5


def jpeg(w, h):
    entry = struct.pack("<HHI", 0x010F, 2, 4) + b"ACM\0" + struct.pack("<HHII", 0x0110, 2, 8, 38)
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + entry + struct.pack("<I", 0) + b"Model 7\0"
    app = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, h, w, 0)


def test_images():
    assert image_info(png(3, 4)) == {"width": 3, "height": 4, "format": "PNG"}
    assert image_info(jpeg(640, 480)) == {"Make": "ACM", "Model": "Model 7", "width": 640, "height": 480, "format": "JPEG"}
    assert image_info(b"GIF89a" + struct.pack("<HH", 9, 8))["width"] == 9 and image_info(b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6))["height"] == 6
    assert image_info(b"\x89PNG") == {} and image_info(b"") == {} and image_info(b"\xff\xd8\xff\xe1") == {}
    assert described("a.png", image_info(png(3, 4))) == "Image file: a.png (width: 3, height: 4, format: PNG)"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("media")
    (d / "doc.md").write_text("# Title\n\n" + "\n\n".join(" ".join(f"p{k}" for _ in range(200)) for k in range(4)))
    (d / "page.html").write_text("<h1>Head</h1><p>inside</p>")
    (d / "s.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhello\n\n2\n00:00:50,000 --> 00:00:51,000\nlater")
    (d / "film.mp4").write_bytes(b"video")
    (d / "talk.mp3").write_bytes(b"audio")
    (d / "scan.pdf").write_bytes(b"%PDF")
    (d / "shot.png").write_bytes(png(7, 8))
    (d / "again.png").write_bytes(png(7, 8))
    (d / "odd.xyz").write_text("?")
    with zipfile.ZipFile(d / "z.zip", "w") as z:
        z.writestr("in/ok.txt", "zipped words")
    return str(d)


def full():
    return providers.Providers(
        transcribe=lambda name, content: [(0.0, 1.5, f" said in {name} ")], probe=lambda name, content: {"duration": 25.0, "frames": 30, "fps": 10.0},
        embedded_subtitles=lambda name, content: "1\n00:00:03,000 --> 00:00:04,000\nsubbed", ocr_pages=lambda content: ["first", " ", "third"], ocr=lambda content: "letters", has_text=lambda content: True,
    )


def test_routes(spark, folder):
    rows = {r.id.removeprefix(folder + "/"): r for r in media.routed(media.expanded(files.scan_all(spark, folder)), Settings(), full()).collect()}
    assert rows["doc.md#0"].content.startswith("# Title\n\n") and rows["doc.md#0"].total_chunks == 2  # along the paragraphs
    assert rows["page.html#0"].content == "# Head\n\ninside" and rows["z.zip/in/ok.txt#0"].content == "zipped words"
    assert (rows["s.srt#0"].content, rows["s.srt#1"].content, rows["s.srt#1"].timestamp_start, rows["s.srt#0"].total_chunks) == ("hello", "later", 50.0, 2)
    assert rows["film.mp4#a0"].content == "[Audio Transcript] said in film.mp4" and rows["film.mp4#a0"].file_type == "video"
    assert [rows[f"film.mp4#f{k}"].content for k in range(3)] == [f"[Visual Frame] Video: film.mp4 at {k}.00s" for k in range(3)] and json.loads(rows["film.mp4#f2"].metadata_json) == {"frame": 20}
    assert rows["film.mp4#s0"].content == "[Subtitle] subbed" and rows["talk.mp3#0"].content == "said in talk.mp3"
    assert rows["scan.pdf#0"].content == "## Page 1\n\nfirst\n\n## Page 3\n\nthird"
    assert rows["shot.png#0"].content == "Image file: shot.png (width: 7, height: 8, format: PNG)\n[OCR Text]\nletters" and "again.png" in rows["again.png#0"].content
    assert not any(i.startswith("odd") for i in rows)
    cloud = [r.content for r in media.video_records(files.scan_all(spark, folder), Settings(video_mode="cloud"), probe=full().probe)[0].orderBy("chunk_index").collect()]
    assert cloud == ["[Video Segment] film.mp4 from 0.0s to 20.0s", "[Video Segment] film.mp4 from 10.0s to 25.0s", "[Video Segment] film.mp4 from 20.0s to 25.0s"]
    bare = media.routed(files.scan_all(spark, folder)).select("file_type").distinct().collect()
    assert {r.file_type for r in bare} == {"document", "subtitle", "image"}  # what needs no model
    assert {r.file_type: r.files for r in files.by_type(files.scan_all(spark, folder)).collect()}["image"] == 2
    assert files.scan(spark, folder + "/nowhere").count() == 0


def test_ingest_of_bytes_and_reconcile(spark, folder, tmp_path, table):
    n = ingest(table, files.scan_all(spark, folder), providers=full())
    assert n == table.records().count() and ingest(table, files.scan_all(spark, folder), providers=full()) == 0
    one = table.records().filter("filename = 'shot.png' OR filename = 'again.png'").collect()
    assert len(one) == 1 and len(one[0].vector) == 64 and one[0].created_at  # equal contents once
    assert table.needs_reindex("no such hash") and not table.needs_reindex(one[0].file_hash)
    assert table.search_lexical("zipped words", 3).first().filename == "ok.txt"
    (tmp_path / "left").mkdir()
    assert streams.reconciled(table, str(tmp_path / "left")) == n and table.records().count() == 0


def test_directory_stream(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.txt").write_text("streamed words")
    (tmp_path / "in" / ".b.txt").write_text("hidden")
    table, seen, told = catalog.Catalog(spark, f"file://{tmp_path}/t"), [], []
    listener = streams.Progress(lambda kind, what: told.append(kind))
    spark.streams.addListener(listener)
    q = streams.into_catalog(streams.directory_stream(spark, str(tmp_path / "in")), table, str(tmp_path / "state"), seen=lambda batch, n: seen.append(n))
    assert streams.drained(q, 120)
    assert [r.filename for r in table.records().filter("record_type = 'chunk'").collect()] == ["a.txt"] and sum(seen) == 2
    spark.streams.removeListener(listener)
    assert q.exception() is None


def test_models_stand_in(spark):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("busy")
        return x * 2

    slept = []
    assert providers.retried(flaky, sleep=slept.append)(4) == 8 and slept == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        providers.retried(lambda: 1 / 0, 2, sleep=slept.append)()
    chat = providers.ChatEngine(lambda prompt: "red" if "search phrase" in prompt else "answered", 900)
    embedding = providers.EmbeddingEngine(lambda texts: [[1.0, float("red" in t)] for t in texts], 2, caption=lambda b: "red thing")
    assert embedding.embed_image(b"") == [1.0, 1.0] and chat.chat([("user", "x")]) == "answered" and chat.summary_chars() == 500
    providers.register("test", lambda: providers.of_models(chat, embedding))
    p = providers.providers("test")
    with pytest.raises(ValueError):
        providers.providers("none")
    f = catalog.with_metadata(spark.createDataFrame([("/a/1.txt", "red green"), ("/a/2.txt", "blue")], "absolute_path string, content string"))
    e = Engine(catalog.written(build_records(f, providers=p)), providers=p)
    r = e.search("where is it?")
    assert r.rewritten == "red" and r.answer == "answered" and r.results.first().filename == "1.txt"
    assert {x.summary for x in e.records.filter("record_type = 'summary'").collect()} == {"answered"}
    assert e.query_hint([1.0, 1.0]) == "red green"


def test_tools(spark):
    f = catalog.with_metadata(spark.createDataFrame([("/a/1.txt", "red green"), ("/b/2.txt", "blue")], "absolute_path string, content string"))
    e = Engine(catalog.written(build_records(f)))
    tools = e.tools()
    assert json.loads(tools["list_indexed_folders"]()) == ["/a", "/b"] and json.loads(tools["get_indexing_status"]())["total_files"] == 2
    assert [(x["chunk_index"], x["content"], x["timestamp_start"]) for x in json.loads(tools["get_file_chunks"]("/a/1.txt"))] == [(0, "red green", None)] * 2
    assert tools["find_documents"]("red green", 1).startswith("- 1.txt (score 1.00)\n  /a/1.txt\n  red green")
    assert "red green" in tools["semantic_search"]("red green")
    hits = e.retrieve("red green", k=1)[0]
    assert [(r.percent, r.filename) for r in search.result_cards(hits).collect()] == [(100, "1.txt")]


def test_stems_and_cover_density(spark):
    assert [search.stemmed(w) for w in ("running", "stopped", "houses", "classes", "bus", "parties", "is", "nationally")] == ["run", "stop", "house", "class", "bus", "parti", "is", "national"]
    rows = spark.createDataFrame([("1", "dogs running"), ("2", "dog x x run"), ("3", "dog"), ("4", None)], "id string, content string")
    assert [(r.id, r.score) for r in search.cover_topk(rows, "dog run").orderBy("rank").collect()] == [("1", 1.0), ("2", round(1 / 3, 6))]
    assert {r.id for r in search.bm25_ranked(rows, "dogs", stem=True).collect()} == {"1", "2", "3"} and {r.id for r in search.bm25_ranked(rows, "dogs").collect()} == {"1"}


def test_postings(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"w{i % 7} w{i % 3} common", f"/d{i % 2}", "document", "chunk") for i in range(50)] + [("n", None, "/d0", "document", "chunk")], "id string, content string, parent_directory string, file_type string, record_type string")
    index = search.Postings.build(rows, f"file://{tmp_path}/index")
    for query, how in (("w1 common", {}), ("w1 w1 w2", {"folder": "/d1"}), ("w1 w2", {"conjunctive": True}), ("?!", {})):
        want = sorted(map(tuple, search.bm25_ranked(rows, query, 20, **how).collect()))
        assert sorted(map(tuple, index.top(query, 20, **how).select("id", "score", "rank").collect())) == want


def test_types_and_functions(spark):
    assert len(EXTENSIONS) == 53 and set(EXTENSIONS) - {".tar.gz"} <= set(MIME) and EXTENSIONS[".ico"] == "image" and EXTENSIONS[".bz2"] == EXTENSIONS[".xz"] == "archive"
    register_functions(spark)
    sql = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert sql("SELECT * FROM clip_windows(25.0D, 20, 10)") == [(0, 0.0, 20.0), (1, 10.0, 25.0), (2, 20.0, 25.0)]
    assert sql(r"SELECT * FROM parse_subtitles('1\n00:00:01,000 --> 00:00:04,500\nhello\nthere', 'srt')") == [(1.0, 4.5, "hello there")]
    assert sql("SELECT * FROM chunk_text('a b', 500, 0.15)") == [(0, "a b")]
    assert [r.v for r in spark.sql("SELECT '[1, 2.5]' AS t UNION ALL SELECT 'x'").select(search.parsed_vector("t").alias("v")).collect()] == [[1.0, 2.5], None]
