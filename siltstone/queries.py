"""The retrieval engine's queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import folds
from siltstone.functions import text as tx
from siltstone.operators import catalog, media, search
from siltstone.plans import engine
from siltstone.plans.providers import Providers
from siltstone.schema import EXTENSIONS, MIME, Settings
from siltstone.ship import spread
from siltstone.sources import files as source

QUERY = "the heention les"
FOLDER = "/corpus/src1"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def _files(spark: SparkSession, d: str) -> DataFrame:
    return catalog.files_of_documents(_t(spark, d, "documents"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return catalog.chunk_records(_files(spark, d))


def _records(spark: SparkSession, d: str) -> DataFrame:
    # as in use: the records are a stored table that every list of a query reads
    return catalog.written(catalog.searchable(_files(spark, d)))


_ENDINGS = [".TXT", ".TAR.GZ", "", ".unknown9", *sorted(EXTENSIONS)]


def classify_files(spark, d):
    ext = F.element_at(F.array(*(F.lit(x) for x in _ENDINGS)), (F.col("doc_id") % len(_ENDINGS) + 1).cast("int"))
    name = F.concat(F.lit("/c/"), F.when(F.col("doc_id") % 11 == 0, F.lit(".bashrc")).otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"), ext)))
    rows = _t(spark, d, "documents").select("doc_id", name.alias("p"))
    pages = _t(spark, d, "pages").select((-F.col("page_id") - 1).alias("doc_id"), F.concat(F.lit("/p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("p"))
    return rows.unionByName(pages).select("doc_id", tx.filename("p").alias("filename"), tx.file_type("p").alias("file_type"), tx.mime_type("p").alias("mime_type"), tx.hidden("p").alias("hidden"))


def hash_and_dedup(spark, d):
    return catalog.first_copies(_files(spark, d)).select("absolute_path", "file_hash")


def needs_reindex(spark, d):
    docs = _t(spark, d, "documents")
    return catalog.needs_reindex(catalog.files_of_documents(docs), catalog.files_of_documents(docs.filter("doc_id % 2 = 0"))).select("absolute_path", "file_hash")


def replace_on_change(spark, d):
    docs = _t(spark, d, "documents")
    new = catalog.files_of_documents(docs.filter("doc_id % 4 = 0").withColumn("text", F.concat("text", F.lit(" changed"))))
    return catalog.replaced_on_change(catalog.files_of_documents(docs.filter("doc_id % 2 = 0")), new).select("absolute_path", "file_hash")


def upsert_latest(spark, d):
    return catalog.latest(_t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


def upsert_by_id(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return catalog.upserted(o, o.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey")


def delete_by_path(spark, d):
    return catalog.deleted_by_path(_chunks(spark, d), "/corpus/src0/en/0.txt").groupBy("absolute_path").agg(F.count("*").alias("n"))


def delete_by_folder(spark, d):
    return catalog.deleted_by_folder(_chunks(spark, d), FOLDER).groupBy("parent_directory").agg(F.count("*").alias("n"))


def list_folders(spark, d):
    return catalog.folders(_files(spark, d))


def catalog_stats(spark, d):
    return catalog.stats(_chunks(spark, d))


def file_chunks(spark, d):
    longest = _t(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(1).select("doc_id")
    docs = _t(spark, d, "documents").join(F.broadcast(longest), "doc_id")  # one row
    return catalog.chunk_records(catalog.files_of_documents(docs)).orderBy("chunk_index").select("chunk_index", "total_chunks", "content")


def chunk_plaintext(spark, d):
    return _chunks(spark, d).select("id", "chunk_index", "total_chunks", "content")


def chunk_markdown(spark, d):
    return tx.exploded(_files(spark, d).select("absolute_path", folds.markdown_chunks()("content").alias("_c")), "_c", "chunk_index", "content")


def clip_windows(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.inline(tx.clip_windows(F.col("p_size") * 3.5))).withColumnsRenamed({"start": "clip_start", "end": "clip_end"})


def frame_schedule(spark, d):
    return _t(spark, d, "part").select("p_partkey", (F.col("p_size") * 10).alias("frames"), (F.col("p_size") % 31).alias("fps")).select("p_partkey", F.inline(tx.frame_schedule("frames", "fps"))).select(
        "p_partkey", "frame", F.round("start", 6).alias("frame_start"), F.round("end", 6).alias("frame_end")
    )


def _srt(spark, d) -> DataFrame:
    code = lambda s: F.format_string("%02d:%02d:%02d,%03d", (s / 3600).cast("int"), (s % 3600 / 60).cast("int"), (s % 60).cast("int"), F.lit(250))
    line = F.regexp_replace(F.trim(F.regexp_replace("text", r"\s+", " ")), "-->", "")
    cue = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n"), code(F.col("turn") * 10), F.lit(" --> "), code(F.col("turn") * 10 + 9), F.lit("\n"), line)
    rows = _t(spark, d, "conversations").filter(F.trim("text") != "").select("conv_id", F.struct("turn", cue.alias("c")).alias("x"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]), "\n\n").alias("srt"))


def subtitle_parse(spark, d):
    return _srt(spark, d).select("conv_id", F.inline(tx.subtitle_cues("srt"))).select("conv_id", F.col("start").alias("cue_start"), F.col("end").alias("cue_end"), "text")


def subtitle_windows(spark, d):
    return folds.subtitle_windows(_srt(spark, d).select("conv_id", F.inline(tx.subtitle_cues("srt"))), "conv_id")


def representative_text(spark, d):
    return catalog.representative_text(_chunks(spark, d), 6000)


def summary_records(spark, d):
    return catalog.summary_records(_chunks(spark, d)).select("id", "record_type", "summary", "file_hash")


def tokenize_terms(spark, d):
    return _t(spark, d, "documents").select(F.explode(tx.tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def bm25_topk(spark, d):
    return search.bm25_ranked(_chunks(spark, d), QUERY, 20)


def bm25_topk_folder(spark, d):
    return search.bm25_ranked(_chunks(spark, d), QUERY, 20, folder=FOLDER)


def conjunctive_match(spark, d):
    return search.bm25_ranked(_chunks(spark, d), "the of and", 20, conjunctive=True)


def _vector(spark, d) -> list[float]:
    return _t(spark, d, "embeddings").filter("vec_id = 0").first().embedding


def cosine_topk(spark, d):
    return search.cosine_topk(_t(spark, d, "embeddings"), _vector(spark, d), 10, key="vec_id", vector="embedding").select("vec_id", "score", "rank")


def cosine_topk_filtered(spark, d):
    both = _t(spark, d, "embeddings").join(_files(spark, d).withColumn("vec_id", F.regexp_extract("filename", r"^(\d+)", 1).cast("long")).drop("content"), "vec_id")
    both = both.withColumn("record_type", F.lit("chunk"))
    return search.cosine_topk(both, _vector(spark, d), 10, key="vec_id", vector="embedding", folder=FOLDER, file_type="document", record_types=["chunk"]).select("vec_id", "absolute_path", "score", "rank")


def normalize_vectors(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", tx.normalised(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return v.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", "i", F.round("x", 5).alias("x"))


def hashed_embedding(spark, d):
    v = tx.hashed_vectors(_t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return tx.exploded(v, "vector", "i", "x").filter("x != 0").select("doc_id", "i", F.round("x", 6).alias("x"))


def _lists(spark, d):
    r = _records(spark, d)
    v = engine.hashed_query(r, QUERY)
    return r, v


def rrf_fuse(spark, d):
    r, v = _lists(spark, d)
    out = search.fused([search.cosine_topk(r, v, 50), search.bm25_ranked(r, QUERY, 100)])
    return out.select("id", "rrf", "score", "first_list", "first_rank")


def hybrid_search(spark, d):
    r, v = _lists(spark, d)
    return search.hybrid(r, QUERY, v).select("id", "score", "rrf", "rank")


def file_groups(spark, d):
    r, v = _lists(spark, d)
    groups = search.file_groups(search.cosine_topk(r, v, 10, record_types=["summary"]), search.cosine_topk(r, v, 50, record_types=["chunk"]))
    return groups.select("absolute_path", "summary", "best_score", "summary_rank", F.coalesce(F.array_join(F.transform("chunk_results", lambda x: x["id"]), ","), F.lit("")).alias("chunk_ids"))


def relevance_gate(spark, d):
    r, v = _lists(spark, d)
    return search.gate(search.hybrid(r, QUERY, v))


def context_blocks(spark, d):
    r, v = _lists(spark, d)
    hits = search.hybrid(r, QUERY, v, top_k=5).select("id", "rank")
    rows = r.join(hits, "id").withColumns({"timestamp_start": F.lit(None).cast("double"), "timestamp_end": F.lit(None).cast("double")})
    return search.context_blocks(rows)


def rerank_overlap(spark, d):
    r = _records(spark, d).filter("record_type = 'chunk'")
    q = _t(spark, d, "benchmark").orderBy("item_id").first().text
    pool = search.bm25_topk(r, q, 15).select("id", "content")
    return search.top(search.overlap_scorer(q)(pool), 10).select("id", "score", "rank")


def recent_history(spark, d):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return _t(spark, d, "conversations").withColumn("n", n).filter("n <= 4").select("conv_id", "turn", "role", "text")


def debounce_events(spark, d):
    from siltstone.streaming.ingest import debounced

    return debounced(_t(spark, d, "events").select("user_id", "ts", "event_type"), gap="7200")


def progress_rollup(spark, d):
    status = F.when(F.col("doc_id") % 7 == 0, "failed").when((F.col("doc_id") % 5 == 0) & (F.col("lang") != "en"), "pending").otherwise("completed")
    return catalog.progress(_t(spark, d, "documents").select(F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang").alias("folder"), status.alias("status")))


def html_to_text(spark, d):
    return _t(spark, d, "pages").select("page_id", folds.html_markdown("html").alias("markdown"))


def ann_lsh(spark, d):
    return search.lsh_topk(_t(spark, d, "embeddings"), _vector(spark, d), 10, key="vec_id", vector="embedding").select("vec_id", "score", "rank")


def engine_search(spark, d):
    return engine.Engine(_records(spark, d)).search(QUERY).results.select("id", "score", "rank")


def _shared(spark) -> str:
    return f"{catalog.shared_root(spark)}/query-{uuid.uuid4().hex}"


def stream_ingest(spark, d):
    from siltstone.streaming.ingest import file_stream, into_catalog

    root = _shared(spark)
    table = catalog.Catalog(spark, f"{root}/table")
    stream = file_stream(spark, d, _t(spark, d, "documents").schema, "documents.parquet")
    q = into_catalog(stream, table, f"{root}/state")
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return table.records().groupBy("record_type").agg(F.count("*").alias("n"), F.count_distinct("absolute_path").alias("files"))


def ingest_chunks(spark, d):
    """What ingestion makes of documents: chunks along their structure."""
    return catalog.structured_chunks(_files(spark, d)).select("id", "chunk_index", "total_chunks", "content")


def _bytes(rows: DataFrame) -> DataFrame:
    """Files as scans give them, of (absolute_path, content as bytes)."""
    return source.described(rows.select("absolute_path", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("file_modified_at"), F.length("content").cast("long").alias("size"), "content"))


def route_by_type(spark, d):
    """Texts, subtitles, images and unknown files through one router."""
    text = _t(spark, d, "documents").filter("doc_id % 5 = 0").select(F.concat(F.lit("/m/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("absolute_path"), F.col("text").cast("binary").alias("content"))
    srt = _srt(spark, d).select(F.concat(F.lit("/s/"), F.col("conv_id").cast("string"), F.lit(".srt")).alias("absolute_path"), F.col("srt").cast("binary").alias("content"))
    word = lambda c: F.unhex(F.lpad(F.hex(F.col(c).cast("long")), 8, "0"))
    head = F.unhex(F.lit("89504E470D0A1A0A0000000D49484452"))
    png = _t(spark, d, "part").filter("p_partkey <= 100").select(F.concat(F.lit("/i/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("absolute_path"), F.concat(head, word("p_size"), word("p_partkey")).alias("content"))
    other = _t(spark, d, "part").filter("p_partkey <= 9").select(F.concat(F.lit("/x/"), F.col("p_partkey").cast("string"), F.lit(".bin")).alias("absolute_path"), F.encode(F.lit("?"), "UTF-8").alias("content"))
    rows = media.routed(media.expanded(_bytes(text.unionByName(srt).unionByName(png).unionByName(other))))
    return rows.select("id", "file_type", "chunk_index", "total_chunks", "content", F.round("timestamp_start", 3).alias("timestamp_start"))


def _videos(spark, d) -> DataFrame:
    name = F.concat(F.lit("/v/"), F.col("p_partkey").cast("string"), F.lit(".mp4"))
    return _bytes(_t(spark, d, "part").filter("p_partkey <= 200").select(name.alias("absolute_path"), F.encode(F.concat_ws(" ", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), "p_name"), "UTF-8").alias("content")))


def _probed(name: str, content: bytes) -> dict:
    key, size = content.decode().split(" ")[:2]
    return {"duration": int(size) * 3.5, "frames": int(size) * 10, "fps": float(int(key) % 31)}


def _said(name: str, content: bytes) -> list:
    return [(k * 2.0, k * 2.0 + 1.5, f" {w} ") for k, w in enumerate(content.decode().split(" ")[2:])]


def video_clips(spark, d):
    rows = media.video_records(_videos(spark, d), Settings(video_mode="cloud"), probe=_probed)[0]
    return rows.select("id", "content", "chunk_index", "total_chunks", "timestamp_start", "timestamp_end", "mime_type")


def video_local(spark, d):
    """Transcripts and frames of videos, by stand-ins for the decoder and the recogniser."""
    said, frames = media.video_records(_videos(spark, d), transcribe=_said, probe=_probed)
    rows = said.unionByName(frames, allowMissingColumns=True)
    return rows.select("id", "content", "file_type", "mime_type", F.round("timestamp_start", 6).alias("timestamp_start"), "metadata_json")


def audio_segments(spark, d):
    files = _videos(spark, d).withColumns({"absolute_path": F.replace("absolute_path", F.lit(".mp4"), F.lit(".mp3")), "file_type": F.lit("audio")})
    return media.audio_records(files, _said).select("id", "content", "chunk_index", "total_chunks", "timestamp_start", "timestamp_end")


def archive_members(spark, d):
    """Members of zip files; a member that would leave its folder is left out."""

    def zipped(batches):
        for pdf in batches:
            out = []
            for text in pdf.content:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    z.writestr("in/a.txt", text)
                    z.writestr("../b.txt", "no")
                out.append(held.getvalue())
            pdf["content"] = out
            yield pdf

    rows = _t(spark, d, "documents").filter("doc_id % 10 = 3").select(F.concat(F.lit("/z/"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("absolute_path"), F.col("text").alias("content"))
    return source.unpacked(_bytes(rows.mapInPandas(zipped, "absolute_path string, content binary"))).select("absolute_path", "filename", "file_type", "file_hash")


def records_by_hash(spark, d):
    one = _files(spark, d).agg(F.min("file_hash")).first()[0]
    return catalog.chunk_records(_files(spark, d).filter(F.col("file_hash") == one)).select("id", "chunk_index", "file_hash")


def preview_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", source.preview("text", 3).alias("preview"))


def scan_counts(spark, d):
    """Files and bytes by type, as a scan reports them."""
    names = classify_files(spark, d).select("file_type", F.length("filename").cast("long").alias("size"))
    return source.by_type(names)


def vtt_parse(spark, d):
    """WebVTT cues with and without hours."""
    begin = F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.lit("00:"))
    code = lambda s: F.concat(begin, F.format_string("%02d:%02d.%03d", (s / 60).cast("int"), (s % 60).cast("int"), F.lit(250)))
    cue = F.concat(F.lit("WEBVTT\n\n"), code(F.col("turn") * 10), F.lit(" --> "), code(F.col("turn") * 10 + 9), F.lit("\nhello "), F.col("role"))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.inline(tx.subtitle_cues(cue, "vtt"))).select("conv_id", "turn", F.col("start").alias("cue_start"), F.col("end").alias("cue_end"), "text")


def vector_parse(spark, d):
    text = F.to_json(F.transform("embedding", lambda x: F.round(x.cast("double"), 3)))
    return _t(spark, d, "embeddings").select("vec_id", F.posexplode(search.parsed_vector(text)).alias("i", "x"))


def bm25_postings(spark, d):
    """bm25_topk from a stored index of terms."""
    return search.Postings.build(_chunks(spark, d), f"{_shared(spark)}/postings").top(QUERY, 20)


def cover_density(spark, d):
    return search.cover_topk(_chunks(spark, d), "the of", 20).select("id", "score", "rank")


def bm25_stemmed(spark, d):
    return search.bm25_ranked(_chunks(spark, d), QUERY, 20, stem=True)


def summary_search(spark, d):
    r, v = _lists(spark, d)
    hits, groups = search.summary_search(r, v, 10)
    return hits.select("id", "score", "rank")


def chunk_search(spark, d):
    r, v = _lists(spark, d)
    return search.cosine_topk(r, v, 10, record_types=["chunk"]).select("id", "score", "rank")


def query_hint(spark, d):
    r, v = _lists(spark, d)
    return search.query_hint(search.cosine_topk(r, v, 5, record_types=["chunk"]))


def result_cards(spark, d):
    r, v = _lists(spark, d)
    hits = search.hybrid(r, QUERY, v).select("id", "score", "rank")
    return search.result_cards(r.join(F.broadcast(hits), "id"))  # ten rows


def folders_json(spark, d):
    return search.as_json(catalog.folders(_files(spark, d)), "parent_directory")


def chunks_json(spark, d):
    return search.as_json(file_chunks(spark, d), "chunk_index", "total_chunks", "content")


def document_lines(spark, d):
    """The text of the tool that finds documents."""
    r, v = _lists(spark, d)
    return search.group_lines(search.summary_search(r, v, 10)[1])


def catalog_changes(spark, d):
    """Appends, upserts, replacements and deletions in the stored table, one after another."""
    root = _shared(spark)
    table = catalog.Catalog(spark, f"{root}/table")
    chunks = catalog.written(_chunks(spark, d))
    of = F.regexp_extract("filename", r"^(\d+)", 1).cast("long")
    table.append(chunks.filter(of % 2 == 0))
    table.upsert(chunks.filter(of % 4 < 2).withColumn("summary", F.lit("new")))
    changed = chunks.filter(of % 6 == 0)
    table.replace_paths(changed.select("absolute_path"), changed.filter("chunk_index = 0").withColumn("summary", F.lit("short")))
    table.delete_by_folder(FOLDER)
    return table.records().select("id", "summary")


def udtf_chunks(spark, d):
    """chunk_text() in SQL."""
    engine.register_functions(spark)
    _t(spark, d, "documents").filter("doc_id % 7 = 0").createOrReplaceTempView("siltstone_udtf_documents")
    return spark.sql("SELECT doc_id, c.chunk_index, c.content FROM siltstone_udtf_documents, LATERAL chunk_text(text, 500, 0.15) AS c")


def udtf_clips(spark, d):
    """clip_windows() in SQL."""
    engine.register_functions(spark)
    _t(spark, d, "part").createOrReplaceTempView("siltstone_udtf_part")
    return spark.sql("SELECT p_partkey, c.clip_start, c.clip_end FROM siltstone_udtf_part, LATERAL clip_windows(CAST(p_size * 3.5 AS DOUBLE), 20, 10) AS c")


QUERIES = {f.__name__: f for f in (
    hybrid_search, classify_files, hash_and_dedup, needs_reindex, replace_on_change, upsert_latest, upsert_by_id, delete_by_path, delete_by_folder, list_folders, catalog_stats, file_chunks,
    chunk_plaintext, chunk_markdown, clip_windows, frame_schedule, subtitle_parse, subtitle_windows, representative_text, summary_records, tokenize_terms, bm25_topk, bm25_topk_folder,
    conjunctive_match, cosine_topk, cosine_topk_filtered, normalize_vectors, hashed_embedding, rrf_fuse, file_groups, relevance_gate, context_blocks, rerank_overlap, recent_history,
    debounce_events, progress_rollup, html_to_text, ann_lsh, engine_search, stream_ingest, ingest_chunks, route_by_type, video_clips, video_local, audio_segments, archive_members, records_by_hash, preview_text,
    scan_counts, vtt_parse, vector_parse, bm25_postings, cover_density, bm25_stemmed, summary_search, chunk_search, query_hint, result_cards, folders_json, chunks_json, document_lines, catalog_changes, udtf_chunks, udtf_clips,
)}

_FILES = """files AS (SELECT '/corpus/' || source || '/' || lang || '/' || doc_id || '.txt' AS absolute_path, doc_id || '.txt' AS filename, '/corpus/' || source || '/' || lang AS parent_directory,
    'document' AS file_type, sha256(text) AS file_hash, text AS content, doc_id FROM documents)"""
_CHUNKS = (
    _FILES
    + r""", w AS (SELECT *, list_filter(string_split_regex(content, '\s+'), lambda x: x <> '') AS w FROM files),
n AS (SELECT *, CAST(greatest(ceil((len(w) - 500) / 425.0), 0) AS INTEGER) + 1 AS total_chunks FROM w WHERE len(w) > 0),
i AS (SELECT *, unnest(range(total_chunks)) AS i FROM n),
chunks AS (SELECT absolute_path || '#' || i AS id, 'chunk' AS record_type, absolute_path, filename, parent_directory, file_type, file_hash, CAST(i AS INTEGER) AS chunk_index, total_chunks,
    array_to_string(w[i * 425 + 1:i * 425 + 500], ' ') AS content, '' AS summary FROM i)"""
)
_TERMS = r"list_transform(regexp_extract_all({0}, '[a-zA-Z0-9][a-zA-Z0-9''+-]*'), lambda x: lower(x))"
_RECORDS = (
    _CHUNKS
    + """, records AS (SELECT * FROM chunks UNION ALL SELECT absolute_path || '#summary', 'summary', absolute_path, filename, parent_directory, file_type, file_hash, 0, 1, substr(content, 1, 200), substr(content, 1, 200)
    FROM chunks WHERE chunk_index = 0 AND content <> ''),
tf AS (SELECT id, b, count(*) AS c FROM (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b FROM (SELECT id, unnest("""
    + _TERMS.format("content")
    + """) AS t FROM records)) GROUP BY 1, 2),
q AS (SELECT b, count(*) AS c FROM (SELECT ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b FROM (SELECT unnest(['the', 'heention', 'les']) AS t)) GROUP BY 1),
cos AS (SELECT id, round(least(1.0, coalesce(sum(tf.c * q.c), 0) / (sqrt(sum(tf.c * tf.c)) * (SELECT sqrt(sum(c * c)) FROM q))), 6) AS score FROM tf LEFT JOIN q USING (b) GROUP BY id),
scored AS (SELECT records.*, cos.score FROM records JOIN cos USING (id)),
summary_list AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored WHERE record_type = 'summary' ORDER BY rank LIMIT 10),
chunk_list AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored WHERE record_type = 'chunk' ORDER BY rank LIMIT 50)"""
)


def _bm25(source: str, terms: list[str], k: int, name: str, conjunctive: bool = False) -> str:
    """CTEs that end in ``name`` (id, score, rank)."""
    t = _TERMS.format("content")
    f = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(terms)))
    part = " + ".join(f"CASE WHEN f{i} > 0 THEN ln((docs + 1) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * greatest(n, 1) / mean)) ELSE 0 END" for i in range(len(terms)))
    every = "WHERE " + " AND ".join(f"f{i} > 0" for i in range(len(terms))) if conjunctive else ""
    return f"""{name}_t AS (SELECT id, t, len(t) AS n FROM (SELECT id, {t} AS t FROM {source})), {name}_f AS (SELECT id, n, {f} FROM {name}_t),
{name}_s AS (SELECT count(*) AS docs, avg(n) AS mean, {df} FROM {name}_f),
{name}_r AS (SELECT id, round({part}, 6) AS score FROM {name}_f, {name}_s {every}),
{name}_k AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {name}_r ORDER BY rank LIMIT {k}),
{name} AS (SELECT id, round(score / max(score) OVER (), 6) AS score, CAST(rank AS INTEGER) AS rank FROM {name}_k WHERE score > 0)"""


_THREE = ["heention", "les", "the"]
_HYBRID = (
    f"{_RECORDS}, {_bm25('records', _THREE, 100, 'lexical')}"
    + """, vector_list AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, kind, id) AS rank FROM (SELECT id, score, 1 AS kind FROM chunk_list UNION ALL SELECT id, score, 2 FROM summary_list)),
every AS (SELECT id, score, rank, 1 AS list FROM vector_list UNION ALL SELECT id, score, rank, 2 FROM lexical UNION ALL SELECT id, score, rank, 3 FROM summary_list),
fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min({'l': list, 'r': rank, 's': score}) AS p FROM every GROUP BY id),
hybrid AS (SELECT id, p.s AS score, rrf, CAST(row_number() OVER (ORDER BY rrf DESC, p.l, p.r, id) AS INTEGER) AS rank FROM fused ORDER BY rank LIMIT 10)"""
)

SQL = {
    "hybrid_search": f"WITH {_HYBRID} SELECT id, score, rrf, rank FROM hybrid",
    "engine_search": f"WITH {_HYBRID.replace(chr(39) + 'the' + chr(39) + ', ' + chr(39) + 'heention', chr(39) + 'heention').replace(_bm25('records', _THREE, 100, 'lexical'), _bm25('records', ['heention', 'les'], 100, 'lexical'))} SELECT id, score, rank FROM hybrid",
    "classify_files": f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '.bashrc' ELSE 'f' || doc_id || {_ENDINGS}[doc_id % {len(_ENDINGS)} + 1] END AS filename FROM documents
        UNION ALL SELECT -page_id - 1, page_id || '.html' FROM pages), s AS (SELECT *, lower(regexp_extract(filename, '[^.](\\.[^.]+)$', 1)) AS e FROM f),
        kinds AS (SELECT unnest({list(EXTENSIONS)}) AS e, unnest({list(EXTENSIONS.values())}) AS kind), mimes AS (SELECT unnest({list(MIME)}) AS e, unnest({list(MIME.values())}) AS mime)
        SELECT doc_id, filename, coalesce(kind, 'unknown') AS file_type, coalesce(mime, 'application/octet-stream') AS mime_type, filename LIKE '.%' AS hidden FROM s LEFT JOIN kinds USING (e) LEFT JOIN mimes USING (e)""",
    "hash_and_dedup": f"WITH {_FILES} SELECT min(absolute_path) AS absolute_path, file_hash FROM files GROUP BY file_hash",
    "needs_reindex": f"WITH {_FILES} SELECT absolute_path, file_hash FROM files WHERE file_hash NOT IN (SELECT file_hash FROM files WHERE doc_id % 2 = 0)",
    "replace_on_change": f"WITH {_FILES} SELECT absolute_path, CASE WHEN doc_id % 4 = 0 THEN sha256(content || ' changed') ELSE file_hash END AS file_hash FROM files WHERE doc_id % 2 = 0",
    "upsert_latest": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1",
    "upsert_by_id": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders",
    "delete_by_path": f"WITH {_CHUNKS} SELECT absolute_path, count(*) AS n FROM chunks WHERE absolute_path <> '/corpus/src0/en/0.txt' GROUP BY 1",
    "delete_by_folder": f"WITH {_CHUNKS} SELECT parent_directory, count(*) AS n FROM chunks WHERE NOT (parent_directory = '{FOLDER}' OR starts_with(parent_directory, '{FOLDER}/')) GROUP BY 1",
    "list_folders": f"WITH {_FILES} SELECT DISTINCT parent_directory FROM files",
    "catalog_stats": f"""WITH {_CHUNKS} SELECT 'total_records' AS name, count(*) AS value FROM chunks UNION ALL SELECT 'total_files', count(DISTINCT absolute_path) FROM chunks
        UNION ALL SELECT 'total_folders', count(DISTINCT parent_directory) FROM chunks UNION ALL SELECT 'count_' || file_type, count(*) FROM chunks GROUP BY file_type""",
    "file_chunks": f"WITH {_CHUNKS} SELECT chunk_index, total_chunks, content FROM chunks WHERE filename = (SELECT doc_id || '.txt' FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1)",
    "chunk_plaintext": f"WITH {_CHUNKS} SELECT id, chunk_index, total_chunks, content FROM chunks",
    "clip_windows": """SELECT p_partkey, CAST(i * 10 AS DOUBLE) AS clip_start, least(d, i * 10.0 + 20) AS clip_end
        FROM (SELECT p_partkey, d, unnest(range(CAST(greatest(ceil((d - 1) / 10), 1) AS INTEGER))) AS i FROM (SELECT p_partkey, CASE WHEN p_size > 0 THEN CAST(p_size * 3.5 AS DOUBLE) ELSE 300.0::DOUBLE END AS d FROM part))""",
    "frame_schedule": """SELECT p_partkey, CAST(f AS BIGINT) AS frame, round(f / r, 6) AS frame_start, round(f / r + 1, 6) AS frame_end
        FROM (SELECT p_partkey, r, unnest(range(0, p_size * 10, CAST(r AS BIGINT))) AS f FROM (SELECT p_partkey, p_size, CASE WHEN p_size % 31 > 0 THEN CAST(p_size % 31 AS DOUBLE) ELSE 25.0::DOUBLE END AS r FROM part))""",
    "subtitle_parse": r"SELECT conv_id, turn * 10 + 0.25::DOUBLE AS cue_start, turn * 10 + 9.25::DOUBLE AS cue_end, trim(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '-->', '')) AS text FROM conversations WHERE trim(text) <> ''",
    "representative_text": f"""WITH {_CHUNKS} SELECT absolute_path, string_agg(substr(content, 1, CAST(6000 - b AS INTEGER)), chr(10) || chr(10) ORDER BY chunk_index) AS text
        FROM (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY absolute_path ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM chunks) WHERE b < 6000 GROUP BY 1""",
    "summary_records": f"WITH {_CHUNKS} SELECT absolute_path || '#summary' AS id, 'summary' AS record_type, substr(content, 1, 200) AS summary, file_hash FROM chunks WHERE chunk_index = 0",
    "tokenize_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY 1",
    "bm25_topk": f"WITH {_CHUNKS}, {_bm25('chunks', _THREE, 20, 'best')} SELECT * FROM best",
    "bm25_topk_folder": f"WITH {_CHUNKS}, within AS (SELECT * FROM chunks WHERE parent_directory = '{FOLDER}' OR starts_with(parent_directory, '{FOLDER}/')), {_bm25('within', _THREE, 20, 'best')} SELECT * FROM best",
    "conjunctive_match": f"WITH {_CHUNKS}, {_bm25('chunks', ['and', 'of', 'the'], 20, 'best', True)} SELECT * FROM best",
    "normalize_vectors": """SELECT vec_id, CAST(i AS INTEGER) AS i, CASE WHEN abs(embedding[i + 1] * 3 / n) < 0.000005 THEN 0 ELSE round(CAST(embedding[i + 1] AS DOUBLE) * 3 / n, 5) END AS x
        FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i, 3 * sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)""",
    "hashed_embedding": f"""WITH tf AS (SELECT doc_id, b, count(*) AS c FROM (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS t FROM documents)) GROUP BY 1, 2)
        SELECT doc_id, CAST(b AS INTEGER) AS i, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS x FROM tf""",
    "rrf_fuse": f"""WITH {_RECORDS}, {_bm25('records', _THREE, 100, 'lexical')}, v AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored ORDER BY rank LIMIT 50),
        every AS (SELECT id, score, rank, 1 AS list FROM v UNION ALL SELECT id, score, rank, 2 FROM lexical)
        SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, arg_min(score, list) AS score, CAST(min(list) AS INTEGER) AS first_list, CAST(arg_min(rank, list) AS INTEGER) AS first_rank FROM every GROUP BY id""",
    "file_groups": f"""WITH {_RECORDS}, own AS (SELECT absolute_path, id, row_number() OVER (PARTITION BY absolute_path ORDER BY rank) AS n FROM chunk_list)
        SELECT s.absolute_path, s.summary, s.score AS best_score, CAST(s.rank AS INTEGER) AS summary_rank, coalesce((SELECT string_agg(id, ',' ORDER BY n) FROM own WHERE own.absolute_path = s.absolute_path AND n <= 3), '') AS chunk_ids FROM summary_list s""",
    "relevance_gate": f"WITH {_HYBRID} SELECT max(score) AS best_score, CASE WHEN max(score) >= 0.65 THEN 'pass' ELSE 'fail' END AS verdict FROM hybrid",
    "recent_history": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4",
    "debounce_events": """WITH a AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
        b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING) AS s FROM a)
        SELECT user_id, max(ts) AS ts, arg_max(event_type, {'t': ts, 'e': event_type}) AS event_type, count(*) AS n_events FROM b GROUP BY user_id, s""",
    "progress_rollup": """WITH j AS (SELECT '/corpus/' || source || '/' || lang AS folder, CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 5 = 0 AND lang <> 'en' THEN 'pending' ELSE 'completed' END AS status FROM documents)
        SELECT folder, count(*) AS total, count(*) FILTER (status <> 'pending') AS processed, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status <> 'pending') / count(*) * 100, 6) AS progress_pct,
        CASE WHEN count(*) FILTER (status <> 'pending') >= count(*) THEN 'completed' ELSE 'processing' END AS state FROM j GROUP BY folder""",
}
_COS = """q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
c AS (SELECT vec_id, round(greatest(0, least(1, list_dot_product(e, qd) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qd, qd))))), 6) AS score
    FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, (SELECT list_transform(q, lambda x: CAST(x AS DOUBLE)) FROM q) AS qd FROM embeddings))"""
SQL |= {
    "cosine_topk": f"WITH {_COS} SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM c ORDER BY rank LIMIT 10",
    "cosine_topk_filtered": f"""WITH {_FILES}, {_COS} SELECT vec_id, absolute_path, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM c JOIN files ON files.doc_id = c.vec_id
        WHERE parent_directory = '{FOLDER}' OR starts_with(parent_directory, '{FOLDER}/') ORDER BY rank LIMIT 10""",
    "context_blocks": f"""WITH {_HYBRID.replace('LIMIT 10)', 'LIMIT 5)').replace('ORDER BY rank LIMIT 100)', 'ORDER BY rank LIMIT 100)').replace('LIMIT 50)', 'LIMIT 25)')}
        SELECT string_agg('[' || h.rank || '] ' || CASE WHEN record_type = 'summary' THEN 'Summary' ELSE 'Excerpt' END || ' of ' || filename || chr(10) || content, chr(10) || chr(10) ORDER BY h.rank) AS context FROM hybrid h JOIN records USING (id)""",
}

_SENTENCES = r"""md AS (SELECT absolute_path, p, len(list_filter(string_split_regex(p, '\s+'), lambda x: x <> '')) AS n FROM (SELECT absolute_path, regexp_replace(content, '^\s+|\s+$', '', 'g') AS p FROM files) WHERE p <> ''),
sl AS (SELECT absolute_path, list_filter(list_transform(string_split_regex(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM md WHERE n > 500),
sp AS (SELECT absolute_path, s, len(s) AS n, list_transform(range(len(s) + 1), lambda i: coalesce(list_sum(list_transform(s[1:i], lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')))), 0)) AS c FROM sl),
packs AS (
    SELECT absolute_path, 0 AS k, 0::BIGINT AS b, coalesce(nullif(list_position(list_transform(range(1, n), lambda i: c[i + 2] > 500), true), 0), n) AS e FROM sp
    UNION ALL
    SELECT absolute_path, k + 1, b2, coalesce(nullif(list_position(list_transform(range(e + 1, n), lambda i: c[i + 2] - c[b2 + 1] > 500), true), 0) + e, n)
    FROM (SELECT packs.absolute_path, k, e, n, c, e - greatest(1, (e - b) * 15 // 100) AS b2 FROM packs JOIN sp USING (absolute_path) WHERE e < n)
),
md_chunks AS (SELECT absolute_path, 0 AS chunk_index, p AS content FROM md WHERE n <= 500 UNION ALL SELECT absolute_path, k, array_to_string(s[b + 1:e], ' ') FROM packs JOIN sp USING (absolute_path)),
md_records AS (SELECT absolute_path || '#' || chunk_index AS id, absolute_path, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY absolute_path) AS INTEGER) AS total_chunks, content FROM md_chunks)"""
_WINDOWS = r"""cues AS (SELECT conv_id, turn * 10 + 0.25::DOUBLE AS s, turn * 10 + 9.25::DOUBLE AS e, trim(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '-->', '')) AS text FROM conversations WHERE trim(text) <> ''),
cl AS (SELECT conv_id, count(*) AS n, list(s ORDER BY s, e, text) AS s, list(e ORDER BY s, e, text) AS e, list(text ORDER BY s, e, text) AS t FROM cues WHERE text <> '' GROUP BY 1),
wins AS (
    SELECT conv_id, 0 AS k, 0::BIGINT AS b, coalesce(nullif(list_position(list_transform(range(1, n), lambda i: s[i + 1] > s[1] + 30), true), 0), n) AS z FROM cl
    UNION ALL
    SELECT conv_id, k + 1, b2, coalesce(nullif(list_position(list_transform(range(z + 1, n), lambda i: s[i + 1] > s[b2 + 1] + 30), true), 0) + z, n)
    FROM (SELECT wins.conv_id, k, z, n, s, coalesce(nullif(list_position(list_transform(range(b, z), lambda i: s[i + 1] >= s[b + 1] + 25), true), 0) + b - 1, z) AS b2 FROM wins JOIN cl USING (conv_id) WHERE z < n)
),
subs AS (SELECT conv_id, CAST(k AS INTEGER) AS chunk_index, s[b + 1] AS timestamp_start, e[z] AS timestamp_end, array_to_string(t[b + 1:z], ' ') AS content FROM wins JOIN cl USING (conv_id))"""
_PROBED = "v AS (SELECT p_partkey, p_size, p_name, CASE WHEN p_size > 0 THEN CAST(p_size * 3.5 AS DOUBLE) ELSE 300.0::DOUBLE END AS d, CASE WHEN p_partkey % 31 > 0 THEN CAST(p_partkey % 31 AS DOUBLE) ELSE 25.0::DOUBLE END AS r FROM part WHERE p_partkey <= 200)"
_SAID = "said AS (SELECT p_partkey, unnest(w) AS w, unnest(range(len(w))) AS k, len(w) AS n FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM v))"
SQL |= {
    "chunk_markdown": f"WITH RECURSIVE {_FILES}, {_SENTENCES} SELECT absolute_path, chunk_index, content FROM md_records",
    "ingest_chunks": f"WITH RECURSIVE {_FILES}, {_SENTENCES} SELECT id, chunk_index, total_chunks, content FROM md_records",
    "udtf_chunks": f"WITH RECURSIVE {_FILES}, {_SENTENCES} SELECT doc_id, chunk_index, md_records.content FROM md_records JOIN files USING (absolute_path) WHERE doc_id % 7 = 0",
    "subtitle_windows": f"WITH RECURSIVE {_WINDOWS} SELECT * FROM subs",
    "route_by_type": f"""WITH RECURSIVE files AS (SELECT '/m/' || doc_id || '.md' AS absolute_path, text AS content FROM documents WHERE doc_id % 5 = 0), {_SENTENCES}, {_WINDOWS}
        SELECT id, 'document' AS file_type, chunk_index, total_chunks, content, NULL::DOUBLE AS timestamp_start FROM md_records
        UNION ALL SELECT '/s/' || conv_id || '.srt#' || chunk_index, 'subtitle', chunk_index, CAST(count(*) OVER (PARTITION BY conv_id) AS INTEGER), content, round(timestamp_start, 3) FROM subs
        UNION ALL SELECT '/i/' || p_partkey || '.png#0', 'image', 0, 1, 'Image file: ' || p_partkey || '.png (width: ' || p_size || ', height: ' || p_partkey || ', format: PNG)', NULL FROM part WHERE p_partkey <= 100""",
    "video_clips": f"""WITH {_PROBED}, c AS (SELECT p_partkey, d, unnest(range(CAST(greatest(ceil((d - 1) / 10), 1) AS INTEGER))) AS i, CAST(greatest(ceil((d - 1) / 10), 1) AS INTEGER) AS n FROM v), w AS (SELECT *, CAST(i * 10 AS DOUBLE) AS a, least(d, i * 10.0 + 20) AS b FROM c)
        SELECT '/v/' || p_partkey || '.mp4#c' || i AS id, printf('[Video Segment] %d.mp4 from %.1fs to %.1fs', p_partkey, a, b) AS content, CAST(i AS INTEGER) AS chunk_index, n AS total_chunks, a AS timestamp_start, b AS timestamp_end, 'video/mp4' AS mime_type FROM w""",
    "video_local": f"""WITH {_PROBED}, {_SAID}, f AS (SELECT p_partkey, r, unnest(range(0, p_size * 10, CAST(r AS BIGINT))) AS f, unnest(range(len(range(0, p_size * 10, CAST(r AS BIGINT))))) AS i FROM v)
        SELECT '/v/' || p_partkey || '.mp4#a' || k AS id, '[Audio Transcript] ' || w AS content, 'video' AS file_type, 'video/mp4' AS mime_type, k * 2.0::DOUBLE AS timestamp_start, NULL AS metadata_json FROM said
        UNION ALL SELECT '/v/' || p_partkey || '.mp4#f' || i, printf('[Visual Frame] Video: %d.mp4 at %.2fs', p_partkey, f / r), 'video', 'image/jpeg', round(f / r, 6), '{{"frame":' || f || '}}' FROM f""",
    "audio_segments": f"""WITH {_PROBED}, {_SAID} SELECT '/v/' || p_partkey || '.mp3#' || k AS id, w AS content, CAST(k AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS total_chunks, k * 2.0::DOUBLE AS timestamp_start, k * 2.0::DOUBLE + 1.5::DOUBLE AS timestamp_end FROM said""",
    "archive_members": "SELECT '/z/' || doc_id || '.zip/in/a.txt' AS absolute_path, 'a.txt' AS filename, 'document' AS file_type, sha256(text) AS file_hash FROM documents WHERE doc_id % 10 = 3",
    "records_by_hash": f"WITH {_CHUNKS} SELECT id, chunk_index, file_hash FROM chunks WHERE file_hash = (SELECT min(file_hash) FROM files)",
    "preview_text": r"SELECT doc_id, CASE WHEN len(l) > 3 THEN array_to_string(l[1:3], chr(10)) || chr(10) || '… (truncated)' ELSE text END AS preview FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)",
    "scan_counts": f"SELECT file_type, count(*) AS files, CAST(sum(length(filename)) AS BIGINT) AS bytes FROM ({SQL['classify_files']}) GROUP BY 1",
    "vtt_parse": "SELECT conv_id, turn, turn * 10 + 0.25::DOUBLE AS cue_start, turn * 10 + 9.25::DOUBLE AS cue_end, 'hello ' || role AS text FROM conversations",
    "vector_parse": "SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS i, unnest(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 3) + 0.0)) AS x FROM embeddings",
    "bm25_postings": SQL["bm25_topk"],
    "summary_search": f"WITH {_RECORDS} SELECT id, score, CAST(rank AS INTEGER) AS rank FROM summary_list",
    "chunk_search": f"WITH {_RECORDS} SELECT id, score, CAST(rank AS INTEGER) AS rank FROM chunk_list WHERE rank <= 10",
    "query_hint": f"WITH {_RECORDS} SELECT content AS hint FROM chunk_list WHERE rank = 1",
    "result_cards": f"WITH {_HYBRID} SELECT h.rank, CAST(floor(round(h.score * 100, 6)) AS INTEGER) AS percent, filename, absolute_path, content FROM hybrid h JOIN records USING (id)",
    "folders_json": f"WITH {_FILES} SELECT CAST(to_json(list(DISTINCT parent_directory ORDER BY parent_directory)) AS VARCHAR) AS json FROM files",
    "chunks_json": f"WITH c AS ({SQL['file_chunks']}) SELECT CAST(to_json(list({{'chunk_index': chunk_index, 'total_chunks': total_chunks, 'content': content}} ORDER BY chunk_index)) AS VARCHAR) AS json FROM c",
    "document_lines": f"""WITH {_RECORDS} SELECT string_agg(printf('- %s (score %.2f)', filename, score) || chr(10) || '  ' || absolute_path || chr(10) || '  ' || summary, chr(10) ORDER BY rank) AS text FROM summary_list""",
    "catalog_changes": f"""WITH {_CHUNKS}, o AS (SELECT *, CAST(regexp_extract(filename, '^(\\d+)', 1) AS BIGINT) AS n FROM chunks)
        SELECT id, CASE WHEN n % 6 = 0 THEN 'short' WHEN n % 4 < 2 THEN 'new' ELSE '' END AS summary FROM o WHERE (n % 2 = 0 OR n % 4 < 2) AND (n % 6 <> 0 OR chunk_index = 0) AND NOT (parent_directory = '{FOLDER}' OR starts_with(parent_directory, '{FOLDER}/'))""",
    "udtf_clips": SQL["clip_windows"],
    "stream_ingest": f"""WITH RECURSIVE {_FILES.replace('FROM documents)', 'FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source, lang, CAST(doc_id AS VARCHAR)) AS first FROM documents) WHERE first = 1)')}, {_SENTENCES}
        SELECT 'chunk' AS record_type, count(*) AS n, count(DISTINCT absolute_path) AS files FROM md_records UNION ALL SELECT 'summary', count(*), count(*) FROM md_records WHERE chunk_index = 0""",
}
