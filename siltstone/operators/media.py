"""Records of files of every kind: each file goes, by its type, to the reader that cuts it.

Readers work on the bytes of a batch of files in the tasks (mapInPandas); what needs a library or a model is a function
of Providers, and a kind whose function isn't given yields no records (images yield theirs without).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import batches
from siltstone.functions.folds import html_to_markdown, subtitle_windows
from siltstone.functions.images import described, image_info
from siltstone.functions.text import clip_windows, frame_schedule, subtitle_cues
from siltstone.operators.catalog import structured_chunks
from siltstone.schema import Settings
from siltstone.sources import files as source

FILE = ["absolute_path", "filename", "parent_directory", "file_type", "mime_type", "file_hash", "file_modified_at"]
_KEYS = "absolute_path string"


def _mapped(files: DataFrame, columns: str, each: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    """absolute_path and these columns: the rows of each(name, bytes)."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.strip().rsplit(" ", 1) for c in f"{_KEYS}, {columns}".split(","))])

    def run(found):
        for batch in found:
            for begin, end in batches.slices(batch.column("content")):
                part = batch.slice(begin, end - begin).to_pylist()
                rows = [(r["absolute_path"], *row) for r in part for row in each(r["filename"], r["content"])]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=schema.names), schema, preserve_index=False)

    return files.select("absolute_path", "filename", "content").mapInArrow(run, f"{_KEYS}, {columns}")


def _named(rows: DataFrame, files: DataFrame) -> DataFrame:
    return files.select(*FILE).join(rows, "absolute_path")


def _records(rows: DataFrame, mark: str = "") -> DataFrame:
    """id and record_type of chunks; mark tells apart what one file gives in several ways."""
    return rows.withColumn("id", F.concat("absolute_path", F.lit("#" + mark), F.col("chunk_index").cast("string"))).withColumn("record_type", F.lit("chunk")).withColumn("summary", F.lit(""))


def document_texts(files: DataFrame, parse=None, ocr_pages=None) -> DataFrame:
    """FILE and content as text: plain text by UTF-8, HTML as Markdown, other documents by parse(name, bytes); a PDF without text by ocr_pages(bytes), a section a page."""
    kinds = files.filter("file_type = 'document'")

    def read(name: str, content: bytes):
        end = name.lower().rsplit(".", 1)[-1]
        if f".{end}" in source.TEXT:
            text = content.decode("utf-8", "replace")
        elif end in ("html", "htm"):
            text = html_to_markdown(content.decode("utf-8", "replace"))
        else:
            text = parse(name, content) if parse else None
        if end == "pdf" and ocr_pages and not (text or "").strip():
            text = "\n\n".join(f"## Page {k}\n\n{page}" for k, page in enumerate(ocr_pages(content), 1) if page.strip())
        if text is not None:
            yield (text,)

    return _named(_mapped(kinds, "content string", read), kinds)


def document_records(texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Chunks of texts (FILE and content) along their structure, by word windows where that fails."""
    return structured_chunks(texts, settings.chunk_words, settings.chunk_overlap)


def subtitle_records(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Windows of the cues of SRT and WebVTT files."""
    windows = subtitle_windows(source.cues(files.filter("file_type = 'subtitle'")), "absolute_path", settings.subtitle_window, settings.subtitle_carry)
    rows = windows.withColumn("total_chunks", F.count("*").over(_of_file()).cast("int"))
    return _records(_named(rows, files))


def _of_file():
    return Window.partitionBy("absolute_path")


_SEGMENTS = "chunk_index int, total_chunks int, timestamp_start double, timestamp_end double, content string"


def _segments(transcribe):
    def read(name: str, content: bytes):
        found = list(transcribe(name, content))
        for k, (start, end, text) in enumerate(found):
            yield k, len(found), float(start), float(end), text.strip()

    return read


def audio_records(files: DataFrame, transcribe=None) -> DataFrame | None:
    """A record for each segment of transcribe(name, bytes): (start, end, text)."""
    if transcribe is None:
        return None
    kinds = files.filter("file_type = 'audio'")
    return _records(_named(_mapped(kinds, _SEGMENTS, _segments(transcribe)), kinds))


def relabelled(rows: DataFrame, label: str) -> DataFrame:
    """The records of a part of a video, named so."""
    return rows.withColumn("content", F.concat(F.lit(f"[{label}] "), "content")).withColumn("file_type", F.lit("video"))


def video_records(files: DataFrame, settings: Settings = Settings(), transcribe=None, probe=None, embedded_subtitles=None) -> list[DataFrame]:
    """Local: the transcript, a frame about every second, the embedded subtitles. Cloud: overlapping clips.

    probe(name, bytes) gives duration, frames and fps; without it a video has clips of the first 300 seconds and no frames.
    """
    kinds, out = files.filter("file_type = 'video'"), []
    known = "duration double, frames long, fps double"
    read = lambda name, content: [tuple(probe(name, content).get(k) for k in ("duration", "frames", "fps"))]
    if settings.video_mode == "cloud":
        rows = _mapped(kinds, known, read) if probe else kinds.select("absolute_path", F.lit(None).cast("double").alias("duration"))
        clips = rows.select("absolute_path", F.posexplode(clip_windows("duration", settings.clip_seconds, settings.clip_overlap)).alias("chunk_index", "_w"))
        clips = _named(clips, kinds).withColumns({"timestamp_start": F.col("_w.start"), "timestamp_end": F.col("_w.end"), "mime_type": F.lit("video/mp4"), "total_chunks": F.count("*").over(_of_file()).cast("int")}).drop("_w")
        return [_records(clips.withColumn("content", F.format_string("[Video Segment] %s from %.1fs to %.1fs", "filename", "timestamp_start", "timestamp_end")), "c")]
    if transcribe:
        out.append(_records(relabelled(_named(_mapped(kinds, _SEGMENTS, _segments(transcribe)), kinds), "Audio Transcript"), "a"))
    if probe:
        frames = _mapped(kinds, known, read).select("absolute_path", F.posexplode(frame_schedule("frames", "fps")).alias("chunk_index", "_f"))
        frames = _named(frames, kinds).withColumns(
            {"timestamp_start": F.col("_f.start"), "timestamp_end": F.col("_f.end"), "mime_type": F.lit("image/jpeg"), "metadata_json": F.to_json(F.struct(F.col("_f.frame").alias("frame"))), "total_chunks": F.count("*").over(_of_file()).cast("int")}
        ).drop("_f")
        out.append(_records(frames.withColumn("content", F.format_string("[Visual Frame] Video: %s at %.2fs", "filename", "timestamp_start")), "f"))
    if embedded_subtitles:
        tracks = _mapped(kinds, "t string", lambda name, content: [(t,) for t in [embedded_subtitles(name, content)] if t])
        windows = subtitle_windows(tracks.select("absolute_path", F.inline(subtitle_cues("t"))), "absolute_path", settings.subtitle_window, settings.subtitle_carry)
        windows = windows.withColumn("total_chunks", F.count("*").over(_of_file()).cast("int"))
        out.append(_records(relabelled(_named(windows, kinds), "Subtitle"), "s"))
    return out


def image_records(files: DataFrame, settings: Settings = Settings(), info=image_info, ocr=None, has_text=None) -> DataFrame:
    """One record an image: what its header tells, and the text that ocr(bytes) reads where has_text(bytes) allows; each content is read once."""
    kinds = files.filter("file_type = 'image'")

    def read(name: str, content: bytes):
        known = info(content)
        text = ocr(content) if ocr and settings.ocr and (has_text is None or has_text(content)) else ""
        yield json.dumps(known, default=str), described("", known).removeprefix("Image file: "), text or ""

    once = kinds.withColumn("_n", F.row_number().over(_by_hash())).filter("_n = 1").drop("_n")
    of = once.select("absolute_path", "file_hash").join(_mapped(once, "metadata_json string, tags string, text string", read), "absolute_path").drop("absolute_path")
    rows = kinds.select(*FILE).join(of, "file_hash").withColumns({"chunk_index": F.lit(0), "total_chunks": F.lit(1)})
    name = F.concat(F.lit("Image file: "), F.col("filename"), F.when(F.col("tags") == "", "").otherwise(F.concat(F.lit(" "), F.trim("tags"))))
    return _records(rows.withColumn("content", F.concat(name, F.when(F.col("text") == "", "").otherwise(F.concat(F.lit("\n[OCR Text]\n"), "text"))))).drop("tags", "text")


def _by_hash():
    return Window.partitionBy("file_hash").orderBy("absolute_path")


def expanded(files: DataFrame) -> DataFrame:
    """FILE and bytes of files that may give records: archives are replaced by their members, once; unknown files go."""
    inside = source.unpacked(files.filter(source.readable_archive("filename"))).select(*FILE, "content")
    return files.select(*FILE, "content").unionByName(inside).filter(~F.col("file_type").isin("archive", "unknown"))


def routed(files: DataFrame, settings: Settings = Settings(), providers=None) -> DataFrame:
    """The chunk records of files (FILE and bytes) of all kinds; see expanded() for archives and unknown files."""
    p = providers
    get = lambda name: getattr(p, name, None)
    parts = [
        document_records(document_texts(files, get("parse"), get("ocr_pages") if settings.ocr else None), settings), subtitle_records(files, settings), audio_records(files, get("transcribe")),
        *video_records(files, settings, get("transcribe"), get("probe"), get("embedded_subtitles")), image_records(files, settings, get("image_info") or image_info, get("ocr"), get("has_text")),
    ]
    parts = [x for x in parts if x is not None]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out
