"""Text as column expressions: tokens, chunks, subtitles, paths, hashed vectors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import batches
from siltstone.functions.batches import TOKEN
from siltstone.schema import EXTENSIONS, MIME


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in sorted(values.items()) for x in pair))


def tokens(text: Column | str) -> Column:
    """Terms: found first, lower case after."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def words(text: Column | str) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def filename(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column | str) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def suffix(path: Column | str) -> Column:
    """The last extension, lower case; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(filename(path), r"[^.](\.[^.]+)$", 1))


def file_type(path: Column | str) -> Column:
    tar = F.lower(filename(path)).endswith(".tar.gz")
    return F.when(tar, F.lit("archive")).otherwise(F.coalesce(F.try_element_at(_literal_map(EXTENSIONS), suffix(path)), F.lit("unknown")))


def mime_type(path: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(MIME), suffix(path)), F.lit("application/octet-stream"))


def hidden(path: Column | str) -> Column:
    """Whether any part of the path begins with a dot."""
    return F.exists(F.split(path, "/"), lambda p: p.startswith("."))


def in_folder(directory: Column | str, folder: str, prefix_compat: bool = False) -> Column:
    """The folder's subtree; prefix_compat: any directory whose name begins so."""
    c = F.col(directory) if isinstance(directory, str) else directory
    return c.startswith(folder) if prefix_compat else (c == folder) | c.startswith(folder.rstrip("/") + "/")


def plain_chunks(text: Column | str, size: int = 500, overlap: float = 0.15) -> Column:
    """Array of word windows; the last is the first that reaches the end. No words, no windows."""
    step = max(1, int(size * (1 - overlap)))
    w = words(text)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(w) - size) / F.lit(step)), F.lit(0)).cast("int"))
    return F.when(F.size(w) > 0, F.transform(starts, lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def word_windows(size: int = 500, overlap: float = 0.15):
    """A column function as plain_chunks(), Arrow-batched: it reads a text once, where slices and joins of arrays took ten times as long."""
    step = max(1, int(size * (1 - overlap)))
    return batches.of_texts("array<string>", lambda texts: pa.array([batches.windows(t, size, step) for t in texts], batches.STRINGS))


def exploded(rows: DataFrame, column: str, *names: str) -> DataFrame:
    """rows with a row for each element of an array (its place and value) or map (its key and value) in place of the column; none for empty ones.

    For columns that Python makes: of a plain explode() Spark infers that the array isn't empty, filters by that below, and
    calls the function there once more.
    """
    each = F.explode_outer if dict(rows.dtypes)[column].startswith("map<") else F.posexplode_outer
    return rows.select(*(c for c in rows.columns if c != column), each(column).alias(*names)).filter(F.col(names[0]).isNotNull())


def chunked(rows: DataFrame, text: str, size: int = 500, overlap: float = 0.15) -> DataFrame:
    """rows without text, with chunk_index, total_chunks and content."""
    kept = [c for c in rows.columns if c != text]
    return exploded(rows.withColumn("_c", word_windows(size, overlap)(text)).select(*kept, F.size("_c").alias("total_chunks"), "_c"), "_c", "chunk_index", "content")


def seconds(code: Column | str) -> Column:
    """Seconds of HH:MM:SS.mmm or MM:SS.mmm (a comma will do); the last part is whole milliseconds; else 0."""
    parts = F.split(F.regexp_replace(F.trim(code), ",", "."), "[:.]")
    n = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("double"), F.lit(0.0))
    four = n(1) * 3600 + n(2) * 60 + n(3) + n(4) / 1000
    three = n(1) * 60 + n(2) + n(3) / 1000
    return F.when(F.size(parts) == 4, four).when(F.size(parts) == 3, three).otherwise(F.lit(0.0))


_SRT = r"(\d{2}:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[,.]\d{3})"
_VTT = r"((?:\d{2}:)?\d{2}:\d{2}\.\d{3})\s*-->\s*((?:\d{2}:)?\d{2}:\d{2}\.\d{3})"


def subtitle_cues(text: Column | str, kind: str = "srt") -> Column:
    """Array of (start, end, text) of an SRT or WebVTT file, in its order."""
    pattern = _SRT if kind == "srt" else _VTT
    blocks = F.filter(F.split(F.trim(F.regexp_replace(text, "\r", "")), r"\n\s*\n"), lambda b: F.regexp_like(b, F.lit(pattern)))

    def cue(b: Column) -> Column:
        lines = F.split(b, "\n")
        at = F.array_position(F.transform(lines, lambda x: F.regexp_like(x, F.lit(pattern))), True).cast("int")
        return F.struct(
            seconds(F.regexp_extract(b, pattern, 1)).alias("start"),
            seconds(F.regexp_extract(b, pattern, 2)).alias("end"),
            F.trim(F.array_join(F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0))), " ")).alias("text"),
        )

    return F.filter(F.transform(blocks, cue), lambda c: c["text"] != "")


def clip_windows(duration: Column | str, length: int = 20, overlap: int = 10) -> Column:
    """Array of (start, end): clips of this length until a start would come within a second of the end; null or no duration: 300 s."""
    if overlap >= length:
        raise ValueError("overlap must be below length")
    d = F.coalesce(F.col(duration) if isinstance(duration, str) else duration, F.lit(0.0)).cast("double")
    d = F.when(d > 0, d).otherwise(F.lit(300.0))
    step = length - overlap
    n = F.greatest(F.ceil((d - 1) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * step).cast("double").alias("start"), F.least(d, (i * step + length).cast("double")).alias("end")))


def frame_schedule(frames: Column | str, fps: Column | str) -> Column:
    """Array of (frame, start, end): one frame about every second."""
    rate = F.when(F.col(fps) > 0, F.col(fps).cast("double")).otherwise(F.lit(25.0))
    every = F.greatest(F.rint(rate), F.lit(1.0)).cast("long")
    n = F.col(frames).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1, every), lambda i: F.struct(i.alias("frame"), (i / rate).alias("start"), (i / rate + 1).alias("end")))).otherwise(
        F.array().cast("array<struct<frame:bigint,start:double,end:double>>")
    )


def bucket(token: Column, dim: int = 64) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dim).cast("int")


def hashed_vector(dim: int = 64):
    """A column function: the unit vector of a text's hashed term counts; the zero vector without terms. Arrow-batched, and no term is shuffled."""

    buckets = batches.Buckets(dim)
    return batches.of_texts("array<double>", lambda texts: batches.vectors(texts, buckets))


def hashed_vectors(rows: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """key and the hashed_vector() of the text."""
    return rows.select(key, hashed_vector(dim)(text).alias("vector"))


def normalised(v: Column | str) -> Column:
    c = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(c, lambda x: x.cast("double") / norm)).otherwise(F.transform(c, lambda x: x.cast("double")))
