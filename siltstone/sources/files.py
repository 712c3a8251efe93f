"""Directories of files as DataFrames: scan, classify, hash, decode, unpack, read subtitles and HTML."""

from __future__ import annotations

import io
import os
import tarfile
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.batches import SLICE
from siltstone.functions.folds import html_markdown, utf8_text
from siltstone.functions.text import file_type, filename, hidden, mime_type, parent, subtitle_cues

TEXT = [".txt", ".md", ".csv", ".json", ".xml"]
FILES = "absolute_path string, file_modified_at timestamp, size bigint, content binary"


def scan(spark: SparkSession, directory: str) -> DataFrame:
    """All files below the directory but those below names that begin with a dot: metadata, hash and bytes.

    The built-in reader leaves out names that begin with an underscore; scan_all() has them too. A folder that isn't there has no files.
    """
    if not os.path.isdir(directory) and "://" not in directory:
        return described(spark.createDataFrame([], FILES))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    path = F.regexp_replace("path", r"^file:/+", "/")
    rows = raw.select(path.alias("absolute_path"), F.col("modificationTime").alias("file_modified_at"), F.col("length").alias("size"), "content")
    base = directory.rstrip("/")
    return described(rows.filter(~hidden(F.expr(f"substr(absolute_path, {len(base) + 1})"))))


def scan_all(spark: SparkSession, directory: str) -> DataFrame:
    """As scan(), with every visible name: paths are listed on the driver, bytes read by the tasks. For folders that all nodes share."""
    found = [os.path.join(d, f) for d, dirs, names in os.walk(directory) if not dirs.sort() for f in sorted(names) if not any(p.startswith(".") for p in os.path.relpath(os.path.join(d, f), directory).split(os.sep))]

    def one(p: str) -> tuple:
        with open(p, "rb") as f:
            s = os.stat(p)
            return p, pd.Timestamp(s.st_mtime_ns // 1000, unit="us", tz="UTC"), s.st_size, f.read()

    def read(batches):
        for pdf in batches:
            yield from _frames(map(one, pdf.absolute_path))

    names = spark.createDataFrame([(p,) for p in found], "absolute_path string")
    return described(names.mapInPandas(read, FILES))


def _frames(rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    """Rows of FILES as frames of about a megabyte of content; an empty one if nothing is left for the last."""
    names, held, size = ["absolute_path", "file_modified_at", "size", "content"], [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size >= SLICE:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    yield pd.DataFrame(held, columns=names)


def described(rows: DataFrame) -> DataFrame:
    return rows.select(
        "absolute_path", filename("absolute_path").alias("filename"), parent("absolute_path").alias("parent_directory"), file_type("absolute_path").alias("file_type"),
        mime_type("absolute_path").alias("mime_type"), F.sha2("content", 256).alias("file_hash"), "file_modified_at", "size", "content",
    )


def texts(files: DataFrame) -> DataFrame:
    """Text of the text and HTML files: absolute_path and so on, and content as a string."""
    extension = F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1))
    text = utf8_text("content")
    plain = files.filter(extension.isin(TEXT)).withColumn("content", text)
    pages = files.filter(extension.isin(".html", ".htm")).withColumn("content", html_markdown(text))
    return plain.unionByName(pages)


def cues(files: DataFrame) -> DataFrame:
    """The cues of the SRT and WebVTT files: absolute_path, start, end, text."""
    out = None
    for kind in ("srt", "vtt"):
        part = files.filter(F.lower("filename").endswith(f".{kind}")).withColumn("t", utf8_text("content")).select("absolute_path", F.inline(subtitle_cues("t", kind)))
        out = part if out is None else out.unionByName(part)
    return out


def preview(text: str = "content", lines: int = 500):
    """The first lines, and a mark where more follow."""
    parts = F.split(text, "\n")
    return F.when(F.size(parts) > lines, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n… (truncated)"))).otherwise(F.col(text))


def safe_member(name: str) -> bool:
    """Whether an archive's member stays below the folder that it is unpacked to."""
    flat = os.path.normpath(name.replace("\\", "/"))
    return not (flat.startswith(("/", "..")) or os.path.isabs(flat) or (len(flat) > 1 and flat[1] == ":"))


def readable_archive(name: str):
    """Whether unpacked() reads archives of this name."""
    return F.lower(name).rlike(r"\.(zip|tar|tar\.gz|tgz)$")


def by_type(files: DataFrame) -> DataFrame:
    """file_type, files, bytes: what a scan has found."""
    return files.groupBy("file_type").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def _members(name: str, content: bytes):
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for m in z.infolist():
                if not m.is_dir() and safe_member(m.filename):
                    yield m.filename, z.read(m)
    elif name.lower().endswith((".tar", ".tar.gz", ".tgz")):
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in t.getmembers():
                if m.isfile() and safe_member(m.name):
                    yield m.name, t.extractfile(m).read()
    else:
        raise ValueError(f"archives of this kind aren't read: {name}")


def unpacked(files: DataFrame) -> DataFrame:
    """The members of zip and tar archives as files named archive/member; unsafe members are left out, other kinds raise."""

    def run(batches):
        for pdf in batches:
            yield from _frames((f"{r.absolute_path}/{name}", r.file_modified_at, len(data), data) for r in pdf.itertuples() for name, data in _members(r.absolute_path, bytes(r.content)))

    return described(files.filter((F.col("file_type") == "archive") | F.lower("filename").endswith(".tgz")).select("absolute_path", "file_modified_at", "content").mapInPandas(run, FILES))
