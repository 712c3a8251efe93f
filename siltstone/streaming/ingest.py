"""Structured Streaming: files as they arrive, and events that settle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from siltstone.functions.text import hidden
from siltstone.operators.catalog import Catalog, files_of_documents
from siltstone.plans.engine import ingest
from siltstone.sources.files import described, scan_all


def file_stream(spark: SparkSession, path: str, schema: StructType, pattern: str | None = None, per_trigger: int = 100) -> DataFrame:
    """Parquet files of texts as they arrive, at most per_trigger a batch. pattern: those of this name, and those in folders of this name (tables of many files)."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if not pattern:
        return reader.parquet(path)
    # in braces a plain name counts as a pattern too: Spark takes the path of one file for a folder else
    return reader.parquet(f"{path}/{pattern if re.search(r'[][{}*?]', pattern) else f'{{{pattern}}}'}")


def directory_stream(spark: SparkSession, directory: str, per_trigger: int = 100) -> DataFrame:
    """Files of any kind as they arrive below a directory, as scans give them; names that begin with a dot are left out."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    raw = raw.option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(directory)
    rows = raw.select(F.regexp_replace("path", r"^file:/+", "/").alias("absolute_path"), F.col("modificationTime").alias("file_modified_at"), F.col("length").alias("size"), "content")
    return described(rows.filter(~hidden(F.expr(f"substr(absolute_path, {len(directory.rstrip('/')) + 1})"))))


def into_catalog(files: DataFrame, table: Catalog, checkpoint: str, available_now: bool = True, seen: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Each batch (of documents, or of files with their content) is ingested by content hash, so a batch that is run again after a failure changes nothing.

    seen(batch, records) is called after each batch.
    """

    def batch(rows: DataFrame, number: int) -> None:
        n = ingest(table, rows if "absolute_path" in rows.columns else files_of_documents(rows))
        if seen:
            seen(number, n)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def reconciled(table: Catalog, directory: str) -> int:
    """Deletes the records of files that are gone from the directory, which streams can't see. Returns their number."""
    return table.keep_only(scan_all(table.spark, directory))


def drained(query: StreamingQuery, seconds: float | None = None) -> bool:
    """Lets a query take in what is there, then stops it. Whether it ended by itself within the time, if one is given."""
    if seconds is None:
        query.processAllAvailable()
        query.stop()
        return True
    ended = query.awaitTermination(seconds)
    if not ended:
        query.stop()
    return bool(ended)


class Progress(StreamingQueryListener):
    """Passes the progress of streams on: told(kind, details), kind being started, progress or terminated."""

    def __init__(self, told: Callable[[str, dict], None]):
        self.told = told

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.told("started", {"id": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.told("progress", {"id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.told("terminated", {"id": str(event.id), "error": event.exception})


def debounced(events: DataFrame, key: str = "user_id", ts: str = "ts", kind: str = "event_type", gap: str = "0.5") -> DataFrame:
    """Batch: the events of a key that follow each other within ``gap`` seconds become one, at its last time and with its last type."""
    w = Window.partitionBy(key).orderBy(ts, kind)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    new = F.when(micros(F.col(ts)) - micros(F.lag(ts).over(w)) <= int(float(gap) * 1_000_000), 0).otherwise(1)
    rows = events.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w))
    return rows.groupBy(key, "_s").agg(F.max(F.struct(ts, kind)).alias("_l"), F.count("*").alias("n_events")).select(key, F.col(f"_l.{ts}").alias(ts), F.col(f"_l.{kind}").alias(kind), "n_events")


def debounced_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", kind: str = "event_type", gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The same over a stream: session windows under a watermark."""
    s = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.max(F.struct(ts, kind)).alias("l"), F.count("*").alias("n_events"))
    return s.select(key, F.col(f"l.{ts}").alias(ts), F.col(f"l.{kind}").alias(kind), "n_events")
