"""What the operators on repeated passages share: document keys, candidate documents, and the cut.

Semantics (both operators, and the SQL of their queries): a window is MIN_WORDS consecutive words of one
document. Of all equal windows the first, by (doc_id, position, text hash), stays; every other one is a
repeat, and the words of all repeats are cut, each with the white space behind it. A passage that repeats
within one document is cut there too; what remains of a periodic text is one period.

Defined cases: null text has no words and stays null; documents with a null doc_id are told apart by their
text, whose hash stands for the id in the order; rows
that agree in doc_id and text are one document given twice: they aren't repeats of each other and get the
same result; documents of under MIN_WORDS words never change; other columns are passed on untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import PIECE, slices

MIN_WORDS = 50
KEY = ("k_id", "k_text")


def keyed(docs: DataFrame) -> DataFrame:
    """The key of each document, its text, and its other columns by number (so that no name clashes).

    The key is (k_id, k_text): doc_id (the text's 64-bit hash where that is null) and a 32-bit hash of the
    text, which tells texts of one doc_id apart. It travels with each place of a document, so it is small.
    """
    others = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    return docs.select(*others, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("k_id"), F.hash("text").alias("k_text"), "text")


def named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs under their names again, and removed_words at the end."""
    return rows.select(*(F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)), F.col("removed_words"))


def place() -> Column:
    """A place of a document, in order: ``at`` has the position above and k_text in the lower 32 bits."""
    return F.struct("k_id", "at")


def repeated(occurrences: DataFrame, key: str) -> DataFrame:
    """The occurrences (key, k_id, at) whose key stands at two places at least.

    A window over the key: one shuffle, and a key of any number of occurrences streams from disk.
    """
    w = Window.partitionBy(key)
    return (
        occurrences.repartition(key)  # before the window: else its argument is shuffled along
        .withColumn("lo", F.min(place()).over(w))
        .withColumn("hi", F.max(place()).over(w))
        .filter(F.col("lo") != F.col("hi"))
        .drop("lo", "hi")
    )


def later(occurrences: DataFrame, key: str) -> DataFrame:
    """All occurrences but the first of each key, which is ``lo``."""
    w = Window.partitionBy(key)
    return occurrences.repartition(key).withColumn("lo", F.min(place()).over(w)).filter(place() != F.col("lo"))


def with_positions(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Each document with the sorted array ``at`` of its positions; the array is no longer than the document."""
    split = places.select(F.col("k_id").alias("p_id"), F.expr("cast(shiftright(shiftleft(at, 32), 32) AS int)").alias("p_text"), F.expr("cast(shiftright(at, 32) AS int)").alias("pos"))
    at = split.groupBy("p_id", "p_text").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    return docs.join(at, (docs["k_id"] == at["p_id"]) & (docs["k_text"] == at["p_text"]), how).drop("p_id", "p_text")


def spans(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of the windows at these sorted positions, as disjoint half-open ranges of words."""
    if not len(at):
        return at, at
    breaks = np.flatnonzero(np.diff(at) > length)
    return at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])] + length


def cut_text(text: str, starts: np.ndarray, ends: np.ndarray) -> str:
    """The text without these ranges of words."""
    edges = [m.start() for m in PIECE.finditer(text)] + [len(text)]
    kept, at = [], 0
    for s, e in zip(starts, ends):
        kept.append(text[at : edges[s]])
        at = edges[e]
    return "".join(kept) + text[at:]


def cut(found: DataFrame, min_words: int) -> DataFrame:
    """found: text and ``at`` (null: nothing to cut) and what else is passed on. Adds removed_words."""
    schema = found.drop("at").withColumn("removed_words", F.lit(0)).schema

    def run(batches):
        for batch in slices(batches):
            t = batch.column(batch.schema.get_field_index("text")).to_pylist()
            removed = np.zeros(len(t), np.int32)
            for i, at in enumerate(batch.column(batch.schema.get_field_index("at")).to_pylist()):
                if at:
                    s, e = spans(np.asarray(at, np.int64), min_words)
                    t[i], removed[i] = cut_text(t[i], s, e), int((e - s).sum())
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != "at"}
            columns |= {"text": pa.array(t, pa.string()), "removed_words": pa.array(removed)}
            yield pa.RecordBatch.from_arrays([columns[n] for n in schema.names], names=schema.names)

    same = found.filter("at IS NULL").drop("at").withColumn("removed_words", F.lit(0))
    return same.unionByName(found.filter("at IS NOT NULL").mapInArrow(run, schema))


def what_is_left(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The documents of which something is left, with n_chars (if there is such a column) as it is now."""
    last = rows.toDF(*(f"c{i}" for i in range(len(columns))), "removed")
    text = f"c{columns.index('text')}"
    kept = last.filter((F.col("removed") == 0) | (F.btrim(text, F.lit(" \t\n\r\f\x0b")) != ""))
    size = lambda i: F.when(F.col("removed") == 0, F.col(f"c{i}")).otherwise(F.length(text)).cast(last.schema[i].dataType)
    return kept.select(*((size(i) if c == "n_chars" else F.col(f"c{i}")).alias(c) for i, c in enumerate(columns)))
