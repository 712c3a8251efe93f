"""Operator 8: repeated substrings by difference-cover anchors.

A difference cover D of a period v has, for any two positions i and j, a shift s < v with (i + s) mod v and
(j + s) mod v both in D. So two equal passages of MIN_WORDS words hold, at one and the same offset below v,
a pair of cover positions, and the ANCHOR words from there lie inside both. Only windows at cover positions
are hashed and shuffled (6 of 31). Anchors that occur once are dropped; from each other one the match
extends to both sides: every window of MIN_WORDS words that holds it at an offset below v is compared by
hash over the corpus. No window of a repeat is missed, and no pairs are formed, so a passage that n
documents share costs n rows, not n * n. Before anything is cut, the words of each repeat are compared with those of
its first place: consecutive repeats of consecutive first places are one run, which goes to the document of its first
places, takes the words there, and comes back. So equal hashes of other words cut nothing (of a class that mixes
two texts in that way, the repeats of the one that isn't first stay).

Defined cases: see repeats.py.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .repeats import MIN_WORDS, cut_text, keyed, later, named, repeated, spans, with_positions
from .text import Prefix, distinct, hashes_of, mix, ranges, rows_of, slices, words_of

#: Perfect difference sets: every difference modulo the period exactly once.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
PERIOD = 31
#: Anchors only choose what is compared, so a few that share these bits cost a little and change nothing.
FILTER_BITS = 48
#: In this order neighbouring rows of one document share their first bytes, which halves the shuffle's size.
PLACES = "k_id long, at long, h long"


def _places(batch: pa.RecordBatch, h: np.ndarray, row: np.ndarray, pos: np.ndarray, bits: int = 64) -> pa.RecordBatch:
    k_id, k_text = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("k_id", "k_text"))
    at = (pos.astype(np.int64) << 32) | (k_text.view(np.uint32).astype(np.int64)[row])
    return pa.RecordBatch.from_arrays([pa.array(k_id[row]), pa.array(at), pa.array((mix(h) >> np.uint64(64 - bits)).view(np.int64))], names=["k_id", "at", "h"])


def anchors(docs: DataFrame, min_words: int = MIN_WORDS, period: int = PERIOD) -> DataFrame:
    """The hash of the words from each cover position."""
    cover, width = np.asarray(COVERS[period]), min_words - period + 1
    if width < 1:
        raise ValueError("the period must not exceed min_words")

    def run(batches):
        for batch in slices(batches):
            words, offsets = words_of(batch.column(batch.schema.get_field_index("text")))
            n = np.diff(offsets)
            row = rows_of(offsets)
            pos = np.arange(len(words)) - offsets[row]
            at = np.flatnonzero(np.isin(np.arange(period), cover)[pos % period] & (pos + width <= n[row]) & (n[row] >= min_words))
            yield _places(batch, Prefix(hashes_of(words))(at, width), row[at], pos[at], FILTER_BITS)

    return docs.mapInArrow(run, PLACES)


def extended(found: DataFrame, min_words: int = MIN_WORDS, period: int = PERIOD) -> DataFrame:
    """The hash of each window that holds a repeated anchor (its position is in ``at``) below the period."""

    def run(batches):
        for batch in slices(batches):
            words, offsets = words_of(batch.column(batch.schema.get_field_index("text")))
            lists = batch.column(batch.schema.get_field_index("at"))
            at = lists.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            first = np.maximum(at - period + 1, 0)
            first[1:] = np.where(row[1:] == row[:-1], np.maximum(first[1:], at[:-1] + 1), first[1:])  # each window once
            last = np.minimum(at, np.diff(offsets)[row] - min_words)
            pos, which = ranges(first, last + 1)
            row = row[which]
            yield _places(batch, Prefix(hashes_of(words))(offsets[row] + pos, min_words), row, pos)

    return found.mapInArrow(run, PLACES)


ASKED = 1024
RUN = ["k_id", "k_text", "f_id", "f_text", "p", "q", "n"]


def runs(repeats: DataFrame) -> DataFrame:
    """RUN: the places that repeat consecutive first places, as runs of n windows; p is where they begin, q where the first ones do.

    The places of a document are gathered as arrays, no longer than it, partly before the shuffle.
    """
    text = lambda c: F.expr(f"cast(shiftright(shiftleft({c}, 32), 32) AS int)")
    pos = lambda c: F.expr(f"cast(shiftright({c}, 32) AS int)")
    rows = repeats.select("k_id", text("at").alias("k_text"), F.col("lo.k_id").alias("f_id"), text("lo.at").alias("f_text"), pos("at").alias("p"), (pos("at") - pos("lo.at")).alias("d"))
    lists = rows.groupBy("k_id", "k_text").agg(*(F.collect_list(c).alias(c) for c in ("f_id", "f_text", "d", "p")))  # without nulls, so they stay aligned; d is the same throughout a run, so it packs well

    def run(batches):
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lengths)
            f_id, f_text, d, p = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in range(2, 6))
            order = np.lexsort((p, d, f_text, f_id, row))
            row, f_id, f_text, d, p = (x[order] for x in (row, f_id, f_text, d, p))
            q = p - d
            fresh = np.ones(len(row), bool)
            fresh[1:] = (np.diff(row) != 0) | (np.diff(f_id) != 0) | (np.diff(f_text) != 0) | (np.diff(p) != 1) | (np.diff(q) != 1)
            first = np.flatnonzero(fresh)
            n = np.diff(np.append(first, len(row)))
            take = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(f_id[first]), *(pa.array(x.astype(np.int32)) for x in (f_text[first], p[first], q[first], n))], names=RUN)

    return lists.mapInArrow(run, "k_id long, k_text int, f_id long, f_text int, p int, q int, n int")


def with_first_words(docs: DataFrame, repeats: DataFrame, min_words: int) -> DataFrame:
    """p_id, p_text, run (p, n, words): each run with the words of its first places, read from their document.

    Up to ASKED runs are sent to a document in one row, so a passage of many copies has its first document read again for
    each ASKED of them, and no row grows with the copies. The plan reads repeats once.
    """
    nth = F.row_number().over(Window.partitionBy("f_id", "f_text").orderBy("k_id", "k_text", "p"))
    asked = runs(repeats).withColumn("chunk", F.floor((nth - 1) / ASKED))
    asked = asked.groupBy("f_id", "f_text", "chunk").agg(F.collect_list(F.struct("q", "n", "k_id", "k_text", "p")).alias("asked"))
    # with all columns, so that the texts' shuffle is the one of the other joins
    held = docs.join(asked, (docs["k_id"] == asked["f_id"]) & (docs["k_text"] == asked["f_text"]))

    def run(batches):
        for batch in slices(batches):
            words, offsets = words_of(batch.column(batch.schema.get_field_index("text")))
            lists = batch.column(batch.schema.get_field_index("asked"))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            q, n, k_id, k_text, p = (lists.flatten().field(i) for i in range(5))
            begin, length = offsets[row] + q.to_numpy(), n.to_numpy() + min_words - 1
            for a in range(0, len(row), ASKED):  # the words of so many runs at a time
                index, _ = ranges(begin[a : a + ASKED], begin[a : a + ASKED] + length[a : a + ASKED])
                edges = pa.array(np.concatenate([[0], np.cumsum(length[a : a + ASKED])]).astype(np.int32))
                text = pc.binary_join(pa.ListArray.from_arrays(edges, words.take(pa.array(index))), " ")
                yield pa.RecordBatch.from_arrays([k_id.slice(a, ASKED), k_text.slice(a, ASKED), p.slice(a, ASKED), n.slice(a, ASKED), text], names=["p_id", "p_text", "p", "n", "words"])

    rows = held.mapInArrow(run, "p_id long, p_text int, p int, n int, words string")
    return rows.select("p_id", "p_text", F.struct("p", "n", "words").alias("run"))


def equal_places(words: pa.Array, begin: np.ndarray, n: np.ndarray, first: pa.Array, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of n windows that begin at these words the windows that are equal to the first ones (a run's words each): run, offset."""
    length = n + min_words - 1
    index, _ = ranges(begin, begin + length)
    edges = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
    mine = pc.binary_join(pa.ListArray.from_arrays(edges, words.take(pa.array(index))), " ")
    same = pc.equal(mine, first).to_numpy(zero_copy_only=False)
    k, run = ranges(np.zeros(len(n), np.int64), np.where(same, n, 0))
    for i in np.flatnonzero(~same):  # equal hashes of other words: only the windows that are equal
        a, b = mine[int(i)].as_py().split(" "), first[int(i)].as_py().split(" ")
        good = [j for j in range(int(n[i])) if a[j : j + min_words] == b[j : j + min_words]]
        k, run = np.append(k, np.array(good, np.int64)), np.append(run, np.full(len(good), i))
    return run.astype(np.int64), k.astype(np.int64)


def cut_where_equal(docs: DataFrame, repeats: DataFrame, min_words: int) -> DataFrame:
    """docs without the words of the windows whose words are those of their first place, and removed_words."""
    lists = with_first_words(docs, repeats, min_words).groupBy("p_id", "p_text").agg(F.collect_list("run").alias("runs"))
    rows = docs.join(lists, (docs["k_id"] == lists["p_id"]) & (docs["k_text"] == lists["p_text"]), "left").drop("p_id", "p_text")
    schema = rows.drop("runs").withColumn("removed_words", F.lit(0)).schema

    def run(batches):
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            text = batch.column(at)
            words, offsets = words_of(text)
            lists = batch.column(batch.schema.get_field_index("runs"))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            p, n, first = (lists.flatten().field(i) for i in range(3))
            p = p.to_numpy().astype(np.int64)
            which, k = equal_places(words, offsets[row] + p, n.to_numpy().astype(np.int64), first, min_words)
            (row, pos), _, _ = distinct(row[which], p[which] + k)
            cuts, out, removed = np.searchsorted(row, np.arange(batch.num_rows + 1)), text.to_pylist(), np.zeros(batch.num_rows, np.int32)
            for i in np.flatnonzero(np.diff(cuts)):
                s, e = spans(pos[cuts[i] : cuts[i + 1]], min_words)
                out[i], removed[i] = cut_text(out[i], s, e), int((e - s).sum())
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)} | {"text": pa.array(out, pa.string()), "removed_words": pa.array(removed)}
            yield pa.RecordBatch.from_arrays([columns[c] for c in schema.names], names=schema.names)

    same = rows.filter("runs IS NULL").drop("runs").withColumn("removed_words", F.lit(0))
    return same.unionByName(rows.filter("runs IS NOT NULL").mapInArrow(run, schema))


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, period: int = PERIOD) -> DataFrame:
    """docs with the repeats cut from text, and a last column removed_words: a row for each row of docs."""
    keys = keyed(docs)
    found = with_positions(keys, repeated(anchors(keys, min_words, period), "h"), "inner")
    repeats = later(extended(found, min_words, period), "h")
    return named(cut_where_equal(keys, repeats, min_words), docs)
