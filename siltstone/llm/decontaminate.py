"""Operator 3: documents that hold benchmark passages, by suffix arrays over the training text.

Each shard of documents (a slice of a scan task, so no text is shuffled) gets a suffix array: words are coded
by their place in the benchmark's vocabulary, and the suffixes whose first MIN_WORDS words are all in it are
ordered by the polynomial hash of these words, which brings equals together; every benchmark suffix is
binary-searched in that order. So only suffixes that agree on MIN_WORDS words are paired, however common their
first words are. Each hit is verified word by word and extended to its full length, so lengths are exact.
Suffixes that hold another word among their first ones can't match and aren't sorted.

A document is contaminated if it shares MIN_WORDS consecutive words with an item, or holds the whole of an item
that is shorter than that (for these, suffixes are ordered to the item's length, once for each such length).
``short_item`` is the least length of such items; it is 1 by default, so no item is dropped: raise it if the
benchmark holds items of a word or two, which almost any text contains. Words are compared verbatim.

The benchmark goes to the tasks in chunks of at most CHUNK_BYTES of text, by hash of the item; its size is
measured first. One chunk is the usual case; a larger benchmark takes one scan of the documents for each chunk.

Defined cases: null or blank texts match nothing; null ids are passed on as null; items given twice count
once, texts that share an item_id each for themselves; documents given twice give their rows twice; a tie goes
to the earliest place in the document, then in the item; an empty benchmark removes nothing; other columns are
passed on, or don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Prefix, mix, ranges, rows_of, slices, words_of

MIN_WORDS = 13
SHORT_ITEM = 1
CHUNK_BYTES = 16 << 20


def _hashes(codes: np.ndarray) -> Prefix:
    return Prefix(mix(codes.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


class Items:
    """A benchmark chunk: coded words of all items, one separator behind each, and by depth the suffixes to search for."""

    def __init__(self, texts: list[str | None], min_words: int = MIN_WORDS, short: int = SHORT_ITEM):
        self.min_words = min_words
        words, offsets = words_of(pa.array(texts, pa.string()))
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        row = rows_of(offsets)
        self.length = np.diff(offsets)
        self.codes = np.full(len(words) + len(texts) + 1, -1, np.int64)
        self.codes[np.arange(len(words)) + row] = coded.indices.to_numpy() + 1
        self.begin = offsets[:-1] + np.arange(len(texts))
        hashes = _hashes(self.codes)
        start = np.flatnonzero(offsets[1:][row] - np.arange(len(words)) >= min_words)
        searched = [(min_words, start + row[start], row[start])]
        for n in np.unique(self.length):
            if max(short, 1) <= n < min_words:
                item = np.flatnonzero(self.length == n)
                searched.append((int(n), self.begin[item], item))
        #: depth, places, items and hashes
        self.searched = [(n, at, item, hashes(at, n)) for n, at, item in searched if len(at)]


def matches(text: pa.Array, items: Items) -> tuple[np.ndarray, ...]:
    """The longest qualifying match of each row and item: row, item, words, place in the row, place in the item."""
    words, offsets = words_of(text)
    none = (np.zeros(0, np.int64),) * 5
    if not len(words) or not items.searched:
        return none
    coded = words.dictionary_encode()
    known = pc.fill_null(pc.add(pc.index_in(coded.dictionary, value_set=items.vocabulary), 1), 0).to_numpy().astype(np.int64)
    codes = np.zeros(len(words) + len(text) + 1, np.int64)  # 0: another word, or a document's end
    codes[np.arange(len(words)) + rows_of(offsets)] = known[coded.indices.to_numpy()]
    end = np.where(codes == 0, np.arange(len(codes)), len(codes))
    room = np.minimum.accumulate(end[::-1])[::-1] - np.arange(len(codes))  # known words from here on
    hashes = _hashes(codes)
    found = []
    for depth, place, item, key in items.searched:
        at = np.flatnonzero(room >= depth)
        own = hashes(at, depth)
        order = np.argsort(own, kind="stable")  # the suffix array, to this depth
        own, at = own[order], at[order]
        hit, which = ranges(np.searchsorted(own, key, "left"), np.searchsorted(own, key, "right"))
        a, b, item = at[hit], place[which], item[which]
        if depth == items.min_words:  # a match that can't begin earlier
            whole = (a == 0) | (b == 0) | (codes[a - 1] != items.codes[b - 1])
            a, b, item = a[whole], b[whole], item[whole]
        same = np.ones(len(a), bool)
        for k in range(depth):  # collision verification
            same &= codes[a + k] == items.codes[b + k]
        a, b, item = a[same], b[same], item[same]
        n = np.full(len(a), depth)
        on = np.arange(len(a)) if depth == items.min_words else a[:0]
        while len(on):
            on = on[codes[np.minimum(a[on] + n[on], len(codes) - 1)] == items.codes[b[on] + n[on]]]
            n[on] += 1
        found.append((a, b, n, item))
    a, b, n, item = map(np.concatenate, zip(*found))
    if not len(a):
        return none
    begin = offsets[:-1] + np.arange(len(text))
    found = np.searchsorted(begin, a, side="right") - 1
    place, item_place = a - begin[found], b - items.begin[item]
    best = np.lexsort((item_place, place, -n, item, found))
    first = best[np.flatnonzero((np.diff(found[best], prepend=-1) != 0) | (np.diff(item[best], prepend=-1) != 0))]
    return found[first], item[first], n[first], place[first], item_place[first]


def chunks(benchmark: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """The items, a bounded chunk at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(size / chunk_bytes))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect() if size else []
        yield [r[0] for r in rows], [r[1] for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, chunk_bytes: int = CHUNK_BYTES, short_item: int = SHORT_ITEM) -> DataFrame:
    """doc_id, item_id, match_words, doc_word, item_word: the longest match of each contaminated document and item."""
    schema = "doc_id long, item_id long, match_words int, doc_word int, item_word int"
    slim, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for ids, texts in chunks(benchmark, chunk_bytes):
        held = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches, held=held):
            ids, texts = held.value
            items = Items(texts, min_words, short_item)
            names = pa.array(ids, pa.int64())
            for batch in slices(batches):
                row, item, *rest = matches(batch.column(1), items)
                columns = [batch.column(0).take(pa.array(row)), names.take(pa.array(item)), *(pa.array(x.astype(np.int32)) for x in rest)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "match_words", "doc_word", "item_word"])

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, chunk_bytes: int = CHUNK_BYTES, short_item: int = SHORT_ITEM) -> DataFrame:
    """docs without the contaminated ones, in place: no shuffle, all columns as they are."""
    for _, texts in chunks(benchmark, chunk_bytes):
        held = docs.sparkSession.sparkContext.broadcast(texts)

        def run(batches, held=held):
            items = Items(held.value, min_words, short_item)
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[matches(batch.column(batch.schema.get_field_index("text")), items)[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
