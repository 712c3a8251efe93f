"""Operator 2: repeated passages by a suffix sort with hashed comparisons.

The suffixes that can begin a repeat are sorted in buckets. A bucket holds the window starts whose window of
MIN_WORDS words has the same minimiser (the least hash of GRAM consecutive words in it, the leftmost of
equals): equal windows have equal minimisers, so equal suffixes always meet, and buckets of a single place,
most of the corpus, are dropped before any text moves. The rest goes to its buckets as strips: runs of
neighbouring starts with one minimiser, cut from their document together.

Within a partition a bottom-up mergesort orders the suffixes of all buckets at once. Two suffixes are
compared through prefix polynomial hashes: a binary search over the length finds their common extension in
log2(MIN_WORDS) probes, and the next words' hashes decide. Neighbours that agree on MIN_WORDS words are then
compared word by word (collision verification), and each run of equal suffixes is a class of repeats. The
order is by word hash rather than by alphabet, which places equals together as well. Identical strips, as
thousands of copies of a passage give, are sorted once, and partitions are worked off in chunks of whole
buckets, so memory follows the distinct strips of one chunk.

Defined cases: see repeats.py.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .repeats import MIN_WORDS, cut, keyed, named, repeated, with_positions
from .substring_dedup import PLACES, _places
from .text import Prefix, distinct, hashes_of, mix, ranges, rows_of, slices, words_of

GRAM = 8


def minimisers(hashes: np.ndarray, offsets: np.ndarray, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window start (in the flat words, given by their hashes), the flat position of its minimiser, and the hash of each gram."""
    n, total = np.diff(offsets), len(hashes)
    row = rows_of(offsets)
    pos = np.arange(total) - offsets[row]
    starts = np.flatnonzero(pos + min_words <= n[row])
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    prefix = Prefix(hashes)
    h = np.full(total, np.uint64(0xFFFFFFFFFFFFFFFF))
    whole = np.arange(total - gram + 1)
    h[: total - gram + 1] = mix(prefix(whole, gram))
    least, at, width = h.copy(), np.arange(total), 1  # sparse table: the leftmost minimum over a power of two
    need = min_words - gram + 1
    while width * 2 <= need:
        right = slice(width, None)
        better = least[right] < least[: total - width]
        low = np.where(better, least[right], least[: total - width])
        where = np.where(better, at[right], at[: total - width])
        least, at, width = np.concatenate([low, least[total - width :]]), np.concatenate([where, at[total - width :]]), width * 2
    second = starts + need - width
    return starts, np.where(least[second] < least[starts], at[second], at[starts]), h


def sampled(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    """The minimisers of all windows, each place once."""

    def run(batches):
        for batch in slices(batches):
            words, offsets = words_of(batch.column(batch.schema.get_field_index("text")))
            starts, at, h = minimisers(hashes_of(words), offsets, min_words, gram)
            first = np.flatnonzero(np.diff(at, prepend=-1) != 0)
            at = at[first]
            row = np.searchsorted(offsets, at, side="right") - 1
            yield _places(batch, h[at], row, at - offsets[row])

    return docs.mapInArrow(run, PLACES)


STRIPS = "k_id long, at long, h long, ahead int, starts int, words string"
CHUNK_BYTES = 8 << 20


def strips(found: DataFrame, min_words: int, gram: int) -> DataFrame:
    """The runs of window starts with one repeated minimiser, with their words, joined by spaces."""

    def run(batches):
        for batch in slices(batches):
            words, offsets = words_of(batch.column(batch.schema.get_field_index("text")))
            lists = batch.column(batch.schema.get_field_index("at"))
            wanted = np.zeros(len(words) + 1, bool)
            wanted[offsets[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())] + lists.flatten().to_numpy()] = True
            starts, at, h = minimisers(hashes_of(words), offsets, min_words, gram)
            if not len(starts):
                continue
            first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
            count = np.diff(np.append(first, len(starts)))
            first, count = first[wanted[at[first]]], count[wanted[at[first]]]
            begin = starts[first]
            index, _ = ranges(begin, begin + count + min_words - 1)
            edges = np.concatenate([[0], np.cumsum(count + min_words - 1)]).astype(np.int32)
            text = pa.ListArray.from_arrays(pa.array(edges), words.take(pa.array(index)))
            row = np.searchsorted(offsets, begin, side="right") - 1
            out = _places(batch, h[at[first]], row, begin - offsets[row])
            ahead = pa.array((at[first] - begin).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*out.columns, ahead, pa.array(count.astype(np.int32)), pc.binary_join(text, " ")], names=["k_id", "at", "h", "ahead", "starts", "words"])

    return found.mapInArrow(run, STRIPS)


class Suffixes:
    """Suffixes of a token array, compared over at most ``depth`` tokens."""

    def __init__(self, tokens: np.ndarray, depth: int):
        self.tokens, self.depth, self.hash = tokens, depth, Prefix(tokens)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the common extension, by binary search on the hashes."""
        low = np.where(self.hash(a, self.depth) == self.hash(b, self.depth), self.depth, 0)
        open_ = np.flatnonzero(low == 0)
        a, b = a[open_], b[open_]
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.depth)  # lo agree, hi don't
        while len(a) and (hi - lo).max() > 1:
            mid = (lo + hi) // 2
            same = self.hash(a, mid) == self.hash(b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid)
        low[open_] = lo
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix a sorts before b; ``ties`` is the answer for equals."""
        n = self.common(a, b)
        same = n == self.depth
        n = np.where(same, 0, n)
        return np.where(same, ties, self.tokens[a + n] < self.tokens[b + n])

    def sort(self, bucket: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """at, sorted within each bucket, by a bottom-up mergesort of all buckets together.

        Each element finds its rank in the partner run by binary search; the merge is then a scatter.
        """
        order = np.argsort(bucket, kind="stable")
        bucket, at = bucket[order], at[order]
        first = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1 if len(bucket) else 0) != 0)
        size = np.diff(np.append(first, len(at)))
        width = 1
        while len(size) and width < size.max():
            live = np.flatnonzero(np.repeat(size > width, size))
            base = np.repeat(first, size)[live]
            end = base + np.repeat(size, size)[live]
            k = live - base
            run = k // width
            left = run % 2 == 0
            mate = base + np.where(left, run + 1, run - 1) * width
            lo, hi = np.minimum(mate, end), np.minimum(mate + width, end)
            start = lo.copy()
            act = np.flatnonzero(lo < hi)
            while len(act):
                mid = (lo[act] + hi[act]) // 2
                # an element of the left run goes before its equals on the right
                other_first = self.before(at[mid], at[live[act]], ties=False)
                other_first |= ~left[act] & ~other_first & ~self.before(at[live[act]], at[mid], ties=False)
                lo[act] = np.where(other_first, mid + 1, lo[act])
                hi[act] = np.where(other_first, hi[act], mid)
                act = act[lo[act] < hi[act]]
            target = base + (run // 2) * 2 * width + (k - run * width) + (lo - start)
            merged = at.copy()
            merged[target] = at[live]
            at, width = merged, width * 2
        return bucket, at


def _later(table: pa.Table, min_words: int) -> pa.RecordBatch | None:
    """The places of the table's window starts that aren't the first of their class of equal suffixes."""
    table = table.combine_chunks()
    if not table.num_rows:
        return None
    text = table.column("words").combine_chunks()
    h, ahead, starts, k_id, place = (table.column(c).to_numpy() for c in ("h", "ahead", "starts", "k_id", "at"))
    strip = text.indices.to_numpy().astype(np.int64)
    # a strip is a minimiser, how far it is ahead, and words
    own, first, strip = distinct(strip, h, ahead.astype(np.int64))
    words, offsets = words_of(text.dictionary.take(pa.array(own[0])))
    at, of = ranges(offsets[:-1], offsets[:-1] + starts[first])
    begin = np.cumsum(starts[first]) - starts[first]  # of each strip in at
    _, _, bucket = distinct(own[1][of], own[2][of] - (at - offsets[of]))
    suffixes = Suffixes(hashes_of(words), min_words)
    bucket, order = suffixes.sort(bucket, at)
    near = np.flatnonzero(bucket[1:] == bucket[:-1])
    near = near[suffixes.common(order[near], order[near + 1]) >= min_words]
    true = np.ones(len(near), bool)
    codes = words.dictionary_encode().indices.to_numpy()
    for k in range(min_words):  # collision verification: the words themselves, coded
        true &= codes[order[near] + k] == codes[order[near + 1] + k]
    fresh = np.ones(len(order), bool)
    fresh[near[true] + 1] = False
    class_of = np.empty(len(at), np.int64)
    class_of[np.searchsorted(at, order)] = np.cumsum(fresh) - 1
    # back to places: every row of the table has the suffixes of its strip
    k, row = ranges(begin[strip], begin[strip] + starts)
    group = class_of[k]
    where = place[row] + ((k - begin[strip][row]) << 32)
    by = np.lexsort((where, k_id[row], group))  # the first of each class comes first
    first_of = by[np.flatnonzero(np.diff(group[by], prepend=-1) != 0)]  # classes count from 0
    first_id, first_at = k_id[row[first_of]], where[first_of]
    keep = np.flatnonzero((k_id[row] != first_id[group]) | (where != first_at[group]))
    at_row = row[keep]
    return pa.RecordBatch.from_arrays([pa.array(k_id[at_row]), pa.array(where[keep]), pa.array(h[at_row])], names=["k_id", "at", "h"])


def _held(batches: list[pa.RecordBatch]) -> pa.Table:
    """One table, in which equal strips share their words."""
    return pa.Table.from_batches(batches).unify_dictionaries().combine_chunks()


def _compact(table: pa.Table) -> pa.Table:
    """The same rows, without the words of strips that aren't in them."""
    k = table.schema.get_field_index("words")
    words = table.column(k).combine_chunks()
    used, index = np.unique(words.indices.to_numpy(), return_inverse=True)
    return table.set_column(k, "words", pa.DictionaryArray.from_arrays(pa.array(index.astype(np.int32)), words.dictionary.take(pa.array(used))))


def sorted_classes(text: DataFrame, min_words: int) -> DataFrame:
    """The window starts of the strips that repeat an earlier one; strips come sorted by minimiser.

    Of a bucket, each distinct strip is held once, and of each place of it a row of numbers.
    """

    def run(batches):
        held, size, limit = [], 0, CHUNK_BYTES
        for batch in slices(batches, "words"):
            k = batch.schema.get_field_index("words")
            held.append(pa.RecordBatch.from_arrays([c.dictionary_encode() if i == k else c for i, c in enumerate(batch.columns)], names=batch.schema.names))
            size += held[-1].nbytes
            if size >= limit:
                table = _held(held)
                h = table.column("h").to_numpy()
                whole = int(np.searchsorted(h, h[-1]))  # the last bucket may go on
                if whole and (out := _later(table.slice(0, whole), min_words)) is not None:
                    yield out
                held = _compact(table.slice(whole)).to_batches()
                size = sum(x.nbytes for x in held)
                limit = max(CHUNK_BYTES, 2 * size)  # a bucket is merged again only when it has doubled
        if held and (out := _later(_held(held), min_words)) is not None:
            yield out

    return text.repartition("h").sortWithinPartitions("h").mapInArrow(run, PLACES)


def suffix_dedup(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """docs with the repeats cut from text, and a last column removed_words: a row for each row of docs."""
    keys = keyed(docs)
    found = with_positions(keys, repeated(sampled(keys, min_words, gram), "h"), "inner")
    repeats = sorted_classes(strips(found, min_words, gram), min_words)
    return named(cut(with_positions(keys, repeats, "left"), min_words), docs)
