"""Operator 7: language-model scores by Katz backoff over words, order 3.

The documents are scored by the model of them all. Tokens are words (see text.py), as 64-bit hashes. All words,
bigrams and trigrams of all documents are counted. With r the count of an n-gram (h, w) and c(h) the sum over w,

    P(w | h) = d(r) r / c(h)            if r reaches the least count of the order
             = a(h) P(w | h')           otherwise, h' being h without its first token,

where d is the Good-Turing discount, from the counts of counts of the order up to K (where these don't give a
discount between 0 and 1, it is (r - 1/2) / r), and a(h) is what normalises exactly: the probability left over in h,
divided by the lower order's probability of all tokens not kept in h. A context without discounted or dropped counts
gives 1 / (c(h) + 1) of its probability to the rest. ``least`` is the least count of a trigram (LEAST = 2): those
seen once back off to the bigram, which is always there, as every scored document is counted; so a document doesn't
vouch for its own rarities. least = 1 keeps them with their discount d(1). The lowest order, for the first word of a
document, is (count + 1) / (words + distinct words + 1): one count is left for words that aren't there. Everything is
evaluated in doubles.

All that P(y | x, m) needs stands around the middle word m: the counts of (x, m, y), (x, m) and (m, y). So each place
of each document goes, with its neighbours and its document, to the bucket of its word; a bucket counts, and once the
counts of counts of all buckets are added up, it evaluates its places. GROUP buckets are worked off one after another
by one task, which gives out a sum for each document. The places are shuffled once, packed: the places of a slice of documents for a bucket stand together, sorted by word, so a
word is named once for all its places; the neighbours are numbers in the table of the FREQUENT commonest words of the
corpus, others are spelled out as hashes (an encoding, without any effect on the scores); and documents are
numbers within their slice, whose ids and lengths travel once. Neither texts nor n-grams are shuffled. The places
of a word with more than HOT of them are spread by x over several buckets; the counts of its (m, y) are added up
before and sent to these.

``docs`` must give the same rows in the same order when a task is repeated, as the scan of a table does.

Defined cases: null texts and texts without words have null scores, and n_bytes 0 if null or empty; documents
given twice count twice and are scored twice; a null doc_id is passed on; an empty table gives no rows; other columns
don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .text import BASE, Reader, compressed, distinct, mix, planes, release, rows_of, slices, words_of

ORDER = 3
K = 5
LEAST = 2
HOT = 500_000
BUCKET_BYTES = 4 << 20
GROUP = 4
SLICE = 4 << 20
HELD = 1_000_000
NONE = 0
LONG = 64
FREQUENT = 65_534
SPELLED = 65_535


def discounts(of_counts: dict[tuple[int, int], int], order: int) -> dict[tuple[int, int], float]:
    """d by (n, r) for r up to K; 1 beyond. of_counts: how many n-grams of order n have count r."""
    out = {}
    for n in range(2, order + 1):
        m = [0] + [of_counts.get((n, r), 0) for r in range(1, K + 2)]
        cut = (K + 1) * m[K + 1] / m[1] if m[1] else 1.0
        for r in range(1, K + 1):
            d = ((r + 1) * m[r + 1] / (r * m[r]) - cut) / (1 - cut) if m[r] and cut < 1 else 0.0
            out[n, r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes after the other are mixed in, for all words at once; words longer than LONG bytes by xxHash."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_binary())
    starts = np.frombuffer(words.buffers()[1], np.int64, n + 1, words.offset * 8)
    size = np.diff(starts)
    data = np.frombuffer(words.buffers()[2], np.uint8)[starts[0] : starts[-1]]
    starts = starts[:-1] - starts[0]
    eight = np.zeros(len(data) // 8 + 2, "<u8")
    eight.view(np.uint8)[: len(data)] = data
    out = mix(size.astype(np.uint64) * BASE)
    which, at = np.flatnonzero(size <= LONG), 0
    while len(which):
        begin, shift = np.divmod(starts[which] + at, 8)
        shift = shift.astype(np.uint64) * np.uint64(8)
        block = eight[begin] >> shift | eight[begin + 1] << np.uint64(1) << (np.uint64(63) - shift)
        beyond = (8 - np.minimum(size[which] - at, 8)).astype(np.uint64) * np.uint64(8)
        out[which] = mix(out[which] ^ (block & (np.uint64(0xFFFFFFFFFFFFFFFF) >> beyond)))
        at += 8
        which = which[size[which] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + size[i]])
    return out


def ordered(key: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys, from 0 to span, in order, and their stable order; sorted as one number with their places where that fits, which is quicker."""
    bits = len(key).bit_length()
    if span.bit_length() + bits > 63:
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = np.sort(key << bits | np.arange(len(key)))
    return both >> bits, both & ((1 << bits) - 1)


def numbered(key: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the number of each key among them, and their counts."""
    key, order = ordered(key, span)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(np.append(first, len(key)))
    number = np.empty(len(key), np.int64)
    number[order] = np.repeat(np.arange(len(first)), count)
    return key[first], number, count


def once(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order, by sorting: np.unique alone goes through a table of hashes, many times slower where most are distinct."""
    x = np.sort(x)
    fresh = np.ones(len(x), bool)
    fresh[1:] = x[1:] != x[:-1]
    return x[fresh]


def named(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the distinct words, the last being NONE; by place the number of its word; the offsets of the rows' places."""
    words, offsets = words_of(text)
    coded = words.dictionary_encode()
    own = np.append(np.maximum(hashed(coded.dictionary), np.uint64(1)), np.uint64(NONE)).view(np.int64)
    return own, coded.indices.to_numpy().astype(np.int64), offsets


def places(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the distinct words, the last being NONE; by place the numbers of the word before, the word and the word behind; its row."""
    own, m, offsets = named(text)
    x, y = np.roll(m, 1), np.roll(m, -1)
    some = np.diff(offsets) > 0
    x[offsets[:-1][some]] = y[offsets[1:][some] - 1] = len(own) - 1
    return own, x, m, y, rows_of(offsets)


def _text(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text"))


def _added(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.Table.from_arrays([pa.array(np.concatenate(z)) for z in zip(*held)], names=["m", "y", "c"]).group_by(["m", "y"]).aggregate([("c", "sum")]).rename_columns({"c_sum": "c"}).select(["m", "y", "c"])


def counts(docs: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """m, y, c: the counts of all words (y is 0), or of the bigrams whose first word is one of these."""

    def run(batches):
        held, size = [], 0
        for batch in slices(batches, limit=SLICE):
            if only is None:
                own, m, _ = named(_text(batch))
                c = np.bincount(m, minlength=len(own))[:-1]
                held.append((own[:-1], np.zeros_like(own[:-1]), c))
            else:
                own, _, m, y, _ = places(_text(batch))
                use = np.isin(own, only)[m] & (y < len(own) - 1)
                key, c = np.unique(m[use] * len(own) + y[use], return_counts=True)
                held.append((own[key // len(own)], own[key % len(own)], c))
            size += len(held[-1][2])
            if size > HELD:
                yield from _added(held).to_batches()
                held, size = [], 0
        if held:
            yield from _added(held).to_batches()
        del held
        release()

    return docs.select("text").mapInArrow(run, "m long, y long, c long").groupBy("m", "y").agg(F.sum("c").alias("c"))


PACKED = "part int, bucket int, slice long, n int, n_words int, spelled int, wide boolean, body binary"
NAMES = ["part", "bucket", "slice", "n", "n_words", "spelled", "wide", "body"]
TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]


def _documents(batch: pa.RecordBatch) -> tuple[int, bytes]:
    """The ids and lengths of a slice."""
    doc_id, n_bytes = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n_bytes"))
    sink = pa.BufferOutputStream()
    table = pa.record_batch([doc_id, n_bytes], names=["doc_id", "n_bytes"])
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(table)
    return batch.num_rows, sink.getvalue().to_pybytes()


def packed(docs: DataFrame, buckets: int, table_of: Broadcast, hot: dict[int, int], spread: int, slice_bytes: int = SLICE) -> DataFrame:
    """All places by part and bucket, PACKED: those of a slice together; and a row for the documents of each slice, with n = -1. A part is GROUP buckets.

    docs: doc_id, text, n_bytes. table_of: the sorted hashes of the commonest words.
    """
    hot_words = np.array(sorted(hot), np.int64)
    shares = np.array([-(-hot[int(w)] // spread) for w in hot_words], np.int64)

    def run(batches):
        number, frequent = TaskContext.get().partitionId() << 24, table_of.value
        for batch in slices(batches, limit=slice_bytes):
            rows, ids = _documents(batch)
            home = int(mix(np.array([number], np.uint64))[0] % np.uint64(buckets))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((home // GROUP, home, number, -1, rows, 0, False, ids), TYPES)], names=NAMES)
            yield from packets(batch, number, frequent)
            release()
            number += 1

    def packets(batch, number, frequent):
        own, x, m, y, row = places(_text(batch))
        if not len(m):
            return
        v = len(own)
        k = np.minimum(np.searchsorted(frequent, own), max(len(frequent) - 1, 0))
        code = np.where(frequent[k] == own, k + 1, SPELLED) if len(frequent) else np.full(v, SPELLED)
        code[-1] = 0
        spun = mix(own.view(np.uint64))
        nth = np.empty(v, np.int64)
        by_hash = np.argsort(own.view(np.uint64))
        nth[by_hash] = np.arange(v)
        hashes = own.view(np.uint64)[by_hash]
        to = (spun % np.uint64(buckets)).astype(np.int64)[m]
        if len(hot_words):
            k = np.minimum(np.searchsorted(hot_words, own), len(hot_words) - 1)
            share = np.where(hot_words[k] == own, shares[k], 1)
            to = (to + (mix(spun ^ np.uint64(7)) >> np.uint64(1)).astype(np.int64)[x] % share[m]) % buckets
        key, order = ordered(to * v + nth[m], buckets * v)
        x, y = x[order], y[order]
        group = np.flatnonzero(np.diff(key, prepend=-1))  # the places of one word in one bucket
        size = np.diff(np.append(group, len(key)))
        word, to = hashes[key[group] % v], key[group] // v
        wide = batch.num_rows > 1 << 16
        row = np.diff(row[order], prepend=0).astype(np.uint32 if wide else np.uint16)  # modulo the type: small steps within a word
        xc, yc = code[x].astype(np.uint16), code[y].astype(np.uint16)
        cuts = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
        begin = np.append(group, len(key))
        last = np.cumsum(row, dtype=row.dtype)
        out = []
        for g, h in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            a, b = int(begin[g]), int(begin[h])
            first = row[a:b].copy()
            first[0] = last[a]
            spelled = np.concatenate([own[x[a:b][xc[a:b] == SPELLED]], own[y[a:b][yc[a:b] == SPELLED]]])
            body = compressed(planes(np.diff(word[g:h], prepend=np.uint64(0))), planes(size[g:h].astype(np.uint32)), planes(xc[a:b]), planes(yc[a:b]), planes(first), planes(spelled))
            out.append((int(to[g]) // GROUP, int(to[g]), number, b - a, h - g, len(spelled), wide, body))
        for a in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 64]), TYPES)], names=NAMES)

    return docs.mapInArrow(run, PACKED)


class Bucket:
    """The places of a bucket: own, the sorted hashes of its words; x, m, y, numbers of words; doc, numbers of documents; distinct n-grams and their counts.

    parts: for each packet its slice, its first place and its first document.
    """

    def __init__(self, table: pa.Table, frequent: np.ndarray):
        packets = list(zip(*(table.column(c).to_pylist() for c in NAMES[2:])))
        n = sum(r[1] for r in packets)
        x, y, doc = np.empty(n, np.uint16), np.empty(n, np.uint16), np.empty(n, np.int32)
        words, sizes, spelled_x, spelled_y, self.parts, at, docs = [], [], [], [], [], 0, 0
        for number, size, n_words, n_spelled, wide, body in packets:
            kind = np.uint32 if wide else np.uint16
            read = Reader(body, n_words * 12 + size * (8 if wide else 6) + n_spelled * 8)
            words.append(np.cumsum(read.take(n_words, np.uint64)).view(np.int64))
            sizes.append(read.take(n_words, np.uint32))
            x[at : at + size], y[at : at + size] = read.take(size, np.uint16), read.take(size, np.uint16)
            row = np.cumsum(read.take(size, kind), dtype=kind)
            doc[at : at + size] = row.astype(np.int32) + docs
            spelled = read.take(n_spelled, np.int64)
            in_x = int((x[at : at + size] == SPELLED).sum())
            spelled_x.append(spelled[:in_x])
            spelled_y.append(spelled[in_x:])
            self.parts.append((number, at, docs))
            at += size
            docs += int(row.max()) + 1
        self.parts.append((None, at, docs))
        table_of = np.concatenate([[NONE], frequent, [NONE]]).astype(np.int64)
        used = np.zeros(SPELLED + 1, bool)
        used[x] = used[y] = True
        used = np.flatnonzero(used[:SPELLED])
        words, spelled_x, spelled_y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (words, spelled_x, spelled_y))
        self.own = once(np.concatenate([words, table_of[used], spelled_x, spelled_y]))
        number = np.zeros(SPELLED + 1, np.int32)
        number[used] = np.searchsorted(self.own, table_of[used])
        self.m = np.repeat(np.searchsorted(self.own, words).astype(np.int32), np.concatenate(sizes) if sizes else 0)
        self.x, self.y = number[x], number[y]
        self.x[x == SPELLED], self.y[y == SPELLED] = np.searchsorted(self.own, spelled_x), np.searchsorted(self.own, spelled_y)
        self.doc, self.n_docs = doc, docs
        v = self.v = len(self.own)
        self.first, self.two = x == 0, y != 0
        self.three = self.two & ~self.first
        self.grams2, self.c2 = np.unique(self.m[self.two] * np.int64(v) + self.y[self.two], return_counts=True)
        self.contexts, context, _ = numbered(self.x[self.three] * np.int64(v) + self.m[self.three], v * v)
        self.key3 = context * np.int64(v) + self.y[self.three]

    def hot(self, hot_words: np.ndarray) -> np.ndarray:
        return np.isin(self.own, hot_words)


def _buckets(table: pa.Table, frequent: np.ndarray):
    """The buckets of a part, one after another."""
    table = table.filter(pc.greater_equal(table.column("n"), 0))
    number = table.column("bucket").to_numpy()
    for k in np.unique(number):
        yield Bucket(table.filter(pa.array(number == k)), frequent)
        release()


def counted(table: pa.Table, frequent: np.ndarray, hot_words: np.ndarray) -> pa.Table:
    """n, r, c: how many n-grams have the count r, up to K + 1; n = 1: r = 0 the places, 1 the distinct words. Words and bigrams of hot words aren't here."""
    rows = [(1, 0, 0)]
    for b in _buckets(table, frequent):
        hot = b.hot(hot_words)
        words = once(b.m)
        c2 = b.c2[~hot[b.grams2 // b.v]]
        c3 = np.unique(b.key3, return_counts=True)[1]
        rows += [(1, 0, len(b.m)), (1, 1, int((~hot[words]).sum()))]
        rows += [(n, r, int((c == r).sum())) for n, c in ((2, c2), (3, c3)) for r in range(1, K + 2)]
        del b  # before the next one is made
    return pa.table({k: pa.array(v, t) for k, v, t in zip("nrc", zip(*rows), (pa.int32(), pa.int32(), pa.int64()))})


def _scale(mass: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A context without discounted or dropped counts leaves 1 / (c + 1)."""
    full = mass > 1 - 1e-12
    return np.where(full, c / ((c + 1) * np.where(full, mass, 1)), 1.0)


SUMS = pa.schema([("slice", pa.int64()), ("n", pa.int32()), ("body", pa.binary())])


def evaluated(b: Bucket, told: pa.Table, hot: dict[int, int], least: int) -> np.ndarray:
    """log P of each place."""
    v = b.v
    n, m, y, c = (told.column(k).to_numpy() for k in ("n", "m", "y", "c"))
    of = {(int(i), int(j)): int(k) for i, j, k in zip(n, m, c) if i}  # of_counts by (n, r)
    d = discounts(of, ORDER)
    dr = {i: np.array([0] + [d[i, r] for r in range(1, K + 1)] + [1.0]) for i in (2, 3)}
    kept = lambda i, r: dr[i][np.minimum(r, K + 1)] * r

    c1 = np.bincount(b.m, minlength=v).astype(np.float64)
    c2, first2 = b.c2.copy(), b.grams2 // v
    context2 = np.bincount(first2, c2, v)
    mass2 = np.bincount(first2, kept(2, c2), v)
    told_m, told_y, told_c = m[n == 0], y[n == 0], c[n == 0]
    if len(told_m):
        words = once(told_m)
        at = np.minimum(np.searchsorted(b.own, words), v - 1)
        here = b.own[at] == words
        of_word = np.searchsorted(words, told_m)
        context2[at[here]] = np.bincount(of_word, told_c)[here]
        mass2[at[here]] = np.bincount(of_word, kept(2, told_c))[here]
        at_m, at_y = (np.minimum(np.searchsorted(b.own, z), v - 1) for z in (told_m, told_y))
        known = (b.own[at_m] == told_m) & (b.own[at_y] == told_y)
        g = at_m[known] * v + at_y[known]
        k = np.minimum(np.searchsorted(b.grams2, g), max(len(b.grams2) - 1, 0))
        same = b.grams2[k] == g if len(b.grams2) else np.zeros(len(g), bool)
        c2[k[same]] = told_c[known][same]
    for w, count in hot.items():
        k = np.searchsorted(b.own, w)
        if k < v and b.own[k] == w:
            c1[k] = count
    mass2 = mass2 / np.maximum(context2, 1)
    p2 = kept(2, c2) / context2[first2] * _scale(mass2, np.maximum(context2, 1))[first2]

    lp = np.where(b.first, np.log((c1[b.m] + 1) / (of[1, 0] + of[1, 1] + 1)), 0.0)
    start = b.first & b.two
    lp[start] += np.log(p2[np.searchsorted(b.grams2, b.m[start] * np.int64(v) + b.y[start])])
    if len(b.contexts):
        key3, at3, c3 = numbered(b.key3, len(b.contexts) * v)
        context = key3 // v
        lower = p2[np.searchsorted(b.grams2, (b.contexts % v)[context] * v + key3 % v)]
        use = c3 >= least
        all3 = np.bincount(context, c3)
        mass = np.bincount(context, np.where(use, kept(3, c3), 0.0)) / all3
        scale = _scale(mass, all3)
        # the bigrams leave something to words not seen, so what they give to the kept ones is below 1
        back = (1 - mass * scale) / (1 - np.bincount(context, np.where(use, lower, 0.0)))
        p3 = np.where(use, kept(3, c3) / all3[context] * scale[context], back[context] * lower)
        lp[b.three] += np.log(p3)[at3]
    return lp


def summed(table: pa.Table, told: pa.Table, frequent: np.ndarray, hot: dict[int, int], least: int) -> pa.Table:
    """SUMS: by slice the log probability of each document's places here; and the rows of the slices' documents, with n = -1."""
    passed = table.filter(pc.less(table.column("n"), 0)).select(["slice", "n", "body"]).cast(SUMS)
    found = []
    for b in _buckets(table, frequent):
        total, here = np.bincount(b.doc, evaluated(b, told, hot, least), b.n_docs), np.bincount(b.doc, minlength=b.n_docs) > 0
        doc = np.flatnonzero(here)
        numbers, firsts = np.array([p[0] for p in b.parts[:-1]], np.int64), np.array([p[2] for p in b.parts[:-1]], np.int64)
        k = np.searchsorted(firsts, doc, side="right") - 1
        found.append((numbers[k], doc - firsts[k], total[doc]))
        del b  # before the next one is made
    if not found:
        return passed
    number, row, lp = map(np.concatenate, zip(*found))
    (number, row), _, at = distinct(number, row)
    lp = np.bincount(at, lp, len(number))
    cuts = np.append(np.flatnonzero(np.diff(number, prepend=number[0] - 1)), len(number))
    out = [(int(number[a]), int(z - a), compressed(planes(np.diff(row[a:z], prepend=0).astype(np.uint32)), planes(lp[a:z]))) for a, z in zip(cuts, cuts[1:])]
    return pa.concat_tables([passed, pa.table([pa.array(c, t) for c, t in zip(zip(*out), SUMS.types)], schema=SUMS)])


SCORES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("log_prob", pa.float64())])


def added(table: pa.Table) -> pa.Table:
    """The scores of a slice's documents."""
    n, bodies = table.column("n").to_pylist(), table.column("body").to_pylist()
    docs = pa.ipc.open_stream(bodies[n.index(-1)]).read_all()
    total, some = np.zeros(docs.num_rows), np.zeros(docs.num_rows, bool)
    for k, body in zip(n, bodies):
        if k > 0:
            read = Reader(body, k * 12)
            rows = np.cumsum(read.take(k, np.uint32))
            total[rows] += read.take(k, np.float64)
            some[rows] = True
    return docs.append_column("log_prob", pa.array(total, mask=~some)).cast(SCORES)


def scored(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, hot_count: int = HOT, least: int = LEAST, slice_bytes: int = SLICE, n_frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, log_prob, bits_per_byte: a row for each document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    size = docs.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    words = stored(counts(docs).select("m", "c"))
    # at most one in hot_count of the places is such a word
    hot = {r.m: r.c for r in words.filter(F.col("c") > hot_count).collect()}
    hot_words = np.array(sorted(hot), np.int64)
    common = words.orderBy(F.desc("c"), "m").limit(min(n_frequent, FREQUENT)).select("m").toArrow().column(0)  # of fixed size
    held = spark.sparkContext.broadcast(np.sort(common.to_numpy()))
    all_places = packed(docs, buckets, held, hot, hot_count, slice_bytes)
    of = all_places.groupBy("part").applyInArrow(lambda t: counted(t, held.value, hot_words), "n int, r int, c long")
    homes = spark.range(-(-buckets // GROUP)).select(F.col("id").cast("int").alias("part"))
    followers = None
    if hot:
        followers = stored(counts(docs, hot_words))
        of = of.unionByName(followers.filter(f"c <= {K + 1}").groupBy("c").count().select(F.lit(2).alias("n"), F.col("c").cast("int").alias("r"), F.col("count").alias("c")))
        of = of.unionByName(spark.createDataFrame([(1, 1, len(hot))], "n int, r int, c long"))
    told = homes.crossJoin(F.broadcast(of.groupBy("n", "r").agg(F.sum("c").alias("c")))).select("part", "n", F.col("r").cast("long").alias("m"), F.lit(0).cast("long").alias("y"), "c")
    if hot:
        home = (mix(hot_words.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        to = sorted({(int(w), int(h + s) % buckets // GROUP) for w, h in zip(hot_words, home) for s in range(-(-hot[int(w)] // hot_count))})
        sent = followers.join(F.broadcast(spark.createDataFrame(to, "m long, part int")), "m")
        told = told.unionByName(sent.select("part", F.lit(0).alias("n"), "m", "y", "c"))
    parts = all_places.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(
        lambda left, right: summed(left, right, held.value, hot, least) if left.num_rows else SUMS.empty_table(), "slice long, n int, body binary"
    )
    bits = F.when(F.col("n_bytes") > 0, -F.col("log_prob") / F.col("n_bytes") / math.log(2))
    return parts.groupBy("slice").applyInArrow(added, "doc_id long, n_bytes long, log_prob double").select("*", bits.alias("bits_per_byte"))
