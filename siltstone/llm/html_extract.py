"""Operator 4: main text of web pages by suffix arrays over each host.

A page's text is its HTML without head, comments, scripts and styles, with tags as breaks and entities
decoded. A run of MIN_WORDS words that stands on two distinct pages of a host is boilerplate; all words that
such runs cover go, and what is left is kept as unique runs, one a line.

The pages of a host are concatenated in effect, not in fact, so a hot host is no single task: the suffixes
that can begin a repeat are bucketed by host and minimiser (see suffix_dedup.py), and a bucket's suffixes
are sorted with hashed comparisons and verified word by word.

One plan for all sizes, in which nothing is collected or broadcast. Pages are read, cut into words and packed once,
a slice of them (about SLICE bytes of text) in one compressed row; the slices are shuffled by their number and read
from that shuffle three times:

1. each slice sends its minimisers, distinct, sorted and cut to 40 bits, to their buckets; a bucket answers with a bit
   for each, in the order sent: whether it stands at two places of its host (the other bits choose the bucket, and the
   buckets grow with the data, so few others share these; those that do are sorted out by the next step);
2. around the repeated ones, each slice sends its distinct strips of words, with the page that holds each, to the
   buckets, where they are sorted; neighbours that agree on MIN_WORDS words form a class, and a class of two pages is
   boilerplate; a bucket answers with a bit for each window, in the order sent;
3. each slice puts the bits on its windows and cuts.

So what comes back to the pages is bits, and a bucket holds BUCKET_BYTES of HTML's share of them, at any size.
``pages`` must give the same rows in the same order when a task is repeated, as the scan of a table does.

Defined cases: null html gives null text; a page without words gives an empty text; pages whose url is null
or has no host form one host; rows that agree in page_id and html are one page given twice: they don't make
each other boilerplate and get the same result; null page_id is passed on; other columns don't matter; an element
that isn't closed is taken as a tag, so its content stays.
"""

from __future__ import annotations

import html as html_module
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .suffix_dedup import Suffixes, minimisers
from .text import Prefix, Reader, compressed, distinct, hashes_of, mix, planes, ranges, rows_of, slices, words_of

MIN_WORDS = 8
GRAM = 5
SLICE = 8 << 20
LEVEL = 6
BUCKET_BYTES = 64 << 20
KEY_BITS = np.uint64(40)
#: For the SQL; the operator decodes all that HTML knows.
ENTITIES = {
    "&nbsp;": " ", "&#160;": " ", "&lt;": "<", "&#60;": "<", "&gt;": ">", "&#62;": ">", "&quot;": '"', "&#34;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'",
    "&copy;": "©", "&reg;": "®", "&trade;": "™", "&middot;": "·", "&bull;": "•", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’",
    "&ldquo;": "“", "&rdquo;": "”", "&laquo;": "«", "&raquo;": "»", "&euro;": "€", "&amp;": "&", "&#38;": "&",
}
#: One pass; an element that isn't closed is taken as a tag.
MARKUP = r"(?is)<(?:!--.*?--|head\b.*?</head\s*|script\b.*?</script\s*|style\b.*?</style\s*|noscript\b.*?</noscript\s*|template\b.*?</template\s*|[/!?a-z][^>]*)>"
BLANKS = r"(?i)&(?:nbsp|tab|newline|#0*(?:9|1[0-3]|32|160)|#x0*(?:[9a-d]|20|a0));"
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def page_text(html: str = "html") -> Column:
    """The text of a page: what isn't dropped or a tag. Entities that are spaces go here, the others by word in page_words()."""
    return F.regexp_replace(F.regexp_replace(html, MARKUP, " "), BLANKS, " ")


def page_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words_of() with the entities decoded: few words have one, so the texts aren't scanned for each."""
    words, offsets = words_of(text)
    coded = pc.match_substring(words, "&") if len(words) else None
    if coded is not None and pc.any(coded).as_py():
        # a word stays one word, and isn't emptied
        some = [re.sub(r"[ \t\n\r\f\v]", "", html_module.unescape(w)) or w for w in words.filter(coded).to_pylist()]
        words = pc.replace_with_mask(words, coded, pa.array(some, words.type))
    return words, offsets


def pages_of(pages: DataFrame) -> DataFrame:
    """page_id, url, host, the keys of page and host, and the page's whole text."""
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", host().alias("host"), F.xxhash64("page_id", "html").alias("page_key"), F.xxhash64(host()).alias("host_key"), page_text().alias("text")
    )


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def packed(pages: DataFrame) -> DataFrame:
    """slice, body: the pages of pages_of(), a slice of them in a row, their words coded."""

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        for batch in slices(batches, limit=SLICE):
            words, offsets = page_words(_column(batch, "text"))
            coded = words.dictionary_encode()
            code = coded.indices.to_numpy()
            by_use = np.argsort(-np.bincount(code, minlength=len(coded.dictionary)), kind="stable")  # common words have small numbers, which compress well
            nth = np.empty(len(by_use), np.uint32)
            nth[by_use] = np.arange(len(by_use))
            sink = pa.BufferOutputStream()
            parts = [
                pa.record_batch([*(_column(batch, c) for c in NAMES), pc.is_null(_column(batch, "text")), pa.array(np.diff(offsets).astype(np.int32))], names=[*NAMES, "none", "n"]),
                pa.record_batch([coded.dictionary.take(pa.array(by_use))], names=["words"]),
                pa.record_batch([pa.array([compressed(planes(nth[code]), level=LEVEL)], pa.binary())], names=["codes"]),
            ]
            for part in parts:
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
                    out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["slice", "body"])
            number += 1

    return pages.mapInArrow(run, "slice long, body binary")


NAMES = ["page_id", "url", "host", "page_key", "host_key"]


class Slice:
    """The pages of a slice (a table), their words and the strips of window starts that share a minimiser."""

    def __init__(self, table: pa.Table, min_words: int, gram: int, buckets: int):
        self.number, self.min_words = table.column("slice")[0].as_py(), min_words
        source = pa.BufferReader(table.column("body")[0].as_buffer())
        self.pages, words, codes = (pa.ipc.open_stream(source).read_all() for _ in range(3))
        self.offsets = np.concatenate([[0], np.cumsum(self.pages.column("n").to_numpy().astype(np.int64))])
        self.codes = Reader(codes.column(0)[0].as_py(), int(self.offsets[-1]) * 4).take(int(self.offsets[-1]), np.uint32).astype(np.int64)
        self.words = words.column(0).combine_chunks()
        hashes = hashes_of(self.words)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        self.prefix = Prefix(hashes)
        starts, at, h = minimisers(hashes, self.offsets, min_words, gram)
        first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
        self.begin, self.count = starts[first], np.diff(np.append(first, len(starts)))
        self.ahead = at[first] - self.begin
        self.row = np.searchsorted(self.offsets, self.begin, side="right") - 1
        self.host = self.pages.column("host_key").to_numpy().view(np.uint64)[self.row]
        self.h = mix(h[at[first]] ^ self.host) if len(first) else np.zeros(0, np.uint64)
        self.bucket = ((self.h >> KEY_BITS) % np.uint64(buckets)).astype(np.int64)
        #: the distinct minimisers by bucket, and the number of each strip's
        (self.key_bucket, self.key), _, self.key_of = distinct(self.bucket, self.h & np.uint64((1 << int(KEY_BITS)) - 1))

    def repeat(self, bits: np.ndarray) -> None:
        """Keeps the strips whose minimiser is repeated, and groups equal ones: what stands in a group, and each strip's group."""
        keep = np.flatnonzero(bits[self.key_of])
        self.begin, self.count, self.ahead, self.row, self.host, self.h, self.bucket = (x[keep] for x in (self.begin, self.count, self.ahead, self.row, self.host, self.h, self.bucket))
        length = self.count + self.min_words - 1
        other = np.zeros(len(keep), np.int64)
        while True:
            _, self.group, self.group_of = distinct(self.bucket, self.h, self.ahead, self.count, self.host, self.prefix(self.begin, length), other)
            index, of = ranges(self.begin, self.begin + length)
            mate = self.begin[self.group][self.group_of][of] + index - self.begin[of]
            wrong = np.unique(of[self.codes[index] != self.codes[mate]])  # equal hashes of other words
            if not len(wrong):
                return
            other[wrong] = wrong + 1


def _bits(replies: pa.Table, order: np.ndarray) -> np.ndarray:
    """The answers of the buckets, in the order of the rows sent; order: the bucket of each row."""
    out = np.zeros(len(order), bool)
    for bucket, n, body in zip(*(replies.column(c).to_pylist() for c in ("bucket", "n", "body"))):
        a, b = np.searchsorted(order, [bucket, bucket + 1])
        out[a:b] = np.unpackbits(np.frombuffer(pa.decompress(body, -(-n // 8), "zstd", asbytes=True), np.uint8), count=n).astype(bool)
    return out


def _reply(numbers, bucket: int, sizes, bits: np.ndarray) -> pa.Table:
    """A row for each slice: its share of these bits."""
    ends = np.cumsum(sizes)
    bodies = [compressed(np.packbits(bits[e - n : e]).tobytes()) for n, e in zip(sizes, ends)]
    return pa.table([pa.array(numbers, pa.int64()), pa.array([bucket] * len(bodies), pa.int32()), pa.array(sizes, pa.int32()), pa.array(bodies, pa.binary())], names=["slice", "bucket", "n", "body"])


REPLY = "slice long, bucket int, n int, body binary"
SENT = "bucket int, slice long, n int, hosts int, pages int, size long, body binary"


def _sent(rows: list[tuple]) -> pa.Table:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=["bucket", "slice", "n", "hosts", "pages", "size", "body"])


def _by_bucket(bucket: np.ndarray):
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    return zip(cuts[:-1].tolist(), cuts[1:].tolist())


def minimisers_sent(s: Slice) -> pa.Table:
    """Each distinct minimiser, and a bit: whether the slice itself has it at two places."""
    twice = np.bincount(s.key_of, minlength=len(s.key)) > 1
    rows = []
    for a, b in _by_bucket(s.key_bucket):
        parts = planes(np.diff(s.key[a:b], prepend=np.uint64(0))), np.packbits(twice[a:b]).tobytes()
        rows.append((int(s.key_bucket[a]), s.number, b - a, 0, 0, sum(map(len, parts)), compressed(*parts, level=LEVEL)))
    return _sent(rows)


def minimisers_counted(table: pa.Table) -> pa.Table:
    """The answer to minimisers_sent(): those at two places."""
    sizes, keys, twice = table.column("n").to_pylist(), [], []
    for n, size, body in zip(sizes, table.column("size").to_pylist(), table.column("body").to_pylist()):
        read = Reader(body, size)
        keys.append(np.cumsum(read.take(n, np.uint64)))
        twice.append(np.unpackbits(np.frombuffer(read.raw(-(-n // 8)), np.uint8), count=n))
    _, number = np.unique(np.concatenate(keys), return_inverse=True)
    places = np.bincount(number, np.concatenate(twice) + 1.0)
    return _reply(table.column("slice"), table.column("bucket")[0].as_py(), sizes, places[number] > 1)


def strips_sent(s: Slice) -> pa.Table:
    """Each distinct strip around a repeated minimiser: minimiser, how far it is ahead, starts, host, page (none if on two) and words."""
    g = s.group
    page = s.pages.column("page_key").to_numpy()[s.row]
    order = np.argsort(s.group_of, kind="stable")
    first = np.searchsorted(s.group_of[order], np.arange(len(g)))
    least, most = (f.reduceat(page[order], first) if len(g) else page[:0] for f in (np.minimum, np.maximum))
    alone = least == most
    length = s.count[g] + s.min_words - 1
    index, _ = ranges(s.begin[g], s.begin[g] + length)
    edges = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
    text = pc.binary_join(pa.ListArray.from_arrays(edges, s.words.take(pa.array(s.codes[index]))), " ")
    rows = []
    for a, b in _by_bucket(s.bucket[g]):
        own = g[a:b]
        hosts, host = np.unique(s.host[own], return_inverse=True)
        words = "\n".join(text.slice(a, b - a).to_pylist()).encode()
        parts = (
            planes(np.diff(s.h[own], prepend=np.uint64(0))), planes(s.ahead[own].astype(np.uint32)), planes(s.count[own].astype(np.uint32)), planes(host.astype(np.uint32)), np.packbits(alone[a:b]).tobytes(),
            planes(hosts), planes(least[a:b][alone[a:b]]), words,
        )
        rows.append((int(s.bucket[g[a]]), s.number, b - a, len(hosts), int(alone[a:b].sum()), sum(map(len, parts)), compressed(*parts, level=LEVEL)))
    return _sent(rows)


def strips_sorted(table: pa.Table, min_words: int) -> pa.Table:
    """The answer to strips_sent(): for each start of each strip, whether its window stands on two distinct pages."""
    columns, sizes = [], []
    for n, n_hosts, n_pages, size, body in zip(*(table.column(c).to_pylist() for c in ("n", "hosts", "pages", "size", "body"))):
        read = Reader(body, size)
        h, ahead, starts, host = np.cumsum(read.take(n, np.uint64)), *(read.take(n, np.uint32).astype(np.int64) for _ in range(3))
        alone = np.unpackbits(np.frombuffer(read.raw(-(-n // 8)), np.uint8), count=n).astype(bool)
        hosts, page = read.take(n_hosts, np.uint64), read.take(n_pages, np.int64)
        lo, hi = np.full(n, np.iinfo(np.int64).min), np.full(n, np.iinfo(np.int64).max)
        lo[alone] = hi[alone] = page
        columns.append((h, ahead, starts, hosts[host], lo, hi, np.array(read.raw(len(read.data) - read.at).decode().split("\n"), object)))
        sizes.append(int(starts.sum()))
    h, ahead, starts, host, lo, hi, text = map(np.concatenate, zip(*columns))
    words, offsets = words_of(pa.array(text, pa.string()))
    at, of = ranges(offsets[:-1], offsets[:-1] + starts)
    _, _, bucket = distinct(h[of], host[of], ahead[of] - (at - offsets[of]))
    suffixes = Suffixes(hashes_of(words), min_words)
    bucket, order = suffixes.sort(bucket, at)
    near = np.flatnonzero(bucket[1:] == bucket[:-1])
    near = near[suffixes.common(order[near], order[near + 1]) >= min_words]
    true = np.ones(len(near), bool)
    codes = words.dictionary_encode().indices.to_numpy()
    for k in range(min_words):  # collision verification
        true &= codes[order[near] + k] == codes[order[near + 1] + k]
    fresh = np.ones(len(order), bool)
    fresh[near[true] + 1] = False
    first = np.flatnonzero(fresh)
    strip = np.searchsorted(offsets, order, side="right") - 1
    shared = np.minimum.reduceat(lo[strip], first) != np.maximum.reduceat(hi[strip], first)
    flags = np.zeros(len(words), bool)
    flags[order] = shared[np.cumsum(fresh) - 1]
    return _reply(table.column("slice"), table.column("bucket")[0].as_py(), sizes, flags[at])


RESULT = "page_id long, url string, host string, text string, n_words int, removed_words int"


def unique_runs(s: Slice, bits: np.ndarray) -> pa.Table:
    """RESULT for the pages of a slice; bits: of the starts of its groups of strips."""
    before = np.cumsum(s.count[s.group]) - s.count[s.group]
    k, strip = ranges(np.zeros(len(s.begin), np.int64), s.count)
    at = (s.begin[strip] + k)[bits[before[s.group_of[strip]] + k]]
    total = len(s.codes)
    edge = np.bincount(at, minlength=total + 1) - np.bincount(at + s.min_words, minlength=total + 1)
    keep = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
    n_pages = s.pages.num_rows
    row = rows_of(s.offsets)[keep]
    start = np.flatnonzero((np.diff(keep, prepend=-2) != 1) | (np.diff(row, prepend=-1) != 0))
    runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(start, len(keep)).astype(np.int32)), s.words.take(pa.array(s.codes[keep]))), " ")
    edges = np.searchsorted(row[start], np.arange(n_pages + 1)).astype(np.int32)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), runs), "\n")
    text = pc.if_else(s.pages.column("none").combine_chunks(), pa.scalar(None, pa.string()), text)
    n = np.bincount(row, minlength=n_pages)
    rest = np.diff(s.offsets) - n
    return pa.table([*(s.pages.column(c) for c in NAMES[:3]), text, pa.array(n.astype(np.int32)), pa.array(rest.astype(np.int32))], names=["page_id", "url", "host", "text", "n_words", "removed_words"])


def main_text(pages: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """page_id, url, host, text, n_words, removed_words: a row for each page."""
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    all_slices = packed(pages_of(pages))
    own = lambda table: Slice(table, min_words, gram, buckets)

    def found(table: pa.Table, replies: pa.Table) -> Slice:
        s = own(table)
        s.repeat(_bits(replies, s.key_bucket))
        return s

    def second(table: pa.Table, replies: pa.Table) -> pa.Table:
        return strips_sent(found(table, replies))

    def third(table: pa.Table, replies: pa.Table) -> pa.Table:
        two = pc.equal(replies.column("step"), 2)
        s = found(table, replies.filter(pc.invert(two)))
        return unique_runs(s, _bits(replies.filter(two), np.repeat(s.bucket[s.group], s.count[s.group])))

    sliced = lambda: all_slices.groupBy("slice")
    repeats = sliced().applyInArrow(lambda t: minimisers_sent(own(t)), SENT).groupBy("bucket").applyInArrow(minimisers_counted, REPLY)
    strips = sliced().cogroup(repeats.groupBy("slice")).applyInArrow(second, SENT)
    boilerplate = strips.groupBy("bucket").applyInArrow(lambda t: strips_sorted(t, min_words), REPLY)
    replies = repeats.withColumn("step", F.lit(1)).unionByName(boilerplate.withColumn("step", F.lit(2)))
    return sliced().cogroup(replies.groupBy("slice")).applyInArrow(third, RESULT)


def _sql_entities() -> str:
    t = "t"
    for name, c in ENTITIES.items():
        t = f"replace({t}, '{name}', '{c.replace(chr(39), chr(39) * 2)}')"
    return t


SQL = rf"""
WITH a AS (
    SELECT page_id, url, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host,
           regexp_replace(html, '{MARKUP}', ' ', 'g') AS t
    FROM pages
), p AS (
    SELECT page_id, url, host, regexp_extract_all({_sql_entities()}, '[^ \t\n\r\f\v]+') AS w FROM a
), windows AS (
    SELECT host, page_id, unnest(list_transform(range(len(w) - {MIN_WORDS - 1}), lambda i: array_to_string(w[i + 1:i + {MIN_WORDS}], ' '))) AS g, unnest(range(len(w) - {MIN_WORDS - 1})) AS pos
    FROM p WHERE len(w) >= {MIN_WORDS}
), shared AS (
    SELECT host, g FROM windows GROUP BY 1, 2 HAVING count(DISTINCT page_id) > 1
), gone AS (
    SELECT DISTINCT page_id, unnest(range(pos, pos + {MIN_WORDS})) AS pos FROM windows JOIN shared USING (host, g)
), words AS (
    SELECT page_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM p
), kept AS (
    SELECT page_id, word, pos, pos - row_number() OVER (PARTITION BY page_id ORDER BY pos) AS run FROM words ANTI JOIN gone USING (page_id, pos)
), runs AS (
    SELECT page_id, min(pos) AS pos, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM kept GROUP BY page_id, run
), texts AS (
    SELECT page_id, string_agg(text, chr(10) ORDER BY pos) AS text, sum(n) AS n FROM runs GROUP BY 1
)
SELECT p.page_id, url, host, CASE WHEN w IS NOT NULL THEN coalesce(texts.text, '') END AS text, CAST(coalesce(n, 0) AS INTEGER) AS n_words,
       CAST(coalesce(len(w), 0) - coalesce(n, 0) AS INTEGER) AS removed_words
FROM p LEFT JOIN texts ON texts.page_id = p.page_id
"""
