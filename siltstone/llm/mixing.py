"""Operator 1: mixing sources to target weights.

1. Pack: the documents of a source, in the order (doc_id, text), give one stream of words with END behind
   each document; it is cut into blocks of BLOCK words (the source's last block may be shorter). A document's
   place comes from prefix sums over a hierarchy of ranges of doc_id (of 2**12 ids, 2**29, 2**46), so no source,
   however hot, and no ids, dense or sparse, are ordered in one task, and every word of every text is packed.
2. Draw: SHARD slots make an output shard. Each slot draws its source from a hash, by integer target weights,
   so a shard's source counts are multinomial. There are as many slots as blocks.
3. Map: the k-th slot of a source over all shards (again a two-level sum: counts by shard, then within the
   shard) takes block perm(k mod n) of epoch k div n, where perm is a pseudorandom permutation of the
   source's n blocks by swap-or-not rounds, its own in each epoch. So a source repeats no block before all of
   its blocks had their turn.
4. Join: blocks are grouped by (source, index) and joined with the slots on the same key and partitioning.

All of it is integer arithmetic and MD5, so that the same SQL runs elsewhere; words are split, and the rounds of the
permutation worked out, in Arrow batches (as lambdas these took 28 microseconds a slot and round). The rounds mix a
key of the source, the epoch and the round modulo the prime P. A source's
default weight is the whole square root of its number of words, which lifts small sources; weights may add up to
anything below 2**60 (a slot's draw is a 60-bit number modulo their sum).

Defined cases: texts without words (null, empty, blank) pack nothing; a null source is a source of its own;
documents with a null doc_id come first within their source, in the order of their text's MD5; ties of doc_id go
by their words; documents given twice are packed twice, next to each other, and count as two in n_docs; an empty table
gives no blocks; a source without a weight in ``weights`` is left out; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .text import ranges, slices, words_of

BLOCK = 512
SHARD = 256
SEED = 17
ROUNDS = 24
LEVELS = (12, 17, 17)
CELLS = 1024
P = 2147483647
END = "<|end|>"
SCHEMA = "shard long, slot long, source string, epoch long, block long, n_words long, n_docs long, first_doc_id long, last_doc_id long, text string"


def _hash60(*parts: Column | str) -> Column:
    text = F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _placed(docs: DataFrame) -> DataFrame:
    """src, known (has an id), r (the lowest range), id (the order within the source, before text), doc_id, text."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.filter("text IS NOT NULL").select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("src"), doc_id.alias("doc_id"), "text")
    rows = rows.withColumn("id", F.when(F.col("doc_id").isNull(), _hash60(F.col("text"))).otherwise(F.col("doc_id")))
    return rows.select("src", F.col("doc_id").isNotNull().alias("known"), F.shiftright("id", LEVELS[0]).alias("r"), "id", "doc_id", "text")


def counted(docs: DataFrame) -> DataFrame:
    """src, known, r, total: the words of each range of each source, END included. Stored: counted once, read by packed() and sources()."""

    def run(batches):
        for batch in slices(batches):
            n = np.diff(words_of(batch.column(3))[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.where(n > 0, n + 1, 0))], names=["src", "known", "r", "n"]).filter(pa.array(n > 0))

    n = _placed(docs).select("src", "known", "r", "text").mapInArrow(run, "src string, known boolean, r long, n long")
    return stored(n.groupBy("src", "known", "r").agg(F.sum("n").alias("total")))


def _streams(docs: DataFrame) -> DataFrame:
    """The columns of _placed(), n, and the text as its words and END, one space between."""

    def run(batches):
        for batch in slices(batches):
            words, offsets = words_of(batch.column(5))
            n = np.diff(offsets)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words), " ")
            text = pc.binary_join_element_wise(text, END, " ")
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n + 1), text], names=[*batch.schema.names[:5], "n", "text"]).filter(pa.array(n > 0))

    return _placed(docs).mapInArrow(run, "src string, known boolean, r long, id long, doc_id long, n long, text string")


def _bases(sums: DataFrame) -> DataFrame:
    """b_src, b_known, b_r, base: the words of the source before each range. Each sum runs over the ranges within one of the next level."""
    level = sums.select("src", "known", F.col("r").alias("x0"), "total")
    levels = []
    for k, bits in enumerate(LEVELS[1:]):
        level = level.withColumn(f"x{k + 1}", F.shiftright(f"x{k}", bits))
        levels.append(level.selectExpr("src", "known", f"x{k}", f"x{k + 1}", f"sum(total) OVER (PARTITION BY src, known, x{k + 1} ORDER BY x{k} ROWS UNBOUNDED PRECEDING) - total AS s{k}"))
        level = level.groupBy("src", "known", f"x{k + 1}").agg(F.sum("total").alias("total"))
    top = len(levels)
    base = level.selectExpr("src", "known", f"x{top}", f"sum(total) OVER (PARTITION BY src ORDER BY known, x{top} ROWS UNBOUNDED PRECEDING) - total AS base")
    for k in range(top - 1, -1, -1):
        base = levels[k].join(base, ["src", "known", f"x{k + 1}"]).select("src", "known", f"x{k}", (F.col(f"s{k}") + F.col("base")).alias("base"))
    return base.select(F.col("src").alias("b_src"), F.col("known").alias("b_known"), F.col("x0").alias("b_r"), "base")


def packed(docs: DataFrame, block: int = BLOCK, sums: DataFrame | None = None) -> DataFrame:
    """src, b, doc_id, pos, piece: what each document puts into each block; pos counts words of the source. sums: the table of counted()."""
    base = _bases(counted(docs) if sums is None else sums)
    inner = _streams(docs).selectExpr("src", "known", "r", "doc_id", "n", "text", "sum(n) OVER (PARTITION BY src, known, r ORDER BY id, text ROWS UNBOUNDED PRECEDING) - n AS inner")
    placed = inner.join(base, (inner["src"] == base["b_src"]) & (inner["known"] == base["b_known"]) & (inner["r"] == base["b_r"]))

    def run(batches):
        for batch in slices(batches):
            words, offsets = words_of(batch.column(4))
            start, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            b, row = ranges(start // block, (start + n - 1) // block + 1)
            pos = np.maximum(start[row], b * block)
            cuts = np.append(offsets[row] + pos - start[row], len(words)).astype(np.int32)  # a piece ends where the next one begins
            piece = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), " ")
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(b), batch.column(1).take(take), pa.array(pos), piece], names=["src", "b", "doc_id", "pos", "piece"])

    return placed.select("src", "doc_id", (F.col("base") + F.col("inner")).alias("start"), "n", "text").mapInArrow(run, "src string, b long, doc_id long, pos long, piece string")


def sources(sums: DataFrame, block: int = BLOCK, weights: dict[str, int] | None = None) -> DataFrame:
    """src, blocks, weight: a row for each source, the weight as a whole number. sums: the table of counted()."""
    totals = sums.groupBy("src").agg(F.sum("total").alias("words"))
    if weights is None:
        weight = F.floor(F.sqrt(F.col("words").cast("double"))).cast("long")
    else:
        pairs = [F.lit(x) for k, w in sorted(weights.items()) for x in (f"s{k}", int(w))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("src")), F.lit(0)).cast("long") if pairs else F.lit(0).cast("long")
    return totals.select("src", F.ceil(F.col("words") / block).cast("long").alias("blocks"), weight.alias("weight")).filter("weight > 0")


def _spread(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers below P from two, the first below P and the second below 2**45; products stay below 2**63."""
    h = (x * 1103515245 + y % P + (y // P) * 40014 + 12345) % P
    return (h + (h >> 15)) % P * 48271 % P


def permuted(key: np.ndarray, blocks: np.ndarray, epoch: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The block of place x of the epoch; key is the source's. Swap-or-not: in each round, x and its partner (t - x) mod n swap places or not, by a bit of the round's key and the greater of both."""
    own = _spread(key, epoch)
    for r in range(ROUNDS):
        a, b = _spread(own, np.int64(2 * r)), _spread(own, np.int64(2 * r + 1))
        mate = ((a * P + b) % blocks + blocks - x) % blocks
        x = np.where(_spread(b, np.maximum(x, mate)) % 2 == 0, mate, x)
    return x


def slots(src: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """shard, slot, src, epoch, block: what goes where. src: the table of sources(), read a few times."""
    spark = src.sparkSession
    total = src.agg(F.sum("blocks"), F.sum("weight")).first()
    n, weight = total[0] or 0, total[1] or 1
    if weight >= 1 << 60:
        raise ValueError("the weights must add up to less than 2**60")
    cell = max(1, -(-weight // CELLS))
    # sources in order of name, each on its stretch of [0, weight); joined over cells of equal width, not as a product
    ends = src.selectExpr("*", "sum(weight) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING) AS hi").selectExpr("*", "hi - weight AS lo")
    ends = ends.select("*", (_hash60(F.lit(f"{seed}:key"), F.col("src")) % P).alias("key"), F.explode(F.expr(f"sequence(lo div {cell}, (hi - 1) div {cell})")).alias("cell"))
    drawn = spark.range(n).select(F.expr(f"id div {shard}").alias("shard"), (F.col("id") % shard).alias("slot"), (_hash60(F.lit(f"{seed}:draw"), F.col("id")) % F.lit(weight)).alias("u"))
    drawn = drawn.withColumn("cell", F.expr(f"u div {cell}")).join(ends, "cell").filter("lo <= u AND u < hi").select("shard", "slot", "src", "blocks", "key")
    counts = drawn.groupBy("src", "shard").agg(F.count("*").alias("c"))
    before = counts.selectExpr("src", "shard", "sum(c) OVER (PARTITION BY src ORDER BY shard ROWS UNBOUNDED PRECEDING) - c AS before")
    ranked = drawn.selectExpr("*", "row_number() OVER (PARTITION BY src, shard ORDER BY slot) - 1 AS j")
    k = ranked.join(before, ["src", "shard"]).selectExpr("shard", "slot", "src", "key", "blocks", "(before + j) div blocks AS epoch", "(before + j) % blocks AS x")

    def run(batches):
        for batch in batches:
            key, blocks, epoch, x = (c.to_numpy() for c in batch.columns[3:])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(5), pa.array(permuted(key, blocks, epoch, x))], names=["shard", "slot", "src", "epoch", "block"])

    return k.mapInArrow(run, "shard long, slot long, src string, epoch long, block long")


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """A row for each slot of each shard, with the text of its block: see SCHEMA."""
    if not {"doc_id", "text", "source"} <= set(docs.columns):
        raise ValueError("docs needs doc_id, text and source")
    sums = counted(docs)
    src = stored(sources(sums, block, weights))
    part = packed(docs, block, sums).groupBy("src", "b").agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id", "piece"))).alias("p"))
    text = part.select(
        F.col("src").alias("p_src"),
        "b",
        F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("text"),
        F.size("p").cast("long").alias("n_docs"),
        F.element_at("p", 1)["doc_id"].alias("first_doc_id"),
        F.element_at("p", -1)["doc_id"].alias("last_doc_id"),
    )
    at = slots(src, shard, seed)
    out = at.join(text, (at["src"] == text["p_src"]) & (at["block"] == text["b"]))
    source = F.when(F.col("src") == "n", F.lit(None)).otherwise(F.expr("substr(src, 2)"))
    n_words = (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("long")
    return out.select("shard", "slot", source.alias("source"), "epoch", "block", n_words.alias("n_words"), "n_docs", "first_doc_id", "last_doc_id", "text")


def _sql_spread(x: str, y: str) -> str:
    h = f"((({x}) * 1103515245 + ({y}) % {P} + (({y}) // {P}) * 40014 + 12345) % {P})"
    return f"(({h} + ({h} >> 15)) % {P} * 48271) % {P}"


_SQL_KEY = _sql_spread(_sql_spread("key", "epoch"), "{y}")

SQL = rf"""
WITH d AS (
    SELECT coalesce('s' || source, 'n') AS src, doc_id, text, row_number() OVER () AS i, list_append(regexp_extract_all(text, '[^ 	

]+'), '{END}') AS w
    FROM documents WHERE regexp_matches(text, '[^ 	

]')
), placed_docs AS (
    SELECT *, CAST(sum(len(w)) OVER (PARTITION BY src ORDER BY doc_id IS NOT NULL, coalesce(doc_id, ('0x' || substr(md5(text), 1, 15))::BIGINT), array_to_string(w, ' '), i) - len(w) AS BIGINT) AS start FROM d
), packed AS (
    SELECT src, doc_id, i, unnest(w) AS word, start + unnest(range(len(w))) AS pos FROM placed_docs
), blocks AS (
    SELECT src, pos // {BLOCK} AS b, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n_words, count(DISTINCT i) AS n_docs, first(doc_id ORDER BY pos) AS first_doc_id, last(doc_id ORDER BY pos) AS last_doc_id
    FROM packed GROUP BY 1, 2
), sources AS (
    SELECT src, (count(*) + {BLOCK - 1}) // {BLOCK} AS blocks, CAST(floor(sqrt(CAST(count(*) AS DOUBLE))) AS BIGINT) AS weight FROM packed GROUP BY 1
), ends AS (
    SELECT *, ('0x' || substr(md5('{SEED}:key:' || src), 1, 15))::BIGINT % {P} AS key, CAST(sum(weight) OVER (ORDER BY src) AS BIGINT) AS hi, CAST(sum(weight) OVER () AS BIGINT) AS total FROM sources
), drawn AS (
    SELECT id // {SHARD} AS shard, id % {SHARD} AS slot, ('0x' || substr(md5('{SEED}:draw:' || id), 1, 15))::BIGINT % (SELECT any_value(total) FROM ends) AS u
    FROM (SELECT unnest(range((SELECT CAST(sum(blocks) AS BIGINT) FROM sources))) AS id)
), placed AS (
    SELECT shard, slot, src, blocks, key, row_number() OVER (PARTITION BY src ORDER BY shard, slot) - 1 AS k FROM drawn JOIN ends ON u < hi AND u >= hi - weight
), e AS (
    SELECT shard, slot, src, blocks, key, k // blocks AS epoch, k % blocks AS x FROM placed
), keys AS (
    SELECT src, epoch, list({_SQL_KEY.format(y="2 * r")} ORDER BY r) AS a, list({_SQL_KEY.format(y="2 * r + 1")} ORDER BY r) AS b
    FROM (SELECT DISTINCT src, epoch, key FROM e), range({ROUNDS}) AS t(r) GROUP BY 1, 2
), m AS (
    SELECT shard, slot, src, epoch, list_reduce(range({ROUNDS}), lambda p, r: CASE
        WHEN {_sql_spread("b[r + 1]", f"greatest(p, ((a[r + 1] * {P} + b[r + 1]) % blocks + blocks - p) % blocks)")} % 2 = 0
        THEN ((a[r + 1] * {P} + b[r + 1]) % blocks + blocks - p) % blocks ELSE p END, x) AS block FROM e JOIN keys USING (src, epoch)
)
SELECT shard, slot, nullif(substr(m.src, 2), '') AS source, epoch, block, n_words, n_docs, first_doc_id, last_doc_id, text
FROM m JOIN blocks ON blocks.src = m.src AND blocks.b = m.block
"""
