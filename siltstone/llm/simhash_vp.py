"""Operator 9: near duplicates by SimHash, with exact pairs from sharded vantage-point trees.

A fingerprint has 128 bits: the majority, bit by bit, over the hashes of the document's distinct words
(lower case, without punctuation at their ends). Two documents are near duplicates if their fingerprints
differ in RADIUS bits at most. The search is exact.

At that radius, triangle bounds over whole fingerprints prune next to nothing: distances to any vantage
point lie within a few bits of 64. So the 128 bits are taken as eight parts of 16: a pair within RADIUS
(below 8 * 3) differs in two bits at most in some part. Over each part stands a vantage-point tree: a node
splits the values by their Hamming distance to a vantage point, and a ball of two bits descends only where
|distance - boundary| allows. The tree's leaves are the shards. A fingerprint lives in one leaf of each tree
and is also sent, as a query, to the later leaves which its ball overlaps; so each pair meets in one shard
of a tree, and it is reported by the first tree only that can see it. Trees are fixed by a seed over all
65,536 values, so nothing is sampled and nothing grows on the driver. A leaf compares each value's
fingerprints with those of the values within two bits, as blocks: 8 * 137 / 65,536 (1.7 %) of all pairs are
looked at.

Near duplicates are closed transitively into groups (large-star, small-star), of which the first document
by (doc_id, hash of the text) stays. A leaf that holds more than HOME fingerprints on average is split into groups, so a
shard's memory stays as it is when the data grow; queries go to each group.

Defined cases: documents without words (null, empty or blank text) have no fingerprint and always stay;
equal fingerprints are collapsed before the search, so thousands of copies cost one search; null doc_id
sorts first; rows that agree in doc_id and text count as copies, one of which stays; other columns are
passed on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed
from .text import mix, ranges, rows_of, slices, words_of

RADIUS = 23
PARTS = 8
VALUES = 1 << 16
HOME = 500_000
PUNCTUATION = ".,;:!?\"'()[]«»¿¡“”„‘’…–—"  # of sentences; symbols such as # or | make another word
EXPAND = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
MASKS = np.array(sorted((1 << a) | (1 << b) for a in range(16) for b in range(a)) + [1 << a for a in range(16)] + [0])


def _words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code of each word's plain form (-1: none), and the lanes of the codes: a byte for each bit."""
    coded = words.dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=PUNCTUATION)
    forms = plain.dictionary_encode()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, forms.dictionary.to_pylist()), np.uint64, len(forms.dictionary))
    octets = np.stack([h, mix(h + np.uint64(0x9E3779B97F4A7C15))], axis=1).view(np.uint8)
    code = forms.indices.to_numpy().astype(np.int64)
    code[pc.equal(plain, "").to_numpy(zero_copy_only=False)] = -1
    return code[coded.indices.to_numpy()], EXPAND[octets]


def fingerprints(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have words, and the two 64-bit halves of their fingerprints."""
    words, offsets = words_of(text)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    code, lanes = _words(words)
    row = rows_of(offsets)
    bare = np.bincount(row[code >= 0], minlength=len(text)) == 0  # only punctuation: its words as they are
    if (bare[row]).any():
        raw = words.dictionary_encode()
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, raw.dictionary.to_pylist()), np.uint64, len(raw.dictionary))
        octets = np.stack([h, mix(h + np.uint64(0x9E3779B97F4A7C15))], axis=1).view(np.uint8)
        code = np.where(bare[row], raw.indices.to_numpy() + len(lanes), code)
        lanes = np.concatenate([lanes, EXPAND[octets]])
    seen = np.unique((row * len(lanes) + code)[code >= 0])
    row, code = seen // len(lanes), seen % len(lanes)
    rows, first, n = np.unique(row, return_index=True, return_counts=True)
    block = np.flatnonzero((np.arange(len(row)) - np.repeat(first, n)) % 255 == 0)  # a byte holds 255
    sums = np.add.reduceat(lanes[code], block, axis=0).view(np.uint8)
    ones = np.add.reduceat(sums, np.searchsorted(block, first), axis=0, dtype=np.int32)
    return rows, np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64)


def keyed(docs: DataFrame) -> DataFrame:
    """The key (k_id, k_text) of a document, and its text."""
    return docs.select(F.col("doc_id").cast("long").alias("k_id"), F.xxhash64("text").alias("k_text"), "text")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """k_id, k_text, f0, f1 of the documents with words."""

    def run(batches):
        for batch in slices(batches, limit=2 << 20):
            rows, f = fingerprints(batch.column(batch.schema.get_field_index("text")))
            ids = [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows)) for c in ("k_id", "k_text")]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(np.ascontiguousarray(f[:, i]).view(np.int64)) for i in (0, 1))], names=["k_id", "k_text", "f0", "f1"])

    return docs.mapInArrow(run, "k_id long, k_text long, f0 long, f1 long")


class Tree:
    """A vantage-point tree over all 16-bit values: home leaf and, for a ball, the leaves that it overlaps."""

    def __init__(self, depth: int, radius: int = 2, seed: int = 7):
        rng = np.random.default_rng(seed)
        values = np.arange(VALUES)
        self.home = np.zeros(VALUES, np.int64)
        self.visits = np.zeros((VALUES, 1 << depth), bool)

        def split(inside: np.ndarray, ball: np.ndarray, leaf: int, level: int) -> None:
            if level == depth:
                self.home[inside] = leaf
                self.visits[ball, leaf] = True
                return
            best = None
            for point in rng.choice(inside, min(8, len(inside)), replace=False):  # the most even split of eight
                d = np.bitwise_count(inside ^ point)
                mu = int(np.median(d))
                for m in (mu - 1, mu):
                    share = abs(np.mean(d <= m) - 0.5)
                    if best is None or share < best[0]:
                        best = (share, point, m)
            _, point, mu = best
            near, far = np.bitwise_count(inside ^ point), np.bitwise_count(ball ^ point).astype(np.int64)
            split(inside[near <= mu], ball[far - radius <= mu], leaf * 2, level + 1)
            split(inside[near > mu], ball[far + radius > mu], leaf * 2 + 1, level + 1)

        split(values, values, 0, 0)


def _part(f: np.ndarray, t: int) -> np.ndarray:
    return ((f[:, t // 4] >> np.uint64(16 * (t % 4))) & np.uint64(0xFFFF)).astype(np.int64)


def _halves(batch) -> np.ndarray:
    return np.stack([batch.column("f0").to_numpy(), batch.column("f1").to_numpy()], axis=1).view(np.uint64)


def _group(f: np.ndarray, groups: int) -> np.ndarray:
    return (mix(f[:, 0] ^ mix(f[:, 1])) % np.uint64(groups)).astype(np.int64)


def shard_pairs(f: np.ndarray, t: int, leaf: int, tree: Tree, radius: int, group: int = 0, groups: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (row, row, distance) of this shard, of a query and a fingerprint that lives in the leaf and the group, that no other shard reports."""
    part = _part(f, t)
    order = np.argsort(part, kind="stable")
    f, part = f[order], part[order]
    f0, f1 = np.ascontiguousarray(f[:, 0]), np.ascontiguousarray(f[:, 1])
    first = np.searchsorted(part, np.arange(VALUES + 1))
    own = np.flatnonzero((tree.home[part] == leaf) & (_group(f, groups) == group))
    h0, h1 = f0[own], f1[own]
    h_first = np.searchsorted(part[own], np.arange(VALUES + 1))
    h_count = np.diff(h_first)
    left, right, far = [], [], []
    for v in np.flatnonzero(np.diff(first)):
        near = v ^ MASKS
        near = near[h_count[near] > 0]
        if tree.home[v] == leaf:
            near = near[near >= v]  # within the leaf, each pair from its lesser value
        if not len(near):
            continue
        c, _ = ranges(h_first[near], h_first[near + 1])
        step = max(1, (1 << 20) // len(c))
        for q0 in range(first[v], first[v + 1], step):
            q = np.arange(q0, min(q0 + step, first[v + 1]))
            d = np.bitwise_count(f0[q][:, None] ^ h0[c]) + np.bitwise_count(f1[q][:, None] ^ h1[c])
            i, j = np.nonzero(d <= radius)
            if len(i):
                a, b = q[i], own[c[j]]
                once = (part[a] != part[b]) | (f0[a] < f0[b]) | ((f0[a] == f0[b]) & (f1[a] < f1[b]))
                left.append(a[once])
                right.append(b[once])
                far.append(d[i, j][once])
    if not left:
        return (np.zeros(0, np.int64),) * 3
    a, b, d = np.concatenate(left), np.concatenate(right), np.concatenate(far)
    mine = np.ones(len(a), bool)
    for s in range(t):  # an earlier tree saw it
        mine &= np.bitwise_count(_part(f[a], s) ^ _part(f[b], s)) > 2
    return order[a[mine]], order[b[mine]], d[mine]


def pairs(distinct: DataFrame, radius: int = RADIUS, depth: int | None = None, home: int = HOME) -> DataFrame:
    """All pairs of these distinct fingerprints (f0, f1) within the radius: a0, a1, b0, b1, distance.

    A leaf of more than ``home`` fingerprints (by the average) is split into groups; queries go to each of them.
    """
    if radius >= 3 * PARTS:
        raise ValueError("the parts bound the radius to 23")
    if depth is None:  # as many shards as the session has shuffle partitions; any depth gives the same pairs
        depth = min(8, max(3, math.ceil(math.log2(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")) / PARTS))))
    groups = max(1, math.ceil(distinct.count() / (home << depth)))

    def route(batches):
        tree = Tree(depth)
        for batch in batches:
            f = _halves(batch)
            for t in range(PARTS):
                part = _part(f, t)
                row, leaf = np.nonzero(tree.visits[part])
                keep = leaf >= tree.home[part[row]]
                row, leaf = row[keep], leaf[keep]
                at = pa.array(row)
                for g in range(groups):
                    shard = ((t << depth) + leaf.astype(np.int64)) * groups + g
                    yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("f0").take(at), batch.column("f1").take(at)], names=["shard", "f0", "f1"])

    def search(table: pa.Table) -> pa.Table:
        shard, group = divmod(table.column("shard")[0].as_py(), groups)
        f = np.ascontiguousarray(_halves(table))
        a, b, d = shard_pairs(f, shard >> depth, shard & ((1 << depth) - 1), Tree(depth), radius, group, groups)
        signed = f.view(np.int64)
        return pa.table({"a0": signed[a, 0], "a1": signed[a, 1], "b0": signed[b, 0], "b1": signed[b, 1], "distance": d.astype(np.int32)})

    sent = distinct.select("f0", "f1").mapInArrow(route, "shard long, f0 long, f1 long")
    return sent.groupBy("shard").applyInArrow(search, "a0 long, a1 long, b0 long, b1 long, distance int")


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v): each node with the least node of its component (node, root), by large-star and small-star.

    Rounds grow with the logarithm of the longest chain; each is written to the shared folder.
    """
    now = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        w = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = w.select("u", F.col("m").alias("v")).unionByName(w.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = checkpointed(small.distinct())


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """k_id, k_text and the group's first document (g_id, g_text) of each document with words."""
    prints = checkpointed(fingerprinted(keyed(docs)))
    node = lambda x: F.struct(F.col(f"{x}0").alias("f0"), F.col(f"{x}1").alias("f1"))
    found = pairs(checkpointed(prints.select("f0", "f1").distinct()), radius)
    roots = components(found.select(node("a").alias("u"), node("b").alias("v"))).select("node.f0", "node.f1", "root")
    named = prints.join(roots, ["f0", "f1"], "left").withColumn("root", F.coalesce("root", F.struct("f0", "f1")))
    least = F.min(F.struct("k_id", "k_text")).over(Window.partitionBy("root"))
    return named.withColumn("g", least).select("k_id", "k_text", F.col("g.k_id").alias("g_id"), F.col("g.k_text").alias("g_text"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The groups of two documents and more: kept_id, doc_ids (all, sorted), n_docs."""
    members = grouped(docs, radius).groupBy("g_id", "g_text").agg(F.array_sort(F.collect_list("k_id")).alias("doc_ids"), F.count("*").alias("n_docs"))
    return members.filter("n_docs > 1").select(F.col("g_id").alias("kept_id"), "doc_ids", "n_docs")


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each group, all columns as they are."""
    # the key without nulls, so that one shuffle of the texts serves the window and the join
    gone = grouped(docs, radius).filter("NOT (k_id <=> g_id AND k_text = g_text)").select(F.coalesce("k_id", "k_text").alias("k_id"), "k_text").distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, doc_id = (f"c{docs.columns.index(c)}" for c in ("text", "doc_id"))
    rows = docs.toDF(*names).withColumn("i", F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text))).withColumn("k", F.xxhash64(text)).withColumn("h", F.xxhash64(*names))
    first = rows.repartition("i", "k").withColumn("n", F.row_number().over(Window.partitionBy("i", "k").orderBy("h")))
    # rows given twice: one stays, but for rows without words, which all stay
    first = first.filter((F.col("n") == 1) | F.col(text).isNull() | (F.btrim(text, F.lit(" \t\n\r\f\x0b")) == ""))
    kept = first.join(gone, (first["i"] == gone["k_id"]) & (first["k"] == gone["k_text"]), "left_anti")
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
