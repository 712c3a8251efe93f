"""Ranking: cosine, BM25, reciprocal-rank fusion, groups by file, re-ranking, the relevance gate.

Scores are rounded to six places before they rank, so that equal scores tie everywhere; ties go to the
smaller id. Query sides (a vector, a few terms) are literals; corpora are never collected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import batches
from siltstone.functions.batches import TERM
from siltstone.functions.text import exploded, in_folder, tokens
from siltstone.operators.catalog import written
from siltstone.schema import Settings


def filtered(records: DataFrame, folder: str | None = None, file_type: str | None = None, record_types: list[str] | None = None, prefix_compat: bool = False) -> DataFrame:
    """Records within all of the given limits; None: no limit, an empty list: nothing. Pushed down to the scan."""
    limits: list[Column] = []
    if folder is not None:
        limits.append(in_folder("parent_directory", folder, prefix_compat))
    if file_type is not None:
        limits.append(F.col("file_type") == file_type)
    if record_types is not None:
        limits.append(F.coalesce("record_type", F.lit("chunk")).isin(record_types) if record_types else F.lit(False))
    return records.filter(reduce(lambda a, b: a & b, limits)) if limits else records


def parsed_vector(text: Column | str) -> Column:
    """The vector of a text such as [1, 2.5]; null if it isn't one."""
    return F.from_json(text, "array<double>")


def cosine(vector: Column | str, query: list[float]) -> Column:
    """Cosine similarity clamped to 0..1, in doubles; null for vectors that are null, zero or of another length."""
    v = F.col(vector) if isinstance(vector, str) else vector
    q = F.array(*(F.lit(float(x)) for x in query))
    q_norm = sum(float(x) ** 2 for x in query) ** 0.5
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / (norm * F.lit(q_norm)))), 6)
    return F.when((F.size(v) == len(query)) & (norm > 0) & F.lit(q_norm > 0), score)


def top(rows: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The k best with rank from 1: a top-k per task, then the window over k rows only."""
    best = rows.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def cosine_topk(records: DataFrame, query: list[float], k: int = 10, key: str = "id", vector: str = "vector", **limits) -> DataFrame:
    scored = filtered(records, **limits).withColumn("score", cosine(vector, query)).filter("score IS NOT NULL")
    return top(scored, k, key=key)


def _times(terms: str, term: str) -> Column:
    return F.size(F.filter(terms, lambda x: x == F.lit(term)))


def _scored(counts: DataFrame, stats: DataFrame, multiples: list[int], k1: float, b: float) -> DataFrame:
    """counts (_n, _f0, ...) with ``score``; stats: one row of _docs, _mean, _d0, ..."""
    joined = counts.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, m in enumerate(multiples):
        idf = F.ln((F.col("_docs") + 1) / (m * F.col(f"_d{i}") + 0.5))
        tf = F.col(f"_f{i}")
        part = m * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.greatest("_n", F.lit(1)) / F.greatest("_mean", F.lit(1e-9))))
        score = score + F.when(tf > 0, part).otherwise(F.lit(0.0))
    return joined.withColumn("score", F.round(score, 6))


def _statistics(counts: DataFrame, n: int) -> DataFrame:
    return counts.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_mean"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(n)))


def term_counts(terms: list[str], stem: bool = False):
    """A column function: from a text the number of its terms, and of each of these, as an array (in Arrow batches: one scan of a text for all terms)."""
    stems = batches.Known(lambda t: stemmed(t.lower())) if stem else None
    return batches.of_texts("array<int>", lambda texts: batches.counts(texts, terms, stems))


def bm25(records: DataFrame, terms: list[str], key: str = "id", text: str = "content", k1: float = 1.2, b: float = 0.75, stem: bool = False) -> DataFrame:
    """key and ``score``, zero for records without a hit. A term asked m times counts m times, in df as well.

    Document frequencies, their number and mean length are those of the records given, by map-side sums; no term is
    shuffled. The counts, a few numbers a record, are stored, so texts are read and cut into terms once.
    """
    asked = sorted(Counter(stemmed(t) if stem else t for t in terms).items())
    counts = records.select(key, term_counts([w for w, _ in asked], stem)(F.coalesce(text, F.lit(""))).alias("_c"))
    counts = written(counts.select(key, F.col("_c")[0].alias("_n"), *(F.col("_c")[i + 1].alias(f"_f{i}") for i in range(len(asked)))))
    return _scored(counts, _statistics(counts, len(asked)), [m for _, m in asked], k1, b)


def query_terms(query: str | list[str]) -> list[str]:
    return query if isinstance(query, list) else [m.lower() for m in TERM.findall(query)]


def _best(scored: DataFrame, terms: list[str], k: int, key: str, conjunctive: bool) -> DataFrame:
    """key, score, rank: the k best with a positive score, normalised to a best of 1."""
    if conjunctive:
        scored = scored.filter(reduce(lambda a, b: a & b, (F.col(f"_f{i}") > 0 for i in range(len(set(terms))))))
    best = top(scored.select(key, "score"), k, key=key).filter("score > 0")
    return best.withColumn("score", F.round(F.col("score") / F.max("score").over(Window.partitionBy()), 6))


def bm25_ranked(records: DataFrame, query: str | list[str], k: int = 10, key: str = "id", text: str = "content", conjunctive: bool = False, stem: bool = False, **limits) -> DataFrame:
    """key, score, rank: the k best by BM25 among those with a positive score, normalised to a best of 1. stem: English endings don't count."""
    terms = query_terms(query)
    rows = filtered(records, **limits)
    if not terms:
        return top(rows.select(key, F.lit(0.0).alias("score")).filter(F.lit(False)), k, key=key)
    own = sorted({stemmed(t) for t in terms}) if stem else terms
    return _best(bm25(rows, terms, key, text, stem=stem), own, k, key, conjunctive)


def bm25_topk(records: DataFrame, query: str | list[str], k: int = 10, key: str = "id", **how) -> DataFrame:
    """The records of bm25_ranked(), with its score and rank."""
    return records.join(F.broadcast(bm25_ranked(records, query, k, key, **how)), key)  # at most k rows


class Postings:
    """A stored index of terms: by bucket of the term the records that hold it, and the records' lengths and limits.

    A query reads the buckets of its terms only (a partition each, with the term pushed to the scan), and the lengths.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def build(cls, records: DataFrame, root: str, key: str = "id", text: str = "content") -> Postings:
        """Writes the index of these records to a new folder."""
        limits = [c for c in ("parent_directory", "file_type", "record_type") if c in records.columns]
        found = records.select(key, *limits, term_frequencies(F.coalesce(text, F.lit(""))).alias("_t"))
        n = F.aggregate(F.map_values("_t"), F.lit(0), lambda a, x: a + x)
        found.select(F.col(key).alias("id"), *limits, n.alias("_n")).write.parquet(f"{root}/lengths")
        terms = exploded(found.select(F.col(key).alias("id"), "_t"), "_t", "term", "tf")
        terms = terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(cls.BUCKETS)).cast("int"))
        terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{root}/terms")
        return cls(records.sparkSession, root)

    def top(self, query: str | list[str], k: int = 10, conjunctive: bool = False, **limits) -> DataFrame:
        """id, score, rank: as bm25_topk() over the indexed records within these limits."""
        terms = query_terms(query)
        asked = sorted(Counter(terms).items())
        lengths = filtered(self.spark.read.parquet(f"{self.root}/lengths"), **limits)
        if not asked:
            return top(lengths.select("id", F.lit(0.0).alias("score")).filter(F.lit(False)), k)
        words = [w for w, _ in asked]
        buckets = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(F.pmod(F.xxhash64("w"), F.lit(self.BUCKETS)).cast("int")).collect()]
        hits = self.spark.read.parquet(f"{self.root}/terms").filter(F.col("bucket").isin(buckets) & F.col("term").isin(words))
        tf = hits.groupBy("id").agg(*(F.coalesce(F.max(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"_f{i}") for i, w in enumerate(words)))
        counts = lengths.join(tf, "id", "left").na.fill(0, [f"_f{i}" for i in range(len(words))])
        return _best(_scored(counts, _statistics(counts, len(words)), [m for _, m in asked], 1.2, 0.75), words, k, "id", conjunctive)


#: How often each term of a text occurs in it: a column function.
term_frequencies = batches.of_texts(T.MapType(T.StringType(), T.IntegerType()), batches.frequencies, batches.SLICE // 4)  # a table of terms a text takes more than the text


_ENDINGS = (("sses", "ss"), ("ies", "i"), ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("ingly", ""), ("edly", ""), ("ing", ""), ("ed", ""), ("ly", ""), ("s", ""))


def stemmed(term: str) -> str:
    """The term without a common English ending: light, and for matching only."""
    for end, put in _ENDINGS:
        if term.endswith(end) and not (end == "s" and term.endswith(("ss", "us", "is"))):
            stem = term[: len(term) - len(end)] + put
            if len(stem) >= 3 and any(c in "aeiouy" for c in stem):
                if end in ("ing", "ed") and len(stem) > 3 and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                    stem = stem[:-1]
                return stem
    return term


def cover_density(terms: list[str]):
    """A column function: the sum, over the shortest stretches of a text that hold all the terms, of 1 / the stretch's length beyond them.

    A stretch that is exactly the terms counts 1; longer ones count less; texts without all terms score 0.
    """
    asked, known = frozenset(stemmed(t) for t in terms), batches.Known(lambda t: stemmed(t.lower()))

    def each(texts: list) -> pa.Array:
        known.bounded()
        return pa.array([_density([known[t] for t in TERM.findall(text or "")], asked) for text in texts], pa.float64())

    return batches.of_texts("double", each)


def _density(words: list[str], asked: frozenset[str]) -> float:
    last, total, left = {}, 0.0, -1
    for i, w in enumerate(words):
        if w in asked:
            last[w] = i
            if len(last) == len(asked):
                begin = min(last.values())
                if begin > left:  # a stretch that holds no other
                    total += 1.0 / (1 + i - begin + 1 - len(asked))
                    left = begin
    return round(total, 6)


def cover_topk(records: DataFrame, query: str, k: int = 10, key: str = "id", text: str = "content", **limits) -> DataFrame:
    """The k best by cover density of stemmed terms, all of which must occur; normalised to a best of 1."""
    terms = query_terms(query)
    rows = filtered(records, **limits)
    if not terms:
        return top(rows.withColumn("score", F.lit(0.0)).filter(F.lit(False)), k, key=key)
    best = top(rows.select(key, cover_density(terms)(F.coalesce(text, F.lit(""))).alias("score")).filter("score > 0"), k, key=key)
    return rows.join(F.broadcast(best.withColumn("score", F.round(F.col("score") / F.max("score").over(Window.partitionBy()), 6))), key)  # at most k rows


def summary_search(records: DataFrame, vector: list[float], k: int = 10, rerank: Callable[[DataFrame], DataFrame] | None = None, settings: Settings = Settings(), **limits) -> tuple[DataFrame, DataFrame]:
    """Summaries nearest to the vector, re-ranked if told, and their file groups. Without any, both are empty."""
    pool = cosine_topk(records, vector, max(k, settings.rerank_top_n) if rerank else k, record_types=["summary"], **limits)
    hits = top(rerank(pool.drop("rank")), k) if rerank else pool
    chunks = cosine_topk(records, vector, max(5 * k, 25), record_types=["chunk"], **limits)
    return hits, file_groups(hits, chunks, settings.max_groups, settings.chunks_per_group)


def query_hint(chunks: DataFrame) -> DataFrame:
    """One row, ``hint``: the content of the best chunk, for a re-ranker when only a vector is known."""
    return chunks.agg(F.max_by("content", F.struct("score", -F.col("rank"))).alias("hint"))


def result_cards(hits: DataFrame) -> DataFrame:
    """What a result list shows: rank, percent (of the score), filename, path and content."""
    return hits.select("rank", F.floor(F.round(F.col("score") * 100, 6)).cast("int").alias("percent"), "filename", "absolute_path", "content")


def fused(lists: list[DataFrame], k: int = 60, key: str = "id") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (key, score, rank): key, rrf, score (of the first list that has it), first_list, first_rank."""
    rows = reduce(DataFrame.unionByName, (x.select(key, "score", "rank", F.lit(i + 1).alias("list")) for i, x in enumerate(lists)))
    place = F.struct("list", "rank", "score")
    out = rows.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), F.min(place).alias("p"))
    return out.select(key, "rrf", F.col("p.score").alias("score"), F.col("p.list").alias("first_list"), F.col("p.rank").alias("first_rank"))


def fused_order(key: str = "id") -> list[Column]:
    return [F.desc("rrf"), F.col("first_list"), F.col("first_rank"), F.col(key)]


def hybrid(records: DataFrame, query: str, vector: list[float], settings: Settings = Settings(), top_k: int | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, **limits) -> DataFrame:
    """id, score, rank (and rrf): vector, lexical and summary lists fused; ``rerank`` rescoring the pool if given."""
    k = top_k or settings.top_k
    chunks = cosine_topk(records, vector, max(5 * k, 25), record_types=["chunk"], **limits).select("id", "score", F.lit(1).alias("kind"))
    summaries = cosine_topk(records, vector, k, record_types=["summary"], **limits)
    by_vector = chunks.unionByName(summaries.select("id", "score", F.lit(2).alias("kind")))
    by_vector = by_vector.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "kind", "id")))
    lexical = bm25_ranked(records, query, max(10 * k, 100), **limits)
    pool = fused([by_vector, lexical, summaries], settings.rrf_k).orderBy(*fused_order())
    pool = pool.limit(max(k, settings.rerank_top_n) if rerank else k)
    if rerank:
        return top(rerank(pool), k)
    return pool.withColumn("rank", F.row_number().over(Window.orderBy(*fused_order()))).select("id", "score", "rrf", "rank")


def file_groups(summaries: DataFrame, chunks: DataFrame, groups: int = 10, each: int = 3) -> DataFrame:
    """summaries and chunks are ranked hits with their record's columns: one row a file, in summary order, with its best chunks."""
    first = summaries.withColumn("n", F.row_number().over(Window.partitionBy("absolute_path").orderBy("rank"))).filter("n = 1")
    own = chunks.withColumn("n", F.row_number().over(Window.partitionBy("absolute_path").orderBy("rank"))).filter(F.col("n") <= each)
    lists = own.groupBy("absolute_path").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("chunk_results"))
    named = first.select("absolute_path", "filename", "file_type", F.coalesce(F.nullif("summary", F.lit("")), "content").alias("summary"), F.col("score").alias("best_score"), F.col("rank").alias("summary_rank"))
    return named.orderBy("summary_rank").limit(groups).join(lists, "absolute_path", "left").orderBy("summary_rank")


def overlap_scorer(query: str) -> Callable[[DataFrame], DataFrame]:
    """A re-ranker without a model: the share of the query's distinct terms that a record's content has."""

    def run(pool: DataFrame) -> DataFrame:
        q = F.array_distinct(tokens(F.lit(query)))
        return pool.withColumn("rerank_score", F.round(F.size(F.array_intersect(F.array_distinct(tokens("content")), q)) / F.greatest(F.size(q), F.lit(1)), 6)).withColumn("score", F.col("rerank_score"))

    return run


def gate(hits: DataFrame, threshold: float = 0.65) -> DataFrame:
    """best_score and verdict (pass or fail) of a list of hits; no hits: fail with null."""
    return hits.agg(F.max("score").alias("best_score")).withColumn("verdict", F.when(F.col("best_score") >= threshold, "pass").otherwise("fail"))


def context_blocks(hits: DataFrame) -> DataFrame:
    """One row, ``context``: numbered blocks of the hits (rank, filename, record_type, times, content) in order. Hits without columns of times have no times."""
    hits = hits.withColumns({c: F.lit(None).cast("double") for c in ("timestamp_start", "timestamp_end") if c not in hits.columns})
    time = F.when(F.col("timestamp_start").isNotNull(), F.format_string(" [Time: %.1f - %.1f]", "timestamp_start", F.coalesce("timestamp_end", "timestamp_start"))).otherwise(F.lit(""))
    label = F.when(F.col("record_type") == "summary", F.lit("Summary")).otherwise(F.lit("Excerpt"))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), label, F.lit(" of "), F.col("filename"), time, F.lit("\n"), F.col("content"))
    parts = hits.select(F.struct(F.col("rank"), block.alias("b")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("l"))
    return parts.select(F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("context"))


def full_context(hits: DataFrame, groups: DataFrame) -> str:
    """The context for an answer: the files with their summaries, then the numbered blocks."""
    files = group_lines(groups).first().text
    blocks = context_blocks(hits).first().context
    return f"Matching files:\n{files}\n\n{blocks}" if files else blocks


def group_lines(groups: DataFrame) -> DataFrame:
    """One row, ``text``: the file groups in order, each with its score, path and summary; empty without any."""
    line = F.format_string("- %s (score %.2f)\n  %s\n  %s", "filename", "best_score", "absolute_path", F.coalesce("summary", F.lit("")))
    rows = groups.select(F.struct("summary_rank", line.alias("l")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("a"))
    return rows.select(F.array_join(F.transform("a", lambda x: x["l"]), "\n").alias("text"))


CHUNK_VIEW = ("chunk_index", "total_chunks", "content", "timestamp_start", "timestamp_end")


def as_json(rows: DataFrame, *columns: str) -> DataFrame:
    """One row, ``json``: the rows, in the order of these columns, as a JSON array; of one column its values, of several objects. Nulls stay."""
    order = F.struct(*(F.col(c) for c in columns))
    every = rows.agg(F.array_sort(F.collect_list(order)).alias("a"))
    value = F.transform("a", lambda x: x[columns[0]]) if len(columns) == 1 else F.col("a")
    return every.select(F.to_json(value, {"ignoreNullFields": "false"}).alias("json"))


def lsh_topk(records: DataFrame, query: list[float], k: int = 10, key: str = "id", vector: str = "vector", tables: int = 16, width: float = 1.5) -> DataFrame:
    """Approximate: random-projection buckets over unit vectors, candidates re-scored exactly."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = records.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", numHashTables=tables, bucketLength=width, seed=7).fit(rows)
    found = model.approxNearestNeighbors(rows, Vectors.dense([float(x) for x in query]), 5 * k)
    return top(found.select(*records.columns).withColumn("score", cosine(vector, query)), k, key=key)
