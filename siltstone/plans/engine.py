"""The search façade: retrieval, the relevance gate with its retries, the answer, the tools; and ingestion."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import hashed_vector, hashed_vectors
from siltstone.operators import catalog, media, search
from siltstone.plans.providers import Providers, hashed_query, plain_rewriter, template_answer
from siltstone.schema import Settings

__all__ = ["Engine", "Providers", "Response", "build_records", "hashed_query", "ingest", "plain_rewriter", "register_functions", "template_answer"]
NOTHING = "No sufficiently relevant content was found in the index."


@dataclass
class Response:
    query: str
    rewritten: str
    results: DataFrame
    groups: DataFrame
    verdict: str
    answer: str
    retries: int
    total_time_ms: float


@dataclass
class Engine:
    records: DataFrame
    settings: Settings = field(default_factory=Settings)
    providers: Providers = field(default_factory=Providers)

    def retrieve(self, query: str, mode: str = "hybrid", k: int | None = None, **limits) -> tuple[DataFrame, DataFrame]:
        """Hits (record columns, score, rank) and file groups. mode: chunk, summary, or anything else for hybrid."""
        s, r = self.settings, self.records
        k = max(1, min(50, k or s.top_k))
        v = self.providers.embed_query(r, query)
        rerank = None
        if self.providers.scorer:
            score = self.providers.scorer(query)
            rerank = lambda pool: score(pool if "content" in pool.columns else pool.join(r.select("id", "content"), "id"))
        if mode == "summary":
            return search.summary_search(r, v, k, rerank, s, **limits)
        chunks = search.cosine_topk(r, v, max(5 * k, 25), record_types=["chunk"], **limits)
        summaries = search.cosine_topk(r, v, k, record_types=["summary"], **limits)
        groups = search.file_groups(summaries, chunks, s.max_groups, s.chunks_per_group)
        if mode == "chunk":
            return search.top(chunks.drop("rank"), k), groups
        ranked = search.hybrid(r, query, v, s, k, rerank, **limits).select("id", "score", "rank")
        return r.join(F.broadcast(ranked), "id").orderBy("rank"), groups  # at most k rows

    def search(self, query: str, history: list[str] | None = None, mode: str = "hybrid", k: int | None = None, **limits) -> Response:
        """Rewrite, retrieve, gate; retry up to max_retries while the rewriter gives something new; then the answer. Errors are raised.

        The k hits are fetched once for the gate, the context and the result.
        """
        began, verdict, tried = time.perf_counter(), "fail", set()
        asked = (history or [])[-self.settings.history :]
        for attempt in range(self.settings.max_retries + 1):
            rewritten = self.providers.rewrite(query, asked)
            if rewritten in tried:  # the same query has the same hits
                attempt -= 1
                break
            tried.add(rewritten)
            found, groups = self.retrieve(rewritten, mode, k, **limits)
            hits = found.sparkSession.createDataFrame(found.collect(), found.schema)  # at most 50 rows
            verdict = search.gate(hits, self.settings.relevance_threshold).first().verdict
            if verdict == "pass":
                break
        answer = self.providers.answer(query, search.full_context(hits, groups)) if verdict == "pass" else NOTHING
        return Response(query, rewritten, hits.orderBy("rank"), groups, verdict if verdict == "pass" else "exhausted", answer, attempt, (time.perf_counter() - began) * 1000)

    def find_documents(self, query: str, k: int = 10, **limits) -> DataFrame:
        return self.retrieve(query, "summary", k, **limits)[1]

    def query_hint(self, vector: list[float], **limits) -> str | None:
        """The content of the chunk nearest to a vector."""
        return search.query_hint(search.cosine_topk(self.records, vector, 1, record_types=["chunk"], **limits)).first().hint

    def tools(self) -> dict[str, Callable[..., str]]:
        """The tools by name; each returns text, tables as JSON."""
        return {
            "semantic_search": lambda query, **how: self.search(query, **how).answer,
            "find_documents": lambda description, k=10, **limits: search.group_lines(self.find_documents(description, max(1, min(50, k)), **limits)).first().text or "No document matches this description.",
            "list_indexed_folders": lambda: search.as_json(self.folders(), "parent_directory").first().json,
            "get_file_chunks": lambda path: search.as_json(self.file_chunks(path).select(*search.CHUNK_VIEW), *search.CHUNK_VIEW).first().json,
            "get_indexing_status": lambda: json.dumps({r.name: r.value for r in self.status().collect()}, indent=2),
        }

    def folders(self) -> DataFrame:
        return catalog.folders(self.records)

    def file_chunks(self, path: str) -> DataFrame:
        return catalog.file_chunks(self.records, path)

    def status(self) -> DataFrame:
        return catalog.stats(self.records)


def build_records(files: DataFrame, settings: Settings = Settings(), providers: Providers | None = None, copies: bool = False) -> DataFrame:
    """Files to records: chunks by the kind of file, summaries and vectors. Of equal contents one file counts, unless copies.

    Content as bytes, as scans give it, goes to the reader of its type; content as text is taken as a document's.
    """
    p = providers or Providers()
    as_bytes = dict(files.dtypes)["content"] == "binary"
    files = media.expanded(files) if as_bytes else files
    files = files if copies else catalog.first_copies(files)
    if as_bytes:
        chunks = media.routed(files, settings, p)
    else:
        chunks = catalog.structured_chunks(files, settings.chunk_words, settings.chunk_overlap)
    chunks = chunks.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    rows = chunks
    if settings.summaries:
        summaries = catalog.summary_records(chunks, p.summarise, p.summary_chars or settings.summary_chars)
        rows = rows.unionByName(summaries.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")), allowMissingColumns=True)
    embedded = rows.join(p.embed_rows(rows.select("id", "content"), "id", "content"), "id") if p.embed_rows is not hashed_vectors else rows.withColumn("vector", hashed_vector()("content"))
    return catalog.as_records(embedded.filter(F.size("vector") > 0))  # records without a vector can't be found


def ingest(table: catalog.Catalog, files: DataFrame, settings: Settings = Settings(), providers: Providers | None = None) -> int:
    """Adds the files whose content the table hasn't, in place of their paths' old records. Returns the number of new records.

    The new records are worked out once, as they are written; work and files follow the change, not the table.
    """
    files = media.expanded(files) if dict(files.dtypes)["content"] == "binary" else files
    new = catalog.needs_reindex(files, table.records())
    if new.isEmpty():
        return 0
    return table.replace_paths(catalog.first_copies(new), build_records(new, settings, providers))


def register_functions(spark: SparkSession) -> None:
    """Table functions for SQL: chunk_text(text, size, overlap), parse_subtitles(text, kind), clip_windows(duration, length, overlap)."""
    from siltstone.functions import tables

    for name in ("chunk_text", "parse_subtitles", "clip_windows"):
        spark.udtf.register(name, getattr(tables, name))
