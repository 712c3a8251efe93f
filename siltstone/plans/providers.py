"""What models and libraries may stand in for, by name, and what works without any.

The defaults are honest stand-ins, not equals of models: hashed vectors, the first characters as a summary, the context
as the answer. A reader or model that isn't given is left out; nothing answers an error with text.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.images import image_info
from siltstone.functions.text import bucket, hashed_vectors, tokens
from siltstone.operators.catalog import summary_budget

STOP = {"please", "find", "show", "me", "the", "a", "an", "of", "for", "about", "what", "is", "are", "where", "how", "do", "does"}


def hashed_query(records: DataFrame, query: str, dim: int = 64) -> list[float]:
    """The query's vector under the same hashing as hashed_vectors()."""
    row = records.sparkSession.range(1).select(F.transform(tokens(F.lit(query)), lambda t: bucket(t, dim)).alias("b")).first()
    v = [0.0] * dim
    for b in row.b:
        v[b] += 1.0
    norm = sum(x * x for x in v) ** 0.5
    return [x / norm for x in v] if norm else v


def plain_rewriter(query: str, history: list[str]) -> str:
    """Without a model: the query's terms but for filler words; the query itself if nothing is left."""
    kept = [t for t in re.findall(r"[\w'+-]+", query.lower()) if t not in STOP]
    return " ".join(kept) or query


def template_answer(query: str, context: str) -> str:
    """Without a model: the context under the question."""
    return f"Results for: {query}\n\n{context}"


def retried(call: Callable, attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call, tried again after an error, each wait twice the one before; the last error is raised."""

    def run(*args, **kwargs):
        for n in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception:
                if n == attempts - 1:
                    raise
                sleep(wait * 2**n)

    return run


@dataclass
class ChatEngine:
    """A chat model behind one function, generate(prompt) -> text; its errors are raised."""

    generate: Callable[[str], str]
    context_window: int = 0
    model: str = "none"

    def chat(self, messages: list[tuple[str, str]]) -> str:
        """The answer to (role, content) messages."""
        return self.generate("\n".join(f"{role}: {content}" for role, content in messages))

    def rewrite_query(self, query: str, history: list[str]) -> str:
        """A search phrase for the query after the last four messages; the query itself if the model gives none."""
        asked = "\n".join(history[-4:])
        return self.generate(f"History:\n{asked}\n\nGive a short search phrase for: {query}").strip() or query

    def summarize_document(self, text: str) -> str:
        return self.generate(f"Summarise in a few sentences:\n\n{text[: self.summary_chars()]}").strip()

    def summary_chars(self) -> int:
        return summary_budget(self.context_window)

    def answer(self, query: str, context: str) -> str:
        return self.generate(f"Answer from these numbered excerpts only.\n\n{context}\n\nQuestion: {query}")


@dataclass
class EmbeddingEngine:
    """An embedding model behind a function of a list of texts; images by their own function, or by caption and text."""

    embed: Callable[[list[str]], list[list[float]]]
    dimension: int
    image: Callable[[bytes], list[float]] | None = None
    caption: Callable[[bytes], str] | None = None
    batch: int = 64

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        return [v for a in range(0, len(texts), self.batch) for v in self.embed(texts[a : a + self.batch])]

    def embed_text(self, text: str) -> list[float]:
        return self.embed_texts([text])[0]

    def embed_image(self, content: bytes) -> list[float]:
        if self.image:
            return self.image(content)
        if self.caption:
            return self.embed_text(self.caption(content))
        raise ValueError("this engine has no way to embed images")

    def embed_image_from_path(self, path: str) -> list[float]:
        with open(path, "rb") as f:
            return self.embed_image(f.read())

    def rows(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """key and vector, a batch of texts at a call."""
        engine = self

        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(engine.embed_texts(texts.fillna("").tolist()))

        return rows.select(key, run(text).alias("vector"))


@dataclass
class Providers:
    embed_query: Callable[[DataFrame, str], list[float]] = hashed_query
    embed_rows: Callable[[DataFrame, str, str], DataFrame] = hashed_vectors
    rewrite: Callable[[str, list[str]], str] = plain_rewriter
    answer: Callable[[str, str], str] = template_answer
    summarise: Callable = field(default=lambda text: F.substring(text, 1, 200))
    summary_chars: int | None = None
    scorer: Callable[[str], Callable[[DataFrame], DataFrame]] | None = None
    parse: Callable[[str, bytes], str | None] | None = None
    ocr_pages: Callable[[bytes], list[str]] | None = None
    transcribe: Callable[[str, bytes], list[tuple[float, float, str]]] | None = None
    probe: Callable[[str, bytes], dict] | None = None
    embedded_subtitles: Callable[[str, bytes], str | None] | None = None
    image_info: Callable[[bytes], dict] = image_info
    ocr: Callable[[bytes], str] | None = None
    has_text: Callable[[bytes], bool] | None = None


def of_models(chat: ChatEngine | None = None, embedding: EmbeddingEngine | None = None, base: Providers | None = None) -> Providers:
    """Providers in which these models stand in; the rest as in base."""
    p = base or Providers()
    if chat:

        @F.udf("string")
        def summarise(text):
            return chat.summarize_document(text)

        p = replace(p, rewrite=chat.rewrite_query, answer=chat.answer, summarise=summarise, summary_chars=chat.summary_chars())
    if embedding:
        p = replace(p, embed_query=lambda _, query: embedding.embed_text(query), embed_rows=embedding.rows)
    return p


#: Backends by mode; register() adds more.
BACKENDS: dict[str, Callable[..., Providers]] = {"offline": Providers}


def register(mode: str, make: Callable[..., Providers]) -> None:
    BACKENDS[mode] = make


def providers(mode: str = "offline", **settings) -> Providers:
    """The providers of a registered mode."""
    if mode not in BACKENDS:
        raise ValueError(f"no backend of this name: {mode}; there are {', '.join(sorted(BACKENDS))}")
    return BACKENDS[mode](**settings)
