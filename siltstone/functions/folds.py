"""The splitters that no expression states well: sequential folds, as Arrow-batched Python."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.functions import batches

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def pack(parts: list[str], size: int, carry: int, joiner: str, least_one: bool = False) -> list[str]:
    """Parts packed up to size words; each next chunk begins with trailing parts of up to carry words (or of that number, with least_one)."""
    out, held, total = [], [], 0
    for part in parts:
        n = len(part.split())
        if held and total + n > size:
            out.append(joiner.join(held))
            if least_one:
                held = held[-max(1, carry_count(len(held), carry)) :]
            else:
                kept, left = [], carry
                for p in reversed(held):
                    left -= len(p.split())
                    if left < 0:
                        break
                    kept.insert(0, p)
                held = kept
            total = sum(len(p.split()) for p in held)
        held.append(part)
        total += n
    if held:
        out.append(joiner.join(held))
    return out


def carry_count(n: int, percent: int) -> int:
    return n * percent // 100


def split_markdown(text: str | None, size: int = 500, overlap: float = 0.15) -> list[str]:
    """Chunks along blank lines; a paragraph above size is packed by sentences on its own."""
    out, run = [], []
    for p in (p.strip() for p in re.split(r"\n\s*\n", text or "")):
        if not p:
            continue
        if len(p.split()) <= size:
            run.append(p)
            continue
        out += pack(run, size, int(size * overlap), "\n\n")
        run = []
        sentences = [s for s in (s.strip() for s in _SENTENCE.split(p)) if s]
        out += pack(sentences, size, round(overlap * 100), " ", least_one=True)
    return out + pack(run, size, int(size * overlap), "\n\n")


def markdown_chunks(size: int = 500, overlap: float = 0.15):
    return batches.of_texts(T.ArrayType(T.StringType()), lambda texts: pa.array([split_markdown(t, size, overlap) for t in texts], batches.STRINGS))


def split_plain(text: str | None, size: int = 500, overlap: float = 0.15) -> list[str]:
    """Word windows; see text.plain_chunks()."""
    w, out, at, step = (text or "").split(), [], 0, max(1, int(size * (1 - overlap)))
    while at < len(w):
        out.append(" ".join(w[at : at + size]))
        if at + size >= len(w):
            break
        at += step
    return out


def document_chunks(size: int = 500, overlap: float = 0.15, splitter=split_markdown):
    """Along the structure of the text; by word windows if that fails."""

    def cut(text: str | None) -> list[str]:
        try:
            return splitter(text, size, overlap)
        except Exception:  # noqa: BLE001 any failure of the structured way
            return split_plain(text, size, overlap)

    return batches.of_texts(T.ArrayType(T.StringType()), lambda texts: pa.array([cut(t) for t in texts], batches.STRINGS))


def subtitle_windows(cues: DataFrame, key: str, window: float = 30.0, carry: float = 5.0) -> DataFrame:
    """Cues (key, start, end, text) folded into windows: key, chunk_index, timestamp_start, timestamp_end, content.

    A window begins with its first cue and ends with the first cue that starts after ``window`` seconds; the
    cues that start in its last ``carry`` seconds open the next one too.
    """
    kind = cues.schema[key].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, held = [], []
        for c in pdf.sort_values(["start", "end", "text"]).itertuples():
            if held and c.start > held[0].start + window:
                rows.append(held)
                end = held[0].start + window
                held = [h for h in held if h.start >= end - carry]
            held.append(c)
        if held:
            rows.append(held)
        k = pdf[key].iloc[0]
        return pd.DataFrame({key: [k] * len(rows), "chunk_index": range(len(rows)), "timestamp_start": [r[0].start for r in rows], "timestamp_end": [r[-1].end for r in rows], "content": [" ".join(c.text for c in r) for r in rows]})

    return cues.select(key, "start", "end", "text").groupBy(key).applyInPandas(fold, f"{key} {kind}, chunk_index int, timestamp_start double, timestamp_end double, content string")


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head", "noscript"):
            self.skip += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("p", "div", "article", "section", "table", "ul", "ol", "footer", "nav", "blockquote"):
            self.out.append("\n\n")
        elif tag in ("br", "tr"):
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch(r"h[1-6]|p|div|article|section|table|ul|ol|footer|nav|blockquote", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Markdown()
    p.feed(html)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(p.out))).strip()


html_markdown = batches.of_texts(T.StringType(), lambda texts: pa.array([html_to_markdown(t) for t in texts], pa.string()))
#: Text of bytes; malformed ones become the replacement character.
utf8_text = batches.of_texts(T.StringType(), lambda contents: pa.array([None if b is None else bytes(b).decode("utf-8", "replace") for b in contents], pa.string()))
