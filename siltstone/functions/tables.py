"""Table functions for SQL: each makes rows of one value."""

from __future__ import annotations

import re

from pyspark.sql.functions import udtf

from siltstone.functions.folds import split_markdown

_TIMES = {"srt": r"(\d{2}:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[,.]\d{3})", "vtt": r"((?:\d{2}:)?\d{2}:\d{2}\.\d{3})\s*-->\s*((?:\d{2}:)?\d{2}:\d{2}\.\d{3})"}


def _seconds(code: str) -> float:
    *rest, milli = re.split(r"[:.,]", code)
    total = 0.0
    for part in rest:
        total = total * 60 + int(part)
    return total + int(milli) / 1000


@udtf(returnType="chunk_index int, content string")
class chunk_text:  # noqa: N801 the name in SQL
    def eval(self, text: str, size: int, overlap: float):
        yield from enumerate(split_markdown(text, size, float(overlap)))


@udtf(returnType="cue_start double, cue_end double, text string")
class parse_subtitles:  # noqa: N801
    def eval(self, text: str, kind: str):
        for block in re.split(r"\n\s*\n", (text or "").replace("\r", "").strip()):
            lines = block.split("\n")
            for k, line in enumerate(lines):
                found = re.search(_TIMES[kind], line)
                if found:
                    said = " ".join(lines[k + 1 :]).strip()
                    if said:
                        yield _seconds(found[1]), _seconds(found[2]), said
                    break


@udtf(returnType="clip_index int, clip_start double, clip_end double")
class clip_windows:  # noqa: N801
    def eval(self, duration: float, length: int, overlap: int):
        if overlap >= length:
            raise ValueError("overlap must be below length")
        end = float(duration) if duration and duration > 0 else 300.0
        start, k = 0.0, 0
        while k == 0 or start < end - 1:
            yield k, start, min(end, start + length)
            start, k = start + length - overlap, k + 1
