"""The one stored table, the file types by extension, and the settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

RECORDS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        *(T.StructField(n, T.StringType()) for n in ("content", "record_type", "absolute_path", "filename", "parent_directory", "file_type", "mime_type")),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("total_chunks", T.IntegerType()),
        T.StructField("timestamp_start", T.DoubleType()),
        T.StructField("timestamp_end", T.DoubleType()),
        *(T.StructField(n, T.StringType()) for n in ("created_at", "file_modified_at", "file_hash", "metadata_json", "summary")),
    ]
)
DEFAULTS = {"record_type": "chunk", "chunk_index": 0, "total_chunks": 1, "metadata_json": "{}", "content": "", "summary": ""}

_BY_TYPE = {
    "document": "pdf docx doc pptx ppt xlsx xls html htm epub txt md csv json xml rtf rst",
    "image": "png jpg jpeg gif bmp tiff tif webp svg ico",
    "audio": "mp3 wav flac aac ogg wma m4a",
    "video": "mp4 avi mkv mov wmv flv webm m4v",
    "subtitle": "srt vtt ass ssa",
    "archive": "zip rar 7z tar gz bz2 xz",
}
EXTENSIONS = {f".{e}": kind for kind, names in _BY_TYPE.items() for e in names.split()}
_MIME = """text/plain txt|text/markdown md|text/csv csv|application/json json|text/xml xml|text/html html htm|application/pdf pdf|application/rtf rtf|text/x-rst rst|application/epub+zip epub
application/msword doc|application/vnd.openxmlformats-officedocument.wordprocessingml.document docx|application/vnd.ms-powerpoint ppt|application/vnd.openxmlformats-officedocument.presentationml.presentation pptx
application/vnd.ms-excel xls|application/vnd.openxmlformats-officedocument.spreadsheetml.sheet xlsx|image/png png|image/jpeg jpg jpeg|image/gif gif|image/bmp bmp|image/tiff tif tiff|image/webp webp|image/svg+xml svg
image/vnd.microsoft.icon ico|audio/mpeg mp3|audio/x-wav wav|audio/flac flac|audio/aac aac|audio/ogg ogg|audio/x-ms-wma wma|audio/mp4 m4a|video/mp4 mp4|video/x-msvideo avi|video/x-matroska mkv|video/quicktime mov
video/x-ms-wmv wmv|video/x-flv flv|video/webm webm|video/x-m4v m4v|application/x-subrip srt|text/vtt vtt|text/x-ssa ass ssa|application/zip zip|application/vnd.rar rar|application/x-7z-compressed 7z
application/x-tar tar|application/gzip gz|application/x-bzip2 bz2|application/x-xz xz"""
MIME = {f".{e}": kind for kind, *names in (x.split() for x in _MIME.replace("\n", "|").split("|")) for e in names}


@dataclass(frozen=True)
class Settings:
    """Values that the operators take as defaults; all are checked."""

    top_k: int = 10
    rrf_k: int = 60
    rerank: bool = False
    rerank_top_n: int = 15
    relevance_threshold: float = 0.65
    max_retries: int = 2
    chunk_words: int = 500
    chunk_overlap: float = 0.15
    clip_seconds: int = 20
    clip_overlap: int = 10
    subtitle_window: float = 30.0
    subtitle_carry: float = 5.0
    max_groups: int = 10
    chunks_per_group: int = 3
    history: int = 4
    summaries: bool = True
    summary_chars: int = 4000
    ocr: bool = True
    video_mode: str = "local"

    def __post_init__(self) -> None:
        for ok, what in (
            (1 <= self.top_k <= 100, "top_k must be 1 to 100"),
            (1 <= self.rrf_k <= 200, "rrf_k must be 1 to 200"),
            (0 <= self.chunk_overlap < 1, "chunk_overlap must be at least 0 and below 1"),
            (self.clip_overlap < self.clip_seconds, "clip_overlap must be below clip_seconds"),
            (0 <= self.relevance_threshold <= 1, "relevance_threshold must be 0 to 1"),
            (self.video_mode in ("local", "cloud"), "video_mode must be local or cloud"),
        ):
            if not ok:
                raise ValueError(what)
