"""Word splitting and hashing of Arrow text columns, vectorised per batch.

A word is a maximal run of bytes other than the six ASCII white-space characters; a piece is a word and
the white space behind it. Null texts have no words.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = r" \t\n\r\f\x0b"
PIECE = re.compile(rf"[^{SPACE}]+[{SPACE}]*")
BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 6 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text, one row at least, so memory doesn't follow the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column in order, and the offsets of each row's words (rows + 1 numbers)."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    keep = pc.greater(pc.binary_length(words), 0)
    if len(words) and not pc.all(keep).as_py():  # white space at an end gives empty words
        kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
        words, offsets = words.filter(keep), kept[offsets]
    return words, offsets


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy()]


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Prefix:
    """Prefix polynomial hashes modulo 2**64: the hash of any run of tokens costs two look-ups."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.inverse = powers(n + 1, INVERSE)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tokens * powers(n), out=self.sums[1:])

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        """Equal runs have equal hashes, wherever they stand."""
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit, for use as a shuffle key."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the half-open ranges, and the number of the range that each comes from."""
    n = np.maximum(ends - starts, 0)
    which = np.repeat(np.arange(len(starts)), n)
    first = np.cumsum(n) - n
    return np.arange(len(which)) - first[which] + starts[which], which


def distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct rows of these columns in order, the first place of each, and the number of each row."""
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[order[1:]] != c[order[:-1]]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return [c[order[fresh]] for c in columns], order[fresh], number


def planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which compress better so."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


class Reader:
    """Reads what planes() and raw bytes make, one after another, from their compressed whole."""

    def __init__(self, data: bytes, size: int):
        self.data, self.at = pa.decompress(data, size, "zstd", asbytes=True) if size else b"", 0

    def take(self, n: int, kind: type) -> np.ndarray:
        size = np.dtype(kind).itemsize
        x = np.frombuffer(self.data, np.uint8, n * size, self.at).reshape(size, n)
        self.at += n * size
        return np.ascontiguousarray(x.T).reshape(-1).view(kind)

    def raw(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


def release() -> None:
    """Gives free memory back to the system: idle Python workers keep what they have."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def compressed(*parts: bytes, level: int = 1) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(b"".join(parts), asbytes=True)
