"""Words of texts inside Spark tasks, and small helpers every operator of this subpackage shares.

``fold_words`` gives the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z: in UTF-8
every character beyond ASCII consists of bytes from 0x80 on, so a byte table is enough.
``plain_words`` gives the words ``[^\\x20\\x09-\\x0D]+``, unchanged.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most words whose hash a task remembers. Workers stay alive and keep what they once held.
REMEMBERED = 100_000

FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def fold_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def plain_words(text: bytes) -> list[bytes]:
    return text.split()


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """word -> 64-bit hash, remembering at most ``REMEMBERED`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def slices(batches: Iterable[pa.RecordBatch], most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold about ``most_bytes``; a longer text stands alone."""
    for batch in batches:
        lengths = np.array([len(x) for x in text_bytes(batch.column("text"))], dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            end = start + max(1, int(np.searchsorted(np.cumsum(lengths[start:]), most_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def given_back(run: Callable) -> Callable:
    """``run`` over the batches of a task; at its end what it no longer needs goes back to the system.

    Workers wait for the next task, and while they wait they would keep the most that any task has taken.
    """
    @functools.wraps(run)
    def held(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return held


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that on pure ASCII, and faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def rows_of(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, whatever else the table has."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers, byte planes apart, compressed."""
    parts = [np.array([len(arrays), *[x for a in arrays for x in (a.dtype.itemsize, len(a))]], dtype="<i8").tobytes()]
    parts += [np.ascontiguousarray(np.ascontiguousarray(a).view("u1").reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays]
    data = b"".join(parts)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    whole = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(whole, "<i8", 1)[0])
    about = np.frombuffer(whole, "<i8", 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for size, length in about.tolist():
        planes = np.frombuffer(whole, "u1", size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).view(f"<i{size}").ravel())
        at += size * length
    return out
