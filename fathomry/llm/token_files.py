"""Operator 2: token ids as flat binary files.

A folder holds, for each part, three files of plain little-endian numbers::

    part-00000.ids      unsigned 16- or 32-bit ids of all documents, one after the other
    part-00000.offsets  64-bit, one more than documents: where each document begins in .ids, counted in ids
    part-00000.keys     64-bit document ids, and part-00000.null one byte each: 1 where the id was null

and ``manifest.parquet``: part, documents, tokens, id_bytes, and ``base``, the ids in all parts before it.
Bases are prefix sums over the parts, so ``base + offset`` is a document's place in the whole corpus. The
files are memory-mapped where the folder is a mounted file system.

Documents are range-partitioned and sorted, so parts follow each other in key order. A part's content depends
on its rows alone and appears under its name only when complete; a task that is run again replaces it.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most words whose ids a task remembers, and words that are encoded together.
REMEMBERED = 1_000_000
TOGETHER = 256

#: White space beside space and line feed: the ASCII ones, and beginnings of the others in UTF-8.
ASCII_SPACES = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
WIDE_SPACES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
MANIFEST = "part string, documents long, tokens long, id_bytes int"


class Encoder:
    """A tokenizer of the tokenizers library, with the ids of space-separated words remembered.

    Byte-level tokenizers split a text before a space that stands alone between two other characters, and
    treat what lies between such places by itself; so ids of the words, joined, are ids of the text. Words a task
    has not met are encoded together, one text of ``TOGETHER`` words with a space before each: a token that begins with
    a space is then the first of its word. Texts with any other white space than that, or lone line feeds, go
    to the tokenizer whole.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.by_words = self._by_words()
        self._known: dict[str, bytes] = {}
        self._first: dict[str, bytes] = {}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self._heads = np.array([x.startswith("Ġ") for x in names])

    def _by_words(self) -> bool:
        """Whether the tokenizer splits texts as described, tried on its own pre-tokenizer."""
        rule = self.tokenizer.pre_tokenizer
        if rule is None or type(rule).__name__ != "ByteLevel" or self.tokenizer.normalizer is not None or rule.add_prefix_space:
            return False
        return [x for x, _ in rule.pre_tokenize_str("ab, c\nd 12")] == ["ab", ",", "Ġc", "Ċ", "d", "Ġ12"]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """ids of each word with a space before it."""
        out: list[bytes] = []
        together = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        size = np.dtype(self.dtype).itemsize
        for part, found in zip(together, self.tokenizer.encode_batch_fast([" " + " ".join(p) for p in together], add_special_tokens=False)):
            ids = np.array(found.ids, dtype=self.dtype)
            starts = np.flatnonzero(self._heads[ids])
            if len(starts) != len(part):  # a word with a token that begins with a space and has none
                out += self._whole([" " + w for w in part])
                continue
            raw, cuts = ids.tobytes(), (starts * size).tolist()
            out += [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]
        return out

    @staticmethod
    def _plain(text: str) -> bool:
        """Whether all white space is single spaces and line feeds, each between two other characters."""
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in " \n" or text[-1] in " \n":
            return False
        data = text.encode()
        return len(data.translate(None, ASCII_SPACES)) == len(data) and (data.isascii() or not any(w in data for w in WIDE_SPACES))

    def encode(self, texts: list[str], space: bool = False) -> list[bytes]:
        """ids of each text, packed; with ``space``, of a space and the text."""
        for known in (self._known, self._first):
            if len(known) > REMEMBERED:
                known.clear()
        known, first = self._known, self._first
        split = [text.split(" ") if self.by_words and self._plain(text) else None for text in texts]
        new = {w for words in split if words is not None for w in words[not space :]}.difference(known)
        if new:
            new = list(new)
            known.update(zip(new, self._words(new)))
        if not space:
            new = list({words[0] for words in split if words is not None}.difference(first))
            first.update(zip(new, self._whole(new)))
        whole = iter(self._whole([" " * space + t for t, w in zip(texts, split) if w is None]))
        get = known.__getitem__
        if space:
            return [next(whole) if words is None else b"".join(map(get, words)) for words in split]
        return [next(whole) if words is None else first[words[0]] + b"".join(map(get, words[1:])) for words in split]


@lru_cache(maxsize=2)
def load(path: str, plain_specials: bool = False) -> Encoder:
    return Encoder(path, plain_specials)


def _open(folder: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ids of all documents in ascending ``key`` order; returns the manifest, which is written too.

    Each document is followed by ``end_id``. Null keys come first; rows of equal key follow their text. Null
    and empty texts are the end id alone; an empty table gives a manifest without parts. Other columns are
    not written, whatever their names.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (files, root) = load(tokenizer), _open(folder)
        name = f"part-{TaskContext.get().partitionId():05d}"
        own = f"{root}/.{name}-{uuid.uuid4().hex}"
        end, at, documents, out = np.array([end_id], dtype=encoder.dtype).tobytes(), 0, 0, {}
        for batch in batches:
            if not out:
                out = {x: files.open_output_stream(f"{own}.{x}") for x in ("ids", "offsets", "keys", "null")}
            width = np.dtype(encoder.dtype).itemsize
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [x + end for x in encoder.encode([t or "" for t in part.column("t").to_pylist()])]
                sizes = np.cumsum([0, *[len(x) // width for x in rows]])
                out["ids"].write(b"".join(rows))
                out["offsets"].write((at + sizes[:-1]).astype("<i8").tobytes())
                out["keys"].write(part.column("k").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                out["null"].write(part.column("k").is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
                at += int(sizes[-1])
                documents += len(rows)
        if out:
            out["offsets"].write(np.array([at], dtype="<i8").tobytes())
            for x, stream in out.items():
                stream.close()
                if files.get_file_info(f"{root}/{name}.{x}").type != pfs.FileType.NotFound:
                    files.delete_file(f"{root}/{name}.{x}")
                files.move(f"{own}.{x}", f"{root}/{name}.{x}")
            columns = [[name], [documents], [at], [np.dtype(encoder.dtype).itemsize]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "documents", "tokens", "id_bytes"])

    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    parts = rows.repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), F.col("t").asc_nulls_first())
    # One row per part: the number of partitions bounds what the driver gets.
    found = sorted(parts.mapInArrow(run, MANIFEST).collect(), key=lambda r: r.part)
    bases = np.cumsum([0, *[r.tokens for r in found]]).tolist()
    manifest = spark.createDataFrame([(*r, b) for r, b in zip(found, bases)], f"{MANIFEST}, base long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest.parquet")
    return spark.read.parquet(f"{folder}/manifest.parquet")


def map_part(folder: str, part: str, id_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets, keys and null flags of one part; memory-mapped on a mounted file system."""
    files, root = _open(folder)
    found = []
    for x, dtype in (("ids", f"<u{id_bytes}"), ("offsets", "<i8"), ("keys", "<i8"), ("null", "u1")):
        path = f"{root}/{part}.{x}"
        if isinstance(files, pfs.LocalFileSystem):
            found.append(np.memmap(path, dtype=dtype, mode="r"))
        else:
            with files.open_input_stream(path) as stream:
                found.append(np.frombuffer(stream.read(), dtype=dtype))
    return tuple(found)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids.

    The sum is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers. Without ``with_ids``
    the ids stay in the task.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, keys, null = map_part(folder, row["part"], row["id_bytes"])
                for first in range(0, row["documents"], 2048):
                    span = range(first, min(first + 2048, row["documents"]))
                    docs = [ids[offsets[i] : offsets[i + 1]] for i in span]
                    columns = [
                        pa.array(np.asarray(keys[span.start : span.stop]), mask=np.asarray(null[span.start : span.stop]).astype(bool)),
                        pa.array(np.asarray(offsets[span.start : span.stop]) + row["base"]),
                        pa.array([len(x) for x in docs], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in docs], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.astype("i8") for x in docs], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    manifest = spark.read.parquet(f"{folder}/manifest.parquet")
    return manifest.repartition(max(1, manifest.count()), F.col("part")).mapInArrow(run, schema)
