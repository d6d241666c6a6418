"""Operator 5: substring deduplication by Rabin-Karp hashes of fixed windows of words.

Every window of ``width`` consecutive words is hashed, two independent rolling polynomials of its word
hashes. One picks the bucket the window is counted in, of the other the upper seven bytes are shipped, so
that the chance of a false repeat per window stays near 1e-11 however large the corpus: buckets hold about
``BUCKET`` windows each and grow in number with it.

What is shuffled is packed: for each slice of documents a task sends a bucket one row, seven bytes a hash and a
window number of two bytes. A hash that occurs more often than twice in a slice is sent twice, which proves it
repeated; its other windows follow as mere numbers. So a passage in a third of all documents adds little to its
bucket. The bucket sends back the numbers of repeated windows, which meet again by slice; the list of the slice's
documents travels with one of its rows. Each document's starts then merge into maximal removal intervals.
A slice is named by its content, so tasks that are run again need not cut the same slices.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.llm.texts import WordHashes, plain_words, slices, text_bytes

WIDTH = 35
BUCKET = 2_000_000
SLICE = 8_000_000
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
NO_KEY = -(1 << 63)


def window_hashes(words: np.ndarray, width: int, multiplier: np.uint64) -> np.ndarray:
    """Polynomial hash, modulo 2^64, of each window of ``width`` values, by doubling."""
    done, size, power, out, at = words, 1, multiplier, None, 0
    with np.errstate(over="ignore"):
        rest = width
        while rest:
            if rest & 1:  # take ``size`` more words behind those that are in ``out``
                n = len(words) - at - size + 1
                out = done[at : at + n] if out is None else out[:n] * power + done[at : at + n]
                at += size
            rest >>= 1
            if rest:
                done = done[: len(done) - size] * power + done[size:]
                size *= 2
                power = power * power
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as gaps: two bytes each, or four where a gap needs them; the first byte tells which."""
    gaps = np.diff(numbers, prepend=0)
    small = len(gaps) == 0 or gaps.max() < 65536
    return (b"\x02" if small else b"\x04") + gaps.astype("<u2" if small else "<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64))


SENT = "bucket int, slice long, about binary, hashes binary, numbers binary, known binary"
REPLY = "slice long, about binary, numbers binary"
STARTS = "key long, sum long, starts binary"


def _send(buckets: int, width: int):
    fields = [f.strip().split(" ") for f in SENT.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = WordHashes()
        for batch in slices(batches, SLICE):
            keys, sums, counts, first, second = [], [], [], [], []
            for key, text in zip(batch.column("key").to_pylist(), text_bytes(batch.column("text"))):
                words = plain_words(text)
                if len(words) < width:
                    continue
                hashes = remembered.array(words)
                keys.append(key)
                sums.append(zlib.crc32(text))
                counts.append(len(words) - width + 1)
                first.append(window_hashes(hashes, width, MULTIPLIERS[0]))
                second.append(window_hashes(hashes, width, MULTIPLIERS[1]))
            if not keys:
                continue
            h = _mixed(np.concatenate(first))
            b = ((_mixed(np.concatenate(second)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((h, b))  # stable: equal windows stay in text order
            same = np.zeros(len(h), dtype=bool)
            same[1:] = (h[order][1:] == h[order][:-1]) & (b[order][1:] == b[order][:-1])
            third = same.copy()
            third[1:] &= same[:-1]
            third[:1] = False
            bounds = np.searchsorted(b[order], np.arange(buckets + 1))
            about = np.array(keys, dtype="<i8").tobytes() + np.array(sums, dtype="<i8").tobytes() + np.array(counts, dtype="<i8").tobytes()
            name = xxhash.xxh3_64_intdigest(about) - (1 << 63)
            rows: list[list] = [[] for _ in fields]
            for i in range(buckets):
                at = order[bounds[i] : bounds[i + 1]]
                if len(at):
                    more = third[bounds[i] : bounds[i + 1]]
                    kept = at[~more]
                    sent, known = np.sort(kept), np.sort(at[more])
                    packed = h[sent].astype("<u8").view("u1").reshape(-1, 8)[:, 1:].tobytes()
                    for column, value in zip(rows, (i, name, None if rows[0] else about, packed, _packed(sent), _packed(known))):
                        column.append(value)
            kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(rows, fields)], names=[n for n, _ in fields])

    return run


def _count(group: pa.Table) -> pa.Table:
    """Numbers of the repeated windows of one bucket, by slice."""
    hashes = []
    for data in group.column("hashes").to_pylist():
        wide = np.zeros((len(data) // 7, 8), dtype="u1")
        wide[:, 1:] = np.frombuffer(data, dtype="u1").reshape(-1, 7)
        hashes.append(wide.view("<u8").ravel())
    whole = np.concatenate(hashes)
    order = np.argsort(whole)
    same = whole[order][1:] == whole[order][:-1]
    repeated = np.zeros(len(whole), dtype=bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    out, at = [], 0
    for own, numbers, known in zip(hashes, group.column("numbers").to_pylist(), group.column("known").to_pylist()):
        out.append(_packed(np.sort(np.concatenate([_unpacked(numbers)[repeated[at : at + len(own)]], _unpacked(known)]))))
        at += len(own)
    return pa.table({"slice": group.column("slice"), "about": group.column("about"), "numbers": pa.array(out, pa.binary())})


def _gather(group: pa.Table) -> pa.Table:
    """Starts of the repeated windows of one slice, by document."""
    about = np.frombuffer(next(x for x in group.column("about").to_pylist() if x is not None), dtype="<i8").reshape(3, -1)
    found = np.unique(np.concatenate([_unpacked(x) for x in group.column("numbers").to_pylist()]))
    ends = np.cumsum(about[2])
    doc = np.searchsorted(ends, found, side="right")
    cuts = np.flatnonzero(np.diff(doc, prepend=-1))
    which = doc[cuts]
    starts = [_packed(found[lo:hi] - (ends[d - 1] if d else 0)) for d, lo, hi in zip(which, cuts, [*cuts[1:], len(found)])]
    return pa.table({"key": pa.array(about[0][which]), "sum": pa.array(about[1][which]), "starts": pa.array(starts, pa.binary())})


def repeated_windows(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sum, starts): for documents with repeated windows, their packed starts. ``sum`` is the text's crc32."""
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY)).alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # About one word in six bytes; one aggregate over the lengths.
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(volume / 6 / BUCKET))
    sent = rows.mapInArrow(_send(buckets, width), SENT)
    replies = sent.groupBy("bucket").applyInArrow(_count, REPLY)
    # Rows that are equal in key and text have equal starts.
    return replies.groupBy("slice").applyInArrow(_gather, STARTS).groupBy("key", "sum").agg(F.max("starts").alias("starts"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with what remains once each word inside a repeated window is removed.

    A window is repeated if its words also begin anywhere else, in the same document too. Windows are judged
    on the input. Returns key, n_words, n_removed, removed (maximal intervals: first word, end), kept_text (kept
    words joined by one space). Null and empty texts have no words; texts shorter than the window lose
    nothing; a repeated row repeats the windows of its copy. Rows may share a key or have none. Other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, removed, kept = [], [], [], []
            for data, pack in zip(text_bytes(batch.column("text")), batch.column("starts").to_pylist()):
                words = plain_words(data)
                intervals = []
                if pack is not None:
                    starts = _unpacked(pack)
                    first = np.flatnonzero(np.diff(starts, prepend=-width - 1) > width)
                    last = [*(first[1:] - 1), len(starts) - 1]
                    intervals = list(zip(starts[first].tolist(), (starts[last] + width).tolist()))
                    rest, at = [], 0
                    for lo, hi in intervals:
                        rest += words[at:lo]
                        at = hi
                    rest += words[at:]
                else:
                    rest = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(rest))
                removed.append([{"start": a, "end": b} for a, b in intervals])
                kept.append(b" ".join(rest))
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            columns = [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_removed", "removed", "kept_text"])

    found = repeated_windows(docs, width, key, text)
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumns({"key": F.coalesce(F.col("id").cast("long"), F.lit(NO_KEY)), "sum": F.crc32(F.col("text").cast("binary"))})
    joined = keyed.join(found, ["key", "sum"], "left").select("id", "text", "starts")
    schema = f"id {dict(rows.dtypes)['id']}, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"
    return joined.mapInArrow(run, schema).withColumnRenamed("id", key)


def digest(kept: DataFrame) -> DataFrame:
    """Columns by which results are compared."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], width: int = WIDTH) -> list[tuple[int, int, str]]:
    """n_words, n_removed, kept_sha256 of each text, with every window in one dictionary; for tests."""
    words = [(t or "").encode().split() for t in texts]
    seen: dict[tuple[bytes, ...], int] = {}
    for ws in words:
        for i in range(len(ws) - width + 1):
            w = tuple(ws[i : i + width])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for ws in words:
        drop = {j for i in range(len(ws) - width + 1) if seen[tuple(ws[i : i + width])] > 1 for j in range(i, i + width)}
        kept = [w for i, w in enumerate(ws) if i not in drop]
        out.append((len(ws), len(drop), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
