"""Operator 11: alignment of the tokens of two tokenizers over each distinct text once.

Documents are shuffled by their full text, and equal ones become one row with their number. Of each distinct
text both tokenizers give tokens and the bytes these stand for. Where tokens of both end at the same byte a group ends,
and two tokens are linked if their bytes overlap.

How often a pair of ids is linked in the whole corpus is a sum over distinct texts, each counted as often as it stands.
A slice of texts sends each of its pairs once, packed into buckets by pair, with the sum over the slice; what comes
back is the whole count of each pair and whether that is the highest of the second id. So a pair that every text
has is one entry a slice. The measures of a text follow from its own pairs and are joined to the documents by the
text's digest.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.llm import token_files
from fathomry.llm.texts import pack, slices, text_bytes, unpack
from fathomry.operators.lookups import spread_join
from fathomry.session import fresh_dir

SLICE = 8_000_000
#: Texts encoded at a time; distinct pairs of a slice per byte of it, roughly, and pairs a bucket receives on average.
BATCH = 128
PAIRS_PER_BYTE = 0.05
BUCKET = 2_000_000
MARK = "▁"

MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: A row is a text (pairs: places in the slice's list of pairs, and times) or, with a bucket, pairs of a slice, their
#: counts there and their places.
ALIGNED = f"slice long, digest binary, {MEASURES}, bucket int, pairs binary"
MEASURED = f"digest binary, {MEASURES}, n_best long, count_sum long"


def _byte_table() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in table.values():
            table[chr(spare)] = b
            spare += 1
    return table


class Side:
    """``encode`` gives the ids of texts, and whether they are sure to spell them; ``spelled`` are the bytes of each
    id, None if it stands for none."""

    def __init__(self, spelled: list[bytes | None]):
        self.spelled = spelled
        self.lengths = np.array([-1 if x is None else len(x) for x in spelled], dtype=np.int64)

    def spells(self, ids: np.ndarray, wanted: bytes) -> bool:
        """Whether the tokens' bytes, joined, are ``wanted``."""
        lengths = self.lengths[ids]
        if lengths.min(initial=0) < 0 or int(lengths.sum()) != len(wanted):
            return False
        return b"".join(map(self.spelled.__getitem__, ids.tolist())) == wanted


class ByteSide(Side):
    """A byte-level tokenizer of the tokenizers library; special tokens in texts are plain text."""

    def __init__(self, path: str):
        self.encoder = token_files.Encoder(path, plain_specials=True)
        table, tokenizer = _byte_table(), self.encoder.tokenizer
        names = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
        super().__init__([bytes(map(table.__getitem__, x)) if x and all(c in table for c in x) else None for x in names])
        # Each byte is a token and only neighbours are merged, so nothing gets lost.
        self.sure = self.encoder.by_words and all(c in names for c in table)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        return [(np.frombuffer(x, dtype=self.encoder.dtype), self.sure) for x in self.encoder.encode(texts, space=True)]


class PieceSide(Side):
    """A SentencePiece model; the model adds the space in front itself.

    Where no piece has a space but in front, single spaces part a text into words that are encoded one by one; the
    ids of words are remembered.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled: list[bytes | None] = []
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        for i, piece in enumerate(names):
            if self.model.is_byte(i):
                spelled.append(bytes([int(piece[1:-1], 16)]))
            else:
                spelled.append(None if self.model.is_control(i) or self.model.is_unknown(i) else piece.replace(MARK, " ").encode())
        super().__init__(spelled)
        self.by_words = not any(MARK in p.lstrip(MARK) for p in names) and self.model.encode("a  b") != self.model.encode("a b")
        self._known: dict[str, bytes] = {}
        self._odd: set[str] = set()  # words their ids do not spell
        self._spelled = [b"\xff" if x is None else x for x in spelled]  # a byte no text has

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, dtype="<i4") for x in self.model.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        if len(self._known) > token_files.REMEMBERED:
            self._known.clear()
            self._odd.clear()
        plain = lambda t: self.by_words and "  " not in t and t[:1] != " " and t[-1:] != " " and MARK not in t and t != ""
        split = [t.split(" ") if plain(t) else None for t in texts]
        new = list({w for words in split if words is not None for w in words}.difference(self._known))
        spelled = self._spelled.__getitem__
        for word, ids in zip(new, self.model.encode(new, num_threads=1)):
            self._known[word] = array("i", ids).tobytes()
            if b"".join(map(spelled, ids)) != b" " + word.encode():
                self._odd.add(word)
        rest = iter(self._whole([t for t, words in zip(texts, split) if words is None]))
        get, odd = self._known.__getitem__, self._odd
        return [(next(rest), False) if words is None else (np.frombuffer(b"".join(map(get, words)), dtype="<i4"), odd.isdisjoint(words)) for words in split]


@lru_cache(maxsize=4)
def load(kind: type[Side], path: str) -> Side:
    return kind(path)


@lru_cache(maxsize=2)
def _printed(n_a: int, n_b: int) -> list[str]:
    """Each id with the sign behind it: a in a group, last a of it, b in a group, last b of it."""
    return [f"{i}{sign}" for n, sign in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")) for i in range(n)]


def aligned(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cuts, at_a, at_b) of ascending ends of tokens: the common ends, and the tokens of each link.

    There is a link for each stretch between neighbouring ends of either side.
    """
    both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    twice = both[1:] == both[:-1]
    stretch = both[np.append(True, ~twice)] if len(both) else both
    return both[1:][twice], np.searchsorted(ends_a, stretch), np.searchsorted(ends_b, stretch)


def printed_order(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Indices into ``_printed`` of all tokens in order of their groups, those of a first."""
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    last_a, last_b = np.append(np.diff(group_a), 1), np.append(np.diff(group_b), 1)
    upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=len(cuts))), np.cumsum(np.bincount(group_b, minlength=len(cuts)))
    out = np.empty(len(a) + len(b), dtype=np.int64)
    out[np.arange(len(a)) + np.append(0, upto_b)[group_a]] = a + n_a * last_a
    out[np.arange(len(b)) + upto_a[group_b]] = b + 2 * n_a + n_b * last_b
    return out


def _bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    return ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _measured_texts(a_side: Side, b_side: Side, texts: list[bytes]) -> tuple[list[list], list[np.ndarray]]:
    """n_a, n_b, n_groups, n_links, groups_sha256 of each text, and its links as a << 32 | b.

    Texts follow each other as if they were one; where a text ends, tokens of both sides end.
    """
    part = [t.decode() for t in texts]
    coded = list(zip(a_side.encode(part), b_side.encode(part)))
    good = [i for i, (t, (a, b)) in enumerate(zip(texts, coded)) if t and all(sure or side.spells(ids, b" " + t) for side, (ids, sure) in ((a_side, a), (b_side, b)))]
    rows, found = [[0, 0, 0, 0, ""] for _ in texts], [np.zeros(0, dtype=np.int64) for _ in texts]
    if not good:
        return rows, found
    a, b = (np.concatenate([coded[i][k][0] for i in good]).astype(np.int64) for k in (0, 1))
    ends_a, ends_b = np.cumsum(a_side.lengths[a]), np.cumsum(b_side.lengths[b])
    cuts, at_a, at_b = aligned(a, b, ends_a, ends_b)
    codes = printed_order(a, b, ends_a, ends_b, cuts, len(a_side.spelled), len(b_side.spelled)).tolist()
    linked = a[at_a] << 32 | b[at_b]
    last_a = np.cumsum([len(coded[i][0][0]) for i in good])
    last_b = np.cumsum([len(coded[i][1][0]) for i in good])
    stop = ends_a[last_a - 1]
    groups, n_links = np.searchsorted(cuts, stop, side="right"), np.searchsorted(at_a, last_a)
    sign = _printed(len(a_side.spelled), len(b_side.spelled)).__getitem__
    before = [0, 0, 0, 0]
    for i, now in zip(good, np.stack([last_a, last_b, groups, n_links], axis=1).tolist()):
        printed = "".join(map(sign, codes[before[0] + before[1] : now[0] + now[1]]))[:-1]
        rows[i] = [x - y for x, y in zip(now, before)] + [hashlib.sha256(printed.encode()).hexdigest()]
        found[i] = linked[before[3] : now[3]]
        before = now
    return rows, found


def _aligned(first: tuple[type[Side], str], second: tuple[type[Side], str], buckets: int):
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [(n, kinds[k]) for n, k in (f.strip().split(" ") for f in ALIGNED.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = load(*first), load(*second)
        for batch in slices(batches, SLICE):
            texts, copies, digests = text_bytes(batch.column("text")), batch.column("copies").to_numpy(), batch.column("digest").to_pylist()
            if not texts:
                continue
            rows, found = [], []
            for start in range(0, len(texts), BATCH):
                measured, linked = _measured_texts(a_side, b_side, texts[start : start + BATCH])
                rows += measured
                found += linked
            sizes = np.array([len(x) for x in found])
            # Pairs and times of all texts at once: neighbours that are equal once text and pair are sorted.
            bits = len(b_side.spelled).bit_length(), (len(a_side.spelled) << len(b_side.spelled).bit_length()).bit_length()
            linked = np.concatenate(found)
            key = np.sort(np.repeat(np.arange(len(rows)), sizes) << bits[1] | linked >> 32 << bits[0] | linked & 0xFFFFFFFF)
            head = np.flatnonzero(np.diff(key, prepend=-1))
            times, own = np.diff(np.append(head, len(key))), key[head]
            doc, own = own >> bits[1], own & ((1 << bits[1]) - 1)
            pairs, place = np.unique(own, return_inverse=True)
            n = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(n, place, times * copies[doc])
            pairs = pairs >> bits[0] << 32 | pairs & ((1 << bits[0]) - 1)
            name = xxhash.xxh3_64_intdigest(b"".join(digests)) - (1 << 63)
            bounds = np.searchsorted(doc, np.arange(len(rows) + 1)).tolist()
            out: list[list] = [[] for _ in fields]
            for i, row in enumerate(rows):
                lo, hi = bounds[i : i + 2]
                packed = pack(np.diff(place[lo:hi], prepend=0).astype("<i4"), times[lo:hi].astype("<i4"))
                for column, value in zip(out, [name, digests[i], *row, None, packed]):
                    column.append(value)
            bucket = _bucket_of(pairs, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if hi > lo:
                    at = order[lo:hi]
                    packed = pack(np.diff(pairs[at], prepend=0), n[at], np.diff(at, prepend=0).astype("<i4"))
                    for column, value in zip(out, [name, *[None] * 6, k, packed]):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(out, fields)], names=[n for n, _ in fields])

    return run


def _summed(group: pa.Table) -> pa.Table:
    """(bucket, a, b, count) of one bucket over all slices."""
    found = [unpack(x) for x in group.column("pairs").to_pylist()]
    pairs, index = np.unique(np.concatenate([np.cumsum(p) for p, _, _ in found]), return_inverse=True)
    count = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(count, index, np.concatenate([n for _, n, _ in found]))
    bucket = np.full(len(pairs), group.column("bucket")[0].as_py(), dtype=np.int32)
    return pa.table({"bucket": bucket, "a": (pairs >> 32).astype(np.int32), "b": (pairs & 0xFFFFFFFF).astype(np.int32), "count": count})


def _told(sent: pa.Table, pairs: pa.Table) -> pa.Table:
    """(slice, counts): places of the pairs a slice sent, their whole counts, and whether they are the best of their b."""
    key = pairs.column("a").to_numpy().astype(np.int64) << 32 | pairs.column("b").to_numpy()
    order = np.argsort(key)
    key, count, best = key[order], pairs.column("count").to_numpy()[order], pairs.column("best").to_numpy(zero_copy_only=False)[order].astype("i1")
    out = []
    for packed in sent.column("pairs").to_pylist():
        own, _, places = unpack(packed)
        at = np.searchsorted(key, np.cumsum(own))
        out.append(pack(places, count[at], best[at]))
    return pa.table([sent.column("slice"), pa.array(out, pa.binary())], names=["slice", "counts"])


def _measured(texts: pa.Table, told: pa.Table) -> pa.Table:
    """All measures of the texts of a slice."""
    found = [unpack(x) for x in told.column("counts").to_pylist()]
    size = sum(len(p) for p, _, _ in found)
    count, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for places, n, flag in found:
        at = np.cumsum(places.astype(np.int64))
        count[at], best[at] = n, flag
    n_best, sums = [], []
    for packed in texts.column("pairs").to_pylist():
        own, times = unpack(packed)
        own, times = np.cumsum(own.astype(np.int64)), times.astype(np.int64)
        n_best.append(int((best[own] * times).sum()))
        sums.append(int((count[own] * times).sum()))
    kept = texts.drop_columns(["slice", "pairs"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def aligned_texts(docs: DataFrame, first: tuple[type[Side], str], second: tuple[type[Side], str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, pairs): measures of each distinct text by ``digest``, and (a, b, count, best) of each linked pair of ids."""
    folder = fresh_dir(docs.sparkSession, "alignment")
    whole = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    volume = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    distinct = whole.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    buckets = max(1, math.ceil(volume * PAIRS_PER_BYTE / BUCKET))
    rows = _stored(distinct.mapInArrow(_aligned(first, second, buckets), ALIGNED), folder, "aligned")
    texts = rows.filter(F.col("bucket").isNull()).drop("bucket")
    sent = rows.filter(F.col("bucket").isNotNull()).select("slice", "bucket", "pairs")
    counts = _stored(sent.groupBy("bucket").applyInArrow(_summed, "bucket int, a int, b int, count long"), folder, "counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    pairs = spread_join(counts, most, ["b"], "inner").select("bucket", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    pairs = _stored(pairs, folder, "pairs")
    told = sent.groupBy("bucket").cogroup(pairs.groupBy("bucket")).applyInArrow(_told, "slice long, counts binary")
    measured = texts.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(_measured, MEASURED)
    return measured, pairs.drop("bucket")


def align(docs: DataFrame, byte_model: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Side a is the byte-level tokenizer of ``byte_model`` over a space and the text, side b the SentencePiece model
    over the text. ``n_best`` are the links whose pair is the most frequent of its b id in the corpus (ties
    included), ``count_sum`` is the sum of the corpus counts of a text's links. Null and empty texts, and
    texts that the tokens of either side do not spell byte for byte, have no tokens and zeros. Repeated rows
    count as often as they stand and get equal measures; rows may share a key or have none. Other columns are
    ignored; an empty table gives no rows.
    """
    texts, _ = aligned_texts(docs, (ByteSide, byte_model), (PieceSide, piece_model), text)
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"), 256)).alias("digest"))
    measures = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return spread_join(rows, texts, ["digest"]).select(F.col("id").alias(key), *measures)
