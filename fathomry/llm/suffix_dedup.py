"""Operator 13: removal of byte strings that a document with a smaller id has too, by suffix and prefix order.

Every window of ``WIDTH`` bytes belongs to the shard of one of its ``GRAM``-byte grams, the least by a fixed order of
grams, so equal windows meet in one shard whatever surrounds them. Neighbouring windows with the same least
gram are one string. A slice of documents sends a shard each distinct string once, with the places where it stands.
The order of grams prefers those that begin with a space, which makes strings longer, and takes frequent grams last,
so that the unlike surroundings of a line that many documents have are dealt over many shards. Which grams are
frequent is estimated from ``SAMPLE`` bytes of documents; it moves strings between shards and changes no result.

A shard puts its strings into suffix order by external induced sorting (``suffix_order``), which carries the common
prefix of neighbours; where that is ``WIDTH`` or more, windows are equal, and the least id of the documents that
have one is known. A window reaches far enough to one side of its gram to hold half of what is left of it beside the
gram; a string whose grams stand beside such a context in one document only has no equal window elsewhere and is not
sorted. Windows of documents with a greater id go back to their slice, where they merge into maximal spans.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.llm.suffix_order import MEMORY, Scratch, induced
from fathomry.llm.texts import pack, slices, text_bytes, unpack
from fathomry.operators.lookups import spread_join
from fathomry.session import fresh_dir

WIDTH = 50
GRAM = 8
#: Bytes of strings a shard receives on average, windows one string holds at most, bytes of text in a slice.
SHARD = 8_000_000
LONGEST = 256
SLICE = 8_000_000
#: Of the compression of strings.
LEVEL = 6
#: Bytes of documents in which frequent grams are looked for, and their share of documents.
SAMPLE = 64_000_000
OFTEN = 0.005
SLOTS = 1 << 22
NO_WINDOW = np.iinfo(np.int32).max

SENT = "shard int, slice long, about binary, strings binary, numbers binary"
REPLY = "slice long, about binary, spans binary"
SPANS = "nokey boolean, key long, digest binary, spans binary"


def gram_values(data: np.ndarray, gram: int, hot: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Rank of the gram at each place: 30 bits of its hash, above them one for no space in front and one for ``hot``."""
    n = len(data) - gram + 1
    out = np.empty(max(n, 0), dtype=np.uint32)
    if n <= 0:
        return out
    wide = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))
    for a in range(0, n, block):
        b = min(n, a + block)
        h = wide[a:b] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += wide[a + gram - 8 : b + gram - 8]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        v = (h >> np.uint64(34)).astype(np.uint32)
        v |= (data[a:b] != 32).astype(np.uint32) << np.uint32(30)
        v |= hot[v & np.uint32(SLOTS - 1)].astype(np.uint32) << np.uint32(31)
        out[a:b] = v
    return out


def window_least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of each run of ``size`` neighbouring values, by doubling."""
    least, have = values, 1
    while 2 * have <= size:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = size - have
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _strings(data: np.ndarray, ends: np.ndarray, width: int, gram: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and least gram of the strings of concatenated documents that end at ``ends``."""
    least = window_least(gram_values(data, gram, hot), width - gram + 1)
    valid = np.ones(len(least), dtype=bool)
    for e in ends[:-1].tolist():
        valid[e - width + 1 : e] = False
    cut = np.empty(len(least), dtype=bool)
    cut[0] = True
    np.not_equal(least[1:], least[:-1], out=cut[1:])
    cut[1:] |= valid[1:] & ~valid[:-1]
    starts = np.flatnonzero(cut & valid)
    stop = np.append(np.flatnonzero((cut | ~valid)), len(least))
    windows = stop[np.searchsorted(stop, starts, side="right")] - starts
    if len(windows) and windows.max() > LONGEST:
        times = -(-windows // LONGEST)
        step = (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)) * LONGEST
        windows = np.minimum(np.repeat(windows, times) - step, LONGEST)
        starts = np.repeat(starts, times) + step
    return starts, windows, least[starts]


def _shard_of(least: np.ndarray, shards: int) -> np.ndarray:
    mixed = least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    return ((mixed >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _table(bits: bytes | None) -> np.ndarray:
    return np.zeros(SLOTS, dtype=bool) if bits is None else np.unpackbits(np.frombuffer(bits, "u1"))[:SLOTS].astype(bool)


def _send(shards: int, width: int, gram: int, bits: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = _table(bits)
        for batch in slices(batches, SLICE):
            columns = (batch.column("nokey").to_pylist(), batch.column("key").to_pylist(), batch.column("digest").to_pylist(), text_bytes(batch.column("text")))
            rows = [r for r in zip(*columns) if len(r[3]) >= width]
            if not rows:
                continue
            raw = b"".join([r[3] for r in rows])
            ends = np.cumsum([len(r[3]) for r in rows])
            keys, nokey = np.array([r[1] for r in rows], dtype=np.int64), np.array([r[0] for r in rows], dtype=np.int8)
            starts, windows, least = _strings(np.frombuffer(raw, "u1"), ends, width, gram, hot)
            seen: dict[bytes, int] = {}
            stops = (starts + windows + width - 1).tolist()
            ids = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), stops)), np.int64, len(starts))
            shard = _shard_of(least, shards)
            texts, of_text = list(seen), np.empty(len(seen), dtype=np.int64)
            of_text[ids] = shard
            by_shard = np.argsort(of_text, kind="stable")
            place = np.empty(len(seen), dtype=np.int64)  # of a string among those of its shard
            bounds = np.searchsorted(of_text[by_shard], np.arange(shards + 1))
            place[by_shard] = np.arange(len(seen)) - np.repeat(bounds[:-1], np.diff(bounds))
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            doc = np.searchsorted(ends, starts, side="right")
            about = pack(keys, nokey, np.diff(ends, prepend=0), np.frombuffer(b"".join([r[2] for r in rows]), "i1"))
            name = xxhash.xxh3_64_intdigest(about) - (1 << 63)
            out: list[list] = [[], [], [], [], []]
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                chosen = [texts[i] for i in by_shard[bounds[s] : bounds[s + 1]].tolist()]
                at = order[cuts[s] : cuts[s + 1]]
                joined = b"".join(chosen)
                d = doc[at]
                numbers = pack(
                    np.array([len(x) for x in chosen], dtype="<i2"),
                    np.diff(place[ids[at]], prepend=0).astype("<i4"), np.diff(starts[at], prepend=0).astype("<i4"),
                    np.diff(keys[d], prepend=0).astype("<i8"), nokey[d],
                )
                packed = len(joined).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(joined, asbytes=True)
                for column, value in zip(out, (s, name, None if out[0] else about, packed, numbers)):
                    column.append(value)
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["shard", "slice", "about", "strings", "numbers"])

    return run


def least_owner(strings: list[bytes], owner: np.ndarray, width: int, scratch: Scratch, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(starts, least): where each string begins in ``least``, which holds the least owner of each window's equals.

    Places where no window begins hold ``NO_WINDOW``.
    """
    lengths = np.array([len(x) for x in strings], dtype=np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    raw = np.frombuffer(b"\xff".join(strings) + b"\xff\xff", dtype="u1")
    kind = np.uint8 if raw.max(initial=0, where=raw != 255) <= 252 and int((raw == 255).sum()) == len(strings) + 1 else np.uint16
    text = raw.astype(kind)
    text += kind(2)
    text[starts + lengths] = 1
    text[-1] = 0
    if len(text) > memory:
        text = scratch.mapped(text)
    who = np.repeat(np.arange(len(strings), dtype=np.int32), lengths + 1)
    who = np.append(who, np.int32(len(strings) - 1))
    last = starts + lengths - width
    least = np.full(len(text), NO_WINDOW, dtype=np.int32)
    open_places = np.zeros(0, dtype=np.int64)
    for places, shared in induced(text, width, width, scratch, memory):
        group = np.cumsum(shared < width)
        window = places <= last[who[places]]
        whole = group[-1]
        group, places = group[window], places[window]
        places, group = np.concatenate([open_places, places]), np.concatenate([np.zeros(len(open_places), dtype=np.int64), group])
        done = group < whole
        open_places = places[~done]
        _settle(least, places[done], group[done], owner, who)
    _settle(least, open_places, np.zeros(len(open_places), dtype=np.int64), owner, who)
    return starts, least


def _settle(least: np.ndarray, places: np.ndarray, group: np.ndarray, owner: np.ndarray, who: np.ndarray) -> None:
    if len(places):
        cuts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        least[places] = np.repeat(np.minimum.reduceat(owner[who[places]], cuts), np.diff(np.append(cuts, len(places))))


def _met_elsewhere(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray, rank: np.ndarray, width: int, gram: int, hot: np.ndarray) -> np.ndarray:
    """Whether a string has its least gram beside a context that another document has too.

    ``which`` and ``rank`` are the strings and documents of all places. Equal windows of two documents have equal
    contexts at the same gram, so none of them is in a string that is left out.
    """
    low, high = np.full(len(starts), NO_WINDOW, dtype=np.int32), np.full(len(starts), -1, dtype=np.int32)
    np.minimum.at(low, which, rank)
    np.maximum.at(high, which, rank)
    values = gram_values(raw, gram, hot)
    least = window_least(values, width - gram + 1)[starts]
    who = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)[: len(values)]
    at = np.flatnonzero(values == least[who])
    who = who[at].astype(np.int64)
    stop = starts + lengths
    at, who = at[at + gram <= stop[who]], who[at + gram <= stop[who]]
    beside = (width - gram + 1) // 2
    size = gram + beside
    wide = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw.data, strides=(1,))
    keys, strings = [], []
    for side, first in ((0, at), (1, at - beside)):
        inside = (first >= starts[who]) & (first + size <= stop[who])
        first = first[inside]
        h = np.full(len(first), side, dtype=np.uint64)
        for step in [*range(0, size - 8, 8), size - 8]:
            h = (h ^ wide[first + step]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        keys.append(h)
        strings.append(who[inside])
    keys, strings = np.concatenate(keys), np.concatenate(strings)
    _, same = np.unique(keys, return_inverse=True)
    first, last = np.full(len(keys), NO_WINDOW, dtype=np.int32), np.full(len(keys), -1, dtype=np.int32)
    np.minimum.at(first, same, low[strings])
    np.maximum.at(last, same, high[strings])
    met = np.zeros(len(starts), dtype=bool)
    met[strings[(first < last)[same]]] = True
    return met


def _judge(width: int, gram: int, bits: bytes | None, folder: str, memory: int):
    def run(group: pa.Table) -> pa.Table:
        texts, lengths, rows, which, offsets, keys, nokey = [], [], [], [], [], [], []
        base = 0
        for r, (data, numbers) in enumerate(zip(group.column("strings").to_pylist(), group.column("numbers").to_pylist())):
            texts.append(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))
            sizes, index, offset, key, none = unpack(numbers)
            lengths.append(sizes.astype(np.int64))
            which.append(np.cumsum(index.astype(np.int64)) + base)
            offsets.append(np.cumsum(offset.astype(np.int64)))
            keys.append(np.cumsum(key))
            nokey.append(none)
            rows.append(np.full(len(index), r))
            base += len(sizes)
        raw = b"".join(texts)
        lengths, rows, which, offsets, keys, nokey = map(np.concatenate, (lengths, rows, which, offsets, keys, nokey))
        starts = np.cumsum(lengths) - lengths
        # Documents by rank of their id; those without one come after all others.
        known, rank = np.unique(keys, return_inverse=True)
        rank = np.where(nokey == 1, len(known), rank).astype(np.int32)
        wanted = np.flatnonzero(_met_elsewhere(np.frombuffer(raw, "u1"), starts, lengths, which, rank, width, gram, _table(bits)))
        low = np.full(len(lengths), NO_WINDOW, dtype=np.int32)
        np.minimum.at(low, which, rank)
        spans: list[tuple[np.ndarray, ...]] = []
        if len(wanted):
            seen: dict[bytes, int] = {}
            place = np.full(len(lengths), -1, dtype=np.int64)
            bounds = zip(starts[wanted].tolist(), (starts + lengths)[wanted].tolist())
            place[wanted] = [seen.setdefault(raw[a:b], len(seen)) for a, b in bounds]
            owner = np.full(len(seen), NO_WINDOW, dtype=np.int32)
            np.minimum.at(owner, place[wanted], low[wanted])
            scratch = Scratch(folder)
            try:
                begin, least = least_owner(list(seen), owner, width, scratch, memory)
            finally:
                scratch.close()
            best = np.minimum.reduceat(least, begin)
            index = place[which]
            late = np.flatnonzero((index >= 0) & (rank > best[np.maximum(index, 0)]))
            n_windows = lengths[which] - width + 1
            for a in range(0, len(late), 20_000):  # at most LONGEST windows each
                o = late[a : a + 20_000]
                times = n_windows[o]
                owner_of = np.repeat(np.arange(len(o)), times)
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                gone = np.flatnonzero(least[begin[index[o]][owner_of] + step] < rank[o][owner_of])
                if len(gone):
                    head = np.r_[True, (np.diff(gone) > 1) | (np.diff(owner_of[gone]) > 0)]
                    first, end = gone[head], gone[np.r_[head[1:], True]]
                    at = offsets[o][owner_of[first]]
                    spans.append((rows[o][owner_of[first]], at + step[first], at + step[end] + width))
        row, first, end = (np.concatenate(x) for x in zip(*spans)) if spans else (np.zeros(0, dtype=np.int64),) * 3
        order = np.lexsort((first, row))
        row, first, end = row[order], first[order], end[order]
        cuts = np.searchsorted(row, np.arange(group.num_rows + 1)).tolist()
        found = [pack(np.diff(first[a:b], prepend=0), (end - first)[a:b]) if b > a else None for a, b in zip(cuts, cuts[1:])]
        reply = pa.table({"slice": group.column("slice"), "about": group.column("about"), "spans": pa.array(found, pa.binary())})
        about, spans_ = reply.column("about"), reply.column("spans")
        return reply.filter(pc.or_(pc.is_valid(about), pc.is_valid(spans_)))

    return run


def _gather(group: pa.Table) -> pa.Table:
    """Maximal spans of the documents of one slice."""
    about = next(x for x in group.column("about").to_pylist() if x is not None)
    found = [unpack(x) for x in group.column("spans").to_pylist() if x is not None]
    names = ["nokey", "key", "digest", "spans"]
    kinds = [pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
    if not found:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    first = np.concatenate([np.cumsum(a) for a, _ in found])
    end = np.concatenate([np.cumsum(a) + n for a, n in found])
    keys, nokey, lengths, digests = unpack(about)
    digests = digests.tobytes()
    ends = np.cumsum(lengths)
    order = np.lexsort((end, first))
    first, end = first[order], end[order]
    doc = np.searchsorted(ends, first, side="right")
    reach = np.maximum.accumulate(end)
    head = np.r_[True, (first[1:] > reach[:-1]) | (doc[1:] != doc[:-1])]
    first, end, doc = first[head], reach[np.r_[np.flatnonzero(head)[1:] - 1, len(reach) - 1]], doc[head]
    base = (ends - lengths)[doc]
    first, end = first - base, end - base
    cuts = np.flatnonzero(np.diff(doc, prepend=-1)).tolist()
    rows = [(doc[a], pack(first[a:b], (end - first)[a:b])) for a, b in zip(cuts, [*cuts[1:], len(doc)])]
    which = np.array([d for d, _ in rows])
    columns = [pa.array(nokey[which] == 1), pa.array(keys[which]), pa.array([digests[16 * d : 16 * d + 16] for d in which.tolist()], pa.binary()), pa.array([p for _, p in rows], pa.binary())]
    return pa.table(columns, names=names)


def _frequent(width: int, gram: int):
    """Slots of grams and how many documents of the sample they are met in; those rare in a whole slice are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(SLOTS, dtype=bool)
        for batch in slices(batches, SLICE):
            met = np.zeros(SLOTS, dtype=np.int32)
            texts = [t for t in text_bytes(batch.column("text")) if len(t) >= width]
            for t in texts:
                met[np.unique(gram_values(np.frombuffer(t, "u1"), gram, none) & np.uint32(SLOTS - 1))] += 1
            slots = np.flatnonzero(met > OFTEN * len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(met[slots], pa.int64())], names=["slot", "n"])

    return run


def _frequent_grams(rows: DataFrame, volume: int, width: int, gram: int) -> bytes | None:
    """One bit per slot of grams: whether it is met in more than ``OFTEN`` of the sample's documents. None: no slot."""
    share = max(1, volume // SAMPLE)
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text")
    least = OFTEN * sample.count()
    met = sample.mapInArrow(_frequent(width, gram), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") > least)
    table = np.zeros(SLOTS, dtype=bool)
    table[[r.slot for r in met.select("slot").collect()]] = True  # at most SLOTS rows
    return np.packbits(table).tobytes() if table.any() else None


def owned_before(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", gram: int = GRAM, memory: int = MEMORY) -> DataFrame:
    """(nokey, key, digest, spans): of documents that lose bytes, the packed starts and lengths of their maximal spans."""
    rows = _rows(docs, key, text).select("nokey", "key", "digest", "text").filter(F.octet_length("text") >= width)
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _frequent_grams(rows, volume, width, gram)
    # Strings of a window and what is behind it are about three times as long as the text.
    shards = max(1, math.ceil(3 * volume / SHARD))
    folder = fresh_dir(docs.sparkSession, "suffixes")
    sent = rows.mapInArrow(_send(shards, width, gram, bits), SENT)
    replies = sent.groupBy("shard").applyInArrow(_judge(width, gram, bits, folder, memory), REPLY)
    # Rows that are equal in key and text lose the same.
    return replies.groupBy("slice").applyInArrow(_gather, SPANS).groupBy("nokey", "key", "digest").agg(F.max("spans").alias("spans"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    own = F.col(f"`{key}`").cast("long")
    rows = docs.select(F.col(f"`{key}`").alias("id"), own.isNull().alias("nokey"), F.coalesce(own, F.lit(0)).alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def remove_owned(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", gram: int = GRAM, memory: int = MEMORY) -> DataFrame:
    """Every row with what remains once each byte is removed that a document with a smaller key has too.

    A byte goes if it lies in a string of ``width`` bytes that also begins in a document with a smaller key;
    strings overlap and are judged on the input. Returns key, n_bytes, n_removed, removed (maximal spans: first
    byte, end), kept (the other bytes, joined). Null and empty texts have no bytes, texts shorter than ``width``
    lose none. Rows that share a key take nothing from each other. Rows without a key come after all others
    and take nothing from each other either. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, removed, kept = [], [], [], []
            for data, found in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist()):
                first, length = unpack(found) if found is not None else (np.zeros(0, dtype=np.int64),) * 2
                spans = list(zip(first.tolist(), (first + length).tolist()))
                at, rest = 0, []
                for a, b in spans:
                    rest.append(data[at:a])
                    at = b
                rest.append(data[at:])
                sizes.append(len(data))
                gone.append(int(length.sum()))
                removed.append([{"start": a, "end": b} for a, b in spans])
                kept.append(b"".join(rest))
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "removed", "kept"])

    found = owned_before(docs, width, key, text, gram, memory)
    rows = _rows(docs, key, text)
    joined = spread_join(rows, found, ["nokey", "key", "digest"]).select("id", "text", "spans")
    schema = f"id {dict(rows.dtypes)['id']}, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary"
    return joined.mapInArrow(run, schema).withColumnRenamed("id", key)


def digest(kept: DataFrame) -> DataFrame:
    """Columns by which results are compared."""
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
