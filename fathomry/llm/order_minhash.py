"""Operator 10: near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its shingles of five folded words. Equal shingles are told apart by the number of
their occurrence. Each of ``TABLES`` sketches hashes all labelled shingles anew, takes the ``LENGTH`` smallest
and keeps them in text order, so two texts agree in a sketch with a chance that falls with their edit
distance, not only with the shingles they share.

Texts that agree in a sketch form a bucket. Each bucket's centre, the text that shares most sketches with others,
is compared with all of it, and what it accepts becomes one class. Texts of a bucket that are in different
classes after that are dealt anew, by their rarest shingles: two texts that align far enough share one of these,
so no pair is lost, while a passage that many texts have is rarely among them. Each of these buckets takes one
centre, then four, sixteen and so on, until all of its pairs are compared, of one class, or too unlike in length.
So a group of n near copies takes about n comparisons. Exact copies are one text from the start.

A candidate counts if at least ``SIMILARITY`` of the longer text's shingles align in order: the longest common
subsequence of both shingle sequences, computed bit-parallel inside the band of diagonals that such an
alignment cannot leave. Links between texts become classes by spreading the least id along them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomry.llm.texts import WordHashes, fold_words, given_back, slices, text_bytes
from fathomry.operators.lookups import spread_join
from fathomry.session import fresh_dir

WORDS = 5
SIMILARITY = 0.8
TABLES = 12
LENGTH = 2
SLICE = 2_000_000
#: Bits of the map that tells which digests are wanted, for each of them; the map is broadcast for at most so many.
BITS = 16
MAPPED = 100_000_000
#: Rows of a small table in one file.
ROWS = 200_000


def shingles(hashes: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hash of each run of ``size`` word hashes; a shorter text is one shingle, a text without words none."""
    n = len(hashes)
    size = min(size, n)
    if n == 0:
        return hashes
    with np.errstate(over="ignore"):
        out = np.zeros(n - size + 1, dtype=np.uint64)
        for i in range(size):
            out = (out ^ hashes[i : n - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def labelled(found: np.ndarray) -> np.ndarray:
    """Shingle hashes mixed with the number of their occurrence."""
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    new = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    nth = np.arange(len(found)) - np.repeat(new, np.diff(np.r_[new, len(found)]))
    out = np.empty_like(found)
    with np.errstate(over="ignore"):
        out[order] = (ranked + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(32))


def sketches(found: np.ndarray, tables: int = TABLES, length: int = LENGTH) -> list[int]:
    """One 64-bit value per table: the smallest labelled shingles in text order."""
    marks = labelled(found)
    take = min(length, len(marks))
    out = []
    with np.errstate(over="ignore"):
        for t in range(tables):
            mixed = (marks ^ np.uint64((t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xC4CEB9FE1A85EC53)
            mixed ^= mixed >> np.uint64(31)
            least = np.sort(np.argpartition(mixed, take - 1)[:take]) if take < len(mixed) else np.arange(len(mixed))
            out.append(xxhash.xxh3_64_intdigest(found[least].tobytes(), seed=t) - (1 << 63))
    return out


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Share of the longer sequence that aligns in order with the other; exact from ``similarity`` on, else 0.

    The alignment skips at most ``len(a) + len(b) - 2 * least`` shingles, which bounds the diagonals.
    """
    n, m = len(a), len(b)
    longest = max(n, m)
    if longest == 0:
        return 0.0
    least = math.ceil(similarity * longest - 1e-9)
    if min(n, m) < least:
        return 0.0
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[:n], place[n:]
    size = len(values)
    # No order of the shingles can align more than both texts have of each.
    if np.minimum(np.bincount(left, minlength=size), np.bincount(right, minlength=size)).sum() < least:
        return 0.0
    band = n + m - 2 * least
    masks: dict[int, int] = {}
    for i, v in enumerate(left.tolist()):
        masks[v] = masks.get(v, 0) | 1 << i
    full = (1 << n) - 1
    row, window = full, (1 << 2 * band + 1) - 1
    for j, v in enumerate(right.tolist()):
        mask = masks.get(v, 0)
        mask &= window << (j - band) if j >= band else window >> (band - j)
        hit = row & mask
        row = (row + hit | row - hit) & full
    share = (n - row.bit_count()) / longest
    return share if share >= similarity - 1e-12 else 0.0


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, text and the 128-bit digest of what was taken; null text as it is."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def _sketched(tables: int, length: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, SLICE):
            digests, counts, keys = [], [], []
            texts = dict(zip(batch.column("digest").to_pylist(), text_bytes(batch.column("text"))))  # copies once
            for digest, text in texts.items():
                found = shingles(hashes.array(fold_words(text)), size)
                if len(found):
                    digests.append(digest)
                    counts.append(len(found))
                    keys.append(sketches(found, tables, length))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["digest", "n", "sketches"])

    return given_back(run)


def _verified(similarity: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        center: tuple[bytes, np.ndarray] = (b"", np.zeros(0, dtype=np.uint64))
        for batch in batches:
            near = []
            for a, text, other in zip(batch.column("center").to_pylist(), text_bytes(batch.column("center_text")), text_bytes(batch.column("text"))):
                if a != center[0]:
                    center = a, shingles(hashes.array(fold_words(text)), size)
                near.append(aligned(center[1], shingles(hashes.array(fold_words(other)), size), similarity))
            kept = ["center", "member", "of_center", "of_member"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(near, pa.float64())], names=[*kept, "near"])

    return given_back(run)


def _stored(df: DataFrame, folder: str, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a written table in the shared folder; one known to have few rows is written in few files."""
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS)
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _dropped(docs: DataFrame, folder: str, names: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    jvm = docs.sparkSession._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _likely(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """All rows of ``texts`` whose digest is in ``wanted`` (each once), and about one in ``BITS`` of the others.

    What it leaves out is not moved by the join that follows. The map takes two bytes a digest; where even these are
    too many for a broadcast, all rows stay.
    """
    n = wanted.count()
    if n > MAPPED:
        return texts
    place = F.pmod(F.xxhash64("digest"), F.lit(BITS * n + 1)) + 1
    own = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substr("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = texts.withColumn("page", F.bitmap_bucket_number(place)).join(F.broadcast(own), "page")
    return met.filter(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).select(*texts.columns)


def _marked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, SLICE):
            marks = [labelled(shingles(hashes.array(fold_words(text)), size)).view(np.int64) for text in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(marks, pa.list_(pa.int64()))], names=["digest", "marks"])

    return given_back(run)


def _by_rare_shingles(rest: DataFrame, taken: DataFrame, similarity: float, size: int, folder: str) -> DataFrame:
    """(digest, n, score, bucket) of ``rest`` (digest, n, score), whose texts are ``taken``, with the rarest labelled shingles as buckets.

    Texts of n shingles that align in ``similarity`` of the longer one have so many labelled shingles in common
    that, in any one order of them, they share one of the first ``n - least + 1``. Shingles no other text has come first
    in that order; they are only counted.
    """
    marks = taken.mapInArrow(_marked(size), "digest binary, marks array<long>")
    marks = _stored(marks.select("digest", F.explode("marks").alias("bucket")), folder, "marks")
    often = marks.groupBy("bucket").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    shared = spread_join(marks, often, ["bucket"], "inner")
    first = shared.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("often", "bucket"))).alias("marks")).join(rest, "digest")
    least = F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9)).cast("int")
    alone = F.col("n") - F.size("marks")
    taking = F.greatest(F.lit(0), F.col("n") - least + 1 - alone)
    return first.select("digest", "n", "score", F.explode(F.slice("marks", F.lit(1), taking)).alias("mark")).select("digest", "n", "score", F.col("mark.bucket").alias("bucket"))


def links(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, tables: int = TABLES, length: int = LENGTH, size: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Verified links (center, member, near) between digests of different texts, and their classes (digest, class)."""
    texts = _texts(docs, key, text).filter(F.col("digest").isNotNull()).select("digest", "text")
    sketched = texts.mapInArrow(_sketched(tables, length, size), "digest binary, n int, sketches array<long>")
    sketched = _stored(sketched.dropDuplicates(["digest"]), folder, "sketched")
    members = sketched.select("digest", "n", F.posexplode("sketches").alias("table", "sketch")).select("digest", "n", F.xxhash64("table", "sketch").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    score = F.sum("size").over(Window.partitionBy("digest")).alias("score")  # of at most ``tables`` rows
    crowded = spread_join(members, sizes, ["bucket"], "inner").select("digest", "n", "bucket", score)
    members = _stored(crowded.withColumn("class", F.col("digest")), folder, "members")
    rows = members.count()
    classes = _stored(members.select("digest", "class").distinct(), folder, "classes", rows)
    # Copies become one row before they meet in a task; texts that are in no bucket with others stay where they are.
    taken = _likely(texts, classes.select("digest")).groupBy("digest").agg(F.first("text").alias("text")).join(classes.select("digest"), "digest", "left_semi")
    taken = _stored(taken, folder, "texts")
    ends = F.least("center", "member").alias("a"), F.greatest("center", "member").alias("b")
    _dropped(docs, folder, ["sketched"])
    found, number, shares, now = None, 0, 1, ["members", "classes"]
    while True:
        share = F.pmod(F.xxhash64("digest", F.lit(number)), F.lit(shares)).alias("share")
        centers = members.groupBy("bucket", share).agg(F.max(F.struct("score", "digest", "n", "class")).alias("c"), F.min("class").alias("lo"), F.max("class").alias("hi"))
        mixed = centers.groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo != hi").select("bucket")
        centers = _stored(centers.select("bucket", "c").join(mixed, "bucket"), folder, f"centers-{number}", rows)
        if centers.isEmpty():
            break
        like = F.least("n", "c.n") >= F.greatest("n", "c.n") * similarity - 1e-9
        pairs = spread_join(members, centers, ["bucket"], "inner").filter(like & (F.col("class") != F.col("c.class")))
        pairs = pairs.select(F.col("c.score").alias("score"), F.col("c.digest").alias("center"), F.col("digest").alias("member"), F.col("c.class").alias("of_center"), F.col("class").alias("of_member"))
        # Where both are centres, the one of higher score stays it.
        pairs = pairs.groupBy(*ends).agg(F.max(F.struct("score", "center", "member", "of_center", "of_member")).alias("p"))
        if found is not None:
            pairs = pairs.join(found.select(*ends), ["a", "b"], "left_anti")
        pairs = _stored(pairs.select("p.center", "p.member", "p.of_center", "p.of_member"), folder, f"pairs-{number}", rows)
        # Only the texts of this round's pairs are moved.
        wanted = pairs.select(F.explode(F.array("center", "member")).alias("digest")).distinct()
        own = taken.join(wanted, "digest", "left_semi")
        joined = pairs.join(own.withColumnRenamed("digest", "member"), "member").join(own.select(F.col("digest").alias("center"), F.col("text").alias("center_text")), "center")
        checked = joined.mapInArrow(_verified(similarity, size), "center binary, member binary, of_center binary, of_member binary, near double")
        checked = _stored(checked, folder, f"checked-{number}")
        found = checked.select("center", "member", "near") if found is None else found.unionByName(checked.select("center", "member", "near"))
        # Classes that a link joins become one; all others stay as they are.
        joins = _stored(checked.filter("near > 0").select(F.col("of_center").alias("a"), F.col("of_member").alias("b")).distinct(), folder, f"joins-{number}", rows)
        merged = spread_least(joins, f"{folder}/merged-{number}", joins.count()).select(F.col("node").alias("class"), F.col("class").alias("new"))
        renamed = lambda df: df.join(merged, "class", "left").withColumn("class", F.coalesce("new", "class")).drop("new")  # noqa: B023, E731
        classes = _stored(renamed(classes), folder, f"classes-{number}", rows)
        # What a centre leaves has met it; the others of its bucket have not met each other.
        met = centers.select("bucket", F.col("c.digest").alias("digest"))
        left = members.join(centers.select("bucket").distinct(), "bucket", "left_semi").join(met, ["bucket", "digest"], "left_anti")
        left = _stored(renamed(left), folder, f"left-{number}", rows)
        _dropped(docs, folder, [f"{x}-{number}" for x in ("centers", "pairs", "joins", "merged")] + now)
        now = [f"left-{number}", f"classes-{number}"]
        if number == 0:
            mixed = left.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo != hi").select("bucket")
            rest = left.join(mixed, "bucket", "left_semi").select("digest", "n", "score", "class").distinct()
            rest = _stored(rest, folder, "rest", rows)
            # From here on only these texts are compared; the others are not moved again.
            taken = _stored(taken.join(rest.select("digest"), "digest", "left_semi"), folder, "fewer")
            left = _by_rare_shingles(rest.drop("class"), taken, similarity, size, folder).join(rest.select("digest", "class"), "digest")
            left = _stored(left, folder, "rare")
            _dropped(docs, folder, ["rest", "left-0", "marks", "texts"])
            now[0] = "rare"
        else:
            shares *= 4
        members, rows = left, left.count()
        number += 1
    _dropped(docs, folder, ["texts", "fewer", f"centers-{number}", now[0]])
    if found is None:
        found = docs.sparkSession.createDataFrame([], "center binary, member binary, near double")
    return found.filter(F.col("near") > 0), classes


def spread_least(edges: DataFrame, folder: str, rows: int | None = None) -> DataFrame:
    """(node, class): the least node of each connected component of edges (a, b).

    Each round gives every node the least class of its neighbours and then that class's own class, so long
    chains halve. Rounds are written to the shared folder.
    """
    few = None if rows is None else 2 * rows
    both = _stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), folder, "edges", few)
    classes = _stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("class")).withColumnRenamed("a", "node"), folder, "classes-0", few)
    number = 0
    while True:
        number += 1
        near = both.join(classes.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        closer = classes.join(near, "node").select("node", "class", F.least("class", "near").alias("next"))
        jump = classes.select(F.col("node").alias("next"), F.col("class").alias("beyond"))
        new = closer.join(jump, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("class"), (F.least("next", F.coalesce("beyond", "next")) != F.col("class")).alias("moved"))
        new = _stored(new, folder, f"classes-{number}", few)
        if new.filter("moved").isEmpty():
            return new.select("node", "class")
        classes = new.select("node", "class")


WORDED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _classified(docs: DataFrame, key: str, text: str, **parameters) -> DataFrame:
    """id, digest (null without words), class (least digest; null without words), n_links of every row."""
    folder = fresh_dir(docs.sparkSession, "near")
    edges, classes = links(docs, folder, key, text, **parameters)
    ends = edges.select(F.explode(F.array("center", "member")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    rows = _texts(docs, key, text).select("id", F.when(F.col("text").rlike(WORDED), F.col("digest")).alias("digest"))
    about = ends.withColumnRenamed("node", "digest").join(classes, "digest")
    return spread_join(rows, about, ["digest"]).withColumn("class", F.coalesce("class", "digest"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """One row per row of ``docs``: key, class_id (least key of its class), class_size, n_links.

    A class holds exact copies and texts joined by links. ``n_links`` counts the verified links of the row's
    text to other texts. Null texts and texts without words are classes of their own, even if repeated;
    rows that repeat a key are members like any others. Rows without a key can be members; where all of a
    class lack one, class_id is null. An empty table gives no rows. Other columns are ignored.
    """
    rows = _classified(docs, key, text, **parameters)
    least = rows.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    joined = spread_join(rows, least, ["class"])
    return joined.select(
        F.col("id").alias(key),
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """All columns of one row per class of near-duplicates: the one with the least key, then the least digest.

    Rows equal in key and text are one. Rows without a key are last choice. Rows with a null text or without
    words all stay as they are.
    """
    rows = _classified(docs, key, text, **parameters)
    chosen = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("best")
    best = rows.filter(F.col("class").isNotNull()).groupBy("class").agg(chosen).select(F.coalesce("best.id", F.lit(0)).alias("__own"), F.col("best.none").alias("__none"), F.col("best.digest").alias("__sum"))
    own, whole = F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string")
    worded = F.coalesce(whole.rlike(WORDED), F.lit(False))
    named = docs.withColumns({"__own": F.coalesce(own, F.lit(0)), "__none": own.isNull(), "__sum": F.when(worded, F.unhex(F.md5(whole.cast("binary"))))})
    name = ["__own", "__none", "__sum"]
    first = named.filter(F.col("__sum").isNotNull()).join(best, name, "left_semi").dropDuplicates(name)
    return first.unionByName(named.filter(F.col("__sum").isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])
