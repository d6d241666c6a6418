"""Operator 8: SimHash fingerprints, and a search within a Hamming radius by permuted block tables.

Each folded word of a text votes with its weight, one plus the logarithm of its count, on the sign of 64 bits of
its hash; the fingerprint keeps the signs. Two fingerprints within radius ``k`` agree in all but ``k`` of
``blocks`` blocks, wherever the differing bits are. So each choice of ``blocks - k`` blocks gives a table keyed by
these blocks' bits, and the tables together miss no pair.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomry.llm.texts import WordHashes, fold_words

BITS = 64
RADIUS = 3
BLOCKS = 6
#: Rows of a range of keys.
RANGE = 20_000


def fingerprint(words: list[bytes], hashes: WordHashes) -> int:
    """64-bit fingerprint; of no words it is 0."""
    if not words:
        return 0
    counts = Counter(words)
    own = hashes.array(list(counts))
    weights = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    # Sorted, so that equal texts add in the same order; whole numbers, so that the order cannot matter.
    votes = np.round(weights * 1024).astype(np.int64)
    bits = np.unpackbits(own.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
    signs = 2 * (votes @ bits) > votes.sum()
    return int(np.packbits(signs, bitorder="little").view("<u8")[0])


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1 - (a ^ b).bit_count() / BITS


def hexadecimal(value: int) -> str:
    return f"{value:016x}"


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (long, the 64 bits) of every row; null and empty texts, and texts without words, give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            own = [fingerprint(fold_words((t or "").encode()), hashes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.array(own, dtype=np.uint64).view(np.int64))], names=["key", "fingerprint"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, fingerprint long").withColumnRenamed("key", key)


def near_fingerprints(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, fingerprint: str = "fingerprint") -> DataFrame:
    """(query, fingerprint, distance): distinct fingerprints within ``radius`` of each distinct query fingerprint.

    Equal fingerprints are one, so copies make no bucket larger; join the rows back by fingerprint.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("radius must be smaller than blocks")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << edges[i + 1] - edges[i]) - 1) << edges[i] for i in chosen)
        masks.append(mask - (1 << BITS) if mask >> BITS - 1 else mask)

    def dealt(df: DataFrame, name: str) -> DataFrame:
        tables = F.array(*[F.struct(F.lit(i).alias("table"), F.col(name).bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(masks)])
        return df.select(F.col(fingerprint).alias(name)).filter(F.col(name).isNotNull()).distinct().select(name, F.explode(tables).alias("t")).select(name, "t.*")

    met = dealt(queries, "query").join(dealt(prints, "print"), ["table", "block"])
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("print")))
    near = met.withColumn("distance", distance).filter(F.col("distance") <= radius).select("query", "print", "distance").distinct()
    return near.withColumnRenamed("print", fingerprint)


def _ranges(docs: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Rows with ``range``, a number that rises with the key; ``RANGE`` rows each at most, about. Null keys have the lowest."""
    total = docs.count()
    spread = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(1, math.ceil(total / RANGE), min(spread, total // 200))
    cuts = docs.select(F.col(f"`{key}`").cast("double").alias("k")).approxQuantile("k", [i / pieces for i in range(1, pieces)], 0.2 / pieces) if pieces > 1 else []
    splits = [float("-inf"), *sorted({c for c in cuts if c is not None}), float("inf")]
    if len(splits) == 2:
        return docs.withColumn("range", F.lit(0)), 1
    cut = Bucketizer(splits=splits, inputCol="__k", outputCol="__range", handleInvalid="keep")
    kept = cut.transform(docs.withColumn("__k", F.col(f"`{key}`").cast("double")))
    return kept.withColumn("range", F.when(F.col("__k").isNull(), 0).otherwise(F.col("__range").cast("int"))).drop("__k", "__range"), len(splits) - 1


def with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's text.

    The next document is the one behind it in descending key order (ties: descending text), after the last the
    first. The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the next text. Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint (hexadecimal),
    near_edited, near_next (shares of equal bits). Null texts are empty; null keys come last. A single row is
    its own next; an empty table gives no rows. Other columns are ignored.

    Documents are cut into ranges of keys. The first row of each range is copied to the range before it, and the
    very first row to the last, so that each range is worked on by itself.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    ranged, _ = _ranges(rows, "key")
    down = [F.col("key").desc_nulls_last(), F.col("text").desc()]
    # The first row of a range: its greatest key, then its greatest text.
    top = ranged.groupBy("range").agg(F.max(F.struct(F.col("key").isNotNull().alias("known"), F.col("key"))).alias("m")).select(F.col("range").alias("top_range"), F.col("m.key").alias("top_key"))
    heads = ranged.join(F.broadcast(top), (F.col("range") == F.col("top_range")) & F.col("key").eqNullSafe(F.col("top_key"))).groupBy("range", "key").agg(F.max("text").alias("text"))
    # One row per range: the range before each in document order; before the first stands the last.
    order = Window.orderBy(F.col("range").desc())
    before = top.select(F.col("top_range").alias("range")).select("range", F.coalesce(F.lag("range").over(order), F.min("range").over(Window.partitionBy())).alias("before"))
    halo = heads.join(F.broadcast(before), "range").select(F.col("before").alias("range"), "key", "text", F.lit(True).alias("halo"))
    dealt = ranged.select("range", "key", "text", F.lit(False).alias("halo")).unionByName(halo).repartition("range").sortWithinPartitions(F.col("range"), F.col("halo"), *down)
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_edited, schema).withColumnRenamed("key", key)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    hashes = WordHashes()
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def row(own, then):
        key, text, fp, key_type = own
        _, other, other_fp, _ = then
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        data = edited.encode()
        efp = fingerprint(fold_words(data), hashes)
        return key, len(text), hashlib.sha256(data).hexdigest(), hexadecimal(fp), hexadecimal(efp), likeness(fp, efp), likeness(fp, other_fp)

    waiting, at = None, None
    for batch in batches:
        kinds = [batch.column("key").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out = []
        for number, key, text, halo in zip(batch.column("range").to_pylist(), batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("halo").to_pylist()):
            own = key, text, fingerprint(fold_words(text.encode()), hashes), None
            if waiting is not None and at == number:
                out.append(row(waiting, own))
            waiting, at = None if halo else own, number
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
