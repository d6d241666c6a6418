"""Lookup joins. Sides are left unhinted: Spark broadcasts one only when its size is known to be
small, and otherwise shuffles, splitting skewed partitions at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Join to an aggregate (or distinct) of the same keys, so that a hot key can be split.

    Spark splits a skewed join partition only where both sides come straight from a shuffle. An
    aggregate by the join keys is already partitioned by them, so its side would not be shuffled
    again. The hash as one more key asks for that shuffle; it is equal whenever the keys are.
    """
    names = {k: f"__r_{k}" for k in keys}
    tagged = left.withColumn("__lh", F.xxhash64(*keys))
    other = right.withColumn("__rh", F.xxhash64(*keys)).withColumnsRenamed(names)
    same = F.col("__lh") == F.col("__rh")
    for k in keys:
        mine, theirs = F.col(k), F.col(names[k])
        same = same & (mine.eqNullSafe(theirs) if null_safe else mine == theirs)
    return tagged.join(other, same, how).drop("__lh", "__rh", *names.values())


def replace_from(df: DataFrame, mapping: DataFrame, key: str, new: str) -> DataFrame:
    """Replace ``key`` by the mapped ``new``; a key the mapping lacks becomes null."""
    return df.join(mapping, key, "left").withColumn(key, F.col(new)).drop(new)


def require_lookup(df: DataFrame, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """Left lookup that fails the job when a key has no entry."""
    message = F.concat(F.lit("no entry for: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    found = mapping.withColumn("__hit", F.lit(True))
    return (
        df.join(found, key, "left")
        .withColumn(value, F.when(F.col("__hit"), F.col(value)).otherwise(F.raise_error(message)))
        .drop("__hit")
    )


def keep_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return df.join(listed.select(key), key, "left_semi")


def not_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return df.join(listed.select(key), key, "left_anti")


def with_label_index(images: DataFrame, labels: DataFrame, key: str = "synset") -> DataFrame:
    """Attach the label number; images of unlisted classes are left out."""
    return images.join(labels.select(key, "label"), key, "inner")


def label_by_file_number(files: DataFrame, labels: DataFrame, name: str = "filename") -> DataFrame:
    """Positional join: file number i, read from the digits that end the base name, gets line i."""
    number = F.regexp_extract(F.col(name), r"(\d+)(?:\.[^./]*)?$", 1)
    keyed = files.withColumn("line_no", number.try_cast("bigint"))
    return keyed.join(labels.select("line_no", "synset"), "line_no", "left").drop("line_no")


def complete_samples(samples: DataFrame, files: DataFrame, expected: int, key: str = "sample_id") -> DataFrame:
    """Samples with exactly ``expected`` matching files."""
    counts = files.groupBy(key).agg(F.count(F.lit(1)).alias("n_files"))
    return samples.join(counts.filter(F.col("n_files") == expected).select(key), key, "left_semi")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by name, duplicates kept; columns one side lacks become null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
