"""Writers and data layouts. Each one replaces its target and returns the path it wrote."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomry.sources.files import slots

MIB = 1024 * 1024


def dataset_path(
    base: str, prefix: str, size: float, partitions: int, stripe_mib: int, compression: str, fmt: str
) -> str:
    """Path that names the parameters of the data set."""
    return f"{base.rstrip('/')}/{prefix}-{size:.2f}x-{partitions}p-{stripe_mib}MiB-{compression}.{fmt}"


def dataset_name(prefix: Column, size: Column, partitions: Column, stripe_mib: Column, compression: Column, fmt: Column) -> Column:
    return F.format_string("%s-%.2fx-%dp-%dMiB-%s.%s", prefix, size, partitions, stripe_mib, compression, fmt)


def write_orc(df: DataFrame, path: str, compression: str = "snappy", stripe_mib: int = 64, partitions: int | None = None) -> str:
    out = df.repartition(partitions) if partitions else df
    (
        out.write.mode("overwrite").format("orc")
        .option("compression", compression)
        .option("orc.stripe.size", stripe_mib * MIB)
        .save(path)
    )
    return path


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", partitions: int | None = None) -> str:
    out = df.repartition(partitions) if partitions else df
    out.write.mode("overwrite").parquet(path, compression=compression)
    return path


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, header: bool = True, **options) -> str:
    out = df.select(*columns) if columns else df
    out.write.mode("overwrite").csv(path, header=header, **options)
    return path


def append_results(df: DataFrame, path: str) -> str:
    """Append result records as bzip2 JSON lines."""
    df.write.mode("append").option("compression", "bzip2").json(path)
    return path


def write_files(df: DataFrame, root: str, path: str = "path", content: str = "bytes") -> str:
    """One file per row: ``content`` under ``path``, relative to ``root``. A file that is there is replaced, so
    a task that is run again does no harm. ``root`` is a mounted folder or one that Arrow's file systems open.
    Rows are dealt out by path, since a small table, read by one task, may stand for a great many files."""

    def write(batches):
        files, top = pafs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = f"{top}/{name}"
                folder = whole.rpartition("/")[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                with files.open_output_stream(whole) as out:
                    out.write(data or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = df.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    rows.repartition(slots(df.sparkSession), "path").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
    return root


def write_by_folder(df: DataFrame, path: str, folder: str, fmt: str = "parquet") -> str:
    """One folder per value. Rows are gathered by value, and values too large for one task are
    split over several, so a hot label costs more files instead of one long task."""
    df.hint("rebalance", folder).write.mode("overwrite").partitionBy(folder).format(fmt).save(path)
    return path


def write_shards(df: DataFrame, path: str, shards: int) -> str:
    """Sharded corpus. Shards are equal by construction and dealt out by hash, so nothing below runs twice
    for a sample of ranges."""
    (
        df.repartition(shards, "shard")
        .sortWithinPartitions("shard", "position")
        .write.mode("overwrite").partitionBy("shard").parquet(path)
    )
    return path


def replicate(df: DataFrame, copies: int, mounts: int = 16) -> DataFrame:
    """Every row ``copies`` times, with copy number and target mount; copies of a row are made in
    its own task. 0 copies give no rows."""
    if copies < 0:
        raise ValueError("copies must not be negative")
    numbers = F.sequence(F.lit(0), F.lit(copies - 1)) if copies else F.array().cast("array<int>")
    return df.withColumn("copy", F.explode(numbers)).withColumn(
        "target", F.pmod(F.col("copy"), F.lit(mounts)) + 1
    )


def bootstrap(df: DataFrame, multiplier: float, seed: int = 7) -> DataFrame:
    """Scale by sampling with replacement."""
    return df if multiplier == 1.0 else df.sample(True, multiplier, seed=seed)


def timed_runs(df: DataFrame, query: Callable[[DataFrame], DataFrame], runs: int = 3) -> list[float]:
    """Seconds per run of ``query`` over the persisted frame, which is released afterwards."""
    held = df.persist()
    try:
        held.count()
        seconds = []
        for _ in range(runs):
            begin = time.monotonic()
            query(held).write.format("noop").mode("overwrite").save()
            seconds.append(time.monotonic() - begin)
        return seconds
    finally:
        held.unpersist()
