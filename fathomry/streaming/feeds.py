"""Structured Streaming forms of the live feeds.

Results land as files, one folder per micro-batch. A batch that is run again replaces its own
folder, so a restart neither loses nor repeats rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.operators.series import counter_rate
from fathomry.session import drop_dir

WATERMARK = "10 minutes"


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Landed files as a stream. ``path`` may be a folder or a glob."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_to_files(
    stream: DataFrame, out: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None,
    late: list[int] | None = None,
) -> str:
    """Run over everything available; returns the folder holding ``batch=<n>`` folders.

    ``each`` turns a micro-batch into the rows to keep. The batch is written to the shared folder first, so that whatever
    ``each`` does reads files: a cached batch is worked out again where two stages reach a part of it at once or an
    executor is lost, and then two tasks write the same state. ``late`` takes the number of rows each micro-batch
    dropped behind the watermark.
    """

    def save(batch: DataFrame, number: int) -> None:
        arrived = f"{out}/arrived/{number}"
        if each:
            batch.write.mode("overwrite").parquet(arrived)
            batch = each(batch.sparkSession.read.schema(batch.schema).parquet(arrived), number)
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        if each:
            drop_dir(batch.sparkSession, arrived)

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()
    if late is not None:
        late += [op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators]
    return f"{out}/rows"


def latest_per_key(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Final state of an update-mode stream: each key's row of its last micro-batch."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    picked = rows.groupBy(*keys).agg(*[F.max_by(v, "batch").alias(v) for v in values])
    return picked.select(*keys, *values)


def windowed(stream: DataFrame, t: str, size: str, keys: Sequence[str], aggs: Sequence[Column], slide: str | None = None, delay: str = WATERMARK) -> DataFrame:
    """Tumbling or sliding window aggregate with a watermark; the window start is ``window_start``."""
    frame = F.window(t, size, slide) if slide else F.window(t, size)
    out = stream.withWatermark(t, delay).groupBy(frame.alias("__w"), *keys).agg(*aggs)
    return out.withColumn("window_start", F.col("__w.start")).drop("__w")


def _earlier(spark: SparkSession, out: str, name: str, number: int) -> DataFrame | None:
    """What micro-batch ``number - 1`` left under ``name``; None before the first."""
    return spark.read.parquet(f"{out}/{name}/batch={number - 1}") if number > 0 else None


def counter_feed(
    stream: DataFrame, out: str, keys: Sequence[str], t: str, value: str, unit: float,
    width: float | None = None, delay: float = 0.0, finish: bool = False, **rate,
) -> str:
    """Rates of a live counter feed whose samples may come out of order by up to ``delay`` (in units of ``t``).

    Samples are held until the latest time seen is ``delay`` past theirs, and then rated in order of time, each
    against the last sample before it. What comes later still is counted (``late_samples``) and left out, as
    are samples without a time. ``finish`` rates what is held at the end of the run; a later run takes it up again and
    replaces these rows.

    State is tables of one folder per micro-batch: held samples, the last rated sample of each series (with
    ``lookback``, only while it is near enough to matter), and the time up to which all is rated. Batch n reads
    what batch n - 1 left, replaces its own and deletes that of n - 2, so a repeated batch is harmless. Rates come from the chunked batch
    operator, so a hot series does not end in one task.
    """

    def rated(held: DataFrame, last: DataFrame | None, until, number: str) -> DataFrame:
        """Rates of held samples up to ``until``; the state that remains is written under ``number``."""
        ready = held.filter(F.col(t) <= F.lit(until)).withColumn("__old", F.lit(False))
        if last is not None:
            ready = ready.unionByName(last.withColumn("__old", F.lit(True)), allowMissingColumns=True)
        newest = ready.groupBy(*keys).agg(F.max(F.struct(t, value)).alias("__s")).select(*keys, "__s.*")
        if rate.get("lookback") is not None:
            newest = newest.filter(F.col(t) > F.lit(until) - F.lit(rate["lookback"]))
        newest.write.mode("overwrite").parquet(f"{out}/last/{number}")
        held.filter(F.col(t) > F.lit(until)).write.mode("overwrite").parquet(f"{out}/held/{number}")
        return counter_rate(ready, keys, t, value, unit=unit, width=width, **rate).filter(~F.col("__old")).drop("__old")

    def step(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        before, held, last = (_earlier(spark, out, name, number) for name in ("marks", "held", "last"))
        until = None if before is None else before.first()["until"]
        late = F.lit(False) if until is None else F.col(t) <= F.lit(until)
        newest, n_late = batch.agg(F.max(t), F.count_if(late)).first()
        times = [x for x in (until, None if newest is None else newest - delay) if x is not None]
        known = max(times, default=None)
        marks = [(None if known is None else float(known), n_late)]
        spark.createDataFrame(marks, "until double, late bigint").coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/batch={number}")
        for name in ("held", "last"):  # a batch that is run again needs only the one before it
            drop_dir(spark, f"{out}/{name}/batch={number - 2}")
        fresh = batch.filter(F.col(t).isNotNull() & ~late)
        fresh = fresh if held is None else fresh.unionByName(held)
        return rated(fresh, last, float("-inf") if known is None else known, f"batch={number}")

    rows = run_to_files(stream, out, each=step)
    spark = stream.sparkSession
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/marks")
    if finish and marks.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marks):  # else there was no batch yet
        done = spark.read.parquet(f"{out}/marks").groupBy().agg(F.max("batch")).first()[0]
        held, last = (spark.read.parquet(f"{out}/{name}/batch={done}") for name in ("held", "last"))
        end = held.agg(F.max(t)).first()[0]
        if end is not None:
            final = counter_rate(
                held.withColumn("__old", F.lit(False)).unionByName(last.withColumn("__old", F.lit(True)), allowMissingColumns=True),
                keys, t, value, unit=unit, width=width, **rate,
            )
            final.filter(~F.col("__old")).drop("__old").write.mode("overwrite").parquet(f"{rows}/batch={done + 1}")
    return rows


def late_samples(spark: SparkSession, rows: str) -> int:
    """Samples a counter feed has left out because all of their time was rated; ``rows`` is what it returned."""
    return spark.read.parquet(f"{rows.removesuffix('/rows')}/marks").agg(F.sum("late")).first()[0] or 0


def final_windows(stream: DataFrame, out: str, each: Callable[[DataFrame, int], DataFrame] | None = None) -> tuple[str, int]:
    """Run an aggregate of ``windowed``; each window is written once, when the watermark has passed its end.

    Returns the folder and how many rows came too late for their window. A window's rows are all in one
    micro-batch, so ``each`` may rank them. Windows the watermark has not reached stay in the state of the query and
    come in a later run.
    """
    late: list[int] = []
    rows = run_to_files(stream, out, mode="append", each=each, late=late)
    return rows, sum(late)


def totals_after_warm_up(
    stream: DataFrame, out: str, t: str, seconds: float, keys: Sequence[str], values: Sequence[str]
) -> str:
    """Running counts and sums per key of the rows from ``seconds`` after the least time the stream has shown on.

    Returns the folder whose last batch holds the totals: keys, rows, and each of ``values`` summed. The start is
    found in the stream. Rows before it are held, since an earlier start may still let them in; once the
    start no longer moves they are never more than the warm-up's.
    """

    def step(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        before, held, totals = (_earlier(spark, out, name, number) for name in ("starts", "held", "rows"))
        columns = [*keys, t, *values]
        known = batch.select(*columns).filter(F.col(t).isNotNull())
        known = known if held is None else known.unionByName(held)
        start = known.agg(F.min(t).alias("start"))
        start = start if before is None else start.unionByName(before).agg(F.min("start").alias("start"))
        start.coalesce(1).write.mode("overwrite").parquet(f"{out}/starts/batch={number}")
        drop_dir(spark, f"{out}/held/batch={number - 2}")
        first = spark.read.parquet(f"{out}/starts/batch={number}").scalar()
        warm = F.col(t) >= first + F.make_dt_interval(secs=F.lit(seconds))
        marked = known.withColumn("__warm", warm)
        marked.filter(~F.col("__warm")).drop("__warm").write.mode("overwrite").parquet(f"{out}/held/batch={number}")
        added = marked.filter("__warm").groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(v).alias(v) for v in values])
        if totals is not None:
            added = added.unionByName(totals.select(*keys, "rows", *values)).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in ("rows", *values)])
        return added

    return run_to_files(stream, out, each=step)


def last_batch(spark: SparkSession, rows: str) -> DataFrame:
    """Rows of the last micro-batch under ``rows``."""
    batches = spark.read.parquet(rows)
    return batches.filter(F.col("batch") == batches.agg(F.max("batch")).scalar()).drop("batch")


def windowed_load(
    stream: DataFrame, out: str, t: str, size: str, keys: Sequence[str], values: Mapping[str, str], delay: str = WATERMARK
) -> str:
    """Averages per window and key, ``values`` by name and column, as update-mode files. A top-n of one is only
    final over the latest row of every key, so it is taken from those files and not inside a micro-batch."""
    totals = windowed(stream, t, size, keys, [F.avg(c).alias(n) for n, c in values.items()], delay=delay)
    return run_to_files(totals, out, mode="update")


def after_warm_up(stream: DataFrame, t: str, start, seconds: float) -> DataFrame:
    """Rows from ``seconds`` after ``start`` on; totals taken of them count from zero there."""
    begin = F.lit(start).cast(stream.schema[t].dataType)
    return stream.filter(F.col(t) >= begin + F.make_dt_interval(secs=F.lit(seconds)))


# Fixed value: mount points that the feed drops.
DROPPED_MOUNTS = r"^/(sys|cgroup|proc|dev|etc|host|lib)($|/)"


def unmatched(column: str, pattern: str) -> Column:
    """Keep events whose field does not match the pattern, as a drop rule states it."""
    return ~F.coalesce(F.col(column).rlike(pattern), F.lit(False))


def first_seen(stream: DataFrame, t: str, keys: Sequence[str], delay: str = WATERMARK) -> DataFrame:
    """Drop repeats of an event that arrive within the watermark."""
    return stream.withWatermark(t, delay).dropDuplicatesWithinWatermark(list(keys))
