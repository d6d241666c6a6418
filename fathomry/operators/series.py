"""Counters and labelled metrics: rates, running values, rolling averages, values on a time grid.

``t`` columns are numeric (seconds as double, or microseconds as bigint). ``width`` is the length of
the time chunks a long series is worked on in; without it the chunks are fitted to the data, which
runs a small aggregate when the frame is built.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.operators.lookups import spread_join
from fathomry.operators.ordered import fit_width, next_row, previous_row, running, trailing_previous, trailing_sums


def since_start(df: DataFrame, t: str = "t") -> DataFrame:
    """Time minus the smallest time of the whole frame, by scalar subquery."""
    start = df.agg(F.min(t)).scalar()
    return df.withColumn(t, F.col(t) - start)


def since_series_minimum(df: DataFrame, keys: Sequence[str], value: str = "counter") -> DataFrame:
    """Counter minus the smallest value of its series. The minimum is aggregated map-side and joined
    back, so a hot series is never gathered."""
    low = df.groupBy(*keys).agg(F.min(value).alias("__low"))
    joined = spread_join(df, low, keys, null_safe=True)
    return joined.withColumn(value, F.col(value) - F.col("__low")).select(*df.columns)


def counter_rate(
    df: DataFrame,
    keys: Sequence[str],
    t: str = "t",
    value: str = "counter",
    unit: float = 1.0,
    width: float | None = None,
    lookback: float | None = None,
    resets: bool = False,
    out: str = "rate",
) -> DataFrame:
    """Change since the previous sample of the series per ``unit`` of ``t``.

    The first sample of a series has no rate and gives no row. ``lookback`` also drops samples
    whose predecessor is further away. ``resets`` counts from zero after a fall of the counter. Samples of one
    time follow their value; between them there is no rate but null.
    """
    carry = {"__t0": t, "__v0": value}
    if lookback is None:
        paired = previous_row(df, keys, t, carry, width, ties=[value])
    else:
        paired = trailing_previous(df, keys, t, lookback, carry, width, ties=[value])
    delta = F.col(value) - F.col("__v0")
    if resets:
        delta = F.when(F.col(value) < F.col("__v0"), F.col(value)).otherwise(delta)
    seconds = (F.col(t) - F.col("__t0")) / F.lit(unit)
    return (
        paired.filter(F.col("__t0").isNotNull())
        .withColumn(out, F.try_divide(delta, seconds))
        .drop("__t0", "__v0")
    )


# A port counter counts 4-byte words; bits per second to Gbit/s for 8-bit bytes.
WORD_BYTES = 4
GBPS_PER_BYTE = 8e-9
MB_PER_WORD = 4e-6


def port_rate_gbps(df: DataFrame, keys: Sequence[str], t: str = "t", value: str = "counter", width: float | None = None) -> DataFrame:
    rated = counter_rate(df, keys, t, value, width=width)
    return rated.withColumn("rate_gbps", F.col("rate") * WORD_BYTES * GBPS_PER_BYTE).drop("rate")


def running_max(df: DataFrame, keys: Sequence[str], t: str, value: str, out: str, width: float | None = None) -> DataFrame:
    return running(df, keys, t, {out: ("max", value)}, width)


def avg_over_time(df: DataFrame, keys: Sequence[str], t: str, value: str, span: float, out: str, width: float | None = None) -> DataFrame:
    """Average of the samples in the closed range [t - span, t], at each sample.

    Null values count for nothing; a range with a value that is not finite has no number (NaN).
    """
    v = F.col(value).cast("double")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    sums = {"__sum": F.when(finite, v), "__n": F.when(finite, 1).otherwise(0), "__odd": F.when(~finite, 1).otherwise(0)}
    summed = trailing_sums(df, keys, t, span, sums, width)
    average = F.when(F.col("__odd") > 0, F.lit(float("nan"))).when(F.col("__n") > 0, F.col("__sum") / F.col("__n"))
    return summed.withColumn(out, average).drop(*sums)


def avg_at_step(df: DataFrame, keys: Sequence[str], t: str, value: str, step: int, span: int) -> DataFrame:
    """Average of the samples in the closed range [step_t - span, step_t], at each multiple of ``step`` whose range has
    any. Columns: keys, step_t, average.

    Samples are summed once, by panes that divide both lengths; a pane adds its sum to each step whose range holds
    it, and the samples of its last moment also to the step ``span`` later, which begins with them.
    """
    pane = math.gcd(step, span)
    known = df.filter(F.col(value).isNotNull() & F.col(t).isNotNull())
    edge = F.col(t) == F.col("__pane")
    panes = known.withColumn("__pane", _grid_time(t, pane)).groupBy(*keys, "__pane").agg(
        F.sum(value).alias("__sum"), F.count(value).alias("__n"),
        F.sum(F.when(edge, F.col(value))).alias("__edge_sum"), F.count(F.when(edge, 1)).alias("__edge_n"),
    )
    first = F.ceil(F.col("__pane") / F.lit(step)) * F.lit(step)
    last = F.floor((F.col("__pane") + F.lit(span - 1)) / F.lit(step)) * F.lit(step)
    steps = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    later = F.col("__pane") + F.lit(span)
    whole = panes.select(*keys, F.explode(steps).alias("step_t"), "__sum", "__n")
    edges = panes.filter((later % step == 0) & (F.col("__edge_n") > 0)).select(*keys, later.cast("bigint").alias("step_t"), F.col("__edge_sum").alias("__sum"), F.col("__edge_n").alias("__n"))
    sums = whole.unionByName(edges).groupBy(*keys, "step_t").agg((F.sum("__sum") / F.sum("__n")).alias("average"))
    return sums.select(*keys, "step_t", "average")


def over_series(at_steps: DataFrame, value: str) -> DataFrame:
    """Sum, average and number of the series' values at each step."""
    return at_steps.groupBy("step_t").agg(F.sum(value).alias("total"), F.avg(value).alias("average"), F.count(value).alias("series"))


def _on_grid(per_step: DataFrame, keys: Sequence[str], step: int, until, width: float) -> DataFrame:
    """Repeat each step's latest sample on the following grid times, up to the next step that has
    its own sample and up to ``until``. Input has one row per series and step."""
    reach = F.floor(until / F.lit(step)) * F.lit(step)
    # ``least`` skips nulls: right for the last step of a series, wrong for a missing ``until``.
    last = F.when(until.isNotNull(), F.least(reach, F.col("__next") - F.lit(step)))
    return (
        next_row(per_step, keys, "step_t", {"__next": "step_t"}, width)
        .withColumn("__last", last)
        .filter(F.col("__last") >= F.col("step_t"))
        .withColumn("step_t", F.explode(F.sequence("step_t", "__last", F.lit(step).cast("bigint"))))
        .drop("__last", "__next")
    )


def _grid_time(t: str, step: int):
    return (F.ceil(F.col(t) / F.lit(step)) * F.lit(step)).cast("bigint")


def sample_at_step(
    df: DataFrame, keys: Sequence[str], t: str, value: str, step: int, lookback: int, width: float | None = None
) -> DataFrame:
    """Instant vector: at each multiple of ``step`` the latest sample of the closed range
    [step_t - lookback, step_t]; of several at one time the greatest. Columns: keys, step_t, value."""
    width = width or fit_width(df, keys, t)
    latest = F.max(F.struct(F.col(t).alias("__t"), F.col(value).alias("__v")))
    per_step = df.filter(F.col(t).isNotNull()).groupBy(*keys, _grid_time(t, step).alias("step_t")).agg(latest.alias("__s"))
    per_step = per_step.select(*keys, "step_t", "__s.__t", F.col("__s.__v").alias(value))
    return _on_grid(per_step, keys, step, F.col("__t") + F.lit(lookback), width).select(*keys, "step_t", value)


def irate_at_step(
    df: DataFrame, keys: Sequence[str], t: str, value: str, step: int, span: int, unit: float, width: float | None = None
) -> DataFrame:
    """Rate from the last two samples of the closed range [step_t - span, step_t] on the grid."""
    width = width or fit_width(df, keys, t)
    paired = trailing_previous(df, keys, t, span, {"__t0": t, "__v0": value}, width, ties=[value])
    latest = F.max(F.struct(F.col(t).alias("__t"), F.col(value).alias("__v"), "__t0", "__v0"))
    per_step = paired.groupBy(*keys, _grid_time(t, step).alias("step_t")).agg(latest.alias("__s")).select(*keys, "step_t", "__s.*")
    # The next step is looked up before samples without a partner are dropped: such a sample
    # still ends the validity of the one before it.
    delta = F.when(F.col("__v") < F.col("__v0"), F.col("__v")).otherwise(F.col("__v") - F.col("__v0"))
    seconds = (F.col("__t") - F.col("__t0")) / F.lit(unit)
    return (
        _on_grid(per_step, keys, step, F.col("__t0") + F.lit(span), width)
        .withColumn("irate", F.try_divide(delta, seconds))
        .select(*keys, "step_t", "irate")
    )


def bucket_derivative(
    df: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], bucket: float, unit: float, width: float | None = None
) -> DataFrame:
    """Largest value per bucket and its change per ``unit`` since the series' previous bucket.

    Columns: keys, ``bucket_t``, and ``<value>_top`` and ``<value>_derivative`` per value.
    """
    width = width or fit_width(df, keys, t)
    start = (F.floor(F.col(t) / F.lit(bucket)) * F.lit(bucket)).cast("bigint")
    tops = df.groupBy(*keys, start.alias("bucket_t")).agg(*[F.max(v).alias(f"{v}_top") for v in values])
    carry = {"__before": "bucket_t", **{f"__old_{v}": f"{v}_top" for v in values}}
    paired = previous_row(tops, keys, "bucket_t", carry, width)
    elapsed = (F.col("bucket_t") - F.col("__before")) / F.lit(unit)
    rated = {f"{v}_derivative": F.try_divide(F.col(f"{v}_top") - F.col(f"__old_{v}"), elapsed) for v in values}
    return paired.withColumns(rated).drop(*carry)


def traffic_by_bucket(
    df: DataFrame, keys: Sequence[str], t: str, inbound: str, outbound: str, bucket: float, unit: float
) -> DataFrame:
    """Traffic per bucket over all series: inbound falls count as 0, outbound is plotted negative
    and its falls are left out."""
    changes = bucket_derivative(df, keys, t, [inbound, outbound], bucket, unit)
    rx, tx = F.col(f"{inbound}_derivative"), F.col(f"{outbound}_derivative")
    received = F.when(rx.isNotNull(), F.greatest(rx, F.lit(0.0)))
    sent = F.when(tx > 0, -tx)
    return changes.groupBy("bucket_t").agg(F.sum(received).alias("inbound"), F.sum(sent).alias("outbound"))


def match_with_following(df: DataFrame, keys: Sequence[str], line_no: str, text: str, pattern: str, width: float | None = 100_000) -> DataFrame:
    """Lines that match, and the line after each of them."""
    tagged = df.withColumn("matched", F.coalesce(F.col(text).rlike(pattern), F.lit(False)))
    paired = previous_row(tagged, keys, line_no, {"__after": "matched"}, width)
    return paired.filter(F.col("matched") | F.coalesce(F.col("__after"), F.lit(False))).drop("__after")


def cumulative_steps(df: DataFrame, t: str, warmup: float, unit: float = 1.0, width: float | None = None, ties: Sequence[str] = ("rank", "step")) -> DataFrame:
    """Records and bytes since the end of warm-up, per rank and over all ranks, with MB/s."""
    start = df.agg(F.min(t)).scalar() + F.lit(warmup)
    warm = df.withColumn("__start", start).filter(F.col(t) >= F.col("__start"))
    # Fitted to all ranks together, so that it suits both passes.
    width = width or fit_width(df, [], t)
    per_rank = running(
        warm, ["rank"], t,
        {"rank_records": ("sum", "batch_size"), "rank_bytes": ("sum", "num_bytes")}, width, ties=ties[1:],
    )
    overall = running(
        per_rank, [], t,
        {"total_records": ("sum", "batch_size"), "total_bytes": ("sum", "num_bytes")}, width, ties=ties,
    )
    dt = (F.col(t) - F.col("__start")) / F.lit(unit)
    return overall.withColumns(
        {
            "rank_MB_per_sec": F.try_divide(F.col("rank_bytes").cast("double"), dt) / 1e6,
            "total_MB_per_sec": F.try_divide(F.col("total_bytes").cast("double"), dt) / 1e6,
        }
    ).drop("__start")


def step_alarms(df: DataFrame, t: str, warmup: float, warn_latency: float = 4.0, warn_sync: float = 30.0) -> DataFrame:
    """Slow steps after the first (or after warm-up), and slow synchronisations after warm-up."""
    start = df.agg(F.min(t)).scalar() + F.lit(warmup)
    warm = F.col(t) >= F.col("__start")
    flags = {
        "slow_step": (warm | (F.col("step") >= 1)) & (F.col("latency_sec") > warn_latency),
        "slow_sync": warm & (F.col("sync_latency_sec") > warn_sync),
    }
    return (
        df.withColumn("__start", start).withColumns(flags).drop("__start").filter(F.col("slow_step") | F.col("slow_sync"))
    )


def difference_of(df: DataFrame, keys: Sequence[str], metric: str, minuend: str, subtrahend: str, value: str, out: str) -> DataFrame:
    """One metric minus another where both exist on the same keys; a metric met more than once there fails the job."""
    of = lambda name: F.when(F.col(metric) == name, F.col(value))
    both = df.filter(F.col(metric).isin(minuend, subtrahend)).groupBy(*keys).agg(
        F.max(of(minuend)).alias("__a"), F.max(of(subtrahend)).alias("__b"),
        F.greatest(F.count(of(minuend)), F.count(of(subtrahend))).alias("__n"),
    )
    single = both.withColumn("__a", F.when(F.col("__n") <= 1, F.col("__a")).otherwise(F.raise_error(F.lit("a metric has several samples on one key"))))
    return single.filter(F.col("__a").isNotNull() & F.col("__b").isNotNull()).select(*keys, (F.col("__a") - F.col("__b")).alias(out))
