"""Grouped reports: statistics by parameter, pivots with flat names, comparison with a baseline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from fathomry.operators.lookups import spread_join

#: Shares a group is dealt out to before its first rows are taken.
SHARES = 32

STATS = {
    "size": lambda c: F.count(F.lit(1)),
    "count": F.count,
    "min": F.min,
    "mean": F.avg,
    "max": F.max,
    "sum": F.sum,
}


def max_rate_by_servicer(
    df: DataFrame, batch: str | None = None, servicer: str = "servicer", rate: str = "interest_rate"
) -> DataFrame:
    """The scan benchmark query; with ``batch`` one grouped query stands for one run per batch."""
    keys = [batch, servicer] if batch else [servicer]
    return df.groupBy(*keys).agg(F.max(rate).alias(f"max_{rate}"))


def checksum(df: DataFrame, column: str) -> DataFrame:
    """Sum and row count. The sum is taken in decimal(38), so large identifiers cannot overflow."""
    return df.agg(
        F.sum(F.col(column).cast("decimal(38,0)")).alias("checksum"), F.count(F.lit(1)).alias("rows")
    )


def group_sizes(df: DataFrame, *keys: str, drop_null_keys: bool = True) -> DataFrame:
    if drop_null_keys:
        for key in keys:
            df = df.filter(F.col(key).isNotNull())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return group_sizes(df, column).orderBy(F.desc("size"), column)


def stats_by(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Sequence[str]]) -> DataFrame:
    """``{metric: [stat, ...]}`` per group, columns named ``metric_stat``."""
    return df.groupBy(*keys).agg(
        *[STATS[s](F.col(m)).alias(f"{m}_{s}") for m, stats in measures.items() for s in stats]
    )


def _part(value: Any) -> str:
    r"""One part of a pivot key as text: null is ``\N``; backslash and underscore are escaped, so no two keys merge."""
    if value is None:
        return "\\N"
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return text.replace("\\", "\\\\").replace("_", "\\_")


def pivot_name(key: Any) -> str:
    """Name of a pivot key: its parts joined by an underscore."""
    return "_".join(map(_part, key if isinstance(key, (tuple, list)) else (key,)))


def pivot_key(columns: Sequence[str]) -> Column:
    """``pivot_name`` as a column."""
    parts = [F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\\", r"\\\\"), "_", r"\\_") for c in columns]
    return F.concat_ws("_", *[F.coalesce(p, F.lit("\\N")) for p in parts])


def _keyed(df: DataFrame, cols: Sequence[str], values: Sequence[Any] | None) -> tuple[DataFrame, list[str]]:
    """Rows with ``__key``, and the names of all keys. A row whose key is not in ``values`` fails the job."""
    keyed = df.withColumn("__key", pivot_key(cols))
    if values is None:
        return keyed, sorted(r[0] for r in keyed.select("__key").distinct().collect())
    names = [pivot_name(v) for v in values]
    listed = F.when(F.col("__key").isin(names), F.col("__key"))
    return keyed.withColumn("__key", F.coalesce(listed, F.raise_error(F.concat(F.lit("key not listed in pivot: "), "__key")).cast("string"))), names


def pivot_stats(
    df: DataFrame,
    rows: Sequence[str],
    cols: Sequence[str],
    measures: Mapping[str, Sequence[str]],
    values: Sequence[Any] | None = None,
) -> DataFrame:
    """Unstack ``cols`` into columns ``metric_stat_key``, key parts written as in ``pivot_name``.

    ``values`` lists all keys, as tuples or as single values, which fixes the schema; a row with another key
    fails the job. Without it the keys are looked up in one job of its own; they are columns of the result,
    so they are few.
    """
    names = [(m, s) for m, stats in measures.items() for s in stats]
    # A spare aggregate keeps Spark's "<key>_<name>" naming when only one statistic is asked for.
    aggs = [STATS[s](F.col(m)).alias(f"{m}_{s}") for m, s in names] + [F.count(F.lit(1)).alias("__n")]
    keyed, keys = _keyed(df, cols, values)
    wide = keyed.groupBy(*rows).pivot("__key", keys).agg(*aggs)
    return wide.select(
        *rows, *[F.col(f"`{v}_{m}_{s}`").alias(f"{m}_{s}_{v}") for m, s in names for v in keys]
    )


def unique_pivot(df: DataFrame, rows: Sequence[str], col: str, metric: str, values: Sequence[Any] | None = None) -> DataFrame:
    """Unstack without aggregating; two rows for one cell fail the job, and so does a key not in ``values``."""
    cell = df.groupBy(*rows, col).agg(F.max(metric).alias("__v"), F.count(F.lit(1)).alias("__n"))
    checked = cell.select(
        *rows,
        col,
        F.when(F.col("__n") > 1, F.raise_error(F.lit("duplicate entry in pivot"))).otherwise(F.col("__v")).alias("__v"),
    )
    keyed, keys = _keyed(checked, [col], values)
    wide = keyed.groupBy(*rows).pivot("__key", keys).agg(F.first("__v"))
    return wide.select(*rows, *[F.col(f"`{v}`").alias(f"{metric}_{v}") for v in keys])


def stack_stats(df: DataFrame, keys: Sequence[str], metric: str, stats: Sequence[str]) -> DataFrame:
    """One row per group and statistic: (keys, agg, value)."""
    wide = stats_by(df, keys, {metric: stats})
    wide = wide.select(*keys, *[F.col(f"{metric}_{s}").cast("double").alias(s) for s in stats])
    return wide.unpivot(list(keys), list(stats), "agg", "value")


def versus_baseline(
    df: DataFrame, row_keys: Sequence[str], baseline: Mapping[str, Any], metric: str, how: str = "percent"
) -> DataFrame:
    """Compare each row's metric with the baseline row that shares its row keys.

    ``percent`` gives (x / base - 1) * 100, ``ratio`` gives x / base. A missing or zero baseline
    gives null. Two baseline rows for one row key fail the job.
    """
    is_base = F.lit(True)
    for name, wanted in baseline.items():
        is_base = is_base & (F.col(name) == F.lit(wanted))
    base = df.filter(is_base).groupBy(*row_keys).agg(F.max(metric).alias("__base"), F.count(F.lit(1)).alias("__n"))
    one = F.when(F.col("__n") > 1, F.raise_error(F.lit("duplicate baseline")).cast("double")).otherwise(F.col("__base"))
    base = base.select(*row_keys, one.alias("__base"))
    ratio = F.try_divide(F.col(metric), F.col("__base"))
    value = ratio if how == "ratio" else (ratio - 1.0) * 100.0
    return spread_join(df, base, row_keys).withColumn(f"{metric}_{how}", value).drop("__base")


def first_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; 0 keeps all rows.

    Groups are dealt out by a hash of the row first and cut to ``n`` there, so that what meets in one task
    is at most ``n`` rows from each share of a hot group.
    """
    if n == 0:
        return df
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, MapType)]), F.lit(SHARES))
    own = F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order))
    cut = df.withColumn("__salt", salt).withColumn("__rank", own).filter(F.col("__rank") <= n).drop("__salt", "__rank")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return cut.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")
