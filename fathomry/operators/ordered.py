"""Order-dependent building blocks that never hold one whole series in one task.

A window over a series puts every row of it into one task, so one hot series would decide the
run time. Here a series is cut into chunks of its ordering column. The work inside a chunk is an
ordinary window; what one chunk owes the next travels in a summary with one row per chunk. The
chunk number is computed from the row alone, so a recomputed task always rebuilds the same chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomry.session import ensure_checkpoint_dir

MICROS = 1_000_000

# Rows of one series a task should meet at most.
CHUNK_ROWS = 2_000_000


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch, the integer form the chunked operators order by."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def fit_width(df: DataFrame, keys: Sequence[str], order: str, rows: int = CHUNK_ROWS) -> float:
    """Chunk width at which the densest chunk of the densest series holds about ``rows`` rows.

    Runs one aggregate over ``order``, and a second one over keys and order when the frame is large.
    Both combine map-side.
    """
    low, high, total = df.agg(F.min(order), F.max(order), F.count(order)).first()
    if not total or high == low:
        return 1.0
    span = float(high - low)
    if total <= rows:
        return span + 1.0
    cell = span / 1024
    cells = df.groupBy(*keys, F.floor((F.col(order) - F.lit(low)) / F.lit(cell)).alias("__cell")).count()
    densest = cells.agg(F.max("count")).first()[0]
    return max(cell * rows / densest, span / 1_000_000)


def _slot(keys: Sequence[str], order: str, width: float) -> Column:
    # One struct: null keys compare equal in the join, and a frame that is already partitioned by
    # the keys is still spread over its chunks.
    chunk = F.floor(F.col(order) / F.lit(width)).alias("chunk")
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], chunk)


def _chain(keys: Sequence[str]):
    """Chunks of one series in order. One row per chunk, so the group stays small."""
    parts = [F.col("__slot")[f"k{i}"] for i in range(len(keys))]
    return Window.partitionBy(*parts).orderBy(F.col("__slot")["chunk"])


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    carry: Mapping[str, str],
    width: float | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """``lag`` by one row within ``keys``; ``carry`` maps each new column to its source.

    ``ties`` makes the order total where ``order`` alone is not unique within a series. Without
    ``width`` the chunks are fitted to the data.
    """
    return _neighbour(df, keys, order, carry, width, ties, F.lag, F.max_by)


def next_row(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    carry: Mapping[str, str],
    width: float | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """``lead`` by one row within ``keys``, as ``previous_row`` is ``lag``: a chunk's last row takes what the next
    chunk of the series begins with."""
    return _neighbour(df, keys, order, carry, width, ties, F.lead, F.min_by)


def _neighbour(df, keys, order, carry, width, ties, shift, edge) -> DataFrame:
    width = width or fit_width(df, keys, order)
    tagged = df.withColumn("__slot", _slot(keys, order, width))
    rank = F.struct(order, *ties) if ties else F.col(order)
    inside = Window.partitionBy("__slot").orderBy(order, *ties)
    edges = tagged.groupBy("__slot").agg(*[edge(src, rank).alias(f"__edge_{out}") for out, src in carry.items()])
    beyond = edges.select("__slot", *[shift(f"__edge_{out}").over(_chain(keys)).alias(f"__far_{out}") for out in carry])
    near = tagged.withColumn("__end", shift(F.lit(False), 1, True).over(inside)).withColumns(
        {f"__near_{out}": shift(src).over(inside) for out, src in carry.items()}
    )
    return near.join(beyond, "__slot", "left").select(
        *df.columns,
        *[F.when(F.col("__end"), F.col(f"__far_{out}")).otherwise(F.col(f"__near_{out}")).alias(out) for out in carry],
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Mapping[str, tuple[str, str]],
    width: float | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Cumulative ``sum`` or ``max`` up to each row; ``measures`` maps output to (how, source)."""
    width = width or fit_width(df, keys, order)
    aggs = {"sum": F.sum, "max": F.max}
    tagged = df.withColumn("__slot", _slot(keys, order, width))
    inside = (
        Window.partitionBy("__slot")
        .orderBy(order, *ties)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = tagged.groupBy("__slot").agg(
        *[aggs[how](src).alias(f"__all_{out}") for out, (how, src) in measures.items()]
    )
    earlier = _chain(keys).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "__slot",
        *[
            aggs[how](f"__all_{out}").over(earlier).alias(f"__old_{out}")
            for out, (how, _) in measures.items()
        ],
    )
    local = tagged.withColumns(
        {f"__in_{out}": aggs[how](src).over(inside) for out, (how, src) in measures.items()}
    )

    def merged(out: str, how: str) -> Column:
        old, new = F.col(f"__old_{out}"), F.col(f"__in_{out}")
        if how == "max":
            return F.greatest(old, new)
        return F.when(old.isNull(), new).otherwise(old + F.coalesce(new, F.lit(0)))

    return local.join(before, "__slot", "left").select(
        *df.columns, *[merged(out, how).alias(out) for out, (how, _) in measures.items()]
    )


def _with_halo(df: DataFrame, keys: Sequence[str], order: str, span: float, width: float | None) -> DataFrame:
    """Give every row its chunk, and a copy in the next chunk if it can still be in a frame there.

    A frame then never needs a second chunk. Chunks are at least ``span`` wide, so a row has one
    extra copy at most.
    """
    width = max(width or fit_width(df, keys, order), span)
    own = F.floor(F.col(order) / F.lit(width))
    reach = F.floor((F.col(order) + F.lit(span)) / F.lit(width))
    spread = df.withColumn("__own", own).withColumn("__chunk", F.explode(F.sequence("__own", reach)))
    return spread.withColumn("__slot", F.struct(*[F.col(k) for k in keys], "__chunk"))


def _without_halo(df: DataFrame) -> DataFrame:
    return df.filter(F.col("__chunk") == F.col("__own")).drop("__own", "__chunk", "__slot")


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    span: float,
    measures: Mapping[str, Column],
    width: float | None = None,
) -> DataFrame:
    """Window functions over the rows of the last ``span`` units, both ends included."""
    frame = Window.partitionBy("__slot").orderBy(order).rangeBetween(-span, Window.currentRow)
    spread = _with_halo(df, keys, order, span, width)
    return _without_halo(spread.withColumns({out: agg.over(frame) for out, agg in measures.items()}))


def trailing_sums(
    df: DataFrame, keys: Sequence[str], order: str, span: float, sums: Mapping[str, Column], width: float | None = None
) -> DataFrame:
    """Sums over the rows of the last ``span`` units, both ends included, at a fixed cost per row.

    A frame is what the chunk holds up to the row, less what it holds up to ``span`` before, and the rows of
    that very moment again. All three frames grow or hold one moment, so none is summed anew for each row.
    Sums of whole numbers are exact; of others the error is that of a sum over the chunk.
    """
    ordered = Window.partitionBy("__slot").orderBy(order)
    until, before = (ordered.rangeBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -span))
    edge = ordered.rangeBetween(-span, -span)
    spread = _with_halo(df, keys, order, span, width)
    zero = lambda total: F.coalesce(total, F.lit(0))
    counted = {out: F.sum(c).over(until) - zero(F.sum(c).over(before)) + zero(F.sum(c).over(edge)) for out, c in sums.items()}
    return _without_halo(spread.withColumns(counted))


def trailing_previous(
    df: DataFrame, keys: Sequence[str], order: str, span: float, carry: Mapping[str, str], width: float | None = None, ties: Sequence[str] = ()
) -> DataFrame:
    """``lag`` by one row that only has to look back ``span`` units; null further back."""
    frame = Window.partitionBy("__slot").orderBy(order, *ties)
    near = F.col(order) - F.lag(order).over(frame) <= F.lit(span)
    spread = _with_halo(df, keys, order, span, width)
    return _without_halo(spread.withColumns({out: F.when(near, F.lag(src).over(frame)) for out, src in carry.items()}))


def ordered_positions(
    df: DataFrame, order: Sequence[str | Column], out: str = "position", partitions: int | None = None
) -> DataFrame:
    """0-based position of every row in the global order, exact and without a global window.

    Range partitions are sorted on their own and checkpointed, so that the partition a row is in
    is fixed; then each partition starts where the ones before it end. Without ``partitions`` small
    neighbouring ranges are merged at run time.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    low_bits = (1 << 33) - 1
    placed = (
        ranged.sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit(low_bits)))
        .checkpoint()
    )
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    return (
        placed.join(starts, "__part")
        .withColumn(out, F.col("__start") + F.col("__row"))
        .select(*df.columns, out)
    )


def shuffled_positions(
    df: DataFrame, key: str, seed: int, position: str = "position", total: str = "total", hex_digits: int = 4
) -> DataFrame:
    """Repeatable shuffle: position of each row in the order of ``md5(key:seed)``, and the row total.

    ``key`` identifies a row; two rows with one key fail the job, as their order would be open.

    The leading hex digits make evenly filled buckets; a bucket is ranked on its own and starts
    after the buckets before it. The summary has at most ``16 ** hex_digits`` rows.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    hashed = df.withColumn("__digest", digest).withColumn("__bucket", F.substring("__digest", 1, hex_digits))
    sizes = hashed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.orderBy("__bucket")
    starts = sizes.select(
        "__bucket",
        F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"),
        F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total),
    )
    inside = Window.partitionBy("__bucket").orderBy("__digest", key)
    number = F.when(
        F.lag(key).over(inside) == F.col(key), F.raise_error(F.concat(F.lit("key is not unique: "), F.col(key).cast("string")))
    ).otherwise(F.row_number().over(inside) - 1)
    return (
        hashed.withColumn("__row", number)
        .join(starts, "__bucket")
        .withColumn(position, F.col("__start") + F.col("__row"))
        .select(*df.columns, position, total)
    )
