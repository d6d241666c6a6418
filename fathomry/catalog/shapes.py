"""Reshaping (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomry.catalog import standins as S
from fathomry.catalog.base import query, table
from fathomry.operators import report

NPS = [16, 32, 48]
STORAGES = ["na", "nfs", None]
LINES = range(1, 8)


def _is(column: str, value) -> str:
    return f"{column} IS NULL" if value is None else f"{column} = {value!r}"


@query(
    "r01_unstack",
    f"WITH {S.TRAINING_CTE} SELECT model, "
    + ", ".join(
        f'{fn}(num_batches) FILTER (WHERE np = {n} AND {_is("storage_type", s)}) AS "num_batches_{stat}_{report.pivot_name((n, s))}"'
        for fn, stat in (("avg", "mean"), ("max", "max"))
        for n in NPS
        for s in STORAGES
    )
    + " FROM runs GROUP BY 1",
)
def _(spark, sf):
    return report.pivot_stats(S.training_runs(spark, sf), ["model"], ["np", "storage_type"], {"num_batches": ["mean", "max"]})


@query(
    "r02_unstack_unique",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, "
    + ", ".join(f"max(l_quantity) FILTER (WHERE l_linenumber = {i}) AS l_quantity_{i}" for i in LINES)
    + " FROM lineitem GROUP BY 1, 2, 3, 4",
)
def _(spark, sf):
    items = table(spark, sf, "lineitem")
    return report.unique_pivot(items, ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"], "l_linenumber", "l_quantity", list(LINES))


@query(
    "r03_stack_then_unstack",
    f"WITH {S.TRAINING_CTE} SELECT model, "
    + ", ".join(
        f"count(num_batches) FILTER (WHERE np = {n})::DOUBLE AS value_max_{n}_count, avg(num_batches) FILTER (WHERE np = {n}) AS value_max_{n}_mean" for n in NPS
    )
    + " FROM runs GROUP BY 1",
)
def _(spark, sf):
    stacked = report.stack_stats(S.training_runs(spark, sf), ["model", "np"], "num_batches", ["count", "mean"])
    return report.pivot_stats(stacked, ["model"], ["np", "agg"], {"value": ["max"]}, [(n, s) for n in NPS for s in ("count", "mean")])


@query(
    "r04_flat_column_names",
    f"""WITH {S.TRAINING_CTE} SELECT storage_type, """
    + ", ".join(f"{fn}(num_copies) FILTER (WHERE np = {n}) AS num_copies_{stat}_{n}" for fn, stat in (("min", "min"), ("sum", "sum")) for n in NPS)
    + " FROM runs GROUP BY 1",
)
def _(spark, sf):
    return report.pivot_stats(S.training_runs(spark, sf), ["storage_type"], ["np"], {"num_copies": ["min", "sum"]}, NPS)
