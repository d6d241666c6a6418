"""Derived measures of experiment records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Left edges of the coverage bins; the last edge closes the last bin.
COVERAGE_EDGES = [35, 40, 45, 50, 51.7, 68, 80, 85]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coverage_bin(value: str | Column, edges: list[float] = COVERAGE_EDGES) -> Column:
    """Left-closed bins named by their rounded left edge; null outside all bins."""
    v = _col(value)
    out = F.when(v < edges[0], F.lit(None).cast("double"))
    for low, high in zip(edges, edges[1:]):
        out = out.when((v >= low) & (v < high), F.lit(float(round(low))))
    return out


def lookup(key: str | Column, mapping: Mapping[str, float]) -> Column:
    """Value of a literal map, null for an unknown key."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), _col(key))


def data_layout(input_dir: Column, temp_dir: Column, shared: list[str], local: list[str], shared_name: str) -> Column:
    """``mixed``, ``all_<shared_name>``, ``all_local`` or null, by where input and scratch lie."""
    from fathomry.functions.text import contains_any

    in_shared, in_local = contains_any(input_dir, shared), contains_any(input_dir, local)
    tmp_shared, tmp_local = contains_any(temp_dir, shared), contains_any(temp_dir, local)
    return (
        F.when(in_shared & tmp_local, F.lit("mixed"))
        .when(in_shared & tmp_shared, F.lit(f"all_{shared_name}"))
        .when(in_local & tmp_local, F.lit("all_local"))
    )


def array_sum(values: str | Column) -> Column:
    """Sum of an array of numbers; null elements count as nothing."""
    return F.aggregate(_col(values), F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0)))


def nested_sum(values: str | Column) -> Column:
    return array_sum(F.flatten(_col(values)))


def nested_size(values: str | Column) -> Column:
    return F.size(F.flatten(_col(values)))


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
