"""Registry of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fathomry.session import apply_defaults

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Run
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register ``run(spark, sf_dir)`` under ``name``; without ``sql`` only its rows are checked."""

    def add(run: Run) -> Run:
        if name in CATALOG:
            raise ValueError(f"query registered twice: {name}")
        CATALOG[name] = Entry(name, run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return apply_defaults(spark).read.parquet(f"{sf_dir}/{name}.parquet")
