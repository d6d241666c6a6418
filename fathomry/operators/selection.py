"""Column and row selection, typed null fills and label matchers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def condition(column: Column, wanted: Any) -> Column:
    """Scalar: equal. Tuple (low, high): between, both ends included. List: any of. Null never matches."""
    if isinstance(wanted, tuple):
        low, high = wanted
        return column.between(low, high)
    if isinstance(wanted, (list, set, frozenset)):
        return column.isin(list(wanted))
    return column == F.lit(wanted)


def filter_dataframe(df: DataFrame, **conditions: Any) -> DataFrame:
    for name, wanted in conditions.items():
        df = df.filter(condition(F.col(name), wanted))
    return df


def varying_columns(df: DataFrame) -> list[str]:
    """Columns with more than one value, null counted as a value. Runs one aggregate.

    Comparing the smallest and largest value needs no distinct count, so nothing is shuffled but
    one row per task.
    """
    probes = []
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        probes += [
            F.count(c).alias(f"n{i}"),
            F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias(f"d{i}"),
        ]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *probes).first()
    return [
        name
        for i, name in enumerate(df.columns)
        if row[f"d{i}"] or 0 < row[f"n{i}"] < row["rows"]
    ]


def take_varying_columns(df: DataFrame) -> DataFrame:
    return df.select(*[f"`{c}`" for c in varying_columns(df)])


def fill_numbers(df: DataFrame, value: float = -1) -> DataFrame:
    """Fill numeric columns only; dates, text and booleans keep their nulls. NaN is not null."""
    return _fill(df, lambda t: value if isinstance(t, T.NumericType) else None)


def fill_by_type(df: DataFrame, number: float = 0, text: str = "0", flag: bool = False) -> DataFrame:
    """Fill every scalar column, so that no group key is null afterwards."""

    def pick(dtype: T.DataType) -> Any:
        if isinstance(dtype, T.NumericType):
            return number
        if isinstance(dtype, T.StringType):
            return text
        if isinstance(dtype, T.BooleanType):
            return flag
        return None

    return _fill(df, pick)


def fill_defaults(df: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    """Fill named columns, adding those the records never had."""
    present = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value).cast(present[name])) if name in present else F.lit(value)
            for name, value in defaults.items()
        }
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(value: Any) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def _fill(df: DataFrame, pick) -> DataFrame:
    # SQL text: one call per wide frame instead of several per column.
    items = []
    for field in df.schema.fields:
        value, c = pick(field.dataType), _quoted(field.name)
        filled = f"coalesce({c}, CAST({_literal(value)} AS {field.dataType.simpleString()}))"
        items.append(c if value is None else f"{filled} AS {c}")
    return df.selectExpr(*items)


def as_float32(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = df.columns
    chosen = set(names if columns is None else columns)
    quoted = {c: _quoted(c) for c in names}
    return df.selectExpr(*[f"CAST({q} AS FLOAT) AS {q}" if c in chosen else q for c, q in quoted.items()])


def features_except(df: DataFrame, label: str) -> list[str]:
    return [c for c in df.columns if c != label]


def label_is(labels: str, name: str, value: str) -> Column:
    return _label(labels, name) == value


def label_matches(labels: str, name: str, pattern: str) -> Column:
    """Regular expression matcher, anchored at both ends; a missing label counts as empty."""
    return _label(labels, name).rlike(f"^(?:{pattern})$")


def _label(labels: str, name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(labels), F.lit(name)), F.lit(""))


def not_error(column: str = "error") -> Column:
    """True only where the flag is present and false."""
    return ~F.col(column)
