"""Chunked operators against plain windows, with one series holding a third of the rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomry.operators import ordered as O
from fathomry.operators import series


def rows_of(df):
    return sorted(df.collect(), key=str)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows, i = [], 0
    for n in range(3000):
        key = "hot" if n % 3 == 0 else rng.choice(["a", "b", "c", None])
        i += 1
        rows.append((i, key, rng.randrange(0, 10_000), rng.choice([None, *range(50)])))
    return spark.createDataFrame(rows, "id int, k string, t bigint, v int").cache()


@pytest.mark.parametrize("width", [7, 1000, 10**6])
def test_previous_row(skewed, width):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = skewed.withColumn("pv", F.lag("v").over(w)).withColumn("pt", F.lag("t").over(w))
    got = O.previous_row(skewed, ["k"], "t", {"pv": "v", "pt": "t"}, width, ties=["id"])
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("width", [7, 1000, 10**6])
def test_next_row(skewed, width):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = skewed.withColumn("nv", F.lead("v").over(w)).withColumn("nt", F.lead("t").over(w))
    got = O.next_row(skewed, ["k"], "t", {"nv": "v", "nt": "t"}, width, ties=["id"])
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("width", [None, 100, 5000])
def test_trailing_sums(skewed, width):
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-50, 0)
    want = skewed.withColumn("n", F.sum(F.lit(1)).over(w)).withColumn("s", F.sum("v").over(w))
    got = O.trailing_sums(skewed.withColumn("one", F.lit(1)), ["k"], "t", 50, {"n": F.col("one"), "s": F.col("v")}, width).drop("one")
    known = lambda df: rows_of(df.withColumn("s", F.coalesce("s", F.lit(0))))
    assert known(got) == known(want)


@pytest.mark.parametrize("width", [7, 1000, 10**6])
@pytest.mark.parametrize("keys", [["k"], []])
def test_running(skewed, width, keys):
    w = Window.partitionBy(*keys).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumn("total", F.sum("v").over(w)).withColumn("top", F.max("v").over(w))
    got = O.running(skewed, keys, "t", {"total": ("sum", "v"), "top": ("max", "v")}, width, ties=["id"])
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("width", [None, 100, 5000])
def test_trailing(skewed, width):
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-50, 0)
    want = skewed.withColumn("n", F.count("v").over(w)).withColumn("s", F.sum("v").over(w))
    got = O.trailing(skewed, ["k"], "t", 50, {"n": F.count("v"), "s": F.sum("v")}, width)
    assert rows_of(got) == rows_of(want)


def test_trailing_previous_needs_a_near_row(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 100, 2), ("a", 201, 3), ("b", 150, 9)], "k string, t bigint, v int")
    got = O.trailing_previous(df, ["k"], "t", 100, {"p": "v"}).select("k", "t", "p")
    assert rows_of(got) == [("a", 0, None), ("a", 100, 1), ("a", 201, None), ("b", 150, None)]


def test_ordered_positions(skewed):
    got = O.ordered_positions(skewed, ["k", "t", "id"], partitions=5)
    want = skewed.withColumn("position", (F.row_number().over(Window.orderBy("k", "t", "id")) - 1).cast("bigint"))
    assert rows_of(got) == rows_of(want)


def test_ordered_positions_with_merged_ranges(skewed):
    got = O.ordered_positions(skewed, [F.desc("v"), F.col("id")]).select("id", "position")
    want = skewed.select("id", (F.row_number().over(Window.orderBy(F.desc("v"), "id")) - 1).cast("bigint").alias("position"))
    assert rows_of(got) == rows_of(want)


def test_shuffled_positions_are_a_permutation(skewed):
    got = O.shuffled_positions(skewed, "id", 12345).select("position", "total").collect()
    assert sorted(r.position for r in got) == list(range(3000))
    assert {r.total for r in got} == {3000}
    again = O.shuffled_positions(skewed.repartition(3), "id", 12345)
    assert rows_of(again) == rows_of(O.shuffled_positions(skewed, "id", 12345))


def test_no_task_holds_the_hot_series(spark, skewed):
    """The window that does the work is partitioned by chunk, not by series."""
    plan = O.previous_row(skewed, ["k"], "t", {"pv": "v"}, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "lag" in plan and "__slot" in plan
    sizes = skewed.groupBy("k", F.floor(F.col("t") / 100)).count().agg(F.max("count")).first()[0]
    assert sizes < skewed.count() / 50


def test_running_max_of_a_series(skewed):
    clean = skewed.filter("v IS NOT NULL").dropDuplicates(["k", "t"])
    got = series.running_max(clean, ["k"], "t", "v", "top", width=100)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    assert rows_of(got) == rows_of(clean.withColumn("top", F.max("v").over(w)))
