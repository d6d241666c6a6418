"""Streams over several micro-batches against their batch form, restarts and late data."""

import random
import time

import pytest
from pyspark.sql import functions as F

from fathomry.operators import series
from fathomry.session import fresh_dir
from fathomry.streaming import feeds

SCHEMA = "id int, k string, at timestamp, t double, v double"


def land(spark, path, rows):
    """One file, later than the ones before it."""
    stamp = F.timestamp_seconds("t")
    df = spark.createDataFrame(rows, "id int, k string, t double, v double").select("id", "k", stamp.alias("at"), "t", "v")
    df.coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)


@pytest.fixture(scope="module")
def landed(spark):
    path, rows = fresh_dir(spark, "landed"), []
    for n in range(4):
        part = [(n * 100 + i, "hot" if i % 3 == 0 else f"k{i % 7}", float(n * 1000 + i * 10), float((n * 977 + i * 31) % 500)) for i in range(100)]
        land(spark, path, part)
        rows += part
    return path, spark.createDataFrame(rows, "id int, k string, t double, v double")


def stream(spark, path, files=1):
    return feeds.file_stream(spark, path, SCHEMA, files_per_batch=files)


def test_counter_feed_equals_batch(spark, landed):
    path, rows = landed
    out = feeds.counter_feed(stream(spark, path).select("id", "k", "t", "v"), fresh_dir(spark, "feed"), ["k"], "t", "v", unit=1.0)
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 4
    want = series.counter_rate(rows, ["k"], "t", "v")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_restart_continues_and_repeats_nothing(spark, landed):
    path, rows = landed
    source, out = fresh_dir(spark, "growing"), fresh_dir(spark, "feed")
    land(spark, source, [(1, "a", 0.0, 1.0), (2, "a", 10.0, 2.0)])
    for _ in range(2):  # the second run finds nothing new
        feeds.counter_feed(stream(spark, source).select("id", "k", "t", "v"), out, ["k"], "t", "v", unit=1.0)
    land(spark, source, [(3, "a", 20.0, 5.0)])
    done = feeds.counter_feed(stream(spark, source).select("id", "k", "t", "v"), out, ["k"], "t", "v", unit=1.0)
    got = {r.id: r.rate for r in spark.read.parquet(done).collect()}
    assert got == {2: 0.1, 3: 0.3}


def test_windows_over_batches_equal_batch(spark, landed):
    path, rows = landed
    totals = feeds.windowed(stream(spark, path), "at", "2 minutes", ["k"], [F.avg("v").alias("m")], slide="10 seconds")
    out = feeds.run_to_files(totals, fresh_dir(spark, "feed"), mode="update")
    got = feeds.latest_per_key(spark, out, ["k", "window_start"])
    want = rows.groupBy(F.window(F.timestamp_seconds("t"), "2 minutes", "10 seconds").alias("w"), "k").agg(F.avg("v").alias("m"))
    want = want.select("k", F.col("w.start").alias("window_start"), "m")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_late_event_is_left_out(spark):
    path = fresh_dir(spark, "late")
    land(spark, path, [(1, "a", 10_000.0, 1.0)])
    land(spark, path, [(2, "a", 10_060.0, 1.0)])
    land(spark, path, [(3, "a", 100.0, 1.0), (4, "a", 9_900.0, 1.0)])  # the first is beyond 10 minutes
    totals = feeds.windowed(stream(spark, path), "at", "1 minute", [], [F.count(F.lit(1)).alias("n")])
    out = feeds.run_to_files(totals, fresh_dir(spark, "feed"), mode="update")
    assert feeds.latest_per_key(spark, out, ["window_start"]).agg(F.sum("n")).first()[0] == 3


def test_repeats_within_watermark(spark):
    path = fresh_dir(spark, "twice")
    land(spark, path, [(1, "a", 1000.0, 1.0), (2, "a", 1001.0, 1.0)])
    land(spark, path, [(1, "a", 1000.0, 1.0), (3, "a", 1002.0, 1.0)])
    once = feeds.first_seen(stream(spark, path), "at", ["id"])
    out = feeds.run_to_files(once, fresh_dir(spark, "feed"))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def shuffled(spark, rows, parts, seed=2):
    """A folder to which files are landed one after the other, rows up to 400 out of order."""
    r, path = random.Random(seed), fresh_dir(spark, "shuffled")
    ordered = sorted(rows, key=lambda x: x[2] + r.uniform(0, 400))
    size = -(-len(ordered) // parts)
    for i in range(parts):
        land(spark, path, ordered[i * size : (i + 1) * size])
    return path


def test_counter_feed_out_of_order_equals_batch(spark, landed):
    _, rows = landed
    path = shuffled(spark, [tuple(r) for r in rows.collect()], 5)
    samples = stream(spark, path).select("id", "k", "t", "v")
    out = feeds.counter_feed(samples, fresh_dir(spark, "feed"), ["k"], "t", "v", unit=1.0, delay=400.0, finish=True)
    want = series.counter_rate(rows, ["k"], "t", "v")
    got = spark.read.parquet(out)
    assert got.filter("batch < 5").count() > 200  # most are rated before the end
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert feeds.late_samples(spark, out) == 0


def test_counter_feed_counts_what_is_too_late_and_forgets_far_series(spark):
    path = fresh_dir(spark, "late")
    land(spark, path, [(1, "a", 0.0, 0.0), (2, "a", 30.0, 3.0), (3, "gone", 5.0, 1.0)])
    land(spark, path, [(4, "a", 10.0, 1.0), (5, "a", 40.0, 5.0)])
    land(spark, path, [(6, "a", 100.0, 9.0), (7, "a", 15.0, 7.0), (8, "a", None, 1.0)])
    land(spark, path, [(9, "a", 31.0, 9.0)])
    base = fresh_dir(spark, "feed")
    out = feeds.counter_feed(stream(spark, path).select("id", "k", "t", "v"), base, ["k"], "t", "v", unit=1.0, delay=25.0, finish=True, lookback=70.0)
    got = {r.id: r.rate for r in spark.read.parquet(out).collect()}
    assert got == {4: 0.1, 2: 0.1, 5: pytest.approx(0.2), 6: pytest.approx(4 / 60)}
    assert feeds.late_samples(spark, out) == 2
    kept = spark.read.parquet(f"{base}/last").filter("batch = 3")
    assert {r.k for r in kept.collect()} == {"a"}


def test_each_window_is_written_once_and_late_rows_are_counted(spark):
    path = fresh_dir(spark, "closing")
    land(spark, path, [(1, "a", 10_000.0, 1.0), (2, "b", 10_010.0, 3.0)])
    land(spark, path, [(3, "a", 10_020.0, 5.0), (4, "a", 12_000.0, 1.0)])
    land(spark, path, [(6, "b", 30_000.0, 2.0)])
    land(spark, path, [(5, "a", 10_030.0, 9.0)])  # its window is written
    totals = feeds.windowed(stream(spark, path), "at", "1 minute", ["k"], [F.avg("v").alias("m"), F.count(F.lit(1)).alias("n")])
    rows, late = feeds.final_windows(totals, fresh_dir(spark, "feed"))
    got = spark.read.parquet(rows).drop("batch")
    assert sorted((r.k, r.m, r.n) for r in got.collect()) == [("a", 1.0, 1), ("a", 1.0, 1), ("a", 5.0, 1), ("b", 3.0, 1)]
    assert late == 1


def test_totals_after_warm_up_find_their_start(spark):
    path, base = fresh_dir(spark, "warm"), fresh_dir(spark, "feed")
    batches = [[(1, "a", 100.0, 1.0), (2, "a", 130.0, 2.0)], [(3, "a", 90.0, 4.0), (4, "b", 125.0, 8.0)], [(5, "a", 119.0, 16.0)]]
    for rows in batches:  # a run for each file
        land(spark, path, rows)
        out = feeds.totals_after_warm_up(stream(spark, path).withColumnRenamed("k", "rank"), base, "at", 30.0, ["rank"], ["v"])
    got = {r["rank"]: (r["rows"], r["v"]) for r in feeds.last_batch(spark, out).collect()}
    assert got == {"a": (1, 2.0), "b": (1, 8.0)}  # 90 is the start


def test_batch_is_worked_out_once_whatever_is_done_with_it(spark, landed):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        runs.add(1)
        return v

    def each(batch, number):
        assert batch.count() == 100
        spark.catalog.clearCache()  # as if the executor that held the batch were lost
        return batch.unionByName(batch)

    counts = stream(spark, landed[0]).withColumn("v", counted("v"))
    out = feeds.run_to_files(counts, fresh_dir(spark, "feed"), each=each)
    assert spark.read.parquet(out).count() == 800
    assert runs.value == 400
