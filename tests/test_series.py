"""Rates, grids and alarms at their edges."""

import random

import pytest

from fathomry.operators import series


def samples(spark, rows):
    return spark.createDataFrame(rows, "k string, t bigint, v double")


def test_rate_reset_gap_and_single_sample(spark):
    df = samples(spark, [("a", 0, 10.0), ("a", 10, 30.0), ("a", 20, 5.0), ("a", 320, 11.0), ("a", 621, 12.0), ("one", 5, 1.0)])
    got = {r.t: r.rate for r in series.counter_rate(df, ["k"], "t", "v", lookback=300, resets=True).collect()}
    assert got == {10: 2.0, 20: 0.5, 320: 0.02}  # 621 has no sample in the last 300
    plain = {r.t: r.rate for r in series.counter_rate(df, ["k"], "t", "v").collect()}
    assert plain == {10: 2.0, 20: -2.5, 320: 0.02, 621: pytest.approx(1 / 301)}


def test_equal_times_give_no_number(spark):
    df = samples(spark, [("a", 5, 1.0), ("a", 5, 2.0)])
    assert [r.rate for r in series.counter_rate(df, ["k"], "t", "v").collect()] == [None]


def test_value_on_grid_lookback_is_closed(spark):
    df = samples(spark, [("a", 10, 1.0), ("a", 11, 2.0)])
    got = {r.step_t: r.v for r in series.sample_at_step(df, ["k"], "t", "v", step=10, lookback=29).collect()}
    assert got == {10: 1.0, 20: 2.0, 30: 2.0, 40: 2.0}
    short = {r.step_t: r.v for r in series.sample_at_step(df, ["k"], "t", "v", step=10, lookback=28).collect()}
    assert short == {10: 1.0, 20: 2.0, 30: 2.0}


def test_irate_needs_both_samples_in_range(spark):
    df = samples(spark, [("a", 0, 0.0), ("a", 10, 20.0), ("a", 500, 50.0)])
    got = {r.step_t: r.irate for r in series.irate_at_step(df, ["k"], "t", "v", step=10, span=30, unit=1.0).collect()}
    # The last two samples leave the range with the older one; the lone sample at 500 has no rate.
    assert got == {10: 2.0, 20: 2.0, 30: 2.0}


def test_average_includes_the_far_end(spark):
    df = samples(spark, [("a", 0, 1.0), ("a", 120, 3.0), ("a", 241, 9.0)])
    got = {r.t: r.m for r in series.avg_over_time(df, ["k"], "t", "v", 120, "m").collect()}
    assert got == {0: 1.0, 120: 2.0, 241: 9.0}


def test_average_on_ties_gaps_nulls_and_odd_values(spark):
    rows = [("a", 0, 1.0), ("a", 0, 3.0), ("a", 5, None), ("a", 120, float("nan")), ("a", 121, 7.0), ("a", 241, 9.0), ("a", 1000, None)]
    for width in (None, 130.0):
        got = series.avg_over_time(samples(spark, rows), ["k"], "t", "v", 120, "m", width)
        assert sorted(str((r.t, r.v, r.m)) for r in got.collect()) == sorted(
            str(x) for x in [(0, 1.0, 2.0), (0, 3.0, 2.0), (5, None, 2.0), (120, float("nan"), float("nan")), (121, 7.0, float("nan")), (241, 9.0, 8.0), (1000, None, None)]
        )


def test_average_at_steps_against_plain_loops(spark):
    r = random.Random(3)
    rows = [(r.choice("aab"), r.randrange(0, 400), float(r.randrange(100))) for _ in range(300)] + [("c", 40, 5.0), ("c", 41, None)]
    for step, span in ((10, 40), (10, 25), (30, 20), (7, 7)):
        got = {(x.k, x.step_t): x.average for x in series.avg_at_step(samples(spark, rows), ["k"], "t", "v", step, span).collect()}
        want = {}
        for k in "abc":
            for s in range(0, 500, step):
                found = [v for key, t, v in rows if key == k and v is not None and s - span <= t <= s]
                if found:
                    want[k, s] = sum(found) / len(found)
        assert got == want


@pytest.mark.parametrize("width", [15.0, 400.0])
def test_grid_and_buckets_of_a_hot_series_do_not_depend_on_chunks(spark, width):
    r = random.Random(5)
    df = samples(spark, [("hot" if i % 3 else f"k{i % 7}", r.randrange(0, 3000), float(r.randrange(50))) for i in range(900)])
    forms = [
        lambda w: series.sample_at_step(df, ["k"], "t", "v", 10, 35, w),
        lambda w: series.irate_at_step(df, ["k"], "t", "v", 10, 60, 1.0, w),
        lambda w: series.bucket_derivative(df, ["k"], "t", ["v"], 10, 1.0, w),
    ]
    for form in forms:
        assert sorted(map(str, form(width).collect())) == sorted(map(str, form(10**6).collect()))
        plan = form(width)._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition(k#" not in plan  # every window that does work is over a chunk


def test_difference_refuses_several_samples(spark):
    df = spark.createDataFrame([(1, "total", 9.0), (1, "free", 4.0), (2, "total", 1.0), (3, "total", 5.0), (3, "total", 6.0), (3, "free", 1.0)], "k int, m string, v double")
    got = series.difference_of(df.filter("k < 3"), ["k"], "m", "total", "free", "v", "used").collect()
    assert [tuple(r) for r in got] == [(1, 5.0)]
    with pytest.raises(Exception, match="several samples"):
        series.difference_of(df, ["k"], "m", "total", "free", "v", "used").collect()


def test_traffic_signs(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 10, 50.0, 20.0), ("a", 20, 40.0, 10.0)], "k string, t bigint, rx double, tx double")
    got = {r.bucket_t: (r.inbound, r.outbound) for r in series.traffic_by_bucket(df, ["k"], "t", "rx", "tx", 10, 1.0).collect()}
    assert got == {0: (None, None), 10: (5.0, -2.0), 20: (0.0, None)}


def test_matching_lines_across_chunks(spark):
    lines = spark.createDataFrame([("f", i, "END" if i in (3, 4, 9) else f"l{i}") for i in range(10)], "file string, n bigint, line string")
    for width in (1, 4, 100):
        got = series.match_with_following(lines, ["file"], "n", "line", "BEGIN|END", width)
        assert sorted(r.n for r in got.collect()) == [3, 4, 5, 9]


def test_since_minimum_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 5), (None, 7), ("a", 1)], "k string, counter bigint")
    got = sorted((str(r.k), r.counter) for r in series.since_series_minimum(df, ["k"]).collect())
    assert got == [("None", 0), ("None", 2), ("a", 0)]


def test_alarms(spark):
    rows = [(0, 0, 9.0, 99.0), (5, 1, 9.0, 99.0), (20, 2, 4.0, 30.0), (21, 3, 4.1, 31.0)]
    df = spark.createDataFrame(rows, "t bigint, step int, latency_sec double, sync_latency_sec double")
    got = {r.step: (r.slow_step, r.slow_sync) for r in series.step_alarms(df, "t", 10).collect()}
    assert got == {1: (True, False), 3: (True, True)}
