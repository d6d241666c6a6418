"""Text and measure functions, selections and reports."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fathomry.functions import measures as M
from fathomry.functions import text as X
from fathomry.operators import lookups, report
from fathomry.operators import selection as sel
from fathomry.operators.encode import encode_strings
from fathomry.sources import writers


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4000), st.integers(1, 4000)), min_size=300, max_size=400))
def test_fixed_text_equals_python(spark, pairs):
    values = [(min(p / w, 1.0),) for p, w in pairs] + [(k / 800,) for k in range(801)] + [(k / 65536,) for k in range(0, 65536, 97)]
    df = spark.createDataFrame(values, "x double")
    assert [r[0] for r in df.select(X.fixed_text("x")).collect()] == ["%.4f" % v for (v,) in values]


def test_last_and_first_match(spark):
    log = "total images/sec: 1.5\nx total images/sec: 9\ntotal images/sec: 2.25\n"
    df = spark.createDataFrame([(log,), ("",), (None,), ("total images/sec: 1.2.3",)], "o string")
    assert [r[0] for r in df.select(X.last_number("o")).collect()] == [2.25, None, None, None]
    assert [r[0] for r in df.select(X.first_number("o", r"sec: ([\d]+)")).collect()] == [1.0, None, None, 1.0]


def test_coverage_bins(spark):
    df = spark.createDataFrame([(v,) for v in (34.9, 35.0, 51.69, 51.7, 67.9, 84.9, 85.0, None)], "v double")
    assert [r[0] for r in df.select(M.coverage_bin("v")).collect()] == [None, 35.0, 50.0, 52.0, 52.0, 80.0, None, None]


def test_words_that_are_not_booleans_fail(spark):
    with pytest.raises(PySparkException, match="boolean value expected"):
        spark.createDataFrame([("maybe",)], "w string").select(X.to_bool("w")).collect()


def test_suffixes(spark):
    df = spark.createDataFrame([(1.0, 1.0), (7.0, 1.0), (0.1, 1.0), (1.0, 3.0)], "n double, f double")
    assert [r[0] for r in df.select(X.copies_suffix("n", "f")).collect()] == ["", "-7x", "-0.1x", "1729"]
    with pytest.raises(PySparkException):
        spark.createDataFrame([(2.0, 3.0)], "n double, f double").select(X.copies_suffix("n", "f")).collect()


def test_dataset_path():
    assert writers.dataset_path("/d/", "perf", 6.0, 48, 2048, "snappy", "orc") == "/d/perf-6.00x-48p-2048MiB-snappy.orc"


def test_filter_ends_are_inclusive_and_null_never_matches(spark):
    df = spark.createDataFrame([(499,), (500,), (50000,), (50001,), (None,)], "n int")
    assert [r.n for r in sel.filter_dataframe(df, n=(500, 50000)).collect()] == [500, 50000]
    assert [r.n for r in sel.filter_dataframe(df, n=[499, 7]).collect()] == [499]


def test_varying_columns_counts_null_as_a_value(spark):
    df = spark.createDataFrame([(1, "x", None, 1.0), (1, "y", None, None)], "same int, txt string, none int, half double")
    assert sel.varying_columns(df) == ["txt", "half"]


def test_fills(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, float("nan"), "a", True)], "i int, d double, s string, b boolean")
    assert [tuple(r) for r in sel.fill_by_type(df).collect()][0] == (0, 0.0, "0", False)
    filled = sel.fill_numbers(df, -1).collect()
    assert tuple(filled[0]) == (-1, -1.0, None, None) and filled[1].d != filled[1].d  # NaN stays


def test_missing_label_matches_like_empty(spark):
    df = spark.createDataFrame([({"device": "lo"},), ({"device": "lo0"},), ({},)], "labels map<string,string>")
    assert df.filter(~sel.label_matches("labels", "device", "veth.*|lo")).count() == 2
    assert df.filter(sel.label_matches("labels", "device", "lo|")).count() == 2


def test_duplicate_cell_fails(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2)], "r string, c string, v int")
    with pytest.raises(PySparkException, match="duplicate entry"):
        report.unique_pivot(df, ["r"], "c", "v", ["x"]).collect()


def test_pivot_keeps_null_and_separator_apart(spark):
    df = spark.createDataFrame([("a", None, 1), (None, "a", 5), ("b", "c", 7), ("b_c", "", 9), ("b", "_c", 11)], "x string, y string, v int")
    row = report.pivot_stats(df.withColumn("r", F.lit(1)), ["r"], ["x", "y"], {"v": ["sum"]}).first().asDict()
    assert sorted(v for k, v in row.items() if k != "r") == [1, 5, 7, 9, 11]
    assert row["v_sum_" + report.pivot_name(("b_c", ""))] == 9 and row["v_sum_" + report.pivot_name((None, "a"))] == 5


def test_pivot_fails_on_a_key_that_is_not_listed(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "r int, x string, v int")
    with pytest.raises(PySparkException, match="key not listed"):
        report.pivot_stats(df, ["r"], ["x"], {"v": ["sum"]}, ["a"]).collect()
    with pytest.raises(PySparkException, match="key not listed"):
        report.unique_pivot(df, ["r"], "x", "v", ["a"]).collect()
    assert report.unique_pivot(df, ["r"], "x", "v").columns == ["r", "v_a", "v_b"]


def test_duplicate_baseline_fails(spark):
    df = spark.createDataFrame([("a", "base", 1.0), ("a", "base", 2.0)], "r string, g string, v double")
    with pytest.raises(PySparkException, match="duplicate baseline"):
        report.versus_baseline(df, ["r"], {"g": "base"}, "v").collect()


def test_replicate_nothing(spark):
    assert writers.replicate(spark.range(3), 0).count() == 0
    assert writers.replicate(spark.range(3), 2).count() == 6


def test_baseline_zero_or_missing_is_null(spark):
    df = spark.createDataFrame([("a", "base", 0.0), ("a", "x", 5.0), ("b", "x", 5.0), ("c", "base", 4.0), ("c", "x", 5.0)], "r string, g string, v double")
    got = {(r.r, r.g): r.v_percent for r in report.versus_baseline(df, ["r"], {"g": "base"}, "v").collect()}
    assert got == {("a", "base"): None, ("a", "x"): None, ("b", "x"): None, ("c", "base"): 0.0, ("c", "x"): 25.0}


def test_group_sizes_leave_out_null_keys(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    assert [tuple(r) for r in report.group_sizes(df, "k").collect()] == [("a", 2)]


def test_codes_by_frequency_then_text(spark):
    rows = [("b",), ("b",), ("a",), ("c",), ("c",), (None,), (None,), (None,)]
    df = spark.createDataFrame(rows, "s string")
    want = sorted([1, 1, 3, 2, 2, 0, 0, 0])
    assert sorted(r.s for r in encode_strings(df).collect()) == want
    assert sorted(r.s for r in encode_strings(df, null_code=-1).collect()) == [-1, -1, -1, 0, 0, 1, 1, 2]


def test_first_rows_per_group_are_cut_before_the_shuffle(spark):
    df = spark.range(10000).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50))
    top = report.first_n_per_group(df, ["g"], ["id"], 4)
    assert "WindowGroupLimit" in top._jdf.queryExecution().optimizedPlan().toString()
    assert top.groupBy("g").count().filter("count > 4").count() == 0


def test_label_by_file_number(spark):
    files = spark.createDataFrame([("val_000000002.JPEG",), ("val_7.JPEG",)], "filename string")
    labels = spark.createDataFrame([(1, "n1"), (2, "n2")], "line_no bigint, synset string")
    assert {(r.filename, r.synset) for r in lookups.label_by_file_number(files, labels).collect()} == {("val_000000002.JPEG", "n2"), ("val_7.JPEG", None)}


def test_fill_text_is_taken_as_it_is(spark):
    df = spark.createDataFrame([(None,)], "`odd ``name` string")
    assert sel.fill_by_type(df, text="it's \\ \"so\"").collect()[0][0] == "it's \\ \"so\""
