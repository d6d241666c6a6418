"""Joins (J) and set operations (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomry.catalog import standins as S
from fathomry.catalog.base import query, table
from fathomry.catalog.windows import FORWARD_SQL
from fathomry.operators import boxes as B
from fathomry.operators import loans, lookups
from fathomry.operators import selection as sel
from fathomry.plans import corpus
from fathomry.plans.results import MEAN_BYTES, suffix_dimension


@query(
    "j01_seller_names",
    f"WITH {S.ACQ_CTE}, {S.SOME_NAMES_CTE} SELECT loan_id, n.new AS seller_name FROM acq LEFT JOIN names n USING (seller_name)",
)
def _(spark, sf):
    acq = S.acquisition(spark, sf).select("loan_id", "seller_name")
    return loans.resolve_seller_names(acq, S.seller_names(spark, sf, S.NAMES_WHERE))


DELINQUENCY_SQL = """d30 AS (SELECT loan_id, min(monthly_reporting_period) AS d FROM perf WHERE current_loan_delinquency_status >= 1 GROUP BY 1),
d90 AS (SELECT loan_id, min(monthly_reporting_period) AS d FROM perf WHERE current_loan_delinquency_status >= 3 GROUP BY 1),
d180 AS (SELECT loan_id, min(monthly_reporting_period) AS d FROM perf WHERE current_loan_delinquency_status >= 6 GROUP BY 1),
delinq AS (SELECT d30.loan_id, d30.d AS delinquency_30, coalesce(d90.d, DATE '1970-01-01') AS delinquency_90,
  coalesce(d180.d, DATE '1970-01-01') AS delinquency_180 FROM d30 LEFT JOIN d90 USING (loan_id) LEFT JOIN d180 USING (loan_id)),
ever AS (SELECT loan_id, CAST(max(current_loan_delinquency_status) >= 1 AS TINYINT) AS ever_30,
  CAST(max(current_loan_delinquency_status) >= 3 AS TINYINT) AS ever_90, CAST(max(current_loan_delinquency_status) >= 6 AS TINYINT) AS ever_180
  FROM perf GROUP BY 1),
per_loan AS (SELECT e.*, coalesce(delinquency_30, DATE '1970-01-01') AS delinquency_30, coalesce(delinquency_90, DATE '1970-01-01') AS delinquency_90,
  coalesce(delinquency_180, DATE '1970-01-01') AS delinquency_180 FROM ever e LEFT JOIN delinq USING (loan_id))"""


@query(
    "j02_delinquency_dates_of_late_loans",
    f"WITH {S.PERF_CTE}, {DELINQUENCY_SQL} SELECT * FROM delinq",
)
def _(spark, sf):
    per_loan = loans.ever_and_first_delinquency(S.performance(spark, sf))
    late = per_loan.filter(F.col("ever_30") == 1).drop("ever_30", "ever_90", "ever_180")
    # At this stage a late loan with no dated month still has no first date; the fill comes after.
    return late.withColumn("delinquency_30", F.nullif("delinquency_30", F.lit(loans.NO_DATE).cast("date")))


@query("j03_ever_and_dates", f"WITH {S.PERF_CTE}, {DELINQUENCY_SQL} SELECT * FROM per_loan")
def _(spark, sf):
    return loans.ever_and_first_delinquency(S.performance(spark, sf))


@query(
    "j04_performance_with_loan_features",
    f"""WITH {S.PERF_CTE}, {DELINQUENCY_SQL} SELECT loan_id, monthly_reporting_period, interest_rate, ever_30, ever_90, ever_180,
      delinquency_30, delinquency_90, delinquency_180 FROM perf LEFT JOIN per_loan USING (loan_id)""",
)
def _(spark, sf):
    perf = S.performance(spark, sf)
    slim = perf.select("loan_id", "monthly_reporting_period", "interest_rate")
    return loans.with_loan_features(slim, loans.ever_and_first_delinquency(perf))


@query(
    "j05_label_by_loan_year_month",
    f"""WITH {S.PERF_CTE}, {FORWARD_SQL} SELECT p.loan_id, CAST(year(monthly_reporting_period) AS SMALLINT) AS timestamp_year,
      CAST(month(monthly_reporting_period) AS TINYINT) AS timestamp_month, delinquency_12, upb_12
    FROM perf p LEFT JOIN forward f ON p.loan_id = f.loan_id
      AND f.m = year(monthly_reporting_period) * 12 + month(monthly_reporting_period)""",
)
def _(spark, sf):
    perf = S.performance(spark, sf)
    slim = perf.select("loan_id", "monthly_reporting_period")
    out = loans.with_forward_label(slim, loans.forward_12_month(perf))
    return out.select(
        "loan_id",
        F.year("monthly_reporting_period").cast("smallint").alias("timestamp_year"),
        F.month("monthly_reporting_period").cast("tinyint").alias("timestamp_month"),
        "delinquency_12",
        "upb_12",
    )


# The multiplicity comes out of the many-to-many join itself, by counting its matches per row.
@query(
    "j06_performance_with_monthly_features",
    f"""WITH {S.PERF_CTE}, {FORWARD_SQL}, p AS (SELECT row_number() OVER () AS rid, loan_id, monthly_reporting_period, interest_rate,
      year(monthly_reporting_period) * 12 + month(monthly_reporting_period) AS m FROM perf)
    SELECT any_value(a.loan_id) AS loan_id, any_value(a.monthly_reporting_period) AS monthly_reporting_period,
      any_value(a.interest_rate) AS interest_rate, any_value(f.delinquency_12) AS delinquency_12, any_value(f.upb_12) AS upb_12, count(*) AS copies
    FROM p a LEFT JOIN p b ON a.loan_id = b.loan_id AND a.m = b.m LEFT JOIN forward f ON f.loan_id = b.loan_id AND f.m = b.m GROUP BY a.rid""",
)
def _(spark, sf):
    perf = S.performance(spark, sf)
    slim = perf.select("loan_id", "monthly_reporting_period", "interest_rate")
    return loans.with_forward_label(slim, loans.forward_12_month(perf))


@query(
    "j07_performance_with_acquisition",
    f"""WITH {S.PERF_CTE}, {S.SOME_ACQ_CTE} SELECT loan_id, coalesce(current_actual_upb, -1) AS current_actual_upb, a.orig_ltv, a.dti, a.zip
    FROM perf LEFT JOIN (SELECT loan_id, coalesce(orig_ltv, -1) AS orig_ltv, coalesce(dti, -1) AS dti, zip FROM acq) a USING (loan_id)""",
)
def _(spark, sf):
    perf = sel.fill_numbers(S.performance(spark, sf).select("loan_id", "current_actual_upb"))
    acq = sel.fill_numbers(S.acquisition(spark, sf, S.ACQ_WHERE).select("loan_id", "orig_ltv", "dti", "zip"))
    return perf.join(acq, "loan_id", "left")


@query(
    "j08_results_with_suffix_dimension",
    f"""WITH {S.TRAINING_CTE}, dim AS (SELECT * FROM (VALUES {', '.join(f"('{k}', CAST({v!r} AS DOUBLE))" for k, v in MEAN_BYTES.items())}) t(data_dir_suffix, mean_bytes_per_image))
    SELECT test_uuid, data_dir_suffix, mean_bytes_per_image FROM runs LEFT JOIN dim USING (data_dir_suffix)""",
)
def _(spark, sf):
    runs = S.training_runs(spark, sf).select("test_uuid", "data_dir_suffix")
    return runs.join(suffix_dimension(spark), "data_dir_suffix", "left")


@query(
    "j09_results_with_coverage",
    "SELECT l_orderkey, l_linenumber, l_partkey AS sample_id, p_retailprice AS coverage FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 3 <> 0",
)
def _(spark, sf):
    runs = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("sample_id"))
    samples = table(spark, sf, "part").filter("p_partkey % 3 <> 0").select(
        F.col("p_partkey").alias("sample_id"), F.col("p_retailprice").alias("coverage")
    )
    return runs.join(samples, "sample_id", "left")


@query(
    "j10_images_with_label_index",
    f"WITH {S.IMAGES_CTE}, {S.LABELS_CTE} SELECT filename, synset, label FROM images JOIN labels USING (synset) WHERE label <= 20",
)
def _(spark, sf):
    labels = S.label_list(spark, sf).filter("label <= 20")
    return lookups.with_label_index(S.images(spark, sf).select("filename", "synset"), labels)


@query(
    "j11_required_text",
    f"WITH {S.IMAGES_CTE}, {S.TEXTS_CTE} SELECT filename, synset, text FROM images JOIN texts USING (synset)",
)
def _(spark, sf):
    return lookups.require_lookup(S.images(spark, sf).select("filename", "synset"), S.synset_texts(spark, sf), "synset", "text")


@query(
    "j12_images_with_boxes",
    f"""WITH {S.SCALED_CTE}, n AS (SELECT filename, count(*) AS n, min(xmin) AS first_xmin FROM scaled WHERE filename NOT LIKE '%7.JPEG' GROUP BY 1)
    SELECT filename, coalesce(n, 0) AS n_boxes, first_xmin, n IS NOT NULL AS has_boxes FROM images LEFT JOIN n USING (filename)""",
)
def _(spark, sf):
    boxes = S.box_series(spark, sf).filter("filename NOT LIKE '%7.JPEG'")
    out = corpus.with_boxes(S.images(spark, sf).select("filename"), boxes)
    return out.select(
        "filename",
        F.size("boxes").cast("bigint").alias("n_boxes"),
        F.try_element_at("boxes", F.lit(1))["xmin"].alias("first_xmin"),
        (F.size("boxes") > 0).alias("has_boxes"),
    )


@query(
    "j12_count_of_images_with_boxes",
    "SELECT count(*) AS images, count(*) FILTER (WHERE p_partkey % 10 <> 7 AND p_partkey IN (SELECT l_partkey FROM lineitem)) AS with_boxes FROM part",
)
def _(spark, sf):
    boxes = S.box_series(spark, sf).filter("filename NOT LIKE '%7.JPEG'")
    out = corpus.with_boxes(S.images(spark, sf).select("filename"), boxes)
    return out.agg(F.count(F.lit(1)).alias("images"), F.count_if(F.size("boxes") > 0).alias("with_boxes"))


@query(
    "j13_label_by_file_number",
    """SELECT 'val_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '.JPEG' AS filename, b.synset
    FROM customer LEFT JOIN (SELECT p_partkey + 1 AS n, replace(p_brand, '#', '_') AS synset FROM part) b ON c_custkey = n""",
)
def _(spark, sf):
    files = table(spark, sf, "customer").select(
        F.format_string("val_%08d.JPEG", F.col("c_custkey")).alias("filename")
    )
    labels = table(spark, sf, "part").select(
        (F.col("p_partkey") + 1).alias("line_no"), F.replace("p_brand", F.lit("#"), F.lit("_")).alias("synset")
    )
    return lookups.label_by_file_number(files, labels)


@query(
    "j14_listed_and_skipped_files",
    f"""WITH {S.IMAGES_CTE}, {S.LABELS_CTE} SELECT synset IN (SELECT synset FROM labels WHERE label <= 15) AS listed, count(*) AS files
    FROM images GROUP BY 1""",
)
def _(spark, sf):
    files = S.images(spark, sf).select("filename", "synset")
    listed = S.label_list(spark, sf).filter("label <= 15")
    kept = lookups.keep_listed(files, listed, "synset").withColumn("listed", F.lit(True))
    skipped = lookups.not_listed(files, listed, "synset").withColumn("listed", F.lit(False))
    return kept.unionByName(skipped).groupBy("listed").agg(F.count(F.lit(1)).alias("files"))


@query(
    "u01_union_of_shifted_months",
    f"""WITH {S.PERF_CTE} SELECT y, loan_id, CAST(floor((year(monthly_reporting_period) * 12 + month(monthly_reporting_period) - 24000 - y) / 12.0) AS BIGINT) AS slot,
      count(*) AS n FROM perf, range(1, 13) t(y) WHERE monthly_reporting_period IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    perf = S.performance(spark, sf).select("loan_id", loans.month_index().alias("m")).filter("m IS NOT NULL")
    shifted = [
        perf.select(F.lit(y).cast("bigint").alias("y"), "loan_id", F.floor((F.col("m") - 24000 - y) / 12).alias("slot"))
        for y in range(1, 13)
    ]
    return lookups.union_all(shifted).groupBy("y", "loan_id", "slot").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u02_union_of_different_columns",
    f"""WITH {S.TRAINING_CTE} SELECT test_uuid, model, np, NULL::DOUBLE AS images_per_sec FROM runs
    UNION ALL SELECT 'other-' || l_orderkey, NULL, NULL, l_quantity FROM lineitem""",
)
def _(spark, sf):
    runs = S.training_runs(spark, sf).select("test_uuid", "model", "np")
    other = table(spark, sf, "lineitem").select(
        F.concat(F.lit("other-"), F.col("l_orderkey")).alias("test_uuid"), F.col("l_quantity").alias("images_per_sec")
    )
    return lookups.union_all([runs, other])


@query(
    "u03_union_of_filtered_subsets",
    f"""WITH {S.TRAINING_CTE} SELECT test_uuid, storage_type, np FROM runs WHERE storage_type = 'na'
    UNION ALL SELECT test_uuid, storage_type, np FROM runs WHERE np = 48""",
)
def _(spark, sf):
    runs = S.training_runs(spark, sf).select("test_uuid", "storage_type", "np")
    return lookups.union_all([sel.filter_dataframe(runs, storage_type="na"), sel.filter_dataframe(runs, np=48)])


@query(
    "u04_one_frame_over_all_partitions",
    "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1",
)
def _(spark, sf):
    # Parts that each worker held apart are partitions of one frame; they meet in the aggregate only.
    parts = table(spark, sf, "orders").repartition(8, "o_orderkey")
    return parts.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query(
    "x24_used_from_total_and_available",
    """WITH a AS (SELECT user_id % 8 AS instance, CAST(epoch(ts) AS BIGINT) // 3600 AS step, max(round(value * 100)) AS v FROM events WHERE event_type = 'click' GROUP BY 1, 2),
    b AS (SELECT user_id % 8 AS instance, CAST(epoch(ts) AS BIGINT) // 3600 AS step, max(round(value * 100)) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT 'host' || instance AS instance, step * 3600000000 AS step_t, a.v - b.v AS used FROM a JOIN b USING (instance, step)""",
)
def _(spark, sf):
    from fathomry.operators.series import difference_of

    hour = 3_600_000_000
    samples = (
        S.metrics(spark, sf)
        .groupBy("metric", F.col("labels")["instance"].alias("instance"), (F.floor(F.col("t_us") / hour) * hour).alias("step_t"))
        .agg(F.max("value").alias("value"))
    )
    return difference_of(samples, ["instance", "step_t"], "metric", "click", "view", "value", "used")


@query(
    "p13_p14_normalised_boxes",
    f"""WITH {S.SCALED_CTE}, {S.LABELS_CTE}, b AS (SELECT *, CASE WHEN suppkey % 5 = 0 THEN 'Brand_' || CAST(1 + suppkey % 40 AS VARCHAR) ELSE synset END AS box_label FROM scaled)
    SELECT filename, synset, xmin, ymin, xmax, ymax FROM b WHERE synset IN (SELECT synset FROM labels WHERE label <= 20)
      AND NOT (box_label <> synset AND box_label IN (SELECT synset FROM labels WHERE label <= 20)) AND xmin < xmax AND ymin < ymax""",
)
def _(spark, sf):
    from fathomry.catalog.scans import annotation_documents

    listed = S.label_list(spark, sf).filter("label <= 20")
    return B.normalise_boxes(annotation_documents(spark, sf), listed).select("filename", "synset", *B.COORDS)
