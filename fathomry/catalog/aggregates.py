"""Aggregations (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomry.catalog import standins as S
from fathomry.catalog.base import query, table
from fathomry.catalog.scans import annotation_documents
from fathomry.functions import measures as M
from fathomry.operators import boxes as B
from fathomry.operators import loans, report, series
from fathomry.operators.selection import label_matches


@query(
    "a01_max_rate_by_servicer",
    "SELECT l_returnflag AS servicer, max(l_discount) AS max_interest_rate FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    scan = table(spark, sf, "lineitem").withColumnsRenamed({"l_returnflag": "servicer", "l_discount": "interest_rate"})
    return report.max_rate_by_servicer(scan)


@query(
    "a02_ever_delinquent",
    f"""WITH {S.PERF_CTE} SELECT loan_id,
      CAST(max(current_loan_delinquency_status) >= 1 AS TINYINT) AS ever_30,
      CAST(max(current_loan_delinquency_status) >= 3 AS TINYINT) AS ever_90,
      CAST(max(current_loan_delinquency_status) >= 6 AS TINYINT) AS ever_180
    FROM perf GROUP BY loan_id""",
)
def _(spark, sf):
    per_loan = loans.ever_and_first_delinquency(S.performance(spark, sf))
    return per_loan.select("loan_id", "ever_30", "ever_90", "ever_180")


@query(
    "a03_first_delinquency",
    f"""WITH {S.PERF_CTE},
    d30 AS (SELECT loan_id, min(monthly_reporting_period) AS d FROM perf WHERE current_loan_delinquency_status >= 1 GROUP BY 1),
    d90 AS (SELECT loan_id, min(monthly_reporting_period) AS d FROM perf WHERE current_loan_delinquency_status >= 3 GROUP BY 1),
    d180 AS (SELECT loan_id, min(monthly_reporting_period) AS d FROM perf WHERE current_loan_delinquency_status >= 6 GROUP BY 1)
    SELECT l.loan_id, coalesce(d30.d, DATE '1970-01-01') AS delinquency_30,
      coalesce(d90.d, DATE '1970-01-01') AS delinquency_90, coalesce(d180.d, DATE '1970-01-01') AS delinquency_180
    FROM (SELECT DISTINCT loan_id FROM perf) l
    LEFT JOIN d30 USING (loan_id) LEFT JOIN d90 USING (loan_id) LEFT JOIN d180 USING (loan_id)""",
)
def _(spark, sf):
    per_loan = loans.ever_and_first_delinquency(S.performance(spark, sf))
    return per_loan.select("loan_id", "delinquency_30", "delinquency_90", "delinquency_180")


@query(
    "a04_status_and_balance_by_month",
    f"""WITH {S.PERF_CTE} SELECT loan_id, year(monthly_reporting_period) * 12 + month(monthly_reporting_period) AS month_idx,
      max(coalesce(current_loan_delinquency_status, -1)) AS worst, min(coalesce(current_actual_upb, 999999999)) AS least
    FROM perf WHERE monthly_reporting_period IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    perf = S.performance(spark, sf)
    status = F.coalesce(F.col(loans.STATUS), F.lit(loans.NO_NUMBER))
    upb = F.coalesce(F.col(loans.UPB), F.lit(float(loans.NO_UPB)))
    return (
        perf.filter(F.col(loans.MONTH).isNotNull())
        .groupBy("loan_id", loans.month_index().cast("bigint").alias("month_idx"))
        .agg(F.max(status).alias("worst"), F.min(upb).alias("least"))
    )


@query(
    "a05_checksum",
    "SELECT CAST(sum(l_orderkey) AS DECIMAL(38,0)) AS checksum, count(*) AS rows FROM lineitem",
)
def _(spark, sf):
    return report.checksum(table(spark, sf, "lineitem"), "l_orderkey")


@query("a06_row_count", "SELECT count(*) AS rows FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "a07_max_rate_by_batch",
    "SELECT l_linenumber AS batch, l_returnflag AS servicer, max(l_discount) AS max_interest_rate FROM lineitem GROUP BY 1, 2",
)
def _(spark, sf):
    scan = table(spark, sf, "lineitem").withColumnsRenamed(
        {"l_returnflag": "servicer", "l_discount": "interest_rate", "l_linenumber": "batch"}
    )
    return report.max_rate_by_servicer(scan, batch="batch")


@query(
    "a08_group_sizes",
    f"WITH {S.TRAINING_CTE} SELECT storage_type, count(*) AS size FROM runs WHERE storage_type IS NOT NULL GROUP BY 1",
)
def _(spark, sf):
    return report.group_sizes(S.training_runs(spark, sf), "storage_type")


@query("a08_value_counts", "SELECT p_type, count(*) AS size FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1")
def _(spark, sf):
    return report.value_counts(table(spark, sf, "part"), "p_type")


@query(
    "a09_boxes_per_image",
    f"""WITH {S.SCALED_CTE} SELECT filename, count(*) OVER (PARTITION BY filename) AS n,
      CAST(row_number() OVER (PARTITION BY filename ORDER BY xmin, ymin, xmax, ymax) - 1 AS INT) AS box_no, xmin, ymin, xmax, ymax FROM scaled""",
)
def _(spark, sf):
    lists = B.collect_boxes(S.box_series(spark, sf)).withColumn("n", F.size("boxes").cast("bigint"))
    rows = lists.select("filename", "n", F.posexplode("boxes").alias("box_no", "box"))
    return rows.select("filename", "n", "box_no", *[F.col(f"box.{c}") for c in B.COORDS])


@query(
    "a10_box_coordinate_lists",
    f"""WITH {S.SCALED_CTE}, {S.LABELS_CTE} SELECT filename, CAST(xmin AS FLOAT) AS xmin, CAST(ymin AS FLOAT) AS ymin,
      CAST(xmax AS FLOAT) AS xmax, CAST(ymax AS FLOAT) AS ymax, label FROM scaled JOIN labels USING (synset)""",
)
def _(spark, sf):
    labelled = S.images(spark, sf).select("filename", "synset").join(S.label_list(spark, sf), "synset")
    lists = B.box_lists(B.collect_boxes(S.box_series(spark, sf)).join(labelled, "filename"))
    names = [*B.COORDS, "label"]
    rows = lists.select("filename", F.explode(F.arrays_zip(*[F.col(f"bbox_{c}").alias(c) for c in names])).alias("box"))
    return rows.select("filename", *[F.col(f"box.{c}") for c in names])


@query(
    "a11_stats_by_parameter",
    f"""WITH {S.TRAINING_CTE} SELECT model, np, count(*) AS num_copies_size, count(num_copies) AS num_copies_count,
      min(num_copies) AS num_copies_min, avg(num_copies) AS num_copies_mean, max(num_copies) AS num_copies_max,
      avg(num_batches) AS num_batches_mean FROM runs GROUP BY 1, 2""",
)
def _(spark, sf):
    return report.stats_by(
        S.training_runs(spark, sf), ["model", "np"],
        {"num_copies": ["size", "count", "min", "mean", "max"], "num_batches": ["mean"]},
    )


@query(
    "a12_mean_of_one_column",
    f"""WITH {S.TRAINING_CTE} SELECT model, np, coalesce(storage_type, '0') AS storage_type, coalesce(cached, false) AS cached,
      avg(coalesce(num_copies, 0)) AS num_copies_mean FROM runs GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    from fathomry.operators.selection import fill_by_type

    runs = fill_by_type(S.training_runs(spark, sf))
    return report.stats_by(runs, ["model", "np", "storage_type", "cached"], {"num_copies": ["mean"]})


@query(
    "a13_rate_summary_per_series",
    f"""WITH {S.PORTS_CTE} SELECT device, port, counter_name, avg(rate_gbps) AS rate_gbps_mean, max(rate_gbps) AS rate_gbps_max,
      max(counter * 4e-6) AS MB_max FROM ports GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    ports = S.ports(spark, sf).withColumn("MB", F.col("counter") * series.MB_PER_WORD)
    return report.stats_by(ports, ["device", "port", "counter_name"], {"rate_gbps": ["mean", "max"], "MB": ["max"]})


@query(
    "a14_total_and_average_by_step",
    f"""WITH {S.EVENTS_CTE} SELECT t_us // 3600000000 * 3600000000 AS step_t, instance, sum(cents) AS total, avg(cents) AS average
    FROM ev WHERE grp IN ('gpu', 'mgmt') GROUP BY 1, 2""",
)
def _(spark, sf):
    hour = 3_600_000_000
    samples = S.metrics(spark, sf).filter(label_matches("labels", "group", "gpu|mgmt"))
    step = (F.floor(F.col("t_us") / hour) * hour).alias("step_t")
    return samples.groupBy(step, F.col("labels")["instance"].alias("instance")).agg(
        F.sum("value").alias("total"), F.avg("value").alias("average")
    )


@query(
    "a15_first_begin_last_end",
    """SELECT o_orderstatus, min(o_orderdate) AS first_begin_utc, max(o_orderdate) AS last_end_utc,
      strftime((min(o_orderdate) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d %H:%M:%S') AS first_begin_local,
      strftime((max(o_orderdate) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d %H:%M:%S') AS last_end_local
    FROM orders GROUP BY 1""",
)
def _(spark, sf):
    span = table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.min("o_orderdate").alias("first_begin_utc"), F.max("o_orderdate").alias("last_end_utc")
    )

    def local(c):
        return F.date_format(F.from_utc_timestamp(F.col(c).cast("timestamp"), "America/Los_Angeles"), "yyyy-MM-dd HH:mm:ss")

    return span.withColumn("first_begin_local", local("first_begin_utc")).withColumn("last_end_local", local("last_end_utc"))


@query(
    "a16_bytes_per_record_and_group",
    """SELECT coalesce(lang, 'TOTAL') AS lang, sum(strlen(text))::BIGINT AS num_bytes, count(*) AS records
    FROM documents GROUP BY GROUPING SETS ((lang), ())""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("lang", F.octet_length("text").alias("num_bytes"))
    by_group = docs.groupBy("lang").agg(F.sum("num_bytes").alias("num_bytes"), F.count(F.lit(1)).alias("records"))
    overall = by_group.agg(F.sum("num_bytes").alias("num_bytes"), F.sum("records").alias("records"))
    return by_group.unionByName(overall.withColumn("lang", F.lit("TOTAL")))


@query(
    "a17_images_per_file",
    """SELECT source AS file, count(*) AS image_count, avg(n_chars) AS original_mean, avg(strlen(text)) AS resized_mean
    FROM documents GROUP BY 1""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumn("encoded", F.octet_length("text"))
    return docs.groupBy(F.col("source").alias("file")).agg(
        F.count(F.lit(1)).alias("image_count"), F.avg("n_chars").alias("original_mean"), F.avg("encoded").alias("resized_mean")
    )


@query(
    "a18_saved_and_skipped_boxes",
    f"""WITH {S.SCALED_CTE} SELECT synset, count(*) FILTER (WHERE xmin < xmax AND ymin < ymax) AS saved_boxes,
      count(*) FILTER (WHERE NOT (xmin < xmax AND ymin < ymax)) AS skipped_boxes FROM scaled GROUP BY 1""",
)
def _(spark, sf):
    return S.box_series(spark, sf).groupBy("synset").agg(
        F.count_if(B.has_area()).alias("saved_boxes"), F.count_if(~B.has_area()).alias("skipped_boxes")
    )


# The same run by its plain definition: classes of an even number are listed.
@query(
    "a18_counted_annotation_run",
    f"""WITH {S.SCALED_CTE}, listed AS (SELECT DISTINCT synset FROM images WHERE length(synset) % 2 = 0),
    b AS (SELECT filename, suppkey % 5 = 0 AND other IN (SELECT synset FROM listed) AND other <> synset AS is_foreign, xmin < xmax AND ymin < ymax AS area
      FROM (SELECT *, 'Brand_' || CAST(1 + suppkey % 40 AS VARCHAR) AS other FROM scaled) WHERE synset IN (SELECT synset FROM listed)),
    f AS (SELECT filename, count(*) FILTER (WHERE NOT is_foreign AND area) AS saved, count(*) AS boxes, count(*) FILTER (WHERE is_foreign) AS others FROM b GROUP BY 1),
    a AS (SELECT DISTINCT filename, synset FROM scaled)
    SELECT synset, CAST(sum(coalesce(saved, 0)) AS BIGINT) AS saved_boxes, CAST(sum(coalesce(boxes - saved, 0)) AS BIGINT) AS skipped_boxes,
      CAST(sum(coalesce(others, 0)) AS BIGINT) AS foreign_boxes, count(*) FILTER (WHERE saved > 0) AS saved_files, count(*) FILTER (WHERE coalesce(saved, 0) = 0) AS skipped_files
    FROM a LEFT JOIN f USING (filename) GROUP BY 1""",
)
def _(spark, sf):
    listed = S.images(spark, sf).select("synset").distinct().filter(F.length("synset") % 2 == 0)
    return B.count_annotations(annotation_documents(spark, sf), listed, by="synset")


@query(
    "a19_average_per_bucket_and_term",
    """SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS bucket, avg(CAST(round(value * 100) AS DOUBLE)) AS average
    FROM events WHERE user_id % 8 < 4 GROUP BY 1, 2""",
)
def _(spark, sf):
    ev = S.events(spark, sf).filter(F.col("instance").isin("host0", "host1", "host2", "host3"))
    return (
        ev.groupBy("event_type", F.window("ts", "1 hour").alias("w"))
        .agg(F.avg("cents").alias("average"))
        .select("event_type", F.col("w.start").alias("bucket"), "average")
    )


@query("a20_distinct_labels", "SELECT DISTINCT replace(p_brand, '#', '_') AS synset FROM part")
def _(spark, sf):
    return S.images(spark, sf).select("synset").distinct()


@query(
    "a21_array_totals",
    """SELECT o_orderkey, CAST(o_orderkey % 7 + o_orderkey % 5 + o_orderkey % 3 AS DOUBLE) AS compute_sec,
      CAST(o_custkey + o_orderkey % 100 + 7 AS DOUBLE) AS input_files_size, 3 AS num_input_files FROM orders""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    runs = table(spark, sf, "orders").select(
        "o_orderkey",
        F.array((k % 7).cast("double"), (k % 5).cast("double"), (k % 3).cast("double")).alias("compute_sec_list"),
        F.array(F.array(F.col("o_custkey"), k % 100), F.array(F.lit(7).cast("bigint"))).alias("input_file_sizes"),
    )
    return runs.select(
        "o_orderkey",
        M.array_sum("compute_sec_list").alias("compute_sec"),
        M.nested_sum("input_file_sizes").alias("input_files_size"),
        M.nested_size("input_file_sizes").alias("num_input_files"),
    )
