"""Projections, filters, predicates (P), sorts and limits (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomry.catalog import standins as S
from fathomry.catalog.base import query, table
from fathomry.operators import boxes as B
from fathomry.operators import lookups, report
from fathomry.operators import selection as sel
from fathomry.operators.encode import encode_strings
from fathomry.schemas import NOT_FEATURES


@query("p01_column_subset", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("p02_drop_columns", f"WITH {S.ACQ_CTE} SELECT * EXCLUDE (loan_id, orig_date, first_pay_date, seller_name) FROM acq")
def _(spark, sf):
    return S.acquisition(spark, sf).drop(*NOT_FEATURES)


@query(
    "p03_rename",
    f"""WITH {S.PERF_CTE} SELECT loan_id, monthly_reporting_period AS timestamp, current_loan_delinquency_status AS delinquency_12,
      current_actual_upb AS upb_12 FROM perf""",
)
def _(spark, sf):
    names = {"monthly_reporting_period": "timestamp", "current_loan_delinquency_status": "delinquency_12", "current_actual_upb": "upb_12"}
    return S.performance(spark, sf).select("loan_id", *names).withColumnsRenamed(names)


@query(
    "p04_status_thresholds",
    f"""WITH {S.PERF_CTE} SELECT k, loan_id, current_loan_delinquency_status AS status FROM perf, (VALUES (1), (3), (6)) t(k)
    WHERE current_loan_delinquency_status >= k""",
)
def _(spark, sf):
    perf = S.performance(spark, sf).select("loan_id", F.col("current_loan_delinquency_status").alias("status"))
    return lookups.union_all([perf.filter(F.col("status") >= k).withColumn("k", F.lit(k)) for k in (1, 3, 6)])


@query("p05_keep_not_error", f"WITH {S.TRAINING_CTE} SELECT test_uuid, error FROM runs WHERE error = false")
def _(spark, sf):
    return S.training_runs(spark, sf).filter(sel.not_error()).select("test_uuid", "error")


@query(
    "p06_filter_dataframe",
    f"""WITH {S.TRAINING_CTE} SELECT test_uuid, np, num_batches, num_copies, image_format FROM runs
    WHERE np = 48 AND num_batches BETWEEN 500 AND 50000 AND num_copies IN (1, 150) AND image_format = 'JPEG'""",
)
def _(spark, sf):
    runs = S.training_runs(spark, sf).select("test_uuid", "np", "num_batches", "num_copies", "image_format")
    return sel.filter_dataframe(runs, np=48, num_batches=(500, 50000), num_copies=[1.0, 150.0], image_format="JPEG")


@query(
    "p07_series_slice",
    f"""WITH {S.PORTS_CTE} SELECT event_id, device, t FROM ports
    WHERE device IN (0, 1) AND port = 1 AND counter_name = 'port_rcv_data' AND t > 1704100000 AND t < 1705000000""",
)
def _(spark, sf):
    ports = sel.filter_dataframe(S.ports(spark, sf), device=[0, 1], port=1, counter_name="port_rcv_data")
    return ports.filter((F.col("t") > 1704100000.0) & (F.col("t") < 1705000000.0)).select("event_id", "device", "t")


@query(
    "p08_label_matchers",
    f"""WITH {S.EVENTS_CTE} SELECT event_id, instance FROM ev
    WHERE NOT regexp_full_match(coalesce(device, ''), 'veth.*|lo')
      AND regexp_full_match(coalesce(device, ''), 'enp134s0.*|enp12s0.*') AND grp = 'gpu'""",
)
def _(spark, sf):
    m = S.metrics(spark, sf)
    kept = m.filter(
        ~sel.label_matches("labels", "device", "veth.*|lo")
        & sel.label_matches("labels", "device", "enp134s0.*|enp12s0.*")
        & sel.label_is("labels", "group", "gpu")
    )
    return kept.select("event_id", F.col("labels")["instance"].alias("instance"))


@query(
    "p09_varying_columns",
    f"""WITH {S.TRAINING_CTE} SELECT test_uuid, utc_begin, utc_end, output, model, np, num_batches, num_copies, cached,
      image_format, data_dir_suffix FROM runs WHERE storage_type = 'nfs' AND error = false""",
)
def _(spark, sf):
    runs = sel.filter_dataframe(S.training_runs(spark, sf), storage_type="nfs", error=False)
    return sel.take_varying_columns(runs)


@query(
    "p10_fill_numbers",
    f"""WITH {S.PERF_CTE} SELECT loan_id, monthly_reporting_period, servicer, coalesce(current_actual_upb, -1) AS current_actual_upb,
      coalesce(current_loan_delinquency_status, -1) AS current_loan_delinquency_status, coalesce(foreclosure_costs, -1) AS foreclosure_costs FROM perf""",
)
def _(spark, sf):
    cols = ["loan_id", "monthly_reporting_period", "servicer", "current_actual_upb", "current_loan_delinquency_status", "foreclosure_costs"]
    return sel.fill_numbers(S.performance(spark, sf).select(*cols), -1)


@query(
    "p11_defaults",
    f"""WITH {S.TRAINING_CTE} SELECT test_uuid, coalesce(num_copies, 1) AS num_copies, coalesce(image_format, 'JPEG') AS image_format,
      false AS warmup FROM runs""",
)
def _(spark, sf):
    runs = S.training_runs(spark, sf).select("test_uuid", "num_copies", "image_format")
    return sel.fill_defaults(runs, {"num_copies": 1.0, "image_format": "JPEG", "warmup": False})


@query(
    "p12_fill_by_type",
    f"""WITH {S.TRAINING_CTE} SELECT test_uuid, coalesce(num_copies, 0) AS num_copies, coalesce(storage_type, '0') AS storage_type,
      coalesce(cached, false) AS cached FROM runs""",
)
def _(spark, sf):
    return sel.fill_by_type(S.training_runs(spark, sf).select("test_uuid", "num_copies", "storage_type", "cached"))


@query(
    "p13_drop_degenerate_boxes",
    f"WITH {S.SCALED_CTE} SELECT filename, xmin, ymin, xmax, ymax FROM scaled WHERE xmin < xmax AND ymin < ymax",
)
def _(spark, sf):
    return B.drop_degenerate(S.box_series(spark, sf)).select("filename", *B.COORDS)


FOREIGN = "CASE WHEN suppkey % 5 = 0 THEN 'Brand_' || CAST(1 + suppkey % 40 AS VARCHAR(9)) WHEN suppkey % 5 = 1 THEN 'deerhound' ELSE synset END"


@query(
    "p14_drop_foreign_labels",
    f"""WITH {S.SCALED_CTE}, b AS (SELECT filename, synset, suppkey, {FOREIGN} AS box_label FROM scaled)
    SELECT * FROM b WHERE NOT (box_label <> synset AND box_label IN (SELECT synset FROM images))""",
)
def _(spark, sf):
    boxes = S.raw_boxes(spark, sf).select("filename", "synset", "suppkey").withColumn("box_label", F.expr(FOREIGN))
    return B.drop_foreign_label(boxes, S.images(spark, sf).select("synset").distinct())


@query(
    "p15_complete_samples",
    """SELECT p_partkey AS sample_id, p_retailprice AS coverage FROM part
    WHERE p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) = 30)""",
)
def _(spark, sf):
    samples = table(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_retailprice").alias("coverage"))
    files = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("sample_id"))
    return lookups.complete_samples(samples, files, 30)


def code_sql(source: str, column: str) -> str:
    return f"""(SELECT v, CAST(row_number() OVER (ORDER BY n DESC, v) - 1 AS INT) AS code
      FROM (SELECT coalesce({column}, '') AS v, count(*) AS n FROM {source} GROUP BY 1))"""


@query(
    "p16_float32_and_codes",
    f"""WITH {S.ACQ_CTE} SELECT CAST(loan_id AS FLOAT) AS loan_id, CAST(c.code AS FLOAT) AS orig_channel, CAST(dti AS FLOAT) AS dti
    FROM acq JOIN {code_sql('acq', 'orig_channel')} c ON c.v = orig_channel""",
)
def _(spark, sf):
    acq = S.acquisition(spark, sf).select("loan_id", "orig_channel", "dti")
    return sel.as_float32(encode_strings(acq))


@query("p17_features_except_label", f"WITH {S.ACQ_CTE} SELECT loan_id, orig_ltv, dti FROM acq")
def _(spark, sf):
    acq = S.acquisition(spark, sf).select("loan_id", "orig_ltv", "dti", "zip")
    return acq.select(*sel.features_except(acq, "zip"))


@query("o01_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("o02_first_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(10)


@query("o03_last_n", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 3")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(3)


@query("o04_lookup_by_key", f"WITH {S.TRAINING_CTE} SELECT test_uuid, output FROM runs WHERE test_uuid = 'run-77'")
def _(spark, sf):
    return sel.filter_dataframe(S.training_runs(spark, sf).select("test_uuid", "output"), test_uuid="run-77")


@query(
    "o05_sorted_boxes",
    f"WITH {S.SCALED_CTE} SELECT filename, xmin, ymin, xmax, ymax FROM scaled ORDER BY 1, 2, 3, 4, 5",
)
def _(spark, sf):
    return S.box_series(spark, sf).select("filename", *B.COORDS).orderBy("filename", *B.COORDS)


@query(
    "o06_first_records_per_file",
    """SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5""",
)
def _(spark, sf):
    return report.first_n_per_group(table(spark, sf, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 5)
