"""Inputs of each domain, derived from the given tables.

Every derivation is a list of (column, expression) in the SQL both engines share, so a query and
the SQL it is checked against start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.catalog.base import table

K = "o_orderkey"
ORDER_DAY = "CAST(o_orderdate AS DATE)"


def _money(every: int, modulus: int) -> str:
    return f"CASE WHEN {K} % {every} = 0 THEN CAST({K} % {modulus} AS DOUBLE) END"


def _day(every: int) -> str:
    return f"CASE WHEN {K} % {every} = 0 THEN {ORDER_DAY} END"


PERFORMANCE = [
    ("loan_id", "o_custkey"),
    ("monthly_reporting_period", f"CASE WHEN {K} % 53 = 0 THEN NULL ELSE {ORDER_DAY} END"),
    ("servicer", f"CASE WHEN {K} % 37 = 0 THEN NULL ELSE o_orderpriority END"),
    ("interest_rate", f"CAST({K} % 800 AS DOUBLE) / 8"),
    ("current_actual_upb", f"CASE WHEN {K} % 11 = 0 THEN 0 WHEN {K} % 13 = 0 THEN NULL ELSE o_totalprice END"),
    ("loan_age", f"CAST({K} % 360 AS DOUBLE)"),
    ("remaining_months_to_legal_maturity", f"CAST(360 - {K} % 360 AS DOUBLE)"),
    ("adj_remaining_months_to_maturity", f"CASE WHEN {K} % 5 = 0 THEN NULL ELSE CAST(358 - {K} % 360 AS DOUBLE) END"),
    ("maturity_date", f"CASE WHEN {K} % 7 = 0 THEN NULL ELSE '12/2035' END"),
    ("msa", "CAST(o_custkey % 400 AS DOUBLE)"),
    ("current_loan_delinquency_status", f"CASE WHEN {K} % 17 = 0 THEN NULL ELSE CAST({K} % 7 AS INT) END"),
    ("mod_flag", f"CASE WHEN {K} % 3 = 0 THEN 'Y' ELSE 'N' END"),
    ("zero_balance_code", f"CASE WHEN {K} % 4 = 0 THEN '01' WHEN {K} % 4 = 1 THEN '09' ELSE NULL END"),
    ("zero_balance_effective_date", _day(4)),
    ("last_paid_installment_date", _day(6)),
    ("foreclosed_after", _day(8)),
    ("disposition_date", _day(10)),
    ("foreclosure_costs", _money(9, 1000)),
    ("prop_preservation_and_repair_costs", _money(9, 900)),
    ("asset_recovery_costs", _money(9, 800)),
    ("misc_holding_expenses", _money(9, 700)),
    ("holding_taxes", _money(9, 600)),
    ("net_sale_proceeds", _money(9, 5000)),
    ("credit_enhancement_proceeds", _money(12, 500)),
    ("repurchase_make_whole_proceeds", _money(12, 400)),
    ("other_foreclosure_proceeds", _money(12, 300)),
    ("non_interest_bearing_upb", _money(15, 2000)),
    ("principal_forgiveness_upb", _money(15, 100)),
    ("repurchase_make_whole_proceeds_flag", f"CASE WHEN {K} % 2 = 0 THEN 'N' ELSE NULL END"),
    ("foreclosure_principal_write_off_amount", _money(18, 50)),
    ("servicing_activity_indicator", f"CASE WHEN {K} % 29 = 0 THEN 'Y' ELSE 'N' END"),
]

C = "c_custkey"

ACQUISITION = [
    ("loan_id", C),
    ("orig_channel", f"CASE WHEN {C} % 3 = 0 THEN 'R' WHEN {C} % 3 = 1 THEN 'B' ELSE 'C' END"),
    ("seller_name", f"CASE WHEN {C} % 19 = 0 THEN NULL ELSE c_mktsegment END"),
    ("orig_interest_rate", f"CAST({C} % 80 AS DOUBLE) / 8"),
    ("orig_upb", f"{C} % 500 * 1000"),
    ("orig_loan_term", f"CASE WHEN {C} % 2 = 0 THEN CAST(360 AS BIGINT) ELSE CAST(180 AS BIGINT) END"),
    ("orig_date", f"CAST('1999-01-01' AS DATE) + CAST({C} % 365 AS INT)"),
    ("first_pay_date", f"CAST('1999-03-01' AS DATE) + CAST({C} % 365 AS INT)"),
    ("orig_ltv", f"CAST({C} % 97 AS DOUBLE)"),
    ("orig_cltv", f"CASE WHEN {C} % 7 = 0 THEN NULL ELSE CAST({C} % 97 AS DOUBLE) END"),
    ("num_borrowers", f"CAST(1 + {C} % 2 AS DOUBLE)"),
    ("dti", f"CASE WHEN {C} % 11 = 0 THEN NULL ELSE CAST({C} % 60 AS DOUBLE) END"),
    ("borrower_credit_score", f"CAST(500 + {C} % 350 AS DOUBLE)"),
    ("first_home_buyer", f"CASE WHEN {C} % 4 = 0 THEN 'Y' ELSE 'N' END"),
    ("loan_purpose", f"CASE WHEN {C} % 5 = 0 THEN 'P' WHEN {C} % 5 = 1 THEN 'C' ELSE 'R' END"),
    ("property_type", f"CASE WHEN {C} % 6 = 0 THEN 'CO' ELSE 'SF' END"),
    ("num_units", f"1 + {C} % 4"),
    ("occupancy_status", f"CASE WHEN {C} % 8 = 0 THEN 'I' ELSE 'P' END"),
    ("property_state", "'S' || CAST(c_nationkey AS VARCHAR(9))"),
    ("zip", f"{C} % 1000"),
    ("mortgage_insurance_percent", f"CASE WHEN {C} % 3 = 0 THEN 25E0 END"),
    ("product_type", "'FRM'"),
    ("coborrow_credit_score", f"CASE WHEN {C} % 2 = 0 THEN CAST(500 + {C} % 300 AS DOUBLE) END"),
    ("mortgage_insurance_type", f"CASE WHEN {C} % 3 = 0 THEN CAST(1 + {C} % 2 AS DOUBLE) END"),
    ("relocation_mortgage_indicator", f"CASE WHEN {C} % 50 = 0 THEN 'Y' ELSE 'N' END"),
]

# Time of an event in microseconds, as each engine spells it.
SPARK_US = "unix_micros(CAST(ts AS TIMESTAMP))"
DUCK_US = "epoch_us(ts)"

CENTS = "CAST(round(value * 100) AS BIGINT)"

EVENTS = [
    ("event_id", "event_id"),
    ("user_id", "user_id"),
    ("event_type", "event_type"),
    ("ts", "ts"),
    ("t_us", "@US"),
    ("cents", f"CAST({CENTS} AS DOUBLE)"),
    ("counter", f"CAST(event_id % 700 * 1000 + {CENTS} % 1000 AS DOUBLE)"),
    ("sent", f"CAST(event_id % 900 * 500 + {CENTS} % 500 AS DOUBLE)"),
    ("instance", "'host' || CAST(user_id % 8 AS VARCHAR(9))"),
    ("grp", "CASE WHEN user_id % 3 = 0 THEN 'gpu' WHEN user_id % 3 = 1 THEN 'mgmt' ELSE 'lab' END"),
    (
        "device",
        "CASE WHEN event_type = 'click' THEN 'enp12s0f0' WHEN event_type = 'view' THEN 'enp134s0f1' "
        "WHEN event_type = 'error' THEN 'veth12' WHEN event_type = 'signup' THEN 'lo' ELSE NULL END",
    ),
]

PORTS = [
    ("event_id", "event_id"),
    ("t", "CAST(@US AS DOUBLE) / 1E6"),
    ("counter", f"event_id * 1000 + {CENTS} % 1000"),
    ("device", "CAST(user_id % 4 AS INT)"),
    ("port", "CAST(1 + user_id % 3 AS INT)"),
    ("counter_name", "CASE WHEN event_type IN ('click', 'view') THEN 'port_rcv_data' ELSE 'port_xmit_data' END"),
    ("rate_gbps", f"CAST({CENTS} % 64 AS DOUBLE) / 8"),
]

STEPS = [
    ("ts", "ts"),
    ("t_us", "@US"),
    ("batch_size", "CAST(32 + event_id % 3 * 16 AS INT)"),
    ("rank", "CAST(user_id % 4 AS INT)"),
    ("hostname", "'host' || CAST(user_id % 2 AS VARCHAR(9))"),
    ("step", "CAST(event_id AS INT)"),
    ("num_bytes", f"{CENTS} * 1000"),
    ("latency_sec", "CAST(event_id % 50 AS DOUBLE) / 8"),
    ("sync_latency_sec", "CAST(event_id % 41 AS DOUBLE)"),
]

NL = "chr(10)"

TRAINING = [
    ("test_uuid", f"'run-' || CAST({K} AS VARCHAR(20))"),
    ("utc_begin", f"'2019-10-24T14:' || CAST(10 + {K} % 50 AS VARCHAR(2)) || ':00Z'"),
    ("utc_end", f"'2019-10-24T15:' || CAST(10 + {K} % 50 AS VARCHAR(2)) || ':00Z'"),
    ("error", f"CASE WHEN {K} % 10 = 0 THEN TRUE WHEN {K} % 10 = 1 THEN NULL ELSE FALSE END"),
    (
        "output",
        f"CASE WHEN {K} % 13 = 0 THEN NULL WHEN {K} % 13 = 1 THEN '' ELSE 'BEGIN' || {NL} || "
        f"'total images/sec: ' || CAST({K} % 900 AS VARCHAR(9)) || '.25' || {NL} || 'step' || {NL} || "
        f"'total images/sec: ' || CAST({K} % 700 AS VARCHAR(9)) || '.5' || {NL} || "
        f"'FINAL RESULTS JSON: {{\"sec\": ' || CAST({K} % 60 AS VARCHAR(9)) || ', \"host\": \"' || o_orderstatus || '\"}}' || {NL} || 'END' END",
    ),
    ("model", "CASE WHEN o_orderpriority = '1-URGENT' THEN 'resnet50' WHEN o_orderpriority = '2-HIGH' THEN 'vgg16' ELSE 'inception4' END"),
    ("np", f"CAST(16 * (1 + {K} % 3) AS INT)"),
    ("num_batches", f"CAST(CASE WHEN {K} % 4 = 0 THEN 500 WHEN {K} % 4 = 1 THEN 499 ELSE 50000 END AS INT)"),
    ("num_copies", f"CASE WHEN {K} % 3 = 0 THEN 150E0 WHEN {K} % 3 = 1 THEN NULL ELSE 1E0 END"),
    ("cached", f"CASE WHEN {K} % 2 = 0 THEN TRUE WHEN {K} % 5 = 1 THEN NULL ELSE FALSE END"),
    ("image_format", f"CASE WHEN {K} % 6 = 0 THEN 'PNG' WHEN {K} % 6 = 1 THEN NULL ELSE 'JPEG' END"),
    ("data_dir_suffix", f"CASE WHEN {K} % 3 = 0 THEN '-150x' WHEN {K} % 6 = 1 THEN '-other' WHEN {K} % 6 = 2 THEN '-png2' ELSE '' END"),
    ("storage_type", f"CASE WHEN {K} % 7 < 3 THEN 'nfs' WHEN {K} % 7 = 3 THEN NULL ELSE 'na' END"),
]

IMAGES = [
    ("filename", "replace(p_brand, '#', '_') || '_' || CAST(p_partkey AS VARCHAR(20)) || '.JPEG'"),
    ("synset", "replace(p_brand, '#', '_')"),
    ("height", "CAST(200 + p_partkey % 300 AS BIGINT)"),
    ("width", "CAST(300 + p_partkey % 400 AS BIGINT)"),
    ("content", "p_name || ' ' || p_type"),
    ("p_partkey", "p_partkey"),
]

# Raw pixel boxes on the image of their part; ends out of order, outside the image or equal occur.
RAW_BOXES = [
    ("l_partkey", "l_partkey"),
    ("xmin", "CAST(floor(l_quantity * 10) AS INT) - 40"),
    ("xmax", "CAST(floor(l_extendedprice) AS INT) % 700"),
    ("ymin", "CAST(floor(l_quantity) AS INT) * 5"),
    ("ymax", "CAST(l_orderkey % 400 AS INT)"),
    ("suppkey", "l_suppkey"),
]


def columns(items: list[tuple[str, str]], us: str = SPARK_US) -> list[str]:
    return [f"{expr.replace('@US', us)} AS {name}" for name, expr in items]


def select_sql(items: list[tuple[str, str]], source: str, where: str = "") -> str:
    return f"SELECT {', '.join(columns(items, DUCK_US))} FROM {source} {where}"


# For joins that must meet loans without an acquisition row, and sellers without a name.
ACQ_WHERE = f"WHERE {C} % 10 <> 9"
NAMES_WHERE = "WHERE c_mktsegment <> 'MACHINERY'"
NAMES_SQL = "SELECT DISTINCT c_mktsegment AS seller_name, 'Bank ' || c_mktsegment AS new FROM customer"

PERF_CTE = f"perf AS ({select_sql(PERFORMANCE, 'orders')})"
ACQ_CTE = f"acq AS ({select_sql(ACQUISITION, 'customer')})"
SOME_ACQ_CTE = f"acq AS ({select_sql(ACQUISITION, 'customer', ACQ_WHERE)})"
SOME_NAMES_CTE = f"names AS ({NAMES_SQL} {NAMES_WHERE})"
EVENTS_CTE = f"ev AS ({select_sql(EVENTS, 'events')})"
PORTS_CTE = f"ports AS ({select_sql(PORTS, 'events')})"
STEPS_CTE = f"steps AS ({select_sql(STEPS, 'events')})"
TRAINING_CTE = f"runs AS ({select_sql(TRAINING, 'orders')})"
IMAGES_CTE = f"images AS ({select_sql(IMAGES, 'part')})"
RAW_BOXES_CTE = f"raw_boxes AS ({select_sql(RAW_BOXES, 'lineitem')})"

# Scaled boxes by the plain arithmetic definition, with the image they belong to.
SCALED_CTE = f"""{IMAGES_CTE}, {RAW_BOXES_CTE}, scaled AS (
  SELECT filename, synset, suppkey,
    least(greatest(least(xmin / CAST(width AS DOUBLE), xmax / CAST(width AS DOUBLE)), 0), 1) AS xmin,
    least(greatest(least(ymin / CAST(height AS DOUBLE), ymax / CAST(height AS DOUBLE)), 0), 1) AS ymin,
    least(greatest(greatest(xmin / CAST(width AS DOUBLE), xmax / CAST(width AS DOUBLE)), 0), 1) AS xmax,
    least(greatest(greatest(ymin / CAST(height AS DOUBLE), ymax / CAST(height AS DOUBLE)), 0), 1) AS ymax
  FROM raw_boxes JOIN images ON l_partkey = p_partkey)"""


def performance(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*columns(PERFORMANCE))


def acquisition(spark: SparkSession, sf: str, where: str = "") -> DataFrame:
    customers = table(spark, sf, "customer")
    return (customers.filter(where.removeprefix("WHERE ")) if where else customers).selectExpr(*columns(ACQUISITION))


def seller_names(spark: SparkSession, sf: str, where: str = "") -> DataFrame:
    customers, segment = table(spark, sf, "customer"), F.col("c_mktsegment")
    kept = customers.filter(where.removeprefix("WHERE ")) if where else customers
    return kept.select(segment.alias("seller_name"), F.concat(F.lit("Bank "), segment).alias("new")).distinct()


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*columns(EVENTS))


def ports(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*columns(PORTS))


def steps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*columns(STEPS))


def training_runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*columns(TRAINING))


def images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*columns(IMAGES))


def raw_boxes(spark: SparkSession, sf: str) -> DataFrame:
    boxes = table(spark, sf, "lineitem").selectExpr(*columns(RAW_BOXES))
    return boxes.join(images(spark, sf), F.col("l_partkey") == F.col("p_partkey"))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled samples: (metric, labels, t_us, value)."""
    labels = F.map_filter(
        F.create_map(F.lit("instance"), F.col("instance"), F.lit("group"), F.col("grp"), F.lit("device"), F.col("device")),
        lambda _, v: v.isNotNull(),
    )
    return events(spark, sf).select(
        F.col("event_type").alias("metric"), labels.alias("labels"), "t_us", "ts", F.col("cents").alias("value"), "event_id"
    )


def box_series(spark: SparkSession, sf: str) -> DataFrame:
    """Scaled boxes keyed by image."""
    from fathomry.operators.boxes import scale_boxes

    return scale_boxes(raw_boxes(spark, sf))


def label_list(spark: SparkSession, sf: str) -> DataFrame:
    """(synset, label): distinct classes numbered in order from 1."""
    from fathomry.operators.ordered import ordered_positions

    names = images(spark, sf).select("synset").distinct()
    return ordered_positions(names, ["synset"]).select("synset", (F.col("position") + 1).alias("label"))


LABELS_CTE = "labels AS (SELECT synset, row_number() OVER (ORDER BY synset) AS label FROM (SELECT DISTINCT synset FROM images))"


def synset_texts(spark: SparkSession, sf: str) -> DataFrame:
    return images(spark, sf).groupBy("synset").agg(F.min("content").alias("text"))


TEXTS_CTE = "texts AS (SELECT synset, min(content) AS text FROM images GROUP BY synset)"
