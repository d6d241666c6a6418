"""Window and time-series operators (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomry.catalog import standins as S
from fathomry.catalog.base import query, table
from fathomry.functions.measures import plus_seconds
from fathomry.operators import loans, report, series
from fathomry.operators.ordered import MICROS
from fathomry.plans.corpus import with_shards

MINUTE = 60 * MICROS
DAY = 24 * 60 * MINUTE
PORT = ["device", "port", "counter_name"]

# The label by its defining join: for every loan-month, all rows of the next twelve months.
FORWARD_SQL = """months AS (
  SELECT loan_id, year(monthly_reporting_period) * 12 + month(monthly_reporting_period) AS m,
    max(coalesce(current_loan_delinquency_status, -1)) AS s, min(coalesce(current_actual_upb, 999999999)) AS u, count(*) AS n
  FROM perf WHERE monthly_reporting_period IS NOT NULL GROUP BY 1, 2),
forward AS (
  SELECT a.loan_id, a.m, CAST(max(b.s) > 3 AS INT) + CAST(min(b.u) = 0 AS INT) AS delinquency_12, min(b.u) AS upb_12, any_value(a.n) AS copies
  FROM months a JOIN months b ON a.loan_id = b.loan_id AND b.m BETWEEN a.m AND a.m + 11 GROUP BY 1, 2)"""


@query(
    "w01_forward_12_month_label",
    f"WITH {S.PERF_CTE}, {FORWARD_SQL} SELECT loan_id, CAST(m AS INT) AS month_idx, delinquency_12, upb_12, copies FROM forward",
)
def _(spark, sf):
    return loans.forward_12_month(S.performance(spark, sf))


@query(
    "w02_counter_since_series_minimum",
    f"""WITH {S.PORTS_CTE} SELECT event_id, device, port, counter_name,
      counter - min(counter) OVER (PARTITION BY device, port, counter_name) AS counter FROM ports""",
)
def _(spark, sf):
    return series.since_series_minimum(S.ports(spark, sf).select("event_id", *PORT, "counter"), PORT)


@query(
    "w03_time_since_start",
    f"WITH {S.PORTS_CTE} SELECT event_id, t - (SELECT min(t) FROM ports) AS t FROM ports",
)
def _(spark, sf):
    return series.since_start(S.ports(spark, sf).select("event_id", "t"))


@query(
    "w04_sample_rate",
    f"""WITH {S.PORTS_CTE}, p AS (SELECT *, lag(t) OVER w AS t0, lag(counter) OVER w AS c0 FROM ports
      WINDOW w AS (PARTITION BY device, port, counter_name ORDER BY t))
    SELECT event_id, device, port, counter_name, t, (counter - c0) / (t - t0) * 4 * 8e-9 AS rate_gbps FROM p WHERE t0 IS NOT NULL""",
)
def _(spark, sf):
    ports = S.ports(spark, sf).select("event_id", *PORT, "t", "counter")
    return series.port_rate_gbps(ports, PORT).drop("counter")


@query(
    "w05_running_maximum",
    f"""WITH {S.PORTS_CTE} SELECT event_id, device, port, counter_name, max(rate_gbps) OVER (
      PARTITION BY device, port, counter_name ORDER BY t ROWS UNBOUNDED PRECEDING) AS max_rate FROM ports""",
)
def _(spark, sf):
    ports = S.ports(spark, sf).select("event_id", *PORT, "t", "rate_gbps")
    return series.running_max(ports, PORT, "t", "rate_gbps", "max_rate").drop("t", "rate_gbps")


@query(
    "w06_irate_at_samples",
    f"""WITH {S.EVENTS_CTE}, p AS (SELECT *, lag(t_us) OVER w AS t0, lag(counter) OVER w AS v0 FROM ev
      WINDOW w AS (PARTITION BY event_type ORDER BY t_us))
    SELECT event_id, event_type, t_us,
      (CASE WHEN counter < v0 THEN counter ELSE counter - v0 END) / ((t_us - t0) / 1e6) AS rate
    FROM p WHERE t_us - t0 <= 300000000""",
)
def _(spark, sf):
    ev = S.events(spark, sf).select("event_id", "event_type", "t_us", "counter")
    return series.counter_rate(
        ev, ["event_type"], "t_us", "counter", unit=1e6, lookback=5 * MINUTE, resets=True
    ).drop("counter")


# Per grid time the last two samples in the closed range, found by as-of joins.
@query(
    "w06_irate_on_step_grid",
    f"""WITH {S.EVENTS_CTE}, p AS (SELECT event_type, t_us, counter, lag(t_us) OVER w AS t0, lag(counter) OVER w AS v0 FROM ev
      WINDOW w AS (PARTITION BY event_type ORDER BY t_us)),
    grid AS (SELECT event_type, unnest(generate_series(min(t_us) // 60000000 * 60000000, max(t_us) + 360000000, 60000000)) AS step_t
      FROM ev GROUP BY 1)
    SELECT g.event_type, g.step_t,
      (CASE WHEN p.counter < p.v0 THEN p.counter ELSE p.counter - p.v0 END) / ((p.t_us - p.t0) / 1e6) AS irate
    FROM grid g ASOF JOIN p ON g.event_type = p.event_type AND g.step_t >= p.t_us
    WHERE p.t0 >= g.step_t - 300000000""",
)
def _(spark, sf):
    ev = S.events(spark, sf).select("event_type", "t_us", "counter")
    return series.irate_at_step(ev, ["event_type"], "t_us", "counter", MINUTE, 5 * MINUTE, 1e6)


@query(
    "a14_sum_of_irate_by_step",
    f"""WITH {S.EVENTS_CTE}, p AS (SELECT instance, event_type, t_us, counter, lag(t_us) OVER w AS t0, lag(counter) OVER w AS v0 FROM ev
      WINDOW w AS (PARTITION BY instance, event_type ORDER BY t_us)),
    grid AS (SELECT instance, event_type, unnest(generate_series(min(t_us) // 600000000 * 600000000, max(t_us) + 7800000000, 600000000)) AS step_t
      FROM ev GROUP BY 1, 2),
    r AS (SELECT g.instance, g.step_t, (CASE WHEN p.counter < p.v0 THEN p.counter ELSE p.counter - p.v0 END) / ((p.t_us - p.t0) / 1e6) AS irate
      FROM grid g ASOF JOIN p ON g.instance = p.instance AND g.event_type = p.event_type AND g.step_t >= p.t_us
      WHERE p.t0 >= g.step_t - 7200000000)
    SELECT instance, step_t, round(sum(irate), 9) AS total, count(*) AS series FROM r GROUP BY 1, 2""",
)
def _(spark, sf):
    ev = S.events(spark, sf).select("instance", "event_type", "t_us", "counter")
    rates = series.irate_at_step(ev, ["instance", "event_type"], "t_us", "counter", 10 * MINUTE, 120 * MINUTE, 1e6)
    return rates.groupBy("instance", "step_t").agg(F.round(F.sum("irate"), 9).alias("total"), F.count(F.lit(1)).alias("series"))


@query(
    "w07_average_over_2_minutes",
    f"""WITH {S.EVENTS_CTE} SELECT event_id, avg(cents) OVER (PARTITION BY event_type ORDER BY t_us
      RANGE BETWEEN 120000000 PRECEDING AND CURRENT ROW) AS average FROM ev""",
)
def _(spark, sf):
    ev = S.events(spark, sf).select("event_id", "event_type", "t_us", "cents")
    return series.avg_over_time(ev, ["event_type"], "t_us", "cents", 2 * MINUTE, "average").select("event_id", "average")


@query(
    "w07_average_on_step_grid",
    f"""WITH {S.EVENTS_CTE}, grid AS (SELECT event_type, unnest(generate_series(
      min(t_us) // 60000000 * 60000000, max(t_us) + 360000000, 60000000)) AS step_t FROM ev GROUP BY 1),
    s AS (SELECT g.event_type, g.step_t, avg(e.cents) AS average FROM grid g JOIN ev e ON e.event_type = g.event_type
      AND e.t_us >= g.step_t - 300000000 AND e.t_us <= g.step_t GROUP BY 1, 2)
    SELECT step_t, round(sum(average), 6) AS total, round(avg(average), 6) AS average, count(*) AS series FROM s GROUP BY 1""",
)
def _(spark, sf):
    ev = S.events(spark, sf).select("event_type", "t_us", "cents")
    steps = series.avg_at_step(ev, ["event_type"], "t_us", "cents", MINUTE, 5 * MINUTE)
    found = series.over_series(steps, "average")
    return found.select("step_t", F.round("total", 6).alias("total"), F.round("average", 6).alias("average"), "series")


@query(
    "a14_value_at_step_over_series",
    f"""WITH {S.EVENTS_CTE}, grid AS (SELECT instance, event_type, unnest(generate_series(
      min(t_us) // 600000000 * 600000000, max(t_us) + 7800000000, 600000000)) AS step_t FROM ev GROUP BY 1, 2),
    v AS (SELECT g.step_t, e.cents FROM grid g ASOF JOIN ev e ON g.instance = e.instance AND g.event_type = e.event_type AND g.step_t >= e.t_us
      WHERE e.t_us >= g.step_t - 7200000000)
    SELECT step_t, sum(cents) AS total, avg(cents) AS average, count(*) AS series FROM v GROUP BY 1""",
)
def _(spark, sf):
    ev = S.events(spark, sf).select("instance", "event_type", "t_us", "cents")
    steps = series.sample_at_step(ev, ["instance", "event_type"], "t_us", "cents", 10 * MINUTE, 120 * MINUTE)
    return series.over_series(steps, "cents")


@query(
    "w08_traffic_per_bucket",
    f"""WITH {S.EVENTS_CTE},
    b AS (SELECT instance, t_us // 600000000 * 600000000 AS bucket_t, max(counter) AS rx, max(sent) AS tx FROM ev GROUP BY 1, 2),
    d AS (SELECT bucket_t, (rx - lag(rx) OVER w) / ((bucket_t - lag(bucket_t) OVER w) / 1e6) AS rx,
      (tx - lag(tx) OVER w) / ((bucket_t - lag(bucket_t) OVER w) / 1e6) AS tx FROM b WINDOW w AS (PARTITION BY instance ORDER BY bucket_t))
    SELECT bucket_t, round(sum(CASE WHEN rx > 0 THEN rx WHEN rx <= 0 THEN 0 END), 9) AS inbound,
      round(sum(CASE WHEN tx > 0 THEN -tx END), 9) AS outbound FROM d GROUP BY 1""",
)
def _(spark, sf):
    ev = S.events(spark, sf)
    out = series.traffic_by_bucket(ev, ["instance"], "t_us", "counter", "sent", 10 * MINUTE, 1e6)
    return out.select("bucket_t", F.round("inbound", 9).alias("inbound"), F.round("outbound", 9).alias("outbound"))


@query(
    "w09_shuffled_shards",
    f"""WITH {S.IMAGES_CTE}, r AS (SELECT filename, synset, row_number() OVER (ORDER BY md5(filename || ':12345'), filename) - 1 AS position,
      count(*) OVER () AS total FROM images)
    SELECT filename, synset, position, CAST(s AS INT) AS shard FROM r, range(16) t(s)
    WHERE position >= s * total // 16 AND position < (s + 1) * total // 16""",
)
def _(spark, sf):
    return with_shards(S.images(spark, sf).select("filename", "synset"), "filename", 16)


LINES_CTE = f"""lines AS (SELECT doc_id, unnest(range(len(string_split(text, {S.NL})))) AS line_no,
  unnest(string_split(text, {S.NL})) AS line FROM documents)"""


def _lines(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


@query(
    "w10_matching_lines_and_next",
    f"""WITH {LINES_CTE}, m AS (SELECT *, regexp_matches(line, 'license|License|the th') AS matched FROM lines),
    p AS (SELECT *, lag(matched) OVER (PARTITION BY doc_id ORDER BY line_no) AS after_match FROM m)
    SELECT doc_id, line_no, line, matched FROM p WHERE matched OR after_match""",
)
def _(spark, sf):
    return series.match_with_following(_lines(spark, sf), ["doc_id"], "line_no", "line", "license|License|the th")


@query(
    "w11_cumulative_bytes",
    f"""WITH {S.STEPS_CTE}, warm AS (SELECT *, (SELECT min(t_us) FROM steps) + 86400000000 AS start FROM steps)
    SELECT rank, step, sum(batch_size) OVER r AS rank_records, sum(num_bytes) OVER r AS rank_bytes,
      sum(batch_size) OVER a AS total_records, sum(num_bytes) OVER a AS total_bytes,
      CAST(sum(num_bytes) OVER r AS DOUBLE) / nullif((t_us - start) / 1e6, 0) / 1e6 AS rank_MB_per_sec,
      CAST(sum(num_bytes) OVER a AS DOUBLE) / nullif((t_us - start) / 1e6, 0) / 1e6 AS total_MB_per_sec
    FROM warm WHERE t_us >= start
    WINDOW r AS (PARTITION BY rank ORDER BY t_us, step ROWS UNBOUNDED PRECEDING), a AS (ORDER BY t_us, rank, step ROWS UNBOUNDED PRECEDING)""".replace(
        "sum(batch_size) OVER r", "CAST(sum(batch_size) OVER r AS BIGINT)"
    ).replace("sum(num_bytes) OVER r AS rank_bytes", "CAST(sum(num_bytes) OVER r AS BIGINT) AS rank_bytes").replace(
        "sum(batch_size) OVER a", "CAST(sum(batch_size) OVER a AS BIGINT)"
    ).replace("sum(num_bytes) OVER a AS total_bytes", "CAST(sum(num_bytes) OVER a AS BIGINT) AS total_bytes"),
)
def _(spark, sf):
    steps = S.steps(spark, sf).select("rank", "step", "t_us", "batch_size", "num_bytes")
    return series.cumulative_steps(steps, "t_us", DAY, unit=1e6).drop("t_us", "batch_size", "num_bytes")


RUN_MEANS = f"""{S.TRAINING_CTE}, means AS (SELECT model, np, coalesce(storage_type, '0') AS storage_type,
  avg(num_batches) AS num_batches_mean FROM runs GROUP BY 1, 2, 3),
base AS (SELECT model, np, num_batches_mean AS b FROM means WHERE storage_type = 'na')"""


def _run_means(spark, sf):
    from fathomry.operators.selection import fill_by_type

    runs = fill_by_type(S.training_runs(spark, sf))
    return report.stats_by(runs, ["model", "np", "storage_type"], {"num_batches": ["mean"]})


@query(
    "w12_percent_versus_baseline",
    f"""WITH {RUN_MEANS} SELECT model, np, storage_type, num_batches_mean,
      (num_batches_mean / b - 1) * 100 AS num_batches_mean_percent FROM means LEFT JOIN base USING (model, np)""",
)
def _(spark, sf):
    return report.versus_baseline(_run_means(spark, sf), ["model", "np"], {"storage_type": "na"}, "num_batches_mean")


@query(
    "w13_ratio_to_baseline",
    f"""WITH {RUN_MEANS} SELECT model, np, storage_type, num_batches_mean,
      num_batches_mean / b AS num_batches_mean_ratio FROM means LEFT JOIN base USING (model, np)""",
)
def _(spark, sf):
    return report.versus_baseline(_run_means(spark, sf), ["model", "np"], {"storage_type": "na"}, "num_batches_mean", how="ratio")


@query(
    "w14_phase_timeline",
    """SELECT o_orderkey, o_orderdate AS bwa_begin, o_orderdate + to_seconds(o_orderkey % 90) AS bwa_end,
      o_orderdate + to_seconds(o_orderkey % 90 + o_orderkey % 7 * 60) AS writing_end,
      o_orderdate + to_seconds(o_orderkey % 90 + o_orderkey % 7 * 60) AS caller_begin FROM orders""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    runs = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("bwa_begin"),
        (k % 90).cast("double").alias("bwa_sec"), (k % 90 + k % 7 * 60).cast("double").alias("to_writing_sec"),
    )
    done = plus_seconds(F.col("bwa_begin"), F.col("to_writing_sec"))
    return runs.select(
        "o_orderkey", "bwa_begin", plus_seconds(F.col("bwa_begin"), F.col("bwa_sec")).alias("bwa_end"),
        done.alias("writing_end"), done.alias("caller_begin"),
    )


@query(
    "w15_value_on_step_grid",
    f"""WITH {S.EVENTS_CTE}, grid AS (SELECT event_type, unnest(generate_series(
      min(t_us) // 60000000 * 60000000, max(t_us) + 360000000, 60000000)) AS step_t FROM ev GROUP BY 1)
    SELECT g.event_type, g.step_t, e.cents FROM grid g ASOF JOIN ev e ON g.event_type = e.event_type AND g.step_t >= e.t_us
    WHERE e.t_us >= g.step_t - 300000000""",
)
def _(spark, sf):
    ev = S.events(spark, sf).select("event_type", "t_us", "cents")
    return series.sample_at_step(ev, ["event_type"], "t_us", "cents", MINUTE, 5 * MINUTE)


@query(
    "w16_slow_steps",
    f"""WITH {S.STEPS_CTE}, f AS (SELECT rank, step, t_us >= (SELECT min(t_us) FROM steps) + 86400000000 AS warm, latency_sec, sync_latency_sec FROM steps)
    SELECT rank, step, latency_sec, sync_latency_sec, (warm OR step >= 1) AND latency_sec > 4 AS slow_step, warm AND sync_latency_sec > 30 AS slow_sync
    FROM f WHERE ((warm OR step >= 1) AND latency_sec > 4) OR (warm AND sync_latency_sec > 30)""",
)
def _(spark, sf):
    steps = S.steps(spark, sf).select("rank", "step", "t_us", "latency_sec", "sync_latency_sec")
    return series.step_alarms(steps, "t_us", DAY).drop("t_us")


@query(
    "w06_idle_share_by_group",
    f"""WITH {S.EVENTS_CTE}, p AS (SELECT *, lag(t_us) OVER w AS t0, lag(counter) OVER w AS v0 FROM ev
      WHERE grp IN ('gpu', 'mgmt') WINDOW w AS (PARTITION BY instance, grp ORDER BY t_us)),
    r AS (SELECT instance, grp, t_us // 3600000000 * 3600000000 AS step_t,
      (CASE WHEN counter < v0 THEN counter ELSE counter - v0 END) / ((t_us - t0) / 1e6) AS rate FROM p WHERE t_us - t0 <= 21600000000)
    SELECT grp, instance, step_t, round(1 - avg(rate), 9) AS busy FROM r GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    ev = S.events(spark, sf).filter(F.col("grp").rlike("^(?:gpu|mgmt)$")).select("instance", "grp", "t_us", "counter")
    rated = series.counter_rate(ev, ["instance", "grp"], "t_us", "counter", 1e6, lookback=360 * MINUTE, resets=True)
    hour = 60 * MINUTE
    return rated.groupBy("grp", "instance", (F.floor(F.col("t_us") / hour) * hour).alias("step_t")).agg(
        F.round(1.0 - F.avg("rate"), 9).alias("busy")
    )
