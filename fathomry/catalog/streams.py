"""Streaming (T): each feed reads the table as a stream and is checked against its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomry.catalog import standins as S
from fathomry.catalog.base import query, table
from fathomry.operators.report import first_n_per_group
from fathomry.session import fresh_dir
from fathomry.streaming import feeds


def event_stream(spark, sf, items=S.EVENTS, extra=()):
    """The events table as a stream. The path is a glob, so one file and a folder of files both work."""
    schema = table(spark, sf, "events").schema
    raw = feeds.file_stream(spark, f"{sf}/events.parque[t]", schema)
    # Watermarks need a zoned timestamp.
    return raw.selectExpr(*S.columns(items), "CAST(ts AS TIMESTAMP) AS at", *extra)


@query(
    "t01_counter_feed_rates",
    f"""WITH {S.PORTS_CTE}, p AS (SELECT *, lag(t) OVER w AS t0, lag(counter) OVER w AS c0 FROM ports
      WINDOW w AS (PARTITION BY device, port, counter_name ORDER BY t))
    SELECT event_id, device, port, counter_name, t, (counter - c0) / (t - t0) AS rate FROM p WHERE t0 IS NOT NULL""",
)
def _(spark, sf):
    keys = ["device", "port", "counter_name"]
    stream = event_stream(spark, sf, S.PORTS).select("event_id", *keys, "t", "counter")
    path = feeds.counter_feed(stream, fresh_dir(spark, "feed"), keys, "t", "counter", unit=1.0)
    return spark.read.parquet(path).drop("batch", "counter")


@query(
    "t02_utilisation_per_window",
    f"WITH {S.EVENTS_CTE} SELECT instance, time_bucket(INTERVAL '1 hour', ts) AS window_start, avg(cents) AS average FROM ev GROUP BY 1, 2",
)
def _(spark, sf):
    totals = feeds.windowed(event_stream(spark, sf), "at", "1 hour", ["instance"], [F.avg("cents").alias("average")])
    path = feeds.run_to_files(totals, fresh_dir(spark, "feed"), mode="update")
    return feeds.latest_per_key(spark, path, ["instance", "window_start"])


@query(
    "t03_bytes_per_report_period",
    f"""WITH {S.STEPS_CTE} SELECT time_bucket(INTERVAL '2 seconds', ts) AS window_start, CAST(sum(num_bytes) AS BIGINT) AS num_bytes,
      count(*) AS steps FROM steps GROUP BY 1""",
)
def _(spark, sf):
    totals = feeds.windowed(
        event_stream(spark, sf, S.STEPS), "at", "2 seconds", [],
        [F.sum("num_bytes").alias("num_bytes"), F.count(F.lit(1)).alias("steps")],
    )
    path = feeds.run_to_files(totals, fresh_dir(spark, "feed"), mode="update")
    return feeds.latest_per_key(spark, path, ["window_start"])


@query(
    "t04_totals_after_warm_up",
    f"""WITH {S.STEPS_CTE} SELECT rank, CAST(sum(batch_size) AS BIGINT) AS records, CAST(sum(num_bytes) AS BIGINT) AS num_bytes
    FROM steps WHERE ts >= (SELECT min(ts) FROM steps) + INTERVAL 1 DAY GROUP BY 1""",
)
def _(spark, sf):
    start = table(spark, sf, "events").agg(F.min("ts")).first()[0]
    warm = feeds.after_warm_up(event_stream(spark, sf, S.STEPS), "ts", start, 86_400.0)
    totals = warm.groupBy("rank").agg(F.sum("batch_size").alias("records"), F.sum("num_bytes").alias("num_bytes"))
    path = feeds.run_to_files(totals, fresh_dir(spark, "feed"), mode="update")
    return feeds.latest_per_key(spark, path, ["rank"])


@query(
    "t05_rolling_2_minute_average",
    f"""WITH {S.EVENTS_CTE} SELECT time_bucket(INTERVAL '10 seconds', ts) - to_seconds(10 * i) AS window_start, avg(cents) AS average
    FROM ev, range(12) t(i) GROUP BY 1""",
)
def _(spark, sf):
    rolled = feeds.windowed(event_stream(spark, sf), "at", "2 minutes", [], [F.avg("cents").alias("average")], slide="10 seconds")
    path = feeds.run_to_files(rolled, fresh_dir(spark, "feed"), mode="update")
    return feeds.latest_per_key(spark, path, ["window_start"])


@query(
    "t06_top_20_per_window",
    f"""WITH {S.EVENTS_CTE}, w AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, user_id, avg(cents) AS cpu, avg(sent) AS memory FROM ev GROUP BY 1, 2)
    SELECT 'cpu' AS ranked_by, * FROM w QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY cpu DESC, user_id) <= 20
    UNION ALL SELECT 'memory', * FROM w QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY memory DESC, user_id) <= 20""",
)
def _(spark, sf):
    values = {"cpu": "cents", "memory": "sent"}
    path = feeds.windowed_load(event_stream(spark, sf), fresh_dir(spark, "feed"), "at", "6 hours", ["user_id"], values)
    loads = feeds.latest_per_key(spark, path, ["window_start", "user_id"])
    top = [first_n_per_group(loads, ["window_start"], [F.desc(v), "user_id"], 20).withColumn("ranked_by", F.lit(v)) for v in values]
    return top[0].unionByName(top[1])


SLICES = 4
HOUR_US = 3_600_000_000


def arriving(spark, df, at, jitter):
    """Lands the rows in slices, in the order of the number ``at`` and up to ``jitter`` late. Yields after each slice: the
    glob of all that has landed, and whether it was the last."""
    folder = fresh_dir(spark, "landed")
    arrival = F.col(at) + F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000 * jitter
    first, last = df.agg(F.min(at), F.max(at)).first()
    size = ((last or 0) + jitter - (first or 0) + 1) / SLICES
    part = F.floor((arrival - F.lit(first or 0)) / size).cast("int")
    for i in range(SLICES):
        df.filter(part == i).write.parquet(f"{folder}/slice={i}")
        yield f"{folder}/*", i == SLICES - 1


@query(
    "t01_counter_feed_out_of_order",
    f"""WITH {S.PORTS_CTE}, p AS (SELECT *, lag(t) OVER w AS t0, lag(counter) OVER w AS c0 FROM ports
      WINDOW w AS (PARTITION BY device, port, counter_name ORDER BY t))
    SELECT event_id, device, port, counter_name, t, (counter - c0) / (t - t0) AS rate FROM p WHERE t0 IS NOT NULL""",
)
def _(spark, sf):
    keys = ["device", "port", "counter_name"]
    out, day = fresh_dir(spark, "feed"), 86_400.0
    ports = S.ports(spark, sf).select("event_id", *keys, "t", "counter")
    for path, end in arriving(spark, ports, "t", day):
        stream = feeds.file_stream(spark, path, ports.schema)
        rows = feeds.counter_feed(stream, out, keys, "t", "counter", unit=1.0, delay=day, finish=end)
    return spark.read.parquet(rows).drop("batch", "counter")


@query(
    "s22_landed_metric_samples",
    f"WITH {S.EVENTS_CTE} SELECT event_type AS metric, instance, count(*) AS samples, sum(cents) AS total FROM ev GROUP BY 1, 2",
)
def _(spark, sf):
    out, samples, keys = fresh_dir(spark, "feed"), S.metrics(spark, sf), ["metric", "instance"]
    for path, _ in arriving(spark, samples, "t_us", HOUR_US):
        stream = feeds.file_stream(spark, path, samples.schema).withColumn("instance", F.col("labels")["instance"])
        totals = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.sum("value").alias("total"))
        rows = feeds.run_to_files(totals, out, mode="update")
    return feeds.latest_per_key(spark, rows, keys)


def closing(spark, sf):
    """The events as they arrive, up to an hour late, and behind them a mark a day later that closes all windows."""
    ev = S.events(spark, sf).select("event_id", "user_id", "instance", "cents", "sent", F.col("ts").cast("timestamp").alias("at"), "t_us")
    mark = ev.agg((F.max("at") + F.expr("INTERVAL 1 DAY")).alias("at")).withColumn("t_us", F.unix_micros("at"))
    return ev.unionByName(mark, allowMissingColumns=True)


@query(
    "t02_final_utilisation_per_window",
    f"WITH {S.EVENTS_CTE} SELECT instance, time_bucket(INTERVAL '1 hour', ts) AS window_start, avg(cents) AS average FROM ev GROUP BY 1, 2",
)
def _(spark, sf):
    out, landed = fresh_dir(spark, "feed"), closing(spark, sf)
    for path, _ in arriving(spark, landed, "t_us", HOUR_US):
        stream = feeds.file_stream(spark, path, landed.schema)
        totals = feeds.windowed(stream, "at", "1 hour", ["instance"], [F.avg("cents").alias("average")], delay="2 hours")
        rows, _ = feeds.final_windows(totals, out)
    return spark.read.parquet(rows).drop("batch")


@query(
    "t06_top_20_as_windows_close",
    f"""WITH {S.EVENTS_CTE}, w AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, user_id, avg(cents) AS cpu, avg(sent) AS memory FROM ev GROUP BY 1, 2)
    SELECT 'cpu' AS ranked_by, * FROM w QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY cpu DESC, user_id) <= 20
    UNION ALL SELECT 'memory', * FROM w QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY memory DESC, user_id) <= 20""",
)
def _(spark, sf):
    def ranked(batch, number):
        # All of a window is in the micro-batch that closes it.
        top = [first_n_per_group(batch, ["window_start"], [F.desc(v), "user_id"], 20).withColumn("ranked_by", F.lit(v)) for v in ("cpu", "memory")]
        return top[0].unionByName(top[1])

    out, landed = fresh_dir(spark, "feed"), closing(spark, sf)
    for path, _ in arriving(spark, landed, "t_us", HOUR_US):
        stream = feeds.file_stream(spark, path, landed.schema)
        totals = feeds.windowed(stream, "at", "6 hours", ["user_id"], [F.avg("cents").alias("cpu"), F.avg("sent").alias("memory")], delay="2 hours")
        rows, _ = feeds.final_windows(totals, out, each=ranked)
    return spark.read.parquet(rows).drop("batch")


@query(
    "t04_totals_after_own_start",
    f"""WITH {S.STEPS_CTE} SELECT rank, count(*) AS "rows", CAST(sum(batch_size) AS BIGINT) AS batch_size, CAST(sum(num_bytes) AS BIGINT) AS num_bytes
    FROM steps WHERE ts >= (SELECT min(ts) FROM steps) + INTERVAL 1 DAY GROUP BY 1""",
)
def _(spark, sf):
    out = fresh_dir(spark, "feed")
    steps = S.steps(spark, sf).withColumn("event_id", F.col("t_us"))
    for path, _ in arriving(spark, steps, "t_us", 24 * HOUR_US):
        rows = feeds.totals_after_warm_up(feeds.file_stream(spark, path, steps.schema), out, "ts", 86_400.0, ["rank"], ["batch_size", "num_bytes"])
    return feeds.last_batch(spark, rows)


MOUNT = "CASE WHEN user_id % 4 = 0 THEN '/proc/fs' WHEN user_id % 4 = 1 THEN '/processed' WHEN user_id % 4 = 2 THEN '/dev' ELSE '/mnt/data' END"


@query(
    "t07_dropped_mount_points",
    f"""SELECT event_id, mount FROM (SELECT event_id, {MOUNT} AS mount FROM events)
    WHERE NOT regexp_matches(mount, '{feeds.DROPPED_MOUNTS}')""",
)
def _(spark, sf):
    stream = event_stream(spark, sf, extra=[f"{MOUNT} AS mount"]).select("event_id", "mount")
    kept = stream.filter(feeds.unmatched("mount", feeds.DROPPED_MOUNTS))
    return spark.read.parquet(feeds.run_to_files(kept, fresh_dir(spark, "feed"))).drop("batch")


@query("t08_events_without_repeats", "SELECT event_id, user_id, CAST(round(value * 100) AS DOUBLE) AS cents FROM events")
def _(spark, sf):
    twice = event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    once = feeds.first_seen(twice.select("event_id", "user_id", "cents", "at"), "at", ["event_id"])
    return spark.read.parquet(feeds.run_to_files(once, fresh_dir(spark, "feed"))).drop("batch", "at")
