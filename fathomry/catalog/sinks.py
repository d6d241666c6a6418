"""Sinks and data layout (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomry.catalog import standins as S
from fathomry.catalog.base import query, table
from fathomry.operators import report
from fathomry.operators.lookups import spread_join
from fathomry.plans import corpus
from fathomry.plans.corpus import round_robin, with_shards
from fathomry.session import fresh_dir
from fathomry.sources import readers, writers

ITEM_SUMS = "SELECT l_returnflag, count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS checksum FROM lineitem GROUP BY 1"


def _item_sums(items):
    return items.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("checksum"))


@query("k01_orc_with_stripes", ITEM_SUMS)
def _(spark, sf):
    path = writers.write_orc(table(spark, sf, "lineitem"), fresh_dir(spark, "orc"), compression="snappy", stripe_mib=64)
    return _item_sums(readers.read_columnar(spark, path))


@query("k02_parquet_snappy", ITEM_SUMS)
def _(spark, sf):
    path = writers.write_parquet(table(spark, sf, "lineitem"), fresh_dir(spark, "parquet"))
    return _item_sums(readers.read_columnar(spark, path, "parquet"))


@query("k03_replace_output", ITEM_SUMS)
def _(spark, sf):
    path = fresh_dir(spark, "replaced")
    for _ in range(2):
        writers.write_orc(table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey"), path)
    return _item_sums(readers.read_columnar(spark, path))


@query("k04_one_file_per_partition", "SELECT CAST(6 AS BIGINT) AS files, count(*) AS rows FROM orders")
def _(spark, sf):
    path = writers.write_orc(table(spark, sf, "orders"), fresh_dir(spark, "parts"), partitions=6)
    files = readers.list_files(spark, path, "*.orc").agg(F.count(F.lit(1)).alias("files"))
    rows = readers.read_columnar(spark, path).agg(F.count(F.lit(1)).alias("rows")).scalar()
    return files.withColumn("rows", rows)


@query(
    "k05_parameter_path",
    "SELECT p_partkey, printf('perf-%.2fx-%dp-%dMiB-snappy.orc', p_size / 4.0, p_partkey % 96, 64 * (1 + p_size % 32)) AS name FROM part",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    name = writers.dataset_name(
        F.lit("perf"), F.col("p_size").cast("double") / 4, F.col("p_partkey") % 96, 64 * (1 + F.col("p_size") % 32), F.lit("snappy"), F.lit("orc")
    )
    return part.select("p_partkey", name.alias("name"))


@query("k06_csv_export", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(spark, sf):
    path = writers.write_csv(table(spark, sf, "orders"), fresh_dir(spark, "export"), ["o_orderkey", "o_totalprice", "o_orderstatus"])
    return readers.read_dimension(spark, path, "o_orderkey bigint, o_totalprice double, o_orderstatus string")[0]


@query(
    "k07_pivot_report_export",
    f"""WITH {S.TRAINING_CTE} SELECT model, avg(num_batches) FILTER (WHERE np = 16) AS num_batches_mean_16,
      avg(num_batches) FILTER (WHERE np = 32) AS num_batches_mean_32, avg(num_batches) FILTER (WHERE np = 48) AS num_batches_mean_48 FROM runs GROUP BY 1""",
)
def _(spark, sf):
    wide = report.pivot_stats(S.training_runs(spark, sf), ["model"], ["np"], {"num_batches": ["mean"]}, [16, 32, 48])
    path = writers.write_csv(wide, fresh_dir(spark, "report"))
    return readers.read_dimension(
        spark, path, "model string, num_batches_mean_16 double, num_batches_mean_32 double, num_batches_mean_48 double"
    )[0]


@query(
    "k08_sharded_corpus",
    f"""WITH {S.IMAGES_CTE} SELECT CAST(s AS INT) AS shard, (s + 1) * n // 8 - s * n // 8 AS records, s * n // 8 AS first_position
    FROM (SELECT count(*) AS n FROM images), range(8) t(s)""",
)
def _(spark, sf):
    placed = with_shards(S.images(spark, sf), "filename", 8)
    path = writers.write_shards(placed, fresh_dir(spark, "shards"), 8)
    return readers.read_corpus(spark, path).groupBy("shard").agg(
        F.count(F.lit(1)).alias("records"), F.min("position").alias("first_position")
    )


@query("k09_label_folders", f"WITH {S.IMAGES_CTE} SELECT synset, filename, content FROM images")
def _(spark, sf):
    images = S.images(spark, sf).select("synset", "filename", "content")
    return readers.read_corpus(spark, writers.write_by_folder(images, fresh_dir(spark, "folders"), "synset"))


@query(
    "k10_replicated_dataset",
    """SELECT p_partkey, CAST(c AS INT) AS copy, CAST(c % 16 + 1 AS INT) AS target, printf('train-%05d-copy-%05d', p_partkey, c) AS name
    FROM part, range(20) t(c)""",
)
def _(spark, sf):
    copies = writers.replicate(table(spark, sf, "part").select("p_partkey"), 20)
    return copies.withColumn("name", F.format_string("train-%05d-copy-%05d", "p_partkey", "copy"))


@query(
    "k11_append_result_records",
    f"WITH {S.TRAINING_CTE} SELECT test_uuid, np, error FROM runs",
)
def _(spark, sf):
    runs, path = S.training_runs(spark, sf), fresh_dir(spark, "records")
    for np in (16, 32, 48):
        writers.append_results(runs.filter(F.col("np") == np), path)
    good, _ = readers.read_results(spark, path, list_files=False)
    return good.select("test_uuid", "np", "error")


@query("k12_repartition", ITEM_SUMS)
def _(spark, sf):
    return _item_sums(table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey").repartition(12))


@query("k13_bootstrap_scale", "SELECT TRUE AS all_known, TRUE AS about_six_times, TRUE AS some_repeat")
def _(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    drawn = writers.bootstrap(items, 6.0).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    known = items.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("m"))
    both = spread_join(known, drawn, ["l_orderkey", "l_linenumber"], "full")
    # The number drawn has the variance of its mean; six standard deviations are allowed.
    total, wanted = F.coalesce(F.sum("n"), F.lit(0)), 6.0 * F.sum("m")
    return both.agg(
        (F.count_if(F.col("m").isNull()) == 0).alias("all_known"),
        (F.abs(total - wanted) <= 6 * F.sqrt(wanted)).alias("about_six_times"),
        (F.count_if(F.col("n") > F.col("m")) > 0).alias("some_repeat"),
    )


@query("k14_timed_persisted_runs", "SELECT CAST(i AS INT) AS run, TRUE AS took_time, (SELECT count(*) FROM lineitem) AS rows FROM range(3) t(i)")
def _(spark, sf):
    scan = table(spark, sf, "lineitem").withColumnsRenamed({"l_returnflag": "servicer", "l_discount": "interest_rate"})
    seconds = writers.timed_runs(scan.select("servicer", "interest_rate"), report.max_rate_by_servicer)
    timed = spark.createDataFrame(list(enumerate(seconds)), "run int, compute_sec double")
    return timed.select("run", (F.col("compute_sec") > 0).alias("took_time"), F.lit(scan.count()).cast("bigint").alias("rows"))


@query(
    "k15_round_robin_files",
    f"""WITH {S.IMAGES_CTE} SELECT filename, row_number() OVER (ORDER BY filename) - 1 AS position,
      CAST((row_number() OVER (ORDER BY filename) - 1) % 7 AS INT) AS worker FROM images""",
)
def _(spark, sf):
    return round_robin(S.images(spark, sf).select("filename"), ["filename"], 7)


@query(
    "k08_built_corpus",
    f"""WITH {S.SCALED_CTE}, {S.LABELS_CTE}, {S.TEXTS_CTE}, r AS (SELECT filename, synset, label, content, height, width,
      row_number() OVER (ORDER BY md5(filename || ':12345'), filename) - 1 AS position, count(*) OVER () AS total
      FROM images JOIN labels USING (synset)),
    n AS (SELECT filename, count(*) AS n FROM scaled WHERE xmin < xmax AND ymin < ymax GROUP BY 1)
    SELECT filename, synset, label, text, CAST(s AS INT) AS shard, position, coalesce(n, 0) AS n_boxes, CAST(strlen(content) AS INT) AS num_bytes,
      'RGB' AS colorspace, 3::BIGINT AS channels, height, width
    FROM r JOIN texts USING (synset) LEFT JOIN n USING (filename), range(16) t(s)
    WHERE position >= s * total // 16 AND position < (s + 1) * total // 16""",
)
def _(spark, sf):
    images = S.images(spark, sf).withColumn("encoded", F.col("content").cast("binary")).drop("content", "p_partkey")
    boxes = S.box_series(spark, sf).filter("xmin < xmax AND ymin < ymax")
    built = corpus.build_corpus(images, S.label_list(spark, sf), S.synset_texts(spark, sf), boxes, 16)
    return built.select(
        "filename", "synset", "label", "text", "shard", "position", F.size("bbox_label").cast("bigint").alias("n_boxes"),
        F.octet_length("encoded").alias("num_bytes"), "colorspace", "channels", "height", "width",
    )
