"""Scalar functions (X) and whole-record cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomry.catalog import standins as S
from fathomry.catalog.base import query, table
from fathomry.functions import measures as M
from fathomry.functions import text as X
from fathomry.operators import boxes as B
from fathomry.operators import series
from fathomry.operators.loans import month_index
from fathomry.plans import corpus, results


def key():
    return F.col("o_orderkey")


@query("x01_year_month", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))


@query(
    "x02_month_index",
    """SELECT o_orderkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS month_idx,
      CAST(floor((year(o_orderdate) * 12 + month(o_orderdate) - 24000 - 5) / 12.0) AS BIGINT) AS slot FROM orders""",
)
def _(spark, sf):
    m = month_index("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", m.alias("month_idx"), F.floor((m - 24000 - 5) / 12).alias("slot"))


@query(
    "x03_parse_utc",
    f"WITH {S.TRAINING_CTE} SELECT test_uuid, CAST(replace(replace(utc_begin, 'T', ' '), 'Z', '') AS TIMESTAMP) AS utc_begin FROM runs",
)
def _(spark, sf):
    return S.training_runs(spark, sf).select("test_uuid", results.utc("utc_begin").alias("utc_begin"))


@query("x04_plus_seconds", "SELECT o_orderkey, o_orderdate + to_microseconds(o_orderkey % 4000 * 250000) AS utc_end FROM orders")
def _(spark, sf):
    seconds = (key() % 4000).cast("double") / 4
    return table(spark, sf, "orders").select("o_orderkey", M.plus_seconds(F.col("o_orderdate"), seconds).alias("utc_end"))


@query(
    "x05_last_rate_in_log",
    f"""WITH {S.TRAINING_CTE} SELECT test_uuid, TRY_CAST(list_last(regexp_extract_all(output, '(?m)^total images/sec: ([.0-9]+)$', 1)) AS DOUBLE) AS images_per_sec FROM runs""",
)
def _(spark, sf):
    return S.training_runs(spark, sf).select("test_uuid", X.last_number("output").alias("images_per_sec"))


@query(
    "x06_first_number_in_log",
    f"WITH {S.TRAINING_CTE} SELECT test_uuid, TRY_CAST(nullif(regexp_extract(output, 'images/sec: ([0-9.]*)', 1), '') AS DOUBLE) AS first_rate FROM runs",
)
def _(spark, sf):
    return S.training_runs(spark, sf).select("test_uuid", X.first_number("output", "images/sec: ([0-9.]*)").alias("first_rate"))


@query(
    "x07_json_in_log",
    f"""WITH {S.TRAINING_CTE}, j AS (SELECT test_uuid, nullif(regexp_extract(output, 'FINAL RESULTS JSON: (.*)', 1), '') AS doc FROM runs)
    SELECT test_uuid, CAST(doc->>'$.sec' AS DOUBLE) AS sec, doc->>'$.host' AS host FROM j""",
)
def _(spark, sf):
    doc = X.logged_json("output", "sec double, host string")
    return S.training_runs(spark, sf).select("test_uuid", doc.alias("doc")).select("test_uuid", "doc.sec", "doc.host")


@query("x08_percent_text", "SELECT event_id, CAST(event_id % 101 AS DOUBLE) AS gpu_util_pct FROM events")
def _(spark, sf):
    util = F.concat((F.col("event_id") % 101).cast("string"), F.lit(" %"))
    return table(spark, sf, "events").select("event_id", X.percent_number(util).alias("gpu_util_pct"))


@query(
    "x09_contains_any",
    "SELECT page_id, contains(url, '.org') OR contains(url, '/de/') AS hit FROM pages",
)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.contains_any("url", [".org", "/de/"]).alias("hit"))


DIRS = {
    "input_dir": "CASE WHEN o_orderkey % 3 = 0 THEN '/mnt/nas/fq' WHEN o_orderkey % 3 = 1 THEN '/raid/fq' ELSE '/data' END",
    "temp_dir": "CASE WHEN o_orderkey % 4 = 0 THEN '/mnt/nas/tmp' WHEN o_orderkey % 4 = 1 THEN '/tmp/x' ELSE '/raid' END",
}


@query(
    "x10_data_layout",
    f"""WITH d AS (SELECT o_orderkey, {DIRS['input_dir']} AS i, {DIRS['temp_dir']} AS t FROM orders) SELECT o_orderkey,
      CASE WHEN contains(i, '/mnt/nas') AND (contains(t, '/raid') OR contains(t, '/tmp')) AND NOT t LIKE '/mnt/nas%' THEN 'mixed'
        WHEN contains(i, '/mnt/nas') AND t = '/mnt/nas/tmp' THEN 'mixed'
        WHEN contains(i, '/raid') AND (contains(t, '/raid') OR contains(t, '/tmp')) THEN 'all_local' END AS data_layout FROM d""",
)
def _(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", *[F.expr(e).alias(n) for n, e in DIRS.items()])
    layout = M.data_layout(F.col("input_dir"), F.col("temp_dir"), ["/mnt/nas"], ["/raid", "/tmp"], "nas")
    return d.select("o_orderkey", layout.alias("data_layout"))


@query(
    "x11_gpus_per_server",
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 16 WHEN '2-HIGH' THEN 10 END::DOUBLE AS gpus FROM orders",
)
def _(spark, sf):
    gpus = M.lookup("o_orderpriority", {"1-URGENT": 16.0, "2-HIGH": 10.0})
    return table(spark, sf, "orders").select("o_orderkey", gpus.alias("gpus"))


@query(
    "x12_coverage_bins",
    """SELECT o_orderkey, CASE WHEN v < 35 THEN NULL WHEN v < 40 THEN 35 WHEN v < 45 THEN 40 WHEN v < 50 THEN 45 WHEN v < 51.7 THEN 50
      WHEN v < 68 THEN 52 WHEN v < 80 THEN 68 WHEN v < 85 THEN 80 END::DOUBLE AS coverage_binned
    FROM (SELECT o_orderkey, CAST(o_orderkey % 1000 AS DOUBLE) / 10 AS v FROM orders)""",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", M.coverage_bin((key() % 1000).cast("double") / 10).alias("coverage_binned"))


@query(
    "x13_resource_minutes",
    """SELECT o_orderkey, CAST(o_custkey AS DOUBLE) / 60 AS total_minutes, 8 / 16E0 * CAST(o_custkey AS DOUBLE) / 60 AS server_minutes,
      8 * CAST(o_custkey AS DOUBLE) / 60 AS gpu_minutes, CAST(o_custkey AS DOUBLE) * 1e-9 AS size_GB FROM orders""",
)
def _(spark, sf):
    sec = F.col("o_custkey").cast("double")
    return table(spark, sf, "orders").select(
        "o_orderkey", (sec / 60.0).alias("total_minutes"), (F.lit(8) / F.lit(16.0) * sec / 60.0).alias("server_minutes"),
        (8 * sec / 60.0).alias("gpu_minutes"), (sec * 1e-9).alias("size_GB"),
    )


@query(
    "x14_rates",
    """SELECT o_orderkey, CAST(o_custkey AS DOUBLE) / nullif(o_orderkey % 5, 0) AS images_per_sec_per_gpu,
      1e-6 * CAST(o_custkey * 1000 AS DOUBLE) / nullif(CAST(o_orderkey % 9 AS DOUBLE), 0) AS compute_MB_per_sec,
      CAST(o_orderkey % 9 AS DOUBLE) / 50 AS sec_per_batch FROM orders""",
)
def _(spark, sf):
    rate, sec = F.col("o_custkey").cast("double"), (key() % 9).cast("double")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.try_divide(rate, key() % 5).alias("images_per_sec_per_gpu"),
        F.try_divide(1e-6 * (F.col("o_custkey") * 1000).cast("double"), sec).alias("compute_MB_per_sec"),
        F.try_divide(sec, F.lit(50)).alias("sec_per_batch"),
    )


@query("x15_scaled_boxes", f"WITH {S.SCALED_CTE} SELECT filename, suppkey, xmin, ymin, xmax, ymax FROM scaled")
def _(spark, sf):
    return S.box_series(spark, sf).select("filename", "suppkey", *B.COORDS)


@query(
    "x16_int_of_float_text",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_extendedprice) AS INT) AS n FROM lineitem",
)
def _(spark, sf):
    items = table(spark, sf, "lineitem")
    return items.select("l_orderkey", "l_linenumber", "l_partkey", B.int_of(F.col("l_extendedprice").cast("string")).alias("n"))


@query(
    "x17_box_line",
    f"WITH {S.SCALED_CTE} SELECT printf('%s,%.4f,%.4f,%.4f,%.4f', filename, xmin, ymin, xmax, ymax) AS value FROM scaled",
)
def _(spark, sf):
    return S.box_series(spark, sf).select(B.box_line().alias("value"))


@query(
    "x18_path_parts",
    """SELECT page_id, list_last(string_split(url, '/')) AS base_name, regexp_extract(url, '([^/]+)/[^/]*$', 1) AS parent,
      regexp_replace(list_last(string_split(url, '/')), '\\.[^.]*$', '') AS stem,
      regexp_extract(list_last(string_split(url, '/')), '(\\.[^.]*)$', 1) AS extension FROM pages""",
)
def _(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", X.base_name("url").alias("base_name"), X.parent_name("url").alias("parent"),
        X.stem("url").alias("stem"), X.extension("url").alias("extension"),
    )


@query(
    "x19_resize_plan",
    """WITH p AS (SELECT p_partkey, CAST(p_size * 97 + 1 AS BIGINT) AS height, CAST(p_partkey % 6000 + 1 AS BIGINT) AS width FROM part),
    f AS (SELECT *, least(3E0, sqrt(536870911E0 / (CAST(height AS DOUBLE) * width * 3))) AS factor FROM p)
    SELECT p_partkey, height, width, factor, CAST(trunc(height * factor) AS INT) AS new_height, CAST(trunc(width * factor) AS INT) AS new_width FROM f""",
)
def _(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") * 97 + 1).cast("bigint").alias("height"), (F.col("p_partkey") % 6000 + 1).cast("bigint").alias("width")
    )
    return corpus.resize_plan(part, 3.0)


@query("x20_content_checksum", "SELECT doc_id, md5(text) AS md5 FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.checksum_of("text").alias("md5"))


@query(
    "x20_checksum_mismatches",
    """WITH expected AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN md5('changed') ELSE md5(text) END AS expected FROM documents WHERE doc_id % 7 <> 3)
    SELECT doc_id, expected IS NOT NULL AS listed, coalesce(md5(text) = expected, false) AS same FROM documents LEFT JOIN expected USING (doc_id)""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", X.checksum_of("text").alias("md5"))
    listed = docs.filter("doc_id % 7 <> 3").select(
        "doc_id", F.when(F.col("doc_id") % 9 == 0, F.md5(F.lit("changed").cast("binary"))).otherwise(F.col("md5")).alias("expected")
    )
    return docs.join(listed, "doc_id", "left").select(
        "doc_id", F.col("expected").isNotNull().alias("listed"), F.coalesce(F.col("md5") == F.col("expected"), F.lit(False)).alias("same")
    )


@query(
    "x21_copies_suffix",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN printf('-%dx', 2 + o_orderkey % 150) WHEN 2 THEN '-0.5x' ELSE '1729' END AS suffix FROM orders""",
)
def _(spark, sf):
    copies = F.when(key() % 4 == 1, (2 + key() % 150).cast("double")).when(key() % 4 == 2, F.lit(0.5)).otherwise(F.lit(1.0))
    resize = F.when(key() % 4 == 3, F.lit(3.0)).otherwise(F.lit(1.0))
    return table(spark, sf, "orders").select("o_orderkey", X.copies_suffix(copies, resize).alias("suffix"))


@query("x22_boolean_words", "SELECT o_orderkey, o_orderkey % 10 < 5 AS flag FROM orders")
def _(spark, sf):
    words = F.array(*[F.lit(w) for w in ["Yes", "true", "T", "y", "1", "No", "false", "F", "n", "0"]])
    return table(spark, sf, "orders").select("o_orderkey", X.to_bool(F.get(words, (key() % 10).cast("int"))).alias("flag"))


@query("x23_megabytes_of_words", f"WITH {S.PORTS_CTE} SELECT event_id, counter * 4e-6 AS MB FROM ports")
def _(spark, sf):
    return S.ports(spark, sf).select("event_id", (F.col("counter") * series.MB_PER_WORD).alias("MB"))


@query(
    "x25_guarded_nested_fields",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey % 600 AS DOUBLE) END AS stage_sec FROM orders""",
)
def _(spark, sf):
    stage = F.when(key() % 3 != 0, F.struct((key() % 3 == 2).alias("error"), (key() % 600).cast("double").alias("elapsed_sec")))
    runs = table(spark, sf, "orders").select("o_orderkey", stage.alias("stage"))
    ok = F.col("stage").isNotNull() & ~F.col("stage.error")
    return runs.select("o_orderkey", F.when(ok, F.col("stage.elapsed_sec")).alias("stage_sec"))


@query(
    "x26_known_bad_images",
    f"WITH {S.IMAGES_CTE} SELECT filename, contains(filename, 'Brand_7_1') AS png, filename IN ('Brand_1_15.JPEG', 'Brand_2_7.JPEG') AS cmyk FROM images",
)
def _(spark, sf):
    path = F.concat(F.lit("/data/train/"), F.col("filename"))
    images = S.images(spark, sf).select("filename", path.alias("path"))
    return images.select(
        "filename", corpus.is_png("path", ["Brand_7_1"]).alias("png"),
        corpus.is_cmyk("path", ["Brand_1_15.JPEG", "Brand_2_7.JPEG"]).alias("cmyk"),
    )


@query(
    "x27_invalid_records",
    f"WITH {S.IMAGES_CTE} SELECT filename, height FROM images WHERE p_partkey % 10 = 0 OR p_partkey % 15 = 1",
)
def _(spark, sf):
    p = F.col("p_partkey")
    stored = S.images(spark, sf).select(
        "filename", "height", "width", F.when(p % 15 == 1, F.lit("PNG")).otherwise(F.lit("JPEG")).alias("format"),
        F.when(p % 10 == 0, F.col("height") + 1).otherwise(F.col("height")).alias("stored_height"), F.col("width").alias("stored_width"),
    )
    return corpus.image_rejects(stored).select("filename", "height")


@query(
    "m02_cleaned_training_results",
    f"""WITH {S.TRAINING_CTE}, r AS (SELECT *, TRY_CAST(list_last(regexp_extract_all(output, '(?m)^total images/sec: ([.0-9]+)$', 1)) AS DOUBLE) AS images_per_sec
      FROM runs WHERE error = false)
    SELECT test_uuid, images_per_sec, images_per_sec / np AS images_per_sec_per_gpu, coalesce(num_copies, 1) AS num_copies,
      coalesce(image_format, 'JPEG') AS image_format,
      images_per_sec * (CASE data_dir_suffix WHEN '-png2' THEN CAST({results.MEAN_BYTES['-png2']!r} AS DOUBLE) WHEN '-other' THEN NULL
        ELSE CAST({results.MEAN_BYTES['']!r} AS DOUBLE) END) * 1e-6 AS MB_per_sec FROM r""",
)
def _(spark, sf):
    clean = results.clean_training_results(S.training_runs(spark, sf), results.suffix_dimension(spark))
    return clean.select("test_uuid", "images_per_sec", "images_per_sec_per_gpu", "num_copies", "image_format", "MB_per_sec")


#: What older records of the second kind of runs lack.
SECOND_DEFAULTS = {"storage_type": "nfs", "mpi": True, "use_tf_layers": True, "nvlink": True}
FLAGS = ["CASE WHEN o_orderkey % 5 < 2 THEN TRUE WHEN o_orderkey % 5 = 2 THEN FALSE END AS mpi", "CASE WHEN o_orderkey % 7 = 0 THEN FALSE END AS nvlink",
         "CASE WHEN o_orderkey % 11 = 0 THEN FALSE END AS use_tf_layers"]


@query(
    "m02_cleaned_second_training_results",
    f"""WITH {S.TRAINING_CTE}, f AS (SELECT 'run-' || CAST(o_orderkey AS VARCHAR) AS test_uuid, {', '.join(FLAGS)} FROM orders),
    r AS (SELECT *, TRY_CAST(list_last(regexp_extract_all(output, '(?m)^total images/sec: ([.0-9]+)$', 1)) AS DOUBLE) AS images_per_sec
      FROM runs JOIN f USING (test_uuid) WHERE error = false)
    SELECT test_uuid, np AS num_gpus, images_per_sec / np AS images_per_sec_per_gpu, coalesce(num_copies, 1) AS num_copies, 'JPEG' AS image_format,
      coalesce(storage_type, 'nfs') AS storage_type, coalesce(mpi, true) AS mpi, coalesce(use_tf_layers, true) AS use_tf_layers, coalesce(nvlink, true) AS nvlink,
      images_per_sec * (CASE data_dir_suffix WHEN '-png2' THEN CAST({results.MEAN_BYTES['-png2']!r} AS DOUBLE) WHEN '-other' THEN NULL
        ELSE CAST({results.MEAN_BYTES['']!r} AS DOUBLE) END) * 1e-6 AS MB_per_sec FROM r""",
)
def _(spark, sf):
    flags = table(spark, sf, "orders").selectExpr("'run-' || CAST(o_orderkey AS STRING) AS test_uuid", *FLAGS)
    raw = S.training_runs(spark, sf).join(flags, "test_uuid")
    clean = results.clean_second_training_results(raw, results.suffix_dimension(spark), SECOND_DEFAULTS)
    return clean.select("test_uuid", "num_gpus", "images_per_sec_per_gpu", "num_copies", "image_format", *SECOND_DEFAULTS, "MB_per_sec")


@query(
    "m02_rejected_training_results",
    """SELECT 'run-' || CAST(o_orderkey AS VARCHAR) AS test_uuid, CASE o_orderkey % 6 WHEN 1 THEN 'not a time: utc_begin' WHEN 2 THEN 'not a time: utc_end'
      ELSE 'not a time: utc_begin, utc_end' END AS reason FROM orders WHERE o_orderkey % 6 IN (1, 2, 3)""",
)
def _(spark, sf):
    n = F.regexp_extract("test_uuid", "[0-9]+", 0).cast("bigint") % 6
    broken = {"utc_begin": F.when(n.isin(1, 3), F.lit("no time")).otherwise(F.col("utc_begin")), "utc_end": F.when(n.isin(2, 3), F.lit("2019-99-99")).when(n != 4, F.col("utc_end"))}
    return results.training_rejects(S.training_runs(spark, sf).withColumns(broken)).select("test_uuid", "reason")


@query(
    "x14_cleaned_scan_results",
    """SELECT o_orderkey, CASE WHEN b THEN sec END AS compute_sec, CASE WHEN b THEN bytes END AS input_files_size,
      CASE WHEN b THEN 1e-6 * bytes / nullif(sec, 0) END AS compute_MB_per_sec, CASE WHEN b THEN sec / 50 END AS sec_per_batch,
      CASE WHEN b THEN 3.5E0 END AS init_sec, 'None' AS compression
    FROM (SELECT o_orderkey, o_orderkey % 6 <> 0 AS b, CAST(o_orderkey % 7 + o_orderkey % 5 AS DOUBLE) AS sec, CAST(o_custkey * 1000 + 7 AS DOUBLE) AS bytes FROM orders)""",
)
def _(spark, sf):
    raw = table(spark, sf, "orders").select(
        "o_orderkey", F.lit("2019-12-13T10:00:00Z").alias("utc_begin"), F.lit("2019-12-13T11:00:00Z").alias("utc_end"),
        F.lit(False).alias("error"), (key() % 6 == 0).alias("single_batch"), F.lit(50).alias("num_batches"),
        F.array((key() % 7).cast("double"), (key() % 5).cast("double")).alias("compute_sec_list"),
        F.array(F.array(F.col("o_custkey") * 1000), F.array(F.lit(7).cast("bigint"))).alias("input_file_sizes"),
        F.array(F.array(F.lit("a")), F.array(F.lit("b"))).alias("input_files"),
        F.lit(1.0).alias("glob_sec"), F.lit(2.0).alias("getsize_sec"), F.lit(0.5).alias("create_ddf_sec"),
        F.lit(None).cast("string").alias("compression"),
    )
    return results.clean_scan_results(raw).select(
        "o_orderkey", "compute_sec", "input_files_size", "compute_MB_per_sec", "sec_per_batch", "init_sec", "compression"
    )


def stage_records(spark, sf):
    """Sequencing runs: a germline stage on every second order, an fq2bam stage on every third."""
    log = F.concat(
        F.lit("Version v2."), key() % 4, F.lit(" GPU-BWA Mem time: "), key() % 90, F.lit(" seconds\nProcessing time: "), key() % 90 + 60,
        F.lit(" seconds\nTotal time taken: "), key() % 30, F.lit("\n"),
    )
    begin = F.lit("2020-03-01T00:00:00Z")

    def stage(error):
        return F.struct(
            begin.alias("utc_begin"), F.lit("2020-03-01T01:00:00Z").alias("utc_end"), (key() % 500).cast("double").alias("elapsed_sec"),
            error.alias("error"), log.alias("errors"),
        )

    return table(spark, sf, "orders").select(
        F.col("o_orderkey"), begin.alias("utc_begin"), F.lit("2020-03-01T02:00:00Z").alias("utc_end"),
        F.when(key() % 10 == 0, F.lit(True)).alias("error"), (key() % 500).cast("double").alias("elapsed_sec"), F.lit(8).alias("num_gpus"),
        F.when(key() % 4 == 0, F.lit("elsewhere")).otherwise(F.lit("node-1")).alias("hostname"),
        F.struct(F.lit("/mnt/nas/in").alias("input_dir"), F.lit("/raid/t").alias("temp_dir")).alias("args"),
        F.array(F.col("o_custkey"), key()).alias("fq_file_sizes"), F.col("o_custkey").alias("bam_file_size_bytes"),
        F.col("o_custkey").alias("haplotypecaller_gvcf_file_size_bytes"), F.col("o_custkey").alias("deepvariant_gvcf_file_size_bytes"),
        F.when(key() % 3 == 0, stage(F.lit(False))).alias("fq2bam_result"),
        F.when(key() % 2 == 0, stage(key() % 8 == 0)).alias("germline_result"),
        F.lit(None).cast("struct<utc_begin:string,utc_end:string,elapsed_sec:double,error:boolean,errors:string>").alias("deepvariant_result"),
    )


@query(
    "w14_cleaned_stage_results",
    """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AND o_orderkey % 8 <> 0 AS g, o_orderkey % 3 = 0 AS f FROM orders)
    SELECT k AS o_orderkey, k % 10 = 0 AS error, CASE WHEN g OR f THEN '2.' || k % 4 END AS tool_version,
      CASE WHEN g OR f THEN CAST(k % 90 AS DOUBLE) END AS bwa_mem_sec, CASE WHEN g OR f THEN 60E0 END AS sorting_to_bam_writing_sec,
      CASE WHEN g THEN CAST(k % 30 AS DOUBLE) / 60 END AS haplotypecaller_minutes,
      CASE WHEN k % 4 <> 0 THEN 0.5E0 * CAST(k % 500 AS DOUBLE) / 60 END AS total_server_minutes, 'mixed' AS data_layout,
      CASE WHEN g THEN TIMESTAMP '2020-03-01 00:00:00' + to_seconds(k % 90 + 60) END AS haplotypecaller_utc_begin,
      CASE WHEN g THEN TIMESTAMP '2020-03-01 00:00:00' + to_seconds(k % 90 + 60) WHEN f THEN TIMESTAMP '2020-03-01 01:00:00' END AS bwa_mem_to_bam_writing_utc_end
    FROM r""",
)
def _(spark, sf):
    clean = results.clean_stage_results(
        stage_records(spark, sf), {"node-1": 16, "node-2": 16}, ["/mnt/nas"], ["/raid", "/tmp"], "nas"
    )
    return clean.select(
        "o_orderkey", "error", "tool_version", "bwa_mem_sec", "sorting_to_bam_writing_sec", "haplotypecaller_minutes",
        "total_server_minutes", "data_layout", "haplotypecaller_utc_begin", "bwa_mem_to_bam_writing_utc_end",
    )
