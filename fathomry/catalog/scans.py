"""Scans and sources (S): derived rows are written in the source's format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomry import schemas
from fathomry.catalog import standins as S
from fathomry.catalog.base import query, table
from fathomry.functions import text as X
from fathomry.operators import boxes as B
from fathomry.operators import report, series
from fathomry.plans import results
from fathomry.session import fresh_dir
from fathomry.sources import readers, writers

LOAN_CSV = {"header": False, "sep": "|", "dateFormat": readers.LOAN_DATES}


@query("s01_performance_csv", f"WITH {S.PERF_CTE} SELECT * FROM perf")
def _(spark, sf):
    path = writers.write_csv(S.performance(spark, sf), fresh_dir(spark, "performance"), **LOAN_CSV)
    return readers.read_performance(spark, path)[0]


@query("s02_acquisition_csv", f"WITH {S.ACQ_CTE} SELECT * FROM acq")
def _(spark, sf):
    path = writers.write_csv(S.acquisition(spark, sf), fresh_dir(spark, "acquisition"), **LOAN_CSV | {"header": True})
    return readers.read_acquisition(spark, path, header=True)[0]


@query("s03_seller_names_csv", S.NAMES_SQL)
def _(spark, sf):
    path = writers.write_csv(S.seller_names(spark, sf), fresh_dir(spark, "names"), **LOAN_CSV)
    return readers.read_names(spark, path)[0]


@query("s04_orc_scan", "SELECT l_returnflag, max(l_discount) AS max_discount FROM lineitem GROUP BY 1")
def _(spark, sf):
    path = writers.write_orc(table(spark, sf, "lineitem"), fresh_dir(spark, "lineitem-orc"))
    return readers.read_columnar(spark, path).groupBy("l_returnflag").agg(F.max("l_discount").alias("max_discount"))


@query("s05_orc_rename_by_position", "SELECT c_custkey AS loan_id, c_name AS seller_name, c_acctbal AS upb FROM customer")
def _(spark, sf):
    slim = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").toDF("_col0", "_col1", "_col2")
    path = writers.write_orc(slim, fresh_dir(spark, "customer-orc"))
    return readers.read_columnar(spark, path, columns=["loan_id", "seller_name", "upb"])


@query("s06_parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    return readers.read_columnar(spark, f"{sf}/orders.parquet", "parquet").select("o_orderkey", "o_totalprice")


@query(
    "s07_numbered_batches",
    "SELECT CAST(l_linenumber - 1 AS INT) AS batch, count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS checksum FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    path = fresh_dir(spark, "batches")
    items.write.partitionBy("l_linenumber").orc(path)
    specs = [f"{path}/l_linenumber={n}/*.orc" for n in range(1, 8)]
    batches = readers.read_batches(spark, specs)
    return batches.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("checksum"))


def _result_lines(spark, sf):
    """JSON line per run; every 50th is cut short."""
    runs = S.training_runs(spark, sf).withColumn("k", F.regexp_extract("test_uuid", r"(\d+)", 1).cast("bigint"))
    line = F.to_json(F.struct(*[c for c in runs.columns if c != "k"]))
    lines = runs.select(F.when(F.col("k") % 50 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    # bzip2 is slow to write; the lines of one input split are spread over the cores.
    return lines.repartition(spark.sparkContext.defaultParallelism)


@query(
    "s08_result_records",
    f"""WITH {S.TRAINING_CTE} SELECT test_uuid, error, output, np, num_copies, cached FROM runs
    WHERE CAST(substr(test_uuid, 5) AS BIGINT) % 50 <> 0""",
)
def _(spark, sf):
    path = fresh_dir(spark, "results")
    _result_lines(spark, sf).write.option("compression", "bzip2").text(path)
    good, _ = readers.read_results(spark, path, list_files=False)
    return good.select("test_uuid", "error", "output", "np", "num_copies", "cached")


@query("s08_rejected_records", "SELECT count(*) AS rejects FROM orders WHERE o_orderkey % 50 = 0")
def _(spark, sf):
    path = fresh_dir(spark, "results")
    _result_lines(spark, sf).write.option("compression", "bzip2").text(path)
    _, rejects = readers.read_results(spark, path, list_files=False)
    return rejects.agg(F.count(F.lit(1)).alias("rejects"))


@query(
    "s09_counter_csv",
    f"WITH {S.PORTS_CTE} SELECT t, counter, rate_gbps, device, port, counter_name FROM ports",
)
def _(spark, sf):
    path = writers.write_csv(
        S.ports(spark, sf), fresh_dir(spark, "counters"),
        ["t", "counter", "rate_gbps", "device", "port", "counter_name"], header=False,
    )
    return readers.read_counters(spark, path)[0]


@query("s10_headered_dimension", "SELECT p_name AS sample_id, p_retailprice AS coverage, p_partkey AS k FROM part")
def _(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_name").alias("sample_id"), F.col("p_retailprice").alias("coverage"), F.col("p_partkey").alias("k")
    )
    path = writers.write_csv(part, fresh_dir(spark, "samples"))
    return readers.read_dimension(spark, path, f"{schemas.SAMPLES}, k bigint")[0]


@query(
    "s11_csv_inside_a_field",
    """SELECT event_id, CAST(i AS INT) AS row_no, 'gpu' || i AS name, CAST((event_id + i) % 101 AS DOUBLE) AS gpu_util_pct
    FROM events, range(3) t(i)""",
)
def _(spark, sf):
    def line(i):
        return F.concat(F.lit(f"2019/10/24 10:00:0{i}, gpu{i}, "), ((F.col("event_id") + i) % 101).cast("string"), F.lit(" %\n"))

    output = F.concat(F.lit("timestamp, name, utilization.gpu [%]\n"), line(0), line(1), line(2))
    runs = table(spark, sf, "events").select("event_id", output.alias("output"))
    rows = readers.expand_csv_field(runs, "output", "timestamp string, name string, util string")
    return rows.select("event_id", "row_no", "name", X.percent_number("util").alias("gpu_util_pct"))


def annotation_documents(spark, sf):
    """One annotation per line item. Every second one goes on after a box without corners."""

    def text(c):
        return F.concat(F.col(c), F.lit(".7"))

    box = F.struct(*[text(c).alias(c) for c in B.COORDS]).alias("bndbox")
    gap = F.struct(*[F.lit("-1").alias(c) for c in B.COORDS]).alias("bndbox")
    name = F.when(F.col("suppkey") % 5 == 0, F.concat(F.lit("Brand_"), 1 + F.col("suppkey") % 40)).otherwise(F.col("synset")).alias("name")
    one = F.struct(name, box)
    stop = F.struct(F.lit("later").alias("name"), gap)
    objects = F.when(F.col("suppkey") % 2 == 0, F.array(one)).otherwise(F.array(one, stop, one))
    return S.raw_boxes(spark, sf).select(
        "filename",
        F.struct(F.col("width").cast("string").alias("width"), F.col("height").cast("string").alias("height")).alias("size"),
        objects.alias("object"),
        "synset",
    )


@query(
    "s12_xml_annotations",
    f"""WITH {S.IMAGES_CTE}, {S.RAW_BOXES_CTE} SELECT filename, synset, 0 AS box_no,
      CASE WHEN suppkey % 5 = 0 THEN 'Brand_' || CAST(1 + suppkey % 40 AS VARCHAR) ELSE synset END AS box_label,
      CAST(width AS INT) AS width, CAST(height AS INT) AS height, xmin, ymin, xmax, ymax
    FROM raw_boxes JOIN images ON l_partkey = p_partkey""",
)
def _(spark, sf):
    path = fresh_dir(spark, "annotations")
    written = annotation_documents(spark, sf).write.format("xml").option("rootTag", "annotations").option("rowTag", "annotation")
    # Tags take many times the room of what they hold; a packed file is read by one task, so none is large.
    written.option("compression", "gzip").option("maxRecordsPerFile", 200_000).save(path)
    good, _ = readers.read_annotations(spark, path, from_path=False)
    return B.annotation_boxes(good).drop("source_file")


def annotation_files(spark, sf):
    """A file for each image: every third keeps its corners outside the objects, every fifth has a second box and one
    without a corner behind it, every seventh is cut off."""
    p = F.col("p_partkey")
    corners = lambda d: F.concat(*[x for c, n in zip(B.COORDS, (1, 2, 50, 60)) for x in (F.lit(f"<{c}>"), (p % 97 + n + d).cast("string"), F.lit(f".5</{c}>"))])
    size = F.concat(F.lit("<size><width>"), F.col("width"), F.lit("</width><height>"), F.col("height"), F.lit("</height></size>"))
    first = F.when(p % 3 == 0, F.concat(F.lit("<owner><name>me</name></owner><list>"), corners(0), F.lit("</list>"))).otherwise(
        F.concat(F.lit("<object><name>"), F.col("synset"), F.lit("</name><part><bndbox>"), corners(0), F.lit("</bndbox></part></object>"))
    )
    more = F.when(p % 5 == 0, F.concat(F.lit("<object><name>late</name>"), corners(7), F.lit("</object><object><xmin>-1</xmin><xmin>9</xmin></object>"))).otherwise(F.lit(""))
    end = F.when(p % 7 == 0, F.lit("<object>")).otherwise(F.lit("</annotation>"))
    text = F.concat(F.lit("<annotation>"), size, first, more, end)
    path = F.concat(F.col("synset"), F.lit("/"), F.regexp_replace("filename", "JPEG$", "xml"))
    return writers.write_files(S.images(spark, sf).select(path.alias("path"), text.alias("bytes")), fresh_dir(spark, "annotated")) + "/*/*.xml"


@query(
    "s12_annotation_files",
    f"""WITH {S.IMAGES_CTE}, b AS (SELECT *, unnest(CASE WHEN p_partkey % 5 = 0 THEN [0, 1] ELSE [0] END) AS box_no FROM images WHERE p_partkey % 7 <> 0)
    SELECT filename, synset, CASE WHEN p_partkey % 3 = 0 THEN 'me' ELSE synset END AS box_label, CAST(width AS INT) AS width, CAST(height AS INT) AS height, box_no,
      CAST(p_partkey % 97 + 1 + 7 * box_no AS INT) AS xmin, CAST(p_partkey % 97 + 2 + 7 * box_no AS INT) AS ymin,
      CAST(p_partkey % 97 + 50 + 7 * box_no AS INT) AS xmax, CAST(p_partkey % 97 + 60 + 7 * box_no AS INT) AS ymax FROM b""",
)
def _(spark, sf):
    return readers.read_annotation_files(spark, annotation_files(spark, sf))[0]


@query("s12_rejected_files", f"WITH {S.IMAGES_CTE} SELECT filename, TRUE AS cut FROM images WHERE p_partkey % 7 = 0")
def _(spark, sf):
    rejects = readers.read_annotation_files(spark, annotation_files(spark, sf))[1]
    name = F.concat(F.regexp_extract("source_file", r"([^/]+)\.xml$", 1), F.lit(".JPEG"))
    return rejects.select(name.alias("filename"), F.endswith("text", F.lit("<object>")).alias("cut"))


@query(
    "s13_ordered_label_list",
    "SELECT synset, row_number() OVER (ORDER BY synset) AS label FROM (SELECT DISTINCT replace(p_brand, '#', '_') AS synset FROM part)",
)
def _(spark, sf):
    path = fresh_dir(spark, "labels")
    names = S.images(spark, sf).select("synset").distinct()
    names.orderBy("synset").write.text(path)
    return readers.read_label_list(spark, path).select("synset", "label")


@query("s14_synset_texts", f"WITH {S.IMAGES_CTE}, {S.TEXTS_CTE} SELECT synset, text FROM texts")
def _(spark, sf):
    path = fresh_dir(spark, "texts")
    S.synset_texts(spark, sf).select(F.concat_ws("\t", "synset", "text").alias("value")).write.text(path)
    return readers.read_synset_texts(spark, path)


@query(
    "s15_box_csv",
    f"WITH {S.SCALED_CTE} SELECT filename, xmin, ymin, xmax, ymax FROM scaled WHERE xmin < xmax AND ymin < ymax",
)
def _(spark, sf):
    path = writers.write_csv(
        B.drop_degenerate(S.box_series(spark, sf)), fresh_dir(spark, "boxes"), ["filename", *B.COORDS], header=False
    )
    return readers.read_boxes(spark, path)


@query(
    "s16_image_folders",
    f"WITH {S.IMAGES_CTE} SELECT filename, synset, CAST(strlen(content) AS INT) AS length, md5(content) AS md5 FROM images",
)
def _(spark, sf):
    files = S.images(spark, sf).select(F.concat_ws("/", "synset", "filename").alias("path"), F.col("content").cast("binary").alias("bytes"))
    path = writers.write_files(files, fresh_dir(spark, "images"))
    return readers.read_images(spark, path).select("filename", "synset", F.octet_length("encoded").alias("length"), F.md5("encoded").alias("md5"))


@query("s17_file_sizes", "SELECT CAST(sum(strlen(text) + 1) AS BIGINT) AS total_bytes FROM documents")
def _(spark, sf):
    path = fresh_dir(spark, "texts")
    table(spark, sf, "documents").select("text").write.text(path)
    return readers.list_files(spark, path, "part-*").agg(F.sum("length").alias("total_bytes"))


@query("s18_sample_list", "SELECT p_name || '-' || p_partkey AS sample_id, p_retailprice AS coverage FROM part")
def _(spark, sf):
    part = table(spark, sf, "part").select(F.concat_ws("-", "p_name", "p_partkey").alias("sample_id"), "p_retailprice")
    return readers.read_samples(spark, writers.write_csv(part, fresh_dir(spark, "samples"), header=False))[0]


@query(
    "s19_inline_dimension",
    f"""WITH {S.TRAINING_CTE} SELECT data_dir_suffix, count(*) AS runs,
      CASE data_dir_suffix WHEN '-png2' THEN CAST({results.MEAN_BYTES['-png2']!r} AS DOUBLE) WHEN '-other' THEN NULL
        ELSE CAST({results.MEAN_BYTES['']!r} AS DOUBLE) END AS mean_bytes_per_image FROM runs GROUP BY 1""",
)
def _(spark, sf):
    runs = S.training_runs(spark, sf).groupBy("data_dir_suffix").agg(F.count(F.lit(1)).alias("runs"))
    return runs.join(results.suffix_dimension(spark), "data_dir_suffix", "left")


@query(
    "s20_step_log",
    f"WITH {S.STEPS_CTE} SELECT rank, hostname, step, num_bytes, latency_sec, time_bucket(INTERVAL '1 millisecond', ts) AS ts FROM steps",
)
def _(spark, sf):
    steps = S.steps(spark, sf)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("@timestamp")
    path = fresh_dir(spark, "steps")
    steps.select(stamp, *[c for c in steps.columns if c not in ("ts", "t_us")]).write.json(path)
    return readers.read_step_log(spark, path)[0].select("rank", "hostname", "step", "num_bytes", "latency_sec", "ts")


def _spoil(df, column, key):
    """One row in 40 has a word where ``column`` should have a number."""
    return df.withColumn(column, F.when(F.col(key) % 40 == 0, F.lit("none")).otherwise(F.col(column).cast("string")))


def _counted(both):
    good, rejects = both
    kinds = good.select(F.lit("good").alias("kind")).unionByName(rejects.select(F.lit("reject").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))


def _spoilt_sql(source, key):
    return f"SELECT CASE WHEN {key} % 40 = 0 THEN 'reject' ELSE 'good' END AS kind, count(*) AS rows FROM {source} GROUP BY 1"


@query("s01_rejected_rows", f"WITH {S.PERF_CTE} {_spoilt_sql('perf', 'loan_id')}")
def _(spark, sf):
    spoilt = _spoil(S.performance(spark, sf), "loan_age", "loan_id")
    return _counted(readers.read_performance(spark, writers.write_csv(spoilt, fresh_dir(spark, "spoilt"), **LOAN_CSV)))


@query("s02_rejected_rows", f"WITH {S.ACQ_CTE} {_spoilt_sql('acq', 'loan_id')}")
def _(spark, sf):
    acq = S.acquisition(spark, sf)
    spoilt = _spoil(acq.withColumn("orig_date", F.date_format("orig_date", readers.LOAN_DATES)), "orig_date", "loan_id")
    return _counted(readers.read_acquisition(spark, writers.write_csv(spoilt, fresh_dir(spark, "spoilt"), **LOAN_CSV)))


@query("s09_rejected_rows", f"WITH {S.PORTS_CTE} {_spoilt_sql('ports', 'event_id')}")
def _(spark, sf):
    names = ["t", "counter", "rate_gbps", "device", "port", "counter_name"]
    spoilt = _spoil(S.ports(spark, sf), "counter", "event_id")
    return _counted(readers.read_counters(spark, writers.write_csv(spoilt, fresh_dir(spark, "spoilt"), names, header=False)))


@query("s10_rejected_rows", _spoilt_sql("part", "p_partkey"))
def _(spark, sf):
    part = table(spark, sf, "part").selectExpr("p_name AS sample_id", "p_retailprice AS coverage", "p_partkey AS k")
    path = writers.write_csv(_spoil(part, "coverage", "k"), fresh_dir(spark, "spoilt"))
    return _counted(readers.read_dimension(spark, path, f"{schemas.SAMPLES}, k bigint"))


@query("s18_rejected_rows", _spoilt_sql("part", "p_partkey"))
def _(spark, sf):
    part = table(spark, sf, "part").selectExpr("p_name AS sample_id", "p_retailprice AS coverage", "p_partkey AS k")
    path = writers.write_csv(_spoil(part, "coverage", "k").drop("k"), fresh_dir(spark, "spoilt"), header=False)
    return _counted(readers.read_samples(spark, path))


@query("s20_rejected_rows", f"WITH {S.STEPS_CTE} {_spoilt_sql('steps', 'step')}")
def _(spark, sf):
    steps = S.steps(spark, sf).withColumn("@timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    path = fresh_dir(spark, "spoilt")
    line = F.to_json(F.struct(*[c for c in steps.columns if c not in ("ts", "t_us")]))
    word = F.regexp_replace(line, '"num_bytes":-?[0-9]+', '"num_bytes":"none"')
    steps.select(F.when(F.col("step") % 40 == 0, word).otherwise(line)).write.text(path)
    return _counted(readers.read_step_log(spark, path))


# In each file the numbers are 0 .. n - 1, whatever files the text came to lie in.
@query(
    "s21_numbered_log_lines",
    f"""WITH lines AS (SELECT unnest(string_split(text, {S.NL})) AS line FROM documents)
    SELECT count(*) AS lines, CAST(sum(strlen(line)) AS BIGINT) AS num_bytes, 0::BIGINT AS gaps FROM lines""",
)
def _(spark, sf):
    path = fresh_dir(spark, "log")
    table(spark, sf, "documents").select("text").write.text(path)
    per_file = readers.read_lines(spark, path).groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("b"), F.sum("line_no").alias("s"), F.max("line_no").alias("m")
    )
    gap = F.abs(F.col("s") - F.expr("n * (n - 1) div 2")) + F.abs(F.col("m") - F.col("n") + 1)
    return per_file.agg(F.sum("n").alias("lines"), F.sum("b").alias("num_bytes"), F.sum(gap).alias("gaps"))


@query(
    "s21_log_lines_with_following",
    """WITH l AS (SELECT o_orderkey, unnest([1, 2, 3]) AS i FROM orders)
    SELECT 'run ' || o_orderkey || CASE WHEN i = 1 THEN ' BEGIN' ELSE ' step' END AS value FROM l WHERE i <= 2""",
)
def _(spark, sf):
    runs = table(spark, sf, "orders").select(
        F.explode(F.array(*[F.concat(F.lit("run "), F.col("o_orderkey"), F.lit(end)) for end in (" BEGIN", " step", " done")])).alias("value")
    )
    path = fresh_dir(spark, "log")
    runs.write.text(path)
    lines = readers.read_lines(spark, path)
    return series.match_with_following(lines, ["file"], "line_no", "value", "BEGIN").select("value")


@query(
    "s22_metric_samples",
    f"WITH {S.EVENTS_CTE} SELECT event_type AS metric, instance, count(*) AS samples, sum(cents) AS total FROM ev GROUP BY 1, 2",
)
def _(spark, sf):
    path = writers.write_parquet(S.metrics(spark, sf), fresh_dir(spark, "metrics"))
    stored = spark.read.parquet(path)
    return stored.groupBy("metric", F.col("labels")["instance"].alias("instance")).agg(
        F.count(F.lit(1)).alias("samples"), F.sum("value").alias("total")
    )


@query(
    "s23_corpus_records",
    f"""WITH {S.IMAGES_CTE} SELECT synset, count(*) AS records, sum(strlen(content))::BIGINT AS num_bytes FROM images GROUP BY 1""",
)
def _(spark, sf):
    records = S.images(spark, sf).withColumn("encoded", F.col("content").cast("binary")).drop("content", "p_partkey")
    corpus = readers.read_corpus(spark, writers.write_parquet(records, fresh_dir(spark, "corpus")))
    return corpus.groupBy("synset").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("encoded")).alias("num_bytes")
    )


@query(
    "a01_max_rate_from_performance_orc",
    f"WITH {S.PERF_CTE} SELECT servicer, max(interest_rate) AS max_interest_rate FROM perf GROUP BY 1",
)
def _(spark, sf):
    path = writers.write_orc(S.performance(spark, sf), fresh_dir(spark, "performance-orc"), stripe_mib=2048)
    return report.max_rate_by_servicer(readers.read_columnar(spark, path))
