"""Readers. They are lazy, declare their schema and let Spark plan the files; those of many small files list them first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomry import schemas
from fathomry.operators.boxes import int_of
from fathomry.operators.lookups import union_all
from fathomry.sources.files import read_records, read_whole, uri

LOAN_DATES = "MM/dd/yyyy"


def _split_text(raw) -> tuple[DataFrame, DataFrame]:
    good, rejects = _split_rejects(raw.withColumn("source_file", F.col("_metadata.file_path")), "source_file")
    return good.drop("source_file"), rejects


def _csv(spark: SparkSession, paths, schema: str, **options) -> tuple[DataFrame, DataFrame]:
    """Delimited text as (good, rejects): a row with a field that does not parse, or with too few or too many
    fields, goes to ``rejects`` whole, with its file."""
    reader = spark.read.schema(f"{schema.strip().rstrip(',')}, _corrupt string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return _split_text(reader.csv(paths, **options))


def _loan_file(spark: SparkSession, paths, schema: str, header: bool) -> tuple[DataFrame, DataFrame]:
    return _csv(spark, paths, schema, sep="|", dateFormat=LOAN_DATES, header=header, enforceSchema=True)


def read_performance(spark: SparkSession, paths: str | list[str], header: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pipe-separated performance files as (good, rejects); ``header`` skips the first row of each file."""
    return _loan_file(spark, paths, schemas.PERFORMANCE, header)


def read_acquisition(spark: SparkSession, paths: str | list[str], header: bool = False) -> tuple[DataFrame, DataFrame]:
    return _loan_file(spark, paths, schemas.ACQUISITION, header)


def read_names(spark: SparkSession, paths: str | list[str], header: bool = False) -> tuple[DataFrame, DataFrame]:
    return _loan_file(spark, paths, schemas.SELLER_NAMES, header)


def read_columnar(
    spark: SparkSession, paths: str | Sequence[str], fmt: str = "orc", columns: Sequence[str] | None = None
) -> DataFrame:
    """ORC or Parquet; ``columns`` renames by position."""
    df = spark.read.format(fmt).load(paths if isinstance(paths, str) else list(paths))
    return df.toDF(*columns) if columns else df


def read_batches(spark: SparkSession, specs: Sequence[str], fmt: str = "orc") -> DataFrame:
    """One frame over all specs with the number of the spec in ``batch``. Spark raises on a spec
    that matches nothing."""
    return union_all(
        [read_columnar(spark, spec, fmt).withColumn("batch", F.lit(i)) for i, spec in enumerate(specs)]
    )


def _split_rejects(raw: DataFrame, file_column: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) by the corrupt-record column.

    Spark only parses the fields a query uses, so a bad field would go unseen in a query that does
    not use it. The hash is always true below; it makes every query parse every field.
    """
    fields = [f"`{c}`" for c in raw.columns if c not in ("_corrupt", file_column)]
    parsed = raw.filter(F.xxhash64(*fields) % 2 < 2)
    good = parsed.filter(F.col("_corrupt").isNull()).drop("_corrupt")
    return good, parsed.filter(F.col("_corrupt").isNotNull()).select(file_column, "_corrupt")


def read_results(
    spark: SparkSession, globs: str | list[str], schema: str = schemas.RESULT, list_files: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Result records (bzip2 by file name) as (good, rejects).

    ``list_files`` reads one JSON list per file; without it, JSON lines, whose bzip2 files Spark
    can split. Records that do not parse go to ``rejects`` with their text and file.
    """
    raw = (
        spark.read.schema(f"{schema}, _corrupt string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("multiLine", list_files)
        .json(globs)
        .withColumn("loaded_filename", F.col("_metadata.file_path"))
    )
    return _split_rejects(raw, "loaded_filename")


def read_counters(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    return _csv(spark, paths, schemas.COUNTERS, ignoreLeadingWhiteSpace=True)


def read_dimension(spark: SparkSession, paths: str | list[str], schema: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    return _csv(spark, paths, schema, header=header)


def read_samples(spark: SparkSession, paths: str | list[str], header: bool = False) -> tuple[DataFrame, DataFrame]:
    return read_dimension(spark, paths, schemas.SAMPLES, header)


def expand_csv_field(df: DataFrame, field: str, schema: str) -> DataFrame:
    """Rows of the CSV text held in ``field``; its first line is a header, empty lines are skipped."""
    lines = F.filter(F.split(F.col(field), "\n"), lambda x: F.length(F.trim(x)) > 0)
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    options = {"ignoreLeadingWhiteSpace": "true"}
    rows = df.select(*[c for c in df.columns if c != field], F.posexplode(body).alias("row_no", "__line"))
    return rows.withColumn("__row", F.from_csv("__line", schema, options)).select(
        *[c for c in rows.columns if c != "__line"], "__row.*"
    )


def read_annotations(spark: SparkSession, paths: str | list[str], from_path: bool = True) -> tuple[DataFrame, DataFrame]:
    """Box annotations (XML) as (good, rejects).

    With ``from_path`` the image name is the file's base name and the class its folder; the name
    inside the document is not reliable. A large file is read in chunks by several tasks; files are listed when this is
    called.
    """
    fields = f"{schemas.ANNOTATION}, synset string, _corrupt string"
    records = read_records(spark, paths, "annotation").select(uri(F.col("path")).alias("source_file"), F.col("content").cast("string").alias("text"))
    parsed = F.from_xml("text", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # Behind a generator the parse runs once; a plain column is worked out again for each field the filters ask for.
    raw = records.select(F.inline(F.array(parsed)), "source_file")
    good, rejects = _split_rejects(raw, "source_file")
    if from_path:
        base = F.regexp_extract("source_file", r"([^/]*?)(?:\.[^./]*)?$", 1)
        good = good.withColumn("filename", F.concat(base, F.lit(".JPEG"))).withColumn(
            "synset", F.regexp_extract("source_file", r"([^/]+)/[^/]+$", 1)
        )
    return good, rejects


def read_annotation_files(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Box annotations, one file each, as (boxes, rejects); tags are found by their place in the whole file.

    The first ``name``, ``width`` and ``height`` anywhere in a file are those of all its boxes. Box i has the i-th ``xmin``,
    ``ymin``, ``xmax`` and ``ymax`` of the file, whatever they are nested in; boxes end at the first xmin that is missing
    or reads as -1, and any other missing value reads as -1. The image's name and class are the file's
    name and folder. A file that is no well-formed document is a reject with its text. Files are listed when this is
    called.
    """
    whole = read_whole(spark, paths, unpack=True).select(uri(F.col("path")).alias("source_file"), F.col("content").cast("string").alias("text"))
    parsed = F.from_xml("text", "_corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    judged = whole.withColumn("__bad", F.coalesce(parsed["_corrupt"].isNotNull(), F.lit(True)))
    # Outside good files the document is empty, since XPath fails the job on one that does not parse.
    text = F.when(F.col("__bad"), F.lit("<none/>")).otherwise(F.col("text"))
    tags = ["name", "width", "height", "xmin", "ymin", "xmax", "ymax"]
    found = judged.filter(~F.col("__bad")).select("source_file", *[F.xpath(text, F.lit(f"//{t}/text()")).alias(t) for t in tags])
    marks = F.transform("xmin", int_of)
    stop = F.array_position(marks, F.lit(-1))
    corner = lambda c, i: int_of(F.get(F.col(c), i))
    box = lambda x, i: F.struct(i.alias("box_no"), *[corner(c, i).alias(c) for c in tags[3:]])
    each = F.transform(F.when(stop > 0, F.slice("xmin", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("xmin")), box)
    base = F.regexp_extract("source_file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    boxes = found.select(
        F.concat(base, F.lit(".JPEG")).alias("filename"), F.regexp_extract("source_file", r"([^/]+)/[^/]+$", 1).alias("synset"),
        F.get("name", F.lit(0)).alias("box_label"), *[int_of(F.get(c, F.lit(0))).alias(c) for c in ("width", "height")], F.explode(each).alias("__box"),
    )
    return boxes.select("filename", "synset", "box_label", "width", "height", "__box.*"), judged.filter("__bad").select("source_file", "text")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines with their file and 0-based number in it: (file, line_no, value).

    A large file is read in splits. Lines are numbered inside their split, and each split starts
    where the ones before it end, so no file has to pass through one task.
    """
    raw = (
        spark.read.text(paths)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
        .withColumn("__id", F.monotonically_increasing_id())
    )
    sizes = raw.groupBy("file", "at").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "at", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("file", "at").orderBy("__id")
    return (
        raw.withColumn("__row", F.row_number().over(inside) - 1)
        .join(starts, ["file", "at"])
        .select("file", (F.col("__start") + F.col("__row")).alias("line_no"), "value")
    )


def read_ordered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with their 0-based ``position`` over all files, taken in order of their paths."""
    lines = read_lines(spark, paths)
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("__n"))
    # One row per file.
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    return lines.join(starts, "file").select("value", (F.col("__start") + F.col("line_no")).alias("position"))


def read_label_list(spark: SparkSession, path: str) -> DataFrame:
    """Ordered class list: (synset, label, line_no); label 0 stays free for background."""
    number = (F.col("position") + 1).cast("bigint")
    return read_ordered_lines(spark, path).select(
        F.trim("value").alias("synset"), number.alias("label"), number.alias("line_no")
    )


def read_synset_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Tab map; a line without exactly two fields fails the job."""
    parts = F.split(F.trim(F.col("value")), "\t")
    return (
        spark.read.text(paths)
        .filter(F.length("value") > 0)
        .withColumn("parts", parts)
        .withColumn(
            "parts",
            F.when(F.size("parts") == 2, F.col("parts")).otherwise(
                F.raise_error(F.concat(F.lit("two fields expected: "), F.col("value")))
            ),
        )
        .select(F.col("parts")[0].alias("synset"), F.col("parts")[1].alias("text"))
    )


def read_boxes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Box lines of five fields; any other line fails the job."""
    return spark.read.schema(schemas.BOXES).csv(paths, mode="FAILFAST")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path and size of files below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length")
    )


def read_images(spark: SparkSession, root: str, pattern: str = "*.JPEG") -> DataFrame:
    """Image files with class from their folder: (filename, synset, path, encoded). They are listed when this is called."""
    return read_whole(spark, root, recursive=True, pattern=pattern).select(
        F.substring_index("path", "/", -1).alias("filename"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("synset"),
        "path",
        F.col("content").alias("encoded"),
    )


def read_step_log(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Step records, one JSON object per line, as (good, rejects)."""
    reader = spark.read.schema(f"{schemas.STEP_LOG.strip().rstrip(',')}, _corrupt string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    good, rejects = _split_text(reader.json(paths))
    return good.withColumn("ts", F.to_timestamp("@timestamp")), rejects


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
