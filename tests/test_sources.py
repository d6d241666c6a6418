"""Readers on real files: headers, dates, malformed input, splits."""

import bz2
import json

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from fathomry.plans import results
from fathomry.session import fresh_dir, shared_root
from fathomry.sources import files, readers, writers


def test_performance_dates_and_header(spark, tmp_path):
    line = "|".join(["7", "03/01/2001", "BANK", "6.5", "100.0", *[""] * 5, "2", *[""] * 20])
    (tmp_path / "p.txt").write_text("header" + "|" * 30 + "\n" + line + "\n")
    row = readers.read_performance(spark, str(tmp_path), header=True)[0].first()
    assert (row.loan_id, str(row.monthly_reporting_period), row.current_loan_delinquency_status, row.mod_flag) == (7, "2001-03-01", 2, None)
    assert len(row) == 31


def test_result_lists_and_malformed_files(spark, tmp_path):
    records = [
        {"test_uuid": "a", "error": False, "np": 2, "output": "total images/sec: 4.5\n", "data_dir_suffix": "", "utc_begin": "2019-10-24T14:00:00Z"},
        {"test_uuid": "b", "error": True},
        {"test_uuid": "c", "error": None, "np": 1},
    ]
    (tmp_path / "good.json.bz2").write_bytes(bz2.compress(json.dumps(records).encode()))
    (tmp_path / "bad.json.bz2").write_bytes(bz2.compress(b'[{"test_uuid": "x", '))
    (tmp_path / "odd.json.bz2").write_bytes(bz2.compress(b'[{"test_uuid": "y", "np": "many"}]'))
    good, rejects = readers.read_results(spark, f"{tmp_path}/*.json.bz2")
    assert sorted(r.test_uuid for r in good.select("test_uuid").collect()) == ["a", "b", "c"]
    assert rejects.count() == 2
    clean = results.clean_training_results(good, results.suffix_dimension(spark), "nfs").collect()
    assert [(r.test_uuid, r.images_per_sec_per_gpu, r.num_copies, r.storage_type) for r in clean] == [("a", 2.25, 1.0, "nfs")]
    assert clean[0].loaded_filename.endswith("good.json.bz2")


def test_unmatched_batch_fails(spark, tmp_path):
    with pytest.raises(PySparkException):
        readers.read_batches(spark, [f"{tmp_path}/nothing/*.orc"])


def test_box_and_text_lines_are_checked(spark, tmp_path):
    (tmp_path / "boxes.csv").write_text("a.JPEG,0.1,0.2,0.3\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        readers.read_boxes(spark, str(tmp_path / "boxes.csv")).collect()
    (tmp_path / "texts.txt").write_text("n1\tcat\nn2 dog\n")
    with pytest.raises(PySparkException, match="two fields expected"):
        readers.read_synset_texts(spark, str(tmp_path / "texts.txt")).collect()


def test_line_numbers_over_splits(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = readers.read_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() >= 1
        got = {r.line_no: r.value for r in lines.collect()}
        splits = spark.read.text(str(path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert splits > 5
    assert got == {i: f"line {i}" for i in range(5000)}


def test_ordered_label_list_over_files(spark):
    path = fresh_dir(spark, "labels")
    names = [f"n{i:03d}" for i in range(100)]
    spark.createDataFrame([(n,) for n in reversed(names)], "v string").repartitionByRange(5, "v").sortWithinPartitions("v").write.text(path)
    got = {r.synset: r.label for r in readers.read_label_list(spark, path).collect()}
    assert got == {n: i + 1 for i, n in enumerate(names)}


def test_csv_field(spark):
    df = spark.createDataFrame([(1, "a, b\n1, x\n2, y\n"), (2, "a, b\n"), (3, "")], "id int, out string")
    rows = readers.expand_csv_field(df, "out", "a int, b string").collect()
    assert [(r.id, r.row_no, r.a, r.b) for r in rows] == [(1, 0, 1, "x"), (1, 1, 2, "y")]


def test_image_folders(spark, tmp_path):
    for name in ("n1/a.JPEG", "n2/b.JPEG", "n2/skip.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    got = {(r.filename, r.synset, len(r.encoded)) for r in readers.read_images(spark, str(tmp_path)).collect()}
    assert got == {("a.JPEG", "n1", 5), ("b.JPEG", "n2", 5)}
    assert readers.list_files(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == 15


def test_hot_folder_is_written_whole(spark):
    df = spark.range(3000).withColumn("synset", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("n"), F.col("id") % 20)))
    back = spark.read.parquet(writers.write_by_folder(df, fresh_dir(spark, "folders"), "synset"))
    assert back.count() == 3000 and back.filter("synset = 'hot'").count() == 1000


def test_scans_are_pruned(spark, sf):
    plan = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_quantity > 49").groupBy("l_returnflag").agg(F.max("l_discount"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in text
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_returnflag:string>" in text


def test_shared_folder_is_the_sessions(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_files_are_found_and_read_in_tasks(spark, tmp_path):
    # Before, the driver held the name of every file, and a task was planned for every few.
    names = ["n1/a b%#é.xml", "n1/deep/below.xml", "n1/_hidden.xml", "n1/.x.xml", "n2/b.xml", "n2/c.txt", "k=v/d.xml"]
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(name)

    def found(paths, **more):
        return sorted((r.path, bytes(r.content).decode()) for r in files.read_whole(spark, paths, **more).collect())

    def want(*names):
        return sorted((f"file:{tmp_path}/{n}", n) for n in names)

    assert found(f"{tmp_path}/*/*.xml") == want("n1/a b%#é.xml", "n2/b.xml", "k=v/d.xml")
    assert found([f"file://{tmp_path}/n[2-3]", f"{tmp_path}/n1/deep/below.xml"]) == want("n2/b.xml", "n2/c.txt", "n1/deep/below.xml")
    assert found(str(tmp_path), recursive=True, pattern="*.{xml,tx}") == want("n1/a b%#é.xml", "n1/deep/below.xml", "n2/b.xml", "k=v/d.xml")
    assert found(str(tmp_path)) == want("k=v/d.xml")
    plain = spark.read.text(f"{tmp_path}/*/*.xml", wholetext=True).select(F.col("_metadata.file_path").alias("f"))
    assert {r[0] for r in files.read_whole(spark, f"{tmp_path}/*/*.xml").select(files.uri(F.col("path"))).collect()} == {r.f for r in plain.collect()}
    for missing in (f"{tmp_path}/none", f"{tmp_path}/*/none*"):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            files.read_whole(spark, missing)
    for frame in (readers.read_images(spark, str(tmp_path), "*.xml"), *readers.read_annotation_files(spark, f"{tmp_path}/*/*.xml")):
        assert not frame.inputFiles() or not any(f.endswith(".xml") for f in frame.inputFiles())


def test_files_of_a_small_table_are_written_by_many_tasks(spark, tmp_path):
    # Before, a table of one partition wrote all of its files in one task.
    df = spark.range(200).coalesce(1).select(F.concat(F.col("id") % 3, F.lit("/"), F.col("id")).alias("path"), F.col("id").cast("string").alias("bytes"))
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("files", "files")
    writers.write_files(df, str(tmp_path / "out"))
    stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup("files") for s in seen.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= 16
    assert {(r.synset, r.filename, bytes(r.encoded)) for r in readers.read_images(spark, str(tmp_path / "out"), "*").collect()} == {(str(i % 3), str(i), str(i).encode()) for i in range(200)}
