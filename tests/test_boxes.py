"""Annotations, box normalisation, box lists and the corpus."""

import gzip
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from fathomry.operators import boxes as B
from fathomry.plans import corpus
from fathomry.session import shared_root
from fathomry.sources import files, readers

XML = """<annotation><folder>{folder}</folder><filename>%s</filename><size><width>{w}</width><height>{h}</height></size>{objects}</annotation>"""
OBJECT = "<object><name>{name}</name><bndbox><xmin>{a}</xmin><ymin>{b}</ymin><xmax>{c}</xmax><ymax>{d}</ymax></bndbox></object>"


def objects(*items):
    return "".join(OBJECT.format(name=n, a=a, b=b, c=c, d=d) for n, a, b, c, d in items)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("xml")
    files = {
        "n1/one.xml": XML.format(folder="n1", w=100, h=50, objects=objects(("n1", 10, 10, 50.7, 40), ("n2", 60, 0, 20, 60))),
        "n1/stop.xml": XML.format(folder="n1", w=100, h=100, objects=objects(("n1", 1, 1, 2, 2), ("n1", -1, 0, 5, 5), ("n1", 1, 1, 9, 9))),
        "n1/foreign.xml": XML.format(folder="n1", w=10, h=10, objects=objects(("n2", 1, 1, 5, 5))),
        "n2/dog.xml": XML.format(folder="n2", w=10, h=10, objects=objects(("deerhound", 1, 1, 5, 5))),
        "n2/empty.xml": XML.format(folder="n2", w=10, h=10, objects=""),
        "n3/other.xml": XML.format(folder="n3", w=10, h=10, objects=objects(("n3", 1, 1, 5, 5))),
        "n1/flat.xml": XML.format(folder="n1", w=10, h=10, objects=objects(("n1", 20, 1, 30, 5))),
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    return str(root)


def test_normalised_boxes_from_files(spark, folder):
    good, _ = readers.read_annotations(spark, f"{folder}/*/*.xml")
    synsets = spark.createDataFrame([("n1",), ("n2",)], "synset string")
    got = {
        (r.filename, r.xmin, r.ymin, r.xmax, r.ymax)
        for r in B.normalise_boxes(good, synsets).collect()
    }
    assert got == {
        ("one.JPEG", 0.1, 0.2, 0.5, 0.8), ("one.JPEG", 0.2, 0.0, 0.6, 1.0),  # ordered and clamped
        ("stop.JPEG", 0.01, 0.01, 0.02, 0.02),  # the list ends at xmin -1
        ("dog.JPEG", 0.1, 0.1, 0.5, 0.5),  # unknown label text is kept
    }
    everything = B.normalise_boxes(good)
    assert {r.filename for r in everything.collect()} == {"one.JPEG", "stop.JPEG", "foreign.JPEG", "dog.JPEG", "other.JPEG"}


def test_counters_of_a_run(spark, folder):
    good, _ = readers.read_annotations(spark, f"{folder}/*/*.xml")
    seen = Observation("boxes")
    synsets = spark.createDataFrame([("n1",), ("n2",)], "synset string")
    assert B.count_boxes(good, synsets, seen).count() == 4
    assert seen.get == {"saved_boxes": 4, "skipped_boxes": 2}


def test_broken_annotation_is_reported(spark, tmp_path):
    (tmp_path / "n1").mkdir()
    (tmp_path / "n1" / "bad.xml").write_text("<annotation><filename>x</filename><size><width>1</size></annotation>")
    (tmp_path / "n1" / "fine.xml").write_text(XML.format(folder="n1", w=1, h=1, objects=objects(("n1", 0, 0, 1, 1))))
    good, rejects = readers.read_annotations(spark, f"{tmp_path}/*/*.xml")
    assert [r.filename for r in good.collect()] == ["fine.JPEG"]
    assert rejects.count() == 1


def test_one_row_per_image_however_many_boxes(spark):
    rng = random.Random(5)
    rows = [("hot.JPEG", rng.random(), 0.0, 1.0, 1.0) for _ in range(900)]
    rows += [("hot.JPEG", 0.25, 0.25, 0.75, 0.75)] * 700  # one box many times
    rows += [(f"{i % 40}.JPEG", 0.1, 0.1, rng.choice([0.5, 0.6]), 0.5) for i in range(800)]
    boxes = spark.createDataFrame(rows, "filename string, xmin double, ymin double, xmax double, ymax double")
    got = B.collect_boxes(boxes).collect()
    assert Counter((r.filename, *b) for r in got for b in r.boxes) == Counter(rows)
    assert len(got) == len({r.filename for r in got}) == 41
    assert all(list(r.boxes) == sorted(r.boxes) for r in got)


def test_box_line_without_a_coordinate_is_null(spark):
    df = spark.createDataFrame([("a", 0.1, None, 0.3, 0.4), ("b", 0.1, 0.2, 0.3, 0.4)], "filename string, xmin double, ymin double, xmax double, ymax double")
    assert [r[0] for r in df.select(B.box_line()).collect()] == [None, "b,0.1000,0.2000,0.3000,0.4000"]


def test_image_without_a_size_fails(spark):
    df = spark.createDataFrame([(0, 10, 1, 2, 3, 4)], "width int, height int, xmin int, ymin int, xmax int, ymax int")
    with pytest.raises(PySparkException, match="image without width"):
        B.scale_boxes(df).collect()


@pytest.fixture(scope="module")
def parts(spark):
    images = spark.createDataFrame(
        [(f"{s}_{i}.JPEG", s, 10, 20, bytes([i])) for i in range(30) for s in ("n1", "n2", "n9")],
        "filename string, synset string, height bigint, width bigint, encoded binary",
    )
    labels = spark.createDataFrame([("n1", 1), ("n2", 2)], "synset string, label bigint")
    texts = spark.createDataFrame([("n1", "cat"), ("n2", "dog")], "synset string, text string")
    boxes = spark.createDataFrame([("n1_3.JPEG", 0.1, 0.2, 0.3, 0.4)] * 2, "filename string, xmin double, ymin double, xmax double, ymax double")
    return images, labels, texts, boxes


def test_corpus(spark, parts):
    built = corpus.build_corpus(*parts, shards=7).collect()
    assert len(built) == 60 and {r.synset for r in built} == {"n1", "n2"}
    assert sorted(r.position for r in built) == list(range(60))
    cuts = [k * 60 // 7 for k in range(8)]
    for r in built:
        assert cuts[r.shard] <= r.position < cuts[r.shard + 1]
        assert len(r.bbox_xmin) == len(r.bbox_label) == (2 if r.filename == "n1_3.JPEG" else 0)


def test_corpus_needs_a_text_for_every_class(spark, parts):
    images, labels, texts, boxes = parts
    with pytest.raises(PySparkException, match="no entry for: n2"):
        corpus.build_corpus(images, labels, texts.filter("synset = 'n1'"), boxes, 4).collect()


def test_corpus_needs_unique_file_names(spark, parts):
    images, *rest = parts
    with pytest.raises(PySparkException, match="key is not unique"):
        corpus.build_corpus(images.union(images), *rest, 4).collect()


def test_images_must_match_their_record(spark):
    df = spark.createDataFrame([("a", "JPEG", 1, 2, 1, 2), ("b", "PNG", 1, 2, 1, 2)], "filename string, format string, height int, width int, stored_height int, stored_width int")
    assert [r.filename for r in corpus.image_rejects(df).collect()] == ["b"]
    with pytest.raises(PySparkException, match="does not match"):
        corpus.check_images(df).collect()


@pytest.mark.parametrize("total,shards", [(10, 3), (100, 7), (5, 8), (64, 64)])
def test_shard_cuts(spark, total, shards):
    got = spark.range(total).select(corpus.shard_of(F.col("id"), F.lit(total), shards).alias("s")).collect()
    want = [next(k for k in range(shards) if k * total // shards <= p < (k + 1) * total // shards) for p in range(total)]
    assert [r.s for r in got] == want


def test_large_annotation_file_is_read_in_chunks(spark, tmp_path, monkeypatch):
    # Before, a file went through one task whatever its size.
    one = XML.format(folder="n1", w=9, h=8, objects=objects(("n1", 1, 1, 2, 2)))
    docs = [(one % f"f{i}").replace("<annotation>", "<annotation >" if i % 3 else '<annotation verified="yes">').replace("</annotation>", "</annotation >" if i % 2 else "</annotation>") for i in range(60)]
    broken = "<annotation><size><width>1</size></annotation>"
    (tmp_path / "all.xml").write_text("<annotations>\n  " + "\n  ".join([*docs[:30], broken, *docs[30:]]) + "\n<annotation><filename>cut</filename></annotations>")
    for size in (16 << 20, 700, 37):
        monkeypatch.setattr(files, "CHUNK", size)
        good, rejects = readers.read_annotations(spark, str(tmp_path / "all.xml"), from_path=False)
        assert sorted(r.filename for r in good.collect()) == sorted(f"f{i}" for i in range(60))
        assert {(r.size.width, r.size.height, len(r.object)) for r in good.collect()} == {("9", "8", 1)}
        assert rejects.count() == 2
    assert files.read_records(spark, str(tmp_path / "all.xml"), "annotation").count() == 62


def test_packed_annotations_are_read_bit_by_bit(spark, tmp_path, monkeypatch):
    # Before, a packed file was unpacked whole in one task.
    one = XML.format(folder="n1", w=9, h=8, objects=objects(("n1", 1, 1, 2, 2)))
    docs = [(one % f"f{i}").replace("</annotation>", "</annotation >" if i % 2 else "</annotation>") for i in range(60)]
    broken = "<annotation><size><width>1</size></annotation>"
    text = "<annotations>\n  " + "\n  ".join([*docs[:30], broken, *docs[30:]]) + "\n<annotation><filename>cut</filename></annotations>"
    (tmp_path / "all.xml.gz").write_bytes(gzip.compress(text[:4000].encode()) + gzip.compress(text[4000:].encode()))
    (tmp_path / "none.xml.gz").write_bytes(gzip.compress(b""))
    for size in (16 << 20, 700, 37):
        monkeypatch.setattr(files, "CHUNK", size)
        good, rejects = readers.read_annotations(spark, str(tmp_path), from_path=False)
        assert sorted(r.filename for r in good.collect()) == sorted(f"f{i}" for i in range(60))
        assert rejects.count() == 2


def test_annotations_are_parsed_once_and_staged_packed(spark, sf):
    # Before, a record was parsed for each field a filter asked for, and the staged text took 680 bytes a record.
    from fathomry.catalog import CATALOG

    root = Path(shared_root(spark).removeprefix("file://"))
    folders = set(root.glob("annotations-*"))
    found = CATALOG["s12_xml_annotations"].run(spark, sf)
    assert found._jdf.queryExecution().executedPlan().toString().count("from_xml(") == 1
    (folder,) = set(root.glob("annotations-*")) - folders
    assert sum(x.stat().st_size for x in folder.iterdir()) < 100 * found.count()
