"""Bounding boxes: from annotation documents to normalised boxes and per-image lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomry.functions.text import fixed_text
from fathomry.operators.lookups import spread_join

COORDS = ["xmin", "ymin", "xmax", "ymax"]


def int_of(text: str | Column) -> Column:
    """Integer part of a number written as text, e.g. ``'12.7'``; a missing value reads as -1."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.try_cast("double").try_cast("int"), F.lit(-1))


def annotation_boxes(annotations: DataFrame) -> DataFrame:
    """One row per box of an annotation document.

    Every box takes the document's first name, width and height, and the boxes end at the first
    one whose xmin reads as -1.
    """
    objects = F.coalesce(F.col("object"), F.array())
    marks = F.transform(objects, lambda o: int_of(o["bndbox"]["xmin"]))
    stop = F.array_position(marks, F.lit(-1))
    kept = F.when(stop > 0, F.slice(objects, 1, (stop - 1).cast("int"))).otherwise(objects)
    rows = annotations.withColumn("__name", F.try_element_at(objects, F.lit(1))["name"]).select(
        "*", F.posexplode(kept).alias("box_no", "__box")
    )
    return rows.select(
        *[c for c in annotations.columns if c not in ("object", "size")],
        F.col("box_no"),
        F.col("__name").alias("box_label"),
        int_of(F.col("size.width")).alias("width"),
        int_of(F.col("size.height")).alias("height"),
        *[int_of(F.col(f"__box.bndbox.{c}")).alias(c) for c in COORDS],
    )


def scale_boxes(boxes: DataFrame) -> DataFrame:
    """Order the ends of each axis, divide by the image size and clamp to 0..1.

    A width or height of zero fails the job.
    """

    def axis(low: str, high: str, size: str) -> dict[str, Column]:
        length = F.when(F.col(size) == 0, F.raise_error(F.lit(f"image without {size}")).cast("double")).otherwise(F.col(size).cast("double"))
        a, b = F.col(low).cast("double") / length, F.col(high).cast("double") / length
        clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
        return {low: clamp(F.least(a, b)), high: clamp(F.greatest(a, b))}

    return boxes.withColumns({**axis("xmin", "xmax", "width"), **axis("ymin", "ymax", "height")})


def has_area() -> Column:
    return (F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax"))


def drop_degenerate(boxes: DataFrame) -> DataFrame:
    return boxes.filter(has_area())


def with_foreign_label(boxes: DataFrame, synsets: DataFrame, synset: str = "synset", box_label: str = "box_label") -> DataFrame:
    """Flag ``foreign``: the box names another class that is itself listed. Unknown text is not foreign."""
    known = synsets.select(F.col(synset).alias(box_label)).distinct().withColumn("__known", F.lit(True))
    foreign = F.coalesce(F.col("__known") & (F.col(box_label) != F.col(synset)), F.lit(False))
    return spread_join(boxes, known, [box_label]).withColumn("foreign", foreign).drop("__known")


def drop_foreign_label(boxes: DataFrame, synsets: DataFrame, **names: str) -> DataFrame:
    return with_foreign_label(boxes, synsets, **names).filter(~F.col("foreign")).drop("foreign")


def normalise_boxes(annotations: DataFrame, synsets: DataFrame | None = None) -> DataFrame:
    """Boxes ready for the corpus: listed classes only, own labels only, scaled, with an area.

    ``annotations`` carries ``filename`` and ``synset`` (the class folder) beside the document.
    """
    if synsets is not None:
        annotations = annotations.join(synsets.select("synset"), "synset", "left_semi")
    boxes = scale_boxes(annotation_boxes(annotations))
    if synsets is not None:
        boxes = drop_foreign_label(boxes, synsets)
    return drop_degenerate(boxes)


def box_line(filename: str = "filename") -> Column:
    """Text line of a box: file name and four coordinates with four decimals; null if one of them is."""
    return F.concat(F.col(filename), *[F.concat(F.lit(","), fixed_text(c)) for c in COORDS])


def _judged(annotations: DataFrame, synsets: DataFrame) -> DataFrame:
    """Scaled boxes of listed classes with ``good``: of the file's own or an unlisted label, and with an area."""
    listed = annotations.join(synsets.select("synset").distinct(), "synset", "left_semi")
    boxes = with_foreign_label(scale_boxes(annotation_boxes(listed)), synsets)
    return boxes.withColumn("good", ~F.col("foreign") & F.coalesce(has_area(), F.lit(False)))


def count_boxes(annotations: DataFrame, synsets: DataFrame, observation) -> DataFrame:
    """``normalise_boxes`` that also reports saved and skipped boxes through an ``Observation``."""
    saved, skipped = F.count_if("good").alias("saved_boxes"), F.count_if(~F.col("good")).alias("skipped_boxes")
    return _judged(annotations, synsets).observe(observation, saved, skipped).filter("good").drop("good", "foreign")


def count_annotations(annotations: DataFrame, synsets: DataFrame, by: str | None = None) -> DataFrame:
    """Saved and skipped boxes and files of an annotation run, in all or for each value of column ``by``.

    A box is skipped for the label of another listed class or for want of an area; a file for a class that is not
    listed, or when it has no box left. Boxes of files whose class is not listed are not looked at. ``filename``
    names a file.
    """
    group = [] if by is None else [by]
    of_file = {"boxes": F.count("good"), "saved": F.count_if("good"), "foreign": F.count_if(F.coalesce("foreign", F.lit(False)))}
    counted = _judged(annotations, synsets).groupBy("filename").agg(*[c.alias(n) for n, c in of_file.items()])
    files = annotations.select("filename", *group).distinct()
    rows = spread_join(files, counted, ["filename"]).fillna(0, list(of_file))
    return rows.groupBy(*group).agg(
        F.sum("saved").alias("saved_boxes"),
        F.sum(F.col("boxes") - F.col("saved")).alias("skipped_boxes"),
        F.sum("foreign").alias("foreign_boxes"),
        F.count_if(F.col("saved") > 0).alias("saved_files"),
        F.count_if(F.col("saved") == 0).alias("skipped_files"),
    )


def collect_boxes(boxes: DataFrame, key: str = "filename") -> DataFrame:
    """Boxes of each image as a sorted array, duplicates kept: (key, boxes), one row per image.

    Equal boxes are counted before the shuffle, so copies of a box do not meet in one task. The array is
    the image's record; where boxes are not needed as an array, work on the rows themselves.
    """
    counted = boxes.groupBy(key, *COORDS).agg(F.count(F.lit(1)).cast("int").alias("__n"))
    runs = F.sort_array(F.collect_list(F.struct(F.struct(*COORDS).alias("box"), "__n")))
    repeated = F.flatten(F.transform("__runs", lambda r: F.array_repeat(r["box"], r["__n"])))
    return counted.groupBy(key).agg(runs.alias("__runs")).select(key, repeated.alias("boxes"))


def box_lists(df: DataFrame, label: str = "label") -> DataFrame:
    """Turn the box array into four parallel float lists and one repeated label list."""
    # Field access on an array of structs gives the array of that field.
    lists = {f"bbox_{c}": F.col(f"boxes.{c}").cast("array<float>") for c in COORDS}
    repeated = F.array_repeat(F.col(label).cast("bigint"), F.size("boxes"))
    return df.withColumns({**lists, "bbox_label": repeated}).drop("boxes")
