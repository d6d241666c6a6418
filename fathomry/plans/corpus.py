"""Labelled image corpus: listing, labels, boxes, repeatable shuffle and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomry.operators.boxes import box_lists, collect_boxes
from fathomry.operators.lookups import require_lookup, spread_join, with_label_index
from fathomry.operators.ordered import ordered_positions, shuffled_positions

# Images known to be stored as PNG, or as JPEG in CMYK colour.
PNG_IMAGES = ["n02105855_2933.JPEG"]
CMYK_IMAGES = [
    "n01739381_1309.JPEG", "n02077923_14822.JPEG", "n02447366_23489.JPEG", "n02492035_15739.JPEG",
    "n02747177_10752.JPEG", "n03018349_4028.JPEG", "n03062245_4620.JPEG", "n03347037_9675.JPEG",
    "n03467068_12171.JPEG", "n03529860_11437.JPEG", "n03544143_17228.JPEG", "n03633091_5218.JPEG",
    "n03710637_5125.JPEG", "n03961711_5286.JPEG", "n04033995_2932.JPEG", "n04258138_17003.JPEG",
    "n04264628_27969.JPEG", "n04336792_7448.JPEG", "n04371774_5854.JPEG", "n04596742_4225.JPEG",
    "n07583066_647.JPEG", "n13037406_4650.JPEG",
]

# Shuffle seed, colour layout and the largest raw image the encoder accepts.
SEED = 12345
COLORSPACE, CHANNELS, FORMAT = "RGB", 3, "JPEG"
MAX_RAW_BYTES = 2**29 - 1


def shard_of(position: str | Column, total: str | Column, shards: int) -> Column:
    """Shard holding a position when shard k starts at floor(k * total / shards)."""
    p = F.col(position) if isinstance(position, str) else position
    n = F.col(total) if isinstance(total, str) else total
    return F.floor(((p + 1) * F.lit(shards) - 1) / n).cast("int")


def with_shards(df: DataFrame, key: str, shards: int, seed: int = SEED) -> DataFrame:
    placed = shuffled_positions(df, key, seed)
    return placed.withColumn("shard", shard_of("position", "total", shards)).drop("total")


def round_robin(df: DataFrame, order: list[str], workers: int, out: str = "worker") -> DataFrame:
    """Deal rows in sorted order to ``workers``, one each in turn."""
    placed = ordered_positions(df, order)
    return placed.withColumn(out, F.pmod(F.col("position"), F.lit(workers)).cast("int"))


def is_png(path: str = "filename", listed: list[str] = PNG_IMAGES) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in listed]), lambda x: F.col(path).contains(x))


def is_cmyk(path: str = "filename", listed: list[str] = CMYK_IMAGES) -> Column:
    return F.substring_index(F.col(path), "/", -1).isin(listed)


def with_boxes(images: DataFrame, boxes: DataFrame, key: str = "filename") -> DataFrame:
    """Attach the box array, empty where an image has none."""
    lists = collect_boxes(boxes, key)
    empty = F.array().cast(lists.schema["boxes"].dataType)
    return spread_join(images, lists, [key]).withColumn("boxes", F.coalesce("boxes", empty))


def build_corpus(
    images: DataFrame, labels: DataFrame, texts: DataFrame, boxes: DataFrame, shards: int, seed: int = SEED
) -> DataFrame:
    """Image records with label, text, boxes and shard.

    Image bytes are the wide column, so everything else is worked out on file names alone and the
    bytes join last, with the finished shard number.
    """
    slim = images.select("filename", "synset")
    placed = with_shards(with_label_index(slim, labels), "filename", shards, seed)
    texted = require_lookup(placed, texts.select("synset", "text"), "synset", "text")
    listed = box_lists(with_boxes(texted, boxes))
    rest = images.drop("synset")
    return listed.join(rest, "filename").withColumns(
        {
            "colorspace": F.lit(COLORSPACE),
            "channels": F.lit(CHANNELS).cast("bigint"),
            "format": F.lit(FORMAT),
        }
    )


def resize_plan(df: DataFrame, factor: float, channels: int = CHANNELS) -> DataFrame:
    """New height and width; the factor is lowered where the raw image would be too large."""
    raw = F.col("height").cast("double") * F.col("width") * channels
    limit = F.sqrt(F.lit(float(MAX_RAW_BYTES)) / raw)
    used = F.lit(1.0) if factor == 1.0 else F.least(F.lit(float(factor)), limit)
    return df.withColumn("factor", used).withColumns(
        {
            "new_height": (F.col("height") * F.col("factor")).cast("int"),
            "new_width": (F.col("width") * F.col("factor")).cast("int"),
        }
    )


def check_images(df: DataFrame) -> DataFrame:
    """Fail the job on a record whose declared format or size differs from the stored one."""
    same = (
        (F.col("format") == FORMAT)
        & (F.col("height") == F.col("stored_height"))
        & (F.col("width") == F.col("stored_width"))
    )
    return df.withColumn(
        "valid",
        F.when(F.coalesce(same, F.lit(False)), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("image does not match its record: "), F.col("filename")))
        ),
    )


def image_rejects(df: DataFrame) -> DataFrame:
    """The records ``check_images`` would stop at."""
    same = (
        (F.col("format") == FORMAT)
        & (F.col("height") == F.col("stored_height"))
        & (F.col("width") == F.col("stored_width"))
    )
    return df.filter(~F.coalesce(same, F.lit(False)))
