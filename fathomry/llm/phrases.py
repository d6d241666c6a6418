"""Operator 3: benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index stores one posting (term, document, position) for each training token that is a word of some test
item; other tokens can be in no match. Test items are cut into windows of consecutive words. Of each window
the two terms with the fewest postings lead: the list of the rarest, shifted by its place in the item, is
intersected with the shifted list of the second, on document and position; only what is left meets the lists
of the other terms. A window with all its terms in place is an exact phrase match. Leading terms that stand
in the document nearly as far from each other as in the item are a proximity match.

Test items are far fewer than documents. Still, what is derived from them is broadcast only while it has at
most ``SMALL`` rows; beyond that Spark joins by shuffle, with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomry.llm.texts import ascii_lower
from fathomry.session import fresh_dir

WINDOW = 10
SMALL = 500_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOC = ["doc", "sum"]


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, of bounded width, are few."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _split(text: Column) -> Column:
    """Words, with an empty one in front or at the end where the text begins or ends with something else."""
    return F.split(ascii_lower(text), BETWEEN)


def _shift() -> Column:
    return (F.element_at("split", 1) == "").cast("int")


def _n_words() -> Column:
    tail = ((F.size("split") > 1) & (F.element_at("split", -1) == "")).cast("int")
    return (F.size("split") - _shift() - tail).cast("long")


def _name(key: str, text: str) -> list[Column]:
    """doc and sum, 128 bits that name a row by its key (null apart) and its whole text."""
    own, whole = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return [F.xxhash64(whole, own, own.isNull()).alias("doc"), F.xxhash64(F.md5(whole.cast("binary")), own, own.isNull()).alias("sum")]


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{key}`").alias("id"), *_name(key, text), _split(whole).alias("split"))


@dataclass
class Index:
    """``postings``: term, doc, sum, pos. ``counts``: term, df. ``rows``: id, doc, sum, n_words of every document."""

    postings: DataFrame
    counts: DataFrame
    rows: DataFrame
    windows: DataFrame
    folder: str


def _item_words(items: DataFrame, key: str, text: str) -> DataFrame:
    """item, place (of the item's row), ipos, term, n."""
    split = items.filter(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("string").alias("item"),
        F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("place"),
        _split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("split"),
    ).distinct()
    words = split.select("item", "place", _shift().alias("shift"), _n_words().cast("int").alias("n"), F.posexplode("split").alias("at", "word"))
    return words.filter(F.col("word") != "").select("item", "place", (F.col("at") - F.col("shift")).alias("ipos"), "word", "n")


def build_index(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> Index:
    """Postings of all documents for the words of ``items``, and the items' windows with their leading terms."""
    folder = fresh_dir(docs.sparkSession, "phrases")
    words = _stored(_item_words(items, item_key, item_text).withColumn("term", F.xxhash64("word")), folder, "item_words")
    vocabulary = words.select("word", "term").distinct()
    split = _documents(docs, key, text)
    tokens = split.select(*DOC, _shift().alias("shift"), F.posexplode("split").alias("at", "word"))
    postings = tokens.join(_small(vocabulary), "word").select("term", *DOC, (F.col("at") - F.col("shift")).alias("pos"))
    postings = _stored(postings, folder, "postings")
    counts = _stored(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), folder, "counts")
    # Each word is in at most ``window`` windows; a short item is one window.
    size = F.least(F.lit(window), F.col("n"))
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - size + 1), F.least(F.col("ipos"), F.col("n") - size)))
    placed = words.join(counts, "term", "left").select("item", "place", "ipos", "term", F.coalesce("df", F.lit(0)).alias("df"), size.alias("size"), starts.alias("start"))
    windows = placed.groupBy("item", "place", "start", "size").agg(F.sort_array(F.collect_list(F.struct("df", "ipos", "term"))).alias("terms"))
    windows = windows.filter(F.col("terms")[0]["df"] > 0).withColumn("second", F.when(F.col("size") > 1, F.col("terms")[1]).otherwise(F.col("terms")[0]))
    windows = windows.select(
        "item", "place", "start", "size", "terms",
        F.col("terms")[0]["ipos"].alias("ipos1"), F.col("terms")[0]["term"].alias("term1"), F.col("second.ipos").alias("ipos2"), F.col("second.term").alias("term2"),
    )
    return Index(postings, counts, split.select("id", *DOC, _n_words().alias("n_words")), _stored(windows, folder, "windows"), folder)


LEADS = ["place", "ipos1", "ipos2"]


def _leading(index: Index, slop: int) -> DataFrame:
    """Places where a window's leading terms stand as in the item, off by at most ``slop`` words: + diagonal, off."""
    leads = index.windows.select(*LEADS, "term1", "term2").distinct()
    first = index.postings.join(_small(leads.withColumnRenamed("term1", "term")), "term")
    first = first.select(*LEADS, *DOC, (F.col("pos") - F.col("ipos1")).alias("diagonal"), "term2", F.explode(F.array(*[F.lit(i) for i in range(-slop, slop + 1)])).alias("off"))
    first = first.withColumn("pos", F.col("diagonal") + F.col("ipos2") + F.col("off"))
    second = index.postings.join(_small(leads.select(F.col("term2").alias("term")).distinct()), "term").withColumnRenamed("term", "term2")
    # A row that is repeated has each posting as often; of one side they are made one before they meet.
    return first.join(second.select(*DOC, "pos", "term2").distinct(), [*DOC, "pos", "term2"]).select(*LEADS, *DOC, "diagonal", "off").distinct()


def phrase_matches(index: Index) -> DataFrame:
    """Exact matches: item, doc, sum, start (position of the window's first word), size."""
    met = _stored(_leading(index, 0).drop("off"), index.folder, "met")
    about = index.windows.select(*LEADS, "item", "start", "size", "terms")
    tried = met.join(_small(about), LEADS)
    wanted = tried.select("item", "place", *DOC, "diagonal", "start", "size", F.explode("terms").alias("t"))
    wanted = wanted.select("item", "place", *DOC, "diagonal", "start", "size", (F.col("diagonal") + F.col("t.ipos")).alias("pos"), F.col("t.term").alias("term"))
    there = index.postings.join(_small(met.select(*DOC).distinct()), DOC, "left_semi").select(*DOC, "pos", "term").distinct()
    whole = wanted.join(there, [*DOC, "pos", "term"]).groupBy("item", "place", *DOC, "diagonal", "start", "size").agg(F.count(F.lit(1)).alias("n"))
    return whole.filter(F.col("n") == F.col("size")).select("item", *DOC, (F.col("diagonal") + F.col("start")).alias("start"), "size").distinct()


def proximity_matches(index: Index, slop: int = 2) -> DataFrame:
    """item, doc, sum, start, off: the leading terms of a window stand ``off`` words nearer or farther than in the item."""
    about = index.windows.select(*LEADS, "item", "start")
    return _leading(index, slop).join(_small(about), LEADS).select("item", *DOC, (F.col("diagonal") + F.col("start")).alias("start"), "off").distinct()


def hits(index: Index, key: str = "doc_id") -> DataFrame:
    """Every document with key, doc, sum, n_words, n_hit (words inside a match), items (sorted ids of matching items).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Null and empty texts have no words
    and no hits; items without a word or an id match nothing; items that repeat an id count as one; equal rows
    give equal results, and rows may share a key or have none. Other columns are ignored.
    """
    found = _stored(phrase_matches(index), index.folder, "matches")
    covered = found.select(*DOC, F.explode(F.expr("sequence(start, start + size - 1)")).alias("pos")).distinct().groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_hit"))
    listed = found.select(*DOC, "item").distinct().groupBy(*DOC).agg(F.sort_array(F.collect_list("item")).alias("items"))
    about = covered.join(listed, DOC)
    rows = index.rows.join(about, DOC, "left")
    return rows.select(F.col("id").alias(key), *DOC, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.expr("array()").cast("array<string>")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """Columns by which results are compared."""
    joined = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), joined.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, ...) without an exact match of any window; all columns kept."""
    index = build_index(docs, items, window)
    dirty = _stored(phrase_matches(index).select(*DOC).distinct(), index.folder, "dirty")
    keyed = docs.withColumns({f"__{n}": c for n, c in zip(DOC, _name("doc_id", "text"))})
    dirty = dirty.select(F.col("doc").alias("__doc"), F.col("sum").alias("__sum"))
    return keyed.join(dirty, ["__doc", "__sum"], "left_anti").drop("__doc", "__sum")
