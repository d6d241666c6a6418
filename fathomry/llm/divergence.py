"""Operator 12: how far the wording of the sources of a language lies apart, by a quadtree of the group-term counts.

Rows of a language's matrix are its sources, columns the terms that at least ``LEAST`` of its documents have. It is
cut into tiles of about ``TILE`` columns and bands of ``BAND`` sources, and each tile with each pair of bands is one
group of rows, so no task holds a language and its size is bounded. In a tile the counts other than zero stand in a
quadtree (K squared children with K = 2, as a list of the non-empty quadrants of each level). Two sources
are walked down together: a quadrant where both are empty ends there and adds its columns to the pair's number of
columns without counts; all these cost the same, which the sizes of both groups tell. Where either has a count
in a single column, the column is priced by itself.

Shares are whole numbers of billionths and prices whole numbers, so sums do not depend on their order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomry.llm.texts import slices, text_bytes
from fathomry.operators.lookups import spread_join
from fathomry.session import fresh_dir

LEAST = 10
TOP = 10
TILE = 1024
BAND = 32
#: Digits are no letters of a term; all else as in words of texts.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
# A billion in two factors, so that counts up to 2e14 stay within 64 bits.
FACTORS = (31_250, 32_000)


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a slice of documents: occurrences, and documents that have the term."""
    names = ["lang", "source", "term", "n", "docs"]
    for batch in slices(batches):
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), text_bytes(batch.column("text"))):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            terms = text.translate(LETTERS).split()
            n.update(terms)
            docs.update(set(terms))
        for (lang, source), (n, docs) in groups.items():
            columns = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()).cast(pa.string(), safe=False)]
            columns += [pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def shares(count: np.ndarray, total: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 size)), exact."""
    whole = total + 2 * size
    upper = (count + 2) * FACTORS[0]
    return 1 + upper // whole * FACTORS[1] + upper % whole * FACTORS[1] // whole


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


def share_column(count: str, total: str) -> Column:
    """``shares`` of columns, with ``size`` for the number of terms; ``div`` and ``%`` on whole numbers are exact."""
    whole, upper = f"({total} + 2 * size)", f"(({count} + 2) * {FACTORS[0]}L)"
    return F.expr(f"1 + ({upper} div {whole}) * {FACTORS[1]}L + (({upper} % {whole}) * {FACTORS[1]}L) div {whole}")


def quadtree(rows: np.ndarray, columns: np.ndarray, levels: int) -> list[np.ndarray]:
    """Non-empty quadrants of each level, from one for the whole matrix down to single cells, as sorted numbers.

    A quadrant of level l is row >> (levels - l) and column >> (levels - l), joined to one number.
    """
    out = []
    for level in range(levels + 1):
        down = levels - level
        out.append(np.unique((rows >> down << 32) | (columns >> down)))
    return out


def _has(level: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Whether the quadrants are among the non-empty ones of a level."""
    wanted = rows << 32 | columns
    at = np.minimum(np.searchsorted(level, wanted), len(level) - 1)
    return level[at] == wanted if len(level) else np.zeros(len(wanted), dtype=bool)


def joint_leaves(tree: list[np.ndarray], first: np.ndarray, second: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, column, empty): for each row a of ``first`` and b of ``second`` with a < b, the columns where either has a
    cell, and ``empty[a, b]``, how many of the ``width`` columns neither has.

    All pairs walk down the tree together; a quadrant that is empty for both halves of a pair is not entered.
    """
    levels = len(tree) - 1
    size = 1 << levels
    empty = np.zeros((1, 1), dtype=np.int64)
    inside = [np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)]
    inside[0][first], inside[1][second] = True, True
    a = b = c = np.zeros(1, dtype=np.int64)
    for level in range(1, levels + 1):
        down = levels - level
        # Children of all quadrants: upper or lower half of each row block, left or right half of the columns.
        a, b, c = ((2 * x[:, None] + bit).ravel() for x, bit in zip((a, b, c), np.array([[i >> k & 1 for i in range(8)] for k in (2, 1, 0)])))
        empty = empty.repeat(2, axis=0).repeat(2, axis=1)
        here = [x.reshape(-1, 1 << down).any(axis=1) for x in inside]
        use = here[0][a] & here[1][b] & (a <= b) & (c << down < width)
        a, b, c = a[use], b[use], c[use]
        there = _has(tree[level], a, c) | _has(tree[level], b, c)
        columns = np.minimum((c[~there] + 1) << down, width) - (c[~there] << down)
        np.add.at(empty, (a[~there], b[~there]), columns)
        a, b, c = a[there], b[there], c[there]
    use = a < b
    return a[use], b[use], c[use], empty


def _priced(group: pa.Table) -> pa.Table:
    """(lang, source, other, value): what the columns of one tile add to the pairs of sources of two bands.

    Rows without a term tell that a source is there, its total, and how many terms the language and the tile have.
    """
    rows = group.filter(pc.is_null(group.column("term")))
    cells = group.filter(pc.is_valid(group.column("term")))
    about = dict(zip(rows.column("source").to_pylist(), zip(rows.column("band").to_pylist(), rows.column("total").to_pylist())))
    known = sorted(about, key=lambda x: (about[x][0], x))  # the bands one after the other
    number = {x: i for i, x in enumerate(known)}
    bands, totals = np.array([about[x][0] for x in known]), np.array([about[x][1] for x in known], dtype=np.int64)
    size, width = np.int64(rows.column("size")[0].as_py()), int(rows.column("width")[0].as_py())
    row = np.array([number[x] for x in cells.column("source").to_pylist()], dtype=np.int64)
    names: dict[str, int] = {}  # terms of the tile that no source of these bands has fill its right edge
    column = np.array([names.setdefault(x, len(names)) for x in cells.column("term").to_pylist()], dtype=np.int64)
    counts = cells.column("n").to_numpy().astype(np.int64)
    levels = max(1, int(max(len(known), width) - 1).bit_length())
    # A band without sources leaves its pairs with others empty.
    first, second = (np.flatnonzero(bands == rows.column(x)[0].as_py()) for x in ("low", "high"))
    a, b, c, empty = joint_leaves(quadtree(row, column, levels), first, second, width)
    key = row << 32 | column
    order = np.argsort(key)
    key, counts = key[order], counts[order]

    def share_of(r, col):
        wanted = r << 32 | col
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        return shares(np.where(key[at] == wanted, counts[at], 0), totals[r], size)

    value = np.zeros((len(known), len(known)), dtype=np.int64)
    np.add.at(value, (a, b), prices(share_of(a, c), share_of(b, c)))
    x, y = (i.ravel() for i in np.meshgrid(first, second, indexing="ij"))
    x, y = x[x < y], y[x < y]
    sums = value[x, y]
    if width:
        none = shares(np.zeros(len(known), dtype=np.int64), totals, size)
        sums = sums + empty[x, y] * prices(none[x], none[y])
    kinds = dict(zip(("lang", "source", "other", "value"), (pa.string(), pa.string(), pa.string(), pa.int64())))
    values = ([rows.column("lang")[0].as_py()] * len(x), [known[i] for i in x], [known[i] for i in y], sums)
    return pa.table({n: pa.array(v, k) for (n, k), v in zip(kinds.items(), values)})


def _tiles(of: str) -> Column:
    return F.pmod(F.xxhash64(of), F.col("tiles")).alias("tile")


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP, tile: int = TILE, band: int = BAND) -> DataFrame:
    """Part ``pair``: the distance of each source to each other one of its language; part ``term``: what marks it.

    Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; a language keeps those that at least
    ``least`` of its documents have. Of a source and of a language each kept term has the share
    1 + floor(10^9 (count + 2) / (all counts + 2 terms)), and two shares lie floor((p - q)^2 / (p + q)) apart. Pairs: the
    sum over all kept terms, every rank. Terms: those of a source with a greater share there than in the
    language, the first ``top``. Returns lang, source, part, item, value, rank (from 1, greatest value first,
    then the item in UTF-8 order).

    Null language, source and text are empty ones. A language without kept terms has pairs of value 0; a source
    without another has no pairs. Repeated rows count as often as they stand. Other columns are ignored; an empty
    table gives no rows.
    """
    folder = fresh_dir(docs.sparkSession, "divergence")
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = _stored(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), folder, "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    kept = _stored(kept.drop("docs"), folder, "kept")
    cells = _stored(spread_join(counts.drop("docs"), kept, ["lang", "term"], "inner"), folder, "cells")

    groups = rows.select("lang", "source").distinct().join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = _stored(groups.fillna(0, ["total"]), folder, "groups")
    langs = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / band)).alias("bands"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("lang_n").alias("lang_total"))
    langs = langs.join(sizes, "lang", "left").fillna(0, ["size", "lang_total"]).withColumn("tiles", F.greatest(F.lit(1), F.ceil(F.col("size") / tile)))
    langs = _stored(langs, folder, "langs")

    # Each cell and each source goes to its tiles, once for each band it is paired with.
    banded = lambda df: df.withColumn("band", F.pmod(F.xxhash64("source"), F.col("bands"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bands") - 1)))
    paired = [F.least("band", "with").alias("low"), F.greatest("band", "with").alias("high")]
    widths = spread_join(kept, langs, ["lang"], "inner").groupBy("lang", _tiles("term")).agg(F.count(F.lit(1)).alias("width"))
    there = banded(spread_join(groups, langs, ["lang"], "inner")).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    there = spread_join(there, widths, ["lang", "tile"]).select("lang", "tile", *paired, "source", "band", "total", "size", F.coalesce("width", F.lit(0)).alias("width"))
    none = F.lit(None).cast("long")
    counts_of = banded(spread_join(cells, langs, ["lang"], "inner")).select("lang", _tiles("term"), *paired, "source", "band", none.alias("total"), none.alias("size"), none.alias("width"), "term", "n")
    both = counts_of.unionByName(there.withColumns({"term": F.lit(None).cast("string"), "n": none}))
    sums = both.groupBy("lang", "tile", "low", "high").applyInArrow(_priced, "lang string, source string, other string, value long")
    sums = _stored(sums.groupBy("lang", "source", "other").agg(F.sum("value").alias("value")), folder, "pairs")
    pairs = sums.select("lang", "source", F.col("other").alias("item"), "value").unionByName(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), "value"))

    marks = spread_join(spread_join(cells, groups, ["lang", "source"], "inner"), langs, ["lang"], "inner")
    marks = marks.select("lang", "source", F.col("term").alias("item"), share_column("n", "total").alias("p"), share_column("lang_n", "lang_total").alias("q")).filter("p > q")
    marks = marks.select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", rank]
    return pairs.select(*columns("pair")).unionByName(marks.select(*columns("term")).filter(F.col("rank") <= top))
