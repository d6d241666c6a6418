"""Divergence of sources against plain counting of every term of every pair."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fathomry.llm import divergence
from tests.conftest import SF


def brute_force(rows, least=10, top=10):
    """All rows of the result from (lang, source, text) rows."""
    count, have, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups.add((lang, source))
        count[lang, source].update(words)
        count[lang].update(words)
        have[lang].update(set(words))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in have[lang].items() if n >= least]
        total = {k: sum(count[k][t] for t in kept) for k in [lang, *[g for g in groups if g[0] == lang]]}
        p = {k: {t: 1 + 10**9 * (count[k][t] + 2) // (n + 2 * len(kept)) for t in kept} for k, n in total.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for g in [g for g in groups if g[0] == lang]:
            pairs = [(sum(f(p[g][t], p[h][t]) for t in kept), h[1]) for h in groups if h[0] == lang and h != g]
            terms = [(f(p[g][t], p[lang][t]), t) for t in kept if count[g][t] and p[g][t] > p[lang][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(*g, part, item, value, i) for i, (value, item) in enumerate(found[: None if part == "pair" else top], 1)]
    return sorted(out)


def check(docs, least=10, **parameters):
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    got = sorted(map(tuple, divergence.divergence(docs, least=least, **parameters).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == brute_force(rows, least)
    return got


def make(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 3) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n long")


def test_whole_table(spark):
    assert check(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("tile, band", [(4, 2), (1000, 3), (7, 100)])
def test_tiles_and_bands(spark, tile, band):
    r = random.Random(tile)
    rows = [(r.choice(["en", "en", "de"]), f"s{r.choice([0, 0, 0, *range(9)])}", " ".join(f"w{'abcdefghij'[r.randrange(10)]}{'xyz'[int(r.random() ** 3 * 3)]}" for _ in range(r.randrange(20)))) for _ in range(200)]
    check(make(spark, rows), 3, tile=tile, band=band)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    rows = [(None, None, None), ("", "", ""), ("en", None, "a b A"), ("en", "s", "a b a"), ("en", "s", "a b a"), ("en", "t", None), ("xx", "only", "7 8 9"), ("xx", "two", "--")]
    rows += [("en", "long", "Word É é " * 40_000), ("de", "a", "same same"), ("de", "b", "same same")]
    got = check(make(spark, rows), 2)
    assert ("xx", "only", "pair", "two", 0, 1) in got
    assert [x for x in got if x[0] == ""] == []


def test_empty_table(spark):
    assert divergence.divergence(make(spark, [("en", "s", "a")]).limit(0)).collect() == []


def test_joint_leaves_and_empty_columns():
    r = np.random.default_rng(4)
    matrix = r.random((5, 13)) < 0.2
    rows, columns = np.nonzero(matrix)
    levels = 4
    a, b, c, empty = divergence.joint_leaves(divergence.quadtree(rows, columns, levels), np.arange(5), np.arange(5), 13)
    got = set(zip(a.tolist(), b.tolist(), c.tolist()))
    want = {(i, j, k) for i in range(5) for j in range(i + 1, 5) for k in range(13) if matrix[i, k] or matrix[j, k]}
    assert got == want and len(a) == len(want)
    assert all(empty[i, j] == 13 - (matrix[i] | matrix[j]).sum() for i in range(5) for j in range(i + 1, 5))


def test_shares_stay_exact_for_great_counts():
    for n, total, size in [(10**13, 9 * 10**13, 10**9), (0, 0, 1), (7, 10**12, 123_456_789)]:
        assert divergence.shares(np.int64(n), np.int64(total), np.int64(size)) == 1 + 10**9 * (n + 2) // (total + 2 * size)
