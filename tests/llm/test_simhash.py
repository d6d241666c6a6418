"""Edited texts and neighbours against plain loops; the block tables against all pairs."""

import hashlib
import random

import pytest

from fathomry.llm import simhash
from fathomry.llm.texts import WordHashes, fold_words
from tests.conftest import SF


def brute(rows):
    """Rows (key, text) in descending key order, ties by descending text, no key last."""
    hashes = WordHashes()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for i, (key, text) in enumerate(order):
        text, then = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = (text[: len(text) - half] + then[:half]).encode()
        own, other, new = (simhash.fingerprint(fold_words(t), hashes) for t in (text.encode(), then.encode(), edited))
        out.append((key, len(text), hashlib.sha256(edited).hexdigest(), simhash.hexadecimal(own), simhash.hexadecimal(new), simhash.likeness(own, new), simhash.likeness(own, other)))
    return out


def same(docs):
    got = [tuple(r) for r in simhash.with_edited(docs).collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_whole_table(spark):
    same(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_odd_rows_over_ranges(docs_of, odd_texts, monkeypatch, size):
    monkeypatch.setattr(simhash, "RANGE", size)
    same(docs_of(odd_texts, [5, None, 3, 2, 2, -1, 0, 9, 8, 1 << 60, 4, 4]))


def test_one_row_and_none(docs_of):
    same(docs_of(["only one text"]))
    assert simhash.with_edited(docs_of([])).collect() == []


def test_equal_texts_have_equal_prints_and_near_ones_near(docs_of):
    r = random.Random(0)
    words = [f"w{r.randrange(10**6)}" for _ in range(300)]
    near = words[:150] + ["x"] + words[151:]
    rows = {x.doc_id: x.fingerprint for x in simhash.fingerprints(docs_of([" ".join(words), " ".join(near), " ".join(words), " ".join(f"v{i}" for i in range(300))])).collect()}
    mask = (1 << 64) - 1
    assert rows[0] == rows[2]
    assert simhash.likeness(rows[0] & mask, rows[1] & mask) > 0.85 > 0.7 > simhash.likeness(rows[0] & mask, rows[3] & mask)


@pytest.mark.parametrize(("radius", "blocks"), [(0, 1), (1, 3), (3, 6), (4, 6)])
def test_tables_find_all_within_the_radius(spark, radius, blocks):
    r = random.Random(radius)
    prints = []
    for _ in range(40):
        p = r.getrandbits(64)
        prints.append(p)
        for k in range(1, 6):
            for _ in range(2):
                q = p
                for b in r.sample(range(64), k):
                    q ^= 1 << b
                prints.append(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in [*signed, *signed[:9]]] + [(None,)], "fingerprint long")
    queries = df.limit(50)
    asked = {r.fingerprint for r in queries.collect()} - {None}
    got = {(r.query, r.fingerprint): r.distance for r in simhash.near_fingerprints(df, queries, radius, blocks).collect()}
    mask = (1 << 64) - 1
    want = {(a, b): d for a in asked for b in set(signed) if (d := ((a ^ b) & mask).bit_count()) <= radius}
    assert got == want
