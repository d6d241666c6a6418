"""Removal against one dictionary of all windows."""

import random

import numpy as np
import pytest

from fathomry.llm import windows
from tests.conftest import SF


def check(docs, width=windows.WIDTH):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted((str(k), *w) for (k, _), w in zip(rows, windows.brute_force([t for _, t in rows], width)))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in windows.digest(windows.remove_repeats(docs, width)).collect())
    assert got == want
    return got


def test_whole_table(spark):
    assert sum(r[2] for r in check(spark.read.parquet(f"{SF}/documents.parquet"))) > 0


def test_odd_rows(docs_of, odd_texts):
    got = check(docs_of(odd_texts))
    assert len(got) == len(odd_texts)


def test_passages_at_ends_overlaps_and_within_one_text(docs_of):
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    p, q = words(40), words(36)
    texts = [p + words(9), words(3) + p, words(4) + p + q + words(2), q + words(50) + q, p[:34] + words(5), words(35), p * 3]
    check(docs_of([" ".join(t) for t in texts]))


@pytest.mark.parametrize("slice_bytes", [400, 5_000])
def test_many_slices_and_buckets_with_a_hot_passage(spark, docs_of, monkeypatch, slice_bytes):
    monkeypatch.setattr(windows, "BUCKET", 50)
    monkeypatch.setattr(windows, "SLICE", slice_bytes)
    r = random.Random(1)
    hot = [f"h{i}" for i in range(12)]
    texts = []
    for i in range(60):
        own = [f"v{r.randrange(300)}" for _ in range(r.randrange(0, 40))]
        at = r.randrange(len(own) + 1)
        texts.append(" ".join(own[:at] + hot + own[at:] if i % 3 == 0 else own))
    texts += texts[:5]
    check(docs_of(texts, [i % 60 if i else None for i in range(len(texts))]), 5)


def test_intervals_are_maximal(docs_of):
    text = " ".join(f"a{i}" for i in range(50))
    rows = windows.remove_repeats(docs_of([text, "x " + text + " y"]), 10).orderBy("doc_id").collect()
    assert [[(s.start, s.end) for s in r.removed] for r in rows] == [[(0, 50)], [(1, 51)]]


def test_rolling_hash_equals_the_polynomial():
    x = np.arange(1, 90, dtype=np.uint64) * np.uint64(11400714819323198485)
    for width in (1, 2, 3, 6, 35):
        want = []
        for i in range(len(x) - width + 1):
            value = 0
            for v in x[i : i + width].tolist():
                value = (value * int(windows.MULTIPLIERS[0]) + v) % 2**64
            want.append(value)
        assert windows.window_hashes(x, width, windows.MULTIPLIERS[0]).tolist() == want


def test_empty_table(docs_of):
    assert windows.remove_repeats(docs_of([])).collect() == []
