"""Suffix order against sorted suffixes; removal against one dictionary of all byte strings."""

import hashlib
import random

import numpy as np
import pytest

from fathomry.llm import suffix_dedup, suffix_order
from tests.conftest import SF


def brute_force(rows, width=50):
    """n_bytes, n_removed, n_spans and kept_sha256 of (key, text) rows."""
    least = {}
    data = [(float("inf") if k is None else k, (t or "").encode()) for k, t in rows]
    for k, d in data:
        for i in range(len(d) - width + 1):
            w = d[i : i + width]
            least[w] = min(least.get(w, k), k)
    out = []
    for k, d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if least[d[i : i + width]] < k:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def check(docs, **parameters):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted((str(k), *w) for (k, _), w in zip(rows, brute_force(rows)))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.remove_owned(docs, **parameters)).collect())
    assert got == want
    return got


@pytest.mark.parametrize("memory", [3, 8, 40, 10**6])
def test_order_and_common_prefixes(tmp_path, memory):
    """Small memory makes queues write runs and the induction go deeper than one level."""
    r = random.Random(memory)
    for trial in range(60):
        body = [r.randint(1, r.choice([1, 2, 3, 9])) for _ in range(r.randint(1, 150))]
        body = body * 3 if trial % 3 == 0 else body
        if trial % 4 == 1:  # long ascents, so that stretches between seeds end on all multiples of what is compared at once
            body = [c for _ in range(12) for c in range(1, r.choice([7, 8, 9, 15, 16, 17]))]
        text = np.array([*body, 0], dtype=np.uint8 if trial % 2 else np.uint16)
        s = text.tolist()
        scratch = suffix_order.Scratch(tmp_path.as_uri())
        blocks = list(suffix_order.induced(text, 50, 10**6, scratch, memory))
        scratch.close()
        places = np.concatenate([p for p, _ in blocks]).tolist()
        assert places == sorted(range(len(s) - 1), key=lambda i: s[i:], reverse=True)
        for n, (a, b) in zip(np.concatenate([x for _, x in blocks]).tolist()[1:], zip(places, places[1:])):
            m = next(i for i in range(51) if i == 50 or s[a + i : a + i + 1] != s[b + i : b + i + 1])
            assert n == m
    assert list(tmp_path.iterdir()) == []


def test_queue_keeps_order_of_entry_across_runs(tmp_path):
    queue = suffix_order.Queue(suffix_order.Scratch(tmp_path.as_uri()), 4)
    for i in range(10):
        queue.push(np.array([1, 2, 2]), np.array([3 * i, 3 * i + 1, 3 * i + 2]), np.zeros(3, dtype=np.uint8))
    assert queue.runs
    assert np.concatenate([p for p, _ in queue.drain(1)]).tolist() == [3 * i for i in range(10)]
    assert np.concatenate([p for p, _ in queue.drain(2)]).tolist() == [x for i in range(10) for x in (3 * i + 1, 3 * i + 2)]


def test_whole_table(spark):
    assert sum(r[2] for r in check(spark.read.parquet(f"{SF}/documents.parquet"))) > 0


def test_odd_rows(docs_of, odd_texts):
    odd = [*odd_texts[:5], "word " * 6_000, "x" * 4_000, "x" * 3_000, "7" * 500, *odd_texts[8:]]
    got = check(docs_of(odd))
    assert len(got) == len(odd)


def test_nulls_ties_and_repeated_rows(docs_of):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    a, b = text(120), text(90)
    texts = [a, a, a + b, b, b, "x" + a, text(60) + b[:50], b[:49] + text(30), a * 2]
    check(docs_of(texts, [5, 5, 7, None, None, 3, 9, 1, -(2**63)]))
    check(docs_of([a, a, b, a], [2**63 - 1, None, 0, 2**63 - 1]))


@pytest.mark.parametrize("slice_bytes, shard_bytes, memory", [(600, 500, 64), (4_000, 10**6, 1000)])
def test_many_slices_and_shards_with_a_hot_passage(spark, docs_of, monkeypatch, slice_bytes, shard_bytes, memory):
    monkeypatch.setattr(suffix_dedup, "SLICE", slice_bytes)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard_bytes)
    r = random.Random(1)
    hot = "an opening line that very many of the documents have in common, word for word. "
    texts = []
    for i in range(60):
        own = "".join(r.choice("abc ") for _ in range(r.randrange(0, 200)))
        at = r.randrange(len(own) + 1)
        texts.append(own[:at] + hot + own[at:] if i % 3 == 0 else own)
    texts += texts[:5]
    check(docs_of(texts, [i % 60 if i else None for i in range(len(texts))]).repartition(3), memory=memory)


def test_spans_are_maximal(docs_of):
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(60))
    rows = suffix_dedup.remove_owned(docs_of([text, "é" + text + "y" + text])).orderBy("doc_id").collect()
    n = len(text)
    assert [[(s.start, s.end) for s in r.removed] for r in rows] == [[], [(2, n + 2), (n + 3, 2 * n + 3)]]
    assert bytes(rows[1].kept) == "éy".encode()


def test_empty_table(docs_of):
    assert suffix_dedup.remove_owned(docs_of([])).collect() == []
