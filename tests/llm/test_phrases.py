"""Exact and proximity matches against plain search."""

import hashlib
import random
import re
import zlib

import pytest

from fathomry.llm import phrases
from tests.conftest import SF


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window=10):
    grams = {}
    for item, text in items:
        ws = words(text)
        k = min(window, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            grams.setdefault(tuple(ws[i : i + k]), set()).add(str(item))
    sizes = {len(g) for g in grams}
    out = []
    for text in texts:
        ws, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(ws) - k + 1):
                if (g := tuple(ws[i : i + k])) in grams:
                    hit.update(range(i, i + k))
                    found |= grams[g]
        out.append((len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def run(spark, docs, texts, items):
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc long")
    index = phrases.build_index(docs, bench)
    got = sorted(tuple(r)[1:] for r in phrases.digest(phrases.hits(index)).collect())
    assert got == sorted(brute(texts, items))
    return index, bench


@pytest.fixture(scope="module")
def cases():
    r = random.Random(2)
    vocabulary = ["the", "of", "a", "and", *[f"w{i}" for i in range(60)]]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(r.choice((1, 2, 5, 9, 10, 11, 30))))) for i in range(25)] + [(3, "the of a"), (90, None), (91, " .. "), (92, "The THE the the the the the the the the the"), (93, "É É w1")]
    texts = []
    for _ in range(80):
        ws = text(r.randrange(0, 60))
        piece = words(r.choice(items)[1])
        at = r.randrange(len(ws) + 1)
        texts.append(", ".join(ws[:at] + piece[: r.choice((9, 10, 30))] + ws[at:]))
    return texts + texts[:4], items


def test_many_windows_and_common_words(spark, docs_of, cases):
    texts, items = cases
    run(spark, docs_of(texts, [i % 70 if i else None for i in range(len(texts))]), texts, items)


def test_odd_rows(spark, docs_of, odd_texts):
    run(spark, docs_of(odd_texts), odd_texts, [(1, "same text here"), (2, "word " * 12), (3, "日本語"), (None, "a")][:3])


def test_without_broadcast(spark, docs_of, cases, monkeypatch):
    monkeypatch.setattr(phrases, "SMALL", 0)
    texts, items = cases
    run(spark, docs_of(texts[:20]), texts[:20], items)


def test_empty_tables(spark, docs_of):
    run(spark, docs_of([]), [], [(1, "a b")])
    run(spark, docs_of(["a b"]), ["a b"], [])


def test_proximity(spark, docs_of):
    item = "zebra one two three four five six seven eight yak"
    texts = ["zebra one two three four five six seven eight extra yak", "zebra yak", item, "none of it one two"]
    index, _ = run(spark, docs_of(texts), texts, [(1, item)])
    off = {(r.id, r.off) for r in phrases.proximity_matches(index, 1).join(index.rows, ["doc", "sum"]).collect()}
    assert (2, 0) in off and all(d != 3 for d, _ in off)


def test_decontaminate_keeps_columns_and_clean_rows(spark, docs_of):
    texts = ["clean text", "one two three four five six seven eight nine ten", None, "", "clean text"]
    docs = docs_of(texts, [1, 2, 3, None, 1])
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    kept = phrases.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "3", "None"]


def test_repeated_contaminated_rows_and_names_of_rows(spark, docs_of):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [item, item, item, item + " " + item, None, "clean", item]
    ids = [1, 1, 1, 2, 2, None, None]
    run(spark, docs_of(texts, ids), texts, [(1, item)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = phrases.decontaminate(docs_of(texts, ids), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]


def test_texts_of_equal_checksum_without_a_key(spark, docs_of):
    sums, r = {}, random.Random(11)
    while True:  # two texts of one 32-bit sum, as any large corpus has
        text = " ".join(r.choice("abcdefghijklmnop") for _ in range(12))
        other = sums.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            break
    texts = [text, other, text]
    run(spark, docs_of(texts, [None, None, -(2**63)]), texts, [(7, text)])


def test_plan_has_no_python(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plan = phrases.hits(phrases.build_index(docs, bench))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
