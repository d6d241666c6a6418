"""Links against alignment of all pairs, classes against union-find."""

import functools
import random
from collections import Counter

import numpy as np
import pytest

from fathomry.llm import order_minhash as omh
from fathomry.llm import texts
from fathomry.llm.texts import WordHashes, fold_words
from tests.conftest import SF


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            up = row[j + 1]
            row[j + 1] = left + 1 if x == y else max(up, row[j])
            left = up
    return row[-1]


@functools.cache
def parts(text):
    return omh.shingles(WordHashes().array(fold_words(text.encode()))).tolist()


def near(a, b):
    x, y = parts(a), parts(b)
    if not x or not y or (Counter(x) & Counter(y)).total() < omh.SIMILARITY * max(len(x), len(y)) - 1e-9:
        return 0.0  # too few in common for any order
    return lcs(x, y) / max(len(x), len(y))


def classes(rows):
    """Least key of each row's class, by all pairs of different texts."""
    texts = sorted({t for _, t in rows if t and fold_words(t.encode())})
    top = {t: t for t in texts}

    def find(t):
        while top[t] != t:
            t = top[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if near(a, b) >= omh.SIMILARITY - 1e-9:
                top[find(a)] = find(b)
    least = {}
    for key, t in rows:
        if t in top and key is not None:
            least[find(t)] = min(key, least.get(find(t), key))
    return sorted((str(k), str(least.get(find(t)) if t in top else k)) for k, t in rows)


def got(docs):
    return sorted((str(r.doc_id), str(r.class_id)) for r in omh.near_duplicates(docs).collect())


@pytest.fixture(scope="module")
def family():
    r = random.Random(9)
    texts = []
    for _ in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(60, 200))]
        for _ in range(r.randrange(1, 6)):
            own = list(base)
            for _ in range(r.randrange(0, max(1, len(own) // 60))):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(own))
    shared = [f"p{i}" for i in range(60)]
    texts += [" ".join(shared + [f"y{r.randrange(10**6)}" for _ in range(120)]) for _ in range(15)]
    return texts


def test_copies_and_near_copies(docs_of, family):
    texts = [*family, *family[:7]]
    ids = [None if i == 3 else i % 70 for i in range(len(texts))]
    assert got(docs_of(texts, ids)) == classes(list(zip(ids, texts)))


def test_odd_rows(docs_of, odd_texts):
    assert got(docs_of(odd_texts)) == classes(list(enumerate(odd_texts)))


def test_large_group_of_near_copies(docs_of):
    r = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join([*base[: (k := r.randrange(150))], f"e{i}", *base[k + 1 :]]) for i in range(60)]
    rows = omh.near_duplicates(docs_of(texts)).collect()
    assert {(x.class_id, x.class_size) for x in rows} == {(0, 60)}


def test_whole_table_finds_exact_copies_and_leaves_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == classes(rows)


def test_empty_table(docs_of):
    assert omh.near_duplicates(docs_of([])).collect() == []
    assert omh.keep_representatives(docs_of([])).collect() == []


def test_representatives(docs_of):
    base = " ".join(f"w{i}" for i in range(200))
    texts = [base, "other text of its own", base + " tail", base, None, None, "", "other text of its own"]
    docs = docs_of(texts, [7, 2, 3, 7, 4, 4, 5, 2])
    kept = omh.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.select("doc_id", "text").na.fill("-").collect()) == [(2, texts[1]), (3, texts[2]), (4, "-"), (4, "-"), (5, "")]


def test_aligned_equals_the_plain_subsequence():
    r = random.Random(3)
    for _ in range(800):
        a = [r.randrange(12) for _ in range(r.randrange(1, 40))]
        b = list(a)
        for _ in range(r.randrange(6)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = [r.randrange(12)] * r.randrange(2)
        share = lcs(a, b) / max(len(a), len(b), 1)
        found = omh.aligned(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
        assert found == pytest.approx(share if share >= omh.SIMILARITY - 1e-12 else 0.0)


def test_sketches_heed_the_order():
    r = np.random.default_rng(0)
    x = r.integers(0, 2**63, 400).astype(np.uint64)
    same = sum(a == b for a, b in zip(omh.sketches(x), omh.sketches(np.concatenate([x[200:], x[:200]]))))
    close = sum(a == b for a, b in zip(omh.sketches(x), omh.sketches(np.delete(x, 7))))
    assert close > same


def test_long_chains_become_one_class(spark, tmp_path):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(0, 60)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    rows = {bytes(r.node): bytes(r["class"]) for r in omh.spread_least(edges, str(tmp_path)).collect()}
    assert set(rows.values()) == {b"\x00", b"\xf0"} and len(rows) == 63


def replaced(r, words, n):
    own = list(words)
    for at in r.sample(range(len(own)), n):
        own[at] = f"x{r.randrange(10**9)}"
    return own


@pytest.mark.parametrize("size", [5, 100])
def test_stars_and_chains_of_edits(docs_of, size):
    """Edits that are near their base or the edit before them, but seldom near each other."""
    r = random.Random(size)
    texts = []
    for _ in range(4 if size < 100 else 1):
        base = [f"w{r.randrange(10**6)}" for _ in range(300)]
        texts += [" ".join(base), *[" ".join(replaced(r, base, 8)) for _ in range(size)]]
        own = [f"w{r.randrange(10**6)}" for _ in range(300)]
        for _ in range(size):
            texts.append(" ".join(own))
            own = replaced(r, own, 6)
    rows = {x.doc_id: x.class_id for x in omh.near_duplicates(docs_of(texts)).collect()}
    want = dict((int(k), int(c)) for k, c in classes(list(enumerate(texts))))
    assert sum(rows[k] != c for k, c in want.items()) <= len(texts) // 100


def test_texts_around_one_hot_passage(docs_of):
    r = random.Random(4)
    passage = [f"p{i}" for i in range(90)]
    texts = []
    for _ in range(60):
        base = [*passage, *[f"y{r.randrange(10**6)}" for _ in range(60)]]
        texts += [" ".join(base), " ".join(replaced(r, base, 3))]
    assert got(docs_of(texts)) == classes(list(enumerate(texts)))


def test_texts_outside_the_buckets_are_not_moved(spark):
    texts = spark.range(20_000).selectExpr("unhex(md5(cast(id AS string))) AS digest", "concat('text ', id) AS text")
    for n in (0, 1, 3_000):
        wanted = texts.limit(n).select("digest")
        likely = omh._likely(texts, wanted)
        assert likely.columns == texts.columns and likely.join(wanted, "digest", "left_semi").count() == n
        assert likely.count() - n <= 20_000 // 10  # about one in 16


def test_workers_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(texts.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: calls.append(1)})())
    run = texts.given_back(lambda batches: (b + 1 for b in batches))
    assert list(run(iter([1, 2]))) == [2, 3] and calls == [1]
    half = run(iter([1, 2]))
    assert next(half) == 2 and calls == [1]
    half.close()  # a task that ends early
    assert calls == [1, 1]


def test_only_texts_still_in_play_move_after_the_first_round(docs_of, family, monkeypatch):
    stored, seen = omh._stored, {}

    def told(df, folder, name, rows=None):
        out = stored(df, folder, name, rows)
        if name in ("texts", "rest", "fewer"):
            seen[name] = out.count()
        return out

    monkeypatch.setattr(omh, "_stored", told)
    omh.near_duplicates(docs_of(family)).count()
    assert seen["rest"] and seen["fewer"] == seen["rest"] < seen["texts"]
