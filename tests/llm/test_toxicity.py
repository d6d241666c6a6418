"""Held-out accuracy, the order of the chain, and odd tables."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.llm import toxicity

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    chain = toxicity.fit_chain(docs, labels.filter("doc_id % 4 <> 0"))
    told = toxicity.score_toxicity(docs, chain).withColumnRenamed("toxic", "said").join(labels.filter("doc_id % 4 = 0"), "doc_id")
    rows = [(r.said, r.toxic) for r in told.select("said", "toxic").collect()]
    assert sum(s == bool(t) for s, t in rows) / len(rows) > 0.93
    assert sum(s and not t for s, t in rows) / len(rows) < 0.02


def plain(chain, text):
    """Probabilities of a text from the chain's numbers, by the definition of its features."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    met = set()
    for w in words:
        met.add(w)
        if len(w) > 5:
            met.add("^" + w[:5])
        met.update("#" + w[i : i + 4] for i in range(len(w) - 3))
    out = []
    for name, intercept, weights, earlier in zip(chain.names, chain.intercepts, chain.weights, chain.earlier):
        z = intercept + sum(weights[chain.features[m]] for m in met if m in chain.features) + sum(a * b for a, b in zip(earlier, out))
        out.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
    return out


def test_every_text_of_the_table_against_the_plain_sum(tables):
    docs, labels = tables
    chain = toxicity.fit_chain(docs, labels)
    for r in toxicity.score_toxicity(docs, chain).collect():
        want = plain(chain, r.text)
        assert [r.p_toxic, r.p_toxic_prose, r.p_toxic_junk] == pytest.approx(want, abs=1e-9)
        assert r.toxic == (max(want) >= toxicity.THRESHOLD)


def test_repeatable_and_all_columns(tables):
    docs, labels = tables
    first, second = toxicity.fit_chain(docs, labels), toxicity.fit_chain(docs.repartition(3), labels.repartition(2))
    assert first == second
    told = toxicity.score_toxicity(docs, first)
    assert told.columns == [*docs.columns, "p_toxic", "p_toxic_prose", "p_toxic_junk", "toxic"]
    assert told.count() == docs.count()


def test_odd_rows(spark, docs_of, odd_texts, tables):
    chain = toxicity.fit_chain(*tables)
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs_of(odd_texts), chain).collect()}
    assert len(rows) == len(odd_texts)
    assert rows[0].p_toxic == rows[1].p_toxic == rows[2].p_toxic and not rows[0].toxic
    assert toxicity.score_toxicity(docs_of([]), chain).collect() == []


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, None, 0)], [(1, 1, 1)], [(None, 1, 1), (1, None, None)]])
def test_few_labels(spark, docs_of, labels):
    docs = docs_of(["a b", "c d", "e"])
    chain = toxicity.fit_chain(docs, spark.createDataFrame(labels, LABELS))
    told = toxicity.score_toxicity(docs, chain).collect()
    assert len(told) == 3 and all(0 <= r.p_toxic <= 1 for r in told)
    if not any(t == 1 for _, _, t in labels):
        assert not any(r.toxic for r in told)


def test_repeated_labels_take_the_greatest(spark, docs_of):
    docs = docs_of(["a", "b"])
    sample = toxicity.labelled_sample(docs, spark.createDataFrame([(0, 1, 0), (0, 1, 1), (1, 0, 0)], LABELS))
    assert sorted((r.text, r.toxic, r.toxic_prose) for r in sample.collect()) == [("a", 1.0, 1.0), ("b", 0.0, 0.0)]


def test_later_models_learn_from_unseen_probabilities():
    rng = np.random.default_rng(1)
    rows = [[int(i)] if i < 6 else [] for i in rng.integers(0, 12, 600)]
    first = np.array([float(bool(r)) for r in rows])
    marks = np.column_stack([first, first])
    intercepts, weights, earlier = toxicity.fit_models(rows, marks, np.arange(600) % 3, 6)
    assert earlier[0] == [] and earlier[1][0] > 1
    chain = toxicity.Chain(["a", "b"], {}, intercepts, weights, earlier)
    assert ((chain.probabilities(rows) > 0.5) == marks.astype(bool)).all()


def test_logistic_is_at_the_minimum():
    rng = np.random.default_rng(3)
    x = (rng.random((200, 5)) < 0.3).astype(float)
    y = (rng.random(200) < 1 / (1 + np.exp(1 - x @ [2, -1, 0, 1, 0]))).astype(float)
    owner, numbers = np.nonzero(x)
    w = toxicity.logistic(numbers, owner, 200, 5, np.zeros((200, 0)), y, penalty=1e-2)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert abs((p - y).mean()) < 1e-3
    assert np.abs(x.T @ (p - y) / 200 + 1e-2 * w[1:]).max() < 1e-3
