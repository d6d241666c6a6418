"""Operator 7: toxicity by a chain of linear classifiers.

Categories are predicted in a fixed order. The model of a category sees the features of the text and the
probabilities of all categories before it. It is trained with out-of-fold probabilities, those of models that
have not seen the row, so that it learns how far to trust the earlier models on new texts.

Features are words, the first five characters of words and four characters in a row within a word, present or
not. Those that go with a category most clearly, by the chi-squared statistic, form the vocabulary.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomry.llm.texts import REMEMBERED, fold_words, given_back, slices, text_bytes
from fathomry.session import fresh_dir

#: Labelled rows the chain is fitted on, about; drawn by hash, the same rows on every run.
SAMPLE_ROWS = 10_000
VOCABULARY = 2_000
LEAST_CHI2 = 15.0
LEAST_ROWS = 4
FOLDS = 3
THRESHOLD = 0.5
PENALTY = 1e-4
#: Bytes of text whose grams a task counts at once.
SLICE = 1_000_000


def categories() -> dict[str, Column]:
    """Categories in the order of the chain, from the labels toxic and quality."""
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return {"toxic": toxic, "toxic_prose": toxic & (F.col("quality") == 1), "toxic_junk": toxic & (F.col("quality") == 0)}


def grams(word: bytes) -> list[str]:
    """Features of one word."""
    text = word.decode("utf-8", "replace")
    found = [text, f"^{text[:5]}"] if len(text) > 5 else [text]
    return found + [f"#{text[i : i + 4]}" for i in range(len(text) - 3)]


@dataclass
class Chain:
    """Linear models by category: intercept, weight of each feature, weights of the earlier probabilities."""

    names: list[str]
    features: dict[str, int] = field(default_factory=dict)
    intercepts: list[float] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)
    earlier: list[list[float]] = field(default_factory=list)

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        """One row of probabilities for each list of features."""
        out = np.zeros((len(rows), len(self.names)))
        for j in range(len(self.names)):
            weights = np.array(self.weights[j])
            for i, row in enumerate(rows):
                z = self.intercepts[j] + (weights[row].sum() if row else 0.0) + float(np.dot(self.earlier[j], out[i, :j]))
                out[i, j] = 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))
        return out


class Features(dict):
    """word -> numbers of its features in the vocabulary, remembering at most ``REMEMBERED`` words."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = tuple({i for g in grams(word) if (i := self.vocabulary.get(g)) is not None})
        return value

    def of(self, text: bytes) -> list[int]:
        found: set[int] = set()
        for numbers in map(self.__getitem__, fold_words(text)):
            if numbers:
                found.update(numbers)
        return sorted(found)


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, fold and one 0/1 column per category for about ``sample_rows`` labelled documents; fewer are taken whole.

    Labels without doc_id or toxic are left out; of repeated labels the greatest holds.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    total = marks.count()
    if total > sample_rows:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / total))
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = [F.coalesce(c, F.lit(False)).cast("double").alias(n) for n, c in categories().items()]
    return texts.join(marks, "doc_id").select("text", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), *marked)


def _vocabulary(sample: DataFrame, names: list[str], size: int) -> list[str]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            seen, hits = Counter(), [Counter() for _ in names]
            marks = [batch.column(n).to_pylist() for n in names]
            for i, text in enumerate(text_bytes(batch.column("text"))):
                own = {g for w in set(fold_words(text)) for g in grams(w)}
                seen.update(own)
                for mark, hit in zip(marks, hits):
                    if mark[i]:
                        hit.update(own)
            columns = [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())]
            columns += [pa.array([h[g] for g in seen], pa.int64()) for h in hits]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "n", *[f"h_{n}" for n in names]])

    totals = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names]).first()
    schema = ", ".join(["gram string", "n long", *[f"h_{n} long" for n in names]])
    counts = sample.mapInArrow(given_back(count), schema).groupBy("gram").agg(*[F.sum(c).cast("double").alias(c) for c in ["n", *[f"h_{n}" for n in names]]])
    best = []
    for name in names:
        rows, yes = float(totals["n"] or 0), float(totals[name] or 0)
        a, b = F.col(f"h_{name}"), F.col("n") - F.col(f"h_{name}")
        c, d = F.lit(yes) - a, F.lit(rows - yes) - b
        below = (a + b) * (c + d) * (a + c) * (b + d)
        best.append(F.when(below > 0, F.lit(rows) * (a * d - b * c) * (a * d - b * c) / below).otherwise(0.0))
    score = F.round(F.greatest(*best, F.lit(0.0)), 6)
    chosen = counts.filter(F.col("n") >= LEAST_ROWS).withColumn("score", score).filter(F.col("score") >= LEAST_CHI2)
    return sorted(r.gram for r in chosen.orderBy(F.col("score").desc(), "gram").limit(size).collect())


def fit_chain(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY) -> Chain:
    """Chain fitted on a bounded sample of labelled rows, in one task.

    A category whose rows are all alike gets no model but its rate, kept off 0 and 1. Without labels every
    probability is small.
    """
    names = list(categories())
    folder = fresh_dir(docs.sparkSession, "toxicity")
    sample = _stored(labelled_sample(docs, labels, sample_rows), folder, "sample")
    words = _vocabulary(sample, names, vocabulary)
    chain = Chain(names, {w: i for i, w in enumerate(words)})
    vocabulary_of = chain.features

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds, marks, rows = [], [], []
        features = Features(vocabulary_of)
        for batch in batches:
            folds += batch.column("fold").to_pylist()
            marks += list(zip(*[batch.column(n).to_pylist() for n in names]))
            rows += [features.of(t) for t in text_bytes(batch.column("text"))]
        order = sorted(range(len(rows)), key=lambda i: (folds[i], marks[i], rows[i]))  # rows arrive in any order
        fitted = fit_models([rows[i] for i in order], np.array([marks[i] for i in order]).reshape(-1, len(names)), np.array([folds[i] for i in order]), len(vocabulary_of))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(fitted)])], names=["models"])

    models = sample.repartition(1).mapInArrow(given_back(fit), "models string").collect()
    chain.intercepts, chain.weights, chain.earlier = json.loads(models[0].models) if models else fit_models([], np.zeros((0, len(names))), np.zeros(0), len(words))
    return chain


def fit_models(rows: list[list[int]], marks: np.ndarray, folds: np.ndarray, size: int) -> tuple[list[float], list[list[float]], list[list[float]]]:
    """Intercepts, feature weights and weights of earlier probabilities of all models of a chain."""
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    numbers = np.array([i for r in rows for i in r], dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    earlier = np.zeros((len(rows), 0))
    out: tuple[list, list, list] = ([], [], [])

    def fit(kept: np.ndarray, target: np.ndarray) -> np.ndarray:
        use = kept[owner]
        place = np.cumsum(kept) - 1
        return logistic(numbers[use], place[owner[use]], int(kept.sum()), size, earlier[kept], target[kept])

    for j in range(marks.shape[1]):
        target = marks[:, j]
        weights = fit(np.ones(len(rows), dtype=bool), target)
        out[0].append(float(weights[0]))
        out[1].append(weights[1 : 1 + size].round(6).tolist())
        out[2].append(weights[1 + size :].round(6).tolist())
        told = np.zeros(len(rows))
        for f in range(FOLDS):  # each row is told what a model says that has not seen it
            own = folds == f
            w = fit(~own, target)
            z = w[0] + np.bincount(owner, weights=w[1:][numbers], minlength=len(rows)) + earlier @ w[1 + size :]
            told[own] = (1 / (1 + np.exp(-np.clip(z, -50, 50))))[own]
        earlier = np.column_stack([earlier, told])
    return out


def logistic(numbers: np.ndarray, owner: np.ndarray, n: int, size: int, dense: np.ndarray, target: np.ndarray, penalty: float = PENALTY, rounds: int = 150) -> np.ndarray:
    """Weights of a penalized logistic regression: intercept, ``size`` features, columns of ``dense``; by L-BFGS.

    Rows that are all alike leave the intercept of their rate, kept off 0 and 1.
    """
    weights = np.zeros(1 + size + dense.shape[1])
    yes = float(target.sum())
    if yes in (0.0, float(n)):
        rate = (yes + 0.5) / (n + 1) if n else 0.01
        weights[0] = math.log(rate / (1 - rate))
        return weights

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = w[0] + np.bincount(owner, weights=w[1:][numbers], minlength=n) + dense @ w[1 + size :]
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        r = (p - target) / n
        grad = np.concatenate([[r.sum()], np.bincount(numbers, weights=r[owner], minlength=size)[:size], dense.T @ r])
        grad[1:] += penalty * w[1:]
        return float(np.mean(np.logaddexp(0, z) - target * z) + penalty / 2 * (w[1:] ** 2).sum()), grad

    value, grad = loss(weights)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, kept = grad.copy(), []
        for s, y in reversed(past):
            a = s @ way / (y @ s)
            way -= a * y
            kept.append(a)
        if past:
            way *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(kept)):
            way += s * (a - y @ way / (y @ s))
        step, slope = 1.0, float(grad @ way)
        while step > 1e-8:
            new = weights - step * way
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - weights, new_grad - grad
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y)]
        done = value - new_value < 1e-7
        weights, value, grad = new, new_value, new_grad
        if done:
            break
    return weights


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` with ``p_<category>`` for each category and ``toxic`` (one reaches the threshold).

    Columns of these names are replaced. Null and empty texts have no features and get the models' intercepts. An
    empty table gives no rows; equal texts have equal probabilities.
    """
    kept = json.dumps(asdict(chain))

    @F.pandas_udf("array<double>")
    def scored(texts):
        import pandas as pd

        own = Chain(**json.loads(kept))
        features = Features(own.features)
        found = own.probabilities([features.of((t or "").encode()) for t in texts])
        return pd.Series(list(found), dtype=object)

    names = [f"p_{n}" for n in chain.names]
    base = docs.drop(*names, "toxic").withColumn("__p", scored(F.col("text").cast("string")))
    told = base.withColumns({n: F.col("__p")[i] for i, n in enumerate(names)})
    return told.withColumn("toxic", F.greatest(*[F.col(n) for n in names], F.lit(0.0)) >= threshold).drop("__p")
