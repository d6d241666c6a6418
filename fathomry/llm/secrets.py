"""Operator 6: secret scan by a linear-chain conditional random field beside three fixed patterns.

Tokens that could be a secret (six or more of ``A-Za-z0-9+/_-`` with a digit, or twenty or more) form chains:
neighbours in a chain have one character of punctuation between them. All other tokens are outside by
construction, so chains can be decoded one by one. A chain's tokens are tagged begin, inside or outside. Features
are a token's shape, length, variety of characters and first characters, the words beside it, and features of
the file: language, source, whether it speaks of keys, how much of it is digits. The field is trained by
gradient steps on the log-likelihood; tokens the fixed patterns cover are its examples, and as it knows these only
by their features, it also tags tokens that the patterns miss. Viterbi finds the best tags.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.llm.texts import given_back

#: Rows the field is fitted on, about; drawn by hash, the same rows on every run.
SAMPLE_ROWS = 20_000
EPOCHS = 12
#: Least margin, in log-odds against the tags without a secret, of a token that is reported.
MARGIN = 1.0

# Fixed patterns; of the second and third the runs that are too short are left out by the repeat count, which
# is the same: a run that is too short holds no longer one.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "crf")

PART = "A-Za-z0-9+/_-"
CANDIDATE = re.compile(rf"(?<![{PART}])(?:(?=[A-Za-z+/_-]*[0-9])[{PART}]{{6,}}|[{PART}]{{20,}})")
WORD = re.compile(r"[^\W_]+|[^\w\s]")
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
NEVER = -1e9


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and not overlapping within a kind; code points."""
    found = []
    folded = text.encode().lower()
    if any(k in folded for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def chains(text: str) -> list[list[tuple[int, int]]]:
    """Candidate tokens (start, end), those with one character of punctuation between them together."""
    out: list[list[tuple[int, int]]] = []
    for m in CANDIDATE.finditer(text):
        if out and m.start() - out[-1][-1][1] == 1 and not text[m.start() - 1].isspace():
            out[-1].append(m.span())
        else:
            out.append([m.span()])
    return out


def file_features(text: str, lang: str | None, source: str | None) -> list[str]:
    folded = text.encode().lower()
    digits = sum(map(text.count, "0123456789")) / max(1, len(text))
    return [f"lang={lang}", f"source={source}", f"keys={any(k in folded for k in KEYWORDS)}", f"digits={min(9, int(digits * 50))}"]


def features(text: str, start: int, end: int, about: list[str]) -> list[str]:
    token = text[start:end]
    kinds = "".join(k for k, there in (("a", re.search("[a-z]", token)), ("A", re.search("[A-Z]", token)), ("0", re.search("[0-9]", token)), ("/", re.search("[+/_-]", token))) if there)
    size = len(token)
    counts = Counter(token)
    variety = -sum(n / size * math.log2(n / size) for n in counts.values())
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", token[:40]))))[:6]
    bucket = min(size, 64).bit_length() * 2 + (size >= 3 << max(0, size.bit_length() - 2))
    hexed = re.fullmatch("[0-9a-f]+", token) is not None
    before = WORD.findall(text[max(0, start - 40) : start].lower())
    behind = WORD.findall(text[end : end + 20].lower())
    words = [w for w in before if w[0].isalnum()]
    return [
        "bias", f"kinds={kinds}", f"size={bucket}", f"kinds+size={kinds}{bucket}", f"hex={hexed}", f"hex+size={hexed}{bucket}", f"variety={int(variety * 2)}",
        f"shape={shape}", f"head={token[:4] if token[:4].isupper() else '-'}", f"digits={int(10 * sum(c.isdigit() for c in token) / size)}",
        f"before={before[-1] if before else '-'}", f"word={words[-1] if words else '-'}", f"behind={behind[0] if behind else '-'}", *about,
    ]


class Field:
    """Weights of a linear-chain conditional random field with the tags begin, inside, outside."""

    def __init__(self, names: Mapping[str, int] | None = None, weights: np.ndarray | None = None, steps: np.ndarray | None = None):
        self.names = dict(names or {})
        self.weights = np.zeros((0, 3)) if weights is None else weights
        self.steps = np.zeros((4, 3)) if steps is None else steps  # the last row is the start

    def _rows(self, chain: list[list[str]]) -> list[list[int]]:
        return [[i for f in token if (i := self.names.get(f)) is not None] for token in chain]

    def _scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[r].sum(axis=0) if r else np.zeros(3) for r in rows])

    def _allowed(self) -> np.ndarray:
        steps = self.steps.copy()
        steps[OUTSIDE, INSIDE] = steps[3, INSIDE] = NEVER
        return steps

    def fit(self, data: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> Field:
        """AdaGrad on the penalized log-likelihood, chains in the given order."""
        for chain, _ in data:
            for token in chain:
                for f in token:
                    self.names.setdefault(f, len(self.names))
        self.weights = np.zeros((len(self.names), 3))
        seen, seen_steps = np.full_like(self.weights, 1e-6), np.full_like(self.steps, 1e-6)
        for _ in range(epochs):
            for chain, tags in data:
                rows = self._rows(chain)
                marginal, pairs = self._expected(self._scores(rows))
                for i, (row, tag) in enumerate(zip(rows, tags)):
                    push = -marginal[i]
                    push[tag] += 1
                    grad = push - decay * self.weights[row]
                    seen[row] += grad**2
                    self.weights[row] += rate * grad / np.sqrt(seen[row])
                told = np.zeros_like(self.steps)
                for a, b in zip([3, *tags], tags):
                    told[a, b] += 1
                grad = told - pairs - decay * self.steps
                seen_steps += grad**2
                self.steps += rate * grad / np.sqrt(seen_steps)
        return self

    def _expected(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of each tag at each place, and expected steps."""
        steps, n = self._allowed(), len(scores)
        ahead, back = np.zeros((n, 3)), np.zeros((n, 3))
        ahead[0] = steps[3] + scores[0]
        for i in range(1, n):
            ahead[i] = np.logaddexp.reduce(ahead[i - 1][:, None] + steps[:3], axis=0) + scores[i]
        for i in range(n - 2, -1, -1):
            back[i] = np.logaddexp.reduce(steps[:3] + (scores[i + 1] + back[i + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(ahead[-1])
        marginal = np.exp(ahead + back - total)
        pairs = np.zeros_like(self.steps)
        pairs[3] = marginal[0]
        for i in range(1, n):
            pairs[:3] += np.exp(ahead[i - 1][:, None] + steps[:3] + (scores[i] + back[i])[None, :] - total)
        return marginal, pairs

    def tags(self, chain: list[list[str]], margin: float = 0.0) -> list[int]:
        """Best tags by Viterbi; ``margin`` is taken from every tag that is part of a secret."""
        scores, steps = self._scores(self._rows(chain)), self._allowed()
        scores[:, [BEGIN, INSIDE]] -= margin
        best, came = steps[3] + scores[0], []
        for row in scores[1:]:
            ways = best[:, None] + steps[:3]
            came.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        tag = int(best.argmax())
        out = [tag]
        for back in reversed(came):
            tag = int(back[tag])
            out.append(tag)
        return out[::-1]

    def dumps(self) -> str:
        return json.dumps({"names": self.names, "weights": self.weights.round(6).tolist(), "steps": self.steps.round(6).tolist()})

    @classmethod
    def loads(cls, data: str) -> Field:
        x = json.loads(data)
        return cls(x["names"], np.array(x["weights"]).reshape(-1, 3), np.array(x["steps"]))


def examples(text: str, lang: str | None, source: str | None) -> list[tuple[list[list[str]], list[int]]]:
    """Chains of a text with the tags the fixed patterns give them."""
    found = chains(text)
    if not found:
        return []
    spans = []
    for kind, start, end in base_spans(text):
        if kind == "assign":
            start = ASSIGN.match(text, start).start(2)
        spans.append((start, end))
    about = file_features(text, lang, source)
    out = []
    for chain in found:
        tags, last = [], None
        for a, b in chain:
            own = next((s for s in spans if a < s[1] and b > s[0]), None)
            tags.append(OUTSIDE if own is None else INSIDE if own == last else BEGIN)
            last = own
        out.append(([features(text, a, b, about) for a, b in chain], tags))
    return out


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    def own(c: str):
        return F.col(f"`{c}`").cast("string") if c in docs.columns else F.lit(None).cast("string")

    return docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), own("lang").alias("lang"), own("source").alias("source"))


def fit_field(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> Field:
    """Field fitted on about ``sample_rows`` rows, in one task; tables of fewer rows are taken whole.

    Without a secret among them, the field tags nothing.
    """
    rows = _rows(docs, key, text)
    total = rows.count()
    if total > sample_rows:
        rows = rows.filter(F.pmod(F.xxhash64("key", "text"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / total))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [json.dumps(e) for t, lang, source in zip(*[batch.column(c).to_pylist() for c in ("text", "lang", "source")]) for e in examples(t, lang, source)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["example"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = sorted({e for b in batches for e in b.column("example").to_pylist()})
        field = Field()
        parsed = [json.loads(e) for e in data]
        if any(t != OUTSIDE for _, tags in parsed for t in tags):
            order = np.random.default_rng(7).permutation(len(parsed))
            field.fit([parsed[i] for i in order], epochs)
        yield pa.RecordBatch.from_arrays([pa.array([field.dumps()])], names=["field"])

    found = rows.mapInArrow(given_back(collect), "example string").repartition(1).mapInArrow(given_back(fit), "field string").collect()
    return Field.loads(found[0].field) if found else Field()


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(docs: DataFrame, field: Field | None = None, key: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Every row's key with ``spans``: array of (kind, start, end) by start, then kind as in ``KINDS``.

    Base spans are all there; spans of the field (``crf``) do not overlap them. Without ``field`` one is fitted
    on ``docs``. Null and empty texts have no spans; an empty table gives no rows; equal rows give equal
    spans. Of other columns only lang and source are used, if there are any.
    """
    kept = (field or fit_field(docs, key, text)).dumps()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field.loads(kept)
        for batch in batches:
            out = [scan(t, lang, source, own, margin) for t, lang, source in zip(*[batch.column(c).to_pylist() for c in ("text", "lang", "source")])]
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in out]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, pa.list_(SPAN))], names=["key", "spans"])

    rows = _rows(docs, key, text)
    return rows.mapInArrow(given_back(run), f"key {dict(rows.dtypes)['key']}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("key", key)


def scan(text: str, lang: str | None, source: str | None, field: Field, margin: float = MARGIN) -> list[tuple[str, int, int]]:
    found = base_spans(text)
    if field.names and (tokens := chains(text)):
        about = file_features(text, lang, source)
        base = list(found)
        for chain in tokens:
            start = None
            tags = field.tags([features(text, a, b, about) for a, b in chain], margin)
            for (a, b), tag, then in zip(chain, tags, [*tags[1:], OUTSIDE]):
                if tag == BEGIN:
                    start = a
                if tag != OUTSIDE and then != INSIDE and not any(start < e and b > s for _, s, e in base):
                    found.append(("crf", start, b))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def mask_secrets(docs: DataFrame, field: Field | None = None, mark: str = "[secret]", margin: float = MARGIN) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, n_chars, ...) with every secret replaced by ``mark``.

    Where there is n_chars, it follows the new text. Null texts stay null.
    """
    kept = (field or fit_field(docs)).dumps()

    @F.pandas_udf("string")
    def masked(text, lang, source):
        import pandas as pd

        own, out = Field.loads(kept), []
        for t, l, s in zip(text, lang, source):
            if t is not None:
                parts, at = [], 0
                for _, a, b in scan(t, l, s, own, margin):
                    if a >= at:
                        parts += [t[at:a], mark]
                    at = max(at, b)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    none = F.lit(None).cast("string")
    done = docs.withColumn("text", masked(F.col("text").cast("string"), *[F.col(c).cast("string") if c in docs.columns else none for c in ("lang", "source")]))
    return done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else done


def digest(found: DataFrame) -> DataFrame:
    """Columns by which results are compared."""
    def told(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    return found.select("doc_id", *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
