"""Operator 1: SentencePiece encoding and decoding by a streaming Viterbi search.

The search walks over a text once. Each position keeps the best piece that ends there and the position
where that piece began. Pieces that are still to come can only begin in a window of ``longest`` positions;
whenever the backpointer paths of all reached positions in that window meet in one boundary, the pieces
before it can no longer change, and their ids are committed and forgotten.

Two kinds of model differ in what makes a path good.

* Unigram: the sum of the piece scores is greatest (ties: the longest last piece).
* Byte-pair merges: neighbouring pieces must be those that the merges make of their joined text. Such a
  path is unique for every prefix, because a merge across a boundary of the whole text would also happen
  in the joined text of the two pieces beside it. So the path score is 0 or minus infinity, and one piece
  per position survives. The ids are those of the reference library on the same file.

Two neighbouring characters that stand side by side in no piece are a boundary that every path passes.
Texts are cut there first, and since words return often, the ids of what lies between such boundaries are
remembered, at most ``REMEMBERED`` of them per task.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.llm.texts import given_back

MARK = "▁"
REMEMBERED = 200_000
UNKNOWN_PENALTY = 10.0
NEVER = float("-inf")
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialized protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


class Pieces:
    """Vocabulary of a model file. Texts are taken as they are: a model with a character map of its own is refused."""

    def __init__(self, data: bytes):
        self.kind, self.prefix, self.scores, self.pieces, self.kinds = UNIGRAM, True, [], [], []
        squeeze = True
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("the model rewrites characters; only models that keep texts as they are can be used")
                self.prefix, squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        if squeeze:
            raise ValueError("the model removes repeated spaces, so its texts do not come back")
        if self.kind not in (UNIGRAM, MERGES) or USER in self.kinds:
            raise ValueError("only unigram and merge models without user-defined pieces can be used")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = i
        self.score_of = {p: self.scores[i] for p, i in self.ids.items()}.get
        self.unknown = self.kinds.index(UNKNOWN)
        byte_ids = [i for i, k in enumerate(self.kinds) if k == BYTE]
        self.bytes = byte_ids if len(byte_ids) == 256 else None
        self.byte_of = {i: n for n, i in enumerate(byte_ids)}
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.separate = self.prefix and not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self._agree: dict[int | str, dict[int | str, bool]] = defaultdict(dict)
        self._known_pairs = 0
        self._word: dict[str, bytes] = {}
        self._part: dict[str, bytes] = {}

    # -- search ---------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The byte-pair merges of a short text: best score first, leftmost among equals."""
        parts, score = list(text), self.score_of
        gains = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while gains and (best := max(gains)) != NEVER:
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], NEVER)
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], NEVER)
        return parts

    def agree(self, left: int | str, right: int | str) -> bool:
        """Whether the merges leave these two pieces side by side; with "" on the left, whether they make ``right``.

        A character without a piece stands for itself.
        """
        row = self._agree[left]
        if right not in row:
            pair = [self.pieces[x] if isinstance(x, int) else x for x in (left, right) if x != ""]
            row[right] = self.merged("".join(pair)) == pair
            self._known_pairs += 1
            if self._known_pairs > 5 * REMEMBERED:
                self._agree.clear()
                self._known_pairs = 0
                return self.agree(left, right)
        return row[right]

    def segments(self, text: str) -> Iterator[int | str]:
        """Piece ids of a marked text in order, each as soon as it is certain; a character without a piece as it is."""
        longest, root, scores, unigram = self.longest, self.trie, self.scores, self.kind == UNIGRAM
        pairs, n, origin = self._agree, len(text), 0  # all before origin is committed and forgotten
        # Of position origin + i: the best piece that ends there, where it begins, and the path's score.
        last: list[int | str | None] = ["", *[None] * min(longest, n)]
        begin, score = [0] * len(last), [0.0] * len(last)
        for j in range(n):
            at = j - origin
            if at >= 4 * longest and (meet := self._meeting(last, begin, at)):
                yield from self._path(last, begin, meet)
                # the last piece before the boundary stays, for the pair test
                last, begin, score = last[meet:], [x - meet for x in begin[meet:]], score[meet:]
                origin += meet
                at -= meet
            if origin + len(last) <= n:
                last.append(None)
                begin.append(0)
                score.append(0.0)
            left = last[at]
            row = pairs[left]
            node, to = root, at
            while to + origin < n:
                char = text[to + origin]
                node = node.get(char)
                to += 1
                piece = None if node is None else node.get("")
                if piece is None:
                    if to == at + 1:
                        piece = char
                    elif node is None:
                        break
                    else:
                        continue
                if unigram:
                    value = score[at] + (scores[piece] if piece is not char else self.worst)
                    if last[to] is None or value > score[to]:
                        last[to], begin[to], score[to] = piece, at, value
                elif last[to] is None:
                    good = row.get(piece)
                    if good is None:
                        good = self.agree(left, piece)
                        row = pairs[left]
                    if good:
                        last[to], begin[to] = piece, at
                if node is None:
                    break
        yield from self._path(last, begin, n - origin)

    @staticmethod
    def _meeting(last: list[int | str | None], begin: list[int], at: int) -> int:
        """Boundary in which the paths of all positions from ``at`` on meet; 0 if they don't yet."""
        live = {i for i in range(at, len(last)) if last[i] is not None}
        while len(live) > 1 and (top := max(live)) > 0:
            live.remove(top)
            live.add(begin[top])
        return live.pop() if len(live) == 1 else 0

    @staticmethod
    def _path(last: list[int | str | None], begin: list[int], at: int) -> list[int | str]:
        out = []
        while at > 0:
            out.append(last[at])
            at = begin[at]
        return out[::-1]

    # -- ids ------------------------------------------------------------------------------------

    def _ids(self, marked: str) -> bytes:
        out: list[int] = []
        for piece in self.segments(marked):
            if isinstance(piece, int):
                out.append(piece)
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return np.array(out, dtype="<i4").tobytes()

    def _cut(self, marked: str) -> bytes:
        """ids of a text that is cut at every boundary no piece can span."""
        out, at, beside = [], 0, self.beside
        for i in range(1, len(marked) + 1):
            if i == len(marked) or marked[i - 1 : i + 1] not in beside:
                part, at = marked[at:i], i
                ids = self._part.get(part)
                if ids is None:
                    ids = self._ids(part)
                    if len(part) <= 32:
                        if len(self._part) >= REMEMBERED:
                            self._part.clear()
                        self._part[part] = ids
                out.append(ids)
        return b"".join(out)

    def _of_word(self, word: str) -> bytes:
        ids = self._cut(MARK + word)
        if len(word) <= 32:
            if len(self._word) >= REMEMBERED:
                self._word.clear()
            self._word[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """ids as little-endian 32-bit integers; null and empty texts have none."""
        if not text:
            return b""
        if self.separate and self.bytes and "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text:
            known, words = self._word.get, text.split(" ")
            return b"".join([known(w) or self._of_word(w) for w in words])
        ids = self._cut((MARK if self.prefix else "") + text.replace(" ", MARK))
        if self.bytes is None:  # neighbouring unknown characters are one unknown piece
            found = np.frombuffer(ids, dtype="<i4")
            ids = found[np.insert((found[1:] != self.unknown) | (found[:-1] != self.unknown), 0, True)].tobytes()
        return ids

    @cached_property
    def spelled(self) -> list[bytes]:
        """What each id stands for."""
        out = []
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind == BYTE:
                out.append(bytes([self.byte_of[i]]))
            elif kind == UNKNOWN:
                out.append(" ⁇ ".encode())
            else:
                out.append(b"" if kind == CONTROL else piece.replace(MARK, " ").encode())
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text: bytes joined to characters, marks to spaces, the first space dropped. Control ids give nothing."""
        text = b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    with open(path, "rb") as file:
        return Pieces(file.read())


def _model(path: str, shipped: bool) -> Pieces:
    return load(SparkFiles.get(path) if shipped else path)


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", shipped: bool = False) -> DataFrame:
    """Every row with its piece ids in column ``ids`` (array<int>), which replaces one of that name.

    ``model`` is a path every executor has, or with ``shipped`` the name of a file given to
    ``SparkContext.addFile``. Null and empty texts have no ids. Rows stay as many as they are, repeated or not;
    other columns are kept as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model, shipped)
        for batch in batches:
            rows = [pieces.encode(x) for x in batch.column("_t").to_pylist()]
            ends = np.cumsum([0, *[len(r) // 4 for r in rows]], dtype=np.int64).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, found], names=[*names, "_ids"])

    names = [c for c in docs.columns if c != ids]
    inner = {c: f"_{i}" for i, c in enumerate(names)}
    narrow = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in names], F.col(f"`{text}`").cast("string").alias("_t"))
    kinds = dict(narrow.dtypes)
    outer, names = names, [inner[c] for c in names]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "_ids array<int>"])
    done = narrow.mapInArrow(given_back(run), schema)
    return done.select(*[F.col(inner[c]).alias(c) for c in outer], F.col("_ids").alias(ids))


def decode(encoded: DataFrame, model: str, ids: str = "ids", text: str = "decoded", shipped: bool = False) -> DataFrame:
    """Every row with the text of its ids in column ``text``; null ids give null, no ids the empty text."""

    @F.pandas_udf("string")
    def run(column):
        pieces = _model(model, shipped)
        return column.map(lambda x: None if x is None else pieces.decode(np.asarray(x, dtype=np.int64)))

    return encoded.withColumn(text, run(F.col(f"`{ids}`")))
