"""Piece ids against the sentencepiece library on the same file, and against all segmentations of short texts."""

import itertools
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomry.llm import pieces
from tests.conftest import SF

PATH = public_tokenizers.path("piece_bpe_32k.model")


def ids_of(model, text):
    return np.frombuffer(model.encode(text), dtype="<i4").tolist()


def field(number, kind, data):
    return bytes([number << 3 | kind]) + (bytes([len(data)]) if kind == 2 else b"") + data


def unigram(vocabulary):
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), *[(p, s, 1) for p, s in vocabulary.items()]]
    out = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in rows)
    return pieces.Pieces(out + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(4, 0, b"\x00")))


@pytest.fixture(scope="module")
def model():
    return pieces.load(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abceinorst ▁\n,.é🙂0", max_size=120))
def test_same_ids_as_the_library(model, library, text):
    assert ids_of(model, text) == library.encode(text)
    if "▁" not in text:
        assert model.decode(np.array(library.encode(text), dtype=np.int64)) == text


def test_long_text_without_a_boundary_is_committed_in_parts(model, library):
    text = "internationalization" * 2000
    assert ids_of(model, text) == library.encode(text)
    streamed = model.segments("▁" + text)
    first = [next(streamed) for _ in range(5)]
    assert first == library.encode(text)[:5]


VOCABULARY = {"▁": -2.0, "a": -3.1, "b": -3.3, "ab": -4.05, "ba": -4.4, "aba": -5.15, "▁a": -3.7, "bb": -9.0}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab ", min_size=1, max_size=9))
def test_unigram_has_the_best_sum(text):
    model = unigram(VOCABULARY)
    marked = "▁" + text.replace(" ", "▁")
    best = -1e9
    for cuts in itertools.product((0, 1), repeat=len(marked) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(marked[at:i])
                at = i
        parts.append(marked[at:])
        if all(p in VOCABULARY for p in parts):
            best = max(best, sum(VOCABULARY[p] for p in parts))
    own = sum(model.scores[i] for i in ids_of(model, text))
    assert own == pytest.approx(best, abs=1e-4)
    assert model.decode(np.array(ids_of(model, text))) == text


def test_unknown_characters_side_by_side_are_one_piece():
    model = unigram(VOCABULARY)
    assert ids_of(model, "azzb").count(model.unknown) == 1


def test_table_round_trip(spark, docs_of, odd_texts, library):
    docs = docs_of(odd_texts)
    coded = pieces.encode(docs, PATH)
    assert coded.columns == [*docs.columns, "ids"]
    rows = {r.doc_id: r for r in pieces.decode(coded, PATH).collect()}
    assert len(rows) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        assert rows[i].ids == library.encode(text or "")
        assert rows[i].decoded == (text or "")


def test_empty_table(docs_of):
    assert pieces.encode(docs_of([]), PATH).collect() == []


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in pieces.encode(docs, PATH).select("text", "ids").collect():
        assert r.ids == library.encode(r.text)


def test_query_encodes_and_decodes_the_whole_table(spark, library):
    from fathomry.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids, r.same_text) == (len(ids), ids, library.decode(ids) == texts[r.doc_id])
