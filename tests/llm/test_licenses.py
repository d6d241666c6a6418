"""Automata against regular expressions and hand-made texts."""

import re

import pytest

from fathomry.llm import licenses
from fathomry.llm.texts import fold_words
from tests.conftest import SF


def accepted(markup, text):
    auto = licenses.compile_template("t", markup)
    words = fold_words(text.encode())
    return [(i, e) for i in range(len(words)) if (e := auto.longest(words, i)) > i]


def test_optional_and_replaceable_regions():
    markup = 'Copyright <<beginOptional>>(c) <<beginOptional>>by<<endOptional>><<endOptional>> <<var;match="1..3">> All rights reserved'
    for text in ("Copyright X. All rights reserved.", "copyright (C) by X Y Z, ALL rights reserved", "Copyright c x all rights reserved"):
        assert accepted(markup, text)[0][1] == len(fold_words(text.encode()))
    for text in ("Copyright all rights reserved", "Copyright a b c d e f all rights reserved", "Copyright X all rights are reserved", "Copyright X all rights"):
        assert not accepted(markup, text)


def test_replaceable_region_may_be_empty_and_longest_wins():
    assert accepted('a <<var;match="0..2">> b', "a b x b b") == [(0, 4)]


@pytest.mark.parametrize("markup", ["x <<beginOptional>> y", "x <<endOptional>>", '<<var;match="0..1">> x', ""])
def test_bad_markup_is_refused(markup):
    with pytest.raises(ValueError):
        licenses.compile_template("t", markup)


def brute(text):
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    found = []
    for label, phrase in licenses.PHRASES.items():
        p = phrase.encode().split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_base_columns(spark, docs_of, odd_texts):
    texts = [*odd_texts, "All rights reserved. ALL RIGHTS reserved CC-BY cc by", "the General Public\nLicense", "Licensed under CC BY-NC 4.0."]
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs_of(texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(","))
    assert "cc-by-nc-notice" in rows[len(texts) - 1].labels and rows[len(texts) - 1].score == 1.0


def test_whole_table_and_empty(spark, docs_of):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.scan_licenses(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
    assert licenses.scan_licenses(docs_of([])).collect() == []
