"""Alignment against both libraries and plain loops over every pair of overlapping tokens."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from fathomry.llm import alignment
from tests.conftest import SF

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PLAIN = {**{b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
SIGNS = PLAIN | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PLAIN)}


def brute_force(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    byte_model = Tokenizer.from_file(PATHS[0])
    byte_model.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    back = {c: b for b, c in SIGNS.items()}
    spelled = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    tokens, total = [], Counter()
    for text in texts:
        text = text or ""
        a = [(i, bytes(back[c] for c in byte_model.id_to_token(i))) for i in byte_model.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, spelled(pieces.id_to_piece(i))) for i in pieces.encode(text)]
        wanted = (" " + text).encode()
        if not text or b"".join(x for _, x in a) != wanted or b"".join(x for _, x in b) != wanted:
            tokens.append(([], [], []))
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        found, first = [], 0
        for i, lo, hi in spans[0]:
            while spans[1][first][2] <= lo:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][1] < hi:
                found.append((i, spans[1][k][0]))
                k += 1
        total.update(found)
        tokens.append((*spans, found))
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    out = []
    for a, b, found in tokens:
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in (a, b)))
            lo = hi
        name = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(a), len(b), len(cuts), len(found), sum(total[x] == most[x[1]] for x in found), sum(total[x] for x in found), name))
    return out


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted((str(k), *w) for (k, _), w in zip(rows, brute_force([t for _, t in rows])))
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted((str(r.doc_id), *[r[c] for c in columns]) for r in alignment.align(docs, *PATHS).collect())
    assert got == want
    return got


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 50_000)
    monkeypatch.setattr(alignment, "BUCKET", 2_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = docs.filter("length(text) < 4000")  # the plain loop over groups is quadratic
    assert short.count() > 50
    check(short.repartition(3))


def test_odd_rows(docs_of, odd_texts):
    odd = [*odd_texts[:5], "word " * 300, "x" * 500, "7" * 400, *odd_texts[8:]]
    odd += ["▁", "a▁b", "<|endoftext|> and <s> </s> <unk>", "<0x41>", "\0", "é́ ﬁ ①", " leading", "two  spaces ", "line\n\nline\t x", "🙂🙂", " x y"]
    got = check(docs_of(odd))
    assert len(got) == len(odd)
    assert sum(r[1] == 0 for r in got) >= 4  # null, empty, and texts with the mark itself


def test_copies_count_as_often_as_they_stand(docs_of):
    got = check(docs_of(["the same words here", "the same words here", "other words", None, None], [1, 1, None, None, 7]))
    assert got.count(got[0]) == 2


@pytest.mark.parametrize("text", ["don't we'll  x", "日本語 テキスト", "a1b2 c3"])
def test_links_are_tokens_less_groups(docs_of, text):
    row = alignment.align(docs_of([text]), *PATHS).first()
    assert row.n_links == row.n_a + row.n_b - row.n_groups > 0


def test_empty_table(docs_of):
    assert alignment.align(docs_of([]), *PATHS).collect() == []
