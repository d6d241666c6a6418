"""Files against the tokenizer applied to each text."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fathomry.llm import token_files
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def expected(tokenizer, rows):
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1] or "")):
        ids = ids_of(tokenizer, text)
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("text", ["a b", " lead", "trail ", "a  b", "a \nb", "a\n\nb c", "don't, we'll.", "x\u0085 y", "a\tb c", "q\r w", "<|endoftext|> x", "12,5. z", "　x y", "é x.\ny"])
def test_ids_of_awkward_white_space(tokenizer, text):
    encoder = token_files.Encoder(PATH)
    for _ in range(2):
        assert np.frombuffer(encoder.encode([text])[0], dtype=encoder.dtype).tolist() == ids_of(tokenizer, text)[:-1]


def test_odd_rows(spark, docs_of, odd_texts, tokenizer, tmp_path):
    ids = [5, None, 3, 2, 2, 1, 0, 9, 8, 7, 4, 4]
    docs = docs_of(odd_texts, ids)
    token_files.write_token_files(docs, str(tmp_path), PATH)
    got = [tuple(r) for r in token_files.read_token_files(spark, str(tmp_path)).orderBy("start").collect()]
    assert got == expected(tokenizer, list(zip(ids, odd_texts)))


def test_parts_follow_each_other_and_map(spark, tokenizer, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_token_files(docs, str(tmp_path), PATH).orderBy("base").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(manifest) > 1 and manifest[1].base == manifest[0].tokens
    ids, offsets, keys, _ = token_files.map_part(str(tmp_path), manifest[1].part, manifest[1].id_bytes)
    assert isinstance(ids, np.memmap) and ids.dtype == np.uint16 and offsets.dtype == np.int64
    text = docs.filter(f"doc_id = {keys[0]}").first().text
    assert ids[: offsets[1]].tolist() == ids_of(tokenizer, text)
    got = [tuple(r) for r in token_files.read_token_files(spark, str(tmp_path)).orderBy("start").collect()]
    assert got == expected(tokenizer, [(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark, docs_of, tmp_path):
    token_files.write_token_files(docs_of([]), str(tmp_path), PATH)
    assert token_files.read_token_files(spark, str(tmp_path)).collect() == []
