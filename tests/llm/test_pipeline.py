"""The pipeline's rows against its operators' tests by hand: each stage on what the one before kept."""

import sentencepiece
import public_tokenizers

import corpus_pipeline
from fathomry.llm import secrets, toxicity
from tests.conftest import SF
from tests.llm.test_order_minhash import classes
from tests.llm.test_phrases import brute


def test_run_equals_plain_stages(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.fit_chain(docs, labels)
    features = toxicity.Features(chain.features)
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {k: r for k, r in rows.items() if max(chain.probabilities([features.of(r.text.encode())])[0]) < toxicity.THRESHOLD}
    first = classes([(k, r.text) for k, r in kept.items()])
    kept = {k: r for k, r in kept.items() if (str(k), str(k)) in first}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = brute([r.text for r in kept.values()], items)
    kept = {k: r for (k, r), found in zip(kept.items(), clean) if not found[-1]}
    field = secrets.fit_field(spark.createDataFrame(list(kept.values()), docs.schema))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for k, r in kept.items():
        text, parts, at = r.text, [], 0
        for _, a, b in secrets.scan(text, r.lang, r.source, field):
            if a >= at:
                parts += [text[at:a], "[secret]"]
            at = max(at, b)
        want[k] = library.encode("".join([*parts, text[at:]]))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < len(rows)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        assert stage(spark, docs, SF).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "pieces"]
