"""One query per operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.llm import alignment, divergence, licenses, order_minhash, personal_data, phrases, pieces, secrets, simhash, suffix_dedup, token_files, toxicity, windows
from fathomry.session import apply_defaults, fresh_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return apply_defaults(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_sentencepiece")
def op1(spark, sf):
    """Piece ids of every text, and whether they decode to it."""
    docs, model = table(spark, sf, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")
    told = pieces.decode(pieces.encode(docs, model), model)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("same_text"))


@query("op2_token_files")
def op2(spark, sf):
    """Ids of every text, written to token files and read back."""
    folder = fresh_dir(apply_defaults(spark), "tokens")
    token_files.write_token_files(table(spark, sf, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, folder, with_ids=False)


@query(
    "op3_decontamination",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    n AS (SELECT item_id, w, CAST(least(10, len(w)) AS BIGINT) AS k FROM b WHERE len(w) > 0),
    i AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM n)),
    g AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
    m AS (SELECT doc_id, item_id, s, k FROM g JOIN i USING (k, g)),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
    x AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)""",
)
def op3(spark, sf):
    """Words of every document inside windows of test items."""
    index = phrases.build_index(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return phrases.digest(phrases.hits(index))


@query("op4_licenses")
def op4(spark, sf):
    """Licence wording of every text."""
    found = licenses.scan_licenses(table(spark, sf, "documents"))
    return found.drop("places")


@query(
    "op5_substring_dedup",
    r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d WHERE len(w) >= 35),
    h AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 34], ' ')) AS h FROM s),
    r AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
    p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM h SEMI JOIN r USING (h)),
    g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM p GROUP BY doc_id),
    k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN (SELECT doc_id, p AS i FROM p) USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)""",
)
def op5(spark, sf):
    """Every text without its repeated windows."""
    return windows.digest(windows.remove_repeats(table(spark, sf, "documents")))


@query("op10_order_minhash")
def op10(spark, sf):
    """Class of near-duplicates of every document."""
    return order_minhash.near_duplicates(table(spark, sf, "documents"))


@query("op6_secrets")
def op6(spark, sf):
    """Secrets in every text."""
    return secrets.digest(secrets.find_secrets(table(spark, sf, "documents")))


@query("op7_toxicity")
def op7(spark, sf):
    """Toxicity of every text by a chain fitted on the labels."""
    docs = table(spark, sf, "documents")
    chain = toxicity.fit_chain(docs, table(spark, sf, "labels"))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), chain).drop("text")


@query("op8_simhash")
def op8(spark, sf):
    """Fingerprints of every text and of its edited text."""
    return simhash.with_edited(table(spark, sf, "documents"))


@query("op9_personal_data")
def op9(spark, sf):
    """Personal data in every text."""
    return personal_data.digest(personal_data.find_personal_data(table(spark, sf, "documents")))


@query("op11_tokenizer_alignment")
def op11(spark, sf):
    """Groups and links of the tokens of two tokenizers over every text."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf, "documents"), *paths)


@query(
    "op12_source_divergence",
    r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
    c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
    v AS (SELECT lang, count(*) AS v, sum(n) AS s FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    a AS (SELECT lang, source, v, s AS ls, coalesce(u, 0) AS gs FROM g JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS u FROM c GROUP BY lang, source) USING (lang, source)),
    p AS (SELECT a.lang, a.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gs + 2 * v) AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (ls + 2 * v) AS q
      FROM a JOIN k USING (lang) LEFT JOIN c ON c.lang = a.lang AND c.source = a.source AND c.term = k.term),
    s AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
    r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
      UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 10""",
)
def op12(spark, sf):
    """How far the sources of each language lie apart, and the terms that mark them."""
    return divergence.divergence(table(spark, sf, "documents"))


@query(
    "op13_suffix_dedup",
    r"""WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
    s AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS x FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS i FROM d)),
    m AS (SELECT x, min(doc_id) AS first FROM s GROUP BY x HAVING count(*) > 1),
    g AS (SELECT doc_id, i, CASE WHEN i > 50 + lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS b FROM s JOIN m USING (x) WHERE first < doc_id),
    k AS (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
    p AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS e FROM k GROUP BY doc_id, run),
    t AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, max(e) AS last FROM p GROUP BY doc_id),
    q AS (SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS lo, a AS hi FROM p UNION ALL SELECT doc_id, last, n FROM t JOIN d USING (doc_id)),
    r AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN r USING (doc_id)""",
)
def op13(spark, sf):
    """Every text without what documents of smaller id have too."""
    return suffix_dedup.digest(suffix_dedup.remove_owned(table(spark, sf, "documents")))
