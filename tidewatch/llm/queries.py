"""Queries that apply the operators to whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    byte_bpe,
    conversations,
    decontaminate,
    hard_negatives,
    licenses,
    mixing,
    neardup,
    pii,
    ranking,
    rules,
    tokens,
    toxicity,
    urls,
)
from tidewatch.llm.common import table
from tidewatch.session import staged


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as token ids in flat files, and what the files hold."""
    return tokens.tokens_of(table(spark, folder, "documents"), tokenizer_path())


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity score."""
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL judged by rules and terms."""
    return urls.judge_urls(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items in documents."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    return pii.personal_data(table(spark, folder, "documents"))


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's class of near duplicates, by shingles of two words."""
    return neardup.near_duplicates(table(spark, folder, "documents"), n=2)


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License notices in documents."""
    return licenses.license_notices(table(spark, folder, "documents"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's counts and verdict, with its source as its domain."""
    return rules.quality_rules(table(spark, folder, "documents")).select(
        "doc_id", *rules.COUNTS, "base_failed", "kept")


def sized_documents(docs: DataFrame) -> DataFrame:
    """Documents with their words counted and their source as the only one they belong to."""
    return docs.withColumns({"size": mixing.n_words(F.col("text")), "sources": F.array(F.col("source").cast("string"))})


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    sized = staged(sized_documents(table(spark, folder, "documents")).select("doc_id", "size", "sources"))
    mix = mixing.plan_mix(sized)
    sources = mixing.listed(spark, mix.sources, "name string, source_size long, target double")
    taken = mixing.apply_mix(sized, mix).select(
        "doc_id", "size", F.col("sources")[0].alias("source"), (F.col("times") * F.col("size")).alias("taken"))
    return taken.join(sources, F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", "size", "source_size", "target", "taken")


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality score."""
    return ranking.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, after some labels are moved on."""
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.hard_negatives(rows, vec_id % 100 == 0)


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded by byte-level BPE and decoded again."""
    import public_tokenizers

    docs = table(spark, folder, "documents")
    return byte_bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation damaged, judged and repaired."""
    return conversations.damaged_and_repaired(table(spark, folder, "conversations"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_toxicity": op2_toxicity,
    "op3_url_filters": op3_url_filters,
    "op4_decontamination": op4_decontamination,
    "op5_personal_data": op5_personal_data,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_license_scan": op7_license_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_mixing": op9_mixing,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_conversation_repair": op13_conversation_repair,
}

_WORD = r"[^\x20\x09-\x0D]"

#: All pairs that share a shingle, then the smallest document that links lead to.
NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{_WORD}+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.c + y.c - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id,
  coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""

_FAILURES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "n_symbols > n_words / 10.0",
    "duplicate_lines": "n_dup_lines >= 10",
    "word_length": "word_chars > 20 * n_words OR word_chars < 2 * n_words",
}


def _shrunken(rule: str) -> str:
    mean = f"least(greatest(avg(d_{rule} / docs) OVER (), 1e-6), 1 - 1e-6)"
    spread = f"coalesce(var_samp(d_{rule} / docs) OVER (), 0)"
    weight = f"""least(greatest(CASE WHEN {spread} > 0 THEN {mean} * (1 - {mean}) / {spread} - 1
      ELSE 1000.0 END, 2.0), 1000.0)"""
    return f"(d_{rule} + {mean} * {weight}) / (docs + {weight})"


QUALITY_RULES = rf"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM t),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS win FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) u(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY 1),
f AS (SELECT w.doc_id, source, len(ws) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(cov.c, 0) AS n_repeat_words FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
d AS (SELECT source, count(*) AS docs,
  {", ".join(f"count(*) FILTER ({test}) AS d_{rule}" for rule, test in _FAILURES.items())} FROM f GROUP BY 1),
v AS (SELECT source, greatest({", ".join(map(_shrunken, _FAILURES))}) <= 0.5 AS good FROM d),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source"""

#: All anchors with all rows.
HARD_NEGATIVES = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS p
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    list_inner_product(a.p, b.p)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""

SQL: dict[str, str] = {
    "op3_url_filters": urls.judge_urls_sql(),
    "op6_near_duplicates": NEAR_DUPLICATES,
    "op8_quality_rules": QUALITY_RULES,
    "op11_hard_negatives": HARD_NEGATIVES,
}
