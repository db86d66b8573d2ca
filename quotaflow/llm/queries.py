"""The thirteen operators as registered queries, and the SQL of those that SQL can
express. Each query reads its whole tables and derives the contract's columns
from its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaflow.llm.bpe_tree import decode_ids, encode_texts
from quotaflow.llm.decontaminate import contamination
from quotaflow.llm.html_text import extract_text
from quotaflow.llm.jaccard_join import near_duplicates
from quotaflow.llm.language_id import language_id
from quotaflow.llm.line_dedup import drop_frequent_lines
from quotaflow.llm.lm_scoring import lm_scores
from quotaflow.llm.mixing import mix_sources
from quotaflow.llm.periodic_runs import planted, run_digest, run_tables
from quotaflow.llm.quality import quality_bands
from quotaflow.llm.token_counts import token_tables
from quotaflow.llm.toxicity import toxicity
from quotaflow.llm.whitening import whiten

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "repeats", "part_words")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bands(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "zstd_ratio", "bad_chunks")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_tables(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(BYTE_TOKENIZER)
    coded = decode_ids(encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", "n_tokens", F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    return run_digest(run_tables(docs))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


REGISTRY = {f.__name__: f for f in (
    op1_mixing, op2_language_id, op3_decontamination, op4_quality_rules, op5_jaccard_join, op6_token_counts,
    op7_html_extraction, op8_toxicity, op9_lm_scoring, op10_line_dedup,
    op11_bpe_tree, op12_periodic_runs, op13_whitening)}

# Words of the decontamination contract: A-Z lower-cased, other ASCII than 0-9 and letters parts them.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)
),
met AS (SELECT doc_id, size, s, item_id FROM dw JOIN bw USING (size, win)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT doc_id, s, size FROM met)) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS named
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM met) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(named, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
),
often AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (k IN (SELECT k FROM often)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k NOT IN (SELECT k FROM often)), '')) AS kept_sha256
FROM l GROUP BY doc_id
"""

# crc32 of the decimal doc_id, eight shifts a byte (0: next byte comes in; polynomial 0xEDB88320 = 3988292384).
_CRC = """CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
    string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295) AS BIGINT)"""

OP12_SQL = rf"""
WITH d AS (
  SELECT doc_id, {_CRC} AS h, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
z AS (SELECT doc_id, h, w, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS k FROM d),
p AS (SELECT *, 1 + (n - a) // k AS p FROM z),
l AS (
  SELECT doc_id, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END AS x
  FROM (SELECT *, unnest(range(0, n)) AS i FROM p)
),
often AS (SELECT doc_id, x FROM l GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT l.* FROM l JOIN often USING (doc_id, x)),
size AS (SELECT doc_id, len(w) AS n FROM d),
same AS (
  SELECT a.doc_id, b.i - a.i AS q, a.i FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i JOIN size ON size.doc_id = a.doc_id
  WHERE 3 * (b.i - a.i) <= n
),
isles AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM same),
wide AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM isles GROUP BY doc_id, q, isle HAVING count(*) + q >= greatest(24, 3 * q)
),
runs AS (
  SELECT * FROM wide r WHERE NOT EXISTS (
    SELECT 1 FROM wide o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.len >= r.s + r.len)
),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS all_runs FROM runs GROUP BY doc_id
),
best AS (
  SELECT r.doc_id, s, len, q FROM runs r
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) = 1
),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS words FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(len AS BIGINT) AS length,
  CAST(q AS BIGINT) AS period, CAST(1000 * len // q AS BIGINT) AS exponent_milli, sha256(coalesce(all_runs, '')) AS runs_sha256,
  sha256(coalesce(words, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE = {"op3_decontamination": OP3_SQL, "op10_line_dedup": OP10_SQL, "op12_periodic_runs": OP12_SQL}
