"""One query per operator of this subpackage, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, chat, exact_dedup, ivfpq, license_scan, mixing, packing, quality, simhash, toxicity
from .common import table

#: The conversation that the first query adds: its texts hold the template's own control strings.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -1L AS conv_id, CAST(n AS BIGINT) AS turn, role, '{CONTROL_TEXT}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(n, role)")
    both = messages.unionByName(extra).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("content"))
    return chat.digests(chat.format_conversations(both))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, packing.public_encoder_paths(), with_ids=False)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return quality.score_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_simhash": op2_simhash,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_packing": op4_packing,
        "op5_quality": op5_quality,
        "op6_class_lm": op6_class_lm,
        "op7_nearest": op7_nearest,
        "op8_toxicity": op8_toxicity,
        "op9_license_scan": op9_license_scan,
        "op10_source_mix": op10_source_mix,
    }


_CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'
), x AS (
  SELECT *, replace(replace(role, '%', '%25'), chr(10), '%0A') AS r, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS b FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, b)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, b) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + len(regexp_extract_all(r, '<\\\\*\\|')) + length(b) + {len(chat.START) + len(chat.END) + 2})::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""

_EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, 3 * source_size AS most, 3 * source_size / weight AS level FROM w
), c AS (
  SELECT *, level <= ((total - coalesce(sum(most) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS stopped FROM l
), t AS (
  SELECT source, source_size, CASE WHEN stopped THEN most::DOUBLE ELSE
    (total - coalesce(sum(most) FILTER (WHERE stopped) OVER (), 0))::DOUBLE / (sum(weight) FILTER (WHERE NOT stopped) OVER ())::DOUBLE * weight END AS target FROM c
), r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, ('0x' || substr(md5('mix:' || d.doc_id), 1, 15))::BIGINT, d.doc_id) - 1 AS rank,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS each,
    ('0x' || substr(md5('mix:' || coalesce('s' || d.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (least(floor(u + each * (rank + 1)) - floor(u + each * rank), 3) * size)::BIGINT AS taken FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": _CHAT_SQL, "op3_exact_dedup": _EXACT_SQL, "op10_source_mix": _MIX_SQL}
