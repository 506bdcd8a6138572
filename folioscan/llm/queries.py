"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.chat import END, MAX_TURNS, NOBODY, SYSTEM, rotate_perspectives
from folioscan.llm.exact_dedup import exact_dedup
from folioscan.llm.html_text import extract_pages
from folioscan.llm.line_crf import quality_scores
from folioscan.llm.line_dedup import MIN_SITES, dedup_lines
from folioscan.llm.mixing import mix_sources
from folioscan.llm.packing import pack_documents
from folioscan.llm.secrets import scan_secrets
from folioscan.llm.simhash import simhash_groups
from folioscan.llm.vector_search import nearest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: four-word shingles, links at four or fewer bits."""
    out = simhash_groups(_table(spark, sf_dir, "documents"), words=4, limit=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_pages(_table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by the line model."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to the contract's weights, targets and caps."""
    return mix_sources(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without boilerplate lines, as a digest of what is kept."""
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed", F.length("kept_text").cast("bigint").alias("n_kept_chars"), F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in bins; exact copies and documents of one source never share one."""
    return pack_documents(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates in all documents with the forest's verdict."""
    out = scan_secrets(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "line_no", "start", "stop", F.sha2(F.encode("value", "UTF-8"), 256).alias("value_sha256"), "probability", "is_secret")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; of equal texts the largest doc_id stays."""
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from every participant's perspective, the mask as text."""
    out = rotate_perspectives(_table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string")))
    return out.withColumn("mask", F.array_join(spans, ","))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all others: the ten nearest found."""
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP4_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    greatest(0.05, coalesce(length(regexp_replace(text, '[\x21-\x26\x28-\x2B\x2F-\x39\x3C-\x40\x5B-\x60\x7B-\x7E]+', '', 'g'))
      / CAST(nullif(length(text), 0) AS DOUBLE), 0.05)) AS weight,
    (CAST(('0x' || substring(md5(CAST(doc_id AS VARCHAR) || '|0'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
keyed AS (SELECT doc_id, source, size, -ln(u) / weight AS key FROM sized),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
ranked AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM src),
capped AS (SELECT *, source_size * 3.0::DOUBLE AS most, sum(source_size) OVER () AS total FROM ranked),
levels AS (SELECT *, row_number() OVER (ORDER BY most / w, source NULLS LAST) AS place, (total - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
chosen AS (SELECT *, (SELECT min_by(level, place) FROM levels WHERE most / w >= level) AS lv FROM levels),
targets AS (SELECT source, source_size, least(most, w * coalesce(lv, 'inf'::DOUBLE)) AS target,
    CASE WHEN source_size > 0 THEN CAST(floor(least(most, w * coalesce(lv, 'inf'::DOUBLE)) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM chosen),
placed AS (SELECT k.doc_id, k.size, t.source_size, t.target, t.epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, CAST(least(3, epochs + CASE WHEN start + size / 2.0::DOUBLE < target - epochs * source_size THEN 1 ELSE 0 END) AS INTEGER) AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies, CAST(copies * size AS BIGINT) AS taken FROM counted
"""

OP5_SQL = rf"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
    unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents),
m AS (SELECT *, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM l),
b AS (SELECT line FROM m WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES} AND count(DISTINCT text) > 1),
k AS (SELECT doc_id, CAST(count(*) FILTER (WHERE line IN (FROM b)) AS BIGINT) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE line NOT IN (FROM b)), '') AS kept FROM m GROUP BY doc_id)
SELECT doc_id, n_removed, CAST(length(kept) AS BIGINT) AS n_kept_chars, sha256(kept) AS kept_sha256 FROM k
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP9_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS body,
    coalesce(regexp_replace(replace(replace(replace(role, '\', '\\'), '"', '\"'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g'), '{NOBODY}') AS name FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name, body) AS k FROM t),
p AS (SELECT DISTINCT conv_id, name AS perspective FROM t WHERE name <> '{SYSTEM}'),
v AS (
  SELECT r.*, (k - 1) // {MAX_TURNS} AS part, p.perspective, r.name = p.perspective AS own,
    CASE WHEN r.name = p.perspective THEN '<|assistant|>' WHEN r.name = '{SYSTEM}' THEN '<|system|>'
      ELSE '<|user name="' || r.name || '"|>' END || chr(10) AS header
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, sum(length(header) + length(body) + {len(END) + 1}) OVER w - length(body) - {len(END) + 1} AS own_start
  FROM v WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT conv_id, CAST(part AS BIGINT) AS part, perspective, CAST(count(*) AS BIGINT) AS n_turns, CAST(count(*) FILTER (WHERE own) AS BIGINT) AS n_own,
  CAST(sum(length(header) + length(body) + {len(END) + 1}) AS BIGINT) AS n_chars, CAST(min(own_start - length(header)) AS BIGINT) AS start,
  string_agg(header || body || '{END}' || chr(10), '' ORDER BY k) AS rendered,
  coalesce(string_agg(CASE WHEN own THEN CAST(own_start AS VARCHAR) || '-' || CAST(own_start + length(body) + {len(END)} AS VARCHAR) END, ',' ORDER BY k), '') AS mask
FROM o GROUP BY conv_id, part, perspective
"""

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_secrets": op7_secrets,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_nearest": op10_nearest,
}

ORACLE_SQL = {
    "op4_mixing": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_chat_formatting": OP9_SQL,
}
