"""Registered queries over whole tables, each next to its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import centroids, decontamination, jaccard_join, licenses, mixing, packing, quality_model, quality_rules, quote_links, secret_scan, token_counts, token_files, vector_codes
from gridloom.llm.common import table
from gridloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op3_token_files")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS symbols
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':42'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / CASE WHEN size > 0 THEN size::DOUBLE / (size + 10 * symbols) ELSE 1 END AS key
  FROM sized),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM sources),
room AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS remaining,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
  FROM ranked
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, cap * weights <= remaining * weight AS is_full FROM room),
targets AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN cap::DOUBLE
         ELSE (weight * (sum(source_size) OVER () - coalesce(sum(cap) FILTER (is_full) OVER (), 0)))::DOUBLE
              / (sum(weight) FILTER (NOT is_full) OVER ()) END AS target
  FROM filled),
units AS (SELECT source, key, doc_id, sum(size) AS size FROM keyed GROUP BY ALL),
walked AS (
  SELECT u.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM units u)
SELECT w.doc_id, CAST(w.size AS BIGINT) AS size, t.source_size, t.target,
  CAST(w.size * (CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END
    + CASE WHEN 2 * w.before + w.size < 2 * (t.target - CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END * t.source_size)
           THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM walked w JOIN targets t ON w.source IS NOT DISTINCT FROM t.source
"""


@query("op4_mixing", OP4_SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_token_counts")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


OP6_SQL = r"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
         CAST(coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS BIGINT) AS n_symbols,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
positions AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM base WHERE len(w) >= 3),
windows AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS c FROM positions),
repeated AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS o) WHERE c >= 2 GROUP BY doc_id),
metrics AS (
  SELECT b.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM base b LEFT JOIN repeated r USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM metrics),
entries AS (
  SELECT doc_id, lang, source, base_failed, metric,
         CASE metric WHEN 'symbols' THEN n_symbols WHEN 'dup_lines' THEN n_dup_lines WHEN 'repeats' THEN n_repeat_words ELSE word_chars END::DOUBLE
         / greatest(CASE metric WHEN 'dup_lines' THEN n_lines ELSE n_words END, 1) AS v
  FROM judged, (SELECT unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS metric)),
sketch AS (
  SELECT lang, source, metric, CASE WHEN v > 0 THEN CAST(ceil(round(ln(v) / ln(1.02::DOUBLE), 6)) AS BIGINT) ELSE -1000000 END AS bucket, count(*) AS n
  FROM entries WHERE NOT base_failed GROUP BY ALL),
walked AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS total,
         round(CASE WHEN bucket = -1000000 THEN 0 ELSE pow(1.02::DOUBLE, bucket) * (2 / 2.02::DOUBLE) END, 9) AS value
  FROM sketch),
quartiles AS (
  SELECT lang, source, metric, min(value) FILTER (upto > floor((total - 1) * 0.25)) AS q25, min(value) FILTER (upto > floor((total - 1) * 0.5)) AS q50,
         min(value) FILTER (upto > floor((total - 1) * 0.75)) AS q75
  FROM walked GROUP BY ALL),
fences AS (
  SELECT *, q50 + 6 * greatest(q75 - q50, s) AS high, CASE WHEN metric = 'word_length' THEN q50 - 6 * greatest(q50 - q25, s) ELSE -1 END AS low
  FROM (SELECT *, CASE metric WHEN 'symbols' THEN 0.05::DOUBLE WHEN 'dup_lines' THEN 0.1::DOUBLE WHEN 'repeats' THEN 0.05::DOUBLE ELSE 0.3::DOUBLE END AS s FROM quartiles)),
verdicts AS (
  SELECT e.doc_id, coalesce(bool_and(v <= high AND v >= low), false) AS inside
  FROM entries e LEFT JOIN fences f ON e.lang IS NOT DISTINCT FROM f.lang AND e.source IS NOT DISTINCT FROM f.source AND e.metric = f.metric
  GROUP BY e.doc_id)
SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed, NOT j.base_failed AND v.inside AS kept
FROM judged j JOIN verdicts v USING (doc_id)
"""


@query("op6_quality_rules", OP6_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# The fences of the query above are those of its twin, which knows no parent groups.
@query("op6_pooled_rules")
def op6_pooled(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf, "documents"), pooled=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_secrets")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[s : s + 9], ' ') AS phrase, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d), lengths WHERE p + n - 1 <= len(w)),
hits AS (SELECT doc_id, p, n, item_id FROM places JOIN windows USING (phrase, n)),
words AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM hits, (SELECT unnest(range(0, 10)) AS o) WHERE o < n GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op9_decontamination", OP9_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


# The columns of the query above are those of its twin; the twin does not state proximity.
@query("op9_proximity")
def op9_proximity(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_near", "near_items")


@query("op5_quality_model")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return quality_model.classified(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op7_jaccard_join")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.linked_groups(table(spark, sf, "documents"), width=3, percent=90)


@query("op1_quote_links")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return quote_links.linked_conversations(table(spark, sf, "conversations"))


@query("op2_licenses")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf, "documents"))


@query("op11_packing")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.packed_sequences(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _floor_of(s: str, n: str) -> str:
    """SQL of ``floor(s / n)`` of whole numbers; DuckDB's own division cuts towards zero."""
    return f"CAST(({s} - (({s} % {n}) + {n}) % {n}) // {n} AS BIGINT)"


SQUARE = "CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)"


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND {FINITE}),
c0 AS MATERIALIZED (
  SELECT j, x FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS j, x FROM v) WHERE j < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, min({{'d': d, 'j': j}}) AS best FROM (SELECT v.r, c.j, {SQUARE.format(a="v.x", b="c.x")} AS d FROM v, c{i} c) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT j, list(q ORDER BY p) AS x FROM (
      SELECT j, p, {_floor_of("sum(e)", "count(*)")} AS q
      FROM (SELECT best.j AS j, unnest(x) AS e, unnest(range(64)) AS p FROM a{i} JOIN v USING (r)) GROUP BY j, p) GROUP BY j) m USING (j))""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(best.j AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.j = best.j
"""


@query("op12_ns_bounds", _op12_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf, "embeddings"))


def _op13_sql(parts: int = 4, size: int = 256, rounds: int = 4) -> str:
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE {FINITE}),
s AS MATERIALIZED (SELECT r, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS y FROM v, range({parts}) t(p)),
c0 AS MATERIALIZED (
  SELECT p, e, y FROM s JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM v) USING (r) WHERE e < {size})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, p, min({{'d': d, 'e': e}}) AS best FROM (SELECT s.r, s.p, c.e, {SQUARE.format(a="s.y", b="c.y")} AS d FROM s JOIN c{i} c USING (p)) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.y, c.y) AS y FROM c{i} c LEFT JOIN (
    SELECT p, e, list(q ORDER BY k) AS y FROM (
      SELECT p, e, k, {_floor_of("sum(z)", "count(*)")} AS q
      FROM (SELECT p, best.e AS e, unnest(y) AS z, unnest(range(len(y))) AS k FROM a{i} JOIN s USING (r, p)) GROUP BY p, e, k) GROUP BY p, e) m USING (p, e))""")
    return ",".join(steps) + f""",
codes AS (
  SELECT r, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM codes JOIN v USING (r)
"""


@query("op13_vector_codes", _op13_sql())
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf, "embeddings"))
