"""The queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aerolith.llm import collocations, exact_dedup, hard_negatives, jaccard_join, language_id, licenses, line_crf, lm_scoring, mixing, packing, quality_grade, token_files, toxicity
from aerolith.llm.common import documents

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(documents(spark, sf_dir))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM ranked
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
     - 2.0 * coalesce(CAST(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
     / CAST(sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed
), water AS (SELECT max(level) AS level FROM levels),
plan AS (
  SELECT source, source_size, least(2.0 * source_size, coalesce(water.level, 0) * weight) AS target FROM levels, water
), rated AS (
  SELECT s.doc_id, s.size, p.source_size, p.target,
    CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 AS u
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""

def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_grade.grade(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("detections")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(documents(spark, sf_dir))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _op9_sql() -> str:
    rules = ",\n".join(
        f"({r['id']}, {_sql_text(r['label'])}, {_sql_text(r['pattern'])}, [{', '.join(_sql_text(k) for k in r['keywords'])}], {r['priority']}, {r['confidence']})" for r in licenses.RULES
    )
    base = []
    for phrase, label in licenses.BASE:
        inner = _sql_text(f" {phrase.replace(' ', '  ')} ")
        n = len(phrase.split(" "))
        base.append(
            f"SELECT doc_id, {_sql_text(label)} AS label, len(string_split(spaced, {inner})) - 1 AS n, (len(string_split(split_part(spaced, {inner}, 1), ' ')) - 1) // 2 AS s,"
            f" n_words - (len(string_split(list_last(string_split(spaced, {inner})), ' ')) - 1) // 2 - {n} AS e FROM t WHERE contains(spaced, {inner})"
        )
    return f"""
WITH rules(id, label, pattern, keywords, priority, confidence) AS (VALUES {rules}),
n AS (SELECT doc_id, trim(regexp_replace({LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') AS norm FROM documents),
t AS (SELECT doc_id, ' ' || replace(norm, ' ', '  ') || ' ' AS spaced, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS n_words FROM n),
b AS ({' UNION ALL '.join(base)}),
bases AS (SELECT doc_id, sum(n) AS n_base, min(s) AS first_word, max(e) AS last_word, list(label) AS labels FROM b GROUP BY doc_id),
hits AS (
  SELECT doc_id, rules.*, regexp_extract_all(spaced, pattern) AS found, string_split_regex(spaced, pattern) AS gaps
  FROM t JOIN rules ON len(list_filter(keywords, lambda k: contains(spaced, ' ' || k || ' '))) > 0 WHERE regexp_matches(spaced, pattern)
),
places AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM hits),
spans AS (
  SELECT doc_id, id, label, priority, confidence,
    (len(replace(array_to_string(gaps[1:i], '') || array_to_string(found[1:i-1], ''), ' ', '--')) - len(array_to_string(gaps[1:i], '') || array_to_string(found[1:i-1], ''))) // 2 AS s,
    (len(replace(array_to_string(gaps[1:i], '') || array_to_string(found[1:i], ''), ' ', '--')) - len(array_to_string(gaps[1:i], '') || array_to_string(found[1:i], ''))) // 2 AS e
  FROM places
),
kept AS (
  SELECT * FROM spans a WHERE NOT EXISTS (
    SELECT 1 FROM spans o WHERE o.doc_id = a.doc_id AND o.s <= a.s AND o.e >= a.e
      AND (o.priority < a.priority OR (o.priority = a.priority AND (o.e - o.s > a.e - a.s OR (o.e - o.s = a.e - a.s AND o.id < a.id)))))
),
method AS (SELECT doc_id, list(label) AS labels, max(confidence) AS score FROM kept GROUP BY doc_id)
SELECT t.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(bases.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.labels, []), coalesce(method.labels, [])))), ',') AS labels,
  CAST(coalesce(method.score, 0) AS DOUBLE) AS score
FROM t LEFT JOIN bases ON bases.doc_id = t.doc_id LEFT JOIN method ON method.doc_id = t.doc_id
"""


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


OP12_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {LOWER} AS low FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(low, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
runs AS ({' UNION ALL '.join(f"SELECT lang, {m} AS m, unnest(list_transform(range(1, len(w) - {m} + 2), lambda i: array_to_string(w[i:i+{m - 1}], ' '))) AS phrase FROM w" for m in range(1, 6))}),
f AS (SELECT lang, m, phrase, count(*) AS a FROM runs GROUP BY lang, m, phrase),
n AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT f.lang, m, phrase, a, n, string_split(phrase, ' ') AS w FROM f JOIN n ON n.lang = f.lang WHERE m > 1 AND a >= 100),
cuts AS (SELECT c.*, unnest(range(1, m)) AS k FROM c),
scores AS (
  SELECT cuts.lang, cuts.m, cuts.phrase, cuts.a, cuts.n, k, h.a AS l, t.a AS r, CAST(CAST(1000 AS HUGEINT) * cuts.a * cuts.n // (CAST(h.a AS HUGEINT) * t.a) AS BIGINT) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = array_to_string(cuts.w[1:k], ' ') JOIN f t ON t.lang = cuts.lang AND t.phrase = array_to_string(cuts.w[k+1:cuts.m], ' ')
),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.m > b.m AND 100 * c.a >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked WHERE rank <= 2000
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS id
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.id AS a_id, a.vec_id AS anchor_id, o.vec_id, o.id, a.label = o.label AS same,
    CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(o.v)) + 1), lambda i: a.v[i] * o.v[i])), 0) AS BIGINT) AS score
  FROM r a JOIN r o ON a.id <> o.id WHERE a.vec_id % 100 = 0
),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY score DESC, vec_id, id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a_id, p.id ORDER BY n.score DESC, n.vec_id, n.id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a_id = p.a_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a_id, p.id ORDER BY n.score DESC, n.vec_id, n.id) <= 5
"""


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_language_id": op4_language_id,
    "op5_mix_sources": op5_mix_sources,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_line_quality": op7_line_quality,
    "op8_quality_grade": op8_quality_grade,
    "op9_license_scan": op9_license_scan,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_toxicity": op11_toxicity,
    "op12_collocations": op12_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}

_ORACLE = {"op2_exact_dedup": OP2_SQL, "op5_mix_sources": OP5_SQL, "op9_license_scan": _op9_sql(), "op12_collocations": OP12_SQL, "op13_hard_negatives": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
