"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bpe, decontaminate, html_extract, language, license_scan, lm, neardup, preference, quality, topk
from lodestrata.llm.session import table


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.classify(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_tokens", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


OP6_SQL = r"""
WITH split AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS words FROM documents
), one AS (
    SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM split
), three AS (
    SELECT doc_id, i, w, lag(w) OVER place AS v, lag(w, 2) OVER place AS u FROM one WINDOW place AS (PARTITION BY doc_id ORDER BY i)
), c1 AS (SELECT w, count(*) AS n FROM one GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM three WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM three WHERE u IS NOT NULL GROUP BY u, v, w),
scored AS (
    SELECT t.doc_id, CASE
        WHEN c3.n IS NOT NULL THEN ln(c3.n) - ln(h2.n)
        WHEN c2.n IS NOT NULL THEN ln(c2.n) - ln(h1.n) + CASE WHEN i >= 2 THEN ln(0.4) ELSE 0 END
        ELSE ln(c1.n) - ln((SELECT count(*) FROM one)) + least(i, 2) * ln(0.4) END AS s
    FROM three t JOIN c1 ON c1.w = t.w
    LEFT JOIN c3 ON c3.u = t.u AND c3.v = t.v AND c3.w = t.w
    LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w
    LEFT JOIN c2 h2 ON h2.v = t.u AND h2.w = t.v
    LEFT JOIN c1 h1 ON h1.w = t.v
)
SELECT d.doc_id, count(s) AS n_tokens, round(coalesce(sum(s), 0), 6) AS log_score, round(avg(s), 6) AS mean_log_score
FROM documents d LEFT JOIN scored USING (doc_id) GROUP BY d.doc_id
"""


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = preference.render(preference.pairs(table(spark, sf_dir, "conversations")))
    flat = {f"{c}_mask": F.array_join(F.transform(f"{c}_mask", lambda x: F.concat_ws("-", x.cast("array<string>"))), ",") for c in ("chosen", "rejected")}
    return made.withColumns(flat)


OP7_SQL = r"""
WITH heard AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM heard
), final AS (
    SELECT conv_id, max(i) AS last FROM placed WHERE role = 'assistant' GROUP BY conv_id
), answer AS (
    SELECT p.conv_id, p.i AS last, p.text AS good, string_split(p.text, ' ') AS words FROM placed p JOIN final f ON p.conv_id = f.conv_id AND p.i = f.last
), stale AS (
    SELECT a.conv_id, arg_max(p.text, p.i) AS text FROM answer a JOIN placed p ON p.conv_id = a.conv_id AND p.i < a.last AND p.role = 'assistant' AND p.text <> a.good GROUP BY a.conv_id
), prompt AS (
    SELECT a.conv_id, coalesce(string_agg('<|im_start|>' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10), '' ORDER BY p.i), '') AS prompt
    FROM answer a LEFT JOIN placed p ON p.conv_id = a.conv_id AND p.i < a.last GROUP BY a.conv_id
), both_answers AS (
    SELECT a.conv_id, a.last, p.prompt, good, coalesce(s.text, array_to_string(words[1:(len(words) // 2)], ' ')) AS bad
    FROM answer a JOIN prompt p ON p.conv_id = a.conv_id LEFT JOIN stale s ON s.conv_id = a.conv_id
), shown AS (
    SELECT *, '<|im_start|>assistant' || chr(10) || good || '<|im_end|>' || chr(10) AS g, '<|im_start|>assistant' || chr(10) || bad || '<|im_end|>' || chr(10) AS b FROM both_answers
)
SELECT conv_id, CASE WHEN good = bad THEN last ELSE last - 1 END AS prompt_turns,
    CASE WHEN good = bad THEN prompt || g ELSE prompt END AS prompt,
    CASE WHEN good = bad THEN '' ELSE g END AS chosen_completion,
    CASE WHEN good = bad THEN '' ELSE '22-' || length(g) END AS chosen_mask,
    CASE WHEN good = bad THEN '' ELSE b END AS rejected_completion,
    CASE WHEN good = bad THEN '' ELSE '22-' || length(b) END AS rejected_mask
FROM shown
"""


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 is a query, against all vectors."""
    embeddings = table(spark, sf_dir, "embeddings")
    found = topk.search(embeddings, embeddings.where("vec_id % 100 = 0"))
    return found.withColumn("score", F.round("score", 9))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.identify(documents, language.fit(documents))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_html_extraction, op3_bpe, op4_quality_classifier, op5_decontamination, op6_lm_scores, op7_preference_format, op8_license_scan, op9_language_id, op10_topk_search)}
ORACLES = {"op6_lm_scores": OP6_SQL, "op7_preference_format": OP7_SQL, "op10_topk_search": topk.search_sql(asked="a.vec_id % 100 = 0")}
