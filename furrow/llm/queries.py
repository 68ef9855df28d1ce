"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import line_dedup
from furrow.llm.filter_audit import audit
from furrow.llm.fingerprints import with_neighbours
from furrow.llm.language_id import held_out, identify
from furrow.llm.lm_score import lm_scores
from furrow.llm import periodic, pieces, toxicity
from furrow.llm.packing import pack
from furrow.llm.quality import quality_rules
from furrow.llm.simhash import near_duplicates
from furrow.llm.texts import documents
from furrow.llm.token_counts import token_counts
from furrow.llm.url_filter import DAMPING, ROUNDS, RULES, THRESHOLD, judge


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids and compares."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(documents(spark, sf_dir), model)
    return pieces.round_trip(encoded, model)


def op2_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(documents(spark, sf_dir))


def op3_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(documents(spark, sf_dir), carry=["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest_columns(line_dedup.drop_lines(documents(spark, sf_dir), limit=10, least=1, carry=["doc_id"]))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=4, distance=4)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), carry=["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "far", "kept"
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score(docs, model, carry=["doc_id"])
    return found.select(
        "row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = periodic.planted_periods(documents(spark, sf_dir))
    return periodic.digest_columns(periodic.periodic_runs(texts, least=24, power=3, carry=["doc_id"]))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_weighted_sampling": op2_weighted_sampling,
    "op3_partial_matching": op3_partial_matching,
    "op4_language_id": op4_language_id,
    "op5_pattern_packing": op5_pattern_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash": op7_simhash,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filter": op9_url_filter,
    "op10_token_counts": op10_token_counts,
    "op11_toxicity": op11_toxicity,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
}

OP6 = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
    FROM documents
), keyed AS (
    SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), repeated AS (
    SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(r.k) AS n_dropped,
    sha256(coalesce(string_agg(CASE WHEN r.k IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated r ON keyed.k = r.k
GROUP BY doc_id
"""

OP13 = r"""
WITH docs AS MATERIALIZED (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), firsts AS (
    SELECT text, min(doc_id) AS first_id FROM docs GROUP BY text
), judged AS MATERIALIZED (
    SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
        len(words) < 200 AS A, 100 * len(list_distinct(words)) < 50 * len(words) AS B,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS C,
        regexp_matches(text, '[#$%&*|]') AS D, first_id < d.doc_id AS E
    FROM (SELECT d.*, first_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs d JOIN firsts USING (text)) d
    LEFT JOIN labels USING (doc_id)
), combos AS MATERIALIZED (
    SELECT part, list_filter([CASE WHEN A THEN 'A' END, CASE WHEN B THEN 'B' END, CASE WHEN C THEN 'C' END,
        CASE WHEN D THEN 'D' END, CASE WHEN E THEN 'E' END], lambda x: x IS NOT NULL) AS failed,
        count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM judged GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
    SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[:step - 1], '') AS earlier
    FROM orders, (SELECT unnest(range(1, 6)) AS step)
), counted AS (
    SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (NOT list_contains(failed, own) AND NOT list_has_any(failed, earlier)), 0) AS kept,
        coalesce(sum(n) FILTER (list_contains(failed, own) AND NOT list_has_any(failed, earlier)), 0) AS removed,
        coalesce(sum(n) FILTER (list_contains(failed, own) AND list_has_any(failed, earlier)), 0) AS redundant,
        coalesce(sum(n) FILTER (failed = [own]), 0) AS unique_fails,
        coalesce(sum(good) FILTER (list_contains(failed, own) AND NOT list_has_any(failed, earlier)), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (list_contains(failed, own) AND NOT list_has_any(failed, earlier)), 0) AS toxic_lost
    FROM combos, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""


def url_filter_sql() -> str:
    """The walk of op9, one pair of tables per round."""
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(k, h + p, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for k, h, p in rules]
    name = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for _, n, c in fits) + " END"
    kind = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, _, c in fits) + " END"
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    rounds = ""
    for i in range(1, ROUNDS + 1):
        sums = ", ".join(
            f"sum(CASE WHEN {'ahead' if v in ('trust', 'weight') else 'NOT ahead'} THEN w * {v} ELSE 0 END) AS {v}"
            for v in ("trust", "weight", "distrust", "gravity")
        )
        mixed = ", ".join(f"{1 - DAMPING} * f.{v} + {DAMPING} * s.{v} AS {v}" for v in ("trust", "weight", "distrust", "gravity"))
        rounds += f"""
, v{i} AS MATERIALIZED (
    SELECT f.host, {mixed}
    FROM v0 f JOIN (SELECT "to" AS host, {sums} FROM edges JOIN v{i - 1} USING (host) GROUP BY 1) s ON f.host = s.host
)"""
    return rf"""
WITH parts AS MATERIALIZED (
    SELECT page_id, html,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {lower}) AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), parsed AS MATERIALIZED (
    SELECT page_id, host, path, {name} AS rule, {kind} AS kind, html FROM parts
), links AS MATERIALIZED (
    SELECT source, target, count(*) AS n FROM (
        SELECT host AS source, translate(regexp_extract(
            unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1)),
            '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), {lower}) AS target
        FROM parsed WHERE host <> ''
    ) WHERE target <> '' AND target <> source GROUP BY ALL
), counted AS (
    SELECT host, count(*) / sum(count(*)) OVER () AS pages, count(*) FILTER (kind = 'allow') / sum(count(*)) OVER () AS good,
        count(*) FILTER (kind = 'block') / sum(count(*)) OVER () AS bad
    FROM parsed WHERE host <> '' GROUP BY host
), hosts AS MATERIALIZED (
    FROM counted UNION ALL SELECT DISTINCT target, 0, 0, 0 FROM links WHERE target NOT IN (SELECT host FROM counted)
), edges AS MATERIALIZED (
    SELECT source AS host, target AS "to", n / sum(n) OVER (PARTITION BY source) AS w, true AS ahead FROM links
    UNION ALL SELECT target, source, n / sum(n) OVER (PARTITION BY target), false FROM links
    UNION ALL SELECT host, host, 1, true FROM hosts WHERE host NOT IN (SELECT source FROM links)
    UNION ALL SELECT host, host, 1, false FROM hosts WHERE host NOT IN (SELECT target FROM links)
), v0 AS MATERIALIZED (
    SELECT host, good AS trust, pages AS weight, bad AS distrust, pages AS gravity FROM hosts
){rounds}
, bad AS (
    SELECT host FROM v{ROUNDS}
    WHERE CASE WHEN gravity > 0 THEN distrust / gravity ELSE 0 END - CASE WHEN weight > 0 THEN trust / weight ELSE 0 END > {THRESHOLD}
)
SELECT page_id, host, path, rule,
    coalesce(kind, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed
"""


ORACLES: dict[str, str] = {
    "op6_line_dedup": OP6,
    "op9_url_filter": url_filter_sql(),
    "op13_filter_audit": OP13,
}
