"""Queries of the learning cycle: history of analyses, tuning patterns, the tuned configuration, how far a cycle goes, its status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import feedback as fb
from sievework.operators import sessions as se
from sievework.operators import tuning
from sievework.plans.analytics import _A, _F, _PAIRS, _S, _avg, _feedback, _joined, _sessions


def _history(spark: SparkSession, d: str) -> DataFrame:
    return tuning.analyses(fb.analysed(_joined(spark, d)))


def analysis_history(spark: SparkSession, d: str) -> DataFrame:
    """The weekly analyses with their issues as text."""
    issues = F.array_join(F.transform(F.array_sort(F.map_entries("issue_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "+")
    return _history(spark, d).select("timestamp", "total_analyzed", F.bround("avg_rating_diff", 6).alias("avg_rating_diff"), F.bround("avg_sentiment", 6).alias("avg_sentiment"), issues.alias("issues"))


def tuning_patterns(spark: SparkSession, d: str) -> DataFrame:
    return tuning.tuning_patterns(_history(spark, d))


def algorithm_config(spark: SparkSession, d: str) -> DataFrame:
    """Weights and thresholds after the patterns of enough confidence."""
    return tuning.config_rows(spark, tuning.tuned(tuning.tuning_patterns(_history(spark, d))))


def learning_cycle(spark: SparkSession, d: str) -> DataFrame:
    """How far a cycle goes whose last one was 30 days before the latest feedback."""
    f = _feedback(spark, d)
    last = f.agg((F.max("created_ts") - F.expr("interval 30 days")).alias("at"))
    return tuning.cycle(f, fb.analysed(_joined(spark, d)), tuning.tuning_patterns(_history(spark, d)), last)


def learning_status(spark: SparkSession, d: str) -> DataFrame:
    """One row: analytics, learning metrics, analyses in the history with the latest, and patterns found."""
    f, s, h = _feedback(spark, d), _sessions(spark, d), _history(spark, d)
    a = se.system_analytics(s, f).select("total_sessions", "total_feedback", "avg_auto_rating", "avg_user_rating", "success_rate")
    m = fb.learning_metrics(f, s).select(*(F.bround(c, 1).alias(c) for c in ("override_rate", "algorithm_accuracy", "feedback_coverage")))
    last = h.agg(F.least(F.count("*"), F.lit(5)).alias("recent_analyses"), F.max("timestamp").alias("last_analysis"))
    p = tuning.tuning_patterns(h).agg(F.count("*").alias("patterns"))
    return a.crossJoin(m).crossJoin(last).crossJoin(p)  # of one row each


QUERIES = {f.__name__: f for f in (analysis_history, tuning_patterns, algorithm_config, learning_cycle, learning_status)}

# --- the same in SQL ---------------------------------------------------------------------------------------------------------

_H = _S + _F + _A.format(src="j") + f""",
an AS (SELECT *, date_trunc('week', created_ts) AS w FROM a), ic AS (SELECT w, issue, count(*) AS c FROM (SELECT w, unnest(issues) AS issue FROM an) GROUP BY 1, 2),
h AS (SELECT w, count(*) AS n, {_avg('rating_diff')} AS d, {_avg('sentiment')} AS m FROM an GROUP BY 1)
"""
_P = _H + """,
l AS (SELECT * FROM h ORDER BY w DESC LIMIT 10), o AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(CAST(d * n AS DECIMAL(24, 9))) AS DOUBLE) / sum(n) AS d, CAST(sum(CAST(m * n AS DECIMAL(24, 9))) AS DOUBLE) / sum(n) AS m FROM l HAVING sum(n) > 0),
ti AS (SELECT issue, CAST(sum(c) AS BIGINT) AS c FROM ic WHERE w IN (SELECT w FROM l) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
tp AS (SELECT 1 AS position, CASE WHEN d < 0 THEN 'system_too_optimistic' ELSE 'system_too_pessimistic' END AS type, 'thresholds' AS action, NULL::VARCHAR AS factor, round_even(sign(d) * least(0.05, abs(d) * 0.02), 9) AS amount, round_even(least(0.9, n / 20), 9) AS confidence, n AS sample_size FROM o WHERE abs(d) > 0.5 AND n >= 5
UNION ALL SELECT 2, issue || '_weight_adjustment', 'weight', issue, 0.05, round_even(least(0.8, c / n), 9), n FROM o, ti WHERE c >= 3 AND c / n > 0.3
UNION ALL SELECT 3, 'negative_sentiment_trend', 'thresholds', NULL, -0.03, 0.7, n FROM o WHERE m < -0.2 AND n >= 5)
"""
SQL = {
    "analysis_history": _H + "SELECT w AS timestamp, n AS total_analyzed, round_even(d, 6) AS avg_rating_diff, round_even(m, 6) AS avg_sentiment, coalesce((SELECT string_agg(issue || '=' || c, '+' ORDER BY issue) FROM ic WHERE ic.w = h.w), CASE WHEN false THEN '' END) AS issues FROM h",
    "tuning_patterns": _P + "SELECT * FROM tp",
    # At most one shift, one weight and one shift apply, in this order.
    "algorithm_config": _P + """,
k AS (SELECT coalesce(max(amount) FILTER (position = 1 AND confidence >= 0.6), 0) AS s1, max(factor) FILTER (position = 2 AND confidence >= 0.6) AS f, coalesce(max(amount) FILTER (position = 3), 0) AS s3 FROM tp),
w0 AS (SELECT * FROM (VALUES ('quality', 0.3), ('speed', 0.2), ('completeness', 0.25), ('deduplication', 0.15), ('errors', 0.1)) t(name, v)),
w1 AS (SELECT name, v::DOUBLE AS v, f, least(0.5, (SELECT v FROM w0 WHERE name = f) + 0.05)::DOUBLE AS top, (SELECT sum(v) FROM w0 WHERE name <> f)::DOUBLE AS rest FROM w0, k),
t0 AS (SELECT * FROM (VALUES (5, 'quality', 0.9), (5, 'speed', 0.8), (5, 'completeness', 0.9), (4, 'quality', 0.8), (4, 'speed', 0.7), (4, 'completeness', 0.8), (3, 'quality', 0.7), (3, 'speed', 0.6), (3, 'completeness', 0.7), (2, 'quality', 0.6), (2, 'speed', 0.5), (2, 'completeness', 0.6)) t(rating, name, v)),
t1 AS (SELECT rating, name, CASE WHEN s1 <> 0 THEN greatest(0.3, least(0.95, v + s1)) ELSE v END AS v, s3 FROM t0, k)
SELECT 'weight' AS kind, NULL::INT AS rating, name, round_even(CASE WHEN f IS NULL THEN v WHEN name = f THEN top ELSE v / rest * (1 - top) END, 9) AS value FROM w1
UNION ALL SELECT 'threshold', rating, name, round_even(CASE WHEN s3 <> 0 THEN greatest(0.3, least(0.95, v + s3)) ELSE v END, 9)::DOUBLE FROM t1""",
    "learning_cycle": _P + """,
c AS (SELECT (SELECT count(*) FROM f WHERE NOT is_auto AND created_ts > (SELECT max(created_ts) FROM f) - INTERVAL 30 DAY) AS new_feedback, (SELECT count(*) FROM a) AS analysed, (SELECT count(*) FROM tp) AS patterns, (SELECT count(*) FROM tp WHERE confidence >= 0.6) AS applicable)
SELECT *, CASE WHEN new_feedback < 10 THEN 'wait' WHEN analysed < 10 THEN 'analyse' WHEN patterns < 2 THEN 'recognise' ELSE 'tune' END AS stage FROM c""",
    "learning_status": _P + _PAIRS + """SELECT ns AS total_sessions, nf AS total_feedback, round_even(aa, 2) AS avg_auto_rating, round_even(ur, 2) AS avg_user_rating, round_even(ok * 100.0 / ns, 2)::DOUBLE AS success_rate,
round_even(round_even(u * 100.0 / nf, 6), 1)::DOUBLE AS override_rate, round_even(round_even(accuracy * 100, 6), 1) AS algorithm_accuracy, round_even(round_even(nf * 100.0 / ns, 6), 1)::DOUBLE AS feedback_coverage, least((SELECT count(*) FROM h), 5) AS recent_analyses, (SELECT max(w) FROM h) AS last_analysis, (SELECT count(*) FROM tp) AS patterns
FROM (SELECT count(*) AS ns, count(*) FILTER (status = 'success') AS ok FROM s), (SELECT count(*) AS nf, count(*) FILTER (NOT is_auto) AS u, avg(rating) FILTER (is_auto) AS aa, avg(rating) FILTER (NOT is_auto) AS ur FROM f), acc""",
}
