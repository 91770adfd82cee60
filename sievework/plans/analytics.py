"""Queries over sessions, feedback and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import feedback as fb
from sievework.operators import scoring
from sievework.operators import sessions as se
from sievework.sources.tables import read_table


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return se.last_rows(read_table(spark, d, "processing_sessions"))


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    return fb.clean_feedback(read_table(spark, d, "user_feedback"))


def _joined(spark: SparkSession, d: str) -> DataFrame:
    return fb.joined(_feedback(spark, d), _sessions(spark, d))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "performance_metrics").dropDuplicates(["metric_id"])


def system_analytics(spark: SparkSession, d: str) -> DataFrame:
    return se.system_analytics(_sessions(spark, d), _feedback(spark, d))


def performance_trends(spark: SparkSession, d: str) -> DataFrame:
    return se.performance_trends(_metrics(spark, d), _sessions(spark, d))


def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def session_quality(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("session_id", scoring.quality_score(F.col("chunk_results"), F.col("dedup_stats"), F.col("final_entries_count")).alias("quality_score"))


def session_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = _sessions(spark, d)
    r, n = F.col("chunk_results"), scoring.n_chunks(F.col("chunk_results"))
    return s.select("session_id", n.alias("chunk_count"), scoring.n_chunks(r, "error").alias("error_count"), F.bround(F.coalesce(scoring.dedup_rate(F.col("dedup_stats")), F.lit(0.0)) * 100, 2).alias("deduplication_efficiency"), F.bround(scoring.ratio(F.col("seconds"), n), 6).alias("avg_chunk_time"))


def auto_rating(spark: SparkSession, d: str) -> DataFrame:
    s = _sessions(spark, d).withColumn("speed_stars", scoring.speed_stars(F.col("total_pages"), F.col("seconds"))).withColumn("completeness_stars", scoring.completeness_stars(F.col("final_entries_count"), F.col("total_pages")))
    s = s.withColumn("dedup_stars", scoring.dedup_stars(F.col("dedup_stats"))).withColumn("error_stars", scoring.error_stars(F.col("chunk_results"), F.col("total_chunks")))
    rating = scoring.rating(F.col("extraction_quality_score"), F.col("speed_stars"), F.col("completeness_stars"), F.col("dedup_stars"), F.col("error_stars"))
    return s.select("session_id", "speed_stars", "completeness_stars", "dedup_stars", "error_stars", rating.alias("rating"), F.bround(rating).cast("int").alias("stored_rating"))


def feedback_text(spark: SparkSession, d: str) -> DataFrame:
    s = _sessions(spark, d)
    return s.select("session_id", scoring.feedback_text(F.col("extraction_quality_score"), F.col("total_pages"), F.col("seconds"), F.col("dedup_stats"), F.col("final_entries_count")).alias("feedback_text"))


def session_summary(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("session_id", "status", "total_pages", "total_chunks", "final_entries_count", F.bround("seconds", 2).alias("processing_time"), "extraction_quality_score", "user_rating")


def recent_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The ten latest sessions."""
    return _sessions(spark, d).orderBy(F.desc("created_ts"), "session_id").limit(10).select("session_id", "created_ts", "status")


def size_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).groupBy(se.group_key().alias("group_key")).agg(F.count("*").alias("n"), scoring.exact_avg(F.col("extraction_quality_score")).alias("avg_quality"))


def learned_patterns(spark: SparkSession, d: str) -> DataFrame:
    return se.learned_patterns(_sessions(spark, d), recent=None)


def optimal_parameters(spark: SparkSession, d: str) -> DataFrame:
    return se.optimal_parameters(se.learned_patterns(_sessions(spark, d), recent=None), pages=3, size=90_000)


def optimization_baseline(spark: SparkSession, d: str) -> DataFrame:
    return se.optimization_baseline(_sessions(spark, d))


def optimization_detect(spark: SparkSession, d: str) -> DataFrame:
    s = _sessions(spark, d)
    return se.optimizations(s, se.optimization_baseline(s))


def active_optimizations(spark: SparkSession, d: str) -> DataFrame:
    return se.active_optimizations(optimization_detect(spark, d)).select("optimization_type", "confidence_score")


def feedback_joined(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).select("feedback_id", F.col("key").alias("session_id"), "rating", "auto_rating", "status")


def feedback_analysis(spark: SparkSession, d: str) -> DataFrame:
    a = fb.analysed(_joined(spark, d))
    return a.select("feedback_id", F.array_join("keywords", "+").alias("keywords"), F.array_join("issues", "+").alias("issues"), "sentiment", "rating_diff", "disagreement_type")


def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return fb.issue_counts(fb.analysed(_joined(spark, d)))


def improvement_suggestions(spark: SparkSession, d: str) -> DataFrame:
    recent = fb.recent_user_comments(_feedback(spark, d), 20)
    return fb.improvement_suggestions(fb.analysed(fb.joined(recent, _sessions(spark, d))))


def speed_patterns(spark: SparkSession, d: str) -> DataFrame:
    return fb.speed_patterns(_joined(spark, d))


def quality_patterns(spark: SparkSession, d: str) -> DataFrame:
    return fb.quality_patterns(_joined(spark, d))


def size_bias_patterns(spark: SparkSession, d: str) -> DataFrame:
    return fb.size_bias_patterns(_joined(spark, d))


def disagreement_histogram(spark: SparkSession, d: str) -> DataFrame:
    return fb.disagreement_histogram(_joined(spark, d))


def pattern_summary(spark: SparkSession, d: str) -> DataFrame:
    return fb.pattern_summary(fb.all_patterns(_joined(spark, d), min_confidence=0.0))


def algorithm_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return fb.algorithm_accuracy(_feedback(spark, d))


def latest_feedback_per_session(spark: SparkSession, d: str) -> DataFrame:
    return fb.latest_per_session(_feedback(spark, d))


def session_feedback_update(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with the rating and text of their latest user feedback."""
    return fb.with_latest_feedback(_sessions(spark, d), _feedback(spark, d)).select("session_id", "user_rating", "user_feedback_text")


def learning_metrics(spark: SparkSession, d: str) -> DataFrame:
    return fb.learning_metrics(_feedback(spark, d), _sessions(spark, d))


def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    return fb.recent_activity(_feedback(spark, d))


_NAMES = (
    system_analytics, performance_trends, status_histogram, session_quality, session_metrics, auto_rating, feedback_text, session_summary, recent_sessions, size_buckets,
    learned_patterns, optimal_parameters, optimization_baseline, optimization_detect, active_optimizations, feedback_joined, feedback_analysis, issue_counts,
    improvement_suggestions, speed_patterns, quality_patterns, size_bias_patterns, disagreement_histogram, pattern_summary, algorithm_accuracy,
    latest_feedback_per_session, session_feedback_update, learning_metrics, recent_activity,
)
QUERIES = {f.__name__: f for f in _NAMES}

# --- the same in SQL ---------------------------------------------------------------------------------------------------------

_S = """
WITH raw AS (SELECT DISTINCT ON (session_id) * FROM processing_sessions WHERE session_id IS NOT NULL
             ORDER BY session_id, received_ts DESC NULLS LAST, coalesce(user_rating, -1) DESC),
s AS (SELECT *, CASE WHEN NOT isnan(total_processing_time) AND total_processing_time >= 0 THEN total_processing_time END AS seconds,
        len(list_filter(coalesce(chunk_results, []), lambda c: c.status = 'success')) AS ok_chunks, len(list_filter(coalesce(chunk_results, []), lambda c: c.status = 'error')) AS bad_chunks,
        len(coalesce(chunk_results, [])) AS n_chunks,
        CASE WHEN coalesce(dedup_stats.initial_count, 0) <> 0 THEN CAST(dedup_stats.initial_count - coalesce(dedup_stats.final_count, 0) AS DOUBLE) / dedup_stats.initial_count END AS dedup,
        'pages_' || CASE WHEN total_pages <= 3 THEN '1-3' WHEN total_pages <= 6 THEN '4-6' WHEN total_pages <= 10 THEN '7-10' ELSE '10+' END
        || '_size_' || CASE WHEN file_size < 100000 THEN 'small' WHEN file_size < 500000 THEN 'medium' ELSE 'large' END AS group_key FROM raw)
"""
_F = """,
f AS (SELECT *, nullif(lower(trim(session_id, ' ' || chr(9) || chr(10) || chr(13))), '') AS key, coalesce(starts_with(feedback_id, 'auto_'), false) AS is_auto
      FROM (SELECT DISTINCT ON (feedback_id) * FROM user_feedback ORDER BY feedback_id, received_ts DESC NULLS LAST, coalesce(rating, -1) DESC)),
au AS (SELECT DISTINCT ON (key) key, rating AS auto_rating FROM f WHERE is_auto AND key IS NOT NULL ORDER BY key, created_ts, feedback_id),
j AS (SELECT f.feedback_id, f.key, f.rating, f.feedback_text, f.created_ts, s.seconds, coalesce(s.file_size, 0) AS file_size, s.extraction_quality_score, s.status, coalesce(au.auto_rating, 0) AS auto_rating
      FROM f JOIN s ON f.key = lower(trim(s.session_id)) LEFT JOIN au ON au.key = f.key WHERE NOT f.is_auto)
"""


def _avg(c: str) -> str:
    return f"(CAST(sum(CAST({c} AS DECIMAL(20, 6))) AS DOUBLE) / count({c}))"


_WORDS = {k: "[" + ", ".join(f"'{w}'" for w in ws) + "]" for k, ws in fb.ISSUES.items()}
_ALL_WORDS = "[" + ", ".join(f"'{w}'" for w in sorted({w for ws in fb.ISSUES.values() for w in ws})) + "]"


def _hits(words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(feedback_text), '{w}') AS INT)" for w in words) + ")"


def _said(words: list[str]) -> str:
    return "((" + " OR ".join(f"contains(lower(coalesce(feedback_text, '')), '{w}')" for w in words) + ") AND rating < auto_rating)"


_A = (
    """,
a0 AS (SELECT *, list_sort(list_distinct(list_filter(regexp_extract_all(lower(feedback_text), '\\w+'), lambda w: list_contains("""
    + _ALL_WORDS
    + """, w)))) AS kw, rating - auto_rating AS rating_diff, list_filter(regexp_split_to_array(lower(feedback_text), '\\s+'), lambda w: w <> '') AS ws FROM {src} WHERE regexp_matches(feedback_text, '\\S')),
a AS (SELECT *, list_filter(["""
    + ", ".join(f"CASE WHEN list_has_any(kw, {ws}) THEN '{k}' END" for k, ws in _WORDS.items())
    + """], lambda x: x IS NOT NULL) AS issues, round_even(greatest(-1.0, least(1.0, CAST("""
    + _hits(fb.POSITIVE)
    + " - "
    + _hits(fb.NEGATIVE)
    + """ AS DOUBLE) / len(ws))), 6) AS sentiment FROM a0)
"""
)
_MEANS = f"{_avg('extraction_quality_score')} AS avg_quality, {_avg('seconds')} AS avg_time, {_avg('final_entries_count')} AS avg_entries, count(*) AS n"
_BASE = f""",
ok AS (SELECT * FROM s WHERE status = 'success'),
b AS (SELECT * FROM (SELECT {_MEANS}, 'window' AS basis FROM ok WHERE created_ts BETWEEN (SELECT max(created_ts) FROM ok) - INTERVAL 60 DAY AND (SELECT max(created_ts) FROM ok) - INTERVAL 30 DAY
      UNION ALL SELECT {_MEANS}, 'oldest' FROM (SELECT * FROM ok ORDER BY created_ts, session_id LIMIT 20)) WHERE n >= 10 ORDER BY basis DESC LIMIT 1)
"""
_OPT = (
    _BASE
    + f""",
r AS (SELECT {_MEANS} FROM (SELECT * FROM ok ORDER BY created_ts DESC, session_id LIMIT 20)),
d AS (SELECT r.n, (r.avg_quality - b.avg_quality) * 100 / b.avg_quality AS q, (b.avg_time - r.avg_time) * 100 / b.avg_time AS t FROM r, b WHERE r.n >= 5),
o AS (SELECT 'quality' AS optimization_type, q, 0.0::DOUBLE AS t, n FROM d WHERE q > 5 UNION ALL SELECT 'speed', 0.0::DOUBLE, t, n FROM d WHERE t > 10 UNION ALL SELECT 'combined', q, t, n FROM d WHERE q > 3 AND t > 5),
oo AS (SELECT optimization_type, round_even(t, 2) AS performance_improvement, round_even(q, 2) AS quality_improvement, n AS sample_size, true AS is_active,
       round_even(least(greatest(abs(q), abs(t)) / 20, 1.0) * 0.6 + least(n / 10.0, 1.0) * 0.4, 2) AS confidence_score FROM o)
"""
)
_STARS = """
CASE WHEN total_pages = 0 THEN 4.0 WHEN seconds = 0 THEN 5.0 WHEN seconds IS NULL OR total_pages IS NULL THEN NULL WHEN total_pages * 5.0 / seconds >= 1.5 THEN 5.0 WHEN total_pages * 5.0 / seconds >= 1.2 THEN 4.5 WHEN total_pages * 5.0 / seconds >= 0.9 THEN 4.0 WHEN total_pages * 5.0 / seconds >= 0.7 THEN 3.0 ELSE 2.0 END::DOUBLE AS speed_stars,
CASE WHEN total_pages = 0 THEN 4.0 WHEN total_pages IS NULL OR final_entries_count IS NULL THEN NULL WHEN final_entries_count / total_pages BETWEEN 10 AND 30 THEN 5.0 WHEN final_entries_count / total_pages >= 5 AND final_entries_count / total_pages < 10 THEN 4.0 WHEN final_entries_count / total_pages < 5 THEN 3.0 WHEN final_entries_count / total_pages > 50 THEN 3.5 ELSE 4.5 END::DOUBLE AS completeness_stars,
CASE WHEN dedup IS NULL THEN 4.0 WHEN dedup BETWEEN 0.2 AND 0.4 THEN 5.0 WHEN dedup >= 0.1 AND dedup < 0.2 THEN 4.0 WHEN dedup < 0.1 THEN 3.5 WHEN dedup > 0.4 AND dedup <= 0.6 THEN 4.0 ELSE 3.0 END::DOUBLE AS dedup_stars,
CASE WHEN coalesce(total_chunks, 0) = 0 OR bad_chunks = 0 THEN 5.0 WHEN bad_chunks / total_chunks < 0.1 THEN 4.5 WHEN bad_chunks / total_chunks < 0.2 THEN 4.0 WHEN bad_chunks / total_chunks < 0.3 THEN 3.0 ELSE 2.0 END::DOUBLE AS error_stars
"""
_PAT = f""",
g AS (SELECT * FROM s WHERE status = 'success' AND extraction_quality_score >= 0.7),
best AS (SELECT DISTINCT ON (group_key) group_key, chunk_size, chunk_overlap, fuzzy_threshold FROM g ORDER BY group_key, extraction_quality_score DESC, created_ts DESC, session_id),
h AS (SELECT group_key, count(*) AS sample_size, CAST(floor(avg(total_pages)) AS INT) AS avg_page_count, CAST(floor(avg(file_size)) AS BIGINT) AS avg_file_size, round_even({_avg('seconds')}, 2) AS avg_processing_time,
      {_avg('extraction_quality_score')} AS m, stddev_samp(extraction_quality_score) AS sd FROM g GROUP BY 1),
p AS (SELECT 'pattern_' || substr(md5(group_key), 1, 16) AS pattern_id, group_key, avg_page_count, avg_file_size, chunk_size AS optimal_chunk_size, chunk_overlap AS optimal_chunk_overlap, fuzzy_threshold AS optimal_fuzzy_threshold,
      avg_processing_time, round_even(m, 2) AS avg_quality_score, sample_size,
      least(1.0, least(sample_size / 20.0, 1.0) * 0.4 + (CASE WHEN sample_size <= 1 THEN 1.0 WHEN m > 0 THEN greatest(0.0, least(1.0, 1 - sd / m)) ELSE 0.0 END) * 0.3 + 0.3) AS c FROM h JOIN best USING (group_key)),
pp AS (SELECT * EXCLUDE (c), round_even(c, 2) AS confidence_score FROM p WHERE sample_size >= 5 AND c >= 0.6)
"""


def _complaints(words: list[str], measure: str, kind: str, cond: str) -> str:
    return (
        f", x AS (SELECT count(*) AS n, count(*) FILTER ({_said(words)}) AS sample_size, {_avg(f'CASE WHEN {_said(words)} THEN {measure} END')} AS threshold, {_avg(measure)} AS overall FROM j)"
        f" SELECT '{kind}' AS type, round_even(least(0.9, sample_size / n), 6) AS confidence, sample_size, round_even(threshold, 6) AS threshold FROM x WHERE sample_size >= 3 AND {cond}"
    )


_SPEED = _complaints(fb.SLOW_WORDS, "seconds", "speed_threshold_pattern", "threshold > overall * 1.5")
_QUALITY = _complaints(fb.BAD_WORDS, "extraction_quality_score", "quality_threshold_pattern", "threshold < overall * 0.9")
_BIAS = f"""SELECT 'document_size_pattern_' || size_category AS type, round_even(least(0.8, n / 10.0), 6) AS confidence, n AS sample_size, round_even(m, 6) AS avg_rating_diff
FROM (SELECT CASE WHEN file_size < 100000 THEN 'small' WHEN file_size < 500000 THEN 'medium' ELSE 'large' END AS size_category, count(*) AS n, {_avg('(rating - auto_rating)')} AS m FROM j GROUP BY 1) WHERE n >= 3 AND abs(m) > 0.5"""
_HIST = """SELECT strong, mild, agreements, round_even(CASE WHEN strong + mild + agreements > 0 THEN (strong + mild) / (strong + mild + agreements) ELSE 0.0 END, 6) AS disagreement_rate
FROM (SELECT count(*) FILTER (d >= 2) AS strong, count(*) FILTER (d = 1) AS mild, count(*) FILTER (d < 1) AS agreements FROM (SELECT CASE WHEN auto_rating > 0 THEN abs(rating - auto_rating) END AS d FROM j))"""
_PAIRS = """,
ua AS (SELECT DISTINCT ON (key) key, rating AS auto_rating FROM f WHERE is_auto AND key IS NOT NULL ORDER BY key, created_ts DESC, feedback_id DESC),
uu AS (SELECT DISTINCT ON (key) key, rating AS user_rating FROM f WHERE NOT is_auto AND key IS NOT NULL ORDER BY key, created_ts DESC, feedback_id DESC),
acc AS (SELECT pairs, accurate, round_even(CASE WHEN pairs > 0 THEN accurate / pairs ELSE 0.0 END, 6) AS accuracy FROM (SELECT count(*) AS pairs, count(*) FILTER (abs(auto_rating - user_rating) <= 1) AS accurate FROM ua JOIN uu USING (key)))
"""

SQL = {
    "system_analytics": _S + _F + """SELECT ts AS total_sessions, tf AS total_feedback, ac AS auto_feedback_count, uc AS user_feedback_count, coalesce(round_even(aa, 2), 0) AS avg_auto_rating, coalesce(round_even(ua, 2), 0) AS avg_user_rating,
coalesce(round_even(ca, 2), 0) AS avg_combined_rating, coalesce(round_even(uc * 100.0 / nullif(ts, 0), 1), 0)::DOUBLE AS override_rate, coalesce(round_even((ts - uc) * 100.0 / nullif(ts, 0), 1), 0)::DOUBLE AS agreement_rate, coalesce(round_even(ok * 100.0 / nullif(ts, 0), 2), 0)::DOUBLE AS success_rate
FROM (SELECT count(*) AS ts, count(*) FILTER (status = 'success') AS ok FROM s), (SELECT count(*) AS tf, count(*) FILTER (is_auto) AS ac, count(*) FILTER (NOT is_auto) AS uc, avg(rating) FILTER (is_auto) AS aa, avg(rating) FILTER (NOT is_auto) AS ua, avg(rating) AS ca FROM f)""",
    "performance_trends": _S + f""", m AS (SELECT DISTINCT ON (metric_id) *, CASE WHEN NOT isnan(processing_time) AND processing_time >= 0 THEN processing_time END AS t FROM performance_metrics ORDER BY metric_id),
x AS (SELECT 'metrics' AS source, 0 AS k, {_avg('t')} AS avg_processing_time, {_avg('quality_score')} AS avg_quality_score, {_avg('user_satisfaction')} AS avg_rating, count(*) AS n FROM m WHERE created_ts >= (SELECT max(created_ts) FROM m) - INTERVAL 7 DAY
UNION ALL SELECT 'sessions', 1, {_avg('seconds')}, {_avg('extraction_quality_score')}, {_avg('user_rating')}, count(*) FROM s WHERE created_ts >= (SELECT max(created_ts) FROM s) - INTERVAL 7 DAY)
SELECT * EXCLUDE (k) FROM x WHERE n > 0 ORDER BY k LIMIT 1""",
    "status_histogram": _S + "SELECT status, count(*) AS n FROM s GROUP BY 1",
    "session_quality": _S + """SELECT session_id, round_even(coalesce(ok_chunks / nullif(n_chunks, 0), 0) * 0.4
+ (CASE WHEN dedup IS NULL THEN 0.5 WHEN dedup BETWEEN 0.2 AND 0.4 THEN 1.0 WHEN dedup < 0.2 THEN dedup / 0.2 ELSE greatest(0.0, 1 - (dedup - 0.4) / 0.3) END) * 0.3
+ (CASE WHEN coalesce(final_entries_count, 0) <= 0 THEN 0.0 WHEN final_entries_count < 50 THEN final_entries_count / 50.0 WHEN final_entries_count <= 150 THEN 1.0 ELSE greatest(0.5, 1 - (final_entries_count - 150) / 300.0) END)::DOUBLE * 0.3, 3) AS quality_score FROM s""",
    "session_metrics": _S + "SELECT session_id, n_chunks AS chunk_count, bad_chunks AS error_count, round_even(coalesce(dedup, 0.0) * 100, 2) AS deduplication_efficiency, round_even(seconds / nullif(n_chunks, 0), 6) AS avg_chunk_time FROM s",
    "auto_rating": _S + f", x AS (SELECT session_id, extraction_quality_score AS q, {_STARS} FROM s), y AS (SELECT *, greatest(1.0, least(5.0, round_even(((1 + q * 4) * 0.3 + speed_stars * 0.2 + completeness_stars * 0.25 + dedup_stars * 0.15 + error_stars * 0.1) * 2, 0) / 2)) AS r FROM x) SELECT session_id, speed_stars, completeness_stars, dedup_stars, error_stars, CASE WHEN q + speed_stars + completeness_stars IS NOT NULL THEN r END AS rating, CAST(round_even(CASE WHEN q + speed_stars + completeness_stars IS NOT NULL THEN r END, 0) AS INT) AS stored_rating FROM y",
    "feedback_text": _S + """, x AS (SELECT session_id, concat_ws(', ', CASE WHEN extraction_quality_score >= 0.9 THEN 'excellent extraction quality' WHEN extraction_quality_score >= 0.8 THEN 'good extraction quality' WHEN extraction_quality_score >= 0.7 THEN 'acceptable extraction quality' ELSE 'extraction quality needs improvement' END,
CASE WHEN seconds < total_pages * 5.0 * 0.8 THEN 'fast processing' WHEN seconds > total_pages * 5.0 * 1.3 THEN 'slower than expected' END, CASE WHEN dedup BETWEEN 0.2 AND 0.4 THEN 'optimal deduplication' WHEN dedup > 0.5 THEN 'high deduplication rate' END,
CASE WHEN coalesce(final_entries_count / nullif(total_pages, 0), 0) >= 15 THEN 'comprehensive data extraction (' || final_entries_count || ' entries)' END) AS t FROM s) SELECT session_id, upper(t[1:1]) || t[2:] || '.' AS feedback_text FROM x""",
    "session_summary": _S + "SELECT session_id, status, total_pages, total_chunks, final_entries_count, round_even(seconds, 2) AS processing_time, extraction_quality_score, user_rating FROM s",
    "recent_sessions": _S + "SELECT session_id, created_ts, status FROM s ORDER BY created_ts DESC, session_id LIMIT 10",
    "size_buckets": _S + f"SELECT group_key, count(*) AS n, {_avg('extraction_quality_score')} AS avg_quality FROM s GROUP BY 1",
    "learned_patterns": _S + _PAT + "SELECT * FROM pp",
    "optimal_parameters": _S + _PAT + """SELECT pattern_id, optimal_chunk_size, optimal_chunk_overlap, optimal_fuzzy_threshold,
round_even((1 - (abs(avg_page_count - 3) / greatest(avg_page_count, 3, 1)::DOUBLE + abs(avg_file_size - 90000) / greatest(avg_file_size, 90000, 1)::DOUBLE) / 2) * confidence_score, 6) AS score
FROM (SELECT * FROM pp WHERE confidence_score >= 0.7 ORDER BY confidence_score DESC, pattern_id LIMIT 5) ORDER BY score DESC, pattern_id LIMIT 1""",
    "optimization_baseline": _S + _BASE + "SELECT * FROM b",
    "optimization_detect": _S + _OPT + "SELECT * FROM oo",
    "active_optimizations": _S + _OPT + "SELECT optimization_type, confidence_score FROM oo WHERE is_active",
    "feedback_joined": _S + _F + "SELECT feedback_id, key AS session_id, rating, auto_rating, status FROM j",
    "feedback_analysis": _S + _F + _A.format(src="j") + "SELECT feedback_id, array_to_string(kw, '+') AS keywords, array_to_string(issues, '+') AS issues, sentiment, rating_diff, CASE WHEN rating_diff = 0 THEN 'agreement' ELSE (CASE WHEN rating_diff > 0 THEN 'user_rated_higher_' ELSE 'user_rated_lower_' END) || (CASE WHEN len(issues) > 0 THEN array_to_string(issues, '+') ELSE 'unknown' END) END AS disagreement_type FROM a",
    "issue_counts": _S + _F + _A.format(src="j") + "SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM a) GROUP BY 1",
    "improvement_suggestions": _S + _F + ", jj AS (SELECT j.* FROM j WHERE feedback_id IN (SELECT feedback_id FROM f WHERE NOT is_auto AND feedback_text IS NOT NULL ORDER BY created_ts DESC, feedback_id LIMIT 20))" + _A.format(src="jj") + f""",
t AS (SELECT count(*) AS n, {_avg('rating_diff')} AS diff, count(*) FILTER (sentiment < -0.1) AS negative FROM a),
c AS (SELECT issue, count(*) AS mentions FROM (SELECT unnest(issues) AS issue FROM a) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT 'algorithm_too_optimistic' AS type, round_even(least(0.9, n / 10), 6) AS confidence FROM t WHERE n > 0 AND diff < -0.5
UNION ALL SELECT issue || '_factor_adjustment', round_even(least(0.8, mentions / n), 6) FROM t, c WHERE mentions >= 3
UNION ALL SELECT 'user_satisfaction_low', 0.7 FROM t WHERE n > 0 AND negative > n * 0.6""",
    "speed_patterns": _S + _F + _SPEED,
    "quality_patterns": _S + _F + _QUALITY,
    "size_bias_patterns": _S + _F + _BIAS,
    "disagreement_histogram": _S + _F + _HIST,
    "pattern_summary": _S + _F + f""", sp AS (SELECT * FROM ({("WITH " + _SPEED[2:])})), qu AS (SELECT * FROM ({("WITH " + _QUALITY[2:])})), bi AS ({_BIAS}), hi AS ({_HIST}),
allp AS (SELECT type, confidence, sample_size FROM sp UNION ALL SELECT type, confidence, sample_size FROM qu UNION ALL SELECT type, confidence, sample_size FROM bi
UNION ALL SELECT 'high_disagreement_pattern', round_even(least(0.9, (strong + mild + agreements) / 20.0), 6), strong + mild + agreements FROM hi WHERE strong + mild + agreements >= 3 AND disagreement_rate > 0.3)
SELECT split_part(type, '_', 1) AS category, count(*) AS patterns, round_even({_avg('confidence')}, 6) AS avg_confidence, sum(sample_size)::BIGINT AS total_sample_size, count(*) FILTER (confidence > 0.8) AS high_confidence FROM allp GROUP BY 1""",
    "algorithm_accuracy": _S + _F + _PAIRS + "SELECT * FROM acc",
    "latest_feedback_per_session": _S + _F + "SELECT DISTINCT ON (key) key AS session_id, feedback_id, rating, feedback_text FROM f WHERE key IS NOT NULL ORDER BY key, created_ts DESC, feedback_id DESC",
    "session_feedback_update": _S + _F + """, l AS (SELECT DISTINCT ON (key) key, rating, feedback_text FROM f WHERE key IS NOT NULL AND NOT is_auto ORDER BY key, created_ts DESC, feedback_id DESC)
SELECT s.session_id, coalesce(l.rating, s.user_rating) AS user_rating, coalesce(l.feedback_text, s.user_feedback_text) AS user_feedback_text FROM s LEFT JOIN l ON l.key = lower(trim(s.session_id))""",
    "learning_metrics": _S + _F + _PAIRS + "SELECT round_even(CASE WHEN n > 0 THEN u * 100.0 / n ELSE 0.0 END, 6)::DOUBLE AS override_rate, round_even(accuracy * 100, 6) AS algorithm_accuracy, 0 AS improvements, round_even(CASE WHEN ns > 0 THEN n * 100.0 / ns ELSE 0.0 END, 6)::DOUBLE AS feedback_coverage FROM (SELECT count(*) AS n, count(*) FILTER (NOT is_auto) AS u FROM f), (SELECT count(*) AS ns FROM s), acc",
    "recent_activity": _S + _F + "SELECT is_auto, count(*) AS n, max(created_ts) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY is_auto ORDER BY created_ts DESC, feedback_id) AS k FROM f) WHERE k <= 5 GROUP BY 1",
}
