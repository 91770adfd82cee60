"""Analytics over processing sessions: counts, trends, learned parameter patterns and optimizations against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators import scoring
from sievework.operators.scoring import exact_avg, valid_time


def last_rows(sessions: DataFrame) -> DataFrame:
    """One row per session: the one received last (ties: the higher user rating). Null ids are left out.

    ``seconds`` is the total processing time where it was measured.
    """
    order = F.struct(F.col("received_ts").alias("_r"), F.coalesce("user_rating", F.lit(-1)).alias("_u"), *sessions.columns)
    one = sessions.filter("session_id is not null").groupBy("session_id").agg(F.max(order).alias("s"))
    return one.select(*(F.col(f"s.{c}").alias(c) for c in sessions.columns)).withColumn("seconds", valid_time(F.col("total_processing_time")))


def system_analytics(sessions: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: totals, automatic and user ratings, override and agreement rate, success rate. Means of nothing are 0."""
    auto = F.coalesce(F.startswith("feedback_id", F.lit("auto_")), F.lit(False))
    mean = lambda c: F.coalesce(F.bround(F.avg(c), 2), F.lit(0.0))
    fb = feedback.agg(
        F.count("*").alias("total_feedback"), F.count_if(auto).alias("auto_feedback_count"), F.count_if(~auto).alias("user_feedback_count"),
        mean(F.when(auto, F.col("rating"))).alias("avg_auto_rating"), mean(F.when(~auto, F.col("rating"))).alias("avg_user_rating"), mean(F.col("rating")).alias("avg_combined_rating"),
    )
    se = sessions.agg(F.count("*").alias("total_sessions"), F.count_if(F.col("status") == "success").alias("_ok"))
    share = lambda part, digits: F.coalesce(F.bround(scoring.ratio(part * 100.0, F.col("total_sessions")), digits), F.lit(0.0))
    both = se.crossJoin(fb)  # of one row each
    return both.select(
        "total_sessions", *fb.columns, share(F.col("user_feedback_count"), 1).alias("override_rate"),
        share(F.col("total_sessions") - F.col("user_feedback_count"), 1).alias("agreement_rate"), share(F.col("_ok"), 2).alias("success_rate"),
    )


def performance_trends(metrics: DataFrame, sessions: DataFrame, days: int = 7) -> DataFrame:
    """Means over the last ``days`` before the latest row of the metrics; over those of the sessions if there are no metrics."""
    def means(df: DataFrame, t: Column, q: Column, r: Column, src: str, rank: int) -> DataFrame:
        now = df.agg(F.max("created_ts").alias("_now"))
        recent = df.crossJoin(F.broadcast(now)).filter(F.col("created_ts") >= F.col("_now") - F.expr(f"interval {days} days"))  # with one row
        return recent.agg(F.lit(src).alias("source"), F.lit(rank).alias("_rank"), exact_avg(t).alias("avg_processing_time"), exact_avg(q).alias("avg_quality_score"), exact_avg(r).alias("avg_rating"), F.count("*").alias("n"))

    a = means(metrics, valid_time(F.col("processing_time")), F.col("quality_score"), F.col("user_satisfaction"), "metrics", 0)
    b = means(sessions, F.col("seconds"), F.col("extraction_quality_score"), F.col("user_rating"), "sessions", 1)
    return a.unionByName(b).filter("n > 0").orderBy("_rank").limit(1).drop("_rank")


def page_bucket(pages: Column) -> Column:
    return F.when(pages <= 3, "1-3").when(pages <= 6, "4-6").when(pages <= 10, "7-10").otherwise("10+")


def size_bucket(size: Column) -> Column:
    return F.when(size < 100_000, "small").when(size < 500_000, "medium").otherwise("large")


def group_key() -> Column:
    return F.concat(F.lit("pages_"), page_bucket(F.col("total_pages")), F.lit("_size_"), size_bucket(F.col("file_size")))


def confidence(n: Column, mean: Column, std: Column) -> Column:
    """.4 for twenty samples, .3 for an even quality, .3 for success."""
    even = F.when(n <= 1, 1.0).when(mean > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - std / mean))).otherwise(0.0)
    return F.least(F.lit(1.0), F.least(n / 20.0, F.lit(1.0)) * 0.4 + even * 0.3 + 0.3)


def learned_patterns(sessions: DataFrame, min_quality: float = 0.7, recent: int | None = 100, min_sample: int = 5, min_confidence: float = 0.6) -> DataFrame:
    """Best parameters per page and size bucket among the ``recent`` latest successful sessions of good quality.

    Parameters are those of the session of highest quality (ties: the latest, then the smaller id). Buckets of fewer than
    ``min_sample`` sessions or less than ``min_confidence`` are left out.
    """
    good = sessions.filter((F.col("status") == "success") & (F.col("extraction_quality_score") >= min_quality))
    if recent:
        good = good.orderBy(F.desc("created_ts"), "session_id").limit(recent)
    q = F.col("extraction_quality_score")
    best = F.min(F.struct((-q).alias("q"), (-F.unix_micros(F.col("created_ts").cast("timestamp"))).alias("t"), "session_id", "chunk_size", "chunk_overlap", "fuzzy_threshold"))
    g = good.groupBy(group_key().alias("group_key")).agg(
        F.count("*").alias("sample_size"), best.alias("b"), F.floor(F.avg("total_pages")).cast("int").alias("avg_page_count"), F.floor(F.avg("file_size")).cast("long").alias("avg_file_size"),
        F.bround(exact_avg(F.col("seconds")), 2).alias("avg_processing_time"), F.bround(exact_avg(q), 2).alias("avg_quality_score"), exact_avg(q).alias("_m"), F.stddev_samp(q).alias("_s"),
    )
    g = g.withColumn("_c", confidence(F.col("sample_size"), F.col("_m"), F.col("_s"))).filter((F.col("sample_size") >= min_sample) & (F.col("_c") >= min_confidence))
    return g.select(
        F.concat(F.lit("pattern_"), F.substring(F.md5("group_key"), 1, 16)).alias("pattern_id"), "group_key", "avg_page_count", "avg_file_size", F.col("b.chunk_size").alias("optimal_chunk_size"),
        F.col("b.chunk_overlap").alias("optimal_chunk_overlap"), F.col("b.fuzzy_threshold").alias("optimal_fuzzy_threshold"), "avg_processing_time", "avg_quality_score", "sample_size", F.bround("_c", 2).alias("confidence_score"),
    )


def optimal_parameters(patterns: DataFrame, pages: int, size: int, min_confidence: float = 0.7, top: int = 5) -> DataFrame:
    """The pattern nearest to a document among the ``top`` most confident: 1 - mean relative distance, times confidence."""
    far = lambda c, x: F.abs(F.col(c) - x) / F.greatest(F.col(c), F.lit(x), F.lit(1)).cast("double")
    near = patterns.filter(F.col("confidence_score") >= min_confidence).orderBy(F.desc("confidence_score"), "pattern_id").limit(top)
    score = F.bround((1 - (far("avg_page_count", pages) + far("avg_file_size", size)) / 2) * F.col("confidence_score"), 6)
    return near.withColumn("score", score).orderBy(F.desc("score"), "pattern_id").limit(1).select("pattern_id", "optimal_chunk_size", "optimal_chunk_overlap", "optimal_fuzzy_threshold", "score")


def _means(df: DataFrame) -> DataFrame:
    return df.agg(exact_avg(F.col("extraction_quality_score")).alias("avg_quality"), exact_avg(F.col("seconds")).alias("avg_time"), exact_avg(F.col("final_entries_count")).alias("avg_entries"), F.count("*").alias("n"))


def optimization_baseline(sessions: DataFrame, start: int = 60, end: int = 30, least: int = 10, oldest: int = 20) -> DataFrame:
    """Means over successful sessions ``start`` to ``end`` days before the latest one; over the ``oldest`` ones if those are
    fewer than ``least``; no row if these are too.
    """
    ok = sessions.filter("status = 'success'")
    now = ok.agg(F.max("created_ts").alias("_now"))
    inside = ok.crossJoin(F.broadcast(now)).filter(F.col("created_ts").between(F.col("_now") - F.expr(f"interval {start} days"), F.col("_now") - F.expr(f"interval {end} days")))  # with one row
    a = _means(inside).withColumn("basis", F.lit("window"))
    b = _means(ok.orderBy("created_ts", "session_id").limit(oldest)).withColumn("basis", F.lit("oldest"))
    return a.unionByName(b).filter(F.col("n") >= least).orderBy(F.desc("basis")).limit(1)


def optimizations(sessions: DataFrame, baseline: DataFrame, recent: int = 20, least: int = 5) -> DataFrame:
    """Improvements of the ``recent`` latest successful sessions over the baseline: quality by more than 5 %, speed by more
    than 10 %, or both by more than 3 and 5. No row without a baseline or with fewer than ``least`` recent sessions.
    """
    now = _means(sessions.filter("status = 'success'").orderBy(F.desc("created_ts"), "session_id").limit(recent)).filter(F.col("n") >= least)
    r = now.select(*(F.col(c).alias(f"r_{c}") for c in now.columns)).crossJoin(baseline)  # of one row each
    q, s = scoring.ratio((F.col("r_avg_quality") - F.col("avg_quality")) * 100, F.col("avg_quality")), scoring.ratio((F.col("avg_time") - F.col("r_avg_time")) * 100, F.col("avg_time"))
    zero = F.lit(0.0)
    kinds = F.array(
        F.when(q > 5, F.struct(F.lit("quality").alias("optimization_type"), q.alias("q"), zero.alias("s"))),
        F.when(s > 10, F.struct(F.lit("speed").alias("optimization_type"), zero.alias("q"), s.alias("s"))),
        F.when((q > 3) & (s > 5), F.struct(F.lit("combined").alias("optimization_type"), q.alias("q"), s.alias("s"))),
    )
    one = r.select("r_n", F.inline(F.filter(kinds, lambda x: x.isNotNull())))
    conf = F.least(F.greatest(F.abs("q"), F.abs("s")) / 20, F.lit(1.0)) * 0.6 + F.least(F.col("r_n") / 10.0, F.lit(1.0)) * 0.4
    return one.select("optimization_type", F.bround("s", 2).alias("performance_improvement"), F.bround("q", 2).alias("quality_improvement"), F.col("r_n").alias("sample_size"), F.lit(True).alias("is_active"), F.bround(conf, 2).alias("confidence_score"))


def active_optimizations(found: DataFrame, kind: str | None = None) -> DataFrame:
    """Active optimizations, of one type if given."""
    active = found.filter("is_active")
    return active if kind is None else active.filter(F.col("optimization_type") == kind)
