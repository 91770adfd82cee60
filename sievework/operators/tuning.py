"""The feedback-driven tuning of rating weights and thresholds: patterns as a table, and a fold over at most three of them by the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.scoring import RATING_WEIGHTS, exact_avg

# Thresholds of each rating.
THRESHOLDS = {5: {"quality": 0.9, "speed": 0.8, "completeness": 0.9}, 4: {"quality": 0.8, "speed": 0.7, "completeness": 0.8}, 3: {"quality": 0.7, "speed": 0.6, "completeness": 0.7}, 2: {"quality": 0.6, "speed": 0.5, "completeness": 0.6}}
LOWEST, HIGHEST = 0.3, 0.95


@dataclass
class Tuning:
    """Weights and thresholds, and the changes that led to them."""

    weights: dict[str, float] = field(default_factory=lambda: dict(RATING_WEIGHTS))
    thresholds: dict[int, dict[str, float]] = field(default_factory=lambda: {r: dict(t) for r, t in THRESHOLDS.items()})
    changes: list[dict] = field(default_factory=list)


def analyses(analysed_feedback: DataFrame, period: str = "week") -> DataFrame:
    """The history that tuning learns from: per ``period`` of ``created_ts`` timestamp, total_analyzed, avg_rating_diff, avg_sentiment
    and issue_counts (a map) of the analysed comments (see `feedback.analysed`).
    """
    when = F.date_trunc(period, F.col("created_ts")).alias("timestamp")
    issues = analysed_feedback.select(when, F.explode("issues").alias("issue")).groupBy("timestamp", "issue").agg(F.count("*").alias("c"))
    counts = issues.groupBy(F.col("timestamp").alias("_t")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("issue", "c")))).alias("issue_counts"))  # a fixed list of issues
    g = analysed_feedback.groupBy(when).agg(F.count("*").alias("total_analyzed"), exact_avg(F.col("rating_diff")).alias("avg_rating_diff"), exact_avg(F.col("sentiment")).alias("avg_sentiment"))
    return g.join(counts, F.col("timestamp") == F.col("_t"), "left").select("timestamp", "total_analyzed", "avg_rating_diff", "avg_sentiment", "issue_counts")


def tuning_patterns(history: DataFrame, recent: int = 10, least: int = 5) -> DataFrame:
    """Patterns of the ``recent`` latest analyses (timestamp, total_analyzed, avg_rating_diff, avg_sentiment, issue_counts map), up to
    three in the order in which they apply: position, type, action, factor, amount, confidence, sample_size.

    Means are weighted by the comments analysed. Thresholds move against a rating that is half a star off on average, the
    weight of an issue that three comments and 30 % of all name goes up, mostly negative comments lower the thresholds. No
    analyses, none. Ties of issues go by name.
    """
    last = history.orderBy(F.desc("timestamp")).limit(recent)
    n = F.col("total_analyzed")
    mean = lambda c: F.sum((F.col(c) * n).cast("decimal(24,9)")).cast("double") / F.sum(n)
    one = last.filter(n > 0).agg(F.sum(n).alias("sample_size"), mean("avg_rating_diff").alias("d"), mean("avg_sentiment").alias("mood")).filter("sample_size > 0")
    top = last.select(F.explode("issue_counts").alias("issue", "c")).groupBy("issue").agg(F.sum("c").alias("c")).agg(F.min(F.struct((-F.col("c")).alias("neg"), "issue")).alias("t"))
    r = one.crossJoin(top.select(F.col("t.issue").alias("issue"), (-F.col("t.neg")).alias("c")))  # of one row each
    size, share = F.col("sample_size"), F.col("c") / F.col("sample_size")
    row = lambda i, kind, action, factor, amount, sure: F.struct(F.lit(i).alias("position"), kind.alias("type"), F.lit(action).alias("action"), factor.alias("factor"), F.bround(amount, 9).alias("amount"), F.bround(sure, 9).alias("confidence"))
    none = F.lit(None).cast("string")
    kinds = F.array(
        F.when((F.abs("d") > 0.5) & (size >= least), row(1, F.when(F.col("d") < 0, "system_too_optimistic").otherwise("system_too_pessimistic"), "thresholds", none, F.signum("d") * F.least(F.lit(0.05), F.abs("d") * 0.02), F.least(F.lit(0.9), size / 20))),
        F.when((F.col("c") >= 3) & (share > 0.3), row(2, F.concat("issue", F.lit("_weight_adjustment")), "weight", F.col("issue"), F.lit(0.05), F.least(F.lit(0.8), share))),
        F.when((F.col("mood") < -0.2) & (size >= least), row(3, F.lit("negative_sentiment_trend"), "thresholds", none, F.lit(-0.03), F.lit(0.7))),
    )
    return r.select("sample_size", F.inline(F.filter(kinds, lambda x: x.isNotNull()))).select("position", "type", "action", "factor", "amount", "confidence", "sample_size")


def shifted(thresholds: dict[int, dict[str, float]], amount: float) -> dict[int, dict[str, float]]:
    """All thresholds moved by ``amount``, kept within bounds."""
    return {r: {m: max(LOWEST, min(HIGHEST, v + amount)) for m, v in t.items()} for r, t in thresholds.items()}


def bumped(weights: dict[str, float], factor: str, amount: float, most: float = 0.5) -> dict[str, float]:
    """One weight raised to at most ``most``, the others scaled so that all add up to 1; unchanged for an unknown factor."""
    if factor not in weights:
        return dict(weights)
    top = min(most, weights[factor] + amount)
    rest = sum(v for f, v in weights.items() if f != factor)
    return {f: top if f == factor else v / rest * (1 - top) if rest > 0 else v for f, v in weights.items()}


def tune(patterns: list[dict], start: Tuning | None = None, min_confidence: float = 0.6) -> Tuning:
    """The tuning after every pattern of enough confidence; each change keeps what was before and after."""
    t = start or Tuning()
    for p in patterns:
        if p["confidence"] < min_confidence:
            continue
        before = (dict(t.weights), {r: dict(m) for r, m in t.thresholds.items()})
        if p["action"] == "weight":
            t.weights = bumped(t.weights, p["factor"], p["amount"])
        else:
            t.thresholds = shifted(t.thresholds, p["amount"])
        if (t.weights, t.thresholds) != before:
            t.changes.append({"pattern": p["type"], "amount": p["amount"], "before": before, "after": (dict(t.weights), {r: dict(m) for r, m in t.thresholds.items()}), "confidence": p["confidence"]})
    return t


def tuned(patterns: DataFrame, start: Tuning | None = None, min_confidence: float = 0.6) -> Tuning:
    """The tuning after the patterns of `tuning_patterns`, of which there are three rows at most."""
    return tune([r.asDict() for r in patterns.orderBy("position").limit(3).collect()], start, min_confidence)


def config_rows(spark: SparkSession, t: Tuning) -> DataFrame:
    """A tuning as a table: kind (weight or threshold), rating (null for weights), name and value, to nine digits."""
    rows = [("weight", None, f, round(v, 9)) for f, v in t.weights.items()] + [("threshold", r, m, round(v, 9)) for r, ms in t.thresholds.items() for m, v in ms.items()]
    return spark.createDataFrame(rows, "kind string, rating int, name string, value double")


def cycle(feedback: DataFrame, analysed_feedback: DataFrame, patterns: DataFrame, last_cycle: DataFrame | None = None) -> DataFrame:
    """One row that says how far a learning cycle goes: new_feedback (user feedback after the last cycle, or all without one),
    analysed, patterns, applicable (patterns of enough confidence) and stage (see `cycle_due`).

    ``last_cycle`` has one row with ``at``, null for none.
    """
    since = last_cycle if last_cycle is not None else feedback.sparkSession.range(1).select(F.lit(None).cast("timestamp_ntz").alias("at"))
    new = feedback.filter("not is_auto").crossJoin(F.broadcast(since.limit(1))).filter(F.col("at").isNull() | (F.col("created_ts") > F.col("at"))).agg(F.count("*").alias("new_feedback"))  # with one row
    r = new.crossJoin(analysed_feedback.agg(F.count("*").alias("analysed"))).crossJoin(patterns.agg(F.count("*").alias("patterns"), F.count_if(F.col("confidence") >= 0.6).alias("applicable")))  # of one row each
    stage = F.when(F.col("new_feedback") < 10, "wait").when(F.col("analysed") < 10, "analyse").when(F.col("patterns") < 2, "recognise").otherwise("tune")
    return r.withColumn("stage", stage)


def cycle_due(new_user_feedback: int, analysed: int, patterns: int, least_feedback: int = 10, least_analysed: int = 10, least_patterns: int = 2) -> str:
    """How far a learning cycle goes: ``wait``, ``analyse``, ``recognise`` or ``tune``."""
    if new_user_feedback < least_feedback:
        return "wait"
    if analysed < least_analysed:
        return "analyse"
    return "recognise" if patterns < least_patterns else "tune"
