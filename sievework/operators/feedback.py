"""Analytics over user and automatic feedback: joins with sessions, comment analysis, disagreement patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.operators.scoring import exact_avg
from sievework.operators.sessions import size_bucket
from sievework.sources.tables import norm_session_id

# Words that name an issue, in the order in which issues are listed, and words of praise and blame.
ISSUES = {
    "speed": ["slow", "fast", "quick", "time", "speed", "faster", "slower", "long"],
    "quality": ["wrong", "accurate", "quality", "extraction", "correct", "incorrect", "missed", "missing"],
    "completeness": ["incomplete", "partial", "missing", "missed", "complete", "all"],
    "deduplication": ["duplicate", "repeated", "same", "copies"],
    "errors": ["error", "failed", "broken", "issue", "problem"],
}
POSITIVE = ["great", "excellent", "perfect", "amazing", "good", "nice", "love", "awesome"]
NEGATIVE = ["bad", "poor", "terrible", "awful", "hate", "wrong", "slow", "missed"]
SLOW_WORDS = ["slow", "long", "time", "wait"]
BAD_WORDS = ["wrong", "missed", "incorrect", "bad", "poor"]


def clean_feedback(feedback: DataFrame) -> DataFrame:
    """One row per feedback id (the one received last; ties: the higher rating), with ``key``, the evenly spelled session id
    (null if blank), and ``is_auto``.
    """
    keep = ["feedback_id", "created_ts", "received_ts", "session_id", "rating", "feedback_text", "corrections_count"]
    order = F.struct(F.col("received_ts").alias("_r"), F.coalesce("rating", F.lit(-1)).alias("_u"), *keep)
    one = feedback.groupBy("feedback_id").agg(F.max(order).alias("f")).select(*(F.col(f"f.{c}").alias(c) for c in keep))
    k = norm_session_id(F.col("session_id"))
    return one.withColumn("key", F.when(k != "", k)).withColumn("is_auto", F.coalesce(F.startswith("feedback_id", F.lit("auto_")), F.lit(False)))


def first_auto(feedback: DataFrame) -> DataFrame:
    """The earliest automatic rating of each session (ties: the smaller id): key, auto_rating."""
    a = feedback.filter("is_auto and key is not null").groupBy("key").agg(F.min(F.struct("created_ts", "feedback_id", "rating")).alias("a"))
    return a.select("key", F.col("a.rating").alias("auto_rating"))


def latest_per_session(feedback: DataFrame) -> DataFrame:
    """The latest feedback of each session (ties: the larger id)."""
    one = feedback.filter("key is not null").groupBy("key").agg(F.max(F.struct("created_ts", "feedback_id", "rating", "feedback_text")).alias("f"))
    return one.select(F.col("key").alias("session_id"), "f.feedback_id", "f.rating", "f.feedback_text")


def with_latest_feedback(sessions: DataFrame, feedback: DataFrame) -> DataFrame:
    """``sessions`` whose rating and feedback text are those of their latest feedback, where there is any."""
    f = latest_per_session(feedback.filter("not is_auto")).select(F.col("session_id").alias("_k"), F.col("rating").alias("_r"), F.col("feedback_text").alias("_t"))
    j = sessions.join(f, norm_session_id(F.col("session_id")) == F.col("_k"), "left")
    return j.withColumn("user_rating", F.coalesce("_r", "user_rating")).withColumn("user_feedback_text", F.coalesce("_t", "user_feedback_text")).drop("_k", "_r", "_t")


def joined(feedback: DataFrame, sessions: DataFrame) -> DataFrame:
    """User feedback with its session and the session's first automatic rating (0 if none); feedback of unknown sessions drops out."""
    s = sessions.select(norm_session_id(F.col("session_id")).alias("key"), "seconds", "file_size", "extraction_quality_score", "status")
    u = feedback.filter("not is_auto and key is not null").select("feedback_id", "key", "rating", "feedback_text", "created_ts")
    return u.join(s, "key").join(first_auto(feedback), "key", "left").withColumn("auto_rating", F.coalesce("auto_rating", F.lit(0)))


def _any_of(text: Column, words: list[str]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def _hits(text: Column, words: list[str]) -> Column:
    out = F.contains(text, F.lit(words[0])).cast("int")
    for w in words[1:]:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def sentiment(text: Column) -> Column:
    """(kinds of praise - kinds of blame) / words, between -1 and 1; 0 without words. Words are found inside others too."""
    t = F.lower(text)
    n = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (_hits(t, POSITIVE) - _hits(t, NEGATIVE)) / n))).otherwise(0.0)


def keywords(text: Column) -> Column:
    """The distinct issue words among the words of a text, sorted."""
    every = sorted({w for ws in ISSUES.values() for w in ws})
    return F.array_sort(F.array_intersect(F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0)), F.array(*map(F.lit, every))))


def issues(words: Column) -> Column:
    """The issues that keywords name, in fixed order."""
    found = F.array(*(F.when(F.arrays_overlap(words, F.array(*map(F.lit, ws))), name) for name, ws in ISSUES.items()))
    return F.filter(found, lambda x: x.isNotNull())


def analysed(joined_feedback: DataFrame) -> DataFrame:
    """Keywords, issues, sentiment and kind of disagreement of each comment; feedback without a comment drops out."""
    rows = joined_feedback.filter(F.regexp_like("feedback_text", F.lit(r"\S")))
    rows = rows.withColumn("keywords", keywords(F.col("feedback_text"))).withColumn("issues", issues(F.col("keywords")))
    diff = F.col("rating") - F.col("auto_rating")
    names = F.when(F.size("issues") > 0, F.array_join("issues", "+")).otherwise("unknown")
    kind = F.when(diff == 0, "agreement").when(diff > 0, F.concat(F.lit("user_rated_higher_"), names)).otherwise(F.concat(F.lit("user_rated_lower_"), names))
    return rows.withColumn("sentiment", F.bround(sentiment(F.col("feedback_text")), 6)).withColumn("rating_diff", diff).withColumn("disagreement_type", kind)


def recent_user_comments(feedback: DataFrame, limit: int) -> DataFrame:
    """Automatic feedback and the ``limit`` latest user comments (ties: the smaller id)."""
    users = feedback.filter("not is_auto and feedback_text is not null").orderBy(F.desc("created_ts"), "feedback_id").limit(limit)
    return users.unionByName(feedback.filter("is_auto"))


def issue_counts(rows: DataFrame) -> DataFrame:
    """How many comments name each issue."""
    return rows.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def improvement_suggestions(rows: DataFrame) -> DataFrame:
    """Up to three suggestions: ratings half a star too high, one issue named three times or more, mostly negative comments."""
    total = rows.agg(F.count("*").alias("n"), exact_avg(F.col("rating_diff")).alias("diff"), F.count_if(F.col("sentiment") < -0.1).alias("negative"))
    top = issue_counts(rows).agg(F.min(F.struct((-F.col("n")).alias("neg"), "issue")).alias("t")).select(F.col("t.issue").alias("issue"), (-F.col("t.neg")).alias("mentions"))
    r = total.crossJoin(top)  # of one row each
    n = F.col("n").cast("double")
    kinds = F.array(
        F.when(F.col("diff") < -0.5, F.struct(F.lit("algorithm_too_optimistic").alias("type"), F.bround(F.least(F.lit(0.9), n / 10), 6).alias("confidence"))),
        F.when(F.col("mentions") >= 3, F.struct(F.concat("issue", F.lit("_factor_adjustment")).alias("type"), F.bround(F.least(F.lit(0.8), F.col("mentions") / n), 6).alias("confidence"))),
        F.when(F.col("negative") > n * 0.6, F.struct(F.lit("user_satisfaction_low").alias("type"), F.lit(0.7).alias("confidence"))),
    )
    return r.filter("n > 0").select(F.inline(F.filter(kinds, lambda x: x.isNotNull())))


def speed_patterns(rows: DataFrame, least: int = 3) -> DataFrame:
    """One row if those who complain of speed and rate below the automatic rating waited 1.5 times the mean or longer."""
    return _complaints(rows, SLOW_WORDS, F.col("seconds"), "speed_threshold_pattern", lambda mean, every: mean > every * 1.5, least)


def quality_patterns(rows: DataFrame, least: int = 3) -> DataFrame:
    """One row if those who complain of quality and rate below had less than .9 of the mean quality."""
    return _complaints(rows, BAD_WORDS, F.col("extraction_quality_score"), "quality_threshold_pattern", lambda mean, every: mean < every * 0.9, least)


def _complaints(rows: DataFrame, words: list[str], measure: Column, kind: str, telling, least: int) -> DataFrame:
    said = _any_of(F.lower(F.coalesce("feedback_text", F.lit(""))), words) & (F.col("rating") < F.col("auto_rating"))
    g = rows.agg(F.count("*").alias("n"), F.count_if(said).alias("sample_size"), exact_avg(F.when(said, measure)).alias("threshold"), exact_avg(measure).alias("overall"))
    g = g.filter((F.col("sample_size") >= least) & telling(F.col("threshold"), F.col("overall")))
    return g.select(F.lit(kind).alias("type"), F.bround(F.least(F.lit(0.9), F.col("sample_size") / F.col("n")), 6).alias("confidence"), "sample_size", F.bround("threshold", 6).alias("threshold"))


def size_bias_patterns(rows: DataFrame, least: int = 3, bias: float = 0.5) -> DataFrame:
    """File-size buckets in which users rate more than ``bias`` above or below the automatic rating on average."""
    diff = (F.col("rating") - F.col("auto_rating")).cast("double")
    g = rows.groupBy(size_bucket(F.coalesce("file_size", F.lit(0))).alias("size_category")).agg(F.count("*").alias("sample_size"), exact_avg(diff).alias("m"))
    g = g.filter((F.col("sample_size") >= least) & (F.abs("m") > bias))
    return g.select(F.concat(F.lit("document_size_pattern_"), "size_category").alias("type"), F.bround(F.least(F.lit(0.8), F.col("sample_size") / 10.0), 6).alias("confidence"), "sample_size", F.bround("m", 6).alias("avg_rating_diff"))


def disagreement_histogram(rows: DataFrame) -> DataFrame:
    """One row: strong (2 stars or more), mild (1) and no disagreement where there is an automatic rating, and the rate."""
    d = F.when(F.col("auto_rating") > 0, F.abs(F.col("rating") - F.col("auto_rating")))
    g = rows.agg(F.count_if(d >= 2).alias("strong"), F.count_if((d >= 1) & (d < 2)).alias("mild"), F.count_if(d < 1).alias("agreements"))
    total = F.col("strong") + F.col("mild") + F.col("agreements")
    return g.select("*", F.bround(F.when(total > 0, (F.col("strong") + F.col("mild")) / total).otherwise(0.0), 6).alias("disagreement_rate"))


def disagreement_patterns(rows: DataFrame, least: int = 3, rate: float = 0.3) -> DataFrame:
    """One row if more than ``rate`` of ``least`` or more users disagree with the automatic rating."""
    h = disagreement_histogram(rows).withColumn("sample_size", F.col("strong") + F.col("mild") + F.col("agreements"))
    h = h.filter((F.col("sample_size") >= least) & (F.col("disagreement_rate") > rate))
    return h.select(F.lit("high_disagreement_pattern").alias("type"), F.bround(F.least(F.lit(0.9), F.col("sample_size") / 20.0), 6).alias("confidence"), "sample_size")


def all_patterns(rows: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """All feedback patterns of enough confidence: type, confidence, sample_size."""
    parts = [speed_patterns(rows), quality_patterns(rows), size_bias_patterns(rows), disagreement_patterns(rows)]
    out = parts[0].select("type", "confidence", "sample_size")
    for p in parts[1:]:
        out = out.unionByName(p.select("type", "confidence", "sample_size"))
    return out.filter(F.col("confidence") >= min_confidence)


def pattern_summary(patterns: DataFrame) -> DataFrame:
    """Per first word of the type: patterns, mean confidence, samples and those of a confidence above .8."""
    return patterns.groupBy(F.split("type", "_")[0].alias("category")).agg(F.count("*").alias("patterns"), F.bround(exact_avg(F.col("confidence")), 6).alias("avg_confidence"), F.sum("sample_size").alias("total_sample_size"), F.count_if(F.col("confidence") > 0.8).alias("high_confidence"))


def rating_pairs(feedback: DataFrame) -> DataFrame:
    """Last automatic and last user rating of each session that has both (ties: the larger id)."""
    last = lambda auto: F.max(F.when(F.col("is_auto") == auto, F.struct("created_ts", "feedback_id", "rating")))
    g = feedback.filter("key is not null").groupBy("key").agg(last(True).alias("a"), last(False).alias("u"))
    return g.filter("a is not null and u is not null").select("key", F.col("a.rating").alias("auto_rating"), F.col("u.rating").alias("user_rating"))


def algorithm_accuracy(feedback: DataFrame, within: int = 1) -> DataFrame:
    """One row: pairs, pairs at most ``within`` stars apart, and their share (0 without pairs)."""
    g = rating_pairs(feedback).agg(F.count("*").alias("pairs"), F.count_if(F.abs(F.col("auto_rating") - F.col("user_rating")) <= within).alias("accurate"))
    return g.select("*", F.bround(F.when(F.col("pairs") > 0, F.col("accurate") / F.col("pairs")).otherwise(0.0), 6).alias("accuracy"))


def learning_metrics(feedback: DataFrame, sessions: DataFrame, improvements: int = 0) -> DataFrame:
    """One row: override rate among all feedback, accuracy and feedback coverage in per cent."""
    f = feedback.agg(F.count("*").alias("n"), F.count_if(~F.col("is_auto")).alias("u"))
    r = f.crossJoin(sessions.agg(F.count("*").alias("s"))).crossJoin(algorithm_accuracy(feedback))  # of one row each
    pct = lambda a, b: F.bround(F.when(b > 0, a * 100.0 / b).otherwise(0.0), 6)
    return r.select(pct(F.col("u"), F.col("n")).alias("override_rate"), F.bround(F.col("accuracy") * 100, 6).alias("algorithm_accuracy"), F.lit(improvements).alias("improvements"), pct(F.col("n"), F.col("s")).alias("feedback_coverage"))


def recent_activity(feedback: DataFrame, top: int = 5) -> DataFrame:
    """Per class of feedback the number and the latest time among its ``top`` latest rows."""
    w = Window.partitionBy("is_auto").orderBy(F.desc("created_ts"), "feedback_id")
    return feedback.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top).groupBy("is_auto").agg(F.count("*").alias("n"), F.max("created_ts").alias("latest"))
