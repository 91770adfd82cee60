"""Scores and ratings of processing sessions, as column expressions over one session's row.

Every expression is null-safe: a null count or time counts as 0 unless stated otherwise, divisions by 0 give the neutral value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the five rating factors.
RATING_WEIGHTS = {"quality": 0.30, "speed": 0.20, "completeness": 0.25, "deduplication": 0.15, "errors": 0.10}
SECONDS_PER_PAGE = 5


def valid_time(c: Column) -> Column:
    """A time that was measured: null for null, NaN and negative ones."""
    return F.when(~F.isnan(c) & (c >= 0), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.when(b != 0, a / b)


def bands(x: Column, steps: list[tuple[Column, float]], rest: float) -> Column:
    """The value of the first condition that holds."""
    out = F.when(steps[0][0], F.lit(steps[0][1]))
    for cond, value in steps[1:]:
        out = out.when(cond, F.lit(value))
    return out.otherwise(F.lit(rest))


def n_chunks(results: Column, status: str | None = None) -> Column:
    """Number of chunk results, of one status if given."""
    r = F.coalesce(results, F.array())
    return F.size(r if status is None else F.filter(r, lambda c: c["status"] == status))


def dedup_rate(stats: Column) -> Column:
    """Share of entries that deduplication removed; null without any entry."""
    first, last = F.coalesce(stats["initial_count"], F.lit(0)), F.coalesce(stats["final_count"], F.lit(0))
    return ratio((first - last).cast("double"), first)


def quality_score(results: Column, stats: Column, entries: Column) -> Column:
    """Three parts: chunks that succeeded (.4), a deduplication rate near .2-.4 (.3), 50-150 entries (.3); three digits."""
    ok = F.coalesce(ratio(n_chunks(results, "success").cast("double"), n_chunks(results)), F.lit(0.0))
    d = dedup_rate(stats)
    zero = F.lit(0.0)
    dedup = F.when(d.isNull(), 0.5).when((d >= 0.2) & (d <= 0.4), 1.0).when(d < 0.2, d / 0.2).otherwise(F.greatest(zero, 1 - (d - 0.4) / 0.3))
    n = F.coalesce(entries, F.lit(0))
    size = F.when(n <= 0, 0.0).when(n < 50, n / 50.0).when(n <= 150, 1.0).otherwise(F.greatest(F.lit(0.5), 1 - (n - 150) / 300.0))
    return F.bround(ok * 0.4 + dedup * 0.3 + size * 0.3, 3)


def speed_stars(pages: Column, seconds: Column) -> Column:
    """From expected over actual time; 4 without pages, 5 where no time passed, null where the time is unknown."""
    r = ratio(pages * float(SECONDS_PER_PAGE), seconds)
    return F.when(pages == 0, 4.0).when(seconds == 0, 5.0).when(r.isNotNull(), bands(r, [(r >= 1.5, 5.0), (r >= 1.2, 4.5), (r >= 0.9, 4.0), (r >= 0.7, 3.0)], 2.0))


def completeness_stars(entries: Column, pages: Column) -> Column:
    """From entries per page; 4 without pages."""
    r = ratio(entries.cast("double"), pages)
    return F.when(pages == 0, 4.0).when(r.isNotNull(), bands(r, [((r >= 10) & (r <= 30), 5.0), ((r >= 5) & (r < 10), 4.0), (r < 5, 3.0), (r > 50, 3.5)], 4.5))


def dedup_stars(stats: Column) -> Column:
    """From the deduplication rate; 4 without entries."""
    d = dedup_rate(stats)
    return F.when(d.isNull(), 4.0).otherwise(bands(d, [((d >= 0.2) & (d <= 0.4), 5.0), ((d >= 0.1) & (d < 0.2), 4.0), (d < 0.1, 3.5), ((d > 0.4) & (d <= 0.6), 4.0)], 3.0))


def error_stars(results: Column, total: Column) -> Column:
    """From the share of failed chunks; 5 without chunks."""
    r = ratio(n_chunks(results, "error").cast("double"), F.coalesce(total, F.lit(0)))
    return F.when(r.isNull() | (r == 0), 5.0).otherwise(bands(r, [(r < 0.1, 4.5), (r < 0.2, 4.0), (r < 0.3, 3.0)], 2.0))


def rating(quality: Column, speed: Column, completeness: Column, dedup: Column, errors: Column, weights: dict[str, float] = RATING_WEIGHTS) -> Column:
    """1 to 5 stars in halves (half to even); null where a factor is."""
    w = weights
    x = (1 + quality * 4) * w["quality"] + speed * w["speed"] + completeness * w["completeness"] + dedup * w["deduplication"] + errors * w["errors"]
    return F.when(x.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.bround(x * 2) / 2)))


def feedback_text(quality: Column, pages: Column, seconds: Column, stats: Column, entries: Column) -> Column:
    """One sentence on quality, speed, deduplication and completeness; parts whose figures are unknown are left out."""
    expected, d = pages * float(SECONDS_PER_PAGE), dedup_rate(stats)
    per_page = F.coalesce(ratio(entries.cast("double"), pages), F.lit(0.0))
    parts = F.concat_ws(
        ", ",
        F.when(quality >= 0.9, "excellent extraction quality").when(quality >= 0.8, "good extraction quality").when(quality >= 0.7, "acceptable extraction quality").otherwise("extraction quality needs improvement"),
        F.when(seconds < expected * 0.8, "fast processing").when(seconds > expected * 1.3, "slower than expected"),
        F.when((d >= 0.2) & (d <= 0.4), "optimal deduplication").when(d > 0.5, "high deduplication rate"),
        F.when(per_page >= 15, F.concat(F.lit("comprehensive data extraction ("), entries.cast("string"), F.lit(" entries)"))),
    )
    return F.concat(F.upper(F.substring(parts, 1, 1)), F.substring(parts, 2, 10_000), F.lit("."))


def exact_avg(c: Column) -> Column:
    """Mean of doubles summed as decimals, the same whatever the order of rows; nulls do not count."""
    return F.sum(c.cast("decimal(20,6)")).cast("double") / F.count(c)
