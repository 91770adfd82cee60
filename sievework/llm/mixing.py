"""A mix of sources by a curriculum: weights over training time, integrated, inverted and laid out by position."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.tokens import count_tokens
from sievework.session import written
from sievework.sources.tables import norm_label

#: Weights at times 0 .. 1, or what makes them of the shares of the sources that have texts; None for constant weights.
Knots = dict[float, dict[str, float]] | Callable[[dict[str, float]], dict[float, dict[str, float]]] | None
BUCKETS = 1024  # of each source's order, so that a source with most of all rows is no single task


@dataclass(frozen=True)
class Segment:
    """A stretch of training time on which a source's weight is linear; ``area`` is its integral up to ``begin``."""

    source: str
    begin: float
    end: float
    weight: float
    slope: float
    area: float


def schedule(shares: dict[str, float], knots: dict[float, dict[str, float]] | None = None) -> list[Segment]:
    """Segments of every source's schedule, weights adding up to 1 at all times.

    Without ``knots`` weights are constant. ``knots`` gives weights at times 0 .. 1, linear in between, constant before the
    first and after the last; a source that a knot leaves out weighs nothing there. Weights at a knot must not all be 0.
    """
    at = dict(sorted((knots or {0.0: shares}).items()))
    times = sorted({0.0, 1.0, *at})
    first, last = min(at), max(at)

    def weights(t: float) -> dict[str, float]:
        w = at[t] if t in at else at[first] if t < first else at[last]
        total = sum(max(0.0, w.get(s, 0.0)) for s in shares)
        if total <= 0:
            raise ValueError(f"no source weighs anything at {t}")
        return {s: max(0.0, w.get(s, 0.0)) / total for s in shares}

    out = []
    for s in shares:
        area = 0.0
        for a, b in zip(times, times[1:]):
            wa, wb = weights(a)[s], weights(b)[s]
            out.append(Segment(s, a, b, wa, (wb - wa) / (b - a), area))
            area += (b - a) * (wa + wb) / 2
    return out


def curriculum(shares: dict[str, float], tilt: float = 0.5) -> dict[float, dict[str, float]]:
    """Knots of a schedule under which every source keeps its share of the whole: large sources weigh up to ``tilt`` more than their
    share at the beginning and as much less at the end, small ones the other way round, in order of their shares (ties by name).
    """
    total = sum(shares.values())
    rank = {s: i for i, s in enumerate(sorted(shares, key=lambda s: (shares[s], s)))}
    middle = sum(shares[s] * rank[s] for s in shares) / total
    most = max((abs(r - middle) for r in rank.values()), default=0) or 1.0
    lean = {s: tilt * (rank[s] - middle) / most for s in shares}  # weighed by shares these add up to 0, so weights add up to 1
    return {t: {s: w / total * (1 + sign * lean[s]) for s, w in shares.items()} for t, sign in ((0.0, 1), (1.0, -1))}


def total_area(segments: list[Segment], source: str) -> float:
    """The share of all tokens that a source has over the whole time."""
    return sum((g.end - g.begin) * (g.weight + g.slope * (g.end - g.begin) / 2) for g in segments if g.source == source)


def measured(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", directory: str | None = None) -> DataFrame:
    """doc_id, source and n_tokens of one document for each distinct text of a source, the one of smallest id.

    Null sources, and null and empty texts, have no place in a mix.
    """
    src = docs.select("doc_id", norm_label(F.col("source")).alias("source"), "text", F.md5("text").alias("form")).filter("source is not null and text <> ''")
    counted = count_tokens(src, "text", tokenizer, directory)
    return written(counted.groupBy("source", "form").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens")).drop("form"))


def _plan(tokens: DataFrame, sources: DataFrame, knots: Knots, total: int | None) -> tuple[list[Segment], float, dict[str, dict]]:
    """Schedule, total tokens and per source what it has, gets and repeats. Sources are a fixed list, a few rows."""
    known = sources.groupBy(norm_label(F.col("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).filter("source is not null")
    have = tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    info = {r.source: r.asDict() for r in known.join(have, "source", "left").orderBy("source").collect()}
    able = {s: r["share"] or 0.0 for s, r in info.items() if r["tokens"] and (r["repeats"] or 0) > 0 and (r["share"] or 0) > 0}
    if not able:
        return [], 0.0, info
    segments = schedule(able, knots(able) if callable(knots) else knots)
    most = {s: info[s]["tokens"] * info[s]["repeats"] for s in able}
    area = {s: total_area(segments, s) for s in able}
    size = float(total) if total else min(most[s] / area[s] for s in able if area[s] > 0)
    for s, r in info.items():
        r["demand"] = min(size * area[s], most[s]) if s in able else 0.0
    return segments, size, info


def mixed(docs: DataFrame, sources: DataFrame, knots: Knots = None, total: int | None = None, tokens: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Training positions: source, doc_id, epoch, n_tokens and position (tokens of the mix that come before its middle).

    Each source with texts gets its weight's integral of the ``total`` tokens; without ``total`` the mix is as large as it can be
    with every such source at its target. Sources without texts are left out and the other shares scaled up. A source's
    texts come in an order fixed by ``seed``, again and again until its demand is met to within half a text, never more than
    max_repeats times; where ``total`` asks for more than that, the source falls short and `shares` says so.
    ``knots`` (or what makes them of the shares, such as `curriculum`) let weights change over the training time.
    A document's position is the time at which its source's cumulative demand reaches it, times the size of the mix.
    Sources unknown to ``sources`` contribute nothing. No texts or no sources give no rows. Equal texts of one source
    are one text.
    """
    tok = tokens if tokens is not None else measured(docs)
    spark = tok.sparkSession
    segments, size, info = _plan(tok, sources, knots, total)
    out = "source string, doc_id long, epoch int, n_tokens long, position double"
    if not segments:
        return spark.createDataFrame([], out)
    facts = spark.createDataFrame([(s, float(r["tokens"]), float(r["demand"]), int(r["repeats"])) for s, r in info.items() if r["demand"] > 0], "source string, tokens double, demand double, repeats int")

    # Running sums in two steps: over a bounded number of buckets a source, then within each bucket.
    h = F.xxhash64("doc_id", F.lit(seed))
    rows = tok.join(F.broadcast(facts), "source").withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 54).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
    base = sums.select("source", "bucket", (F.sum("s").over(Window.partitionBy("source").orderBy("bucket")) - F.col("s")).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("mid", F.sum("n_tokens").over(inside) - F.col("n_tokens") / 2).join(F.broadcast(base), ["source", "bucket"])
    turns = F.least(F.col("repeats"), F.ceil(F.col("demand") / F.col("tokens")).cast("int"))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), turns - 1))).withColumn("at", F.col("base") + F.col("mid") + F.col("epoch") * F.col("tokens")).filter("at < demand")

    # Inverse of the integrated schedule: on a segment, weight * x + slope * x**2 / 2 = tokens still to go.
    seg = spark.createDataFrame([(g.source, g.begin, g.weight, g.slope, g.area * size, (g.area + (g.end - g.begin) * (g.weight + g.slope * (g.end - g.begin) / 2)) * size) for g in segments], "source string, t0 double, w double, k double, lo double, hi double")
    # A source's last segment takes what sums of floating point put beyond its end.
    ends = seg.filter("hi > lo").groupBy("source").agg(F.max("hi").alias("end"))
    seg = seg.filter("hi > lo").join(F.broadcast(ends), "source")
    rows = rows.join(F.broadcast(seg), "source").filter("at >= lo and (at < hi or hi = end)")
    d = (F.col("at") - F.col("lo")) / size
    t = F.col("t0") + 2 * d / (F.col("w") + F.sqrt(F.greatest(F.lit(0.0), F.col("w") ** 2 + 2 * F.col("k") * d)))
    return rows.select("source", "doc_id", "epoch", "n_tokens", (t * size).alias("position"))


def laid_out(positions: DataFrame, docs: DataFrame, parts: int) -> DataFrame:
    """The mix with its texts in order of position: partition i holds the i-th stretch, sorted.

    Positions are spread evenly by construction, so stretches of equal length are equal in size and no sampling is needed.
    """
    top = positions.agg(F.max("position")).first()[0] or 1.0
    rows = positions.join(docs.select("doc_id", "text").filter("text is not null").dropDuplicates(["doc_id"]), "doc_id")
    part = F.least(F.floor(F.col("position") / F.lit(top) * parts), F.lit(parts - 1)).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions("position", "source", "doc_id", "epoch")


def stretches(positions: DataFrame, parts: int = 10) -> DataFrame:
    """Per stretch (1 .. ``parts``) of the training time and source: tokens and their share of the stretch."""
    top = positions.agg(F.max("position").alias("top"))  # one row
    at = F.least(F.floor(F.col("position") / F.col("top") * parts), F.lit(parts - 1)) + 1
    g = positions.crossJoin(F.broadcast(top)).groupBy(at.cast("int").alias("stretch"), "source").agg(F.sum("n_tokens").alias("tokens"))
    return g.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("stretch")))  # over one row a source


def shares(positions: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source of ``sources``: target_share, max_repeats, texts, tokens, actual_share and the most uses of one text."""
    used = positions.groupBy("source").agg(F.countDistinct("doc_id").alias("texts"), F.sum("n_tokens").alias("tokens"), (F.max("epoch") + 1).alias("most_uses"))
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # over one row a source
    used = used.withColumn("actual_share", F.col("tokens") / all_tokens)
    want = sources.select(norm_label(F.col("source")).alias("source"), "target_share", "max_repeats")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return want.join(used, "source", "left").select("source", "target_share", "max_repeats", zero("texts"), zero("tokens"), F.coalesce("actual_share", F.lit(0.0)).alias("actual_share"), zero("most_uses"))
