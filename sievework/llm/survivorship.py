"""Field-by-field survivorship: for each group the best record of every field, in one aggregation of composite maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import bare, is_placeholder

_LATE, _EARLY = 1 << 62, -(1 << 62)


def ranked(entries: DataFrame, trust: DataFrame, cut: DataFrame) -> DataFrame:
    """Each entry (as often as it was delivered) with its group's hashes and what each of its fields is worth.

    ``worth_value`` and ``worth_comment`` are structs that order candidates: most letters and digits (values only), most
    trusted extractor, latest, smallest id; null where the field cannot survive.
    """
    rank = trust.groupBy("extractor").agg(F.min("trust_rank").alias("trust_rank"))
    key = bare(F.coalesce("entry_key", F.lit("")))
    # 128 bits a group: two hashes that take session and key in different order.
    src = entries.filter("session_id is not null").select(
        "entry_id", "extractor", F.xxhash64("session_id", key).alias("g1"), F.xxhash64(key, F.lit("#"), "session_id").alias("g2"), F.unix_micros(F.col("extracted_ts").cast("timestamp")).alias("at"),
        F.when(~is_placeholder(F.col("entry_value")), F.length(bare(F.col("entry_value")))).alias("size"), (~is_placeholder(F.col("comments"))).alias("has_comment"),
    )
    # The extractors are a fixed list, a few rows; a cut flag is one row per cut entry, so that side is shuffled.
    src = src.join(F.broadcast(rank), "extractor", "left").drop("extractor").join(cut.select(F.col("id").alias("entry_id"), F.lit(True).alias("is_cut")), "entry_id", "left")
    order = [-F.coalesce(F.col("trust_rank").cast("long"), F.lit(_LATE)), F.coalesce("at", F.lit(_EARLY)), -F.col("entry_id")]
    names = ["trust", "at", "neg_id"]
    tail = [c.alias(n) for c, n in zip(order, names)]
    value = F.when(F.col("size").isNotNull() & F.col("is_cut").isNull(), F.struct(F.col("size").cast("long").alias("size"), *tail))
    comment = F.when(F.col("has_comment"), F.struct(*tail))
    return src.select("entry_id", "g1", "g2", value.alias("worth_value"), comment.alias("worth_comment"))


def survivors(entries: DataFrame, trust: DataFrame, cut: DataFrame) -> DataFrame:
    """One row per group of two or more entries: g1 and g2 (its hash), group_entry_id, last_entry_id (smallest and largest id),
    value_entry_id and comment_entry_id (null if none survives).

    A group is the entries of one session whose keys have one bare form (null keys count as empty). Entries delivered
    twice are one. Values that are placeholders or in ``cut`` (id) and comments that are placeholders cannot survive.
    Unknown and null extractors come last, a null time is earliest, ties end at the smallest id. Entries without a session
    belong to no group. Maxima combine map-side, so a group with a third of all rows costs no more than any other.
    """
    agg = ranked(entries, trust, cut).groupBy("g1", "g2").agg(F.min("entry_id").alias("group_entry_id"), F.max("entry_id").alias("last_entry_id"), F.max("worth_value").alias("v"), F.max("worth_comment").alias("c"))
    return agg.filter("group_entry_id < last_entry_id").select("g1", "g2", "group_entry_id", "last_entry_id", (-F.col("v.neg_id")).alias("value_entry_id"), (-F.col("c.neg_id")).alias("comment_entry_id"))


def surviving_fields(groups: DataFrame) -> DataFrame:
    """group_entry_id, field_name and the entry each field survives from."""
    fields = F.array(
        F.struct(F.lit("entry_value").alias("field_name"), F.col("value_entry_id").alias("entry_id")),
        F.struct(F.lit("comments").alias("field_name"), F.col("comment_entry_id").alias("entry_id")),
    )
    return groups.select("group_entry_id", F.inline(fields)).filter("entry_id is not null")


def golden_records(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """The record built for each group: session, key (of the first entry), surviving value and comment (null if none does)."""
    one = entries.dropDuplicates(["entry_id"])
    pick = lambda col, name: one.select(F.col("entry_id").alias(f"_{name}"), F.col(col).alias(name))
    out = groups.join(one.select(F.col("entry_id").alias("group_entry_id"), "session_id", "entry_key"), "group_entry_id")
    for ref, col in (("value_entry_id", "entry_value"), ("comment_entry_id", "comments")):
        out = out.join(pick(col, col), F.col(ref) == F.col(f"_{col}"), "left").drop(f"_{col}")
    return out.select("session_id", "group_entry_id", "entry_key", "entry_value", "comments")


def consolidation(entries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session: groups of several entries, entries beyond the first of each, and the pipeline's own count.

    ``recorded`` is the largest dedup_stats.entries_consolidated of the session's rows; null where none is known.
    """
    key = bare(F.coalesce("entry_key", F.lit("")))
    members = entries.filter("session_id is not null").select("session_id", key.alias("key"), "entry_id").distinct()
    sizes = members.groupBy("session_id", "key").agg(F.count("*").alias("n")).filter("n > 1")
    per = sizes.groupBy("session_id").agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("consolidated"))
    said = sessions.groupBy("session_id").agg(F.max("dedup_stats.entries_consolidated").alias("recorded"))
    return per.join(said, "session_id", "left")
