"""Duplicates hidden by formatting: canonical forms, 128-bit hashes and counts combined map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import bare, field_form, is_placeholder
from sievework.operators.components import connected_components
from sievework.operators.skew import join_counted
from sievework.session import written


def _hashed(*cols: Column) -> Column:
    """128 bits of a hash and 64 of an independent one that checks it; columns are joined with a character that bare forms never hold."""
    return F.concat(F.unhex(F.md5(F.concat_ws("\x1f", *cols))), F.unhex(F.lpad(F.hex(F.xxhash64(*reversed(cols))), 16, "0")))


def form_hashes(df: DataFrame, id_col: str, key_col: str, value_col: str, min_chars: int = 20) -> DataFrame:
    """``id``, ``plain`` (hash of the bare key and value, with its check) and ``fields`` (hash of the bare key and the sorted
    fields, with its check; null where the value lists none) of each distinct row that can be a copy: value no placeholder and at least
    ``min_chars`` letters and digits. Deliveries of one row twice become one.
    """
    k, v = F.coalesce(F.col(key_col), F.lit("")), F.col(value_col)
    rows = df.filter(~is_placeholder(v)).select(F.col(id_col).alias("id"), bare(k).alias("_k"), bare(v).alias("_v"), field_form(v).alias("_f"))
    rows = rows.filter(F.length("_v") >= min_chars)
    fields = F.when(F.col("_f").isNotNull(), _hashed(F.col("_k"), F.lit("fields"), F.col("_f")))
    return rows.select("id", _hashed(F.col("_k"), F.col("_v")).alias("plain"), fields.alias("fields")).distinct()


def collapse_formatting(df: DataFrame, id_col: str = "entry_id", key_col: str = "entry_key", value_col: str = "entry_value", min_chars: int = 20) -> DataFrame:
    """Sets of records equal but for white space, letter case, punctuation or field order.

    Result: ``id``, ``first`` (the smallest id of its set) and ``copies`` (records in the set), one row per record that
    belongs to a set of two or more. Two values are equal if their plain bare forms are, or if both list the same fields;
    sets are closed under both. Null and empty keys are equal to each other. Values that are null, blank, placeholders or
    shorter than ``min_chars`` letters and digits belong to no set. A null id is a record like any other, but only ids
    that differ are copies. Empty input gives no rows; other columns are ignored.
    Two forms, plain or of fields, that met in 128 bits would differ in their check, which is part of every grouping, so they are never merged.
    """
    rows = written(form_hashes(df, id_col, key_col, value_col, min_chars))  # texts are read once
    # Map-side combining leaves one row per form and partition, so a form with a third of all rows costs no more than others.
    plain = written(rows.groupBy("plain").agg(F.min("fields").alias("f"), F.max("fields").alias("f2"), F.min("id").alias("first"), F.count("*").alias("n")))
    sets = plain.select("plain", "first", "n", F.coalesce("f", "plain").alias("set"))
    # One plain form read as two different field lists joins both lists' sets; rare, so looked for before it is paid for.
    twice = plain.filter("f <> f2").select("plain")
    if twice.limit(1).count():
        links = rows.filter("fields is not null").join(twice, "plain", "left_semi").select(F.col("plain").alias("a"), F.col("fields").alias("b")).distinct()
        roots = connected_components(links)
        sets = sets.join(roots, sets["set"] == roots["node"], "left").select("plain", "first", "n", F.coalesce("component", "set").alias("set"))
    whole = sets.groupBy("set").agg(F.min("first").alias("lead"), F.sum("n").alias("copies"))
    groups = sets.join(whole.filter("copies > 1"), "set").select("plain", F.col("n").alias("_n"), F.col("lead").alias("first"), "copies")
    return join_counted(rows.select("id", "plain"), groups, "plain", "_n", F.col("id")).select("id", "first", "copies")
