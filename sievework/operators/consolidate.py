"""Fuzzy consolidation of entries: similar pairs within a group, their components, one survivor each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sievework.functions.similarity import Rules, similarity
from sievework.operators.components import connected_components
from sievework.operators.entries import cut_mark, exact_key_dedup, normalize_key, repair_marked, signature, strip, valid_entries
from sievework.operators.skew import row_numbers
from sievework.session import written

BLOCK = 200  # entries of a group that one side of a task's comparison holds
ROWS, PAIRS = 4_000, 200_000  # entries, and pairs of them, that a task looks at in one go


def once(rows: DataFrame, seen: DataFrame, group: str, order: str) -> DataFrame:
    """``rows``, each group and order once. Whether ``seen``, which they come from, repeats any is counted first, as ids take a
    small part of the shuffle that whole rows do.
    """
    twice = seen.groupBy(group, order).agg(F.count("*").alias("_n")).filter("_n > 1").limit(1).count()
    return rows.dropDuplicates([group, order]) if twice else rows


def prepared(df: DataFrame, group: str, order: str) -> DataFrame:
    """Valid entries with what the pair test reads: norm, signature, key, value, comments, education."""
    return once(valid_entries(df), df, group, order).select(
        F.col(group).alias("g"), F.col(order).alias("o"), F.col("entry_key").alias("key"), F.col("entry_value").alias("value"), strip(F.coalesce("comments", F.lit(""))).alias("comments"),
        normalize_key(F.col("entry_key")).alias("norm"), signature(F.col("entry_key"), F.col("entry_value")).alias("signature"),
    )


def similar_pairs(rows: DataFrame, threshold: float = 0.85, compat: bool = False) -> DataFrame:
    """Orders ``a`` < ``b`` of similar entries of one group, in columns g, a, b.

    A group is cut into blocks of BLOCK entries and every pair of blocks is one task's work of bounded size, so a group with a
    third of all rows is spread over many tasks; only pairs that are similar come out.
    """
    rules = Rules(threshold, compat)
    kind = rows.schema["o"].dataType.simpleString()
    gkind = rows.schema["g"].dataType.simpleString()
    rows = rows.filter(F.col("o").isNotNull())
    size = rows.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("_size"))
    sized = lambda which: rows.join(size.filter(which), F.col("g") == F.col("_g")).withColumn("last", F.floor((F.col("_size") - 1) / BLOCK).cast("int")).drop("_g", "_size")
    # One entry alone has no pair; a group of one block needs no numbers.
    few = sized(F.col("_size").between(2, BLOCK)).drop("last").withColumns({c: F.lit(0) for c in ("block", "i", "j")})
    # Numbered by stretches where the order allows it, so that a group with a large share of all rows is no single task.
    many, spread = sized(F.col("_size") > BLOCK), kind in ("tinyint", "smallint", "int", "bigint")
    numbered = row_numbers(many, "g", ["o"], "_n") if spread else many.withColumn("_n", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    blocked = numbered.withColumn("block", F.floor((F.col("_n") - 1) / BLOCK).cast("int")).drop("_n")
    # A row of block b takes part in every pair of blocks (i, j), i <= j, with b among them.
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    placed = blocked.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    placed = few.unionByName(placed.select(few.columns))

    def pairs_of(pdf: pd.DataFrame) -> pd.DataFrame:
        """Similar entries of whole pairs of blocks, which come one after the other, each sorted by block and order."""
        es = pdf[["g", "o", "key", "value", "comments", "norm", "signature"]].to_dict("records")
        for e in es:
            e["education"] = rules.is_education(e["key"].lower(), e["value"].lower())
        at, edge = np.arange(len(pdf)), np.flatnonzero(_begins(pdf))
        ends = np.repeat(np.append(edge[1:], len(pdf)), np.diff(np.append(edge, len(pdf))))
        i, j, block = (pdf[c].to_numpy() for c in ("i", "j", "block"))
        # Each row meets the later ones of its block, or all of the other block, which stand behind it.
        left = np.add.reduceat((block == i).astype(np.int64), edge)
        second = np.repeat(edge + left, np.diff(np.append(edge, len(pdf))))
        first = np.where(i == j, at + 1, np.where(block == i, second, ends))
        n = ends - first
        found = []
        part = np.cumsum(n) // PAIRS
        for k in range(int(part[-1]) + 1):
            own = at[part == k]
            a = np.repeat(own, n[own])
            b = np.arange(len(a)) - np.repeat(np.cumsum(n[own]) - n[own], n[own]) + np.repeat(first[own], n[own])
            hit = rules.similar(es, a, b)
            found += [(es[x]["g"], es[x]["o"], es[y]["o"]) for x, y in zip(a[hit].tolist(), b[hit].tolist())]
        return pd.DataFrame(found, columns=["g", "a", "b"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= ROWS:
                rows = pd.concat(held, ignore_index=True)
                done = int(np.flatnonzero(_begins(rows))[-1])  # the last pair of blocks may go on in the next batch
                if done:
                    yield pairs_of(rows.iloc[:done])
                held, n = [rows.iloc[done:]], len(rows) - done
        if n:
            yield pairs_of(pd.concat(held, ignore_index=True))

    # Little data but much work: a number of partitions keeps adaptive execution from making one task of it all.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "g", "i", "j").sortWithinPartitions("g", "i", "j", "block", "o").mapInPandas(compare, f"g {gkind}, a {kind}, b {kind}")


def _begins(pdf: pd.DataFrame) -> np.ndarray:
    """Where a row's pair of blocks is not that of the row before."""
    return np.logical_or.reduce([(pdf[c] != pdf[c].shift()).to_numpy(bool) for c in ("g", "i", "j")])


def fuzzy_consolidate(df: DataFrame, group: str, order: str, threshold: float = 0.85, compat: bool = False) -> DataFrame:
    """One row per component of similar entries within a group: group, first_order (its first member), best_order (its survivor),
    n, comments (up to three distinct ones, the longest first, joined with `` | ``, or the survivor's own) and value (the survivor's).

    ``order`` must be unique over all groups. Entries that are not valid (see `valid_entries`) take no part. The survivor has the
    highest score (length, comments, no cut mark, digits, words, punctuation, key length), the first on a tie. Of several entries
    more than half of which are about education it is the one of the highest `_education_score`; its comments are the first three
    distinct ones, and its value takes the range of the component's years if these are two and it lacks one.
    """
    rules = Rules(threshold, compat)
    rows = prepared(df, group, order)
    links = similar_pairs(rows, threshold, compat)
    roots = written(connected_components(links.select("a", "b")))
    member = rows.join(roots, F.col("o") == F.col("node")).withColumnRenamed("component", "c")
    v = F.col("value")
    score = (
        F.length(v) * 0.4 + F.when(F.length("comments") > 10, 30).otherwise(0) + F.when(cut_mark(v), 0).otherwise(20) + F.when(F.regexp_like(v, F.lit("[0-9]")), 5).otherwise(0)
        + F.when(F.size(F.filter(F.split(v, r"\s+"), lambda x: x != "")) > 3, 5).otherwise(0) + F.when(F.regexp_like(v, F.lit("[.,;:]")), 3).otherwise(0) + F.length("key") * 0.1
    )
    is_education = F.udf(lambda k, x: rules.is_education(k.lower(), x.lower()), "boolean")
    years = F.regexp_extract_all(v, F.lit(r"\b((?:19|20)\d{2})\b" if not compat else r"\b(19|20)\d{2}\b"), F.lit(1))
    member = member.withColumn("edu", is_education("key", "value")).withColumn("years", years)
    notes = F.array_sort(F.collect_set(F.when(F.length("comments") > 0, F.struct("o", "comments"))))
    best = lambda points: F.max(F.struct(F.bround(points, 6).alias("score"), (-F.col("o")).alias("neg"), "comments", "value", "years"))
    g = member.groupBy("g", "c").agg(
        F.min("o").alias("first_order"), F.count("*").alias("n"), best(score).alias("b"), best(_education_score(F.lower("key"), F.lower("value"))).alias("e"), notes.alias("notes"),
        F.avg(F.col("edu").cast("int")).alias("edu"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("years")))).alias("all_years"),
    )
    taught = (F.col("n") > 1) & (F.col("edu") > 0.5)
    g = g.withColumn("b", F.when(taught, F.col("e")).otherwise(F.col("b"))).withColumn("span", F.array_join("all_years", "-"))
    lacks = taught & (F.size("all_years") == 2) & (F.size(F.array_except("all_years", "b.years")) > 0) & ~F.contains(F.col("b.value"), F.col("span"))
    value = F.when(lacks, F.concat("b.value", F.lit(" ("), F.col("span"), F.lit(")"))).otherwise(F.col("b.value"))
    merged = _merge(F.transform("notes", lambda x: x["comments"]), ~taught)
    several = g.select(F.col("g").alias(group), "first_order", (-F.col("b.neg")).alias("best_order"), "n", F.coalesce(merged, F.nullif("b.comments", F.lit(""))).alias("comments"), value.alias("value"))
    # An entry that resembles no other stands for itself.
    alone = rows.join(roots, F.col("o") == F.col("node"), "left_anti")
    return several.unionByName(alone.select(F.col("g").alias(group), F.col("o").alias("first_order"), F.col("o").alias("best_order"), F.lit(1).cast("long").alias("n"), F.nullif("comments", F.lit("")).alias("comments"), "value"))


def _education_score(k: Column, v: Column) -> Column:
    """What an entry (its key and value in lower case) is worth among entries about education."""
    has = lambda c, p: F.regexp_like(c, F.lit(p))
    n = F.regexp_count(v, F.lit(r"\b(19|20)\d{2}\b"))
    score = F.when(has(k, r"\b\d+(st|nd|rd|th)\b"), 50).when(has(k, r"\b(st|nd|rd|th)\b"), -20).otherwise(0) + F.when(n >= 2, 30).when(n == 1, 15).otherwise(0)
    for term in ("grade", "gpa", "score", "achievement", "degree", "diploma"):
        score += F.when(F.contains(k, F.lit(term)) | F.contains(v, F.lit(term)), 10).otherwise(0)
    return score + F.length(v) * 0.1 + F.when(has(v, r"\b\d+(\.\d+)?%?\b"), 15).otherwise(0) + F.when(cut_mark(v), 0).otherwise(10)


@F.pandas_udf(T.StringType())
def _merge(notes: pd.Series, by_length: pd.Series) -> pd.Series:
    """Up to three of the comments no earlier one resembles, the longest first if so told; null unless there are several."""
    out = []
    for xs, longest in zip(notes, by_length):
        kept: list[str] = []
        for x in dict.fromkeys(xs if xs is not None else ()):
            if not any(similarity(x, k) > 0.8 for k in kept):
                kept.append(x)
        out.append(" | ".join((sorted(kept, key=len, reverse=True) if longest else kept)[:3]) if len(kept) > 1 else None)
    return pd.Series(out, dtype=object)


def deduplicated(df: DataFrame, group: str, order: str, threshold: float = 0.85, fuzzy: bool = True, repair: bool = True) -> dict[str, DataFrame]:
    """The stages of deduplication, each as the rows that are left after it: ``input`` (rows of equal group and order are one),
    ``valid``, ``repaired`` (keys normalized, marked values made whole; column ``was_repaired``), ``fuzzy`` (survivors of the fuzzy
    consolidation with its comments and value) and ``exact`` (one row per normalized key, with ``first_order``).

    ``order`` must be unique over all groups. Keys that normalizing leaves too short take no part in the consolidation, but stay.
    """
    one = df.dropDuplicates([group, order])
    rows = valid_entries(df).withColumn("raw_key", F.col("entry_key"))
    rows = written(rows.withColumn("entry_key", normalize_key(F.col("entry_key"))))
    rows = once(rows, rows, group, order).withColumn("was_repaired", F.lit(False))
    fixed = rows
    if repair:
        whole = written(repair_marked(rows, group, order, unique=True).select(F.col(order).alias("_e"), "repaired"))
        fixed = rows.join(whole, F.col(order) == F.col("_e"), "left").withColumn("was_repaired", F.col("repaired").isNotNull())
        fixed = fixed.withColumn("entry_value", F.coalesce("repaired", "entry_value")).drop("_e", "repaired")
    kept = fixed
    if fuzzy:
        best = fuzzy_consolidate(fixed, group, order, threshold)
        # An entry that stands for itself alone brings nothing it has not got, but for its comments' margins.
        changed = lambda c: F.when(F.col("n") > 1, F.col(c))
        best = best.select(F.col("best_order").alias("_b"), changed("comments").alias("_n"), changed("value").alias("_v"), (F.col("n") == 1).alias("_alone"))
        kept = fixed.join(best, F.col(order) == F.col("_b"), "left").filter(F.col("_b").isNotNull() | (F.length("entry_key") < 2))
        own = F.when(F.col("_alone"), F.nullif(strip(F.col("comments")), F.lit("")))
        kept = written(kept.withColumn("comments", F.coalesce("_n", own, "comments")).withColumn("entry_value", F.coalesce("_v", "entry_value")).drop("_b", "_n", "_v", "_alone"))
    last = exact_key_dedup(kept, group, order, unique=True).select(F.col("best_order").alias("_b"), "first_order", F.col("comments").alias("_n"))
    last = kept.join(last, F.col(order) == F.col("_b")).withColumn("comments", F.coalesce("_n", "comments")).drop("_n", "_b")
    return {"input": one, "valid": rows.withColumn("entry_key", F.col("raw_key")), "repaired": fixed, "fuzzy": kept, "exact": last}


def dedup_stats(df: DataFrame, group: str, order: str, threshold: float = 0.85, fuzzy: bool = True) -> DataFrame:
    """One row of what each stage of `deduplicated` leaves: input_count, after_validation, after_normalization, after_repair,
    after_fuzzy, after_exact, final_count; truncation_repairs, fuzzy_duplicates_removed, exact_duplicates_removed, and
    reduction_percentage of the input, 0 without any.
    """
    s = deduplicated(df, group, order, threshold, fuzzy)
    n = lambda name, *more: s[name].agg(F.count("*").alias(f"n_{name}"), *more)
    r = n("input").crossJoin(n("repaired", F.count_if("was_repaired").alias("fixed"))).crossJoin(n("fuzzy")).crossJoin(n("exact"))  # of one row each
    cut = F.when(F.col("n_input") > 0, F.bround((1 - F.col("n_exact") / F.col("n_input")) * 100, 1)).otherwise(0.0)
    same = [F.col("n_repaired").alias(c) for c in ("after_validation", "after_normalization", "after_repair")]  # these stages drop nothing
    return r.select(
        F.col("n_input").alias("input_count"), *same, F.col("n_fuzzy").alias("after_fuzzy"), F.col("n_exact").alias("after_exact"), F.col("n_exact").alias("final_count"),
        F.col("fixed").alias("truncation_repairs"), (F.col("n_repaired") - F.col("n_fuzzy")).alias("fuzzy_duplicates_removed"), (F.col("n_fuzzy") - F.col("n_exact")).alias("exact_duplicates_removed"), cut.alias("reduction_percentage"),
    )
