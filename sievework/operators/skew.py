"""Joins and numberings that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def join_counted(rows: DataFrame, groups: DataFrame, key: str, n: str, spread: Column, hot: int = 200_000) -> DataFrame:
    """``rows`` inner-joined to ``groups`` (one row per ``key``, with the number ``n`` of rows it has) without a skewed shuffle.

    A group of more than ``hot`` rows is hot; hot groups are broadcast (there are at most total rows / ``hot`` of them, so
    the broadcast is ``hot`` times smaller than the input), all others meet in an ordinary shuffle, in which rows of hot
    keys are spread by ``spread`` under keys that match nothing. Rows with a null key drop out, as in an inner join.
    Neither side may hold columns named ``_h`` or ``_k``; other shared names than ``key`` must not occur.
    """
    names = [c for c in groups.columns if c != key]
    is_hot = F.col(n) > hot
    h = F.broadcast(groups.filter(is_hot).select(F.col(key).alias("_k"), F.struct(*names).alias("_h")))
    cold = groups.filter(~is_hot)
    left = rows.filter(F.col(key).isNotNull()).join(h, F.col(key) == F.col("_k"), "left").drop("_k")
    same = [F.col(f"_h.{c}").alias(c) for c in names]
    done = left.filter(F.col("_h").isNotNull()).select(*rows.columns, *same)
    rest = left.filter(F.col("_h").isNull()).drop("_h").join(cold, key)
    return done.unionByName(rest.select(*rows.columns, *names))


def row_numbers(df: DataFrame, group: str, order: list[str], name: str, width: int = 100_000) -> DataFrame:
    """``df`` with ``name``, each row's number from 1 within its group, by ``order``, whose first column must be an integer.

    A group is numbered in stretches of ``width`` values of that column: counts of the stretches are added up (one row a
    stretch), rows are only sorted within theirs, so a group with most of all rows is spread over many tasks. A null group is a
    group; nulls of the first column come first. ``df`` is read twice.
    """
    stretch = F.floor(F.coalesce(F.col(order[0]), F.lit(-(1 << 62))) / width)
    counts = df.groupBy(F.col(group).alias("__g"), stretch.alias("__s")).agg(F.count("*").alias("__n"))
    before = counts.select("__g", "__s", (F.sum("__n").over(Window.partitionBy("__g").orderBy("__s")) - F.col("__n")).alias("__base"))
    own = F.row_number().over(Window.partitionBy(group, "__s2").orderBy(*order))
    rows = df.withColumn("__s2", stretch).withColumn("__own", own)
    j = rows.join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__s2") == F.col("__s")))
    return j.select(*df.columns, (F.col("__base") + F.col("__own")).alias(name))
