"""References to keys that their parent table does not hold, found with bitmaps per key range and period.

Keys of both sides are dictionary-encoded as integers. Per key range and period one bitmap says which keys are referred to,
one which parents arrived and one which were removed. The parents sure to be there for a whole period are those that arrived
in an earlier period and were not removed up to its end; *referred AND NOT sure* leaves few bits, and only the rows behind
those bits are held against exact times. All other rows are settled by the bitmaps alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BITS = 32768  # of one of Spark's bitmaps
KEYS = 20_000  # of a range, about: few enough to be sorted and numbered in memory, enough to fill a bitmap


def _and_not(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The codes of the bits that are left of (referred AND NOT (arrived AND NOT removed))."""
    zero = b"\0" * (BITS // 8)
    for rb in batches:
        grids = [np.frombuffer(b"".join(x or zero for x in rb.column(c).to_pylist()), np.uint8).reshape(rb.num_rows, BITS // 8) for c in ("referred", "arrived", "removed")]
        row, bit = np.nonzero(np.unpackbits(grids[0] & ~(grids[1] & ~grids[2]), axis=1, bitorder="little"))
        at = pa.array(row)
        code = rb.column("base").to_numpy()[row] + bit + 1
        yield pa.RecordBatch.from_arrays([rb.column("rng").take(at), rb.column("period").take(at), pa.array(code)], ["rng", "period", "code"])


def dictionary(keys: DataFrame, ranges: int) -> DataFrame:
    """``rng`` and ``code`` (1, 2, ...) of each distinct non-null ``key``: ranges by hash, codes by order within one."""
    d = keys.select("key").filter(F.col("key").isNotNull()).distinct().withColumn("rng", F.pmod(F.xxhash64("key"), F.lit(ranges)))
    return d.withColumn("code", F.row_number().over(Window.partitionBy("rng").orderBy("key")).cast("long"))


def orphan_references(children: DataFrame, parents: DataFrame, ranges: int | None = None, period: str = "month") -> DataFrame:
    """The rows of ``children`` whose key no parent held at their time, with the reason.

    ``children``: child_table, child_id, key, at. ``parents``: key, received, removed (several rows of a key count as one:
    its first receipt, its first removal). Result: child_table, child_id, key, at, reason, each distinct row once; reason
    is ``missing`` (no row of the key was ever received), ``late`` (received after ``at``) or ``removed`` (removed at or
    before ``at``; a row both late and removed is ``removed``).
    Null keys refer to nothing and are left out. A null ``at`` counts as after everything. A parent whose ``received`` is
    null in every row was never received. Empty ``children`` give no rows; empty ``parents`` make every reference missing.
    Keys are split into ``ranges`` by hash; without it into as many as give each some KEYS keys, from a count that takes one pass.
    """
    last = F.lit("9999-12-01").cast("timestamp_ntz")
    per = lambda c: F.date_trunc(period, F.coalesce(c.cast("timestamp_ntz"), last)).cast("timestamp_ntz")
    kids = children.select("child_table", "child_id", "key", F.col("at").cast("timestamp_ntz").alias("at")).filter(F.col("key").isNotNull()).distinct().withColumn("period", per(F.col("at")))
    held = parents.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.col("received").cast("timestamp_ntz")).alias("received"), F.min(F.col("removed").cast("timestamp_ntz")).alias("removed"))
    keys = kids.select("key").union(held.select("key"))
    if ranges is None:
        n = children.select("key").union(parents.select("key")).agg(F.approx_count_distinct("key")).first()[0]
        ranges = max(1, -(-n // KEYS))
    codes = dictionary(keys, ranges)

    marks = (
        kids.select("key", "period", F.lit("ref").alias("kind")).distinct()
        .unionByName(held.filter("received is not null").select("key", per(F.col("received")).alias("period"), F.lit("arr").alias("kind")))
        .unionByName(held.filter("removed is not null").select("key", per(F.col("removed")).alias("period"), F.lit("rem").alias("kind")))
        .join(codes, "key")
        .withColumn("base", F.floor((F.col("code") - 1) / BITS) * BITS)
        .groupBy("rng", "base", "period")
        .agg(*(F.expr(f"bitmap_construct_agg(bitmap_bit_position(code)) filter (where kind = '{k}')").alias(k) for k in ("ref", "arr", "rem")), F.max((F.col("kind") == "ref").cast("int")).alias("any_ref"))
    )
    by = Window.partitionBy("rng", "base").orderBy("period")
    sure = marks.select(
        "rng", "base", "period", "any_ref", F.col("ref").alias("referred"),
        F.expr("bitmap_or_agg(arr) over (partition by rng, base order by period rows between unbounded preceding and 1 preceding)").alias("arrived"),
        F.bitmap_or_agg("rem").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("removed"),
    ).filter("any_ref = 1").drop("any_ref")
    open_keys = sure.mapInArrow(_and_not, "rng long, period timestamp_ntz, code long").join(codes, ["rng", "code"]).select("key", "period")

    rows = kids.join(open_keys, ["key", "period"]).join(held, "key", "left")
    at = F.coalesce("at", last)
    reason = F.when(F.col("removed") <= at, "removed").when(F.col("received").isNull(), "missing").when(F.col("received") > at, "late")
    return rows.withColumn("reason", reason).filter("reason is not null").select("child_table", "child_id", "key", "at", "reason")


def orphan_report(children: DataFrame, orphans: DataFrame) -> DataFrame:
    """References and orphans of each child table and month of ``at``: child_table, month, refs, missing, late, removed.

    Months without references have no row; a null ``at`` has a row with a null month.
    """
    month: Column = F.date_format(F.col("at"), "yyyy-MM").alias("month")
    refs = children.filter(F.col("key").isNotNull()).select("child_table", "child_id", "key", "at").distinct().groupBy("child_table", month).agg(F.count("*").alias("refs"))
    bad = orphans.groupBy("child_table", month).agg(*(F.count_if(F.col("reason") == r).alias(r) for r in ("missing", "late", "removed")))
    both = refs.alias("r").join(bad.alias("b"), (F.col("r.child_table") == F.col("b.child_table")) & F.col("r.month").eqNullSafe(F.col("b.month")), "left")
    return both.select("r.child_table", "r.month", "r.refs", *(F.coalesce(f"b.{x}", F.lit(0)).alias(x) for x in ("missing", "late", "removed")))
