"""Parquet tables of one directory, with the clean-up that their descriptions call for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import ship_package


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``: one parquet file or a folder of them."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_session_id(col) -> F.Column:
    """A session id without surrounding white space and in lower case; null stays null."""
    return F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))


def norm_label(col) -> F.Column:
    """A label such as a source or a document type: trimmed, lower case, blanks and hyphens as ``_``; null stays null."""
    return F.regexp_replace(F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", "")), r"(?U)[\s-]+", "_")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one object a row (nulls are left out)."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; nested columns must be turned into strings first."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """``base`` with rows of ``changes`` in place of those with an equal ``key``; among equal keys in ``changes`` the last by
    ``order`` wins, on a tie the largest by the other columns in turn. A null order comes first.

    Null keys never match and are kept from both sides. Columns must be orderable.
    """
    kept = base.join(changes.select(key).distinct(), key, "left_anti")
    last = changes.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max(F.struct(F.col(order).alias("__o"), *changes.columns)).alias("__r"))
    single = last.select(*(F.col(f"__r.{c}").alias(c) for c in changes.columns)).unionByName(changes.filter(F.col(key).isNull()))
    return kept.unionByName(single, allowMissingColumns=True)


def frames(events: DataFrame) -> DataFrame:
    """Each row as a frame of an event stream: column ``value``, ``data: `` and the row as JSON (nulls are left out), then a blank line.

    A stream of them goes to any text sink, e.g. ``frames(df).writeStream.format("text")``.
    """
    return events.select(F.concat(F.lit("data: "), F.to_json(F.struct(*events.columns)), F.lit("\n")).alias("value"))


def expired(df: DataFrame, time: str = "created_ts", days: int = 90, now=None) -> DataFrame:
    """Rows younger than ``days`` before ``now`` (a timestamp column; the latest time of ``df`` if not given); null times expire."""
    if now is not None:
        return df.filter(F.col(time) >= now - F.expr(f"interval {days} days"))
    last = df.agg(F.max(time).alias("_now"))
    return df.crossJoin(F.broadcast(last)).filter(F.col(time) >= F.col("_now") - F.expr(f"interval {days} days")).drop("_now")  # with one row


def write_excel(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """One sheet, by the driver; a sheet holds at most ``most`` rows, and a table of more raises ValueError. Needs openpyxl."""
    import importlib.util

    if importlib.util.find_spec("openpyxl") is None:
        raise RuntimeError("writing xlsx needs openpyxl; write_csv needs nothing")
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows do not fit a sheet")
    rows.to_excel(path, index=False)
