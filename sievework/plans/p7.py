"""Problem 7: rows of user_feedback and performance_metrics that name a session which was not there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.references import orphan_references, orphan_report
from sievework.sources.tables import norm_session_id, read_table


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def kids(name: str, key: str) -> DataFrame:
        k = norm_session_id(F.col("session_id"))
        return read_table(spark, sf_dir, name).select(F.lit(name).alias("child_table"), F.col(key).alias("child_id"), F.when(k != "", k).alias("key"), F.col("received_ts").alias("at"))

    children = kids("user_feedback", "feedback_id").unionByName(kids("performance_metrics", "metric_id"))
    parents = read_table(spark, sf_dir, "processing_sessions").select(norm_session_id(F.col("session_id")).alias("key"), F.col("received_ts").alias("received"), F.col("deleted_ts").alias("removed"))
    return children, parents


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child_table and child_id of each orphan row."""
    return orphan_references(*_sides(spark, sf_dir)).select("child_table", "child_id").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and orphans per table and month."""
    children, parents = _sides(spark, sf_dir)
    return orphan_report(children, orphan_references(children, parents))


QUERIES = {"p7_found": p7_found, "p7_report": p7_report}

_BASE = """
WITH s AS (SELECT lower(trim(session_id, ' \t\n\r')) AS k, min(received_ts) AS r, min(deleted_ts) AS d FROM processing_sessions GROUP BY 1),
c AS (SELECT DISTINCT 'user_feedback' AS child_table, feedback_id AS child_id, lower(trim(session_id, ' \t\n\r')) AS k, received_ts AS ts FROM user_feedback
      UNION SELECT DISTINCT 'performance_metrics', metric_id, lower(trim(session_id, ' \t\n\r')), received_ts FROM performance_metrics),
j AS (SELECT c.*, CASE WHEN d <= ts THEN 'removed' WHEN r IS NULL THEN 'missing' WHEN r > ts THEN 'late' END AS reason
      FROM c LEFT JOIN s USING (k) WHERE k IS NOT NULL AND k <> '')
"""
SQL = {
    "p7_found": _BASE + "SELECT DISTINCT child_table, child_id FROM j WHERE reason IS NOT NULL",
    "p7_report": _BASE + "SELECT child_table, strftime(ts, '%Y-%m') AS month, count(*) AS refs, count(*) FILTER (reason = 'missing') AS missing, count(*) FILTER (reason = 'late') AS late, count(*) FILTER (reason = 'removed') AS removed FROM j GROUP BY 1, 2",
}
