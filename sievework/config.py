"""Defaults of the pipeline, overridable by Spark settings below ``spark.sievework.``."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    fuzzy_threshold: float = 0.85
    chunk_size: int = 1200
    chunk_overlap: int = 100
    table_prefix: str = "prod_"
    learning: bool = False

    @classmethod
    def of(cls, spark: SparkSession) -> Config:
        """The session's settings, each read as the type of its default."""
        got = {}
        for f in fields(cls):
            raw = spark.conf.get(f"spark.sievework.{f.name}", None)
            if raw is not None:
                got[f.name] = raw.lower() in ("1", "true", "yes") if isinstance(f.default, bool) else type(f.default)(raw)
        return cls(**got)
