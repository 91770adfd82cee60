"""Every core query against its SQL twin, and the entry points."""

from __future__ import annotations

import sys

import pytest

import __spark_entry__ as entry
from sievework.plans import registry
from tests.helpers import same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, small, duck, name):
    same(registry.QUERIES[name](spark, small).toPandas(), duck.execute(registry.SQL[name]).df())


def test_positions_and_their_methods(spark, small):
    """Every entry has one place; the methods of all add up."""
    placed = registry.QUERIES["entry_positions"](spark, small)
    n = spark.read.parquet(f"{small}/entries.parquet").select("entry_id").distinct().count()
    assert placed.count() == placed.select("entry_id").distinct().count() == n
    m = registry.QUERIES["position_methods"](spark, small).first()
    assert m.total_entries == m.exact + m.fuzzy + m.context + m.fallback == n


def test_stages_only_take_away(spark, small):
    """The fuzzy stage keeps as many entries as it has components, and the pipeline's order counts each document from 1."""
    s = registry.QUERIES["dedup_stats"](spark, small).first()
    assert s.input_count >= s.after_validation == s.after_repair >= s.after_fuzzy >= s.after_exact == s.final_count > 0
    assert s.after_repair - s.after_fuzzy == s.fuzzy_duplicates_removed and s.after_fuzzy - s.after_exact == s.exact_duplicates_removed
    rows = registry.QUERIES["extraction_pipeline"](spark, small).groupBy("doc_id").agg({"#": "max", "*": "count"}).collect()
    assert rows and all(r["max(#)"] == r["count(1)"] for r in rows)


def test_character_windows_of_whole_documents(spark, small):
    """Windows are what the document has at their place."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = registry.QUERIES["char_chunks"](spark, small).collect()
    assert got and all(r.content in docs[r.doc_id][r.start_pos : r.start_pos + 1200] and len(r.content) == r.length for r in got)


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


def test_entry_works_without_llm(monkeypatch):
    monkeypatch.setitem(sys.modules, "sievework.llm", None)
    monkeypatch.delitem(sys.modules, "sievework.llm.queries", raising=False)
    assert set(entry.queries()) == set(registry.QUERIES)
    assert set(entry.oracle_sql()) == set(registry.SQL)
