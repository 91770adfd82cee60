"""The extraction pipeline: documents to sections to entries, cleaned, repaired, deduplicated and put in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.config import Config
from sievework.operators.chunking import semantic_chunks
from sievework.operators.consolidate import deduplicated
from sievework.operators.entries import document_order
from sievework.sources.scans import Extractor, extract, label_extractor


def extract_documents(docs: DataFrame, extractor: Extractor = label_extractor, fuzzy: bool = True, threshold: float | None = None) -> DataFrame:
    """doc_id, ``#``, entry_key, entry_value, comments, chunk_id and final_position of the entries of all documents.

    Stages: sections, extractor, validation, repair of marked values, fuzzy consolidation (it compares all pairs of a document,
    at the session's `Config.fuzzy_threshold` if no ``threshold`` is given; left out without ``fuzzy``), one entry per normalized key, document order. Documents without entries give no rows.
    """
    raw = extract(semantic_chunks(docs.dropDuplicates(["doc_id"])), extractor=extractor).filter("status = 'success'")
    # An id over all documents that sorts as the entries stand.
    rows = raw.withColumn("entry_id", F.col("doc_id") * 10_000_000_000 + F.col("chunk_id") * 100_000 + F.col("pos"))
    least = Config.of(docs.sparkSession).fuzzy_threshold if threshold is None else threshold
    rows = deduplicated(rows, "doc_id", "entry_id", least, fuzzy)["exact"]
    return document_order(rows, "doc_id", "first_order").select("doc_id", "#", "entry_key", "entry_value", "comments", "chunk_id", "final_position")
