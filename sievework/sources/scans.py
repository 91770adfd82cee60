"""Scans of files: texts, PDF through a pluggable reader, JSON results, fenced code, progress frames; extraction per chunk."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Extractor = Callable[[str], list[tuple[str, str, str | None]]]


def read_texts(spark: SparkSession, path: str, least: int = 1, most: int = 50_000) -> DataFrame:
    """path, text and error of whole files: texts outside ``least`` to ``most`` characters come with an error in place of the text."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    n = F.length(F.trim("text"))
    return checked(df, "text", F.when(n < least, f"text of less than {least} characters").when(n > most, f"text of more than {most} characters"))


def checked(df: DataFrame, text: str, error: Column) -> DataFrame:
    """``df`` with ``error``, and ``text`` null where there is one."""
    return df.withColumn("error", error).withColumn(text, F.when(F.col("error").isNull(), F.col(text)))


def read_pdfs(spark: SparkSession, path: str, pages_of: Callable[[bytes], list[str | None]], most_bytes: int = 50 << 20) -> DataFrame:
    """path, text (pages under their banners; pages without text keep their number), total_pages, file_size and error of PDF files.

    A file of more than ``most_bytes`` and one that cannot be read have an error and no text. ``pages_of`` turns a file's bytes into its pages' texts; no PDF library is part of this package.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content, size in zip(pdf["path"], pdf["content"], pdf["length"]):
                try:
                    if size > most_bytes:
                        raise ValueError(f"file of more than {most_bytes} bytes")
                    pages = pages_of(bytes(content))
                    rows.append((name, "\n\n".join(f"--- Page {i} ---\n{p}" for i, p in enumerate(pages, 1) if p), len(pages), size, None))
                except Exception as e:  # noqa: BLE001 - a file's failure is data
                    rows.append((name, None, None, size, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "total_pages", "file_size", "error"]).astype({"total_pages": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    files = files.withColumn("content", F.when(F.col("length") <= most_bytes, F.col("content")))
    return files.select("path", "content", "length").mapInPandas(run, "path string, text string, total_pages int, file_size long, error string")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Exported results: entries, global_notes, session_id, processing_time of each JSON file."""
    schema = "entries array<struct<Key:string,Value:string,Comments:string>>, global_notes string, session_id string, processing_time double"
    return spark.read.schema(schema).json(path, multiLine=True)


def read_snippets(spark: SparkSession, path: str) -> DataFrame:
    """path and the first fenced Python block of each Markdown file, in order of path."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", r"(?s)```python\s*\n(.*?)```", 1).alias("code"))
    return df.filter("code <> ''").orderBy("path")


def parse_frames(lines: DataFrame) -> DataFrame:
    """Progress events of ``data: {json}`` lines (column value); other lines and broken ones are dropped."""
    schema = "event string, session string, chunk int, seq long, status string, entries_count int, processing_time double"
    e = F.from_json(F.expr("substring(value, 7)"), schema)
    return lines.filter(F.startswith("value", F.lit("data: "))).select(e.alias("e")).filter("e.event is not null").select("e.*")


def label_extractor(text: str) -> list[tuple[str, str, str | None]]:
    """The default extractor: a line ``label: value`` is an entry, any other line of three words or more one whose key is its
    first two words.
    """
    out: list[tuple[str, str, str | None]] = []
    for line in text.splitlines():
        m = re.match(r"\s*([^\s:][^:]{0,60}):\s+(\S.*)$", line)
        words = line.split()
        if m:
            out.append((m.group(1).strip(), m.group(2).strip(), None))
        elif len(words) > 2:
            out.append((" ".join(words[:2]), " ".join(words[2:]), None))
    return out


def extract(chunks: DataFrame, id_col: str = "doc_id", extractor: Extractor = label_extractor) -> DataFrame:
    """Entries of each chunk (id, chunk_id, content) by ``extractor``: id, chunk_id, pos, entry_key, entry_value, comments,
    status and error. A chunk that fails is one row with status ``error``; null contents give none.
    """
    kind = chunks.schema[id_col].dataType.simpleString()
    names = [id_col, "chunk_id", "pos", "entry_key", "entry_value", "comments", "status", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, chunk, text in zip(pdf["id"], pdf["chunk_id"], pdf["content"]):
                try:
                    rows += [(key, chunk, i, k, v, c, "success", None) for i, (k, v, c) in enumerate(extractor(text))]
                except Exception as e:  # noqa: BLE001 - a chunk's failure is data
                    rows.append((key, chunk, 0, None, None, None, "error", str(e)))
            yield pd.DataFrame(rows, columns=names)

    src = chunks.select(F.col(id_col).alias("id"), "chunk_id", "content").filter("content is not null")
    return src.mapInPandas(run, f"{id_col} {kind}, chunk_id int, pos int, entry_key string, entry_value string, comments string, status string, error string")
