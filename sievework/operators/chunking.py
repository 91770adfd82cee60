"""Sections and character windows of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
# What a section's first line looks like, in any letter case.
HEADERS = [
    r"[A-Z][A-Z\s&]{10,}$",
    r"\d+\.\s+[A-Z]",
    r"[A-Z][a-z]+:",
    r"Event\s+Details?:?",
    r"Schedule:?",
    r"Registration:?",
    r"Contact:?",
    r"Hotel:?",
    r"Pricing:?",
    r"Day\s+\d+",
    r"Session\s+\d+",
]
HEADER = "(?i)^(?:" + "|".join(HEADERS) + ")"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def _sections(lines: Column, stripped: Column) -> Column:
    """Array of (line, header): the header lines, or evenly spaced sections where there are fewer than three."""
    at = lambda i: stripped[i]
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    found = F.transform(F.filter(every, lambda i: (F.length(at(i)) > 3) & F.regexp_like(at(i), F.lit(HEADER))), lambda i: F.struct(i.alias("line"), at(i).alias("header")))
    n = F.size(lines)
    step = F.greatest(F.lit(1), F.floor(n / F.least(F.lit(8), F.greatest(F.lit(1), F.floor(n / 50)))).cast("int"))
    near = lambda i: F.filter(F.slice(stripped, F.greatest(F.lit(0), i - 5) + 1, F.least(n, i + 10) - F.greatest(F.lit(0), i - 5)), lambda x: F.length(x) > 5)
    even = F.transform(F.sequence(F.lit(0), n - 1, step), lambda i: F.struct(i.alias("line"), F.coalesce(F.substring(F.try_element_at(near(i), F.lit(1)), 1, 50), F.lit("Content Section")).alias("header")))
    return F.when(F.size(found) >= 3, found).otherwise(even)


def _kept(df: DataFrame) -> DataFrame:
    """``df`` behind a generator of one row each: the optimizer would otherwise copy an array's expression into every use."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def semantic_chunks(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sections of more than 100 characters of each document: id, chunk_id (the section's ordinal, gaps stay), content, header,
    section_type, start_line, end_line, content_length, start_page, end_page, page_range.

    A section runs from its header line to the next; text before the first header belongs to none. Sections of more than ten
    lines repeat a seventh of as many lines before them (two at least), unless blank. Pages are estimated from positions.
    A document without any long section but with text is one chunk. Null and blank texts and empty tables give no chunk.
    All is done within each row: the plan has no shuffle.
    """
    base = docs.select(F.col(id_col).alias("id"), "text", F.coalesce("total_pages", F.lit(1)).alias("pages")).filter(F.length(strip(F.col("text"))) > 0)
    base = _kept(base.withColumn("lines", F.split("text", "\n")).withColumn("stripped", F.transform("lines", strip)))
    base = _kept(base.withColumn("sections", _sections(F.col("lines"), F.col("stripped"))).withColumn("n", F.size("lines")))
    lines, cpp = F.col("lines"), F.length("text") / F.greatest(F.lit(1), F.col("pages"))

    def join(start: Column, count: Column) -> Column:
        return F.array_join(F.slice(lines, start + 1, count), "\n")

    def chunk(s: Column, i: Column) -> Column:
        start, nxt = s["line"], F.try_element_at("sections", i + 2)
        end = F.coalesce(nxt["line"], F.col("n"))
        own = strip(join(start, end - start))
        k = F.greatest(F.lit(2), F.floor((end - start) / 7).cast("int"))
        first = F.greatest(F.lit(0), start - k)
        before = join(first, start - first)
        content = F.when((i > 0) & (end - start > 10) & (F.length(strip(before)) > 0), F.concat(before, F.lit("\n"), own)).otherwise(own)
        pos = F.when(start > 0, F.length(join(F.lit(0), start)) + 1).otherwise(0)
        return F.struct((i + 1).alias("chunk_id"), content.alias("content"), s["header"].alias("header"), start.alias("start_line"), end.alias("end_line"), pos.alias("pos"), F.length(own).alias("own"))

    made = _kept(base.withColumn("chunks", F.filter(F.transform("sections", chunk), lambda c: c["own"] > 100)).drop("lines", "stripped", "sections"))
    # A document without long sections is one; both kinds in one pass, as reading twice would cut every document twice.
    whole = F.struct(
        F.lit(1).alias("chunk_id"), strip(F.col("text")).alias("content"), F.lit("Full Content").alias("header"), F.lit(0).alias("start_line"), F.col("n").alias("end_line"), F.lit(0).alias("pos"), F.lit(0).alias("own")
    )
    each = F.when(F.size("chunks") > 0, F.col("chunks")).otherwise(F.array(whole))
    rows = made.select("id", "pages", cpp.alias("cpp"), F.length("text").alias("size"), (F.size("chunks") == 0).alias("full"), F.inline(each))
    first = F.greatest(F.lit(1), F.floor(F.col("pos") / F.col("cpp")).cast("int") + 1)
    last = F.greatest(first, F.floor((F.col("pos") + F.length("content")) / F.col("cpp")).cast("int") + 1)
    full = lambda a, b: F.when(F.col("full"), a).otherwise(b)
    rows = rows.withColumn("start_page", full(F.lit(1), F.least(first, F.col("pages")))).withColumn("end_page", full(F.col("pages"), F.least(last, F.col("pages"))))
    pages = F.when(F.col("start_page") != F.col("end_page"), F.concat_ws("-", F.col("start_page").cast("string"), F.col("end_page").cast("string"))).otherwise(F.col("start_page").cast("string"))
    return rows.select(
        F.col("id").alias(id_col), "chunk_id", "content", "header", full(F.lit("full_content"), F.lit("semantic_section")).alias("section_type"), "start_line", "end_line",
        full(F.col("size"), F.length("content")).alias("content_length"), "start_page", "end_page", full(F.lit("1"), pages).alias("page_range"),
    )


_STOPS = (". ", "! ", "? ", ".\n", "!\n", "?\n")


def char_windows(text: str, size: int = 1200, overlap: int = 100) -> list[tuple[int, int, str]]:
    """(start, end, content) of windows every ``size - overlap`` characters, cut back to a sentence end or a word.

    A sentence end counts in the second half of a window's last 100 characters, a space in its last 50 beyond four fifths.
    Windows of 50 characters or less without their margins are left out. ``overlap`` must be below ``size``.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    out = []
    for start in range(0, len(text), size - overlap):
        end = min(start + size, len(text))
        body = text[start:end].strip()
        if len(body) <= 50:
            continue
        if end < len(text):
            tail = body[-100:]
            stop = max(tail.rfind(s) for s in _STOPS)
            space = body.rfind(" ", max(0, len(body) - 50))
            keep = len(body) - len(tail) + stop + 1 if stop > len(tail) / 2 else space if space > len(body) * 0.8 else None
            if keep is not None:
                body, end = body[:keep].strip(), start + keep
        out.append((start, end, body))
    return out


def char_chunks(docs: DataFrame, size: int = 1200, overlap: int = 100, id_col: str = "doc_id") -> DataFrame:
    """Character windows of every document: id, chunk_id, start_pos, end_pos, content, length, char_range ('1-1200')."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "chunk_id", "start_pos", "end_pos", "content", "length", "char_range"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"]):
                rows += [(key, i, a, b, c, len(c), f"{a + 1}-{b}") for i, (a, b, c) in enumerate(char_windows(text, size, overlap), 1)]
            yield pd.DataFrame(rows, columns=names)

    src = docs.select(F.col(id_col).alias("id"), "text").filter("text is not null")
    return src.mapInPandas(run, f"{id_col} {kind}, chunk_id int, start_pos int, end_pos int, content string, length int, char_range string")
