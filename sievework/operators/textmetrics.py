"""Completeness and fidelity of extracted entries against their documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.chunking import strip
from sievework.operators.entries import B

# Patterns of content types, with edges of ASCII words (where a word character is next to the edge anyway, one look decides).
CONTENT = {
    "dates": r"(?<!\w)\d{1,2}[/-]\d{1,2}[/-]\d{2,4}(?!\w)|(?<!\w)\w+ \d{4}(?!\w)",
    "percentages": r"\d+\.?\d*%",
    "phone_numbers": r"(?<!\w)\d{3}[-.]?\d{3}[-.]?\d{4}(?!\w)",
    "emails": rf"{B}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{{2,}}{B}",
    "numbers": r"(?<!\w)\d+(?!\w)",
    "urls": r"https?://[^\s]+",
}
#: A text without the sign has none of the kind, which is cheaper to see.
SIGNS = {"percentages": "%", "emails": "@", "urls": "http"}


def words(c: Column) -> Column:
    """Distinct words of three ASCII letters or more, bounded by other than ASCII letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?<!\w)[a-z]{3,}(?!\w)"), F.lit(0)))


def _occurrences(t: Column, kind: str) -> Column:
    n = F.regexp_count(t, F.lit(CONTENT[kind]))
    return F.when(F.contains(t, F.lit(SIGNS[kind])), n).otherwise(0) if kind in SIGNS else n


def content_counts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Characters, words, distinct words, occurrences of each content type, paragraphs, bullets and headings of each text.

    Null texts count as empty.
    """
    t = F.coalesce("text", F.lit(""))
    solid = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    return docs.select(
        id_col, F.length(t).alias("total_characters"), F.size(solid).alias("total_words"), F.size(words(t)).alias("unique_words"),
        *(_occurrences(t, n).alias(n) for n in CONTENT),
        F.size(F.filter(F.split(t, "\n\n"), lambda p: F.length(strip(p)) > 50)).alias("paragraphs"),
        F.regexp_count(t, F.lit(r"(?md)^[ \t]*[•\-*][ \t]+")).alias("bullet_points"), F.regexp_count(t, F.lit(r"(?md)^[A-Z][A-Z ]{5,}$")).alias("headings"),
    )


def coverage_band(share: Column) -> Column:
    return F.when(share < 0.3, "LOW").when(share < 0.6, "MODERATE").otherwise("GOOD")


def fidelity_band(share: Column) -> Column:
    return F.when(share >= 0.9, "EXCELLENT").when(share >= 0.75, "GOOD").when(share >= 0.5, "FAIR").otherwise("POOR")


def word_coverage(docs: DataFrame, said: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Share of each document's distinct words that its entries (``said``: id, text) hold; documents without words or entries
    have 0. Words meet as rows, so a document or an entry set of any size is spread over tasks.
    """
    own = docs.select(id_col, F.explode(words(F.col("text"))).alias("w")).distinct()
    got = said.select(F.col(id_col).alias("_i"), F.explode(words(F.col("text"))).alias("_w")).distinct()
    both = own.join(got, (F.col(id_col) == F.col("_i")) & (F.col("w") == F.col("_w")), "left")
    g = both.groupBy(id_col).agg(F.count("*").alias("document_words"), F.count("_w").alias("captured_words"))
    share = F.bround(F.coalesce(F.col("captured_words"), F.lit(0)) / F.col("document_words"), 6)
    out = docs.select(id_col).distinct().join(g, id_col, "left")
    out = out.select(id_col, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("document_words", "captured_words")), F.coalesce(share, F.lit(0.0)).alias("word_coverage"))
    return out.withColumn("band", coverage_band(F.col("word_coverage")))


def content_gaps(docs: DataFrame, said: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document and content type that it has: occurrences, those in its entries, rate and number lost (negative if the
    entries have more).
    """
    kinds = ", ".join(f"'{n}', {n}" for n in CONTENT)
    tall = lambda df: content_counts(df, id_col).select(id_col, F.expr(f"stack({len(CONTENT)}, {kinds}) as (content_type, n)"))
    got = tall(said).groupBy(F.col(id_col).alias("_i"), F.col("content_type").alias("_t")).agg(F.sum("n").alias("captured"))
    own = tall(docs).filter("n > 0")
    j = own.join(got, (F.col(id_col) == F.col("_i")) & (F.col("content_type") == F.col("_t")), "left").withColumn("captured", F.coalesce("captured", F.lit(0)))
    return j.select(id_col, "content_type", F.col("n").alias("in_document"), "captured", F.bround(F.col("captured") / F.col("n"), 6).alias("capture_rate"), (F.col("n") - F.col("captured")).alias("lost"))


def plain_text(c: Column) -> Column:
    """White space collapsed, signs outside a common set dropped, lower case; letters of any script stay."""
    t = F.regexp_replace(strip(c), r"[\s\p{Z}]+", " ")
    return F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}_ \-.,:;()\[\]/@#$%&*+=<>?!'\"]", ""))


def top_phrases(text: str, search: str, top: int = 3) -> list[tuple[int, int, float]]:
    """(position, length, similarity) of up to ``top`` runs of words of ``search`` that ``text`` holds, both in plain form: all of
    it, with similarity 1, or else the longest of two or more words' runs over three characters, each with its share of the
    length; ties in order of their words. A run that is not found is not made longer.
    """
    if not search:
        return []
    if search in text:
        return [(text.find(search), len(search), 1.0)]
    words, found = search.split(), []
    if len(words) < 2:
        return []
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            run = " ".join(words[i:j])
            at = text.find(run)
            if at < 0:
                break
            if len(run) > 3:
                found.append((at, len(run), len(run) / len(search)))
    return sorted(found, key=lambda x: -x[2])[:top]


_PHRASES = T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))


@F.pandas_udf(_PHRASES)
def _top_phrases(text: pd.Series, search: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("position", "length", "similarity"), x)) for x in top_phrases(t or "", s or "")] for t, s in zip(text, search)])


def phrase_matches(docs: DataFrame, said: DataFrame, id_col: str = "doc_id", key_col: str = "entry_id", context: int = 100) -> DataFrame:
    """Where the texts of ``said`` (id, key, text) stand in their documents: key, rank (1 to 3), similarity and context, the
    document's characters from ``context`` before to ``context`` behind the place, which is counted in its plain form.

    Texts of which nothing is found, and those of unknown documents, have no row.
    """
    t = docs.select(F.col(id_col).alias("_i"), F.coalesce("text", F.lit("")).alias("_raw"), plain_text(F.coalesce("text", F.lit(""))).alias("_t"))
    j = said.select(id_col, key_col, plain_text(F.coalesce("text", F.lit(""))).alias("_s"), F.length(F.coalesce("text", F.lit(""))).alias("_n")).join(t, F.col(id_col) == F.col("_i"))
    m = j.select(key_col, "_raw", "_n", F.posexplode(_top_phrases("_t", "_s")).alias("rank", "m"))
    start = F.greatest(F.lit(0), F.col("m.position") - context)
    end = F.col("m.position") + F.when(F.col("m.similarity") == 1.0, F.col("_n")).otherwise(F.col("m.length")) + context
    return m.select(key_col, (F.col("rank") + 1).alias("rank"), F.bround("m.similarity", 6).alias("similarity"), F.substring(F.col("_raw"), start + 1, F.greatest(F.lit(0), end - start)).alias("context"))


def phrase_found(text: Column, search: Column) -> Column:
    """Whether `top_phrases` finds any, by runs of up to three words: any longer run over three characters has one of these."""
    w = F.filter(F.split(search, " "), lambda x: x != "")
    n = F.size(w)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array())
    short = F.exists(F.concat(of(1), of(2), of(3)), lambda p: (F.length(p) > 3) & F.contains(text, p))
    return F.when(search == "", False).otherwise(F.contains(text, search) | ((n > 1) & short))


def fidelity(docs: DataFrame, entries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document with entries (id, entry_key, entry_value): entries of which key and value, one or neither are found in the
    text, the fidelity (found + half of half found) / all, and the share of the text's length the entries have, at most 1.

    Entries come to their document's text in one equi-join; a document with most entries is left to the skew join of adaptive
    execution. Phrases of a value are only looked for where the value as a whole is not found.
    """
    t = docs.select(F.col(id_col).alias("_i"), plain_text(F.coalesce("text", F.lit(""))).alias("_t"))
    e = entries.select(id_col, plain_text(F.coalesce("entry_key", F.lit(""))).alias("k"), plain_text(F.coalesce("entry_value", F.lit(""))).alias("v"))
    j = e.join(t, F.col(id_col) == F.col("_i")).withColumn("fk", phrase_found(F.col("_t"), F.col("k"))).withColumn("fv", phrase_found(F.col("_t"), F.col("v")))
    g = j.groupBy(id_col).agg(
        F.count("*").alias("total_entries"), F.count_if(F.col("fk") & F.col("fv")).alias("perfect_matches"), F.count_if(F.col("fk") != F.col("fv")).alias("partial_matches"),
        F.count_if(~F.col("fk") & ~F.col("fv")).alias("missing_entries"), F.sum(F.length("k") + F.length("v")).alias("_said"), F.max(F.length("_t")).alias("_len"),
    )
    score = F.bround((F.col("perfect_matches") + F.col("partial_matches") * 0.5) / F.col("total_entries"), 6)
    cover = F.bround(F.when(F.col("_len") > 0, F.least(F.lit(1.0), F.col("_said") / F.col("_len"))).otherwise(0.0), 6)
    return g.withColumn("fidelity", score).withColumn("coverage", cover).withColumn("band", fidelity_band(F.col("fidelity"))).drop("_said", "_len")
