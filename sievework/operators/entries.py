"""Key/value entries: validation, key normalization, signatures, exact deduplication, repair, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.text import is_placeholder
from sievework.operators.chunking import strip
from sievework.operators.skew import row_numbers

# An edge of a word of ASCII letters, digits and underscores, which does not depend on the dialect's idea of \b.
B = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
ORDINAL = r"\d+(st|nd|rd|th)"
# Words that make a number a place or a session, priorities of a profile's fields, kinds of errors.
PLACES = "session|meeting|room|track|hall|floor"
PRIORITIES = [
    ["full name", "name", "birthdate", "birth", "age", "blood", "nationality"],
    ["current company", "current position", "current salary", "current start"],
    ["previous company", "previous position", "previous salary", "previous start", "previous end", "previous joining", "previous starting"],
    ["first company", "first position", "first salary", "first job"],
    ["graduation", "cgpa", "degree", "college", "university", "school", "b-tech", "hi-tech", "class rank", "overall score", "thesis"],
    ["certification", "aws", "azure", "safe", "pmp", "project management"],
    ["proficiency", "skill", "python", "sql", "visualization", "cloud", "experience"],
]
ERRORS = {
    "rate_limit": ["rate limit", "429"],
    "timeout": ["timeout", "timed out"],
    "api_error": ["api", "openai"],
    "connection_error": ["connection", "network"],
    "data_error": ["invalid", "parse", "json"],
    "auth_error": ["auth", "key"],
}


def valid_entries(df: DataFrame, key: str = "entry_key", value: str = "entry_value") -> DataFrame:
    """Rows with a key of two characters or more and a value that is no placeholder, both without surrounding white space."""
    out = df.withColumn(key, strip(F.col(key))).withColumn(value, strip(F.col(value)))
    return out.filter((F.length(key) >= 2) & ~is_placeholder(F.col(value)))


def validation_counts(df: DataFrame, key: str = "entry_key", value: str = "entry_value") -> DataFrame:
    """One row: entries, short or missing keys, placeholder values, valid entries and their share (0 of none)."""
    bad_key = F.coalesce(F.length(strip(F.col(key))) < 2, F.lit(True))
    bad_value = is_placeholder(F.col(value))
    g = df.agg(F.count("*").alias("total"), F.count_if(bad_key).alias("bad_keys"), F.count_if(bad_value).alias("bad_values"), F.count_if(~bad_key & ~bad_value).alias("valid"))
    return g.select("*", F.bround(F.when(F.col("total") > 0, F.col("valid") / F.col("total")).otherwise(0.0), 6).alias("success_rate"))


def has_ordinal(key: Column) -> Column:
    """True for keys in which an ordinal has meaning (10th Grade, Year-3rd), false for rooms, sessions and the like."""
    k = F.lower(key)
    pattern = f"{B}{ORDINAL}(\\s+|[-_])\\w+{B}|{B}\\w+(\\s+|[-_]){ORDINAL}{B}"
    return F.coalesce(~F.regexp_like(k, F.lit(f"{B}({PLACES}){B}")) & F.regexp_like(k, F.lit(pattern)), F.lit(False))


def normalize_key(key: Column) -> Column:
    """A key in lower case without sessions, rooms, times, dates and numbers at its edges; with each word capitalised, and
    its ordinals kept, where these have meaning. What would be left empty comes back as it was, in lower case. Null is ''.
    """
    raw = strip(F.coalesce(key, F.lit("")))
    low = k = F.lower(raw)
    for p in (
        rf"{B}\d+(st|nd|rd|th)?\s*(session|room|track|hall){B}", rf"{B}(session|room|track|hall)\s*[a-z0-9]+{B}",
        rf"{B}\d{{1,2}}:\d{{2}}(\s*(am|pm))?{B}", rf"{B}\d{{1,2}}/\d{{1,2}}(/\d{{2,4}})?{B}",
    ):
        k = F.regexp_replace(k, p, "")
    keep = has_ordinal(k)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(k, f"{B}{ORDINAL}{B}", ""), r"^\d+\s*[-:.]?\s*", ""), r"\s*[-:.]\s*\d+$", "")
    tidy = lambda c: F.regexp_replace(strip(F.regexp_replace(c, r"[\s\p{Z}]+", " ")), r"^[ \-:.,;]+|[ \-:.,;]+$", "")
    # Every pattern asks for a digit or one of these words; most keys have neither.
    out = F.when(F.regexp_like(low, F.lit("[0-9]|session|room|track|hall")), F.when(keep, F.initcap(tidy(k))).otherwise(tidy(plain))).otherwise(tidy(low))
    return F.when(out == "", low).otherwise(out)


def signature(key: Column, value: Column) -> Column:
    """``key:value`` in lower case, of the value the first fifty characters; '' where both are empty."""
    k, v = F.lower(strip(F.coalesce(key, F.lit("")))), F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when((k == "") & (v == ""), "").otherwise(F.concat(k, F.lit(":"), F.substring(v, 1, 50)))


def cut_mark(value: Column) -> Column:
    return F.endswith(value, F.lit("...")) | F.endswith(value, F.lit("…"))


def entry_score(key: Column, value: Column, comments: Column) -> Column:
    """What an entry is worth among those of its key: comments, length, digits, no cut mark, a long key."""
    v = strip(F.coalesce(value, F.lit("")))
    return F.when(F.length(strip(F.coalesce(comments, F.lit("")))) > 0, 50).otherwise(0) + F.length(v) + F.when(F.regexp_like(v, F.lit("[0-9]")), 20).otherwise(0) + F.when(cut_mark(v), 0).otherwise(30) + F.length(strip(key)) / 2


def exact_key_dedup(df: DataFrame, group: str, order: str, key: str = "entry_key", value: str = "entry_value", comments: str = "comments", unique: bool = False) -> DataFrame:
    """One row per group and key (white space and case ignored): the best entry by `entry_score`, the first on a tie.

    Result: group, dedup_key, first_order (where the key was first seen), best_order (of the survivor), n and comments: all
    distinct comments of the key in order, joined with `` | ``. Rows of equal order are one (``unique``: there are none). Null keys count as ''.
    Maxima combine map-side; only distinct comments of a key are held together.
    """
    k = F.lower(strip(F.coalesce(F.col(key), F.lit(""))))
    rows = (df if unique else df.dropDuplicates([group, order])).withColumn("dedup_key", k)
    best = F.max(F.struct(entry_score(F.col(key), F.col(value), F.col(comments)).alias("score"), (-F.col(order)).alias("neg")))
    said = strip(F.coalesce(F.col(comments), F.lit("")))
    notes = rows.filter(F.length(said) > 0).groupBy(group, "dedup_key", said.alias("_c")).agg(F.min(order).alias("_o"))
    notes = notes.groupBy(F.col(group).alias("_g"), F.col("dedup_key").alias("_k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_c"))), lambda x: x["_c"]), " | ").alias("comments"))
    g = rows.groupBy(group, "dedup_key").agg(F.min(order).alias("first_order"), best.alias("b"), F.count("*").alias("n"))
    return g.join(notes, (F.col(group).eqNullSafe(F.col("_g"))) & (F.col("dedup_key") == F.col("_k")), "left").select(group, "dedup_key", "first_order", (-F.col("b.neg")).alias("best_order"), "n", "comments")


def repair_marked(df: DataFrame, group: str, order: str, key: str = "entry_key", value: str = "entry_value", unique: bool = False) -> DataFrame:
    """Values that end in dots, made whole by the first longer value of a like key in their group that begins the same.

    Keys are alike if they agree up to case and white space or one is within a third of the other's length in edits. Result:
    group, order and repaired value of each value that could be repaired. Candidates meet on group and the first eight
    characters of the stem, so no group is compared with itself as a whole; stems of less than eight characters only meet
    values with all their characters. ``unique``: no two rows have one order.
    """
    v, k = strip(F.coalesce(F.col(value), F.lit(""))), F.lower(strip(F.coalesce(F.col(key), F.lit(""))))
    rows = (df if unique else df.dropDuplicates([group, order])).select(F.col(group).alias("g"), F.col(order).alias("o"), k.alias("k"), v.alias("v"))
    marked = rows.filter(cut_mark(F.col("v")) & (F.length("v") > 3)).withColumn("stem", strip(F.regexp_replace("v", r"[.…]+$", ""))).filter(F.length("stem") > 0)
    marked = marked.withColumn("head", F.lower(F.substring("stem", 1, 8))).withColumn("w", F.length("head"))
    whole = rows.filter(~cut_mark(F.col("v"))).select(F.col("g").alias("g2"), F.col("o").alias("o2"), F.col("k").alias("k2"), F.col("v").alias("v2"))
    # Each value offers its first eight characters once; shorter heads only in groups with a stem of that length, which few have.
    short = marked.filter("w < 8").select(F.col("g").alias("g2"), F.col("w").alias("w2")).distinct()
    others = whole.withColumn("w2", F.lit(8)).unionByName(whole.join(short, "g2").select(*whole.columns, "w2"))
    others = others.withColumn("head2", F.lower(F.expr("substring(v2, 1, w2)"))).filter(F.length("head2") == F.col("w2"))
    hit = marked.join(others, (F.col("g") == F.col("g2")) & (F.col("w") == F.col("w2")) & (F.col("head") == F.col("head2")) & (F.col("o") != F.col("o2")))
    alike = F.levenshtein("k", "k2") <= 0.3 * F.greatest(F.length("k"), F.length("k2"))
    hit = hit.filter(F.startswith(F.lower("v2"), F.lower("stem")) & (F.length("v2") > F.length("stem")) & ~cut_mark(F.col("v2")) & alike)
    return hit.groupBy("g", "o").agg(F.min(F.struct("o2", "v2")).alias("b")).select(F.col("g").alias(group), F.col("o").alias(order), F.col("b.v2").alias("repaired"))


def logical_priority(key: Column) -> Column:
    """1 to 8: what part of a profile a key belongs to; the first list with a word found in the key counts."""
    k = F.lower(F.coalesce(key, F.lit("")))
    out = F.lit(len(PRIORITIES) + 1)
    for i, words in reversed(list(enumerate(PRIORITIES, 1))):
        has = F.lit(False)
        for w in words:
            has = has | F.contains(k, F.lit(w))
        out = F.when(has, i).otherwise(out)
    return out


def error_category(error: Column) -> Column:
    """The first kind of error one of whose words the message holds; null without a message."""
    e = F.lower(error)
    out = F.lit("unknown_error")
    for kind, words in reversed(list(ERRORS.items())):
        has = F.lit(False)
        for w in words:
            has = has | F.contains(e, F.lit(w))
        out = F.when(has, kind).otherwise(out)
    return F.when(error.isNotNull(), out)


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` with ``#``, the row's number within its group in the given order, from 1."""
    return df.withColumn("#", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def document_order(df: DataFrame, group: str, order: str, chunk: str = "chunk_id", spread: bool = False) -> DataFrame:
    """``final_position`` (chunk * 100,000 + index * 50 + 250, index from 0 over the group) and ``#`` in its order.

    A window sorts each group in one task, on disk if need be. ``spread`` numbers groups in stretches instead, for a group with a
    large share of all rows; it reads ``df`` four times, and ``order`` must be an integer then. Null chunks count as 0. With
    some 1,995 entries a group spills over into the next chunk's range, as the formula has it.
    """
    number = row_numbers if spread else lambda d, g, by, name, _=0: d.withColumn(name, F.row_number().over(Window.partitionBy(g).orderBy(*by)))
    rows = number(df, group, [order], "__row").withColumn("_i", F.col("__row") - 1).drop("__row")
    rows = rows.withColumn("final_position", F.coalesce(F.col(chunk), F.lit(0)) * 100_000 + F.floor((F.col("_i") / 10 + 0.5) * 500).cast("long"))
    return number(rows, group, ["final_position", "_i"], "#", 1_000_000).drop("_i")


def with_global_note(df: DataFrame, notes: DataFrame, group: str, order: str, comments: str = "comments", tag: bool = True) -> DataFrame:
    """``df`` whose first row of each group begins its comments with the group's ``note`` (tagged, if asked for)."""
    n = notes.select(F.col(group).alias("_g"), F.col("note").alias("_n"))
    first = F.row_number().over(Window.partitionBy(group).orderBy(order)) == 1
    said = F.concat(F.lit("[GLOBAL NOTE: "), F.col("_n"), F.lit("]")) if tag else F.col("_n")
    old = F.when(F.length(strip(F.coalesce(F.col(comments), F.lit("")))) > 0, F.col(comments))
    marked = df.withColumn("_first", first).join(n, F.col(group) == F.col("_g"), "left")
    return marked.withColumn(comments, F.when(F.col("_first") & F.col("_n").isNotNull(), F.concat_ws(" | ", said, old)).otherwise(F.col(comments))).drop("_first", "_g", "_n")


def context_ring(chunks: DataFrame, group: str, order: str, text: str, last: int = 5, chars: int = 500) -> DataFrame:
    """``context``: the first ``chars`` characters of the ``last`` chunks before each, in order; cut ones end in dots."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-last, -1)
    t = F.coalesce(F.col(text), F.lit(""))
    short = F.when(F.length(t) > chars, F.concat(F.substring(t, 1, chars), F.lit("..."))).otherwise(t)
    return chunks.withColumn("context", F.array_join(F.collect_list(short).over(w), "\n"))


def context_state(chunks: DataFrame, group: str, order: str, last: int = 5) -> DataFrame:
    """What an extractor's memory holds before each chunk: processed and failed chunks, messages (two a chunk, of at most ``last``),
    entries and their mean a processed chunk, and the share of processed ones in per cent, 0 before the first.

    ``chunks`` has status and entries_count (null counts as 0).
    """
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    sums = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    rows = chunks.select(
        group, order, sums(ok.cast("int")).alias("processed_chunks"), sums((~ok).cast("int")).alias("failed_chunks"), sums(F.when(ok, F.coalesce("entries_count", F.lit(0))).otherwise(0)).alias("total_entries"),
    )
    done, failed = F.col("processed_chunks"), F.col("failed_chunks")
    return rows.select(
        "*", (F.least(done, F.lit(last)) * 2).alias("context_messages"), F.bround(F.when(done > 0, F.col("total_entries") / done).otherwise(0.0), 1).alias("avg_entries_per_chunk"),
        F.bround(done * 100.0 / F.greatest(F.lit(1), done + failed), 1).cast("double").alias("success_rate"),
    )


def field_patterns(df: DataFrame, group: str, order: str, key: str = "entry_key") -> DataFrame:
    """Per group and key (case and margins ignored): the spelling seen first, which later entries are asked to keep, and uses."""
    rows = df.filter(F.length(strip(F.col(key))) > 0)
    g = rows.groupBy(group, F.lower(strip(F.col(key))).alias("name")).agg(F.min(F.struct(order, key)).alias("f"), F.count("*").alias("uses"))
    return g.select(group, "name", F.col(f"f.{key}").alias("spelling"), "uses")


def merged_synonyms(df: DataFrame, id_col: str, fields: str) -> DataFrame:
    """``df`` (id and ``fields``, a map) with the names of its map made one where they agree without case, spaces, ``_`` and ``-``:
    all become the smallest such name of the whole table. Of several in one map the first non-null value by name stays.

    Null and empty maps come back empty; ids must be unique, a null id is one too.
    """
    rows = df.select(id_col, F.explode(fields).alias("name", "v")).withColumn("_n", F.regexp_replace(F.lower("name"), r"[ _-]", ""))
    best = rows.groupBy("_n").agg(F.min("name").alias("canonical"))
    one = rows.join(best, "_n").groupBy(id_col, "canonical").agg(F.min(F.struct(F.col("v").isNull().alias("none"), "name", "v")).alias("x"))
    maps = one.groupBy(F.col(id_col).alias("_i")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("canonical", F.col("x.v").alias("v"))))).alias("_m"))
    kind = df.schema[fields].dataType
    return df.select(id_col).join(maps, F.col(id_col).eqNullSafe(F.col("_i")), "left").select(id_col, F.coalesce("_m", F.map_from_arrays(F.array(), F.array()).cast(kind)).alias(fields))


def visible_columns(df: DataFrame, *names: str) -> DataFrame:
    """One row: for each column whether any row has a non-blank value in it."""
    return df.agg(*(F.coalesce(F.bool_or(F.length(strip(F.col(n).cast("string"))) > 0), F.lit(False)).alias(n) for n in names))
