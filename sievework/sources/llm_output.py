"""Reading what an extractor returns: salvage of JSON in prose, entries of any shape, case of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "struct<Key:string,Value:string,Comments:string>"


def salvage(text: Column) -> Column:
    """The JSON object or array in a text: from the first brace or bracket to the last one that closes its kind; code fences
    are dropped. Null without any.
    """
    t = F.regexp_replace(text, r"```(json)?", "")
    o, a = F.instr(t, "{"), F.instr(t, "[")
    is_object = (o > 0) & ((a == 0) | (o < a))
    start = F.when(is_object, o).otherwise(a)
    rest = F.substring(t, start, F.length(t))
    last = lambda sign: F.length(rest) - F.instr(F.reverse(rest), sign) + 1
    end = F.when(is_object, F.when(F.contains(rest, F.lit("}")), last("}"))).otherwise(F.when(F.contains(rest, F.lit("]")), last("]")))
    return F.when(start > 0, F.substring(rest, F.lit(1), end))


def entries_of(json: Column) -> Column:
    """The entries of a salvaged text as an array of (Key, Value, Comments) with names in any letter case: those of an object
    with ``entries``, of a list, or the object itself. Null for what is no JSON.
    """
    # Names are folded before parsing, inside quotes and before a colon, so one schema reads all spellings.
    j = json
    for name in ("Key", "Value", "Comments"):
        j = F.regexp_replace(j, f'(?i)"{name}"\\s*:', f'"{name}":')
    j = F.regexp_replace(F.regexp_replace(j, r'(?i)"comment"\s*:', '"Comments":'), r'(?i)"entries"\s*:', '"entries":')
    listed = F.from_json(j, f"array<{ENTRY}>")
    wrapped = F.from_json(j, f"struct<entries:array<{ENTRY}>,global_notes:string>")
    single = F.from_json(j, ENTRY)
    return F.when(F.startswith(j, F.lit("[")), listed).when(wrapped["entries"].isNotNull(), wrapped["entries"]).when(single["Key"].isNotNull(), F.array(single))


def global_notes(json: Column) -> Column:
    return F.from_json(json, "struct<global_notes:string>")["global_notes"]


def unnested(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, Key, Value, Comments of every entry with a key and a value in each payload; payloads without JSON give none."""
    rows = df.select(id_col, F.posexplode(entries_of(salvage(F.col(text_col)))).alias("pos", "e"))
    clean = lambda c: F.regexp_replace(F.col(f"e.{c}"), r"(?U)^\s+|\s+$", "").alias(c)
    return rows.select(id_col, "pos", clean("Key"), clean("Value"), clean("Comments")).filter("Key <> '' and Value <> ''")
