"""Small scalar functions: labels, ids, sizes, kinds of errors, token overlap, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.operators.chunking import strip

UNITS = ["Bytes", "KB", "MB", "GB", "TB"]
# Words of a message by which a handler tells kinds of errors apart, in order, and those of an error's type name.
HANDLER_ERRORS = {
    "API": ["api", "openai", "rate limit", "429", "503", "502"],
    "NETWORK": ["connection", "network", "timeout", "dns"],
    "VALIDATION": ["validation", "invalid", "null", "none", "empty"],
    "DATA": ["json", "parse", "decode", "format", "unicode"],
    "PROCESSING": ["processing", "chunk", "deduplication", "normalization"],
}
SYSTEM_TYPES = ["memory", "system", "os", "io"]


def field_title(name: Column) -> Column:
    """A field's name without numbers of sessions and rooms and numbers at its edges, each word capitalised; '' for null."""
    s = F.regexp_replace(strip(F.coalesce(name, F.lit(""))), r"(?<![A-Za-z0-9_])\d+[A-Z]?(?![A-Za-z0-9_])", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^\d+\s*[-:.]?\s*", ""), r"\s*[-:.]\s*\d+$", "")
    return F.initcap(F.lower(F.regexp_replace(F.regexp_replace(s, r"[\s\p{Z}]+", " "), r"^[ \-:.,;]+|[ \-:.,;]+$", "")))


def file_size_label(size: Column) -> Column:
    """Bytes with the largest unit that leaves one or more of it, to two digits: '0 Bytes', '1.5 KB'."""
    power = F.least(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) / 10), F.lit(len(UNITS) - 1)).cast("int")
    number = F.regexp_replace(F.format_string("%.2f", F.bround(size / F.pow(F.lit(1024.0), power), 2)), r"\.?0+$", "")
    return F.when(size <= 0, F.lit("0 Bytes")).otherwise(F.concat(number, F.lit(" "), F.element_at(F.array(*map(F.lit, UNITS)), power + 1)))


def handler_error(message: Column, type_name: Column | None = None) -> Column:
    """The first kind of error one of whose words the message holds, else SYSTEM by the name of the error's type, else UNKNOWN;
    null without a message.
    """
    has = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    out = F.lit("UNKNOWN")
    if type_name is not None:
        out = F.when(F.coalesce(has(F.lower(type_name), SYSTEM_TYPES), F.lit(False)), "SYSTEM").otherwise(out)
    for kind, words in reversed(list(HANDLER_ERRORS.items())):
        out = F.when(has(F.lower(message), words), kind).otherwise(out)
    return F.when(message.isNotNull(), out)


def pretty_object(**fields: Column) -> Column:
    """A JSON object of string fields over several lines, indented by two spaces; null fields are null, letters stay as they are."""
    quoted = lambda c: F.coalesce(F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"^\[|\]$", ""), F.lit("null"))
    lines = [F.concat(F.lit(f'  "{name}": '), F.when(c.isNull(), "null").otherwise(quoted(c))) for name, c in fields.items()]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def made_id(prefix: str, *key: Column) -> Column:
    """``prefix_`` and 16 hexadecimal digits of a hash of ``key``, so that a run can be repeated."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\x1f", *key), 256), 1, 16))


def token_jaccard(a: Column, b: Column) -> Column:
    """Common over all distinct lower-case tokens; 0 where neither has any."""
    x, y = (F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda t: t != "") for c in (a, b))
    n = F.size(F.array_union(x, y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(0.0)


def extraction_prompt(header: Column, pages: Column, content: Column) -> Column:
    """A request to an extractor for one section, in this package's own words."""
    return F.concat(
        F.lit("List every fact of the section below as JSON: an object with \"entries\", each with \"Key\", \"Value\" and \"Comments\".\nSection: "),
        F.coalesce(header, F.lit("")), F.lit("\nPages: "), F.coalesce(pages, F.lit("")), F.lit("\n---\n"), F.coalesce(content, F.lit("")),
    )


def entry_errors(key: Column, value: Column) -> Column:
    """What is wrong with an entry, as an array of messages; empty if nothing is."""
    k, v = F.length(strip(key)), F.length(strip(value))
    checks = [F.when(key.isNull(), "key missing").when(k == 0, "key blank").when(k < 2, "key too short"), F.when(value.isNull(), "value missing").when(v == 0, "value blank")]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())
