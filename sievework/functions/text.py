"""Text forms shared by many operators, as JVM expressions.

Word characters are letters and digits of any script (``\\p{L}\\p{N}``). All forms of null are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = r"[\p{L}\p{N}]+"
NOT_RUN = r"[^\p{L}\p{N}]+"

# The words that stand for a missing value.
PLACEHOLDERS = ["null", "none", "n/a", "na", "nil", "undefined", "empty", "missing", "unknown", "blank"]


def strip(c: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def runs(c: Column) -> Column:
    """The lower-case runs of letters and digits, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(RUN), F.lit(0))


def bare(c: Column) -> Column:
    """Bare form: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), NOT_RUN, "")


# One anchored match: it fails at the first character of an ordinary value, whatever its length.
_PLACEHOLDER = "(?iU)^\\s*(?:" + "|".join(PLACEHOLDERS) + ")?\\s*$"


def is_placeholder(c: Column) -> Column:
    """True for null, blank and the words of ``PLACEHOLDERS`` in any letter case."""
    return c.isNull() | F.regexp_like(c, F.lit(_PLACEHOLDER))


def field_form(c: Column) -> Column:
    """The sorted ``name:value`` fields of a value that lists several, each in bare form; null for any other value.

    Fields are parted by semicolons, bars or line breaks; there must be two or more and each must have a name and a colon.
    """
    parts = F.filter(F.split(c, r"[;|\r\n]+"), lambda p: F.regexp_like(p, F.lit(r"(?U)\S")))
    ok = (F.size(parts) >= 2) & F.forall(parts, lambda p: F.regexp_like(p, F.lit(r"(?U)^[^:]*[^:\s][^:]*:")))
    one = lambda p: F.concat(bare(F.substring_index(p, ":", 1)), F.lit(":"), bare(F.substring(p, F.instr(p, ":") + 1, F.length(p))))
    # A value without a colon cannot be a list: the cheap test spares most rows the splitting.
    return F.when(F.contains(c, F.lit(":")) & ok, F.array_join(F.array_sort(F.transform(parts, one)), ";"))
