"""Cutting oversized texts at the strongest natural boundary each permissible window holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Strength of a cut after a character. A paragraph end is strongest, a place inside a word weakest.
PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE, INSIDE, NEVER = 6, 5, 4, 3, 2, 1, 0


def boundary_strengths(text: str) -> np.ndarray:
    """``s[i]`` for i in 0..len: the strength of a cut between characters i-1 and i. Whole text, one pass of array operations."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    s = np.full(n + 1, INSIDE, np.uint8)
    if n == 0:
        return s
    small = np.minimum(c, 0xFFFF)
    space = _SPACE[small]
    after = np.zeros(n + 1, bool)  # the next character is white space, or there is none
    after[n], after[:n] = True, space
    prev = np.zeros(n + 1, np.uint32)
    prev[1:] = c
    s[1:][space] = SPACE
    ends = np.isin(prev, _ENDS)
    s[np.isin(prev, _CLAUSES) & after] = CLAUSE
    s[ends & after] = SENTENCE
    # A cut after the white space that follows a sentence or clause is as good, and keeps the space with what it ends.
    gap = np.zeros(n + 1, bool)
    gap[1:] = space
    two = np.zeros(n + 1, np.uint8)
    two[1:] = s[:-1]
    for level in (SENTENCE, CLAUSE):
        s[gap & (two == level)] = level
    s[1:][c == 10] = LINE
    pair = np.zeros(n + 1, bool)
    pair[2:] = (c[1:] == 10) & (c[:-1] == 10)
    crlf = np.zeros(n + 1, bool)
    crlf[4:] = (c[3:] == 10) & (c[2:-1] == 13) & (c[1:-2] == 10) & (c[:-3] == 13) if n > 3 else False
    s[pair | crlf] = PARAGRAPH
    # Never between carriage return and line feed, nor before a combining mark or joiner.
    s[1:n][(c[:-1] == 13) & (c[1:] == 10)] = NEVER
    s[:n][_MARK[small]] = NEVER
    return s


def _tables() -> tuple[np.ndarray, np.ndarray]:
    import unicodedata

    space, mark = np.zeros(0x10000, bool), np.zeros(0x10000, bool)
    for i in range(0x10000):
        ch = chr(i)
        space[i] = ch.isspace()
        mark[i] = unicodedata.combining(ch) != 0 or i in (0x200D, 0xFE0E, 0xFE0F)
    return space, mark


_SPACE, _MARK = _tables()
_ENDS = np.array([ord(x) for x in ".!?…。！？"], np.uint32)
_CLAUSES = np.array([ord(x) for x in ",;:)、，；："], np.uint32)


class RangeMax:
    """Sparse table over boundary strengths: the strongest cut of a window, the rightmost one on a tie, in two look-ups. It has
    the levels that windows of at most ``width`` cuts call for, however long the text.
    """

    def __init__(self, strengths: np.ndarray, width: int | None = None):
        key = (strengths.astype(np.int64) << 40) | np.arange(len(strengths), dtype=np.int64)
        self.levels = [key]
        while 2 << (len(self.levels) - 1) <= min(len(key), width or len(key)):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.maximum(last[:-half], last[half:]))

    def best(self, lo: int, hi: int) -> int:
        """The cut in lo..hi (both included)."""
        k = (hi - lo + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[lo], level[hi - (1 << k) + 1])) & ((1 << 40) - 1)


def split_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most ``size`` characters that cover ``text``; each next one starts exactly ``overlap`` characters back.

    A piece is cut at the strongest boundary in the last half of its permissible length. Texts within ``size`` come out as
    one span. ``size`` below 1 raises ValueError; an ``overlap`` that is negative or not below ``size`` counts as 0.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    overlap = overlap if 0 <= overlap < size else 0
    n = len(text)
    if n <= size:
        return [(0, n)]
    index, start, out = RangeMax(boundary_strengths(text), size), 0, []
    while n - start > size:
        low = start + max((size + 1) // 2, overlap + 1)
        cut = index.best(min(low, start + size), start + size)
        out.append((start, cut))
        start = cut - overlap
    out.append((start, n))
    return out


PIECE_SCHEMA = "session_id string, chunk_id int, piece_id int, n_pieces int, header string, page_range string, whole string, start_char int, end_char int, piece string"


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            spans = split_spans(r.content, int(r.size), int(r.overlap))
            rows += [(r.session_id, r.chunk_id, i, len(spans), r.header, r.page_range, r.whole, a, b, r.content[a:b]) for i, (a, b) in enumerate(spans, 1)]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in PIECE_SCHEMA.split(", ")]).astype({"chunk_id": "Int32"})


def limits(sessions: DataFrame) -> DataFrame:
    """session_id, size and overlap of each session with a positive chunk_size: the largest, with the overlap of such a row."""
    lim = sessions.filter("session_id is not null and chunk_size > 0").groupBy("session_id").agg(F.max(F.struct("chunk_size", F.coalesce("chunk_overlap", F.lit(0)).alias("o"))).alias("l"))
    return lim.select("session_id", F.col("l.chunk_size").alias("size"), F.col("l.o").alias("overlap"))


def split_oversized(chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Pieces of every chunk that is longer than its session's limit, with header, page range and a hash of the whole chunk kept.

    ``chunks``: session_id, chunk_id, header, page_range, content. ``sessions``: session_id, chunk_size, chunk_overlap, several
    rows of a session allowed (its largest size with the overlap of such a row, the larger one on a tie, holds).
    Equal chunk rows are one chunk; of chunks that share session and id but differ, each is split. Null contents, contents
    within the limit, and sessions unknown, null or with a null or non-positive chunk_size give no pieces. Overlaps that are
    null, negative or not below the size count as 0. Lengths are Unicode code points. Extra columns are ignored.
    """
    # Only the oversized go on to the distinct and to Python, so texts cross one shuffle.
    big = chunks.select("session_id", "chunk_id", "header", "page_range", "content").join(limits(sessions), "session_id").filter(F.length("content") > F.col("size"))
    return big.distinct().withColumn("whole", F.md5("content")).mapInPandas(_pieces, PIECE_SCHEMA)
