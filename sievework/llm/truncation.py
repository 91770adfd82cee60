"""Values that were cut off: aligned with a longer copy, marked, ending inside a known word, or ending where no text ends."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sievework.functions.text import is_placeholder
from sievework.llm.bagminhash import mix
from sievework.llm.vectext import Tokens, bare_hashes, is_alnum, tokenize
from sievework.session import written

SHINGLE, BANDS = 5, 2
ORDERS = (6, 4, 3, 1)  # tokens of an ending's context, longest first
#: Vocabulary: words that occur in at least this share of records; at most (words a record) / share can.
VOCABULARY = 1e-4
#: Words with so many occurrences per record are the frame of sentences and stand for themselves in a context, all others for
#: their class.
FRAME = 0.025
#: Words a value must have to be judged by its last word (one word alone is a name or code), to be aligned with a copy or judged
#: by its ending, and to be counted among the texts whose words and endings are known. Shorter ones are met by their openings.
#: A mark tells at any length.
LEAST, ALIGNED, MIN_RUNS = 2, 4, 6
#: A bucket of more rows is not compared pair by pair (see `_hot_pairs`); which pairs are found does not depend on it.
HOT = 1000
SEEN, TERMINALITY = 20, 0.1
#: A last word alone, its context unseen, must end texts even more rarely.
TERMINALITY_OF_ONE = 0.02

# Marks left at a cut, a decoy that closes a finished text, and closing signs; all at a value's end.
_MARK = re.compile(r"(\.\.\.|…|\[\s*…?\s*(\.\.\.)?\s*\]|[^\W\d_]-|\(cont[a-z.']*\)?)\s*$")
_NOT_A_MARK = re.compile(r"\betc\s*(\.+|…)\s*$", re.IGNORECASE)
_CLOSED = re.compile(r"[.!?:;)\]\"'»”’。！？][^\w]*$")
_TAIL = 40
_STOPS = np.array([ord(x) for x in ".!?"], np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)
_CUTS = ".!?;|\n"
_PLACES = 20  # bits of a word's hash by which known words are looked up
_GAPS = np.zeros(256, np.uint8)
for _kind, _signs in ((1, ","), (2, ":"), (3, _CUTS)):
    _GAPS[[ord(x) for x in _signs]] = _kind


def state_of(value: str) -> str:
    """``marked`` if a sign of a cut was left, ``closed`` if the value ends with a closing sign, otherwise ``open``."""
    if value[-1:] in ".!?" and value[-2:-1].isalnum() and "(" not in value[-12:]:
        return "closed"  # as most values are; the patterns below say the same
    tail = value[-_TAIL:]
    if _MARK.search(tail) and not _NOT_A_MARK.search(tail):
        return "marked"
    return "closed" if _CLOSED.search(tail) else "open"


def _states(values: list[str], tok: Tokens) -> np.ndarray:
    """`state_of` of each text, of most by its last two characters: one that ends with a letter or digit is open, one with a stop
    behind a letter or digit closed, unless a bracket near its end may begin a mark.
    """
    end, size = tok.stops - 1, tok.stops - 1 - tok.starts
    at = lambda i: tok.codes[np.maximum(end - i, tok.starts)]
    bracket = np.concatenate([[0], np.cumsum(tok.codes == 40)])
    plain = (size >= 2) & (bracket[end] == bracket[np.maximum(end - 3 * _TAIL, tok.starts)])
    last = at(1)
    is_open, is_closed = plain & is_alnum(last), plain & is_alnum(at(2)) & np.isin(last, _STOPS)
    out = np.where(is_open, "open", "closed").astype("<U6")
    for i in np.flatnonzero(~is_open & ~is_closed).tolist():
        out[i] = state_of(values[i])
    return out


def _values(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """id and value of each record that has a value; how many words it has is seen where texts are read."""
    src = df.select(F.col(id_col).alias("id"), F.col(value_col).alias("value"))
    return src.filter(~is_placeholder(F.col("value")))


def _judged(rb: pa.RecordBatch, least: int) -> tuple[pa.RecordBatch, Tokens]:
    """The rows of a batch with ``least`` words or more, and their tokens."""
    tok = tokenize(rb.column("value").to_pylist())
    keep = np.diff(tok.first()) >= least
    if keep.all():
        return rb, tok
    return rb.filter(pa.array(keep)), tok.only(keep)


def _keys(tok: Tokens, is_open: np.ndarray) -> np.ndarray:
    """One integer a text: 63 bits of a hash of its bare form, then one that says it is open."""
    return ((bare_hashes(tok) & ~np.uint64(1)) | is_open.astype(np.uint64)).view(np.int64)


# --- near-copies -----------------------------------------------------------------------------------------------------------


def _shingle_buckets(tok: Tokens, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of the smallest hashed five-word shingles of each text: over the whole text, and over its first 2, 6, 18 and so
    on, of each ``bands``. A cut text is the beginning of its longer copy, so among as many first shingles of both they agree
    however much longer the copy is. Texts of fewer than five words have none.
    """
    first = tok.first()
    n = np.maximum(np.diff(first) - SHINGLE + 1, 0)
    roll = tok.hash.copy()
    for i in range(1, SHINGLE):
        nxt = np.zeros_like(roll)
        nxt[:-i] = tok.hash[i:]
        roll = mix(roll * _P + nxt)
    own = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    roll = roll[np.repeat(first[:-1], n) + nth]
    buckets, texts, level = [], [], 2
    limits = [0]  # the whole text
    while level <= n.max(initial=0):
        limits.append(level)
        level *= 3
    for limit in limits:
        at = np.flatnonzero(n >= max(limit, 1))
        use = (nth < limit) & (n >= limit)[own] if limit else np.ones(len(own), bool)
        h = roll[use]
        edge = np.cumsum(np.minimum(n[at], limit) if limit else n[at])
        edge = np.concatenate([[0], edge[:-1]])
        for b in range(bands if len(at) else 0):
            seed = mix(np.full(1, b + 1 + 64 * limit, np.uint64))
            buckets.append(mix(np.minimum.reduceat(h * (seed | np.uint64(1)), edge) ^ seed))
            texts.append(at)
    none = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    return np.concatenate(buckets or none[0]).view(np.int64), np.concatenate(texts or none[1])


def _openings(tok: Tokens, key: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, key, number of words and text of the openings of ALIGNED to MIN_RUNS - 1 words: an open text of so many words, too short for a
    shingle of complete words, meets longer ones by its complete words and the first letter of its last. Of longer texts that
    go on alike one stands for all, under a key of its opening that no text is cut by.
    """
    first = tok.first()
    n = np.diff(first)
    stops = np.concatenate([[0], np.cumsum(_GAPS[np.minimum(tok.codes, len(_GAPS) - 1)] == 3)])
    buckets, keys, words, texts = [], [], [], []
    for size in range(ALIGNED, MIN_RUNS):
        at = np.flatnonzero(use & (n >= size))
        h = np.full(len(at), size, np.uint64)
        for i in range(size - 1):
            h = mix(h * _P + tok.hash[first[at] + i])
        last = first[at] + size - 1
        longer = n[at] > size
        stop = longer & (stops[np.append(tok.begin, len(tok.codes))[last + 1]] > stops[tok.end[last]])
        goes_on = mix(mix(h * _P + tok.hash[last]) + stop.astype(np.uint64)) & ~np.uint64(1)
        buckets.append(mix(h * _P + tok.codes[tok.begin[last]].astype(np.uint64)))
        # The text's own key where it may be the cut one or has no word more; else that of its opening.
        keys.append(np.where(longer, goes_on.view(np.int64), key[at]))
        words.append(n[at])
        texts.append(at)
    return np.concatenate(buckets).view(np.int64), np.concatenate(keys), np.concatenate(words), np.concatenate(texts)


def _held(tok: Tokens) -> np.ndarray:
    """64 bits of each text, one or more of them for its words."""
    first = tok.first()
    out = np.zeros(len(first) - 1, np.uint64)
    full = np.diff(first) > 0
    if full.any():
        out[full] = np.bitwise_or.reduceat(np.uint64(1) << (tok.hash >> np.uint64(58)), first[:-1][full])
    return out.view(np.int64)


def _tails(tok: Tokens) -> np.ndarray:
    """The bits of each text's last three words before its last one, in 18 bits; 0 for shorter texts."""
    first = tok.first()
    bit = (tok.hash >> np.uint64(58)).astype(np.int32)
    out = np.zeros(len(first) - 1, np.int32)
    at = np.flatnonzero(np.diff(first) >= 4)
    last = first[1:][at] - 1
    out[at] = (bit[last - 3] << 12) | (bit[last - 2] << 6) | bit[last - 1]
    return out


_MEETING = ["bucket", "key", "words", "held", "tail", "id"]


def _band_rows(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        opened: set[tuple[int, int]] = set()
        for whole in batches:
            rb, tok = _judged(whole, ALIGNED)
            state = _states(rb.column("value").to_pylist(), tok)
            key = _keys(tok, state == "open")
            # Copies combine here: a text that a task has seen gives no more rows. Forgotten at a bound, as copies do no harm.
            new = np.zeros(len(key), bool)
            for i in np.unique(key, return_index=True)[1]:
                k = int(key[i])
                new[i] = state[i] != "marked" and k not in seen
                seen.add(k)
            if len(seen) > 1_000_000:
                seen.clear()
            if not new.any():
                continue
            bucket, own, words, at = _openings(tok, key, new)
            once = [i for i, x in enumerate(zip(bucket.tolist(), own.tolist())) if x not in opened and not opened.add(x)]
            if len(opened) > 1_000_000:
                opened.clear()
            # What goes on is stood for by one text, so it is not asked for its other words.
            held, tail = np.full(len(once), -1, np.int64), _tails(tok)[at[once]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (bucket[once], own[once], words[once].astype(np.int32), held, tail)), rb.column("id").take(pa.array(at[once]))], _MEETING)
            new &= np.diff(tok.first()) >= MIN_RUNS
            if not new.any():
                continue
            bucket, at = _shingle_buckets(tok, bands)
            bucket, at = bucket[new[at]], at[new[at]]
            n = np.diff(tok.first()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *(pa.array(x[at]) for x in (key, n, _held(tok), _tails(tok))), rb.column("id").take(pa.array(at))], _MEETING)

    return run


def _meet(bucket: np.ndarray, key: np.ndarray, words: np.ndarray, held: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each open text with each longer one of its bucket that may hold its last three complete words; rows come sorted by bucket."""
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    size = np.diff(np.append(edge, len(bucket)))
    start, size = np.repeat(edge, size), np.repeat(size, size)
    one, two, three = (np.uint64(1) << ((tail >> shift) & 63).astype(np.uint64) for shift in (0, 6, 12))
    need = one | two | three
    open_ = np.flatnonzero(((key & 1) == 1) & (size > 1))
    found = [(np.zeros(0, np.int64),) * 2]
    part = np.cumsum(size[open_]) // 1_000_000
    for i in range(int(part[-1]) + 1 if len(part) else 0):
        own = open_[part == i]
        n = size[own]
        a = np.repeat(own, n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[own], n)
        # The last word of a cut text may be half of one, so an equal number of words is enough.
        ok = (words[b] >= words[a]) & ((key[a] >> 1) != (key[b] >> 1)) & ((need[a] & ~held.view(np.uint64)[b]) == 0)
        found.append((a[ok], b[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _bucket_pairs(hot: int, least: int = 100_000):
    """Pairs of each bucket; of a bucket of more than ``hot`` rows its rows instead (with the bucket and no ``full_id``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        flowing = None  # the hot bucket whose rows are passed on as they come

        def read(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal flowing
            t = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            cols = [t.column(c).to_numpy() for c in _MEETING[:5]]
            ids = t.column("id").combine_chunks()
            if not len(cols[0]):
                return
            edge = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
            size = np.diff(np.append(edge, len(cols[0])))
            large = (size > hot) | (cols[0][edge] == flowing)
            done = len(cols[0]) if final or large[-1] else int(edge[-1])  # the last bucket may go on in the next batch
            flowing = cols[0][-1] if large[-1] else None
            wide = np.repeat(large, size)[:done]
            if wide.any():
                at = np.flatnonzero(wide)
                own = ids.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(cols[1][at]), own, pa.nulls(len(at), own.type), pa.array(cols[0][at])], ["cut", "cut_id", "full_id", "bucket"])
            # A text comes once for each task that has read it. Keys are put in order here, as a sort by one number alone costs the JVM much less.
            plain = np.flatnonzero(~wide)
            plain = plain[np.lexsort((cols[1][plain], cols[0][plain]))]
            new = np.append(True, (cols[0][plain][1:] != cols[0][plain][:-1]) | (cols[1][plain][1:] != cols[1][plain][:-1])) if len(plain) else np.zeros(0, bool)
            plain = plain[new]
            a, b = _meet(*(x[plain] for x in cols))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(cols[1][plain[a]]), ids.take(pa.array(plain[a])), ids.take(pa.array(plain[b])), pa.nulls(len(a), pa.int64())], ["cut", "cut_id", "full_id", "bucket"])
            if done < len(cols[0]):
                waiting.extend(t.slice(done).to_batches())

        rows = 0
        for rb in batches:
            waiting.append(rb)
            rows += rb.num_rows
            if rows >= least and rb.num_rows:
                yield from read(False)
                rows = sum(x.num_rows for x in waiting)
        if waiting:
            yield from read(True)

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every place at which a text could continue a cut one: three words, a hash of the words up to them, the next word and
    whether a sentence ends behind it. ``tail`` marks an open text's own last three complete words.
    """
    for rb in batches:
        tok = tokenize(rb.column("value").to_pylist())
        first, n = tok.first(), len(tok.hash)
        if n < 4:
            continue
        three = mix(mix(tok.hash[:-3] * _P + tok.hash[1:-2]) * _P + tok.hash[2:-1])
        run = np.cumsum(mix(tok.hash))
        head = run[2:-1] - np.concatenate([[np.uint64(0)], run])[first[tok.text[:-3]]]
        at = np.flatnonzero(tok.text[:-3] == tok.text[3:])
        kind = _GAPS[np.minimum(tok.codes, len(_GAPS) - 1)] == 3
        stops = np.concatenate([[0], np.cumsum(kind)])
        nxt = np.append(tok.begin[1:], len(tok.codes))
        stop = stops[nxt[at + 3]] > stops[tok.end[at + 3]]
        text = pa.array(tok.text[at])
        tail = (at + 4 == first[tok.text[at] + 1]) & (rb.column("key").to_numpy()[tok.text[at]] & 1).astype(bool)
        col = lambda x: pa.array(x.view(np.int64))
        size = pa.array((first[tok.text[at] + 1] - first[tok.text[at]]).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [rb.column("bucket").take(text), col(three[at]), col(head[at]), col(tok.hash[at + 3]), pa.array(stop), pa.array(tail), size, rb.column("key").take(text), rb.column("id").take(text)],
            ["bucket", "three", "head", "next", "stop", "tail", "size", "key", "id"],
        )


def _hot_pairs(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Pairs out of hot buckets, without comparing all texts of one: an alignment rests on the last three complete words of the
    cut text, so it meets only texts that hold these, and of texts that are alike up to there one stands for all.
    """
    kind = values.schema["id"].dataType.simpleString()
    texts = rows.join(values, rows["cut_id"] == values["id"]).select("bucket", F.col("cut").alias("key"), "id", "value")
    places = texts.mapInArrow(_places, f"bucket long, three long, head long, next long, stop boolean, tail boolean, size long, key long, id {kind}")
    full = places.groupBy("bucket", "three", "head", "next", "stop").agg(F.max(F.struct("size", "id")).alias("f"))
    open_ = places.filter("tail").select("bucket", "three", F.col("key").alias("cut"), F.col("id").alias("cut_id"), F.col("next").alias("last"), "size")
    # The same last word and a sentence end behind it is no cut; all else is looked at.
    met = open_.join(full, ["bucket", "three"]).filter((F.col("next") != F.col("last")) | ~F.col("stop")).filter(F.col("f.size") >= F.col("size"))
    return met.select("cut", "cut_id", F.col("f.id").alias("full_id"))


_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=4096)
def _words(text: str) -> tuple[list[str], set[str]]:
    """The lower-case words of a text, in order and as a set; copies of one text come one after the other."""
    words = _WORD.findall(text.lower())
    return words, set(words)


def ends_early(cut: str, full: str, similarity: float = 0.8) -> bool:
    """True if ``full`` goes on, inside a sentence, where an alignment of ``cut`` with it ends.

    The heads must share ``similarity`` of their words; the last complete words of ``cut`` must stand together in ``full``
    with more behind them that continues the last word of ``cut``.
    """
    (a, _), (b, held) = _words(cut), _words(full)
    if len(a) < 4 or len(b) < len(a):
        return False
    one, two, three, part = a[-4:]
    if three not in held or two not in held or one not in held:
        return False
    words = set(a[:-1])
    for at in range(len(b) - 3):
        if b[at + 2] != three or b[at + 1] != two or b[at] != one or not b[at + 3].startswith(part):
            continue
        head = set(b[: at + 3])
        if len(words & head) < similarity * max(len(words), len(head)):
            continue
        if b[at + 3] != part:
            return True  # inside a word
        # A whole word last: early only if the longer copy's sentence goes on behind it.
        if at + 4 < len(b) and not _sentence_ends_after(full, at + 3):
            return True
    return False


def _sentence_ends_after(text: str, i: int) -> bool:
    """True if the gap behind word ``i`` of ``text`` ends a sentence or a line."""
    spans = list(_WORD.finditer(text.lower()))
    gap = text[spans[i].end() : spans[i + 1].start()] if i + 1 < len(spans) else "."
    return any(x in gap for x in _CUTS)


def _next_words(tok: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Of each three words with a fourth behind them in their text, the text and a hash that tells of the fourth its first letter alone."""
    if len(tok.hash) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    three = mix(mix(tok.hash[:-3] * _P + tok.hash[1:-2]) * _P + tok.hash[2:-1])
    at = np.flatnonzero(tok.text[:-3] == tok.text[3:])
    return tok.text[at], mix(three[at] * _P + tok.codes[tok.begin[at + 3]].astype(np.uint64))


def _may_end_early(cuts: list[str], fulls: list[str]) -> np.ndarray:
    """Which pairs `ends_early` can hold for: somewhere in the longer text the cut one's last three complete words stand together,
    before a word of the same first letter as its last.
    """
    (cuts, nth), (fulls, mth) = _different(cuts), _different(fulls)
    text, own = _next_words(tokenize(cuts))
    last = np.flatnonzero(np.append(text[1:] != text[:-1], True)[: len(text)])
    need, has = np.zeros(len(cuts), np.uint64), np.zeros(len(cuts), bool)
    need[text[last]], has[text[last]] = own[last], True
    text, held = _next_words(tokenize(fulls))
    # Each pair with all places of its longer text.
    first = np.searchsorted(text, np.arange(len(fulls) + 1))
    n = np.diff(first)[mth]
    pair = np.repeat(np.arange(len(nth)), n)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[mth], n)
    out = np.zeros(len(nth), bool)
    out[pair[held[at] == need[nth][pair]]] = True
    return out & has[nth]


def _different(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The different ones of ``texts``, and which of them each is."""
    place: dict[str, int] = {}
    nth = np.array([place.setdefault(t, len(place)) for t in texts], np.int64)
    return list(place), nth


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        c, a, b = (rb.column(x).to_pylist() for x in ("cut", "cut_value", "full_value"))
        hit = [c[i] for i in np.flatnonzero(_may_end_early(a, b)).tolist() if ends_early(a[i], b[i])]
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64())], ["key"])


def aligned(values: DataFrame, bands: int = BANDS, hot: int = HOT) -> DataFrame:
    """``key`` of the open values that end early against a longer near-copy, each once."""
    kind = values.schema["id"].dataType.simpleString()
    rows = values.mapInArrow(_band_rows(bands), f"bucket long, key long, words int, held long, tail int, id {kind}")
    found = written(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_pairs(hot), f"cut long, cut_id {kind}, full_id {kind}, bucket long"))
    pairs = found.filter("bucket is null").select("cut", "cut_id", "full_id")
    hot_rows = found.filter("bucket is not null")
    if hot_rows.limit(1).count():
        pairs = pairs.unionByName(_hot_pairs(hot_rows, values))
    pairs = pairs.groupBy("cut", "full_id").agg(F.min("cut_id").alias("cut_id"))
    text = lambda name: values.select(F.col("id").alias(f"{name}_id"), F.col("value").alias(f"{name}_value"))
    # Many texts are finished in a way that shows at once (see `state_of`), so they need not be moved to be met as cut ones.
    finished = F.regexp_like(F.substring("cut_value", -2, 2), F.lit(r"^[A-Za-z0-9][.!?]\z")) & ~F.contains("cut_value", F.lit("("))
    both = pairs.join(text("cut").filter(~finished), "cut_id").join(text("full"), "full_id")
    return both.select("cut", "cut_value", "full_value").mapInArrow(_align, "key long").distinct()


# --- terminality -----------------------------------------------------------------------------------------------------------


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with the number of their occurrences that are followed by something, summed up per task; '' counts records."""
    words: dict[int, str] = {}
    held, records = [], 0

    def sum_up() -> pa.RecordBatch:
        x = np.concatenate(held, axis=1)
        at, key = pd.factorize(x[0])
        n = np.bincount(at, x[1], len(key)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(["", *map(words.__getitem__, key.tolist())], pa.string()), pa.array(np.append(records, n))], ["word", "n"])

    for whole in batches:
        rb, tok = _judged(whole, MIN_RUNS)
        inner = np.flatnonzero((np.diff(tok.text, append=-1) == 0) & (tok.codes[tok.begin] > 57)) if len(tok.begin) else np.zeros(0, int)
        code, uniq = pd.factorize(tok.hash[inner].view(np.int64))
        at, n = np.zeros(len(uniq), np.int64), np.bincount(code, minlength=len(uniq))
        at[code[::-1]] = np.arange(len(code))[::-1]
        # A word is made a string once a task, as most come again with each batch.
        words.update((h, tok.string(i)) for h, i in zip(uniq.tolist(), inner[at].tolist()) if h not in words)
        held.append(np.vstack([uniq, n]))
        records += rb.num_rows
        if len(words) > 200_000 or len(held) > 400:
            yield sum_up()
            words.clear()
            held, records = [], 0
    if held:
        yield sum_up()


def vocabulary(values: DataFrame) -> tuple[dict[str, int], int]:
    """Counts of the words frequent enough (a bounded number, see VOCABULARY) and the number of records, over all records."""
    counts = values.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    size = counts.agg(F.max(F.when(F.col("word") == "", F.col("n"))).alias("size"))  # no filter, so that counts are made once
    rows = counts.join(F.broadcast(size)).filter(F.col("n") >= F.greatest(F.lit(5.0), VOCABULARY * F.col("size"))).collect()
    return {r.word: r.n for r in rows if r.word}, rows[0].size if rows else 0


class Endings:
    """Contexts of token ends: classes of the last tokens with the punctuation between them."""

    def __init__(self, vocab: dict[str, int], total: int):
        words = sorted(vocab)
        tok = tokenize(words)
        order = np.argsort(tok.hash)
        self.known = tok.hash[order]
        share = np.array([0 if w.isdigit() else vocab[w] / max(total, 1) for w in words])[order] if words else np.zeros(0)
        self.cls = np.where(share >= FRAME, self.known, np.uint64(1))
        self.places = np.zeros(1 << _PLACES, np.int32)
        self.places[(self.known >> np.uint64(64 - _PLACES)).astype(np.int64)[::-1]] = np.arange(len(self.known), dtype=np.int32)[::-1]
        self.crowded = np.flatnonzero(np.diff(self.known >> np.uint64(64 - _PLACES), prepend=np.uint64(0)) == 0) if len(self.known) else np.zeros(0, np.int64)
        beginnings = tokenize(sorted({w[:i] for w in words if w.isalpha() for i in range(1, len(w))})).hash
        self.beginnings = np.setdiff1d(beginnings, self.known)

    def places_of(self, hashes: np.ndarray) -> np.ndarray:
        """Where in ``known`` each word would be found: by the first bits of its hash, and by search for known words that share these."""
        at = self.places[hashes >> np.uint64(64 - _PLACES)]
        if len(self.crowded):
            other = self.known[self.crowded]
            i = np.minimum(np.searchsorted(other, hashes), len(other) - 1)
            at = np.where(other[i] == hashes, self.crowded[i], at)
        return at

    def partial(self, hashes: np.ndarray) -> np.ndarray:
        """True for words that known words of letters begin with and that are none themselves."""
        i = np.minimum(np.searchsorted(self.beginnings, hashes), max(len(self.beginnings) - 1, 0))
        return self.beginnings[i] == hashes if len(self.beginnings) else np.zeros(len(hashes), bool)

    def classes(self, tok: Tokens) -> np.ndarray:
        """Words of the frame are themselves, other known words one class, unknown ones another, numbers one per length."""
        n = len(tok.hash)
        if n == 0:
            return np.zeros(0, np.uint64)
        at = self.places_of(tok.hash)
        hit = self.known[at] == tok.hash if len(self.known) else np.zeros(n, bool)
        c = np.where(hit, self.cls[at] if len(self.known) else np.uint64(1), np.uint64(2))
        digit = (tok.codes[tok.begin] >= 48) & (tok.codes[tok.begin] <= 57)
        c = np.where(digit, np.uint64(10) + np.minimum(tok.end - tok.begin, 4).astype(np.uint64), c)
        # The punctuation before a token is part of it: none, comma, colon, or the start of a sentence or field.
        kind = _GAPS[np.minimum(tok.codes, len(_GAPS) - 1)]
        gap = np.zeros(n, np.uint64)
        gap[1:] = np.maximum.reduceat(kind, np.stack([tok.end[:-1], tok.begin[1:]], axis=1).ravel())[::2] if n > 1 else 0
        return mix(c * np.uint64(8) + gap)

    def all_contexts(self, tok: Tokens) -> list[np.ndarray]:
        """A hash of the last tokens at each token, for every order, longest first; before a text's first token is its beginning."""
        cls = self.classes(tok)
        back = np.arange(len(cls)) - tok.first()[tok.text]
        h, found = np.full(len(cls), 7, np.uint64), {}
        for i in range(max(ORDERS)):
            prev = np.zeros_like(cls)
            prev[i:] = cls[: len(cls) - i]
            prev[back < i] = 7
            h = mix(h * _P + prev)
            if i + 1 in ORDERS:
                found[i + 1] = h ^ np.uint64(i + 1)
        return [found[o] for o in ORDERS]

    def terminal(self, tok: Tokens) -> np.ndarray:
        """For each token: a sentence or field ends right behind it (a stop followed by space, or a separator)."""
        codes = tok.codes
        stop = _GAPS[np.minimum(codes, len(_GAPS) - 1)] == 3
        solid = np.zeros(len(codes), bool)
        solid[:-1] = ~(codes[1:] <= 32) & ~stop[1:]
        dot = (codes == 46) & solid  # a point inside a number or address
        mark = np.concatenate([[0], np.cumsum(stop & ~dot)])
        nxt = np.append(tok.begin[1:], len(codes))
        return mark[nxt] > mark[tok.end]


_READ = "ctx long, n long, ends long, id {}, key long, state string, partial boolean, ctxs array<bigint>"


def _read(vocab: dict[str, int], total: int, kind: pa.DataType):
    """One pass over all texts: the counts of their contexts, summed up per task, and what there is to judge of each open or
    marked one. Rows of the first kind have a context, rows of the second an id's state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Endings(vocab, total)
        held: list[np.ndarray] = []

        def rows(size: int, **cols) -> pa.RecordBatch:
            kinds = {"ctx": pa.int64(), "n": pa.int64(), "ends": pa.int64(), "id": kind, "key": pa.int64(), "state": pa.string(), "partial": pa.bool_(), "ctxs": pa.list_(pa.int64())}
            return pa.RecordBatch.from_arrays([cols.get(c, pa.nulls(size, t)) for c, t in kinds.items()], list(kinds))

        def sum_up() -> np.ndarray:
            x = np.concatenate(held, axis=1)
            at, key = pd.factorize(x[0])
            return np.vstack([key, np.bincount(at, x[1], len(key)).astype(np.int64), np.bincount(at, x[2], len(key)).astype(np.int64)])

        def counts() -> pa.RecordBatch:
            x = sum_up()
            held.clear()
            return rows(x.shape[1], ctx=pa.array(x[0]), n=pa.array(x[1]), ends=pa.array(x[2]))

        for whole in batches:
            rb, tok = _judged(whole, 1)
            if not rb.num_rows:
                continue
            end = e.terminal(tok)
            # A text's last token is only evidence where a stop closes it.
            n = np.diff(tok.first())
            use = ((np.diff(tok.text, append=-1) == 0) | _closed_last(tok)) & (n >= MIN_RUNS)[tok.text]
            ctx = e.all_contexts(tok)
            for c in ctx:
                at, key = pd.factorize(c[use].view(np.int64))
                held.append(np.vstack([key, np.bincount(at, minlength=len(key)), np.bincount(at[end[use]], minlength=len(key))]))
            if len(held) > 400:
                held[:] = [sum_up()]
                if held[0].shape[1] > 1_000_000:
                    yield counts()
            values = rb.column("value").to_pylist()
            state = _states(values, tok)
            # Of one word, a hyphen at its end is part of a code or grade, and nothing else tells.
            for i in np.flatnonzero((n < LEAST) & (state != "closed")):
                state[i] = "closed" if state[i] == "open" or values[i].rstrip().endswith("-") else "marked"
            pick = np.flatnonzero(state != "closed")
            last = (tok.first()[1:] - 1)[pick]
            partial = e.partial(tok.hash[last])
            far = (n[pick] >= ALIGNED).astype(np.uint64)  # of shorter values no ending is looked up
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(pick) * len(ctx) + 1, len(ctx), dtype=np.int32)), pa.array(np.stack([c[last] * far for c in ctx], axis=1).ravel().view(np.int64)))
            yield rows(len(pick), id=rb.column("id").take(pa.array(pick)), key=pa.array(_keys(tok, state == "open")[pick]), state=pa.array(state[pick].tolist(), pa.string()), partial=pa.array(partial, pa.bool_()), ctxs=lists)
        if held:
            yield counts()

    return run


def _closed_last(tok: Tokens) -> np.ndarray:
    """True for a text's last token with a full stop, question or exclamation mark behind it."""
    last = np.diff(tok.text, append=-1) != 0
    mark = np.concatenate([[0], np.cumsum((tok.codes == 33) | (tok.codes == 46) | (tok.codes == 63))])
    return last & (mark[tok.stops[tok.text]] > mark[tok.end])


def truncated(df: DataFrame, id_col: str = "entry_id", value_col: str = "entry_value") -> DataFrame:
    """``id`` and ``why`` of each record whose value was cut off; one row per id.

    ``why`` is ``mark`` (a sign of a cut was left), ``copy`` (a near-copy found through min-hash bands of five-word shingles
    goes on where this value ends), ``word`` (it ends inside a word of the corpus) or ``ending`` (texts of the corpus end
    behind such closing words in less than TERMINALITY of SEEN or more cases). The last two only judge values without a copy
    and without a closing sign. Vocabulary and endings are counted over all records, however many.
    Null, blank and placeholder values are never cut, single words only if marked, and copies and endings tell from ALIGNED words on; a finished value is no case,
    however short beside its copies, nor is one that merely lacks its full stop. Repeated rows count once. Empty input gives
    no rows.
    """
    values = _values(df, id_col, value_col)
    kind = values.schema["id"].dataType
    vocab, total = vocabulary(values)
    read = written(values.mapInArrow(_read(vocab, total, to_arrow_type(kind)), _READ.format(kind.simpleString())))
    counts = read.filter("ctx is not null").groupBy("ctx").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).filter(F.col("n") >= SEEN)
    lists = [f"c{i}" for i in range(len(ORDERS))]
    opened = read.filter("state = 'open'").select("id", "key", "partial", *(F.col("ctxs")[i].alias(c) for i, c in enumerate(lists)))
    # Many texts end alike: each list of contexts is looked up once. Its first, the longest, tells it from all others.
    once = opened.select(lists).distinct()
    ends = once.select(*lists, F.posexplode(F.array(*lists)).alias("o", "ctx")).join(counts, "ctx")
    # The longest context that was seen often enough decides.
    best = ends.groupBy(*lists).agg(F.min(F.struct("o", (F.col("ends") / F.col("n")).alias("share"))).alias("b"))
    best = opened.join(best, lists, "left").select("id", "key", "partial", "b")
    copies = aligned(values).withColumn("copy", F.lit(True))
    rare = F.col("b.share") < F.when(F.col("b.o") == len(ORDERS) - 1, TERMINALITY_OF_ONE).otherwise(TERMINALITY)
    why = F.when(F.col("copy"), "copy").when(F.col("partial"), "word").when(rare, "ending")
    rest = best.join(copies, "key", "left").select("id", why.alias("why")).filter("why is not null")
    return read.filter("state = 'marked'").select("id", F.lit("mark").alias("why")).unionByName(rest).groupBy("id").agg(F.min("why").alias("why"))


def truncation_rates(df: DataFrame, cut: DataFrame, sessions: DataFrame, id_col: str = "entry_id") -> DataFrame:
    """Per source of ``df``: entries, cut entries, their share, and the truncation repairs of the sessions that source fed.

    Null sources are one group. A session's repairs count once for each source among its entries; of its rows the largest
    count holds, null where none is known.
    """
    rows = df.select(F.col(id_col).alias("id"), "session_id", "source").distinct().join(cut.select("id", F.lit(1).alias("is_cut")), "id", "left")
    per = rows.groupBy("source").agg(F.count("*").alias("entries"), F.count("is_cut").alias("cut"), (F.count("is_cut") / F.count("*")).alias("rate"))
    fixes = sessions.groupBy("session_id").agg(F.max("dedup_stats.truncation_repairs").alias("r"))
    repairs = rows.select("session_id", "source").distinct().join(fixes, "session_id").groupBy(F.col("source").alias("_s")).agg(F.sum("r").alias("truncation_repairs"))
    return per.join(repairs, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
