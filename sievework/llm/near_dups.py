"""Near-duplicate records by BagMinHash signatures, banding and an exact check of word overlap."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import is_placeholder
from sievework.llm.bagminhash import band_keys, mix, signatures
from sievework.llm.vectext import code_points, hash_runs, is_alnum, tokenize_codes
from sievework.operators.components import connected_components
from sievework.operators.skew import join_counted
from sievework.session import written

#: Of pairs at the least similarity, all bands together miss this share, and fewer of any more similar pair.
MISSED = 0.0025
#: Components a band has beyond four, so that chance meetings in a bucket stay few, are log10(word sets / this).
CHANCE = 50
#: A bucket of more word sets is compared block against block, each pair of blocks in a task; which pairs are found does not depend on it.
HOT = 16_384
#: Members of a form beyond so many are spread under several keys when pairs of forms become pairs of records.
SPREAD = 100_000
CELLS = 96  # of a word set's parity map
_TINY = 24  # rows of a bucket up to which buckets are compared together, all at one distance at a time
_FIELD_BREAKS, _RUN = re.compile(r"[;|\r\n]+"), re.compile(r"[^\W_]+")


def texts(df: DataFrame, id_col: str, key_col: str, value_col: str, min_runs: int) -> DataFrame:
    """id, key and value of the rows that may have ``min_runs`` runs of letters and digits in their value."""
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(key_col), F.lit("")).alias("key"), F.col(value_col).alias("value"))
    return src.filter((F.length("value") >= 2 * min_runs - 1) & ~is_placeholder(F.col("value")))


@dataclass
class Records:
    """The eligible rows of a batch: which they are, their distinct words one record after the other, their class (two
    independent 64-bit hashes of the set of words) and where key and value are in the code points.
    """

    row: np.ndarray
    starts: np.ndarray
    words: np.ndarray
    cls: np.ndarray
    check: np.ndarray
    codes: np.ndarray
    begin: np.ndarray
    middle: np.ndarray
    end: np.ndarray

    def plain(self) -> np.ndarray:
        """A hash of the bare forms of key and value."""
        word = is_alnum(self.codes)
        at = np.concatenate([[0], np.cumsum(word)])
        chars = self.codes[word]
        value, key = hash_runs(chars, at[self.begin], at[self.middle]), hash_runs(chars, at[self.middle], at[self.end])
        return mix(value ^ mix(key)).view(np.int64)


def read_records(rb: pa.RecordBatch, min_runs: int) -> Records:
    """Words are 32 bits of their hash: two words of one pair meet by chance about once in ten million pairs."""
    values = [v.lower() for v in rb.column("value").to_pylist()]
    codes, starts = code_points([f"{v}\n{k.lower()}" for v, k in zip(values, rb.column("key").to_pylist())])
    tok = tokenize_codes(codes, starts)
    middle = starts[:-1] + np.fromiter(map(len, values), np.int64, len(values))
    runs = np.bincount(tok.text[tok.begin < middle[tok.text]], minlength=len(values)) if len(tok.text) else np.zeros(len(values), int)
    ok = runs >= min_runs
    tok = tok.only(ok)
    w = (tok.hash >> np.uint64(32)).astype(np.int64)
    key = np.sort((tok.text << 32) | w)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key  # distinct words of each record, in order
    own, w = key >> 32, key & 0xFFFFFFFF
    first = np.searchsorted(own, np.arange(len(tok.starts) + 1))
    once = mix(w.astype(np.uint64) + np.uint64(1))
    hashes = [mix(np.add.reduceat(h, first[:-1])).view(np.int64) if len(w) else np.zeros(0, np.int64) for h in (once, mix(once))]
    return Records(np.flatnonzero(ok), first, w.astype(np.uint32).view(np.int32), *hashes, codes, starts[:-1][ok], middle[ok], starts[1:][ok])


def field_hash(key: str, value: str) -> int | None:
    """A hash of the bare key and the sorted bare fields of a value that lists several; null for any other value."""
    if ":" not in value:
        return None
    parts = [p for p in _FIELD_BREAKS.split(value.lower()) if p.strip()]
    if len(parts) < 2 or not all(p.partition(":")[0].strip() and ":" in p for p in parts):
        return None
    bare = lambda t: "".join(_RUN.findall(t))
    fields = sorted(f"{bare(n)}:{bare(v)}" for n, _, v in (p.partition(":") for p in parts))
    return int.from_bytes(blake2b("\x1f".join([bare(key.lower()), *fields]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def records(src: DataFrame, min_runs: int) -> DataFrame:
    """Of each eligible row id, cls and check (its word set), plain and fields (its forms; fields is 0 without a list), and the
    words of the set where the task that reads it has not seen it before. One pass over the texts, written once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rb in batches:
            r = read_records(rb, min_runs)
            rb = rb.take(pa.array(r.row))
            fields = [field_hash(k, v) or 0 for k, v in zip(rb.column("key").to_pylist(), rb.column("value").to_pylist())]
            new = np.zeros(len(r.cls), bool)
            for i in np.unique(r.cls ^ r.check, return_index=True)[1]:
                c = int(r.cls[i] ^ r.check[i])
                new[i] = c not in seen
                seen.add(c)
            if len(seen) > 1_000_000:  # forgotten at a bound: a copy more does no harm
                seen.clear()
            size = np.where(new, np.diff(r.starts), 0)
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append(~new, False)), pa.array(r.words[np.repeat(new, np.diff(r.starts))]))
            yield pa.RecordBatch.from_arrays([rb.column("id"), *map(pa.array, (r.cls, r.check, r.plain())), pa.array(fields, pa.int64()), sets], ["id", "cls", "check", "plain", "fields", "words"])

    return written(src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, cls long, check long, plain long, fields long, words array<int>"))


def _flat(rb: pa.RecordBatch | pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    col = rb.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = col.offsets.to_numpy().astype(np.int64)
    return off - off[0], col.flatten().to_numpy(zero_copy_only=False)


def banding(n: int, similarity: float) -> tuple[int, int]:
    """Bands and components a band for ``n`` word sets. All words weigh the same, so whether a pair meets depends on its similarity
    alone; bands are as many as keep the share of missed pairs below MISSED whatever their components.
    """
    rows = max(4, math.ceil(math.log10(max(n, 1) / CHANCE)))
    return math.ceil(math.log(MISSED) / math.log(1 - similarity**rows)), rows


def _parity(starts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two integers a set: the parities of the number of its words in each of CELLS cells, 64 in the first; the second has the
    set's size above its 32. At least as many words differ between two sets as parities do.
    """
    cell = (mix(words.view(np.uint32).astype(np.uint64)) >> np.uint64(20)) % np.uint64(CELLS)
    bit = np.uint64(1) << (cell & np.uint64(63))
    low, high = (np.bitwise_xor.reduceat(np.where(own, bit, np.uint64(0)), starts[:-1]) for own in (cell < 64, cell >= 64))
    return low.view(np.int64), (high | (np.diff(starts).astype(np.uint64) << np.uint64(32))).view(np.int64)


def _bands(bands: int, rows: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                rb = whole.slice(at, 2000)
                starts, words = _flat(rb, "words")
                keys = band_keys(signatures(starts, words.view(np.uint32).astype(np.uint64), np.zeros(len(words), np.uint8), bands * rows), bands, rows)
                keys = (keys.view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)
                cls, low, high = (np.repeat(x, bands) for x in (rb.column("cls").to_numpy(), *_parity(starts, words)))
                # The bucket comes last: its leading zeros then stand beside those of the next row and compress with them.
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(low), pa.array(high), pa.array(keys.ravel())], ["cls", "low", "high", "bucket"])

    return run


class _Sets:
    """Word sets by their class and parity map."""

    def __init__(self, cls: np.ndarray, low: np.ndarray, high: np.ndarray, similarity: float):
        self.cls, self.low = cls, low.view(np.uint64)
        self.high, self.size = (high & 0xFFFFFFFF).astype(np.uint32), (high >> 32).astype(np.float64)
        # |A xor B| <= most * (|A| + |B|) holds for every similar pair.
        self.similarity, self.most = similarity, (1 - similarity) / (1 + similarity) * self.size + 5e-10

    def tested(self, x: np.ndarray, y: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """Which of the pairs ``x``, ``y`` sizes and parity maps allow; ``differ``: parities that differ in the first part."""
        small, large = np.minimum(self.size[x], self.size[y]), np.maximum(self.size[x], self.size[y])
        differ = differ + np.bitwise_count(self.high[x] ^ self.high[y])
        return (differ <= self.most[x] + self.most[y]) & (small >= self.similarity * large - 1e-9) & (self.cls[x] != self.cls[y])

    def rows(self, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        a, b = self.cls[x], self.cls[y]
        key = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1])], ["a", "b"])

    def across(self, a: slice, b: slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs that tests allow between two stretches; of one stretch with itself each once."""
        same, n = a == b, b.stop - b.start
        step = max(1, 500_000 // max(n, 1))
        for lo in range(a.start, a.stop, step):
            hi, first = min(lo + step, a.stop), lo if same else b.start
            differ = np.bitwise_count(self.low[lo:hi, None] ^ self.low[None, first : b.stop])
            x, y = np.nonzero(differ <= self.most[lo:hi, None] + self.most[None, first : b.stop])
            x, y, d = x + lo, y + first, differ[x, y]
            if same:
                x, y, d = x[y > x], y[y > x], d[y > x]
            ok = self.tested(x, y, d)
            yield x[ok], y[ok]

    def within(self, bucket: np.ndarray) -> pa.RecordBatch:
        """The pairs of rows of equal ``bucket``, in sorted input."""
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        size = np.diff(np.append(edge, len(bucket)))
        found = [p for e, n in zip(edge[size > _TINY], size[size > _TINY]) for p in self.across(slice(e, e + n), slice(e, e + n))]
        at = np.flatnonzero(np.repeat((size > 1) & (size <= _TINY), size))
        for d in range(1, _TINY):
            at = at[at + d < len(bucket)]
            at = at[bucket[at] == bucket[at + d]]
            if not len(at):
                break
            ok = self.tested(at, at + d, np.bitwise_count(self.low[at] ^ self.low[at + d]))
            found.append((at[ok], at[ok] + d))
        return self.rows(*(np.concatenate([p[i] for p in found] or [np.zeros(0, np.int64)]) for i in (0, 1)))


def _pairs(similarity: float, hot: int, least: int = 100_000):
    """Pairs (a < b) of the rows of equal ``bucket`` in sorted input, as far as sizes and parity maps allow ``similarity``; of a bucket of
    more than ``hot`` rows its rows instead, each with the number of its block.
    """
    names = ("bucket", "cls", "low", "high")

    def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rb = _Sets(*cols[1:], similarity).within(cols[0])
        if rb.num_rows:
            yield pa.RecordBatch.from_arrays([*rb.columns, *(pa.nulls(rb.num_rows, pa.int64()) for _ in range(4))], ["a", "b", "bucket", "low", "high", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        flowing, gone, last = None, 0, None  # the hot bucket whose rows are passed on as they come, how many have, and the last one

        def read(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal flowing, gone, last
            cols = [np.concatenate(x) for x in zip(*held)]
            new = np.append(last is None or any(x[0] != y for x, y in zip(cols, last)), np.any([x[1:] != x[:-1] for x in cols], axis=0))
            end = [x[-1] for x in cols]
            cols = [x[new] for x in cols]  # a set that several tasks have read is one
            if not len(cols[0]):
                held[:] = []
                return
            last = None
            bucket = cols[0]
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            size = np.diff(np.append(edge, len(bucket)))
            large = (size > hot) | (bucket[edge] == flowing)
            done = len(bucket) if final or large[-1] else int(edge[-1])  # the last bucket may go on in the next batch
            for e, n in zip(edge[large], size[large]):
                gone = gone if bucket[e] == flowing else 0
                flowing = bucket[e]
                for at in range(e, e + n, hot):
                    part = slice(at, min(at + hot, e + n))
                    k = part.stop - part.start
                    block = (gone + np.arange(k)) // hot
                    gone += k
                    yield pa.RecordBatch.from_arrays([pa.array(cols[1][part]), pa.nulls(k, pa.int64()), *(pa.array(cols[i][part]) for i in (0, 2, 3)), pa.array(block)], ["a", "b", "bucket", "low", "high", "block"])
            if not large[-1]:
                flowing, gone = None, 0
            plain = ~np.repeat(large, size)[:done]
            yield from emit([x[:done][plain] for x in cols])
            if done < len(bucket):
                held[:] = [[x[done:] for x in cols]]
            else:
                held[:], last = [], end

        rows = 0
        for rb in batches:
            held.append([rb.column(c).to_numpy() for c in names])
            rows += rb.num_rows
            if rows >= least and rb.num_rows:
                yield from read(False)
                rows = sum(len(x[0]) for x in held)
        if held:
            yield from read(True)

    return run


def _block_pairs(similarity: float):
    """Pairs between the two blocks of each (bucket, i, j), rows sorted by these and by block."""

    def test(t: pa.Table) -> Iterator[pa.RecordBatch]:
        s = _Sets(*(t.column(c).to_numpy() for c in ("a", "low", "high")), similarity)
        block = t.column("block").to_numpy()
        n, mid = len(block), int(np.searchsorted(block, block[0], "right"))
        for x, y in s.across(slice(0, mid), slice(0, mid) if mid == n else slice(mid, n)):
            yield s.rows(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None
        for rb in batches:
            keys = np.stack([rb.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
            edge = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
            for lo, hi in zip(edge, [*edge[1:], len(keys)]):
                if held and own != tuple(keys[lo]):
                    yield from test(pa.Table.from_batches(held).combine_chunks())
                    held = []
                own = tuple(keys[lo])
                held.append(rb.slice(lo, hi - lo))
        if held:
            yield from test(pa.Table.from_batches(held).combine_chunks())

    return run


def similar_classes(own: DataFrame, similarity: float = 0.7, bands: int | None = None, band_rows: int | None = None, hot: int = HOT) -> DataFrame:
    """Pairs (``a`` < ``b``, structs of cls and check) of different word sets among ``own`` (see `records`) whose Jaccard similarity
    is ``similarity`` or more; written, as it is read several times.

    Candidates share a band of BagMinHash components (see `banding`). All words weigh the same, so whether a pair is found depends on its
    similarity alone, not on how common its words or how many its copies are. Three exact tests follow, cheapest first: set
    sizes, a parity map of which as many bits differ as words at most, and the word sets themselves. Equal sets
    meet once, as one class. Buckets of more than ``hot`` sets are compared in blocks.
    """
    sets = own.filter("words is not null")
    n = sets.count()
    chosen = banding(n, similarity)
    bands, rows = bands or chosen[0], band_rows or chosen[1]
    # So many bits that some ten thousand keys in all meet by chance, whatever n: keys are much of what is shuffled, and pairs
    # that meet by chance fail the exact tests.
    bits = max(24, min(63, math.ceil(2 * math.log2(max(2, n * bands))) - 15))
    buckets = sets.select("cls", "words").mapInArrow(_bands(bands, rows, bits), "cls long, low long, high long, bucket long")
    order = ["bucket", "cls", "low", "high"]
    met = buckets.repartition("bucket").sortWithinPartitions(*order).mapInArrow(_pairs(similarity, hot), "a long, b long, bucket long, low long, high long, block long")
    met = written(met)
    cand = met.filter("b is not null").select("a", "b")
    crowd = met.filter("b is null")
    if crowd.limit(1).count():
        blocks = crowd.groupBy("bucket").agg((F.max("block") + 1).alias("n"))
        crowd = crowd.join(blocks, "bucket").withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        crowd = crowd.select("a", "bucket", "low", "high", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
        crowd = crowd.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "block").mapInArrow(_block_pairs(similarity), "a long, b long")
        cand = cand.unionByName(crowd)

    side = lambda s: sets.select(F.col("cls").alias(f"_{s}"), F.struct("cls", "check").alias(s), F.col("words").alias(f"_w{s}"))
    near = cand.distinct().withColumnsRenamed({"a": "_a", "b": "_b"}).join(side("a"), "_a").join(side("b"), "_b")
    both = F.size(F.array_intersect("_wa", "_wb"))
    return written(near.filter(both >= similarity * (F.size("_wa") + F.size("_wb") - both) - 1e-9).select("a", "b").distinct())


def near_duplicate_pairs(df: DataFrame, id_col: str = "entry_id", key_col: str = "entry_key", value_col: str = "entry_value", similarity: float = 0.7, min_runs: int = 12, spread: int = SPREAD) -> DataFrame:
    """All pairs of records (``id_a`` < ``id_b``) whose words are similar and whose bare forms differ.

    Records count if their value is no placeholder and has ``min_runs`` runs of letters and digits or more; null keys count
    as empty. Pairs of one word set are found as members of one class, pairs of different sets through `similar_classes`.
    Rows delivered twice are one record; a record never pairs with itself; empty input gives no rows.
    Forms (records equal but for formatting) are paired first and become records at the end, so copies never meet each other.
    Result size is what the definition asks for: a hundred variants of a text are 4,950 pairs.
    """
    own = records(texts(df, id_col, key_col, value_col, min_runs), min_runs)
    links = similar_classes(own, similarity)
    # Only classes with a link or with several forms have pairs; all else is left behind here.
    forms = ["plain", "fields"]
    several = own.groupBy("cls", "check").agg(*(f(c).alias(f"{n}_{c}") for c in forms for n, f in (("lo", F.min), ("hi", F.max)))).filter("lo_plain <> hi_plain")
    several = several.select(F.struct("cls", "check").alias("c"))
    nodes = links.select(F.explode(F.array("a", "b")).alias("c")).unionByName(several).distinct().select("c.cls", "c.check")
    own = written(own.select("id", "cls", "check", *forms).join(nodes, ["cls", "check"]).distinct())
    of = own.groupBy("cls", "check", *forms).agg(F.count("*").alias("n"))
    f = lambda s: of.select(F.struct("cls", "check").alias(s), F.struct("cls", "check", *forms).alias(f"f{s}"), (F.floor((F.col("n") - 1) / spread) + 1).alias(f"n{s}"))
    pairs = links.join(f("a"), "a").join(f("b"), "b").select("fa", "na", "fb", "nb")
    within = f("a").join(f("b"), F.col("a") == F.col("b")).filter("fa < fb").select("fa", "na", "fb", "nb")
    same = (F.col("fa.fields") == F.col("fb.fields")) & (F.col("fa.fields") != 0)
    pairs = pairs.unionByName(within).filter((F.col("fa.plain") != F.col("fb.plain")) & ~same)
    # A form with a large share of all rows has as many keys as `spread` fits into it; its partners are repeated for each.
    wide = F.broadcast(of.filter(F.col("n") > spread).select("cls", "check", *forms, (F.floor((F.col("n") - 1) / spread) + 1).alias("n")))  # at most rows / spread
    rows = own.join(wide, ["cls", "check", *forms], "left").select("id", F.struct("cls", "check", *forms).alias("f"), F.pmod(F.xxhash64("id"), F.coalesce("n", F.lit(1))).alias("k"))
    for s in ("a", "b"):
        keys = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{s}") - 1)).alias(f"k{s}")
        m = rows.select(F.col("id").alias(f"id_{s}"), F.col("f").alias(f"_f{s}"), F.col("k").alias(f"_k{s}"))
        pairs = pairs.select("*", keys).join(m, (F.col(f"f{s}") == F.col(f"_f{s}")) & (F.col(f"k{s}") == F.col(f"_k{s}"))).drop(f"_f{s}", f"_k{s}", f"k{s}")
    return pairs.filter("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str = "entry_id", key_col: str = "entry_key", value_col: str = "entry_value", similarity: float = 0.7, min_runs: int = 12) -> DataFrame:
    """One row per eligible record: ``id``, ``group`` and ``links``, the number of other word sets its own is similar to.

    Groups are connected components of similar word sets; ``group`` is the smallest id in it. Copies need no links.
    """
    own = records(texts(df, id_col, key_col, value_col, min_runs), min_runs)
    links = similar_classes(own, similarity)
    degree = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    found = degree.join(connected_components(links), F.col("c") == F.col("node")).select("c", "links", "component")
    rows = own.select("id", F.struct("cls", "check").alias("c")).distinct()
    # One row a class, combined map-side; its members come back by a join that holds for hot classes.
    classes = rows.groupBy("c").agg(F.min("id").alias("lead"), F.count("*").alias("n")).join(found, "c", "left").withColumn("component", F.coalesce("component", "c"))
    lead = classes.groupBy("component").agg(F.min("lead").alias("group"))
    classes = classes.join(lead, "component").select("c", "n", "group", F.coalesce("links", F.lit(0)).alias("links"))
    return join_counted(rows, classes, "c", "n", F.col("id")).select("id", "group", "links")
