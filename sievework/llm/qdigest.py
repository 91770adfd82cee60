"""Percentiles with a deterministic rank bound from mergeable q-digests.

Values are quantized to leaves of a binary tree over a bounded ordered universe. A digest keeps counts at tree nodes; a node
whose count with its sibling's and parent's is below n / k is folded into the parent, so that a digest holds at most 3k nodes
and any rank read from it is off by at most log2(universe) * n / k. Digests merge by adding counts node by node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20  # leaves 0 .. 2**20 - 1
UNIT = 0.001  # width of a leaf in the values' unit (milliseconds, for seconds): 0 .. 1048.575 exactly, see `leaf`
K = 2000  # ranks are off by at most BITS / K = 1 % of the count


def leaf(value: Column, unit: float = UNIT) -> Column:
    """The leaf of a measurement; null for null, NaN, negative and infinite values, which are no measurements.

    Half of the universe has width ``unit``; beyond, leaves widen by 1 / 2**15 of the value, so that the universe stays
    bounded and ordered for long tails: values up to unit * 2**19 * e**16 (in seconds 147 years) keep a relative error of
    1 / 32,768. All beyond is in the last leaf, whose value is infinity.
    """
    half = 1 << (BITS - 1)
    x = value / F.lit(unit)
    near = F.floor(x)
    far = half + F.floor(F.log(x / half) * 32768)
    ok = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    return F.when(ok, F.least(F.when(x < half, near).otherwise(far), F.lit((1 << BITS) - 1)).cast("long"))


def leaf_value(leaf_number: np.ndarray, unit: float = UNIT) -> np.ndarray:
    """The smallest value of a leaf, infinity for the last one, which holds what the universe does not."""
    half = 1 << (BITS - 1)
    x = np.asarray(leaf_number, float)
    return np.where(x < (1 << BITS) - 1, unit * np.where(x < half, x, half * np.exp((x - half) / 32768)), np.inf)


def compress(nodes: np.ndarray, counts: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """A digest's nodes (numbered as in a heap: leaf i is 2**BITS + i, a node's parent is half of it), folded bottom-up."""
    order = np.argsort(nodes)
    nodes, counts = nodes[order], counts[order]
    limit = int(counts.sum()) // k
    out_n, out_c = [], []
    level_n, level_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for depth in range(BITS, 0, -1):
        own = (nodes >> depth) == 1
        level_n, level_c = _add(np.concatenate([level_n, nodes[own]]), np.concatenate([level_c, counts[own]]))
        parents, at = np.unique(level_n >> 1, return_inverse=True)
        total = np.bincount(at, level_c, len(parents)).astype(np.int64)
        up = ((nodes >> (depth - 1)) == 1).nonzero()[0]
        if len(up):
            hit = np.searchsorted(nodes[up], parents)
            hit = np.minimum(hit, len(up) - 1)
            total = total + np.where(nodes[up][hit] == parents, counts[up][hit], 0)
        fold = total[at] < limit
        out_n.append(level_n[~fold])
        out_c.append(level_c[~fold])
        level_n, level_c = _add(level_n[fold] >> 1, level_c[fold])
    own = nodes == 1
    level_n, level_c = _add(np.concatenate([level_n, nodes[own]]), np.concatenate([level_c, counts[own]]))
    n, c = np.concatenate([*out_n, level_n]), np.concatenate([*out_c, level_c])
    order = np.argsort(n)
    return n[order], c[order]


def _add(nodes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(nodes, return_inverse=True)
    return u.astype(np.int64), np.bincount(at, counts, len(u)).astype(np.int64)


def quantiles(nodes: np.ndarray, counts: np.ndarray, probs: list[float], unit: float = UNIT) -> list[tuple[float, float]]:
    """For each probability the value whose rank is ceil(p * n) as the digest has it (the upper end of the node in which
    that rank falls, nodes in order of their upper leaf, smaller ranges first), with the digest's bound on its rank error.
    """
    depth = np.floor(np.log2(nodes)).astype(np.int64)
    width = BITS - depth
    upper = ((nodes + 1) << width) - 1 - (1 << BITS)
    order = np.lexsort((width, upper))
    cum = np.cumsum(counts[order])
    n = int(cum[-1])
    # Only counts kept above the leaves can be out of place: those on the path to a leaf, one node a level.
    bound = float(sum(int(counts[depth == d].max()) for d in np.unique(depth[depth < BITS])))
    at = [int(np.searchsorted(cum, max(1, int(np.ceil(p * n))))) for p in probs]
    return [(float(leaf_value(upper[order][i], unit)), bound) for i in at]


def _type(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _lists(t: pa.Table | pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    """Offsets and then the values of each of several list columns of equal lengths."""
    cols = [c.combine_chunks() if isinstance(c := t.column(n), pa.ChunkedArray) else c for n in names]
    off = cols[0].offsets.to_numpy().astype(np.int64)
    return [off - off[0], *(c.flatten().to_numpy(zero_copy_only=False) for c in cols)]


def _folded(offsets: np.ndarray, nodes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests one after the other, each compressed if it has more nodes than leaves may be without loss, or counts to fold."""
    size, total = np.diff(offsets), np.add.reduceat(np.append(counts, 0), offsets[:-1]) if len(offsets) > 1 else np.zeros(0, np.int64)
    out_n, out_c, n = [], [], size.copy()
    at = 0
    for i in np.flatnonzero((total >= k) & (size > 0)):  # below k counts nothing can be folded
        out_n.append(nodes[at : offsets[i]]), out_c.append(counts[at : offsets[i]])
        a, b = compress(nodes[offsets[i] : offsets[i + 1]], counts[offsets[i] : offsets[i + 1]], k)
        out_n.append(a), out_c.append(b)
        n[i], at = len(a), offsets[i + 1]
    out_n.append(nodes[at:]), out_c.append(counts[at:])
    return np.concatenate([[0], np.cumsum(n)]), np.concatenate(out_n), np.concatenate(out_c)


def _partial(keys: list[str], k: int, most: int):
    """Digests of what a task reads: leaves are counted over all groups at once, and handed on in the end or when there are ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[pa.Table] = []
        held: list[np.ndarray] = []  # group, node and count

        def add_up() -> tuple[pa.Table, np.ndarray]:
            t = pa.concat_tables(groups).combine_chunks()
            code, first = _codes(t)
            x = np.concatenate(held, axis=1)
            key, at = np.unique((code[x[0]] << (BITS + 1)) | x[1], return_inverse=True)
            return t.take(pa.array(first)), np.stack([key >> (BITS + 1), key & ((2 << BITS) - 1), np.bincount(at, x[2], len(key)).astype(np.int64)])

        def digests() -> pa.RecordBatch:
            t, x = add_up()
            off = np.searchsorted(x[0], np.arange(t.num_rows + 1))
            off, nodes, counts = _folded(off, x[1], x[2], k)
            lists = [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(v)) for v in (nodes, counts)]
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns), *lists], [*keys, "nodes", "counts"])

        base = 0
        for rb in batches:
            if not rb.num_rows:
                continue
            t = pa.Table.from_batches([rb.select(keys)])
            code, first = _codes(t)
            groups.append(t.take(pa.array(first)))
            held.append(np.stack([code + base, rb.column("_leaf").to_numpy() + (1 << BITS), np.ones(rb.num_rows, np.int64)]))
            base += len(first)
            if sum(x.shape[1] for x in held) > most:
                t, x = add_up()
                if x.shape[1] > most // 2:
                    yield digests()
                    groups, held, base = [], [], 0
                else:
                    groups, held, base = [t], [x], t.num_rows
        if groups:
            yield digests()

    return run


def _codes(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row, equal for equal rows (nulls are equal), and the first row of each number."""
    code = np.zeros(t.num_rows, np.int64)
    for c in t.columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        d = pa.compute.dictionary_encode(c, null_encoding="encode")
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        code = np.unique(code * (len(d.dictionary) + 1) + d.indices.to_numpy(), return_inverse=True)[1].astype(np.int64)
    first = np.unique(code, return_index=True)[1]
    return code, first


def build(df: DataFrame, keys: list[str], value: str, k: int = K, unit: float = UNIT, most: int = 2_000_000) -> DataFrame:
    """One digest per group: ``keys``, ``n``, ``nodes`` and ``counts`` (at most 3k nodes and a path's).

    Rows that are no measurements (see `leaf`) count nowhere; groups without any have no row; null keys are groups.
    Each task makes digests of its own rows, which are then merged; it holds at most ``most`` counts, and what crosses
    the shuffle is digests, however large a group is.
    """
    src = df.select(*keys, leaf(F.col(value), unit).alias("_leaf")).filter("_leaf is not null")
    return merge(src.mapInArrow(_partial(keys, k, most), f"{_type(src, keys)}, nodes array<long>, counts array<long>"), keys, k)


def merge(digests: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Digests of finer groups, or of the same from different places, added up node by node to those of ``keys``.

    Nodes are added in a distributed sum; a group's nodes, each once, then come together to be folded. The bound of a result is
    read from its own counts (see `quantiles`), whatever it was merged from.
    """
    nodes = digests.select(*keys, F.inline(F.arrays_zip("nodes", "counts"))).groupBy(*keys, F.col("nodes").alias("node")).agg(F.sum("counts").alias("count"))
    grouped = nodes.groupBy(*keys).agg(F.sum("count").alias("n"), F.array_sort(F.collect_list(F.struct("node", "count"))).alias("raw"))
    grouped = grouped.select(*keys, "n", F.transform("raw", lambda x: x["node"]).alias("nodes"), F.transform("raw", lambda x: x["count"]).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            off, n, c = _folded(*_lists(rb, ("nodes", "counts")), k)
            lists = [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(v)) for v in (n, c)]
            yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in range(len(keys) + 1)), *lists], [*keys, "n", "nodes", "counts"])

    return grouped.mapInArrow(run, f"{_type(digests, keys)}, n long, nodes array<long>, counts array<long>")


def read(digests: DataFrame, keys: list[str], probs: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.99), unit: float = UNIT) -> DataFrame:
    """``keys``, ``n``, ``p``, ``value`` and ``rank_error`` (the most the value's rank can be off) for each probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            off, nodes, counts = _lists(rb, ("nodes", "counts"))
            got = [x for lo, hi in zip(off, off[1:]) for x in quantiles(nodes[lo:hi], counts[lo:hi], list(probs), unit)]
            again = pa.array(np.repeat(np.arange(rb.num_rows), len(probs)))
            cols = [rb.column(i).take(again) for i in range(len(keys) + 1)]
            p, v, b = np.tile(np.array(probs), rb.num_rows), *(np.array([x[i] for x in got], np.float64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, (p, v, b))], [*keys, "n", "p", "value", "rank_error"])

    return digests.select(*keys, "n", "nodes", "counts").mapInArrow(run, f"{_type(digests, keys)}, n long, p double, value double, rank_error double")


def session_times(sessions: DataFrame) -> DataFrame:
    """Measurements of each session: document_type, day, month, measure (``chunk`` or ``total``) and seconds.

    A session counts once, by its row received last (ties: the larger row of chunk results, then of total time), removed
    sessions too: their work was done. document_type is trimmed and lower case, null and blank are ``unknown``.
    """
    last = sessions.filter("session_id is not null").groupBy("session_id").agg(
        F.max(F.struct("received_ts", F.coalesce(F.size("chunk_results"), F.lit(0)).alias("size"), F.coalesce("total_processing_time", F.lit(-1.0)).alias("t"), "created_ts", "document_type", "chunk_results", "total_processing_time")).alias("s")
    ).select("s.*")
    kind = F.lower(F.regexp_replace("document_type", r"(?U)^\s+|\s+$", ""))
    one = F.transform(F.coalesce("chunk_results", F.array()), lambda c: F.struct(F.lit("chunk").alias("measure"), c["processing_time"].alias("seconds")))
    every = F.concat(one, F.array(F.struct(F.lit("total").alias("measure"), F.col("total_processing_time").alias("seconds"))))
    return last.select(F.when((kind == "") | kind.isNull(), "unknown").otherwise(kind).alias("document_type"), F.to_date("created_ts").alias("day"), F.date_format("created_ts", "yyyy-MM").alias("month"), F.inline(every))
