"""Scores for abusive, hateful and sexual language from a factorization machine over hashed terms.

Documents are long and the bad sentence in them short, while labels name documents. So windows of twelve words are scored, a
document has the score of its worst window, and training alternates between picking each bad document's worst window and
fitting the machine to those windows against all windows of clean documents. Terms are read through common disguises: accents,
spaced or dotted letters, stretched letters, digits for letters, masked words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.bagminhash import mix
from sievework.llm.vectext import Tokens, code_points, hash_runs, is_alnum
from sievework.sources.tables import norm_label

BITS, FACTORS = 18, 8
WINDOW, STRIDE = 12, 6
FIRST_GUESS = 1.2  # mean log-odds of a window's terms from which a bad document's window is believed at first
THRESHOLD = 0.8  # of the score, for a document to be flagged
#: The classifier is fitted on at most so many labelled documents, chosen by a hash of their id.
MAX_LABELLED = 20_000

# Signs that hide inside words, digits that stand for letters, characters of no width.
_JOINERS = np.array([ord(x) for x in "._-·*"], np.uint32)
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
_NO_WIDTH = np.array([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF], np.uint32)
_ENDS = np.array([ord(x) for x in ".!?"], np.uint32)
_MASKED = np.uint64(0x5DEECE66D)


def _fold_table() -> np.ndarray:
    """Lower-case base letter of each character up to U+FFFF: accents, width and style taken off."""
    import unicodedata

    out = np.arange(0x10000, dtype=np.uint32)
    for i in range(0x80, 0x10000):
        base = unicodedata.normalize("NFKD", chr(i))[0] if not 0xD800 <= i < 0xE000 else chr(i)
        low = base.lower()[0]
        out[i] = ord(low) if ord(low) < 0x10000 else i
    for i in range(ord("A"), ord("Z") + 1):
        out[i] = i + 32
    return out


_FOLD = _fold_table()
_LEET = np.arange(256, dtype=np.uint32)
for _a, _b in _DIGITS.items():
    _LEET[ord(_a)] = ord(_b)


def _letters(c: np.ndarray) -> np.ndarray:
    return is_alnum(c) & ~((c >= 48) & (c <= 57))


def _shift(x: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full_like(x, fill)
    if by > 0:
        out[by:] = x[:-by]
    else:
        out[:by] = x[-by:]
    return out


def read_through(texts: list[str]) -> Tokens:
    """Tokens of texts with disguises undone."""
    codes, starts = code_points(texts)
    codes = np.where(codes < 0x10000, _FOLD[np.minimum(codes, 0xFFFF)], codes)
    own = np.repeat(np.arange(len(texts)), np.diff(starts))

    def keep(mask: np.ndarray) -> None:
        nonlocal codes, own
        codes, own = codes[mask], own[mask]

    keep(~np.isin(codes, _NO_WIDTH))
    # Letters stretched to three or more count once.
    edge = np.flatnonzero(np.diff(codes, prepend=0) != 0)
    run = np.repeat(np.diff(np.append(edge, len(codes))), np.diff(np.append(edge, len(codes))))
    first = np.zeros(len(codes), bool)
    first[edge] = True
    keep(first | (run < 3) | ~_letters(codes))
    # One joining sign between two letters hides nothing; masks of several asterisks stay.
    letter = _letters(codes)
    keep(~(np.isin(codes, _JOINERS) & _shift(letter, 1, False) & _shift(letter, -1, False)))
    # A space between two single letters.
    letter = _letters(codes)
    single = letter & ~_shift(letter, 1, False) & ~_shift(letter, -1, False)
    before_single = _shift(single, 1, False)
    keep(~((codes == 32) & before_single & _shift(single, -1, False)))

    word = is_alnum(codes)
    star = (codes == 42) & (_shift(codes == 42, 1, False) | _shift(codes == 42, -1, False))
    word |= star
    step = np.diff(word.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    n = end - begin
    inside = np.repeat(_letters(codes[begin]) if len(begin) else np.zeros(0, bool), n)
    at = np.flatnonzero(word)
    codes = codes.copy()
    fix = at[inside & (codes[at] < 256)]
    codes[fix] = _LEET[codes[fix]]
    h = hash_runs(codes, begin, end)
    if len(begin):
        h[np.add.reduceat(star[at].astype(np.int32), np.cumsum(n) - n) > 0] = _MASKED
    at = np.searchsorted(own, np.arange(len(texts) + 1))
    return Tokens(codes, at[:-1], at[1:], begin, end, h, own[begin])


@dataclass
class Windows:
    """Windows of at most WINDOW tokens within sentences: token range and text of each, and the terms of each token."""

    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    word: np.ndarray  # hashed term of each token
    pair: np.ndarray  # hashed term of each token with the next one


def windows(texts: list[str], step: int = 500) -> Windows:
    """Windows of all texts, read ``step`` texts at a time, so that memory holds little besides the result."""
    parts = [_windows(texts[i : i + step]) for i in range(0, len(texts), step)] or [_windows([])]
    base = np.cumsum([0, *(len(p.word) for p in parts)])
    join = lambda f: np.concatenate([f(i, p) for i, p in enumerate(parts)])
    return Windows(join(lambda i, p: p.begin + base[i]), join(lambda i, p: p.end + base[i]), join(lambda i, p: p.text + i * step), join(lambda i, p: p.word), join(lambda i, p: p.pair))


def _windows(texts: list[str]) -> Windows:
    tok = read_through(texts)
    n = len(tok.hash)
    # A sentence ends at a stop with a space behind it, and at a line break.
    c = tok.codes
    stop = (np.isin(c, _ENDS) & _shift(c <= 32, -1, True)) | (c == 10)
    mark = np.concatenate([[0], np.cumsum(stop)])
    new = np.ones(n, bool)
    if n:
        new[1:] = (mark[tok.begin[1:]] > mark[tok.end[:-1]]) | (tok.text[1:] != tok.text[:-1])
    sent = np.flatnonzero(new)
    size = np.diff(np.append(sent, n))
    count = np.maximum(1, -(-(size - (WINDOW - STRIDE)) // STRIDE))
    own = np.repeat(np.arange(len(sent)), count)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    begin = sent[own] + nth * STRIDE
    end = np.minimum(begin + WINDOW, (sent + size)[own])
    # Numbers say nothing here: one term for each length.
    digit = (tok.codes[tok.begin] >= 48) & (tok.codes[tok.begin] <= 57) if n else np.zeros(0, bool)
    tok.hash[digit] = mix(np.minimum(tok.end - tok.begin, 6)[digit].astype(np.uint64))
    mask = np.uint64((1 << BITS) - 1)
    nxt = np.append(tok.hash[1:], np.uint64(0))[:n]
    return Windows(begin, end, tok.text[begin] if n else begin, (mix(tok.hash) & mask).astype(np.int32), (mix(tok.hash * np.uint64(31) + mix(nxt)) & mask).astype(np.int32))


class Machine:
    """bias + sum of term weights + all pairwise products of word factors, as a logit."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(1 << BITS, np.float32)
        self.p = np.zeros(1 << BITS, np.float32)
        self.v = rng.normal(0, 0.05, (1 << BITS, FACTORS)).astype(np.float32)
        self.known = np.ones((2, 1 << BITS), bool)  # words and pairs that several training documents hold

    def logits(self, x: Windows) -> np.ndarray:
        """One logit a window, from running sums, so that overlapping windows cost no second look-up."""

        def between(values: np.ndarray, end: np.ndarray) -> np.ndarray:
            run = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
            return run[end] - run[x.begin]

        v = self.v[x.word]
        s = between(v, x.end)
        inter = 0.5 * ((s**2).sum(axis=1) - between((v.astype(np.float64) ** 2).sum(axis=1), x.end))
        return self.bias + between(self.w[x.word], x.end) + between(self.p[x.pair], np.maximum(x.end - 1, x.begin)) + inter

    def fit(self, x: Windows, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 6, rate: float = 0.08, decay: float = 2e-4, batch: int = 1024, seed: int = 1) -> None:
        """Adagrad on windows ``rows`` with targets ``y``."""
        rng = np.random.default_rng(seed)
        gw, gp, gv = np.full_like(self.w, 1e-6), np.full_like(self.p, 1e-6), np.full_like(self.v, 1e-6)
        gb = 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                r, t, wt = rows[pick], y[pick], weight[pick]
                n = x.end[r] - x.begin[r]
                own = np.repeat(np.arange(len(r)), n)
                pos = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(x.begin[r], n)
                last = pos == np.repeat(x.end[r] - 1, n)
                wid, pid, pown = x.word[pos], x.pair[pos[~last]], own[~last]
                v = self.v[wid]
                s = np.add.reduceat(v, np.cumsum(n) - n, axis=0)
                logit = self.bias + np.bincount(own, self.w[wid], len(r)) + np.bincount(pown, self.p[pid], len(r)) + 0.5 * ((s**2).sum(1) - np.bincount(own, (v**2).sum(1), len(r)))
                g = (wt * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - t)).astype(np.float32)
                gb += float(g.sum()) ** 2
                self.bias -= rate * float(g.sum()) / np.sqrt(gb)
                kw, kp = self.known[0][wid], self.known[1][pid]
                _step(self.w, gw, wid[kw], g[own][kw], rate, decay)
                _step(self.p, gp, pid[kp], g[pown][kp], rate, decay)
                _step(self.v, gv, wid[kw], (g[own][:, None] * (s[own] - v))[kw], rate, decay)


def _step(table: np.ndarray, square: np.ndarray, ids: np.ndarray, grad: np.ndarray, rate: float, decay: float) -> None:
    """An Adagrad step on the rows ``ids`` (repeats are summed)."""
    if not len(ids):
        return
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    total = np.add.reduceat(grad[order], first, axis=0)
    u = ids[first]
    total += decay * table[u]
    square[u] += total**2
    table[u] -= rate * total / np.sqrt(square[u])


def worst(x: Windows, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text its highest score (minus infinity without words) and the window that has it (-1 without)."""
    top, at = np.full(n, -np.inf), np.full(n, -1)
    if len(score):
        order = np.lexsort((score, x.text))
        last = np.flatnonzero(np.diff(x.text[order], append=-1))
        top[x.text[order][last]], at[x.text[order][last]] = score[order][last], order[last]
    return top, at


def train(x: Windows, bad: np.ndarray, rounds: int = 3) -> Machine:
    """A machine fitted to the windows of documents of which ``bad`` says whether they hold such language anywhere; labels may err."""
    texts = len(bad)
    m = Machine()
    known = np.zeros((2, 1 << BITS), bool)
    n_bad, n_good = max(1, int(bad.sum())), max(1, int((~bad).sum()))
    # First guess: words and pairs that bad documents share and clean ones lack.
    first = np.searchsorted(x.text, np.arange(texts + 1))
    token_text = np.zeros(len(x.word), np.int64)
    token_text[x.begin[first[:-1]][np.diff(first) > 0]] = 1
    token_text = np.flatnonzero(np.diff(first) > 0)[np.cumsum(token_text) - 1] if len(x.word) else token_text
    guess = np.zeros(len(x.begin))
    for kind, ids in enumerate((x.word, x.pair)):
        seen = np.unique((token_text << BITS) | ids)
        in_text, term = seen >> BITS, seen & ((1 << BITS) - 1)
        in_bad = np.bincount(term[bad[in_text]], minlength=1 << BITS)
        in_good = np.bincount(term[~bad[in_text]], minlength=1 << BITS)
        odds = np.log(np.maximum(in_bad - 1, 0.05) / n_bad) - np.log((in_good + 0.5) / n_good)
        odds = np.where(in_bad >= 2, np.maximum(odds, 0), 0)
        known[kind] = in_bad + in_good >= 2
        run = np.concatenate([[0], np.cumsum(odds[ids])])
        guess += (run[x.end] - run[x.begin]) / np.maximum(x.end - x.begin, 4)
    clean = np.flatnonzero(~bad[x.text])
    score = guess
    for r in range(rounds):
        top, at = worst(x, score, texts)
        pick = at[bad & (at >= 0) & (top > (FIRST_GUESS if r == 0 else 0.0))]
        pick = pick[guess[pick] > FIRST_GUESS / 2]
        if not len(pick):
            break
        rows = np.concatenate([pick, clean])
        y = np.concatenate([np.ones(len(pick)), np.zeros(len(clean))])
        # Labels of clean documents err now and then; a window that scores high in one is not insisted on.
        doubt = score[clean] > (np.quantile(guess[pick], 0.5) if r == 0 else 3.0)
        weight = np.concatenate([np.full(len(pick), min(40.0, max(1.0, 0.15 * len(clean) / len(pick)))), np.where(doubt, 0.3, 1.0)])
        m = Machine()
        m.known = known
        m.v[~known[0]] = 0
        m.fit(x, rows, y, weight)
        score = m.logits(x)
    return m


def _score(m: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                rb = whole.slice(at, 500)
                texts = [t or "" for t in rb.column("text").to_pylist()]
                x = windows(texts)
                top, _ = worst(x, m.logits(x), len(texts))
                yield pa.RecordBatch.from_arrays([rb.column("id"), pa.array(1 / (1 + np.exp(-np.clip(top, -50, 50))))], ["id", "score"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> Machine:
    """A machine trained on at most ``limit`` labelled documents, those of the smallest hash of their id.

    A document is bad if half or more of its non-null labels are other than ``none``; unknown labels count as bad, null
    labels not at all. Labels of unknown documents and labelled documents without text teach nothing.
    """
    lab = labels.filter("content_label is not null").groupBy(F.col("doc_id").alias("id")).agg(F.avg((F.lower(F.trim("content_label")) != "none").cast("int")).alias("bad"))
    ids = docs.select(F.col(id_col).alias("id")).filter("id is not null").distinct().join(lab.hint("merge"), "id").orderBy(F.xxhash64("id"), "id").limit(limit)
    # At most ``limit`` ids go out to the texts; texts are read where they are, and one task fits the machine to what was read.
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(ids), "id")
    kind = sample.schema["id"].dataType.simpleString()
    read = sample.mapInArrow(_read_task, f"id {kind}, bad double, begin binary, end binary, word binary, pair binary")
    read = read.groupBy("id").agg(F.min(F.struct("bad", "begin", "end", "word", "pair")).alias("r")).select("id", "r.*")
    got = read.coalesce(1).sortWithinPartitions(F.xxhash64("id"), "id").mapInArrow(_train_task, "bias double, w binary, p binary, v binary").collect()
    m = Machine()  # what came back has the fixed size of the tables
    if got:
        m.bias, m.w, m.p = got[0].bias, np.frombuffer(got[0].w, np.float32), np.frombuffer(got[0].p, np.float32)
        m.v = np.frombuffer(got[0].v, np.float32).reshape(-1, FACTORS)
    else:
        m.v[:] = 0
    return m


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each text, as bytes of their arrays."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            rb = whole.slice(at, 500)
            x = _windows(rb.column("text").to_pylist())
            first = np.searchsorted(x.text, np.arange(rb.num_rows + 1))
            token = np.append(x.begin, len(x.word))[first]  # where the tokens of each text begin
            rows = [[(a[first[i] : first[i + 1]] - token[i]).astype(np.int32).tobytes() for a in (x.begin, x.end)] + [a[token[i] : token[i + 1]].tobytes() for a in (x.word, x.pair)] for i in range(rb.num_rows)]
            cols = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("bad"), *(pa.array(list(c), pa.binary()) for c in cols)], ["id", "bad", "begin", "end", "word", "pair"])


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bad, parts = [], {c: [] for c in ("begin", "end", "word", "pair")}
    for rb in batches:
        bad += [b >= 0.5 for b in rb.column("bad").to_pylist()]
        for c, held in parts.items():
            held += [np.frombuffer(b, np.int32) for b in rb.column(c).to_pylist()]
    if bad:
        n, tokens = (np.array([len(x) for x in parts[c]], np.int64) for c in ("begin", "word"))
        base = np.repeat(np.cumsum(tokens) - tokens, n)
        begin, end, word, pair = (np.concatenate(parts[c]) for c in parts)
        m = train(Windows(begin + base, end + base, np.repeat(np.arange(len(bad)), n), word, pair), np.array(bad, bool))
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), *(pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (m.w, m.p, m.v))], ["bias", "w", "p", "v"])


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every document, from its whole text.

    Null, empty and blank texts score 0. Without a single labelled document to learn from, every other text scores 0.5, as
    nothing speaks for either side. Every row comes out once, repeated rows as often as they come in; other columns are dropped.
    """
    m = fitted(docs, labels, id_col, text_col)
    machine = docs.sparkSession.sparkContext.broadcast(m)  # of fixed size: 2**BITS rows
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _score(machine.value)(batches)

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def rates(docs: DataFrame, scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source (spelled evenly, null a source of its own): documents, flagged ones, their share and the mean score."""
    rows = docs.select("doc_id", norm_label(F.col("source")).alias("source")).join(scores, "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= threshold).alias("flagged"), F.avg((F.col("score") >= threshold).cast("int")).alias("rate"), F.avg("score").alias("mean_score"))
