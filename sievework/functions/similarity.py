"""String similarity as published: Ratcliff-Obershelp ratio through the standard library, best-window partial ratio."""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np

# Words of education, of institutions, of shared context, and what stands for what.
EDUCATION = [
    "grade", "school", "university", "college", "education", "academic", "semester", "year", "gpa", "score", "achievement",
    "degree", "diploma", "transcript", "course", "class", "subject", "major", "minor",
]
INSTITUTIONS = ["school", "university", "college", "institute", "academy"]
CONTEXT = ["session", "event", "conference", "meeting"]
SYNONYMS = {
    "university": ["college", "univ"],
    "college": ["university", "univ"],
    "gpa": ["grade", "performance", "academic"],
    "grade": ["gpa", "performance", "academic"],
    "performance": ["gpa", "grade", "academic"],
    "academic": ["gpa", "grade", "performance"],
}


_LOST, _WHOLE = re.compile(r"(\d+)?(st|nd|rd|th)(\s+\w+)?"), re.compile(r"\b\d+(st|nd|rd|th)\s*")
_BASE, _NUMBER = re.compile(r"\b\d*(st|nd|rd|th)\b"), re.compile(r"\b(\d+(?:\.\d+)?)%?\b")
_KIN = {w for a, bs in SYNONYMS.items() for w in (a, *bs)}


@lru_cache(maxsize=65536)
def raw_ratio(a: str, b: str) -> float:
    """Ratio of matching characters, in the argument order given (it is not symmetric)."""
    return SequenceMatcher(None, a, b).ratio()


def similarity(a: str | None, b: str | None) -> float:
    """`raw_ratio` without case and margins; 0 if either is empty or null, 1 if equal."""
    x, y = (a or "").lower().strip(), (b or "").lower().strip()
    if not a or not b:
        return 0.0
    return 1.0 if x == y else raw_ratio(x, y)


def partial_ratio(a: str | None, b: str | None) -> float:
    """100 * the best ratio of the shorter string with a window of its length in the longer; 0 if either is empty or null.

    Windows begin where a block of matching characters aligns them, as in the published definition.
    """
    short, long = sorted((a or "", b or ""), key=len)
    if not short:
        return 0.0
    best = 0.0
    for i, j, n in SequenceMatcher(None, short, long).get_matching_blocks():
        at = max(0, j - i)
        best = max(best, SequenceMatcher(None, short, long[at : at + len(short)]).ratio())
        if best > 0.995:
            return 100.0
    return 100 * best


class Needle:
    """A text to be looked for among many: `partial_ratio` is only worked out where the longest common subsequence allows it."""

    def __init__(self, text: str):
        self.text = text
        self.at: dict[str, int] = {}
        for i, c in enumerate(text):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def common(self, other: str) -> int:
        """Length of the longest common subsequence, by bits: matching blocks, being in order, never hold more characters."""
        full = v = (1 << len(self.text)) - 1
        for c in other:
            u = v & self.at.get(c, 0)
            v = ((v + u) | (v - u)) & full
        return len(self.text) - v.bit_count()

    def best(self, others: list[str], least: float) -> tuple[int, float]:
        """The first of ``others`` with the highest partial ratio above ``least``, and the ratio; -1 if none has."""
        where, top = -1, least
        for i, other in enumerate(others):
            short, n = min(len(self.text), len(other)), self.common(other)
            # A window is as long as the shorter text, or at the end of the longer one shorter, but no shorter than what matches.
            score = partial_ratio(self.text, other) if short and 200 * n / (short + n) > top else 0.0
            if score > top:
                where, top = i, score
        return where, top


_BINS = 64


def bags(texts: list[str]) -> np.ndarray:
    """How often characters fall into each of a fixed number of bins, one row a text, in the smallest type that holds the counts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    n = np.bincount(own * _BINS + codes % _BINS, minlength=len(texts) * _BINS).reshape(len(texts), _BINS)
    return n.astype(np.min_scalar_type(n.max(initial=0)))


def shared(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What rows ``a`` of one table of counts and rows ``b`` of another have in common at most, pair by pair."""
    parts = [np.minimum(x[a[i : i + _PAIRS]], y[b[i : i + _PAIRS]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), _PAIRS)]
    return np.concatenate(parts or [np.zeros(0, np.int64)])


def sets(items: list) -> np.ndarray:
    """How many elements of each set fall into each bin by hash."""
    n = np.array([np.bincount([hash(x) % _BINS for x in xs], minlength=_BINS) if xs else np.zeros(_BINS, np.int64) for xs in items], np.int64).reshape(len(items), _BINS)
    return n.astype(np.min_scalar_type(n.max(initial=0)))


_PAIRS = 50_000  # pairs whose counts are held at a time
_WIDEST = 16  # words of 64 bits a text's positions are looked at in; longer texts are bounded by their bags alone


class Texts:
    """Texts as numbers, for upper bounds of the `raw_ratio` of many pairs at a time, each bound tighter and dearer than the one before."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.n = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.codes = (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % _BINS).astype(np.int64)
        self.bags = bags(texts)

    def by_length(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.ratio(a, b, np.minimum(self.n[a], self.n[b]))

    def by_bag(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.ratio(a, b, shared(self.bags, a, self.bags, b))

    def by_order(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """By the longest common subsequence: matching blocks, being in order, never hold more characters."""
        return self.ratio(a, b, self.common(a, b))

    def ratio(self, a: np.ndarray, b: np.ndarray, matched: np.ndarray) -> np.ndarray:
        """1 for two empty texts."""
        total = self.n[a] + self.n[b]
        return np.where(total > 0, 2 * matched / np.maximum(total, 1), 1.0) + 1e-9

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of bins (see `Needle.common`); of very long texts the shorter one's length."""
        a, b = np.where(self.n[a] > self.n[b], b, a), np.where(self.n[a] > self.n[b], a, b)
        out, wide, least = self.n[a].copy(), (self.n[a] + 63) >> 6, 0
        while least < _WIDEST:
            most = max(1, 2 * least)
            at = np.flatnonzero((wide > least) & (wide <= most))
            for i in range(0, len(at), _PAIRS // most):
                part = at[i : i + _PAIRS // most]
                out[part] = self._in_order(a[part], b[part], most)
            least = most
        return out

    def _in_order(self, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
        rows, own = np.unique(a, return_inverse=True)
        masks, n, first = np.zeros((len(rows) * _BINS, width), np.uint64), self.n[rows], self.first[rows]
        for p in range(int(n.max())):
            k = np.flatnonzero(n > p)
            masks[k * _BINS + self.codes[first[k] + p], p >> 6] |= np.uint64(1 << (p & 63))
        # The longest first, so that those still being read stand together.
        order = np.argsort(-self.n[b], kind="stable")
        base, at, n = own[order] * _BINS, self.first[b][order], self.n[b][order]
        v = np.full((width, len(a)), ~np.uint64(0))
        still = np.searchsorted(-n, -np.arange(int(n[0])), side="left")
        for p, k in enumerate(still.tolist()):
            held = masks[base[:k] + self.codes[at[:k] + p]]
            carry = np.zeros(k, np.uint64)
            for w in range(width):
                old, has = v[w, :k], held[:, w]
                one = old + (old & has)
                new = one + carry
                carry = ((one < old) | (new < one)).astype(np.uint64)
                v[w, :k] = new | (old & ~has)
        out = np.empty(len(a), np.int64)
        out[order] = width * 64 - np.bitwise_count(v).sum(axis=0, dtype=np.int64)
        return out


@lru_cache(maxsize=1024)
def _matcher(b: str) -> SequenceMatcher:
    return SequenceMatcher(None, "", b)


def reaches(a: str, b: str, enough: Callable[[float], bool]) -> bool:
    """``enough(raw_ratio(a, b))`` of a test that holds for all ratios beyond one it holds for; ends as soon as it does."""
    m, total, matched, open_ = _matcher(b), len(a) + len(b), 0, [(0, len(a), 0, len(b))]
    if not total:
        return enough(1.0)
    m.set_seq1(a)
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        i, j, n = m.find_longest_match(alo, ahi, blo, bhi)
        if n:
            matched += n
            if enough(2.0 * matched / total):
                return True
            if alo < i and blo < j:
                open_.append((alo, i, blo, j))
            if i + n < ahi and j + n < bhi:
                open_.append((i + n, ahi, j + n, bhi))
    return enough(2.0 * matched / total)


class Rules:
    """When two entries say the same. ``compat`` reads years as their century and percentages only before a word character,
    as the replaced implementation did; the default reads whole years and any percentage.
    """

    def __init__(self, threshold: float = 0.85, compat: bool = False):
        self.threshold = threshold
        self.years = re.compile(r"\b(19|20)\d{2}\b" if compat else r"\b(?:19|20)\d{2}\b")
        self.percents = re.compile(r"\b\d+%\b" if compat else r"\b\d+%")
        self.scores = re.compile(r"\b\d+(\.\d+)?%\b" if compat else r"\b\d+(\.\d+)?%")

    def share_figures(self, a: str, b: str) -> bool:
        """A year or a percentage in common."""
        return any(set(p.findall(a)) & set(p.findall(b)) for p in (self.years, self.percents))

    def corrupted_ordinal(self, k1: str, k2: str, v1: str, v2: str) -> bool:
        """One key is the other with its ordinal's number, or the whole ordinal, lost, and values share a figure."""
        if not self.share_figures(v1, v2):
            return False
        m1, m2 = (_LOST.search(k) for k in (k1, k2))
        if m1 and m2 and m1.group(2, 3) == m2.group(2, 3) and bool(m1.group(1)) != bool(m2.group(1)):
            return True
        for full, part in ((k1, k2), (k2, k1)):
            bare = _WHOLE.sub("", full).strip()
            if bare and similarity(bare, part) > 0.8:
                return True
        return False

    def is_education(self, key: str, value: str) -> bool:
        both = f"{key} {value}"
        # The words first, two of which patterns ask for; no pattern is looked for without a sign it needs.
        return bool(
            any(w in both for w in EDUCATION)
            or ("level" in both and re.search(r"\b\d+(st|nd|rd|th)\s*(grade|year|level)\b", both))
            or (("-" in value or "/" in value) and re.search(r"\b(19|20)\d{2}[-/](19|20)?\d{2}\b", value))
            or ("%" in value and self.scores.search(value))
        )

    def education_score(self, k1: str, k2: str, v1: str, v2: str) -> float:
        """Points for lost ordinals, like base keys, common years, institutions, synonyms and near figures; at most 1."""
        score = 0.6 if self.corrupted_ordinal(k1, k2, v1, v2) else 0.0
        b1, b2 = (_BASE.sub("", k).strip() for k in (k1, k2))
        score += 0.5 if b1 and b2 and similarity(b1, b2) > 0.8 else 0.0
        y1, y2 = set(self.years.findall(v1)), set(self.years.findall(v2))
        score += 0.3 * len(y1 & y2) / len(y1 | y2) if y1 and y2 else 0.0
        if any(w in k1 and w in k2 for w in INSTITUTIONS):
            score += 0.2 * similarity(k1, k2)
        like = sum(1 if a == b else 0.8 if b in SYNONYMS.get(a, ()) else 0 for a in set(k1.split()) for b in set(k2.split()))
        score += min(0.3, 0.15 * like)
        n1, n2 = ([float(x) for x in _NUMBER.findall(v)] for v in (v1, v2))
        if n1 and n2:
            mean = sum(abs(a - b) for a in n1 for b in n2) / (len(n1) * len(n2))
            score += 0.1 * max(0.0, 1 - mean / 100)
        return min(1.0, score)

    def possible(self, left: list[dict], right: list[dict]) -> np.ndarray:
        """`may_be_alike` of each prepared entry of ``left`` with each of ``right``."""
        a, b = (x.ravel() for x in np.indices((len(left), len(right))))
        return self.may_be_alike([*left, *right], a, b + len(left)).reshape(len(left), len(right))

    def may_be_alike(self, es: list[dict], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs (``a``, ``b``: places in ``es``) of prepared entries `alike` can hold for, from upper bounds of its ratios, many
        pairs at a time; bounds get tighter step by step, over what the ones before left open.
        """
        t, names = self.threshold, ("norm", "key", "value", "signature")
        low = {c: [e[c].lower() for e in es] for c in names}
        texts = {c: Texts([x.strip() for x in low[c]]) for c in names}
        said, taught = (np.array([bool(e[c]) for e in es], bool) for c in ("comments", "education"))
        lost, both = self._may_be_lost(low["key"], low["value"], texts["key"], a, b), taught[a] & taught[b]
        school = np.zeros(len(a))
        school[both] = self._most_school(low["key"], low["value"], a[both], b[both], lost[both])
        # `meaning` reads keys and values with their margins, of which bounds say nothing.
        wide = np.array([len(k) != n or len(v) != m for k, v, n, m in zip(low["key"], low["value"], texts["key"].n, texts["value"].n)], bool)
        ok = lost | (school >= 0.4) | wide[a] | wide[b]
        live, bound = np.flatnonzero(~ok), {}
        for step in ("by_length", "by_bag", "by_order"):
            for c in names:
                tight = getattr(texts[c], step)(a[live], b[live])
                bound[c] = np.minimum(bound[c], tight) if c in bound else tight
                if len(bound) < len(names):
                    continue
                key, value, s = bound["norm"], bound["value"], 0.1 * (said[a[live]] & said[b[live]])
                meaning = 0.7 * bound["key"] + 0.3 * value
                stay = (bound["signature"] >= t) | ((key >= 0.9) & (value >= 0.7)) | (meaning >= 0.8) | ((s > 0) & (key >= 0.75))
                stay |= 0.4 * key + 0.3 * value + 0.2 * meaning + s >= 0.9 * t
                stay |= both[live] & (0.3 * key + 0.2 * value + 0.15 * meaning + 0.25 * school[live] + s >= 0.9 * t)
                live, bound = live[stay], {c: x[stay] for c, x in bound.items()}
        ok[live] = True
        return ok

    def _may_be_lost(self, keys: list[str], values: list[str], key: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs `corrupted_ordinal` can hold for: those with a figure in common, up to chance, and keys that allow it."""
        places: dict[tuple, int] = {}
        place = lambda x: places.setdefault(x, len(places) + 1)
        held = np.zeros(len(keys), np.uint64)
        for i, v in enumerate(values):
            years = set(self.years.findall(v)) if "19" in v or "20" in v else ()
            for x in (*(("year", y) for y in years), *(("percent", p) for p in (set(self.percents.findall(v)) if "%" in v else ()))):
                held[i] |= np.uint64(1 << place(x) % 64)
        out = np.zeros(len(a), bool)
        at = np.flatnonzero(held[a] & held[b])
        if not len(at):
            return out
        kind, full, rest = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), []
        for i, k in enumerate(keys):
            m = _LOST.search(k)
            if m:
                kind[i], full[i] = place(m.group(2, 3)), bool(m.group(1))
            rest.append(_WHOLE.sub("", k).strip() if m else k.strip())
        x, y = a[at], b[at]
        whole = Texts(rest)
        like = lambda x, y: 2 * shared(whole.bags, x, key.bags, y) / np.maximum(whole.n[x] + key.n[y], 1) + 1e-9
        out[at] = ((kind[x] > 0) & (kind[x] == kind[y]) & (full[x] != full[y])) | (like(x, y) > 0.8) | (like(y, x) > 0.8)
        return out

    def _most_school(self, keys: list[str], values: list[str], a: np.ndarray, b: np.ndarray, lost: np.ndarray) -> np.ndarray:
        """The most points that each pair of entries about education can have (see `education_score`)."""
        rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = at[: len(a)], at[len(a) :]
        keys, values = ([x[i] for i in rows] for x in (keys, values))
        base = Texts([_BASE.sub("", k).strip() for k in keys]).by_bag(a, b) > 0.8
        flag = lambda f, of: np.array([bool(f(x)) for x in of], bool)
        named = flag(lambda k: any(w in k for w in INSTITUTIONS), keys)
        words = [set(k.split()) for k in keys]
        kin = np.array([len(_KIN & w) for w in words], np.int64)
        held, years = sets(words), sets([set(self.years.findall(v)) for v in values])
        like = shared(held, a, held, b) + 0.8 * kin[a] * kin[b]
        numbers = flag(_NUMBER.search, values)
        points = 0.6 * lost + 0.5 * base + 0.3 * (shared(years, a, years, b) > 0) + 0.2 * (named[a] & named[b]) + np.minimum(0.3, 0.15 * like) + 0.1 * (numbers[a] & numbers[b])
        return np.minimum(1.0, points) + 1e-9

    def similar(self, es: list[dict], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs (places in ``es``) of prepared entries are `alike`."""
        out = self.may_be_alike(es, a, b)
        for i in np.flatnonzero(out).tolist():
            one, two = es[a[i]], es[b[i]]
            out[i] = self._means_the_same(one, two) or self.alike(one, two)
        return out

    def _means_the_same(self, e1: dict, e2: dict) -> bool:
        """Two of the tests of `alike`, equal signatures and like meaning, without working out more of the values' ratio than decides."""
        if e1["signature"] == e2["signature"] and similarity(e1["signature"], e2["signature"]) >= self.threshold:
            return True
        key = 0.7 * raw_ratio(e1["key"].lower(), e2["key"].lower())
        return key + 0.3 >= 0.8 and reaches(e1["value"].lower(), e2["value"].lower(), lambda r: key + 0.3 * r >= 0.8)

    def alike(self, e1: dict, e2: dict) -> bool:
        """The decision over two prepared entries (see `prepare`): any of six tests, the cheap ones first."""
        t = self.threshold
        if similarity(e1["signature"], e2["signature"]) >= t:
            return True
        key, value = similarity(e1["norm"], e2["norm"]), similarity(e1["value"], e2["value"])
        if key >= 0.9 and value >= 0.7:
            return True
        k1, k2, v1, v2 = e1["key"].lower(), e2["key"].lower(), e1["value"].lower(), e2["value"].lower()
        meaning = 0.95 if self.corrupted_ordinal(k1, k2, v1, v2) else 0.7 * raw_ratio(k1, k2) + 0.3 * raw_ratio(v1, v2)
        if meaning >= 0.8:
            return True
        school = self.education_score(k1, k2, v1, v2) if e1["education"] and e2["education"] else 0.0
        if school >= 0.4:
            return True
        context = 0.0
        c1, c2 = e1["comments"].lower(), e2["comments"].lower()
        if c1 and c2:
            context = min(1.0, similarity(c1, c2) + (0.2 if any(w in c1 and w in c2 for w in CONTEXT) else 0.0))
        if context >= 0.7 and key >= 0.75:
            return True
        if school > 0:
            total = key * 0.3 + value * 0.2 + meaning * 0.15 + school * 0.25 + context * 0.1
        else:
            total = key * 0.4 + value * 0.3 + meaning * 0.2 + context * 0.1
        return total >= 0.9 * t
