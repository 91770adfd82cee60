"""Tokens of many texts at once, by array operations over code points instead of a loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sievework.llm.bagminhash import mix

_PRIME = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number modulo 2**64, and of its inverse."""
    if len(_tables[0]) < n:
        for i, base in enumerate((_PRIME, _INVERSE)):
            p = np.full(2 * n, base, np.uint64)
            p[0] = 1
            _tables[i] = np.cumprod(p)
    return _tables[0], _tables[1]


def _alnum() -> np.ndarray:
    """True for letters and digits of any script in the first three planes."""
    import unicodedata

    return np.array([unicodedata.category(chr(i))[0] in "LN" for i in range(0x33480)], bool)


_ALNUM = _alnum()
_POWERS = np.cumprod(np.full(4096, _PRIME, np.uint64))


def is_alnum(codes: np.ndarray) -> np.ndarray:
    return _ALNUM[np.minimum(codes, len(_ALNUM) - 1)]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line break, and where each text begins (one more entry than texts)."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return codes, starts


@dataclass
class Tokens:
    """Runs of letters and digits: ``begin`` and ``end`` in ``codes``, 64-bit ``hash``, and the ``text`` each is from.

    Text i is the codes from ``starts[i]`` to ``stops[i]``.
    """

    codes: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray

    def first(self) -> np.ndarray:
        """Index of each text's first token (one more entry than texts)."""
        return np.searchsorted(self.text, np.arange(len(self.starts) + 1))

    def string(self, i: int) -> str:
        return self.codes[self.begin[i] : self.end[i]].tobytes().decode("utf-32-le", "replace")

    def only(self, keep: np.ndarray) -> Tokens:
        """The tokens of the texts that ``keep`` is true for, numbered anew."""
        sel = keep[self.text]
        return Tokens(self.codes, self.starts[keep], self.stops[keep], self.begin[sel], self.end[sel], self.hash[sel], (np.cumsum(keep) - 1)[self.text[sel]])


def hash_runs(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, over its whole length: a polynomial read off running sums."""
    power, inverse = _powers(len(codes) + 1)
    run = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=run[1:])
    return mix(((run[end] - run[begin]) * inverse[begin]) ^ ((end - begin).astype(np.uint64) << np.uint64(48)))


def tokenize_codes(codes: np.ndarray, starts: np.ndarray) -> Tokens:
    w = is_alnum(codes)
    edge = np.diff(w.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Tokens(codes, starts[:-1], starts[1:], begin, end, hash_runs(codes, begin, end), np.searchsorted(starts, begin, "right") - 1)


def tokenize(texts: list[str]) -> Tokens:
    """Lower-case tokens of all texts."""
    return tokenize_codes(*code_points([t.lower() for t in texts]))


def bare_hashes(tok: Tokens) -> np.ndarray:
    """A 64-bit hash of each text's bare form: its letters and digits without the gaps between them."""
    word = is_alnum(tok.codes)
    at = np.concatenate([[0], np.cumsum(word)])
    return hash_runs(tok.codes[word], at[tok.starts], at[tok.stops])
