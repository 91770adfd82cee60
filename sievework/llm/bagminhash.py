"""BagMinHash: signatures whose components agree with the probability of the weighted Jaccard similarity of two bags.

Each word owns a Poisson process over (time, component, weight), the same in every record. The weight axis is discretised
into the dyadic intervals (2**-(t+1), 2**-t], so a word of weight 2**-k sees the points of intervals t >= k. A component's
value is the time of its first visible point over all words of the record. First points are drawn once for each word of a
batch, for all its components together, and records take minima over the rows of their words.
"""

from __future__ import annotations

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PART = 1 << 15  # words whose times are held at once
_LONG = 512  # words of a bag that are folded together with those of others


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def arrivals(words: np.ndarray, level: np.ndarray, m: int) -> np.ndarray:
    """Time of the first visible point of each word's process in each of ``m`` components, at weight ``2**-level``.

    The process is split from the top: of the first point on (0, 2**-i] half are above 2**-(i+1) and not seen by lower weights,
    for which the first point on the lower half comes later by an independent gap of twice the mean.
    """
    base = words.astype(np.uint64)[:, None] * _GOLD + np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    time = None
    for i in range(int(level.max(initial=0)) + 1):
        h = mix(base + np.full(1, i, np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
        gap = ((h >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
        np.log(gap, out=gap)
        gap *= np.float32(-(2.0**i))
        if time is None:
            time = gap
        else:
            time = np.where((level >= i)[:, None] & upper, time + gap, time)
        upper = (h & np.uint64(1)).astype(bool)  # the point just drawn, or kept, lies in the upper half
    return time


def signatures(starts: np.ndarray, words: np.ndarray, level: np.ndarray, m: int) -> np.ndarray:
    """Signature (float32, ``m`` columns) of each bag: words ``words[starts[i]:starts[i+1]]`` of weight ``2**-level``.

    Empty bags have infinite components, which agree with nothing by convention. Words of a bag must differ and be below 2**60.
    Bags are taken together, longest first, one word of each at a time; the rest of a very long bag is folded by itself.
    """
    n = len(starts) - 1
    out = np.full((n, m), np.inf, np.float32)
    if not len(words):
        return out
    uniq, which = np.unique((words.astype(np.uint64) << np.uint64(4)) | level.astype(np.uint64), return_inverse=True)
    size = np.diff(starts)
    order = np.argsort(-size, kind="stable")
    size, first = size[order], starts[:-1][order]
    held = np.full((n, m), np.inf, np.float32)
    for lo in range(0, len(uniq), _PART):  # so that the times of a batch's words are bounded
        part = uniq[lo : lo + _PART]
        time = arrivals(part >> np.uint64(4), (part & np.uint64(15)).astype(np.uint8), m)
        if len(uniq) > _PART:
            own = np.flatnonzero((which >= lo) & (which < lo + _PART))
            bag = np.searchsorted(starts, own, "right") - 1
            edge = np.flatnonzero(np.diff(bag, prepend=-1))
            for i in range(0, len(edge), 8):
                stop = edge[i + 8] if i + 8 < len(edge) else len(own)
                low = np.minimum.reduceat(time[which[own[edge[i] : stop]] - lo], edge[i : i + 8] - edge[i], axis=0)
                out[bag[edge[i : i + 8]]] = np.minimum(out[bag[edge[i : i + 8]]], low)
            continue
        row = np.empty((n, m), np.float32)
        for p in range(int(min(size[0], _LONG))):
            k = int(np.searchsorted(-size, -p, "left"))
            np.take(time, which[first[:k] + p], axis=0, out=row[:k], mode="clip")
            np.minimum(held[:k], row[:k], out=held[:k])
        for i in range(int(np.searchsorted(-size, -_LONG, "left"))):
            for at in range(first[i] + _LONG, first[i] + size[i], _LONG):
                held[i] = np.minimum(held[i], time[which[at : min(at + _LONG, first[i] + size[i])]].min(axis=0))
        out[order] = held
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per record and band of ``rows`` components."""
    bits = sig[:, : bands * rows].view(np.uint32).reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD), (len(sig), bands)).copy()
    for i in range(rows):
        key = mix(key ^ bits[:, :, i] * _GOLD)
    return key.view(np.int64)
