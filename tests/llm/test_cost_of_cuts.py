"""What is worked out to find cut values, and that no less is found by it."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from sievework.llm import truncation
from sievework.llm.vectext import tokenize

WORDS = ["alpha", "beta", "gamma", "delta", "Ébauche", "zeta", "eta", "theta", "12", "iota's", "kappa", "lambda"]


def pairs(n: int) -> list[tuple[int, str, str]]:
    rng, out = random.Random(9), []
    for i in range(n):
        full = " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(0, 14)))
        cut = full[: rng.randrange(0, len(full) + 1)] if rng.random() < 0.5 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 8)))
        out.append((i, cut, full))
    return out


def test_few_pairs_are_read_word_by_word(monkeypatch):
    """All that end early are found, and hardly a pair beside them is looked at in full."""
    rows, seen, real = pairs(3000), [], truncation.ends_early
    want = [i for i, a, b in rows if real(a, b)]
    monkeypatch.setattr(truncation, "ends_early", lambda a, b: seen.append(1) or real(a, b))
    rb = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["cut", "cut_value", "full_value"])
    got = [x for part in truncation._align(iter([rb, rb.slice(0, 0)])) for x in part.column(0).to_pylist()]
    assert want and got == want and len(seen) < 0.6 * len(rows)


def test_words_are_counted_once_a_task():
    texts = [" ".join(WORDS[i % 5 :] + WORDS[:3]) for i in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts[i : i + 8])], ["id", "value"]) for i in range(0, 40, 8)]
    rows = [r for b in truncation._word_counts(iter(batches)) for r in b.to_pylist()]
    assert len(rows) == len({r["word"] for r in rows}) and {r["word"]: r["n"] for r in rows}[""] == 40
    assert {r["word"]: r["n"] for r in rows}["beta"] == sum(t.lower().split().count("beta") for t in texts)


def test_known_words_and_their_beginnings(monkeypatch):
    """Known words are found by their places, however crowded these are."""
    vocab = {f"word{chr(97 + i % 26)}{chr(97 + i // 26)}": 10 + i for i in range(300)} | {"wo": 7, "a1": 9}
    looked = [*vocab, "w", "wor", "worda", "a", "unknown", "word1"]
    for bits in (1, 4, 20):
        monkeypatch.setattr(truncation, "_PLACES", bits)
        e, tok = truncation.Endings(vocab, 1000), tokenize(looked)
        at = e.places_of(tok.hash)
        assert [w in vocab for w in looked] == (e.known[at] == tok.hash).tolist()
        # Of words that are no words of letters, beginnings are none.
        assert [w for w, p in zip(looked, e.partial(tok.hash)) if p] == ["w", "wor", "worda"]
    assert not truncation.Endings({}, 0).partial(tok.hash).any() and len(truncation.Endings({}, 0).classes(tok)) == len(looked)


def test_order_of_rows_in_a_bucket_does_not_matter():
    rng = np.random.default_rng(3)
    n = 400
    bucket = np.sort(rng.integers(0, 20, n))
    cols = [pa.array(bucket), pa.array(rng.integers(0, 60, n)), pa.array(rng.integers(4, 9, n).astype(np.int32)), pa.array(np.full(n, -1)), pa.array(np.zeros(n, np.int32))]
    key = np.array(cols[1])
    words = np.array([4 + k % 5 for k in key], np.int32)
    rb = pa.RecordBatch.from_arrays([cols[0], cols[1], pa.array(words), cols[3], cols[4], pa.array(key)], truncation._MEETING)
    order = np.lexsort((key, bucket))
    found = lambda x: sorted((r["cut"], r["full_id"]) for p in truncation._bucket_pairs(1000, 90)(iter([x.slice(i, 90) for i in range(0, n, 90)])) for r in p.to_pylist())
    assert found(rb) == found(rb.take(pa.array(order))) != []


def test_states_of_many_texts_are_those_of_each():
    """Marks, brackets, stops and letters of odd case at the end, short and empty texts, and texts of which others were left out."""
    rng, signs = random.Random(4), ["a", "Z", "7", ".", "!", "...", "…", "(cont", "(", ")", "]", "[", "-", " ", "_", "\n", "İ", "ß", "etc.", "½", "é", "中", "\u0301"]
    texts = ["", "a", ".", "a.", "(a.", "x (cont", "x (continued" + "a" * 60] + ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 9))) for _ in range(3000)]
    assert truncation._states(texts, tokenize(texts)).tolist() == [truncation.state_of(t) for t in texts]
    keep = np.array([i % 3 > 0 for i in range(len(texts))])
    kept = [t for t, k in zip(texts, keep) if k]
    assert truncation._states(kept, tokenize(texts).only(keep)).tolist() == [truncation.state_of(t) for t in kept]
