"""Survivorship, truncation and splitting."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import splitting, survivorship, truncation

TRUST = [("manual", 1), ("llm", 2), ("retry", 2), ("ocr", 4)]


def test_survivors(spark, entries):
    rows = [
        (1, "s", "Key", "abc", "n/a", "llm", 3), (2, "s", "key ", "abcd", None, "ocr", 9), (3, "s", "K-E-Y", "ab cd", "yes", "manual", None), (3, "s", "K-E-Y", "ab cd", "yes", "manual", None),
        (4, "s", "Key", "a longer one that was cu", "later", "manual", 9), (5, "s", "other", "single", "x", "llm", 1), (6, "t", "Key", "none", None, None, 1), (7, "t", "Key", None, "", "x", 2),
        (8, None, "Key", "no session", "c", "llm", 1), (9, None, "Key", "no session", "c", "llm", 1), (10, "u", None, "same", "a", "llm", 2), (11, "u", "", "same", "a", "retry", 2), (12, "u", "--", "same", "a", "ghost", 9),
    ]
    cut = spark.createDataFrame([(4,)], "id long")
    got = survivorship.survivors(entries(rows), spark.createDataFrame(TRUST, "extractor string, trust_rank int"), cut)
    fields = {tuple(r) for r in survivorship.surviving_fields(got).collect()}
    assert fields == {(1, "entry_value", 3), (1, "comments", 4), (10, "entry_value", 10), (10, "comments", 10)}
    whole = {r.group_entry_id: r for r in survivorship.golden_records(entries(rows), got).collect()}
    assert whole[1].entry_value == "ab cd" and whole[1].comments == "later" and whole[6].entry_value is None
    assert survivorship.survivors(entries([]), spark.createDataFrame([], "extractor string, trust_rank int"), cut).count() == 0


def sentences(n, seed=5):
    rng = random.Random(seed)
    nouns = "harbor ledger permit turbine orchard badge report kiosk valve clinic".split()
    verbs = "inspect deliver approve archive repair sample".split()
    return [
        f"The {rng.choice(nouns)} will {rng.choice(verbs)} the {rng.choice(nouns)} before {rng.randrange(1, 28)} May 20{rng.randrange(10, 30)}. "
        f"Please {rng.choice(verbs)} the {rng.choice(nouns)} that Order{i} sent, then {rng.choice(verbs)} the {rng.choice(nouns)}."
        for i in range(n)
    ]


def test_truncation(entries):
    texts = sentences(400)
    rows = [(i, "s", "k", t) for i, t in enumerate(texts)]
    cases = {
        1000: (texts[0][:70], True), 1001: (texts[1][:-1], False), 1002: (texts[2].split(". ")[0] + ".", False), 1003: (texts[3][:60].rstrip() + "...", True), 1004: (texts[4][:61] + " [...]", True),
        1005: ("Please approve the ledger that Order99 sent, then inspect the", True), 1006: ("Please approve the ledger that Order98 sent, then inspect the turb", True), 1007: (texts[5][:-1] + ", etc...", False),
        1008: (None, False), 1009: ("", False), 1010: ("short...", True), 1011: ("missing", False), 1012: (texts[6].split(". ")[0], False), 1014: ("A-", False), 1015: ("...", False), 1013: (texts[7] + " " + "word " * 30_000 + "end.", False),
    }
    rows += [(i, "s", "k", v) for i, (v, _) in cases.items()] + [(1000, "s", "k", cases[1000][0])]
    got = {r.id for r in truncation.truncated(entries(rows)).collect()}
    assert got == {i for i, (_, is_cut) in cases.items() if is_cut}
    assert truncation.truncated(entries([])).count() == 0


def test_truncation_of_short_values(entries):
    """Values of fewer than six words are cut by a mark, inside a word, or against a longer copy; finished ones are not."""
    rows = [(i, "s", "k", t) for i, t in enumerate(sentences(400))]
    rows += [(500 + i, "s", "k", f"Contact: Ana Berg{i}; Code: B{i}; Venue: Hall {i} in the old town") for i in range(100)]
    cases = {
        1000: ("Contact: Ana Orlo; Ven", True), 1001: ("Venue: Hall (cont", True), 1002: ("The harbor will insp", True), 1003: ("Please approve the turb", True), 1004: ("Contact: Ana Berg7; Cod", True),
        1005: ("Contact: Ana Berg7; Code: B7", False), 1006: ("Venue: Hall 7", False), 1007: ("n/a", False), 1008: ("24 May", False), 1009: ("The harbor.", False), 1011: ("Quen", False), 1012: ("Zor Vel Quarnim Dastrel", True),
    }
    rows += [(600, "s", "k", "Zor Vel Quarnim Dastrelian goes on to the harbor.")] + [(i, "s", "k", v) for i, (v, _) in cases.items()]
    why = {r.id: r.why for r in truncation.truncated(entries(rows)).collect()}
    assert set(why) == {i for i, (_, is_cut) in cases.items() if is_cut}
    assert why[1012] == "copy" and why[1001] == "mark" and why[1000] == "word"


def test_hot_buckets_find_what_pairs_find(entries):
    """Texts that share a long opening: the way for hot buckets flags what comparing all pairs flags."""
    opening = "This notice is sent to every member of the association and its branches without exception"
    rng = random.Random(9)
    full = [f"{opening} and concerns case {i} about the {rng.choice(['harbor', 'orchard', 'clinic'])} near station {rng.randrange(99)} as agreed in writing." for i in range(300)]
    cuts = [f[: rng.randrange(40, len(f) - 3)] for f in full[:60]]
    df = entries([(i, "s", "k", t) for i, t in enumerate(full + cuts)])
    values = truncation._values(df, "entry_id", "entry_value")
    by_pairs = {r.key for r in truncation.aligned(values, hot=10_000).collect()}
    assert by_pairs and by_pairs == {r.key for r in truncation.aligned(values, hot=5).collect()}


def test_alignment_finds_what_all_pairs_show(entries):
    """Of cuts at random places, bands and openings find nearly all that any pair gives away; with a word edited, which leaves
    short ones hardly a shingle of five words in common, most.
    """
    rng = random.Random(21)
    full = sentences(320, 8)
    cuts = []
    for i, f in enumerate(full[:240]):
        words = f.split()
        if i % 2:
            words[rng.randrange(len(words))] = "edited"
        text = " ".join(words)
        cuts.append(text[: rng.randrange(25, len(text) - 2)])
    texts = full + [c for c in cuts if truncation.state_of(c) == "open"]
    want = {t for t in texts if truncation.state_of(t) == "open" and any(truncation.ends_early(t, f) for f in texts if f != t)}
    df = entries([(i, "s", "k", t) for i, t in enumerate(texts)])
    got = {r.key for r in truncation.aligned(truncation._values(df, "entry_id", "entry_value")).collect()}
    for edited, least in ((False, 0.97), (True, 0.75)):
        some = sorted(t for t in want if any(f.startswith(t) for f in full) != edited)
        keys = set(truncation._keys(truncation.tokenize(some), np.ones(len(some), bool)).tolist())
        assert len(keys) > 40 and len(got & keys) >= least * len(keys)
    assert len(got) <= len(want)


def test_alignment():
    full = "alpha beta gamma delta epsilon zeta eta theta. iota kappa"
    assert truncation.ends_early("alpha beta gamma delta epsilon ze", full)
    assert truncation.ends_early("alpha beta gamma delta epsilon", full)
    assert not truncation.ends_early("alpha beta gamma delta epsilon zeta eta theta", full)
    assert not truncation.ends_early(full, full) and not truncation.ends_early("other words that are not there", full)


def test_rates(spark, entries):
    df = entries([(1, "s", "k", "v"), (2, "s", "k", "v"), (2, "s", "k", "v")])
    sessions = spark.createDataFrame([("s", (3,)), ("s", (3,)), ("t", None)], "session_id string, dedup_stats struct<truncation_repairs:int>")
    got = truncation.truncation_rates(df, spark.createDataFrame([(2,)], "id long"), sessions).collect()
    assert [(r.source, r.entries, r.cut, r.rate, r.truncation_repairs) for r in got] == [("s", 2, 1, 0.5, 3)]


@given(st.text(alphabet="ab \n.,;\ŕé", max_size=400), st.integers(1, 60), st.integers(-3, 70))
@settings(max_examples=200, deadline=None)
def test_pieces_cover_and_overlap(text, size, overlap):
    spans = splitting.split_spans(text, size, overlap)
    shared = overlap if 0 <= overlap < size else 0
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= size for a, b in spans)
    assert all(nxt[0] == prev[1] - shared and nxt[1] > prev[1] for prev, nxt in zip(spans, spans[1:]))


@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.data())
@settings(max_examples=100, deadline=None)
def test_range_max_breaks_ties_rightward(values, data):
    import numpy as np

    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo, len(values) - 1))
    got = splitting.RangeMax(np.array(values, np.uint8)).best(lo, hi)
    assert got == max(range(lo, hi + 1), key=lambda i: (values[i], i))


def test_natural_boundaries():
    text = "One sentence here. Another one follows it.\n\nA new paragraph begins and goes on"
    assert text[: splitting.split_spans(text, 60, 0)[0][1]].endswith("\n\n")
    with pytest.raises(ValueError):
        splitting.split_spans("x", 0, 0)


def test_split_table(spark):
    chunks = [("s", 1, "h", "1", "word " * 30), ("s", 1, "h", "1", "word " * 30), ("s", 2, None, None, "tiny"), ("s", 3, "h", "2", None), ("t", 1, "h", "1", "x" * 500), ("u", 1, "h", "1", "x" * 500), (None, 1, "h", "1", "x" * 500), ("e", 1, "h", "1", "😀" * 30)]
    limits = [("s", 50, 10), ("s", 50, None), ("t", None, 5), ("e", 29, -1), (None, 5, 0)]
    c = spark.createDataFrame([(*r, "clash", 3) for r in chunks], "session_id string, chunk_id int, header string, page_range string, content string, size string, piece_id int")
    got = splitting.split_oversized(c, spark.createDataFrame(limits, "session_id string, chunk_size int, chunk_overlap int")).collect()
    assert {(r.session_id, r.chunk_id) for r in got} == {("s", 1), ("e", 1)}
    s = sorted((r for r in got if r.session_id == "s"), key=lambda r: r.piece_id)
    assert [r.piece_id for r in s] == list(range(1, s[0].n_pieces + 1)) and all(r.header == "h" for r in s)
    assert all(b.start_char == a.end_char - 10 for a, b in zip(s, s[1:]))
    assert splitting.split_oversized(c.limit(0), spark.createDataFrame(limits, "session_id string, chunk_size int, chunk_overlap int")).count() == 0
