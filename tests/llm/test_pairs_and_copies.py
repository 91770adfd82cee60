"""Near-duplicates and formatting duplicates against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from sievework.llm import canonical, near_dups
from sievework.llm.bagminhash import arrivals, signatures

RUN = re.compile(r"[^\W_]+")


def bare(s):
    return "".join(RUN.findall((s or "").lower()))


def fields(v):
    parts = [p for p in re.split(r"[;|\r\n]+", v) if p.strip()]
    if len(parts) < 2 or not all(":" in p and p.split(":")[0].strip() for p in parts):
        return None
    return sorted((bare(p.split(":", 1)[0]), bare(p.split(":", 1)[1])) for p in parts)


def equal(a, b):
    f = fields(a[1])
    return bare(a[0]) == bare(b[0]) and (bare(a[1]) == bare(b[1]) or (f is not None and f == fields(b[1])))


def brute_pairs(rows, least=0.7):
    recs = {}
    for i, k, v in rows:
        if v is not None and len(RUN.findall(v)) >= 12:
            recs[i] = (k or "", v, set(RUN.findall(v.lower())) | set(RUN.findall((k or "").lower())))
    ids = sorted(recs)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 10 * len(recs[a][2] & recs[b][2]) >= 10 * least * len(recs[a][2] | recs[b][2]) - 1e-9 and not equal(recs[a], recs[b])}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**31, 60)
    b = np.concatenate([a[:40], rng.integers(0, 2**31, 20)])
    level = np.zeros(120, np.uint8)
    level[:20] = level[60:80] = 2
    s = signatures(np.array([0, 60, 120]), np.concatenate([a, b]).astype(np.uint64), level, 2000)
    assert abs((s[0] == s[1]).mean() - (20 / 4 + 20) / (20 / 4 + 20 + 40)) < 0.04
    alone = signatures(np.array([0, 60]), a.astype(np.uint64), level[:60], 2000)
    assert (alone[0] == s[0]).all()  # a signature does not depend on what else is in the batch
    assert np.isinf(signatures(np.array([0, 0]), np.zeros(0, np.uint64), np.zeros(0, np.uint8), 8)).all()


def test_signatures_of_very_long_bags():
    """Bags of more words than are folded at once have the minima over all their words."""
    rng = np.random.default_rng(2)
    size = np.array([3, 0, 700, 40_000, 1, 600])
    starts, words = np.concatenate([[0], np.cumsum(size)]), rng.permutation(1 << 20)[: size.sum()].astype(np.uint64)
    level = rng.integers(0, 3, len(words)).astype(np.uint8)
    s = signatures(starts, words, level, 16)
    for i in range(len(size)):
        own = slice(starts[i], starts[i + 1])
        assert (s[i] == arrivals(words[own], level[own], 16).min(axis=0, initial=np.inf)).all()


def test_near_duplicates_recall_and_precision(spark, small):
    df = spark.read.parquet(f"{small}/../sf0.01/entries.parquet")
    rows = {r.entry_id: (r.entry_id, r.entry_key, r.entry_value) for r in df.select("entry_id", "entry_key", "entry_value").collect()}
    some = sorted(rows)[:1500]
    want = brute_pairs([rows[i] for i in some])
    got = {tuple(r) for r in near_dups.near_duplicate_pairs(df.filter(df.entry_id <= some[-1])).collect()}
    assert not got - want and len(got) >= 0.97 * len(want) and want


@pytest.mark.parametrize("hot", [16, 100_000])
def test_near_duplicates_of_one_large_family(entries, hot):
    """A family of near-copies holds a third of the rows, so that its words are the most common of all."""
    rng = random.Random(4)
    family = [f"shared{i}" for i in range(29)]
    rows = []
    for i in range(300):
        words = [f"word{rng.randrange(4000)}" for _ in range(29)]
        if i % 3 == 0:
            words = list(family)
            for at in rng.sample(range(29), 2):
                words[at] = f"edit{rng.randrange(10**6)}"
        rows.append((i, "s", "k", " ".join(words)))
    want = brute_pairs([(r[0], r[2], r[3]) for r in rows])
    own = near_dups.records(near_dups.texts(entries(rows), "entry_id", "entry_key", "entry_value", 12), 12)
    assert len(want) == 100 * 99 // 2
    assert near_dups.similar_classes(own, hot=hot).count() >= 0.99 * len(want)
    got = {tuple(r) for r in near_dups.near_duplicate_pairs(entries(rows)).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_hot_buckets_find_what_others_find(entries):
    """Which pairs come out does not depend on the size from which buckets are compared in blocks."""
    rng = random.Random(6)
    rows = [(i, "s", "k", " ".join(rng.sample([f"w{j}" for j in range(26 + i % 2)], 20))) for i in range(150)]
    own = near_dups.records(near_dups.texts(entries(rows + rows[:20]), "entry_id", "entry_key", "entry_value", 12), 12)
    found = [{(tuple(r.a), tuple(r.b)) for r in near_dups.similar_classes(own, bands=3, band_rows=2, hot=hot).collect()} for hot in (7, 40, 100_000)]
    assert found[0] and found[0] == found[1] == found[2]


def test_near_duplicates_of_one_form_in_a_third_of_the_rows(entries):
    """Copies of one form never meet each other; its few variants meet all of them, under several keys."""
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(i, "s", "k", words.title() if i % 2 else words + ".") for i in range(60)] + [(60 + i, "s", "k", " ".join(f"x{i}y{j}" for j in range(14))) for i in range(100)]
    rows += [(200, "s", "k", words + " more"), (201, "s", "k", " ".join(reversed(words.split())))]
    want = brute_pairs([(r[0], r[2], r[3]) for r in rows])
    assert len(want) == 60 * 2 + 1
    for spread in (7, 100_000):
        assert {tuple(r) for r in near_dups.near_duplicate_pairs(entries(rows), spread=spread).collect()} == want


def test_near_duplicates_of_odd_rows(entries):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "s", "k", words), (2, "t", "k", words + " more"), (2, "t", "k", words + " more"), (3, "t", None, words.upper() + "."), (4, None, "k", None), (5, "s", "", ""), (6, "s", "k", "none"), (7, "s", "k", long), (8, "s", "k", long + " end"), (9, "s", "k", "twelve short words"), (10, "s", "k", " ".join(reversed(words.split())))]
    got = {tuple(r) for r in near_dups.near_duplicate_pairs(entries(rows)).collect()}
    assert got == brute_pairs([(r[0], r[2], r[3]) for r in rows])
    groups = {r.id: (r.group, r.links) for r in near_dups.near_duplicate_groups(entries(rows)).collect()}
    assert groups[2][0] == 1 and groups[8] == (7, 1) and groups[10][0] == 1 and 9 not in groups
    assert near_dups.near_duplicate_pairs(entries([])).count() == 0
    assert near_dups.near_duplicate_pairs(entries([(1, "s", "k", None)])).count() == 0


def test_formatting_copies_against_brute_force(entries):
    rng = random.Random(2)
    base = ["Code: AB-1234; Lot: xy-77; Place: Main Hall", "The quick brown fox jumps over dogs", "name: a long value | other: more text here", "0123456789 0123456789"]

    def vary(v):
        if ":" in v and rng.random() < 0.5:
            parts = re.split(r"[;|]", v)
            rng.shuffle(parts)
            v = ";".join(parts)
        return rng.choice([str.upper, str.lower, lambda x: x.replace(" ", "  "), lambda x: x.replace("-", "."), lambda x: x + " !"])(v)

    rows = [(i, "s", rng.choice(["Key", "k e y", None, "other"]), vary(rng.choice(base))) for i in range(120)]
    rows += [(200, "s", "Key", "short"), (201, "s", "Key", None), (202, "s", "Key", "missing"), (203, "s", "Key", " "), rows[3], rows[3]]
    recs = {r[0]: (r[2] or "", r[3]) for r in rows if r[3] and len(bare(r[3])) >= 20}
    lead = {}
    for i in sorted(recs):
        lead[i] = next((lead[j] for j in sorted(lead) if equal(recs[i], recs[j])), i)
    want = {(i, lead[i], list(lead.values()).count(lead[i])) for i in lead if list(lead.values()).count(lead[i]) > 1}
    assert {tuple(r) for r in canonical.collapse_formatting(entries(rows)).collect()} == want
    assert canonical.collapse_formatting(entries([])).count() == 0


def test_sets_are_closed_under_both_relations(entries):
    """One plain form, read as two different lists, joins the sets of both."""
    a, b = "aa: bbbbbbbbbbb; cc: ddddddddddd", "aa: bbbbbbbbbbb cc; ddddddddddd: x"
    rows = [(1, "s", "k", a), (2, "s", "k", "cc: ddddddddddd; aa: bbbbbbbbbbb"), (3, "s", "k", a.replace(";", ",")), (4, "s", "k", b)]
    got = {r.id: r.first for r in canonical.collapse_formatting(entries(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("value,same", [("a: 1; b: 2", "b: 2 | a: 1"), ("a: 1\nb: 2", "B:2;A:1")])
def test_field_hash(value, same):
    assert near_dups.field_hash("K", value) == near_dups.field_hash("k!", same) is not None
    assert near_dups.field_hash("k", "a: 1") is None and near_dups.field_hash("k", "a: 1; b") is None
