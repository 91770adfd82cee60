"""What the consolidation of entries works out, and that it finds what comparing every pair finds."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from sievework.functions.similarity import Needle, Rules, Texts, raw_ratio, reaches
from sievework.operators import consolidate
from sievework.operators.chunking import semantic_chunks

THINGS = ["ledger", "harvest", "conveyor", "annual report", "kiosk", "blueprint", "portable sensor", "transcript", "northern barn", "licence"]


def sentences(rng: random.Random, n: int, **more) -> list[dict]:
    rows = []
    for i in range(n):
        a, b, c = rng.sample(THINGS, 3)
        key = rng.choice([f"each {a}", "the public", f"please archive {b}", f"{rng.randrange(1, 12)}th grade", "payment of"])
        value = rng.choice([f"from Wexjoro should confirm the {b}, with {rng.randrange(900)} of the {c}", f"{rng.randrange(90)},919 EUR is due on 21 August 20{rng.randrange(18, 25)} unless {a} fails", f"asks for one {c} and {rng.randrange(99)}% of the {a}"])
        rows.append({"key": key, "norm": key.lower(), "value": value, "signature": f"{key}:{value[:50]}".lower(), "comments": rng.choice(["", "", "meeting notes"]), **more})
    return rows


def test_bounds_leave_little_to_be_worked_out():
    """Of entries written alike, hardly more pairs than are alike are left for ratios; no alike one is ruled out."""
    rng = random.Random(5)
    for compat in (False, True):
        rules, rows = Rules(0.85, compat), sentences(rng, 90)
        for e in rows:
            e["education"] = rules.is_education(e["key"].lower(), e["value"].lower())
        a, b = np.triu_indices(len(rows), 1)
        want = np.array([rules.alike(rows[i], rows[j]) for i, j in zip(a, b)])
        open_ = np.triu(rules.possible(rows, rows), 1)[a, b]
        assert want.any() and open_[want].all() and (rules.similar(rows, a, b) == want).all()
        plain = ~np.array([rows[i]["education"] and rows[j]["education"] for i, j in zip(a, b)])
        assert (open_ & plain & ~want).sum() < 0.05 * (plain & ~want).sum()


def test_common_subsequences_of_any_length():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (0, 1, 5, 63, 64, 65, 127, 128, 129, 200, 400, 1000, 1100)]
    a, b = (x.ravel() for x in np.indices((len(texts), len(texts))))
    got = Texts(texts).common(a, b)
    for i, j, n in zip(a, b, got):
        least = Needle(texts[i]).common(texts[j])
        assert n == least if min(len(texts[i]), len(texts[j])) <= 1024 else n >= least


def test_reaches_is_the_ratio():
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab cde") for _ in range(rng.randrange(0, 260))) for _ in range(40)] + ["a" * 250]
    for s in texts:
        for t in texts:
            for least in (0.0, 0.4, raw_ratio(s, t), 1.0):
                assert reaches(s, t, lambda r: r >= least) == (raw_ratio(s, t) >= least)


def test_pairs_against_every_pair(spark, monkeypatch):
    """Small and large groups, groups of one, and batches that end inside a group."""
    monkeypatch.setattr(consolidate, "BLOCK", 7)
    monkeypatch.setattr(consolidate, "ROWS", 10)
    monkeypatch.setattr(consolidate, "PAIRS", 50)
    rng, rows, sizes = random.Random(8), [], {"a": 1, "b": 5, "c": 7, "d": 30, "e": 2, "f": 16}
    for g, n in sizes.items():
        rows += [(g, len(rows) + 1000 * i, e["key"], e["value"], e["comments"]) for i, e in enumerate(sentences(rng, n))]
    df = consolidate.prepared(spark.createDataFrame(rows, "session_id string, entry_id long, entry_key string, entry_value string, comments string"), "session_id", "entry_id")
    rules, es = Rules(), [r.asDict() for r in df.orderBy("o").collect()]
    for e in es:
        e["education"] = rules.is_education(e["key"].lower(), e["value"].lower())
    want = sorted((x["g"], x["o"], y["o"]) for i, x in enumerate(es) for y in es[i + 1 :] if x["g"] == y["g"] and rules.alike(x, y))
    assert want and sorted(tuple(r) for r in consolidate.similar_pairs(df).collect()) == want


def test_entries_are_shuffled_once_and_repeated_ones_are_one(spark):
    df = spark.createDataFrame([("s", i, f"Key {i}", f"value number {i}", None) for i in (1, 2, 3)], "session_id string, entry_id long, entry_key string, entry_value string, comments string")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(consolidate.prepared(df, "session_id", "entry_id"))
    assert consolidate.prepared(df.union(df), "session_id", "entry_id").count() == 3


def test_documents_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "short text", 1), (2, "SCHEDULE\n" + "a line of words\n" * 20, 3)], "doc_id long, text string, total_pages int")
    cut = semantic_chunks(docs)
    assert cut.filter(F.col("doc_id") == 1).select("section_type", "content_length", "page_range").first() == ("full_content", 10, "1")
    assert "Union" not in cut._jdf.queryExecution().optimizedPlan().toString()
