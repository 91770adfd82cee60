from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievework.functions.similarity import Needle, Rules, partial_ratio
from sievework.operators import consolidate
from sievework.operators.components import connected_components
from sievework.operators.entries import context_state, merged_synonyms, repair_marked
from sievework.operators.references import orphan_references, orphan_report
from sievework.operators.skew import join_counted, row_numbers
from sievework.session import checkpoint_dir
from sievework.sources.tables import norm_label, norm_session_id, upsert, write_csv, write_json

KIDS = "child_table string, child_id string, key string, at timestamp_ntz, extra int"
FOLKS = "key string, received timestamp_ntz, removed timestamp_ntz, child_id string"


def orphans(kids, folks):
    out = set()
    for t, i, k, at, *_ in kids:
        if k is None:
            continue
        got = [r for kk, r, _, _ in folks if kk == k and r is not None]
        gone = [d for kk, _, d, _ in folks if kk == k and d is not None]
        late = at or datetime.max
        if gone and min(gone) <= late:
            out.add((t, i, "removed"))
        elif not got:
            out.add((t, i, "missing"))
        elif min(got) > late:
            out.add((t, i, "late"))
    return out


def test_orphans_against_brute_force(spark):
    rng, day = random.Random(4), datetime(2024, 1, 1)
    stamp = lambda: None if rng.random() < 0.08 else day + timedelta(days=rng.randrange(120), hours=rng.choice([0, 0, 7]))
    folks = [(rng.choice([None, *(f"k{n}" for n in range(150))]), stamp(), stamp() if rng.random() < 0.2 else None, "x") for _ in range(200)]
    kids = [(rng.choice("ab"), rng.choice([None, str(n)]), rng.choice([None, *(f"k{n}" for n in range(180))]), stamp(), n) for n in range(400)]
    kids += kids[:40]
    c, p = spark.createDataFrame(kids, KIDS), spark.createDataFrame(folks, FOLKS)
    for ranges in (1, 7, None):
        got = [(r.child_table, r.child_id, r.reason) for r in orphan_references(c, p, ranges).collect()]
        assert set(got) == orphans(kids, folks)
    report = orphan_report(c, orphan_references(c, p)).agg(F.sum("refs"), F.sum(F.col("missing") + F.col("late") + F.col("removed"))).first()
    assert report[0] == c.filter("key is not null").select("child_table", "child_id", "key", "at").distinct().count()


def test_orphans_of_empty_tables(spark):
    c, p = spark.createDataFrame([], KIDS), spark.createDataFrame([], FOLKS)
    one = spark.createDataFrame([("a", "1", "k", datetime(2024, 1, 1), 0)], KIDS)
    assert orphan_references(c, p).count() == 0
    assert [r.reason for r in orphan_references(one, p).collect()] == ["missing"]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5), (None, 3), (7, 8), (7, 8)]
    root = {n: n for e in edges for n in e if n is not None and None not in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_counted_is_an_inner_join(spark):
    rows = spark.createDataFrame([(i, None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 40}") for i in range(600)], "id long, k string")
    groups = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("lead"))
    want = {tuple(r) for r in rows.join(groups, "k").select("id", "k", "n", "lead").collect()}
    for hot in (10, 10_000):
        assert {tuple(r) for r in join_counted(rows, groups, "k", "n", F.col("id"), hot).select("id", "k", "n", "lead").collect()} == want


def test_blocks_find_what_all_pairs_find(spark, monkeypatch):
    """Groups larger than a block give the same pairs as one block."""
    words = ["Total amount", "Total amounts", "Venue", "10th Grade", "Th Grade", "Contact person"]
    rng = random.Random(3)
    rows = [(g, g * 100 + i, rng.choice(words), rng.choice(["2019-2020 with 85% overall", "Room 12, main building", "Room 12, main buildings", "n/a"]), rng.choice([None, "", "meeting notes", "other"])) for g in range(2) for i in range(25)]
    df = consolidate.prepared(spark.createDataFrame(rows, "session_id long, entry_id long, entry_key string, entry_value string, comments string"), "session_id", "entry_id")
    whole = {tuple(r) for r in consolidate.similar_pairs(df).collect()}
    monkeypatch.setattr(consolidate, "BLOCK", 4)
    assert whole and {tuple(r) for r in consolidate.similar_pairs(df).collect()} == whole


def test_bounds_rule_out_no_pair():
    """Whatever the rules hold for, the bounds allow."""
    rng = random.Random(11)
    keys = ["Total amount", "Total amounts", "Venue", "10th Grade", "Th Grade", "Grade 10", "Contact person", "Contact persons", "University fee", "College fee", "é" * 4]
    values = ["2019-2020 with 85% overall", "2019 with 85%", "Room 12, main building", "Room 12, main buildings", "12 EUR", "12 EUR a head", "x", "overall in 2011"]
    for compat in (False, True):
        rules = Rules(0.85, compat)
        rows = [{"key": k, "norm": k.lower(), "value": v, "signature": f"{k}:{v}".lower(), "comments": rng.choice(["", "meeting notes", "a session note"]), "education": rules.is_education(k.lower(), v.lower())} for k in keys for v in values]
        ok = rules.possible(rows, rows)
        alike = [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and rules.alike(a, b)]
        assert alike and all(ok[i, j] for i, j in alike) and ok.mean() < 0.9


def test_needle_finds_what_every_ratio_finds():
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab cde") for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    for t in texts[:20]:
        scores = [partial_ratio(t, x) for x in texts]
        best = max(range(len(texts)), key=lambda i: (scores[i], -i))
        at, score = Needle(t).best(texts, 40.0)
        assert (at, score) == ((best, scores[best]) if scores[best] > 40 else (-1, 40.0))


def test_context_state_of_odd_chunks(spark):
    rows = [("s", 1, "success", 4), ("s", 2, "error", 9), ("s", 3, None, None), ("s", 4, "success", None), ("s", 5, "success", 1), (None, 1, "success", 2)]
    got = {(r.g, r.o): (r.processed_chunks, r.failed_chunks, r.context_messages, r.avg_entries_per_chunk, r.success_rate) for r in context_state(spark.createDataFrame(rows, "g string, o int, status string, entries_count int"), "g", "o", 1).collect()}
    assert got[("s", 1)] == got[(None, 1)] == (0, 0, 0, 0.0, 0.0) and got[("s", 4)] == (1, 2, 2, 4.0, 33.3) and got[("s", 5)] == (2, 2, 2, 2.0, 50.0)


def test_synonyms_become_one_name(spark):
    rows = [(1, {"Entry Value": None, "entry_value": "a", "x": "1"}), (2, {"ENTRYVALUE": "b"}), (3, None), (4, {}), (None, {"X": "c"})]
    got = {r.i: r.m for r in merged_synonyms(spark.createDataFrame(rows, "i int, m map<string,string>"), "i", "m").collect()}
    assert got == {1: {"ENTRYVALUE": "a", "X": "1"}, 2: {"ENTRYVALUE": "b"}, 3: {}, 4: {}, None: {"X": "c"}}


def test_repair_of_short_and_long_stems(spark):
    rows = [(1, 1, "Key", "ab..."), (1, 2, "Keys", "abacus and more"), (1, 3, "other", "abacus and others"), (2, 4, "Key", "a much longer st…"), (2, 5, "key", "A much longer story"), (2, 6, "key", None), (2, 7, "key", "..."), (3, 8, "key", "abacus")]
    df = spark.createDataFrame(rows, "g int, o int, entry_key string, entry_value string")
    assert {(r.o, r.repaired) for r in repair_marked(df, "g", "o").collect()} == {(1, "abacus and more"), (4, "A much longer story")}
    assert repair_marked(df.limit(0), "g", "o").count() == 0


def test_a_shared_folder_is_asked_for_off_local():
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        checkpoint_dir(type("Session", (), {"sparkContext": Context()})())


def test_consolidation_is_a_partition(spark):
    rows = [(1, 1, "Name", "Ada Lovelace of London", None), (1, 2, "name", "Ada Lovelace of London", "seen on page two"), (1, 3, "Fee", "12 EUR", None), (1, 4, "x", "short key", None), (2, 5, "Name", "Ada Lovelace of London", None)]
    df = spark.createDataFrame(rows, "session_id long, entry_id long, entry_key string, entry_value string, comments string")
    got = {r.first_order: r for r in consolidate.fuzzy_consolidate(df, "session_id", "entry_id").collect()}
    assert {k: (r.n, r.best_order) for k, r in got.items()} == {1: (2, 2), 3: (1, 3), 5: (1, 5)}
    assert got[1].comments == "seen on page two"
    again = df.join(spark.createDataFrame([(r.best_order,) for r in got.values()], "entry_id long"), "entry_id")
    assert consolidate.fuzzy_consolidate(again, "session_id", "entry_id").count() == len(got)
    assert consolidate.fuzzy_consolidate(df.limit(0), "session_id", "entry_id").count() == 0


def test_education_entries_merge(spark):
    """A whole ordinal outweighs a longer value; two years of a component come together, comments in their order."""
    rows = [(1, 1, "Th Grade", "85% overall in 2019 with a long remark on the marks given in all the subjects", "first"), (1, 2, "10th Grade", "85% overall in 2019", "a second, longer one"), (1, 3, "10th Grade", "85% overall in 2019, 2020", None)]
    make = lambda rs: consolidate.fuzzy_consolidate(spark.createDataFrame(rs, "session_id long, entry_id long, entry_key string, entry_value string, comments string"), "session_id", "entry_id").collect()
    got = make(rows[:2])
    assert [(r.n, r.best_order, r.value, r.comments) for r in got] == [(2, 2, "85% overall in 2019", "first | a second, longer one")]
    rows[2] = (1, 3, "10th Grade", "85% in 2020", None)
    rows[0] = (1, 1, "10th Grade", "85% overall in 2019 as a grade", None)
    got = make([rows[0], rows[2]])
    assert [(r.n, r.best_order, r.value) for r in got] == [(2, 1, "85% overall in 2019 as a grade (2019-2020)")]


def test_labels_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(" Web-Upload\t", "SESSION_1 "), (None, None)], "s string, k string")
    assert [tuple(r) for r in df.select(norm_label(F.col("s")), norm_session_id(F.col("k"))).collect()] == [("web_upload", "session_1"), (None, None)]
    write_json(df, str(tmp_path / "j"))
    write_csv(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    make = lambda rows: spark.createDataFrame(rows, "k int, v string, t int")
    merged = upsert(make([(1, "a", 1), (2, "b", 9), (None, "n", 1)]), make([(2, "c", 2), (2, "x", None), (3, "d", 1), (3, "e", 2), (3, "f", 2), (None, "m", 1)]), "k", "t")
    assert {tuple(r) for r in merged.collect()} == {(1, "a", 1), (2, "c", 2), (3, "f", 2), (None, "n", 1), (None, "m", 1)}
    assert upsert(make([]), make([]), "k", "t").count() == 0


def test_row_numbers_are_those_of_a_window(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), rng.choice([None, rng.randrange(-50, 400)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, i long")
    want = {tuple(r) for r in df.withColumn("n", F.expr("row_number() over (partition by g order by o, i)")).collect()}
    assert {tuple(r) for r in row_numbers(df, "g", ["o", "i"], "n", 20).collect()} == want
    assert row_numbers(df.limit(0), "g", ["o", "i"], "n").count() == 0
