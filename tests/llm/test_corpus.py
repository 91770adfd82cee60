"""Percentiles, tokens, mixing and abuse scores."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.llm import abuse, mixing, qdigest, tokens
from sievework.llm.queries import QUERIES, SQL
from tests.helpers import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, small, duck, name):
    same(QUERIES[name](spark, small).toPandas(), duck.execute(SQL[name]).df())


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=400), st.integers(2, 60))
@settings(max_examples=60, deadline=None)
def test_rank_error_is_bounded(values, k):
    base = 1 << qdigest.BITS
    nodes, counts = qdigest.compress(*qdigest._add(np.array(values) + base, np.ones(len(values))), k=k)
    assert counts.sum() == len(values) and len(nodes) <= 3 * k + qdigest.BITS
    for p, (v, bound) in zip((0.1, 0.5, 0.9), qdigest.quantiles(nodes, counts, [0.1, 0.5, 0.9], unit=1.0)):
        rank = int(np.ceil(p * len(values)))
        low, high = sum(x < v for x in values), sum(x <= v for x in values)
        assert low - bound < rank <= high + bound
        assert bound <= qdigest.BITS * (len(values) // k)


def test_digests_of_days_merge_to_that_of_a_month(spark):
    rng = random.Random(8)
    rows = [(d, rng.lognormvariate(1, 1)) for d in range(10) for _ in range(500)] + [(1, None), (1, float("nan")), (2, -1.0), (None, 3.0), (3, float("inf"))]
    df = spark.createDataFrame(rows, "day int, t double").withColumn("m", F.lit("x"))
    days = qdigest.build(df, ["m", "day"], "t", k=200)
    month = qdigest.read(qdigest.merge(days, ["m"], k=200), ["m"]).collect()
    values = np.sort([t for _, t in rows if t is not None and t >= 0 and np.isfinite(t)])
    for r in month:
        assert r.n == len(values)
        rank = np.searchsorted(values, r.value + qdigest.UNIT)
        assert abs(rank - np.ceil(r.p * len(values))) <= r.rank_error + 10 * qdigest.BITS * (500 // 200) + 1
    many = qdigest.build(df, ["m", "day"], "t", k=200, most=300)
    assert {(r.day, r.n) for r in many.collect()} == {(r.day, r.n) for r in days.collect()}
    assert {r.day for r in days.select("day").collect()} == {None, *range(10)}
    assert qdigest.build(df.limit(0), ["m"], "t").count() == 0


def test_digests_at_size(spark):
    """A million values over many tasks, one group with most of them, and a small k: few nodes, ranks within the stated bound and that within log2(universe) * n / k of each merge."""
    n, k = 1_200_000, 100
    df = spark.range(0, n, 1, 16).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(900_000)) / 1000.0 + F.when(F.col("id") % 100 == 0, 1e6).otherwise(0)).alias("t"), (F.col("id") % 7).alias("day"))
    days = qdigest.build(df, ["g", "day"], "t", k)
    months = qdigest.merge(days, ["g"], k)
    assert months.select(F.max(F.size("nodes"))).first()[0] <= 3 * k + qdigest.BITS
    for r in qdigest.read(months, ["g"]).collect():
        exact = df.filter(F.col("g") == r.g).agg(F.count_if(F.col("t") < r.value), F.count_if(F.col("t") < r.value + max(qdigest.UNIT, r.value / 16_000)), F.count("*")).first()
        rank = np.ceil(r.p * exact[2])
        assert r.n == exact[2] and exact[0] - r.rank_error <= rank <= exact[1] + r.rank_error
        assert 0 < r.rank_error <= 3 * qdigest.BITS * r.n / k


def test_leaves_are_ordered(spark):
    xs = [0.0, 0.0004, 0.001, 1.0, 500.0, 524.2, 524.3, 600.0, 5000.0, 1e9, 1e12]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(qdigest.leaf(F.col("x"))).collect()]
    assert got == sorted(got) and got[-1] == (1 << qdigest.BITS) - 1
    back = qdigest.leaf_value(np.array(got[3:10]))
    assert np.allclose(back, xs[3:10], rtol=2e-3) and np.isinf(qdigest.leaf_value(np.array(got[10:])))[0]


TEXTS = ["plain words", "", None, "naïve café ☕ 日本語", "a  b\n\n c\t", "<|endoftext|> is text", "x" * 3000, "word " * 90_000, "​", "🙂" * 50]


def test_tokens_round_trip(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "no id", 2)], "doc_id long, text string, ids int")
    out = tokens.encode(df)
    ids = {r.doc_id: list(r.ids) for r in out.collect()}
    assert ids[1] == ids[2] == [] and max(max(x, default=0) for x in ids.values()) < 50256
    back = {r.doc_id: r.text for r in tokens.decode(out).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)} | {None: "no id"}
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(df.drop("ids")).collect()} == {k: len(v) for k, v in ids.items()}
    assert tokens.encode(df.limit(0)).count() == 0


def test_blocks_change_nothing():
    tok = tokens.load(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    text = " ".join(random.Random(1).choice(["word", "don't", "12", "x,", "é", "  ", "\n"]) for _ in range(4000))
    whole = tok.encode(text, add_special_tokens=False).ids
    assert [i for b in tokens.blocks(text, 500) for i in tok.encode(b, add_special_tokens=False).ids] == whole
    assert "".join(tokens.blocks(text, 500)) == text and tokens.blocks("x" * 900, 500) == ["x" * 900]
    assert len(tokens.byte_table()) == 256 == len(set(tokens.byte_table().values()))
    assert tokens.offsets("a b") == [(0, 1), (1, 3)] and tokens.offsets("") == []


def mix_tables(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Web Upload", "web-upload", "web_upload"] * 5 + ["fax", None]), " ".join(["tok"] * rng.randrange(1, 40)) + f" {i}") for i in range(600)] + [(900, "fax", ""), (901, "fax", None), (902, "other", "text")]
    docs = spark.createDataFrame(rows + [(910 + i, "fax", "same text") for i in range(20)], "doc_id long, source string, text string")
    sources = spark.createDataFrame([("web_upload", 0.6, 1), ("fax", 0.3, 4), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    return docs, sources


def test_mix_reaches_its_shares(spark):
    docs, sources = mix_tables(spark)
    m = mixing.mixed(docs, sources).cache()
    got = {r.source: r for r in mixing.shares(m, sources).collect()}
    assert got["web_upload"].actual_share == pytest.approx(0.6 / 0.9, abs=0.02) and got["absent"].tokens == 0
    assert got["fax"].most_uses <= 4 and got["web_upload"].most_uses == 1
    uses = m.join(docs, ["doc_id"]).groupBy("text").count().agg(F.max("count")).first()[0]
    assert uses <= 4 and m.filter("doc_id in (900, 901, 902)").count() == 0
    out = [r.position for r in mixing.laid_out(m, docs, 4).collect()]
    assert out == sorted(out) and len(out) == m.count()
    short = {r.source: r for r in mixing.shares(mixing.mixed(docs, sources, total=10_000_000), sources).collect()}
    assert short["web_upload"].most_uses == 1 and short["fax"].most_uses == 4
    assert mixing.mixed(docs.limit(0), sources).count() == 0


def test_schedules_integrate_and_invert(spark):
    segments = mixing.schedule({"a": 0.5, "b": 0.5}, {0.0: {"a": 1.0}, 0.5: {"a": 1.0, "b": 1.0}, 1.0: {"b": 2.0}})
    assert mixing.total_area(segments, "a") == pytest.approx(0.5) and mixing.total_area(segments, "b") == pytest.approx(0.5)
    with pytest.raises(ValueError):
        mixing.schedule({"a": 1.0}, {0.0: {"b": 1.0}})
    docs, sources = mix_tables(spark)
    m = mixing.mixed(docs, sources, knots={0.0: {"web_upload": 1.0}, 1.0: {"fax": 1.0}}).toPandas()
    first, last = m[m.position < m.position.max() / 4], m[m.position > m.position.max() * 3 / 4]
    share = lambda x: x[x.source == "web_upload"].n_tokens.sum() / x.n_tokens.sum()
    assert share(first) > 0.8 and share(last) < 0.2


def test_disguises_are_read_through():
    tok = abuse.read_through(["You i d i o t, you m0r0n; stuuuupid c.lown, b***d CAFÉ"])
    plain = abuse.read_through(["you idiot you moron stupid clown b**d cafe"])
    assert list(tok.hash) == list(plain.hash)


def test_held_out_accuracy(spark, small):
    """Trained on most labelled documents of sf0.1, fewer than a hundred of them bad, the scores find about half of the rest's bad ones,
    of whose labels some are wrong, with hardly a false alarm. How recall grows with labels is in the README.
    """
    d = f"{small}/../sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null")
    lab = spark.read.parquet(f"{d}/doc_labels.parquet").filter("content_label is not null").groupBy("doc_id").agg(F.avg((F.col("content_label") != "none").cast("int")).alias("bad"))
    rows = docs.join(lab, "doc_id").orderBy(F.xxhash64("doc_id")).select("text", "bad").collect()
    k = int(len(rows) * 0.75)
    m = abuse.train(abuse.windows([r.text for r in rows[:k]]), np.array([r.bad >= 0.5 for r in rows[:k]]))
    x = abuse.windows([r.text for r in rows[k:]])
    top, _ = abuse.worst(x, m.logits(x), len(rows) - k)
    bad, found = np.array([r.bad >= 0.5 for r in rows[k:]]), 1 / (1 + np.exp(-top)) >= abuse.THRESHOLD
    assert (found & bad).sum() >= 0.45 * bad.sum() and (found & ~bad).sum() <= 0.02 * (~bad).sum()


def test_scores_of_odd_documents(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, " \n", "B"), (4, "word " * 50_000, None), (5, "fine text", "b")] * 2, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, reviewer string, content_label string, labelled_ts timestamp_ntz")
    got = {r.doc_id: r.score for r in abuse.score_documents(docs, none).collect()}
    assert got[1] == got[2] == got[3] == pytest.approx(0) and got[4] == got[5] == 0.5
    odd = spark.createDataFrame([(5, "r", None), (99, "r", "abusive"), (5, "r", "none"), (1, "r", "sexual")], "doc_id long, reviewer string, content_label string")
    assert abuse.score_documents(docs, odd).count() == 10
    assert abuse.score_documents(docs.limit(0), odd).count() == 0
    assert {r.source for r in abuse.rates(docs, abuse.score_documents(docs, none)).collect()} == {"a", "b", None}
