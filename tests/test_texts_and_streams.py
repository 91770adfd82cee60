from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.functions.similarity import Rules, partial_ratio, raw_ratio, similarity
from sievework.operators import consolidate, feedback, tuning
from sievework.operators.chunking import char_windows, semantic_chunks
from sievework.operators.entries import has_ordinal, normalize_key
from sievework.operators.positions import exact, method_shares, positions, search
from sievework.operators.textmetrics import phrase_found, top_phrases
from sievework.plans.pipeline import extract_documents
from sievework.sources import scans
from sievework.sources.llm_output import entries_of, salvage
from sievework.streaming import progress


@given(st.text(max_size=40), st.text(max_size=40))
@settings(max_examples=60, deadline=None)
def test_similarity_bounds(a, b):
    assert 0 <= similarity(a, b) <= 1 and 0 <= partial_ratio(a, b) <= 100
    assert similarity(a, a) == (1.0 if a else 0.0)


def test_similarity_examples():
    assert similarity(None, "x") == 0 and similarity("AbC ", "abc") == 1
    assert (raw_ratio("tide", "diet"), raw_ratio("diet", "tide")) == (0.25, 0.5)
    assert partial_ratio("venue", "the venue is open") == 100


def test_modes_read_years_and_percentages_differently():
    a, b = "from 2019 to 2020", "from 2011 to 2012"
    assert Rules(compat=True).share_figures(a, b) and not Rules().share_figures(a, b)
    assert Rules().share_figures("85% overall", "got 85%.") and not Rules(compat=True).share_figures("85% overall", "got 85%.")
    assert Rules().corrupted_ordinal("10th grade", "th grade", "85%", "85%")


@given(st.text(alphabet="ab .!?\n", max_size=900), st.integers(60, 300), st.integers(0, 50))
@settings(max_examples=80, deadline=None)
def test_char_windows(text, size, overlap):
    for start, end, body in char_windows(text, size, overlap):
        assert start % (size - overlap) == 0 and len(body) <= size and end <= start + size
        assert body.strip() == body and body in text[start : start + size]


def test_semantic_chunks_of_odd_documents(spark):
    rows = [(1, None, 1), (2, "  \n ", 1), (3, "short text", 0), (4, "\n".join(["Schedule:", "x1 " * 60, "Contact:", "y2 " * 60, "Hotel:", "z"]), 2), (5, "word " * 40_000, 7), (6, "a\r\nb", None)]
    got = semantic_chunks(spark.createDataFrame(rows, "doc_id long, text string, total_pages int")).collect()
    by = {i: [r for r in got if r.doc_id == i] for i in range(1, 7)}
    assert not by[1] and not by[2]
    assert [r.section_type for r in by[3]] == ["full_content"] and [r.header for r in by[4]] == ["Schedule:", "Contact:"]
    assert len(by[5]) == 1 and by[5][0].content_length >= 199_999


def test_keys(spark):
    keys = {"Session 1A": "session 1a", "10th Grade": "10th Grade", "Grade 10th": "Grade 10th", "3rd Floor": "floor", "Room 2B": "room 2b", "1. Intro": "intro", "": "", "Talk 10:30 am": "talk"}
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string")
    got = {r.k: r.n for r in df.select("k", normalize_key(F.col("k")).alias("n")).collect()}
    assert got == keys | {None: ""}
    assert {r[0]: r[1] for r in df.select("k", has_ordinal(F.col("k"))).collect()}["10th Grade"]


def test_phrases(spark):
    rows = [("the red house on a hill", s) for s in ("red house", "blue house", "on a", "xx yy", "", "a hill top", "of it")]
    for r in spark.createDataFrame(rows, "t string, s string").select("t", "s", phrase_found(F.col("t"), F.col("s")).alias("p")).collect():
        assert bool(top_phrases(r.t, r.s)) == r.p, r.s
    assert top_phrases("the red house on a hill", "red house") == [(4, 9, 1.0)]
    assert [x[:2] for x in top_phrases("the red house on a hill", "a red house on the hill")] == [(4, 12), (4, 9), (8, 8)]


def first_exact(key, value, text):
    """The first text of an entry that is found, among all it has, and its confidence by place; as published."""
    key, value = (key or "").strip(), (value or "").strip()
    tries = [f"{key}{j}{value}" for j in (": ", ":", " = ", "=", " - ", " ")] if key and value else []
    tries += [f"{key}: {value[:20]}", f"{key} {value[:20]}"] if key and len(value) > 20 else []
    tries += [key, *key.split()[:1], value[:30], *value.split()[:1], *(w for w in value.split()[:3] if len(w) > 3)]
    tries = [t for t in dict.fromkeys(tries) if len(t) > 2]
    at = next((i for i, t in enumerate(tries) if t in text), None)
    return None if at is None or at > 2 else (text.find(tries[at]), round(1 - 0.1 * at, 1))


def test_exact_positions(spark):
    texts = ["Intro line\nPhone: 555-123-4567\nVenue: Main Hall 5\n", "Venue = Main Hall 5", "the Main Hall of it", "", "Venue:Main Hall 5"]
    rows = [(k, v, t) for k in ("Venue", "Main Hall", " Venue ", "", None, "ab") for v in ("Main Hall 5", "Main Hall of the old town in the south", "", None, "it") for t in texts]
    df = spark.createDataFrame(rows, "k string, v string, t string")
    for r in df.select("*", exact(F.col("k"), F.col("v"), F.col("t")).alias("e")).collect():
        assert (tuple(r.e) if r.e else None) == first_exact(r.k, r.v, r.t), r
    assert search("Zebra", "qqqq", "nothing here") is None and search(None, None, None) is None


def test_fallback_positions_follow_the_entries(spark):
    """Entries that no search finds are estimated by their index within their session."""
    rows = [(s, i, 1, "Zebra", "qqqq") for s, ids in (("s", range(100, 124, 2)), ("t", [7, 3]), (None, [1, 2])) for i in ids]
    entries = spark.createDataFrame(rows, "session_id string, entry_id long, chunk_id int, entry_key string, entry_value string")
    chunks = spark.createDataFrame([("s", 1, "nothing here"), ("t", 1, "nothing here")], "session_id string, chunk_id int, content string")
    got = {r.entry_id: (r.position, r.final_position, r.method) for r in positions(entries, chunks, "session_id", "entry_id").collect()}
    length = {**dict.fromkeys(range(100, 124, 2), 12), 3: 12, 7: 12, 1: 1000, 2: 1000}  # chunks of a null session are unknown
    want = {i: int(length[i] * (((25 / 26) + 0.5 + n / 10) / 3)) for ids in (range(100, 124, 2), [3, 7], [1, 2]) for n, i in enumerate(ids)}
    assert got == {i: (p, 100_000 + p, "fallback") for i, p in want.items()}
    assert method_shares(positions(entries.limit(0), chunks, "session_id", "entry_id")).first().low_confidence == 0


def test_salvage(spark):
    texts = ['Sure: ```json\n{"entries": [{"KEY": "a", "Value": "b"}], "global_notes": "n"}\n``` done', '[{"key": "a", "value": "b"}]', '{"Key": "a", "Value": "b", "comment": "c"}', "no json", None, "{broken"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(entries_of(salvage(F.col("t")))).collect()]
    assert [[(e.Key, e.Value) for e in x] if x else None for x in got] == [[("a", "b")]] * 3 + [None] * 3


def test_pipeline_and_extractor(spark):
    docs = spark.createDataFrame([(1, "Schedule:\nFull name: Ada\nFull name: Ada Lovelace\nBase fee: 12 EUR\n" + "filler words here " * 10, 1, 5), (2, None, 1, 5)], "doc_id long, text string, total_pages int, extra int")
    got = extract_documents(docs).collect()
    assert [r["#"] for r in sorted(got, key=lambda r: r["#"])] == list(range(1, len(got) + 1))
    assert {"full name", "base fee"} <= {r.entry_key for r in got} and len({r.entry_key for r in got}) == len(got)

    def fails(text):
        raise ValueError("no")

    chunk = spark.createDataFrame([(1, 1, "x"), (1, 2, None)], "doc_id long, chunk_id int, content string")
    assert [(r.status, r.error) for r in scans.extract(chunk, extractor=fails).collect()] == [("error", "no")]


def test_pipeline_consolidates_by_default(spark, monkeypatch):
    """Entries that say the same under slightly different keys are one, at the session's threshold."""
    text = "Schedule:\nTotal amount due: 1200 EUR for the whole course\nTotal amounts due: 1200 EUR for the whole course\nVenue: Main Hall\n" + "filler words here " * 10
    docs = spark.createDataFrame([(1, text, 1)], "doc_id long, text string, total_pages int")
    keys = lambda **how: [r.entry_key for r in extract_documents(docs, **how).collect() if r.entry_key.startswith("total")]
    assert len(keys()) == 1 and len(keys(fuzzy=False)) == 2
    used, real = [], consolidate.fuzzy_consolidate
    monkeypatch.setattr(consolidate, "fuzzy_consolidate", lambda rows, group, order, threshold: used.append(threshold) or real(rows, group, order, threshold))
    spark.conf.set("spark.sievework.fuzzy_threshold", "0.9")
    try:
        extract_documents(docs)
    finally:
        spark.conf.unset("spark.sievework.fuzzy_threshold")
    assert used == [0.9]


def test_file_scans(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.txt").write_text("  ")
    (tmp_path / "c.txt").write_text("much too long")
    assert {(r.text, r.error) for r in scans.read_texts(spark, str(tmp_path / "*.txt"), most=6).collect()} == {("hello", None), (None, "text of less than 1 characters"), (None, "text of more than 6 characters")}
    (tmp_path / "x.pdf").write_bytes(b"one|two")
    got = scans.read_pdfs(spark, str(tmp_path), lambda b: [None, *b.decode().split("|")]).first()
    assert got.total_pages == 3 and got.text.startswith("--- Page 2 ---\none") and got.error is None
    assert scans.read_pdfs(spark, str(tmp_path), lambda b: [], most_bytes=3).first().error == "file of more than 3 bytes"
    assert scans.read_pdfs(spark, str(tmp_path), lambda b: b.oops).first().text is None
    (tmp_path / "m.md").write_text("text\n```python\nx = 1\n```\n```python\ny\n```")
    assert [r.code for r in scans.read_snippets(spark, str(tmp_path / "*.md")).collect()] == ["x = 1\n"]
    (tmp_path / "r.json").write_text('{"entries": [{"Key": "a", "Value": "b"}], "session_id": "s"}')
    assert scans.read_results(spark, str(tmp_path / "*.json")).first().session_id == "s"


@pytest.mark.parametrize("time", [None, "at"])
def test_stream_folds_like_batch(spark, tmp_path, time):
    rows = [("s", c, e, st_, n, seq) for c in range(4) for seq, (e, st_, n) in enumerate([("chunk_complete", "error" if c == 2 else "success", c), ("chunk_start", "pending", 0), ("noise", "x", 9)][:: 1 if c % 2 else -1], 1)]
    src = spark.createDataFrame(rows, "session string, chunk int, event string, status string, entries_count int, seq long").withColumn("at", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = progress.fold_stream(stream, time).writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    last = spark.table("folded").groupBy("session", "chunk").agg(F.max(F.struct("seq", "state", "entries_count")).alias("x")).select("session", "chunk", "x.state", "x.entries_count")
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in progress.fold_batch(src).collect()}


def test_window_stream_equals_batch(spark, small, tmp_path):
    ev = spark.read.parquet(f"{small}/events.parquet")
    ev.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = progress.event_windows(stream, late="1 hour").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("w").withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).collect()} == {tuple(r) for r in progress.event_windows(ev).collect()}


def test_frames(spark):
    lines = spark.createDataFrame([('data: {"event": "chunk_start", "chunk": 1}',), ("data: {oops",), (": ping",), (None,)], "value string")
    assert [(r.event, r.chunk) for r in scans.parse_frames(lines).collect()] == [("chunk_start", 1)]


def test_tuning(spark):
    docs = [(i, 10, -1.0, -0.3, {"speed": 4}) for i in range(12)]
    kind = "timestamp long, total_analyzed int, avg_rating_diff double, avg_sentiment double, issue_counts map<string,int>"
    found = tuning.tuning_patterns(spark.createDataFrame(docs, kind))
    assert [p.type for p in found.orderBy("position").collect()] == ["system_too_optimistic", "speed_weight_adjustment", "negative_sentiment_trend"]
    assert tuning.tuning_patterns(spark.createDataFrame([], kind)).count() == 0 and tuning.tuning_patterns(spark.createDataFrame([(1, 0, None, None, None)], kind)).count() == 0
    t = tuning.tuned(found.withColumn("confidence", F.lit(0.9)))
    assert abs(sum(t.weights.values()) - 1) < 1e-9 and t.weights["speed"] == 0.25 and len(t.changes) == 3
    assert t.changes[0]["before"][1] != t.changes[0]["after"][1]
    assert tuning.bumped(t.weights, "nothing", 0.1) == t.weights
    assert [tuning.cycle_due(*x) for x in ((1, 9, 9), (10, 2, 9), (10, 10, 1), (10, 10, 2))] == ["wait", "analyse", "recognise", "tune"]


def test_sentiment(spark):
    rows = [("great and fast", 1 / 3), ("too slow, bad", -2 / 3), ("", 0.0), (None, 0.0)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").orderBy("i").select(feedback.sentiment(F.col("t"))).collect()]
    assert got == pytest.approx([x for _, x in rows])
    assert re.fullmatch(r"[a-z+]+", "+".join(feedback.ISSUES))
