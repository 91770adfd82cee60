"""Queries over errors, places of entries, phrases, names and frames, and deduplication on cases written out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import scalars
from sievework.operators import chunking, consolidate, positions, textmetrics
from sievework.operators import entries as en
from sievework.plans.documents import _C, _E, _NORM, _chunks, _docs, _entries, _said, _strip
from sievework.sources.scans import parse_frames
from sievework.sources.tables import frames, read_table, upsert
from sievework.streaming import progress

# One message for every word that tells kinds of errors apart, each with its kind.
_MESSAGES = [
    ("the api said no", "API"), ("openai is away", "API"), ("a rate limit was met", "API"), ("status 429", "API"), ("status 503", "API"), ("status 502", "API"), ("connection lost", "NETWORK"), ("network down", "NETWORK"),
    ("a timeout of 60 s", "NETWORK"), ("no dns", "NETWORK"), ("validation went wrong", "VALIDATION"), ("invalid field", "VALIDATION"), ("value is null", "VALIDATION"), ("got None", "VALIDATION"), ("an empty list", "VALIDATION"),
    ("bad JSON", "DATA"), ("cannot parse", "DATA"), ("cannot decode", "DATA"), ("wrong format", "DATA"), ("unicode trouble", "DATA"), ("processing went wrong", "PROCESSING"), ("chunk 3", "PROCESSING"),
    ("deduplication went wrong", "PROCESSING"), ("normalization went wrong", "PROCESSING"), ("out of luck", "UNKNOWN"), ("", "UNKNOWN"),
]
_KINDS = [("rate limit 1", "rate_limit"), ("429", "rate_limit"), ("timeout", "timeout"), ("timed out", "timeout"), ("api", "api_error"), ("OpenAI", "api_error"), ("connection", "connection_error"), ("network", "connection_error"), ("invalid x", "data_error"), ("parse", "data_error"), ("json", "data_error"), ("auth", "auth_error"), ("no key", "auth_error"), ("else", "unknown_error")]


def handler_errors(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the chunks' errors, and of a message for each word that tells."""
    c = read_table(spark, d, "semantic_chunks").distinct().filter("error is not null").select(F.col("error").alias("message"))
    return c.unionByName(spark.createDataFrame([(m,) for m, _ in _MESSAGES], "message string")).groupBy(scalars.handler_error(F.col("message")).alias("category")).agg(F.count("*").alias("n"))


def error_words(spark: SparkSession, d: str) -> DataFrame:
    """Both ways to tell errors apart, on a message for each word; a type name tells a system error where no word does."""
    rows = spark.createDataFrame([(m, t) for m, _ in _MESSAGES for t in (None,)] + [(m, None) for m, _ in _KINDS] + [("out of luck", "MemoryError"), ("out of luck", "OSError"), ("out of luck", "ValueError")], "message string, type string")
    return rows.select("message", "type", scalars.handler_error(F.col("message"), F.col("type")).alias("handler"), en.error_category(F.col("message")).alias("stream")).distinct()


def error_stats(spark: SparkSession, d: str) -> DataFrame:
    """One row: chunks that failed, those tried again, those that then succeeded, those that never did, and both shares in per cent."""
    c = read_table(spark, d, "semantic_chunks").distinct().groupBy("session_id", "chunk_id")
    bad, ok = F.count_if(F.col("status") == "error"), F.count_if(F.col("status") == "success")
    g = c.agg(bad.alias("bad"), ok.alias("ok"), F.count("*").alias("n")).filter("bad > 0")
    g = g.agg(F.count("*").alias("total_errors"), F.count_if(F.col("n") > 1).alias("recovery_attempts"), F.count_if(F.col("ok") > 0).alias("successful_recoveries"), F.count_if(F.col("ok") == 0).alias("critical_failures"))
    pct = lambda a, b: F.bround(F.when(F.col(b) > 0, F.col(a) * 100.0 / F.col(b)).otherwise(0.0), 1).cast("double")
    return g.select("*", pct("successful_recoveries", "recovery_attempts").alias("recovery_rate_percent"), pct("critical_failures", "total_errors").alias("critical_failure_rate_percent"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).select("session_id", "entry_id", "chunk_id", "entry_key", "entry_value")
    return positions.positions(e, _chunks(spark, d), "session_id", "entry_id")


def entry_positions(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).select("entry_id", "position", "confidence", "method", "final_position")


def position_methods(spark: SparkSession, d: str) -> DataFrame:
    return positions.method_shares(_placed(spark, d))


def exact_positions(spark: SparkSession, d: str) -> DataFrame:
    """The entries that stand in their chunk as they are."""
    return _placed(spark, d).filter("method = 'exact'").select("entry_id", "position", "confidence", "final_position")


def estimated_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where each entry would be put if nothing of it were found, in the chunk it has."""
    e = en.numbered(_entries(spark, d).select("session_id", "entry_id", "chunk_id", "entry_key"), "session_id", "entry_id")
    j = e.join(_chunks(spark, d).select("session_id", "chunk_id", F.length("content").alias("n")), ["session_id", "chunk_id"], "left")
    return j.select("entry_id", positions.estimate(F.col("entry_key"), F.col("#") - 1, F.coalesce("n", F.lit(1000))).alias("position"))


_PLACES = [
    ("Venue", "Main Hall 5", "Intro line\nPhone: 555-123-4567\nVenue: Main Hall 5\n"), ("Venue", "Main Hall 5", "x Venue = Main Hall 5"), ("Venue", None, "The venue and the Venue"), (None, "Main Hall 5 of the old town, south", "at Main Hall 5 of the old town, sou"),
    ("Venues", "Main Halls 5", "first line\n\nVenue: Main Hall 5\nlast"), ("Fee", "12 EUR for members only", "x" * 32 + " Fee: " + "z" * 24 + " 12 " + "z" * 20), ("Fee", "12 EUR for members of the association", "Fee   :   12 EUR for members of"), ("Work phone", "unlisted", "call (555) 123-4567 now"),
    ("Email", "unlisted", "write to a.b@c.org"), ("Zebra", "qqqq", "nothing here"), ("notes", "qqqq", "nothing here"), ("", "", "nothing here"), ("Zebra", "qqqq", None),
]


def place_examples(spark: SparkSession, d: str) -> DataFrame:
    """Each way in which an entry is placed, on literal chunks; session 1, of one entry a chunk."""
    rows = [(1, i, i, k, v, t) for i, (k, v, t) in enumerate(_PLACES)]
    df = spark.createDataFrame(rows, "session_id int, entry_id int, chunk_id int, entry_key string, entry_value string, content string")
    p = positions.positions(df.drop("content"), df.select("session_id", "chunk_id", "content"), "session_id", "entry_id")
    return p.select("entry_id", "position", F.bround("confidence", 2).alias("confidence"), "method")


def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    """Where the keys of entries stand in their documents, in whole or in parts."""
    s = read_table(spark, d, "processing_sessions").groupBy("session_id").agg(F.max("doc_id").alias("doc_id"))
    said = _entries(spark, d).join(s, "session_id").select("doc_id", "entry_id", F.col("entry_key").alias("text"))
    return textmetrics.phrase_matches(_docs(spark, d), said)


def fidelity_score(spark: SparkSession, d: str) -> DataFrame:
    return textmetrics.fidelity(_docs(spark, d), _said(spark, d))


def context_state(spark: SparkSession, d: str) -> DataFrame:
    """What the extractor's memory holds before each chunk."""
    c = read_table(spark, d, "semantic_chunks").groupBy("session_id", "chunk_id").agg(F.max("status").alias("status"), F.max("entries_count").alias("entries_count"))
    return en.context_state(c, "session_id", "chunk_id")


def field_patterns(spark: SparkSession, d: str) -> DataFrame:
    return en.field_patterns(_entries(spark, d).select("session_id", "entry_id", "entry_key"), "session_id", "entry_id")


def column_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Entries as maps whose names are spelled in several ways, and the names they have in the end."""
    e = _entries(spark, d).select("entry_id", "entry_value", "comments")
    name = lambda a, b, c: F.when(F.col("entry_id") % 3 == 0, a).when(F.col("entry_id") % 3 == 1, b).otherwise(c)
    maps = e.select("entry_id", F.map_from_arrays(F.array(name("Entry Value", "entry_value", "ENTRY-VALUE"), name("comments", "Comments", "com_ments"), F.lit("entryvalue")), F.array("entry_value", "comments", F.lit("spare"))).alias("fields"))
    m = en.merged_synonyms(maps, "entry_id", "fields")
    return m.select("entry_id", F.array_join(F.map_keys("fields"), "+").alias("names"), F.try_element_at("fields", F.lit("ENTRY-VALUE")).alias("value"), F.try_element_at("fields", F.lit("Comments")).alias("comment"))


def pretty_entries(spark: SparkSession, d: str) -> DataFrame:
    """Each entry as indented JSON."""
    return _entries(spark, d).select("entry_id", scalars.pretty_object(Key=F.col("entry_key"), Value=F.col("entry_value"), Comments=F.col("comments")).alias("json"))


def frame_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Chunk results as frames of an event stream, read back."""
    s = read_table(spark, d, "processing_sessions").select("session_id", F.inline("chunk_results")).select(F.lit("chunk_complete").alias("event"), F.col("session_id").alias("session"), F.col("chunk_id").alias("chunk"), F.lit(3).cast("long").alias("seq"), "status", "entries_count").distinct()
    lines = frames(s).select(F.explode(F.split("value", "\n")).alias("value"))
    return parse_frames(lines).select("session", "chunk", "status", "entries_count")


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Feedback of the first half of all time, brought up to date by the second: one row an id, the one received last."""
    f = read_table(spark, d, "user_feedback").select("feedback_id", "received_ts", "rating").filter("feedback_id is not null")
    mid = f.agg(F.percentile_approx(F.unix_micros(F.col("received_ts").cast("timestamp")), 0.5).alias("mid"))
    rows = f.crossJoin(F.broadcast(mid)).withColumn("late", F.unix_micros(F.col("received_ts").cast("timestamp")) > F.col("mid")).drop("mid")  # with one row
    base = rows.filter("not late").groupBy("feedback_id").agg(F.max(F.struct("received_ts", "rating")).alias("r")).select("feedback_id", "r.received_ts", "r.rating")
    return upsert(base, rows.filter("late").drop("late"), "feedback_id", "received_ts")


def dedup_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the stages of deduplication leave of all entries, the fuzzy one left out."""
    return consolidate.dedup_stats(_entries(spark, d), "session_id", "entry_id", fuzzy=False)


def fuzzy_consolidate(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.fuzzy_consolidate(_entries(spark, d), "session_id", "entry_id")


def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.dedup_stats(_entries(spark, d), "session_id", "entry_id")


_CASES = [
    (1, 1, "Total amount due", "1200 EUR for the whole trip", None), (1, 2, "Total amounts due", "1200 EUR for the whole trip", "as agreed in the letter"), (1, 3, "Venue", "Main Hall 5", None), (1, 4, "x", "a key too short", None), (1, 5, "Total amount due", "n/a", None),
    (2, 11, "Th Grade", "85% overall in 2019 with a long remark on the marks given in all the subjects", "first"), (2, 12, "10th Grade", "85% overall in 2019", "a second, longer one"), (2, 13, "Venue", "Main Hall 5", None),
    (3, 21, "10th Grade", "85% overall in 2019 as a grade", None), (3, 22, "10th Grade", "85% in 2020", None),
    (4, 31, "Notes", "The harbor is clo...", None), (4, 32, "Notes", "The harbor is closed in winter", None),
]


def _cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CASES, "session_id int, entry_id int, entry_key string, entry_value string, comments string")


def consolidation_examples(spark: SparkSession, d: str) -> DataFrame:
    """Fuzzy consolidation of literal entries: like keys, education entries and their years, a comment that stays, an invalid key."""
    return consolidate.fuzzy_consolidate(_cases(spark), "session_id", "entry_id")


def stage_examples(spark: SparkSession, d: str) -> DataFrame:
    """The counts of every stage on the same entries."""
    return consolidate.dedup_stats(_cases(spark), "session_id", "entry_id")


def window_examples(spark: SparkSession, d: str) -> DataFrame:
    """Character windows of literal texts: cut at a sentence, at a word, nowhere, and a tail too short to keep."""
    texts = [(1, "word " * 30 + "ends here. " + "tail " * 20), (2, "x" * 500), (3, "short"), (4, None), (5, "w" * 60 + " " + "v" * 200)]
    c = chunking.char_chunks(spark.createDataFrame(texts, "doc_id int, text string"), 200, 20)
    return c.select("doc_id", "chunk_id", "start_pos", "end_pos", "length", "char_range")


QUERIES = {
    f.__name__: f
    for f in (
        handler_errors, error_words, error_stats, entry_positions, position_methods, exact_positions, estimated_positions, place_examples, phrase_matches, fidelity_score, context_state, field_patterns,
        column_synonyms, pretty_entries, frame_round_trip, upsert_latest, dedup_counts, fuzzy_consolidate, dedup_stats, consolidation_examples, stage_examples, window_examples,
    )
}

# --- the same in SQL ---------------------------------------------------------------------------------------------------------

_KEY, _VAL = _strip("coalesce(e.entry_key, '')"), _strip("coalesce(e.entry_value, '')")
# The kinds of errors, written out once more.
_HANDLER = """CASE WHEN m LIKE '%api%' OR m LIKE '%openai%' OR m LIKE '%rate limit%' OR m LIKE '%429%' OR m LIKE '%503%' OR m LIKE '%502%' THEN 'API' WHEN m LIKE '%connection%' OR m LIKE '%network%' OR m LIKE '%timeout%' OR m LIKE '%dns%' THEN 'NETWORK'
WHEN m LIKE '%validation%' OR m LIKE '%invalid%' OR m LIKE '%null%' OR m LIKE '%none%' OR m LIKE '%empty%' THEN 'VALIDATION' WHEN m LIKE '%json%' OR m LIKE '%parse%' OR m LIKE '%decode%' OR m LIKE '%format%' OR m LIKE '%unicode%' THEN 'DATA'
WHEN m LIKE '%processing%' OR m LIKE '%chunk%' OR m LIKE '%deduplication%' OR m LIKE '%normalization%' THEN 'PROCESSING' ELSE 'UNKNOWN' END"""
_STREAM = """CASE WHEN m LIKE '%rate limit%' OR m LIKE '%429%' THEN 'rate_limit' WHEN m LIKE '%timeout%' OR m LIKE '%timed out%' THEN 'timeout' WHEN m LIKE '%api%' OR m LIKE '%openai%' THEN 'api_error' WHEN m LIKE '%connection%' OR m LIKE '%network%' THEN 'connection_error'
WHEN m LIKE '%invalid%' OR m LIKE '%parse%' OR m LIKE '%json%' THEN 'data_error' WHEN m LIKE '%auth%' OR m LIKE '%key%' THEN 'auth_error' ELSE 'unknown_error' END"""


def _values(rows: list[tuple]) -> str:
    one = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_PLAIN = r"lower(regexp_replace(regexp_replace({0}, '[\s\p{{Z}}]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_ \-.,:;()\[\]/@#$%&*+=<>?!''\x22]', '', 'g'))"


def _plain(c: str) -> str:
    return _PLAIN.format(_strip(f"coalesce({c}, '')"))


def _some(col: str) -> str:
    """Whether a run of words of ``col`` over three characters is in the text ``t``, or all of it."""
    w = f"list_filter(string_split({col}, ' '), lambda x: x <> '')"
    runs = f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]), list_transform(range(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2]))"
    return f"({col} <> '' AND (contains(t, {col}) OR (len({w}) > 1 AND len(list_filter({runs}, lambda p: length(p) > 3 AND contains(t, p))) > 0)))"


_DEDUP = (
    rf"""
WITH {_E}, v AS (SELECT session_id, entry_id, {_strip('entry_key')} AS k, {_strip('entry_value')} AS v FROM e WHERE length({_strip('entry_key')}) >= 2 AND lower({_strip("coalesce(entry_value, '')")}) NOT IN ('', 'null', 'none', 'n/a', 'na', 'nil', 'undefined', 'empty', 'missing', 'unknown', 'blank')),
k AS (SELECT DISTINCT k AS entry_key FROM v)"""
    + _NORM
    + rf""", x AS (SELECT session_id, entry_id, lower({_strip("CASE WHEN n = '' THEN raw ELSE n END")}) AS k, v FROM v JOIN f ON f.entry_key = v.k),
m AS (SELECT *, {_strip("regexp_replace(v, '[.…]+$', '')")} AS stem FROM x WHERE (ends_with(v, '...') OR ends_with(v, '…')) AND length(v) > 3),
r AS (SELECT DISTINCT m.entry_id FROM m JOIN x ON x.session_id = m.session_id AND x.entry_id <> m.entry_id AND length(m.stem) > 0 AND starts_with(lower(x.v), lower(m.stem)) AND length(x.v) > length(m.stem)
      AND NOT (ends_with(x.v, '...') OR ends_with(x.v, '…')) AND levenshtein(m.k, x.k) <= 0.3 * greatest(length(m.k), length(x.k))),
s AS (SELECT (SELECT count(*) FROM e) AS i, (SELECT count(*) FROM x) AS n, (SELECT count(*) FROM (SELECT DISTINCT session_id, k FROM x)) AS o, (SELECT count(*) FROM r) AS t)
"""
)

SQL = {
    "handler_errors": f"SELECT {_HANDLER} AS category, count(*) AS n FROM (SELECT lower(error) AS m FROM (SELECT DISTINCT * FROM semantic_chunks) WHERE error IS NOT NULL UNION ALL SELECT lower(x) FROM ({_values([(m,) for m, _ in _MESSAGES])}) t(x)) GROUP BY 1",
    "error_words": _values([(m, None, k) for m, k in _MESSAGES]).replace("VALUES ", "WITH a AS (SELECT DISTINCT * FROM (VALUES ", 1)
    + f""") t(message, type, kind)), b AS (SELECT message, type, kind, lower(message) AS m FROM a
UNION SELECT *, lower(message) FROM ({_values([(m, None) for m, _ in _KINDS])}) t(message, type), (SELECT NULL::VARCHAR AS kind) UNION SELECT 'out of luck', x, CASE WHEN x = 'ValueError' THEN 'UNKNOWN' ELSE 'SYSTEM' END, 'out of luck' FROM (VALUES ('MemoryError'), ('OSError'), ('ValueError')) t(x))
SELECT DISTINCT message, type, coalesce(kind, {_HANDLER}) AS handler, {_STREAM} AS stream FROM b WHERE kind IS NOT NULL OR message NOT IN (SELECT message FROM a)""",
    "error_stats": """WITH g AS (SELECT session_id, chunk_id, count(*) FILTER (status = 'error') AS bad, count(*) FILTER (status = 'success') AS ok, count(*) AS n FROM (SELECT DISTINCT * FROM semantic_chunks) GROUP BY 1, 2),
s AS (SELECT count(*) AS total_errors, count(*) FILTER (n > 1) AS recovery_attempts, count(*) FILTER (ok > 0) AS successful_recoveries, count(*) FILTER (ok = 0) AS critical_failures FROM g WHERE bad > 0)
SELECT *, CASE WHEN recovery_attempts > 0 THEN round_even(successful_recoveries * 100.0 / recovery_attempts, 1) ELSE 0.0 END::DOUBLE AS recovery_rate_percent, CASE WHEN total_errors > 0 THEN round_even(critical_failures * 100.0 / total_errors, 1) ELSE 0.0 END::DOUBLE AS critical_failure_rate_percent FROM s""",
    "exact_positions": rf"""WITH {_E}, {_C}, a AS (SELECT e.entry_id, e.chunk_id, coalesce(c.content, '') AS t, {_KEY} AS k, {_VAL} AS v FROM e LEFT JOIN c ON c.session_id = e.session_id AND c.chunk_id = e.chunk_id),
b AS (SELECT *, list_filter(CASE WHEN k <> '' AND v <> '' THEN [k || ': ' || v, k || ':' || v, k || ' = ' || v] ELSE [k, regexp_split_to_array(k, '\s+')[1], v[1:30], regexp_split_to_array(v, '\s+')[1]] || list_filter(regexp_split_to_array(v, '\s+')[1:3], lambda x: length(x) > 3) END, lambda x: length(x) > 2) AS raw FROM a),
d AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i)[1:3] AS tries FROM b),
f AS (SELECT *, list_filter([1, 2, 3], lambda i: i <= len(tries) AND contains(t, tries[i]))[1] AS i FROM d)
SELECT entry_id, instr(t, tries[i]) - 1 AS position, round_even(1 - (i - 1) * 0.1, 1)::DOUBLE AS confidence, coalesce(chunk_id, 0) * 100000 + instr(t, tries[i]) - 1 AS final_position FROM f WHERE i IS NOT NULL""",
    "estimated_positions": rf"""WITH {_E}, {_C}, a AS (SELECT e.entry_id, coalesce(e.entry_key, '') AS k, coalesce(length(c.content), 1000) AS n, row_number() OVER (PARTITION BY e.session_id ORDER BY e.entry_id) - 1 AS i FROM e LEFT JOIN c ON c.session_id = e.session_id AND c.chunk_id = e.chunk_id),
b AS (SELECT *, regexp_matches(k, '^\p{{L}}') AS letter, lower(k) AS l FROM a)
SELECT entry_id, CAST(floor(n * ((CASE WHEN letter THEN (unicode(l) - 97) / 26.0::DOUBLE ELSE 0.0::DOUBLE END + (CASE WHEN contains(l, 'name') OR contains(l, 'title') OR contains(l, 'id') THEN 0.1 WHEN contains(l, 'notes') OR contains(l, 'comments') OR contains(l, 'remarks') THEN 0.9 ELSE 0.5 END)::DOUBLE + i / 10.0::DOUBLE)
/ CASE WHEN letter THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END)) AS BIGINT) AS position FROM b""",
    "place_examples": "SELECT * FROM ("
    + _values([
        (0, 31, 1.0, "exact"), (1, 2, 0.8, "exact"), (2, 18, 1.0, "exact"), (3, 3, 1.0, "exact"), (4, 12, 0.89, "fuzzy"), (5, 33, 0.9, "context"), (6, 0, 0.81, "fuzzy"), (7, 4, 0.9, "context"), (8, 9, 0.9, "context"),
        (9, 9, 0.3, "fallback"), (10, 9, 0.3, "fallback"), (11, 9, 0.3, "fallback"), (12, 887, 0.3, "fallback"),
    ])
    + ") t(entry_id, position, confidence, method)",
    "phrase_matches": rf"""WITH {_E}, sd AS (SELECT session_id, max(doc_id) AS doc_id FROM processing_sessions GROUP BY 1),
a AS (SELECT e.entry_id, {_plain('e.entry_key')} AS s, length(coalesce(e.entry_key, '')) AS n, coalesce(d.text, '') AS raw, {_plain('d.text')} AS t FROM e JOIN sd USING (session_id) JOIN documents d USING (doc_id)),
w AS (SELECT *, list_filter(string_split(s, ' '), lambda x: x <> '') AS ws FROM a WHERE s <> ''),
p AS (SELECT entry_id, raw, t, 1.0 AS similarity, s AS run, n AS len, 1 AS i, 1 AS j FROM w WHERE contains(t, s)
      UNION ALL SELECT entry_id, raw, t, length(run) / length(s), run, length(run), i, j FROM (SELECT *, array_to_string(ws[i:j], ' ') AS run FROM (SELECT *, unnest(range(i, len(ws) + 1)) AS j FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE NOT contains(t, s) AND len(ws) > 1))) WHERE length(run) > 3 AND contains(t, run)),
r AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY similarity DESC, i, j) AS rank, instr(t, run) - 1 AS pos FROM p)
SELECT entry_id, CAST(rank AS INT) AS rank, round_even(similarity, 6) AS similarity, raw[greatest(0, pos - 100) + 1:greatest(0, pos + len + 100)] AS context FROM r WHERE rank <= 3""",
    "fidelity_score": rf"""WITH {_E}, sd AS (SELECT session_id, max(doc_id) AS doc_id FROM processing_sessions GROUP BY 1),
a AS (SELECT doc_id, {_plain('e.entry_key')} AS k, {_plain('e.entry_value')} AS v, {_plain('d.text')} AS t FROM e JOIN sd USING (session_id) JOIN documents d USING (doc_id)),
b AS (SELECT *, {_some('k')} AS fk, {_some('v')} AS fv FROM a),
g AS (SELECT doc_id, count(*) AS total_entries, count(*) FILTER (fk AND fv) AS perfect_matches, count(*) FILTER (fk <> fv) AS partial_matches, count(*) FILTER (NOT fk AND NOT fv) AS missing_entries, sum(length(k) + length(v)) AS said, max(length(t)) AS n FROM b GROUP BY 1),
h AS (SELECT doc_id, total_entries, perfect_matches, partial_matches, missing_entries, round_even((perfect_matches + partial_matches * 0.5) / total_entries, 6)::DOUBLE AS fidelity, round_even(CASE WHEN n > 0 THEN least(1.0, said / n) ELSE 0.0 END, 6)::DOUBLE AS coverage FROM g)
SELECT *, CASE WHEN fidelity >= 0.9 THEN 'EXCELLENT' WHEN fidelity >= 0.75 THEN 'GOOD' WHEN fidelity >= 0.5 THEN 'FAIR' ELSE 'POOR' END AS band FROM h""",
    "context_state": """WITH c AS (SELECT session_id, chunk_id, max(status) AS status, max(entries_count) AS n FROM semantic_chunks GROUP BY 1, 2),
a AS (SELECT session_id, chunk_id, CAST(coalesce(sum(CAST(coalesce(status = 'success', false) AS INT)) OVER w, 0) AS BIGINT) AS processed_chunks, CAST(coalesce(sum(1 - CAST(coalesce(status = 'success', false) AS INT)) OVER w, 0) AS BIGINT) AS failed_chunks,
CAST(coalesce(sum(CASE WHEN status = 'success' THEN coalesce(n, 0) ELSE 0 END) OVER w, 0) AS BIGINT) AS total_entries FROM c WINDOW w AS (PARTITION BY session_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT *, least(processed_chunks, 5) * 2 AS context_messages, round_even(CASE WHEN processed_chunks > 0 THEN total_entries / processed_chunks ELSE 0.0 END, 1)::DOUBLE AS avg_entries_per_chunk, round_even(processed_chunks * 100.0 / greatest(1, processed_chunks + failed_chunks), 1)::DOUBLE AS success_rate FROM a""",
    "field_patterns": rf"WITH {_E} SELECT session_id, lower({_strip('entry_key')}) AS name, min_by(entry_key, entry_id) AS spelling, count(*) AS uses FROM e WHERE length({_strip('entry_key')}) > 0 GROUP BY 1, 2",
    "column_synonyms": f"WITH {_E} SELECT entry_id, 'Comments+ENTRY-VALUE' AS names, coalesce(entry_value, 'spare') AS value, comments AS comment FROM e",
    "pretty_entries": "WITH "
    + _E
    + """ SELECT entry_id, '{' || chr(10) || '  "Key": ' || coalesce(CAST(to_json(entry_key) AS VARCHAR), 'null') || ',' || chr(10) || '  "Value": ' || coalesce(CAST(to_json(entry_value) AS VARCHAR), 'null') || ',' || chr(10) || '  "Comments": ' || coalesce(CAST(to_json(comments) AS VARCHAR), 'null') || chr(10) || '}' AS json FROM e""",
    "frame_round_trip": "SELECT DISTINCT session_id AS session, c.chunk_id AS chunk, c.status AS status, c.entries_count AS entries_count FROM (SELECT session_id, unnest(chunk_results) AS c FROM processing_sessions)",
    "upsert_latest": "SELECT DISTINCT ON (feedback_id) feedback_id, received_ts, rating FROM user_feedback WHERE feedback_id IS NOT NULL ORDER BY feedback_id, received_ts DESC NULLS LAST, rating DESC NULLS LAST",
    "dedup_counts": _DEDUP + "SELECT i AS input_count, n AS after_validation, n AS after_normalization, n AS after_repair, n AS after_fuzzy, o AS after_exact, o AS final_count, t AS truncation_repairs, 0 AS fuzzy_duplicates_removed, n - o AS exact_duplicates_removed, round_even((1 - o / i) * 100, 1)::DOUBLE AS reduction_percentage FROM s",
    "consolidation_examples": "SELECT * FROM ("
    + _values([
        (1, 1, 2, 2, "as agreed in the letter", "1200 EUR for the whole trip"), (1, 3, 3, 1, None, "Main Hall 5"), (2, 11, 12, 2, "first | a second, longer one", "85% overall in 2019"), (2, 13, 13, 1, None, "Main Hall 5"),
        (3, 21, 21, 2, None, "85% overall in 2019 as a grade (2019-2020)"), (4, 31, 32, 2, None, "The harbor is closed in winter"),
    ])
    + ") t(session_id, first_order, best_order, n, comments, value)",
    "stage_examples": "SELECT 12 AS input_count, 10 AS after_validation, 10 AS after_normalization, 10 AS after_repair, 6 AS after_fuzzy, 6 AS after_exact, 6 AS final_count, 1 AS truncation_repairs, 4 AS fuzzy_duplicates_removed, 0 AS exact_duplicates_removed, 50.0::DOUBLE AS reduction_percentage",
    "window_examples": "SELECT * FROM ("
    + _values([(1, 1, 0, 160, 160, "1-160"), (1, 2, 180, 261, 79, "181-261"), (2, 1, 0, 200, 200, "1-200"), (2, 2, 180, 380, 200, "181-380"), (2, 3, 360, 500, 140, "361-500"), (5, 1, 0, 200, 200, "1-200"), (5, 2, 180, 261, 81, "181-261")])
    + ") t(doc_id, chunk_id, start_pos, end_pos, length, char_range)",
}
