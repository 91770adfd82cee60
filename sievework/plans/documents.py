"""Queries over documents, chunks, entries and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import scalars
from sievework.operators import chunking, textmetrics
from sievework.operators import entries as en
from sievework.plans.pipeline import extract_documents
from sievework.sources import llm_output
from sievework.sources.tables import expired, read_table
from sievework.streaming import progress


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entries").dropDuplicates(["entry_id"])


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row per session and chunk, the one with the largest content."""
    c = read_table(spark, d, "semantic_chunks").groupBy("session_id", "chunk_id").agg(F.max(F.struct(F.coalesce("content", F.lit("")).alias("content"), "header")).alias("c"))
    return c.select("session_id", "chunk_id", "c.content", "c.header")


def _said(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and text of every entry, through its session."""
    s = read_table(spark, d, "processing_sessions").groupBy("session_id").agg(F.max("doc_id").alias("doc_id"))
    e = _entries(spark, d)
    text = F.concat_ws(" ", "entry_key", "entry_value", "comments")
    return e.join(s, "session_id").select("doc_id", text.alias("text"), "entry_key", "entry_value")


def content_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return textmetrics.content_counts(_docs(spark, d))


def word_coverage(spark: SparkSession, d: str) -> DataFrame:
    return textmetrics.word_coverage(_docs(spark, d), _said(spark, d))


def content_gaps(spark: SparkSession, d: str) -> DataFrame:
    return textmetrics.content_gaps(_docs(spark, d), _said(spark, d))


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.semantic_chunks(_docs(spark, d))


def chunk_page_ranges(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.semantic_chunks(_docs(spark, d))
    return c.groupBy("page_range").agg(F.count("*").alias("chunks"), F.sum("content_length").alias("characters"))


def char_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.char_chunks(_docs(spark, d))


def _literal_keys(spark: SparkSession) -> DataFrame:
    keys = ["Session 1A", "Room 2B", "10th Grade", "Grade 10th", "10th-Grade", "3rd Floor", "Th Grade", "12:30 pm Lunch", "3/4/2024 Talk", "1. Intro", "Year-3rd"]
    return spark.createDataFrame([(k,) for k in keys], "entry_key string")


def normalize_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = _entries(spark, d).select("entry_key").unionByName(_literal_keys(spark)).distinct()
    return keys.select("entry_key", en.normalize_key(F.col("entry_key")).alias("normalized"))


def ordinal_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = _entries(spark, d).select("entry_key").unionByName(_literal_keys(spark)).distinct()
    return keys.select("entry_key", en.has_ordinal(F.col("entry_key")).alias("has_ordinal"))


def entry_signature(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("entry_id", en.signature(F.col("entry_key"), F.col("entry_value")).alias("signature"))


def validate_entries(spark: SparkSession, d: str) -> DataFrame:
    return en.validation_counts(_entries(spark, d))


def exact_key_dedup(spark: SparkSession, d: str) -> DataFrame:
    return en.exact_key_dedup(_entries(spark, d), "session_id", "entry_id")


def truncation_repair(spark: SparkSession, d: str) -> DataFrame:
    return en.repair_marked(_entries(spark, d), "session_id", "entry_id")


def position_order(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).select("session_id", "entry_id", "chunk_id")
    return en.document_order(e, "session_id", "entry_id", spread=True).select("session_id", "entry_id", "final_position", F.col("#").alias("row_number"))


def global_note_row(spark: SparkSession, d: str) -> DataFrame:
    """The header of a session's first chunk that has one, put before the comments of its first entry."""
    c = _chunks(spark, d).filter("header is not null")
    notes = c.groupBy("session_id").agg(F.min(F.struct("chunk_id", "header")).alias("h")).select("session_id", F.col("h.header").alias("note"))
    e = _entries(spark, d).select("session_id", "entry_id", "comments")
    return en.with_global_note(e, notes, "session_id", "entry_id")


def context_ring(spark: SparkSession, d: str) -> DataFrame:
    return en.context_ring(_chunks(spark, d), "session_id", "chunk_id", "content").select("session_id", "chunk_id", "context")


def _progress(spark: SparkSession, d: str) -> DataFrame:
    """Three events per chunk result of the sessions."""
    s = read_table(spark, d, "processing_sessions").select("session_id", F.inline("chunk_results")).select("session_id", "chunk_id", "status", "entries_count").distinct()
    kinds = F.array(*(F.struct(F.lit(k).alias("event"), F.lit(i).cast("long").alias("seq")) for k, i in progress.RANK.items()))
    return s.select(F.col("session_id").alias("session"), F.col("chunk_id").alias("chunk"), "status", "entries_count", F.inline(kinds))


def progress_fold(spark: SparkSession, d: str) -> DataFrame:
    return progress.fold_batch(_progress(spark, d)).groupBy("session").agg(F.count_if(F.col("state") == "success").alias("success"), F.count_if(F.col("state") == "error").alias("error"), F.count("*").alias("chunks"))


def logical_sort(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).select("entry_id", en.logical_priority(F.col("entry_key")).alias("priority"), F.lower("entry_key").alias("key"))
    return e.orderBy("priority", "key", "entry_id")


def error_categories(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "semantic_chunks").distinct().filter("error is not null")
    return c.groupBy(en.error_category(F.col("error")).alias("category")).agg(F.count("*").alias("n"))


def json_salvage(spark: SparkSession, d: str) -> DataFrame:
    """Each entry as one fenced object in prose, read back."""
    e = _entries(spark, d)
    obj = F.to_json(F.struct(F.col("entry_key").alias("KEY"), F.col("entry_value").alias("value"), F.col("comments").alias("Comment")))
    text = e.select("entry_id", F.concat(F.lit("Here it is:\n```json\n"), obj, F.lit("\n```\nDone.")).alias("text"))
    return llm_output.unnested(text, "entry_id", "text").select("entry_id", "Key", "Value", "Comments")


def llm_unnest(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's entries as one wrapped payload, read back."""
    e = _entries(spark, d).groupBy("session_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("entry_id", F.col("entry_key").alias("Key"), F.col("entry_value").alias("Value")))).alias("entries"))
    text = e.select(F.concat_ws("/", "session_id", F.col("chunk_id").cast("string")).alias("id"), F.concat(F.lit("Note: "), F.to_json(F.struct(F.lit("n").alias("global_notes"), "entries"))).alias("text"))
    return llm_output.unnested(text, "id", "text").select("id", "pos", "Key", "Value")


def field_names(spark: SparkSession, d: str) -> DataFrame:
    """The first spelling of each key, case ignored."""
    e = _entries(spark, d).groupBy(F.lower("entry_key").alias("key")).agg(F.min(F.struct("entry_id", "entry_key")).alias("f"), F.count("*").alias("n"))
    return e.select("key", F.col("f.entry_key").alias("spelling"), "n")


def column_visibility(spark: SparkSession, d: str) -> DataFrame:
    return en.visible_columns(_entries(spark, d), "comments", "extractor", "source")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return progress.event_windows(read_table(spark, d, "events"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return progress.event_sessions(read_table(spark, d, "events"))


def extraction_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return extract_documents(_docs(spark, d))


def field_titles(spark: SparkSession, d: str) -> DataFrame:
    keys = _entries(spark, d).select("entry_key").unionByName(_literal_keys(spark)).distinct()
    return keys.select("entry_key", scalars.field_title(F.col("entry_key")).alias("title"))


def file_size_labels(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", scalars.file_size_label(F.col("file_size")).alias("label"))


def fresh_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the last 90 days."""
    return expired(read_table(spark, d, "performance_metrics").dropDuplicates(["metric_id"])).select("metric_id", "created_ts")


def batch_stats(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and failures per batch of five of each session's chunks."""
    c = _statuses(spark, d)
    return c.groupBy("session_id", F.floor((F.col("chunk_id") - 1) / 5).cast("int").alias("batch")).agg(F.count("*").alias("chunks"), F.max("failed").alias("any_failed"), F.sum("failed").alias("failed"))


def _statuses(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "semantic_chunks").groupBy("session_id", "chunk_id")
    return c.agg(F.max((F.col("status") == "error").cast("int")).alias("failed"))


def recent_completions(spark: SparkSession, d: str) -> DataFrame:
    """The last three chunks of each session that succeeded, in order."""
    c = _statuses(spark, d).filter("failed = 0").groupBy("session_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    return c.select("session_id", F.array_join(F.slice("ids", F.greatest(F.lit(1), F.size("ids") - 2), 3).cast("array<string>"), ",").alias("last_chunks"))


def entry_problems(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).select("entry_id", F.array_join(scalars.entry_errors(F.col("entry_key"), F.col("entry_value")), ", ").alias("problems"))
    return e.filter("problems <> ''")


def key_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the tokens of each entry's key and value."""
    return _entries(spark, d).select("entry_id", F.bround(scalars.token_jaccard(F.col("entry_key"), F.col("entry_value")), 6).alias("overlap"))


_NAMES = (
    field_titles, file_size_labels, fresh_metrics, batch_stats, recent_completions, entry_problems, key_overlap,
    content_type_counts, word_coverage, content_gaps, semantic_chunks, chunk_page_ranges, char_chunks, normalize_keys, ordinal_keys, entry_signature,
    validate_entries, exact_key_dedup, truncation_repair, position_order, global_note_row, context_ring, progress_fold,
    logical_sort, error_categories, json_salvage, llm_unnest, field_names, column_visibility, event_windows, event_sessions, extraction_pipeline,
)
QUERIES = {f.__name__: f for f in _NAMES}

# --- the same in SQL ---------------------------------------------------------------------------------------------------------


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _q(text: str) -> str:
    return text.replace("'", "''")


_CT = {
    "dates": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\w+ \d{4}\b", "percentages": r"\d+\.?\d*%", "phone_numbers": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "emails": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b", "numbers": r"\b\d+\b", "urls": r"https?://[^\s]+",
}
_E = "e AS (SELECT DISTINCT ON (entry_id) * FROM entries ORDER BY entry_id)"
_C = "c AS (SELECT DISTINCT ON (session_id, chunk_id) session_id, chunk_id, coalesce(content, '') AS content, header FROM semantic_chunks ORDER BY session_id, chunk_id, coalesce(content, '') DESC, header DESC NULLS LAST)"
_SAID = _E + ", sd AS (SELECT session_id, max(doc_id) AS doc_id FROM processing_sessions GROUP BY 1), said AS (SELECT sd.doc_id, concat_ws(' ', entry_key, entry_value, comments) AS text FROM e JOIN sd USING (session_id))"
_W3 = r"list_distinct(regexp_extract_all(lower({}), '\b[a-z]{{3,}}\b'))"
_PH = "(entry_value IS NULL OR lower(trim(entry_value, ' ' || chr(9) || chr(10) || chr(13))) IN ('', " + ", ".join(f"'{w}'" for w in ("null", "none", "n/a", "na", "nil", "undefined", "empty", "missing", "unknown", "blank")) + "))"
_KEYS = f"WITH {_E}, k AS (SELECT entry_key FROM e UNION SELECT unnest(['Session 1A', 'Room 2B', '10th Grade', 'Grade 10th', '10th-Grade', '3rd Floor', 'Th Grade', '12:30 pm Lunch', '3/4/2024 Talk', '1. Intro', 'Year-3rd']))"
_ORD = r"(coalesce(NOT regexp_matches({0}, '\b(session|meeting|room|track|hall|floor)\b') AND regexp_matches({0}, '\b\d+(st|nd|rd|th)(\s+|[-_])\w+\b|\b\w+(\s+|[-_])\d+(st|nd|rd|th)\b'), false))"
_CHUNKS = rf"""
WITH d AS (SELECT doc_id, text, coalesce(total_pages, 1) AS pages, string_split(text, chr(10)) AS l FROM documents WHERE length({_strip('text')}) > 0),
a AS (SELECT *, list_transform(l, lambda x: {_strip('x')}) AS st, len(l) AS n FROM d),
b AS (SELECT *, list_filter(range(n), lambda i: length(st[i + 1]) > 3 AND regexp_matches(st[i + 1], '{_q(chunking.HEADER)}')) AS hit, greatest(1, n // least(8, greatest(1, n // 50))) AS step FROM a),
f AS (SELECT *, CASE WHEN len(hit) >= 3 THEN hit ELSE range(0, n, step) END AS starts FROM b),
g AS (SELECT doc_id, text, pages, l, st, n, len(hit) >= 3 AS real, starts, unnest(starts) AS s, unnest(range(1, len(starts) + 1)) AS i FROM f),
h AS (SELECT *, coalesce(starts[i + 1], n) AS e FROM g),
k AS (SELECT *, {_strip("array_to_string(l[s + 1:e], chr(10))")} AS own, greatest(0, s - greatest(2, (e - s) // 7)) AS p FROM h),
m AS (SELECT *, array_to_string(l[p + 1:s], chr(10)) AS before FROM k WHERE length(own) > 100),
o AS (SELECT *, CASE WHEN i > 1 AND e - s > 10 AND length({_strip('before')}) > 0 THEN before || chr(10) || own ELSE own END AS content,
      CASE WHEN s > 0 THEN length(array_to_string(l[1:s], chr(10))) + 1 ELSE 0 END AS pos, length(text) / greatest(1, pages) AS cpp FROM m),
q AS (SELECT *, greatest(1, CAST(floor(pos / cpp) AS INT) + 1) AS fp FROM o),
r AS (SELECT *, least(fp, pages) AS start_page, least(greatest(fp, CAST(floor((pos + length(content)) / cpp) AS INT) + 1), pages) AS end_page FROM q),
x AS (SELECT doc_id, CAST(i AS INT) AS chunk_id, content, CASE WHEN real THEN st[s + 1] ELSE coalesce(list_filter(st[greatest(0, s - 5) + 1:least(n, s + 10)], lambda z: length(z) > 5)[1][1:50], 'Content Section') END AS header, 'semantic_section' AS section_type,
      CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line, CAST(length(content) AS INT) AS content_length, start_page, end_page, CASE WHEN start_page <> end_page THEN start_page || '-' || end_page ELSE CAST(start_page AS VARCHAR) END AS page_range FROM r
      UNION ALL SELECT doc_id, 1, {_strip('text')}, 'Full Content', 'full_content', 0, CAST(n AS INT), CAST(length(text) AS INT), 1, pages, '1' FROM a WHERE doc_id NOT IN (SELECT doc_id FROM m))
"""


# The priorities and kinds of errors, written out once more.
_PRIORITY = """CASE WHEN regexp_matches(k, 'full name|name|birthdate|birth|age|blood|nationality') THEN 1 WHEN regexp_matches(k, 'current company|current position|current salary|current start') THEN 2
WHEN regexp_matches(k, 'previous company|previous position|previous salary|previous start|previous end|previous joining|previous starting') THEN 3 WHEN regexp_matches(k, 'first company|first position|first salary|first job') THEN 4
WHEN regexp_matches(k, 'graduation|cgpa|degree|college|university|school|b-tech|hi-tech|class rank|overall score|thesis') THEN 5 WHEN regexp_matches(k, 'certification|aws|azure|safe|pmp|project management') THEN 6
WHEN regexp_matches(k, 'proficiency|skill|python|sql|visualization|cloud|experience') THEN 7 ELSE 8 END"""
_KIND = """CASE WHEN regexp_matches(m, 'rate limit|429') THEN 'rate_limit' WHEN regexp_matches(m, 'timeout|timed out') THEN 'timeout' WHEN regexp_matches(m, 'api|openai') THEN 'api_error' WHEN regexp_matches(m, 'connection|network') THEN 'connection_error'
WHEN regexp_matches(m, 'invalid|parse|json') THEN 'data_error' WHEN regexp_matches(m, 'auth|key') THEN 'auth_error' ELSE 'unknown_error' END"""

# Of the keys in k (column entry_key) the forms that normalizing goes through; n, or raw where it is empty, is the result.
_NORM = r""", a AS (SELECT entry_key, lower(""" + _strip("entry_key") + r""") AS raw, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(""" + _strip("entry_key") + r"""), '\b\d+(st|nd|rd|th)?\s*(session|room|track|hall)\b', '', 'g'), '\b(session|room|track|hall)\s*[a-z0-9]+\b', '', 'g'), '\b\d{1,2}:\d{2}(\s*(am|pm))?\b', '', 'g'), '\b\d{1,2}/\d{1,2}(/\d{2,4})?\b', '', 'g') AS k FROM k),
b AS (SELECT *, """ + _ORD.format("k") + r""" AS keep, regexp_replace(regexp_replace(regexp_replace(k, '\b\d+(st|nd|rd|th)\b', '', 'g'), '^\d+\s*[-:.]?\s*', ''), '\s*[-:.]\s*\d+$', '') AS plain FROM a),
c AS (SELECT *, regexp_replace(""" + _strip(r"regexp_replace(CASE WHEN keep THEN k ELSE plain END, '[\s\p{Z}]+', ' ', 'g')") + r""", '^[ \-:.,;]+|[ \-:.,;]+$', '', 'g') AS t FROM b),
f AS (SELECT entry_key, raw, CASE WHEN keep THEN array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') ELSE t END AS n FROM c)"""


SQL = {
    "field_titles": _KEYS + r""", a AS (SELECT entry_key, regexp_replace(regexp_replace(regexp_replace(""" + _strip("entry_key") + r""", '\b\d+[A-Z]?\b', '', 'g'), '^\d+\s*[-:.]?\s*', ''), '\s*[-:.]\s*\d+$', '') AS s FROM k),
b AS (SELECT entry_key, lower(regexp_replace(regexp_replace(s, '[\s\p{Z}]+', ' ', 'g'), '^[ \-:.,;]+|[ \-:.,;]+$', '', 'g')) AS t FROM a) SELECT entry_key, array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS title FROM b""",
    "file_size_labels": "SELECT doc_id, CASE WHEN file_size <= 0 THEN '0 Bytes' ELSE regexp_replace(printf('%.2f', round_even(file_size / pow(1024.0, p), 2)), '\\.?0+$', '') || ' ' || (['Bytes', 'KB', 'MB', 'GB', 'TB'])[p + 1] END AS label FROM (SELECT doc_id, file_size, least(CAST(floor(log2(greatest(file_size, 1)) / 10) AS INT), 4) AS p FROM documents)",
    "fresh_metrics": "SELECT DISTINCT metric_id, created_ts FROM performance_metrics WHERE created_ts >= (SELECT max(created_ts) FROM performance_metrics) - INTERVAL 90 DAY",
    "batch_stats": "WITH c AS (SELECT session_id, chunk_id, max(CAST(status = 'error' AS INT)) AS failed FROM semantic_chunks GROUP BY 1, 2) SELECT session_id, CAST((chunk_id - 1) // 5 AS INT) AS batch, count(*) AS chunks, max(failed) AS any_failed, CAST(sum(failed) AS BIGINT) AS failed FROM c GROUP BY 1, 2",
    "recent_completions": "WITH c AS (SELECT session_id, chunk_id FROM semantic_chunks GROUP BY 1, 2 HAVING max(CAST(status = 'error' AS INT)) = 0), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY chunk_id DESC) AS i FROM c) SELECT session_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY chunk_id) AS last_chunks FROM r WHERE i <= 3 GROUP BY 1",
    "entry_problems": f"WITH {_E}, a AS (SELECT entry_id, concat_ws(', ', CASE WHEN entry_key IS NULL THEN 'key missing' WHEN length({_strip('entry_key')}) = 0 THEN 'key blank' WHEN length({_strip('entry_key')}) < 2 THEN 'key too short' END, CASE WHEN entry_value IS NULL THEN 'value missing' WHEN length({_strip('entry_value')}) = 0 THEN 'value blank' END) AS problems FROM e) SELECT * FROM a WHERE problems <> ''",
    "key_overlap": f"WITH {_E}, a AS (SELECT entry_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(entry_key, '')), '\\s+'), lambda t: t <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(entry_value, '')), '\\s+'), lambda t: t <> '')) AS y FROM e) SELECT entry_id, round_even(CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0.0 END, 6) AS overlap FROM a",
    "content_type_counts": "SELECT doc_id, length(t) AS total_characters, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) AS total_words, len(" + _W3.format("t") + ") AS unique_words, "
    + ", ".join(f"len(regexp_extract_all(t, '{_q(p)}')) AS {n}" for n, p in _CT.items())
    + f", len(list_filter(string_split(t, chr(10) || chr(10)), lambda p: length({_strip('p')}) > 50)) AS paragraphs, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[ \\t]*[•\\-*][ \\t]+'))) AS bullet_points, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[A-Z][A-Z ]{{5,}}$'))) AS headings FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "word_coverage": f"WITH {_SAID}, o AS (SELECT DISTINCT doc_id, unnest({_W3.format('text')}) AS w FROM documents), g AS (SELECT DISTINCT doc_id, unnest({_W3.format('text')}) AS w FROM said), "
    "j AS (SELECT o.doc_id, count(*) AS document_words, count(g.w) AS captured_words FROM o LEFT JOIN g ON o.doc_id = g.doc_id AND o.w = g.w GROUP BY 1), "
    "x AS (SELECT d.doc_id, coalesce(document_words, 0) AS document_words, coalesce(captured_words, 0) AS captured_words, coalesce(round_even(captured_words / document_words, 6), 0.0) AS word_coverage FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN j USING (doc_id)) "
    "SELECT *, CASE WHEN word_coverage < 0.3 THEN 'LOW' WHEN word_coverage < 0.6 THEN 'MODERATE' ELSE 'GOOD' END AS band FROM x",
    "content_gaps": f"WITH {_SAID}, " + ", ".join(
        f"{name} AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS content_type, len(regexp_extract_all(coalesce(text, ''), '{_q(p)}')) AS n FROM {src}" for n, p in _CT.items()) + ")" for name, src in (("o", "documents"), ("g0", "said"))
    ) + ", g AS (SELECT doc_id, content_type, sum(n) AS captured FROM g0 GROUP BY 1, 2) SELECT o.doc_id, o.content_type, n AS in_document, CAST(coalesce(captured, 0) AS BIGINT) AS captured, round_even(coalesce(captured, 0) / n, 6) AS capture_rate, CAST(n - coalesce(captured, 0) AS BIGINT) AS lost FROM o LEFT JOIN g ON o.doc_id = g.doc_id AND o.content_type = g.content_type WHERE n > 0",
    "semantic_chunks": _CHUNKS + "SELECT * FROM x",
    "chunk_page_ranges": _CHUNKS + "SELECT page_range, count(*) AS chunks, CAST(sum(content_length) AS BIGINT) AS characters FROM x GROUP BY 1",
    "normalize_keys": _KEYS + _NORM + " SELECT entry_key, CASE WHEN n = '' THEN raw ELSE n END AS normalized FROM f",
    "ordinal_keys": _KEYS + "SELECT entry_key, " + _ORD.format("lower(entry_key)") + " AS has_ordinal FROM k",
    "entry_signature": f"WITH {_E}, a AS (SELECT entry_id, lower({_strip(chr(99) + 'oalesce(entry_key, ' + chr(39) * 2 + ')')}) AS k, lower({_strip(chr(99) + 'oalesce(entry_value, ' + chr(39) * 2 + ')')}) AS v FROM e) SELECT entry_id, CASE WHEN k = '' AND v = '' THEN '' ELSE k || ':' || v[1:50] END AS signature FROM a",
    "validate_entries": f"WITH {_E}, a AS (SELECT coalesce(length({_strip('entry_key')}) < 2, true) AS bk, {_PH} AS bv FROM e) SELECT count(*) AS total, count(*) FILTER (bk) AS bad_keys, count(*) FILTER (bv) AS bad_values, count(*) FILTER (NOT bk AND NOT bv) AS valid, round_even(count(*) FILTER (NOT bk AND NOT bv) / count(*), 6) AS success_rate FROM a",
    "exact_key_dedup": f"""WITH {_E}, a AS (SELECT session_id, entry_id, lower({_strip("coalesce(entry_key, '')")}) AS dedup_key, {_strip("coalesce(entry_value, '')")} AS v, {_strip("coalesce(comments, '')")} AS c, length({_strip("entry_key")}) / 2 AS kl FROM e),
s AS (SELECT *, CASE WHEN length(c) > 0 THEN 50 ELSE 0 END + length(v) + CASE WHEN regexp_matches(v, '[0-9]') THEN 20 ELSE 0 END + CASE WHEN ends_with(v, '...') OR ends_with(v, '…') THEN 0 ELSE 30 END + kl AS score FROM a),
n AS (SELECT session_id, dedup_key, string_agg(c, ' | ' ORDER BY o) AS comments FROM (SELECT session_id, dedup_key, c, min(entry_id) AS o FROM a WHERE length(c) > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
b AS (SELECT DISTINCT ON (session_id, dedup_key) session_id, dedup_key, entry_id AS best_order FROM s ORDER BY session_id, dedup_key, score DESC, entry_id),
g AS (SELECT session_id, dedup_key, min(entry_id) AS first_order, count(*) AS n FROM a GROUP BY 1, 2)
SELECT g.session_id, g.dedup_key, first_order, best_order, g.n, comments FROM g JOIN b USING (session_id, dedup_key) LEFT JOIN n USING (session_id, dedup_key)""",
    "truncation_repair": f"""WITH {_E}, a AS (SELECT session_id, entry_id, lower({_strip("coalesce(entry_key, '')")}) AS k, {_strip("coalesce(entry_value, '')")} AS v FROM e),
m AS (SELECT *, {_strip("regexp_replace(v, '[.…]+$', '')")} AS stem FROM a WHERE (ends_with(v, '...') OR ends_with(v, '…')) AND length(v) > 3)
SELECT DISTINCT ON (m.session_id, m.entry_id) m.session_id, m.entry_id, a.v AS repaired FROM m JOIN a ON a.session_id = m.session_id AND a.entry_id <> m.entry_id AND length(m.stem) > 0 AND starts_with(lower(a.v), lower(m.stem)) AND length(a.v) > length(m.stem)
AND NOT (ends_with(a.v, '...') OR ends_with(a.v, '…')) AND levenshtein(m.k, a.k) <= 0.3 * greatest(length(m.k), length(a.k)) ORDER BY m.session_id, m.entry_id, a.entry_id""",
    "position_order": f"WITH {_E}, a AS (SELECT session_id, entry_id, chunk_id, row_number() OVER (PARTITION BY session_id ORDER BY entry_id) - 1 AS i FROM e), b AS (SELECT *, coalesce(chunk_id, 0) * 100000 + CAST(floor((i / 10 + 0.5) * 500) AS BIGINT) AS final_position FROM a) SELECT session_id, entry_id, final_position, row_number() OVER (PARTITION BY session_id ORDER BY final_position, i) AS row_number FROM b",
    "global_note_row": f"WITH {_E}, {_C}, h AS (SELECT DISTINCT ON (session_id) session_id, header AS note FROM c WHERE header IS NOT NULL ORDER BY session_id, chunk_id, header), a AS (SELECT e.session_id, entry_id, comments, note, row_number() OVER (PARTITION BY e.session_id ORDER BY entry_id) AS i FROM e LEFT JOIN h USING (session_id)) SELECT session_id, entry_id, CASE WHEN i = 1 AND note IS NOT NULL THEN concat_ws(' | ', '[GLOBAL NOTE: ' || note || ']', CASE WHEN length({_strip(chr(99) + 'oalesce(comments, ' + chr(39) * 2 + ')')}) > 0 THEN comments END) ELSE comments END AS comments FROM a",
    "context_ring": f"WITH {_C} SELECT session_id, chunk_id, coalesce(string_agg(CASE WHEN length(content) > 500 THEN content[1:500] || '...' ELSE content END, chr(10)) OVER (PARTITION BY session_id ORDER BY chunk_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS context FROM c",
    "progress_fold": "WITH r AS (SELECT DISTINCT session_id, unnest(chunk_results) AS c FROM processing_sessions), x AS (SELECT session_id, c.chunk_id AS k, max(CASE WHEN c.status = 'error' THEN 1 ELSE 0 END) AS bad FROM r GROUP BY 1, 2) SELECT session_id AS session, count(*) FILTER (bad = 0) AS success, count(*) FILTER (bad = 1) AS error, count(*) AS chunks FROM x GROUP BY 1",
    "logical_sort": f"WITH {_E} SELECT entry_id, {_PRIORITY} AS priority, key FROM (SELECT entry_id, lower(coalesce(entry_key, '')) AS k, lower(entry_key) AS key FROM e) ORDER BY priority, key, entry_id",
    "error_categories": f"SELECT {_KIND} AS category, count(*) AS n FROM (SELECT lower(error) AS m FROM (SELECT DISTINCT * FROM semantic_chunks) WHERE error IS NOT NULL) GROUP BY 1",
    "json_salvage": f"WITH {_E} SELECT entry_id, {_strip('entry_key')} AS \"Key\", {_strip('entry_value')} AS \"Value\", {_strip('comments')} AS \"Comments\" FROM e WHERE {_strip('entry_key')} <> '' AND {_strip('entry_value')} <> ''",
    "llm_unnest": f"WITH {_E}, a AS (SELECT session_id || '/' || chunk_id AS id, row_number() OVER (PARTITION BY session_id, chunk_id ORDER BY entry_id) - 1 AS pos, {_strip('entry_key')} AS \"Key\", {_strip('entry_value')} AS \"Value\" FROM e) SELECT * FROM a WHERE \"Key\" <> '' AND \"Value\" <> ''",
    "field_names": f"WITH {_E} SELECT lower(entry_key) AS key, min_by(entry_key, entry_id) AS spelling, count(*) AS n FROM e GROUP BY 1",
    "column_visibility": f"WITH {_E} SELECT " + ", ".join(f"coalesce(bool_or(length({_strip(c)}) > 0), false) AS {c}" for c in ("comments", "extractor", "source")) + " FROM e",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "event_sessions": "WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM b GROUP BY user_id, s",
}
