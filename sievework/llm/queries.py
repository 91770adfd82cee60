"""The pN_ queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm import abuse, canonical, mixing, near_dups, qdigest, splitting, survivorship, tokens, truncation
from sievework.session import written
from sievework.sources.tables import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entries that say nearly the same."""
    pairs = near_dups.near_duplicate_pairs(read_table(spark, sf_dir, "entries"))
    return pairs.select(F.col("id_a").alias("entry_id_a"), F.col("id_b").alias("entry_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each eligible entry with its near-duplicate group and its number of links."""
    rows = near_dups.near_duplicate_groups(read_table(spark, sf_dir, "entries"))
    return rows.select(F.col("id").alias("entry_id"), F.col("group").alias("group_entry_id"), "links")


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = read_table(spark, sf_dir, "entries")
    return survivorship.survivors(entries, read_table(spark, sf_dir, "extractors"), truncation.truncated(entries))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry each field of each group survives from."""
    return survivorship.surviving_fields(_survivors(spark, sf_dir))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record built for each group."""
    return survivorship.golden_records(read_table(spark, sf_dir, "entries"), _survivors(spark, sf_dir))


def p2_of_unmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry each field survives from if only values that end in dots count as cut off."""
    entries = read_table(spark, sf_dir, "entries")
    cut = entries.filter(F.endswith("entry_value", F.lit("...")) | F.endswith("entry_value", F.lit("…"))).select(F.col("entry_id").alias("id")).distinct()
    return survivorship.surviving_fields(survivorship.survivors(entries, read_table(spark, sf_dir, "extractors"), cut))


def p2_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidated entries per session beside the recorded count."""
    return survivorship.consolidation(read_table(spark, sf_dir, "entries"), read_table(spark, sf_dir, "processing_sessions"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies hidden by formatting: the first entry of each set with each other one."""
    rows = canonical.collapse_formatting(read_table(spark, sf_dir, "entries"))
    return rows.filter("id <> first").select(F.col("first").alias("first_entry_id"), F.col("id").alias("entry_id"))


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each set once, with its number of copies."""
    rows = canonical.collapse_formatting(read_table(spark, sf_dir, "entries"))
    return rows.filter("id = first").select(F.col("first").alias("first_entry_id"), "copies")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose value was cut off."""
    return truncation.truncated(read_table(spark, sf_dir, "entries")).select(F.col("id").alias("entry_id"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut entries per source, beside recorded repairs."""
    entries = read_table(spark, sf_dir, "entries")
    return truncation.truncation_rates(entries, truncation.truncated(entries), read_table(spark, sf_dir, "processing_sessions"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(read_table(spark, sf_dir, "semantic_chunks"), read_table(spark, sf_dir, "processing_sessions"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that had to be cut."""
    return _pieces(spark, sf_dir).filter("piece_id = 2").select("session_id", "chunk_id").distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of oversized chunks."""
    return _pieces(spark, sf_dir)


def p6_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each oversized chunk put together again from its pieces without what neighbours share, and whether every piece keeps to the limits."""
    pieces = _pieces(spark, sf_dir)
    chunk = ["session_id", "chunk_id", "header", "page_range", "whole"]
    own = F.expr("substring(piece, if(piece_id = 1, 1, greatest(1, before - start_char + 1)))")
    w = Window.partitionBy(*chunk).orderBy("piece_id")  # pieces of one chunk
    lim = splitting.limits(read_table(spark, sf_dir, "processing_sessions"))
    rows = pieces.withColumn("before", F.lag("end_char").over(w)).join(lim, "session_id")
    fits = (F.length("piece") <= F.col("size")) & F.coalesce(F.col("before") - F.col("start_char") == F.when(F.col("overlap").between(0, F.col("size") - 1), F.col("overlap")).otherwise(0), F.lit(True))
    g = rows.groupBy(*chunk).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_id", own.alias("t")))), lambda x: x["t"]), "").alias("text"), F.bool_and(fits).alias("fits"))
    return g.select("session_id", "chunk_id", F.md5("text").alias("content_hash"), "fits").distinct()


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of every text as decoding gives it back from its ids."""
    return tokens.decode(tokens.encode(read_table(spark, sf_dir, "documents"))).select("doc_id", F.md5("text").alias("text_hash"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(read_table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(mixing.mixed(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "sources"), knots=mixing.curriculum))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix, texts and all, in order of training position, by a curriculum from large sources to small ones."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixing.laid_out(_mix(spark, sf_dir), read_table(spark, sf_dir, "documents"), parts)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.shares(_mix(spark, sf_dir), read_table(spark, sf_dir, "sources"))


def p9_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and share of each source in each tenth of the training time."""
    return mixing.stretches(_mix(spark, sf_dir))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: whether it has texts, whether its share is its target's among the sources with texts, whether no text is used too
    often, and whether its share of the first half of the training time is that of the curriculum; to within 1 and 3 % and two of the longest texts.
    """
    mix, sources = _mix(spark, sf_dir), read_table(spark, sf_dir, "sources")
    one = Window.partitionBy((F.col("texts") > 0).cast("int"))  # over one row a source
    s = mixing.shares(mix, sources)
    s = s.withColumn("want", F.when(F.col("texts") > 0, F.col("target_share") / F.sum("target_share").over(one)).otherwise(0.0))
    s = s.withColumn("i", F.row_number().over(one.orderBy("target_share", "source")) - 1).withColumn("off", F.col("i") - F.sum(F.col("want") * F.col("i")).over(one))
    s = s.withColumn("early", F.col("want") * (1 + 0.25 * F.coalesce(F.try_divide("off", F.max(F.abs("off")).over(one)), F.lit(0.0))))
    half = mixing.stretches(mix, 2).filter("stretch = 1").select("source", F.col("share").alias("got"))
    s = s.join(half, "source", "left")
    s = s.crossJoin(mix.agg((2 * F.max("n_tokens") / F.sum("n_tokens")).alias("grain")))  # with one row
    near = lambda x, y, by: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))) < by + F.coalesce("grain", F.lit(0.0)) * by * 100
    return s.select("source", (F.col("texts") > 0).alias("has_texts"), near(F.col("actual_share"), F.col("want"), 0.01).alias("share_kept"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"), near(F.col("got"), F.col("early"), 0.03).alias("schedule_kept"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "doc_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit language."""
    return _scores(spark, sf_dir).filter(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    return _scores(spark, sf_dir)


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of flagged documents per source."""
    return abuse.rates(read_table(spark, sf_dir, "documents"), _scores(spark, sf_dir))


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qdigest.build(qdigest.session_times(read_table(spark, sf_dir, "processing_sessions")), ["document_type", "measure", "month", "day"], "seconds")


def p3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of processing times per document type and day."""
    return qdigest.read(_digests(spark, sf_dir), ["document_type", "measure", "day"])


def p3_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per document type and month, from the digests of its days."""
    keys = ["document_type", "measure", "month"]
    return qdigest.read(qdigest.merge(_digests(spark, sf_dir), keys), keys)


def p3_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each monthly percentile has the rank it should have among the exact values, to within its stated bound and one leaf."""
    keys = ["document_type", "measure", "month"]
    got = p3_monthly(spark, sf_dir)
    raw = qdigest.session_times(read_table(spark, sf_dir, "processing_sessions")).filter(qdigest.leaf(F.col("seconds")).isNotNull()).select(*keys, "seconds")
    width = F.greatest(F.lit(qdigest.UNIT), F.col("value") / 16_000)
    j = got.join(raw, keys).groupBy(*keys, "n", "p", "value", "rank_error").agg(F.count_if(F.col("seconds") < F.col("value") - width).alias("below"), F.count_if(F.col("seconds") <= F.col("value") + width).alias("upto"), F.count("*").alias("exact_n"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n")))
    return j.select(*keys, "p", ((F.col("n") == F.col("exact_n")) & (F.col("below") - F.col("rank_error") < rank) & (rank <= F.col("upto") + F.col("rank_error"))).alias("within"))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements per document type, measure and month, as the merged digests have them."""
    return qdigest.merge(_digests(spark, sf_dir), ["document_type", "measure", "month"]).select("document_type", "measure", "month", "n")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p2_found, p2_records, p2_of_unmarked, p2_consolidation, p3_daily, p3_monthly, p3_ranks, p3_counts, p4_found, p4_copies, p5_found, p5_rates,
        p6_found, p6_pieces, p6_rejoined, p8_ids, p8_round_trip, p9_mix, p9_shares, p9_stretches, p9_kept, p10_found, p10_scores, p10_rates,
    )
}

_P4 = r"""
WITH e AS (SELECT DISTINCT entry_id, lower(coalesce(entry_key, '')) AS k, entry_value AS v FROM entries
           WHERE entry_value IS NOT NULL AND lower(trim(entry_value, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) NOT IN ('', 'null', 'none', 'n/a', 'na', 'nil', 'undefined', 'empty', 'missing', 'unknown', 'blank')),
b AS (SELECT entry_id, regexp_replace(k, '[^\p{L}\p{N}]+', '', 'g') AS kb, regexp_replace(lower(v), '[^\p{L}\p{N}]+', '', 'g') AS vb,
             list_filter(regexp_split_to_array(lower(v), '[;|\r\n]+'), lambda x: regexp_matches(x, '\S')) AS parts FROM e),
f AS (SELECT entry_id, kb, vb, CASE WHEN len(parts) >= 2 AND len(list_filter(parts, lambda x: NOT regexp_matches(x, '^[^:]*[^:\s][^:]*:'))) = 0
             THEN array_to_string(list_sort(list_transform(parts, lambda x: regexp_replace(x[1:instr(x, ':') - 1], '[^\p{L}\p{N}]+', '', 'g') || ':' || regexp_replace(x[instr(x, ':') + 1:], '[^\p{L}\p{N}]+', '', 'g'))), ';') END AS ff
      FROM b WHERE length(vb) >= 20),
g AS (SELECT entry_id, coalesce(kb || '#' || min(ff) OVER (PARTITION BY kb, vb), kb || '=' || vb) AS s FROM f),
h AS (SELECT s, entry_id, min(entry_id) OVER (PARTITION BY s) AS first_entry_id FROM (SELECT DISTINCT s, entry_id FROM g))
"""
_P1_PAIRS = r"""
WITH RECURSIVE e AS (SELECT DISTINCT entry_id, lower(coalesce(entry_key, '')) AS k, lower(entry_value) AS v FROM entries WHERE entry_value IS NOT NULL),
w AS (SELECT *, regexp_extract_all(v, '[\p{L}\p{N}]+') AS runs FROM e),
r AS (SELECT entry_id, list_distinct(list_concat(runs, regexp_extract_all(k, '[\p{L}\p{N}]+'))) AS ws, regexp_replace(k, '[^\p{L}\p{N}]+', '', 'g') AS kb, regexp_replace(v, '[^\p{L}\p{N}]+', '', 'g') AS vb,
      list_filter(regexp_split_to_array(v, '[;|\r\n]+'), lambda x: regexp_matches(x, '\S')) AS parts FROM w WHERE len(runs) >= 12),
f AS (SELECT entry_id, ws, len(ws) AS n, kb, vb, CASE WHEN len(parts) >= 2 AND len(list_filter(parts, lambda x: NOT regexp_matches(x, '^[^:]*[^:\s][^:]*:'))) = 0
      THEN array_to_string(list_sort(list_transform(parts, lambda x: regexp_replace(x[1:instr(x, ':') - 1], '[^\p{L}\p{N}]+', '', 'g') || ':' || regexp_replace(x[instr(x, ':') + 1:], '[^\p{L}\p{N}]+', '', 'g'))), ';') END AS ff FROM r),
t AS (SELECT entry_id, n, unnest(ws) AS w FROM f), d AS (SELECT w, count(*) AS df FROM t GROUP BY 1),
p AS (SELECT entry_id, w FROM (SELECT entry_id, n, w, row_number() OVER (PARTITION BY entry_id ORDER BY df, w) AS i FROM t JOIN d USING (w)) WHERE i <= n - (7 * n + 9) // 10 + 1),
c AS (SELECT DISTINCT a.entry_id AS a, b.entry_id AS b FROM p a JOIN p b ON a.w = b.w AND a.entry_id < b.entry_id)
"""
_P1 = _P1_PAIRS + r"""SELECT c.a AS entry_id_a, c.b AS entry_id_b FROM c JOIN f x ON x.entry_id = c.a JOIN f y ON y.entry_id = c.b
WHERE 10 * len(list_intersect(x.ws, y.ws)) >= 7 * (x.n + y.n - len(list_intersect(x.ws, y.ws))) AND (x.kb <> y.kb OR (x.vb <> y.vb AND (x.ff IS NULL OR y.ff IS NULL OR x.ff <> y.ff)))
"""
# Components by the smallest entry that can be reached over pairs of similar word sets, equal ones included.
_P1_GROUPS = _P1_PAIRS + r""",
s AS (SELECT entry_id, list_sort(ws) AS k, n FROM f),
o AS (SELECT x.k AS ka, y.k AS kb, c.a, c.b FROM c JOIN s x ON x.entry_id = c.a JOIN s y ON y.entry_id = c.b WHERE 10 * len(list_intersect(x.k, y.k)) >= 7 * (x.n + y.n - len(list_intersect(x.k, y.k)))),
d2 AS (SELECT ka AS k, kb AS o FROM o WHERE ka <> kb UNION SELECT kb, ka FROM o WHERE ka <> kb), l AS (SELECT k, count(*) AS links FROM d2 GROUP BY 1),
g AS (SELECT a AS x, b AS y FROM o UNION ALL SELECT b, a FROM o),
z AS (SELECT entry_id AS x, entry_id AS y FROM s UNION SELECT z.x, g.y FROM z JOIN g ON g.x = z.y)
SELECT s.entry_id, m.group_entry_id, coalesce(l.links, 0) AS links FROM s JOIN (SELECT x, min(y) AS group_entry_id FROM z GROUP BY 1) m ON m.x = s.entry_id LEFT JOIN l ON l.k = s.k
"""
_BARE = r"regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_NONE = "(coalesce(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '') IN ('', 'null', 'none', 'n/a', 'na', 'nil', 'undefined', 'empty', 'missing', 'unknown', 'blank'))"
_P2_OF = f"""
WITH e AS (SELECT DISTINCT entry_id, session_id, {_BARE.format('entry_key')} AS k, entry_value AS v, comments AS c, extractor, extracted_ts AS t FROM entries WHERE session_id IS NOT NULL),
m AS (SELECT e.*, coalesce(x.r, 9223372036854775807) AS r, length({_BARE.format('v')}) AS size, min(entry_id) OVER w AS lead, count(*) OVER w AS n
      FROM e LEFT JOIN (SELECT extractor, min(trust_rank) AS r FROM extractors GROUP BY 1) x USING (extractor) WINDOW w AS (PARTITION BY session_id, k)),
a AS (SELECT lead, 'entry_value' AS field_name, entry_id, row_number() OVER (PARTITION BY lead ORDER BY size DESC, r, t DESC NULLS LAST, entry_id) AS i FROM m WHERE n > 1 AND NOT {_NONE.format('v')} AND NOT (ends_with(v, '...') OR ends_with(v, '…'))
      UNION ALL SELECT lead, 'comments', entry_id, row_number() OVER (PARTITION BY lead ORDER BY r, t DESC NULLS LAST, entry_id) FROM m WHERE n > 1 AND NOT {_NONE.format('c')})
SELECT lead AS group_entry_id, field_name, entry_id FROM a WHERE i = 1"""
_P3_BASE = """
WITH last AS (SELECT DISTINCT ON (session_id) session_id, document_type, created_ts, chunk_results, total_processing_time FROM processing_sessions
              WHERE session_id IS NOT NULL ORDER BY session_id, received_ts DESC, coalesce(len(chunk_results), 0) DESC, coalesce(total_processing_time, -1) DESC),
t AS (SELECT coalesce(nullif(lower(trim(document_type)), ''), 'unknown') AS document_type, strftime(created_ts, '%Y-%m') AS month, chunk_results, total_processing_time FROM last),
m AS (SELECT document_type, 'total' AS measure, month, total_processing_time AS v FROM t
      UNION ALL SELECT document_type, 'chunk', month, unnest(list_transform(chunk_results, lambda c: c.processing_time)) FROM t)
"""
_LIMITS = "(SELECT session_id, max(chunk_size) AS size FROM processing_sessions GROUP BY 1) s USING (session_id) WHERE length(c.content) > s.size"
SQL = {
    "p1_found": _P1,
    "p1_groups": _P1_GROUPS,
    "p2_of_unmarked": _P2_OF,
    "p2_consolidation": """
WITH m AS (SELECT session_id, regexp_replace(lower(coalesce(entry_key, '')), '[^\\p{L}\\p{N}]+', '', 'g') AS k, count(DISTINCT entry_id) AS n FROM entries WHERE session_id IS NOT NULL GROUP BY 1, 2 HAVING n > 1),
p AS (SELECT session_id, count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS consolidated FROM m GROUP BY 1)
SELECT p.*, (SELECT max(s.dedup_stats.entries_consolidated) FROM processing_sessions s WHERE s.session_id = p.session_id) AS recorded FROM p""",
    "p3_counts": _P3_BASE + "SELECT document_type, measure, month, count(*) AS n FROM m WHERE v >= 0 AND NOT isnan(v) AND NOT isinf(v) GROUP BY 1, 2, 3",
    "p3_ranks": _P3_BASE + "SELECT document_type, measure, month, unnest([0.25, 0.5, 0.75, 0.9, 0.99])::DOUBLE AS p, true AS within FROM m WHERE v >= 0 AND NOT isnan(v) AND NOT isinf(v) GROUP BY 1, 2, 3",
    "p4_found": _P4 + "SELECT first_entry_id, entry_id FROM h WHERE entry_id <> first_entry_id",
    "p4_copies": _P4 + "SELECT first_entry_id, count(*) AS copies FROM h GROUP BY 1 HAVING count(*) > 1",
    "p6_found": "SELECT DISTINCT c.session_id, c.chunk_id FROM semantic_chunks c JOIN " + _LIMITS,
    "p6_rejoined": "SELECT DISTINCT c.session_id, c.chunk_id, md5(c.content) AS content_hash, true AS fits FROM semantic_chunks c JOIN " + _LIMITS,
    "p8_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS text_hash FROM documents",
    "p9_kept": r"""
WITH d AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g') AS source FROM documents WHERE text <> '')
SELECT s.source, d.source IS NOT NULL AS has_texts, true AS share_kept, true AS repeats_kept, true AS schedule_kept FROM sources s LEFT JOIN d USING (source)""",
}
