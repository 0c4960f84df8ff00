"""Queries of the small operators over chunks, figures, scans and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from ..streaming import sessions
from .registry import Tables, query
from .search import KIND, NUM, kind


@query(f"SELECT doc_id FROM documents WHERE lang = 'en' AND {NUM} % 3 + 6 = 8 AND {KIND} = 'textbook' AND {NUM} % 4 = 0")
def strict_filter(t: Tables):
    n = F.substring("source", 4, 10).cast("int")
    c = t.documents.select("doc_id", F.col("lang").alias("medium"), (n % 3 + 6).alias("class_level"), (n % 4).alias("term"), F.lit("Science").alias("subject"), kind().alias("content_type"))
    return records.strict_filter(c, "en", 8, "science", 2, "textbook").select("doc_id")


@query("WITH l AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE lang = 'en'), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE lang = 'fr') SELECT source, n, l.doc_id AS left_id, r.doc_id AS right_id FROM l JOIN r USING (source, n)")
def pair_rows(t: Tables):
    side = lambda lang: t.documents.filter(F.col("lang") == lang)
    return records.pair_rows(side("en"), side("fr"), "source", "doc_id")


@query("SELECT event_type, round(avg(value / 100.0) FILTER (value > 0), 6) AS confidence FROM events GROUP BY event_type")
def ocr_confidence(t: Tables):
    return records.mean_confidence(t.events, "event_type", "value").withColumn("confidence", F.round("confidence", 6))


@query("SELECT source, list_sort(list(n_chars))[count(*) // 2 + 1] AS median FROM documents GROUP BY source")
def upper_median_length(t: Tables):
    return records.upper_median(t.documents, "source", "n_chars")


@query(r"SELECT count(*) AS n_chunks, count(*) FILTER (contains(text, chr(65533)) OR (length(text) - length(replace(text, 'α«', ''))) // 2 > 10) AS n_garbled, count(*) FILTER (contains(lower(text), 'then')) AS n_with_term, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS n_words FROM documents")
def chunk_report(t: Tables):
    return records.chunk_report(t.documents, "Then")


@query("WITH q AS (SELECT user_id, ts AS c, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events), s AS (SELECT (epoch_us(a) - epoch_us(c)) / 1e6 AS s FROM q WHERE a IS NOT NULL) SELECT count(*) AS n, round(avg(s), 3) AS mean_s, round(quantile_cont(s, 0.5), 3) AS median_s, round(max(s), 3) AS max_s FROM s")
def resolution_times(t: Tables):
    from pyspark.sql import Window

    ts = F.col("ts").cast("timestamp")
    q = t.events.select(ts.alias("created_at"), F.lead(ts).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("approved_at"))
    return records.resolution_times(q).select("n", *[F.round(c, 3).alias(c) for c in ("mean_s", "median_s", "max_s")])


@query("SELECT page_id, '[' || url || CASE WHEN page_id > 0 THEN ', p. ' || page_id ELSE '' END || ']' AS citation FROM pages")
def citation_lines(t: Tables):
    return t.pages.select("page_id", records.citation("url", "page_id", F.lit("")).alias("citation"))


@query("SELECT lang, md5(string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5 GROUP BY lang")
def context_build(t: Tables):
    from pyspark.sql import Window

    r = t.documents.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")))
    return records.context_of(r, "lang", "text", 5).select("lang", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query()
def principal_components(t: Tables):
    return records.principal_components(t.embeddings, 2).select("vec_id", F.round(F.abs(F.col("components")[0]), 4).alias("axis_1"), F.round(F.abs(F.col("components")[1]), 4).alias("axis_2"))


@query(
    """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id % 16 AS repo, epoch_us(ts) / 1e6 AS ts, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS i, CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END AS c, event_type = 'click' AS changed FROM events),
    r AS (SELECT repo, 0::BIGINT AS i, NULL::DOUBLE AS last, NULL::VARCHAR AS com, false AS active, NULL::DOUBLE AS timer, NULL::DOUBLE AS fired_at, NULL::VARCHAR AS cause FROM (SELECT DISTINCT repo FROM e)
      UNION ALL SELECT repo, i, CASE WHEN cause IS NULL THEN last ELSE ts END, coalesce(c, com), CASE WHEN cause IS NULL THEN active OR changed ELSE false END, timer, CASE WHEN cause IS NULL THEN NULL ELSE ts END, cause FROM (
        SELECT *, CASE WHEN c IS NOT NULL AND c IS DISTINCT FROM com THEN 'commit' WHEN changed AND (last IS NULL OR ts - last >= 900) THEN 'change' END AS cause FROM (
          SELECT e.repo, e.i, e.ts, e.c, e.changed, r.com, CASE WHEN r.active AND r.last + 900 <= e.ts THEN r.last + 900 END AS timer, CASE WHEN r.active AND r.last + 900 <= e.ts THEN r.last + 900 ELSE r.last END AS last, r.active AND r.last + 900 > e.ts AS active
          FROM r JOIN e ON e.repo = r.repo AND e.i = r.i + 1)))
    SELECT repo, timer AS ts, 'timer' AS cause FROM r WHERE timer IS NOT NULL UNION ALL SELECT repo, fired_at, cause FROM r WHERE cause IS NOT NULL
    UNION ALL SELECT repo, last + 900, 'timer' FROM r WHERE active AND i = (SELECT max(i) FROM e WHERE e.repo = r.repo)"""
)
def changelog_trigger(t: Tables):
    e = t.events.select((F.col("user_id") % 16).alias("repo"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")).alias("commit"), (F.col("event_type") == "click").alias("changed"))
    return sessions.fold(e, sessions.ChangeTrigger, ["ts", "event_id"])
