"""Queries of lexical, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import vector as V
from ..operators import bm25_index, lexical, mindmap, plugins, ranking, retrieval, similarity
from ..sources.io import scratch
from .registry import Tables, query

TOK = r"tok AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents), post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS doc_len FROM documents), cs AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM dl), ts AS (SELECT term, count(*) AS df, ln((any_value(cs.n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM post, cs GROUP BY term), q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark) GROUP BY ALL), bm AS (SELECT item_id, post.doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * doc_len / avgdl))) AS score FROM q JOIN ts USING (term) JOIN post USING (term) JOIN dl USING (doc_id), cs GROUP BY ALL)"
NUM = "CAST(substr(source, 4) AS INT)"
KIND = f"CASE WHEN {NUM} < 10 THEN 'textbook' WHEN {NUM} < 15 THEN 'guide' ELSE 'previous_year' END"


def kind():
    """The tables' sources in the role of content types."""
    n = F.substring("source", 4, 10).cast("int")
    return F.when(n < 10, "textbook").when(n < 15, "guide").otherwise("previous_year")


@query("SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents) GROUP BY ALL")
def tokenize_terms(t: Tables):
    return lexical.postings(t.documents)


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS BIGINT) AS doc_len FROM documents")
def doc_lengths(t: Tables):
    return lexical.doc_stats(t.documents)


@query(f"WITH {TOK} SELECT term, df, round(idf, 8) AS idf FROM ts")
def term_df_idf(t: Tables):
    docs = t.documents
    return lexical.term_stats(lexical.postings(docs), lexical.corpus_stats(lexical.doc_stats(docs))).select("term", "df", F.round("idf", 8).alias("idf"))


@query(f"WITH {TOK} SELECT item_id, doc_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM bm) WHERE rank <= 10")
def bm25_topk(t: Tables):
    return lexical.bm25_top(t.benchmark, t.documents, 10).select("item_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query(f"WITH {TOK} SELECT item_id, doc_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM bm) WHERE rank <= 10")
def bm25_index_topk(t: Tables):
    """The index is written first, as a user would once; then the questions read the blocks that can matter."""
    path = scratch(t.spark, "bm25-index")
    bm25_index.write_index(t.documents, path)
    return bm25_index.Index(t.spark, path).top_k(t.benchmark, 10).select("item_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query(f"WITH {TOK} SELECT item_id, doc_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM bm JOIN (SELECT doc_id FROM documents WHERE lang = 'en' AND {KIND} IN ('textbook', 'guide')) USING (doc_id)) WHERE rank <= 5")
def bm25_filtered_global_stats(t: Tables):
    allowed = (F.col("lang") == "en") & kind().isin("textbook", "guide")
    return lexical.bm25_top(t.benchmark, t.documents, 5, allowed=allowed).select("item_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT item_id AS query_id, v AS qv FROM benchmark JOIN e ON item_id = vec_id), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(qv, v), 8) AS score FROM q, e), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def dense_topk(t: Tables):
    q = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    return similarity.cosine_topk(q, t.embeddings, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(v[i]) AS x FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY label) SELECT vec_id, c.label AS centroid, round(list_cosine_similarity(e.v, c.v), 6) AS similarity FROM e, c")
def centroid_similarities(t: Tables):
    from ..operators import graph

    centroids = graph.mean_vectors(t.embeddings, "label").select(F.col("label").alias("centroid"), F.col("embedding").alias("c"))
    # one row a label: the set that all vectors are compared with
    return t.embeddings.select("vec_id", "embedding").join(centroids).select("vec_id", "centroid", F.round(V.cosine("embedding", "c"), 6).alias("similarity"))


@query("WITH d AS (SELECT doc_id AS id, lang AS grp, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r1, row_number() OVER (PARTITION BY lang ORDER BY length(regexp_replace(text, '[^ ]', '', 'g')), doc_id) AS r2 FROM documents) SELECT grp, id, round(1.0 / (60 + r1) + 1.0 / (60 + r2), 10) AS rrf FROM d")
def rrf_fusion(t: Tables):
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), "n_chars", F.length(F.regexp_replace("text", "[^ ]", "")).alias("spaces"))
    a = ranking.full_rank(d, "grp", "n_chars", "id", descending=True).select("grp", "id", "rank")
    b = ranking.full_rank(d, "grp", "spaces", "id").select("grp", "id", "rank")
    return ranking.rrf([a, b], "grp", "id").select("grp", "id", F.round("rrf", 10).alias("rrf"))


def requests(t: Tables):
    v = t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    b = t.benchmark.join(v, "item_id", "left")
    return b.select(F.col("item_id").alias("request_id"), F.col("text").alias("question"), F.when(F.col("item_id") % 4 == 3, "xx").otherwise(F.get(F.array(F.lit("en"), F.lit("fr"), F.lit("de"), F.lit("es")), (F.col("item_id") % 4).cast("int"))).alias("medium"), F.lit(None).cast("int").alias("class_id"), F.lit(None).cast("int").alias("term"), F.lit("auto").alias("subject"), F.array(F.lit("textbook"), F.lit("guide"), F.lit("previous_year")).alias("allowed"), F.lit("en").alias("fallback_language"), "vector")


def chunks(t: Tables):
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return t.documents.join(e, "doc_id", "left").select(F.col("doc_id").alias("chunk_id"), "text", F.col("lang").alias("medium"), F.lit(6).alias("class_level"), F.lit(0).alias("term"), F.lit("science").alias("subject"), kind().alias("content_type"), "embedding")


_ASKED = r"tok AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents), post AS (SELECT doc_id, lang, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, lang, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS doc_len FROM documents), cs AS (SELECT lang, count(*) AS n, avg(doc_len) AS avgdl FROM dl GROUP BY lang), ts AS (SELECT lang, term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM post JOIN cs USING (lang) GROUP BY lang, term), rq AS (SELECT item_id, text, CASE item_id % 4 WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'en' END AS lang FROM benchmark), q AS (SELECT item_id, lang, term, count(*) AS times FROM (SELECT item_id, lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM rq) GROUP BY ALL), bm AS (SELECT item_id, post.doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * doc_len / avgdl))) AS score FROM q JOIN ts USING (lang, term) JOIN post USING (lang, term) JOIN dl ON dl.doc_id = post.doc_id JOIN cs ON cs.lang = q.lang GROUP BY ALL), emb AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), pair AS (SELECT rq.item_id, d.doc_id FROM rq JOIN documents d USING (lang)), sc AS (SELECT p.item_id, p.doc_id, round(coalesce(bm.score, 0), 8) AS sparse, round(coalesce(list_cosine_similarity(qe.v, de.v), 0), 8) AS dense FROM pair p LEFT JOIN bm ON bm.item_id = p.item_id AND bm.doc_id = p.doc_id LEFT JOIN emb qe ON qe.vec_id = p.item_id LEFT JOIN emb de ON de.vec_id = p.doc_id), rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dense DESC, doc_id) AS dense_rank, row_number() OVER (PARTITION BY item_id ORDER BY sparse DESC, doc_id) AS sparse_rank FROM sc)"


@query(f"WITH {_ASKED}, f AS (SELECT rk.*, {KIND} AS content_type, 1.0 / (60 + dense_rank) + 1.0 / (60 + sparse_rank) AS rrf FROM rk JOIN documents USING (doc_id)), p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN content_type IN ('textbook', 'guide') THEN 0 ELSE 1 END, round(rrf, 12) DESC, dense_rank) AS position FROM f) SELECT item_id AS request_id, doc_id AS chunk_id, content_type, CAST(dense_rank AS INT) AS dense_rank, CAST(sparse_rank AS INT) AS sparse_rank, round(rrf, 10) AS rrf, CAST(position AS INT) AS position, item_id % 4 = 3 AS fallback_used FROM p WHERE position <= 6")
def hybrid_retrieve(t: Tables):
    return retrieval.hybrid_retrieve(requests(t), chunks(t), 3).withColumn("rrf", F.round("rrf", 10))


@query(f"SELECT lang, doc_id, content_type, CAST(position AS INT) AS position FROM (SELECT lang, doc_id, {KIND} AS content_type, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN {KIND} IN ('textbook', 'guide') THEN 0 ELSE 1 END, n_chars DESC, doc_id) AS position FROM documents) WHERE position <= 20")
def tier_merge(t: Tables):
    d = t.documents.withColumn("content_type", kind())
    return ranking.tier_merge(d, "lang", [F.desc("n_chars"), F.col("doc_id")], 10).select("lang", "doc_id", "content_type", "position")


@query(f"WITH d AS (SELECT lang, doc_id, n_chars, {KIND} AS content_type FROM documents), r AS (SELECT *, CASE content_type WHEN 'textbook' THEN 1 WHEN 'guide' THEN 2 ELSE 3 END AS tier, row_number() OVER (PARTITION BY lang, content_type ORDER BY n_chars DESC, doc_id) AS k FROM d), c AS (SELECT * FROM r WHERE k <= 12), s AS (SELECT *, coalesce((SELECT count(*) FROM c c2 WHERE c2.lang = c.lang AND c2.tier < c.tier), 0) AS before FROM c) SELECT lang, doc_id, content_type, CAST(tier AS INT) AS tier, CAST(row_number() OVER (PARTITION BY lang ORDER BY tier, k) AS INT) AS position FROM s WHERE before < 12")
def strict_tier_merge(t: Tables):
    d = t.documents.withColumn("content_type", kind())
    return ranking.strict_tier_merge(d, "lang", [F.desc("n_chars"), F.col("doc_id")], 12, ["textbook", "guide", "previous_year"]).select("lang", "doc_id", "content_type", "tier", "position")


@query("WITH d AS (SELECT *, source || '-' || doc_id % 50 AS shelf FROM documents), p AS (SELECT shelf, doc_id FROM d WHERE lang = 'es'), f AS (SELECT shelf, doc_id FROM d WHERE lang = 'en') SELECT *, false AS fallback_used FROM p UNION ALL SELECT *, true FROM f WHERE shelf NOT IN (SELECT shelf FROM p)")
def language_fallback(t: Tables):
    d = t.documents.withColumn("shelf", F.concat("source", F.lit("-"), F.col("doc_id") % 50))
    side = lambda lang: d.filter(F.col("lang") == lang).select("shelf", "doc_id")
    return ranking.with_fallback(side("es"), side("en"), "shelf")


@query(f"WITH d AS (SELECT lang, doc_id, n_chars, CASE WHEN {NUM} % 3 = 0 THEN 'web' WHEN {NUM} % 3 = 1 THEN 'tamil' ELSE 'book' END AS bucket FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang, bucket ORDER BY n_chars DESC, doc_id) AS turn FROM d), k AS (SELECT * FROM r WHERE turn <= 5 AND bucket IN ('book', 'web')) SELECT lang, doc_id, bucket, CAST(row_number() OVER (PARTITION BY lang ORDER BY turn, CASE bucket WHEN 'book' THEN 1 ELSE 2 END) AS INT) AS position FROM k")
def bucketed_interleave(t: Tables):
    n = F.substring("source", 4, 10).cast("int")
    path = F.when(n % 3 == 0, F.concat(F.lit("add/"), "source")).when(n % 3 == 1, F.concat(F.lit("books\\Tamil\\"), "source")).otherwise(F.col("source"))
    out = ranking.interleave(t.documents, "lang", T.bucket(path), [F.desc("n_chars"), F.col("doc_id")], 5, ["book", "web"])
    return out.select("lang", "doc_id", "bucket", "position")


@query("SELECT conv_id, turn, role FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system')")
def seen_antijoin(t: Tables):
    c = t.conversations
    return c.join(c.filter("role = 'system'").select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", "turn", "role")


@query(f"WITH r AS (SELECT item_id AS request_id, 6 + item_id % 3 AS class_id, item_id % 4 AS term FROM benchmark), c AS (SELECT doc_id AS chunk_id, {NUM} % 3 + 6 AS class_level, {NUM} % 4 AS term, {KIND} AS content_type FROM documents WHERE lang = 'en') SELECT request_id, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM r JOIN c ON r.class_id = c.class_level AND CASE WHEN class_id IN (6, 7) THEN c.term = r.term ELSE c.term = 0 END AND content_type IN ('textbook', 'guide') GROUP BY request_id")
def metadata_filter(t: Tables):
    n = F.substring("source", 4, 10).cast("int")
    c = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("medium"), (n % 3 + 6).alias("class_level"), (n % 4).alias("term"), F.lit("science").alias("subject"), kind().alias("content_type"))
    r = t.benchmark.select(F.col("item_id").alias("request_id"), F.lit("what").alias("question"), F.lit("en").alias("medium"), (6 + F.col("item_id") % 3).cast("int").alias("class_id"), (F.col("item_id") % 4).cast("int").alias("term"), F.lit("science").alias("subject"), F.array(F.lit("textbook"), F.lit("guide")).alias("allowed"))
    return retrieval.metadata_filter(r, c).groupBy("request_id").agg(F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))


_STOPS = ", ".join(f"'{w}'" for w in L.RELEVANCE_STOPS)


@query(
    r"WITH b AS (SELECT item_id, text, list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z]+'), lambda w: lower(w)), lambda w: length(w) > 2 AND w NOT IN (" + _STOPS + r")) AS kw FROM benchmark), "
    r"h AS (SELECT b.item_id, d.doc_id, d.text, kw, list_filter(list_transform(string_split(regexp_replace(regexp_replace(d.text, '^\s+|\s+$', '', 'g'), '([.!?\n\x{0964}\x{0965}])\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 10) AS s FROM b JOIN documents d ON contains(d.text, b.text)), "
    r"sc AS (SELECT *, list_transform(s, lambda x: len(list_filter(kw, lambda w: contains(lower(x), w))) + CASE WHEN regexp_matches(lower(x), '(^|[^\p{L}\p{N}_])(is|are|called|defined|means|refers|classified|types|example|examples)($|[^\p{L}\p{N}_])') THEN 0.5 ELSE 0 END) AS score FROM h), "
    r"p AS (SELECT *, list_position(score, list_max(score)) - 1 AS best FROM sc) SELECT item_id, doc_id, md5(CASE WHEN len(s) = 0 THEN substring(text, 1, 800) WHEN len(kw) = 0 OR list_max(score) = 0 THEN array_to_string(s[1 : 5], ' ') ELSE array_to_string(s[greatest(best - 1, 0) + 1 : best + 5], ' ') END) AS excerpt_md5 FROM p"
)
def relevant_sentence(t: Tables):
    from ..operators.lookup import contained_pairs

    b, d = t.benchmark.select("item_id", F.col("text").alias("question")), t.documents.select("doc_id", "text")
    hits = contained_pairs(b.select(F.col("item_id").alias("small_id"), F.col("question").alias("small")), d.select(F.col("doc_id").alias("large_id"), F.col("text").alias("large")))
    hits = hits.select(F.col("small_id").alias("item_id"), F.col("large_id").alias("doc_id")).join(b, "item_id").join(d, "doc_id")
    hits = hits.withColumn("ws", mindmap.question_keywords("question"))
    return hits.select("item_id", "doc_id", F.md5(mindmap.relevant_sentences("text", F.col("ws")).cast("binary")).alias("excerpt_md5"))


@query()
def rerank_overlap(t: Tables):
    top = lexical.bm25_top(t.benchmark, t.documents, 10).withColumnRenamed("rank", "position")
    both = top.join(t.benchmark.select("item_id", F.col("text").alias("question")), "item_id").join(t.documents.select("doc_id", "text"), "doc_id")
    score = plugins.score_with(plugins.OverlapScorer(), F.col("question"), F.col("text"))
    return ranking.rerank(both, "item_id", score, 5).select("item_id", "doc_id", "position", "rerank_score", "rank")
