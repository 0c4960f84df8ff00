"""Queries of prompts, buckets, second stages, knowledge pages, sessions and packed language-model blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import prompts as P
from ..functions import text as T
from ..operators import chunking, evaluation, graph, lexical, lookup, ranking, records, similarity
from ..streaming import sessions
from .documents import _any
from .registry import Tables, query
from .reports import E
from .search import KIND, NUM, TOK, kind


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fill(s: str, **values: str) -> str:
    out = _q(s)
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


def _case(key: str, options: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in options.items()) + " END"


_SYSTEM = _case("language", {lang: " || chr(10) || chr(10) || ".join([_fill(P.OPENING[lang], grade="CAST(grade AS VARCHAR)", level="level"), _q(P.RULES[lang]), _case("template", {k: _q(v) for k, v in P.FORMS[lang].items()}), _fill(P.CLOSING[lang], statement=_case("grounding", {k: _q(v) for k, v in P.STATEMENTS[lang].items()}))]) for lang in P.OPENING})
_USER = _case("language", {lang: f"{_q(head)} || chr(10) || '---' || chr(10) || context || chr(10) || '---' || chr(10) || chr(10) || {_q(ask)} || question" for lang, (head, ask) in P.USER.items()})


@query(
    rf"WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL), rq AS (SELECT conv_id * 1000 + turn AS request_id, conv_id, CASE WHEN turn % 5 = 0 THEN text || ' தமிழ்' ELSE text END AS question FROM c WHERE role = 'user'), ps AS (SELECT rq.request_id, turn AS rank, turn % 4 AS class_level, CASE WHEN turn % 3 = 0 THEN 'science' ELSE 'maths' END AS subject, (length(text) % 100) / 100.0 AS score, text FROM rq JOIN c ON c.conv_id = rq.conv_id AND c.role = 'assistant'), g AS (SELECT request_id, count(*) AS n, count(*) FILTER (subject = 'maths') AS m, avg(score) AS mean, (list(class_level ORDER BY rank) FILTER (class_level <> 0))[1] AS grade, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM ps GROUP BY request_id), j AS (SELECT rq.request_id, question, lower(question) AS q, len(regexp_extract_all(lower(question), '\S+')) AS w, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(mean, 0) AS mean, coalesce(grade, 6) AS grade, coalesce(context, '') AS context, length(regexp_replace(question, '[^\x{{0B80}}-\x{{0BFF}}]', '', 'g')) AS ta FROM rq LEFT JOIN g USING (request_id)), k AS (SELECT request_id, question, context, CAST(grade AS INT) AS grade, CASE WHEN ta >= 3 OR ta / greatest(length(question), 1) > 0.05 THEN 'ta' ELSE 'en' END AS language, CASE WHEN {_any('q', L.CONFUSED)} THEN 'Beginner' WHEN {_any('q', L.HARD)} OR w > 8 THEN 'Advanced' WHEN {_any('q', L.EASY)} OR w <= 4 THEN 'Beginner' ELSE 'Intermediate' END AS level, CASE WHEN {_any('q', L.CONFUSED)} OR {_any('q', L.FOLLOW_UP)} THEN 'follow_up' WHEN {_any('q', L.EXAM)} THEN 'exam' WHEN {_any('q', L.PRACTICE)} THEN 'practice' WHEN (n > 0 AND m > n / 2) OR (n = 0 AND {_any('q', ['math', 'solve', 'தீர்'])}) THEN 'math' ELSE 'default' END AS template, CASE WHEN n = 0 THEN 'none' WHEN round(mean, 9) >= 0.7 THEN 'strong' ELSE 'partial' END AS grounding FROM j) SELECT request_id, language, grade, level, template, grounding, md5({_SYSTEM}) AS system_md5, md5({_USER}) AS user_md5 FROM k"
)
def build_prompts(t: Tables):
    c = t.conversations.filter("text is not null")
    asked = c.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "conv_id", F.when(F.col("turn") % 5 == 0, F.concat("text", F.lit(" தமிழ்"))).otherwise(F.col("text")).alias("question"))
    said = c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("rank"), (F.col("turn") % 4).cast("int").alias("class_level"), F.when(F.col("turn") % 3 == 0, "science").otherwise("maths").alias("subject"), (F.length("text") % 100 / 100).alias("score"), "text")
    out = P.build_prompts(asked.select("request_id", "question"), asked.select("request_id", "conv_id").join(said, "conv_id").drop("conv_id"))
    return out.select("request_id", "language", "grade", "level", "template", "grounding", F.md5(F.col("system").cast("binary")).alias("system_md5"), F.md5(F.col("user").cast("binary")).alias("user_md5"))


@query(r"WITH w AS (SELECT source, doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents), e AS (SELECT source, doc_id, length(unnest(ws)) AS id, generate_subscripts(ws, 1) AS p FROM w), n AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY doc_id, p) - 1 AS pos FROM e), g AS (SELECT source, pos // 1024 AS block_no, list(id ORDER BY pos) AS ids FROM n GROUP BY ALL) SELECT source, CAST(block_no AS BIGINT) AS block_no, CAST(len(ids) AS INT) AS n, md5(array_to_string(ids, ' ')) AS ids_md5, true AS labelled FROM g WHERE len(ids) = 1024 OR block_no = 0")
def lm_token_blocks(t: Tables):
    coded = t.documents.select("doc_id", "source", F.transform(T.words("text"), lambda w: F.length(w)).alias("ids"))
    b = chunking.lm_token_blocks(coded, 1024)
    return b.select("source", "block_no", F.size("input_ids").alias("n"), F.md5(F.array_join(F.col("input_ids").cast("array<string>"), " ").cast("binary")).alias("ids_md5"), (F.col("input_ids") == F.col("labels")).alias("labelled"))


_BUCKET = "CASE vec_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'tamil' ELSE 'book' END"


def _bucket_sql(web_only: bool) -> str:
    asked = "bucket = 'web'" if web_only else "(bucket = 'web' OR bucket = CASE WHEN language = 'ta' THEN 'tamil' ELSE 'book' END)"
    return f"WITH {E}, s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 8) AS score FROM benchmark b JOIN e q ON q.vec_id = b.item_id, e), f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 180), c AS (SELECT *, {_BUCKET} AS bucket, CASE WHEN query_id % 2 = 0 THEN 'ta' ELSE 'en' END AS language FROM f WHERE vec_id % 7 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY score DESC, vec_id) AS turn FROM c WHERE {asked} AND score >= CASE WHEN bucket <> 'web' THEN 0.28 WHEN language = 'ta' THEN 0.22 ELSE 0.30 END) SELECT query_id, vec_id, bucket, CAST(row_number() OVER (PARTITION BY query_id ORDER BY turn, bucket = 'web') AS INT) AS position FROM k WHERE turn <= 3"


def _bucketed(t: Tables, web_only: bool):
    q = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    near = similarity.cosine_topk(q, t.embeddings, 180)
    n = F.col("vec_id") % 3
    scored = near.select("query_id", F.col("vec_id").alias("doc_id"), "score", F.when(n == 0, "web").when(n == 1, "tamil").otherwise("book").alias("bucket"), F.when(F.col("query_id") % 2 == 0, "ta").otherwise("en").alias("language"), (F.col("vec_id") % 7 == 0).alias("seen"))
    return ranking.bucketed_retrieve(scored, "query_id", 3, web_only).select("query_id", F.col("doc_id").alias("vec_id"), "bucket", "position")


@query(_bucket_sql(False))
def bucketed_retrieve(t: Tables):
    return _bucketed(t, False)


@query(_bucket_sql(True))
def web_only_retrieve(t: Tables):
    return _bucketed(t, True)


@query(f"WITH {TOK}, f AS (SELECT item_id, doc_id, n_chars FROM bm JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, doc_id) <= 20) SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY -n_chars DESC, doc_id) AS INT) AS rank FROM f QUALIFY rank <= 5")
def two_stage_rerank(t: Tables):
    # Only the 20 that a question's first stage keeps (two_stage's `wide`) go on; they are those of all scores.
    first = lexical.bm25_top(t.benchmark, t.documents, 20).drop("rank").withColumn("score", F.round("score", 8))
    scores = first.join(t.documents.select("doc_id", (-F.col("n_chars")).alias("second")), "doc_id")
    return ranking.two_stage(scores, "item_id", "score", "second").select("item_id", "doc_id", "rank")


@query(f"WITH {E}, p AS (SELECT vec_id // 10 AS page_id, i, avg(v[i]) AS x FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), pv AS (SELECT page_id, list(x ORDER BY i) AS v FROM p GROUP BY page_id), s AS (SELECT q.vec_id AS query_id, page_id, round(list_cosine_similarity(q.v, pv.v), 8) AS score FROM benchmark b JOIN e q ON q.vec_id = b.item_id, pv) SELECT query_id, page_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS INT) AS rank FROM s QUALIFY rank <= 3")
def late_pool_topk(t: Tables):
    q = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    patches = t.embeddings.select(F.expr("vec_id div 10").alias("page_id"), "embedding")
    return graph.late_pool_topk(patches, q, 3).select("query_id", "page_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {E}, l AS (SELECT vec_id // 2 AS pair_id, v FROM e WHERE vec_id % 2 = 0), r AS (SELECT vec_id // 2 AS pair_id, v FROM e WHERE vec_id % 2 = 1), s AS (SELECT l.pair_id AS a, r.pair_id AS b, round(list_cosine_similarity(l.v, r.v), 8) AS s FROM l, r), o AS (SELECT a AS pair_id, s AS own FROM s WHERE a = b), x AS (SELECT o.pair_id, any_value(own) AS own, count(*) FILTER (s > own) + 1 AS rank FROM s JOIN o ON o.pair_id = s.a GROUP BY o.pair_id), y AS (SELECT o.pair_id, count(*) FILTER (s > own) + 1 AS back_rank FROM s JOIN o ON o.pair_id = s.b GROUP BY o.pair_id) SELECT pair_id, round(own, 6) AS similarity, rank, back_rank, rank = 1 AND back_rank = 1 AS mutual FROM x JOIN y USING (pair_id)")
def mutual_rank(t: Tables):
    e = t.embeddings.withColumn("pair_id", F.expr("vec_id div 2"))
    return similarity.mutual_ranks(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1")).withColumn("similarity", F.round("similarity", 6))


@query("SELECT doc_id || '_tbl_' || doc_id % 50 || '_' || doc_id AS chunk_id, md5('[Table Reference (Page ' || doc_id % 50 || ')]' || chr(10) || chr(10) || text) AS text_md5, 'table' AS role FROM documents UNION ALL SELECT doc_id || '_fig_' || doc_id % 50 || '_' || doc_id, md5('[Figure Reference (Page ' || doc_id % 50 || ') Caption: ' || source || ']' || chr(10) || '[Diagram Text: ' || text || ']'), 'figure' FROM documents")
def table_and_figure_chunks(t: Tables):
    d = t.documents.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 50).alias("page"), F.col("doc_id").alias("seq"), "text", "source")
    both = records.table_chunks(d.withColumnRenamed("text", "content")).unionByName(records.figure_chunks(d.withColumnRenamed("text", "ocr_text").withColumnRenamed("source", "caption")))
    return both.select("chunk_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "role")


_FILES = "f AS (SELECT source || '/' || lang || '/' || CASE WHEN doc_id % 10 = 0 THEN 'requirements.txt' ELSE 'f' || doc_id || CASE doc_id % 4 WHEN 1 THEN '.py' WHEN 2 THEN '.tar.gz' ELSE '' END END AS file_path, CASE WHEN doc_id % 10 = 0 THEN 'numpy==1' || chr(10) || '# none' || chr(10) || chr(10) || lang || '-tools == 2' ELSE text END AS content FROM documents), n AS (SELECT *, string_split(file_path, '/')[-1] AS name FROM f)"


@query(f"WITH {_FILES} SELECT 'extension' AS kind, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS name, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'files', '', count(*) FROM n UNION ALL SELECT DISTINCT 'module', string_split(file_path, '/')[1], 1 FROM n UNION ALL SELECT DISTINCT 'dependency', trim(string_split(x, '==')[1]), 1 FROM (SELECT unnest(string_split(content, chr(10))) AS x FROM n WHERE name = 'requirements.txt') WHERE trim(x) <> '' AND x[1] <> '#'")
def file_inventory(t: Tables):
    ext = F.when(F.col("doc_id") % 4 == 1, ".py").when(F.col("doc_id") % 4 == 2, ".tar.gz").otherwise("")
    needs = F.concat(F.lit("numpy==1\n# none\n\n"), "lang", F.lit("-tools == 2"))
    listed = F.col("doc_id") % 10 == 0
    name = F.when(listed, "requirements.txt").otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"), ext))
    return records.file_inventory(t.documents.select(F.concat_ws("/", "source", "lang", name).alias("file_path"), F.when(listed, needs).otherwise(F.col("text")).alias("content")))


_WIKI = "p AS (SELECT 'D' || doc_id AS title, text || ' [[D' || (doc_id * 7) % 1500 || ']] [[Module ' || lang || ']] [[D' || doc_id || ']]' AS text FROM documents)"


def _wiki(t: Tables):
    d = t.documents
    link = lambda *c: F.concat(F.lit(" [["), *c, F.lit("]]"))
    text = F.concat("text", link(F.lit("D"), (F.col("doc_id") * 7 % 1500).cast("string")), link(F.lit("Module "), "lang"), link(F.lit("D"), F.col("doc_id").cast("string")))
    return d.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("title"), text.alias("text"))


@query(rf"WITH {_WIKI}, l AS (SELECT DISTINCT title, unnest(regexp_extract_all(text, '\[\[(.*?)\]\]', 1)) AS link FROM p) SELECT title, link FROM l WHERE link NOT LIKE 'Module %' AND link NOT IN (SELECT title FROM p)")
def broken_wiki_links(t: Tables):
    return lookup.broken_wiki_links(_wiki(t))


@query(r"WITH d AS (SELECT doc_id, '+def f' || doc_id || '(a, b):' || chr(10) || ' def kept(a):' || chr(10) || replace(text, '. ', '.' || chr(10) || '+') || chr(10) || '-class X' || doc_id || '(Y):' || chr(10) || '+import os' || chr(10) || '-from a import b' || chr(10) || '+defer' AS diff, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'x<!-- MANUAL:START -->' || text || '<!-- MANUAL:END -->y' END AS old, CASE WHEN doc_id % 2 = 0 THEN 'new ## Related Documentation z' ELSE ' new ' END AS new FROM documents), r AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN regexp_extract(old, '(?s)<!-- MANUAL:START -->(.*?)<!-- MANUAL:END -->', 1) END AS region FROM d), b AS (SELECT *, '## Manual Notes' || chr(10) || '<!-- MANUAL:START -->' || coalesce(region, '') || chr(10) || '<!-- MANUAL:END -->' || chr(10) || chr(10) AS block FROM r) SELECT doc_id, md5(array_to_string(list_filter(string_split(diff, chr(10)), lambda x: regexp_matches(x, '^[+-]\s*(def\s+\w+\(.*?\):|class\s+\w+|import\s+|from\s+.*?\s+import\s+)')), chr(10))) AS signatures_md5, md5(region) AS region_md5, md5(CASE WHEN contains(new, '## Related Documentation') THEN replace(new, '## Related Documentation', block || '## Related Documentation') ELSE trim(new) || chr(10) || chr(10) || block END) AS page_md5 FROM b")
def knowledge_pages(t: Tables):
    i = F.col("doc_id").cast("string")
    diff = F.concat(F.lit("+def f"), i, F.lit("(a, b):\n def kept(a):\n"), F.replace("text", F.lit(". "), F.lit(".\n+")), F.lit("\n-class X"), i, F.lit("(Y):\n+import os\n-from a import b\n+defer"))
    old = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("x<!-- MANUAL:START -->"), "text", F.lit("<!-- MANUAL:END -->y")))
    new = F.when(F.col("doc_id") % 2 == 0, "new ## Related Documentation z").otherwise(" new ")
    d = t.documents.select("doc_id", diff.alias("diff"), old.alias("old"), new.alias("new"))
    md5 = lambda c, name: F.md5(c.cast("binary")).alias(name)
    return d.select("doc_id", md5(F.array_join(T.signature_changes("diff"), "\n"), "signatures_md5"), md5(T.manual_region("old"), "region_md5"), md5(T.keep_manual("new", "old"), "page_md5"))


@query("WITH t AS (SELECT *, sum(CAST(turn % 4 = 0 OR role = 'system' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS topic FROM conversations), s AS (SELECT conv_id, turn, list([turn, length(text) % 5]) OVER (PARTITION BY conv_id, topic ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t) SELECT conv_id, turn, array_to_string(list_sort(list_distinct(flatten(coalesce(seen, [])))), ' ') AS seen FROM s")
def seen_before(t: Tables):
    c = t.conversations.withColumn("new_topic", (F.col("turn") % 4 == 0) | (F.col("role") == "system")).withColumn("shown", F.array("turn", (F.length("text") % 5).cast("long")))
    return sessions.seen_before(c, "conv_id", "turn", "new_topic", "shown").select("conv_id", "turn", F.array_join(F.array_sort("seen").cast("array<string>"), " ").alias("seen"))


_STATE = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


@query(f"WITH e AS (SELECT user_id AS job_id, event_id, {_STATE} AS state, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT job_id, event_id, before, state FROM e WHERE state IS DISTINCT FROM before AND NOT coalesce((before IS NULL AND state = 'queued') OR (before = 'queued' AND state IN ('processing', 'failed')) OR (before = 'processing' AND state IN ('completed', 'failed')) OR (before = 'failed' AND state = 'queued'), false)")
def illegal_transitions(t: Tables):
    state = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    return sessions.illegal_transitions(t.events.select(F.col("user_id").alias("job_id"), "event_id", state.alias("state")), ts="event_id")


@query("WITH r AS (SELECT doc_id, quality * 4 + 1 AS judge, CAST(n_chars % 5 + 1 AS INT) AS human FROM labels JOIN documents USING (doc_id)) SELECT doc_id, abs(judge - human) AS diff FROM r WHERE abs(judge - human) >= 1 ORDER BY diff DESC, doc_id LIMIT 5")
def top_disagreements(t: Tables):
    r = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", (F.col("quality") * 4 + 1).alias("judge"), (F.col("n_chars") % 5 + 1).cast("int").alias("human"))
    return evaluation.top_disagreements(r, "judge", "human", "doc_id").select("doc_id", "diff")


@query(r"WITH w AS (SELECT list_transform(regexp_extract_all(text, '\S+'), lambda x: length(x)) AS t FROM documents), h AS (SELECT t[2:] AS t, t[:-2] AS p FROM w) SELECT CAST(sum(len(t)) AS BIGINT) AS n, round(sum(len(list_filter(list_zip(t, p), lambda z: z[1] = z[2]))) / sum(len(t)), 8) AS accuracy FROM h WHERE len(t) > 0")
def shifted_accuracy(t: Tables):
    ids = F.transform(T.words("text"), lambda w: F.length(w))
    m = evaluation.shifted_accuracy(t.documents.select(ids.alias("labels"), ids.alias("predicted")).filter(F.size("labels") > 1))
    return m.select("n", F.round("accuracy", 8).alias("accuracy"))


@query(f"SELECT lang AS medium, array_to_string(list_sort(list_distinct(list(lower(coalesce(CASE WHEN {NUM} % 4 = 0 THEN NULL ELSE {KIND} END, 'Science'))))), ',') AS subjects FROM documents GROUP BY lang")
def distinct_subjects(t: Tables):
    d = t.documents.withColumn("subject", F.when(F.substring("source", 4, 10).cast("int") % 4 != 0, kind()))
    return records.distinct_values(d, "lang", "subject", "Science").select(F.col("lang").alias("medium"), F.array_join("values", ",").alias("subjects"))


@query("SELECT user_id, count(*) AS n, CAST(round(avg(value)) AS BIGINT) AS average FROM events GROUP BY user_id")
def quiz_average(t: Tables):
    return evaluation.quiz_average(t.events, "user_id", "value")


@query("WITH g AS (SELECT conv_id, (list(turn % 4 ORDER BY turn) FILTER (turn % 4 <> 0))[1] AS grade, avg((length(text) % 100) / 100.0) AS mean, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY conv_id) SELECT conv_id, CAST(coalesce(grade, 6) AS BIGINT) AS grade, CASE WHEN n = 0 THEN 'none' WHEN mean >= 0.7 THEN 'strong' ELSE 'partial' END AS grounding FROM g")
def answer_grades(t: Tables):
    c = t.conversations.filter("text is not null").select("conv_id", "turn", (F.col("turn") % 4).alias("grade"), (F.length("text") % 100 / 100).alias("score"))
    return evaluation.answer_grades(c, "conv_id", "turn", "grade", "score").withColumn("grade", F.col("grade").cast("long"))


@query("SELECT event_type AS run_id, count(*) AS n, round(coalesce(avg(value), 0), 6) AS avg_value, round(avg(event_id), 6) AS avg_event_id FROM events GROUP BY event_type")
def run_averages(t: Tables):
    r = evaluation.run_averages(t.events.withColumnRenamed("event_type", "run_id"), ["value", "event_id"])
    return r.select("run_id", "n", F.round("avg_value", 6).alias("avg_value"), F.round("avg_event_id", 6).alias("avg_event_id"))
