"""Queries of evaluation, graphs, manifests, look-ups, sessions and reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import vector as V
from ..operators import evaluation, graph, lexical, lookup, manifest, similarity
from ..streaming import sessions
from .registry import Tables, query
from .search import KIND, TOK, kind

E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
NEAR = f"{E}, sim AS MATERIALIZED (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.v, b.v), 8) AS s FROM e a, e b WHERE a.vec_id <> b.vec_id), nn AS MATERIALIZED (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS r FROM sim) WHERE r <= 5), ed AS (SELECT src, dst FROM nn UNION SELECT dst, src FROM nn), fl AS MATERIALIZED (SELECT * FROM ed UNION SELECT src, src FROM ed), dg AS (SELECT src, count(*) AS d FROM fl GROUP BY src)"


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def content_hash_dedup(t: Tables):
    return manifest.keep_first(t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash")), ["content_hash"], ["doc_id"])


_OLD = "old AS (SELECT 'p' || doc_id AS file_path, CASE WHEN doc_id % 3 = 0 THEN sha256('old' || text) ELSE sha256(text) END AS file_hash FROM documents WHERE doc_id % 5 <> 0), new AS (SELECT 'p' || doc_id AS file_path, sha256(text) AS file_hash FROM documents WHERE doc_id % 7 <> 0)"


def _snapshots(t: Tables):
    """Two states of the table as an old and a new listing of files."""
    d = t.documents.select("doc_id", F.concat(F.lit("p"), F.col("doc_id")).alias("file_path"), F.sha2("text", 256).alias("h"), F.sha2(F.concat(F.lit("old"), "text"), 256).alias("g"))
    old = d.filter("doc_id % 5 <> 0").select("file_path", F.when(F.col("doc_id") % 3 == 0, F.col("g")).otherwise(F.col("h")).alias("file_hash"))
    return old, d.filter("doc_id % 7 <> 0").select("file_path", F.col("h").alias("file_hash"))


@query(f"WITH {_OLD} SELECT file_path, file_hash, CASE WHEN file_hash IN (SELECT file_hash FROM old) THEN 'unchanged' WHEN file_path IN (SELECT file_path FROM old) THEN 'modified' ELSE 'new' END AS status FROM new")
def change_detection(t: Tables):
    old, new = _snapshots(t)
    return manifest.detect_changes(new, old)


@query(f"WITH {_OLD} SELECT file_path, file_hash FROM old WHERE file_path NOT IN (SELECT file_path FROM new) UNION ALL SELECT file_path, file_hash FROM new")
def manifest_upsert(t: Tables):
    old, new = _snapshots(t)
    return manifest.upsert(old, new)


@query(f"WITH {_OLD} SELECT coalesce(old.file_path, new.file_path) AS file_path, CASE WHEN old.file_path IS NULL THEN 'Added' WHEN new.file_path IS NULL THEN 'Removed' ELSE 'Modified' END AS change FROM old FULL JOIN new ON old.file_path = new.file_path WHERE old.file_path IS NULL OR new.file_path IS NULL OR old.file_hash <> new.file_hash")
def snapshot_diff(t: Tables):
    old, new = _snapshots(t)
    return manifest.snapshot_diff(old, new, "file_path", "file_hash")


@query(f"WITH c AS (SELECT doc_id, source FROM documents), v AS (SELECT vec_id AS doc_id, source FROM embeddings JOIN documents ON vec_id = doc_id), n AS (SELECT source, count(*) AS n FROM c GROUP BY source), m AS (SELECT source, count(*) AS m FROM v GROUP BY source) SELECT n.source, n, coalesce(m, 0) AS m, n = coalesce(m, 0) AS aligned FROM n LEFT JOIN m USING (source)")
def embedding_alignment_counts(t: Tables):
    v = t.embeddings.select(F.col("vec_id").alias("doc_id")).join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("m"))
    n = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return n.join(v, "source", "left").select("source", "n", F.coalesce("m", F.lit(0).cast("long")).alias("m"), (F.col("n") == F.coalesce("m", F.lit(0))).alias("aligned"))


@query(f"WITH {NEAR} SELECT src, dst FROM ed")
def knn_edges(t: Tables):
    return graph.knn_edges(t.embeddings)


@query(f"WITH {NEAR} SELECT fl.src, fl.dst, round(1 / sqrt(a.d * b.d), 6) AS weight FROM fl JOIN dg a ON a.src = fl.src JOIN dg b ON b.src = fl.dst")
def sym_norm_adj(t: Tables):
    return graph.symmetric_weights(graph.knn_edges(t.embeddings)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {NEAR} SELECT fl.src, fl.dst, round(1.0 / d, 6) AS weight FROM fl JOIN dg USING (src)")
def row_norm_adj(t: Tables):
    return graph.row_weights(graph.knn_edges(t.embeddings)).withColumn("weight", F.round("weight", 6))


_LAYER = f"{NEAR}, x AS MATERIALIZED (SELECT vec_id AS node, CAST(i - 1 AS INT) AS dim, v[i] AS x FROM e, (SELECT unnest(range(1, 65)) AS i)), x1 AS MATERIALIZED (SELECT fl.src AS node, dim, sum(x / d) AS x FROM fl JOIN dg USING (src) JOIN x ON x.node = fl.dst GROUP BY ALL), pr AS (SELECT node, dim, (x.x + x1.x) / 2 AS x FROM x JOIN x1 USING (node, dim))"


@query(f"WITH {_LAYER} SELECT node, dim, round(x, 6) AS value FROM pr")
def propagate_layer(t: Tables):
    w = graph.row_weights(graph.knn_edges(t.embeddings))
    moved = graph.propagate(w, t.embeddings.select(F.col("vec_id").alias("node"), "embedding"), [0.5, 0.5])
    return graph.cells(moved).select("node", "dim", F.round("value", 6).alias("value"))


@query(f"WITH {_LAYER}, pv AS (SELECT node, list(x ORDER BY dim) AS v FROM pr GROUP BY node), b AS (SELECT ed.src AS node, avg(round(list_cosine_similarity(a.v, c.v), 8)) AS before FROM ed JOIN e a ON a.vec_id = ed.src JOIN e c ON c.vec_id = ed.dst GROUP BY 1), f AS (SELECT ed.src AS node, avg(round(list_cosine_similarity(a.v, c.v), 8)) AS after FROM ed JOIN pv a ON a.node = ed.src JOIN pv c ON c.node = ed.dst GROUP BY 1) SELECT node, round(before, 5) AS before, round(after, 5) AS after FROM b JOIN f USING (node)")
def neighbor_similarity_report(t: Tables):
    edges = graph.knn_edges(t.embeddings)
    moved = graph.propagate(graph.row_weights(edges), t.embeddings.select(F.col("vec_id").alias("node"), "embedding"), [0.5, 0.5])
    before = graph.neighbour_similarity(edges, t.embeddings).groupBy(F.col("src").alias("node")).agg(F.round(F.avg("similarity"), 5).alias("before"))
    after = graph.neighbour_similarity(edges, moved, "node").groupBy(F.col("src").alias("node")).agg(F.round(F.avg("similarity"), 5).alias("after"))
    return before.join(after, "node")


@query(f"WITH {E}, l AS (SELECT vec_id // 2 AS pair_id, v FROM e WHERE vec_id % 2 = 0), r AS (SELECT vec_id // 2 AS pair_id, v FROM e WHERE vec_id % 2 = 1), s AS (SELECT l.pair_id, r.pair_id AS other, round(list_cosine_similarity(l.v, r.v), 8) AS s FROM l, r), o AS (SELECT pair_id, s AS own FROM s WHERE pair_id = other) SELECT pair_id, round(any_value(own), 6) AS similarity, count(*) FILTER (s > own) + 1 AS rank FROM s JOIN o USING (pair_id) GROUP BY pair_id")
def pair_rank(t: Tables):
    e = t.embeddings.withColumn("pair_id", F.expr("vec_id div 2"))
    return similarity.pair_ranks(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1")).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {E} SELECT label, CAST(i - 1 AS INT) AS dim, round(avg(v[i]), 6) AS value FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL")
def mean_pool_by_label(t: Tables):
    return graph.mean_pool(t.embeddings, "label").withColumn("value", F.round("value", 6))


@query()
def procrustes_align(t: Tables):
    e = t.embeddings.withColumn("pair_id", F.expr("vec_id div 2"))
    pairs = e.filter("vec_id % 2 = 0").select("pair_id", F.col("embedding").alias("a")).join(e.filter("vec_id % 2 = 1").select("pair_id", F.col("embedding").alias("b")), "pair_id")
    turned = graph.apply_matrix(pairs, graph.procrustes(pairs, "a", "b"), "a")
    return turned.select("pair_id", V.cosine("a", "b").alias("before"), V.cosine("aligned", "b").alias("after"))


@query(f"WITH {E}, p AS (SELECT list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0) SELECT count(*) AS pairs, round(avg(c), 6) AS before, true AS orthogonal, true AS no_worse FROM p")
def procrustes_report(t: Tables):
    """What must hold of the best rotation: it is orthogonal, and no other, so not standing still either, brings the pairs nearer."""
    e = t.embeddings.withColumn("pair_id", F.expr("vec_id div 2"))
    pairs = e.filter("vec_id % 2 = 0").select("pair_id", F.col("embedding").alias("a")).join(e.filter("vec_id % 2 = 1").select("pair_id", F.col("embedding").alias("b")), "pair_id")
    m = graph.procrustes(pairs, "a", "b")
    dot = lambda x, y: F.aggregate(F.zip_with(F.col(x).cast("array<double>"), F.col(y).cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    sums = graph.apply_matrix(pairs, m, "a").agg(F.count("*").alias("pairs"), F.round(F.avg(V.cosine("a", "b")), 6).alias("before"), F.sum(dot("aligned", "b") - dot("a", "b")).alias("gain"))
    return sums.select("pairs", "before", F.lit(bool(abs(m.T @ m - np.eye(len(m))).max() < 1e-9)).alias("orthogonal"), (F.col("gain") >= -1e-9).alias("no_worse"))


_HITS = f"{TOK}, hit AS (SELECT b.item_id, list(d.doc_id) AS expected FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1), got AS (SELECT item_id, list(doc_id ORDER BY rank) AS retrieved FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM bm) WHERE rank <= 10 GROUP BY 1), m AS (SELECT item_id, list_filter(retrieved, lambda p: p <> 0) AS r, list_filter(expected, lambda p: true) AS x FROM hit JOIN got USING (item_id)), v AS (SELECT item_id, CAST(list_has_any(r[1:1], x) AS DOUBLE) AS recall_1, CAST(list_has_any(r[1:5], x) AS DOUBLE) AS recall_5, CAST(list_has_any(r[1:10], x) AS DOUBLE) AS recall_10, len(list_filter(r[1:5], lambda p: list_contains(x, p))) / 5.0 AS precision_5, coalesce(1.0 / list_position(list_transform(r, lambda p: list_contains(x, p)), true), 0) AS mrr, coalesce(list_sum(list_transform(r[1:5], lambda p, i: CASE WHEN list_contains(x, p) THEN 1 / log2(i + 1) ELSE 0 END)), 0) / list_sum(list_transform(range(1, least(len(x), 5) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_5 FROM m)"


def _cases(t: Tables):
    b, d = t.benchmark, t.documents
    inside = lookup.contained_pairs(b.select(F.col("item_id").alias("small_id"), F.col("text").alias("small")), d.select(F.col("doc_id").alias("large_id"), F.col("text").alias("large")))
    inside = inside.select(F.col("small_id").alias("item_id"), F.col("large_id").alias("doc_id"))
    top = lexical.bm25_top(b, d, 10).select("item_id", "doc_id", "rank")
    # A text that very many documents hold is counted; of those documents only the retrieved ones are gathered.
    n = inside.groupBy("item_id").agg(F.count("*").alias("n_expected"))
    both = top.join(inside.withColumn("held", F.lit(True)), ["item_id", "doc_id"], "left")
    ten = both.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "held"))).alias("x"))
    ids = lambda x: F.transform(x, lambda r: r["doc_id"])
    cases = ten.select("item_id", ids("x").alias("retrieved"), ids(F.filter("x", lambda r: r["held"])).alias("expected"))
    return evaluation.retrieval_metrics(n.join(cases, "item_id"))


_M = ["recall_1", "recall_5", "recall_10", "precision_5", "mrr", "ndcg_5"]


@query(f"WITH {_HITS} SELECT item_id, {', '.join(f'round({m}, 6) AS {m}' for m in _M)} FROM v")
def recall_precision_mrr_ndcg(t: Tables):
    return _cases(t).select("item_id", *[F.round(m, 6).alias(m) for m in _M])


@query(f"WITH {_HITS}, runs AS (SELECT item_id % 4 AS run, avg(mrr) AS mrr, avg(precision_5) AS precision_5 FROM v GROUP BY 1), d AS (SELECT *, mrr - lag(mrr) OVER (ORDER BY run) AS dm FROM runs) SELECT run, round(mrr, 6) AS mrr, round(precision_5, 6) AS precision_5, round(dm, 6) AS delta_mrr, CASE WHEN round(dm, 9) > 0 THEN 'Improved' WHEN round(dm, 9) < 0 THEN 'Declined' WHEN round(dm, 9) = 0 THEN 'Unchanged' END AS status_mrr FROM d")
def eval_delta(t: Tables):
    runs = _cases(t).groupBy((F.col("item_id") % 4).alias("run")).agg(F.round(F.avg("mrr"), 9).alias("mrr"), F.avg("precision_5").alias("precision_5"))
    out = evaluation.run_deltas(runs, ["mrr"], "run")
    return out.select("run", F.round("mrr", 6).alias("mrr"), F.round("precision_5", 6).alias("precision_5"), F.round("delta_mrr", 6).alias("delta_mrr"), "status_mrr")


_RATED = "WITH r AS (SELECT quality + toxic + CAST(n_chars > 2000 AS INT) AS judge, CASE WHEN n_chars > 4000 THEN 2 WHEN n_chars > 800 THEN 1 ELSE 0 END + quality AS human, doc_id FROM labels JOIN documents USING (doc_id))"


def _rated(t: Tables):
    j = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return j.select("doc_id", (F.col("quality") + F.col("toxic") + (F.col("n_chars") > 2000).cast("int")).alias("judge"), (F.when(F.col("n_chars") > 4000, 2).when(F.col("n_chars") > 800, 1).otherwise(0) + F.col("quality")).alias("human"))


@query(f"{_RATED}, l AS (SELECT label, row_number() OVER (ORDER BY label) AS i FROM (SELECT judge AS label FROM r UNION SELECT human FROM r)), p AS (SELECT a.i AS i, b.i AS j FROM r JOIN l a ON judge = a.label JOIN l b ON human = b.label), s AS (SELECT sum((i - j) * (i - j)) AS seen, count(*) AS n FROM p), c AS (SELECT sum((x.i - y.j) * (x.i - y.j)) AS chance FROM p x, p y) SELECT n, round(1 - seen / (chance / n), 8) AS kappa FROM s, c")
def quadratic_kappa(t: Tables):
    return evaluation.quadratic_kappa(_rated(t), "judge", "human").withColumn("kappa", F.round("kappa", 8))


@query(f"{_RATED} SELECT doc_id, judge, human, abs(judge - human) AS diff FROM r WHERE abs(judge - human) >= 1")
def disagreements(t: Tables):
    return evaluation.disagreements(_rated(t), "judge", "human").select("doc_id", "judge", "human", "diff")


@query("WITH r AS (SELECT quality AS t, CAST(n_chars > 500 AS INT) AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT c, count(*) FILTER (t = c) AS support, count(*) FILTER (p = c) AS said, count(*) FILTER (t = c AND p = c) AS tp FROM r, (SELECT DISTINCT t AS c FROM r) GROUP BY c), m AS (SELECT *, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS pr, tp / support AS re FROM c) SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS precision, round(sum(re * support) / sum(support), 6) AS recall, round(sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * support) / sum(support), 6) AS f1 FROM m")
def classifier_report(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("quality", (F.col("n_chars") > 500).cast("int").alias("said"))
    m = evaluation.classifier_metrics(rows, "quality", "said")
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("WITH f AS (SELECT CASE WHEN value > 50 THEN 'correct' ELSE 'wrong' END AS rating, event_type = 'click' AS ce FROM events) SELECT count(*) AS total, count(*) FILTER (rating = 'correct') AS correct, count(*) FILTER (rating <> 'correct') AS incorrect, count(*) FILTER (ce) AS citation_errors, round(100.0 * count(*) FILTER (rating = 'correct') / count(*), 1) AS pct_correct FROM f")
def feedback_dashboard(t: Tables):
    f = t.events.select(F.when(F.col("value") > 50, "correct").otherwise("wrong").alias("rating"), (F.col("event_type") == "click").alias("citation_errors"))
    return evaluation.feedback_stats(f)


_PLAIN = r"regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '^\s+|\s+$', '', 'g')"
_STOPS = ", ".join(f"'{w}'" for w in L.CORRECTION_STOPS)


@query(rf"WITH q AS (SELECT conv_id * 1000 + turn AS query_id, {_PLAIN.format('text')} AS x FROM conversations WHERE role = 'user'), c AS (SELECT item_id AS correction_id, {_PLAIN.format('text')} AS y FROM benchmark), qw AS (SELECT DISTINCT query_id, unnest(regexp_split_to_array(x, '\s+')) AS w FROM q), cw AS (SELECT DISTINCT correction_id, unnest(regexp_split_to_array(y, '\s+')) AS w FROM c), p AS (SELECT query_id, correction_id FROM qw JOIN cw USING (w) WHERE w NOT IN ('', {_STOPS}) GROUP BY ALL HAVING count(*) >= 2 UNION SELECT query_id, correction_id FROM q JOIN c ON (contains(x, y) AND y <> '') OR (contains(y, x) AND x <> '')) SELECT query_id, min(correction_id) AS correction_id FROM p GROUP BY query_id")
def correction_lookup(t: Tables):
    q = t.conversations.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    return lookup.match_corrections(q, t.benchmark.select(F.col("item_id").alias("correction_id"), F.col("text").alias("issue")))


@query(r"WITH g AS (SELECT item_id AS seq, lower(regexp_extract_all(text, '\p{L}+')[item_id % 7 + 1]) AS english, 'X' || item_id AS tamil FROM benchmark UNION ALL SELECT item_id + 1000000, lower(regexp_extract_all(text, '\S+')[1] || ' ' || regexp_extract_all(text, '\S+')[2]), 'Y' || item_id FROM benchmark UNION ALL SELECT 2000000 + i, w, 'Z' || i FROM (SELECT unnest([1, 2, 3]) AS i, unnest(['q', 'é', 'zz']) AS w)), k AS (SELECT english, arg_max(tamil, seq) AS tamil FROM g WHERE english IS NOT NULL AND english <> '' GROUP BY english) SELECT doc_id AS prompt_id, english, tamil FROM documents JOIN k ON contains(lower(text), english)")
def glossary_contains_join(t: Tables):
    ws = F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)
    one = t.benchmark.select(F.col("item_id").alias("seq"), F.get(ws, (F.col("item_id") % 7).cast("int")).alias("english"), F.concat(F.lit("X"), "item_id").alias("tamil"))
    two = t.benchmark.select(F.col("item_id") + 1000000, F.array_join(F.slice(T.words("text"), 1, 2), " "), F.concat(F.lit("Y"), "item_id"))
    tiny = t.spark.range(1).select(F.posexplode(F.array(F.lit("q"), F.lit("é"), F.lit("zz"))).alias("i", "w")).select((F.col("i") + 2000001).cast("long"), "w", F.concat(F.lit("Z"), F.col("i") + 1))
    return lookup.glossary_matches(t.documents.select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt")), one.union(two).union(tiny).filter("english is not null"))


@query("WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages) SELECT page_id, link FROM l WHERE link NOT IN (SELECT url FROM pages)")
def html_link_setdiff(t: Tables):
    return lookup.broken_links(t.pages)


@query("WITH t AS (SELECT source AS file, n_chars % 3 <> 0 AS nr FROM documents), f AS (SELECT DISTINCT source AS file FROM documents UNION SELECT 'empty.pdf'), n AS (SELECT f.file, count(t.nr) AS n_terms, count(*) FILTER (t.nr) AS n_flagged FROM f LEFT JOIN t ON t.file = f.file GROUP BY f.file) SELECT file, n_terms, n_flagged, round(CASE WHEN n_terms > 0 THEN n_flagged / n_terms ELSE 0 END, 6) AS flagged_ratio, CASE WHEN n_terms = 0 THEN '0 terms found' WHEN n_flagged / n_terms > 0.5 THEN '>50% terms flagged (' || n_flagged || '/' || n_terms || ')' END AS failure FROM n")
def glossary_file_stats(t: Tables):
    files = t.documents.select(F.col("source").alias("file")).union(t.spark.range(1).select(F.lit("empty.pdf"))).distinct()
    terms = t.documents.select(F.col("source").alias("file"), (F.col("n_chars") % 3 != 0).alias("needs_review"))
    return lookup.glossary_file_stats(terms, files).withColumn("flagged_ratio", F.round("flagged_ratio", 6))


@query("SELECT conv_id, turn, role, CAST(r AS INT) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6")
def history_last6(t: Tables):
    return sessions.last_messages(t.conversations, "conv_id", ["turn"]).select("conv_id", "turn", "role", "recency")


@query("SELECT conv_id, count(*) AS n_turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS context_md5 FROM conversations GROUP BY conv_id")
def session_context(t: Tables):
    c = t.conversations.select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.md5(F.array_join(lines, "\n").cast("binary")).alias("context_md5"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS fire_ts, count(*) AS n FROM k GROUP BY user_id, k")
def session_gap_debounce(t: Tables):
    e = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = sessions.debounce(e, ["user_id"], "1 hour")
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return s.select("user_id", show("first_ts"), show("fire_ts"), "n")


@query("SELECT event_type, strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(t: Tables):
    e = t.events.select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return sessions.windowed_counts(e, ["event_type"], "6 hours").select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def _seconds(t: Tables, key):
    return t.events.select(key, (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "event_id", "event_type")


#: Each key's records by number, for folds as recursion.
_STEPS = "e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS i FROM (SELECT {key} AS k, epoch_us(ts) / 1e6 AS ts, event_id FROM events))"


@query(f"WITH RECURSIVE {_STEPS.format(key='user_id')}, r AS (SELECT k, i, ts, event_id, [ts] AS log, true AS accepted FROM e WHERE i = 1 UNION ALL SELECT k, i, ts, event_id, CASE WHEN len(old) < 5 THEN list_append(old, ts) ELSE old END, len(old) < 5 FROM (SELECT e.k, e.i, e.ts, e.event_id, list_filter(r.log, lambda t: e.ts - t < 21600) AS old FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1)) SELECT k AS client, ts, accepted FROM r")
def rate_limit_fold(t: Tables):
    # five calls of a client in six hours: the tables' events are hours apart
    return sessions.fold(_seconds(t, F.col("user_id").alias("client")), sessions.RateLimit, ["ts", "event_id"], seconds=21600.0)


@query(f"WITH RECURSIVE {_STEPS.format(key="sha256(user_id || ':' || event_type)")}, r AS (SELECT k, i, ts, ts AS stored, false AS hit FROM e WHERE i = 1 UNION ALL SELECT e.k, e.i, e.ts, CASE WHEN e.ts - r.stored < 86400 THEN r.stored ELSE e.ts END, e.ts - r.stored < 86400 FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1) SELECT k AS cache_key, ts, hit FROM r")
def cache_hit_ttl(t: Tables):
    key = T.cache_key("user_id", "event_type").alias("cache_key")
    return sessions.fold(_seconds(t, key), sessions.AnswerCache, ["ts", "event_id"])


@query("WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS k, epoch_us(ts) / 1e6 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN event_type = 'purchase' THEN 'class=' || event_id % 3 END AS f FROM events), r AS (SELECT k, i, ts, f AS filters FROM e WHERE i = 1 UNION ALL SELECT e.k, e.i, e.ts, coalesce(e.f, CASE WHEN e.ts - r.ts < 43200 THEN r.filters END) FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1) SELECT k AS session, ts, filters FROM r")
def session_filters_fold(t: Tables):
    rows = _seconds(t, F.col("user_id").alias("session")).withColumn("filters", F.when(F.col("event_type") == "purchase", F.concat(F.lit("class="), F.col("event_id") % 3)))
    return sessions.fold(rows, sessions.SessionFilters, ["ts", "event_id"], seconds=43200.0)


@query("SELECT user_id AS job_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS state, max(event_id) FILTER (true) IS NOT NULL AS known FROM events GROUP BY user_id")
def job_latest_state(t: Tables):
    rows = t.events.select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("ts"), F.col("event_type").alias("state"))
    return sessions.job_table(rows).select("job_id", "state", F.col("ts").isNotNull().alias("known"))


@query("WITH c AS (SELECT user_id, value, event_id, ts FROM events WHERE event_type = 'view' AND value > 10) SELECT user_id, arg_max(event_id, struct_pack(t := ts, i := event_id)) AS event_id FROM c GROUP BY user_id")
def image_cache_latest(t: Tables):
    c = t.events.filter("event_type = 'view' and value > 10").select("user_id", "ts", "event_id")
    return evaluation.latest(c, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value FROM events GROUP BY event_type")
def eval_averages(t: Tables):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"), F.round(F.min("value"), 6).alias("min_value"), F.round(F.max("value"), 6).alias("max_value"))


@query(f"SELECT lang AS grade, source AS subject, count(*) AS n_units, count(*) FILTER ({KIND} = 'textbook') AS formula_heavy, count(*) FILTER ({KIND} = 'guide') AS descriptive FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def grouping_sets_inventory(t: Tables):
    from ..operators.units import inventory_counts

    k = F.when(kind() == "textbook", "Heading").when(kind() == "guide", "Descriptive Unit").otherwise("Table")
    return inventory_counts(t.documents.select(F.col("lang").alias("grade"), F.col("source").alias("subject"), k.alias("unit_type")), "grade", "subject")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(t: Tables):
    s = t.lineitem.filter("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    return s.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


@query("SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, rank() OVER (PARTITION BY r_name ORDER BY round(sum(l_extendedprice * (1 - l_discount)), 2) DESC) AS rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
def revenue_rank(t: Tables):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    s = j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return s.withColumn("rank", F.rank().over(Window.partitionBy("r_name").orderBy(F.desc("revenue"))))
