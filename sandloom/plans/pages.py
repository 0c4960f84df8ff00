"""Queries of page layout, paths of books and glossaries, and folds said as recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import layout
from .documents import _LINES, _SE, STRIP, _any
from .registry import Tables, query

#: Blocks on pages made of documents: a file is a source, a page ten documents, a box follows from the id and the length.
_BOXES = "b AS (SELECT source AS file, doc_id // 200 AS page, doc_id AS block_no, (doc_id % 3) * 190.0 AS x0, (doc_id % 3) * 190.0 + CASE doc_id % 4 WHEN 0 THEN 500 ELSE 150 END AS x1, (doc_id * 37 % 790) * 1.0 AS y0, (doc_id * 37 % 790) + 10.0 + n_chars % 40 AS y1, 600.0 AS page_width, 800.0 AS page_height, text FROM documents)"


def _boxes(t: Tables):
    i = F.col("doc_id")
    x0, y0 = (i % 3) * 190.0, (i * 37 % 790) * 1.0
    wide = F.when(i % 4 == 0, 500).otherwise(150)
    return t.documents.select(F.col("source").alias("file"), F.expr("doc_id div 200").alias("page"), i.alias("block_no"), x0.alias("x0"), (x0 + wide).alias("x1"), y0.alias("y0"), (y0 + 10 + F.col("n_chars") % 40).alias("y1"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), "text")


@query(f"WITH {_BOXES} SELECT block_no FROM b WHERE NOT (y1 < 0.08 * page_height OR y0 > 0.92 * page_height)")
def page_margins(t: Tables):
    return layout.margins(_boxes(t)).select("block_no")


@query(f"WITH {_BOXES}, s AS (SELECT *, CASE WHEN x1 - x0 > 390 THEN 'full' WHEN x1 < 345 AND x0 < 300 THEN 'left' WHEN x0 > 255 AND x1 > 300 THEN 'right' ELSE 'full' END AS side FROM b), n AS (SELECT *, count(*) FILTER (side = 'full') OVER p AS nf, count(*) FILTER (side = 'left') OVER p AS nl, count(*) FILTER (side = 'right') OVER p AS nr, coalesce(sum(CAST(side = 'full' AS INT)) OVER (PARTITION BY file, page ORDER BY y0, block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM s WINDOW p AS (PARTITION BY file, page)), k AS (SELECT *, nf = 0 AND (nl < 2 OR nr < 2) AS plain FROM n) SELECT file, page, block_no, CAST(row_number() OVER (PARTITION BY file, page ORDER BY CASE WHEN plain THEN 0 ELSE above END, CASE WHEN plain OR side = 'left' THEN 0 WHEN side = 'right' THEN 1 ELSE 2 END, y0, x0, block_no) AS INT) AS position FROM k")
def reading_order(t: Tables):
    return layout.reading_order(_boxes(t)).select("file", "page", "block_no", "position")


@query(f"WITH {_BOXES}, i AS (SELECT source AS file, doc_id // 200 AS page, doc_id AS image_no, (doc_id * 53 % 700) + 40.0 AS y1 FROM documents WHERE doc_id % 2 = 0) SELECT i.file, i.page, image_no, md5(arg_min(text, block_no)) AS caption_md5 FROM i LEFT JOIN b ON b.file = i.file AND b.page = i.page AND abs(b.y0 - i.y1) < 120 GROUP BY i.file, i.page, image_no")
def captions(t: Tables):
    i = t.documents.filter("doc_id % 2 = 0").select(F.col("source").alias("file"), F.expr("doc_id div 200").alias("page"), F.col("doc_id").alias("image_no"), (F.col("doc_id") * 53 % 700 + 40.0).alias("y1"))
    return layout.captions(i, _boxes(t)).select("file", "page", "image_no", F.md5(F.col("caption").cast("binary")).alias("caption_md5"))


@query(f"WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: {STRIP.format('x')}), lambda x: true) AS s FROM documents), e AS (SELECT doc_id, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS block_no FROM d) SELECT doc_id, CAST(block_no AS INT) AS block_no, md5(text) AS text_md5 FROM e WHERE text <> ''")
def document_blocks(t: Tables):
    return layout.document_blocks(t.documents).select("doc_id", "block_no", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(r"SELECT doc_id, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS word_no, unnest(ws) AS word FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents)")
def document_words(t: Tables):
    return layout.document_words(t.documents)


@query("SELECT source, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id)) AS text_md5 FROM documents GROUP BY source")
def joined_pages(t: Tables):
    return layout.joined_pages(t.documents, "source", "doc_id", "text").select("source", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_ROLE = "CASE " + " ".join(f"WHEN length(text) < 60 AND {_any('lower(text)', ns)} THEN '{r}'" for r, ns in L.ROLES.items()) + " ELSE 'general' END"
_MARKED = f"{_LINES}, mk AS (SELECT doc_id, seq, CASE length(text) % 9 WHEN 0 THEN 'Worked example' WHEN 1 THEN 'Exercise' WHEN 2 THEN (length(text) % 4 + 1) || '.' || (length(text) % 3 + 1) || ' Part' WHEN 3 THEN 'Activity' ELSE text END AS text FROM ln)"


@query(rf"WITH {_MARKED}, h AS (SELECT *, regexp_replace(text, '\s+', ' ', 'g') AS c FROM mk), k AS (SELECT *, CASE WHEN regexp_matches(c, '{_SE}') THEN regexp_extract(c, '{_SE}', 1) || ' ' || {STRIP.format(f"regexp_extract(c, '{_SE}', 2)")} END AS name, length(regexp_extract(c, '{_SE}', 1)) - length(replace(regexp_extract(c, '{_SE}', 1), '.', '')) AS dots, {_ROLE} AS role, length(text) < 120 AND (regexp_matches(text, '^(\d+\.\d+|\d+\.|[IVXLCDM]+\.)') OR (upper(text) = text AND lower(text) <> text)) AS heading FROM h), m AS (SELECT *, CASE WHEN dots = 1 THEN name END AS main, CASE WHEN dots = 2 THEN name END AS sub FROM k), n AS (SELECT *, count(main) OVER w AS no FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)), s AS (SELECT *, coalesce(last_value(main IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 'General') || coalesce(' > ' || last_value(sub IGNORE NULLS) OVER (PARTITION BY doc_id, no ORDER BY seq ROWS UNBOUNDED PRECEDING), '') AS path FROM n), p AS (SELECT *, sum(CAST(heading OR coalesce(lag(path) OVER o <> path, true) AS INT)) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, lag(path) OVER (PARTITION BY doc_id ORDER BY seq) AS dummy FROM s) WINDOW o AS (PARTITION BY doc_id ORDER BY seq)), r AS (SELECT *, CASE WHEN role <> 'general' THEN role END AS own, last_value(CASE WHEN role <> 'general' THEN role END IGNORE NULLS) OVER (PARTITION BY doc_id, part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY doc_id, part ORDER BY seq) AS r FROM p), g AS (SELECT *, sum(CAST(r = 1 OR (own IS NOT NULL AND own IS DISTINCT FROM before) AS INT)) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS grp FROM r) SELECT doc_id, CAST(grp AS INT) AS seq, arg_min(role, seq) AS role, md5(any_value(path) || string_agg(text, chr(10) ORDER BY seq)) AS text_md5 FROM g GROUP BY doc_id, grp".replace("coalesce(lag(path) OVER o <> path, true)", "coalesce(dummy <> path, true)").replace(" WINDOW o AS (PARTITION BY doc_id ORDER BY seq)), r AS", "), r AS"))
def logical_blocks(t: Tables):
    lines = layout.document_lines(t.documents)
    n = F.length("text")
    part = F.concat((n % 4 + 1).cast("string"), F.lit("."), (n % 3 + 1).cast("string"), F.lit(" Part"))
    marked = F.when(n % 9 == 0, "Worked example").when(n % 9 == 1, "Exercise").when(n % 9 == 2, part).when(n % 9 == 3, "Activity").otherwise(F.col("text"))
    b = layout.logical_blocks(layout.sections(lines.withColumn("text", marked)))
    return b.select("doc_id", "seq", "role", F.md5(F.concat("section_path", "text").cast("binary")).alias("text_md5"))


_PATHS = "p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Books\\Class_' || (doc_id % 3 + 6) || '/Maths/Tamil/Previous Year/term-' || (doc_id % 3 + 1) || '/samacheer ' || 2000 + doc_id % 30 || '.pdf' WHEN 1 THEN 'x/class ' || doc_id % 12 || '/science' WHEN 2 THEN 'up/class_8_science_term_' || (doc_id % 3 + 1) || '_tamil_teacher-notes reprint.pdf' ELSE 'none/of/these_' || doc_id || '.pdf' END AS path FROM documents)"


@query(rf"WITH {_PATHS}, l AS (SELECT doc_id, path, lower(replace(path, '\', '/')) AS low, replace(path, '\', '/') AS p FROM p) SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN doc_id % 3 + 6 WHEN 1 THEN doc_id % 12 WHEN 2 THEN 8 ELSE -1 END AS INT) AS class_level, CASE doc_id % 4 WHEN 0 THEN 'maths' ELSE 'science' END AS subject, CASE WHEN contains(low, 'tamil') THEN 'ta' ELSE 'en' END AS medium, CASE doc_id % 4 WHEN 0 THEN 'previous_year' WHEN 2 THEN 'teacher_notes' ELSE 'textbook' END AS content_type, CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 + 1 ELSE 0 END AS INT) AS term, CAST(CASE doc_id % 4 WHEN 0 THEN 2000 + doc_id % 30 ELSE 2024 END AS INT) AS year, CASE doc_id % 4 WHEN 0 THEN 'Samacheer Kalvi' ELSE 'Tamil Nadu Textbook and Educational Services Corporation' END AS publisher, CASE doc_id % 4 WHEN 0 THEN (2000 + doc_id % 30) || ' Edition' WHEN 2 THEN '2024 Edition (Reprint)' ELSE '2024 Edition' END AS edition FROM l")
def path_metadata(t: Tables):
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    paths = F.when(i % 4 == 0, F.concat(F.lit("Books\\Class_"), s(i % 3 + 6), F.lit("/Maths/Tamil/Previous Year/term-"), s(i % 3 + 1), F.lit("/samacheer "), s(2000 + i % 30), F.lit(".pdf")))
    paths = paths.when(i % 4 == 1, F.concat(F.lit("x/class "), s(i % 12), F.lit("/science"))).when(i % 4 == 2, F.concat(F.lit("up/class_8_science_term_"), s(i % 3 + 1), F.lit("_tamil_teacher-notes reprint.pdf")))
    m = T.path_metadata(paths.otherwise(F.concat(F.lit("none/of/these_"), s(i), F.lit(".pdf"))))
    return t.documents.select("doc_id", m.alias("m")).select("doc_id", "m.*").fillna(-1, ["class_level"])


@query("WITH p AS (SELECT doc_id, 'Class_' || doc_id % 9 || '/' || CASE doc_id % 3 WHEN 0 THEN 'Maths' WHEN 1 THEN 'Science' ELSE 'x' END || CASE WHEN doc_id % 2 = 0 THEN '/Term_' || doc_id % 4 ELSE '' END || '/' || lang || CASE WHEN doc_id % 5 = 0 THEN '_English' ELSE '' END AS p FROM documents) SELECT doc_id, 'Class ' || doc_id % 9 AS class, CASE doc_id % 3 WHEN 0 THEN 'Maths' WHEN 1 THEN 'Science' ELSE 'Unknown' END AS subject, CASE WHEN doc_id % 2 = 0 THEN 'Term ' || doc_id % 4 ELSE 'Full Year' END AS term, CASE WHEN doc_id % 5 = 0 THEN 'English' ELSE 'Unknown' END AS medium FROM p")
def glossary_path(t: Tables):
    i = F.col("doc_id")
    subject = F.when(i % 3 == 0, "Maths").when(i % 3 == 1, "Science").otherwise("x")
    path = F.concat(F.lit("Class_"), (i % 9).cast("string"), F.lit("/"), subject, F.when(i % 2 == 0, F.concat(F.lit("/Term_"), (i % 4).cast("string"))).otherwise(""), F.lit("/"), "lang", F.when(i % 5 == 0, "_English").otherwise(""))
    return t.documents.select("doc_id", T.glossary_path(path).alias("m")).select("doc_id", "m.*")


@query(r"WITH w AS (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z]+') AS ws FROM documents), c AS (SELECT doc_id, coalesce(ws[1], 'x') AS a FROM w) SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN '' ELSE 'அணு' END AS tamil, CASE doc_id % 4 WHEN 2 THEN '' ELSE a END AS english FROM c")
def bilingual_terms(t: Tables):
    a = F.coalesce(F.get(F.regexp_extract_all("text", F.lit("([a-zA-Z]+)"), 1), F.lit(0)), F.lit("x"))
    i = F.col("doc_id")
    term = F.when(i % 4 == 0, F.concat(F.lit("12. அணு - "), a)).when(i % 4 == 1, F.concat(a, F.lit(" அணு"))).when(i % 4 == 2, F.lit("- அணு -")).otherwise(F.concat(F.lit("3. "), a))
    return t.documents.select("doc_id", T.bilingual_term(term).alias("m")).select("doc_id", "m.*")


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\(\s*([^()]*?)\s*\)', '(\1)', 'g'), '\[\s*([^\[\]]*?)\s*\]', '[\1]', 'g')) AS tidy_md5 FROM (SELECT doc_id, replace(replace(text, ', ', ' ( a, '), '. ', ' ) [ x ] ') AS t FROM documents)")
def tidy_brackets(t: Tables):
    x = F.replace(F.replace("text", F.lit(", "), F.lit(" ( a, ")), F.lit(". "), F.lit(" ) [ x ] "))
    return t.documents.select("doc_id", F.md5(T.tidy_brackets(x).cast("binary")).alias("tidy_md5"))
