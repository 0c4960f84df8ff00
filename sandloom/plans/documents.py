"""Queries of text functions, chunkers, page layout, inventories and corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import chunking, corpus, layout, mindmap, units
from .registry import Tables, query

W = r"[^\p{L}\p{N}_]"
VOWELS = "A-Za-z"


def _any(c: str, needles) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(c, n.replace("'", "''")) for n in needles) + ")"


def _pattern(*parts: str) -> str:
    return "|".join(parts).replace("'", "''")


MATH = _pattern(T.whole_words(L.MATH_WORDS + L.MATH_WHOLE), *L.MATH_TAMIL, *L.MATH_SHAPES)
SCIENCE = _pattern(T.whole_words(L.SCIENCE_WORDS), *L.SCIENCE_TAMIL)
ASK = "SELECT conv_id, turn, text, lower(text) AS q, len(regexp_extract_all(lower(text), '\\S+')) AS n FROM conversations WHERE text IS NOT NULL"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT conv_id, turn, regexp_matches(q, '{MATH}') AS math, regexp_matches(q, '{SCIENCE}') AS science FROM ({ASK})")
def subject_detect(t: Tables):
    s = T.subjects("text")
    return t.conversations.filter("text is not null").select("conv_id", "turn", F.array_contains(s, "math").alias("math"), F.array_contains(s, "science").alias("science"))


@query(f"SELECT conv_id, turn, CASE WHEN {_any('q', L.IMAGE_WORDS)} THEN 'Image' ELSE 'Chat' END AS intent, {_any('q', L.EXAM)} AS exam, {_any('q', L.PRACTICE)} AND NOT {_any('q', L.EXAM)} AS practice, {_any('q', L.CONFUSED)} AS confused, {_any('q', L.CONFUSED)} OR {_any('q', L.FOLLOW_UP)} AS follow_up, regexp_matches(q, '{_pattern(T.whole_words(L.MORE_WORDS))}') AS more, NOT {_any('q', L.BLOCKED)} AS safe FROM ({ASK})")
def intent_class(t: Tables):
    return t.conversations.filter("text is not null").select("conv_id", "turn", T.intent("text").alias("intent"), T.exam_mode("text").alias("exam"), T.practice_mode("text").alias("practice"), T.confused("text").alias("confused"), T.follow_up("text").alias("follow_up"), T.wants_more("text").alias("more"), T.safe_prompt("text").alias("safe"))


@query(f"SELECT conv_id, turn, CASE WHEN {_any('q', L.HARD)} OR n > 8 THEN 'Advanced' WHEN {_any('q', L.EASY)} OR n <= 4 THEN 'Beginner' ELSE 'Intermediate' END AS level, CASE WHEN {_any('q', L.ASSESSMENT)} THEN 6 ELSE 1 END AS n_types FROM ({ASK})")
def difficulty_class(t: Tables):
    types = T.content_types("text", F.array(F.lit("magazine")))
    return t.conversations.filter("text is not null").select("conv_id", "turn", T.difficulty("text").alias("level"), F.size(types).alias("n_types"))


@query(f"SELECT conv_id, turn, CASE WHEN {_any('q', L.CONFUSED)} OR {_any('q', L.FOLLOW_UP)} THEN 'follow_up' WHEN {_any('q', L.EXAM)} THEN 'exam' WHEN {_any('q', L.PRACTICE)} THEN 'practice' WHEN {_any('q', ['math', 'solve', 'தீர்'])} THEN 'math' ELSE 'default' END AS template FROM ({ASK})")
def prompt_template(t: Tables):
    q = F.lower("text")
    return t.conversations.filter("text is not null").select("conv_id", "turn", T.template_id("text", T.has_any(q, ["math", "solve", "தீர்"])).alias("template"))


@query(f"WITH d AS (SELECT doc_id, text, length({STRIP.format('text')}) AS n, length(text) - length(replace(text, '$', '')) AS dollars, coalesce(list_max(list_transform(regexp_extract_all(text, '\\S+'), lambda w: length(w))), 0) AS longest, n_chars FROM documents) SELECT doc_id, CASE WHEN text IS NULL OR n = 0 THEN 'empty' WHEN n < 50 THEN 'too short' WHEN n > 4000 THEN 'too long' WHEN dollars % 2 = 1 THEN 'unbalanced math' WHEN n_chars IS NULL THEN 'missing metadata' WHEN longest > 45 THEN 'overlong word' ELSE 'ok' END AS reason FROM d")
def chunk_validator_reasons(t: Tables):
    return t.documents.select("doc_id", T.chunk_problem("text", F.col("n_chars").isNull()).alias("reason"))


@query(rf"WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS ls FROM documents), s AS (SELECT doc_id, text, ls, length(regexp_replace(text, '[^{VOWELS}]', '', 'g')) / length(text) AS r, len(list_filter(ls, lambda x: length(regexp_replace(x, '[^{VOWELS}]', '', 'g')) / length(x) < 0.1 AND length(x) > 3)) AS junk FROM l) SELECT doc_id, round(r, 6) AS ratio, r < 0.15 OR len(ls) = 0 OR junk / greatest(len(ls), 1) > 0.6 AS junk FROM s")
def script_ratio(t: Tables):
    return t.documents.select("doc_id", F.round(T.script_ratio("text", VOWELS), 6).alias("ratio"), T.junk_chunk("text", VOWELS).alias("junk"))


@query(rf"WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS ls FROM documents), k AS (SELECT doc_id, text, list_filter(ls, lambda x: length(regexp_replace(x, '[^A-Z]', '', 'g')) / length(x) >= 0.1 OR length(x) < 10) AS kept FROM l) SELECT doc_id, len(kept) AS n_kept, md5(CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') ELSE text END) AS kept_md5 FROM k")
def junk_line_filter(t: Tables):
    kept = T.keep_script_lines("text", "A-Z")
    n = F.size(F.filter(T.lines("text"), lambda x: (T.script_ratio(x, "A-Z") >= 0.10) | (F.length(x) < 10)))
    return t.documents.select("doc_id", n.alias("n_kept"), F.md5(kept.cast("binary")).alias("kept_md5"))


@query(rf"SELECT doc_id, md5({STRIP.format(r"regexp_replace(regexp_replace(text, '[^\S\n]+', ' ', 'g'), '\n+', chr(10) || chr(10), 'g')")}) AS chunk_md5, md5({STRIP.format(r"regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")}) AS loader_md5 FROM documents")
def clean_whitespace(t: Tables):
    return t.documents.select("doc_id", F.md5(T.chunk_whitespace("text").cast("binary")).alias("chunk_md5"), F.md5(T.loader_whitespace("text").cast("binary")).alias("loader_md5"))


@query(rf"WITH h AS (SELECT doc_id, list_transform(string_split(regexp_replace(replace(text, ' and ', '-' || chr(10) || 'and '), '([a-zA-Z]+)-\s*\n\s*([a-zA-Z]+)', '\1\2', 'g'), chr(10)), lambda x: {STRIP.format('x')}) AS ls FROM documents), p AS (SELECT doc_id, array_to_string(list_transform(ls, lambda x, i: CASE WHEN x = '' OR i = len(ls) THEN x WHEN coalesce(ls[i + 1], '') = '' THEN x || chr(10) WHEN x[-1:] = '-' THEN x[:-2] ELSE x || ' ' END), '') AS j FROM h) SELECT doc_id, md5({STRIP.format(r"regexp_replace(j, ' {2,}', ' ', 'g')")}) AS joined_md5 FROM p")
def hyphen_repair(t: Tables):
    broken = F.replace("text", F.lit(" and "), F.lit("-\nand "))
    return t.documents.select("doc_id", F.md5(T.join_lines(broken).cast("binary")).alias("joined_md5"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[\p{L}\p{N}_\s.,?!\-()+=*/÷<>≤≥^√%±×≠≈≡∝∞∠⊥∥△°\x{0B80}-\x{0BFF}\x{0370}-\x{03FF}\x{2200}-\x{22FF}\x{25A0}-\x{25FF}\x{00BC}-\x{00BE}\x{2070}-\x{209F}\\{}\[\]]', '', 'g')) / greatest(length(text), 1) > 0.15 AND length(text) >= 5 AS dropped FROM documents")
def ocr_garbage(t: Tables):
    return t.documents.select("doc_id", ((T.ocr_filter("text") == "") & (F.length("text") >= 5)).alias("dropped"))


@query(f"SELECT doc_id, ({' + '.join(f'CAST(contains(lower(text), {chr(39)}{n}{chr(39)}) AS INT)' for n in L.COPYRIGHT)}) >= 3 AS copyright, regexp_matches({STRIP.format('text')}, '^(\\d+|-\\s*\\d+\\s*-)$') AS page_number, length({STRIP.format('text')}) > 100 AS searchable, len(regexp_extract_all(text, '\\S+')) >= 40 AND len(regexp_split_to_array(text, '[.!?]+')) >= 4 AND length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) > length(text) * 0.5 AS descriptive, contains(text, chr(65533)) AS corrupt FROM documents")
def page_flags(t: Tables):
    return t.documents.select("doc_id", T.copyright_page("text").alias("copyright"), T.page_number_block("text").alias("page_number"), T.searchable("text").alias("searchable"), T.descriptive("text").alias("descriptive"), T.residual_corruption("text").alias("corrupt"))


@query(r"WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents), c AS (SELECT doc_id, CAST(start AS INT) AS start, len(ws[start + 1 : start + 400]) AS n_words, array_to_string(ws[start + 1 : start + 400], ' ') AS chunk FROM w, LATERAL (SELECT unnest(range(0, len(ws), 340)) AS start)) SELECT doc_id, start, n_words, md5(chunk) AS chunk_md5 FROM c WHERE length(chunk) >= 40")
def word_window_chunks(t: Tables):
    return chunking.word_windows(t.documents).select("doc_id", "start", "n_words", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query(rf"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS s FROM documents), g AS (SELECT doc_id, CAST(g AS INT) AS group_no, s[g * 5 + 1 : g * 5 + 5] AS part FROM s, LATERAL (SELECT unnest(range(0, (len(s) + 4) // 5)) AS g)) SELECT doc_id, group_no, len(part) AS n_sentences, md5(array_to_string(part, ' ')) AS chunk_md5 FROM g")
def sentence_group_chunks(t: Tables):
    return chunking.sentence_groups(t.documents).select("doc_id", "group_no", "n_sentences", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


_SENT = rf"s AS MATERIALIZED (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS l FROM documents)))"
#: A fold as recursion: each step takes a document's next sentence; `closed` is a chunk that the step ends.
_PACK = "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, last) - 1 AS INT) AS chunk_no, chunk FROM (SELECT doc_id, i, 0 AS last, closed AS chunk FROM r WHERE closed IS NOT NULL UNION ALL SELECT doc_id, i, 1, {rest} FROM (SELECT *, max(i) OVER (PARTITION BY doc_id) AS top FROM r) WHERE i = top) WHERE chunk <> ''"


@query(rf"WITH RECURSIVE {_SENT}, w AS MATERIALIZED (SELECT doc_id, i, regexp_extract_all(x, '\S+') AS ws FROM s), r AS (SELECT doc_id, i, ws AS now, CAST(NULL AS VARCHAR) AS closed FROM w WHERE i = 1 UNION ALL SELECT r.doc_id, w.i, CASE WHEN len(now) + len(ws) > 200 THEN list_concat(now[greatest(len(now) - 9, 1) : len(now)], ws) ELSE list_concat(now, ws) END, CASE WHEN len(now) + len(ws) > 200 THEN array_to_string(now, ' ') END FROM r JOIN w ON w.doc_id = r.doc_id AND w.i = r.i + 1) {_PACK.format(rest="array_to_string(now, ' ')")}")
def greedy_sentence_pack(t: Tables):
    return chunking.map_text(t.documents, lambda x: chunking.pack_sentences(chunking.python_sentences(x), 200))


@query(rf"WITH RECURSIVE {_SENT}, r AS (SELECT doc_id, i, x || ' ' AS now, CAST(NULL AS VARCHAR) AS closed FROM s WHERE i = 1 UNION ALL SELECT r.doc_id, s.i, CASE WHEN length(now) + length(x) < 300 THEN now || x || ' ' ELSE x || ' ' END, CASE WHEN length(now) + length(x) < 300 THEN NULL ELSE trim(now) END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1) {_PACK.format(rest='trim(now)')}")
def char_pack(t: Tables):
    return chunking.map_text(t.documents, lambda x: chunking.pack_chars(chunking.python_sentences(x)))


@query(rf"WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, '. ') AS l FROM documents)), r AS (SELECT doc_id, i, CASE WHEN length(x) < 300 THEN ' ' || x ELSE x END AS now, CAST(NULL AS VARCHAR) AS closed FROM s WHERE i = 1 UNION ALL SELECT r.doc_id, s.i, CASE WHEN length(now) + length(x) < 300 THEN now || ' ' || x ELSE x END, CASE WHEN length(now) + length(x) < 300 THEN NULL ELSE {STRIP.format('now')} END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1), k AS (SELECT doc_id, i, 0 AS last, closed AS chunk FROM r WHERE closed <> '' UNION ALL SELECT doc_id, i, 1, {STRIP.format('now')} FROM (SELECT *, max(i) OVER (PARTITION BY doc_id) AS top FROM r) WHERE i = top) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, last) - 1 AS INT) AS chunk_no, chunk FROM k WHERE chunk <> ''")
def english_char_pack(t: Tables):
    return chunking.map_text(t.documents, chunking.pack_full_stops)


@query()
def recursive_chunks(t: Tables):
    return chunking.map_text(t.documents, chunking.recursive_split)


@query()
def guide_chunks(t: Tables):
    return chunking.map_text(t.documents, chunking.guide_chunks)


@query()
def curriculum_chunks(t: Tables):
    lines = layout.sections(layout.document_lines(t.documents))
    return chunking.curriculum_chunks(layout.logical_blocks(lines))


@query()
def unit_inventory(t: Tables):
    return units.unit_inventory(t.documents)


@query(r"WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<(?:h[1-6]|p|li|td|title)[^>]*>.*?</(?:h[1-6]|p|li|td|title)>')) AS raw, generate_subscripts(regexp_extract_all(html, '(?s)<(?:h[1-6]|p|li|td|title)[^>]*>.*?</(?:h[1-6]|p|li|td|title)>'), 1) - 1 AS seq FROM pages), x AS (SELECT page_id, seq, regexp_extract(raw, '^<(h[1-6]|p|li|td|title)', 1) AS tag, regexp_replace(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM p) SELECT page_id, CAST(seq AS INT) AS seq, tag, md5(text) AS text_md5 FROM x WHERE text <> ''")
def page_block_scan(t: Tables):
    return layout.html_blocks(t.pages).select("page_id", "seq", "tag", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_LINES = rf"ln AS (SELECT doc_id, CAST(seq AS INT) AS seq, {STRIP.format('raw')} AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents) WHERE {STRIP.format('raw')} <> '')"


def _numbered(t: Tables):
    """Document lines with headings put before some of them: lines are plain prose in these tables."""
    lines = layout.document_lines(t.documents)
    n = F.length("text")
    head = F.when(n % 7 == 0, F.concat(F.lit("Unit "), (n % 5 + 1).cast("string"), F.lit(": "), F.col("text"))).when(n % 7 == 1, F.concat((n % 4 + 1).cast("string"), F.lit("."), (n % 3 + 1).cast("string"), F.lit(" "), F.col("text"))).when(n % 7 == 2, F.concat((n % 4 + 1).cast("string"), F.lit(".1."), (n % 3 + 1).cast("string"), F.lit(" "), F.col("text")))
    return lines.withColumn("text", F.coalesce(head, F.col("text")))


_NUMBERED = f"{_LINES}, nb AS (SELECT doc_id, seq, CASE length(text) % 7 WHEN 0 THEN 'Unit ' || (length(text) % 5 + 1) || ': ' || text WHEN 1 THEN (length(text) % 4 + 1) || '.' || (length(text) % 3 + 1) || ' ' || text WHEN 2 THEN (length(text) % 4 + 1) || '.1.' || (length(text) % 3 + 1) || ' ' || text ELSE text END AS text FROM ln)"
_CH = f"(?i)^({'|'.join(L.CHAPTER_WORDS)})\\s*([ivxlcdm]+|\\d+)\\s*:?\\s*(.*)$"


@query(rf"WITH {_NUMBERED}, h AS (SELECT *, regexp_replace(text, '\s+', ' ', 'g') AS c, lead(text) OVER (PARTITION BY doc_id ORDER BY seq) AS nx FROM nb), k AS (SELECT *, regexp_matches(c, '{_CH}') AS is_h, CASE WHEN regexp_matches(c, '{_CH}') THEN regexp_extract(c, '{_CH}', 2) END AS number, CASE WHEN regexp_matches(c, '{_CH}') THEN CASE WHEN regexp_extract(c, '{_CH}', 3) <> '' THEN regexp_extract(c, '{_CH}', 3) WHEN length(nx) < 80 THEN nx ELSE '' END END AS title FROM h) SELECT doc_id, seq, CAST(sum(CAST(is_h AS INT)) OVER w AS BIGINT) AS chapter_seq, coalesce(last_value(number IGNORE NULLS) OVER w, '0') AS chapter_no, md5(coalesce(last_value(title IGNORE NULLS) OVER w, 'General')) AS title_md5 FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def header_parse(t: Tables):
    return layout.chapters(_numbered(t)).select("doc_id", "seq", "chapter_seq", "chapter_no", F.md5(F.col("chapter_title").cast("binary")).alias("title_md5"))


_SE = r"^(\d+\.\d+(?:\.\d+)?)\s*:?\s*(.*)$"


@query(rf"WITH {_NUMBERED}, h AS (SELECT *, regexp_replace(text, '\s+', ' ', 'g') AS c FROM nb), k AS (SELECT *, CASE WHEN regexp_matches(c, '{_SE}') THEN regexp_extract(c, '{_SE}', 1) || ' ' || {STRIP.format(f"regexp_extract(c, '{_SE}', 2)")} END AS name, length(regexp_extract(c, '{_SE}', 1)) - length(replace(regexp_extract(c, '{_SE}', 1), '.', '')) AS dots FROM h), m AS (SELECT *, CASE WHEN dots = 1 THEN name END AS main, CASE WHEN dots = 2 THEN name END AS sub FROM k), n AS (SELECT *, count(main) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS no FROM m) SELECT doc_id, seq, md5(coalesce(last_value(main IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 'General') || coalesce(' > ' || last_value(sub IGNORE NULLS) OVER (PARTITION BY doc_id, no ORDER BY seq ROWS UNBOUNDED PRECEDING), '')) AS path_md5 FROM n")
def section_carry_forward(t: Tables):
    return layout.sections(_numbered(t)).select("doc_id", "seq", F.md5(F.col("section_path").cast("binary")).alias("path_md5"))


@query(rf"WITH {_NUMBERED} SELECT doc_id, seq, CASE WHEN length(text) < 120 AND (regexp_matches(text, '^(\d+\.\d+|\d+\.|[IVXLCDM]+\.)') OR (upper(text) = text AND lower(text) <> text)) THEN 'heading' WHEN regexp_matches(text, '^(•|-|\d+\))') THEN 'list' ELSE 'paragraph' END AS type, CASE {' '.join(f"WHEN length(text) < 60 AND {_any('lower(text)', ns)} THEN '{r}'" for r, ns in L.ROLES.items())} ELSE 'general' END AS role FROM nb")
def block_labels(t: Tables):
    return _numbered(t).select("doc_id", "seq", T.block_type("text").alias("type"), T.block_role("text").alias("role"))


@query(r"WITH w AS (SELECT source, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS total FROM documents GROUP BY source) SELECT source, CAST(b AS BIGINT) AS block_no, least(total, 1024) AS n_tokens FROM w, LATERAL (SELECT unnest(range(0, greatest(total // 1024, CASE WHEN total > 0 THEN 1 ELSE 0 END))) AS b)")
def lm_block_pack(t: Tables):
    return chunking.lm_blocks(t.documents.select("doc_id", "source", T.word_count("text").alias("n_tokens")), 1024)


@query(r"WITH v AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS piece FROM documents) SELECT DISTINCT piece FROM v WHERE lang IN ('en', 'fr')")
def vocab_union(t: Tables):
    v = t.documents.select("lang", F.explode(T.tokens("text")).alias("piece"))
    return corpus.new_pieces(v.filter("lang = 'en'"), v.filter("lang = 'fr'"))


@query("WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\S+')) AS w FROM documents) " + " UNION ALL ".join(f"SELECT '{n}' AS language, count(*) FILTER (regexp_matches(w, '[\\x{{{a:04X}}}-\\x{{{b:04X}}}]')) AS n_tokens, round(100.0 * count(*) FILTER (regexp_matches(w, '[\\x{{{a:04X}}}-\\x{{{b:04X}}}]')) / count(*), 4) AS pct FROM w" for n, (a, b) in L.SCRIPTS.items()))
def token_script_counts(t: Tables):
    return corpus.script_counts(t.documents)


@query(r"WITH w AS (SELECT conv_id, turn, regexp_extract_all(regexp_replace(lower(text), '[^a-z ]', '', 'g'), '\S+') AS ws FROM conversations), k AS (SELECT conv_id * 1000 + turn AS msg, ws FROM w), e AS (SELECT msg, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM k), v AS (SELECT term, row_number() OVER (ORDER BY min(struct_pack(m := msg, p := pos))) + 1 AS id FROM e GROUP BY term), c AS (SELECT msg, list(id ORDER BY pos) AS ids FROM e JOIN v USING (term) GROUP BY msg) SELECT k.msg, CAST(len(k.ws) AS INT) AS n_words, array_to_string(list_concat(list_transform(range(0, greatest(0, 25 - len(coalesce(ids, [])))), lambda x: 0), coalesce(ids, [])[-25:]), ' ') AS ids FROM k LEFT JOIN c USING (msg)")
def vocab_encode_pad(t: Tables):
    m = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg"), "text")
    coded = mindmap.encode_padded(m, mindmap.vocabulary(m, "msg", "text"), "msg", "text")
    n = m.select("msg", F.size(T.words(T.classifier_text("text"))).alias("n_words"))
    return coded.join(n, "msg").select("msg", "n_words", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(r"WITH w AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS r FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) WHERE length(term) >= 4 GROUP BY term) SELECT s.term || ' ' || v.term || ' ' || o.term AS sentence FROM w s, w v, w o WHERE s.r <= 3 AND v.r IN (4, 5) AND o.r IN (6, 7, 8)")
def synthetic_cross_product(t: Tables):
    """Subjects, verbs and objects are the documents' eight commonest words of four letters or more."""
    words = t.documents.select(F.explode(T.tokens("text")).alias("term")).filter(F.length("term") >= 4).groupBy("term").agg(F.count("*").alias("n"))
    top = [r.term for r in words.orderBy(F.desc("n"), "term").limit(8).collect()]
    return mindmap.synthetic_sentences(top[:3], top[3:5], top[5:8], t.spark)


@query(rf"WITH s AS (SELECT conv_id * 1000 + turn AS msg, list_filter(list_transform(regexp_split_to_array(text, '[.\n]+'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS s FROM conversations), e AS (SELECT msg, unnest(s) AS x, generate_subscripts(s, 1) AS step FROM s), l AS (SELECT msg, step, array_to_string(regexp_extract_all(x, '\S+')[1:3], ' ') AS label, lead(step) OVER (PARTITION BY msg ORDER BY step) AS target FROM e) SELECT msg, CAST(step AS INT) AS source, CAST(target AS INT) AS target FROM l WHERE target IS NOT NULL")
def step_edges(t: Tables):
    m = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg"), "text")
    return mindmap.step_edges(mindmap.steps(m, "msg", "text"), "msg")


@query(r"WITH w AS (SELECT conv_id * 1000 + turn AS msg, regexp_extract_all(text, '[\p{L}]+') AS ws FROM conversations), x AS (SELECT msg, ws[1] AS a, ws[2] AS r, ws[3] AS b, ws FROM w WHERE len(ws) >= 5), tr AS (SELECT msg, 0 AS seq, a AS subject, r AS relation, b AS object FROM x UNION ALL SELECT msg, 2, b, ws[4], ws[5] FROM x), nm AS (SELECT msg, subject AS label, seq, 0 AS side FROM tr UNION ALL SELECT msg, object, seq, 1 FROM tr), f AS (SELECT msg, label, min(struct_pack(s := seq, d := side)) AS place FROM nm GROUP BY ALL), nd AS (SELECT msg, label, CAST(row_number() OVER (PARTITION BY msg ORDER BY place) AS INT) AS node_id FROM f) SELECT tr.msg, s.node_id AS source, o.node_id AS target, relation AS label FROM tr JOIN nd s ON s.msg = tr.msg AND s.label = subject JOIN nd o ON o.msg = tr.msg AND o.label = object")
def triple_parse(t: Tables):
    ws = F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)
    m = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg"), ws.alias("ws")).filter(F.size("ws") >= 5)
    line = lambda *i: F.concat_ws(" | ", *[F.col("ws")[k] for k in i])
    m = m.select("msg", F.concat_ws("\n", line(0, 1, 2), F.lit("not | a triple"), line(2, 3, 4)).alias("text"))
    return mindmap.graph_of(mindmap.triples(m, "msg", "text"), "msg")[1]
