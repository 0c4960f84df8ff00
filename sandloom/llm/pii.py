"""Personal data, and the terms that give it away, in DataFrame functions alone.

Four kinds are found by pattern: e-mail, ip, card and phone. Each value found is a protected entity. A term near an entity
discloses it as far as it tells which entity it is: with p(c) the share of the corpus's words that stand near entity c and
p(c|t) the share of a term's occurrences that do, the term gives PMI(c; t) = log(p(c|t) / p(c)) of the entity's information
IC(c) = -log(p(c)). A term that gives at least THRESHOLD of it, and stands near the entity in at least SUPPORT different
surroundings (between different neighbours, so copies of a passage count once), is generalised to the beginnings of words that
it shares with others, if that discloses less than the threshold, and else removed.

The patterns are written so that no text makes them slow: where the plain pattern could start at every character of a long run, a
look-behind lets it start at the first alone, and repetitions that can't give anything back are possessive. Matches
are the same. Positions follow from the lengths of matches and of the gaps between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import spill, table

KINDS = ("email", "ip", "card", "phone")
#: Characters of context on either side of a finding; a context ends at the next finding of the same kind.
REACH = 60
SUPPORT, THRESHOLD = 3, 0.9
#: Letters that a generalised term keeps.
STEM = 3

_LOCAL = "[A-Za-z0-9._%+-]"
#: Kind: pattern, and a character without which no text has a match. A card here is what has 14 digits or more.
PATTERNS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[ -]?[0-9]){13,}+", None),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
}
_SPACE = r"[\x20\x09-\x0D]"
_TOKEN = r"[^\x20\x09-\x0D]+"
#: A term: the first run of letters of a token that has neither @ nor digit.
_TERM = r"\p{L}[\p{L}\p{M}'’-]*+"


def _ends(lengths: str) -> str:
    """SQL of the running sums of an array of ints. Blocks of 256 first, so an array that grows element by element is short."""
    block = f"aggregate(slice({lengths}, b * 256 + 1, 256), named_struct('sum', 0, 'out', cast(array() as array<int>)), (s, v) -> named_struct('sum', s.sum + v, 'out', concat(s.out, array(s.sum + v))), s -> s.out)"
    blocks = f"transform(sequence(0, cast((size({lengths}) - 1) div 256 as int)), b -> {block})"
    return f"aggregate({blocks}, named_struct('sum', 0, 'out', cast(array() as array<int>)), (a, x) -> named_struct('sum', a.sum + coalesce(try_element_at(x, -1), 0), 'out', concat(a.out, transform(x, v -> v + a.sum))), a -> a.out)"


_DIGITS = "regexp_replace(h, '[^0-9]', '')"
#: Which matches count, and what value makes two the same entity. In a doubled digit of Luhn's sum, the digits add up to its place in 0516273849.
_LUHN = "aggregate(sequence(1, char_length(d)), 0, (s, j) -> s + if(j % 2 = 0, instr('0516273849', substring(d, -j, 1)) - 1, cast(substring(d, -j, 1) as int))) % 10 = 0"
VALID = {
    "email": "true",
    "ip": "forall(split(h, '[.]'), p -> char_length(trim(LEADING '0' FROM p)) <= 3 and coalesce(try_cast(trim(LEADING '0' FROM p) as int), 0) <= 255)",
    "card": f"exists(array({_DIGITS}), d -> char_length(d) between 14 and 19 and {_LUHN})",
    "phone": f"char_length({_DIGITS}) between 10 and 15",
}
VALUE = {"email": "lower(h)", "ip": "h", "card": _DIGITS, "phone": _DIGITS}


def find(docs: DataFrame, reach: int = REACH, with_text: bool = False) -> DataFrame:
    """row_id, doc_id, n_words, base, and with_text the text, of each row, written to the shared folder.

    base: array of (start, k, end, entity, before, after, cut_before, cut_after), k being the kind's place in KINDS.
    """
    now = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, (pattern, char) in PATTERNS.items():
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        none = F.expr("cast(array() as array<string>)")
        now = now.withColumn(f"h_{kind}", hits if char is None else F.when(F.instr("text", char) > 0, hits).otherwise(none))
    for kind, (pattern, _) in PATTERNS.items():
        now = now.withColumn(f"g_{kind}", F.when(F.size(f"h_{kind}") > 0, F.split("text", pattern, -1)))
    for kind in KINDS:
        now = now.withColumn(f"l_{kind}", F.expr(f"transform(h_{kind}, (h, i) -> char_length(g_{kind}[i]) + char_length(h))"))
    for kind in KINDS:
        now = now.withColumn(f"e_{kind}", F.expr(f"if(size(l_{kind}) = 0, l_{kind}, {_ends(f'l_{kind}')})"))
    spans = []
    for k, kind in enumerate(KINDS):
        g = f"g_{kind}"
        found = (
            f"named_struct('ok', {VALID[kind]}, 'start', e_{kind}[i] - char_length(h), 'k', {k}, 'end', e_{kind}[i], 'entity', concat('{kind}:', {VALUE[kind]}), "
            f"'before', right({g}[i], {reach}), 'after', left({g}[i + 1], {reach}), 'cut_before', char_length({g}[i]) > {reach}, 'cut_after', char_length({g}[i + 1]) > {reach})"
        )
        kept = "named_struct('start', x.start, 'k', x.k, 'end', x.end, 'entity', x.entity, 'before', x.before, 'after', x.after, 'cut_before', x.cut_before, 'cut_after', x.cut_after)"
        spans.append(f"transform(filter(transform(h_{kind}, (h, i) -> {found}), x -> x.ok), x -> {kept})")
    base = F.expr(f"array_sort(concat({', '.join(spans)}))")
    words = F.size(F.filter(F.split("text", f"{_SPACE}+"), lambda w: w != "")).cast("long")
    return spill(now.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", words.alias("n_words"), base.alias("base"), *(["text"] if with_text else [])), "pii-found")


def surroundings(found: DataFrame) -> DataFrame:
    """row_id, entity, term, stem, start, end, around of each term near an entity; around tells its neighbours."""
    one = found.select("row_id", F.explode("base").alias("b")).select("row_id", "b.*")
    sides = F.array(
        F.struct(F.when(F.col("cut_before"), F.regexp_replace("before", f"^{_TOKEN}", "")).otherwise(F.col("before")).alias("t"), F.lit(True).alias("left")),
        F.struct(F.when(F.col("cut_after"), F.regexp_replace("after", f"{_TOKEN}$", "")).otherwise(F.col("after")).alias("t"), F.lit(False).alias("left")),
    )
    side = one.select("row_id", "entity", "start", "end", F.explode(sides).alias("s")).select("row_id", "entity", F.when(F.col("s.left"), F.col("start") - F.length("s.t")).otherwise(F.col("end")).alias("origin"), F.col("s.t").alias("t"))
    cut = side.select("row_id", "entity", "origin", F.regexp_extract_all("t", F.lit(_TOKEN), F.lit(0)).alias("h"), F.split("t", _TOKEN, -1).alias("g"))
    ended = cut.withColumn("len", F.expr("transform(h, (x, i) -> char_length(g[i]) + char_length(x))")).withColumn("ends", F.expr(f"if(size(len) = 0, len, {_ends('len')})"))
    tokens = ended.select("row_id", "entity", F.explode(F.expr("transform(h, (x, i) -> named_struct('x', x, 'at', origin + ends[i] - char_length(x), 'around', xxhash64(lower(if(i > 0, h[i - 1], '')), lower(coalesce(get(h, i + 1), '')))))")).alias("w"))
    tokens = tokens.filter(~F.col("w.x").rlike("[@0-9]")).select("row_id", "entity", "w.*", F.regexp_extract("w.x", _TERM, 0).alias("word")).filter("word <> ''")
    start = F.col("at") + F.expr("instr(x, word)") - 1
    return tokens.select("row_id", "entity", F.lower("word").alias("term"), F.substring(F.lower("word"), 1, STEM).alias("stem"), start.alias("start"), (start + F.length("word")).alias("end"), "around")


def _joined(rows: DataFrame, small: DataFrame, keys: list[str], most: int = 1 << 18) -> DataFrame:
    """Inner join on keys: `small` is broadcast up to `most` rows; beyond, a key's rows are dealt over 16 copies of its partner."""
    if small.count() <= most:
        return rows.join(F.broadcast(small), keys)
    dealt = rows.withColumn("deal", (F.rand(7) * 16).cast("int"))
    return dealt.join(small.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(15)))), [*keys, "deal"]).drop("deal")


def disclosing(docs: DataFrame, found: DataFrame, near: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """entity, term, share, action: what terms tell of entities, where it is at least the threshold."""
    pairs = near.groupBy("entity", "term", "around").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_tc"), F.count("*").alias("support"))
    pairs = spill(pairs.filter(F.col("support") >= support).withColumn("stem", F.substring("term", 1, STEM)), "pii-pairs")
    stems = pairs.select("stem").distinct()
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{M}'’-]+")).alias("term")).withColumn("stem", F.substring("term", 1, STEM))
    few = stems.count()
    kept = words.join(F.broadcast(stems) if few <= 1 << 18 else stems, "stem", "left_semi") if few else words.filter("false")
    counts = spill(kept.groupBy("term").agg(F.count("*").alias("n_t")), "pii-counts")
    total = found.agg(F.sum("n_words")).first()[0] or 0
    entities = near.join(F.broadcast(pairs.select("entity").distinct()) if few <= 1 << 18 else pairs.select("entity").distinct(), "entity", "left_semi")
    n_c = entities.groupBy("entity").agg(F.count("*").alias("n_c"))
    n_gc = entities.groupBy("entity", "stem").agg(F.count("*").alias("n_gc"))
    n_g = counts.groupBy(F.substring("term", 1, STEM).alias("stem")).agg(F.sum("n_t").alias("n_g"))
    told = _joined(_joined(_joined(_joined(pairs, counts, ["term"]), n_c, ["entity"]), n_gc, ["entity", "stem"]), n_g, ["stem"])
    information = F.log(F.greatest(F.lit(float(total)), F.col("n_c") + 1.0) / F.col("n_c"))
    share = lambda n, of: 1 + F.log(F.least(F.col(n) / F.col(of), F.lit(1.0))) / information
    told = told.withColumn("share", share("n_tc", "n_t")).filter(F.col("share") >= threshold)
    return told.select("entity", "term", "share", F.when((F.length("term") > STEM) & (share("n_gc", "n_g") < threshold), "generalised").otherwise("removed").alias("action"))


def personal_data(docs: DataFrame, reach: int = REACH, support: int = SUPPORT, threshold: float = THRESHOLD, with_text: bool = False) -> DataFrame:
    """doc_id, base, terms, and with_text the text, for each row of docs.

    base: array of (kind, start, end), what the patterns find, leftmost and not overlapping in each kind; positions are code
    points, end exclusive, ordered by start, then by KINDS. terms: array of (start, end, term, action), terms that disclose an
    entity near which they stand, in the places where they do. Null texts count as empty, repeated rows and null doc_ids give
    a row each, columns other than doc_id and text are left alone, an empty table gives no row. Texts of any length
    are read whole. Statistics are those of all rows.
    """
    source = docs.select("doc_id", "text")
    found = find(source, reach, with_text)
    near = spill(surroundings(found), "pii-near")
    bad = spill(disclosing(source, found, near, support, threshold), "pii-disclosing")
    hits = _joined(near, bad, ["entity", "term"]).groupBy("row_id", "start", "end").agg(F.max("action").alias("action"), F.min("term").alias("term"))
    terms = hits.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "term", "action"))).alias("terms"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("base", lambda b: F.struct(F.get(kinds, b["k"]).alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,term:string,action:string>>)")
    return found.join(terms, "row_id", "left").select("doc_id", base.alias("base"), F.coalesce("terms", none).alias("terms"), *(["text"] if with_text else []))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text: personal data as [kind], disclosing terms as their first letters and an asterisk or as [term]. Of spans that overlap, the first is named."""
    rows = personal_data(docs, with_text=True, **options)
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.concat(F.lit("["), b["kind"], F.lit("]")).alias("put")))
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["action"] == "generalised", F.concat(F.substring(t["term"], 1, STEM), F.lit("*"))).otherwise(F.lit("[term]")).alias("put")))
    marked = rows.select("doc_id", "text", F.array_sort(F.concat(base, terms)).alias("spans"))
    piece = "if(s.start >= a.at, concat(substring(text, a.at + 1, s.start - a.at), s.put), '')"
    text = f"aggregate(spans, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, s) -> named_struct('at', greatest(a.at, s.end), 'out', concat(a.out, array({piece}))), a -> concat(array_join(a.out, ''), substring(text, a.at + 1)))"
    return marked.select("doc_id", F.expr(text).alias("text"))


def _joined_spans(kind: Column, start: Column, end: Column) -> Column:
    return F.concat(kind, F.lit(":"), start.cast("string"), F.lit(":"), end.cast("string"))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; kind `term` stands last among equal starts."""
    rows = personal_data(table(spark, sf_dir, "documents"))
    count = [F.expr(f"cast(size(filter(base, b -> b.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    shown = F.array_join(F.transform("base", lambda b: _joined_spans(b["kind"], b["start"], b["end"])), ",")
    place = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    every = F.concat(
        F.transform("base", lambda b: F.struct(b["start"].alias("start"), F.array_position(place, b["kind"]).alias("k"), b["end"].alias("end"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS) + 1).cast("long").alias("k"), t["end"].alias("end"))),
    )
    spans = F.array_join(F.transform(F.array_sort(every), lambda x: _joined_spans(F.element_at(place, x["k"].cast("int")), x["start"], x["end"])), ",")
    return rows.select("doc_id", *count, F.sha2(shown, 256).alias("base_sha256"), spans.alias("spans"))
