"""A Merkle manifest of a table: leaves, subroots of each language, one root, and a proof for each row.

Levels are DataFrames. Leaves get indices by row_number; an index divided by the fanout is the parent's; grouped and sorted
child arrays are hashed into parents, until each group has one node. On the way down a join a round hands the parents'
proofs to their children, each of which puts its own siblings before them. One round settles DEPTH levels: what is grouped are
the fanout ** DEPTH nodes below one node, whose levels in between are arrays of that row; so 33 levels take nine exchanges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import spill, table

FANOUT = 2
DEPTH = 4
#: What a row's leaf is made of, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    """'-' for null, else the UTF-8 byte count, ':' and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(doc_id, source, lang, n_chars, text) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def indexed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with idx (from 0, by `order` within `group`) and n (rows of the group).

    No group is sorted in one task: rows are range-partitioned by group and order, numbered within each part, and moved on by
    the rows that the group has in the parts before. Parts are written first, so a part is the same whenever it is read.
    """
    parts = spill(rows.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id()), "merkle-parts")
    counts = parts.groupBy(group, "part").agg(F.count("*").alias("size"))
    by_group = Window.partitionBy(group)  # a group has at most one row a part
    before = F.sum("size").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(group).alias("o_group"), F.col("part").alias("o_part"), F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(by_group).alias("n"))
    local = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)) - 1
    numbered = parts.withColumn("local", local)
    out = numbered.join(offsets, (F.col(group) == F.col("o_group")) & (F.col("part") == F.col("o_part")))
    return out.select(*[c for c in rows.columns], (F.col("before") + F.col("local")).alias("idx"), "n")


def _ceil_div(a: str, b: int) -> str:
    return f"(({a} + {b - 1}) div {b})"


def _layers(fanout: int, depth: int, count: str) -> Column:
    """Of `nodes`, an array of digests: it and the levels above it, `depth` of them; `count` is how many nodes their level has.

    A level of one node is the top and stays as it is.
    """
    digest = f"unhex(sha2(array_join(transform(slice(last.nodes, i * {fanout} + 1, {fanout}), x -> lower(hex(x))), ''), 256))"
    above = f"transform(sequence(0, cast({_ceil_div('size(last.nodes)', fanout)} as int) - 1), i -> {digest})"
    step = f"if(acc.count <= 1, element_at(acc.layers, -1), transform(array(named_struct('nodes', element_at(acc.layers, -1))), last -> {above})[0])"
    return F.expr(
        f"aggregate(sequence(1, {depth}), named_struct('layers', array(nodes), 'count', cast({count} as bigint)), "
        f"(acc, k) -> named_struct('layers', concat(acc.layers, array({step})), 'count', {_ceil_div('acc.count', fanout)}), acc -> acc.layers)"
    )


def _path(fanout: int, depth: int) -> str:
    """SQL of the digests of the siblings of child `pos` in `layers`, level by level, as one binary."""
    at = f"(pos div cast(pow({fanout}, k) as bigint))"
    run = f"({at} div {fanout} * {fanout})"
    sibling = f"transform(filter(sequence({run}, least({run} + {fanout}, cast(size(layers[k]) as bigint)) - 1), i -> i <> {at}), i -> layers[k][i])"
    return f"aggregate(sequence(0, {depth - 1}), cast('' as binary), (acc, k) -> concat(acc, aggregate({sibling}, cast('' as binary), (s, x) -> concat(s, x))))"


def grow(nodes: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> tuple[list[DataFrame], DataFrame]:
    """Rounds from the leaves up, and (g, n, top, height): each group's last node and the round that made it.

    nodes: g (never null), idx, n, digest (binary), payload. A round's rows are (g, idx, n, layers) of the nodes below one
    node; those of the first round have their payloads too.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    width, rounds, tops, now = fanout**depth, [], None, nodes
    while not rounds or width ** len(rounds) < most:
        below, first = width ** len(rounds), not rounds
        kids = F.array_sort(F.collect_list(F.struct("idx", "digest", *(["payload"] if first else []))))
        up = now.groupBy("g", F.expr(f"idx div {width}").alias("parent")).agg(F.max("n").alias("n"), kids.alias("kids"))
        more = [F.transform("kids", lambda x: x["payload"]).alias("payloads")] if first else []
        up = up.select("g", F.col("parent").alias("idx"), "n", F.transform("kids", lambda x: x["digest"]).alias("nodes"), *more)
        rounds.append(spill(up.withColumn("layers", _layers(fanout, depth, _ceil_div("n", below))).drop("nodes"), "merkle-round"))
        last = rounds[-1].select("g", "idx", "n", F.expr("element_at(layers, -1)[0]").alias("digest"))
        done = last.filter(F.col("n") <= below * width).select("g", "n", F.col("digest").alias("top"), F.lit(len(rounds)).alias("height"))
        tops, now = done if tops is None else tops.unionByName(done), last.filter(F.col("n") > below * width)
    return rounds, tops


def descend(rounds: list[DataFrame], tops: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """idx, n, digest, payload, carry, proof of each leaf.

    tops: g, height, proof, carry: a leaf's proof is its own siblings' digests, then its group's proof; carry comes with it.
    """
    width, above = fanout**depth, None
    for height in range(len(rounds), 0, -1):
        enter = tops.filter(F.col("height") == height).select("g", F.lit(0).cast("long").alias("idx"), "proof", "carry")
        above = enter if above is None else above.unionByName(enter)
        first = ["payloads"] if height == 1 else []
        paths = F.expr(f"transform(sequence(0, size(layers[0]) - 1), pos -> named_struct('pos', pos, 'digest', layers[0][pos], 'own', {_path(fanout, depth)}))")
        kids = rounds[height - 1].join(above, ["g", "idx"]).select("g", "idx", "n", "proof", "carry", *first, F.explode(paths).alias("kid"))
        own = [F.col("kid.digest").alias("digest"), F.expr("payloads[kid.pos]").alias("payload")] if first else []
        above = kids.select("g", (F.col("idx") * width + F.col("kid.pos")).alias("idx"), F.concat("kid.own", "proof").alias("proof"), "carry", *(["n"] if first else []), *own)
    return above


def _fold(start: str, idx: str, n: str, offset: str, levels: int, fanout: int) -> Column:
    """struct(node, at): digests of `proof` folded into the hex node `start`, from byte `offset` on.

    A proof is digests alone: how many siblings a level has, and on which side, follows from the index and the counts.
    """
    run = f"(acc.idx div {fanout} * {fanout})"
    size = f"cast(least(cast({fanout} as bigint), acc.count - {run}) as int)"
    left = f"cast(64 * (acc.idx - {run}) as int)"
    hexed = f"lower(hex(substring(proof, acc.at + 1, 32 * ({size} - 1))))"
    joined = f"concat(substring({hexed}, 1, {left}), acc.node, substring({hexed}, {left} + 1))"
    step = f"named_struct('node', sha2({joined}, 256), 'idx', acc.idx div {fanout}, 'count', {_ceil_div('acc.count', fanout)}, 'at', acc.at + 32 * ({size} - 1))"
    zero = f"named_struct('node', {start}, 'idx', cast({idx} as bigint), 'count', cast({n} as bigint), 'at', cast({offset} as int))"
    return F.expr(f"aggregate(sequence(1, {max(levels, 1)}), {zero}, (acc, k) -> if(acc.count > 1, {step}, acc), acc -> named_struct('node', acc.node, 'at', acc.at))")


def _levels(n: int, fanout: int) -> int:
    k = 0
    while n > 1:
        n, k = -(-n // fanout), k + 1
    return k


def merkle_manifest(docs: DataFrame, changed: Column | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """doc_id, lang, leaf, idx, n, subroot, lang_idx, n_langs, root, proof, folded_root: a row for each row of docs.

    leaf and the roots are lower-case hexadecimal; proof is the binary of the siblings' digests, level by level from the leaf
    to the language's subroot and from there to the root. Leaves of a language ascend by doc_id, null first, rows of equal
    doc_id by their leaves (equal leaves are interchangeable); languages ascend by their bytes, null first. A level's last
    run may be shorter, a single node included; a lone leaf is its language's subroot, a lone subroot the root.
    folded_root is recomputed from the proof and the leaf, or from `changed`, the leaf of a tampered row, where that isn't
    null: then it differs from root. Null fields count as '-'. An empty table gives no row. Columns other than the five fields
    are left alone, whatever their names. No task takes more than fanout ** depth nodes of a group at a time; the number
    of languages, the size of the largest and the root come to the driver.
    """
    none = F.lit(None).cast("string")
    lang = F.col("lang").cast("string")
    group = F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), lang))  # sorts as languages do, null first
    leaves = docs.select(group.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf_hash(*[F.col(c) for c in FIELDS])).alias("digest"), F.unhex(none if changed is None else changed).alias("forged"))
    placed = indexed(spill(leaves, "merkle-leaves"), "g", ["doc_id", "digest"])
    rounds, tops = grow(placed.select("g", "idx", "n", "digest", F.struct("doc_id", "forged").alias("payload")), fanout, depth)
    langs = indexed(spill(tops, "merkle-subroots").select(F.lit("").alias("all"), F.struct("g", "height", "n", "top").alias("payload"), "g"), "all", ["g"])
    over, whole = grow(langs.select(F.col("all").alias("g"), "idx", "n", F.col("payload.top").alias("digest"), "payload"), fanout, depth)
    top = whole.select(F.lower(F.hex("top")).alias("root"), "n").first()
    root, n_langs = (top.root, top.n) if top else (None, 0)
    start = whole.select("g", "height", F.lit(b"").alias("proof"), none.alias("carry"))
    entries = descend(over, start, fanout, depth).select("payload.g", "payload.height", F.col("payload.n").alias("n"), "proof", F.struct(F.col("payload.top").alias("subroot"), F.col("idx").alias("lang_idx")).alias("carry"))
    entries = spill(entries, "merkle-entries")
    most = entries.agg(F.max("n")).first()[0] or 0
    proved = descend(rounds, entries, fanout, depth)
    hexed = lambda c: F.lower(F.hex(c))
    rows = proved.select("payload.doc_id", F.expr("if(g = '', null, substring(g, 2))").alias("lang"), hexed("digest").alias("leaf"), "idx", "n", hexed("carry.subroot").alias("subroot"), "carry.lang_idx", F.lit(n_langs).cast("long").alias("n_langs"), F.lit(root).cast("string").alias("root"), "proof", hexed(F.coalesce("payload.forged", "digest")).alias("start"))
    rows = rows.withColumn("inner", _fold("start", "idx", "n", "0", _levels(most, fanout), fanout))
    return rows.withColumn("folded_root", _fold("inner.node", "lang_idx", "n_langs", "inner.at", _levels(n_langs, fanout), fanout)["node"]).drop("inner", "start")


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; rows whose crc32(doc_id) 7 divides are tampered with."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    doc_id, source, lang, n_chars, text = [F.col(c) for c in FIELDS]
    made = merkle_manifest(docs, F.when(tampered, leaf_hash(doc_id, source, lang, n_chars + 1, text)))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, source, lang, n_chars, coalesce(text, '') AS t, text IS NULL AS no_text FROM documents),
parts AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS f_id, coalesce(strlen(source) || ':' || source, '-') AS f_source, coalesce(strlen(lang) || ':' || lang, '-') AS f_lang,
  CASE WHEN no_text THEN '-' ELSE strlen(t) || ':' || t END AS f_text,
  (xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END), 4294967295)) % 7 = 0 AS tampered FROM docs),
leaves AS (SELECT doc_id, lang, sha256(f_id || f_source || f_lang || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || f_text) AS leaf,
  CASE WHEN tampered THEN sha256(f_id || f_source || f_lang || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || f_text) END AS forged FROM parts),
placed AS (SELECT *, coalesce('+' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
up AS (SELECT g, 0 AS lev, idx AS i, n AS c, leaf AS h FROM placed
  UNION ALL SELECT g, any_value(lev) + 1, i // 2, any_value((c + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE c > 1 GROUP BY g, i // 2),
subs AS (SELECT g, lev, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM up WHERE c = 1),
over_up AS (SELECT 0 AS lev, idx AS i, n AS c, h FROM subs
  UNION ALL SELECT any_value(lev) + 1, i // 2, any_value((c + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM over_up WHERE c > 1 GROUP BY i // 2),
walk AS (SELECT p.doc_id, p.leaf, p.g, s.h AS subroot, s.idx AS lang_idx, s.lev AS top, p.idx AS i, 0 AS lev, '' AS proof, coalesce(p.forged, p.leaf) AS node FROM placed p JOIN subs s USING (g)
  UNION ALL SELECT w.doc_id, w.leaf, w.g, w.subroot, w.lang_idx, w.top, w.i // 2, w.lev + 1, w.proof || coalesce(u.h, ''), sha256(CASE WHEN w.i % 2 = 0 THEN w.node || coalesce(u.h, '') ELSE u.h || w.node END)
  FROM walk w LEFT JOIN up u ON u.g = w.g AND u.lev = w.lev AND u.i = xor(w.i, 1) WHERE w.lev < w.top),
over_walk AS (SELECT doc_id, leaf, subroot, lang_idx AS i, 0 AS lev, proof, node FROM walk WHERE lev = top
  UNION ALL SELECT w.doc_id, w.leaf, w.subroot, w.i // 2, w.lev + 1, w.proof || coalesce(u.h, ''), sha256(CASE WHEN w.i % 2 = 0 THEN w.node || coalesce(u.h, '') ELSE u.h || w.node END)
  FROM over_walk w LEFT JOIN over_up u ON u.lev = w.lev AND u.i = xor(w.i, 1) WHERE w.lev < (SELECT max(lev) FROM over_up))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM over_walk, (SELECT h AS root FROM over_up WHERE c = 1) WHERE lev = (SELECT max(lev) FROM over_up)
"""
