"""Phrases whose words stand together more often than chance, mined depth-first over bitmaps of word positions.

A shard is a few megabytes of texts. Its tokens are numbered, with a hole between pieces, so nothing reaches over a boundary.
Each word has a bitmap of its positions, compressed to blocks of BLOCK bits that aren't empty. A phrase's bitmap holds the
positions of its last words: shifted by one and ANDed with a word's bitmap it is the bitmap of the phrase that is one word
longer, and its popcount the shard's count. The ANDs of a prefix with all words are made from the transposed index, by block,
so words that have no bit in a block cost nothing. Prefixes are taken some at a time and followed to their full length before
the next. Counts are summed over shards.

A phrase can only be frequent if its shorter parts are: words go first, then phrases of two words, then of three, and frequent
ones of the level before reach the tasks as a bit map of fixed size. What that lets through by chance the sums drop.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Bloom, mix, parts, release, small_batches, spill, table

BLOCK = 8
MINIMUM, HALF, MOST = 10, 50, 2000
#: Bits (as powers of two) of the maps of frequent words and of frequent pairs: 4 and 16 MB.
WORD_BITS, PAIR_BITS = 25, 27
#: Bytes of text in a shard.
SHARD = 1 << 21

_BOUNDS = bytes(46 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def tokens(texts: list[bytes], langs: list) -> tuple[np.ndarray, list]:
    """Word numbers by position, -1 in holes, and the (language, word) of each number.

    bytes.lower() changes A-Z alone. Bounds of pieces become words of their own, which no other word equals; what is left of
    white space is space and tab, at which split() cuts.
    """
    by_lang: dict = {}
    for text, lang in zip(texts, langs, strict=True):
        by_lang.setdefault(lang, []).append(text)
    places, words = [], []
    for lang, mine in by_lang.items():
        ids = _Ids()
        number = ids[b"."]
        cut = b".".join([*mine, b""]).lower().translate(_BOUNDS).replace(b".", b" . ").split()
        at = np.fromiter(map(ids.__getitem__, cut), dtype=np.int64, count=len(cut))
        places.append(np.where(at == number, -1, at - 1 + len(words)))
        words += [(lang, w) for w in list(ids)[1:]]
    return np.concatenate(places) if places else np.zeros(0, np.int64), words


def _hash(words: list) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as digest

    seeds = {lang: int(digest(lang)) for lang in {lang for lang, _ in words}}
    return np.fromiter((digest(w, seeds[lang]) for lang, w in words), dtype=np.uint64, count=len(words))


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _P + second)


class Bitmaps:
    """Compressed bitmaps of some words' positions: entries (word, block, mask), by word and by block."""

    def __init__(self, at: np.ndarray, wanted: np.ndarray):
        """at: word numbers by position; wanted: which numbers get a bitmap."""
        pos = np.flatnonzero((at >= 0) & np.append(wanted, False)[at])
        order = np.argsort(at[pos].astype(np.int32), kind="stable")
        pos = pos[order]
        word, block, bit = at[pos], pos // BLOCK, (1 << (pos % BLOCK)).astype(np.uint8)
        new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (block[1:] != block[:-1])])) if len(word) else np.zeros(0, np.int64)
        self.word, self.block = word[new], block[new]
        self.mask = np.bitwise_or.reduceat(bit, new) if len(new) else np.zeros(0, np.uint8)
        order = np.argsort(self.block.astype(np.int32), kind="stable")
        self.b_word, self.b_mask = self.word[order], self.mask[order]
        self.first = np.searchsorted(self.block[order], np.arange(len(at) // BLOCK + 3))

    def extend(self, node: np.ndarray, block: np.ndarray, mask: np.ndarray):
        """node, word, block, mask of the prefixes' bitmaps, shifted by one, AND every word's bitmap, where that isn't empty."""
        carry = np.flatnonzero(mask >> np.uint8(BLOCK - 1))
        node, block = np.concatenate([node, node[carry]]), np.concatenate([block, block[carry] + 1])
        mask = np.concatenate([mask << np.uint8(1), np.ones(len(carry), np.uint8)])
        size = self.first[block + 1] - self.first[block]
        size[mask == 0] = 0
        end = np.cumsum(size)
        entry = np.arange(end[-1] if len(end) else 0) + np.repeat(self.first[block] - end + size, size)
        both = np.repeat(mask, size) & self.b_mask[entry]
        hit = np.flatnonzero(both)
        source = np.searchsorted(end, hit, side="right")
        return node[source], self.b_word[entry[hit]], block[source], both[hit]


def _phrases(node: np.ndarray, word: np.ndarray, mask: np.ndarray, n: int):
    """Distinct (node, word) as node * n + word, where each one's rows begin in the order of codes, that order, and the popcounts' sums."""
    code = node * n + word
    order = np.argsort(code)
    code = code[order]
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    count = np.add.reduceat(np.bitwise_count(mask[order]).astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
    return code[new], new, order, count


def _count_words(batches):
    """key, n: of each shard's words."""
    import pyarrow as pa

    for part, texts in parts(batches, limit=SHARD):
        at, words = tokens(texts, part.column(0).to_pylist())
        n = np.bincount(at[at >= 0], minlength=len(words))
        yield pa.RecordBatch.from_arrays([_keys(_named(words), [np.arange(len(words))]), pa.array(n)], ["key", "n"])


def _hash_words(batches):
    """h of rows (lang, phrase)."""
    import pyarrow as pa

    for b in batches:
        words = list(zip(b.column(0).to_pylist(), (w.encode() for w in b.column(1).to_pylist()), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(_hash(words).view(np.int64))], ["h"])


def _named(words: list):
    """A shard's words and their languages as Arrow columns."""
    import pyarrow as pa

    return pa.array([w for _, w in words], pa.binary()), pa.array([lang for lang, _ in words], pa.string()).cast(pa.binary())


def _keys(named, columns: list[np.ndarray]):
    """An Arrow column of phrase, tab and language; the phrases' words have the numbers in columns. One short key keeps shuffles small."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names, langs = named
    phrase = [names.take(pa.array(c)) for c in columns]
    phrase = phrase[0] if len(phrase) == 1 else pc.binary_join_element_wise(*phrase, b" ")
    key = pc.binary_join_element_wise(phrase, langs.take(pa.array(columns[0])), b"\t")
    return key.cast(options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True))


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _prefixes(batches, words_map: Bloom, most: int = 1 << 14):
    """Of each shard the words, their hashes and bitmaps; then piece by piece node, word, block, mask of phrases of two words.

    A piece is some prefixes' entries. What two pieces count of a phrase adds up.
    """
    for part, texts in parts(batches, limit=SHARD):
        at, words = tokens(texts, part.column(0).to_pylist())
        h = _hash(words)
        maps = Bitmaps(at, words_map.has(slots(h, words_map.bits)))
        for i in range(0, len(maps.word), most):
            yield words, h, maps, maps.extend(maps.word[i : i + most], maps.block[i : i + most], maps.mask[i : i + most])


def _count_pairs(batches, words_map: Bloom, hold: int = 1 << 20):
    """bucket, pairs: counts of phrases of two words by 44 bits of hash. A row has those of 12 bits: the other 32 bits of each
    phrase, then its counts in a byte each, which stop at 255.

    Until then a phrase and its count are one number, the count in the low 20 bits, so they are sorted in place.
    """
    import pyarrow as pa

    low20 = np.uint64((1 << 20) - 1)

    def out(held):
        both = np.concatenate(held)
        held.clear()
        both.sort()
        code = both >> np.uint64(20)
        new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        code = code[new]
        both &= low20
        n = np.minimum(np.add.reduceat(both, new), 255).astype(np.uint8)
        del both
        bucket, low = (code >> np.uint64(32)).astype(np.int32), code.astype(np.uint32)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = [*cut[1:].tolist(), len(code)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array([low[i:j].tobytes() + n[i:j].tobytes() for i, j in zip(cut.tolist(), ends, strict=True)], pa.binary())], ["bucket", "pairs"])

    held, size = [], 0
    for words, h, _, (node, word, _, mask) in _prefixes(batches, words_map):
        code, _, _, n = _phrases(node, word, mask, len(words))
        if len(code):
            held.append(_pair_hash(h[code // len(words)], h[code % len(words)]) & ~low20 | np.minimum(n, 255).astype(np.uint64))
            size += len(code)
        if size > hold:
            yield out(held)
            size = 0
    if held:
        yield out(held)
    release()


def _frequent_pairs(batches, minimum: int):
    """h of the pairs whose counts, summed over the rows of a bucket, reach the minimum. Rows come sorted by bucket."""
    import pyarrow as pa

    def summed(bucket, bodies):
        low = np.concatenate([np.frombuffer(b, np.uint32, len(b) // 5) for b in bodies])
        n = np.concatenate([np.frombuffer(b, np.uint8, offset=len(b) // 5 * 4) for b in bodies])
        order = np.argsort(low)
        low, n = low[order], n[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        good = low[new][np.add.reduceat(n, new) >= minimum].astype(np.uint64)
        h = (np.uint64(bucket) << np.uint64(52)) | (good << np.uint64(20))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    now, bodies = None, []
    for batch in batches:
        for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != now and bodies:
                yield summed(now, bodies)
                bodies = []
            now = bucket
            bodies.append(body)
    if bodies:
        yield summed(now, bodies)


def _mine(batches, words_map: Bloom, pairs_map: Bloom, most: int = 1 << 14):
    """key, n: each shard's phrases of two and three words whose pairs may be frequent, followed depth-first."""
    import pyarrow as pa

    def rows(columns, n):
        return pa.RecordBatch.from_arrays([_keys(named, columns), pa.array(n)], ["key", "n"])

    of = named = None
    for words, h, maps, (node, word, block, mask) in _prefixes(batches, words_map):
        n = len(words)
        code, new, order, count = _phrases(node, word, mask, n)
        first, second = code // n, code % n
        frequent = pairs_map.has(slots(_pair_hash(h[first], h[second]), pairs_map.bits))
        if not frequent.any():
            continue
        if words is not of:  # once a shard, not for each of its pieces
            of, named = words, _named(words)
        yield rows([first[frequent], second[frequent]], count[frequent])
        number = np.repeat(np.arange(len(code)), np.diff(np.append(new, len(order))))
        live = frequent[number]
        node, order = number[live], order[live]
        block, mask = block[order], mask[order]
        for k in range(0, len(node), most):
            up, third, _, mask3 = maps.extend(node[k : k + most], block[k : k + most], mask[k : k + most])
            code3, _, _, count3 = _phrases(up, third, mask3, n)
            top, third = code3 // n, code3 % n
            good = pairs_map.has(slots(_pair_hash(h[second[top]], h[third]), pairs_map.bits))
            top, third, count3 = top[good], third[good], count3[good]
            if len(top):
                yield rows([first[top], second[top], third], count3)


def frequent(docs: DataFrame, minimum: int = MINIMUM) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of all words, and (size, lang, phrase, a) of phrases of two and three words that occur at least `minimum` times.

    docs: lang, text, both never null. Which pairs may be frequent is found by hash alone; their texts and exact counts come
    from the last run. minimum: at most 255.
    """
    source = docs.select("lang", "text")
    spark = docs.sparkSession

    def summed(mapper) -> DataFrame:
        total = source.mapInArrow(mapper, "key string, n long").groupBy("key").agg(F.sum("n").alias("a"))
        return total.select(F.expr("substring(key, instr(key, '\t') + 1)").alias("lang"), F.substring_index("key", "\t", 1).alias("phrase"), "a")  # a phrase has no tab

    # No stage below has two functions of batches, and all of it runs here: one worker a core, and small batches only meanwhile.
    with small_batches(spark):
        words = spill(summed(_count_words), "words")
        known = words.filter(F.col("a") >= minimum).select("lang", "phrase")
        words_map = spark.sparkContext.broadcast(Bloom.of_slots(known, "h", slots, WORD_BITS, made=_hash_words))
        pairs = source.mapInArrow(lambda batches: _count_pairs(batches, words_map.value), "bucket int, pairs binary").repartition("bucket").sortWithinPartitions("bucket")
        pairs_map = spark.sparkContext.broadcast(Bloom.of_slots(pairs, "h", slots, PAIR_BITS, made=partial(_frequent_pairs, minimum=minimum)))
        phrases = summed(lambda batches: _mine(batches, words_map.value, pairs_map.value)).filter(F.col("a") >= minimum)
        phrases = spill(phrases.select(F.size(F.split("phrase", " ")).alias("size"), "*"), "phrases")
    words_map.unpersist()
    pairs_map.unpersist()
    return words, phrases


def _with_count(rows: DataFrame, key: str, counts: DataFrame, out: str, total: int, hot: int = 1000) -> DataFrame:
    """rows with out: the count of the phrase in column key. total: the sum of all counts.

    A word that begins very many phrases has a large count itself. Those of at least a thousandth of all, so a thousand
    words at most, are broadcast; the others' rows are shuffled.
    """
    names = rows.columns
    small = counts.select(F.col("lang").alias("c_lang"), F.col("phrase").alias("c_phrase"), F.col("a").alias(out))
    on = (F.col("lang") == F.col("c_lang")) & (F.col(key) == F.col("c_phrase"))
    frequent_ = F.broadcast(small.filter(F.col(out) * hot >= total))
    rest = rows.join(frequent_, on, "left_anti").join(small.filter(F.col(out) * hot < total), on)
    return rows.join(frequent_, on).select(*names, out).unionByName(rest.select(*names, out))


def collocations(docs: DataFrame, minimum: int = MINIMUM, half: int = HALF, most: int | None = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two and three words.

    a: the phrase's occurrences, overlapping ones too; l, r: those of its two parts at the cut with the lowest score; n: all
    words of the language; score: floor(1000000 * a * a / (l * r)) in exact decimals. A phrase inside a longer one that occurs
    at least half % as often is left out. Ties go by a, then by the phrase's bytes, so every rank is taken once; most=None
    gives all. Null languages count as `und`, null texts as empty, repeated rows count each time; an empty table gives no row.
    Columns other than lang and text are left alone. Counts must be below 10**15, so that the products fit 38 digits.
    """
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words, phrases = frequent(source, minimum)
    n = words.groupBy("lang").agg(F.sum("a").alias("n"))
    known = words.filter(F.col("a") >= minimum)
    total = words.agg(F.sum("a")).first()[0] or 0
    square = lambda x, y: F.col(x).cast("decimal(15,0)") * F.col(y).cast("decimal(15,0)")

    def scored(rows: DataFrame, l: str, r: str) -> DataFrame:  # noqa: E741
        cut = rows.withColumn("over", F.lit(1000000).cast("decimal(7,0)") * square("a", "a")).withColumn("under", square(l, r))
        return cut.withColumn("score", F.expr("over div under").cast("long")).drop("over", "under")

    w = F.split("phrase", " ")
    two = phrases.filter("size = 2").select("lang", "phrase", "a", w[0].alias("w1"), w[1].alias("w2"))
    two = spill(scored(_with_count(_with_count(two, "w1", known, "l", total), "w2", known, "r", total), "l", "r").select("lang", "phrase", "a", "l", "r", "score"), "pairs")
    three = phrases.filter("size = 3").select("lang", "phrase", "a", F.concat_ws(" ", w[0], w[1]).alias("p1"), F.concat_ws(" ", w[1], w[2]).alias("p2"))
    # A pair's row has the counts of its words, so a phrase of three words finds all four counts in its two pairs.
    head = two.select("lang", F.col("phrase").alias("p1"), F.col("a").alias("l2"), F.col("l").alias("l1"))
    tail = two.select("lang", F.col("phrase").alias("p2"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    four = three.join(head, ["lang", "p1"]).join(tail, ["lang", "p2"])
    cuts = scored(scored(four, "l1", "r1").withColumnRenamed("score", "s1"), "l2", "r2").withColumnRenamed("score", "s2")
    early = F.col("s1") <= F.col("s2")
    best = cuts.select("lang", "phrase", "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    longer = three.select("lang", F.explode(F.array_distinct(F.array("p1", "p2"))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = two.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < half * F.col("a"))).drop("longer")
    found = alone.unionByName(best)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    if most is not None:  # the best of each piece of a language go on, so no language is sorted in one task
        pieces = found.withColumn("piece", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        found = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "piece").orderBy(F.desc("score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= most).drop("piece", "rank")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked if most is None else ranked.filter(F.col("rank") <= most)
    return ranked.join(F.broadcast(n) if n.count() <= 1 << 16 else n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH piece AS (SELECT lang, row_number() OVER () AS id, ws FROM (
  SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents))),
word AS (SELECT lang, id, k, ws[k] AS w, ws[k + 1] AS w2, ws[k + 2] AS w3, len(ws) AS m FROM (SELECT lang, id, ws, unnest(range(1, len(ws) + 1)) AS k FROM piece)),
f1 AS (SELECT lang, w, count(*) AS f FROM word GROUP BY ALL),
f2 AS (SELECT lang, w, w2, count(*) AS f FROM word WHERE k + 1 <= m GROUP BY ALL),
f3 AS (SELECT lang, w, w2, w3, count(*) AS f FROM word WHERE k + 2 <= m GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
two AS (SELECT p.lang, p.w || ' ' || p.w2 AS phrase, p.w, p.w2, p.f AS a, x.f AS l, y.f AS r FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w = p.w JOIN f1 y ON y.lang = p.lang AND y.w = p.w2 WHERE p.f >= 10),
three AS (SELECT t.*, x.f AS l1, b.f AS r1, c.f AS l2, y.f AS r2, 1000000::HUGEINT * t.f * t.f // (x.f::HUGEINT * b.f) AS s1, 1000000::HUGEINT * t.f * t.f // (c.f::HUGEINT * y.f) AS s2
  FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w = t.w JOIN f2 b ON b.lang = t.lang AND b.w = t.w2 AND b.w2 = t.w3
  JOIN f2 c ON c.lang = t.lang AND c.w = t.w AND c.w2 = t.w2 JOIN f1 y ON y.lang = t.lang AND y.w = t.w3 WHERE t.f >= 10),
longer AS (SELECT lang, w, w2, max(f) AS f FROM (SELECT lang, w, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
found AS (SELECT t.lang, phrase, a, l, r, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM two t LEFT JOIN longer g ON g.lang = t.lang AND g.w = t.w AND g.w2 = t.w2 WHERE g.f IS NULL OR 100 * g.f < 50 * a
  UNION ALL SELECT lang, w || ' ' || w2 || ' ' || w3, f, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM three)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM found) JOIN total USING (lang) WHERE rank <= 2000
"""
