"""N-gram Jaccard join by universe partitioning.

Two sets with Jaccard similarity >= t differ in at most H = (|r| + |s|)(1 - t)/(1 + t) elements. Sets are dealt into bands by
size. For a band, the universe of shingles is hashed into segments whose weights add up to more than H: a segment of weight
1 is indexed by the subset of the set that falls into it, one of weight 2 also by the subset without any one of its
elements (its one-deletion neighbourhood), so that it still meets a partner that differs in one element there. If no
segment met, every segment would differ by its weight at least, more than H together. How many segments get weight 2 is
chosen for each band by cost (`allocate`). A set that is small or lop-sided may have too many empty segments, which are
not indexed; those sets are left over for the exact fallback below.

Sets are compared once for each class of equal sets. Of a signature's sets the smallest is compared with each of the others.
If a map task has many sets of one signature, they go on under a signature of that task's own, and only their smallest
under the shared one, so that no reducer gets a hot signature whole. For a signature of two sets that is all; in larger
groups it makes chains of links. A group is torn if its sets are not all linked in the end. The sets of a torn group of up
to FEW are compared with each other. As the weights add up to more than H, a set meets each partner under several signatures
(`needs`), most of all if it is large: if a partner is still missing, what is linked with the set touches as many larger torn
groups. So whatever touches fewer is done; sets that share a common line and little else mostly are. The others, and the
sets left over, are joined exactly by prefix: two sets with the similarity share an element among
the first |r| - ceil(t|r|) + 1 of each, in an order that puts the elements that most of these sets have last; elements
whose sets are all linked already are skipped, and elements that the same sets have are one key (`_merged`). Candidates that
a bit sketch of both sets doesn't rule out are verified on the whole sets.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Bloom, components, discard, mix, parts, release, spill, table, texts, window_hashes, words_of_batch

WORDS = 5
NUM, DEN = 80, 100  # the similarity as a fraction
HOT = 16  # sets of one signature in a task that go on as they are
MINIMA = 8  # triples of hash functions by which sets that are left are gathered before they are joined by prefix
FEW = 8  # sets of a torn group that are compared with each other
BLOCK = 1024  # sets of one key of the join by prefix that are compared in one piece
PART = {"rows": 512, "limit": 1 << 20}  # what a task works on at a time: work space is some thirty times the text
MARK = np.int64(-(1 << 63))  # stands among the sets of a signature that a task has salted
_U = np.uint64


def shingles(texts_: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, a text of none has none."""
    h, first = words_of_batch(texts_, lower=True)
    w = window_hashes(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(w[a : b - size + 1]))
        elif b > a:
            out.append(window_hashes(h[a:b], b - a, seed=100 + b - a))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out


def bands(upto: int, ratio: float = 1.5) -> np.ndarray:
    edges = [1]
    while edges[-1] <= upto:
        edges.append(max(edges[-1] + 1, int(edges[-1] * ratio)))
    return np.array(edges, dtype=np.int64)


def allocate(low: int, high: int) -> tuple[int, int, int]:
    """For a band of sizes low..high: segments, how many of them have weight 2, and the largest difference of a pair.

    Cost of a layout: signatures for each set, and eight for each segment likely to be empty (lost weight).
    """
    most = (high + high * DEN // NUM) * (DEN - NUM) // (DEN + NUM)
    weight = most + 1 + 3 + most // 16
    n = (low + high) / 2

    def cost(double: int) -> float:
        m = weight - double
        return m + double * (1 + n / m) + 8 * m * np.exp(-n / m)

    double = min(range(weight // 2 + 1), key=cost) if weight < 200 else 0
    return weight - double, double, most


def _segments(sets: list[np.ndarray]):
    """For sets dealt into segments, first in their own families and then in those below: the sets' numbers, their families,
    (first slot, segments, segments of weight 2) of each set, its elements, owner and slot of each, elements in each slot,
    and by how much a set's weight exceeds its largest difference from a partner."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    edges = bands(int(sizes.max(initial=1)))
    plan = [allocate(int(a), int(b) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    m_of, d_of = np.array([p[0] for p in plan]), np.array([p[1] for p in plan])
    band = np.searchsorted(edges, sizes, side="right") - 1
    for step in (0, 1):  # in its own family, and in the one below if a partner can be there
        family = band - step
        live = np.flatnonzero((sizes > 0) & (family >= 0) & (sizes * NUM <= DEN * (edges[np.maximum(family, 0) + 1] - 1)))
        if not len(live):
            continue
        n, fam = sizes[live], family[live]
        m, d = m_of[fam], d_of[fam]
        base = np.cumsum(m) - m
        tokens = np.concatenate([sets[i] for i in live])
        owner = np.repeat(np.arange(len(live)), n)
        seg = ((mix(tokens ^ _U(0xA5A5)) >> _U(33)) * m[owner].astype(_U) >> _U(31)).astype(np.int64)
        slot = base[owner] + seg
        count = np.bincount(slot, minlength=int(m.sum()))
        who = np.repeat(np.arange(len(live)), m)
        double = np.arange(len(count)) - base[who] < d[who]
        weight = np.where(double, np.where(count >= 2, 2, 0), np.where(count >= 1, 1, 0))
        have = np.bincount(who, weights=weight, minlength=len(live)).astype(np.int64)
        # the largest difference of this set from a partner in this family
        partner = np.minimum(n * DEN // NUM, (edges[fam + 1] - 1) * DEN // NUM) if step == 0 else edges[fam + 1] - 1
        far = (n + partner) * (DEN - NUM) // (DEN + NUM)
        yield live, fam, base, m, d, tokens, owner, slot, count, have - far


def needs(sets: list[np.ndarray]) -> np.ndarray:
    """How many signatures at least a set shares with any partner; 0 if it is left over. Segments that don't meet weigh no more
    than the two differ, so those that meet weigh as much as the excess, and each of them is a signature of its own."""
    out = np.full(len(sets), np.iinfo(np.int64).max)
    for live, _, _, _, d, *_, excess in _segments(sets):
        out[live] = np.minimum(out[live], np.where(excess <= 2 * d, (excess + 1) // 2, excess - d))
    return np.maximum(out, 0)


def signatures(sets: list[np.ndarray], keys: np.ndarray):
    """(signature, key) of every indexed subset, and the keys of the sets left over."""
    sig, key, short = [], [], np.zeros(len(sets), dtype=bool)
    for live, fam, base, m, d, tokens, owner, slot, count, excess in _segments(sets):
        value = mix(tokens)
        total = np.zeros(len(count), dtype=_U)
        np.add.at(total, slot, value)
        who = np.repeat(np.arange(len(live)), m)
        place = np.arange(len(total)) - base[who]
        salt = mix((fam[who].astype(_U) << _U(32)) + place.astype(_U) + _U(1))
        double = place < d[who]
        short[live[excess <= 0]] = True
        full = count > 0
        sig.append(mix(total[full] ^ salt[full]))
        key.append(keys[live][who[full]])
        cut = double[slot] & (count[slot] >= 2)
        sig.append(mix((total[slot[cut]] - value[cut]) ^ salt[slot[cut]]))
        key.append(keys[live][owner[cut]])
    if not sig:
        return np.zeros(0, _U), np.zeros(0, np.int64), keys[short]
    return np.concatenate(sig), np.concatenate(key), keys[short]


def _rows(r, b):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(r), pa.array(b)], ["r", "b"])


def _left_mark(keys: np.ndarray) -> np.ndarray:
    """The signature under which a set that is left over is told."""
    return mix(keys.view(_U) ^ _U(0x1EF70E51)).view(np.int64)


def _class_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    one = np.array([int(mix(s).sum(dtype=_U)) for s in sets], dtype=_U)
    two = np.array([int(mix(s ^ _U(0x5BD1E995)).sum(dtype=_U)) for s in sets], dtype=_U)
    n = np.array([len(s) for s in sets], dtype=_U)
    # The first key begins with the size, so that the smallest key of a group is that of its smallest set.
    return ((np.minimum(n, _U(0x7FFF)) << _U(48)) | (mix(one + n) >> _U(16))).view(np.int64), mix(two ^ n).view(np.int64)


def parity(tokens: np.ndarray) -> bytes:
    """For each of n to 2n bits, at least 1024, whether an odd number of the n elements fall on it. Two sets' bits differ in no more places
    than the sets differ in elements; longer ones are folded to the length of shorter ones by exclusive or."""
    bits = 1 << max(10, (max(1, len(tokens)) - 1).bit_length())
    return np.packbits(np.bincount((mix(tokens ^ _U(0x51ED270B)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def may_link(n: int, p: bytes, m: int, q: bytes) -> bool:
    """Whether sizes and parities leave it open that two sets have the similarity."""
    if min(n, m) * DEN < max(n, m) * NUM:
        return False
    while len(p) != len(q):
        if len(p) < len(q):
            n, p, m, q = m, q, n, p
        half = len(p) // 2
        p = (int.from_bytes(p[:half], "little") ^ int.from_bytes(p[half:], "little")).to_bytes(half, "little")
    return (int.from_bytes(p, "little") ^ int.from_bytes(q, "little")).bit_count() * (DEN + NUM) <= (n + m) * (DEN - NUM)


def _folded(batches):
    """doc_id and its parity folded to 1024 bits, as 16 longs; none if there are several sets of one doc_id."""
    import pyarrow as pa

    for x in batches:
        rows = []
        for p, many in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True):
            rows.append(None if many > 1 else np.bitwise_xor.reduce(np.frombuffer(p, "<i8").reshape(-1, 16), axis=0).tolist())
        yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array([None if r is None else r[k] for r in rows], pa.int64()) for k in range(16))], ["doc_id", *(f"p{k}" for k in range(16))])


def _set_keys(batches):
    import pyarrow as pa

    for b, t in parts(batches, **PART):
        sets = shingles(t)
        k1, k2 = _class_keys(sets)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), pa.array([parity(s) for s in sets], pa.binary()), pa.array(needs(sets))], ["doc_id", "n_shingles", "k1", "k2", "parity", "need"])


def _sift(batches):
    """Rows (a, b) of those pairs that sizes and parities don't rule out."""
    import pyarrow as pa

    for x in batches:
        na, pa_, nb, pb = (x.column(k).to_pylist() for k in range(2, 6))
        keep = [may_link(*r) for r in zip(na, pa_, nb, pb, strict=True)]
        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _star(r: np.ndarray, b: np.ndarray):
    """Of rows sorted by (r, b): where a group begins, and each row's first b."""
    new = np.concatenate([[True], r[1:] != r[:-1]])
    return new, b[np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))]


def _emit(batches, hold: int = 1 << 18):
    """Rows (r, b): set b has signature r. Of more than HOT sets in this task, all but the smallest have it salted."""
    from pyspark import TaskContext

    held, size, salt = [], 0, int(TaskContext.get().partitionId()) << 24

    def out():
        sig, key = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        new, _ = _star(sig, key)
        once = new.copy()
        once[1:] |= key[1:] != key[:-1]
        sig, key, new = sig[once], key[once], new[once]
        at = np.flatnonzero(new)
        hot = np.repeat(np.diff(np.append(at, len(sig))) > HOT, np.diff(np.append(at, len(sig))))
        r = np.concatenate([np.where(hot, mix(sig ^ mix(np.array([salt], dtype=_U))), sig), sig[hot & new], sig[hot & new]]).view(np.int64)
        b = np.concatenate([key, key[hot & new], np.full(int((hot & new).sum()), MARK)])
        for k in range(0, len(r), 1 << 16):  # the JVM holds a batch outside its heap
            yield _rows(r[k : k + (1 << 16)], b[k : k + (1 << 16)])

    for _, t in parts(batches, **PART):
        sets = shingles(t)
        keys = _class_keys(sets)[0]
        _, once = np.unique(keys, return_index=True)  # copies in this part
        sig, key, short = signatures([sets[k] for k in once], keys[once])
        if len(short):
            yield _rows(_left_mark(short), short)
        held.append((sig, key))
        size += len(sig)
        if size > hold:
            yield from out()
            held, size, salt = [], 0, salt + 1
    if held and size:
        yield from out()


def _reduce(batches):
    """Of a signature's sets, pairs (a, b) of the smallest with each other one; for three sets or more also the signature g,
    and whether the group is wide: more than FEW sets, or some of it salted. A set that is left over is a pair with itself."""
    import pyarrow as pa

    last, carried = None, np.zeros(0, dtype=np.int64)
    for x in batches:
        if not x.num_rows:
            continue
        r, b = x.column(0).to_numpy(), x.column(1).to_numpy()
        salted = np.union1d(r[b == MARK], carried)
        carried = salted[salted == r[-1]]  # the last signature goes on in the next batch, perhaps after its mark
        again = np.concatenate([[False], (r[1:] == r[:-1]) & (b[1:] == b[:-1])]) | (b == MARK)
        edge = r[-1]
        r, b = r[~again], b[~again]
        if not len(r):
            continue
        left = _left_mark(b) == r
        new, first = _star(r, b)
        at = np.flatnonzero(new)
        n = np.repeat(np.diff(np.append(at, len(r))), np.diff(np.append(at, len(r))))
        open_ = (r == edge) | np.isin(r, salted)  # the last group may go on in the next batch
        if last is not None and r[0] == last[0]:
            mine = r == r[0]
            first = np.where(mine, last[1], first)
            open_ |= mine
        last = (r[-1], first[-1])
        keep = (first != b) | left
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(first[keep]), pa.array(b[keep]), pa.array(r[keep], mask=~((n > 2) | open_)[keep]), pa.array(((n > FEW) | open_)[keep])], ["a", "b", "g", "wide"])


def _slot(bits: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).alias("slot")


def _through(batches, bloom):
    """Parts of those rows that the bit map lets through."""
    import pyarrow as pa

    yield from parts((b.filter(pa.array(bloom.value.has(b.column(2).to_numpy()))) for b in batches), **PART)


def _chosen_sets(batches, bloom=None):
    """doc_id and the whole set of the documents that the bit map lets through."""
    import pyarrow as pa

    for b, t in _through(batches, bloom):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingles(t)], pa.binary())], ["doc_id", "elements"])


def _frequent(batches, bloom=None, limit: int = 1 << 20, minima: int = MINIMA):
    """Rows (e, m, doc_id): with doc_id null, how many of this task's sets have an element that several have (an order is made
    of that, never a filter); else m stands for the smallest hashes of doc_id's set by the e-th three of 3 * `minima` hash functions."""
    import pyarrow as pa

    held, size = [], 0

    def out():
        e, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(e[n > 1].view(np.int64)), pa.array(n[n > 1]), pa.nulls(int((n > 1).sum()), pa.int64())], ["e", "m", "doc_id"])

    salts = mix(np.arange(1, 3 * minima + 1, dtype=_U))[:, None]

    def low_of(x):
        a = mix(x[None, :] ^ salts).min(axis=1).reshape(minima, 3)
        return mix(a[:, 0] + mix(a[:, 1] + mix(a[:, 2])))

    for b, t in _through(batches, bloom):
        sets = shingles(t)
        held += sets
        size += sum(map(len, sets))
        low = [low_of(s) if len(s) else None for s in sets]
        some = [k for k, x in enumerate(low) if x is not None]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(minima, dtype=np.int64), len(some))), pa.array(np.concatenate([low[k] for k in some]).view(np.int64)), b.column(0).take(pa.array(np.repeat(some, minima)))], ["e", "m", "doc_id"])
        if size > limit:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _prefixes(batches, bloom=None, common=None):
    """(element, doc_id, n, place) of the first elements of each set; common elements come last, then the order is by hash."""
    import pyarrow as pa

    known = common.value
    for b, t in _through(batches, bloom):
        sets, cut = shingles(t), []
        for s in sets:
            at = np.searchsorted(known, s)
            frequent = known[np.minimum(at, len(known) - 1)] == s if len(known) else np.zeros(len(s), bool)
            cut.append(np.concatenate([s[~frequent], s[frequent]])[: len(s) - -(-NUM * len(s) // DEN) + (len(s) > 0)])
        n = np.array([len(s) for s in cut], dtype=np.int64)
        if n.sum():
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cut).view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.repeat([len(s) for s in sets], n)), pa.array(place)], ["e", "doc_id", "n", "place"])


def _verify(batches):
    import pyarrow as pa

    for x in batches:
        keep = []
        for p, q in zip(x.column(2), x.column(3), strict=True):
            r, s = np.frombuffer(p.as_buffer(), dtype=_U), np.frombuffer(q.as_buffer(), dtype=_U)
            if len(r) > len(s):
                r, s = s, r
            at = np.searchsorted(s, r)
            both = int((s[np.minimum(at, len(s) - 1)] == r).sum()) if len(s) else 0
            keep.append(DEN * both >= NUM * (len(r) + len(s) - both) and both > 0)
        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    release()


#: Whether two sizes leave room for the similarity.
FITS = f"least(n, nb) * {DEN} >= greatest(n, nb) * {NUM}"


def _gather(minima: DataFrame, sizes: DataFrame, links: DataFrame, linked: DataFrame, checked: DataFrame, sift, verified, bits, rounds: int = 2):
    """Before sets are joined by prefix: find most of the links among them with few pairs.

    In families of near copies nearly every two sets meet by prefix, and most of those pairs would say nothing new. So sets
    with three equal smallest hashes (minima: e, m, doc_id) are compared with one of them first: with the smallest set, and in
    further rounds with others, as long as their roots differ. What this misses, the join by prefix finds.
    Gives links, components, and the pairs that were compared.
    """
    keyed = minima.join(sizes, "doc_id")
    for turn in range(rounds):
        roots = linked.select(F.col("node").alias("doc_id"), "root")
        now = keyed.join(roots, "doc_id", "left").select("e", "m", "doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
        key = F.col("n") if turn == 0 else F.xxhash64("doc_id", F.lit(turn))
        pivot = now.groupBy("e", "m").agg(F.min(F.struct(key.alias("k"), "doc_id", "n", "root")).alias("p")).select("e", "m", F.col("p.doc_id").alias("b"), F.col("p.n").alias("nb"), F.col("p.root").alias("rb"))
        met = now.join(pivot, ["e", "m"]).filter(f"root <> rb and {FITS}").select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct()
        new = spill(sift(met.join(checked, ["a", "b"], "left_anti")), "gathered-pairs")
        if not new.head(1):
            break
        checked = checked.union(new)
        links = links.union(verified(new, bits(new.select(F.col("a").alias("doc_id")).union(new.select("b")).distinct())))
        linked = components(links)
    return links, linked, checked


def _merged(first: DataFrame) -> DataFrame:
    """Of rows (e, doc_id, n, place, root): the same with one key e for elements that much the same sets have, so that two sets
    meet once and not for each element that both have; and block, of `blocks` of BLOCK sets of the key on average.

    An element goes to the most frequent one that stands in a set with it. If that gathers more than twice as many sets as
    this one has, its elements stay by themselves. A set has its smallest place under a key.
    """
    counted = spill(first.join(first.groupBy("e").agg(F.count("*").alias("k")), "e"), "counted-prefixes")
    top = counted.groupBy("doc_id").agg(F.max(F.struct("k", "e")).alias("top"))
    at = spill(counted.select("e", "doc_id").join(top, "doc_id").groupBy("e").agg(F.max("top").alias("top")).select("e", F.col("top.e").alias("key"), F.col("top.k").alias("k")), "keys")
    sizes = first.select("e", "doc_id").join(at, "e").groupBy("key", "k").agg(F.count_distinct("doc_id").alias("many"))
    at = at.join(sizes.filter("many <= 2 * k").select("key", F.lit(True).alias("good")), "key", "left").select("e", F.when(F.col("good"), F.col("key")).otherwise(F.col("e")).alias("key"))
    merged = spill(first.join(at, "e").groupBy(F.col("key").alias("e"), "doc_id", "n", "root").agg(F.min("place").alias("place")), "merged-prefixes")
    blocks = merged.groupBy("e").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return merged.join(blocks, "e").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))


def jaccard_components(docs: DataFrame, bloom_bits: int = 25, common_most: int = 1 << 17) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to).

    Null and empty texts have no shingles and link with nothing, equal ones included. Rows that repeat a doc_id are one
    node of the graph. A null doc_id takes part only through equal sets: it gets their component, or null. Other columns
    are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = texts(docs)
    ids = spill(source.mapInArrow(_set_keys, "doc_id long, n_shingles long, k1 long, k2 long, parity binary, need long"), "set-keys")
    classes = spill(ids.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("parity").alias("parity"), F.first("need").alias("need")), "classes")
    stars = spill(source.filter("doc_id is not null").mapInArrow(_emit, "r long, b long").repartition("r").sortWithinPartitions("r", "b").mapInArrow(_reduce, "a long, b long, g long, wide boolean"), "stars")
    side = lambda k: classes.filter("rep is not null").select(F.col("k1").alias(k), F.col("rep").alias(f"r{k}"), F.col("n").alias(f"n{k}"))
    found = spill(stars.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b"), "candidates")
    fits = f"ra <> rb and least(na, nb) * {DEN} >= greatest(na, nb) * {NUM}"

    def sift(pairs: DataFrame) -> DataFrame:
        known = lambda k: classes.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}"))
        both = pairs.join(known("a"), "a").join(known("b"), "b").select("a", "b", "na", "pa", "nb", "pb")
        return both.mapInArrow(_sift, "a long, b long").distinct()

    edges = spill(sift(found.filter(fits).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()), "pairs")

    def bits(frame: DataFrame):
        return spark.sparkContext.broadcast(Bloom.of(frame, "doc_id", bloom_bits))

    def verified(candidates: DataFrame, bloom) -> DataFrame:
        chosen = source.select("doc_id", "text", _slot(bloom_bits)).mapInArrow(partial(_chosen_sets, bloom=bloom), "doc_id long, elements binary")
        at = lambda k: chosen.select(F.col("doc_id").alias(k), F.col("elements").alias(f"e{k}"))
        both = candidates.join(at("a"), "a").join(at("b"), "b").select("a", "b", "ea", "eb")
        return spill(both.mapInArrow(_verify, "a long, b long").distinct(), "links")

    links = verified(edges, bits(edges.select(F.col("a").alias("doc_id")).union(edges.select("b")).distinct()))
    linked = components(links)
    root = lambda k: linked.select(F.col("node").alias(f"r{k}"), F.col("root").alias(f"root_{k}"))
    rooted = spill(found.join(root("a"), "ra", "left").join(root("b"), "rb", "left").select("a", "b", "ra", "rb", "na", "nb", F.coalesce("root_a", "ra").alias("root_a"), F.coalesce("root_b", "rb").alias("root_b")), "rooted")
    groups = stars.filter("g is not null and a <> b").join(rooted, ["a", "b"])
    torn = spill(groups.groupBy("g").agg(F.min(F.least("root_a", "root_b")).alias("lo"), F.max(F.greatest("root_a", "root_b")).alias("hi"), F.bool_or("wide").alias("wide_group")).filter("lo <> hi").select("g", "wide_group"), "torn")
    groups = groups.join(torn, "g")
    wide = groups.filter("wide_group")
    touched = wide.select(F.col("root_a").alias("root"), "g").union(wide.select("root_b", "g")).groupBy("root").agg(F.count_distinct("g").alias("touched"))
    few = groups.filter("not wide_group")
    member = few.select("g", F.col("ra").alias("doc_id"), F.col("na").alias("n"), F.col("root_a").alias("root")).union(few.select("g", "rb", "nb", "root_b")).distinct()
    mate = member.select("g", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    close = f"doc_id < b and root <> rb and least(n, nb) * {DEN} >= greatest(n, nb) * {NUM}"
    few_pairs = spill(member.join(mate, "g").filter(close).select(F.col("doc_id").alias("a"), "b").distinct(), "few-pairs")
    nodes = rooted.select(F.col("ra").alias("node"), F.col("root_a").alias("root")).union(rooted.select("rb", "root_b")).distinct()
    least = nodes.join(classes.select(F.col("rep").alias("node"), "need"), "node").groupBy("root").agg(F.min("need").alias("need"))
    open_roots = touched.join(least, "root").filter("touched >= need").select("root")
    rest = nodes.join(open_roots, "root", "left_semi").select(F.col("node").alias("doc_id")).union(found.filter("a = b").select("ra")).distinct()
    rest = spill(rest, "rest")
    discard(stars)
    more, checked = few_pairs, edges
    if rest.head(1):
        bloom = bits(rest)
        chosen = source.select("doc_id", "text", _slot(bloom_bits))
        kind = "e long, doc_id long, n long, place long"
        seen = spill(chosen.mapInArrow(partial(_frequent, bloom=bloom), "e long, m long, doc_id long"), "minima")
        minima = seen.filter("doc_id is not null").join(rest, "doc_id", "left_semi")
        sizes = classes.filter("rep is not null").groupBy(F.col("rep").alias("doc_id")).agg(F.min("n").alias("n"))
        links, linked, checked = _gather(minima, sizes, links, linked, checked, sift, verified, bits)
        often = seen.filter("doc_id is null").groupBy("e").agg(F.sum("m").alias("m"))
        top = often.orderBy(F.desc("m"), "e").limit(common_most).toArrow()["e"].to_numpy().view(_U)
        common = spark.sparkContext.broadcast(np.sort(top))
        first = chosen.mapInArrow(partial(_prefixes, bloom=bloom, common=common), kind)
        first = first.join(linked.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select("e", "doc_id", "n", "place", F.coalesce("root", "doc_id").alias("root"))
        first = spill(first.join(rest, "doc_id", "left_semi").distinct(), "prefixes")
        open_ = first.groupBy("e").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("e")
        first = _merged(spill(first.join(open_, "e", "left_semi"), "open-prefixes"))
        folded = classes.filter("rep is not null").groupBy(F.col("rep").alias("doc_id")).agg(F.first("parity").alias("parity"), F.count("*").alias("many"))
        folded = folded.join(rest, "doc_id", "left_semi").mapInArrow(_folded, "doc_id long, " + ", ".join(f"p{k} long" for k in range(16)))
        first = first.join(folded, "doc_id")
        # A key of many sets is cut into blocks, and each two blocks meet by themselves.
        other = first.select("e", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("root").alias("rb"), *[F.col(f"p{k}").alias(f"q{k}") for k in range(16)])
        first = first.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1)))
        # If this key has the first element that both have, no more than the elements from it on can be shared; and parities differ
        # in no more places than the sets.
        differ = " + ".join(f"bit_count(p{k} ^ q{k})" for k in range(16))
        can = f"(i < j or doc_id < b) and root <> rb and {FITS} and least(n - place, nb - pb) * {DEN + NUM} >= {NUM} * (n + nb) and coalesce(({differ}) * {DEN + NUM} <= (n + nb) * {DEN - NUM}, true)"
        roots = lambda k: linked.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
        more = more.join(roots("a"), "a", "left").join(roots("b"), "b", "left").filter("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
        more = more.join(checked, ["a", "b"], "left_anti").union(first.join(other, ["e", "i", "j"]).filter(can).select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")))
    more = spill(sift(more.distinct()).join(checked, ["a", "b"], "left_anti"), "more-pairs")
    if more.head(1):
        links = links.union(verified(more, bits(more.select(F.col("a").alias("doc_id")).union(more.select("b")).distinct())))
        linked = components(links)
    known = classes.select("k1", "k2", "rep").join(linked.select(F.col("node").alias("rep"), "root"), "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("root"))
    # One class may be a third of all rows: its partition is split by the skew join.
    out = ids.join(known, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("root"))
    return out.select("doc_id", "n_shingles", F.col("root").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] ELSE range(1, greatest(len(ws) - 3, 2)) END) AS i FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.seen)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(c.seen) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.node = w.doc_id GROUP BY ALL
"""
