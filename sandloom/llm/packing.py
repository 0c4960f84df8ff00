"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens. A full piece is a sequence by itself. The others are dealt by a hash
of their row into shards of some thousands of pieces, and several islands, each a task of its own, evolve packings of a
shard, from populations that best-fit the pieces in random orders. A chromosome is a list of bins: crossover injects whole
well-filled bins of one parent into the other, drops the bins that hold an injected piece as well, and best-fits the pieces
so displaced. After each epoch an island's elite moves on to the next island of the ring; no bound is looked at before two
epochs are over. Then a shard whose best packing meets the lower bound ceil(tokens / capacity) is done.

A shard keeps its fullest sequences. Its `loose_bins` emptiest ones are opened again, and the pieces of all shards' opened
sequences are dealt and evolved anew, until one shard is left: so no partly filled sequence stays behind in every shard.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import parts, spill, table, texts
from ._tokens import ByteLevel, loaded

CAPACITY = 2048


def best_fit(order, sizes, bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put each piece, in this order, into the bin with the least room that still holds it; changes bins and room."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, r in enumerate(room):
        stacks[r].append(b)
        mask |= 1 << r
    for i in order:
        s = sizes[i]
        if fits := mask >> s:
            r = s + ((fits & -fits).bit_length() - 1)
            b = stacks[r].pop()
            if not stacks[r]:
                mask &= ~(1 << r)
            bins[b].append(i)
        else:
            b, r = len(bins), capacity
            bins.append([i])
            room.append(capacity)
        room[b] = r - s
        stacks[r - s].append(b)
        mask |= 1 << (r - s)


def fitness(bins, room, capacity: int) -> tuple:
    """Fewer bins first, then the mean squared fill: full bins beside empty ones beat even ones."""
    return (-len(bins), sum(((capacity - r) / capacity) ** 2 for r in room))


def pack(order, sizes, capacity: int):
    bins, room = [], []
    best_fit(order, sizes, bins, room, capacity)
    return bins, room


def crossover(a, b, sizes, capacity: int, rng: random.Random):
    """Bins of b that are well filled (less than half the average room left) go into a whole, half of them by chance; what
    they displace, and what lies in a's worse filled bins, is best-fitted."""
    (bins_a, room_a), (bins_b, room_b) = a, b
    well_a, well_b = (sum(room) / max(1, len(room)) / 2 for room in (room_a, room_b))
    chosen = [k for k, r in enumerate(room_b) if r <= well_b and rng.random() < 0.5]
    taken = {i for k in chosen for i in bins_b[k]}
    bins, room = [bins_b[k][:] for k in chosen], [room_b[k] for k in chosen]
    displaced = []
    for x, r in zip(bins_a, room_a, strict=True):
        if r <= well_a and taken.isdisjoint(x):
            bins.append(x[:])
            room.append(r)
        else:
            displaced += [i for i in x if i not in taken]
    best_fit(sorted(displaced, key=lambda i: (-sizes[i], i)), sizes, bins, room, capacity)
    return bins, room


def mutate(a, sizes, capacity: int, rng: random.Random):
    """Empty a few of the least-filled bins and as many others, and best-fit their pieces in a shuffled order."""
    bins, room = a
    worst = sorted(range(len(bins)), key=lambda k: -room[k])[: 2 + len(bins) // 50]
    out = set(worst) | {rng.randrange(len(bins)) for _ in worst}
    loose = [i for k in out for i in bins[k]]
    rng.shuffle(loose)
    loose.sort(key=lambda i: -(sizes[i] // 64))
    rest = [(x[:], r) for k, (x, r) in enumerate(zip(bins, room, strict=True)) if k not in out]
    new, left = [x for x, _ in rest], [r for _, r in rest]
    best_fit(loose, sizes, new, left, capacity)
    return new, left


def evolve(sizes: list[int], capacity: int, seeds: list[list[int]], rng_seed: int, population: int = 4, generations: int = 4, bound: bool = False):
    """(bin of each piece, number of bins, crossovers made) of the best packing found.

    seeds: packings that came from other islands or epochs; the rest of the population best-fits the pieces in random
    orders. With `bound`, a population that meets the lower bound is left as it is.
    """
    rng, n, crossed = random.Random(rng_seed), len(sizes), 0
    least = -(-sum(sizes) // capacity)
    people = []
    for s in seeds:
        k = max(s) + 1
        bins, room = [[] for _ in range(k)], [capacity] * k
        for i, b in enumerate(s):
            bins[b].append(i)
            room[b] -= sizes[i]
        people.append((bins, room))
    while len(people) < population:
        order = list(range(n))
        rng.shuffle(order)
        people.append(pack(order, sizes, capacity))
    key = lambda p: fitness(*p, capacity)
    for _ in range(generations):
        people.sort(key=key, reverse=True)
        if bound and len(people[0][0]) <= least:
            break
        a, b = people[0], people[1 + rng.randrange(len(people) - 1)]
        children = [crossover(a, b, sizes, capacity, rng), crossover(b, a, sizes, capacity, rng), mutate(a, sizes, capacity, rng)]
        crossed += 2
        people = sorted(people + children, key=key, reverse=True)[:population]
    best = max(people, key=key)
    where = [0] * n
    for b, x in enumerate(best[0]):
        for i in x:
            where[i] = b
    return where, len(best[0]), crossed


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents longer than capacity are cut, only the first piece being shorter."""

    def cut(batches):
        import pyarrow as pa

        enc = loaded(ByteLevel, tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b, texts_ in parts(batches):
            rows = []
            for key, ids in zip(b.column(0).to_pylist(), (enc.encode([t.decode()]) for t in texts_), strict=True):
                raw = memoryview(ids[0] + end)
                n = len(raw) // 4
                count = -(-n // capacity)
                first = n - capacity * (count - 1)
                for k in range(count):
                    start = 0 if k == 0 else first + capacity * (k - 1)
                    length = first if k == 0 else capacity
                    rows.append((key, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, shard_pieces: int = 20_000, islands: int = 2, epochs: int = 4, loose_bins: int = 8) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is one piece of the end id alone; rows with a repeated or null doc_id are pieces of their own, dealt like
    any others. Other columns are not looked at, whatever their names. An empty table gives an empty result.
    """
    cut = spill(pieces(docs, tokenizer, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = cut.filter(F.col("length") == capacity).select(*names, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose, level = cut.filter(F.col("length") < capacity), 0
    while True:
        n = loose.count()
        n_shards = max(1, -(-n // shard_pieces))
        dealt = loose.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(n_shards)).cast("int"))
        best = _islands(dealt, n_shards, capacity, islands, epochs, level)
        placed = _placed(dealt, best, n_shards, names, level, loose_bins if n_shards > 1 else 0)
        if n_shards == 1:
            return out.unionByName(placed.drop("uid", "open"))
        placed = spill(placed, "placed")
        out = out.unionByName(placed.filter("not open").drop("uid", "open"))
        loose, last = placed.filter("open").select(*names, "uid"), n
        if loose.count() * 2 > last:  # shards so small that opening sequences gets nowhere: deal everything to fewer, larger ones
            shard_pieces *= 4
        level += 1


def _islands(dealt: DataFrame, n_shards: int, capacity: int, islands: int, epochs: int, level: int) -> DataFrame:
    """shard, packing: the best packing of each shard's pieces in the order of their uid."""
    cells = dealt.select("shard", "uid", F.col("length").cast("int").alias("length"), F.explode(F.array(*[F.lit(k) for k in range(islands)])).alias("island"))
    # A stated number of partitions is left alone by the coalescing, which would run many islands in one task.
    tasks = min(n_shards * islands, 20_000)
    cells = cells.repartition(tasks, "shard", "island")
    state_type = "shard int, island int, bins int, least int, crossed int, packing array<int>"
    state = None
    for epoch in range(epochs):

        def island(key, items, elites=None, epoch=epoch):
            import pandas as pd

            if not len(items):
                return pd.DataFrame({"shard": [], "island": [], "bins": [], "least": [], "crossed": [], "packing": []})
            sizes = items.sort_values("uid")["length"].tolist()
            seeds = [p.tolist() for p in elites["packing"]] if elites is not None else []
            seed = (level * 1_000_003 + int(key[0])) * 1009 + int(key[1]) * 31 + epoch
            where, n, crossed = evolve(sizes, capacity, seeds, seed, bound=epoch > 1)
            return pd.DataFrame({"shard": [key[0]], "island": [key[1]], "bins": [n], "least": [-(-sum(sizes) // capacity)], "crossed": [crossed], "packing": [where]})

        groups = cells.groupBy("shard", "island")
        if state is None:
            state = groups.applyInPandas(lambda key, items: island(key, items), state_type)
        else:
            # an island's own elite stays, and goes on to the next one
            moved = state.select("shard", F.explode(F.array("island", (F.col("island") + 1) % islands)).alias("island"), "bins", "packing").distinct()
            moved = moved.repartition(tasks, "shard", "island")
            state = groups.cogroup(moved.groupBy("shard", "island")).applyInPandas(lambda key, items, elites: island(key, items, elites), state_type)
        state = spill(state, "islands")
        if epoch and not state.groupBy("shard").agg(F.min(F.col("bins") - F.col("least")).alias("over")).filter("over > 0").head(1):
            break
    return state.groupBy("shard").agg(F.min_by("packing", F.struct("bins", "island")).alias("packing"))


def _placed(dealt: DataFrame, best: DataFrame, n_shards: int, names: list[str], level: int, loose_bins: int) -> DataFrame:
    """names..., uid, sequence_id, offset, and whether the sequence is one of its shard's loose_bins emptiest."""

    def place(key, items, chosen):
        items = items.sort_values("uid").reset_index(drop=True)
        where = np.asarray(chosen["packing"].iloc[0], dtype=np.int64)
        fill = np.bincount(where, items["length"].to_numpy())
        open_ = np.zeros(len(fill), dtype=bool)
        open_[np.argsort(fill, kind="stable")[:loose_bins]] = True
        items["bin"] = where
        items = items.sort_values(["bin", "uid"], kind="stable")
        items["offset"] = items.groupby("bin")["length"].cumsum() - items["length"]
        items["sequence_id"] = (np.int64(level) << np.int64(56)) + (np.int64(key[0]) << np.int64(24)) + items["bin"]
        items["open"] = open_[items["bin"].to_numpy()]
        return items[[*names, "uid", "sequence_id", "offset", "open"]]

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long, sequence_id long, offset long, open boolean"
    tasks = min(n_shards, 20_000)
    rows = dealt.select(*names, "uid", "shard").repartition(tasks, "shard")
    return rows.groupBy("shard").cogroup(best.repartition(tasks, "shard").groupBy("shard")).applyInPandas(place, kind)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
