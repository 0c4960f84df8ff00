"""Stateful processes: each has a state with one step a record, run over a batch as a fold and over a stream with keyed state.

Time is that of the records (`ts`, seconds), never the clock's. A state says by due() when it wants to be woken: in a batch it is
woken before the first record at or after that time, in a stream by a timer that fires when the watermark gets there, with or
without a record of its own. So a stream that stands still forgets nothing, and one that ends (availableNow) does end.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.folds import _columns, ordered_fold


class Process:
    """What fold() and stream() need of a state. `schema` is of the output, whose first column is the key; `kept` of the state."""

    schema = kept = ""

    def step(self, row) -> list:
        raise NotImplementedError

    def due(self) -> float | None:
        """When to be woken; None: not at all."""
        return None

    def wake(self) -> list:
        """What to do at due(); afterwards due() must be later or None."""
        return []

    def dump(self) -> tuple | None:
        """The state as a row of `kept`; None if it is as at the start, and can be dropped."""
        raise NotImplementedError

    def load(self, values: tuple) -> None:
        raise NotImplementedError


class RateLimit(Process):
    """At most `most` accepted calls in `seconds`; calls that are turned away aren't logged."""

    schema, kept = "client long, ts double, accepted boolean", "log array<double>"

    def __init__(self, key, most: int = 5, seconds: float = 60.0):
        self.key, self.most, self.seconds, self.log = key, most, seconds, []

    def step(self, row) -> list:
        self.log = [t for t in self.log if row.ts - t < self.seconds]
        ok = len(self.log) < self.most
        if ok:
            self.log.append(row.ts)
        return [(*self.key, row.ts, ok)]

    def due(self) -> float | None:
        return max(self.log) + self.seconds if self.log else None

    def wake(self) -> list:
        self.log = []
        return []

    def dump(self) -> tuple | None:
        return (self.log,) if self.log else None

    def load(self, values: tuple) -> None:
        self.log = list(values[0])


class AnswerCache(Process):
    """A key is a hit for `seconds` after the miss that stored it; a hit doesn't prolong it."""

    schema, kept = "cache_key string, ts double, hit boolean", "stored double"

    def __init__(self, key, seconds: float = 86400.0):
        self.key, self.seconds, self.stored = key, seconds, None

    def step(self, row) -> list:
        hit = self.stored is not None and row.ts - self.stored < self.seconds
        if not hit:
            self.stored = row.ts
        return [(*self.key, row.ts, hit)]

    def due(self) -> float | None:
        return None if self.stored is None else self.stored + self.seconds

    def wake(self) -> list:
        self.stored = None
        return []

    def dump(self) -> tuple | None:
        return None if self.stored is None else (self.stored,)

    def load(self, values: tuple) -> None:
        (self.stored,) = values


class SessionFilters(Process):
    """Filters stay with a session for `seconds` since they were last used; a message with any filter replaces them all."""

    schema, kept = "session long, ts double, filters string", "filters string, at double"

    def __init__(self, key, seconds: float = 1800.0):
        self.key, self.seconds, self.filters, self.at = key, seconds, None, None

    def step(self, row) -> list:
        if self.at is not None and row.ts - self.at >= self.seconds:
            self.filters = None
        if isinstance(row.filters, str) and row.filters:
            self.filters = row.filters
        self.at = row.ts
        return [(*self.key, row.ts, self.filters)]

    def due(self) -> float | None:
        return None if self.at is None else self.at + self.seconds

    def wake(self) -> list:
        self.filters = self.at = None
        return []

    def dump(self) -> tuple | None:
        return None if self.at is None else (self.filters, self.at)

    def load(self, values: tuple) -> None:
        self.filters, self.at = values


class ChangeTrigger(Process):
    """repo, ts, cause of each firing: at once at a new commit; for other changes when `seconds` have gone by since it last
    fired, which is at once (`change`) or later, by a timer that needs no record (`timer`)."""

    schema, kept = "repo long, ts double, cause string", "last double, commit string, active boolean"

    def __init__(self, key, seconds: float = 900.0):
        self.key, self.seconds, self.last, self.commit, self.active = key, seconds, None, None, False

    def _fire(self, ts: float, cause: str) -> list:
        self.last, self.active = ts, False
        return [(*self.key, ts, cause)]

    def step(self, row) -> list:
        if isinstance(row.commit, str) and row.commit != self.commit:
            self.commit = row.commit
            return self._fire(row.ts, "commit")
        if row.changed and (self.last is None or row.ts - self.last >= self.seconds):
            return self._fire(row.ts, "change")
        self.active = self.active or bool(row.changed)
        return []

    def due(self) -> float | None:
        return self.last + self.seconds if self.active else None

    def wake(self) -> list:
        return self._fire(self.last + self.seconds, "timer")

    def dump(self) -> tuple | None:
        return None if self.last is None else (self.last, self.commit, self.active)

    def load(self, values: tuple) -> None:
        self.last, self.commit, self.active = values


def _woken(state: Process, now: float | None) -> list:
    """Wakes a state for all that is due up to `now` (None: for ever)."""
    out = []
    while (at := state.due()) is not None and (now is None or at <= now):
        out += state.wake()
    return out


class _Timed:
    """A process as ordered_fold wants it: records wake it first, and after the last record nothing stays due."""

    def __init__(self, state: Process):
        self.state = state

    def step(self, row) -> list:
        return _woken(self.state, row.ts) + self.state.step(row)

    def end(self) -> list:
        return _woken(self.state, None)


def _names(schema: str) -> list[str]:
    return [c.strip().split()[0] for c in _columns(schema)]


def fold(rows: DataFrame, state: type[Process], order: list[str] | None = None, **options) -> DataFrame:
    """What the process gives for rows, which have its key, ts and what its step reads."""
    return ordered_fold(rows, _names(state.schema)[:1], order or ["ts"], lambda k: _Timed(state(k, **options)), state.schema)


#: Spark's watermark begins at 1970 and passes over what isn't later; this many seconds are added to times on the way in.
_SHIFT = 1e9


def stream(rows: DataFrame, state: type[Process], order: list[str] | None = None, late: str = "1 second", **options) -> DataFrame:
    """The same over a stream, with the state of each key in the state store as typed columns.

    Records of a batch are taken in order; records that come later than the watermark (the largest ts so far less `late`) are
    left out, as with every stateful operator. A timer stands in the store for each state that is due at some time; when
    the watermark passes it the state is woken, and dropped if nothing is left of it, so what is kept grows with
    the keys of that time, not with all keys ever seen. Results are the fold's, if no record overtakes another of its key by
    batches and none is too late; what is due after the last watermark isn't given yet.
    """
    key, names = _names(state.schema)[0], _names(state.schema)

    def run(k, frames, store):
        now = state(k, **options)
        if store.exists:
            now.load(tuple(store.get))
        mark = store.getCurrentWatermarkMs() / 1000 - _SHIFT
        out = _woken(now, mark)
        if not store.hasTimedOut:
            for row in pd.concat(list(frames)).sort_values(order or ["ts"], kind="stable").itertuples(index=False):
                out += _woken(now, row.ts) + now.step(row)
            out += _woken(now, mark)
        left = now.dump()
        if left is None:
            if store.exists:
                store.remove()
        else:
            store.update(left)
            if now.due() is not None:
                store.setTimeoutTimestamp(max(math.ceil((now.due() + _SHIFT) * 1000), store.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    at = rows.withColumn("_event", F.timestamp_seconds(F.col("ts") + _SHIFT)).withWatermark("_event", late)
    return at.groupBy(key).applyInPandasWithState(run, state.schema, state.kept, "append", "EventTimeTimeout")


def debounce(rows: DataFrame, by: list[str], gap: str = "5 seconds", ts: str = "ts") -> DataFrame:
    """by, first_ts, fire_ts, n: one event for changes that follow each other within the gap, when it has been quiet so long.

    Works on streams with a watermark too.
    """
    w = rows.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(*by, F.col("w.start").alias("first_ts"), F.col("w.end").alias("fire_ts"), "n")


def windowed_counts(rows: DataFrame, by: list[str], width: str, slide: str | None = None, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Counts in tumbling or sliding windows; on a stream, rows later than `late` are left out."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    src = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return src.groupBy(*by, w.alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def last_messages(rows: DataFrame, by: str, order: list[str], n: int = 6) -> DataFrame:
    """The last n messages of each conversation, recency 1 being the newest."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)


def job_table(updates: DataFrame, by: str = "job_id", ts: str = "ts", state: str = "state") -> DataFrame:
    """by, state, ts of each job's last update."""
    return updates.groupBy(by).agg(F.max_by(state, ts).alias(state), F.max(ts).alias(ts))


#: What a job may become from each state (null: it is new).
NEXT_STATES = {None: ["queued"], "queued": ["processing", "failed"], "processing": ["completed", "failed"], "completed": [], "failed": ["queued"]}


def illegal_transitions(updates: DataFrame, by: str = "job_id", ts: str = "ts", state: str = "state", allowed: dict | None = None) -> DataFrame:
    """by, ts, before, state of updates that don't follow from the state before; the same state again is no transition."""
    before = F.lag(state).over(Window.partitionBy(by).orderBy(ts))
    u = updates.select(by, ts, before.alias("before"), state).filter(~F.col(state).eqNullSafe(F.col("before")))
    legal = F.lit(False)
    for old, new in (NEXT_STATES if allowed is None else allowed).items():
        same = F.col("before").isNull() if old is None else F.col("before").eqNullSafe(F.lit(old))
        legal = legal | (same & F.col(state).isin(new)) if new else legal
    return u.filter(~F.coalesce(legal, F.lit(False)))


def write_jobs(updates: DataFrame, path: str, checkpoint: str, keep: int = 2):
    """A streaming query that keeps the table of jobs at path up to date, a version a batch; job_versions() reads the last.

    The last `keep` versions stay, so that who reads one while the next is written isn't disturbed.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = job_versions(spark, path)
        rows = batch.select("job_id", "state", "ts")
        job_table(rows if old is None else old.unionByName(rows)).write.mode("overwrite").parquet(f"{path}/v={epoch}")
        fs, done = _versions(spark, path)
        for v in done[:-keep]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}"), True)

    return updates.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark, path: str):
    """The file system of path, and the complete versions below it, oldest first."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return fs, sorted(int(n[2:]) for n in found if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def job_versions(spark, path: str) -> DataFrame | None:
    done = _versions(spark, path)[1]
    return spark.read.parquet(f"{path}/v={done[-1]}").select("job_id", "state", "ts") if done else None


def seen_before(rows: DataFrame, by: str, order: str, new_topic: str, shown: str) -> DataFrame:
    """Adds `seen`: what earlier rows of the topic have shown (arrays), in order; a row with new_topic begins a topic."""
    w = Window.partitionBy(by).orderBy(order)
    topic = rows.withColumn("_topic", F.sum(F.col(new_topic).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy(by, "_topic").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return topic.withColumn("seen", F.array_distinct(F.flatten(F.collect_list(shown).over(earlier)))).drop("_topic")


def reassemble(chunks: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """The text that a stream of pieces adds up to."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return chunks.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x[text]), "").alias("text"))
