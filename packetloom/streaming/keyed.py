"""Keyed state with event-time timers: window sketches, rolling itemsets and bounded decayed scores over streams.

Tasks first reduce their rows to small mergeable parts; parts meet in Spark's store by key, and a timer gives the
result and drops the state when the watermark passes. State survives restarts with its query's checkpoint.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import sketches
from ..operators.sketches import F2_WORDS, PHI, f2_salt

# Spark checks a processor in a process beside the driver, which knows nothing of files sent to executors: it gets the code itself.
for _module in (sys.modules[__name__], sketches):
    cloudpickle.register_pickle_by_value(_module)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UTC = pa.timestamp("us", tz="UTC")


def keep_state_in_rocksdb(spark: SparkSession) -> SparkSession:
    """Keyed state with timers needs this store; queries that began with another keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")  # all stores of an executor share a bounded cache
    return spark


def closing(df: DataFrame, last: Column, watermark_s: int) -> DataFrame:
    """``df`` with the moment after which a row matters to no open window.

    The watermark follows the events themselves; a row is late only when ``last`` is behind it, as in Spark's own windows.
    """
    return df.withColumn("closes", last.alias("closes", metadata={"spark.watermarkDelayMs": watermark_s * 1000}))


def text_of(seconds: float) -> str:
    return pd.Timestamp(seconds, unit="s").strftime("%Y-%m-%d %H:%M:%S")


# ------------------------------------------------------------------ sketches by window
def salted(item: str, salt: int) -> int:
    """As ``sketches.salted_hash``, unsigned."""
    return int.from_bytes(hashlib.sha256(f"{salt}:{item}".encode()).digest()[:8], "little")


class Sketch:
    """Flajolet-Martin bitmaps and the +-1 sums of the second moment of one item column; parts merge exactly."""

    def __init__(self, hashes: int, seed: int):
        self.hashes, self.seed = hashes, seed
        self.bitmaps = np.zeros(hashes, np.uint64)
        self.sums = np.zeros(64 * F2_WORDS, np.int64)

    def add(self, item: str, times: int) -> None:
        for i in range(self.hashes):
            x = salted(item, self.seed * 10000 + i)
            self.bitmaps[i] |= np.uint64(1 << (min((x & -x).bit_length() - 1, 63) if x else 63))
        bits = np.concatenate([np.unpackbits(np.array([salted(item, f2_salt(self.seed, w))], "<u8").view(np.uint8), bitorder="little") for w in range(F2_WORDS)])
        self.sums += times * (1 - 2 * bits.astype(np.int64))

    def merge(self, bitmaps: np.ndarray, sums: np.ndarray) -> None:
        self.bitmaps |= bitmaps
        self.sums += sums

    def distinct(self, groups: int) -> float:
        first = [((~int(b) & (1 << 64) - 1) & -(~int(b) & (1 << 64) - 1)).bit_length() - 1 if int(b) != (1 << 64) - 1 else 64 for b in self.bitmaps]
        size = self.hashes // groups
        return float(np.median([2.0 ** (sum(first[g * size : (g + 1) * size]) / size) / PHI for g in range(groups)]))

    def f2(self, groups: int) -> float:
        return float(np.median((self.sums.astype(float) ** 2).reshape(groups, -1).mean(axis=1)))


PARTS = "w timestamp, n long, " + ", ".join(f"{s}_{k} binary" for s in ("src", "dst") for k in ("fm", "f2"))
SKETCHED = "window_start string, window_len_s int, packets long, src_ips_fm double, dst_ips_fm double, src_f2 double, dst_f2 double"


def sketch_parts(df: DataFrame, length_s: int, hashes: int, seed: int) -> DataFrame:
    """One row a window and task: the sketches of its packets. An item is hashed once a batch of rows, however often it comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[list[int], Sketch, Sketch]] = {}
        for b in batches:
            p = pd.DataFrame({"w": b.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False) // (length_s * 10**6), "src": b.column(1).to_pandas(), "dst": b.column(2).to_pandas()})
            for w, n in p.groupby("w").size().items():
                made.setdefault(w, ([0], Sketch(hashes, seed), Sketch(hashes, seed + 1)))[0][0] += int(n)
            for side, at in (("src", 1), ("dst", 2)):
                for (w, item), n in p.groupby(["w", side]).size().items():
                    made[w][at].add(item, int(n))
        cols = [pa.array([w * length_s * 10**6 for w in made], pa.int64()).cast(UTC), pa.array([x[0][0] for x in made.values()], pa.int64())]
        cols += [pa.array([v.tobytes() for v in values], pa.binary()) for at in (1, 2) for values in ([x[at].bitmaps for x in made.values()], [x[at].sums for x in made.values()])]
        yield pa.RecordBatch.from_arrays(cols, ["w", "n", "src_fm", "src_f2", "dst_fm", "dst_f2"])

    return df.filter("event_time is not null").select("event_time", "src_ip", "dst_ip").mapInArrow(run, PARTS)


class WindowSketches(StatefulProcessor):
    """Merges the parts of a window and gives its estimates when the watermark passes its end."""

    def __init__(self, length_s: int, hashes: int, groups: int, f2_groups: int, seed: int):
        self.length_s, self.hashes, self.groups, self.f2_groups, self.seed = length_s, hashes, groups, f2_groups, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sketch", PARTS.replace("w timestamp, ", ""))

    def held(self) -> tuple[int, Sketch, Sketch]:
        src, dst = Sketch(self.hashes, self.seed), Sketch(self.hashes, self.seed + 1)
        if not self.state.exists():
            return 0, src, dst
        n, *parts = self.state.get()
        self.take(src, dst, *parts)
        return n, src, dst

    @staticmethod
    def take(src: Sketch, dst: Sketch, src_fm: bytes, src_f2: bytes, dst_fm: bytes, dst_f2: bytes) -> None:
        src.merge(np.frombuffer(src_fm, np.uint64), np.frombuffer(src_f2, np.int64))
        dst.merge(np.frombuffer(dst_fm, np.uint64), np.frombuffer(dst_f2, np.int64))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, src, dst = self.held()
        for p in rows:
            for r in p[["n", "src_fm", "src_f2", "dst_fm", "dst_f2"]].itertuples(index=False):
                n += int(r[0])
                self.take(src, dst, *r[1:])
        self.state.update((n, src.bitmaps.tobytes(), src.sums.tobytes(), dst.bitmaps.tobytes(), dst.sums.tobytes()))
        self.handle.registerTimer((int(key[0].timestamp()) + self.length_s) * 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, src, dst = self.held()
        self.state.clear()
        row = (text_of(key[0].timestamp()), self.length_s, n, *(round(x.distinct(self.groups), 6) for x in (src, dst)), *(round(x.f2(self.f2_groups), 6) for x in (src, dst)))
        yield pd.DataFrame([row], columns=[c.split()[0] for c in SKETCHED.split(", ")])

    def close(self) -> None: ...


def stream_sketches(df: DataFrame, length_s: int = 10, watermark_s: int = 30, hashes: int = 30, groups: int = 5, f2_groups: int = 8, seed: int = 42) -> DataFrame:
    """Stream, append mode: the rows of ``sketches.window_sketches``, each when its window is closed.

    A task sends one part a window, whatever its rows; a window's state is 4 KB and gone when the row is out.
    """
    keep_state_in_rocksdb(df.sparkSession)
    parts = sketch_parts(df.withWatermark("event_time", f"{watermark_s} seconds"), length_s, hashes, seed)
    parts = closing(parts, F.col("w") + F.make_dt_interval(secs=F.lit(length_s - 0.001)), watermark_s)
    return parts.groupBy("w").transformWithStateInPandas(WindowSketches(length_s, hashes, groups, f2_groups, seed), SKETCHED, "append", "EventTime")


# ------------------------------------------------------------------ rolling itemsets
ITEMS = "shard int, src_ip string, slice long, item string"
#: Cells that the sources of a shard are dealt over; a worker holds the baskets of one cell at a time.
CELLS = 128
COUNTED = "window_start string, itemset string, size int, c long"


def basket_parts(df: DataFrame, slice_s: int, shards: int, cells: int = CELLS) -> DataFrame:
    """Distinct (source, slice, item) of each batch of rows of a task, with the cell of the source: ``cells`` to a shard."""
    item = F.concat_ws(":", F.coalesce("protocol", F.lit("UNKNOWN")), F.col("dst_port").cast("string"))
    at = (F.floor(F.unix_seconds("event_time") / slice_s) * slice_s).cast("long")
    d = df.filter("src_ip is not null and event_time is not null").select(F.pmod(F.xxhash64("src_ip"), F.lit(shards * cells)).cast("int").alias("shard"), "src_ip", at.alias("slice"), item.alias("item"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pandas(b.to_pandas().drop_duplicates(), schema=b.schema, preserve_index=False)

    return d.mapInArrow(run, ITEMS)


class Rolling:
    """Baskets of the open windows and the counts of one of them, kept up by what enters and what leaves."""

    def __init__(self, window_s: int, slide_s: int, text: str | None = None):
        self.window_s, self.slide_s = window_s, slide_s
        self.end: int | None = None
        self.baskets: dict[int, dict[str, set[str]]] = {}
        self.counts: dict[tuple[str, ...], int] = defaultdict(int)
        self.n = 0
        if text:
            self.end, self.n, counts, baskets = json.loads(text)
            self.counts.update((tuple(k), c) for k, c in counts)
            self.baskets = {int(t): {s: set(i) for s, i in b.items()} for t, b in baskets.items()}

    def dump(self) -> str:
        return json.dumps([self.end, self.n, list(self.counts.items()), {t: {s: sorted(i) for s, i in b.items()} for t, b in self.baskets.items()}])

    def inside(self, t: int) -> bool:
        return self.end is not None and self.end - self.window_s <= t < self.end

    def change(self, items: set[str], new: str | None, by: int) -> None:
        """Counts of an itemset change by ``by``: all of a basket's, or only those that a new item makes."""
        if new is None:
            self.n += by
        singles, pairs = (items, combinations(sorted(items), 2)) if new is None else ((new,), (tuple(sorted((new, x))) for x in items))
        for key in (*((x,) for x in singles), *pairs):
            self.counts[key] += by
            if not self.counts[key]:
                del self.counts[key]

    def count(self, t: int, by: int) -> None:
        for items in self.baskets[t].values():
            self.change(items, None, by)

    def move(self, end: int) -> None:
        """The counted window becomes the one that ends at ``end``."""
        old = {t for t in self.baskets if self.inside(t)}
        self.end = end
        new = {t for t in self.baskets if self.inside(t)}
        for t in old - new:
            self.count(t, -1)
        for t in new - old:
            self.count(t, 1)

    def add(self, t: int, source: str, item: str, passed: float) -> None:
        """A packet's item; windows whose end the watermark ``passed`` are out already."""
        first = t // self.slide_s * self.slide_s + self.slide_s
        first = max(first, int(passed // self.slide_s) * self.slide_s + self.slide_s)
        if t < first - self.window_s:
            return
        if self.end is None or first < self.end:
            self.move(first)
        basket = self.baskets.setdefault(t, {})
        if source not in basket:
            basket[source] = {item}
            if self.inside(t):
                self.change({item}, None, 1)
        elif item not in basket[source]:
            if self.inside(t):
                self.change(basket[source], item, 1)
            basket[source].add(item)

    def closed(self, passed: float) -> Iterator[tuple[str, str, int, int]]:
        """The counts of every window that ended; then the next one with a basket is counted, and older baskets go."""
        while self.end is not None and self.end <= passed:
            start = text_of(self.end - self.window_s)
            if self.n:
                yield start, "", 0, self.n
                yield from ((start, " + ".join(k), len(k), c) for k, c in self.counts.items())
            self.move(self.end + self.slide_s)
            for t in [t for t in self.baskets if t < self.end - self.window_s]:
                del self.baskets[t]
            if not self.baskets:
                self.end = None
            elif not self.n:
                first = min(self.baskets)
                self.move(max(self.end, first // self.slide_s * self.slide_s + self.slide_s))


class RollingItemsets(StatefulProcessor):
    """A cell of sources: baskets enter as they come, leave by timer; a window's counts are given when it is closed."""

    def __init__(self, window_s: int, slide_s: int):
        self.window_s, self.slide_s = window_s, slide_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("baskets", "s string")

    def held(self) -> Rolling:
        return Rolling(self.window_s, self.slide_s, self.state.get()[0] if self.state.exists() else None)

    def keep(self, r: Rolling) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if r.end is None:
            self.state.clear()
        else:
            self.state.update((r.dump(),))
            self.handle.registerTimer(r.end * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        r, passed = self.held(), timerValues.getCurrentWatermarkInMs() / 1000
        for p in rows:
            for source, t, item in p[["src_ip", "slice", "item"]].itertuples(index=False):
                r.add(int(t), source, item, passed)
        self.keep(r)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        r = self.held()
        out = list(r.closed(timerValues.getCurrentWatermarkInMs() / 1000))
        self.keep(r)
        if out:
            yield pd.DataFrame(out, columns=["window_start", "itemset", "size", "c"])

    def close(self) -> None: ...


def stream_itemset_counts(df: DataFrame, window_s: int = 60, slide_s: int = 10, slice_s: int = 1, watermark_s: int = 30, shards: int = 64) -> DataFrame:
    """Stream, update mode: by cell of sources, the counts of items and pairs of each closed window; size 0 is the number of baskets.

    Each of the ``shards`` is dealt over CELLS cells, whose state is loaded one after another, so that a worker's memory is
    that of one cell. All cells give a window in the same micro-batch, that in which the watermark passes its end.
    """
    if window_s % slide_s or slide_s % slice_s:
        raise ValueError("slices must divide the slide, and that the window")
    keep_state_in_rocksdb(df.sparkSession)
    d = basket_parts(df.withWatermark("event_time", f"{watermark_s} seconds"), slice_s, shards)
    last = F.timestamp_seconds(F.floor(F.col("slice") / slide_s) * slide_s + window_s - 0.001)
    return closing(d, last, watermark_s).groupBy("shard").transformWithStateInPandas(RollingItemsets(window_s, slide_s), COUNTED, "update", "EventTime")


def frequent(counts: DataFrame, min_support: float = 0.05) -> DataFrame:
    """The rows of ``itemsets.rolling`` from the counts of all shards of some windows; for a sink, batch by batch."""
    c = counts.groupBy("window_start", "itemset", "size").agg(F.sum("c").alias("c"))
    n = c.filter("size = 0").select("window_start", F.col("c").alias("n"))
    both = c.filter("size > 0").join(n, "window_start").filter(F.col("c") >= F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(min_support))))
    return both.select("window_start", "itemset", "size", F.col("c").alias("support_count"), F.round(F.col("c") / F.col("n"), 4).alias("support_ratio"))


# ------------------------------------------------------------------ bounded decayed scores
SCORES = "shard int, key string, t double, score double"
KEPT = "shard int, key string, score double, at_most double, at double"


class DecayedHitters:
    """Space-Saving over decaying weights: at most ``size`` keys, each with a score that is short by ``slack`` at most.

    Parts merge as mergeable summaries do: weights of equal keys add up, and where more keys are left than fit, the
    largest that does not fit is taken off all. What was taken off in all, decayed likewise, is ``slack``; it is never more
    than the decayed weight of all packets over ``size`` + 1.
    """

    def __init__(self, size: int, half_life_s: float, at: float | None = None, slack: float = 0.0, scores: dict[str, float] | None = None):
        if size <= 0 or half_life_s <= 0:
            raise ValueError("size and half-life must be positive")
        self.size, self.half_life_s, self.at, self.slack, self.scores = size, half_life_s, at, slack, dict(scores or {})

    def age(self, t: float) -> None:
        if self.at is None:
            self.at = t
        if t > self.at:
            f = 2.0 ** (-(t - self.at) / self.half_life_s)
            self.at, self.slack = t, self.slack * f
            self.scores = {k: s * f for k, s in self.scores.items()}

    def merge(self, keys: list[str], t: np.ndarray, score: np.ndarray) -> None:
        """Weights ``score`` of ``keys``, each as of its own t."""
        if not len(keys):
            return
        self.age(float(t.max()))
        for k, s in zip(keys, (score * 2.0 ** (-(self.at - t) / self.half_life_s)).tolist(), strict=True):
            self.scores[k] = self.scores.get(k, 0.0) + s
        if len(self.scores) > self.size:
            cut = float(np.partition(np.fromiter(self.scores.values(), float), len(self.scores) - self.size - 1)[len(self.scores) - self.size - 1])
            self.slack += cut
            self.scores = {k: s - cut for k, s in self.scores.items() if s > cut}

    def forget(self, epsilon: float) -> None:
        """Keys whose score could not reach ``epsilon`` any more."""
        self.scores = {k: s for k, s in self.scores.items() if s + self.slack >= epsilon}


def score_parts(df: DataFrame, key: str, half_life_s: float, shards: int) -> DataFrame:
    """One row a key and batch of rows of a task: its decayed weight as of the key's last packet there."""
    k = F.col(key).cast("string")
    d = df.filter(k.isNotNull() & F.col("event_time").isNotNull()).select(F.pmod(F.xxhash64(k), F.lit(shards)).cast("int").alias("shard"), k.alias("key"), (F.unix_micros("event_time") / 1e6).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.to_pandas()
            p["last"] = p.groupby(["shard", "key"])["t"].transform("max")
            p["score"] = 2.0 ** (-(p["last"] - p["t"]) / half_life_s)
            g = p.groupby(["shard", "key"], sort=False).agg(t=("last", "max"), score=("score", "sum")).reset_index()
            yield pa.RecordBatch.from_arrays([pa.array(g["shard"], pa.int32()), pa.array(g["key"], pa.string()), pa.array(g["t"], pa.float64()), pa.array(g["score"], pa.float64())], ["shard", "key", "t", "score"])

    return d.mapInArrow(run, SCORES)


class DecayTable(StatefulProcessor):
    """A shard of keys in bounded state; it is gone when the watermark is ``ttl_s`` past its last packet."""

    def __init__(self, size: int, half_life_s: float, ttl_s: float, epsilon: float):
        self.size, self.half_life_s, self.ttl_s, self.epsilon = size, half_life_s, ttl_s, epsilon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("hitters", "at double, slack double, scores string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        h = DecayedHitters(self.size, self.half_life_s, *((held[0], held[1], json.loads(held[2])) if held else ()))
        for p in rows:
            h.merge(p["key"].tolist(), p["t"].to_numpy(), p["score"].to_numpy())
        h.forget(self.epsilon)
        self.state.update((float(h.at), float(h.slack), json.dumps(h.scores)))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(int((h.at + self.ttl_s) * 1000))
        out = [(key[0], k, s, s + h.slack, h.at) for k, s in h.scores.items()]
        if out:
            yield pd.DataFrame(out, columns=["shard", "key", "score", "at_most", "at"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None: ...


def stream_decay_table(df: DataFrame, key: str, half_life_s: float, size: int = 1000, shards: int = 16, watermark_s: int = 30, ttl_s: float | None = None, epsilon: float = 1e-4) -> DataFrame:
    """Stream, update mode: (shard, key, score, at_most, at) of the keys of highest decayed counts.

    Each shard holds ``size`` keys at most, however many come; a score lies between ``score`` and ``at_most``, which are
    apart by the shard's decayed weight over ``size`` + 1 at most. Late packets count with their own weight. Keys that cannot
    reach ``epsilon`` go at once, a shard without packets for ``ttl_s`` (default: 20 half-lives) goes whole.
    """
    keep_state_in_rocksdb(df.sparkSession)
    d = score_parts(df.withWatermark("event_time", f"{watermark_s} seconds"), key, half_life_s, shards)
    # A late packet still has its own weight, so no row of a shard is ever late.
    d = closing(d, F.lit("2200-01-01").cast("timestamp"), watermark_s)
    return d.groupBy("shard").transformWithStateInPandas(DecayTable(size, half_life_s, 20 * half_life_s if ttl_s is None else ttl_s, epsilon), KEPT, "update", "EventTime")
