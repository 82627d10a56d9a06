"""Keyed streaming state with timers: equal to the batch result, bounded, and whole after restarts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import itemsets, sketches
from packetloom.streaming import keyed
from packetloom.streaming.sinks import start_sink

pytestmark = pytest.mark.usefixtures("few_partitions")
SCHEMA = "event_time timestamp, event_id long, src_ip string, dst_ip string, protocol string, dst_port int"
BASE = 1_704_067_200


def rows(seed, n, first, last, sources=9):
    r = random.Random(seed)
    out = []
    for i in range(n):
        src = None if r.random() < 0.02 else f"10.0.0.{r.randrange(sources)}"
        out.append((BASE + r.uniform(first, last), i, src, None if r.random() < 0.02 else f"198.51.100.{int(r.expovariate(0.2))}", r.choice(["TCP", "UDP", None]), r.choice([80, 443, 53, 8443, None])))
    return out


def frame(spark, data):
    made = spark.createDataFrame([(float(t), *x) for t, *x in data], "t double, " + SCHEMA.split(", ", 1)[1])
    return made.select(F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("event_time"), *made.columns[1:])


class Feed:
    """A folder of files read as a stream; each ``run`` starts the query anew from its checkpoint."""

    def __init__(self, spark, path):
        self.spark, self.path, self.states = spark, path, []

    def put(self, data):
        frame(self.spark, data).coalesce(1).write.mode("append").parquet(str(self.path / "in"))

    def run(self, build, mode, write=None):
        stream = build(self.spark.readStream.schema(SCHEMA).parquet(str(self.path / "in")))
        q = start_sink(stream, write or (lambda b, _: b.write.mode("append").parquet(str(self.path / "out"))), str(self.path / "ck"), mode, None)
        q.awaitTermination(180)
        self.states.append([o for p in q.recentProgress for o in p.stateOperators])
        return self.spark.read.parquet(str(self.path / "out")) if write is None else None


def test_sketches_equal_the_batch_and_leave_no_state(spark, tmp_path):
    f = Feed(spark, tmp_path)
    parts = [rows(1, 200, 0, 40), rows(2, 200, 20, 70), [(BASE + 50.5, 1, "10.9.9.9", "x", "TCP", 1), (BASE + 90, 2, "10.9.9.8", "y", "TCP", 1)], [(BASE + 3.0, 9, "late", "late", "TCP", 1), (BASE + 10_000, 3, "a", "b", "UDP", 2)]]
    for p in parts:
        f.put(p)
        got = f.run(lambda d: keyed.stream_sketches(d, 10, 30), "append")
    on_time = [x for p in parts for x in p if x[2] != "late" and x[0] < BASE + 9000]
    want = sketches.window_sketches(frame(spark, on_time), 10)
    assert want.count() == 8 and sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert sum(o.numRowsDroppedByWatermark for o in f.states[-1]) == 1
    assert f.states[-1][-1].numRowsTotal <= 3  # of the one open window


def test_sketch_estimates():
    s, other = keyed.Sketch(60, 42), keyed.Sketch(60, 42)
    r = np.random.default_rng(1)
    counts = r.zipf(1.7, 800).clip(1, 300)
    for i, c in enumerate(counts):
        (s if i % 2 else other).add(f"item{i}", int(c))
    s.merge(other.bitmaps, other.sums)
    assert abs(s.distinct(6) - 800) / 800 < 0.4
    assert abs(s.f2(8) - (counts**2).sum()) / (counts**2).sum() < 0.5


@pytest.mark.parametrize("shards", [1, 5])
def test_rolling_itemsets_equal_the_batch(spark, tmp_path, shards):
    f = Feed(spark, tmp_path)
    parts = [rows(3, 150, 0, 50), rows(4, 150, 30, 90), rows(5, 80, 75, 100), rows(6, 60, 400, 430), [(BASE + 5_000, 0, "10.0.0.1", "x", "TCP", 1)], [(BASE + 3.0, 9, "late", "late", "TCP", 9), (BASE + 10_000, 0, "10.0.0.1", "x", "TCP", 1)]]

    def write(batch, _):
        keyed.frequent(batch, 0.1).write.mode("append").parquet(str(tmp_path / "out"))

    for p in parts:
        f.put(p)
        f.run(lambda d: keyed.stream_itemset_counts(d, 60, 10, 1, 30, shards), "update", write)
    on_time = [x for p in parts for x in p if x[2] != "late" and x[0] < BASE + 9_000]
    want = itemsets.rolling(frame(spark, on_time), 60, 10, 1, 0.1)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert f.states[-1][-1].numRowsTotal <= 3 * shards


def test_no_state_of_rolling_itemsets_holds_a_shard(spark):
    """Sources of one shard are dealt over cells, of which each has its own state."""
    d = frame(spark, [(BASE + i, i, f"10.0.{i // 250}.{i % 250}", "x", "TCP", 1) for i in range(2000)])
    cells = keyed.basket_parts(d, 1, 1).groupBy("shard").count().collect()
    assert len(cells) > 0.9 * keyed.CELLS and max(r["count"] for r in cells) < 2000 / 16
    assert keyed.basket_parts(d, 1, 1).groupBy("src_ip").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() == 0



def test_rolling_counts_follow_every_change():
    """Baskets in any order, with restarts, against counting from scratch."""
    r = random.Random(8)
    for _ in range(40):
        roll, seen, passed, out, want = keyed.Rolling(6, 2), [], 0.0, {}, {}
        for _ in range(60):
            t, s, i = int(passed) + r.randrange(-7, 9), f"s{r.randrange(3)}", f"i{r.randrange(4)}"
            if t >= 0:
                roll.add(t, s, i, passed)
                seen.append((t, s, i, passed))
            if r.random() < 0.3:
                passed += r.choice([0.5, 1, 3, 11])
                got = list(roll.closed(passed))
                for w, k, _, c in got:
                    assert (w, k) not in out
                    out[w, k] = c
            if r.random() < 0.3:
                roll = keyed.Rolling(6, 2, roll.dump())
        for w, k, _, c in roll.closed(10**6):
            out[w, k] = c
        for end in range(2, int(passed) + 40, 2):
            b = {}
            for t, s, i, at in seen:
                if end - 6 <= t < end and at < end:
                    b.setdefault((t, s), set()).add(i)
            name = keyed.text_of(end - 6)
            if b:
                want[name, ""] = len(b)
            for items in b.values():
                for k in [(x,) for x in items] + [(x, y) for x in items for y in items if x < y]:
                    want[name, " + ".join(k)] = want.get((name, " + ".join(k)), 0) + 1
        assert out == want


def test_decayed_hitters_stay_small_and_within_bounds():
    r = np.random.default_rng(3)
    n, size, half = 400_000, 500, 30.0
    t = np.sort(r.uniform(0, 120, n))
    keys = np.where(r.random(n) < 0.3, r.zipf(1.4, n).clip(1, 50), np.arange(n) + 1000)
    h = keyed.DecayedHitters(size, half)
    for i in range(0, n, 50_000):
        k, at = np.unique(keys[i : i + 50_000], return_inverse=True)
        last = np.zeros(len(k))
        np.maximum.at(last, at, t[i : i + 50_000])
        score = np.bincount(at, 2.0 ** (-(last[at] - t[i : i + 50_000]) / half))
        h.merge([str(x) for x in k], last, score)
        assert len(h.scores) <= size
    exact = {}
    for k, w in zip(keys.tolist(), 2.0 ** (-(h.at - t) / half), strict=True):
        exact[str(k)] = exact.get(str(k), 0.0) + w
    total = sum(exact.values())
    assert h.slack <= total / (size + 1) + 1e-6
    assert all(exact[k] - h.slack - 1e-6 <= s <= exact[k] + 1e-6 for k, s in h.scores.items())
    assert all(k in h.scores for k, s in exact.items() if s > h.slack + 1e-6)
    with pytest.raises(ValueError):
        keyed.DecayedHitters(0, 1.0)


def test_decay_table_over_a_stream(spark, tmp_path):
    f = Feed(spark, tmp_path)
    scan = [(BASE + 40 + i / 200, i, f"10.1.{i // 250}.{i % 250}", "v", "TCP", 1) for i in range(3000)]
    parts = [rows(7, 300, 0, 40), scan, [(BASE + 20.0, 0, "10.0.0.3", "late", "TCP", 1), (BASE + 60, 1, "10.0.0.4", "x", "TCP", 1)]]
    for p in parts:
        f.put(p)
        got = f.run(lambda d: keyed.stream_decay_table(d, "src_ip", 20, size=40, shards=4), "update")
    latest = got.groupBy("shard").agg(F.max("at").alias("at"))
    got = got.join(latest, ["shard", "at"]).dropDuplicates(["shard", "key"])
    assert got.groupBy("shard").count().filter("count > 40").count() == 0
    every = frame(spark, [x for p in parts for x in p]).filter("src_ip is not null")
    exact = every.select(F.col("src_ip").alias("key"), (F.unix_micros("event_time") / 1e6).alias("t")).join(got, "key").groupBy("key", "score", "at_most").agg(F.sum(F.pow(F.lit(2.0), (F.col("t") - F.col("at")) / 20)).alias("want"))
    assert exact.count() > 40 and exact.filter("want < score - 1e-6 or want > at_most + 1e-6").count() == 0
    f.put([(BASE + 5_000, 0, "10.0.0.1", "x", "TCP", 1)])
    f.run(lambda d: keyed.stream_decay_table(d, "src_ip", 20, size=40, shards=4), "update")
    f.put([(BASE + 9_000, 0, "10.0.0.1", "x", "TCP", 1)])
    f.run(lambda d: keyed.stream_decay_table(d, "src_ip", 20, size=40, shards=4), "update")
    assert f.states[-1][-1].numRowsTotal <= 3
