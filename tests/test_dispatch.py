"""The fan-out: isolated plugins, batches that come again, results equal to the batch's, no invalid row lost."""

from __future__ import annotations

import logging
import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import alerts, cleaning, itemsets, sketches
from packetloom.plans import registry
from packetloom.schema import COLUMNS
from packetloom.sources import packets as src
from packetloom.streaming import dispatch
from packetloom.streaming.dispatch import Context, Dispatcher, Plugin


pytestmark = pytest.mark.usefixtures("few_partitions")


def packets(spark, seed, n, first, last):
    r = random.Random(seed)
    t = sorted(r.uniform(first, last) for _ in range(n))
    rows = [(1_704_067_200 + x, f"10.0.0.{r.randrange(6)}", f"198.51.100.{r.randrange(12)}", r.choice(["TCP", "UDP"]), r.choice([80, 443, 53, None])) for x in t]
    d = spark.createDataFrame(rows, "t double, src_ip string, dst_ip string, protocol string, dst_port int")
    return d.select(F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("event_time"), *d.columns[1:], F.lit(True).alias("is_valid"))


BATCHES = [(1, 120, 0, 45), (2, 260, 35, 110), (5, 3, 400, 401)]


@pytest.fixture(scope="module")
def fed(spark, few_partitions, tmp_path_factory):
    """A fan-out of all plugins and one that always fails, over three batches of which one comes again."""
    root = str(tmp_path_factory.mktemp("fan"))
    calls = []

    def fails(batch, ctx):
        calls.append(batch.count())
        raise ValueError("simulated")

    chosen = [Plugin("broken", fails), dispatch.sketch_plugin(10), dispatch.itemset_plugin(60, 10, 1, 0.1), dispatch.decay_plugin(("dst_ip",), (10, 60)), dispatch.spike_plugin(10, alerts.AlertConfig(min_pps=0.5, warmup_windows=3, warn_multiplier=1.2, critical_multiplier=2.0))]
    d = Dispatcher(chosen, root, 600.0)
    for i, b in enumerate(BATCHES):
        d(packets(spark, *b), i)
    ctx = Context(spark, root, 0)
    names = ("sketch_state", "distinct_counts", "moments", "baskets", "frequent_itemsets", "decay_keys", "spike_windows", "alerts", "pipeline_health", "plugin_errors")
    before = {n: (ctx.table(n).manifest().version, sorted(map(str, ctx.table(n).read().collect()))) for n in names}
    for i in (1,):
        d(packets(spark, *BATCHES[i]), i)
    after = {n: (ctx.table(n).manifest().version, sorted(map(str, ctx.table(n).read().collect()))) for n in names}
    every = packets(spark, *BATCHES[0])
    for b in BATCHES[1:]:
        every = every.unionByName(packets(spark, *b))
    return ctx, every.persist(), before, after, calls


def test_a_plugin_that_throws_stops_no_other(spark, fed):
    ctx, _, _, _, calls = fed
    assert calls == [120, 260, 3, 260]
    errors = ctx.table("plugin_errors").read().collect()
    assert len(errors) == 3 and {(r["plugin"], r["error"]) for r in errors} == {("broken", "ValueError: simulated")}
    health = ctx.table("pipeline_health").read()
    assert health.filter("metric = 'plugin_error'").agg(F.sum("value")).first()[0] == 3 and health.filter("metric = 'input_rows'").agg(F.sum("value")).first()[0] == 383


def test_a_batch_that_comes_again_changes_nothing(fed):
    _, _, before, after, _ = fed
    assert before == after and all(v for v, _ in before.values())


def test_sketches_equal_the_batch(fed):
    ctx, every, _, _, _ = fed
    want = {r["window_start"]: r for r in sketches.window_sketches(every, 10).collect()}
    got = ctx.table("distinct_counts").read().join(ctx.table("moments").read(), ["window_start", "window_len_s"]).collect()
    assert {r["window_start"]: (r["src_ips_fm"], r["dst_ips_fm"], r["f2_ams"], r["src_f2_ams"]) for r in got} == {k: (r["src_ips_fm"], r["dst_ips_fm"], r["dst_f2"], r["src_f2"]) for k, r in want.items()}


def test_itemsets_equal_the_batch(fed):
    ctx, every, _, _, _ = fed
    want = itemsets.rolling(every, 60, 10, 1, 0.1)
    assert sorted(map(tuple, ctx.table("frequent_itemsets").read().select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_decayed_scores_equal_the_batch_and_faded_keys_go(fed):
    ctx, every, _, _, _ = fed
    got = ctx.table("decay_keys").read()
    t = F.unix_micros("event_time") / 1e6
    want = every.select(t.alias("t"), F.col("dst_ip").alias("key")).join(got, "key").groupBy("key", "half_life_s", "score", "at").agg(F.sum(F.pow(F.lit(2.0), (F.col("t") - F.col("at")) / F.col("half_life_s"))).alias("w"))
    assert want.filter("abs(w - score) > 1e-6").count() == 0
    old = got.filter("half_life_s = 10").select("key").collect()
    last = {r[0] for r in packets(every.sparkSession, *BATCHES[-1]).select("dst_ip").collect()}
    assert {r[0] for r in old} >= last


def test_spikes_equal_the_batch(fed):
    ctx, every, _, _, _ = fed
    config = alerts.AlertConfig(min_pps=0.5, warmup_windows=3, warn_multiplier=1.2, critical_multiplier=2.0)
    pps = every.groupBy(F.date_format(F.window("event_time", "10 seconds")["start"], "yyyy-MM-dd HH:mm:ss").alias("window_start")).agg((F.count(F.lit(1)) / 10).alias("pps"))
    want = alerts.spikes(pps.filter("window_start < '2024-01-01 00:06:00'"), config)
    assert want.count() > 0
    assert sorted(map(str, ctx.table("alerts").read().select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_slow_batches_are_told(spark, tmp_path, caplog):
    d = Dispatcher([], str(tmp_path / "slow"), 0.0)
    with caplog.at_level(logging.WARNING):
        for i in range(2):
            d(packets(spark, 1, 5, 0, 1), i)
        assert "slow batches" not in caplog.text
        d(packets(spark, 1, 5, 0, 1), 2)
    assert "3 slow batches in a row" in caplog.text


def test_the_runner_loses_no_invalid_row(spark, tmp_path):
    registry.clear()
    good = src.generate(spark, "normal", 5, 20)
    bad = good.limit(9).withColumn("src_ip", F.lit("")).unionByName(good.limit(4).withColumn("protocol", F.lit("SCTP"))).unionByName(good.limit(2).withColumn("timestamp", F.lit("soon")))
    good.unionByName(bad).select(*COLUMNS).coalesce(2).write.csv(str(tmp_path / "in"))
    c = registry.Config(input_path=str(tmp_path / "in"), output_path=str(tmp_path / "out"), checkpoint_root=str(tmp_path / "c"), windows_s=(10,), trigger_s=None, enabled=(), plugins=("bronze", "dead_letters", "nothing"))
    for _ in range(2):
        queries = registry.run(spark, c)
        for q in queries:
            q.awaitTermination(120)
        if _ == 0:
            seen = [p.observedMetrics["cleaning"] for p in queries[0].recentProgress if "cleaning" in p.observedMetrics]
    ctx = Context(spark, str(tmp_path / "out/plugins"), 0)
    letters = {r["reason"]: r["count"] for r in ctx.table("dead_letters").read().groupBy("reason").count().collect()}
    assert letters == {"src_ip": 9, "protocol": 4, "timestamp": 2} and ctx.table("bronze").read().count() == 115
    valid, invalid = cleaning.split_valid(cleaning.clean(src.read_packets(spark, str(tmp_path / "in"))))
    assert sum(m["valid"] for m in seen) == valid.count() == 100 and sum(m["invalid"] for m in seen) == invalid.count()
    assert sum(m["reason_src_ip"] for m in seen) == 9 and sum(m["reason_protocol"] for m in seen) == 4
    registry.stop(queries)
