"""Properties of the reference's operators on small inputs."""

from __future__ import annotations

import hashlib
import hmac
import random
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetloom.functions import net
from packetloom.operators import alerts, cleaning, graph, history, itemsets, membership, sketches, windows
from packetloom.plans import catalogue, registry
from packetloom.schema import COLUMNS
from packetloom.sources import packets as src
from packetloom.sources import serving
from packetloom.streaming import sinks
from packetloom.streaming.stateful import Dgim, stream_decay, stream_dgim, stream_reservoir

GOOD = ("2024-01-01 00:00:00.000", "10.0.0.1", "8.8.8.8", "1234", "53", "udp", "100", "", "", "", "1.5")


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in COLUMNS))


def changed(**k):
    return tuple(k.get(c, v) for c, v in zip(COLUMNS, GOOD, strict=True))


def test_clean_keeps_every_row(spark):
    bad = [changed(timestamp="x"), changed(protocol=None), changed(protocol="SCTP"), changed(packet_length="0"), changed(src_ip=" "), changed(dst_port="70000")]
    valid, invalid = cleaning.split_valid(raw(spark, GOOD, *bad))
    assert (valid.count(), invalid.count()) == (1, len(bad))
    assert valid.first()["port_class"] == "well-known" and valid.first()["is_private_src"]


@pytest.mark.parametrize("column,value", [("timestamp", "2024-01-01"), ("src_ip", "256.1.1.1"), ("dst_ip", ":::"), ("src_port", "-1"), ("dst_port", "a"), ("protocol", ""), ("packet_length", "65536"), ("src_mac", "AA"), ("tcp_flags", "1"), ("iat_ms", "-2")])
def test_first_broken_rule(spark, column, value):
    assert cleaning.validate(raw(spark, changed(**{column: value}))).first()["reason"] == column


def test_good_row_has_no_reason(spark):
    assert cleaning.validate(raw(spark, GOOD)).first()["reason"] is None


@pytest.mark.parametrize("ip,ok", [("1.2.3.4", True), ("01.2.3.4", False), ("::", True), ("::1", True), ("fe80::1:2", True), ("1:2:3:4:5:6:7:8", True), ("1:2:3:4:5:6:7", False), ("1::2::3", False), ("g::1", False), ("1:2:3:4:5:6:7::", True)])
def test_addresses(spark, ip, ok):
    assert spark.range(1).select(net.is_ip(F.lit(ip))).first()[0] is ok


def test_hmac_is_hmac(spark):
    for key in (b"k", b"x" * 100):
        got = spark.range(1).select(net.hmac_sha256(F.lit("10.0.0.1"), key)).first()[0]
        assert bytes(got) == hmac.new(key, b"10.0.0.1", hashlib.sha256).digest()


def test_anonymised_stay_in_class(spark):
    got = spark.createDataFrame([("10.1.1.1",), ("8.8.8.8",), ("2001:db8::1",), ("junk",)], "ip string").select(net.anonymise_ip(F.col("ip"), b"k")).collect()
    assert [r[0].split(".")[0].split(":")[0] for r in got] == ["10", "198", "fd00", "junk"]


def test_filters(spark):
    specs = cleaning.parse_filters([{"name": "a", "dst_ports": [1, 2]}, {"name": "b", "protocol": "tcp"}, {"name": "c", "src_ip": "x' OR 1=1 --"}])
    assert [s.expr for s in specs[:2]] == ["dst_port IN (1, 2)", "protocol = 'TCP'"]
    cleaning.validate_filters(spark, specs, "dst_port int, protocol string, src_ip string")
    for bad, error in (([{"expr": "1"}], ValueError), ([{"name": "x"}], ValueError), (["x"], TypeError)):
        with pytest.raises(error):
            cleaning.parse_filters(bad)
    with pytest.raises(KeyError):
        cleaning.apply_filter(spark.range(1), "none such")


def test_windows_add_up(spark, sf):
    p = src.from_events(spark, sf)
    by = {r["window_len_s"]: r["n"] for r in windows.multi_window(p, (10, 30, 60)).groupBy("window_len_s").agg(F.sum("packets").alias("n")).collect()}
    assert set(by.values()) == {1000}
    edges = windows.ip_edges(p, 3600).groupBy("window_start").agg(F.sum("packets").alias("e"))
    both = windows.window_metrics(p, 3600).join(edges, "window_start")
    assert both.filter("packets <> e").count() == 0


def test_streams_equal_batches(spark, sf, tmp_path):
    p = src.from_events(spark, sf).select("event_id", "event_time", "src_ip", "dst_ip", "protocol", "dst_port", "packet_length", "iat_ms")
    p.repartitionByRange(3, "event_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    for name, build in (("metrics", windows.window_metrics), ("edges", windows.ip_edges), ("sources", windows.source_stats), ("filters", lambda d, n: windows.filter_counts(d, length_s=n))):
        out = str(tmp_path / name)
        keys = [c for c in build(p, 3600).columns if c in ("window_start", "window_len_s", "src_ip", "dst_ip", "filter_name")]
        q = sinks.start_sink(build(stream.withColumn("x", F.lit(1)).drop("x"), 3600), lambda b, i, out=out, keys=keys: sinks.upsert(b, out, keys), str(tmp_path / f"c_{name}"), trigger_s=None)
        q.awaitTermination(120)
        want, got = build(p, 3600), spark.read.parquet(out)
        assert want.exceptAll(got.select(*want.columns)).count() == 0 and got.count() == want.count()


def test_late_rows_are_counted_not_summed(spark, tmp_path):
    rows = lambda *t: spark.createDataFrame([(x, "a", "b", 1) for x in t], "t string, src_ip string, dst_ip string, packet_length int").select(F.col("t").cast("timestamp").alias("event_time"), "src_ip", "dst_ip", "packet_length")
    first = rows("2024-01-01 00:00:00", "2024-01-01 01:00:00")
    first.write.parquet(str(tmp_path / "in"))
    build = lambda: windows.window_metrics(spark.readStream.schema(first.schema).parquet(str(tmp_path / "in")), 60)
    run = lambda: sinks.start_sink(build(), lambda b, i: sinks.upsert(b, str(tmp_path / "out"), ["window_start", "window_len_s"]), str(tmp_path / "c"), trigger_s=None)
    run().awaitTermination(60)
    rows("2024-01-01 00:00:30", "2024-01-01 01:00:10").write.mode("append").parquet(str(tmp_path / "in"))
    q = run()
    q.awaitTermination(60)
    got = {r["window_start"]: r["packets"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-01-01 00:00:00": 1, "2024-01-01 01:00:00": 2}


def exact_ones(bits, n):
    return sum(bits[-n:])


@pytest.mark.parametrize("window", [1, 5, 64, 1000])
def test_dgim_bound(window):
    r = random.Random(window)
    for bits in ([0] * 200, [1] * 200, [i % 2 for i in range(200)], [r.random() < 0.3 for _ in range(3000)]):
        d = Dgim(window)
        seen = []
        for b in bits:
            d.update(int(b))
            seen.append(int(b))
            e = exact_ones(seen, window)
            assert abs(d.query() - e) <= e * 0.5 + 1
        assert Dgim.restore(d.snapshot()).query() == d.query()
    with pytest.raises(ValueError):
        Dgim(0)


def test_stateful_streams(spark, sf, tmp_path):
    p = src.from_events(spark, sf)
    p.repartitionByRange(3, "event_id").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df, mode in (("dgim", stream_dgim(stream(), 200), "update"), ("decay", stream_decay(stream(), "dst_port", 3600), "update"), ("sample", stream_reservoir(stream(), "event_id", 20), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("dgim").groupBy("predicate_name").agg(F.max("seen").alias("n")).filter("n <> 1000").count() == 0
    last = spark.table("decay").groupBy("key").agg(F.max_by("score", "last").alias("s"), F.max("last").alias("t"))
    want = p.filter("dst_port is not null").select(F.col("dst_port").cast("string").alias("key"), (F.unix_micros("event_time") / 1e6).alias("x")).join(last, "key").groupBy("key", "s").agg(F.sum(F.pow(F.lit(2.0), (F.col("x") - F.col("t")) / 3600)).alias("w"))
    assert want.filter("abs(s - w) > 1e-6").count() == 0
    kept = {r[0] for r in spark.table("sample").select("p", "key").distinct().orderBy("p").limit(20).select("key").collect()}
    assert kept == {str(r[0]) for r in sketches.reservoir(p, "event_id", 20).select("event_id").collect()}


def test_sketches(spark):
    items = spark.range(1000).select(F.timestamp_seconds(F.lit(0)).alias("event_time"), F.concat(F.lit("item_"), "id").alias("item"), F.col("id").alias("event_id"))
    est = sketches.fm_distinct(items, "item", 86400, 60, 6).first()["estimate"]
    assert abs(est - 1000) / 1000 < 0.4
    halves = [items.filter(F.col("event_id") % 2 == i).agg(*sketches.fm_bitmaps(F.col("item"), 6)).first() for i in (0, 1)]
    whole = items.agg(*sketches.fm_bitmaps(F.col("item"), 6)).first()
    assert [a | b for a, b in zip(*halves, strict=True)] == list(whole)
    with pytest.raises(ValueError):
        sketches.fm_estimate([F.lit(1)] * 7, 5)
    skew = spark.range(1000).select(F.timestamp_seconds(F.col("id")).alias("event_time"), F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("x"), F.col("id") % 50)).alias("item"), F.col("id").alias("event_id"))
    exact, ams = sketches.f2_exact(skew, "item", 86400).first()["f2_exact"], sketches.f2_ams(skew, "item", "event_id", 86400, 200, 10).first()["f2_ams"]
    assert abs(ams - exact) / exact < 0.3
    assert sketches.reservoir(items, "event_id", 7).count() == 7 and 150 < sketches.bernoulli(items, "event_id", 0.2).count() < 250


def test_decay_halves(spark):
    one = spark.createDataFrame([(100.0, 0)], "v double, t long").withColumn("at", F.timestamp_seconds("t"))
    for t, want in ((10, 50.0), (20, 25.0), (30, 12.5)):
        got = one.agg(sketches.decayed(F.col("v"), F.col("at"), F.timestamp_seconds(F.lit(t)), 10)).first()[0]
        assert abs(got - want) < 1e-9


def test_itemsets_agree(spark):
    r = random.Random(3)
    b = spark.createDataFrame([(str(i), sorted({f"TCP:{r.randint(1, 12)}" for _ in range(5)})) for i in range(200)], "basket string, items array<string>")
    found = [{(x["itemset"], x["support_count"]) for x in itemsets.mine(b, 0.1, a).collect()} for a in ("apriori", "pcy", "brute")]
    fp = {(x["itemset"], x["support_count"]) for x in itemsets.fp_growth(b, 0.1).filter("size <= 2").collect()}
    assert found[0] == found[1] == found[2] == fp


EDGES = [("A", "B", 10, 1000), ("A", "C", 5, 500), ("C", "B", 3, 300), ("D", "B", 7, 700)]


def edges(spark, rows=EDGES):
    return graph.edges_of(spark.createDataFrame(rows, "src_ip string, dst_ip string, packets long, bytes long"))


def test_pagerank_toy(spark):
    want = {"A": 0.147257, "B": 0.516505, "C": 0.188980, "D": 0.147257}
    for local in (1000, 0):
        got = {r["id"]: r["rank"] for r in graph.pagerank(edges(spark), tol=1e-6 if local else 1e-3, local_edges=local).collect()}
        assert all(abs(got[k] - v) < (1e-4 if local else 2e-3) for k, v in want.items())


def test_graph_rows(spark):
    e = edges(spark, [*EDGES, ("A", "B", 110, 11000), (" ", "B", 1, 1), ("Z", "A", None, None)])
    assert e.filter("src = 'A' and dst = 'B'").first()["packets"] == 120
    sums = graph.transitions(e).groupBy("src").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums) and "Z" not in {r["src"] for r in sums}
    assert graph.next_hop(e, "nobody").count() == 0
    with pytest.raises(ValueError):
        graph.degrees(e, "colour")


def test_betweenness_of_a_path(spark):
    rows = [(a, b, 1, 1) for a, b in zip("ABCD", "BCDE", strict=True)]
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(edges(spark, rows)).collect()}
    assert got == {"A": 0.0, "B": 0.25, "C": round(4 / 12, 9), "D": 0.25, "E": 0.0}


def test_stationary(spark):
    two = [("A", "B", 1, 1), ("B", "A", 1, 1), ("A", "A", 1, 1), ("B", "B", 3, 3)]
    got = {r["id"]: r["rank"] for r in graph.stationary(edges(spark, two)).collect()}
    assert abs(got["A"] - 1 / 3) < 1e-5


def test_alert_rules(spark):
    m = [(f"2024-01-01 00:{i:02d}:00", 100.0) for i in range(10)] + [("2024-01-01 00:10:00", 350.0), ("2024-01-01 00:11:00", 900.0), ("2024-01-01 00:12:00", 5.0)]
    metrics = spark.createDataFrame(m, "window_start string, pps double")
    c = alerts.AlertConfig(warmup_windows=5)
    got = [(r["window_start"][14:16], r["severity"]) for r in alerts.spikes(metrics, c).orderBy("window_start").collect()]
    assert got == [("10", "WARN"), ("11", "CRITICAL")]
    assert alerts.cooled(alerts.spikes(metrics, c), 120).count() == 1
    stats = spark.createDataFrame([("w", "a", 5, 100, 100), ("w", "b", 50, 21, 31), ("w", "c", 50, 20, 30), ("w", "d", None, 99, 1)], "window_start string, src_ip string, packets long, unique_dst_ports long, unique_dst_ips long")
    assert {(r["src_ip"], r["alert_type"]) for r in alerts.source_rules(stats, c).collect()} == {("b", "UNUSUAL_PORT_ACTIVITY"), ("b", "HIGH_FANOUT"), ("d", "UNUSUAL_PORT_ACTIVITY")}


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("k1", 1, "x"), ("k2", 2, None)], "k string, v int, s string")
    b = spark.createDataFrame([("k2", None, "y"), ("k3", 3, "z")], "k string, v int, s string")
    for d in (a, b):
        sinks.upsert(d, str(tmp_path / "t"), ["k"])
        sinks.upsert_sqlite(d, str(tmp_path / "t.db"), "t", ["k"])
    want = {("k1", 1, "x"), ("k2", 2, "y"), ("k3", 3, "z")}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == want
    con = sqlite3.connect(tmp_path / "t.db")
    assert set(con.execute("SELECT k, v, s FROM t")) == want
    con.close()


def test_compaction_and_verification(spark, tmp_path):
    d = src.generate(spark, "spike", 6, 20)
    raw_dir = str(tmp_path / "raw/dt=2024-01-01/hr=05")
    d.coalesce(1).write.csv(raw_dir)
    assert history.compact_hour(spark, str(tmp_path / "raw"), str(tmp_path / "out"), "2024-01-01", 5) == history.compact_hour(spark, str(tmp_path / "raw"), str(tmp_path / "out"), "2024-01-01", 5)
    assert d.count() == 4 * 20 + 2 * 80
    r = history.verify_files(spark, raw_dir).first()
    assert (r["records"], r["malformed"]) == (240, 0) and r["freshness_s"] > 0
    lines = spark.createDataFrame([("a,b",), ("a,b",), ("t" + "," * 10,)], "value string")
    assert tuple(history.verify_lines(lines).first()) == (3, 2, 1)
    assert history.compare_counts(0, 0) == (0.0, True) and history.compare_counts(0, 1)[1] is False
    with pytest.raises(ValueError):
        history.select_hour("2024-01-01")


def test_replay_and_lines(spark):
    d = src.generate(spark, "normal", 3, 5)
    r = src.restamp(d, 0.0, 2.0).orderBy("timestamp").collect()
    assert r[0]["timestamp"].startswith("1970-01-01 00:00:00.000") and r[0]["iat_ms"] == 0
    back = src.format_line(d).select(*src.parse_line(F.col("value")))
    assert back.select("src_ip", "dst_ip").exceptAll(d.select("src_ip", "dst_ip")).count() == 0


def test_registry(spark, caplog, monkeypatch):
    registry.clear()
    registry.register_defaults()
    assert [o.name for o in registry.enabled(["moments", "nothing"])] == ["moments"] and "nothing" in caplog.text
    assert registry.enabled([]) == [] and len(registry.enabled(None)) == 9
    with pytest.raises(TypeError):
        registry.register("x")
    monkeypatch.setenv("PACKETLOOM_TRIGGER_S", "1")
    assert registry.load_config().trigger_s == 1 and registry.load_config().trigger_s is not True


def test_runner(spark, tmp_path):
    registry.clear()
    src.generate(spark, "normal", 10, 20).write.csv(str(tmp_path / "in"))
    c = registry.Config(input_path=str(tmp_path / "in"), output_path=str(tmp_path / "out"), checkpoint_root=str(tmp_path / "c"), windows_s=(10,), trigger_s=None, enabled=("window_metrics", "protocol_counts"))
    for _ in range(2):
        for q in registry.run(spark, c):
            q.awaitTermination(120)
    assert registry.result_table(spark, c, "window_metrics", 10).read().agg(F.sum("packets")).first()[0] == 200
    gone = registry.retain(spark, c, "2025-09-23 00:00:00")
    assert set(gone) == {"window_metrics_10", "protocol_counts_10"} and min(gone.values()) > 0
    assert registry.result_table(spark, c, "window_metrics", 10).read().count() == 0


def test_bloom_loses_nothing(spark):
    a = spark.range(2000).withColumn("item", F.concat(F.lit("x"), "id"))
    kept = membership.probe(a, "item", membership.bloom(a.filter("id < 1000"), "item", 1 << 15), 1 << 15)
    assert kept.filter("id < 1000").count() == 1000 and kept.filter("id >= 1000").count() < 60


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    """Events of users past 65535, whose third octet in ``packets_of`` is over 255."""
    root = str(tmp_path_factory.mktemp("users"))
    rows = [(i, u) for i, u in enumerate((0, 255, 65535, 65536, 80000, 300000, 16777215), 59)]
    d = spark.createDataFrame(rows, "event_id long, user_id long")
    d.select("event_id", F.timestamp_seconds(F.lit(1704067200) + F.col("event_id")).alias("ts"), "user_id", F.lit("click").alias("event_type"), F.lit(5.0).alias("value"), F.lit('{"k": 7}').alias("props")).write.parquet(f"{root}/events.parquet")
    return root


def test_many_users_have_private_addresses(spark, many_users):
    d = src.from_events(spark, many_users).select(src.in_ten(F.col("src_ip")).alias("ip"))
    want = ["10.0.0.0", "10.0.0.255", "10.0.255.255", "10.1.0.0", "10.1.56.128", "10.4.147.224", "10.255.255.255"]
    assert sorted(r["ip"] for r in d.collect()) == sorted(want)
    assert [tuple(r) for r in catalogue.ip_classes(spark, many_users).collect()] == [("private", "private", 7)]



def test_many_users_send_no_bad_addresses(spark, many_users):
    """Rows 59 to 65: 62 has no ends, and no other rule is broken."""
    assert sorted(map(tuple, catalogue.reject_reasons(spark, many_users).collect())) == [("BAD_TIMESTAMP", 1), ("OK", 6)]



@pytest.mark.parametrize("block", [1 << 19, 7])
def test_two_steps_in_blocks(spark, block):
    """The matrix squared: loops, dangling ends and a vertex that many steps pass."""
    r = random.Random(5)
    rows = {(f"v{r.randrange(9)}", f"v{r.randrange(12)}"): r.randrange(1, 6) for _ in range(50)} | {(f"a{i}", "hub"): 1 for i in range(20)} | {("hub", f"b{i}"): 2 for i in range(20)}
    out = {}
    for (a, _), n in rows.items():
        out[a] = out.get(a, 0) + n
    want = {}
    for (a, b), n in rows.items():
        for (c, d), m in rows.items():
            if b == c:
                want[a, d] = want.get((a, d), 0) + n / out[a] * m / out[c]
    found = graph.two_step(edges(spark, [(a, b, n, n) for (a, b), n in rows.items()]), block=block)
    got = [(x["src"], x["dst"], x["p"]) for x in found.collect()]
    assert len(got) == len(want) and all(abs(p - want[a, b]) < 1e-6 for a, b, p in got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # products are no rows


def test_two_steps_of_more_products_than_a_task_adds_up_at_once():
    side, end, via = [0] * 6 + [1] * 6, [*"xxxyyz", *"pqpqpr"], [*"abcabd", *"aabbcc"]
    t = pa.table({"side": pa.array(side, pa.int32()), "end": end, "via": via, "p": [float(i + 1) for i in range(12)]})
    whole, few = (sorted(x for b in graph._block_square(t, n) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)) for n in (1 << 22, 1))
    assert whole == few == [("x", "p", 1 * 7.0 + 2 * 9 + 3 * 11), ("x", "q", 1 * 8.0 + 2 * 10), ("x", "r", 3 * 12.0), ("y", "p", 4 * 7.0 + 5 * 9), ("y", "q", 4 * 8.0 + 5 * 10)]



def test_members_are_exact_when_the_filter_is_full(spark):
    a = spark.range(2000).select("id", F.col("id").cast("string").alias("item")).unionByName(spark.createDataFrame([(0, "0"), (9999, None)], "id long, item string"))
    of = a.filter("id % 7 = 0")
    assert membership.probe(a, "item", membership.bloom(of, "item", 1 << 10), 1 << 10).count() > of.count()
    kept = membership.members(a, "item", of, 1 << 10)
    assert kept.columns == a.columns and sorted(r["id"] for r in kept.collect()) == sorted([0, *range(0, 2000, 7)])



def test_serving(spark, tmp_path):
    m = spark.createDataFrame([("2024-01-01 00:00:00", 10, 1.0), ("2024-01-01T00:00:10Z", 10, None)], "window_start string, window_len_s int, pps double")
    db = str(tmp_path / "s.db")
    sinks.upsert_sqlite(m, db, "window_metrics")
    assert serving.read_sqlite(spark, db, "window_metrics", "2024-01-01T00:00:05Z").count() == 1
    assert serving.latest(m).count() == 1
    lay = serving.Layout(str(tmp_path / "zones"))
    assert set(lay.create(spark)) >= {"raw", "stream_in"} and (tmp_path / "zones/raw").is_dir()
    from datetime import datetime

    listing = ["-rw-r--r-- 1 u g 10 2024-01-01 00:00 /in/a.csv", "-rw-r--r-- 1 u g 10 2024-01-03 00:00 /in/b.csv", "drwxr-xr-x - u g 0 2024-01-01 00:00 /in/d", "-rw-r--r-- 1 u g 1 2024-01-01 00:00 /in/.c", "junk"]
    assert serving.eligible_files(listing, datetime(2024, 1, 2), "/in") == ["/in/a.csv"]


def test_raw_table(spark, tmp_path):
    src.generate(spark, "dns_heavy", 2, 5).write.csv(str(tmp_path / "raw/dt=2024-01-01/hr=00"))
    serving.register_raw(spark, "raw_packets", str(tmp_path / "raw"))
    assert spark.sql("SELECT count(*) FROM raw_packets WHERE dt = '2024-01-01'").first()[0] == 10
    spark.sql("DROP TABLE raw_packets")
    serving.write_dataset(src.generate(spark, "dns_heavy", 2, 5), str(tmp_path / "set"))
    assert spark.read.json(str(tmp_path / "set.truth")).first()["packets"] == 10


def test_health(spark, tmp_path):
    h = sinks.Health()
    spark.streams.addListener(h)
    src.generate(spark, "normal", 2, 5).write.csv(str(tmp_path / "in"))
    q = sinks.start_sink(windows.window_metrics(cleaning.clean(src.stream_packets(spark, str(tmp_path / "in"))), 10), lambda b, i: b.count(), str(tmp_path / "c"), trigger_s=None)
    q.awaitTermination(60)
    import time

    for _ in range(50):
        if h.rows:
            break
        time.sleep(0.2)
    spark.streams.removeListener(h)
    assert {r["metric"] for r in h.rows} >= {"lag_s", "input_rows", "late_rows", "batch_duration_s"}


def test_streamed_alerts_are_judged_once(spark, tmp_path):
    from packetloom.streaming.alerting import alert_table, start_alerts

    calm, spike = src.generate(spark, "normal", 60, 20), src.generate(spark, "portscan_like", 10, 200, base_epoch=1758412860.0)
    later = src.generate(spark, "normal", 5, 1, base_epoch=1758413000.0)
    for i, d in enumerate((calm, spike, later)):
        d.coalesce(1).write.mode("append").csv(str(tmp_path / "in"))
        valid, _ = cleaning.split_valid(cleaning.clean(src.stream_packets(spark, str(tmp_path / "in"))))
        for q in start_alerts(valid, str(tmp_path / "out"), config=alerts.AlertConfig(min_pps=5, warmup_windows=3), trigger_s=None):
            q.awaitTermination(120)
    got = alert_table(spark, str(tmp_path / "out"), "spikes").read().collect()
    assert [(r["window_start"], r["severity"]) for r in got] == [("2025-09-21 00:01:00", "CRITICAL")]
    scans = alert_table(spark, str(tmp_path / "out"), "sources").read().filter("alert_type = 'UNUSUAL_PORT_ACTIVITY'").collect()
    assert [r["window_start"] for r in scans] == ["2025-09-21 00:01:00"]


def test_lines_over_tcp():
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))
    got = []

    def serve():
        c, _ = server.accept()
        with c, c.makefile() as f:
            got.extend(f)

    t = threading.Thread(target=serve)
    t.start()
    w = sinks.TcpLines("127.0.0.1", server.getsockname()[1])
    w.open(0, 0)
    w.process(("a", None, 1))
    w.process(("b", 2, 3))
    w.close(None)
    t.join(5)
    server.close()
    assert got == ["a,,1\n", "b,2,3\n"]


def test_strict_parser(spark):
    good = "\t".join(["1704067200.1239", "10.0.0.1", "8.8.8.8", "", "", "1", "2", "", "", "6", "", "60", "AA:BB:CC:00:11:22", "", "0x10", "0.001"])
    d = spark.createDataFrame([(good,)], "value string")
    r = src.parse_raw_strict(d).first()
    assert (r["timestamp"], r["src_mac"], r["iat_ms"], r["dst_port"]) == ("2024-01-01 00:00:00.123", "aa:bb:cc:00:11:22", 1.0, 2)
    for bad in (good.replace("AA:BB", "AABB"), good.replace("0x10", "SYN")):
        assert src.parse_raw(spark.createDataFrame([(bad,)], "value string")).first()["reject_reason"] == "VALIDATION"
    with pytest.raises(Exception, match="WRONG_COLUMNS"):
        src.parse_raw_strict(spark.createDataFrame([("x",)], "value string")).collect()


def test_sqlite_table_gains_columns(spark, tmp_path):
    db = str(tmp_path / "serving.db")
    sinks.upsert_sqlite(spark.createDataFrame([("a", 1)], "k string, n int"), db, "t", ["k"])
    sinks.upsert_sqlite(spark.createDataFrame([("a", None, 2.5), ("b", 3, None)], "k string, n int, x double"), db, "t", ["k"])
    with sqlite3.connect(db) as con:
        assert sorted(con.execute("SELECT k, n, x FROM t")) == [("a", 1, 2.5), ("b", 3, None)]


def test_upsert_after_a_crash_in_the_swap(spark, tmp_path):
    """The table was set aside and the new one had not yet taken its place: nothing is lost."""
    path = tmp_path / "t"
    sinks.upsert(spark.createDataFrame([("a", 1)], "k string, n int"), str(path), ["k"])
    path.rename(tmp_path / "t.old")
    sinks.upsert(spark.createDataFrame([("b", 2)], "k string, n int"), str(path), ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(str(path)).collect()) == [("a", 1), ("b", 2)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_private_addresses_have_four_numbers(spark):
    ips = ["10.1.2.3", "10.x", "172.16.0.1", "172.32.0.1", "192.168.1", "127.0.0.1", "::1", "fd12:3::", "fe80::1", "8.8.8.8", None]
    d = spark.createDataFrame([(x,) for x in ips], "ip string")
    assert [r[0] for r in d.select(net.is_private(F.col("ip"))).collect()] == [True, False, True, False, False, True, True, True, True, False, False]


@pytest.mark.parametrize("local", [0, 1000])
def test_stationary_is_alike_at_all_sizes(spark, local):
    """By joins and in one task: the same vector where there is one, no rows where there is none."""
    e = edges(spark, [("A", "B", 1, 1), ("B", "A", 1, 1), ("A", "A", 1, 1), ("B", "B", 3, 3), ("B", "C", 1, 1)])
    got = {r["id"]: r["rank"] for r in graph.stationary(e, local_edges=local).collect()}
    p = {"A": {"A": 1 / 2, "B": 1 / 2}, "B": {"A": 1 / 5, "B": 3 / 5, "C": 1 / 5}, "C": dict.fromkeys("ABC", 1 / 3)}
    assert set(got) == set("ABC") and all(abs(sum(got[u] * p[u].get(v, 0) for u in p) - got[v]) < 1e-6 for v in got)
    swings = edges(spark, [("A", "B", 1, 1), ("B", "A", 1, 1), ("B", "C", 1, 1), ("C", "B", 1, 1)])
    assert graph.stationary(swings, max_iter=8, local_edges=local).count() == 0


def test_markov_rows_add_up(spark):
    e = edges(spark, [("A", "B", 1, 1), ("A", "C", 3, 1), ("B", "D", 0, 1)])
    rows = graph.markov_rows(e).collect()
    assert {(r["src"], r["dst"]): r["p"] for r in rows} == {("A", "B"): 0.25, ("A", "C"): 0.75, ("B", None): 0.25, ("C", None): 0.25, ("D", None): 0.25}


def test_baselines_are_those_of_a_fold(spark):
    """Any gaps, windows that do not count, and a start in the middle."""
    r = random.Random(4)
    at, rows = 1_700_000_000, []
    for _ in range(600):
        at += r.choice([10, 10, 10, 20, 5000, 2_000_000])
        rows.append((at, r.choice([5.0, 60.0, 70.0, 200.0, 500.0])))
    c = alerts.AlertConfig(warmup_windows=5)
    m = spark.createDataFrame(rows, "at long, pps double").select(F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), "pps", "at")
    base, n, want = 0.0, 0, []
    for t, pps in rows:
        want.append((t, base if n else 0.0, n))
        if pps >= c.min_pps:
            base, n = (pps if not n else c.alpha * pps + (1 - c.alpha) * base), n + 1
    got = alerts.baselines(m, c).withColumn("at", F.unix_timestamp("window_start")).orderBy("at").select("at", "before", "counted").collect()
    assert all(a[0] == b[0] and a[2] == b[2] and abs(a[1] - b[1]) < 1e-6 for a, b in zip(got, want, strict=True))
    first, rest = m.filter(F.col("at") < rows[300][0]), m.filter(F.col("at") >= rows[300][0])
    start = alerts.baseline_after(first, c)
    both = sorted(map(str, alerts.spikes(first, c).collect() + alerts.spikes(rest, c, start).collect()))
    assert both == sorted(map(str, alerts.spikes(m, c).collect())) and len(both) > 10
    assert alerts.baseline_after(m.limit(0), c, start) == start and alerts.spikes(m.limit(0), c).count() == 0


def test_longer_windows_from_stored_sketches(spark, tmp_path):
    d = spark.range(40_000).select(F.timestamp_micros(F.col("id") * 3000).alias("event_time"), (F.col("id") % 9000).cast("string").alias("src_ip"), (F.col("id") % 77).cast("string").alias("dst_ip"), F.lit(80).alias("dst_port"))
    windows.distinct_sketches(d, 10).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    for n in (10, 30, 60):
        want = {r[0]: r[1:] for r in d.groupBy(F.date_format(F.window("event_time", f"{n} seconds")["start"], "yyyy-MM-dd HH:mm:ss")).agg(*[F.count_distinct(c) for c in windows.SKETCHED.values()]).collect()}
        got = {r["window_start"]: (r["src_ips"], r["dst_ips"], r["ports"]) for r in windows.distinct_rollup(stored, n).collect()}
        assert got.keys() == want.keys() and all(abs(a - b) <= 0.05 * b for k in want for a, b in zip(got[k], want[k], strict=True))


def test_longer_windows_are_counted_exactly(spark):
    """More items a window than a sketch tells apart, an item in several windows, and a window without any port."""
    d = spark.range(60_000).select(F.timestamp_micros(F.col("id") * 1000).alias("event_time"), (F.col("id") % 29_000).cast("string").alias("src_ip"), (F.col("id") % 77).cast("string").alias("dst_ip"), F.when(F.col("id") < 30_000, F.col("id") % 5).alias("dst_port"))
    stored = windows.distinct_items(d, 10)
    for n in (10, 30, 60):
        want = d.groupBy(F.date_format(F.window("event_time", f"{n} seconds")["start"], "yyyy-MM-dd HH:mm:ss").alias("w")).agg(*[F.count_distinct(c) for c in windows.SKETCHED.values()])
        assert sorted(map(tuple, windows.exact_rollup(stored, n).drop("window_len_s").collect())) == sorted(map(tuple, want.collect()))
    assert {r["ports"] for r in windows.exact_rollup(stored, 30).collect()} == {0, 5}



def test_a_stream_gives_every_packet_once(spark, tmp_path):
    rows = lambda *t: spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", i) for m, i in t], "t string, i int").select(F.col("t").cast("timestamp").alias("event_time"), "i")
    states = []
    for batch in (rows((0, 1), (0, 1), (0, 2)), rows((0, 1), (0, 3)), rows((10, 4), (10, 4)), rows((0, 5), (20, 6))):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = src.once(spark.readStream.schema("event_time timestamp, i int").parquet(str(tmp_path / "in")), ("event_time", "i"))
        q = sinks.start_sink(stream, lambda b, _: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "ck"), "append", None)
        q.awaitTermination(60)
        states.append([o for p in q.recentProgress for o in p.stateOperators])
    assert sorted(r["i"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4, 6]
    assert sum(o.numRowsDroppedByWatermark for o in states[-1]) == 1 and states[-1][-1].numRowsTotal <= 1
    assert src.once(rows((0, 1), (0, 1)), ("event_time", "i")).count() == 1


@pytest.mark.parametrize("k", [None, 4])
def test_betweenness_by_joins(spark, k):
    """Ties of paths, two-way edges, loops and parts out of reach: as one source at a time."""
    r = random.Random(12)
    rows = {(f"v{r.randrange(11)}", f"v{r.randrange(11)}"): r.choice([1, 1, 2, 4]) for _ in range(34)} | {("x", "y"): 1, ("y", "z"): 1, ("x", "x"): 5}
    e = edges(spark, [(a, b, w, w) for (a, b), w in rows.items()])
    want = {x["id"]: x["betweenness"] for x in graph.betweenness(e, k=k).collect()}
    got = {x["id"]: x["betweenness"] for x in graph.betweenness_by_joins(e, k=k).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 2e-9 for v in got) and sum(got.values()) > 0
