"""Snapshot tables: whole at every moment, idempotent by batch, and really deleted."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from packetloom.streaming import tables
from packetloom.streaming.tables import Conflict, SnapshotTable

pytestmark = pytest.mark.usefixtures("few_partitions")
SCHEMA = "window_start string, k string, v long, s string"


def at(h, m=0):
    return f"2024-01-01 {h:02d}:{m:02d}:00"


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "t"), ("window_start", "k"))


def put(spark, t, *rows, **how):
    return t.merge(spark.createDataFrame(list(rows), SCHEMA), **how)


def held(t):
    return {tuple(r) for r in t.read().collect()}


def test_merge_fills_columns_and_touches_only_its_buckets(spark, table):
    put(spark, table, (at(1), "a", 1, "x"), (at(2), "a", 2, None), (None, "n", 0, "z"))
    first = table.manifest()
    put(spark, table, (at(2), "a", None, "y"), (at(2), "b", 3, "w"))
    assert held(table) == {(at(1), "a", 1, "x"), (at(2), "a", 2, "y"), (at(2), "b", 3, "w"), (None, "n", 0, "z")}
    last = table.manifest()
    assert last.version == 2 and {b for b in last.buckets if last.buckets[b] != first.buckets[b]} == {"2024010102"}
    assert {tuple(r) for r in table.read(1).collect()} == {(at(1), "a", 1, "x"), (at(2), "a", 2, None), (None, "n", 0, "z")}


def test_new_columns_and_combining(spark, table):
    put(spark, table, (at(1), "a", 1, "x"))
    more = spark.createDataFrame([(at(1), "a", 5, 0.5)], "window_start string, k string, v long, extra double")
    table.merge(more, combine={"v": lambda o, n: o("v") + n("v")})
    assert [tuple(r) for r in table.read().select("v", "s", "extra").collect()] == [(6, "x", 0.5)]
    put(spark, table, (at(1), "z", 9, "q"), scope=("window_start",))
    assert held(table) == {(at(1), "z", 9, "q", None)}


def test_a_batch_that_comes_again_changes_nothing(spark, table):
    add = {"v": lambda o, n: o("v") + n("v")}
    for batch in (0, 1, 1, 0, 2):
        put(spark, table, (at(1), "a", 1, "x"), txn=("sums", batch), combine=add)
    assert held(table) == {(at(1), "a", 3, "x")} and table.manifest().version == 3
    for batch in (0, 0, 1):
        table.append(spark.createDataFrame([(at(1), "raw", 1, "x")], SCHEMA), txn=("bronze", batch))
    assert table.read().filter("k = 'raw'").count() == 2
    assert put(spark, table, txn=("sums", 3)) and not put(spark, table, txn=("sums", 3))


@pytest.mark.parametrize("step", ["_write", "commit", "after"])
def test_a_crash_between_steps_loses_nothing(spark, table, monkeypatch, step):
    put(spark, table, (at(1), "a", 1, "x"), (at(2), "a", 1, "x"))
    before = held(table)
    real = SnapshotTable._write if step == "_write" else SnapshotTable.commit

    def fails(self, *a):
        if step != "commit":
            real(self, *a)
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_write" if step == "_write" else "commit", fails)
        with pytest.raises(OSError, match="killed"):
            put(spark, table, (at(1), "a", 2, "y"), txn=("w", 0))
    after = {(at(1), "a", 2, "y"), (at(2), "a", 1, "x")}
    assert held(table) == (after if step == "after" else before)
    put(spark, table, (at(1), "a", 2, "y"), txn=("w", 0))
    assert held(table) == after
    assert table.vacuum(1) == (1 if step == "after" else 2)
    assert held(table) == after and table.vacuum(1) == 0


def test_two_writers_both_stay(spark, table, monkeypatch):
    put(spark, table, (at(1), "a", 1, "x"))
    other, real, once = SnapshotTable(spark, table.path, table.keys), SnapshotTable.commit, []

    def commit(self, m):
        if not once:
            once.append(1)
            put(spark, other, (at(1), "b", 2, "y"))
        real(self, m)

    monkeypatch.setattr(SnapshotTable, "commit", commit)
    put(spark, table, (at(1), "c", 3, "z"))
    assert {r[1] for r in held(table)} == {"a", "b", "c"}
    with pytest.raises(Conflict):
        real(table, tables.Manifest(1))


def test_retention_deletes_and_counts(spark, tmp_path):
    made = {n: SnapshotTable(spark, str(tmp_path / n), ("window_start", "k")) for n in ("one", "two")}
    for t in made.values():
        put(spark, t, *[(at(h, m), "a", 1, "x") for h in range(6) for m in (0, 30)], (None, "n", 1, "x"))
    gone = tables.retain_all(made, "2024-01-02 03:15:00", 24, 1)
    assert gone == {"one": 7, "two": 7} and made["one"].read().count() == 6
    files = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "one/data"))
    assert files.count() == 6  # nothing older is on disk
    assert tables.retain_all(made, "2024-01-02 03:15:00", 24, 1) == {"one": 0, "two": 0}


def test_buckets_by_hash_and_a_table_never_written(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "h"), ("k",), tables.by_hash("k", 4))
    assert t.read().count() == 0 and t.versions() == [] and not t.done(("x", 0))
    t.merge(spark.range(100).select(F.col("id").cast("string").alias("k"), "id"))
    t.merge(spark.range(50, 150).select(F.col("id").cast("string").alias("k"), (F.col("id") + 1).alias("id")))
    assert t.read().count() == 150 and t.read().filter("k >= '50' and id = k + 1").count() >= 50 and len(t.manifest().buckets) == 4
