"""Result tables of snapshots: a reader sees a whole version at every moment, a writer rewrites what it touches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"
#: (the row that is there, the row that comes) to the column's value; both are given as functions of a column's name.
Combine = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]
Txn = tuple[str, int]


def by_hour(column: str = "window_start") -> Column:
    return F.substring(F.regexp_replace(F.col(column).cast("string"), r"[^0-9]", ""), 1, 10)


def by_hash(column: str, buckets: int = 16) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("string")


@dataclass
class Manifest:
    """One version: its columns, the folders that hold each bucket, and the last batch of each writer."""

    version: int = 0
    schema: str | None = None
    buckets: dict[str, list[str]] = field(default_factory=dict)
    txn: dict[str, int] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class SnapshotTable:
    """Parquet folders under ``path``/data and numbered manifests under ``path``/_manifests.

    A commit writes its rows to a new folder, then renames its manifest to the next number, which fails if that
    is taken: the highest number is the table. A crash leaves the version before and an unlisted folder, which
    ``vacuum`` removes. Rows lie in buckets (of an hour, by default), and only buckets that a commit touches are rewritten.
    With ``txn`` (a writer's name and its batch id) a batch that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), bucket: Column | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), tuple(keys)
        self.bucket = by_hour() if bucket is None else bucket
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = self._path("_manifests")
        self.fs = self.folder.getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    # ---------------------------------------------------------------- manifests
    def versions(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self.fs.listStatus(self.folder) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        found = self.versions()
        if not found:
            return Manifest()
        return Manifest(**json.loads(self._text(version or found[-1])))

    def _text(self, version: int) -> str:
        stream = self.fs.open(self._path(f"_manifests/{version:020d}.json"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, m: Manifest) -> None:
        """Make ``m`` the table, unless its number is taken."""
        self.fs.mkdirs(self.folder)
        temp = self._path(f"_manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(temp, True)
        try:
            out.write(bytearray(json.dumps(vars(m)).encode()))
        finally:
            out.close()
        target = self._path(f"_manifests/{m.version:020d}.json")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.folder.toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temp, target, none)
        except Py4JJavaError as e:
            self.fs.delete(temp, False)
            if "FileAlreadyExists" in str(e.java_exception.toString()) or self.fs.exists(target):
                raise Conflict(f"version {m.version} of {self.path} is taken") from e
            raise

    # ---------------------------------------------------------------- reading
    def read(self, version: int | None = None, buckets: Sequence[str] | None = None) -> DataFrame:
        """The rows of a version (the last one), of some buckets only where these are given. A table never written has no columns."""
        m = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(m.schema)) if m.schema else T.StructType()
        paths = [f"{self.path}/data/{f}/{BUCKET}={b}" for b, fs in m.buckets.items() if buckets is None or b in buckets for f in fs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def done(self, txn: Txn) -> bool:
        return self.manifest().txn.get(txn[0], -1) >= txn[1]

    # ---------------------------------------------------------------- writing
    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """(the new folder, the buckets in it)."""
        name = uuid.uuid4().hex
        rows.withColumn(BUCKET, self.bucket).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        at = self._path(f"data/{name}")
        return name, [s.getPath().getName().split("=", 1)[1] for s in self.fs.listStatus(at) if "=" in s.getPath().getName()]

    def _attempt(self, change: Callable[[Manifest], Manifest | None], txn: Txn | None, tries: int = 5) -> bool:
        """Commit ``change`` of the newest version; made again where another writer came first."""
        for i in range(tries):
            m = self.manifest()
            if txn and m.txn.get(txn[0], -1) >= txn[1]:
                return False
            new = change(m)
            if new is None:
                return False
            new.version = m.version + 1
            if txn:
                new.txn = m.txn | {txn[0]: txn[1]}
            try:
                self.commit(new)
                return True
            except Conflict:
                if i == tries - 1:
                    raise
        return False

    def _columns(self, m: Manifest, rows: DataFrame) -> str:
        """The table's columns and then those that only ``rows`` has; all may be null."""
        old = T.StructType.fromJson(json.loads(m.schema)).fields if m.schema else []
        names = {f.name for f in old}
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in [*old, *(f for f in rows.schema.fields if f.name not in names)]]).json()

    def append(self, rows: DataFrame, txn: Txn | None = None) -> bool:
        """Add rows and touch nothing else; for raw records that never change."""

        def change(m: Manifest) -> Manifest:
            name, touched = self._write(rows)
            return Manifest(0, self._columns(m, rows), m.buckets | {b: [*m.buckets.get(b, []), name] for b in touched}, m.txn)

        return self._attempt(change, txn)

    def merge(self, rows: DataFrame, txn: Txn | None = None, combine: dict[str, Combine] | None = None, scope: Sequence[str] = (), keep: Column | None = None) -> bool:
        """Upsert by key: a column's new value where it is not null, else the old one, or what ``combine`` says for rows on both sides.

        With ``scope`` (some key columns), old rows with the same scope as a new one are replaced as a whole. With
        ``keep``, rows of the touched buckets that it is not true of go.
        """
        held = rows.withColumn(BUCKET, self.bucket).persist()
        try:
            touched = [r[0] for r in held.select(BUCKET).distinct().collect()]  # windows of one batch

            def change(m: Manifest) -> Manifest | None:
                if not touched:
                    return Manifest(0, self._columns(m, rows), m.buckets, m.txn) if txn else None
                new, schema = held.drop(BUCKET), self._columns(m, rows)
                if any(b in m.buckets for b in touched):
                    old = self.read(m.version, touched)
                    if scope:
                        there = new.select(*scope).distinct()
                        new = old.join(there, self._same(old, there, scope), "left_anti").unionByName(new, allowMissingColumns=True)
                    else:
                        new = self._merged(old, new, combine or {})
                name, got = self._write(new if keep is None else new.filter(keep))
                kept = {b: f for b, f in m.buckets.items() if b not in touched}
                return Manifest(0, schema, kept | {b: [name] for b in got}, m.txn)

            return self._attempt(change, txn)
        finally:
            held.unpersist()

    @staticmethod
    def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
        same = F.lit(True)
        for k in keys:
            same = same & a[k].eqNullSafe(b[k])
        return same

    def _merged(self, old: DataFrame, new: DataFrame, combine: dict[str, Combine]) -> DataFrame:
        o, n = old.withColumn("__there", F.lit(True)).alias("o"), new.withColumn("__there", F.lit(True)).alias("n")
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        both = F.col("o.__there") & F.col("n.__there")
        names = [*old.columns, *(c for c in new.columns if c not in old.columns)]

        def value(c: str) -> Column:
            sides = [F.col(f"{a}.{c}") for a, d in (("n", new), ("o", old)) if c in d.columns]
            plain = F.coalesce(*sides)
            return F.when(both, combine[c](lambda x: F.col(f"o.{x}"), lambda x: F.col(f"n.{x}"))).otherwise(plain) if c in combine and len(sides) == 2 else plain

        return o.join(n, same, "full").select(*[value(c).alias(c) for c in names])

    def delete_before(self, cutoff: str, column: str = "window_start") -> int:
        """Really delete rows whose ``column`` is before ``cutoff`` (same form of text); returns their number.

        For hourly buckets: those before the cutoff's go whole, its own is rewritten. Nulls stay.
        """
        edge = "".join(x for x in cutoff if x.isdigit())[:10]
        gone = 0

        def change(m: Manifest) -> Manifest | None:
            nonlocal gone
            old = [b for b in m.buckets if b.isdigit() and b <= edge]
            if not old:
                return None
            rows = self.read(m.version, old)
            late = F.coalesce(F.col(column).cast("string") < F.lit(cutoff), F.lit(False))
            gone, kept = rows.agg(F.count_if(late), F.count_if(~late)).first()
            if not gone:
                return None
            buckets = {b: f for b, f in m.buckets.items() if b not in old}
            if kept:
                name, touched = self._write(rows.filter(~late))
                buckets |= {b: [name] for b in touched}
            return Manifest(0, m.schema, buckets, m.txn)

        return gone if self._attempt(change, None) else 0

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the last ``keep`` versions and the buckets that none of these lists from disk; returns the number of bucket folders."""
        found = self.versions()
        last = found[-keep:]
        used = {(f, b) for v in last for b, fs in self.manifest(v).buckets.items() for f in fs}
        for v in found[: len(found) - len(last)]:
            self.fs.delete(self._path(f"_manifests/{v:020d}.json"), False)
        data, n = self._path("data"), 0
        for s in self.fs.listStatus(data) if self.fs.exists(data) else []:
            name = s.getPath().getName()
            inside = [x.getPath() for x in self.fs.listStatus(s.getPath()) if "=" in x.getPath().getName()]
            gone = [p for p in inside if (name, p.getName().split("=", 1)[1]) not in used]
            for p in gone if len(gone) < len(inside) else [s.getPath()]:
                self.fs.delete(p, True)
            n += len(gone)
        return n


def retain_all(tables: dict[str, SnapshotTable], now: str, hours: int = 24, keep: int = 2) -> dict[str, int]:
    """Delete what is older than ``hours`` from every table of windows; rows deleted by table."""
    from datetime import datetime, timedelta

    cutoff = (datetime.fromisoformat(now) - timedelta(hours=hours)).strftime("%Y-%m-%d %H:%M:%S")
    out = {}
    for name, t in tables.items():
        out[name] = t.delete_before(cutoff)
        t.vacuum(keep)
    return out
