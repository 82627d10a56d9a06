"""Storage layout, and reading what was served: tables, the newest window, SQLite results, dashboards' packs."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PACKET_SCHEMA


@dataclass(frozen=True)
class Layout:
    """Zones below one root, local or on any store Spark reads: stream_in, raw (dt=/hr=), historical, checkpoints, serving."""

    root: str

    def zone(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def zones(self) -> dict[str, str]:
        return {n: self.zone(n) for n in ("stream_in", "raw", "historical", "checkpoints", "serving", "dead_letters")}

    def create(self, spark: SparkSession) -> dict[str, str]:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for z in self.zones.values():
            path = jvm.org.apache.hadoop.fs.Path(z)
            path.getFileSystem(conf).mkdirs(path)
        return self.zones


def hdfs_path(authority: str, *parts: str) -> str:
    return f"hdfs://{authority}/" + "/".join(p.strip("/") for p in parts)


LISTING = re.compile(r"^(?P<kind>[d-])\S+\s+\S+\s+\S+\s+\S+\s+(?P<size>\d+)\s+(?P<day>\d{4}-\d{2}-\d{2})\s+(?P<time>\d{2}:\d{2})\s+(?P<path>.+)$")


def eligible_files(listing: Iterable[str], cutoff: datetime, root: str) -> list[str]:
    """Files of a directory listing below ``root`` older than ``cutoff``; folders, hidden and temporary files stay."""
    out = []
    for line in listing:
        m = LISTING.match(line.strip())
        if not m or m["kind"] == "d" or not m["path"].startswith(root.rstrip("/") + "/"):
            continue
        name = m["path"].rsplit("/", 1)[-1]
        if not name.startswith(".") and not name.endswith(".tmp") and datetime.fromisoformat(f"{m['day']} {m['time']}") < cutoff.replace(tzinfo=None):
            out.append(m["path"])
    return out


def register_raw(spark: SparkSession, name: str, root: str) -> None:
    """A table over raw CSV partitioned by dt and hr; partitions that are there are added."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in PACKET_SCHEMA.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}, dt STRING, hr STRING) USING csv PARTITIONED BY (dt, hr) LOCATION '{root}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")


def latest(df: DataFrame, column: str = "window_start") -> DataFrame:
    """Rows of the newest window."""
    top = df.agg(F.max(column).alias("__top"))
    return df.join(F.broadcast(top), F.col(column) == F.col("__top")).drop("__top")  # one row


def read_sqlite(spark: SparkSession, db_path: str, table: str, since: str | None = None, column: str = "window_start") -> DataFrame:
    """A served table, read only; times are compared as times, so either text form works."""
    con = sqlite3.connect(f"file:{Path(db_path).resolve()}?mode=ro", uri=True, timeout=5)
    try:
        cur = con.execute(f"SELECT * FROM {table}" + (f" WHERE julianday({column}) >= julianday(?)" if since else ""), (since,) if since else ())
        names, rows = [d[0] for d in cur.description], cur.fetchall()
    finally:
        con.close()
    kinds = {int: "bigint", float: "double"}
    types = [next((kinds.get(type(r[i]), "string") for r in rows if r[i] is not None), "string") for i in range(len(names))]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True)))


def pack(metrics: DataFrame, edges: DataFrame, stats: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """What a dashboard shows, from real tables: the newest rates, top talkers, destinations and ports by source."""
    talkers = stats.groupBy("src_ip").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes")).orderBy(F.desc("packets"), "src_ip").limit(k)
    fan = edges.groupBy("src_ip").agg(F.count_distinct("dst_ip").alias("destinations")).orderBy(F.desc("destinations"), "src_ip").limit(k)
    ports = stats.groupBy("src_ip").agg(F.max("unique_dst_ports").alias("ports")).orderBy(F.desc("ports"), "src_ip").limit(k)
    return {"rates": latest(metrics), "talkers": talkers, "fan_out": fan, "ports": ports}


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_dataset(df: DataFrame, path: str) -> None:
    """Packets as contract CSV in ``path`` and their ground truth as JSON beside it."""
    from ..operators.history import ground_truth

    df.select(*PACKET_SCHEMA.names).write.mode("overwrite").csv(path)
    ground_truth(df).coalesce(1).write.mode("overwrite").json(f"{path}.truth")
