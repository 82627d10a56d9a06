"""Writing results of streams and batches: column-wise upsert, retention, exports, health."""

from __future__ import annotations

import socket
import sqlite3
import time
import uuid
from collections import deque
from collections.abc import Callable, Sequence
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..schema import RESULT_KEYS


def upsert(new: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Merge rows into a Parquet table by key: a column's new value where it is not null, else the old one.

    Columns only one side has are kept. The merged table is written beside the old one and swapped in: the old
    one is set aside, the new one takes its place, and only then does the old one go. A crash in between
    leaves a whole table under ``path`` or beside it, and the next call puts that one back first.
    """
    spark = new.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    if fs.exists(aside) and not fs.exists(target):
        fs.rename(aside, target)
    fs.delete(aside, True)
    merged = new
    if fs.exists(target):
        old = spark.read.parquet(path)
        names = [*old.columns, *(c for c in new.columns if c not in old.columns)]
        o, n = old.alias("o"), new.alias("n")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        sides = {c: [F.col(f"{a}.{c}") for a, d in (("n", new), ("o", old)) if c in d.columns] for c in names}
        merged = o.join(n, same, "full").select(*[F.coalesce(*s).alias(c) for c, s in sides.items()])
    temp = jvm.org.apache.hadoop.fs.Path(f"{path}.next")
    merged.write.mode("overwrite").parquet(f"{path}.next")
    if fs.exists(target):
        fs.rename(target, aside)
    fs.rename(temp, target)
    fs.delete(aside, True)


def upsert_sqlite(new: DataFrame, db_path: str, table: str, keys: Sequence[str] | None = None) -> int:
    """Upsert a bounded serving result into SQLite in one transaction; rows come one partition at a time. Returns their number.

    A table that lacks a column of ``new`` gets it, null in its older rows.
    """
    keys = list(keys or RESULT_KEYS[table])
    cols = new.columns
    rest = [c for c in cols if c not in keys]
    con = sqlite3.connect(db_path, timeout=5)
    try:
        con.execute(f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(cols)}, updated_at, PRIMARY KEY ({', '.join(keys)}))")
        have = {r[1] for r in con.execute(f"PRAGMA table_info({table})")}
        for c in (c for c in cols if c not in have):
            con.execute(f"ALTER TABLE {table} ADD COLUMN {c}")
        sets = ", ".join([f"{c} = coalesce(excluded.{c}, {c})" for c in rest] + ["updated_at = excluded.updated_at"])
        sql = f"INSERT INTO {table} ({', '.join(cols)}, updated_at) VALUES ({', '.join('?' * (len(cols) + 1))}) ON CONFLICT ({', '.join(keys)}) DO UPDATE SET {sets}"
        now, n = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), 0
        with con:
            for r in new.toLocalIterator():
                con.execute(sql, (*r, now))
                n += 1
        return n
    finally:
        con.close()


def retain(df: DataFrame, now: str, hours: int = 24, column: str = "window_start") -> DataFrame:
    """Rows not older than ``hours`` before ``now``."""
    return df.filter(F.col(column).cast("timestamp") >= F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)))


def start_sink(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", trigger_s: int | None = 5):
    """One query with a checkpoint of its own; without ``trigger_s`` it takes what is there and ends."""
    w = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if trigger_s is None else w.trigger(processingTime=f"{trigger_s} seconds")).start()


def finished(df: DataFrame) -> DataFrame:
    """Run an aggregating stream over all that is there and return its whole result, kept in the shared folder."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    root = f"{root}/streams/{uuid.uuid4().hex}"
    q = start_sink(df, lambda b, _: b.write.mode("overwrite").parquet(f"{root}/out"), f"{root}/checkpoint", "complete", None)
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def appended(df: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there and return the rows it gave, each batch through ``each``, kept in the shared folder."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    root = f"{root}/streams/{uuid.uuid4().hex}"
    # A batch that runs twice writes the same folder.
    q = start_sink(df, lambda b, i: (each(b) if each else b).write.mode("overwrite").parquet(f"{root}/out/batch={i}"), f"{root}/checkpoint", mode, None)
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")


def csv_files(df: DataFrame, path: str, checkpoint: str, max_records: int = 100_000, trigger_s: int = 60):
    """A stream as CSV files of bounded size, a set each trigger; closed files are never touched again."""
    return df.writeStream.format("csv").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", max_records).trigger(processingTime=f"{trigger_s} seconds").start()


class TcpLines:
    """A ``foreach`` writer of lines to a socket: reconnects with growing pauses, keeps the newest ``buffer`` lines meanwhile and counts the rest."""

    def __init__(self, host: str, port: int, buffer: int = 1000, timeout: float = 2.0):
        self.host, self.port, self.buffer, self.timeout = host, port, buffer, timeout

    def open(self, partition_id: int, epoch_id: int) -> bool:
        self.waiting: deque[str] = deque(maxlen=self.buffer)
        self.dropped, self.pause, self.next_try, self.socket = 0, 0.5, 0.0, None
        return True

    def process(self, row) -> None:
        self.dropped += len(self.waiting) == self.buffer
        self.waiting.append(",".join("" if v is None else str(v) for v in row))
        self.flush()

    def flush(self) -> None:
        if self.socket is None and time.monotonic() >= self.next_try:
            try:
                self.socket, self.pause = socket.create_connection((self.host, self.port), self.timeout), 0.5
            except OSError:
                self.next_try, self.pause = time.monotonic() + self.pause, min(8.0, self.pause * 2)
        while self.socket is not None and self.waiting:
            try:
                self.socket.sendall((self.waiting[0] + "\n").encode())
                self.waiting.popleft()
            except OSError:
                self.socket.close()
                self.socket = None

    def close(self, error) -> None:
        self.next_try = 0.0
        self.flush()
        if self.socket is not None:
            self.socket.close()


def dead_letters(df: DataFrame, path: str, reason: str) -> None:
    """Rejected rows by day and reason."""
    df.withColumns({"dt": F.to_date(F.current_timestamp()), "reason": F.col(reason)}).write.mode("append").partitionBy("dt", "reason").parquet(path)


def export_tables(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> None:
    """Each table as JSON lines, nulls kept."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{root}/{name}")


class Health(StreamingQueryListener):
    """Batch duration, rows, lag and rows dropped behind the watermark of every micro-batch."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def onQueryStarted(self, event) -> None: ...  # noqa: N802

    def onQueryIdle(self, event) -> None: ...  # noqa: N802

    def onQueryTerminated(self, event) -> None: ...  # noqa: N802

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        seen = (p.eventTime or {}).get("max")
        lag = max(0.0, (datetime.fromisoformat(p.timestamp) - datetime.fromisoformat(seen)).total_seconds()) if seen else 0.0
        for metric, value in (("lag_s", lag), ("batch_duration_s", p.batchDuration / 1000), ("input_rows", p.numInputRows), ("late_rows", late)):
            self.rows.append({"ts": p.timestamp, "component": p.name or str(p.id), "metric": metric, "value": float(value)})


def write_report(report: dict, destination: str) -> None:
    """A small JSON report, whole or not at all."""
    import json

    target = Path(destination)
    temp = target.with_suffix(".tmp")
    temp.write_text(json.dumps(report, sort_keys=True, default=str))
    temp.replace(target)
