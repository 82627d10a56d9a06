"""Alerts over a stream: windows are judged once, when they are closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import alerts, windows
from .dispatch import Context
from .sinks import start_sink
from .tables import SnapshotTable


def alert_table(spark, root: str, kind: str) -> SnapshotTable:
    """``spikes`` or ``sources``."""
    return SnapshotTable(spark, f"{root}/alerts_{kind}", ("alert_id",))


def start_alerts(valid: DataFrame, root: str, length_s: int = 10, watermark_s: int = 30, config: alerts.AlertConfig = alerts.AlertConfig(), trigger_s: int | None = 5) -> list[StreamingQuery]:
    """Two queries in append mode, which see a window only when the watermark has passed it.

    The spike rule goes on from the baseline that the windows before left, so a batch looks at its own windows only; the
    baseline is committed with the batch's id after the alerts, and a batch that runs twice gives the same alerts
    under the same ids. Source rules look at the batch alone. The cooldown counts from the alerts of the last ``cooldown_s``.
    """
    keys = ("window_start", "window_len_s")

    def cool(found: DataFrame, table: SnapshotTable) -> DataFrame:
        """Those not within the cooldown of one that was let through before."""
        first = found.agg(F.min("window_start")).first()[0]
        if first is None or not table.versions():
            return alerts.cooled(found, config.cooldown_s)
        recent = F.unix_seconds(F.to_timestamp("window_start")) >= F.unix_seconds(F.to_timestamp(F.lit(first))) - config.cooldown_s
        old = table.read().filter(recent & (F.col("window_start") < first)).select(*found.columns)
        return alerts.cooled(old.unionByName(found), config.cooldown_s)

    def on_metrics(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        spark, ctx = batch.sparkSession, Context(batch.sparkSession, root, batch_id)
        try:
            if not batch.take(1):
                return
            SnapshotTable(spark, f"{root}/window_metrics", keys).merge(batch, ctx.txn("metrics"))
            carry = SnapshotTable(spark, f"{root}/baseline", ("series",), F.lit("all"))
            if carry.done(ctx.txn("spikes")):
                return
            was = carry.read().first() if carry.versions() else None
            start = (was["baseline"], was["counted"]) if was else (0.0, 0)
            table = alert_table(spark, root, "spikes")
            table.merge(alerts.named(cool(alerts.spikes(batch, config, start), table)), ctx.txn("spikes"))
            base, counted = alerts.baseline_after(batch, config, start)
            carry.merge(spark.createDataFrame([("all", float(base), int(counted))], "series string, baseline double, counted long"), ctx.txn("spikes"))
        finally:
            batch.unpersist()

    def on_sources(batch: DataFrame, batch_id: int) -> None:
        spark, ctx = batch.sparkSession, Context(batch.sparkSession, root, batch_id)
        found = alerts.source_rules(batch, config).persist()
        try:
            table = alert_table(spark, root, "sources")
            if found.take(1) and not table.done(ctx.txn("sources")):
                table.merge(alerts.named(cool(found, table)), ctx.txn("sources"))
        finally:
            found.unpersist()

    return [
        start_sink(windows.window_metrics(valid, length_s, watermark_s), on_metrics, f"{root}/c_metrics", "append", trigger_s),
        start_sink(windows.source_stats(valid, length_s, watermark_s), on_sources, f"{root}/c_sources", "append", trigger_s),
    ]
