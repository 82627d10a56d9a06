"""One fan-out for what works by micro-batch: each batch is held once, every plugin has it, none can stop another."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import net
from ..operators import alerts, itemsets, sketches
from ..schema import COLUMNS, RESULT_KEYS
from .sinks import start_sink
from .tables import SnapshotTable, by_hash, by_hour

log = logging.getLogger(__name__)


@dataclass
class Context:
    """What a plugin works with: its tables by name, and the batch's id."""

    spark: SparkSession
    root: str
    batch_id: int
    watermark_s: int = 30
    newest: object = None

    def table(self, name: str, keys: Sequence[str] = (), bucket: Column | None = None) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.root}/{name}", keys or RESULT_KEYS.get(name, ()), bucket)

    def txn(self, plugin: str) -> tuple[str, int]:
        """The plugin in this query, by the id in its checkpoint, and the batch: a new query begins at batch 0 again."""
        query = self.spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        return f"{plugin}@{query}" if query else plugin, self.batch_id


@dataclass(frozen=True)
class Plugin:
    """``run`` gets the valid packets of a batch (all rows where ``invalid``) and writes tables under its own batch id."""

    name: str
    run: Callable[[DataFrame, Context], None]
    invalid: bool = False


@dataclass
class Dispatcher:
    """A foreachBatch function: runs every plugin over the held batch and records how it went.

    A plugin that raises is logged, counted as plugin_error and listed in the table plugin_errors; the others go on and so does
    the query. Plugins commit under the batch's id, so a batch that comes again after a crash changes nothing that it had
    changed, health included. After ``slow_after`` batches in a row that took longer than the trigger there is a warning.
    """

    plugins: Sequence[Plugin]
    root: str
    trigger_s: float = 5.0
    watermark_s: int = 30
    slow_after: int = 3
    component: str = "dispatcher"
    slow: int = field(default=0, init=False)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        began = time.time()
        batch = batch.persist()
        try:
            rows, invalid, newest = batch.agg(F.count(F.lit(1)), F.count_if(~F.col("is_valid")), F.max(F.when(F.col("is_valid"), F.col("event_time")))).first()
            ctx = Context(batch.sparkSession, self.root, batch_id, self.watermark_s, newest)
            errors = []
            for p in self.plugins:
                try:
                    p.run(batch if p.invalid else batch.filter("is_valid"), ctx)
                except Exception as e:
                    log.exception("plugin %s failed on batch %d", p.name, batch_id)
                    errors.append((p.name, batch_id, f"{type(e).__name__}: {e}"[:1000]))
        finally:
            batch.unpersist()
        took = time.time() - began
        self.slow = self.slow + 1 if took > self.trigger_s else 0
        if self.slow >= self.slow_after:
            log.warning("batch %d took %.1f s, trigger %.1f s, %d slow batches in a row", batch_id, took, self.trigger_s, self.slow)
        self.record(ctx, errors, {"batch_duration_s": took, "input_rows": rows, "invalid_rows": invalid, "lag_s": max(0.0, began - newest.timestamp()) if newest else 0.0, "plugin_error": len(errors), "slow_batches": self.slow})

    def record(self, ctx: Context, errors: list[tuple], metrics: dict[str, float]) -> None:
        ts = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())
        if errors:
            e = ctx.spark.createDataFrame([(ts, *x) for x in errors], "ts string, plugin string, batch_id long, error string")
            ctx.table("plugin_errors", bucket=by_hour("ts")).append(e, ctx.txn("plugin_errors"))
        h = ctx.spark.createDataFrame([(ts, f"{self.component}:{ctx.batch_id}", m, float(v)) for m, v in metrics.items()], "ts string, component string, metric string, value double")
        ctx.table("pipeline_health", bucket=by_hour("ts")).append(h, ctx.txn("pipeline_health"))


# ------------------------------------------------------------------ plugins
def sketch_plugin(length_s: int = 10, hashes: int = 30, groups: int = 5, seed: int = 42) -> Plugin:
    """Flajolet-Martin and second moments by window: a batch's sketches are merged into those there, then estimated."""

    def run(batch: DataFrame, ctx: Context) -> None:
        state = sketches.sketch_state(batch, length_s, hashes, seed).persist()
        try:
            held = ctx.table("sketch_state", ("window_start", "window_len_s"))
            merge = {"packets": lambda o, n: o("packets") + n("packets")}
            merge |= {f"{s}_fm": lambda o, n, s=s: sketches.merged_bitmaps(o(f"{s}_fm"), n(f"{s}_fm")) for s in ("src", "dst")}
            merge |= {f"{s}_z": lambda o, n, s=s: sketches.merged_sums(o(f"{s}_z"), n(f"{s}_z")) for s in ("src", "dst")}
            held.merge(state, ctx.txn("sketches"), merge)
            touched = held.read(buckets=[r[0] for r in state.select(by_hour()).distinct().collect()])
            if not touched.columns:
                return
            now = sketches.estimated(touched.join(state.select("window_start", "window_len_s"), ["window_start", "window_len_s"], "left_semi"), hashes, groups)
            ctx.table("distinct_counts").merge(now.select("window_start", "window_len_s", "src_ips_fm", "dst_ips_fm"), ctx.txn("sketches"))
            ctx.table("moments").merge(now.select("window_start", "window_len_s", F.col("dst_f2").alias("f2_ams"), F.col("src_f2").alias("src_f2_ams")), ctx.txn("sketches"))
        finally:
            state.unpersist()

    return Plugin("sketches", run)


def itemset_plugin(window_s: int = 60, slide_s: int = 10, slice_s: int = 1, min_support: float = 0.05) -> Plugin:
    """Rolling frequent itemsets: baskets gain the batch's items, and the windows that hold these baskets are ranked anew."""

    def run(batch: DataFrame, ctx: Context) -> None:
        new = itemsets.baskets(batch, slice_s).withColumn("at", F.date_format(F.timestamp_seconds("slice"), "yyyy-MM-dd HH:mm:ss")).persist()
        try:
            lo, hi = new.agg(F.min("slice"), F.max("slice")).first()
            if lo is None:
                return
            held = ctx.table("baskets", ("basket",), by_hour("at"))
            held.merge(new, ctx.txn("itemsets"), {"items": lambda o, n: F.array_sort(F.array_union(o("items"), n("items")))})
            hours = [time.strftime("%Y%m%d%H", time.gmtime(h * 3600)) for h in range((lo - window_s) // 3600, (hi + window_s) // 3600 + 1)]
            near = held.read(buckets=hours).filter(F.col("slice").between(lo - window_s, hi + window_s))
            found = itemsets.rolling_of(near, window_s, slide_s, min_support)
            touched = new.select(F.date_format(F.window(F.timestamp_seconds("slice"), f"{window_s} seconds", f"{slide_s} seconds")["start"], "yyyy-MM-dd HH:mm:ss").alias("window_start")).distinct()
            found = found.join(touched, "window_start", "left_semi").withColumns({"window_len_s": F.lit(window_s), "algorithm": F.lit("apriori")})
            ctx.table("frequent_itemsets").merge(found, ctx.txn("itemsets"), scope=("window_start",))
        finally:
            new.unpersist()

    return Plugin("itemsets", run)


def decay_plugin(keys: Sequence[str] = ("dst_ip", "dst_port"), half_lives_s: Sequence[float] = (10, 30, 60), epsilon: float = 1e-4, buckets: int = 16) -> Plugin:
    """Decayed counts of keys: a batch's are added to those there as of the later moment; those under ``epsilon`` go."""

    def run(batch: DataFrame, ctx: Context) -> None:
        if ctx.newest is None:
            return
        t = F.unix_micros("event_time") / F.lit(1e6)
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("key_type"), F.col(k).cast("string").alias("key")) for k in keys])).alias("k")
        lives = F.explode(F.array(*[F.lit(float(h)) for h in half_lives_s])).alias("half_life_s")
        now = F.unix_micros(F.lit(ctx.newest)) / F.lit(1e6)
        d = batch.select(t.alias("t"), each).filter("k.key is not null").select("t", "k.*").select("*", lives)
        score = F.sum(F.pow(F.lit(2.0), -(now - F.col("t")) / F.col("half_life_s")))
        new = d.groupBy("key_type", "key", "half_life_s").agg(score.alias("score")).withColumn("at", now)

        def aged(row: Callable[[str], Column], at: Column) -> Column:
            return row("score") * F.pow(F.lit(2.0), -(at - row("at")) / row("half_life_s"))

        merge = {"score": lambda o, n: aged(o, F.greatest(o("at"), n("at"))) + aged(n, F.greatest(o("at"), n("at"))), "at": lambda o, n: F.greatest(o("at"), n("at"))}
        live = F.col("score") * F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), now - F.col("at")) / F.col("half_life_s")) >= epsilon
        ctx.table("decay_keys", ("key_type", "key", "half_life_s"), by_hash("key", buckets)).merge(new, ctx.txn("decay"), merge, keep=live)

    return Plugin("decay", run)


def spike_plugin(length_s: int = 10, config: alerts.AlertConfig = alerts.AlertConfig()) -> Plugin:
    """Traffic spikes: a batch's packets are added to its windows; those that the watermark has passed are judged once, in
    order, from the baseline kept with the last one judged. Packets of judged windows are late and change nothing more."""

    def run(batch: DataFrame, ctx: Context) -> None:
        if ctx.newest is None:
            return
        start = F.date_format(F.window("event_time", f"{length_s} seconds")["start"], "yyyy-MM-dd HH:mm:ss")
        new = batch.groupBy(start.alias("window_start")).agg(F.count(F.lit(1)).alias("packets"))
        held = ctx.table("spike_windows", ("window_start",))
        held.merge(new, ctx.txn("spikes"), {"packets": lambda o, n: o("packets") + n("packets")})
        state = ctx.table("spike_baseline", ("series",), F.lit("all"))
        if state.done(ctx.txn("spikes")):
            return
        was = state.read().first() if state.versions() else None
        end = F.timestamp_seconds(F.unix_seconds(F.to_timestamp("window_start")) + length_s)
        closed = held.read().filter(end <= F.lit(ctx.newest) - F.make_dt_interval(secs=F.lit(ctx.watermark_s)))
        closed = closed.filter(F.col("window_start") > was["judged"]) if was else closed
        pps = closed.select("window_start", F.round(F.col("packets") / length_s, 6).alias("pps"))
        last = pps.agg(F.max("window_start")).first()[0]
        if last is None:
            return
        begin = (was["baseline"], was["counted"]) if was else (0.0, 0)
        found = alerts.named(alerts.spikes(pps, config, begin))
        ctx.table("alerts").merge(found, ctx.txn("spikes"))
        base, counted = alerts.baseline_after(pps, config, begin)
        row = ctx.spark.createDataFrame([("all", last, float(base), int(counted))], "series string, judged string, baseline double, counted long")
        state.merge(row, ctx.txn("spikes"))

    return Plugin("spikes", run)


def with_reason(cleaned: DataFrame) -> DataFrame:
    """Cleaned rows with the first rule of the contract that an invalid one breaks; null where the row is valid."""
    broken = F.coalesce(net.row_reason({c: F.col(c).cast("string") for c in COLUMNS}), F.lit("other"))
    return cleaned.withColumn("reason", F.when(~F.col("is_valid"), broken))


def dead_letter_plugin() -> Plugin:
    """Invalid rows with their reason, none lost, by hour of arrival."""

    def run(batch: DataFrame, ctx: Context) -> None:
        bad = batch if "reason" in batch.columns else with_reason(batch)
        bad = bad.filter("not is_valid").withColumn("seen_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
        ctx.table("dead_letters", bucket=by_hour("seen_at")).append(bad, ctx.txn("dead_letters"))

    return Plugin("dead_letters", run, invalid=True)


def bronze_plugin() -> Plugin:
    """Every row as it came, valid or not, appended by the hour of its event and never rewritten."""

    def run(batch: DataFrame, ctx: Context) -> None:
        at = F.coalesce(F.date_format("event_time", "yyyyMMddHH"), F.lit("none"))
        ctx.table("bronze", bucket=at).append(batch, ctx.txn("bronze"))

    return Plugin("bronze", run, invalid=True)


def default_plugins() -> list[Plugin]:
    return [bronze_plugin(), dead_letter_plugin(), sketch_plugin(), itemset_plugin(), decay_plugin(), spike_plugin()]


def observed(cleaned: DataFrame, name: str = "cleaning") -> DataFrame:
    """Cleaned rows with their reason; how many are valid, invalid, and invalid for which reason is observed inside the running query."""
    d = with_reason(cleaned)
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("is_valid")).alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid")]
    return d.observe(name, *counts, *[F.count_if(F.col("reason") == r).alias(f"reason_{r}") for r in (*COLUMNS, "other")])


def start_dispatcher(cleaned: DataFrame, root: str, checkpoint: str, plugins: Sequence[Plugin] | None = None, trigger_s: int | None = 5, watermark_s: int = 30) -> StreamingQuery:
    """The query that feeds the plugins; ``cleaned`` has event_time and is_valid."""
    d = Dispatcher(default_plugins() if plugins is None else plugins, root, trigger_s or 5.0, watermark_s)
    return start_sink(observed(cleaned), d, checkpoint, "append", trigger_s)
