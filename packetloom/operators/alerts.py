"""Alerts: a spike against an exponentially weighted baseline, port scans, fan-out, and a cooldown in event time."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AlertConfig:
    #: The rules' defaults.
    alpha: float = 0.1
    warmup_windows: int = 30
    warn_multiplier: float = 3.0
    critical_multiplier: float = 6.0
    min_pps: float = 50.0
    max_ports: int = 20
    max_dst_ips: int = 30
    cooldown_s: int = 60
    min_packets: int = 10


def load_config(path: str) -> AlertConfig:
    """Defaults overridden by the keys of a YAML file; a missing file gives the defaults."""
    import yaml

    p = Path(path)
    given = (yaml.safe_load(p.read_text()) or {}) if p.exists() else {}
    known = asdict(AlertConfig())
    return AlertConfig(**{k: type(known[k])(v) for k, v in given.items() if k in known})


#: Windows are scanned by a tree over their seconds since 1970: so many bits a level, up to 2**40 seconds.
LEVEL_BITS, LEVELS = 10, 4
#: An affine map x -> a x + b and the number of windows that made it.
MAP = "struct<a:double,b:double,n:long>"


def _map(a: Column, b: Column, n: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), n.alias("n"))


def _then(f: Column, g: Column) -> Column:
    """First ``f``, then ``g``."""
    return _map(g["a"] * f["a"], g["a"] * f["b"] + g["b"], f["n"] + g["n"])


def baseline_maps(metrics: DataFrame, config: AlertConfig, seen: int = 0) -> DataFrame:
    """(at, window_start, pps, m): what each window does to the baseline. Windows under min_pps are the identity, the
    first that counts (unless ``seen`` were counted before) sets it, every other moves it by alpha."""
    c = config
    d = metrics.select(F.unix_seconds(F.try_to_timestamp("window_start")).alias("at"), "window_start", F.col("pps").cast("double").alias("pps"))
    counts = F.coalesce(F.col("pps") >= c.min_pps, F.lit(False))
    moves = _map(F.lit(1 - c.alpha), F.lit(c.alpha) * F.col("pps"), F.lit(1).cast("long"))
    if not seen:
        first = d.filter(counts).agg(F.min(F.struct("at", "window_start", "pps")).alias("first"))
        d = d.join(F.broadcast(first))  # one row
        moves = F.when(F.struct("at", "window_start", "pps") == F.col("first"), _map(F.lit(0.0), F.col("pps"), F.lit(1).cast("long"))).otherwise(moves)
    return d.select("at", "window_start", "pps", F.when(counts, moves).otherwise(_map(F.lit(1.0), F.lit(0.0), F.lit(0).cast("long"))).cast(MAP).alias("m"))


def _levels(maps: DataFrame) -> list[DataFrame]:
    """The tree's nodes from the segments of windows up to one root: (id, kids, m), kids in order, at most 2**LEVEL_BITS seconds apart."""
    out, node, order = [], maps.withColumn("id", F.col("at")), ["at", "window_start", "pps"]
    identity = _map(F.lit(1.0), F.lit(0.0), F.lit(0).cast("long"))
    for _ in range(LEVELS):
        kids = F.array_sort(F.collect_list(F.struct(*order, "m"))).alias("kids")
        up = node.groupBy(F.shiftright("id", LEVEL_BITS).alias("id")).agg(kids)
        node = up.withColumn("m", F.aggregate("kids", identity, lambda f, k: _then(f, k["m"])))
        out.append(node)
        node, order = node.select("id", "m"), ["id"]
    return out


def baseline_after(metrics: DataFrame, config: AlertConfig = AlertConfig(), start: tuple[float, int] = (0.0, 0)) -> tuple[float, int]:
    """(baseline, windows counted) after all windows, from what ``start`` says was before them."""
    found = _levels(baseline_maps(metrics, config, start[1]))[-1].select("m").first()  # one root
    return (found["m"]["a"] * start[0] + found["m"]["b"], start[1] + found["m"]["n"]) if found else start


def baselines(metrics: DataFrame, config: AlertConfig = AlertConfig(), start: tuple[float, int] = (0.0, 0)) -> DataFrame:
    """(window_start, pps, before, counted): the baseline before each window and the windows counted up to then.

    An associative scan: maps of windows are composed by segments of time and these by segments again, then what
    came before is handed down. No task holds more windows than a segment has seconds, however long the series.
    """
    maps = baseline_maps(metrics, config, start[1])
    tree = _levels(maps)
    down = tree[-1].select("id", _map(F.lit(0.0), F.lit(float(start[0])), F.lit(int(start[1])).cast("long")).cast(MAP).alias("f"))
    for i, level in reversed(list(enumerate(tree))):

        def step(s: Column, k: Column) -> Column:
            return F.struct(_then(s["f"], k["m"]).alias("f"), F.concat(s["out"], F.array(s["f"])).alias("out"))

        whole = level.select("id", "kids").join(down, "id")
        begin = F.struct(F.col("f"), F.array().cast(f"array<{MAP}>").alias("out"))
        each = F.explode(F.arrays_zip("kids", F.aggregate("kids", begin, step)["out"].alias("before"))).alias("k")
        names = ("at", "window_start", "pps") if i == 0 else ("id",)
        down = whole.select(each).select(*[F.col(f"k.kids.{c}").alias(c) for c in names], F.col("k.before").alias("f"))
    return down.select("window_start", "pps", F.col("f.b").alias("before"), F.col("f.n").alias("counted"))


def spikes(metrics: DataFrame, config: AlertConfig = AlertConfig(), start: tuple[float, int] = (0.0, 0)) -> DataFrame:
    """Windows whose pps reaches a multiple of the baseline before it: (window_start, alert_type, severity, src_ip, observed, baseline, change_pct).

    Windows under min_pps leave the baseline as it is, the first sets it, and up to the warm-up it only learns. baseline is the
    one after the window, change_pct is against the one before. ``start`` is the baseline and the number of windows
    counted before these, so that a stream need not look at old windows again (see ``baseline_after``).
    """
    c, old, pps = config, F.col("before"), F.col("pps")
    hot = (pps >= c.min_pps) & (F.col("counted") > 0) & (F.col("counted") + 1 >= c.warmup_windows) & (pps >= c.warn_multiplier * old)
    level = F.when(pps >= c.critical_multiplier * old, "CRITICAL").otherwise("WARN")
    return baselines(metrics, config, start).filter(hot).select(
        "window_start", F.lit("TRAFFIC_SPIKE").alias("alert_type"), level.alias("severity"), F.lit(None).cast("string").alias("src_ip"), F.round(pps, 6).alias("observed"),
        F.round(F.lit(c.alpha) * pps + F.lit(1 - c.alpha) * old, 6).alias("baseline"), F.round(F.when(old > 0, (pps - old) / old * 100).otherwise(0.0), 6).alias("change_pct"),
    )


def source_rules(stats: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """Port scans (more than max_ports) and fan-out (more than max_dst_ips) of sources with min_packets; an unknown packet count passes."""
    s = stats.filter(F.coalesce("packets", F.lit(config.min_packets + 1)) >= config.min_packets)
    rules = F.array(
        F.struct(F.lit("UNUSUAL_PORT_ACTIVITY").alias("alert_type"), F.coalesce(F.col("unique_dst_ports").cast("double"), F.lit(0.0)).alias("observed"), F.lit(float(config.max_ports)).alias("baseline")),
        F.struct(F.lit("HIGH_FANOUT").alias("alert_type"), F.coalesce(F.col("unique_dst_ips").cast("double"), F.lit(0.0)).alias("observed"), F.lit(float(config.max_dst_ips)).alias("baseline")),
    )
    s = s.select("window_start", "src_ip", F.explode(rules).alias("r")).filter("r.observed > r.baseline")
    change = (F.col("r.observed") - F.col("r.baseline")) / F.col("r.baseline") * 100
    return s.select("window_start", "r.alert_type", F.lit("WARN").alias("severity"), "src_ip", "r.observed", "r.baseline", F.round(change, 6).alias("change_pct"))


def cooled(alerts: DataFrame, cooldown_s: int = 60) -> DataFrame:
    """Alerts not within ``cooldown_s`` of the last one let through of their type and source; folded by that key."""
    at = F.unix_seconds(F.try_to_timestamp("window_start"))
    rows = alerts.withColumn("__at", at).groupBy("alert_type", "src_ip").agg(F.array_sort(F.collect_list(F.struct("__at", *[c for c in alerts.columns if c not in ("alert_type", "src_ip")]))).alias("r"))

    def step(s: Column, x: Column) -> Column:
        free = s["last"].isNull() | (x["__at"] - s["last"] >= cooldown_s)
        return F.when(free, F.struct(x["__at"].alias("last"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s)

    start = F.struct(F.lit(None).cast("long").alias("last"), F.slice("r", 1, 0).alias("out"))
    kept = rows.select("alert_type", "src_ip", F.explode(F.aggregate("r", start, step)["out"]).alias("a"))
    return kept.select(*[F.col(c) if c in ("alert_type", "src_ip") else F.col(f"a.{c}") for c in alerts.columns])


def evaluate(metrics: DataFrame, stats: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """All rules over closed windows, cooled down, each with an id and its details as JSON."""
    return named(cooled(spikes(metrics, config).unionByName(source_rules(stats, config)), config.cooldown_s))


def named(a: DataFrame) -> DataFrame:
    """Alerts with an id made of type, source and window, and their figures as JSON."""
    key = F.concat_ws("|", "alert_type", F.coalesce("src_ip", F.lit("*")), "window_start")
    details = F.to_json(F.struct("observed", "baseline", "change_pct"))
    return a.withColumns({"alert_id": F.sha2(key, 256), "details_json": details})
