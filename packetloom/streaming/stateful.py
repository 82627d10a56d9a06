"""Order-dependent state over streams: DGIM counting, decaying scores, spike baselines, reservoirs.

Each works on one key at a time with state in Spark's store, so that it survives restarts; rows of a
micro-batch are taken in (event_time, event_id) order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.alerts import AlertConfig
from ..operators.cleaning import DEFAULT_PREDICATES, FilterSpec
from ..operators.sketches import ones


class Dgim:
    """Datar-Gionis-Indyk-Motwani: buckets (last time, size), newest first, two of a size at most."""

    def __init__(self, window_n: int = 1000, t: int = 0, buckets: list[tuple[int, int]] | None = None):
        if window_n <= 0:
            raise ValueError("window_n must be positive")
        self.window_n, self.t, self.buckets = window_n, t, list(buckets or [])

    def update(self, bit: int) -> None:
        self.t += 1
        while self.buckets and self.buckets[-1][0] <= self.t - self.window_n:
            self.buckets.pop()
        if not bit:
            return
        b = self.buckets
        b.insert(0, (self.t, 1))
        i = 0
        while i + 2 < len(b) and b[i][1] == b[i + 1][1] == b[i + 2][1]:
            b[i + 1 : i + 3] = [(b[i + 1][0], 2 * b[i + 1][1])]
            i += 1

    def query(self, k: int | None = None) -> int:
        """Ones among the last ``k`` bits: whole buckets, and half of the oldest that overlaps."""
        k = min(k or self.window_n, self.window_n)
        inside = [b for b in self.buckets if b[0] > self.t - k]
        return sum(s for _, s in inside[:-1]) + inside[-1][1] // 2 if inside else 0

    def snapshot(self) -> str:
        return json.dumps([self.window_n, self.t, self.buckets])

    @staticmethod
    def restore(text: str) -> Dgim:
        n, t, b = json.loads(text)
        return Dgim(n, t, [tuple(x) for x in b])


def counting_ones_dgim(df: DataFrame, window_n: int = 1000, predicates: tuple[FilterSpec, ...] = DEFAULT_PREDICATES) -> DataFrame:
    """Batch: DGIM and exact counts over the last ``window_n`` packets by predicate.

    What is older than the window cannot matter to either, so only the last packets are taken, by a top-n.
    """
    from pyspark.sql import functions as F

    last = df.orderBy(F.desc("event_time"), F.desc("event_id")).limit(window_n)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["event_time", "event_id"])
        d = Dgim(window_n)
        for bit in pdf["bit"]:
            d.update(int(bit))
        exact, est = int(pdf["bit"].sum()), d.query()
        err = abs(est - exact) / exact * 100 if exact else 0.0
        return pd.DataFrame([(pdf["predicate_name"].iloc[0], len(pdf), exact, est, round(err, 2))], columns=["predicate_name", "window_n", "exact_ones", "dgim_estimate", "err_pct"])

    return ones(last, predicates).groupBy("predicate_name").applyInPandas(run, "predicate_name string, window_n long, exact_ones long, dgim_estimate long, err_pct double")


def stream_dgim(df: DataFrame, window_n: int = 1000, predicates: tuple[FilterSpec, ...] = DEFAULT_PREDICATES) -> DataFrame:
    """Stream: the DGIM estimate by predicate after each micro-batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = Dgim.restore(state.get[0]) if state.exists else Dgim(window_n)
        for bit in pd.concat(list(batches)).sort_values(["event_time", "event_id"])["bit"]:
            d.update(int(bit))
        state.update((d.snapshot(),))
        yield pd.DataFrame([(key[0], d.t, d.query())], columns=["predicate_name", "seen", "dgim_estimate"])

    return ones(df, predicates).groupBy("predicate_name").applyInPandasWithState(step, "predicate_name string, seen long, dgim_estimate long", "s string", "update", GroupStateTimeout.NoTimeout)


def stream_decay(df: DataFrame, key: str, half_life_s: float) -> DataFrame:
    """Stream: the decayed count of each key at its last event; late packets count with their own weight."""
    if half_life_s <= 0:
        raise ValueError("half-life must be positive")

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score, last = state.get if state.exists else (0.0, None)
        for t in pd.concat(list(batches))["t"].sort_values():
            if last is None or t >= last:
                score = score * 2 ** (-((t - last) if last is not None else 0.0) / half_life_s) + 1
                last = float(t)
            else:
                score += 2 ** (-(last - t) / half_life_s)
        state.update((score, last))
        yield pd.DataFrame([(str(k[0]), score, last)], columns=["key", "score", "last"])

    from pyspark.sql import functions as F

    d = df.select(F.col(key).cast("string").alias("key"), (F.unix_micros("event_time") / 1e6).alias("t")).filter("key is not null")
    return d.groupBy("key").applyInPandasWithState(step, "key string, score double, last double", "score double, last double", "update", GroupStateTimeout.NoTimeout)


def stream_spikes(metrics: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """Stream: the spike rule over closed windows (window_start, pps), one series, with cooldown in event time."""

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base, n, last = state.get if state.exists else (0.0, 0, None)
        out = []
        for w, pps in pd.concat(list(batches)).sort_values("window_start")[["window_start", "pps"]].itertuples(index=False):
            if pps < config.min_pps:
                continue
            if not n:
                base, n = pps, 1
                continue
            old, base = base, config.alpha * pps + (1 - config.alpha) * base
            n += 1
            if n >= config.warmup_windows and pps >= config.warn_multiplier * old:
                at = pd.Timestamp(w).timestamp()
                if last is None or at - last >= config.cooldown_s:
                    last = at
                    out.append((w, "CRITICAL" if pps >= config.critical_multiplier * old else "WARN", pps, base))
        state.update((float(base), int(n), last))
        yield pd.DataFrame(out, columns=["window_start", "severity", "observed", "baseline"])

    from pyspark.sql import functions as F

    m = metrics.select("window_start", F.col("pps").cast("double").alias("pps")).withColumn("one", F.lit(1))
    return m.groupBy("one").applyInPandasWithState(step, "window_start string, severity string, observed double, baseline double", "base double, n long, last double", "append", GroupStateTimeout.NoTimeout)


def stream_reservoir(df: DataFrame, key: str, k: int = 1000, seed: int = 42) -> DataFrame:
    """Stream: the keys of the least priorities so far, kept in 16 parts of state whose union is cut when read."""
    from pyspark.sql import functions as F

    from ..operators.sketches import priority

    if k <= 0:
        raise ValueError("k must be positive")

    def step(part: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have = json.loads(state.get[0]) if state.exists else []
        for b in batches:
            have = sorted({*map(tuple, have), *b[["p", "key"]].itertuples(index=False, name=None)})[:k]
        state.update((json.dumps(have),))
        yield pd.DataFrame(have, columns=["p", "key"]).assign(part=part[0])[["part", "p", "key"]]

    p = priority(F.col(key), seed)
    d = df.select(p.alias("p"), F.col(key).cast("string").alias("key"), F.pmod(F.xxhash64(p), F.lit(16)).cast("int").alias("part"))
    return d.groupBy("part").applyInPandasWithState(step, "part int, p string, key string", "s string", "update", GroupStateTimeout.NoTimeout)
