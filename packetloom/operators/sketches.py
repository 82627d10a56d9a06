"""Samples, sketches and decaying scores as mergeable aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import DEFAULT_PREDICATES, FilterSpec

PHI = 0.77351
PRIME = 2**31 - 1


# ------------------------------------------------------------------ samples
def priority(key: Column, seed: int) -> Column:
    """A uniform, seeded rank of a row, the same in any SQL engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def reservoir(df: DataFrame, key: str, k: int = 1000, seed: int = 42) -> DataFrame:
    """A uniform sample of ``k`` rows: those of the least priority. Samples of parts merge by taking the least again."""
    if k <= 0:
        raise ValueError("k must be positive")
    return df.withColumn("__p", priority(F.col(key), seed)).orderBy("__p", key).limit(k).drop("__p")


def bernoulli(df: DataFrame, key: str, p: float, seed: int = 42) -> DataFrame:
    """Each row with probability ``p``, decided by its own priority."""
    if not 0 <= p <= 1:
        raise ValueError("p must lie in [0, 1]")
    return df.filter(F.conv(F.substring(priority(F.col(key), seed), 1, 8), 16, 10).cast("long") < int(p * 2**32))


def sampling_compare(df: DataFrame, key: str, value: str, k: int = 1000, p: float = 0.1, seed: int = 42) -> DataFrame:
    """Means of a reservoir and a Bernoulli sample against the mean of all rows."""
    full = df.agg(F.avg(value).alias("full_mean"), F.count(F.lit(1)).alias("n"))

    def one(sample: DataFrame, method: str, size: Column) -> DataFrame:
        s = sample.agg(F.count(F.lit(1)).alias("sample_n"), F.avg(value).alias("sample_mean"))
        both = s.join(F.broadcast(full))  # one row meets one row
        err = F.when(F.col("full_mean") == 0, 0.0).otherwise(F.abs(F.col("sample_mean") - F.col("full_mean")) / F.col("full_mean") * 100)
        return both.select(F.lit(method).alias("method"), size.cast("long").alias("k"), "sample_n", F.round("sample_mean", 6).alias("sample_mean_len"), F.round("full_mean", 6).alias("full_mean_len"), F.round(err, 6).alias("err_pct"))

    return one(reservoir(df, key, k, seed), "reservoir", F.lit(k)).unionByName(one(bernoulli(df, key, p, seed), "bernoulli", F.floor(F.col("n") * p)))


# ------------------------------------------------------------------ Flajolet-Martin
def trailing_zeros(x: Column) -> Column:
    """Of a 64-bit value; 64 for 0."""
    return F.bit_count(x.bitwiseAND(-x) - 1)


def salted_hash(item: Column, salt: int) -> Column:
    """The first 8 bytes of SHA-256 of "salt:item", little-endian, as a signed long."""
    hex_ = F.sha2(F.concat(F.lit(f"{salt}:"), item.cast("string")), 256)
    return F.conv(F.concat(*[F.substring(hex_, 2 * i + 1, 2) for i in reversed(range(8))]), 16, -10).cast("long")


def fm_bitmaps(item: Column, hashes: int = 30, seed: int = 0) -> list[Column]:
    """Aggregates that make the sketch, one bitmap a hash; sketches merge by bit_or."""
    tz = [F.least(trailing_zeros(salted_hash(item, seed * 10000 + i)), F.lit(63)) for i in range(hashes)]
    return [F.bit_or(_bit(t)).alias(f"fm{i}") for i, t in enumerate(tz)]


def _bit(t: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), t.cast("int"))


def fm_estimate(bitmaps: Sequence[Column], groups: int = 5) -> Column:
    """2 to the mean first zero bit of each group of bitmaps over PHI; the median of the groups."""
    if groups <= 0 or len(bitmaps) % groups:
        raise ValueError("hashes must divide into groups")
    size = len(bitmaps) // groups
    first = [trailing_zeros(F.bitwise_not(F.coalesce(b, F.lit(0).cast("long")))) for b in bitmaps]
    est = [F.pow(F.lit(2.0), sum(first[g * size + 1 : (g + 1) * size], first[g * size]) / F.lit(float(size))) / F.lit(PHI) for g in range(groups)]
    order = F.array_sort(F.array(*est))
    mid = groups // 2
    return F.get(order, F.lit(mid)) if groups % 2 else (F.get(order, F.lit(mid - 1)) + F.get(order, F.lit(mid))) / 2


def fm_distinct(df: DataFrame, item: str, length_s: int = 10, hashes: int = 30, groups: int = 5, seed: int = 42) -> DataFrame:
    """Estimated distinct items by window; a null item is none. Items are made distinct first, which leaves the bitmaps as they are."""
    d = df.filter(F.col(item).isNotNull()).select(F.window("event_time", f"{length_s} seconds").alias("w"), F.col(item).alias("item")).distinct()
    s = d.groupBy("w").agg(*fm_bitmaps(F.col("item"), hashes, seed))
    return s.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.round(fm_estimate([F.col(f"fm{i}") for i in range(hashes)], groups), 6).alias("estimate"))


# ------------------------------------------------------------------ both by window
#: 64-bit hashes whose bits are the signs of the second moment's sums.
F2_WORDS = 2


def f2_salt(seed: int, word: int) -> int:
    """Salts of the sign hashes, beyond those of the bitmaps."""
    return seed * 10000 + 9000 + word


def f2_sums(item: Column, times: Column, seed: int = 0) -> list[Column]:
    """Aggregates that make the sketch: sums of +-times, the signs from hashed items; sketches merge by adding. The mean square of a sum is F2."""
    words = [salted_hash(item, f2_salt(seed, w)) for w in range(F2_WORDS)]
    return [F.sum(times * (1 - 2 * F.shiftright(w, j).bitwiseAND(1))).alias(f"z{64 * i + j}") for i, w in enumerate(words) for j in range(64)]


def f2_estimate(sums: Sequence[Column], groups: int = 8) -> Column:
    """The median over groups of the mean square of their sums."""
    if groups <= 0 or len(sums) % groups:
        raise ValueError("sums must divide into groups")
    size = len(sums) // groups
    squares = F.transform(F.array(*sums), lambda x: x.cast("double") * x.cast("double"))
    means = [F.aggregate(F.slice(squares, g * size + 1, size), F.lit(0.0), lambda a, x: a + x) / F.lit(float(size)) for g in range(groups)]
    order, mid = F.array_sort(F.array(*means)), groups // 2
    return F.get(order, F.lit(mid)) if groups % 2 else (F.get(order, F.lit(mid - 1)) + F.get(order, F.lit(mid))) / 2


def sketch_state(df: DataFrame, length_s: int = 10, hashes: int = 30, seed: int = 42) -> DataFrame:
    """(window_start, window_len_s, packets, src_fm, src_z, dst_fm, dst_z): the mergeable sketches of each window as arrays.

    Packets are counted by window and item before anything is hashed. Destinations take the next seed. A null item is
    none: a window whose items are all null has empty sketches.
    """
    start = F.floor(F.unix_seconds("event_time") / length_s) * length_s
    d = df.filter("event_time is not null").select(start.alias("at"), "src_ip", "dst_ip")
    out = d.groupBy("at").agg(F.count(F.lit(1)).alias("packets"))
    for side, s in (("src", seed), ("dst", seed + 1)):
        c = d.groupBy("at", F.col(f"{side}_ip").alias("item")).agg(F.count(F.lit(1)).alias("c")).filter("item is not null")
        sums, maps = f2_sums(F.col("item"), F.col("c"), s), fm_bitmaps(F.col("item"), hashes, s)
        zero = F.lit(0).cast("long")
        held = c.groupBy("at").agg(*maps, *sums).select("at", F.array(*[f"fm{i}" for i in range(hashes)]).alias("fm"), F.array(*[f"z{i}" for i in range(len(sums))]).alias("z"))
        out = out.join(held, "at", "left").withColumnsRenamed({"fm": f"{side}_fm", "z": f"{side}_z"})
        out = out.withColumns({f"{side}_fm": F.coalesce(f"{side}_fm", F.array_repeat(zero, hashes)), f"{side}_z": F.coalesce(f"{side}_z", F.array_repeat(zero, len(sums)))})
    return out.select(F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.lit(length_s).alias("window_len_s"), "packets", "src_fm", "src_z", "dst_fm", "dst_z")


def merged_bitmaps(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def merged_sums(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def estimated(state: DataFrame, hashes: int = 30, groups: int = 5, f2_groups: int = 8) -> DataFrame:
    """Distinct sources and destinations and their second moments, from windows' sketches."""
    made = []
    for side in ("src", "dst"):
        made.append(F.round(fm_estimate([F.get(f"{side}_fm", F.lit(i)) for i in range(hashes)], groups), 6).alias(f"{side}_ips_fm"))
        made.append(F.round(f2_estimate([F.get(f"{side}_z", F.lit(i)) for i in range(64 * F2_WORDS)], f2_groups), 6).alias(f"{side}_f2"))
    return state.select("window_start", "window_len_s", "packets", made[0], made[2], made[1], made[3])


def window_sketches(df: DataFrame, length_s: int = 10, hashes: int = 30, groups: int = 5, f2_groups: int = 8, seed: int = 42) -> DataFrame:
    """packets, estimated distinct sources and destinations (Flajolet-Martin) and their second moments, by window."""
    return estimated(sketch_state(df, length_s, hashes, seed), hashes, groups, f2_groups)


# ------------------------------------------------------------------ second moment
def f2_exact(df: DataFrame, item: str, length_s: int = 10) -> DataFrame:
    """The sum of squared counts of the items of each window."""
    c = df.groupBy(F.window("event_time", f"{length_s} seconds").alias("w"), item).agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("w").agg(F.sum(F.col("c") * F.col("c")).alias("f2_exact")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "f2_exact")


def ams_keys(key: Column, n: int, seed: int) -> list[Column]:
    """``n`` pairwise independent ranks of a row from one hash: (a h + b) mod a prime."""
    h = F.conv(F.substring(priority(key, seed), 1, 7), 16, 10).cast("long")
    return [F.pmod(h * ((7919 * (i + 1) + seed) % PRIME) + (104729 * (i + 1)) % PRIME, F.lit(PRIME)) for i in range(n)]


def f2_ams(df: DataFrame, item: str, key: str, length_s: int = 10, estimators: int = 64, groups: int = 8, seed: int = 42) -> DataFrame:
    """Alon-Matias-Szegedy: each estimator picks a position, r is how often its item comes from there on, X = n (2 r - 1).

    Means of groups of estimators, then their median; the mean over all positions would be F2 itself.
    """
    groups = min(groups if groups > 0 else 6, estimators)
    span = F.floor(F.unix_seconds("event_time") / length_s)
    later = Window.partitionBy("span", "item").orderBy("event_time", "key").rowsBetween(0, Window.unboundedFollowing)
    d = df.select(span.alias("span"), F.col(item).alias("item"), "event_time", F.col(key).alias("key")).withColumn("r", F.count(F.lit(1)).over(later))
    picks = [F.min(F.struct(k.alias("h"), F.col("key"), F.col("r"))).alias(f"x{i}") for i, k in enumerate(ams_keys(F.col("key"), estimators, seed))]
    s = d.groupBy("span").agg(F.count(F.lit(1)).alias("n"), *picks)
    xs = [F.col("n") * (2 * F.col(f"x{i}.r") - 1) for i in range(estimators)]
    size = estimators // groups
    cut = [xs[g * size : (g + 1) * size if g < groups - 1 else estimators] for g in range(groups)]
    order = F.array_sort(F.array(*[sum(c[1:], c[0]) / F.lit(float(len(c))) for c in cut]))
    mid = groups // 2
    median = F.get(order, F.lit(mid)) if groups % 2 else (F.get(order, F.lit(mid - 1)) + F.get(order, F.lit(mid))) / 2
    return s.select(F.date_format(F.timestamp_seconds(F.col("span") * length_s), "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", F.round(median, 2).alias("f2_ams"))


# ------------------------------------------------------------------ decay
def decayed(value: Column, at: Column, now: Column, half_life_s: float) -> Column:
    """Sum of values halved every ``half_life_s`` up to ``now``; the sum of parts is the sum of the whole."""
    if half_life_s <= 0:
        raise ValueError("half-life must be positive")
    return F.sum(value * F.pow(F.lit(2.0), -(F.unix_micros(now) - F.unix_micros(at)) / F.lit(1e6 * half_life_s)))


def decay_traffic(df: DataFrame, half_lives_s: Sequence[float] = (10, 30, 60)) -> DataFrame:
    """The decayed number of packets at the last event, by half-life."""
    last = df.agg(F.max("event_time").alias("now"))
    d = df.select("event_time").join(F.broadcast(last))  # one row
    s = d.agg(F.max("now").alias("now"), *[F.coalesce(decayed(F.lit(1.0), F.col("event_time"), F.col("now"), h), F.lit(0.0)).alias(f"s{i}") for i, h in enumerate(half_lives_s)])
    rows = F.array(*[F.struct(F.lit(float(h)).alias("half_life_s"), F.round(f"s{i}", 6).alias("score")) for i, h in enumerate(half_lives_s)])
    return s.select(F.date_format("now", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.explode(rows).alias("r")).select("ts", "r.half_life_s", "r.score")


def decay_top_keys(df: DataFrame, keys: Sequence[str] = ("dst_ip", "dst_port"), half_lives_s: Sequence[float] = (10, 30, 60), n: int = 10, epsilon: float = 1e-4) -> DataFrame:
    """The ``n`` keys of the highest decayed packet counts by key type and half-life; scores under ``epsilon`` do not count."""
    last = df.agg(F.max("event_time").alias("now"))
    d = df.join(F.broadcast(last))  # one row
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key_type"), F.col(k).cast("string").alias("key")) for k in keys])).alias("k")
    s = d.select("event_time", "now", pairs).filter("k.key is not null").groupBy("k.key_type", "k.key").agg(*[decayed(F.lit(1.0), F.col("event_time"), F.col("now"), h).alias(f"s{i}") for i, h in enumerate(half_lives_s)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(h)).alias("half_life_s"), F.round(f"s{i}", 6).alias("score")) for i, h in enumerate(half_lives_s)])).alias("r")
    s = s.select("key_type", "key", rows).select("key_type", "key", "r.*").filter(F.col("score") >= epsilon)
    w = Window.partitionBy("key_type", "half_life_s").orderBy(F.desc("score"), "key")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# ------------------------------------------------------------------ ones in a sliding window
def ones(df: DataFrame, predicates: Sequence[FilterSpec] = DEFAULT_PREDICATES) -> DataFrame:
    """(predicate_name, event_time, event_id, bit) for every packet and predicate."""
    bits = F.array(*[F.struct(F.lit(p.name).alias("predicate_name"), F.coalesce(F.expr(p.expr), F.lit(False)).cast("int").alias("bit")) for p in predicates])
    return df.select("event_time", "event_id", F.explode(bits).alias("b")).select("b.predicate_name", "event_time", "event_id", "b.bit")


def counting_ones_exact(df: DataFrame, window_n: int = 1000, predicates: Sequence[FilterSpec] = DEFAULT_PREDICATES) -> DataFrame:
    """Ones among the last ``window_n`` packets. The last packets are found once, by a top-n, not by a window over all."""
    if window_n <= 0:
        raise ValueError("window_n must be positive")
    last = df.orderBy(F.desc("event_time"), F.desc("event_id")).limit(window_n)
    return ones(last, predicates).groupBy("predicate_name").agg(F.count(F.lit(1)).alias("window_n"), F.sum("bit").alias("exact_ones"))
