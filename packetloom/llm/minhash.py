"""Near-duplicate documents: banded b-bit MinHash proposes, full shingle sets confirm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Words, mix64, pieces, trimmed, written
from .components import components

BANDS, ROWS, BITS = 24, 4, 2
K = BANDS * ROWS
FIELDS = 64 // BITS
BLOCK_SHINGLES = 500_000
_rng = np.random.Generator(np.random.PCG64(20240229))
A = _rng.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
B = _rng.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32)
BAND_SALT = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """K minima of a set of 64-bit hashes, in bounded memory at any set size."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 2048):
            np.minimum(out, (A[:, None] * x[None, i : i + 2048] + B[:, None]).min(axis=1), out=out)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys of (texts, K) minima."""
    m = mins.reshape(len(mins), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(BAND_SALT, (len(mins), BANDS)).copy()
        for j in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, j])
    return key


def packed(mins: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, FIELDS to a 64-bit word."""
    low = (mins & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(mins), K // FIELDS, FIELDS)
    return np.bitwise_or.reduce(low << (np.arange(FIELDS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b, buf, off in pieces(texts):
        h, o = Words(buf, off).shingles(k)
        for i in range(b - a):
            s = np.sort(h[o[i] : o[i + 1]])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def lists(values: np.ndarray) -> pa.Array:
    n, w = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * w + 1, w, dtype=np.int32)), pa.array(values.reshape(-1).view(np.int64)))


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, key, bands, sig) of every document; key is null and bands are unused where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), k))
            mins = np.array([minima(s) for s in sets], np.uint32).reshape(len(sets), K)
            keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, keys, lists(band_keys(mins)), lists(packed(mins))], ["doc_id", "n", "key", "bands", "sig"])

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return d.mapInArrow(trimmed(run), "doc_id long, n long, key binary, bands array<long>, sig array<long>")


def estimate(x: Column, y: Column) -> Column:
    """Jaccard similarity from packed signatures: equal fields by bit count, corrected for chance equality."""
    spread = F.lit(sum(1 << (BITS * i) for i in range(FIELDS)) - (1 << 64 if BITS * (FIELDS - 1) == 63 else 0))
    parts = []
    for i in range(K // FIELDS):
        z = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        any_ = z
        for j in range(1, BITS):
            any_ = any_.bitwiseOR(F.shiftrightunsigned(z, j))
        parts.append(F.bit_count(any_.bitwiseAND(spread)))
    equal = 1 - sum(parts[1:], parts[0]) / F.lit(float(K))
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """Six standard deviations under the threshold: a linked pair falls below it about once in 1e9."""
    c = 2.0**-BITS
    p = c + (1 - c) * threshold
    return threshold - 6 * (p * (1 - p) / K) ** 0.5 / (1 - c)


def plausible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) of classes, those that set sizes and packed signatures leave possible, with est."""
    x, y = (classes.select(F.col("c").alias(i), F.col("n").alias(f"n_{i}"), F.col("sig").alias(f"sig_{i}")) for i in "ab")
    p = pairs.join(x, "a").join(y, "b").filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    p = p.withColumn("est", estimate(F.col("sig_a"), F.col("sig_b"))).filter(F.col("est") >= least_estimate(num / den))
    return p.select("a", "b", "est")


def with_sets(goes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(at, c, s): for each class of ``goes`` (c, doc_id, key, at: longs) its sorted shingle hashes, once for each of ``at``.

    A class none of whose documents has an id is found among those without one, by its key.

    Sets are made again from the text of the class's document, so that they are never stored for all documents.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, key, at = (batch.column(i).to_pylist() for i in (0, 1, 2))
            for a in range(0, batch.num_rows, 64):
                rows = []
                for i, s in enumerate(shingle_sets(batch.column(3).slice(a, 64), k), a):
                    if set_key(s) == key[i]:
                        rows += [(x, c[i], s.tobytes()) for x in at[i]]
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["at", "c", "s"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    # A join by key at every size: a table that is small today must not decide how texts move.
    goes = goes.withColumnRenamed("doc_id", "rep")
    known = texts.filter("doc_id is not null").join(goes.filter("rep is not null").hint("merge"), F.col("doc_id") == F.col("rep"))
    made = known.select("c", "key", "at", "text").mapInArrow(trimmed(sets), "at long, c long, s binary")
    if not goes.filter("rep is null").take(1):
        return made

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_key(s) if len(s) else None for s in shingle_sets(batch.column(0), k)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(0)], ["own", "text"])

    nameless = texts.filter("doc_id is null").select("text").mapInArrow(trimmed(keyed), "own binary, text string").dropDuplicates(["own"])
    nameless = nameless.join(goes.filter("rep is null").hint("merge"), F.col("own") == F.col("key"))
    return made.unionByName(nameless.select("c", "key", "at", "text").mapInArrow(trimmed(sets), "at long, c long, s binary"))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of ``pairs`` (a, b), those with den * intersection >= num * union on full sets; a's set goes to b's, once a pair."""
    rep = classes.select("c", F.col("d").alias("doc_id"), "key")
    goes = pairs.select(F.col("a").alias("c"), F.col("b").alias("at")).union(pairs.select("b", "b").distinct())
    goes = goes.join(rep, "c").groupBy("doc_id", "c", "key").agg(F.collect_list("at").alias("at"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = np.zeros(len(x), bool)
            for i in range(len(x)):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                both = np.sort(np.concatenate((p, q)))
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = den * common >= num * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    made = written(with_sets(goes, docs, k), "minhash_sets")
    x, y = made.filter("c <> at").select(F.col("c").alias("a"), F.col("at").alias("b"), F.col("s").alias("x")), made.filter("c = at").select(F.col("c").alias("b"), F.col("s").alias("y"))
    return x.join(y, "b").select("a", "b", "x", "y").mapInArrow(trimmed(compare), "a long, b long")


def cell_links(c: np.ndarray, label: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> tuple[list[int], list[int]]:
    """Links between members of different components that join components; overlaps are counted over posting lists."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    new = np.concatenate(([True], flat[order][1:] != flat[order][:-1]))
    element = np.empty(len(flat), np.int64)
    element[order] = np.cumsum(new) - 1
    start = np.append(np.flatnonzero(new), len(flat))
    owner = np.repeat(np.arange(len(sets)), size)[order]
    own = np.concatenate(([0], np.cumsum(size)))
    _, group = np.unique(label, return_inverse=True)
    skip = np.bincount(group).argmax()
    a_out, b_out = [], []
    for y in np.flatnonzero(group != skip):
        e = element[own[y] : own[y + 1]]
        n = start[e + 1] - start[e]
        at = np.cumsum(n) - n
        common = np.bincount(owner[np.arange(int(n.sum())) + np.repeat(start[e] - at, n)], minlength=len(sets))
        hit = np.flatnonzero((group != group[y]) & (den * common >= num * (size + size[y] - common)))
        for g in np.unique(group[hit]):
            x = hit[group[hit] == g][0]
            a_out.append(int(c[y]))
            b_out.append(int(c[x]))
            group[group == g] = group[y]
    return a_out, b_out


def leftovers(bands: DataFrame, stars: DataFrame, comp: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that star edges miss: between classes that share a bucket and lie in different components.

    Buckets whose classes are all in one component need nothing more; nor do those of two classes whose
    pair is not plausible, as ``stars`` (a, b), the plausible star edges, tells. Components that meet in the
    others form a cluster, whose classes are dealt over blocks of about BLOCK_SHINGLES; each pair of
    blocks is one task's group of bounded size, in which overlaps of full sets are counted, and only
    links that join components leave it. A set moves once for each block of its cluster.
    """
    m = bands.join(comp.select(F.col("node").alias("c"), "label"), "c", "left").select("band", "c", F.coalesce("label", "c").alias("label"))
    mixed = m.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band", "lo")
    m = m.join(mixed, "band").select("band", "c", "label", "lo")
    pairs = m.groupBy("band").agg(F.min("c").alias("b"), F.max("c").alias("a"), F.count(F.lit(1)).alias("size")).filter("size = 2")
    m = m.join(pairs.join(stars, ["a", "b"], "left_anti").select("band"), "band", "left_anti")
    m = written(m.select("c", "label", "lo").distinct(), "minhash_mixed")
    cluster = components(m.select(F.col("label").alias("a"), F.col("lo").alias("b")).distinct()).select(F.col("node").alias("label"), F.col("label").alias("cluster"))
    m = m.select("c", "label").distinct().join(cluster, "label").join(classes.select("c", "n", "key", F.col("d").alias("doc_id")), "c")
    return cluster_links(written(m, "minhash_members"), docs, k, num, den)


def cluster_links(m: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join components, of all pairs in each cluster of ``m`` (c, label, cluster, n, key, doc_id).

    A cluster is dealt over blocks of about BLOCK_SHINGLES, and each pair of blocks is one group; pairs are never listed.
    """
    sizes = m.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    m = m.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    at = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least("block", o) * F.col("blocks") + F.greatest("block", o))
    goes = m.select("doc_id", "c", "key", F.transform(at, lambda x: F.xxhash64("cluster", x)).alias("at"))
    made = with_sets(goes, docs, k).join(m.select("c", "label"), "c")

    def run(t: pa.Table) -> pa.Table:
        c, label = t["c"].to_numpy(), t["label"].to_numpy()
        if len(np.unique(label)) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = cell_links(c, label, [np.frombuffer(x.as_buffer(), np.uint64) for x in t["s"]], num, den)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return made.groupBy("at").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents joined where den * |A n B| >= num * |A u B|.

    A and B are sets of k-word shingles of the whole texts (ASCII letters lower-cased); a text of
    fewer words is one shingle, a null or empty one has none, is linked with nothing and is its own
    component. Texts of equal sets are one class, which enters the search once, however many copies
    it has. Classes that share a band are linked to the least class of the bucket; where estimates
    allow it the full sets decide, and classes of a bucket that these star edges leave in different
    components are compared in a second step, so no link that a band proposes is lost (bands propose a pair at
    0.8 with 1 - 4e-6, at 0.85 with 1 - 3e-8). component_id is the least doc_id of a component;
    repeated rows are kept or dropped alike. A document without an id is linked like others; component_id is
    null where no document of the component has an id, and such rows are kept. Links are confirmed on 64-bit
    hashes of shingles: two different shingles of a pair of n have equal hashes with n**2 / 2**65, under 1e-9 for 100,000.
    """
    s = written(signed(docs, k), "minhash_signed")
    classes = s.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("d"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "minhash_classes")
    bands = classes.select("c", F.explode("bands").alias("band"))
    stars = bands.groupBy("band").agg(F.min("c").alias("b"), F.max("c").alias("top")).filter("b <> top").drop("top")
    stars = bands.join(stars, "band").filter("c <> b").select(F.col("c").alias("a"), "b").distinct()
    stars = written(plausible(stars, classes, num, den), "minhash_stars")
    first = stars.groupBy("a").agg(F.max_by("b", "est").alias("b"))
    links = written(confirmed(first, classes, docs, k, num, den), "minhash_links")
    comp = written(components(links), "minhash_components")
    more = written(leftovers(bands, stars, comp, classes, docs, k, num, den), "minhash_leftovers")
    if more.take(1):
        comp = written(components(links.union(more)), "minhash_components")
    of = classes.join(comp, classes["c"] == comp["node"], "left").select("key", "d", F.coalesce("label", "c").alias("label"))
    least = of.groupBy("label").agg(F.min("d").alias("component_id"))
    of = of.join(least, "label").select("key", "component_id")
    out = s.select("doc_id", "n", "key").join(of, "key", "left")
    own = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == own, own.isNull())
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), kept.alias("kept"))


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) > 2 THEN [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]
                                        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN l ON l.a = r.other)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least_id AS component_id, doc_id = least_id AS kept
FROM s JOIN (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


def deduplicated(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without all but the least doc_id of each group; of repeated rows one stays. Rows without a doc_id stay."""
    found = near_duplicates(docs, k, num, den)
    gone = written(found.filter("not kept").select("doc_id").distinct(), "minhash_gone")
    again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    kept = docs.join(gone.withColumnRenamed("doc_id", "__gone"), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    if again.take(1):
        kept = kept.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.filter("doc_id is null"))
    return kept
