"""Long repeated strings: shard Burrows-Wheeler orders merged by interleave refinement.

A repeat of ``length`` bytes has the same least 32-byte gram (its anchor) at the same offset wherever it
starts. Suffixes are therefore dealt by anchor, which puts equal strings of all shards side by side and
aligned. In each deal the suffixes of all shards stand one after another, and their interleave is refined
one preceding byte at a time: a stable counting step, as in merging Burrows-Wheeler transforms, which
also carries the column at which neighbours first differ. The common prefix of neighbours follows from
that column, so repeated intervals are read off at each step and no suffix is ever compared or sorted again.
Two lengths are read off together: what is removed, and a shorter one at which passages count as shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, pieces, powers, raw_bytes, written

GRAM = 32
PLACE_BITS = 20
PART_BYTES = 8 << 20
#: Strings of so many bytes that start again elsewhere are shared passages: 50 words of prose and more.
SHARED = 300
#: Parts of the join that marks strings around frequent anchors.
SALTS = 16
#: Anchors with more occurrences than one task should hold go by hashes of their strings.
HOT_ROWS = 100_000
EMPTY_SHA = hashlib.sha256(b"").digest()


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    n = len(buf)
    p, q = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    return mix64((sums[GRAM:] - sums[:-GRAM]) * q[: n - GRAM + 1])


def string_hashes(buf: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string of ``length`` bytes."""
    n = len(buf)
    p, q = powers(n + 1)
    out = []
    for b in (buf.astype(np.uint64) + np.uint64(1), buf.astype(np.uint64) * (buf.astype(np.uint64) + np.uint64(17)) + np.uint64(5)):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(b * p[:n], out=sums[1:])
        out.append(mix64((sums[length:] - sums[:-length]) * q[: n - length + 1]).view(np.int64))
    return out[0], out[1]


def anchors(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, gram hash, place, first, last): runs of starts of ``length``-byte strings with one anchor occurrence.

    ``buf`` holds less than 2**PLACE_BITS bytes. The anchor is the leftmost least of the grams inside the string.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    n, w = len(buf), length - GRAM + 1
    if n < length:
        return none
    h = gram_hashes(buf)
    key = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
    pad = -len(key) % w
    rows = np.concatenate((key, np.full(pad, 2**64 - 1, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    size = np.diff(off)
    starts = np.maximum(size - length + 1, 0)
    if not starts.sum():
        return none
    at = np.arange(int(starts.sum())) + np.repeat(off[:-1] - (np.cumsum(starts) - starts), starts)
    text = np.repeat(np.arange(len(size)), starts)
    place = (np.minimum(behind[at], ahead[at + w - 1]) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
    last = np.append(first[1:], len(at)) - 1
    t, base = text[first], off[:-1][text[first]]
    return t, h[place[first]].view(np.int64), place[first] - base, at[first] - base, at[last] - base


def anchor_runs(texts: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, gram hash, place, first, last) for each text; very long texts are taken in overlapping parts."""
    most = (1 << PLACE_BITS) - 1
    for a, _, buf, off in pieces(texts):
        if len(buf) <= most:
            t, *cols = anchors(buf, off, length)
            cut = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else []
            for i, j in zip(cut, np.append(cut[1:], len(t)).astype(int), strict=True):
                yield (a + int(t[i]), *(c[i:j] for c in cols))
            continue
        held: tuple[np.ndarray, ...] | None = None
        for s in range(0, len(buf) - length + 1, most - length):
            part = buf[s : s + most]
            _, g, p, first, last = anchors(part, np.array([0, len(part)]), length)
            keep = first < most - length  # later starts are the next part's
            g, p, first, last = g[keep], p[keep] + s, first[keep] + s, np.minimum(last[keep], most - length - 1) + s
            if held is not None and len(g) and held[0][-1] == g[0] and held[1][-1] == p[0]:  # one run, cut by the border
                first[0] = held[2][-1]
                held = tuple(c[:-1] for c in held)
            if held is not None:
                yield (a, *held)
            held = g, p, first, last
        if held is not None:
            yield (a, *held)


def refine(columns: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray, lengths: tuple[int, ...], starts: int) -> list[np.ndarray]:
    """For each of ``lengths``, which strings of so many bytes recur: (starts, rows) of the aligned suffixes ``columns`` (columns, rows).

    Rows are valid in columns low to high - 1 and lie together by ``group``, shard after shard. From the
    last column to the first the order of each group's rows is refined by the byte in that column; where
    all rows of a group agree the order stands. ``differ`` holds, for each row and the one before it in
    order, the first column in which they differ.
    """
    n_cols, n = columns.shape
    found = [np.zeros((starts, n), bool) for _ in lengths]
    order = np.arange(n)
    head = np.concatenate(([True], group[1:] != group[:-1]))
    differ = np.where(head, -1, n_cols)
    for c in range(n_cols - 1, -1, -1):
        sym = columns[c][order].astype(np.int16)
        sym[(c < low[order]) | (c >= high[order])] = 256
        split = np.concatenate(([False], sym[1:] != sym[:-1])) & ~head
        if split.any():
            torn = np.zeros(int(group[-1]) + 1, bool)
            torn[group[split]] = True
            at = np.flatnonzero(torn[group])
            key = group[at].astype(np.int64) * 257 + sym[at]
            o = np.argsort(key, kind="stable")
            k, source = key[o], at[o]
            same = np.concatenate(([False], k[1:] == k[:-1]))
            new = np.full(len(at), c)
            if same.any():
                a, b = source[np.flatnonzero(same) - 1] + 1, source[same] + 1
                value = differ[b - 1].copy()
                far = np.flatnonzero(b - a > 1)
                if len(far):
                    ends = np.empty(2 * len(far), np.int64)
                    ends[::2], ends[1::2] = a[far], b[far]
                    value[far] = np.minimum.reduceat(np.append(differ, n_cols), ends)[::2]
                new[same] = value
            new[head[at]] = -1
            order[at], sym[at], differ[at] = order[source], sym[source], new
        out = sym == 256
        if out.any():
            differ[out & ~head] = c
        if c < starts:
            for f, length in zip(found, lengths, strict=True):
                equal = differ >= c + length
                equal[:-1] |= equal[1:] & ~head[1:]
                f[c, order[equal]] = True
    return found


def repeated_in(rows: pa.Table, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, start, end): bytes covered by recurring strings of each length, for one deal of rows (g, k, p, first, last, ctx).

    Anchors belong to the least length; ctx reaches from the first start to the end of the longest string at the last one.
    """
    g, p = rows["g"].to_numpy(), rows["p"].to_numpy()
    first, last = rows["first"].to_numpy(), rows["last"].to_numpy()
    k = np.array(rows["k"].to_pylist(), dtype="S16") if rows.num_rows else np.zeros(0, "S16")
    order = np.lexsort((p, k, g))
    g_, k_, p_ = g[order], k[order], p[order]
    again = np.concatenate(([False], (g_[1:] == g_[:-1]) & (k_[1:] == k_[:-1]) & (p_[1:] == p_[:-1])))
    order = order[~again]
    g_ = g[order]
    new = np.concatenate(([True], g_[1:] != g_[:-1]))
    group = np.cumsum(new) - 1
    alone = np.bincount(group)[group] == 1
    order = order[~alone]
    nothing = np.zeros(0, np.int64)
    if not len(order):
        return nothing, nothing, nothing, nothing
    g_ = g[order]
    group = np.cumsum(np.concatenate(([True], g_[1:] != g_[:-1]))) - 1
    reach = min(lengths) - GRAM
    low = first[order] - p[order] + reach
    buf, off = raw_bytes_of(rows["ctx"])
    size = (off[1:] - off[:-1])[order]
    high = low + size
    columns = np.zeros((reach + max(lengths), len(order)), np.uint8)
    for i in range(0, len(order), 1024):
        s = slice(i, i + 1024)
        at = np.arange(int(size[s].sum())) - np.repeat(np.cumsum(size[s]) - size[s], size[s])
        columns[at + np.repeat(low[s], size[s]), np.repeat(np.arange(i, min(i + 1024, len(order))), size[s])] = buf[at + np.repeat(off[order[s]], size[s])]
    out = []
    for length, found in zip(lengths, refine(columns, low, high, group, lengths, reach + 1), strict=True):
        edge = np.diff(np.pad(found.T, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, start = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        shift = (p[order] - reach)[row]
        out.append((order[row], np.full(len(row), length), start + shift, end - 1 + shift + length))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def raw_bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_binary())
    off = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2], np.uint8), off


def text_key(text: str) -> object:
    return F.expr(f"substring(unhex(sha2(coalesce({text}, ''), 256)), 1, 16)")


RUNS = "g long, k binary, p int, first int, last int"


def covered(docs: DataFrame, length: int, shared: int = SHARED, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, texts, spans): facts (doc_id, k, n_bytes, sha) of every document, k naming its text; texts
    (k, text) that may hold repeats; spans (k, length, start, stop), bytes of texts covered by recurring
    strings of ``length`` and of ``shared`` bytes, which may overlap.

    Copies of a text are one text here: where a text of ``length`` bytes or more has copies, all of it recurs.
    An anchor that more than ``hot_rows`` texts share is not dealt to one task: the strings around it are
    counted by hash, summed before the shuffle.
    """
    lengths = tuple(sorted({shared, length}))
    least, most = lengths[0], lengths[-1]
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    facts = written(d.select("doc_id", text_key("text").alias("k"), F.octet_length("text").cast("long").alias("n_bytes"), F.expr("unhex(sha2(text, 256))").alias("sha")), "suffix_facts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = raw_bytes(batch.column(0))
            cols: list[list[np.ndarray]] = [[], [], [], []]
            names, count = [], []
            for t, g, p, first, last in anchor_runs(batch.column(0), least):
                for c, x in zip(cols, (g, p, first, last), strict=True):
                    c.append(x)
                names.append(hashlib.sha256(buf[off[t] : off[t + 1]]).digest()[:16])
                count.append(len(g))
            if names:
                k = pa.array(names, pa.binary()).take(pa.array(np.repeat(np.arange(len(names)), count)))
                g, p, first, last = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays([pa.array(g), k, *(pa.array(x.astype(np.int32)) for x in (p, first, last))], ["g", "k", "p", "first", "last"])

    runs = written(d.filter(F.octet_length("text") >= least).select("text").mapInArrow(run, RUNS), "suffix_runs")
    at = F.xxhash64("k", "p")  # an anchor recurs where its occurrences are not all one text and place
    again = runs.groupBy("g").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("n"))
    again = written(again.filter("lo <> hi").select("g", (F.col("n") > hot_rows).alias("hot")), "suffix_again")
    asked = runs.join(again, "g").groupBy("k").agg(F.collect_set(F.struct("g", "p", "first", "last", "hot")).alias("runs"))
    rep = facts.groupBy("k").agg(F.min("doc_id").alias("doc_id"))
    need = asked.join(rep, "k").select(F.col("doc_id").alias("rep"), "k", "runs")
    same = (F.col("doc_id").eqNullSafe(F.col("rep"))) & (text_key("text") == F.col("k"))  # a text whose documents all lack an id is found by its key
    texts = written(d.join(need, same).select("k", "text", "runs"), "suffix_texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = raw_bytes(batch.column(1))
            runs_ = batch.column(2)
            flat, of = runs_.flatten(), runs_.offsets.to_numpy()
            of = of - of[0]
            g, p, first, last, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(of))
            g, p, first, last, owner = (x[~hot] for x in (g, p, first, last, owner))
            a, b = off[owner] + first, np.minimum(off[owner] + last + most, off[owner + 1])
            for i in range(0, len(g), 4096):
                s = slice(i, i + 4096)
                ctx = pa.array([buf[x:y].tobytes() for x, y in zip(a[s], b[s], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(g[s]), batch.column(0).take(pa.array(owner[s])), *(pa.array(x[s]) for x in (p, first, last)), ctx], ["g", "k", "p", "first", "last", "ctx"])

    total = texts.select(F.explode("runs").alias("r")).agg(F.sum(F.col("r.last") - F.col("r.first") + most)).first()[0] or 0
    deals = max(1, -(-total // PART_BYTES))

    def deal(t: pa.Table) -> pa.Table:
        row, size, start, stop = repeated_in(t, lengths)
        return pa.table({"k": t["k"].take(pa.array(row)), "length": pa.array(size, pa.int32()), "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64())})

    dealt = texts.mapInArrow(cut, RUNS + ", ctx binary").groupBy(F.pmod(F.xxhash64("g"), F.lit(deals)).alias("deal"))
    spans = dealt.applyInArrow(deal, "k binary, length int, start long, stop long")
    if not again.filter("hot").take(1):
        return facts, texts, spans

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = raw_bytes(batch.column(1))
            for i, runs_ in enumerate(batch.column(2).to_pylist()):
                for r in (r for r in runs_ if r["hot"]):
                    for size in lengths:
                        part = buf[off[i] + r["first"] : min(off[i] + r["last"] + size, off[i + 1])]
                        if len(part) >= size:
                            a, b = string_hashes(part, size)
                            start = r["first"] + np.arange(len(a), dtype=np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([batch.column(0)[i].as_py()] * len(a), pa.binary()), pa.array(np.full(len(a), size, np.int32)), pa.array(start)], ["a", "b", "k", "length", "start"])

    each = texts.filter(F.exists("runs", lambda r: r["hot"])).mapInArrow(strings, "a long, b long, k binary, length int, start long")
    often = each.groupBy("a", "b", "length").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # Occurrences of one string are spread over SALTS parts; each part gets every string that recurs once.
    often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = each.withColumn("salt", F.pmod(F.xxhash64("k", "start"), F.lit(SALTS)).cast("int"))
    hot = each.join(often, ["a", "b", "length", "salt"], "left_semi").select("k", "length", "start", (F.col("start") + F.col("length")).alias("stop"))
    return facts, texts, spans.unionByName(hot)


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, length: int = 400, shared: int = SHARED, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared, n_passages) for every document.

    Texts are UTF-8 bytes. A byte goes if a string of ``length`` bytes over it also starts anywhere else,
    in the same document too; matches do not cross documents and are judged on the input. n_shared and
    n_passages count bytes and runs of bytes in the same way for strings of ``shared`` bytes, of which
    nothing is removed. Null and empty texts lose nothing; repeated rows are copies of each other like any
    other equal texts; a null doc_id is a document like others.
    """
    facts, texts, spans = covered(docs, length, shared, hot_rows)
    by_text = spans.groupBy("k").agg(F.collect_set(F.struct("length", "start", "stop")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = raw_bytes(batch.column(1))
            rows = []
            for i, spans_ in enumerate(batch.column(2).to_pylist()):
                data = buf[off[i] : off[i + 1]]
                gone, also = (union_of([(s["start"], s["stop"]) for s in spans_ if s["length"] == n]) for n in (length, shared))
                h, at = hashlib.sha256(), 0
                for a, b in gone:
                    h.update(data[at:a])
                    at = b
                h.update(data[at:])
                rows.append((sum(b - a for a, b in gone), len(gone), h.digest(), sum(b - a for a, b in also), len(also)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["k", "removed", "spans", "kept", "shared", "passages"])

    cut = texts.select("k", "text").join(by_text, "k").mapInArrow(run, "k binary, removed long, spans long, kept binary, shared long, passages long").dropDuplicates(["k"])
    many = facts.groupBy("k").agg(F.count(F.lit(1)).alias("copies"))
    known = many.join(cut, "k", "left").filter("copies > 1 or removed is not null")
    out = facts.join(known, "k", "left")
    copied = F.coalesce("copies", F.lit(1)) > 1
    whole, common = copied & (F.col("n_bytes") >= length), copied & (F.col("n_bytes") >= shared)
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.lower(F.hex(F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept", "sha")))).alias("kept_sha256"),
        F.when(common, F.col("n_bytes")).otherwise(F.coalesce("shared", F.lit(0))).alias("n_shared"),
        F.when(common, F.lit(1)).otherwise(F.coalesce("passages", F.lit(0))).cast("long").alias("n_passages"),
    )
