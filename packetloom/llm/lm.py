"""Language-model scoring by online logistic context mixing.

A text is coded bit by bit. Frequent words, counted over all training documents, have codes in a binary
tree that halves their weight in byte order; another word is an escape and then its bytes and a blank,
coded by a tree of bytes. Every bit is predicted in three contexts, two of them hashed: none, the last
word, the last word's ending; in a spelled word its last three bytes, over the border to the word
before, and all of it so far. Gated weights, learnt online, combine them in the logistic domain, and an
adaptive table refines the result. The bits of a text add up to its probability. Words are also counted exactly, for the base score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix64, pieces, ragged, written
from .langid import remainder

PREDICTORS = 3
SLOT_BITS, SLICE_BITS = 19, 14
SLOTS, SLICE = 1 << SLOT_BITS, 1 << SLICE_BITS
#: The most words that have codes of their own; every other word is spelled.
TREE_WORDS = 1 << 19
#: Gates: how often each hashed context was met (four degrees), and how deep in the code of a word or a byte.
SEEN_GATES, DEPTHS = 4 ** (PREDICTORS - 1), 20
PLACE_GATES = 2 * DEPTHS
#: Added to counts before they are divided: of no context, of the others.
ADDED_0, ADDED = 0.02, 0.1
BUCKETS = 33
#: Leading bits of a hash by which words with codes are found.
NEAR_BITS = 20
#: States of a slot: counts up to EXACT in all as they are, more by the size of their sum and in steps of their ratio.
EXACT, LEVELS, STEPS = 12, 40, 2.5
SIZES = (30, 100, 1000, 10_000)
#: Words of fewer training occurrences are spelled.
LEAST_COUNT = 2
#: Bytes of text for each part of the vocabulary.
PART_BYTES = 8 << 20
SYMBOLS = 1 << 12
#: Partial sums that one task adds up.
FAN = 64
HEAVY_SHARE = 20000
#: What one task holds when documents meet their words: tokens less heavy ones; ranges of hashes at most.
TOKENS_A_CELL, MOST_RANGE_BITS = 1 << 20, 12
END = b"\n"
END_HASH = Words(np.array([65], np.uint8), np.array([0, 1])).hash[0] ^ np.uint64(0x5DEECE66D)


@dataclass
class Vocabulary:
    """Distinct words in order of their hashes: training count, length and bytes."""

    h: np.ndarray
    c: np.ndarray
    size: np.ndarray
    data: np.ndarray

    @staticmethod
    def merged(parts: list[Vocabulary]) -> Vocabulary:
        if len(parts) == 1:
            return parts[0]
        h = np.concatenate([p.h for p in parts])
        c, size = np.concatenate([p.c for p in parts]), np.concatenate([p.size for p in parts])
        data = np.concatenate([p.data for p in parts])
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        start = np.cumsum(size) - size
        return Vocabulary(u, np.bincount(inv, c, len(u)).astype(np.int64), size[first], data[ragged(start[first], size[first])])

    @staticmethod
    def of(w: Words, learn: np.ndarray) -> Vocabulary:
        u, first, inv = np.unique(w.hash, return_index=True, return_inverse=True)
        c = np.bincount(inv, learn[w.doc].astype(float), len(u)).astype(np.int64)
        size = w.end[first] - w.start[first]
        return Vocabulary(u, c, size, w.buf[ragged(w.start[first], size)])

    def rows(self, parts_bits: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        n = 1 << parts_bits
        cut = np.searchsorted(self.h, np.arange(1, n, dtype=np.uint64) << np.uint64(64 - parts_bits)) if parts_bits else np.zeros(0, np.int64)
        cut = np.concatenate(([0], cut, [len(self.h)]))
        at = np.concatenate(([0], np.cumsum(self.size)))
        for p in np.flatnonzero(cut[1:] > cut[:-1]):
            a, b = cut[p], cut[p + 1]
            yield int(p), self.h[a:b].tobytes(), self.c[a:b].tobytes(), self.size[a:b].astype(np.int32).tobytes(), self.data[at[a] : at[b]].tobytes()

    @staticmethod
    def read(h: pa.Scalar, c: pa.Scalar, size: pa.Scalar, data: pa.Scalar) -> Vocabulary:
        raw = [np.frombuffer(x.as_buffer(), t) if x.as_buffer().size else np.zeros(0, t) for x, t in ((h, np.uint64), (c, np.int64), (size, np.int32), (data, np.uint8))]
        return Vocabulary(raw[0], raw[1], raw[2].astype(np.int64), raw[3])


ROWS = "p int, h binary, c binary, size binary, data binary"


def row_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["p", "h", "c", "size", "data"])


def vocabulary(docs: DataFrame, parts_bits: int) -> DataFrame:
    """ROWS, one for each range of hashes: all words of all documents with their counts in training documents.

    ``docs``: text, learn. Each task sums before the shuffle; the end of a text counts as a word. There is
    a range for every PART_BYTES of text, so a row holds a bounded share of the words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Vocabulary] = []
        waiting = ends = 0
        for batch in batches:
            learn = np.array(batch.column(1).to_pylist(), bool)
            ends += int(learn.sum())
            for a, b, buf, off in pieces(batch.column(0)):
                found.append(Vocabulary.of(Words(buf, off), learn[a:b]))
                waiting += len(found[-1].h)
                if len(found) > 8 and waiting > 2 * len(found[0].h):
                    found = [Vocabulary.merged(found)]
                    waiting = 0
        found.append(Vocabulary(np.array([END_HASH]), np.array([ends], np.int64), np.array([1]), np.frombuffer(END, np.uint8)))
        for row in Vocabulary.merged(found).rows(parts_bits):
            yield row_batch([row])

    def merge(t: pa.Table) -> pa.Table:
        v = Vocabulary.merged([Vocabulary.read(*(t[n][i] for n in ("h", "c", "size", "data"))) for i in range(t.num_rows)])
        return pa.Table.from_batches([row_batch([(t["p"][0].as_py(), v.h.tobytes(), v.c.tobytes(), v.size.astype(np.int32).tobytes(), v.data.tobytes())])])

    return docs.select("text", "learn").mapInArrow(count, ROWS).groupBy("p").applyInArrow(merge, ROWS)


# ------------------------------------------------------------------ codes
def halved(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A binary tree over leaves in their order: an inner node parts its leaves where their weight is nearest to halved.

    (where each leaf's path starts and one more, steps: node * 2 + bit, number of inner nodes).
    """
    total = np.concatenate(([0.0], np.cumsum(weight)))
    low, high = np.array([0]), np.array([len(weight)])
    leaf, step, made = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while True:
        low, high = low[high - low > 1], high[high - low > 1]
        if not len(low):
            break
        half = (total[low] + total[high]) / 2
        cut = np.clip(np.searchsorted(total, half), low + 1, high - 1)
        cut -= (cut - 1 > low) & (half - total[cut - 1] < total[cut] - half)
        size = high - low
        at = ragged(low, size)
        leaf.append(at)
        step.append(np.repeat(np.arange(made, made + len(low)), size) * 2 + (at >= np.repeat(cut, size)))
        made += len(low)
        low, high = np.stack((low, cut), 1).ravel(), np.stack((cut, high), 1).ravel()
    order = np.argsort(np.concatenate(leaf), kind="stable")
    size = np.bincount(np.concatenate(leaf), minlength=len(weight))
    return np.concatenate(([0], np.cumsum(size))), np.concatenate(step)[order], made


@dataclass
class Tree:
    """Codes of symbols: the escape, the frequent words and the end, then the 256 bytes. A code is a path of steps."""

    h: np.ndarray  # sorted hashes of the words
    symbol: np.ndarray  # of each hash
    start: np.ndarray  # of each symbol's path, and one more
    step: np.ndarray  # node * 2 + bit
    place: np.ndarray  # the place gate of each step of a path
    nodes: int
    bytes_at: int  # symbol of byte 0
    byte_step: int  # least step in a byte's path
    plain: np.ndarray  # by step, how often training documents took it: sums of the counts of words and bytes
    near: np.ndarray  # by leading bits of a hash, the first word in h with these or greater ones
    deep: int  # the most words that share leading bits

    ESCAPE = 0

    @staticmethod
    def grown(hashes: np.ndarray, counts: np.ndarray, escapes: int, spelled: np.ndarray) -> Tree:
        """From words in byte order, their counts, how often none of them was met, and the counts of bytes then."""
        start, step, made = halved(np.concatenate(([escapes], counts)) + 0.5)
        byte_start, byte_step, more = halved(spelled + 0.5)
        by = np.argsort(hashes)
        start = np.concatenate((start, byte_start[1:] + start[-1]))
        step = np.concatenate((step, byte_step + 2 * made)).astype(np.uint32)
        taken = np.repeat(np.concatenate(([escapes], counts, spelled)), np.diff(start))
        plain = np.bincount(step, taken, 2 * (made + more)).astype(np.float32)
        depth = ragged(np.zeros(len(start) - 1, np.int64), np.diff(start))
        place = (np.minimum(depth, DEPTHS - 1) + DEPTHS * (step >= 2 * made)).astype(np.uint8)
        h = hashes[by]
        near = np.searchsorted(h, np.arange(1 << NEAR_BITS, dtype=np.uint64) << np.uint64(64 - NEAR_BITS))
        deep = int(np.diff(np.append(near, len(h))).max())
        return Tree(h, by + 1, start, step, place, made + more, len(counts) + 1, 2 * made, plain, near, deep)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The symbol of each word; ESCAPE where it has none."""
        at = self.near.take((h >> np.uint64(64 - NEAR_BITS)).astype(np.intp))
        out = np.zeros(len(h), np.int64)
        left, last = np.arange(len(h)), len(self.h) - 1
        for _ in range(self.deep):
            i = np.minimum(at, last)
            there = self.h.take(i)
            hit = there == h[left]
            out[left[hit]] = self.symbol.take(i[hit])
            more = there < h[left]
            left, at = left[more], at[more] + 1
        return out


def mix32(x: np.ndarray) -> np.ndarray:
    x = x * np.uint32(0x85EBCA6B)
    return x ^ (x >> np.uint32(15))


def chained(salt: int, *parts: np.ndarray) -> np.ndarray:
    x = np.full(len(parts[0]), salt * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for p in parts:
        x = mix32(x + p)
    return x


class Symbols:
    """The texts of a piece as symbols: text, symbol, and the context of each hashed predictor."""

    def __init__(self, w: Words, tree: Tree):
        n, d = len(w.hash), len(w.off) - 1
        at = np.arange(n) + w.doc  # a text's end follows its words
        ends = w.bounds[1:] + np.arange(d)
        h = np.empty(n + d, np.uint64)
        h[at], h[ends] = w.hash, END_HASH
        text = np.empty(n + d, np.int64)
        text[at], text[ends] = w.doc, np.arange(d)
        size, begin = np.zeros(n + d, np.int64), np.zeros(n + d, np.int64)
        size[at], begin[at] = w.end - w.start, w.start
        last = np.zeros(n + d, np.uint32)
        last[at] = w.buf[w.end - 1]
        before = np.zeros(n + d, np.uint32)
        before[at] = np.where(w.end - w.start > 1, w.buf[np.maximum(w.end - 2, 0)], 0)
        place = np.arange(n + d) - np.concatenate(([0], ends[:-1] + 1))[text] if d else np.zeros(0, np.int64)

        def ago(x: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(len(x), np.uint32)
            out[k:] = x[:-k]
            out[place < k] = 0
            return out

        short = (h >> np.uint64(32)).astype(np.uint32)
        one = ago(short, 1)
        tail = ago(last, 1)
        first = [chained(1, one), chained(2, tail, ago(before, 1))]
        found = tree.find(h)
        spelled = np.flatnonzero(found == Tree.ESCAPE)
        many = np.ones(n + d, np.int64)
        many[spelled] += size[spelled] + 1
        to = np.cumsum(many) - many
        self.text, self.symbol = np.repeat(text, many), np.empty(int(many.sum()), np.int64)
        self.symbol[to] = found
        self.context = [np.empty(len(self.symbol), np.uint32) for _ in first]
        for x, y in zip(self.context, first, strict=True):
            x[to] = y
        if not len(spelled):
            return
        long = size[spelled] + 1
        at = ragged(to[spelled] + 1, long)
        j = ragged(np.zeros(len(spelled), np.int64), long)
        ends = np.cumsum(long) - 1
        byte = np.full(len(at), 32, np.uint32)
        inside = np.ones(len(at), bool)
        inside[ends] = False
        byte[inside] = w.buf[ragged(begin[spelled], size[spelled])]
        self.symbol[at] = tree.bytes_at + byte
        edge = np.repeat(tail[spelled], long) + np.uint32(0x200)
        past = []
        for k in (1, 2, 3):
            x = np.zeros(len(at), np.uint32)
            x[k:] = byte[:-k]
            past.append(np.where(j >= k, x, np.where(j == k - 1, np.uint32(0x100), np.where(j == k - 2, edge, np.uint32(0)))))
        sums = np.zeros(len(at) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mix64(byte.astype(np.uint64) + (j.astype(np.uint64) << np.uint64(9))), out=sums[1:])
        so_far = mix64(sums[:-1] - np.repeat(sums[ends + 1 - long], long)).astype(np.uint32)
        for x, y in zip(self.context, [chained(13, *past), chained(15, so_far)], strict=True):
            x[at] = y

    def bits(self, tree: Tree) -> Iterator[Bits]:
        for a in range(0, len(self.symbol), SYMBOLS):
            s = slice(a, a + SYMBOLS)
            symbol = self.symbol[s]
            start = tree.start[symbol]
            size = tree.start[symbol + 1] - start
            at = ragged(start, size)
            step = tree.step.take(at)
            yield Bits(a, size, step, step & np.uint32(1), tree.place.take(at).astype(np.int64), [np.repeat(x[s], size) for x in self.context])


@dataclass
class Bits:
    """One entry for each bit coded: its step, value, place gate and contexts; the first symbol and how many bits each has."""

    first: int
    size: np.ndarray
    step: np.ndarray
    bit: np.ndarray
    place: np.ndarray
    context: list[np.ndarray]  # of the hashed predictors

    @cached_property
    def node(self) -> np.ndarray:
        """A hash of each bit's node."""
        x = self.step >> np.uint32(1)
        x *= np.uint32(0x9E3779B1)
        return x

    def slots(self, i: int) -> np.ndarray:
        """The slot of each bit in the table of hashed predictor i."""
        x = self.context[i] ^ self.node  # then as mix32, in place
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        x >>= np.uint32(32 - SLOT_BITS)
        return x.astype(np.intp)


# ------------------------------------------------------------------ the model
def ratio(n0: np.ndarray, n1: np.ndarray, added: float) -> np.ndarray:
    return np.log((n1 + added) / (n0 + added))


def states(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """One byte for each pair of counts."""
    total = n0 + n1
    small = np.minimum(total, EXACT)
    exact = small * (small + 1) / 2 + np.minimum(n1, small)
    level = np.clip(np.round(ratio(n0, n1, ADDED) * STEPS) + LEVELS // 2, 0, LEVELS - 1)
    rough = (EXACT + 1) * (EXACT + 2) // 2 + LEVELS * np.searchsorted(SIZES[:-1], total) + level
    return np.where(total <= EXACT, exact, rough).astype(np.uint8)


def state_counts() -> tuple[np.ndarray, np.ndarray]:
    """The counts that each state stands for."""
    pairs = [(t - k, k) for t in range(EXACT + 1) for k in range(t + 1)]
    for t in SIZES:
        for level in range(LEVELS):
            p = 1 / (1 + math.exp(-(level - LEVELS // 2) / STEPS))
            pairs.append((t * (1 - p), t * p))
    n0, n1 = np.array(pairs).T
    return n0, n1


def seen(total: np.ndarray) -> np.ndarray:
    """How often a context was met: never, once or twice, up to 15 times, more."""
    return (total > 0).astype(np.int64) + (total > 2.5) + (total > 15.5)


N0, N1 = state_counts()
#: By state, and for learning by bit and state with that bit's own occurrence left out: prediction and gate.
STRETCH, SEEN = ratio(N0, N1, ADDED).astype(np.float32), [seen(N0 + N1) * PLACE_GATES * 4**i for i in range(PREDICTORS - 1)]
_less = [(np.maximum(N0 - (1 - bit), 0), np.maximum(N1 - bit, 0)) for bit in (0, 1)]
STRETCH_LESS = np.concatenate([np.pad(ratio(a, b, ADDED), (0, 256 - len(N0))) for a, b in _less]).astype(np.float32)
SEEN_LESS = [np.concatenate([np.pad(seen(a + b), (0, 256 - len(N0))) for a, b in _less]) * PLACE_GATES * 4**i for i in range(PREDICTORS - 1)]


@dataclass
class Counts:
    """What the corpus tells, of fixed size: (nodes, 2) counts without context, (PREDICTORS - 1, SLOTS) states with one."""

    plain: np.ndarray
    states: np.ndarray

    @staticmethod
    def of(plain: np.ndarray, counts: np.ndarray) -> Counts:
        return Counts(plain, np.stack([states(c[:, 0], c[:, 1]) for c in counts]))

    def without(self) -> tuple[np.ndarray, np.ndarray]:
        """By step, the prediction at its node without context; and the same with that step's own occurrence left out."""
        n0, n1 = self.plain.T
        less = np.stack([ratio(np.maximum(n0 - (1 - bit), 0), np.maximum(n1 - bit, 0), ADDED_0) for bit in (0, 1)], axis=1)
        return np.repeat(ratio(n0, n1, ADDED_0), 2).astype(np.float32), less.astype(np.float32).ravel()


@dataclass
class Mixer:
    """Gated weights by predictor and gate; the refining table: how often a prediction in a bucket met 0 and 1."""

    by_seen: np.ndarray  # (PREDICTORS, SEEN_GATES)
    by_place: np.ndarray  # (PREDICTORS, PLACE_GATES)
    refine: np.ndarray  # (PLACE_GATES, BUCKETS, 2)

    @staticmethod
    def fresh() -> Mixer:
        start = np.array([0.4, 0.3, 0.3])
        return Mixer(np.tile(start[:, None], (1, SEEN_GATES)), np.zeros((PREDICTORS, PLACE_GATES)), np.zeros((PLACE_GATES, BUCKETS, 2)))

    def weights(self) -> np.ndarray:
        """(PREDICTORS, SEEN_GATES x PLACE_GATES): a gate of each kind together."""
        return (self.by_seen[:, :, None] + self.by_place[:, None, :]).reshape(PREDICTORS, -1).astype(np.float32)

    def learn(self, x: list[np.ndarray], gate: np.ndarray, place: np.ndarray, bit: np.ndarray, rate: float = 0.01, batch: int = 16384) -> None:
        """Online over small batches in the order of the text; the refining table notes each prediction made on the way."""
        shape, size = (SEEN_GATES, PLACE_GATES), SEEN_GATES * PLACE_GATES
        for a in range(0, len(bit), batch):
            s = slice(a, a + batch)
            part, g, b = [v[s] for v in x], gate[s], bit[s]
            stretch = mixed(self.weights(), part, g)
            err = b.astype(np.float32) - chance(stretch)
            n = np.bincount(g, minlength=size).reshape(shape)
            scale = [rate / np.sqrt(np.maximum(n.sum(axis=axis), 1)) for axis in (1, 0)]
            for i in range(PREDICTORS):
                step = np.bincount(g, err * part[i], size).reshape(shape)
                self.by_seen[i] += scale[0] * step.sum(axis=1)
                self.by_place[i] += scale[1] * step.sum(axis=0)
            at = (place[s] * BUCKETS + bucket(stretch)) * 2 + b
            self.refine += np.bincount(at, minlength=self.refine.size).reshape(self.refine.shape)


def mixed(weights: np.ndarray, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
    out = weights[0].take(gate, mode="clip")
    out *= x[0]
    for i in range(1, PREDICTORS):
        part = weights[i].take(gate, mode="clip")
        part *= x[i]
        out += part
    return np.clip(out, -14, 14, out=out)


def chance(stretch: np.ndarray) -> np.ndarray:
    p = np.negative(stretch)
    np.exp(p, out=p)
    p += np.float32(1)
    return np.reciprocal(p, out=p)


def bucket(stretch: np.ndarray) -> np.ndarray:
    x = np.rint(stretch * np.float32(2))
    x += np.float32(BUCKETS // 2)
    return np.clip(x, 0, BUCKETS - 1, out=x).astype(np.int64)


@dataclass
class Model:
    """What scoring needs, of fixed size."""

    tree: Tree
    counts: Counts
    mixer: Mixer

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By step, the prediction without context; the weights; by place and bucket, factor and summand of a refined probability. Made where texts are scored."""
        n = self.mixer.refine
        all_ = n.sum(axis=2) + 8
        return self.counts.without()[0], self.mixer.weights(), (0.5 + 4 / all_).astype(np.float32).ravel(), (0.5 * n[:, :, 1] / all_).astype(np.float32).ravel()

    def log2p(self, w: Words) -> np.ndarray:
        """Base-2 log probability of each text of a piece."""
        return self.coded(Symbols(w, self.tree), len(w.off) - 1)

    def coded(self, symbols: Symbols, texts: int) -> np.ndarray:
        """Base-2 log probability of the symbols of each text."""
        out = np.zeros(texts)
        plain, weights, factor, summand = self.tables
        low = np.float32(2.0**-20)
        for b in symbols.bits(self.tree):
            x, gate = [plain.take(b.step, mode="clip")], b.place.copy()
            for i in range(PREDICTORS - 1):
                s = self.counts.states[i].take(b.slots(i), mode="clip").astype(np.intp)
                x.append(STRETCH.take(s, mode="clip"))
                gate += SEEN[i].take(s, mode="clip")
            stretch = mixed(weights, x, gate)
            p = chance(stretch)
            at = b.place * BUCKETS
            at += bucket(stretch)
            p *= factor.take(at, mode="clip")
            p += summand.take(at, mode="clip")
            np.clip(p, low, 1 - low, out=p)
            p -= 1 - b.bit.astype(np.float32)
            each = np.add.reduceat(np.append(np.log2(np.abs(p, out=p), out=p), np.float32(0)), np.cumsum(b.size) - b.size, dtype=np.float64)
            out += np.bincount(symbols.text[b.first : b.first + len(b.size)], np.where(b.size, each, 0), len(out))
        return out


# ------------------------------------------------------------------ sums over the corpus
def added_up(parts: DataFrame, schema: str) -> DataFrame:
    """(s, n, m): sums over tasks of ``parts`` (task, s, n, m: compressed floats), FAN at a time, in the order of the tasks."""
    parts = written(parts, "lm_parts")
    many = (parts.agg(F.max("task")).first()[0] or 0) + 1

    def add(t: pa.Table) -> pa.Table:
        order = np.argsort(t["task"].to_numpy(), kind="stable")
        total = np.sum([unpacked(t["m"][int(i)].as_py()) for i in order], axis=0, dtype=np.float64)
        return pa.table({"task": pa.array([int(t["task"][0].as_py())], pa.int32()), "s": t["s"][:1], "n": pa.array([float(np.sum(t["n"].to_numpy()))]), "m": pa.array([packed(total)], pa.binary())})

    while True:
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("int"))
        parts = parts.groupBy("s", "task").applyInArrow(add, schema)
        many = -(-many // FAN)
        if many == 1:
            return parts
        parts = written(parts, "lm_parts")


def packed(x: np.ndarray) -> bytes:
    return pa.compress(x.astype(np.float32).tobytes(), codec="zstd", asbytes=True) + int(x.size).to_bytes(8, "little")


def unpacked(m: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(m[:-8], decompressed_size=4 * int.from_bytes(m[-8:], "little"), codec="zstd", asbytes=True), np.float32)


PARTS = "task int, s int, n double, m binary"


def part_batch(rows: list[tuple[int, float, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([task] * len(cols[0]), pa.int32()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.binary())], ["task", "s", "n", "m"])


def coded(vocab: DataFrame, tokens: int, most: int) -> Tree:
    """Codes of the at most ``most`` words that training documents hold most often, LEAST_COUNT times at least."""

    def level(c: np.ndarray) -> np.ndarray:
        return np.floor(16 * np.log2(np.maximum(c, 1))).astype(np.int64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1024, np.int64)
        for batch in batches:
            for x in batch.column(0):
                c = np.frombuffer(x.as_buffer(), np.int64)
                out += np.bincount(level(c[c >= LEAST_COUNT]), minlength=1024)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], ["level", "n"])

    got = vocab.select("c").mapInArrow(tally, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1025, np.int64)
    n[got["level"].to_numpy()] = got["n"].to_numpy()
    above = np.cumsum(n[::-1])[::-1]
    least = int(np.flatnonzero(above <= most)[0])

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                v = Vocabulary.read(*(batch.column(j)[r] for j in range(1, 5)))
                keep = np.flatnonzero(((v.c >= LEAST_COUNT) & (level(v.c) >= least)) | (v.h == END_HASH))
                at = np.cumsum(v.size) - v.size
                text = [v.data[at[i] : at[i] + v.size[i]].tobytes() for i in keep]
                yield pa.RecordBatch.from_arrays([pa.array(v.h[keep].view(np.int64)), pa.array(v.c[keep]), pa.array(text, pa.binary())], ["h", "c", "w"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(256)
        for batch in batches:
            for r in range(batch.num_rows):
                v = Vocabulary.read(*(batch.column(j)[r] for j in range(1, 5)))
                c = np.where(((v.c >= LEAST_COUNT) & (level(v.c) >= least)) | (v.h == END_HASH), 0, v.c)
                out += np.bincount(v.data, np.repeat(c, v.size), 256)
                out[32] += c.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(out)], ["byte", "n"])

    top = vocab.mapInArrow(frequent, "h long, c long, w binary").toArrow()
    words, h, c = top["w"].to_pylist(), top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    if not words:
        words, h, c = [END], np.array([END_HASH]), np.zeros(1, np.int64)
    order = np.array(sorted(range(len(words)), key=lambda i: (words[i], h[i])))
    spelled = np.zeros(256)
    for byte, n in vocab.mapInArrow(rare, "byte long, n double").groupBy("byte").agg(F.sum("n")).collect():
        spelled[byte] = n
    return Tree.grown(h[order], c[order], max(0, tokens - int(c.sum())), spelled)


def context_counts(learn: DataFrame, tree: Tree) -> Counts:
    """How often each slot of each hashed predictor met 0 and 1 in all of ``learn`` (text); nodes alone are known from the words' counts."""
    shared = learn.sparkSession.sparkContext.broadcast(tree)  # TREE_WORDS words at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((PREDICTORS - 1, 2 * SLOTS), np.int32)
        tree = shared.value
        for batch in batches:
            for _, _, buf, off in pieces(batch.column(0)):
                for b in Symbols(Words(buf, off), tree).bits(tree):
                    for i in range(PREDICTORS - 1):
                        np.add.at(table[i], b.slots(i) * 2 + b.bit, np.int32(1))
        cells = table.reshape(-1, 2 * SLICE)
        for s in np.flatnonzero(cells.any(axis=1)):
            yield part_batch([(int(s), 0.0, packed(cells[s]))])

    got = added_up(learn.mapInArrow(count, PARTS), PARTS).toArrow()
    out = np.zeros(((PREDICTORS - 1) * SLOTS // SLICE, 2 * SLICE), np.float32)
    for s, m in zip(got["s"].to_pylist(), got["m"], strict=True):
        out[s] = unpacked(m.as_py())
    return Counts.of(tree.plain.reshape(-1, 2), out.reshape(PREDICTORS - 1, SLOTS, 2))


def trained(learn: DataFrame, tree: Tree, counts: Counts) -> Mixer:
    """Weights learnt online over all of ``learn`` (text), task by task from the same start, and averaged by bits; refining
    tables added up. A bit's own occurrence is left out of the counts that predict it."""
    shared = learn.sparkSession.sparkContext.broadcast((tree, counts))  # some 60 MB at most whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, counts = shared.value
        plain = counts.without()[1]
        m, bits = Mixer.fresh(), 0
        for batch in batches:
            for _, _, buf, off in pieces(batch.column(0)):
                for b in Symbols(Words(buf, off), tree).bits(tree):
                    x, gate = [plain.take(b.step, mode="clip")], b.place.copy()
                    own = b.bit.astype(np.intp) << 8
                    for i in range(PREDICTORS - 1):
                        s = own + counts.states[i].take(b.slots(i), mode="clip")
                        x.append(STRETCH_LESS.take(s, mode="clip"))
                        gate += SEEN_LESS[i].take(s, mode="clip")
                    m.learn(x, gate, b.place, b.bit)
                    bits += len(b.bit)
        if bits:
            flat = [bits * m.by_seen, bits * m.by_place, m.refine]
            yield part_batch([(0, float(bits), packed(np.concatenate([f.ravel() for f in flat])))])

    got = added_up(learn.mapInArrow(run, PARTS), PARTS).toArrow()
    shared.unpersist()
    if not got.num_rows:
        return Mixer.fresh()
    flat, n = unpacked(got["m"][0].as_py()).astype(float), got["n"][0].as_py()
    cut = np.cumsum([SEEN_GATES * PREDICTORS, PLACE_GATES * PREDICTORS])
    return Mixer(flat[: cut[0]].reshape(PREDICTORS, -1) / n, flat[cut[0] : cut[1]].reshape(PREDICTORS, -1) / n, flat[cut[1] :].reshape(PLACE_GATES, BUCKETS, 2))


def fit(learn: DataFrame, vocab: DataFrame, tokens: int, tree_words: int = TREE_WORDS) -> Model:
    """The model of all texts of ``learn`` (text), whose words ``vocab`` has counted."""
    tree = coded(vocab, tokens, tree_words)
    counts = context_counts(learn, tree)
    return Model(tree, counts, trained(learn, tree, counts))


def score(docs: DataFrame, held_mod: int = 5, held_rest: int = 1, tree_words: int = TREE_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    Learns from rows whose crc32(doc_id) mod ``held_mod`` is not ``held_rest`` (a null doc_id is neither
    held out nor learned from). score is the mixed model's log10 probability of the lower-cased tokens and
    the end; documents that were learned from are scored by counts that hold them. For the base score
    words of all documents are counted by range of hash. The at most HEAVY_SHARE words that make up
    1/HEAVY_SHARE of the training tokens or more are sent to every task; the others meet their counts by
    range of hash, in tasks that hold a bounded share of words and of documents. A null or empty text is
    one token, the end. Repeated rows are scored alike. With nothing to learn from, every count is 0 and
    the model is untrained. Weights depend, a little, on how Spark deals the input.
    """
    spark = docs.sparkSession
    rest = remainder(docs["doc_id"], held_mod)
    d = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(rest == held_rest, F.lit(False)).alias("held_out"),
        F.coalesce(rest != held_rest, F.lit(False)).alias("learn"), F.coalesce(docs["text"], F.lit("")).alias("text"),
    )
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (-(-size // PART_BYTES) - 1).bit_length())
    vocab = written(vocabulary(d, bits), "lm_vocabulary")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2, np.int64)
        for batch in batches:
            for x in batch.column(0):
                c = np.frombuffer(x.as_buffer(), np.int64)
                out += [c.sum(), (c > 0).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in out], ["n", "v"])

    n, v = (int(x or 0) for x in vocab.select("c").mapInArrow(sums, "n long, v long").agg(F.sum("n"), F.sum("v")).first())
    model = spark.sparkContext.broadcast(fit(d.filter("learn").select("text"), vocab, n, tree_words))

    limit = max(1, -(-n // HEAVY_SHARE))

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(*(batch.column(i) for i in range(2)), strict=True):
                h, c = (np.frombuffer(x.as_buffer(), t) for x, t in ((h, np.uint64), (c, np.int64)))
                k = c >= limit
                yield pa.RecordBatch.from_arrays([pa.array(h[k].view(np.int64)), pa.array(c[k])], ["h", "c"])

    top = vocab.select("h", "c").mapInArrow(heavy, "h long, c long").toArrow()
    top_h = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(top_h)
    top_h, top_c = top_h[order], top["c"].to_numpy()[order].astype(float)

    coarse = min(bits, MOST_RANGE_BITS, max(4, (-(-n // TOKENS_A_CELL) - 1).bit_length()))
    salts = max(1, -(-n // (TOKENS_A_CELL << coarse)))
    if not len(top_h):
        top_h, top_c = np.zeros(1, np.uint64), np.zeros(1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By range of hash, the documents of a batch and their words that are not heavy; what is known already goes with the first range."""
        turn = None
        for batch in batches:
            uid, doc_id, held = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            for a, b, _, _ in pieces(batch.column(3), 8 << 20):
                turn = int(uid[a]) * 31 % salts if turn is None else (turn + 1) % salts
                parts = []
                for a2, b2, buf2, off2 in pieces(batch.column(3).slice(a, b - a)):
                    w = Words(buf2, off2)
                    h = np.concatenate((w.hash, np.full(b2 - a2, END_HASH)))
                    doc = np.concatenate((w.doc, np.arange(b2 - a2)))
                    i = np.minimum(np.searchsorted(top_h, h), len(top_h) - 1)
                    known = (top_h[i] == h) & (top_c[i] > 0)
                    i, of = i[known], doc[known]
                    sums = [np.bincount(of, x, b2 - a2) for x in (np.ones(len(i)), np.log10(top_c[i] + 0.5))]
                    own = model.value.log2p(w) * math.log10(2)
                    parts.append((h[~known], doc[~known] + a2, np.bincount(doc, minlength=b2 - a2), *sums, own, np.diff(off2)))
                h, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                tokens, known, base, own, size = (np.concatenate([p[j] for p in parts]) for j in range(2, 7))
                part = (h >> np.uint64(64 - coarse)).astype(np.int64) if coarse else np.zeros(len(h), np.int64)
                order = np.argsort(doc, kind="stable")  # nearly in order
                order = order[np.argsort(part[order].astype(np.uint16), kind="stable")]
                h, doc, part = h[order], doc[order], part[order]
                cut = np.searchsorted(part, np.arange((1 << coarse) + 1))
                for p in range(1 << coarse):
                    s = slice(cut[p], cut[p + 1])
                    if cut[p] == cut[p + 1] and p:
                        continue
                    n_of = np.bincount(doc[s], minlength=b - a).astype(np.int32)
                    cols = [base, known.astype(float), own, tokens.astype(float), size.astype(float)] if p == 0 else []
                    ids = pa.array([doc_id.slice(a, b - a).to_pylist() if p == 0 else None], pa.list_(pa.int64()))
                    out = pa.array([held.slice(a, b - a).to_pylist() if p == 0 else None], pa.list_(pa.bool_()))
                    blobs = [pa.array([x], pa.binary()) for x in (h[s].tobytes(), n_of.tobytes(), np.concatenate(cols).tobytes() if cols else b"")]
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([turn], pa.int32()), pa.array([int(uid[a])], pa.int64()), *blobs, ids, out], SPREAD_NAMES)

    given = d.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text").mapInArrow(spread, SPREAD)
    side = vocab.select(F.shiftright("p", bits - coarse).alias("p"), "h", "c").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        hs = [np.frombuffer(x.as_buffer(), np.uint64) for x in right["h"]]
        cs = [np.frombuffer(x.as_buffer(), np.int64) for x in right["c"]]
        h, c = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hs, np.uint64), (cs, np.int64)))
        o = np.argsort(h, kind="stable")
        h, c = h[o], c[o]
        sums = []
        for r in range(left.num_rows):
            w, n_of, own = (np.frombuffer(left[x][r].as_buffer(), t) if left[x][r].as_buffer().size else np.zeros(0, t) for x, t in (("h", np.uint64), ("n_of", np.int32), ("own", float)))
            made = np.zeros((5, len(n_of)))
            if len(own):
                made += own.reshape(5, -1)
            doc = np.repeat(np.arange(len(n_of)), n_of)
            i = np.searchsorted(h, w)
            made[0] += np.bincount(doc, np.log10(c[i] + 0.5), len(n_of))
            made[1] += np.bincount(doc[c[i] > 0], minlength=len(n_of))
            sums.append(made[: 5 if len(own) else 2].tobytes())
        return pa.table({"block": left["block"], "sums": pa.array(sums, pa.binary()), "ids": left["ids"], "held": left["held"]})

    met = given.groupBy("p", "salt").cogroup(side.groupBy("p", "salt")).applyInArrow(meet, "block long, sums binary, ids array<long>, held array<boolean>")

    def together(t: pa.Table) -> pa.Table:
        """The sums of one block of documents over all ranges of hashes."""
        first = next(r for r in range(t.num_rows) if t["ids"][r].is_valid)
        ids, held = t["ids"][first].values, t["held"][first].values
        made = np.zeros((5, len(ids)))
        for x in t["sums"]:
            got = np.frombuffer(x.as_buffer(), float).reshape(-1, len(ids))
            made[: len(got)] += got
        cols = {"base": made[0], "n_known": made[1].astype(np.int64), "own": made[2], "n_tokens": made[3].astype(np.int64), "size": made[4].astype(np.int64)}
        return pa.table({"doc_id": ids, "held_out": held, **cols})

    total = met.groupBy("block").applyInArrow(together, "doc_id long, held_out boolean, base double, n_known long, own double, n_tokens long, size long")
    norm = math.log10(n + 0.5 * (v + 1))
    return total.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        F.col("own").alias("score"), F.when(F.col("size") > 0, -F.col("own") * F.lit(math.log2(10)) / F.col("size")).alias("bits_per_byte"),
    )


SPREAD_NAMES = ["p", "salt", "block", "h", "n_of", "own", "ids", "held"]
SPREAD = "p int, salt int, block long, h binary, n_of binary, own binary, ids array<long>, held array<boolean>"
