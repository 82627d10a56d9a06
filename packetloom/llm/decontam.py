"""Benchmark decontamination: latent semantic retrieval, then subsequence and answer checks.

Benchmark items and all passages of all documents form a TF-IDF matrix over the benchmark's words;
a distributed randomised SVD gives its latent space. Every window of every document is folded
into that space and compared with every item by cosine; what comes near is checked on the words.
Beside it, windows that hold enough of an item's rarer words are checked too, so that no item that
stands in a window is lost to a cosine that the words around it dilute.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, Words, pieces, ragged, written
from .lm import PARTS, added_up, packed, part_batch, unpacked

BUCKET_BITS = 16
CHUNK, CHUNKS = 16, 3  # windows of 48 words begin every 16
RANK, OVERSAMPLE = 256, 16
ITEM_BLOCK = 1024
CORPUS_WEIGHT = 125.0  # of all corpus passages together in the latent space; a passage of an item weighs 1
ROW_BLOCK, SLICE_ROWS = 16, 128  # of products: rows of a dense block, rows of the slices that are added up
#: The upper triangle of A'A over at most so many words is kept by each task (52 MB) and takes one pass; of more, products with A'A take three.
GRAM_WORDS, GRAM_SLICE, GRAM_ENTRIES = 5120, 1 << 17, 1 << 14
#: Passages of which the latent space keeps less energy than this are compared by their own TF-IDF vectors.
KEPT = 0.99
LEAST_WORDS = 5
PASSAGE = 96  # longer items are looked for by passages of so many words
STOP_IDF = 0.25
CANDIDATES = 4096  # counted at a time
#: Documents without any of the words that are added to the count, so that words of small corpora are not all stop words.
IMAGINED = 1000


def folded(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """(first text, words) of each piece: lower case in any alphabet, ASCII punctuation counts as blank."""
    for a, _, buf, off in pieces(pc.utf8_lower(texts)):
        yield a, Words(buf, off, PUNCTUATION)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents a word of each hash bucket occurs, and how many documents there are."""
    size = 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, w in folded(batch.column(0)):
                key = np.sort(w.doc * size + bucket(w.hash))
                df[:size] += np.bincount(key[np.concatenate(([True], key[1:] != key[:-1]))] % size, minlength=size) if len(key) else 0
            df[size] += batch.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["f", "n"])

    got = docs.select("text").mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1, np.int64)
    df[got["f"].to_numpy()] = got["n"].to_numpy()
    return df[:size], int(df[size])


Batches = Iterator[pa.RecordBatch]
ROWS_SCHEMA = "cols binary, vals binary, sizes binary"


@dataclass
class Passages:
    """Rows that are made from texts in the Python worker that uses them; one mapInArrow after another would hold two workers a task."""

    texts: DataFrame
    rows: Callable[[Batches], Batches]

    def mapInArrow(self, use: Callable[[Batches], Batches], schema: str) -> DataFrame:
        rows = self.rows
        return self.texts.mapInArrow(lambda batches: use(rows(batches)), schema)


def corpus_passages(docs: DataFrame, vocabulary: np.ndarray, maybe: np.ndarray, idf: np.ndarray) -> Passages:
    """Sparse rows of unit length, one for every CHUNK * CHUNKS words of every document: blobs of columns, values and row sizes.

    ``idf``: by word of the vocabulary; passages without any word of it of some weight have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w in folded(batch.column(0)):
                count = np.diff(w.bounds)
                many = -(-count // (CHUNK * CHUNKS))
                row = np.repeat(np.cumsum(many) - many, count) + ragged(np.zeros(len(count), np.int64), count) // (CHUNK * CHUNKS)
                hit = np.flatnonzero(maybe[bucket(w.hash)])
                col = np.minimum(np.searchsorted(vocabulary, w.hash[hit]), len(vocabulary) - 1)
                real = (vocabulary[col] == w.hash[hit]) & (idf[col] > 0)
                key, times = np.unique(row[hit[real]] * len(vocabulary) + col[real], return_counts=True)
                if not len(key):
                    continue
                row, col = np.divmod(key, len(vocabulary))
                v = times * idf[col]
                v /= np.sqrt(np.bincount(row, v * v))[row]
                size = np.bincount(row)
                blobs = (col.astype(np.int32), v.astype(np.float32), size[size > 0].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs], ["cols", "vals", "sizes"])

    return Passages(docs.select("text"), run)


def blocks(row: np.ndarray, col: np.ndarray, val: np.ndarray | None, rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A sparse matrix in order of its rows as (first row, columns, dense block over these columns); no ``val``: counts."""
    cut = np.searchsorted(row, np.arange(0, rows + ROW_BLOCK, ROW_BLOCK))
    some = np.zeros(int(col.max(initial=-1)) + 1, bool)
    at = np.zeros(len(some), np.int64)
    for i in np.flatnonzero(cut[1:] > cut[:-1]):
        s, a = slice(cut[i], cut[i + 1]), int(i) * ROW_BLOCK
        some[col[s]] = True
        u = np.flatnonzero(some)
        some[u] = False
        at[u] = np.arange(len(u))
        size = min(ROW_BLOCK, rows - a)
        x = np.bincount((row[s] - a) * len(u) + at[col[s]], None if val is None else val[s], size * len(u))
        yield a, u, x.reshape(size, len(u)).astype(np.float32)


def product(c: np.ndarray, v: np.ndarray, size: np.ndarray, q: np.ndarray, gram: bool, out: np.ndarray) -> None:
    """Adds to ``out`` A'(A q), or (A q)'(A q), for sparse rows of A."""
    y = np.zeros((len(size), q.shape[1]), np.float32) if gram else None
    for a, u, x in blocks(np.repeat(np.arange(len(size)), size), c, v, len(size)):
        part = x @ q[u]
        if gram:
            y[a : a + len(x)] = part
        else:
            out[u] += x.T @ part
    if gram:
        out += y.T @ y


def corpus_product(rows: DataFrame | Passages, q: np.ndarray, gram: bool) -> tuple[np.ndarray, float]:
    """Sum over all corpus rows of A of A'(A q), or of (A q)'(A q), and the number of rows: each task sends one matrix, in slices that are added up by tasks."""
    q = q.astype(np.float32)
    shape = (q.shape[1] if gram else len(q), q.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = np.zeros(shape, np.float32), 0
        for batch in batches:
            for blobs in zip(*batch.columns, strict=True):
                c, v, size = (np.frombuffer(x.as_buffer(), t) for x, t in zip(blobs, (np.int32, np.float32, np.int32), strict=True))
                product(c, v, size, q, gram, out)
                n += len(size)
        if n:
            yield part_batch([(a // SLICE_ROWS, float(n), packed(out[a : a + SLICE_ROWS])) for a in range(0, shape[0], SLICE_ROWS)])

    total, n = np.zeros(shape), 0.0
    got = added_up(rows.mapInArrow(run, PARTS), PARTS).toArrow()
    for i, m, n in zip(got["s"].to_pylist(), got["m"], got["n"].to_pylist(), strict=True):
        total[i * SLICE_ROWS : (i + 1) * SLICE_ROWS] = unpacked(m.as_py()).reshape(-1, shape[1])
    return total, n


def gram_of(c: np.ndarray, v: np.ndarray, size: np.ndarray, width: int, out: np.ndarray) -> None:
    """Adds the upper triangle of A'A, row after row in ``out``, for sparse rows of A whose columns ascend."""
    at, end = np.arange(len(c)), np.repeat(np.cumsum(size), size)
    for a in range(0, len(c), GRAM_ENTRIES):
        s = slice(a, a + GRAM_ENTRIES)
        many = end[s] - at[s]
        right = ragged(at[s], many)
        i = c[s].astype(np.intp)
        np.add.at(out, np.repeat(i * width - i * (i + 1) // 2, many) + c[right], np.repeat(v[s], many) * v[right])


def corpus_gram(rows: DataFrame | Passages, width: int) -> tuple[np.ndarray, float]:
    """A'A over all corpus rows and the number of rows, in one pass: each task sends one matrix, in slices that are added up by tasks."""
    cells = width * (width + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = np.zeros(cells, np.float32), 0
        for batch in batches:
            for blobs in zip(*batch.columns, strict=True):
                c, v, size = (np.frombuffer(x.as_buffer(), t) for x, t in zip(blobs, (np.int32, np.float32, np.int32), strict=True))
                gram_of(c, v, size, width, out)
                n += len(size)
        if n:
            yield part_batch([(i, float(n), packed(out[a : a + GRAM_SLICE])) for i, a in enumerate(range(0, cells, GRAM_SLICE))])

    flat, n = np.zeros(cells), 0.0
    got = added_up(rows.mapInArrow(run, PARTS), PARTS).toArrow()
    for i, m, n in zip(got["s"].to_pylist(), got["m"], got["n"].to_pylist(), strict=True):
        flat[i * GRAM_SLICE : (i + 1) * GRAM_SLICE] = unpacked(m.as_py())
    total, at = np.zeros((width, width)), 0
    for i in range(width):
        total[i, i:] = total[i:, i] = flat[at : at + width - i]
        at += width - i
    return total, n


def randomised_svd(rows: Passages, given: list[tuple[np.ndarray, np.ndarray]], width: int, rank: int, seed: int = 5, power: int = 2) -> np.ndarray:
    """The right singular vectors (width, rank) of a sparse matrix by subspace iteration.

    Its rows: ``given``, and the distributed ``rows`` scaled so that all of them together weigh CORPUS_WEIGHT.
    These are read once if A'A of them is small enough to keep, else written and read in each iteration.
    """
    c, v = (np.concatenate([x[j] for x in given]) for j in (0, 1))
    own = c, v.astype(np.float32), np.array([len(x[0]) for x in given if len(x[0])], np.int64)
    q = np.random.Generator(np.random.PCG64(seed)).standard_normal((width, min(width, rank + OVERSAMPLE)))
    square = corpus_gram(rows, width) if width <= GRAM_WORDS else None
    rows = rows if square else written(rows.mapInArrow(lambda batches: batches, ROWS_SCHEMA), "lsa_rows")

    def times(gram: bool) -> np.ndarray:
        out = np.zeros((q.shape[1] if gram else width, q.shape[1]))
        product(*own, q.astype(np.float32), gram, out)
        if square:
            total, n = square[0] @ q, square[1]
            total = q.T @ total if gram else total
        else:
            total, n = corpus_product(rows, q, gram)
        return out + total * (min(CORPUS_WEIGHT, n) / max(n, 1.0))

    for _ in range(power):
        q = np.linalg.qr(times(gram=False))[0]
    _, u = np.linalg.eigh(times(gram=True))
    return (q @ u[:, ::-1])[:, :rank]


#: Of windows: text, passage, first word, end word, highest cosine.
Candidates = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Index:
    """Items of one block: what scoring a document needs."""

    ids: list[int]
    sizes: list[int]  # words of each item
    answers: list[np.ndarray]  # hashes of the words its answer check looks for
    item: list[int]  # of each passage, its item; long items have several
    words: list[np.ndarray]  # hashes of each passage's words
    vocabulary: np.ndarray  # sorted word hashes
    maybe: np.ndarray  # bucket -> holds a word of the vocabulary
    idf: np.ndarray  # by bucket
    weight: np.ndarray  # (words of the vocabulary, passages): a word's share of the cosine's numerator
    rarer: np.ndarray  # (words of the vocabulary, passages): 1 for a passage's rarer words
    least: np.ndarray  # of each passage: how many of a window's words are rarer words of it, if the window holds it
    reach: np.ndarray  # of each passage: chunks of such a window

    def __post_init__(self) -> None:
        self.lengths = np.array([len(x) for x in self.words], np.int64)
        self.every = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        #: (words of all passages and one more, passages): how often a passage holds a word.
        self.times = np.zeros((len(self.every) + 1, len(self.words)), np.uint8)
        for i, x in enumerate(self.words):
            u, n = np.unique(x, return_counts=True)
            self.times[np.searchsorted(self.every, u), i] = n
        #: By bucket, the first of ``every`` in it or after it, and one more.
        self.begin = np.searchsorted(self.every, np.arange(1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS))
        self.begin = np.append(self.begin, len(self.every))
        #: By row of ``times``, the word's place in the vocabulary or -1.
        self.column = np.full(len(self.every) + 1, -1)
        self.column[np.searchsorted(self.every, self.vocabulary)] = np.arange(len(self.vocabulary))

    @cached_property
    def both(self) -> np.ndarray:
        """``weight`` and ``rarer`` side by side; made where texts are scored."""
        return np.concatenate([self.weight, self.rarer.astype(np.float32)], axis=1)

    def candidates(self, w: Words, place: np.ndarray, cosine: float) -> list[Candidates]:
        """Windows that come near a passage of an item, or hold enough of its rarer words. ``place``: see ``places``.

        Empty chunks after those of each text keep its windows from reaching into the next text.
        """
        n, passages = len(w.hash), len(self.words)
        if not n or not len(self.vocabulary):
            return []
        count = np.diff(w.bounds)
        chunks = -(-count // CHUNK)
        pad = max(CHUNKS, int(self.reach.max())) - 1
        rows = chunks + pad * (chunks > 0)
        base = np.cumsum(rows) - rows
        every = int(rows.sum())
        starts = every - pad
        text = np.repeat(np.arange(len(rows)), rows)
        real = ragged(np.zeros(len(rows), np.int64), rows) < chunks[text]
        chunk = np.repeat(base, count) + ragged(np.zeros(len(count), np.int64), count) // CHUNK
        energy = np.bincount(chunk, self.idf[bucket(w.hash)] ** 2, every)
        hit = np.flatnonzero(place < len(self.every))
        col = self.column[place[hit]]
        hit, col = hit[col >= 0], col[col >= 0]
        score, held = np.zeros((every, passages), np.float32), np.zeros((every, passages), np.uint8)
        for a, u, x in blocks(chunk[hit], col, None, every):
            x = x @ self.both[u]
            score[a : a + len(x)], held[a : a + len(x)] = x[:, :passages], x[:, passages:]
        total, norm = score[:starts].copy(), energy[:starts].copy()
        for j in range(1, CHUNKS):
            total += score[j : j + starts]
            norm += energy[j : j + starts]
        near = total >= (cosine * np.sqrt(np.maximum(norm, 1e-9)))[:, None].astype(np.float32)
        near[~real[:starts]] = False
        out = self.holding(w, base, text, real, held, near, total, norm)
        at, item = np.divmod(np.flatnonzero(near.ravel()), passages)
        if not len(at):
            return out
        order = np.lexsort((at, item))
        at, item = at[order], item[order]
        value = total[at, item] / np.sqrt(norm[at])
        cut = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (at[1:] > at[:-1] + CHUNKS) | (text[at[1:]] != text[at[:-1]]))))
        begin, end, item = at[cut], at[np.append(cut[1:], len(at)) - 1], item[cut]
        t = text[begin]
        room = np.maximum(0, self.lengths[item] - CHUNK)
        first = np.maximum(w.bounds[t] + (begin - base[t]) * CHUNK - room, w.bounds[t])
        end = np.minimum(w.bounds[t] + (end - base[t] + CHUNKS) * CHUNK + room, w.bounds[t + 1])
        return [*out, (t, item, first, end, np.maximum.reduceat(value, cut))]

    def holding(self, w: Words, base: np.ndarray, text: np.ndarray, real: np.ndarray, held: np.ndarray, near: np.ndarray, total: np.ndarray, norm: np.ndarray) -> list[Candidates]:
        """Like ``candidates``, each window that is not near but has the least count of a passage's rarer words."""
        starts, out = len(near), []
        found = held[:starts].copy()
        for k in range(1, int(self.reach.max()) + 1):
            if k > 1:
                found += held[k - 1 : k - 1 + starts]
            if not (self.reach == k).any():
                continue
            least = np.where(self.reach == k, self.least, 255).astype(np.uint8)  # 255: more than a window has words
            some = np.flatnonzero((found >= least).ravel())
            at, item = np.divmod(some, near.shape[1])
            some = real[at] & ~near.ravel()[some]
            at, item = at[some], item[some]
            t = text[at]
            first = w.bounds[t] + (at - base[t]) * CHUNK
            out.append((t, item, first, np.minimum(first + k * CHUNK, w.bounds[t + 1]), total[at, item] / np.sqrt(np.maximum(norm[at], 1e-9))))
        return out

    def places(self, w: Words) -> np.ndarray:
        """The row of ``times`` of each word; words of no passage have the last, of zeros."""
        b = bucket(w.hash)
        place = np.full(len(b), len(self.every))
        at, end = self.begin[b], self.begin[b + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = self.every[at] == w.hash[left]
            place[left[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            left, at, end = left[more], at[more] + 1, end[more]
        return place

    def hopeful(self, place: np.ndarray, found: Candidates, share: float) -> np.ndarray:
        """Which candidates can pass: a common subsequence has no word oftener than the passage or the region has it."""
        _, item, first, end, _ = found
        most = np.zeros(len(item), np.int64)
        for a in range(0, len(item), CANDIDATES):
            s = slice(a, a + CANDIDATES)
            size = end[s] - first[s]
            of, x = np.repeat(np.arange(len(size)), size), place[ragged(first[s], size)]
            times = self.times[x, item[s][of]]
            some = np.flatnonzero(times)
            key, at, n = np.unique(of[some] * (len(self.every) + 1) + x[some], return_index=True, return_counts=True)
            most[s] = np.bincount(key // (len(self.every) + 1), np.minimum(n, times[some[at]]), len(size))
        return np.flatnonzero(most >= share * self.lengths[item])

    def matches(self, texts: pa.Array, cosine: float, share: float, answer: float) -> Iterator[tuple[int, int, float, int, int, int, int, float]]:
        """(text, item id, cosine, common words, item words, first word, end word, answer share) that pass all checks; of a text and item the best."""
        for a, w in folded(texts):
            best: dict[tuple[int, int], tuple] = {}
            place = self.places(w)
            for some in self.candidates(w, place, cosine):
                keep = self.hopeful(place, some, share)
                for t, i, first, end, value in zip(*(x[keep].tolist() for x in some), strict=True):
                    region, passage = w.hash[first:end], self.words[i]
                    common, last = lcs(passage, region)
                    if common >= share * len(passage):
                        start = int(w.bounds[t])
                        row = (common, value, first - start, first + last - start, np.isin(self.answers[self.item[i]], region))
                        if (t, i) not in best or row[:4] > best[t, i][:4]:
                            best[t, i] = row
            found: dict[tuple[int, int], list[tuple]] = {}
            for (t, i), row in best.items():
                found.setdefault((t, self.item[i]), []).append(row)
            for (t, i), rows in sorted(found.items(), key=lambda x: x[0]):
                common = sum(r[0] for r in rows)
                there = np.any([r[4] for r in rows], axis=0)
                answered = float(there.mean()) if len(there) else 1.0
                if common >= share * self.sizes[i] and answered >= answer:
                    yield a + t, self.ids[i], max(r[1] for r in rows), common, self.sizes[i], min(r[2] for r in rows), max(r[3] for r in rows), answered


def lcs(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Length of the longest common subsequence, by bit-parallel rows, and the end of its last new word in the region."""
    where: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    v, length, last = full, 0, 0
    for j, x in enumerate(region.tolist()):
        if m := where.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
            if (now := len(item) - v.bit_count()) > length:
                length, last = now, j + 1
    return length, last


def sparse(cols: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a passage of these columns, of unit length."""
    c, k = np.unique(cols[idf[cols] > 0], return_counts=True)
    v = k * idf[c]
    return c, v / max(1e-9, float(np.sqrt((v * v).sum())))


def build(docs: DataFrame, items: pa.Table, df: np.ndarray, n: int, share: float) -> Index:
    """The index of one block of items (item_id, text and, where there is one, answer)."""
    idf = np.log((n + IMAGINED) / (df + 1.0))
    hashed = []
    for column in ["text", *(["answer"] if "answer" in items.column_names else [])]:
        words: list[np.ndarray] = []
        for _, w in folded(items[column].combine_chunks()):
            words += [w.hash[w.bounds[t] : w.bounds[t + 1]] for t in range(len(w.bounds) - 1)]
        hashed.append(words)
    use = [i for i, x in enumerate(hashed[0]) if len(x) >= LEAST_WORDS]
    ids, words = [items["item_id"][i].as_py() for i in use], [hashed[0][i] for i in use]
    rare = [x[idf[bucket(x)] >= np.median(idf[bucket(x)])] for x in words]
    answers = [hashed[1][i] if len(hashed) > 1 and len(hashed[1][i]) else r for i, r in zip(use, rare, strict=True)]
    sizes = [len(x) for x in words]
    item = [i for i, x in enumerate(words) for _ in range(0, len(x), PASSAGE)]
    words = [x[j : j + PASSAGE] for x in words for j in range(0, len(x), PASSAGE)]
    rarer, least = [], []
    for x in words:  # of m words, ``need`` common ones are at least need - (m - r) of the r rarest
        y = x[np.argsort(-idf[bucket(x)], kind="stable")]
        need = max(1, math.ceil(share * len(x)))
        r = max(int((idf[bucket(x)] >= STOP_IDF).sum()), len(x) - need + 1)
        rarer.append(y[:r])
        least.append(need - (len(x) - r))
    reach = np.array([max(CHUNKS, -(-(len(x) - 1) // CHUNK) + 1) for x in words], np.int64)
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    vocabulary = vocabulary[(idf[bucket(vocabulary)] >= STOP_IDF) | np.isin(vocabulary, np.concatenate([vocabulary[:0], *rarer]))]
    maybe = np.zeros(1 << BUCKET_BITS, bool)
    maybe[bucket(vocabulary)] = True
    own = np.where(idf[bucket(vocabulary)] >= STOP_IDF, idf[bucket(vocabulary)], 0)
    width = len(vocabulary)
    if not width:
        return Index(ids, sizes, answers, item, words, vocabulary, maybe, idf, np.zeros((0, len(words)), np.float32), np.zeros((0, len(words)), np.uint8), np.array(least), reach)

    def columns(h: np.ndarray) -> np.ndarray:
        c = np.minimum(np.searchsorted(vocabulary, h), width - 1)
        return c[vocabulary[c] == h]

    given = [sparse(columns(x), own) for x in words]
    v = randomised_svd(corpus_passages(docs, vocabulary, maybe, own), given, width, min(RANK, width))
    q = np.zeros((width, len(words)))
    for i, (c, x) in enumerate(given):
        q[c, i] = x
    kept = v.T @ q
    weight = own[:, None] * np.where((kept * kept).sum(axis=0) < KEPT, q, v @ kept)
    member = np.zeros((width, len(words)), np.uint8)
    for i, x in enumerate(rarer):
        member[columns(x), i] = 1
    return Index(ids, sizes, answers, item, words, vocabulary, maybe, idf, weight.astype(np.float32), member, np.array(least), reach)


def indexes(docs: DataFrame, benchmark: DataFrame, share: float) -> list[Index]:
    """One index for each block of about ITEM_BLOCK items; documents pass by each in turn."""
    n_items = benchmark.count()
    blocks = -(-n_items // ITEM_BLOCK)
    if not blocks:
        return []
    df, n = document_frequency(docs)
    keep = [c for c in ("item_id", "text", "answer") if c in benchmark.columns]
    items = benchmark.select(*keep).filter(F.col("text").isNotNull()).withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    return [build(docs, items.filter(F.col("block") == b).select(*keep).orderBy("item_id").toArrow(), df, n, share) for b in range(blocks)]


SCHEMA = "doc_id long, item_id long, cosine double, common_words long, item_words long, first_word long, end_word long, answer_share double"


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.35, share: float = 0.6, answer: float = 0.5) -> DataFrame:
    """A row for each document and item found in it: SCHEMA, words counted from 0 in the document.

    An item is found where a window's latent cosine reaches ``cosine``, or a window as long as the item
    and of 48 words at least holds ``share`` of its words; the longest common word
    subsequence of the region around it reaches ``share`` of the item's words (of a long item: of the
    passage's, and all passages found together of the item's), and at least
    ``answer`` of the words of its answer (without an answer column: of its rarer half) stand there.
    Null and empty texts hold nothing, items under 5 words are not looked for, repeated rows give
    repeated results, an empty benchmark gives none.
    """
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    out: DataFrame | None = None
    for index in indexes(docs, benchmark, share):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(index.matches(batch.column(1), cosine, share, answer))
                cols = list(zip(*rows, strict=True)) or [()] * 8
                ids = batch.column(0).take(pa.array(cols[0], pa.int64()))
                kinds = [pa.int64(), pa.float64(), *[pa.int64()] * 4, pa.float64()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], ["doc_id", "item_id", "cosine", "common_words", "item_words", "first_word", "end_word", "answer_share"])

        found = d.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.35, share: float = 0.6, answer: float = 0.5) -> DataFrame:
    """``docs`` without those in which an item is found; the rows are filtered where they are."""
    at = docs.columns.index("text")
    out = docs
    for index in indexes(docs, benchmark, share):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in index.matches(batch.column(at), cosine, share, answer)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
