"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader and elastic-net penalties, calibrated by a temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, trimmed

BITS = 15
DIM = 1 << BITS
ORDERS = (1, 2, 3)
SCALE = 64.0
FOLDED = 0x110000
UNDETERMINED = "und"


def _fold_table() -> np.ndarray:
    """Letters of all planes to lower case, all else to a blank."""
    out = np.full(FOLDED, 32, np.uint32)
    for a, b in ((0, 0xD800), (0xE000, FOLDED)):
        every = "".join(map(chr, range(a, b)))
        for i, (c, low) in enumerate(zip(every, map(str.lower, every), strict=True), a):
            if c.isalpha():
                out[i] = ord(low) if len(low) == 1 else i
    return out


_fold: list[np.ndarray] = []


def letters(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points, offsets) of UTF-8 texts."""
    if not _fold:
        _fold.append(_fold_table())
    starts = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=starts[1:])
    c = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return _fold[0][c], starts[off]


def grams(c: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each n-gram, offsets by text); n-grams do not cross texts."""
    n = np.maximum(np.diff(off) - order + 1, 0)
    h = np.full(max(0, len(c) - order + 1), order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for j in range(order):
            h = (h ^ c[j : len(c) - order + 1 + j]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        h = (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
    to = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=to[1:])
    if order > 1:
        h = h[np.arange(to[-1]) + np.repeat(off[:-1] - to[:-1], n)]
    return h, to


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (DIM, languages): inverse document frequency times weight
    bias: np.ndarray
    temperature: float

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for _, _, buf, off in pieces(texts):
            c, o = letters(buf, off)
            logit = np.zeros((len(o) - 1, len(self.langs)))
            total = np.zeros(len(o) - 1)
            for order in ORDERS:
                h, to = grams(c, o, order)
                total += np.diff(to)
                some = np.flatnonzero(np.diff(to))
                if len(some):
                    logit[some] += np.add.reduceat(self.table[h], to[some], axis=0, dtype=np.float64)
            sums = np.zeros(len(c) + 1, np.int64)
            np.cumsum(c != 32, out=sums[1:])
            known = (sums[o[1:]] > sums[o[:-1]]) & (len(self.langs) > 0)
            if len(self.langs):
                logit = (logit * (SCALE / np.maximum(total, 1))[:, None] + self.bias) / self.temperature
                p = np.exp(logit - logit.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                at = p.argmax(axis=1)
                names += [self.langs[a] if k else UNDETERMINED for a, k in zip(at, known, strict=True)]
                scores.append(np.where(known, p[np.arange(len(p)), at], 0.0))
            else:
                names += [UNDETERMINED] * (len(o) - 1)
                scores.append(np.zeros(len(o) - 1))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """FTRL-proximal over (lang, features, counts) rows in the given order; every fifth row only calibrates."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros(0), 1.0)
    at = {name: i for i, name in enumerate(langs)}
    bias_row = DIM
    z, n = np.zeros((DIM + 1, len(langs))), np.zeros((DIM + 1, len(langs)))
    fit, held = [r for j, r in enumerate(rows) if j % 5 or len(rows) < 20], [r for j, r in enumerate(rows) if not j % 5]

    def example(r: tuple[str, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
        """Made anew each time: the rows stay as small as they came."""
        lang, i, k = r
        return at[lang], np.append(i.astype(np.int64), bias_row), np.append(SCALE * idf[i] * k / max(1, int(k.sum())), 1.0)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for r in fit:
            y, i, x = example(r)
            w = weights(i)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(np.arange(DIM + 1))
    logits = np.array([x @ w[i] for _, i, x in map(example, held)])
    truth = np.array([at[r[0]] for r in held])

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

    best = min(np.geomspace(0.25, 4, 41), key=loss)
    return Model(langs, (w[:DIM] * idf[:, None]).astype(np.float32), w[DIM], float(best))


def remainder(doc_id: Column, mod: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(mod))


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all the texts (one column) each feature occurs, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(DIM + 1, np.int64), 0
        for batch in batches:
            for _, _, buf, off in pieces(batch.column(0)):
                c, o = letters(buf, off)
                made = [grams(c, o, order) for order in ORDERS]
                for d in range(len(o) - 1):
                    mark = np.zeros(DIM, bool)
                    for h, to in made:
                        mark[h[to[d] : to[d + 1]]] = True
                    df[:DIM] += mark
            df[DIM] += batch.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["f", "n"])

    got = texts.mapInArrow(trimmed(run), "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(DIM + 1, np.int64)
    df[got["f"].to_numpy()] = got["n"].to_numpy()
    return df[:DIM], int(df[DIM])


def sampled_features(docs: DataFrame, max_train: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Features of about ``max_train`` labelled rows, spread evenly over all languages and chosen by id hash.

    A language has a row in the result of the count, as labels are few; each has one row at least in the sample, however many there are.
    """
    counts = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = max(1.0, max_train / len(counts))
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, share / n))]), F.col("lang"))
    order = F.xxhash64(F.lit("langid"), "doc_id")
    docs = docs.withColumn("order", order)
    least = docs.groupBy("lang").agg(F.min_by("doc_id", F.struct("order", "doc_id")).alias("least"))
    first = F.create_map(*[F.lit(x) for r in least.collect() for x in (r[0], r[1])])
    taken = F.coalesce(F.pmod("order", F.lit(1 << 30)) < rate * (1 << 30), F.lit(False)) | F.coalesce(F.col("doc_id") == F.element_at(first, F.col("lang")), F.lit(False))
    chosen = docs.filter(taken).select("lang", "order", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, many = [], []
            for _, _, buf, off in pieces(batch.column(2)):
                c, o = letters(buf, off)
                made = [grams(c, o, order) for order in ORDERS]
                for d in range(len(o) - 1):
                    i, k = np.unique(np.concatenate([h[to[d] : to[d + 1]] for h, to in made]), return_counts=True)
                    found.append(i.astype(np.uint16).tobytes())
                    many.append(np.minimum(k, 65535).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary()), pa.array(many, pa.binary())], ["lang", "order", "i", "k"])

    got = chosen.mapInArrow(trimmed(run), "lang string, order long, i binary, k binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["order"], r["lang"], r["i"], r["k"]))
    return [(r["lang"], np.frombuffer(r["i"], np.uint16), np.frombuffer(r["k"], np.uint16)) for r in got]


def fit(docs: DataFrame, max_train: int = 3000, held_mod: int = 4, held_rest: int = 2) -> Model:
    """A model from rows whose crc32(doc_id) mod ``held_mod`` is not ``held_rest``: document frequencies from
    all of their texts, weights and temperature from at most about ``max_train`` of those with a lang."""
    learn = docs.filter(remainder(docs["doc_id"], held_mod) != held_rest).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    df, n = document_frequency(learn.select("text"))
    idf = np.log((n + 1.0) / (df + 1.0)) + 0.05
    return train(sampled_features(learn.filter(F.col("lang").isNotNull()), max_train), idf)


def identify(docs: DataFrame, model: Model, held_mod: int = 4, held_rest: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, from its whole text alone.

    A null text, or one without letters, is ``und`` with score 0; so is every text if no row had a
    lang to learn from. At equal scores the language first in code-point order wins. A null doc_id is
    not held out and not learned from. Repeated rows get the same result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(remainder(docs["doc_id"], held_mod) == held_rest, F.lit(False))
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held.alias("held_out"), docs["text"].alias("text"))
    return d.mapInArrow(trimmed(run), "doc_id long, held_out boolean, lang_pred string, score double")


def identified_only(docs: DataFrame, model: Model, min_score: float = 0.4) -> DataFrame:
    """``docs`` without rows whose language is undetermined or predicted with less than ``min_score``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column(at))
            yield batch.filter(pa.array([x != UNDETERMINED and s >= min_score for x, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
