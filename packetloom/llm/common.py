"""Shared pieces: tables written to the shared folder, and vectorised text work."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUB_BATCH_BYTES = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one is set only where the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: lineage ends there, executors may go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{re.sub(r'[^a-z0-9]', '_', name)}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which its worker, which waits for the next task, gives back what memory it no longer uses."""

    def run_and_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other systems have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return run_and_trim


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ------------------------------------------------------------------ numpy text kit
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: All ASCII but letters and digits.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 2 * SUB_BATCH_BYTES)
        both = []
        for b in (BASE, BASE_INV):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[0] = have = (both[0], both[1])
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(texts: pa.Array, limit: int = SUB_BATCH_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of whole texts of about ``limit`` bytes, so that work arrays stay small."""
    buf, off = raw_bytes(texts)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


class Words:
    """Words of the texts in a piece: start, end, text number and a 64-bit hash of each, ASCII lower case."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE):
        self.buf, self.off = TO_LOWER[buf], off
        n = len(buf)
        word = ~between[buf]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        edge = off[(off > 0) & (off < n)]
        before[edge], after[edge - 1] = False, False
        self.start, self.end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        p, q = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
        self.hash = mix64((sums[self.end] - sums[self.start]) * q[self.start] + (self.end - self.start).astype(np.uint64))
        self.bounds = np.searchsorted(self.doc, np.arange(len(off)))

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of k-word shingles, offsets by text); a text of fewer words is one shingle, one of none has none."""
        count = np.diff(self.bounds)
        h, n = self.hash, len(self.hash)
        with np.errstate(over="ignore"):
            each = np.zeros(max(0, n - k + 1), np.uint64)
            for j in range(k):
                each = each * BASE + h[j : n - k + 1 + j] if len(each) else each
        each = mix64(each + np.uint64(k))
        made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
        out = np.zeros(len(made) + 1, np.int64)
        np.cumsum(made, out=out[1:])
        hashes = np.empty(out[-1], np.uint64)
        whole = np.repeat(count >= k, made)
        pos = np.arange(out[-1]) - np.repeat(out[:-1], made) + np.repeat(self.bounds[:-1], made)
        hashes[whole] = each[pos[whole]]
        for d in np.flatnonzero((count > 0) & (count < k)):
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in h[self.bounds[d] : self.bounds[d + 1]]:
                    x = x * BASE + w
                hashes[out[d]] = mix64(np.array([x + np.uint64(count[d])]))[0]
        return hashes, out


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start to start + size - 1 of all rows, one after another."""
    at = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - at, size)
