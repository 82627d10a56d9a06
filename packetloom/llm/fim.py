"""Fill-in-middle: texts as ropes, split at two unit ranks, rearranged with sentinels, and rebuilt by splitting again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_bytes

P, S, M = b"<P>", b"<S>", b"<M>"
#: Leaves end at the first unit that starts after so many bytes; texts are cut by windows of so many bytes.
LEAF_BYTES, WINDOW = 1 << 11, 1 << 18
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes that begin a code point.
FIRST = (np.arange(256) & 0xC0) != 0x80
UNITS, POINTS, BYTES = range(3)


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Where units begin: runs of A-Z and a-z, and every other code point."""
    letter = LETTER[data]
    new = FIRST[data]
    new[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(new)


class Rope:
    """A leaf (its bytes) or an inner node (two subtrees), with counts of units, code points and bytes below it."""

    __slots__ = ("data", "left", "right", "size")

    def __init__(self, data: np.ndarray | None, left: Rope | None, right: Rope | None, size: tuple[int, int, int]):
        self.data, self.left, self.right, self.size = data, left, right, size


def leaf(data: np.ndarray) -> Rope:
    return Rope(data, None, None, (len(unit_starts(data)), int(FIRST[data].sum()), len(data)))


EMPTY = leaf(np.zeros(0, np.uint8))
SENTINELS = {x: leaf(np.frombuffer(x, np.uint8)) for x in (P, S, M)}


def concat(*ropes: Rope) -> Rope:
    """One rope of several in order, paired up so that depth grows by the logarithm of their number."""
    now = [r for r in ropes if r.size[BYTES]] or [EMPTY]
    while len(now) > 1:
        now = [
            Rope(None, a, b, (a.size[0] + b.size[0], a.size[1] + b.size[1], a.size[2] + b.size[2])) for a, b in zip(now[::2], now[1::2], strict=False)
        ] + ([now[-1]] if len(now) % 2 else [])
    return now[0]


def rope(data: np.ndarray) -> Rope:
    """The balanced rope of a text; every leaf ends between units, so counts of leaves add up."""
    leaves, at = [], 0
    while at < len(data):
        window = data[at : at + WINDOW]
        starts = unit_starts(window)
        if at + WINDOW < len(data):
            # The last unit may go on beyond the window: it is left to the next, or found whole if it fills this one.
            if len(starts) > 1:
                window, starts = window[: starts[-1]], starts[:-1]
            else:
                rest = np.flatnonzero(~LETTER[data[at + 1 :]])
                window = data[at : at + 1 + (int(rest[0]) if len(rest) else len(data))]
        cuts = starts[np.unique(np.searchsorted(starts, np.arange(LEAF_BYTES, len(window), LEAF_BYTES)))[:-1]] if len(window) > LEAF_BYTES else starts[:0]
        edges = [0, *cuts.tolist(), len(window)]
        points = np.cumsum(FIRST[window])
        first = np.searchsorted(starts, edges)
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if b > a:
                n = int(points[b - 1]) - (int(points[a - 1]) if a else 0)
                leaves.append(Rope(window[a:b], None, None, (int(first[i + 1] - first[i]), n, b - a)))
        at += len(window)
    return concat(*leaves)


def split(r: Rope, at: int, by: int = UNITS) -> tuple[Rope, Rope]:
    """(the first ``at`` units, code points or bytes, the rest); only leaves on one path are cut."""
    if at <= 0:
        return EMPTY, r
    if at >= r.size[by]:
        return r, EMPTY
    if r.data is not None:
        cut = at if by == BYTES else int((unit_starts(r.data) if by == UNITS else np.flatnonzero(FIRST[r.data]))[at])
        return leaf(r.data[:cut]), leaf(r.data[cut:])
    here = r.left.size[by]
    if at == here:
        return r.left, r.right
    if at < here:
        a, b = split(r.left, at, by)
        return a, concat(b, r.right)
    a, b = split(r.right, at - here, by)
    return concat(r.left, a), b


def flat(r: Rope) -> bytes:
    """The bytes below a rope, read from leaf to leaf."""
    out, todo = [], [r]
    while todo:
        x = todo.pop()
        if x.data is not None:
            out.append(x.data.tobytes())
        else:
            todo += [x.right, x.left]
    return b"".join(out)


def form_of(data: bytes, h3: int, h4: int, plain: int, spm: int) -> str:
    if not data or h3 % 100 >= 100 - plain or P in data or S in data or M in data:
        return "plain"
    return "spm" if h4 % 100 < spm else "psm"


def rearranged(r: Rope, a: int, b: int, form: str) -> tuple[Rope, int, int]:
    """(the rope with sentinels, code points of its prefix, of its middle) of a rope split at unit ranks a <= b."""
    head, suffix = split(r, b)
    prefix, middle = split(head, a)
    parts = (SENTINELS[S], suffix, SENTINELS[P], prefix, SENTINELS[M], middle) if form == "spm" else (SENTINELS[P], prefix, SENTINELS[S], suffix, SENTINELS[M], middle)
    return concat(*parts), prefix.size[POINTS], middle.size[POINTS]


def rebuilt(data: np.ndarray, form: str) -> bytes:
    """The text before it was rearranged: the output's rope split at its sentinels, its parts put in order."""
    if form == "plain":
        return data.tobytes()
    raw = data.tobytes()
    first, second = (S, P) if form == "spm" else (P, S)
    i, j = raw.find(second), raw.find(M)
    if not raw.startswith(first) or not 0 < i < j:
        raise ValueError(f"not a text of form {form}")
    head, middle = split(rope(data), j, BYTES)
    one, two = split(head, i, BYTES)
    one, two, middle = (split(x, len(P), BYTES)[1] for x in (one, two, middle))
    return flat(concat(two, middle, one) if form == "spm" else concat(one, middle, two))


def texts(made: list[bytes | None]) -> pa.Array:
    return pa.array(made, pa.binary()).cast(pa.string())


FIM = "struct<n: bigint, form: string, fim_text: string, prefix_chars: bigint, middle_chars: bigint>"
MADE = ("n", "form", "fim_text", "prefix_chars", "middle_chars")


def fim_column(text: Column, draw: Column, plain: int, spm: int) -> Column:
    """FIM of each text; ``draw`` is at least 32 hex digits."""

    @F.arrow_udf(FIM)
    def made(column: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for t, d in column:
            buf, off = raw_bytes(t)
            n, form, out, prefix, middle = [], [], [], [], []
            for i, hexed in enumerate(d.to_pylist()):
                data = buf[off[i] : off[i + 1]]
                h = [int(hexed[k : k + 8], 16) for k in range(0, 32, 8)]
                r = rope(data)
                raw = data.tobytes()
                f = form_of(raw, h[2], h[3], plain, spm)
                n.append(r.size[UNITS])
                form.append(f)
                if f == "plain":
                    out.append(raw)
                    prefix.append(None)
                    middle.append(None)
                    continue
                a, b = sorted((h[0] % (n[-1] + 1), h[1] % (n[-1] + 1)))
                whole, p, m = rearranged(r, a, b, f)
                out.append(flat(whole))
                prefix.append(p)
                middle.append(m)
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(form, pa.string()), texts(out), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())], list(MADE))

    return made(text, draw)


def restored(text: Column, form: Column) -> Column:
    """The exact text before ``fill_in_middle``, from its ``fim_text`` and ``form`` alone."""

    @F.arrow_udf("string")
    def made(column: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for t, f in column:
            buf, off = raw_bytes(t)
            yield texts([rebuilt(buf[off[i] : off[i + 1]], x) for i, x in enumerate(f.to_pylist())])

    return made(text, form)


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """``docs`` with n, form, fim_text, prefix_chars and middle_chars.

    Units are runs of A-Z and a-z and every other code point. sha256 of ``seed:doc_id`` (a null id counts as
    empty) draws two unit ranks and the form: ``plain`` per cent of texts, empty and null ones (as empty) and
    those that hold a sentinel stay as they are, of the others ``spm`` per cent are suffix first. Equal ids draw
    alike, so repeated rows have equal results. A text is read whole; its rope is built by windows, so that
    besides the text only its leaves are held. Columns of the made names are replaced, others are carried
    along in the JVM. An empty table gives an empty table.
    """
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), 256)
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in MADE]
    d = docs.select(*keep, fim_column(docs["text"], draw, plain, spm).alias("__fim"))
    return d.select(*[c for c in keep], *[F.col(f"__fim.{c}").alias(c) for c in MADE])


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of fill_in_middle and of its inverse."""
    d = fill_in_middle(docs.select("doc_id", "text"))
    back = restored(F.col("fim_text"), F.col("form"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
r AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""
