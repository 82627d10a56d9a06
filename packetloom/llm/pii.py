"""Personal data: patterns propose spans, checksums confirm them, context words move the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order in which spans are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
DIGITS = re.compile(r"[0-9]")
#: Words that, near a span, speak for or against its kind.
CONTEXT = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "credit", "visa", "mastercard", "payment", "cc"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer", "konto"),
}
AGAINST = ("version", "example", "sample", "release", "isbn", "serial")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.85}
NEAR = 48
DOUBLE = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    n = [ord(c) - 48 for c in reversed(digits)]
    return (sum(n[::2]) + sum(DOUBLE[x] for x in n[1::2])) % 10 == 0


def mod97(text: str) -> bool:
    """The IBAN check: the first four characters go last, letters count 10 to 35, the remainder is 1."""
    rest = 0
    for c in text[4:] + text[:4]:
        rest = (rest * (100 if c > "9" else 10) + int(c, 36)) % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outward, which finds the leftmost matches without trying every start of a long word."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def propose(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of every kind, by kind and start."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    if not DIGITS.search(text):
        return
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in ((x.lstrip("0") or "0") for x in m[0].split("."))):
                yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := "".join(DIGITS.findall(m[0]))) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGITS.findall(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, raised by a word of its context within NEAR characters and lowered by a word against it."""
    near = set(re.findall(r"[a-z]+", (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()))
    return round(min(1.0, max(0.0, PRIOR[kind] + 0.1 * bool(near & set(CONTEXT[kind])) - 0.2 * bool(near & set(AGAINST)))), 4)


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, spans array<struct<kind: string, start: int, stop: int, score: double>>"


def find_pii(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """(doc_id, spans) for every row of ``docs``; positions are code points, the end exclusive.

    Null and empty texts have no spans. The text is read whole at any length: each pattern runs in
    time linear in it. Base kinds are kept whatever their score; others need ``min_score``. Repeated
    rows give repeated results; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                rows = [{"kind": k, "start": s, "stop": e, "score": score(t, k, s, e)} for k, s, e in propose(t)] if t else []
                out.append([r for r in rows if r["kind"] in BASE or r["score"] >= min_score])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, SCHEMA)


def pii_report(docs: DataFrame) -> DataFrame:
    """The digest columns of find_pii: counts by base kind, a hash of the base spans, all spans."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_iban long, max_score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                all_ = [(s["kind"], s["start"], s["stop"]) for s in spans]
                base = listed([s for s in all_ if s[0] in BASE])
                n = {k: sum(s[0] == k for s in all_) for k in KINDS}
                rows.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(base.encode()).hexdigest(), listed(all_), n["iban"], max((s["score"] for s in spans), default=None)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_iban", "max_score"])

    return find_pii(docs).mapInArrow(run, schema)


def redacted(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the earlier kind's stays."""
    taken: list[tuple[int, int, str]] = []
    for k, a, b in propose(text):
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, k))
    out, at = [], 0
    for a, b, k in sorted(taken):
        out += [text[at:a], f"<{k}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; no row goes, null texts stay null."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if t is None else redacted(t) for t in b.column(at).to_pylist()], b.column(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)
