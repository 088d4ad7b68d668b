"""Personal data: expressions propose spans, checksums confirm them, words nearby move their score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stateflux.llm.common import slices, tidy

#: Kinds by their order at one start. The first four are the base: they stay whatever their score.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "national")
#: Characters before and after a span in which words count, what they add to or take from a score, and the score that other kinds have to reach.
BEFORE, AFTER, STEP, LEAST = 48, 24, 30, 50


@dataclass(frozen=True)
class Kind:
    """How a kind is found: an expression that every engine reads alike, a first score of 100, and words that raise or lower it."""

    pattern: str
    score: int
    raised_by: tuple[str, ...]
    lowered_by: tuple[str, ...] = field(default=("example", "sample", "test", "version", "isbn", "invoice", "order no"))


SPEC = {
    "email": Kind(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 80, ("mail", "contact", "write to", "correo", "courriel")),
    "ip": Kind(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 60, ("ip", "host", "server", "address", "login")),
    "card": Kind(r"[0-9]([\x20-]?[0-9])+", 80, ("card", "visa", "credit", "debit", "karte", "tarjeta", "carte")),
    "phone": Kind(r"\+[0-9][\x20().0-9-]+[0-9]", 70, ("phone", "tel", "call", "fax", "mobile", "mobil")),
    "iban": Kind(r"\b[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?\b", 80, ("iban", "account", "konto", "cuenta", "compte", "bank")),
    "ssn": Kind(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 30, ("ssn", "social security", "taxpayer")),
    "national": Kind(r"\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b", 30, ("phone", "tel", "call", "fax", "mobile", "mobil")),
}

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# What follows finds what SPEC's expressions do in time linear in the text: a run of digits is tried once, not from each of its digits
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_FAST = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
} | {k: re.compile(SPEC[k].pattern, re.ASCII) for k in KINDS[4:]}
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Whether the digits' checksum is right: from the right, every second one doubled, its digits summed."""
    doubled = [2 * int(d) - 9 * (d > "4") if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number's checksum is right: its first four characters last, letters as 10 to 35, the rest by 97 is 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def confirmed(kind: str, span: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(part := x.lstrip("0")) <= 3 and int(part or 0) <= 255 for x in span.split("."))
    if kind == "iban":
        account = span.replace(" ", "")
        return 15 <= len(account) <= 34 and mod97(account)
    if kind == "ssn":
        return span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"
    if kind == "national":
        return span[0] not in "01" and span[4] not in "01"
    n = len(_digits(span))
    return 10 <= n <= 15 if kind == "phone" else 14 <= n <= 19 and luhn(_digits(span))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: what precedes an @ goes back to the last character that may not stand there, or to the match before."""
    done = 0
    for m in _DOMAIN.finditer(text):
        begins = m.start()
        while begins > done and text[begins - 1] in _LOCAL_CHARS:
            begins -= 1
        if begins < m.start():
            yield begins, m.end()
            done = m.end()


def spans(text: str) -> list[tuple[int, int, int, int]]:
    """start, end, index of the kind, score: the base's confirmed spans, and others that overlap none of them and reach LEAST."""
    found: list[tuple[int, int, int, int]] = []
    taken: list[tuple[int, int]] = []
    digits = any(c in text for c in "0123456789")
    for i, kind in enumerate(KINDS):
        if kind == "email":
            places = _emails(text) if "@" in text else ()
        elif not digits or (kind == "phone" and "+" not in text):
            places = ()
        else:
            places = (m.span() for m in _FAST[kind].finditer(text))
        if i == len(BASE):
            for a, b, *_ in sorted(found):
                if taken and a < taken[-1][1]:
                    taken[-1] = taken[-1][0], max(b, taken[-1][1])
                else:
                    taken.append((a, b))
        for a, b in places:
            if not confirmed(kind, text[a:b]):
                continue
            if i >= len(BASE):
                at = bisect_left(taken, (b, 0)) - 1  # the last that begins before b
                if at >= 0 and taken[at][1] > a:
                    continue
            near = f"{text[max(0, a - BEFORE) : a]}\n{text[b : b + AFTER]}".translate(_LOWER)
            score = SPEC[kind].score + STEP * any(w in near for w in SPEC[kind].raised_by) - STEP * any(w in near for w in SPEC[kind].lowered_by)
            if i < len(BASE) or score >= LEAST:
                found.append((a, b, i, score))
    return sorted(found, key=lambda s: (s[0], s[2]))


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``spans``: kind, start, end (code points, end exclusive), score of 100, of each row.

    A kind's matches are leftmost and don't overlap; those its checksum or its
    limits refuse are dropped and not tried again in part. Kinds beyond the base
    (accounts with a checksum of 97; numbers of insurance and of telephones
    without a country, which need a word that says so) add spans where no base
    span is. A null text is empty and has no spans. Long texts are read whole, in
    time linear in their length. Repeated rows and null ids are rows like others.
    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    kinds, ids = pa.array(KINDS), docs.schema[doc_id].dataType.simpleString()
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [spans(t) if t else [] for t in batch.column(1).to_pylist()]
            flat = [s for row in rows for s in row]
            ends = [0]
            for row in rows:
                ends.append(ends[-1] + len(row))
            parts = [kinds.take(pa.array([s[2] for s in flat], pa.int32())), pa.array([s[0] for s in flat], pa.int64()), pa.array([s[1] for s in flat], pa.int64()), pa.array([s[3] for s in flat], pa.int32())]
            values = pa.StructArray.from_arrays(parts, fields=list(struct))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc_id", "spans"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(work), f"doc_id {ids}, spans array<struct<kind string, start long, end long, score int>>")


def listed(of: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def audit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the number of spans of each base kind, the digest of the base's spans, and all spans, as :func:`found` says."""
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found(docs, doc_id, text).select("doc_id", *counts, F.sha2(listed(of(*BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
