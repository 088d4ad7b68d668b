"""Language identification with rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile is the list of the most frequent character n-grams (one to three
letters, word ends included) in order of frequency. A text gets the language
whose profile is least out of place with its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stateflux.llm.common import slices, tidy

UNKNOWN = "und"
#: n-grams in a profile.
DEPTH = 300
#: Characters that are counted at once while a profile is learned, and n-grams whose counts a task holds before it passes them on.
CHUNK, HELD = 1 << 21, 1 << 20

_alpha: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For every code point, whether it is a letter. Made once a worker."""
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _alpha


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-grams of a whole text and how often each occurs; two empty arrays if it has no letter.

    An n-gram is packed into 63 bits, 21 for each code point, so packing is exact.
    A run of anything but letters is one blank; no n-gram has a blank inside.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[code]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of others, the first
    code = np.where(letter, code, 32)[keep]
    if code[0] != 32:
        code = np.concatenate(([32], code))
    if code[-1] != 32:
        code = np.concatenate((code, [32]))
    alphabet, at = np.unique(code, return_inverse=True)
    size, blank = len(alphabet), int(np.searchsorted(alphabet, 32))
    wide = alphabet.astype(np.int64)
    one = np.bincount(at, minlength=size)
    one[blank] = 0
    found = [(wide, one)]
    pair = at[:-1] * size + at[1:]
    inner = at[1:-1] != blank
    triple = (pair[:-1] * size + at[2:])[inner]
    for grams, n in ((pair, 2), (triple, 3)):
        if size**n <= max(1 << 16, 8 * len(grams)):
            counts = np.bincount(grams, minlength=1)
            value = np.flatnonzero(counts)
            counts = counts[value]
        else:
            value, counts = np.unique(grams, return_counts=True)
        packed = wide[value % size]
        for k in range(1, n):
            packed = packed | (wide[value // size**k % size] << (21 * k))
        found.append((packed, counts))
    packed, counts = (np.concatenate(x) for x in zip(*found))
    return packed[counts > 0], counts[counts > 0].astype(np.int64)


def ranked(packed: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The ``depth`` most frequent n-grams, most frequent first, ties to the smaller packed value."""
    return packed[np.lexsort((packed, -counts))[:depth]]


def learned(docs: DataFrame, text: str, lang: str, trained: Column, depth: int = DEPTH) -> dict[str, list[int]]:
    """Profiles of each language in ``lang``, from all rows for which ``trained`` is true.

    Every task sums its own rows first and sends one row for each language and
    n-gram, or several if it meets more than HELD of them. Only the ranked
    profiles, ``depth`` numbers a language, reach the driver. Ties of counts go
    to the smaller packed n-gram. Repeated rows count each time; rows without
    text or language, or with an empty text, teach nothing.
    """
    rows = docs.where(trained & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, dict[int, int]] = {}
        held: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}

        def add(which: str) -> None:
            total = totals.setdefault(which, {})
            for g, n in zip(*(x.tolist() for x in gram_counts(" ".join(held.pop(which))))):
                total[g] = total.get(g, 0) + n
            sizes[which] = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for which, total in totals.items():
                yield pa.RecordBatch.from_arrays([pa.array([which] * len(total), pa.string()), pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["l", "g", "n"])
            totals.clear()

        for batch in slices(batches):
            for which, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(which, []).append(t)
                sizes[which] = sizes.get(which, 0) + len(t)
                if sizes[which] >= CHUNK:
                    add(which)
            if sum(sizes.values()) >= CHUNK:  # of many languages together
                for which in list(held):
                    add(which)
            if sum(map(len, totals.values())) > HELD:
                yield from passed_on()  # counts of one n-gram are summed after the shuffle, however often they were passed on
        for which in list(held):
            add(which)
        yield from passed_on()

    ranks = F.row_number().over(_by_count())
    top = rows.mapInArrow(tidy(count), "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).withColumn("r", ranks).where(F.col("r") <= depth)
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("l", "r").collect():
        profiles.setdefault(row["l"], []).append(row["g"])
    return profiles


def _by_count():
    from pyspark.sql import Window

    return Window.partitionBy("l").orderBy(F.col("n").desc(), F.col("g"))


class Judge:
    """Compares texts with profiles."""

    def __init__(self, profiles: dict[str, list[int]], depth: int = DEPTH):
        self.depth, self.sorted = depth, []
        for name in sorted(profiles):
            grams = np.array(profiles[name], np.int64)
            order = np.argsort(grams)
            self.sorted.append((name, grams[order], order))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language and 1 - distance / greatest possible distance; ties go to the name that sorts first."""
        if not text or not self.sorted:
            return UNKNOWN, 0.0
        own = ranked(*gram_counts(text), self.depth)
        if not len(own):
            return UNKNOWN, 0.0
        rank, best = np.arange(len(own)), None
        for name, grams, order in self.sorted:
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            out = int(np.where(grams[at] == own, np.abs(order[at] - rank), self.depth).sum())
            if best is None or out < best[0]:
                best = out, name
        return best[1], 1.0 - best[0] / (self.depth * len(own))


def identified(docs: DataFrame, profiles: dict[str, list[int]], text: str, keep: list[str], depth: int = DEPTH, carry_text: bool = False) -> DataFrame:
    """``keep`` columns of every row with ``lang_pred`` and ``score``; with ``carry_text``, the text too.

    A null text, an empty one or one without letters gets ``und`` and 0. Whole
    texts are judged; rows that are repeated are judged alike; languages equally
    far go to the name that sorts first. With no profile (no training row) all
    rows get ``und``; an empty table gives no rows. ``keep`` names columns that
    pass unchanged, others are ignored.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, depth)
        for batch in slices(batches):
            said = [judge(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[not carry_text :], pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], names)

    rows = docs.select(F.col(text), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[not carry_text :]) + ", lang_pred string, score double"
    names = [*rows.columns[not carry_text :], "lang_pred", "score"]
    return rows.mapInArrow(tidy(judged), kinds)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no profile is learned from: crc32 of the id as text leaves 1 on division by 3 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
