"""Packing by concatenate and cut: prefix sums over partition totals give global offsets, fixed windows cut the stream."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateflux.llm.common import slices, tidy, written
from stateflux.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, path: str, pattern: str | None, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pass one: doc_id, the part it is in, its first place in that part, and its ids with ``end`` after them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, encode, last = TaskContext.get().partitionId(), 0, encoder(path, pattern), np.array([end], "<u4").tobytes()
        for batch in slices(batches):
            ids = [x + last for x in encode(batch.column(1).to_pylist())]
            ends = list(accumulate((len(x) // 4 for x in ids), initial=place))
            place = ends[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(ends[:-1], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "part", "place", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(tidy(work), "doc_id long, part int, place long, ids binary")


def pack(docs: DataFrame, path: str, pattern: str | None, end: int, window: int = 2048, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces that ``window``-long sequences are made of, one row each.

    Documents stand in the order of the input's parts, and in a part in the
    order of its rows. Pass one tokenises every text once and writes the ids to
    the shared folder; the parts' totals, one number each, give every part its
    global offset; pass two cuts at multiples of ``window``. A document that
    crosses a border has a piece on either side. No row is shuffled. Only the
    very last sequence can be short: it alone may need padding.

    A null or empty text is the end token alone. Rows with a null or repeated
    id are documents like others. An empty table gives no rows. With
    ``with_ids`` the pieces also carry their ids.
    """
    rows = written(tokenised(docs, path, pattern, end, doc_id, text), "tokens")
    totals = rows.groupBy("part").agg(F.max(F.col("place") + F.octet_length("ids") / 4).cast("long").alias("n")).orderBy("part").collect()
    before = dict(zip((r["part"] for r in totals), accumulate((r["n"] for r in totals), initial=0)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for doc, part, place, ids in zip(*(c.to_pylist() for c in batch.columns)):
                first, n, at = before[part] + place, len(ids) // 4, 0
                while at < n:
                    offset = (first + at) % window
                    length = min(n - at, window - offset)
                    piece = ids[4 * at : 4 * (at + length)]
                    for col, value in zip(out, (doc, at, length, zlib.crc32(piece), n, (first + at) // window, offset, piece)):
                        col.append(value)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:7]] + [pa.array(c, pa.binary()) for c in out[7:]], names)

    kinds = PIECES + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in kinds.split(", ")]
    return rows.select("doc_id", "part", "place", "ids").mapInArrow(tidy(cut), kinds)
