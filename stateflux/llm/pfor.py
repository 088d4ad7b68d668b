"""Token ids in files of patched frame-of-reference blocks.

A file holds documents in ascending id order. Its ids are cut into blocks of
1,024; a block is

    minimum u32 | width u8 | exceptions u16 | packed low bits | places u16[] | high parts u32[]

where width is enough for nine in ten of the ids less the minimum; what does not
fit is an exception, whose low bits are packed with the rest. After the blocks
stand the block starts (u64[]), the document ids (i64[], with one byte each
that says whether the id is null) and lengths (u64[]), then three counts, the
place of the block starts, and the magic word.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateflux.llm.common import parts_for, scratch, slices, tidy
from stateflux.llm.store import NewFile, reader
from stateflux.llm.tokens import encoder

MAGIC = b"PFORIDS1"
BLOCK = 1024
PERCENTILE = 0.9
TRAILER = struct.Struct("<QQQQ8s")
#: Blocks packed at once, and bytes read at once.
GROUP, READ = 256, 1 << 22
#: Bytes of text whose ids stand in one file, at least and at most (about).
SPAN = 1 << 23, 1 << 28


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of ids, the last filled with its own last id."""
    if not len(ids):
        return []
    short = -len(ids) % BLOCK
    values = np.concatenate((ids, np.full(short, ids[-1], ids.dtype))).astype(np.uint64).reshape(-1, BLOCK)
    least = values.min(axis=1)
    values -= least[:, None]
    typical = np.partition(values, int(BLOCK * PERCENTILE), axis=1)[:, int(BLOCK * PERCENTILE)]
    widths = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(int)
    out: list[bytes] = [b""] * len(values)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        part = values[rows]
        bits = np.empty((len(rows), BLOCK, width), np.uint8)
        for k in range(width):
            bits[:, :, k] = part >> np.uint64(k) & np.uint64(1)
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        high = part >> np.uint64(width)
        for i, row in enumerate(rows):
            places = np.flatnonzero(high[i])
            out[row] = struct.pack("<IBH", int(least[row]), width, len(places)) + packed[i].tobytes() + places.astype("<u2").tobytes() + high[i][places].astype("<u4").tobytes()
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """All ids of whole blocks, one after the other."""
    out = np.empty((len(blocks), BLOCK), np.uint32)
    heads = [struct.unpack_from("<IBH", b) for b in blocks]
    for width in {h[1] for h in heads}:
        rows = [i for i, h in enumerate(heads) if h[1] == width]
        packed = np.frombuffer(b"".join(blocks[i][7 : 7 + BLOCK * width // 8] for i in rows), np.uint8).reshape(len(rows), -1)
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, width) if width else np.zeros((len(rows), BLOCK, 0), np.uint8)
        values = np.zeros((len(rows), BLOCK), np.uint32)
        for k in range(width):
            values |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
        out[rows] = values
    for i, (least, width, n) in enumerate(heads):
        if n:
            at = 7 + BLOCK * width // 8
            out[i][np.frombuffer(blocks[i], "<u2", n, at)] |= np.frombuffer(blocks[i], "<u4", n, at + 2 * n) << np.uint32(width)
        out[i] += np.uint32(least)
    return out.ravel()


class Writer:
    def __init__(self, folder: str):
        self.file, self.starts, self.docs, self.lengths = NewFile(folder, ".pfor"), [], [], []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.size += len(ids) // 4
        if self.size >= GROUP * BLOCK:
            self._put(self.size - self.size % BLOCK)

    def _put(self, n: int) -> None:
        data = b"".join(self.held)
        for block in encode_blocks(np.frombuffer(data, "<u4", n)):
            self.starts.append(self.file.write(block))
        self.held, self.size = [data[4 * n :]], self.size - n

    def close(self) -> tuple[str, int, int]:
        """Where the file is, how many documents and ids it has."""
        self._put(self.size)
        at = self.file.write(np.array(self.starts + [self.file.at], "<u8").tobytes())
        self.file.write(np.array([d or 0 for d in self.docs], "<i8").tobytes() + bytes(d is None for d in self.docs) + np.array(self.lengths, "<u8").tobytes())
        self.file.write(TRAILER.pack(len(self.starts), len(self.docs), sum(self.lengths), at, MAGIC))
        self.file.close()
        return self.file.uri, len(self.docs), sum(self.lengths)


class Reader:
    """Random access by block: ``ids(a, b)`` reads only the blocks that hold them."""

    def __init__(self, uri: str):
        self.file = reader(uri)
        size = self.file.size()
        n_blocks, n_docs, self.n_ids, at, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a file of token ids")
        tail = self.file.read_at(size - TRAILER.size - at, at)
        self.starts = np.frombuffer(tail, "<u8", n_blocks + 1)
        at = 8 * (n_blocks + 1)
        docs, null = np.frombuffer(tail, "<i8", n_docs, at), tail[at + 8 * n_docs : at + 9 * n_docs]
        self.docs = [None if no else d for d, no in zip(docs.tolist(), null)]
        self.lengths = np.frombuffer(tail, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)

    def blocks(self, first: int, to: int) -> np.ndarray:
        """The ids of blocks [first, to), in one ranged read."""
        base = int(self.starts[first])
        data = self.file.read_at(int(self.starts[to]) - base, base)
        cuts = [int(x) - base for x in self.starts[first : to + 1]]
        ids = decode_blocks([data[a:b] for a, b in zip(cuts, cuts[1:])])
        return ids[: self.n_ids - first * BLOCK]

    def ids(self, begin: int, end: int) -> np.ndarray:
        if begin >= end:
            return np.empty(0, np.uint32)
        first = begin // BLOCK
        return self.blocks(first, -(-end // BLOCK))[begin - first * BLOCK : end - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """Of each document: its id, the place of its first id in the file, how many ids it has and their crc32."""
        at, held, base, block = 0, b"", 0, 0
        n_blocks = len(self.starts) - 1
        for doc, n in zip(self.docs, self.lengths.tolist()):
            crc, left = 0, n
            while left:
                if not held:
                    to = min(n_blocks, block + GROUP)
                    held, base, block = self.blocks(block, to).astype("<u4").tobytes(), 0, to
                take = min(left, len(held) // 4 - base)
                crc = zlib.crc32(held[4 * base : 4 * (base + take)], crc)
                base, left = base + take, left - take
                if 4 * base == len(held):
                    held = b""
            yield doc, at, n, crc
            at += n


def write_ids(docs: DataFrame, path: str, pattern: str | None, end: int, folder: str, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Writes the ids of every whole text, ``end`` after each, in ascending id order; returns (file, documents, ids) in that order.

    Rows are dealt out by ranges of ids and sorted in each, then tokenised and
    written as they pass; nothing but one row a file reaches the driver. The
    number of files follows from the bytes of text. Null texts are empty, null
    ids come first. Rows with one id stand next to each other in the order of a
    hash of their texts, and ranges may end between them, so an id that very many
    rows have is dealt to several files. Other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, writer, first = encoder(path, pattern), np.array([end], "<u4").tobytes(), None, 0
        for batch in slices(batches):
            if writer is None and batch.num_rows:
                writer, first = Writer(folder), batch.column(2)[0].as_py()
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                writer.add(doc, ids + last)
        if writer:
            uri, n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pylist([{"uri": uri, "docs": n_docs, "ids": n_ids, "null": writer.docs[0] is not None, "least": writer.docs[0] or 0, "hash": first}])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"), F.xxhash64(text).alias("hash"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc()]
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    rows = rows.repartitionByRange(parts_for(docs.sparkSession, size, *SPAN), *order).sortWithinPartitions(*order)
    files = rows.mapInArrow(tidy(work), "uri string, docs long, ids long, null boolean, least long, hash long").collect()
    return [(f["uri"], f["docs"], f["ids"]) for f in sorted(files, key=lambda f: (f["null"], f["least"], f["hash"]))]


def read_back(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone; start counts the ids of all before it."""
    before = list(accumulate((f[2] for f in files), initial=0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(*(c.to_pylist() for c in batch.columns)):
                found = [(d, base + at, n, crc) for d, at, n, crc in Reader(uri).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame([(f[0], b) for f, b in zip(files, before)], "uri string, base long").repartition(max(1, len(files)))
    return rows.mapInArrow(tidy(work), "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_ids(docs: DataFrame, path: str, pattern: str | None, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids written to files in the shared folder and read back from them. An empty table writes no file and gives no rows."""
    spark = docs.sparkSession
    return read_back(spark, write_ids(docs, path, pattern, end, scratch(spark, "ids"), doc_id, text))
