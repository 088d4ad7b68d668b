"""Exact top-k inner products from an impact-ordered index, score at a time.

Vectors lie in blocks. A block is indexed by postings (vector, component, value),
ordered by level of impact: the size of the value, quantised at the quantiles of
the block's sizes, so that one outlier does not empty the upper levels. Levels
are worked off by descending impact, for some queries at once, adding to
accumulators. What is still to come for a vector and a query is at most the
length of the vector's rest times the length of the query's weights in the
components of that rest (Cauchy and Schwarz). The work on a block stops only when
that proves that few vectors can still be among the best; those are scored
exactly. What earlier blocks gave raises the score that later ones must reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stateflux.llm.common import Work, slices, tidy, written
from stateflux.llm.store import reader

#: Vectors in a block, queries in a batch, of those worked on at once, impact levels, possible members a query that are scored at once.
BLOCK, BATCH, AT_ONCE, LEVELS, FEW = 4096, 2048, 256, 8, 48
#: Components of the vectors whose blocks a task holds, and of the queries in one file.
SPAN, FILE = 1 << 22, 1 << 24
#: With more parts of the index than this, one in so many of them first gives every query a score to reach.
SAMPLE = 64
#: Scores from here on, in size, have no 64 bits: such pairs of a query and a vector are left out.
LARGEST = float(1 << 63)
NONE = np.iinfo(np.int64).min
FOUND = "query_id long, vec_id long, score long"
ROWS = "dim int, width int, ids binary, v binary"


def quantised(rows: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as long.

    Vectors that are null or empty, hold a null or non-finite component or one that is no 64-bit integer then are left out.
    """
    sound = F.expr(f"`{embedding}` is not null and size(`{embedding}`) > 0 and forall(`{embedding}`, x -> x is not null and abs(cast(x as double)) < double('Infinity'))")
    large = F.expr(f"forall(`{embedding}`, x -> abs({scale}D * cast(x as double)) < 9e18D)")
    return rows.where(sound).where(large).select(F.col(vec_id).cast("long").alias("vec_id"), F.expr(f"transform(`{embedding}`, x -> floor({scale} * cast(x as double)))").alias("v"))


def blocked(vectors: DataFrame, parts: int, n: int) -> DataFrame:
    """Rows (dim, width, ids, v) of at most ``n`` vectors of one length, their components in ``width`` bytes each.

    Rows are dealt out by a hash of id and components, so neither copies of one vector nor rows that repeat an id stay together.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def row(dim: int) -> pa.RecordBatch:
            ids, v = (np.concatenate(x) for x in zip(*held.pop(dim)))
            width = next(w for w in (2, 4, 8) if -(1 << 8 * w - 1) <= v.min() and v.max() < 1 << 8 * w - 1)
            return pa.RecordBatch.from_pylist([{"dim": dim, "width": width, "ids": ids.astype("<i8").tobytes(), "v": v.astype(f"<i{width}").tobytes()}], pa.schema([("dim", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("v", pa.binary())]))

        for batch in slices(batches, n):
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            dims = np.diff(starts)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                own = held.setdefault(dim, [])
                if own and sum(len(x) for x, _ in own) + len(rows) > n:
                    yield row(dim)
                    own = held.setdefault(dim, [])
                own.append((ids[rows], flat[starts[rows][:, None] + np.arange(dim)]))
            while sum(v.size for own in held.values() for _, v in own) > SPAN:  # of many lengths
                yield row(max(held, key=lambda d: sum(v.size for _, v in held[d])))
        for dim in list(held):
            yield row(dim)

    return vectors.select("vec_id", "v").repartition(parts, F.xxhash64("vec_id", "v")).mapInArrow(tidy(work), ROWS)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components of a row."""
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["v"], f"<i{row['width']}").reshape(-1, row["dim"])


class Segments:
    """The postings of a block by descending level of impact.

    ``proofs`` and ``early`` count how many groups of queries were worked on and
    how many of them ended, by proof, before the last level.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.spare = ids, vectors, len(ids) - len(np.unique(ids))
        row, component = np.nonzero(vectors)
        value = vectors[row, component]
        size = np.abs(value.astype(np.float64))
        cuts = np.quantile(size, np.arange(1, LEVELS) / LEVELS) if len(size) else np.zeros(LEVELS - 1)
        level = LEVELS - 1 - np.searchsorted(cuts, size, side="right")  # 0: the greatest impact
        order = np.lexsort((component, level))
        self.row, self.component, self.value = row[order].astype(np.int32), component[order].astype(np.int32), value[order]
        self.ends = np.searchsorted(level[order], np.arange(LEVELS + 1))
        squares = size[order] ** 2
        self.rest = [np.sqrt(np.bincount(self.row[e:], squares[e:], len(ids))) for e in self.ends[1:]]
        self.length = np.sqrt(np.bincount(self.row, squares, len(ids)))
        self.proofs = self.early = 0

    def _matrix(self, begin: int, end: int, value: np.ndarray | float) -> np.ndarray:
        out = np.zeros(self.vectors.shape)
        out[self.row[begin:end], self.component[begin:end]] = value
        return out

    def best(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score) of the k best of this block for each query, none with the query's own id or with a score below its floor."""
        n, weights = len(self.ids), queries.astype(np.float64)
        k += self.spare  # rows that repeat an id must not crowd others out
        lengths = np.sqrt((weights**2).sum(axis=1))
        total = np.zeros((len(queries), n))
        own = query_ids[:, None] == self.ids[None, :]
        # sums of products that pass 2 ** 53 are rounded: by at most this
        rounding = lengths[:, None] * self.length[None, :] * ((queries.shape[1] + LEVELS + 4) * 2.0**-52)
        reached = np.where(floor == NONE, -np.inf, floor.astype(np.float64) * (1 - np.sign(floor) * 2.0**-52))
        for done in range(1, LEVELS + 1):
            begin, end = self.ends[done - 1], self.ends[done]
            if end > begin:
                total += weights @ self._matrix(begin, end, self.value[begin:end]).T
            if done < LEVELS and 2 * done <= LEVELS:
                continue  # too early for a proof
            slack = rounding
            if done < LEVELS:
                left = np.sqrt(weights**2 @ self._matrix(end, len(self.row), 1.0).T)
                slack = slack + left * self.rest[done - 1][None, :] * (1 + 1e-9)
            # a pair that may have no score proves nothing about others
            low = np.where(own | (np.abs(total) + slack >= LARGEST), -np.inf, total - slack)
            least = np.partition(low, n - k, axis=1)[:, n - k] if k <= n else np.full(len(queries), -np.inf)
            possible = (total + slack >= np.maximum(least, reached)[:, None]) & ~own
            if done == LEVELS or possible.sum() <= FEW * len(queries):
                break
        self.proofs, self.early = self.proofs + 1, self.early + (done < LEVELS)
        which, row = np.nonzero(possible)
        scores = np.empty(len(row), np.int64)
        for at in range(0, len(row), 1 << 16):
            cut = slice(at, at + (1 << 16))
            scores[cut] = np.einsum("ij,ij->i", self.vectors[row[cut]].astype(np.int64), queries[which[cut]].astype(np.int64))
        # sums of 64 bits wrap, and are right if the score has so many: by the rounded one, or where that is near the limit by long integers
        near = np.abs(total[which, row]) + (rounding[which, row] if done == LEVELS else slack[which, row])
        fits = near < LARGEST
        for i in np.flatnonzero(~fits):
            score = sum(int(a) * int(b) for a, b in zip(self.vectors[row[i]], queries[which[i]]))
            fits[i] = -(1 << 63) <= score < 1 << 63
        return which[fits], self.ids[row[fits]], scores[fits]


def foremost(which: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query, by place, its k best different ids: each by its best score, ties to the smaller id."""
    order = np.lexsort((-scores, ids, which))
    which, ids, scores = which[order], ids[order], scores[order]
    first = np.ones(len(which), bool)
    first[1:] = (which[1:] != which[:-1]) | (ids[1:] != ids[:-1])
    which, ids, scores = which[first], ids[first], scores[first]
    order = np.lexsort((ids, -scores, which))
    which, ids, scores = which[order], ids[order], scores[order]
    keep = np.arange(len(which)) - np.searchsorted(which, which) < k
    return which[keep], ids[keep], scores[keep]


def batches_of(files: list[str]) -> Iterator[dict]:
    """The rows of Parquet files in the shared folder, one at a time."""
    for uri in files:
        with reader(uri) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1):
                yield from batch.to_pylist()


def searched(index: DataFrame, files: list[str], k: int) -> DataFrame:
    """query_id, vec_id, score: of the blocks that a task holds, each query's k best. Batches of queries stream past the blocks, out of ``files``."""

    def search(held: list[dict]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[Segments]] = {}
        for row in held:
            blocks.setdefault(row["dim"], []).append(Segments(*unpacked(row)))
        for batch in batches_of(files):
            if batch["dim"] not in blocks:
                continue
            query_ids, queries = unpacked(batch)
            floors = np.frombuffer(batch["floors"], "<i8") if batch.get("floors") else np.full(len(query_ids), NONE)
            for at in range(0, len(query_ids), AT_ONCE):
                some = slice(at, at + AT_ONCE)
                floor, found = floors[some].copy(), (np.empty(0, np.int64),) * 3
                for block in blocks[batch["dim"]]:
                    new = block.best(queries[some], query_ids[some], k, floor)
                    found = foremost(*(np.concatenate(x) for x in zip(found, new)), k)
                    full = np.bincount(found[0], minlength=len(floor)) == k
                    if full.any():  # the k-th best of those with k
                        last = np.searchsorted(found[0], np.flatnonzero(full), side="right") - 1
                        floor[full] = np.maximum(floor[full], found[2][last])
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[some][found[0]]), pa.array(found[1]), pa.array(found[2])], ["query_id", "vec_id", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and size + len(row["v"]) // row["width"] > 2 * SPAN:
                    yield from search(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["v"]) // row["width"]
        if held:
            yield from search(held)

    return index.mapInArrow(tidy(work), FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def exact_top_k(rows: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, its k highest integer inner products with other rows.

    The index and the queries, in blocks, are written to the shared folder. A
    task reads its part of the index once and lets all batches of queries pass,
    so nothing is copied for each pair of a block and a batch. Each part gives k
    candidates a query at most. With more than SAMPLE parts, a first pass over
    one in SAMPLE of them gives each query a score that its k best reach, and
    the others give only candidates that reach it.

    Ties go to the smaller id. Fewer than k others: all. Vectors of another
    length than the query's are no candidates. Rows that repeat an id are one
    candidate, with the best of their scores; as queries they are one, each
    candidate with the best score any of them gives. Rows with a null id or
    vector, an empty vector, null or non-finite components, or one that quantised
    is beyond 9e18 in size, take no part; a pair whose score has no 64 bits is
    left out, its vectors are not. An empty table gives no rows. Other columns
    are ignored.
    """
    vectors = quantised(rows, vec_id, embedding, scale).where(F.col("vec_id").isNotNull())
    asking = F.col("vec_id") % every == 0
    size, size_asked = (x or 0 for x in vectors.agg(F.sum(F.size("v")), F.sum(F.when(asking, F.size("v")))).first())
    parts = max(1, -(-size // SPAN))
    if not size_asked:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    with Work() as work:
        index = work.written(blocked(vectors, parts, BLOCK), "vectors")
        asked = work.written(blocked(vectors.where(asking), max(1, -(-size_asked // FILE)), BATCH), "queries")
        if parts > SAMPLE:
            some = index.where(F.pmod(F.xxhash64("ids"), F.lit(SAMPLE)) == 0)
            low = ranked(searched(some, sorted(asked.inputFiles()), k), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
            asked = work.written(floored(asked, low), "queries")
        return written(ranked(searched(index, sorted(asked.inputFiles()), k), k).select("query_id", "rank", "vec_id", "score"), "best")


def floored(asked: DataFrame, low: DataFrame) -> DataFrame:
    """The batches of queries with ``floors``: for each query the score in ``low`` (query_id, floor), or none."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpacked(row)[0]
                each = row["v"]
                step = row["dim"] * row["width"]
                yield pa.RecordBatch.from_arrays([pa.array([row["dim"]] * len(ids), pa.int32()), pa.array([row["width"]] * len(ids), pa.int32()), pa.array(ids), pa.array([each[i * step : (i + 1) * step] for i in range(len(ids))], pa.binary())], ["dim", "width", "query_id", "v"])

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("dim", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("v", pa.binary()), ("floors", pa.binary())])
        for batch in slices(batches, BATCH):
            groups: dict[tuple, list] = {}
            for dim, width, i, v, floor in zip(*(c.to_pylist() for c in batch.columns)):
                groups.setdefault((dim, width), []).append((i, v, NONE if floor is None else floor))
            yield pa.RecordBatch.from_pylist([{"dim": d, "width": w, "ids": np.array([x[0] for x in g], "<i8").tobytes(), "v": b"".join(x[1] for x in g), "floors": np.array([x[2] for x in g], "<i8").tobytes()} for (d, w), g in groups.items()], kinds)

    rows = asked.mapInArrow(tidy(opened), "dim int, width int, query_id long, v binary").join(low, "query_id", "left")
    return rows.select("dim", "width", "query_id", "v", "floor").mapInArrow(tidy(closed), ROWS + ", floors binary")
