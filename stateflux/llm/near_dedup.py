"""Near-duplicates: circulant MinHash signatures, banding, exact Jaccard verification, components.

1. Every text becomes a set of shingles, a 128-bit hash of that set, a signature
   and band keys. Texts with one set are one class, held by its smallest id.
2. Classes that share a band key share a bucket. Each is compared with one
   member of the bucket, its pivot, whose choice differs from bucket to bucket.
   This is a short cut: pairs that share too few buckets to be likely links are
   left to the next step, which would compare them again.
3. Links found make components. A bucket whose members are in one component is
   done. In all other buckets every pair from two components is compared,
   unless sizes or the shingles that other components have rule a link out.
   Buckets with the same members are compared once; a large one is compared in
   pairs of blocks.

So any two classes that share a bucket and are similar enough end in one
component, and a large group of near copies costs a few comparisons a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stateflux.llm.common import Work, meet, salt, salt_mask, salts_in, slices, tidy, written
from stateflux.llm.components import connected
from stateflux.llm.shingles import Circulant, bands, set_hash, shingle_set

#: Members of a bucket that are compared in one task, and their shingles; a larger bucket is compared by pairs of blocks of about this size.
BLOCK, VOLUME = 1024, 1 << 20
#: Members of the buckets that a class and a pivot share, counted bucket by bucket: with fewer, the two are left to step 3.
LIKELY = 5
#: Cells of a dense matrix that one comparison may take.
CELLS = 1 << 22


def signed(docs: DataFrame, doc_id: str, text: str, width: int, n_bands: int, rows: int) -> DataFrame:
    """doc_id, n, h1, h2, keys: the size and 128-bit hash of each text's set of shingles, and its band keys (none for an empty set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(n_bands * rows)
        for batch in slices(batches):
            sizes, hashes, keys = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t, width)
                sizes.append(len(s))
                hashes.append(np.frombuffer(set_hash(s), "<i8"))
                keys.append(bands(circulant.signature(s), rows) if len(s) else np.empty(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            h = np.array(hashes, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))], ["doc_id", "n", "h1", "h2", "keys"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(tidy(work), "doc_id long, n long, h1 long, h2 long, keys array<long>")


def shingled(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """id, n, s: each text's whole set of shingles, as sorted 64-bit hashes in one binary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "s"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(tidy(work), "id long, n long, s binary")


def similar(common, one, two, percent: int):
    """Whether the intersection is at least ``percent`` of the union."""
    return 100 * common >= percent * (one + two - common)


def verified_stars(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that are similar. Rows stream past their ``a``, whose set is all that a task holds.

    An ``a`` with many partners is copied to several salts; a ``b`` has few pairs.
    """
    pairs, sizes = pairs.withColumn("salt", salt("b")), sets.select("id", "n")
    dealt = F.explode(salts_in("mask")).alias("salt")
    centres = pairs.groupBy("a").agg(salt_mask("salt").alias("mask")).join(sizes.select(F.col("id").alias("a"), F.col("n").alias("one")), "a").select("a", dealt, "one")
    sized = pairs.join(sizes.select(F.col("id").alias("b"), F.col("n").alias("two")), "b").join(centres, ["a", "salt"])
    # only pairs whose sizes allow it take their sets along
    sized = sized.where(100 * F.least("one", "two") >= percent * F.greatest("one", "two")).select("a", "b", "salt")
    first = sized.groupBy("a").agg(salt_mask("salt").alias("mask")).join(sets.select(F.col("id").alias("a"), "s"), "a").select("a", dealt, F.lit(False).alias("partner"), F.col("a").alias("b"), "s")
    rest = sized.join(sets.select(F.col("id").alias("b"), "s"), "b").select("a", "salt", F.lit(True).alias("partner"), "b", "s")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, partner, b, s in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                values = np.frombuffer(s, np.uint64)
                if not partner:
                    centre, own = a, values
                elif a == centre:
                    at = np.searchsorted(own, values)
                    common = int((own[np.minimum(at, len(own) - 1)] == values).sum())
                    if similar(common, len(own), len(values), percent):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return first.union(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", "partner").mapInArrow(tidy(work), "a long, b long")


def links_between(components: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of components between which some pair of sets is similar: enough of them to connect all that are.

    ``blocks``: if given, only pairs of sets from two different blocks are compared.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column = np.unique(flat, return_inverse=True)
    low, high = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), np.iinfo(np.int64).min)
    np.minimum.at(low, column, components[owner])
    np.maximum.at(high, column, components[owner])
    shared = (low != high)[column]  # only these can be common to sets of two components
    reach = np.bincount(owner[shared], minlength=len(sets))
    keep = np.flatnonzero(100 * reach >= percent * sizes)
    if len(keep) < 2 or len(np.unique(components[keep])) < 2:
        return []
    place = np.full(len(sets), -1)
    place[keep] = np.arange(len(keep))
    use = shared & (place[owner] >= 0)
    _, cell = np.unique(column[use], return_inverse=True)
    row, n, width = place[owner[use]], len(keep), int(cell.max(initial=-1)) + 1
    size, comp = sizes[keep], components[keep]
    block = None if blocks is None else blocks[keep]
    parent = {int(c): int(c) for c in np.unique(comp)}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    order = np.argsort(cell, kind="stable")
    cells, rows_ = cell[order], row[order]
    step = max(1, CELLS // max(1, n))  # columns of the matrix that are filled at once
    common = np.zeros((n, n), np.int64)
    for first in range(0, width, step):
        a, b = np.searchsorted(cells, (first, first + step))
        dense = np.zeros((n, min(step, width - first)), np.float32)
        dense[rows_[a:b], cells[a:b] - first] = 1
        common += (dense @ dense.T).astype(np.int64)  # at most CELLS, which float32 holds exactly
    for first in range(0, n, 64):
        some = slice(first, first + 64)
        possible = (comp[some, None] < comp[None, :]) & similar(common[some], size[some, None], size[None, :], percent)
        if block is not None:
            possible &= block[some, None] != block[None, :]
        for i, j in zip(*np.nonzero(possible)):
            a, b = root(int(comp[first + i])), root(int(comp[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(comp[first + i]), int(comp[j])))
    return out


def verified_buckets(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of components from members (key, rep, component, m, volume) of buckets of m members with ``volume`` shingles, all of which have two components or more."""
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("volume") / VOLUME)).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "component", "rep").join(sets.select(F.col("id").alias("rep"), "s"), "rep")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def compared() -> pa.RecordBatch:
            found = []
            if len({c for c, _, _ in held}) > 1:
                blocks_ = np.array([b for _, b, _ in held])
                found = links_between(np.array([c for c, _, _ in held], np.int64), [s for _, _, s in held], blocks_ if group[1] != group[2] else None, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for key, i, j, block, component, s in zip(*(c.to_pylist() for c in batch.columns)):
                if group != (key, i, j):
                    if len(held) > 1:
                        yield compared()
                    group, held = (key, i, j), []
                held.append((component, block, np.frombuffer(s, np.uint64)))
        if len(held) > 1:
            yield compared()

    keys = ["key", "i", "j"]
    return dealt.select(*keys, "block", "component", "s").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(work), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, n_bands: int = 25, rows: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if the intersection of their sets of shingles is at
    least ``percent`` hundredths of the union; component_id is the smallest id
    that links lead to. With the default bands a pair at the threshold shares no
    bucket with a chance of 4e-7; whatever shares one is compared exactly.

    Documents without words, null texts among them, are linked with nothing.
    Those with equal sets are linked by that, however long. A null id is a row
    that takes part only as an equal of others: it is never kept if another row
    has its set, and has component null if none has. Rows that repeat an id
    are one document with several sets. Other columns are ignored. An empty
    table gives no rows. Shingles are compared by 64-bit hashes: two different
    ones of a pair of texts with n shingles in all meet with a chance of n * n /
    2 ** 65, a hundred-millionth for texts of a million words.
    """
    with Work() as work:
        prints = work.written(signed(docs, doc_id, text, width, n_bands, rows), "signatures").withColumn("salt", salt("doc_id"))
        classes = work.written(prints.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), salt_mask("salt").alias("mask")), "classes")
        held = prints.where("n > 0").join(classes.select("rep").where("rep is not null").distinct(), F.col("doc_id") == F.col("rep"), "left_semi")
        members = held.select(F.explode("keys").alias("key"), F.col("doc_id").alias("rep"), "n").withColumn("salt", salt("rep"))
        buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.expr("min(rep ^ key)").alias("one"), F.expr("max(rep ^ key)").alias("two"), salt_mask("salt").alias("mask")).where("m > 1 and one != two")
        shared = work.written(meet(members, buckets, ["key"]).select("key", "rep", "n", "m", F.expr("one ^ key").alias("pivot")), "buckets")

        listed = shared.select(F.col("rep").alias("id")).distinct()
        sets = work.written(shingled(docs.join(listed, docs[doc_id].cast("long") == listed["id"], "left_semi"), doc_id, text, width), "shingles")

        stars = shared.where("rep != pivot").groupBy(F.col("pivot").alias("a"), F.col("rep").alias("b")).agg(F.sum("m").alias("met"))
        first = connected(verified_stars(stars.where(F.col("met") >= LIKELY).select("a", "b"), sets, percent))

        placed = shared.select("key", "rep", "n").join(first.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component")).withColumn("salt", salt("rep"))
        open_ = placed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("volume"), F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), salt_mask("salt").alias("mask"))
        open_ = open_.where("low != high").groupBy("m", "volume", "x", "y").agg(F.min("key").alias("key"), F.min("mask").alias("mask")).select("key", "m", "volume", "mask")
        second = connected(verified_buckets(meet(placed, open_, ["key"]), sets, percent))
        work.done(shared, sets)

        components = first.join(second.select(F.col("id").alias("component"), F.col("component").alias("last")), "component", "left").select("id", F.coalesce("last", "component").alias("component"))
        components = components.union(second.join(first, "id", "left_anti").select("id", "component"))
        classes = classes.join(components, classes["rep"] == components["id"], "left").select("h1", "h2", "n", "mask", F.coalesce("component", "rep").alias("component"))
        out = meet(prints.select("doc_id", "n", "h1", "h2", "salt"), classes, ["h1", "h2", "n"], "left")
        component = F.coalesce("component", "doc_id")
        return written(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")), "near")
