"""Helpers the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stateflux.llm.store import remove

#: Bits of a salt mask: one hot group is dealt to this many tasks at most.
SALTS = 63


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one under the warehouse.

    The setting is read from the session; only where it is unset and Spark runs in
    one process (tests, a laptop) is a folder below the warehouse put in its place.
    On a cluster without the setting nothing is written: a machine's own folder
    would not be found by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stateflux"
        if not base.split(":", 1)[0].isalnum() or base.startswith("/"):
            base = f"file://{base}"
        if base.startswith("file:/") and not base.startswith("file:///"):
            base = "file:///" + base[len("file:/") :].lstrip("/")
    return base.rstrip("/")


_left: set[str] = set()


def scratch(spark: SparkSession, what: str) -> str:
    """A new, unused path in the shared folder; what is written there is removed when the driver's process ends."""
    path = f"{shared_base(spark)}/stateflux-{what}-{uuid.uuid4().hex}"
    _left.add(path)
    return path


@atexit.register
def _remove_left() -> None:
    for path in _left:
        remove(path)


#: With it, Spark removes an execution's shuffle files when the execution ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that a task hands to Python at once (by default 64 MB, or 10,000 rows): the JVM and Python each hold such a batch. A row of more goes alone.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
WHILE_WRITTEN = {CLEANUP: "true", BATCH: str(4 << 20)}


def _put(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = {key: spark.conf.get(key) for key in WHILE_WRITTEN}
    try:
        for key, value in WHILE_WRITTEN.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and reread.

    It cuts lineage with a table that outlives any executor; with the files in
    the shared store, a lost executor costs the tasks it ran and nothing else.
    The table stays until the driver's process ends: results are read from it.
    """
    return _put(df, scratch(df.sparkSession, what))


class Work:
    """The tables that an operator writes on its way, to be removed when its result is written.

    ``with Work() as work:`` removes them at the end of the block, so nothing
    that the block returns may still read them.
    """

    def __enter__(self) -> Work:
        self.tables: list[tuple[DataFrame, str]] = []
        return self

    def written(self, df: DataFrame, what: str) -> DataFrame:
        """As the function of that name, but removed with the others, or before by :meth:`done`."""
        path = scratch(df.sparkSession, what)
        out = _put(df, path)
        self.tables.append((out, path))
        return out

    def done(self, *tables: DataFrame) -> None:
        for table, path in self.tables:
            if any(table is t for t in tables):
                remove(path)
                _left.discard(path)

    def __exit__(self, *_) -> None:
        self.done(*(t for t, _ in self.tables))


def salt(*cols: str) -> Column:
    """The salt of a row, from columns that vary inside a hot group."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(SALTS)).cast("int")


def salt_mask(of: str) -> Column:
    """Aggregate: a long whose bits say which salts a group has."""
    return F.bit_or(F.expr(f"shiftleft(1L, {of})"))


def salts_in(mask: str) -> Column:
    """The salts whose bits a mask has, as an array, to be exploded."""
    return F.expr(f"filter(sequence(0, {SALTS - 1}), i -> (shiftright({mask}, i) & 1L) = 1L)")


def meet(rows: DataFrame, groups: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows joined with their group, of which each has one row.

    ``rows`` has a column ``salt``, ``groups`` a column ``mask`` of its rows'
    salts (from :func:`salt_mask`). A group is copied once for each salt it has,
    at most as often as it has rows, so rows of one key spread over many tasks.
    """
    dealt = groups.withColumn("salt", F.explode(salts_in("mask"))).drop("mask")
    return rows.join(dealt, [*on, "salt"], how).drop("salt")


def parts_for(spark: SparkSession, size: int, least: int, most: int) -> int:
    """Into how many parts ``size`` bytes are dealt: of ``least`` bytes, or larger ones if these are over eight for each core, but never over ``most``."""
    return max(1, min(-(-size // least), max(8 * spark.sparkContext.defaultParallelism, -(-size // most))))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: so many texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow; when a task ends, what it freed goes back to the system.

    Spark keeps idle workers for the next stage with Python in it. Without this
    they would hold their largest task's memory while other stages need theirs.
    """

    @functools.wraps(work)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied
