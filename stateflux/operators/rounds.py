"""Tables between the rounds of an iteration: written to the shared folder, read by the next round, removed at the end."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many bytes of its arrays.
BROADCAST = 32 << 20


def shared(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names; where it is unset and Spark is one process, one below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_rounds").rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Rounds:
    """``with Rounds(spark) as r:`` removes at the end what ``r.written`` wrote. Lineage ends at each table, so a lost executor costs only its tasks."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Rounds:
        return self

    def _put(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = f"{shared(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def written(self, df: DataFrame, name: str) -> DataFrame:
        out, path = self._put(df, name)
        self.paths[id(out)] = (out, path)
        return out

    def dropped(self, df: DataFrame | None) -> None:
        """Removes a table of an earlier round."""
        out, path = self.paths.pop(id(df), (None, None))
        if path:
            _remove(self.spark, path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written to stay until the driver's process ends."""
        out, path = self._put(df, name)
        atexit.register(_quietly, self.spark, path)
        return out

    def __exit__(self, *_) -> None:
        for _out, path in self.paths.values():
            _remove(self.spark, path)
        self.paths.clear()


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # noqa: BLE001 - the session has ended before the process
        pass


def sized(df: DataFrame, n_bytes: int) -> DataFrame:
    """``df``, to be broadcast if its arrays take at most BROADCAST bytes."""
    return F.broadcast(df) if n_bytes <= BROADCAST else df
