"""Writers: result tables, matrices, solutions as JSON, model bundles, and work that goes on where it stopped."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A result table; in CSV arrays and structs are JSON."""
    if kind == "csv":
        plain = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(*plain).write.mode("overwrite").option("header", "true").csv(path)
    else:
        df.write.mode("overwrite").format(kind).save(path)


def matrix_columns(df: DataFrame, keys: list[str], n: int, map_: str = "map", prefix: str = "ch") -> DataFrame:
    """A vector's elements as columns ch_001, ch_002 and so on."""
    return df.select(*keys, *[F.get(F.col(map_), F.lit(i)).alias(f"{prefix}_{i + 1:03d}") for i in range(n)])


def write_matrix(df: DataFrame, path: str, keys: list[str], map_: str = "map") -> None:
    n = df.agg(F.max(F.size(map_))).first()[0] or 0
    write_table(matrix_columns(df, keys, n, map_), path, "csv")


def solution_json(states: DataFrame, by: list[str], metadata: Mapping[str, object] | None = None) -> DataFrame:
    """by, json: each model's maps, similarities and matches (state, map and, if there, label, corr) as one JSON object; numbers that are not finite are left out."""
    extra = [c for c in ("label", "corr", "polarity") if c in states.columns]
    sound = F.transform("map", lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))
    rows = states.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("state", sound.alias("map"), *extra))).alias("s"))
    name = lambda e: F.format_string("state_%02d", e["state"].cast("int") + 1)
    maps = F.map_from_entries(F.transform("s", lambda e: F.struct(name(e), e["map"])))
    matches = F.transform("s", lambda e: F.struct(name(e).alias("state"), *[e[c].alias(c) for c in extra]))
    fixed = F.from_json(F.lit(json.dumps({k: str(v) for k, v in (metadata or {}).items()})), "map<string,string>")
    return rows.select(*by, F.to_json(F.struct(maps.alias("estimated_microstates"), matches.alias("matches"), F.size("s").alias("k_estimated"), fixed.alias("metadata"))).alias("json"))


def write_bundle(states: DataFrame, path: str, by: list[str]) -> None:
    """A model's states, one folder for each level, k or other key: a node's files are replaced, others stay."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def resumed(work: DataFrame, key: list[str], path: str, settings: Mapping[str, object], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of ``make`` for all rows of ``work``, those that ``path`` has under the same settings read from there.

    What is missing is made and appended, so work that was stopped goes on with what it has not done.
    """
    spark = work.sparkSession
    mark = json.dumps(dict(settings), sort_keys=True, default=str)
    try:
        done = spark.read.parquet(path)
    except Exception as error:  # there is nothing yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        done = None
    todo = work if done is None else work.join(done.where(F.col("settings") == mark).select(*key).distinct(), key, "left_anti")
    if not todo.isEmpty():
        make(todo).withColumn("settings", F.lit(mark)).write.mode("append").parquet(path)
    return spark.read.parquet(path).where(F.col("settings") == mark).drop("settings").join(work.select(*key).distinct(), key, "left_semi")
