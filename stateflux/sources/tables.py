"""Loaders. Timestamps without a zone become microseconds since the epoch, embeddings doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, us, seq, state, gfp: the labelled samples of each record."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("rec"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"), F.col("value").alias("gfp")
    )


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, grp, map: pattern vectors as arrays of doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("map"))
