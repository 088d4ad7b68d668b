"""Connected components by alternating large and small stars (Kiveris et al., 2014), with hubs salted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateflux.llm.common import Work, meet, salt, salt_mask, written


def _with_least(pairs: DataFrame) -> DataFrame:
    """(v, u) with the least of v and all its u as m."""
    least = pairs.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"), salt_mask("salt").alias("mask"))
    return meet(pairs, least, ["v"])


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the least id reachable) of every id in ``edges``; an id with no edge has no row.

    Each round halves the height of the trees at least; it ends when a round
    changes nothing. A round is written to the shared folder and the one before
    removed, so lineage stays short. Null ends and loops are left out.
    """
    x, y = F.col(a), F.col(b)
    with Work() as work:
        stars = work.written(edges.where((x != y)).select(F.greatest(x, y).alias("v"), F.least(x, y).alias("u")).distinct(), "stars")
        before = None
        while True:
            now = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.bit_xor(F.xxhash64("u", "v"))).first()
            if now == before or now[0] == 0:
                break
            before = now
            both = stars.union(stars.select(F.col("u").alias("v"), F.col("v").alias("u"))).withColumn("salt", salt("u"))
            large = _with_least(both).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
            small = _with_least(large.withColumn("salt", salt("u")))
            small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(small.select("v", F.col("m").alias("u")))
            stars, older = work.written(small.where("u < v").distinct(), "stars"), stars
            work.done(older)
        ends = stars.select(F.col("v").alias("id"), F.col("u").alias("component")).union(stars.select(F.col("u").alias("id"), F.col("u").alias("component")))
        return written(ends.groupBy("id").agg(F.min("component").alias("component")), "components")
