"""Operators on channels: montages, common channels, interpolation and spatial filters.

Channels of a montage are some hundreds at most; samples and maps are many.
Samples in long form have (keys, ch, x); a spatial operation is a table of
weights (target, source, weight) that they are joined with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stateflux.functions.text import channel
from stateflux.operators.tables import small

def _distances(sources: DataFrame, targets: DataFrame, id_: str) -> DataFrame:
    other = sources.select(F.col(id_).alias("source"), *[F.col(c).alias(f"_{c}") for c in "xyz"])
    d = F.sqrt(reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"_{c}")) ** 2 for c in "xyz"]))
    return targets.crossJoin(small(other)).select(F.col(id_).alias("target"), "source", d.alias("d"))


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.round("d", 12), "source"))).where(F.col("rank") <= k)


def inverse_distance(sources: DataFrame, targets: DataFrame, k: int = 6, id_: str = "idx", eps: float = 2.220446049250313e-16) -> DataFrame:
    """target, source, weight: the k nearest sources of each target by 1 / d squared, summing to one; a source at the same place counts alone."""
    near = _nearest(_distances(sources, targets, id_), k)
    w = Window.partitionBy("target")
    raw = F.when(F.min("d").over(w) <= eps, (F.col("rank") == 1).cast("double")).otherwise(1 / (F.col("d") * F.col("d") + eps))
    return near.withColumn("raw", raw).select("target", "source", (F.col("raw") / F.sum("raw").over(w)).alias("weight")).where("weight > 0")


def smoothing(points: DataFrame, k: int, id_: str = "idx") -> DataFrame:
    """target, source, weight: 1 / d over the k nearest other channels, summing to one. A channel without a place keeps its own value."""
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    sound = points.where(length > 1e-15).select(id_, *[(F.col(c) / length).alias(c) for c in "xyz"])
    near = _nearest(_distances(sound, sound, id_).where("target <> source"), k)
    inverse = 1 / F.greatest(F.col("d"), F.lit(2.220446049250313e-16))
    weights = near.select("target", "source", (inverse / F.sum(inverse).over(Window.partitionBy("target"))).alias("weight"))
    alone = points.select(F.col(id_).alias("target")).join(weights.select("target").distinct(), "target", "left_anti")
    return weights.unionByName(alone.select("target", F.col("target").alias("source"), F.lit(1.0).alias("weight")))


def spatial_filter(points: DataFrame, mode: str, k: int = 4, strength: float = 1.0, id_: str = "idx") -> DataFrame:
    """The weights of a filter: ``none``, ``laplacian``, ``smoothing`` or ``average_reference``."""
    own = points.select(F.col(id_).alias("target"), F.col(id_).alias("source"))
    if mode == "none":
        return own.withColumn("weight", F.lit(1.0))
    if mode == "average_reference":
        n = points.count()
        pairs = own.select("target").crossJoin(small(own.select("source")))
        return pairs.withColumn("weight", (F.col("target") == F.col("source")).cast("double") - 1.0 / n)
    if mode not in ("laplacian", "smoothing"):
        raise ValueError(f"unknown spatial filter {mode}")
    strength = max(0.0, strength) if mode == "laplacian" else min(1.0, max(0.0, strength))
    keep, share = (1.0, -strength) if mode == "laplacian" else (1 - strength, strength)
    near = smoothing(points, k, id_).withColumn("weight", F.col("weight") * share)
    return own.withColumn("weight", F.lit(keep)).unionByName(near).groupBy("target", "source").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def applied(samples: DataFrame, weights: DataFrame, keys: list[str], ch: str = "ch", x: str = "x") -> DataFrame:
    """keys, ch, x: every target channel as the weighted sum of its sources; sums begin in each task before rows are shuffled."""
    met = samples.join(small(weights), samples[ch] == weights["source"])
    return met.groupBy(*keys, "target").agg(F.sum(F.col(x) * F.col("weight")).alias(x)).withColumnRenamed("target", ch)


#: The leads of the clinical montages, each with an older name.
LEADS_19 = [
    ("Fp1", ""), ("Fp2", ""), ("F7", ""), ("F3", ""), ("Fz", ""), ("F4", ""), ("F8", ""), ("T7", "T3"), ("C3", ""), ("Cz", ""), ("C4", ""), ("T8", "T4"),
    ("P7", "T5"), ("P3", ""), ("Pz", ""), ("P4", ""), ("P8", "T6"), ("O1", ""), ("O2", ""),
]
LEADS_12 = [(x, "") for x in ("Fp1", "Fp2", "F3", "F4", "Fz", "C3", "C4", "P3", "P4", "Pz", "O1", "O2")]
MONTAGES = {"10-20-20": LEADS_19, "10-20-12": LEADS_12}


def montage(labels: DataFrame, kind: str, label: str = "label", idx: str = "idx") -> DataFrame:
    """place, lead, idx, label: for each lead of a montage the first channel that has its name, its older name or both with a slash; ``full`` keeps all channels in order."""
    if kind == "full":
        return labels.select(F.row_number().over(Window.orderBy(idx)).alias("place"), F.col(label).alias("lead"), idx, label)
    leads = labels.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(MONTAGES[kind], 1)], "place int, lead string, older string")
    name, one, two = F.lower(F.trim(label)), F.lower("lead"), F.lower("older")
    named = (two != "") & ((name == two) | (name == F.concat_ws("/", one, two)) | (name == F.concat_ws("/", two, one)))
    rank = F.when(name == one, 0).when((two != "") & (name == two), 1).otherwise(2)
    met = labels.crossJoin(F.broadcast(leads)).where((name == one) | named).withColumn("_rank", rank)  # twenty leads
    return met.withColumn("_r", F.row_number().over(Window.partitionBy("place").orderBy("_rank", idx))).where("_r = 1").select("place", "lead", idx, label)


def common_channels(files: DataFrame, policy: str = "intersect", file: str = "file", label: str = "label", order: str = "idx", located: Column | None = None) -> DataFrame:
    """label, idx: the channels that all analyses use.

    ``intersect``: those in every file, in the order of the first file; ``strict``:
    the same, but an error if a file has others; ``densest``: those of the file
    with most channels, one with places first, then the first by name.
    """
    name = channel(F.col(label))
    rows = files.withColumn("_name", name).withColumn("_located", located if located is not None else F.lit(False))
    if policy == "densest":
        best = rows.groupBy(file).agg(F.countDistinct("_name").alias("n"), F.max("_located").alias("p")).orderBy(F.col("n").desc(), F.col("p").desc(), file).limit(1)
        return rows.join(F.broadcast(best.select(file)), file, "left_semi").groupBy(F.col("_name").alias("label")).agg(F.min(order).alias("idx"))
    n_files = rows.agg(F.countDistinct(file).alias("files"))
    first = rows.agg(F.min(file).alias("_first"))
    have = rows.groupBy("_name").agg(F.countDistinct(file).alias("n")).crossJoin(F.broadcast(n_files))
    if policy == "strict":
        have = have.withColumn("n", F.when(F.col("n") < F.col("files"), F.raise_error(F.concat(F.lit("not in all files: "), "_name"))).otherwise(F.col("n")))
    kept = have.where("n = files").select("_name")
    return rows.crossJoin(F.broadcast(first)).where(F.col(file) == F.col("_first")).join(kept, "_name", "left_semi").groupBy(F.col("_name").alias("label")).agg(F.min(order).alias("idx"))


def matched_labels(one: DataFrame, two: DataFrame, least: int = 0, label: str = "label", idx: str = "idx") -> DataFrame:
    """label, idx_one, idx_two: channels of two montages with one canonical label, each label's first; none if fewer than ``least`` match."""
    a, b = (x.groupBy(channel(F.col(label)).alias("label")).agg(F.min(idx).alias(f"idx_{n}")) for x, n in ((one, "one"), (two, "two")))
    met = a.join(b, "label")
    enough = met.agg((F.count(F.lit(1)) >= least).alias("_enough"))
    return met.crossJoin(F.broadcast(enough)).where("_enough").drop("_enough")


def overridden(channels: DataFrame, sidecar: DataFrame, file: str = "file", label: str = "label") -> DataFrame:
    """Channels with the places of a sidecar, file by file, if it has enough of the file's labels: half of them and at least four; else with their own. ``source`` says which."""
    side = sidecar.groupBy(F.col(file), channel(F.col(label)).alias("_name")).agg(*[F.first(c).alias(f"_{c}") for c in "xyz"])
    met = channels.withColumn("_name", channel(F.col(label))).join(side, [file, "_name"], "left")
    w = Window.partitionBy(file)
    hits = F.count("_x").over(w)
    use = (hits >= F.greatest(F.lit(4), F.ceil(0.5 * F.count(F.lit(1)).over(w)))) & F.col("_x").isNotNull()
    met = met.withColumn("_use", use)
    return met.select(file, label, *[F.when(F.col("_use"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in "xyz"], F.when(F.col("_use"), "sidecar").otherwise("own").alias("source"))


def remap_spec(file_labels: DataFrame, target_labels: DataFrame, source_places: DataFrame, target_places: DataFrame, k: int = 6, id_: str = "idx") -> DataFrame:
    """target, source, weight: a target channel that the file has is taken as it is, any other one is interpolated from the k nearest observed ones."""
    direct = matched_labels(target_labels, file_labels, idx=id_).select(F.col("idx_one").alias("target"), F.col("idx_two").alias("source"))
    missing = target_places.join(direct, target_places[id_] == direct["target"], "left_anti")
    observed = source_places.join(direct.select("source").distinct(), source_places[id_] == F.col("source"), "left_semi")
    return direct.withColumn("weight", F.lit(1.0)).unionByName(inverse_distance(observed, missing, k, id_))


def backfilled(channels: DataFrame, reference: DataFrame, label: str = "label") -> DataFrame:
    """Channels with the places of a reference montage, by canonical label, where they have none; ``source`` says whose they are."""
    places = reference.groupBy(channel(F.col(label)).alias("_name")).agg(*[F.first(c, ignorenulls=True).alias(f"_{c}") for c in "xyz"])
    met = channels.withColumn("_name", channel(F.col(label))).join(places, "_name", "left")
    own = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    out = met.withColumn("source", F.when(own, "own").when(F.col("_x").isNotNull(), "reference"))
    return out.select(*[c for c in channels.columns if c not in "xyz"], *[F.when(F.col("source") == "reference", F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in "xyz"], "source")
