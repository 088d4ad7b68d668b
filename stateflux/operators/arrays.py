"""Kernels on pattern vectors (arrays of doubles), all inside Spark's expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def let(x: Column, f) -> Column:
    """f(x), with x evaluated once a row: inside a lambda an expression would be evaluated for every element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def centred(v: Column) -> Column:
    """Average reference: less the mean over channels."""
    return let(v, lambda w: let(mean(w), lambda m: F.transform(w, lambda x: x - m)))


def unit(v: Column, eps: float = 1e-12) -> Column:
    """Zero mean and unit length; a constant map becomes zeros."""
    return let(centred(v), lambda c: let(norm(c), lambda s: F.transform(c, lambda x: x / F.when(s < eps, 1.0).otherwise(s))))


def unit_rms(v: Column, eps: float = 1e-12) -> Column:
    """Zero mean and unit root mean square."""
    return let(centred(v), lambda c: let(norm(c) / F.sqrt(F.size(c).cast("double")), lambda s: F.transform(c, lambda x: x / F.when(s < eps, 1.0).otherwise(s))))


def gfp_rms(v: Column) -> Column:
    """Population spread over channels."""
    return let(centred(v), lambda c: norm(c) / F.sqrt(F.size(c).cast("double")))


def gfp_sd(v: Column) -> Column:
    """Sample spread over channels; null for one channel."""
    return let(centred(v), lambda c: F.sqrt(F.try_divide(dot(c, c), (F.size(c) - 1).cast("double"))))


def padded(v: Column, n: int) -> Column:
    """The first ``n`` elements, with nulls behind if there are fewer; a null is all nulls."""
    full = F.coalesce(v, F.array().cast("array<double>"))
    return F.slice(F.concat(full, F.array_repeat(F.lit(None).cast("double"), n)), 1, n)


def clamped(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def log_sum_exp(v: Column) -> Column:
    return let(v, lambda w: let(F.array_max(w), lambda m: m + F.ln(F.aggregate(w, F.lit(0.0), lambda a, x: a + F.exp(x - m)))))


def gaussian_log_pdf(x: Column, mu: Column, variance: Column) -> Column:
    """Of a vector, with a diagonal covariance."""
    terms = F.zip_with(F.zip_with(x, mu, lambda a, b: a - b), variance, lambda d, v: F.ln(v) + d * d / v)
    return -0.5 * (F.size(x) * math.log(2 * math.pi) + total(terms))


def argmax(v: Column) -> Column:
    """The place, from 1, of the greatest element, the first of several."""
    return F.array_position(v, F.array_max(v)).cast("int")


def outer(v: Column) -> Column:
    """The upper triangle of the outer product, off-diagonal cells times sqrt 2: polarity does not matter."""
    row = lambda x, i: F.transform(F.slice(v, i + 1, F.size(v)), lambda y, j: F.when(j == 0, x * y).otherwise(math.sqrt(2) * x * y))
    return F.flatten(F.transform(v, row))


def aligned(v: Column, to: Column) -> Column:
    """With its sign turned so that it points along ``to``."""
    return F.when(dot(v, to) < 0, F.transform(v, lambda x: -x)).otherwise(v)


#: States that a model may have: they travel with every row.
STATES = 1000


def _few(states: Column) -> Column:
    return F.when(F.size(states) <= STATES, states).otherwise(F.raise_error(F.lit(f"a model has at most {STATES} states")))


def assigned(maps: DataFrame, centres: DataFrame, id_: str = "id", map_: str = "map") -> DataFrame:
    """Each map with the centre (k, centre) that it is most like, whatever its sign: id, k, corr; ties to the smaller k.

    Centres are the few states of a model (at most some tens), so they are sent
    to all tasks; each map looks through them in one expression, with no
    product of rows and no shuffle.
    """
    few = centres.select(F.struct(F.col("k"), F.col("centre")).alias("c")).groupBy().agg(_few(F.array_sort(F.collect_list("c"))).alias("cs"))
    scored = F.transform("cs", lambda c: F.struct(F.abs(dot(F.col(map_), c["centre"])).alias("a"), (-c["k"]).alias("k"), dot(F.col(map_), c["centre"]).alias("corr")))
    best = F.array_max(scored)
    return maps.crossJoin(F.broadcast(few)).withColumn("b", best).drop("cs").withColumn("k", -F.col("b.k")).withColumn("corr", F.col("b.corr")).drop("b")


def fit_statistics(labelled: DataFrame, by: list[str] | None = None, map_: str = "map") -> DataFrame:
    """Explained variance, within-cluster residual and mean similarity of assigned maps (columns map, corr)."""
    power = dot(F.col(map_), F.col(map_))
    w = labelled.withColumn("p", power).withColumn("fit", F.col("corr") * F.col("corr"))
    return w.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_maps"), F.round(F.try_divide(F.sum("fit"), F.sum("p")), 6).alias("gev"), F.round(F.sum(F.col("p") - F.col("fit")), 6).alias("wss"), F.round(F.avg(F.abs("corr")), 6).alias("mean_abs_corr"))


def state_shares(labelled: DataFrame, k: int, map_: str = "map") -> DataFrame:
    """Of each state that occurs: maps, share, mean similarity; beside them the residual variance of all and its cross-validation for k states."""
    power = dot(F.col(map_), F.col(map_))
    per = labelled.groupBy("k").agg(F.count(F.lit(1)).alias("n_maps"), F.avg(F.abs("corr")).alias("r"), F.sum(power - F.col("corr") * F.col("corr")).alias("_w"), F.sum(power).alias("_p"), F.max(F.size(map_)).alias("_c"))
    w = Window.partitionBy()  # states are few
    residual = F.try_divide(F.sum("_w").over(w), F.sum("_p").over(w))
    factor = F.pow((F.max("_c").over(w) - 1) / F.greatest(F.lit(1), F.max("_c").over(w) - k - 1), 2)
    return per.select("k", "n_maps", F.round(F.col("n_maps") / F.sum("n_maps").over(w), 6).alias("share"), F.round("r", 6).alias("mean_abs_corr"), F.round(residual, 6).alias("residual_variance"), F.round(residual * factor, 6).alias("cross_validation"))


def centroid_silhouette(maps: DataFrame, centres: DataFrame, id_: str = "id", map_: str = "map") -> DataFrame:
    """id, silhouette: from the two nearest centres, with distance 1 - |corr|."""
    few = centres.groupBy().agg(_few(F.collect_list("centre")).alias("cs"))
    sims = F.reverse(F.array_sort(F.transform("cs", lambda c: F.abs(dot(F.col(map_), c)))))
    two = maps.crossJoin(F.broadcast(few)).withColumn("s", sims)
    a, b = 1 - F.col("s")[0], 1 - F.col("s")[1]
    return two.select(id_, F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)).alias("silhouette"))


def mean_map(df: DataFrame, by: list[str], map_: str = "map", weight: Column | None = None) -> DataFrame:
    """The weighted mean of maps by group, channel by channel; null cells are left out."""
    w = F.lit(1.0) if weight is None else weight
    cells = df.select(*by, w.alias("w"), F.posexplode(map_).alias("pos", "x"))
    means = cells.groupBy(*by, "pos").agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum(F.when(F.col("x").isNotNull(), F.col("w")))).alias("m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean_map"))


def level_statistic(cells: DataFrame, level: str, pos: str = "pos", value: str = "x") -> DataFrame:
    """The observed statistic of a topographic ANOVA: root mean square deviation of level means from the grand mean map."""
    means = cells.groupBy(level, pos).agg(F.avg(value).alias("m"))
    dev = means.withColumn("d", F.col("m") - F.avg("m").over(Window.partitionBy(pos)))
    return dev.groupBy(level).agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms")).groupBy().agg(F.round(F.sqrt(F.avg(F.col("rms") * F.col("rms"))), 6).alias("statistic"), F.count(F.lit(1)).alias("n_levels"))
