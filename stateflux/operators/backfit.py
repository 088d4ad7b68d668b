"""Fitting a model's states back to recordings: hard, soft, and mixtures of two at transitions.

Centres are a model's states, some tens at most: they are constants of the plan.
Everything on samples stays in Spark's expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stateflux.operators import arrays as A
from stateflux.operators.fits import normal
from stateflux.operators.sequences import fill_from_peaks

EPS = 2.220446049250313e-16


def constants(centres: DataFrame, k: str = "k", centre: str = "centre") -> tuple[list, np.ndarray]:
    """Names and normalised maps of a model's states, in order."""
    rows = centres.select(k, centre).orderBy(k).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a model has some tens of states, not thousands")
    return [r[0] for r in rows], normal(np.array([r[1] for r in rows], float))


def literal(matrix: np.ndarray) -> list[Column]:
    return [F.array(*[F.lit(float(x)) for x in row]) for row in matrix]


def similarities(map_: Column, maps: np.ndarray) -> Column:
    """The correlations of a normalised map with each state."""
    return F.array(*[A.dot(map_, row) for row in literal(maps)])


def hard(samples: DataFrame, centres: DataFrame, vector: str = "v", peak: Column | None = None, rec: str = "rec", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Adds ``k`` and ``confidence``: the state each sample is most like, whatever its sign; with ``peak``, that of the nearest peak."""
    names, maps = constants(centres)
    unit = A.unit(F.col(vector))
    rows = samples.withColumn("_s", F.transform(A.let(unit, lambda u: similarities(u, maps)), F.abs))
    rows = rows.withColumn("k", F.element_at(F.array(*[F.lit(n) for n in names]), A.argmax(F.col("_s")))).withColumn("confidence", F.array_max("_s"))
    if peak is not None:
        rows = rows.withColumn("_both", F.struct("k", "confidence"))
        rows = fill_from_peaks(rows, peak, rec, "_both", order).withColumn("k", F.coalesce("filled.k", "k")).withColumn("confidence", F.coalesce("filled.confidence", "confidence")).drop("_both", "filled")
    return rows.drop("_s")


def spreads(labelled: DataFrame, centres: DataFrame, label: str = "k", map_: str = "map") -> list[float]:
    """Of each state the root mean square of 1 - |r| over its own maps; a state without maps has that of all maps and states."""
    names, maps = constants(centres)
    d = F.transform(A.let(A.unit(F.col(map_)), lambda u: similarities(u, maps)), lambda r: 1 - F.abs(r))
    rows = labelled.select(F.col(label).alias("k"), d.alias("d"))
    sums = rows.agg(*[F.avg(F.when(F.col("k") == n, F.col("d")[i] * F.col("d")[i])).alias(f"s{i}") for i, n in enumerate(names)], F.avg(F.aggregate("d", F.lit(0.0), lambda a, x: a + x * x) / len(names)).alias("all")).first()
    everywhere = float(np.sqrt((sums["all"] or 0.0) + EPS))
    return [everywhere if sums[f"s{i}"] is None else float(np.sqrt(sums[f"s{i}"] + EPS)) for i in range(len(names))]


def gaussian(samples: DataFrame, centres: DataFrame, sigmas: list[float], vector: str = "v") -> DataFrame:
    """Adds ``weights``: a share for each state by its distance 1 - |r| and half the state's spread, summing to one."""
    _, maps = constants(centres)
    d = A.let(A.unit(F.col(vector)), lambda u: F.transform(similarities(u, maps), lambda r: 1 - F.abs(r)))
    scale = F.array(*[F.lit(max(0.5 * s, EPS) ** 2 + EPS) for s in sigmas])
    raw = F.zip_with(d, scale, lambda x, s: F.exp(-0.5 * x * x / s))
    return samples.withColumn("weights", A.let(raw, lambda w: A.let(F.greatest(A.total(w), F.lit(EPS)), lambda t: F.transform(w, lambda x: x / t))))


def linear(samples: DataFrame, centres: DataFrame, vector: str = "v") -> DataFrame:
    """Adds ``weights``: the positive parts of a least-squares unmixing, of whichever sign leaves less over, summing to one; |r| where none is left."""
    _, maps = constants(centres)
    inverse, columns = np.linalg.pinv(maps), maps.T

    def of(u: Column) -> Column:
        raw = F.array(*[A.dot(u, row) for row in literal(inverse.T)])

        def both(c: Column) -> Column:
            plus, minus = F.transform(c, lambda x: F.greatest(x, F.lit(0.0))), F.transform(c, lambda x: F.greatest(-x, F.lit(0.0)))
            left = lambda w, sign: A.let(F.zip_with(u, F.array(*[sign * A.dot(w, row) for row in literal(columns)]), lambda a, b: a - b), lambda e: A.dot(e, e))
            return A.let(plus, lambda p: A.let(minus, lambda m: F.when(left(m, -1.0) < left(p, 1.0), m).otherwise(p)))

        near = F.transform(similarities(u, maps), F.abs)
        return A.let(A.let(raw, both), lambda w: F.when(A.total(w) > EPS, w).otherwise(near))

    return samples.withColumn("weights", A.let(A.let(A.unit(F.col(vector)), of), lambda w: A.let(F.greatest(A.total(w), F.lit(EPS)), lambda t: F.transform(w, lambda x: x / t))))


def two_state(x: Column, a: Column, b: Column) -> Column:
    """A struct (first, second, secondary, gain): shares of two unit maps in a vector by least squares, the smaller share, and how much less they leave than the better one alone.

    Null for parallel maps or a vector without any of them.
    """

    def solved(p: Column) -> Column:
        det = 1 - p["ab"] * p["ab"]
        one, two = (p["xa"] - p["ab"] * p["xb"]) / det, (p["xb"] - p["ab"] * p["xa"]) / det
        total = F.abs(one) + F.abs(two)
        pair = F.greatest(p["xx"] - one * p["xa"] - two * p["xb"], F.lit(0.0))
        single = p["xx"] - F.greatest(p["xa"] * p["xa"], p["xb"] * p["xb"])
        gain = F.greatest(F.lit(0.0), (single - pair) / F.greatest(single, F.lit(EPS)))
        shares = F.struct((F.abs(one) / total).alias("first"), (F.abs(two) / total).alias("second"), (F.least(F.abs(one), F.abs(two)) / total).alias("secondary"), gain.alias("gain"))
        return F.when((det > 1e-12) & (total > EPS), shares)

    return A.let(F.struct(A.dot(a, b).alias("ab"), A.dot(x, a).alias("xa"), A.dot(x, b).alias("xb"), A.dot(x, x).alias("xx")), solved)


def transition_aware(samples: DataFrame, centres: DataFrame, rate: float, max_ms: float = 40.0, peak: Column | None = None, gfp: str = "gfp", rec: str = "rec", order: tuple[str, ...] = ("pos",), vector: str = "v", label: str = "k") -> DataFrame:
    """Adds ``weights`` and ``mixed``: one state a sample, but two where a mixture is plausible.

    Near a change (``max_ms`` either side; the later change counts) the two states
    around it are fitted, and taken if the smaller share is 0.03. At a peak of high
    field power the two most similar states are, if the smaller share is 0.12 and
    they leave 0.05 less than one; elsewhere, where a linear unmixing gives a second
    state 0.10, if it is 0.15 and they leave 0.10 less.
    """
    names, maps = constants(centres)
    half = max(2, round(max_ms / 1000 * rate))
    w = Window.partitionBy(rec).orderBy(*order)
    rows = linear(samples, centres, vector).withColumnRenamed("weights", "_linear")
    rows = rows.withColumn("_r", A.let(A.unit(F.col(vector)), lambda u: F.transform(similarities(u, maps), F.abs)))
    rows = rows.withColumn("_at", F.array_position(F.array(*[F.lit(n) for n in names]), F.col(label)).cast("int"))
    before = F.lag("_at").over(w)
    rows = rows.withColumn("_change", F.when(before.isNotNull() & (before != F.col("_at")), F.struct(before.alias("a"), F.col("_at").alias("b"))))
    rows = rows.withColumn("_pair", F.last("_change", ignorenulls=True).over(w.rowsBetween(-half, half)))
    floors = rows.groupBy(rec).agg(F.percentile(gfp, F.lit(0.65)).alias("_floor"))
    rows = rows.join(floors, rec).withColumn("_high", F.col(gfp) >= F.col("_floor")).withColumn("_peak", F.coalesce(peak, F.lit(False)) if peak is not None else F.lit(False))
    ranked = F.transform(F.slice(F.reverse(F.array_sort(F.transform("_r", lambda r, i: F.struct(r.alias("r"), (-i).alias("i"))))), 1, 2), lambda s: (1 - s["i"]).cast("int"))
    second = F.element_at(F.reverse(F.array_sort("_linear")), 2)
    rows = rows.withColumn("_top", ranked).withColumn("_other", second >= 0.10).withColumn("_near", F.col("_pair").isNotNull())
    a, b = F.when(F.col("_near"), F.col("_pair.a")).otherwise(F.element_at("_top", 1)), F.when(F.col("_near"), F.col("_pair.b")).otherwise(F.element_at("_top", 2))
    table = F.array(*literal(maps))
    rows = rows.withColumn("_a", a).withColumn("_b", b)
    tried = F.when((F.col("_near") | F.col("_peak") | F.col("_other")) & (F.col("_a") != F.col("_b")), two_state(F.col(vector), F.element_at(table, F.col("_a")), F.element_at(table, F.col("_b"))))
    rows = rows.withColumn("_fit", tried)
    f = lambda c: F.col(f"_fit.{c}")
    good = (F.col("_near") & (f("secondary") >= 0.03)) | (F.col("_peak") & F.col("_high") & (f("secondary") >= 0.12) & (f("gain") >= 0.05)) | (F.col("_other") & (f("secondary") >= 0.15) & (f("gain") >= 0.10))
    rows = rows.withColumn("mixed", F.coalesce(good, F.lit(False)))
    places = F.array(*[F.lit(i + 1) for i in range(len(names))])
    mixture = F.transform(places, lambda i: F.when(i == F.col("_a"), f("first")).when(i == F.col("_b"), f("second")).otherwise(0.0))
    alone = F.transform(places, lambda i: F.when(i == F.col("_at"), 1.0).otherwise(0.0))
    return rows.withColumn("weights", F.when(F.col("mixed"), mixture).otherwise(alone)).select(*samples.columns, "weights", "mixed")


def diagnostics(rows: DataFrame, truth: str = "truth", estimate: str = "estimate", overlap: str = "overlap") -> DataFrame:
    """One row: how often the greatest weights agree, mean absolute errors of weights, the same within overlap, how often all active states are found there, and the errors of coverage. Weights are arrays with one place a state."""
    t, e, o = F.col(truth), F.col(estimate), F.coalesce(F.col(overlap), F.lit(False))
    hit = (A.argmax(t) == A.argmax(e)).cast("double")
    err = A.total(F.zip_with(t, e, lambda a, b: F.abs(a - b))) / F.size(t)
    places = lambda v: F.filter(F.transform(v, lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))), lambda s: s["x"] > 1e-6)
    active = F.array_sort(F.transform(places(t), lambda s: -s["i"]))
    best = lambda n: F.array_sort(F.transform(F.slice(F.reverse(F.array_sort(places(e))), 1, n), lambda s: -s["i"]))
    pair = A.let(active, lambda a: F.when(o & (F.size(a) >= 2), (best(F.size(a)) == a).cast("double")))
    one = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("top1_accuracy"), F.avg(err).alias("weight_mae"), F.avg(F.when(o, hit)).alias("top1_accuracy_overlap"), F.avg(F.when(o, err)).alias("weight_mae_overlap"), F.avg(pair).alias("pair_accuracy_overlap"),
    )
    cells = rows.select(F.posexplode(F.arrays_zip(t.alias("t"), e.alias("e"))).alias("pos", "c")).groupBy("pos").agg(F.avg("c.t").alias("t"), F.avg("c.e").alias("e")).where("t > 0 or e > 0")
    d = F.col("e") - F.col("t")
    varied = (F.count_distinct("t") > 1) & (F.count_distinct("e") > 1)
    r = F.try_divide(F.covar_pop("t", "e"), F.nullif(F.stddev_pop("t") * F.stddev_pop("e"), F.lit(0.0)))
    cover = cells.agg(F.when(varied, r).alias("coverage_corr"), F.avg(F.abs(d)).alias("coverage_mae"), F.sqrt(F.avg(d * d)).alias("coverage_rmse"), F.sum(F.abs(d)).alias("coverage_l1"), F.max(F.abs(d)).alias("coverage_linf"))
    return one.crossJoin(cover)  # one row each


def identity_accuracy(pairs: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """Of each group, from matched states with their labels (label_true, label_est, similarity): shares of pairs with one label, of all states and of pairs, and the states unmatched."""
    same = F.count_if(F.col("label_true") == F.col("label_est"))
    met = sizes.join(pairs.groupBy(*by).agg(same.alias("n_label_matches"), F.count(F.lit(1)).alias("n_matched"), F.avg("similarity").alias("mean_similarity")), by, "left")
    met = met.withColumn("n_label_matches", F.coalesce("n_label_matches", F.lit(0))).withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    return met.select(
        *by, (F.col("n_label_matches") / F.greatest("k_true", "k_est", F.lit(1))).alias("identity_accuracy"), F.try_divide(F.col("n_label_matches"), F.col("n_matched")).alias("identity_accuracy_matched"), "n_label_matches", "n_matched",
        (F.col("k_true") - F.col("n_matched")).alias("n_unmatched_true"), (F.col("k_est") - F.col("n_matched")).alias("n_unmatched_estimated"), "mean_similarity",
    )
