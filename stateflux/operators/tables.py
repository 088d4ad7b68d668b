"""Operators on result tables: joins, filters, summaries, ranks, adjustments, model selection."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stateflux.functions.text import finite, number


#: Rows that a table which is broadcast may have: pairs of channels, states, labels.
SMALL = 1 << 20
#: Ranges of values whose running counts are taken in one task each.
RANGES = 256


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """``df``, to be broadcast if it has at most ``limit`` rows; else as it is, for Spark to choose the join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def by_key(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    """The rows of each key, the first ``n`` columns, of batches in which a key's rows follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy() for i in range(n)]
        starts = [0, *(np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(n)):
            yield pa.Table.from_batches(held)
            held = []
        for start, end in itertools.pairwise(starts):
            held.append(batch.slice(start, end - start))
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def exact_sum(x: Column) -> Column:
    """Aggregate: the sum of doubles of up to eight decimals, below 1e20 in size, in whatever order they come, so that equal sums are equal; what goes beyond is added as doubles."""
    fixed = F.coalesce(x.try_cast("decimal(28,8)"), F.lit(0).cast("decimal(28,8)"))
    return F.sum(fixed).cast("double") + F.sum(x - fixed.cast("double"))


def first_row(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in an order that leaves no tie."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def described(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, SD, SEM and the normal 95 % limits; spread is null for one row."""
    base = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    sem = F.col("s") / F.sqrt(F.col("n").cast("double"))
    return base.select(*by, "n", F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"), F.round(sem, 6).alias("sem"), F.round(F.col("m") - 1.96 * sem, 6).alias("low"), F.round(F.col("m") + 1.96 * sem, 6).alias("high"))


def having_all(df: DataFrame, unit: str, part: str) -> DataFrame:
    """Relational division: rows of units that have every value of ``part`` that occurs."""
    need = df.groupBy().agg(F.countDistinct(part).alias("need"))
    full = df.groupBy(unit).agg(F.countDistinct(part).alias("have")).crossJoin(F.broadcast(need)).where("have = need").select(unit)  # need is one row
    return df.join(full, unit, "left_semi")


def having_some(df: DataFrame, unit: str, part: str, least: int) -> DataFrame:
    """Rows of units that have at least ``least`` values of ``part``."""
    return df.join(df.groupBy(unit).agg(F.countDistinct(part).alias("have")).where(F.col("have") >= least).select(unit), unit, "left_semi")


def all_cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the cells of the two factors, how many of them occur, and whether all do."""
    sums = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg((F.countDistinct(a) * F.countDistinct(b)).alias("cells"), F.countDistinct(a, b).alias("present"))
    return sums.withColumn("complete", F.col("cells") == F.col("present"))


def first_match(rows: DataFrame, lookup: DataFrame, on: list[str], order: list[Column], inferred: dict[str, Column]) -> DataFrame:
    """Rows with the columns of the first row of ``lookup`` that has their key; without one, the inferred values. ``found`` says which."""
    first = first_row(lookup, on, *order).withColumn("found", F.lit(True))
    met = rows.join(first, on, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    for name, value in inferred.items():
        met = met.withColumn(name, F.when(F.col("found"), F.col(name)).otherwise(value))
    return met


def resolved(df: DataFrame, id_: str, aliases: DataFrame, alias: str = "alias", canonical: str = "canonical") -> DataFrame:
    """Ids replaced by the name that ``aliases`` gives them; others stay. An alias with two names is an error when rows are read."""
    one = aliases.where(F.col(alias).isNotNull()).groupBy(F.trim(alias).alias("_alias")).agg(F.countDistinct(canonical).alias("_n"), F.min(canonical).alias("_name"))
    conflict = F.raise_error(F.concat(F.lit("conflicting names of "), F.col("_alias")))
    one = one.withColumn("_name", F.when(F.col("_n") > 1, conflict).otherwise(F.col("_name")))
    return df.join(one, F.trim(df[id_]) == F.col("_alias"), "left").withColumn(id_, F.coalesce("_name", F.trim(df[id_]))).drop("_alias", "_n", "_name")


def score(values: Sequence[Column], how: str) -> Column:
    """A composite of columns: ``copy`` of the first, ``mean`` of the finite ones, ``diff`` or ``ratio`` of the first two; null where that is not defined."""
    real = [F.when(finite(v), v.cast("double")) for v in values]
    if how == "copy":
        return real[0]
    if how == "mean":
        n = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in real])
        return F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in real]), n)
    if how == "diff":
        return real[0] - real[1]
    if how == "ratio":
        return ratio(real[0], real[1])
    raise ValueError(f"unknown composite {how}")


def numeric_columns(df: DataFrame, columns: Sequence[str], share: float = 0.8) -> DataFrame:
    """name, filled, numbers, numeric: of each text column the values that are there, those that are numbers, and whether these are ``share`` of them. One pass."""
    there = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    sums = df.agg(*[x for i, c in enumerate(columns) for x in (F.count_if(there(c)).alias(f"f{i}"), F.count_if(there(c) & number(F.col(c)).isNotNull()).alias(f"n{i}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"f{i}").alias("filled"), F.col(f"n{i}").alias("numbers")) for i, c in enumerate(columns)])
    return sums.select(F.explode(rows).alias("r")).select("r.*").withColumn("numeric", (F.col("filled") > 0) & (F.col("numbers") >= share * F.col("filled")))


def selection_errors(df: DataFrame, true: str = "k_true", estimated: str = "k_est", matched: str | None = None) -> DataFrame:
    """Adds the signed, absolute and squared error of a number of states, whether it is too low or too high, and with ``matched`` the states missed and too many."""
    e = F.col(estimated) - F.col(true)
    out = df.withColumns({"k_signed_error": e, "k_abs_error": F.abs(e), "k_sq_error": e * e, "under": e < 0, "over": e > 0, "correct": e == 0})
    if matched:
        out = out.withColumns({"missed": F.greatest(F.col(true) - F.col(matched), F.lit(0)), "extra": F.greatest(F.col(estimated) - F.col(matched), F.lit(0))})
    return out


def condition_deltas(features: DataFrame, unit: str, minuend: str, subtrahend: str, name: str = "name", condition: str = "condition", value: str = "value") -> DataFrame:
    """unit, name, delta: of each unit and feature the difference of its means in two conditions, where both are there."""
    mean = lambda c: F.avg(F.when(F.col(condition) == c, F.col(value)))
    both = features.where(F.col(condition).isin(minuend, subtrahend)).groupBy(unit, name).agg(mean(minuend).alias("_a"), mean(subtrahend).alias("_b"))
    return both.where("_a is not null and _b is not null").select(unit, F.concat(F.lit(f"delta__{minuend}_minus_{subtrahend}__"), name).alias(name), (F.col("_a") - F.col("_b")).alias("delta"))


def fallback(base: DataFrame, levels: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """The value from the first of several tables that has the row's key, from the most to the least specific; ``level`` says which."""
    out, found = base, []
    for i, (lookup, on) in enumerate(levels):
        own = lookup.select(*on, F.col(value).alias(f"_{i}"))
        out = out.join(own, on, "left") if on else out.crossJoin(F.broadcast(own))
        found.append(f"_{i}")
    level = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(i)) for i, c in enumerate(found)])
    return out.withColumn(value, F.coalesce(*found)).withColumn("level", level).drop(*found)


def paired(df: DataFrame, keys: list[str], side: str, one, two, value: str, complete: bool = True) -> DataFrame:
    """Rows of the two sides of a comparison, side by side: one aggregation instead of a self-join.

    A key that a side has twice is an error when rows are read, and with
    ``complete`` one that only one side has.
    """
    a, b = (F.count_if(F.col(side) == s) for s in (one, two))
    met = df.where(F.col(side).isin(one, two)).groupBy(*keys).agg(a.alias("_n"), b.alias("_m"), *[F.max(F.when(F.col(side) == s, F.col(value))).alias(c) for c, s in (("a", one), ("b", two))])
    name = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    wrong = F.when((F.col("_n") > 1) | (F.col("_m") > 1), F.raise_error(F.concat(F.lit("keys are not unique: "), name)).cast("boolean"))
    if complete:
        wrong = wrong.when((F.col("_n") == 0) | (F.col("_m") == 0), F.raise_error(F.concat(F.lit("not on both sides: "), name)).cast("boolean"))
    sound = wrong.otherwise((F.col("_n") == 1) & (F.col("_m") == 1))
    return met.where(sound).drop("_n", "_m").withColumn("diff", F.col("b") - F.col("a"))


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Dense confusion counts over the union of labels, with row shares (null for labels that never are true)."""
    labels = df.select(F.col(true).alias("l")).union(df.select(F.col(predicted).alias("l"))).where("l is not null").distinct()
    grid = labels.select(F.col("l").alias(true)).crossJoin(small(labels.select(F.col("l").alias(predicted)), 10_000))
    out = grid.join(df.groupBy(true, predicted).agg(F.count(F.lit(1)).alias("n")), [true, predicted], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", F.round(ratio(F.col("n"), F.sum("n").over(Window.partitionBy(true))), 6))


def mean_confusion(df: DataFrame, block: str, true: str, predicted: str) -> DataFrame:
    """The mean over blocks of their row-normalised confusions; a label that is never true in a block has a row of zeros there."""
    blocks = df.select(block).distinct()
    labels = df.select(F.col(true).alias("l")).union(df.select(F.col(predicted).alias("l"))).where("l is not null").distinct()
    grid = labels.select(F.col("l").alias(true)).crossJoin(small(labels.select(F.col("l").alias(predicted)), 10_000))
    counts = df.groupBy(block, true, predicted).agg(F.count(F.lit(1)).alias("n"))
    rates = counts.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy(block, true)))
    n = blocks.agg(F.count(F.lit(1)).alias("blocks"))
    sums = rates.groupBy(true, predicted).agg(F.sum("rate").alias("total"))
    return grid.join(sums, [true, predicted], "left").crossJoin(F.broadcast(n)).select(true, predicted, F.coalesce(F.col("total") / F.col("blocks"), F.lit(0.0)).alias("mean_rate"))


def fold_errors(df: DataFrame, fold: Column, value: str) -> DataFrame:
    """fold, train_mean, test_mean, error: the mean of each fold against that of all others, from sums by fold."""
    sums = df.where(finite(F.col(value))).groupBy(fold.alias("fold")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # folds are few
    train = ratio(F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n"))
    out = sums.withColumn("train_mean", train).withColumn("test_mean", F.col("s") / F.col("n"))
    return out.where("train_mean is not null").select("fold", "train_mean", "test_mean", F.abs(F.col("test_mean") - F.col("train_mean")).alias("error"))


def grouped_difference(df: DataFrame, value: str, correct: Column) -> DataFrame:
    """One row: number and mean of the values of correct and of other rows, and the difference."""
    v, ok = F.when(finite(F.col(value)), F.col(value)), F.coalesce(correct, F.lit(False))
    out = df.agg(F.count(F.when(ok, v)).alias("n_correct"), F.count(F.when(~ok, v)).alias("n_incorrect"), F.avg(F.when(ok, v)).alias("mean_correct"), F.avg(F.when(~ok, v)).alias("mean_incorrect"))
    return out.withColumn("mean_difference", F.col("mean_correct") - F.col("mean_incorrect"))


def ranked_values(counts: DataFrame, value: str, count: str = "c", by: Sequence[str] = ()) -> DataFrame:
    """Adds ``before``: how many rows (of a group) have a smaller value, to a table of distinct values (of each group) with counts.

    Values are cut into ranges at approximate quantiles; counts run within a range,
    and the ranges' totals, RANGES numbers a group, give where each begins.
    """
    edges = sorted(set(counts.approxQuantile(value, [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)))
    part = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(value))) if edges else F.lit(0)
    rows = counts.withColumn("_part", part)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(count).over(earlier(Window.partitionBy(*by, "_part").orderBy(value))), F.lit(0.0))
    totals = rows.groupBy(*by, "_part").agg(F.sum(count).alias("_t"))
    totals = totals.withColumn("_first", F.coalesce(F.sum("_t").over(earlier(Window.partitionBy(*by).orderBy("_part"))), F.lit(0.0)))
    totals = totals.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_part").alias("_p"), "_first")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by], F.col("_part") == F.col("_p"))
    out = rows.withColumn("before", inside).join(small(totals) if by else F.broadcast(totals), same)
    return out.withColumn("before", F.col("before") + F.col("_first")).drop("_part", "_p", "_first", *[f"_of_{c}" for c in by])


def average_ranks(df: DataFrame, by: list[str], value: str, of: DataFrame | None = None) -> DataFrame:
    """Adds ``avg_rank``: ranks from 1, ties share their mean. They come from a table of distinct values with counts, so a group is many tasks. ``of`` has the same rows, before other columns were added. A value is computed on both sides and has to be the same there: one that depends on the order of rows is written first."""
    rows = df.withColumn("_value", F.col(value))
    counts = (df if of is None else of).select(*by, F.col(value).alias("_value")).groupBy(*by, "_value").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    ranks = ranked_values(counts, "_value", "_c", by).select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_value").alias("_of"), (F.col("before") + (F.col("_c") + 1) / 2).alias("avg_rank"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by], F.col("_value").eqNullSafe(F.col("_of")))
    return rows.join(small(ranks), same).drop("_value", "_of", *[f"_of_{c}" for c in by])


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, tie: str) -> DataFrame:
    """Adds ``q``: the false discovery rate at which a row is found."""
    n = F.count(p).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(p, tie))
    raw = df.where(F.col(p).isNotNull()).withColumn("_r", rank).withColumn("_q", F.col(p) * n / rank)
    return raw.withColumn("q", F.least(F.min("_q").over(Window.partitionBy(*by).orderBy(F.col("_r").desc())), F.lit(1.0))).drop("_r", "_q")


def holm(df: DataFrame, by: list[str], p: str, tie: str) -> DataFrame:
    """Adds ``p_holm``: p adjusted step-down."""
    n = F.count(p).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(p, tie))
    raw = df.where(F.col(p).isNotNull()).withColumn("_r", rank).withColumn("_p", (n - rank + 1) * F.col(p))
    return raw.withColumn("p_holm", F.least(F.max("_p").over(Window.partitionBy(*by).orderBy("_r")), F.lit(1.0))).drop("_r", "_p")


def quantile_groups(df: DataFrame, by: list[str], value: str, tie: str, groups: int = 5) -> DataFrame:
    """Adds ``grp``: ceil(groups * rank / n), from 1."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("grp", F.ceil(groups * F.row_number().over(Window.partitionBy(*by).orderBy(value, tie)) / n).cast("int"))


def standardised(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds ``z`` (population SD; 0 if constant) and ``unit`` (min-max; 0 if constant)."""
    w = Window.partitionBy(*by)
    sd, low, high = F.stddev_pop(value).over(w), F.min(value).over(w), F.max(value).over(w)
    z = F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0)
    return df.withColumn("z", z).withColumn("unit", F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0))


def spread_sample(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """At most ``n`` rows of each group, evenly spaced in its order: those whose rank is one of n equal steps from 1 to the group's size, rounded."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(order)).cast("long")).withColumn("_n", F.count(F.lit(1)).over(w))
    # rank r is the rounded step j if j (size - 1) / (n - 1) lies in [r - 3/2, r - 1/2); j is the first whole number that can
    step, low, high = 2 * (F.col("_n") - 1), (2 * F.col("_r") - 3) * (n - 1), (2 * F.col("_r") - 1) * (n - 1)
    j = F.greatest(F.lit(0), F.expr(f"((2 * _r - 3) * {n - 1} + 2 * (_n - 1) - 1) div nullif(2 * (_n - 1), 0)"))
    keep = F.when(F.col("_n") <= n, True).otherwise((j * step >= low) & (j * step < high) & (j <= n - 1))
    return ranked.where(keep).drop("_r", "_n")


def seeded_sample(df: DataFrame, by: list[str], key: list[str], n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of each group, by a hash of key and seed: the same rows wherever and in whatever order they lie."""
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))
    return df.withColumn("_h", mixed).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", *key))).where(F.col("_r") <= n).drop("_h", "_r")


def label_order(frames: list[DataFrame], label: str, order: str) -> DataFrame:
    """label, place: the labels of several tables in the order of their first appearance, table after table."""
    rows = reduce(DataFrame.unionByName, [f.select(F.lit(i).alias("_t"), F.col(order).alias("_o"), label) for i, f in enumerate(frames)])
    first = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(F.struct("_t", "_o")).alias("_first"))
    return first.select(label, F.row_number().over(Window.orderBy("_first", label)).alias("place"))  # labels are few


def deviation_flags(df: DataFrame, low: str, high: str, q: str, level: float = 0.05) -> DataFrame:
    """Adds whether an interval leaves out zero, whether the false discovery rate is below the level, and both."""
    away = F.coalesce((F.col(low) > 0) | (F.col(high) < 0), F.lit(False))
    found = F.coalesce(F.col(q) < level, F.lit(False))
    return df.withColumn("away_from_zero", away).withColumn("fdr_found", found).withColumn("both", away & found)


def _min_max(c: Column, w) -> Column:
    """Scaled to [0, 1] over a window; 0 for a constant and for a value that is missing."""
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.coalesce(F.when(high - low > 2.220446049250313e-16, (c - low) / (high - low)), F.lit(0.0))


def chord_distance(df: DataFrame, by: list[str], k: str, y: Column, name: str) -> DataFrame:
    """Adds ``name``: the distance of each inner point of a curve, both axes scaled to [0, 1], from the line through its ends; 0 at the ends."""
    w = Window.partitionBy(*by)
    ends = w.orderBy(k).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("_x", _min_max(F.col(k), w)).withColumn("_y", _min_max(y, w))
    df = df.withColumn("_x0", F.first("_x").over(ends)).withColumn("_x1", F.last("_x").over(ends)).withColumn("_y0", F.first("_y").over(ends)).withColumn("_y1", F.last("_y").over(ends))
    dx, dy = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    d = F.abs(dy * F.col("_x") - dx * F.col("_y") + F.col("_x1") * F.col("_y0") - F.col("_y1") * F.col("_x0")) / F.sqrt(dy * dy + dx * dx + 2.220446049250313e-16)
    inner = (F.col(k) != F.min(k).over(w)) & (F.col(k) != F.max(k).over(w))
    return df.withColumn(name, F.when(inner, d).otherwise(0.0)).drop("_x", "_y", "_x0", "_x1", "_y0", "_y1")


def elbow(df: DataFrame, by: list[str], k: str, score: str) -> DataFrame:
    """Adds ``elbow``: the distance of each inner point of a scaled curve from the line through its ends."""
    return chord_distance(df, by, k, F.col(score), "elbow")


def curvature(df: DataFrame, by: list[str], k: str, score: str) -> DataFrame:
    """Adds ``curvature``: the second difference of a curve at its inner points."""
    w = Window.partitionBy(*by).orderBy(k)
    return df.withColumn("curvature", F.lag(score).over(w) - 2 * F.col(score) + F.lead(score).over(w))


#: The criteria by which a number of states can be selected.
CRITERIA = ["gev", "calinski_harabasz", "silhouette", "free_energy", "log_likelihood", "bic", "icl", "free_energy_elbow", "elbow_sil_combined", "covariance", "covariance_elbow", "free_energy_covariance"]


def criterion_scores(df: DataFrame, by: list[str], k: str) -> DataFrame:
    """Adds ``score_<criterion>`` of each candidate number of states, greater being better, from the columns gev, calinski_harabasz, silhouette, free_energy, log_likelihood, bic, icl and covariance.

    The ends of more than four candidates are no choice of the silhouette. An elbow
    that no point forms falls back to the greatest value (of a covariance, the
    smallest). Without any covariance the hybrid is the free energy.
    """
    w = Window.partitionBy(*by)
    ok = {c: F.when(finite(F.col(c)), F.col(c)) for c in ("gev", "calinski_harabasz", "silhouette", "free_energy", "log_likelihood", "bic", "icl", "covariance")}
    rows = df
    for c in ("gev", "calinski_harabasz", "free_energy", "log_likelihood", "bic", "icl"):
        rows = rows.withColumn(f"score_{c}", ok[c])
    inner = (F.count(F.lit(1)).over(w) <= 4) | ((F.col(k) != F.min(k).over(w)) & (F.col(k) != F.max(k).over(w)))
    rows = rows.withColumn("score_silhouette", F.when(inner, ok["silhouette"])).withColumn("score_covariance", F.max(ok["covariance"]).over(w) - ok["covariance"])
    for name, curve in (("free_energy_elbow", ok["free_energy"]), ("covariance_elbow", F.max(ok["covariance"]).over(w) - ok["covariance"])):
        rows = chord_distance(rows, by, k, curve, "_d")
        flat = F.max("_d").over(w) <= 2.220446049250313e-16
        rows = rows.withColumn(f"_{name}", F.col("_d")).withColumn(f"score_{name}", F.when(flat, curve).otherwise(F.col("_d"))).drop("_d")
    at = F.first(k).over(w.orderBy(F.col("_free_energy_elbow").desc(), k).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("score_elbow_sil_combined", 0.6 * F.exp(-F.abs(F.col(k) - at)) + 0.4 * (ok["silhouette"] + 1) / 2)
    parts = 0.45 * _min_max(F.col("_free_energy_elbow"), w) + 0.35 * _min_max(F.col("_covariance_elbow"), w) + 0.15 * _min_max(F.col("score_covariance"), w) + 0.05 * _min_max(ok["free_energy"], w)
    some = F.count(ok["covariance"]).over(w) > 0
    return rows.withColumn("score_free_energy_covariance", F.when(some, parts).otherwise(ok["free_energy"])).drop("_free_energy_elbow", "_covariance_elbow")


def chosen(df: DataFrame, by: list[str], k: str, criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """by, criterion, k, score: the candidate that each criterion selects, the smaller of two; none where no score is there."""
    unknown = [c for c in criteria if c not in CRITERIA]
    if unknown:
        raise ValueError(f"unknown criteria {unknown}")
    rows = criterion_scores(df, by, k)
    rows = rows.select(*by, k, F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"score_{c}").alias("score")) for c in criteria])).alias("c")).select(*by, k, "c.criterion", "c.score")
    return first_row(rows.where("score is not null"), [*by, "criterion"], F.round("score", 9).desc(), F.col(k))


def candidate_rows(df: DataFrame, by: list[str], k: str, metrics: Sequence[str], criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """Every candidate with its metrics, these scaled to [0, 1] by curve, its scores, and whether each criterion selects it."""
    w = Window.partitionBy(*by)
    rows = criterion_scores(df, by, k)
    for m in metrics:
        rows = rows.withColumn(f"{m}_norm", _min_max(F.when(finite(F.col(m)), F.col(m)), w))
    for c in criteria:
        rank = F.row_number().over(w.orderBy(F.round(f"score_{c}", 9).desc_nulls_last(), k))
        rows = rows.withColumn(f"selected_by_{c}", (rank == 1) & F.col(f"score_{c}").isNotNull())
    return rows


def selected(df: DataFrame, by: list[str], k: str, score: str, exclude_edges: bool = False) -> DataFrame:
    """The candidate with the best score of each group, ties to the smaller; optionally not an end of more than four candidates."""
    w = Window.partitionBy(*by)
    rows = df
    if exclude_edges:
        rows = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_a", F.min(k).over(w)).withColumn("_b", F.max(k).over(w))
        rows = rows.where((F.col("_n") <= 4) | ((F.col(k) != F.col("_a")) & (F.col(k) != F.col("_b")))).drop("_n", "_a", "_b")
    return first_row(rows, by, F.col(score).desc_nulls_last(), F.col(k))


def shrunk(df: DataFrame, by: list[str], value: str, variance: str) -> DataFrame:
    """DerSimonian and Laird's estimate of the variance between rows, and every value drawn towards the weighted mean."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_w", 1 / F.col(variance))
    s0, s1, s2, k = F.sum("_w").over(w), F.sum(F.col("_w") * F.col(value)).over(w), F.sum(F.col("_w") * F.col("_w")).over(w), F.count(F.lit(1)).over(w)
    rows = rows.withColumn("_m", s1 / s0).withColumn("_s0", s0).withColumn("_s2", s2).withColumn("_k", k)
    q = F.sum(F.col("_w") * (F.col(value) - F.col("_m")) * (F.col(value) - F.col("_m"))).over(w)
    tau = F.greatest(F.lit(0.0), F.coalesce(ratio(q - (F.col("_k") - 1), F.col("_s0") - F.col("_s2") / F.col("_s0")), F.lit(0.0)))
    rows = rows.withColumn("tau2", tau)
    again = 1 / (F.col(variance) + F.col("tau2"))
    rows = rows.withColumn("_m2", F.sum(again * F.col(value)).over(w) / F.sum(again).over(w))
    share = F.col("tau2") / (F.col("tau2") + F.col(variance))
    return rows.withColumn("shrunk", share * F.col(value) + (1 - share) * F.col("_m2")).drop("_w", "_m", "_s0", "_s2", "_k", "_m2")


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Tables one below the other by name; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def neighbours(points: DataFrame, id_: str, xyz: list[str], k: int) -> DataFrame:
    """The k nearest other points of each and weights 1/d that sum to 1: the kernel of spatial filters. Points are a montage: some hundreds at most."""
    other = points.select(F.col(id_).alias("nb"), *[F.col(c).alias(f"_{c}") for c in xyz])
    d = F.sqrt(sum((F.col(c) - F.col(f"_{c}")) ** 2 for c in xyz))
    near = points.join(small(other), F.col(id_) != F.col("nb")).withColumn("d", d)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy(id_).orderBy("d", "nb"))).where(F.col("r") <= k)
    inverse = 1 / F.greatest(F.col("d"), F.lit(1e-9))
    return near.select(id_, "nb", F.col("r").alias("rank"), "d", (inverse / F.sum(inverse).over(Window.partitionBy(id_))).alias("weight"))


def hit_summary(beats: DataFrame, by: list[str], hit: str = "hit", latency: str = "latency", tap: str = "tap") -> DataFrame:
    """Of each group's beats: hits and misses with their rates, the latency of hits, and taps that hit nothing, also for each beat."""
    sums = beats.groupBy(*by).agg(F.count(F.lit(1)).alias("n_beats"), F.count_if(hit).alias("n_hits"), F.count_if(tap).alias("_taps"), F.avg(F.when(F.col(hit), F.col(latency))).alias("_m"), F.stddev_samp(F.when(F.col(hit), F.col(latency))).alias("_s"))
    n, misses, extra = F.col("n_beats"), F.col("n_beats") - F.col("n_hits"), F.col("_taps") - F.col("n_hits")
    return sums.select(
        *by, "n_beats", "n_hits", misses.alias("n_misses"), F.round("_m", 4).alias("mean_latency"), F.round("_s", 4).alias("sd_latency"), F.round(F.col("n_hits") / n, 6).alias("hit_rate"), F.round(misses / n, 6).alias("miss_rate"),
        extra.alias("extra_taps"), F.round(extra / n, 6).alias("extra_taps_per_beat"),
    )


def consistency(df: DataFrame, by: list[str], value: str, least: int = 3) -> DataFrame:
    """by, n, variance, inverse_variance, log_inverse of groups with ``least`` values that differ."""
    v = df.where(finite(F.col(value))).groupBy(*by).agg(F.count(value).alias("n"), F.var_samp(value).alias("variance")).where((F.col("n") >= least) & (F.col("variance") > 0))
    return v.withColumn("inverse_variance", 1 / F.col("variance")).withColumn("log_inverse", -F.ln("variance"))
