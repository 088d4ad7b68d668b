"""Test statistics in closed form, each from one or two aggregations; tail probabilities are added to the finished rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stateflux.functions.special import p_value
from stateflux.functions.text import finite, number
from stateflux.operators.rounds import Rounds
from stateflux.operators.tables import average_ranks, ranked_values, ratio, small

#: Blocks of maps that meet, at most, unless one has more than MOST maps; cells of a product worked on at once.
BANDS, MOST, CELLS = 16, 1 << 16, 1 << 22


def kruskal_wallis(df: DataFrame, group: str, value: str, with_p: bool = False) -> DataFrame:
    """H with the correction for ties, its degrees of freedom, and epsilon squared; optionally p.

    Ranks come from a table of distinct values with counts.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("c"))
    ranks = ranked_values(counts, value).withColumn("rk", F.col("before") + (F.col("c") + 1) / 2)
    ties = counts.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("t"))
    sums = rows.join(ranks.select(value, "rk"), value).groupBy(group).agg(F.sum("rk").alias("rs"), F.count(F.lit(1)).alias("m")).agg(F.sum(F.col("rs") * F.col("rs") / F.col("m")).alias("s"), F.count(F.lit(1)).alias("k"))
    n = F.col("n")
    h = ratio(ratio(F.lit(12.0), n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - ratio(F.col("t"), n * (n * n - 1)))
    out = ties.crossJoin(sums).select(F.round(h, 6).alias("h"), (F.col("k") - 1).alias("df"), F.round(ratio(h, n - 1), 6).alias("epsilon2"))  # one row each
    return out.withColumn("p_value", p_value("chi2", F.col("h"), F.col("df"))) if with_p else out


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """a, b, n_a, n_b, u, z, p_value, p_bonferroni: every pair of groups by the rank-sum test, normal with the correction for ties and by one half."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    counts = rows.groupBy("g", "v").agg(F.count(F.lit(1)).cast("double").alias("c"))
    levels = counts.groupBy("g").agg(F.sum("c").alias("n"))  # groups are few
    pairs = levels.select(F.col("g").alias("a"), F.col("n").alias("n_a")).join(small(levels.select(F.col("g").alias("b"), F.col("n").alias("n_b"))), F.col("a") < F.col("b"))
    pairs = small(pairs)
    met = counts.join(pairs, F.col("g") == F.col("a")).unionByName(counts.join(pairs, F.col("g") == F.col("b")))
    both = met.groupBy("a", "b", "n_a", "n_b", "v").agg(F.sum("c").alias("c"), F.sum(F.when(F.col("g") == F.col("a"), F.col("c")).otherwise(0.0)).alias("c_a"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("a", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = both.withColumn("rk", before + (F.col("c") + 1) / 2).groupBy("a", "b", "n_a", "n_b").agg(F.sum(F.col("rk") * F.col("c_a")).alias("r"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("t"))
    na, nb = F.col("n_a"), F.col("n_b")
    n, u = na + nb, F.col("r") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * (n + 1 - ratio(F.col("t"), n * (n - 1))))
    off = u - na * nb / 2
    z = ratio(F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)), sd)
    out = sums.select("a", "b", na.cast("long").alias("n_a"), nb.cast("long").alias("n_b"), u.alias("u"), F.round(z, 6).alias("z"))
    out = out.withColumn("p_value", p_value("z", F.col("z")))
    return out.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p_value") * F.count(F.lit(1)).over(Window.partitionBy())))


def welch(df: DataFrame, a: str, b: str, with_p: bool = False) -> DataFrame:
    """Welch's t of two columns, its degrees of freedom, and Cohen's d with the pooled SD; optionally p."""
    m = df.agg(*[f(c).alias(f"{n}{x}") for x, c in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    va, vb, na, nb = (F.col(c) for c in ("va", "vb", "na", "nb"))
    se, diff = ratio(va, na) + ratio(vb, nb), F.col("ma") - F.col("mb")
    df_ = ratio(se * se, ratio(ratio(va, na) * ratio(va, na), na - 1) + ratio(ratio(vb, nb) * ratio(vb, nb), nb - 1))
    out = m.select(F.round(ratio(diff, F.sqrt(se)), 6).alias("t"), F.round(df_, 4).alias("df"), F.round(ratio(diff, F.sqrt(ratio((na - 1) * va + (nb - 1) * vb, na + nb - 2))), 6).alias("cohen_d"))
    return out.withColumn("p_value", p_value("t", F.col("t"), F.col("df"))) if with_p else out


def one_sample(df: DataFrame, by: list[str], value: str, with_p: bool = False) -> DataFrame:
    """by, n, mean, t, df, cohen_d against zero; optionally p."""
    m = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    out = m.select(*by, "n", F.round("m", 6).alias("mean"), F.round(ratio(F.col("m"), F.col("s") / F.sqrt(F.col("n").cast("double"))), 6).alias("t"), (F.col("n") - 1).alias("df"), F.round(ratio(F.col("m"), F.col("s")), 6).alias("cohen_d"))
    return out.withColumn("p_value", p_value("t", F.col("t"), F.col("df"))) if with_p else out


def hotelling(df: DataFrame, a: str, b: str, by: list[str] | None = None, with_p: bool = False) -> DataFrame:
    """One-sample T squared of a two-dimensional mean against zero, and its F; optionally p. Null for three rows or fewer."""
    m = df.where(finite(F.col(a)) & finite(F.col(b))).groupBy(*(by or [])).agg(F.count(a).alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.covar_samp(a, b).alias("c"))
    ma, mb, va, vb, c, n = (F.col(x) for x in ("ma", "mb", "va", "vb", "c", "n"))
    t2 = F.when(n > 3, ratio(n * (ma * ma * vb - 2 * ma * mb * c + mb * mb * va), va * vb - c * c))
    out = m.select(*(by or []), "n", F.round(t2, 4).alias("t2"), F.round(ratio(n - 2.0, 2.0 * (n - 1)) * t2, 4).alias("f"))
    return out.withColumn("p_value", p_value("f", F.col("f"), F.lit(2.0), F.col("n") - 2)) if with_p else out


def correlation(a: str, b: str) -> Column:
    """Aggregate: Pearson's r; null for a constant."""
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def correlation_p(r: Column, df: Column) -> Column:
    t = r * F.sqrt(F.try_divide(df.cast("double"), F.greatest(1 - r * r, F.lit(2.220446049250313e-16))))
    return F.when((df > 0) & (F.abs(r) < 1), p_value("t", t, df))


def spearman(df: DataFrame, by: list[str], a: str, b: str, least: int = 3, with_p: bool = False) -> DataFrame:
    """by, n, rho of rows where both values are finite; null for fewer than ``least``."""
    rows = df.where(finite(F.col(a)) & finite(F.col(b)))
    rows = average_ranks(average_ranks(rows, by, a).withColumnRenamed("avg_rank", "_ra"), by, b, rows).withColumnRenamed("avg_rank", "_rb")
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation("_ra", "_rb").alias("rho"))
    out = out.withColumn("rho", F.when(F.col("n") >= least, F.round("rho", 6)))
    return out.withColumn("p_value", correlation_p(F.col("rho"), F.col("n") - 2)) if with_p else out


def partial_spearman(df: DataFrame, by: list[str], a: str, b: str, one: str, two: str, least: int = 10, with_p: bool = False) -> DataFrame:
    """by, n, rho: the rank correlation of a and b with two covariates held fixed, from the six pairwise ones of complete rows; null for fewer than ``least``.

    Rows are written once: a sum of doubles may have another last digit each time it is
    computed, and a value that meets its own rank has to be the same on both sides.
    """
    rows = df
    for c in (a, b, one, two):
        rows = rows.where(finite(F.col(c)))
    with Rounds(df.sparkSession) as work:
        rows = whole = work.written(rows.select(*dict.fromkeys((*by, a, b, one, two))), "ranked")
        for i, c in enumerate((a, b, one, two)):
            rows = average_ranks(rows, by, c, whole).withColumnRenamed("avg_rank", f"_r{i}")
        sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[correlation(f"_r{i}", f"_r{j}").alias(f"c{i}{j}") for i in range(4) for j in range(i + 1, 4)])
        sums = work.result(sums, "correlations")
    c = lambda i, j: F.coalesce(F.col(f"c{min(i, j)}{max(i, j)}"), F.lit(0.0))  # noqa: E731  # a constant covariate takes nothing away

    def held(r, p, q):
        return F.try_divide(r - p * q, F.nullif(F.sqrt(F.greatest((1 - p * p) * (1 - q * q), F.lit(0.0))), F.lit(0.0)))

    ab, a2, b2 = held(F.col("c01"), c(0, 2), c(1, 2)), F.coalesce(held(c(0, 3), c(0, 2), c(2, 3)), F.lit(0.0)), F.coalesce(held(c(1, 3), c(1, 2), c(2, 3)), F.lit(0.0))
    out = sums.select(*by, "n", F.when(F.col("n") >= least, F.round(held(ab, a2, b2), 6)).alias("rho"))
    return out.withColumn("p_value", correlation_p(F.col("rho"), F.col("n") - 4)) if with_p else out


def demographic_effects(features: DataFrame, demographics: DataFrame, unit: str, least: int = 10, with_p: bool = False) -> DataFrame:
    """feature, variable, analysis, n, statistic, effect_size: each feature (unit, feature, value) against each variable (unit, variable, text) by the test that fits it.

    Numbers with two values: Welch's t and Cohen's d (the second less the first),
    both with three rows at least. More numbers: Spearman. Texts: Kruskal and Wallis
    over groups of three rows or more, two at least, with epsilon squared. Pairs
    with fewer than ``least`` rows or a constant feature have no row.
    """
    rows = features.where(finite(F.col("value"))).join(demographics.where(F.trim(F.coalesce("text", F.lit(""))) != ""), unit)
    rows = rows.withColumn("x", number(F.col("text"))).withColumn("label", F.lower(F.trim("text")))
    key = ["feature", "variable"]
    facts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), (F.count("x") == F.count(F.lit(1))).alias("_numeric"), F.countDistinct("x").alias("_levels"), F.stddev_pop("value").alias("_sd"), F.min("x").alias("_low"))
    met = rows.join(facts.where((F.col("_n") >= least) & (F.col("_sd") > 0)), key)
    # two numbers
    low = F.col("x") == F.col("_low")
    two = met.where("_numeric and _levels = 2").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[f(F.when(c, F.col("value"))).alias(f"{s}{i}") for i, c in ((0, low), (1, ~low)) for s, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]).where("n0 >= 3 and n1 >= 3")
    n0, n1, v0, v1 = (F.col(c) for c in ("n0", "n1", "v0", "v1"))
    se = v0 / n0 + v1 / n1
    d = ratio(F.col("m1") - F.col("m0"), F.sqrt(ratio((n0 - 1) * v0 + (n1 - 1) * v1, n0 + n1 - 2)))
    freedom = ratio(se * se, v0 * v0 / (n0 * n0 * (n0 - 1)) + v1 * v1 / (n1 * n1 * (n1 - 1)))
    welch_ = two.select(*key, F.lit("welch_t_test").alias("analysis"), "n", ratio(F.col("m0") - F.col("m1"), F.sqrt(se)).alias("statistic"), d.alias("effect_size"), freedom.alias("df"))
    # more numbers
    many = spearman(met.where("_numeric and _levels >= 3"), key, "value", "x")
    rho = many.select(*key, F.lit("spearman").alias("analysis"), "n", F.col("rho").alias("statistic"), F.col("rho").alias("effect_size"), (F.col("n") - 2).cast("double").alias("df"))
    # texts
    texts = met.where("not _numeric").withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*key, "label"))).where("_m >= 3")
    ranks = average_ranks(texts, key, "value").withColumn("_ties", F.count(F.lit(1)).over(Window.partitionBy(*key, "value")))
    sums = ranks.groupBy(*key, "label").agg(F.sum("avg_rank").alias("rs"), F.count(F.lit(1)).alias("m"), F.sum(F.col("_ties") * F.col("_ties") - 1).alias("t"))
    sums = sums.groupBy(*key).agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("rs") * F.col("rs") / F.col("m")).alias("s"), F.sum("t").alias("t")).where("k >= 2")
    n = F.col("n").cast("double")
    h = ratio(12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("t") / (n * (n * n - 1)))
    kruskal = sums.select(*key, F.lit("kruskal_wallis").alias("analysis"), "n", h.alias("statistic"), ratio(h - F.col("k") + 1, n - F.col("k")).alias("effect_size"), (F.col("k") - 1).cast("double").alias("df"))
    out = welch_.unionByName(rho).unionByName(kruskal).select(*key, "analysis", "n", F.round("statistic", 6).alias("statistic"), F.round("effect_size", 6).alias("effect_size"), F.round("df", 4).alias("df"))
    if not with_p:
        return out
    p = F.when(F.col("analysis") == "welch_t_test", p_value("t", F.col("statistic"), F.col("df"))).when(F.col("analysis") == "spearman", correlation_p(F.col("statistic"), F.col("df"))).otherwise(p_value("chi2", F.col("statistic"), F.col("df")))
    return out.withColumn("p_value", p)


def matrix_evidence(rows: DataFrame, label: str = "k", features: str = "f") -> DataFrame:
    """n, k, log_likelihood, bic, icl, assignment_entropy of a mixture of diagonal Gaussians with the labels' moments.

    Moments are sums by label and dimension; the model, an array of states, is one
    row that meets every row of the data.
    """
    cells = rows.select(F.col(label).alias("k"), F.posexplode(features).alias("pos", "x"))
    overall = cells.groupBy("pos").agg(F.greatest(F.coalesce(F.var_samp("x"), F.lit(0.0)), F.lit(1e-8)).alias("gv"), F.avg("x").alias("gm"))
    ridge = overall.agg(F.greatest(F.lit(1e-8), F.median("gv") * 1e-4).alias("ridge"))
    moments = cells.groupBy("k", "pos").agg(F.count(F.lit(1)).alias("m"), F.avg("x").alias("mu"), F.var_samp("x").alias("v")).join(overall, "pos").crossJoin(F.broadcast(ridge))
    moments = moments.withColumn("v", F.greatest(F.when(F.col("m") >= 2, F.col("v")).otherwise(F.col("gv")), F.lit(1e-8)) + F.col("ridge"))
    states = moments.groupBy("k").agg(F.first("m").alias("m"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "mu", "v"))), lambda s: F.struct(s["mu"].alias("mu"), s["v"].alias("v"))).alias("dims"))
    model = states.groupBy().agg(F.array_sort(F.collect_list(F.struct("k", "m", "dims"))).alias("model"), F.sum("m").alias("n"))  # a model has some tens of states
    eps, log2pi = 2.220446049250313e-16, 1.8378770664093453

    def joint(s: Column) -> Column:
        terms = F.zip_with(F.col(features), s["dims"], lambda x, d: log2pi + F.ln(d["v"]) + (x - d["mu"]) * (x - d["mu"]) / d["v"])
        return F.ln(s["m"] / F.col("n") + eps) - 0.5 * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    scored = rows.crossJoin(F.broadcast(model)).withColumn("_j", F.transform("model", joint)).withColumn("_top", F.array_max("_j"))
    scored = scored.withColumn("_ll", F.col("_top") + F.ln(F.aggregate("_j", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top"))) + eps))
    entropy = F.aggregate("_j", F.lit(0.0), lambda a, x: a - F.exp(x - F.col("_ll")) * F.ln(F.exp(x - F.col("_ll")) + eps))
    sums = scored.agg(F.count(F.lit(1)).alias("n"), F.first(F.size("_j")).alias("k"), F.first(F.size(features)).alias("_d"), F.sum("_ll").alias("log_likelihood"), F.sum(entropy).alias("assignment_entropy"))
    bic = F.col("log_likelihood") - 0.5 * ((F.col("k") - 1) + 2 * F.col("k") * F.greatest(F.col("_d"), F.lit(1))) * F.ln(F.col("n"))
    return sums.select("n", "k", "log_likelihood", bic.alias("bic"), (bic - F.col("assignment_entropy")).alias("icl"), "assignment_entropy")


def calinski_harabasz(rows: DataFrame, label: str = "k", features: str = "f") -> DataFrame:
    """n, k, score from sums by label and dimension; null for one label or no more rows than labels."""
    cells = rows.select(F.col(label).alias("k"), F.posexplode(features).alias("pos", "x"))
    parts = cells.groupBy("k", "pos").agg(F.count(F.lit(1)).alias("m"), F.avg("x").alias("mu"), (F.var_pop("x") * F.count(F.lit(1))).alias("w"))
    grand = F.sum(F.col("m") * F.col("mu")).over(Window.partitionBy("pos")) / F.sum("m").over(Window.partitionBy("pos"))
    sums = parts.withColumn("b", F.col("m") * (F.col("mu") - grand) * (F.col("mu") - grand)).groupBy().agg(F.sum("w").alias("w"), F.sum("b").alias("b"), F.countDistinct("k").alias("k"), F.sum(F.when(F.col("pos") == 0, F.col("m"))).alias("n"))
    score = F.when((F.col("k") > 1) & (F.col("n") > F.col("k")), ratio(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k"))))
    return sums.select("n", "k", score.alias("score"))


def exact_silhouette(rows: DataFrame, id_: str = "id", label: str = "k", map_: str = "map", block: int = 2048) -> DataFrame:
    """id, silhouette of every map by distances 1 - |r| to all others, blocks of maps against blocks of maps.

    A map itself and those with |r| = 1 are left out of its own state. Every map
    meets every other one, so the work is the square of their number; beyond some
    ten thousand maps the form by centres is meant. A map is sent to at most
    BANDS pairs of blocks on either side, unless a block then had over MOST maps.
    """
    import numpy as np
    import pandas as pd

    n = rows.count()
    blocks = max(1, -(-n // MOST), min(BANDS, -(-n // block)))
    dealt = rows.select(F.col(id_).alias("id"), F.col(label).alias("k"), F.col(map_).alias("v")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    one, two = dealt.withColumn("c", other), dealt.select(F.col("id").alias("id_"), F.col("k").alias("k_"), F.col("v").alias("v_"), F.col("b").alias("c_"), other.alias("b_"))

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("k_", kind="stable", ignore_index=True)
            y = np.stack(right["v_"].to_numpy())
            mine, ids, (labels, k) = left["k"].to_numpy(), left["id"].to_numpy(), np.unique(right["k_"].to_numpy(), return_inverse=True)
            starts, sizes = np.searchsorted(k, np.arange(len(labels))), np.bincount(k)
            step = max(1, CELLS // len(y))
            for at in range(0, len(left), step):
                part = slice(at, at + step)
                far = 1 - np.abs(np.stack(left["v"].to_numpy()[part]) @ y.T)
                many = np.tile(sizes, (len(far), 1))
                p, q = np.nonzero(far < 1e-9)
                drop = np.round(1 - far[p, q], 9) >= 1
                same = mine[part][:, None] == labels[None]
                left_out = [(p[drop], q[drop])]
                place = pd.Index(right["id_"]).get_indexer_for(ids[part]) if not right["id_"].duplicated().any() else None
                if place is not None:
                    left_out.append((np.flatnonzero(place >= 0), place[place >= 0]))
                else:
                    left_out.append(np.nonzero(ids[part][:, None] == right["id_"].to_numpy()[None]))
                pairs = np.unique(np.concatenate([a.astype(np.int64) * len(y) + b for a, b in left_out]))
                a, b = pairs // len(y), pairs % len(y)
                own = same[a, k[b]]
                a, b = a[own], b[own]
                far[a, b] = 0
                np.subtract.at(many, (a, k[b]), 1)
                total = np.add.reduceat(far, starts, axis=1)
                out.append(pd.DataFrame({"id": np.repeat(ids[part], len(labels)), "k": np.repeat(mine[part], len(labels)), "o": np.tile(labels, len(far)), "d": total.ravel(), "m": many.ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "k": [], "o": [], "d": [], "m": []})

    kind = {c: dealt.schema[c].dataType.simpleString() for c in ("id", "k")}
    met = one.groupBy("b", "c").cogroup(two.groupBy("b_", "c_")).applyInPandas(sums, f"id {kind['id']}, k {kind['k']}, o {kind['k']}, d double, m long")
    means = met.groupBy("id", "k", "o").agg(F.sum("d").alias("d"), F.sum("m").alias("m")).withColumn("d", F.try_divide("d", F.col("m").cast("double")))
    per = means.groupBy("id", "k").agg(F.coalesce(F.max(F.when(F.col("o") == F.col("k"), F.col("d"))), F.lit(0.0)).alias("a"), F.min(F.when(F.col("o") != F.col("k"), F.col("d"))).alias("b"))
    a, b = F.col("a"), F.coalesce("b", "a")
    return per.select("id", F.coalesce(F.try_divide(b - a, F.nullif(F.greatest(a, b), F.lit(0.0))), F.lit(0.0)).alias("silhouette"))
