"""Regressions with errors that allow for clusters, and a random intercept, from sums by cluster.

A pass over the rows sums, for each cluster of each model, what an estimating step
needs; a second sum over clusters gives matrices of coefficients by coefficients,
from which the driver takes the step. All models share the passes; no model's,
group's or cluster's rows are gathered. Terms: numbers as they are, texts and
booleans as indicators against the first level in order, ``a:b`` as products.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stateflux.functions.special import chi2_upper, z_two_sided
from stateflux.operators.rounds import Rounds

#: Levels that a term may have, and ratios of variances that one pass tries.
LEVELS, RATIOS = 200, 33


class Coefficient(NamedTuple):
    """A column of the design: its name, its term, and the parts (column, level or None) whose product it is."""

    name: str
    term: str
    parts: tuple


def coefficients(terms: Sequence[str], levels: dict[str, list[str]]) -> list[Coefficient]:
    """An intercept and the columns of the terms; a term with ``levels`` has a column for each."""
    out = [Coefficient("(intercept)", "(intercept)", ())]
    for term in terms:
        each = [[(part, level) for level in levels[part]] if part in levels else [(part, None)] for part in term.split(":")]
        for parts in itertools.product(*each):
            out.append(Coefficient(":".join(p if level is None else f"{p}[{level}]" for p, level in parts), term, parts))
    return out


class Model:
    """One group's model: which columns of the common design are its own, and its parameters so far."""

    def __init__(self, own: list[int]):
        self.own, self.beta, self.alpha, self.cov, self.extra = own, np.zeros(len(own)), 0.0, None, {}


#: Of a model's rows (design, outcome, trials) one row of numbers each, to be summed by cluster; of its clusters' sums one array, to be summed.
ByRow = Callable[[np.ndarray, np.ndarray, np.ndarray, Model], np.ndarray]
ByCluster = Callable[[np.ndarray, Model], np.ndarray]


def cluster_sums(data: DataFrame, models: dict[str, Model], by_row: ByRow) -> DataFrame:
    """node, cluster, v: summed in each batch, in each task and then by cluster, so a large cluster leaves a task as one row."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for node, own in frame.groupby("node"):
                model = models[node]
                x = np.stack(own["x"].to_numpy()).astype(float)[:, model.own]
                rows = by_row(x, own["y"].to_numpy(float), own["m"].to_numpy(float), model)
                at, names = pd.factorize(own["cluster"])
                sums = np.zeros((len(names), rows.shape[1]))
                np.add.at(sums, at, rows)
                yield pd.DataFrame({"node": node, "cluster": names, "v": list(sums)})

    sums = data.where(F.col("node").isin(*models)).mapInPandas(work, "node string, cluster string, v array<double>")
    return _summed(sums, "node", "cluster")


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(vector_to_array(Summarizer.metrics("sum").summary(array_to_vector("v"))["sum"]).alias("v"))


def over_clusters(clusters: DataFrame, models: dict[str, Model], by_cluster: ByCluster) -> dict[str, np.ndarray]:
    """Each model's sum over its clusters: a few matrices of coefficients by coefficients for each, on the driver."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for node, own in frame.groupby("node"):
                yield pd.DataFrame({"node": [node], "v": [by_cluster(np.stack(own["v"].to_numpy()).astype(float), models[node])]})

    return {r["node"]: np.array(r["v"]) for r in _summed(clusters.mapInPandas(work, "node string, v array<double>"), "node").collect()}


def outer(v: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """The weighted sum of the rows' outer products, as one row."""
    return ((v if weight is None else v * weight[:, None]).T @ v).ravel()


def products(x: np.ndarray) -> np.ndarray:
    """Each row's outer product, as a row."""
    return (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)


# -- least squares and the random intercept


def moments(x, y, m, model) -> np.ndarray:
    """Number, sums and products of design and outcome."""
    both = np.column_stack((x, y))
    return np.column_stack((np.ones(len(y)), both, products(both)))


def least_squares(data: DataFrame, models: dict[str, Model]) -> None:
    """Coefficients and their covariance, with the usual small-sample factor for clusters."""
    sums = over_clusters(cluster_sums(data, models, moments), models, lambda v, model: np.concatenate([[len(v)], v.sum(axis=0)]))
    for node, v in sums.items():
        model, p = models[node], len(models[node].own)
        cross = v[2 + p + 1 :].reshape(p + 1, p + 1)
        model.extra = {"clusters": v[0], "rows": v[1], "bread": np.linalg.pinv(cross[:p, :p])}
        model.beta = model.extra["bread"] @ cross[:p, p]
    scores = cluster_sums(data, models, lambda x, y, m, model: x * (y - x @ model.beta)[:, None])
    for node, v in over_clusters(scores, models, lambda v, model: outer(v)).items():
        model, p = models[node], len(models[node].own)
        g, n, bread = model.extra["clusters"], model.extra["rows"], model.extra["bread"]
        model.cov = g / max(g - 1, 1) * (n - 1) / max(n - p, 1) * bread @ v.reshape(p, p) @ bread


def random_intercept(work: Rounds, data: DataFrame, models: dict[str, Model]) -> None:
    """A random intercept for each cluster by maximum likelihood.

    The likelihood is maximised over the ratio of the two variances; given it, the
    rest has closed forms. A pass tries RATIOS ratios of every model, between the
    neighbours of the best so far.
    """
    clusters = work.written(cluster_sums(data, models, moments), "clusters")
    sums = over_clusters(clusters, models, lambda v, model: np.concatenate([[len(v)], v.sum(axis=0)]))
    for node, v in sums.items():
        model, p = models[node], len(models[node].own)
        model.extra = {"clusters": v[0], "rows": v[1], "cross": v[2 + p + 1 :].reshape(p + 1, p + 1), "tried": {}, "next": [-math.inf, *np.linspace(-20.0, 15.0, 71)], "step": 0.5}

    def profile(v: np.ndarray, model: Model) -> np.ndarray:
        n, s = v[:, 0], v[:, 1 : 2 + len(model.own)]
        ratios = np.exp(np.array(model.extra["next"]))
        return np.concatenate([np.concatenate([[np.log1p(r * n).sum()], outer(s, r / (1 + r * n))]) for r in ratios])

    for _ in range(8):
        got = over_clusters(clusters, models, profile)
        for node, v in got.items():
            model, p = models[node], len(models[node].own)
            n, cross, tried = model.extra["rows"], model.extra["cross"], model.extra["tried"]
            for at, part in zip(model.extra["next"], v.reshape(len(model.extra["next"]), -1)):
                m = cross - part[1:].reshape(p + 1, p + 1)
                bread = np.linalg.pinv(m[:p, :p])
                beta = bread @ m[:p, p]
                within = max((m[p, p] - beta @ m[:p, p]) / n, 1e-300)
                tried[at] = (-0.5 * (n * math.log(2 * math.pi * within) + part[0] + n), beta, bread * within, math.exp(at) * within, within)
            best = max(tried, key=lambda a: (tried[a][0], a == -math.inf))
            model.beta, model.cov, between, within = tried[best][1:]
            model.alpha = between / (between + within)
            model.extra |= {"between": between, "within": within}
            middle, step = max((a for a in tried if a > -math.inf), key=lambda a: tried[a][0]), model.extra["step"]
            model.extra |= {"next": list(np.linspace(middle - step, middle + step, RATIOS)), "step": 2 * step / (RATIOS - 1)}


# -- estimating equations


def gee(data: DataFrame, models: dict[str, Model], family: str, exchangeable: bool, rounds: int = 100, tol: float = 1e-10) -> None:
    """Generalised estimating equations: coefficients, robust covariance, and the correlation within clusters (0 without ``exchangeable``).

    An exchangeable inverse is applied by sums over clusters; each round takes the
    correlation that the round before found.
    """

    def residuals(x, y, m, model) -> np.ndarray:
        eta = np.clip(x @ model.beta, -30, 30)
        mu = 1 / (1 + np.exp(-eta)) if family == "binomial" else x @ model.beta
        v = np.maximum(m * mu * (1 - mu), 1e-12) if family == "binomial" else np.ones(len(y))
        z, r = x * np.sqrt(v)[:, None] if family == "binomial" else x, (y - m * mu) / np.sqrt(v)
        return np.column_stack((np.ones(len(y)), r, r**2, z, z * r[:, None], products(z)))

    def equations(v: np.ndarray, model: Model) -> np.ndarray:
        p, a = len(model.own), model.alpha
        n, r, r2, z, zr, zz = v[:, 0], v[:, 1], v[:, 2], v[:, 3 : 3 + p], v[:, 3 + p : 3 + 2 * p], v[:, 3 + 2 * p :]
        shrink = a / (1 - a + a * n)
        score = (zr - (shrink * r)[:, None] * z) / (1 - a)
        hessian = (zz.sum(axis=0) - outer(z, shrink)) / (1 - a)
        return np.concatenate([[len(v), n.sum(), (n * (n - 1) / 2).sum(), (r**2).sum(), r2.sum()], score.sum(axis=0), hessian, outer(score)])

    # the largest cluster bounds the correlation from below
    largest = {r["node"]: r["n"] for r in data.where(F.col("node").isin(*models)).groupBy("node", "cluster").count().groupBy("node").agg(F.max("count").alias("n")).collect()}
    left = dict(models)
    for _ in range(rounds):
        got = over_clusters(cluster_sums(data, left, residuals), left, equations)
        for node, v in got.items():
            model, p = left[node], len(left[node].own)
            clusters, n, pairs, by_cluster, square = v[:5]
            hessian, meat = v[5 + p : 5 + p + p * p].reshape(p, p), v[5 + p + p * p :].reshape(p, p)
            bread = np.linalg.pinv(hessian)
            step, before = bread @ v[5 : 5 + p], model.alpha
            if exchangeable:
                phi = square / max(n - p, 1)
                model.alpha = float(np.clip((by_cluster - square) / 2 / max(pairs - p, 1) / max(phi, 1e-300), -0.99 / max(largest[node] - 1, 1), 0.99))
            model.beta, model.cov = model.beta + step, bread @ meat @ bread
            model.extra = {"clusters": clusters, "rows": n}
            if np.abs(step).max() < tol and abs(model.alpha - before) < tol:
                del left[node]
        if not left:
            return


def wald_terms(beta: np.ndarray, covariance: np.ndarray, term: Sequence[str]) -> list[tuple[str, float, int, float]]:
    """(term, chi2, df, p) of all columns of each term together."""
    out = []
    for t in dict.fromkeys(term):
        own = np.array([x == t for x in term])
        part = covariance[np.ix_(own, own)]
        chi2 = float(beta[own] @ np.linalg.pinv(part) @ beta[own])
        df = int(np.linalg.matrix_rank(part))
        out.append((t, chi2, df, chi2_upper(chi2, df) if df else math.nan))
    return out


MODELS = ("mixed", "ols", "gee_binomial", "gee_gaussian", "binomial_counts")
RESULT = "model string, term string, column string, estimate double, std_error double, z double, p_value double, term_chi2 double, term_df long, term_p double, n_rows long, n_clusters long, correlation double"


def modelled(rows: DataFrame, by: list[str], outcome: str, terms: Sequence[str], cluster: str, model: str, failures: str | None = None, least_clusters: int = 2) -> DataFrame:
    """by and one row for each coefficient of each group's model, with the Wald test of its term.

    ``mixed`` falls back to clustered least squares where no likelihood is found;
    ``binomial_counts`` takes successes and ``failures``. Rows with a missing value
    are left out; a group with fewer clusters than ``least_clusters`` has no rows.
    A model's levels and its matrices of coefficients by coefficients go to the driver.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model}")
    spark, parts = rows.sparkSession, list(dict.fromkeys(p for t in terms for p in t.split(":")))
    kind = {p: rows.schema[p].dataType.simpleString() for p in parts}
    named = {p: F.initcap(F.col(p).cast("string")) if kind[p] == "boolean" else F.col(p) for p in parts if kind[p] in ("string", "boolean")}
    node = (F.to_json(F.struct(*by)) if by else F.lit("{}")).alias("node")
    there = F.lit(True)
    for c in dict.fromkeys([outcome, cluster, *([failures] if failures else []), *parts]):
        there &= F.col(c).isNotNull() if c in named or rows.schema[c].dataType.simpleString() not in ("double", "float") else F.col(c).isNotNull() & ~F.isnan(F.col(c))
    used = rows.where(there)
    own = {}
    for p, value in named.items():
        found = used.select(node, value.alias("level")).distinct().groupBy("node").agg(F.slice(F.sort_array(F.collect_set("level")), 1, LEVELS + 1).alias("levels")).collect()
        if any(len(r["levels"]) > LEVELS for r in found):
            raise ValueError(f"{p} has more than {LEVELS} levels")
        own[p] = {r["node"]: r["levels"] for r in found}
    every = {p: sorted({x for levels in own[p].values() for x in levels}) for p in named}
    design = coefficients(terms, every)
    column = lambda part, level: F.col(part).cast("double") if level is None else (named[part] == level).cast("double")
    x = []
    for c in design:
        value = F.lit(1.0)
        for part, level in c.parts:
            value = value * column(part, level)
        x.append(value)
    y = F.col(outcome).cast("double")
    trials = y + F.col(failures).cast("double") if failures else F.lit(1.0)
    with Rounds(spark) as work:
        data = work.written(used.select(node, F.col(cluster).cast("string").alias("cluster"), F.array(*x).alias("x"), y.alias("y"), trials.alias("m")), "design")
        enough = [r["node"] for r in data.groupBy("node").agg(F.countDistinct("cluster").alias("n")).where(F.col("n") >= least_clusters).collect()]
        # a group's first level of a term is what the others are held against
        mine = lambda n, c: all(level is None or level in own[part][n][1:] for part, level in c.parts)
        models = {n: Model([i for i, c in enumerate(design) if mine(n, c)]) for n in enough}
        kinds = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by])
        schema = "node string, " + RESULT
        out, names = [], dict.fromkeys(models, model)
        if models:
            if model == "ols":
                least_squares(data, models)
            elif model == "mixed":
                random_intercept(work, data, models)
                lost = {n: m for n, m in models.items() if not np.isfinite(m.beta).all() or not np.isfinite(m.cov).all()}
                if lost:
                    least_squares(data, lost)
                    names |= dict.fromkeys(lost, "ols")
            else:
                gee(data, models, "gaussian" if model == "gee_gaussian" else "binomial", model == "gee_binomial")
        for n, m in models.items():
            term = [design[i].term for i in m.own]
            wald = {t: (chi2, df, p) for t, chi2, df, p in wald_terms(m.beta, m.cov, term)}
            for i, at in enumerate(m.own):
                se = math.sqrt(max(m.cov[i, i], 0.0))
                z = m.beta[i] / se if se > 0 else math.nan
                chi2, df, p = wald[term[i]]
                out.append((n, names[n], term[i], design[at].name, float(m.beta[i]), se, float(z), float(z_two_sided(z)) if z == z else math.nan, chi2, df, float(p), int(m.extra["rows"]), int(m.extra["clusters"]), float(m.alpha)))
    got = spark.createDataFrame(out, schema)
    key = F.from_json("node", kinds) if by else None
    return got.select(*[key[c].alias(c) for c in by], *[c for c in got.columns if c != "node"])


def residualised(rows: DataFrame, y: str, xs: Sequence[str], name: str = "residual") -> DataFrame:
    """Adds what a least-squares fit of y on the covariates and an intercept leaves; the sums of products of one pass give the coefficients. Null where a value is."""
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    there = F.col(y).isNotNull()
    for c in xs:
        there &= F.col(c).isNotNull()
    pick = lambda v: F.when(there, v)
    wanted: list[Column] = [F.sum(pick(a * b)).alias(f"x{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i]
    wanted += [F.sum(pick(a * F.col(y).cast("double"))).alias(f"y{i}") for i, a in enumerate(columns)]
    got = rows.agg(*wanted).first()
    if got["x0_0"] is None:
        return rows.withColumn(name, F.lit(None).cast("double"))
    n = len(columns)
    beta = np.linalg.lstsq(np.array([[got[f"x{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]), np.array([got[f"y{i}"] for i in range(n)]), rcond=None)[0]
    fitted = sum((float(b) * c for b, c in zip(beta[1:], columns[1:])), F.lit(float(beta[0])))
    return rows.withColumn(name, pick(F.col(y) - fitted))
