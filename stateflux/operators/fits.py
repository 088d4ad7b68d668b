"""What fits are compared, matched, aligned and begun with; the clustering itself is in :mod:`clustering`."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateflux.operators import arrays as A
from stateflux.operators.clustering import normal, principal
from stateflux.operators.tables import by_key, small

#: Bands of a set's states, each of LEAST_BAND states or more, and the most states in one; cells of a product and pairs worked on at once.
BANDS, LEAST_BAND, BAND, PRODUCT, PAIRS = 16, 2048, 1 << 16, 1 << 22, 1 << 18


def assignment(similarity: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one pairs (row, column) of greatest total similarity, all rows or all columns used (shortest augmenting paths with potentials)."""
    if min(similarity.shape, default=0) == 0:
        return []
    if similarity.shape[0] > similarity.shape[1]:
        return sorted((i, j) for j, i in assignment(similarity.T))
    cost = similarity.max() - similarity
    n, m = cost.shape
    row_price, col_price, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, seen = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while owner[at]:
            seen[at] = True
            slack = cost[owner[at] - 1] - row_price[owner[at]] - col_price[1:]
            better = ~seen[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], at
            free = np.flatnonzero(~seen[1:]) + 1
            nearest = free[np.argmin(least[free])]
            step = least[nearest]
            row_price[owner[seen]] += step
            col_price[seen] -= step
            least[~seen] -= step
            at = nearest
        while at:
            owner[at], at = owner[way[at]], way[at]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def duplicate_pairs(states: DataFrame, by: list[str], state: str = "state", map_: str = "map", least: float = 0.85) -> DataFrame:
    """by, a, b, similarity: pairs of a model's states that are one but for polarity.

    A set's states are dealt to at most BANDS bands (more, if a band would have
    over BAND states), and each two bands meet in one task as matrices. A product
    of matrices finds the pairs; their similarity is then summed in the order of
    the channels. Pairs leave in parts, so no task holds all of its pairs.
    """
    unit = A.unit(F.col(map_).cast("array<double>"))
    rows = states.select(*by, F.col(state).alias("_s"), unit.alias("_u")).where(" and ".join([*(f"`{c}` is not null" for c in by), "_s is not null and _u is not null and forall(_u, x -> x is not null)"]))
    rows = rows.withColumn("_d", F.size("_u"))
    key = [*by, "_d"]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    bands = F.greatest(F.ceil(F.col("_n") / BAND), F.least(F.lit(BANDS), F.ceil(F.col("_n") / LEAST_BAND))).cast("int")
    dealt = rows.join(small(sizes.select(*key, bands.alias("_m"))), key).withColumn("_b", F.pmod(F.xxhash64("_s"), F.col("_m")).cast("int"))
    dealt = dealt.withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    cell = [*key, "_i", "_j"]
    dealt = dealt.select(*key, F.least("_b", "_c").alias("_i"), F.greatest("_b", "_c").alias("_j"), (F.col("_b") <= F.col("_c")).alias("_left"), "_s", "_u")
    kind = states.schema[state].dataType.simpleString()

    def met(own: pa.Table) -> Iterator[pa.RecordBatch]:
        d, i, j = (own.column(c)[0].as_py() for c in ("_d", "_i", "_j"))
        left, names, heads = own.column("_left").to_numpy(), own.column("_s").combine_chunks(), [own.column(c)[0] for c in by]
        u = own.column("_u").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, d)
        one = np.flatnonzero(left)
        two = one if i == j else np.flatnonzero(~left)
        if not len(one) or not len(two):
            return
        step = max(1, PRODUCT // len(two))
        for at in range(0, len(one), step):
            mine = one[at : at + step]
            p, q = np.nonzero(~(np.abs(u[mine] @ u[two].T) < least - 1e-9))
            for part in range(0, len(p), PAIRS):
                x, y = mine[p[part : part + PAIRS]], two[q[part : part + PAIRS]]
                if i == j:
                    x, y = x[x < y], y[x < y]
                total = np.zeros(len(x))
                for c in range(d):
                    total += u[x, c] * u[y, c]
                total = np.abs(total)
                near = ~(total < least)
                x, y, total = x[near], y[near], total[near]
                a, b = names.take(pa.array(x)), names.take(pa.array(y))
                less, equal = pc.less(a, b), pc.equal(a, b)
                out = [pa.array([h.as_py()] * len(x), h.type) for h in heads]
                out = pa.RecordBatch.from_arrays([*out, pc.if_else(less, a, b), pc.if_else(less, b, a), pa.array(total)], [*by, "a", "b", "similarity"])
                yield out.filter(pc.invert(equal))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in by_key(batches, len(cell)):
            yield from met(own)

    kinds = ", ".join([*(f"`{c}` {states.schema[c].dataType.simpleString()}" for c in by), f"a {kind}, b {kind}, similarity double"])
    return dealt.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(work, kinds)


def solution(fits: DataFrame, by: list[str], k: int | DataFrame) -> DataFrame:
    """The states of one k, or of the k that a table (by, k) gives each set."""
    return fits.where(F.col("k") == k) if isinstance(k, int) else fits.join(k.select(*by, "k"), [*by, "k"], "left_semi")


def with_priors(maps: DataFrame, priors: DataFrame, by: list[str], copies: int, share: float = 1.0, map_: str = "map", gfp: str = "gfp") -> DataFrame:
    """Maps with those of a parent model (by, map) added ``copies`` times each, weighted so that together they count ``share`` of the set's own weight."""
    own = maps.groupBy(*by).agg(F.sum(F.col(gfp) * F.col(gfp)).alias("_w"))
    n = priors.groupBy(*by).agg((F.count(F.lit(1)) * copies).alias("_n"))
    extra = priors.join(own, by).join(n, by).withColumn(gfp, F.sqrt(F.lit(share) * F.col("_w") / F.col("_n"))).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return maps.unionByName(extra.select(*by, map_, gfp), allowMissingColumns=True)


def matched(similarities: DataFrame, by: list[str], one: str = "i", two: str = "j", value: str = "similarity", threshold: float = 0.0) -> DataFrame:
    """by, i, j, similarity: the one-to-one pairs of greatest total similarity of each group, those below the threshold left out. A missing pair has similarity 0."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot_table(index=one, columns=two, values=value, aggfunc="max", fill_value=0.0)
        key = {c: pdf[c].iloc[0] for c in by}
        found = [(grid.index[a], grid.columns[b], float(grid.to_numpy()[a, b])) for a, b in assignment(grid.to_numpy(float))]
        return pd.DataFrame([{**key, one: a, two: b, value: s} for a, b, s in found if s >= threshold], columns=[*by, one, two, value])

    rows = similarities.select(*by, one, two, F.col(value).cast("double").alias(value))
    return rows.groupBy(*by).applyInPandas(pairs, rows.schema)


def recovery(pairs: DataFrame, sizes: DataFrame, by: list[str], value: str = "similarity") -> DataFrame:
    """Of each group, from matched pairs and the numbers of states (by, k_true, k_est): mean similarity of the pairs and padded with zeros, sensitivity, precision, F1.

    At a threshold of 0 all of the smaller model's states are matched, so these three follow from the two numbers.
    """
    met = sizes.join(pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_matched"), F.sum(value).alias("_s")), by, "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0))).withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    n = F.col("n_matched")
    sensitivity, precision = F.coalesce(F.try_divide(n, F.col("k_true")), F.lit(0.0)), F.coalesce(F.try_divide(n, F.col("k_est")), F.lit(0.0))
    return met.select(
        *by, "k_true", "k_est", "n_matched", F.coalesce(F.try_divide(F.col("_s"), n), F.lit(0.0)).alias("mean_recovery_matched"), F.coalesce(F.try_divide(F.col("_s"), F.greatest("k_true", "k_est")), F.lit(0.0)).alias("mean_recovery_padded"),
        sensitivity.alias("sensitivity"), precision.alias("precision"), F.coalesce(F.try_divide(2 * n, F.col("k_true") + F.col("k_est")), F.lit(0.0)).alias("f1"),
    )


def template_alignment(states: DataFrame, templates: DataFrame, by: list[str], strong: float = 0.5, map_: str = "map") -> DataFrame:
    """by, state, label, corr, polarity, aligned, strong: each state with the template that the best assignment gives it, and its map turned that way; without one the label is X and the state's number.

    ``templates`` (label, map) has the channels of the states; see the channel operators to bring them there.
    """
    few = [(r["label"], np.asarray(r[map_], float)) for r in templates.select("label", map_).orderBy("label").collect()]  # a handful of canonical maps
    if len(few) > 1000:
        raise ValueError("too many templates")
    names, t = [x for x, _ in few], normal(np.array([v for _, v in few]))

    def align(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("state")
        x = normal(np.stack(pdf[map_].to_numpy()).astype(float))
        signed, key, out = x @ t.T, {c: pdf[c].iloc[0] for c in by}, []
        to = dict(assignment(np.abs(signed)))
        for i, state in enumerate(pdf["state"]):
            r = signed[i, to[i]] if i in to else 0.0
            turn = -1 if r < 0 else 1
            out.append({**key, "state": state, "label": names[to[i]] if i in to else f"X{i + 1}", "corr": abs(float(r)), "polarity": turn, "aligned": (turn * x[i]).tolist(), "strong": bool(abs(r) >= strong)})
        return pd.DataFrame(out)

    kinds = ", ".join([f"{c} {states.schema[c].dataType.simpleString()}" for c in by] + [f"state {states.schema['state'].dataType.simpleString()}", "label string, corr double, polarity int, aligned array<double>, strong boolean"])
    return states.select(*by, "state", map_).groupBy(*by).applyInPandas(align, kinds)


def _grams(labelled: DataFrame, k: str, map_: str) -> DataFrame:
    """k, n, s, g: of each state the number of maps, their sum and their Gram matrix, summed in each task before the shuffle."""

    def part(batches):
        sums: dict = {}
        for pdf in batches:
            for key, own in pdf.groupby(k):
                x = np.stack(own[map_].to_numpy()).astype(float)
                n, s, g = sums.get(key, (0, 0.0, 0.0))
                sums[key] = n + len(x), s + x.sum(axis=0), g + x.T @ x
        if sums:
            yield pd.DataFrame([{k: key, "n": n, "s": s.tolist(), "g": g.ravel().tolist()} for key, (n, s, g) in sums.items()])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{k: pdf[k].iloc[0], "n": int(pdf["n"].sum()), "s": np.sum([np.asarray(x) for x in pdf["s"]], axis=0).tolist(), "g": np.sum([np.asarray(x) for x in pdf["g"]], axis=0).tolist()}])

    kinds = f"{k} {labelled.schema[k].dataType.simpleString()}, n long, s array<double>, g array<double>"
    return labelled.select(k, map_).mapInPandas(part, kinds).groupBy(k).applyInPandas(total, kinds)


def principal_centres(labelled: DataFrame, k: str = "k", map_: str = "map") -> DataFrame:
    """k, centre, n_maps: the first principal axis of each state's maps, along their mean, at unit length. Only a matrix of channels by channels for each state and task is shuffled."""

    def axis(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.asarray(pdf["s"].iloc[0], float)
        c = normal(principal(np.asarray(pdf["g"].iloc[0], float).reshape(len(s), -1), s)[None])[0]
        return pd.DataFrame([{k: pdf[k].iloc[0], "centre": c.tolist(), "n_maps": int(pdf["n"].iloc[0])}])

    return _grams(labelled, k, map_).groupBy(k).applyInPandas(axis, f"{k} {labelled.schema[k].dataType.simpleString()}, centre array<double>, n_maps long")


def principal_components(rows: DataFrame, map_: str = "map", share: float = 0.999, most: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Mean, axes (one a row), explained shares and numerical rank of all rows' vectors, from one Gram matrix: the driver gets a matrix of channels by channels."""
    got = _grams(rows.select(F.lit(0).alias("k"), map_), "k", map_).collect()
    if not got:
        return np.empty(0), np.empty((0, 0)), np.empty(0), 0
    n, s = got[0]["n"], np.array(got[0]["s"])
    covariance = (np.array(got[0]["g"]).reshape(len(s), -1) - np.outer(s, s) / n) / max(1, n - 1)
    value, vector = np.linalg.eigh(covariance)
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1].T
    total = value.sum()
    shares = value / total if total > 0 else value
    d = min(most, int(np.searchsorted(np.cumsum(shares), share - 1e-12)) + 1)
    signs = np.sign(vector[np.arange(len(vector)), np.abs(vector).argmax(axis=1)])  # the greatest weight of an axis is positive
    return s / n, (vector * signs[:, None])[:d], shares[:d], int((value > value.max(initial=0.0) * len(s) * np.finfo(float).eps * 100).sum())


def scores(rows: DataFrame, mean: np.ndarray, axes: np.ndarray, map_: str = "map", name: str = "scores") -> DataFrame:
    """Adds the scores of each row's vector on the axes, inside Spark's expressions."""
    centred = F.zip_with(F.col(map_), F.array(*[F.lit(float(x)) for x in mean]), lambda a, b: a - b)
    on = lambda c: F.array(*[F.aggregate(F.zip_with(c, F.array(*[F.lit(float(x)) for x in axis]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) for axis in axes])
    return rows.withColumn(name, F.element_at(F.transform(F.array(centred), on), 1))


def feature_components(features: DataFrame, columns: Sequence[str], unit: str, share: float = 0.8, most: int = 20) -> tuple[DataFrame, pd.DataFrame]:
    """Scores of each unit on the components of a table of features, and a table (component, feature, weight, loading, explained).

    Missing values are the column's median, columns are standardised by their population SD (1 if constant), and the fewest components that explain ``share`` are kept.
    """
    value = {c: F.when((F.abs(F.col(c)) < float("inf")) & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    medians = features.agg(*[F.median(value[c]).alias(c) for c in columns]).first()
    filled = features.select(unit, *[F.coalesce(value[c], F.lit(medians[c])).alias(c) for c in columns])
    moments = filled.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    z = filled.select(unit, F.array(*[(F.col(c) - moments[f"m_{c}"]) / (moments[f"s_{c}"] or 1.0) for c in columns]).alias("z"))
    _, axes, explained, _ = principal_components(z, "z", share, most)
    n = max(1, z.count() - 1)
    power = [float(z.select(F.sum(F.pow(F.aggregate(F.zip_with("z", F.array(*[F.lit(float(x)) for x in a]), lambda p, q: p * q), F.lit(0.0), lambda t, x: t + x), 2))).first()[0]) / n for a in axes]
    table = pd.DataFrame([{"component": f"PC{i + 1}", "feature": c, "weight": float(a[j]), "loading": float(a[j] * math.sqrt(power[i])), "explained": float(explained[i])} for i, a in enumerate(axes) for j, c in enumerate(columns)])
    return scores(z, np.zeros(len(columns)), axes, "z").select(unit, *[F.col("scores")[i].alias(f"PC{i + 1}") for i in range(len(axes))]), table


