"""Operators that SQL cannot express, against definitions, enumerations and planted states; edge cases; the reference values of small frames."""

from __future__ import annotations

import itertools
import json
import math
import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stateflux.functions import special
from stateflux.functions import text as X
from stateflux.operators import arrays as A
from stateflux.operators import backfit as B
from stateflux.operators import channels as C
from stateflux.operators import fits as M
from stateflux.operators import regression as R
from stateflux.operators import resampling as P
from stateflux.operators import sequences as S
from stateflux.operators import signals as G
from stateflux.operators import statistics as ST
from stateflux.operators import tables as T
from stateflux.plans import QUERIES, SQL
from stateflux.sinks import files as K
from stateflux.sources import files as SF
from tests import local_fits as local
from tests import local_regression as LR
from tests.oracle import same


def one(df):
    return df.collect()[0]


# -- values of small frames


def test_paired_benchmark(spark):
    rows = [(r, m, 0.9 if m == "spm" else 0.7) for r in (1, 2) for m in ("spm", "kmeans")]
    pairs = T.paired(spark.createDataFrame(rows, "rep int, method string, f1 double"), ["rep"], "method", "kmeans", "spm", "f1").collect()
    assert len(pairs) == 2 and all(r["diff"] > 0 for r in pairs)
    for wrong in ([(1, "spm", 0.5)], [(3, "spm", 0.5)]):
        with pytest.raises(Exception, match="keys are not unique|not on both sides"):
            T.paired(spark.createDataFrame(rows + wrong, "rep int, method string, f1 double"), ["rep"], "method", "kmeans", "spm", "f1").collect()


def test_row_rates_of_a_confusion(spark):
    got = {(r["t"], r["p"]): (r["n"], r["share"]) for r in T.confusion(spark.createDataFrame([(4, 4), (4, 5), (3, 3)], "t int, p int"), "t", "p").collect()}
    assert got[4, 4] == (1, 0.5) and got[4, 5] == (1, 0.5) and got[5, 5] == (0, None)


def test_map_normalisation(spark):
    x = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 3.0]), (2, [5.0])], "id int, m array<double>")
    got = {r["id"]: r for r in x.select("id", A.unit(F.col("m")).alias("u"), A.unit_rms(F.col("m")).alias("r"), A.gfp_sd(F.col("m")).alias("sd")).collect()}
    assert got[0]["u"] == [0.0, 0.0] and abs(np.linalg.norm(got[1]["u"]) - 1) < 1e-12 and got[1]["r"] == [-1.0, 1.0] and got[2]["sd"] is None


def test_label_orders(spark):
    frames = [spark.createDataFrame(list(enumerate(x)), "o int, l string") for x in ("AB", "CB", [None, "A"])]
    assert [(r["l"], r["place"]) for r in T.label_order(frames, "l", "o").orderBy("place").collect()] == [("A", 1), ("B", 2), ("C", 3)]


def test_design_arithmetic(spark):
    design = G.design(spark, 2, [4, 5, 6, 7], [0], [0, 0.5])
    assert design.count() == 16 and design.select("condition").distinct().count() == 16 and design.count() * 3 * 13 == 624


def test_tokens(spark):
    x = spark.createDataFrame([("spm_vb", "elbow_sil_combined"), ("kmeans_koenig", "ch"), (None, "bic bic")], "m string, c string")
    got = x.select(X.method(F.col("m")).alias("m"), X.criterion(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("spm vb", "elbow sil combined"), ("koenig kmeans", "calinski harabasz score"), ("", "bic")]


# -- parsing and tables


def test_channels_and_numbers(spark):
    x = spark.createDataFrame([("EEG channel 007",), ("00a1",), (" Chan 000",), (None,)], "t string")
    assert [r[0] for r in x.select(X.channel(F.col("t"))).collect()] == ["7", "00a1", "0", None]
    x = spark.createDataFrame([("1d",), ("NaN",), (">=5",), ("1,000",), (None,)], "t string")
    assert [r[0] for r in x.select(X.number(F.col("t"))).collect()] == [None, None, None, 1000.0, None]


def test_even_sample_is_rounded_steps(spark):
    for n, cap in ((12, 5), (13, 4), (5, 5), (100, 7), (1, 3), (3, 2), (31, 30)):
        got = sorted(r["i"] for r in T.spread_sample(spark.range(n).selectExpr("id as i", "1 as g"), ["g"], "i", cap).collect())
        steps = range(n) if n <= cap else sorted({math.floor(j * (n - 1) / (cap - 1) + 0.5) for j in range(cap)})
        assert got == list(steps), (n, cap)


def test_conflicting_aliases(spark):
    rows, names = spark.createDataFrame([("a",), ("b",), (" c ",)], "id string"), "alias string, canonical string"
    assert sorted(r["id"] for r in T.resolved(rows, "id", spark.createDataFrame([("a", "x"), ("a", "x"), (None, "y")], names)).collect()) == ["b", "c", "x"]
    with pytest.raises(Exception, match="conflicting names of a"):
        T.resolved(rows, "id", spark.createDataFrame([("a", "x"), ("a", "y")], names)).collect()


def test_empty_single_and_constant_groups(spark):
    x = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", None)], "g string, v double")
    got = {r["g"]: r for r in T.described(x, ["g"], "v").collect()}
    assert got["a"]["sd"] is None and got["b"]["sd"] == 0 and got["c"]["n"] == 0 and got["c"]["mean"] is None
    assert all(r["z"] == 0 for r in T.standardised(x.where("g = 'b'"), ["g"], "v").collect())
    assert one(ST.kruskal_wallis(x.where("g = 'b'"), "g", "v"))["h"] is None and one(ST.welch(x.limit(0).select("v", F.col("v").alias("w")), "v", "w"))["t"] is None
    assert ST.spearman(x.withColumn("w", F.lit(1.0)), ["g"], "v", "w").where("rho is not null").count() == 0
    assert one(ST.hotelling(x.select("v", F.col("v").alias("w")), "v", "w"))["t2"] is None
    assert T.chosen(spark.createDataFrame([], "f string, k int, " + ", ".join(f"{m} double" for m in ("gev", "calinski_harabasz", "silhouette", "free_energy", "log_likelihood", "bic", "icl", "covariance"))), ["f"], "k").count() == 0
    with pytest.raises(ValueError):
        T.chosen(x, ["g"], "v", ["no_criterion"])


def test_ranks_of_many_values(spark):
    x = spark.range(3000).selectExpr("cast(id * 7919 % 1009 as double) as v", "1.0D as c").groupBy("v").agg(F.sum("c").alias("c"))
    got = {r["v"]: r["before"] for r in ST.ranked_values(x, "v").collect()}
    counts, before = {r["v"]: r["c"] for r in x.collect()}, 0.0
    for v in sorted(counts):
        assert got[v] == before
        before += counts[v]


# -- sequences


def seq(spark, rows):
    return spark.createDataFrame([(0, i * 1_000_000, i, s, float(g)) for i, (s, g) in enumerate(rows)], "rec long, us long, seq long, state string, gfp double")


def test_one_state_and_borders(spark):
    x = seq(spark, [("a", 1)] * 4)
    r = one(S.state_metrics(x))
    assert r["coverage"] == 1 and r["occurrences"] == 1 and r["run_mean"] == 4 and one(S.entropy(x))["entropy_bits"] == 0
    assert S.state_metrics(x.limit(0)).count() == 0 and S.near_change(x, 2).where("near").count() == 0


def test_tap_between_two_beats(spark):
    x = seq(spark, [("r", 0), ("t", 0), ("r", 0), ("x", 0), ("t", 0), ("t", 0), ("r", 0)])
    assert [(r["seq"], r["hit_us"]) for r in S.nearest(x, "t", "r", 10).orderBy("seq").collect()] == [(1, 0), (4, 2_000_000), (5, 6_000_000)]
    assert [r["seq"] for r in S.nearest(x, "t", "r", 0.5).collect()] == []
    best = S.nearest(seq(spark, [("r", 0), ("t", 0), ("t", 0)]), "t", "r", 10, best=True).collect()
    assert [r["seq"] for r in best] == [1]


def test_phase_of_a_long_record(spark):
    x = spark.range(75_000).selectExpr("0L as rec", "id * 4000 as us", "id as seq", "if(id % 250 = 0, 'r', 's') as state", "1.0D as gfp")
    got = one(S.phase(x, "r").agg(F.count(F.lit(1)).alias("n"), F.max("phase").alias("p")))
    assert got["n"] == 299 * 250 and abs(got["p"] - 2 * math.pi * 249 / 250) < 1e-9


def test_peaks_by_the_definition(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 12, 200)
    x = seq(spark, [("s", g) for g in v]).withColumn("pos", F.col("seq"))
    peaks = [i for i in range(1, 199) if v[i] > v[i - 1] and v[i] >= v[i + 1] and v[i] >= np.quantile(v, 0.4)]
    tops = S.local_maxima(x, 0.4)
    assert sorted(r["seq"] for r in tops.collect()) == peaks
    for strict in (True, False):
        kept = []
        for p in sorted(peaks, key=lambda i: (-v[i], i)):
            if all(abs(p - q) > 5 if strict else abs(p - q) >= 5 for q in kept):
                kept.append(p)
        assert sorted(r["seq"] for r in S.spaced_peaks(tops, 5, strict=strict).collect()) == sorted(kept)
    got, last = [], None
    for p in peaks:
        if last is None or p - last > 4:
            got.append(p)
            last = p
    assert sorted(r["pos"] for r in S.collapsed_train(tops, 4).collect()) == got


def test_spaced_peaks_and_trains_of_long_records(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)  # many blocks
    rng = np.random.default_rng(12)
    rows = [(r, int(p), float(v)) for r in (1, None) for p, v in zip(np.flatnonzero(rng.random(900) < 0.4), rng.integers(0, 12, 900))]
    rows += [(2, p, float(p)) for p in range(0, 60, 2)]  # ever higher: as many rounds as it takes
    x = spark.createDataFrame(rows, "rec long, pos long, gfp double")
    for distance, strict in ((3, True), (5, False), (0, True)):
        got = sorted(((r["rec"], r["pos"]) for r in S.spaced_peaks(x, distance, strict=strict).collect()), key=repr)
        want = []
        for rec in (1, None, 2):
            kept = []
            for _, p, _ in sorted((r for r in rows if r[0] == rec), key=lambda r: (-r[2], r[1])):
                if all(abs(p - k) > distance if strict else abs(p - k) >= distance for k in kept):
                    kept.append(p)
            want += [(rec, p) for p in kept]
        assert got == sorted(want, key=repr)
    for gap in (0, 2, 7):
        want = []
        for rec in (1, None, 2):
            last = None
            for p in sorted(r[1] for r in rows if r[0] == rec):
                if last is None or p - last > gap:
                    want.append((rec, p))
                    last = p
        assert sorted(((r["rec"], r["pos"]) for r in S.collapsed_train(x, gap).collect()), key=repr) == sorted(want, key=repr)
    assert S.spaced_peaks(x.limit(0), 3).count() == 0 and S.collapsed_train(x.limit(0), 3).count() == 0


def test_outliers_keep_enough(spark):
    x = spark.createDataFrame([(0, float(v)) for v in (1, 1, 1, 1, 1, 9)] + [(1, float(v)) for v in (1, 2, 3, 4, 100)] + [(2, 5.0), (2, 50.0)], "g int, v double")
    kept = lambda **k: sorted((r["g"], r["v"]) for r in S.upper_outliers(x, ["g"], "v", **k).where("keep").collect())
    assert (0, 9.0) not in kept(share=0.5, least=3) and (1, 100.0) not in kept(least=4) and (1, 100.0) in kept(least=5) and (2, 50.0) in kept()


def test_axis_dynamics_of_a_turning_map(spark):
    t = np.arange(200)
    axis = np.array([1.0, -1, 0, 0])
    side, other = np.array([0, 0, 1.0, -1]), np.array([1.0, 1, -1, -1])
    maps = axis + 0.3 * (np.cos(t / 10)[:, None] * side / math.sqrt(2) + np.sin(t / 10)[:, None] * other / 2)
    x = spark.createDataFrame([(0, int(i), m.tolist(), 0) for i, m in zip(t, maps)], "rec int, pos int, map array<double>, k int")
    r = one(S.axis_dynamics(x, spark.createDataFrame([(0, axis.tolist())], "k int, centre array<double>"), 100.0))
    assert r["n_active"] == 200 and r["n_runs"] == 1 and r["energy_fraction"] > 0.9 and r["zero_crossing_hz"] == 0
    assert abs(r["precession_abs_deg_s"] - 100 * math.degrees(0.1)) < 20 and r["directionality"] > 0.99


# -- maps, channels


def test_spatial_filters(spark):
    points = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0), (3, -1.0, 0.0, 0.0), (4, 0.0, 0.0, 0.0)], "idx int, x double, y double, z double")
    for mode, total in (("none", 1), ("laplacian", 0), ("smoothing", 1), ("average_reference", 0)):
        sums = {r["target"]: r["s"] for r in C.spatial_filter(points, mode, 2).groupBy("target").agg(F.sum("weight").alias("s")).collect()}
        assert all(abs(s - total) < 1e-12 for s in sums.values()) and (mode == "laplacian" or len(sums) == 5)
    with pytest.raises(ValueError):
        C.spatial_filter(points, "other")
    hit = C.inverse_distance(points.where("idx < 4"), points.where("idx = 1"), 3).collect()
    assert [(r["source"], r["weight"]) for r in hit] == [(1, 1.0)]


def test_common_channels(spark):
    rows = [(f, i, l) for f, ls in (("a", ["Fz", "Cz", "EEG 001"]), ("b", ["cz", "1", "FZ", "Oz"])) for i, l in enumerate(ls)]
    x = spark.createDataFrame(rows, "file string, idx int, label string")
    assert sorted((r["label"], r["idx"]) for r in C.common_channels(x).collect()) == [("1", 2), ("cz", 1), ("fz", 0)]
    assert C.common_channels(x, "densest").count() == 4
    with pytest.raises(Exception, match="not in all files"):
        C.common_channels(x, "strict").collect()


def planted(k=4, n=400, channels=12, noise=0.05, seed=0):
    rng = np.random.default_rng(seed)
    truth = M.normal(rng.normal(size=(k, channels)))
    labels = rng.integers(0, k, n)
    x = truth[labels] * rng.choice([-1.0, 1.0], n)[:, None] * rng.uniform(0.5, 2, n)[:, None]
    return truth, labels, x + noise * rng.normal(size=x.shape)


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4), (2, 5), (5, 5)):
        for _ in range(20):
            s = rng.random((n, m)).round(1 if n == 5 else 3)
            small, big = sorted((n, m))
            best = max(sum(s[i, p[i]] if n <= m else s[p[i], i] for i in range(small)) for p in itertools.permutations(range(big), small))
            pairs = M.assignment(s)
            assert len(pairs) == small == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and abs(sum(s[a, b] for a, b in pairs) - best) < 1e-9
    assert M.assignment(np.empty((0, 3))) == []


def test_matching_and_recovery(spark):
    rows = [(0, i, j, 0.9 if i == j else 0.1) for i in range(3) for j in range(2)]
    sims = spark.createDataFrame(rows, "g int, i int, j int, similarity double")
    pairs = M.matched(sims, ["g"])
    assert sorted((r["i"], r["j"]) for r in pairs.collect()) == [(0, 0), (1, 1)] and M.matched(sims, ["g"], threshold=0.95).count() == 0
    r = one(M.recovery(pairs, spark.createDataFrame([(0, 3, 2)], "g int, k_true int, k_est int"), ["g"]))
    assert abs(r["f1"] - 2 * 2 / 5) < 1e-12 and abs(r["sensitivity"] - 2 / 3) < 1e-12 and r["precision"] == 1 and abs(r["mean_recovery_padded"] - 0.6) < 1e-12


def test_template_alignment(spark):
    truth, _, _ = planted(n=300)
    names = "label string, map array<double>"
    templates = spark.createDataFrame([(c, (-t).tolist()) for c, t in zip("ABCD", truth)], names)
    states = spark.createDataFrame([(0, i, t.tolist()) for i, t in enumerate(truth[::-1])] + [(0, 4, [1.0, -1.0] + [0.0] * 10)], "f int, state int, map array<double>")
    got = {r["state"]: r for r in M.template_alignment(states, templates, ["f"]).collect()}
    assert [got[i]["label"] for i in range(5)] == ["D", "C", "B", "A", "X5"] and got[0]["polarity"] == -1 and got[0]["strong"] and not got[4]["strong"]


def test_components_and_centres(spark):
    truth, labels, x = planted(n=500)
    frame = spark.createDataFrame([(i, int(k), M.normal(v[None])[0].tolist()) for i, (k, v) in enumerate(zip(labels, x))], "id long, k int, map array<double>")
    got = {r["k"]: np.array(r["centre"]) for r in M.principal_centres(frame).collect()}
    assert all(abs(got[k] @ truth[k]) > 0.99 for k in range(4))
    u = M.normal(x)
    mean, axes, shares, rank = M.principal_components(frame, most=3)
    value, vector = np.linalg.eigh(np.cov(u.T))
    assert np.allclose(mean, u.mean(axis=0)) and np.allclose(shares, value[::-1][:3] / value.sum()) and np.allclose(np.abs((axes * vector[:, ::-1].T[:3]).sum(axis=1)), 1) and rank == 11 == local.rank(u)
    scored = {r["id"]: r["scores"] for r in M.scores(frame, mean, axes).collect()}
    assert np.allclose([scored[i] for i in range(500)], (u - mean) @ axes.T)


def test_feature_components_against_svd(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 5))
    rows = [(i, *[None if (i, j) in ((3, 1), (7, 1)) else float(v) for j, v in enumerate(r)], 1.0) for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "u int, " + ", ".join(f"f{j} double" for j in range(5)) + ", flat double")
    filled = x.copy()
    filled[[3, 7], 1] = np.median(np.delete(x[:, 1], [3, 7]))
    z = np.column_stack(((filled - filled.mean(axis=0)) / filled.std(axis=0), np.zeros(40)))
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    keep = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.8) + 1)
    scores, table = M.feature_components(frame, [*[f"f{j}" for j in range(5)], "flat"], "u")
    got = np.array([r[1:] for r in sorted(scores.collect())])
    assert got.shape[1] == keep and np.allclose(np.abs(got), np.abs(z @ vt[:keep].T), atol=1e-6) and len(table) == 6 * keep


# -- backfit


def test_soft_backfits_of_known_mixtures(spark):
    a, b = np.array([1.0, -1, 0, 0]) / math.sqrt(2), np.array([0, 0, 1.0, -1]) / math.sqrt(2)
    centres = spark.createDataFrame([(1, a.tolist()), (2, b.tolist())], "k int, centre array<double>")
    x = spark.createDataFrame([(0, i, (s * (w * a + (1 - w) * b)).tolist(), 1.0) for i, (w, s) in enumerate([(1, 1), (0.7, -1), (0.5, 1), (0.2, -2), (0, 1)])], "rec int, pos int, v array<double>, gfp double")
    got = [r["weights"] for r in B.linear(x, centres).orderBy("pos").collect()]
    assert np.allclose(np.array(got)[:, 0], [1, 0.7, 0.5, 0.2, 0], atol=1e-9)
    fit = [r["f"] for r in x.select("pos", B.two_state(F.col("v"), F.array(*[F.lit(float(t)) for t in a]), F.array(*[F.lit(float(t)) for t in b])).alias("f")).orderBy("pos").collect()]
    assert np.allclose([f["first"] for f in fit], [1, 0.7, 0.5, 0.2, 0], atol=1e-9) and np.allclose([f["gain"] for f in fit][1:4], 1)
    hard = B.hard(x, centres)
    assert [r["k"] for r in hard.orderBy("pos").collect()] == [1, 1, 1, 2, 2]
    mixed = B.transition_aware(hard, centres, rate=50.0).orderBy("pos").collect()
    assert all(abs(sum(r["weights"]) - 1) < 1e-9 for r in mixed) and np.allclose([r["weights"][0] for r in mixed], [1, 0.7, 0.5, 0.2, 0], atol=1e-9) and [r["mixed"] for r in mixed] == [False, True, True, True, False]
    sigmas = B.spreads(x.select(F.lit(1).alias("k"), F.col("v").alias("map")).limit(1), centres)
    assert sigmas[0] < 1e-6 < sigmas[1]
    soft = [r["weights"] for r in B.gaussian(x, centres, [0.5, 0.5]).orderBy("pos").collect()]
    assert all(abs(sum(w) - 1) < 1e-12 for w in soft) and soft[0][0] > 0.99 and abs(soft[2][0] - 0.5) < 1e-9
    peaks = B.hard(x, centres, peak=F.col("pos").isin(0, 4)).orderBy("pos").collect()
    assert [r["k"] for r in peaks] == [1, 1, 1, 2, 2] and [r["pos"] for r in peaks] == [0, 1, 2, 3, 4]


# -- signals


def test_filters_and_spectra(spark):
    rate, t = 200.0, np.arange(2000) / 200.0
    slow, fast = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 50 * t)
    assert np.abs(G.brick_wall(slow + fast, rate, 8, 13) - slow).max() < 1e-9
    y = G.forth_and_back(*G.butterworth(8, 13, rate), slow + fast)
    assert np.abs(y - slow)[200:-200].max() < 0.05
    b, a = G.butterworth(8, 13, rate)
    z = np.exp(2j * np.pi * np.array([8, 13, 10.2]) / rate)
    gain = np.abs(np.polyval(b, z) / np.polyval(a, z))
    assert np.allclose(gain[:2], math.sqrt(0.5), atol=1e-9) and gain[2] > 0.99
    rows = [(r, int(i), [float(v), float(2 * v)]) for r, s in ((0, slow), (1, fast)) for i, v in enumerate(s)]
    x = spark.createDataFrame(rows, "rec int, pos int, v array<double>")
    got = {(r["rec"], r["freq"]): r["power"] for r in G.spectra(x, rate, [5.0, 10.0, 20.0, 50.0]).collect()}
    assert got[0, 10.0] > 1e3 * got[0, 20.0] and got[1, 50.0] > 1e3 * got[1, 10.0]
    white = np.random.default_rng(0).normal(size=(1, 100_000))
    assert abs(G.welch(white, rate, np.arange(5.0, 90.0)).mean() - 2 / rate) < 0.001
    with pytest.raises(ValueError):
        G.welch(white, rate, np.array([100.0]))
    long = x.select("rec", "pos", F.posexplode("v").alias("ch", "x"))
    short = G.filtered(long.where("pos < 20"), rate, 8, 13, "butterworth").join(long.withColumnRenamed("x", "old"), ["rec", "pos", "ch"])
    assert short.where("x <> old").count() == 0 and G.filtered(long, rate, 8, 13).where("rec = 1 and abs(x) > 1e-9").count() == 0


def test_blocks_of_signals_are_as_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n, rate = 9000, 100.0
    v = np.cumsum(rng.normal(size=(2, n)), axis=1) + 5 * np.sin(np.arange(n) * 0.7)
    long = spark.createDataFrame([("r", c, p + 50, float(v[c, p])) for c in range(2) for p in range(n)], "rec string, ch int, pos long, x double")
    b, a = G.butterworth(2.0, 20.0, rate)
    monkeypatch.setattr(G, "BLOCK", 1000)
    reach = G.Recursive(b, a).reach()
    assert n > 5 * reach  # several blocks
    got = np.empty((2, n))
    for r in G.filtered(long, rate, 2.0, 20.0, "butterworth").collect():
        got[r["ch"], r["pos"] - 50] = r["x"]
    for c in range(2):
        assert np.abs(got[c] - G.forth_and_back(b, a, v[c])).max() < 1e-9 * np.abs(v).max()
    # the filter by its difference equation
    x, y = v[0][:300], np.zeros(300)
    for i in range(300):
        y[i] = sum(b[j] * x[i - j] for j in range(5) if i >= j) - sum(a[j] * y[i - j] for j in range(1, 5) if i >= j)
    assert np.allclose(G.Recursive(b, a)(x, np.zeros(4)), y)
    vectors = spark.createDataFrame([("r", p, v[:, p].tolist()) for p in range(n)] + [("s", p, v[:, p].tolist()) for p in range(30)], "rec string, pos long, v array<double>")
    freqs = [1.0, 5.0, 11.0, 40.0]
    monkeypatch.setattr(G, "WINDOWS", 4)
    power = {(r["rec"], r["freq"]): r["power"] for r in G.spectra(vectors, rate, freqs, 1.0, 0.5).collect()}
    for name, own in (("r", v), ("s", v[:, :30])):
        assert np.allclose([power[name, f] for f in freqs], G.welch(own, rate, np.array(freqs), 1.0, 0.5), rtol=1e-9)
    with pytest.raises(Exception, match="follow each other"):
        G.filtered(long.where("pos <> 100"), rate, 2.0, 20.0, "butterworth").count()


def test_spectral_parameters(spark):
    f = np.arange(1.0, 45.5, 0.5)
    power = 10 ** (2 - 1.5 * np.log10(f) + 0.8 * np.exp(-0.5 * ((f - 10) / 1) ** 2))
    line, peaks = G.decomposed(f, power)
    alpha = {p["band"]: p for p in peaks}["alpha"]
    assert abs(line["exponent"] - 1.5) < 0.1 and abs(line["intercept"] - 2) < 0.1 and alpha["peak_hz"] == 10 and 0.6 < alpha["amplitude"] < 0.9 and alpha["probability"] > 0.99
    x = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(f, power)] + [(1, 3.0, 1.0)], "g int, freq double, power double")
    assert G.spectral_parameters(x, ["g"]).count() == len(G.BANDS)
    spectra = G.mean_spectra(spark.createDataFrame([(0, 1.0, 2.0, 1), (0, 1.0, 5.0, 3)], "g int, freq double, power double, n_samples int"), ["g"])
    assert one(spectra)["power"] == 4.25


# -- resampling and regressions


def test_tails_against_tables():
    for got, want in (
        (special.t_two_sided(2.228139, 10), 0.05), (special.t_two_sided(-12.706205, 1), 0.05), (special.f_upper(4.102821, 2, 10), 0.05), (special.f_upper(161.447639, 1, 1), 0.05),
        (special.chi2_upper(3.841459, 1), 0.05), (special.chi2_upper(124.342113, 100), 0.05), (special.z_two_sided(1.959964), 0.05), (special.chi2_upper(0, 3), 1.0), (special.t_two_sided(0, 5), 1.0),
    ):
        assert abs(got - want) < 1e-6
    assert math.isnan(special.t_two_sided(1.0, 0))


def test_tails_as_columns(spark):
    x = spark.createDataFrame([(2.228139, 10.0), (None, 3.0), (1.0, None)], "t double, df double")
    got = [r["p"] for r in x.select(special.p_value("t", F.col("t"), F.col("df")).alias("p")).collect()]
    assert abs(got[0] - 0.05) < 1e-6 and got[1:] == [None, None]


def test_sign_flips_and_bootstrap(spark):
    v = np.array([1.0, 2.0, -0.5, 3.0, 0.7])
    exact = np.mean([np.dot(s, v) >= v.sum() - 1e-12 for s in itertools.product((-1, 1), repeat=5)])
    many = np.random.default_rng(0).normal(5, 1, 400)
    x = spark.createDataFrame([("m", i, float(t)) for i, t in enumerate(v)] + [("n", 0, None), ("o", 1, 2.0)] + [("p", i, float(t)) for i, t in enumerate(many)], "metric string, o int, d double")
    a, b = ({r["metric"]: r for r in P.paired_tests(f, ["metric"], "d", "o", 20_000, 4000).collect()} for f in (x, x.repartition(3)))
    assert abs(a["m"]["p_value"] - exact) < 0.01 and a["m"]["n"] == 5 and a["m"]["mean"] == pytest.approx(v.mean()) and a["m"]["effect_dz"] == pytest.approx(v.mean() / v.std(ddof=1))
    assert a["n"]["n"] == 0 and a["n"]["mean"] is None and a["n"]["p_value"] is None and a["o"]["p_value"] is None and a["o"]["ci_low"] == pytest.approx(2)
    # as samples with replacement have them
    means = np.random.default_rng(1).choice(many, (4000, 400)).mean(axis=1)
    assert abs(a["p"]["ci_low"] - np.percentile(means, 2.5)) < 0.02 and abs(a["p"]["ci_high"] - np.percentile(means, 97.5)) < 0.02 and a["p"]["p_value"] == pytest.approx(1 / 20_001)
    for m in "mp":
        assert a[m]["p_value"] == b[m]["p_value"] and a[m]["ci_low"] == pytest.approx(b[m]["ci_low"], abs=1e-9)


def design(spark, unit, group, condition, x):
    rows = [(u, g, c, s, m.tolist()) for u, g, c, maps in zip(unit, group, condition, x) for s, m in enumerate(maps)]
    return spark.createDataFrame(rows, "unit long, grp string, condition string, state int, map array<double>")


def test_tanova_finds_what_is_planted(spark, monkeypatch):
    rng = np.random.default_rng(5)
    unit, group, condition, x = [], [], [], []
    base, shift = rng.normal(size=(2, 8)), np.zeros((2, 8))
    shift[0, :4], shift[0, 4:] = 1.0, -1.0
    for u in range(16):
        for c in range(2):
            unit.append(u)
            group.append("ab"[u % 2])
            condition.append(f"c{c}")
            x.append(base + c * shift + 0.3 * rng.normal(size=(2, 8)))
    data = design(spark, unit, group, condition, x)
    got = {(r["effect"], r["state"]): r for r in P.tanova(data, draws=400).collect()}
    assert got["condition", 0]["p_uncorrected"] < 0.01 and got["condition", 1]["p_uncorrected"] > 0.02 and got["group", 0]["p_uncorrected"] > 0.02 and got["group_x_condition", 0]["p_max_state"] > 0.02
    assert {k[0] for k in got} >= {"group_pair_a_vs_b", "condition_pair_c0_vs_c1", "condition_within_a", "group_at_c1"} and got["condition", 0]["n_permutations"] == 400
    means = np.array([np.mean([m for m, c in zip(x, condition) if c == f"c{i}"], axis=0) for i in range(2)])
    assert got["condition", 0]["statistic"] == pytest.approx(np.sqrt(((means - means.mean(axis=0))[:, 0] ** 2).mean()))
    # a unit's maps as the group test takes them
    mean, turned = np.mean(x, axis=0), []
    for u in range(16):
        m = np.mean([v for v, w in zip(x, unit) if w == u], axis=0)
        turned.append(P.unit_rms(m * np.where((m * mean).sum(axis=1) < 0, -1, 1)[:, None]))
    own = np.array([np.mean(turned[i::2], axis=0) for i in range(2)])
    assert got["group", 1]["statistic"] == pytest.approx(P.main_effect(own)[1]) and got["group", 1]["n_units"] == 16
    cells = np.array([[np.mean([m for m, a, b in zip(x, group, condition) if (a, b) == (g, c)], axis=0) for c in ("c0", "c1")] for g in "ab"])
    assert got["group_x_condition", 0]["statistic"] == pytest.approx(P.interaction(cells)[0])
    # neither the tasks nor how much they hold change anything
    monkeypatch.setattr(P, "HELD", 1 << 10)
    again = {(r["effect"], r["state"]): r["p_uncorrected"] for r in P.tanova(data.repartition(7), draws=400).collect()}
    assert all(got[k]["p_uncorrected"] == again[k] for k in again)


def test_tanova_posterior_and_what_cannot_be_tested(spark):
    rng = np.random.default_rng(9)
    x = [np.array([[1.0, 0, 0, -1], [0, 1, -1, 0]]) * (1 + c) + 0.1 * rng.normal(size=(2, 4)) for _ in range(10) for c in range(2)]
    unit, condition = [u for u in range(10) for _ in range(2)], ["c0", "c1"] * 10
    posterior = {(r["effect"], r["state"]): r for r in P.tanova(design(spark, unit, [None] * 20, condition, x), draws=600, posthoc=False, bayesian=True, rope=0.2).collect()}
    r = posterior["condition", 0]
    assert r["prob_gt_rope"] > 0.95 and r["ci_low"] < r["posterior_median"] < r["ci_high"] and r["n_draws"] == 600 and r["posterior_mean"] == pytest.approx(r["statistic"], rel=0.1)
    lone = P.tanova(design(spark, [0, 1], ["a", "a"], [None, None], x[:2]), draws=10, posthoc=False).collect()
    assert len(lone) == 2 and all(r["statistic"] is None and r["note"] for r in lone)
    # a unit that lacks a condition is left out, or with complete=False stays if it has two
    three = P.tanova(design(spark, [*unit, 99], [None] * 21, [*condition, "c0"], [*x, x[0]]), draws=5, posthoc=False).collect()
    assert three[0]["n_units"] == 10 and three[0]["n_observations"] == 20
    assert P.tanova(design(spark, [0], [None], [None], x[:1]), draws=5).count() == 0


def test_label_permutations_by_enumeration(spark):
    rng = np.random.default_rng(6)
    x = P.unit_rms(rng.normal(size=(6, 1, 5)) + 3 * np.arange(5))  # all along their mean
    labels = np.array(list("aaabbb"), object)
    effect = lambda p: P.main_effect(np.array([x[p == v].mean(axis=0) for v in "ab"]))[0]
    exact = np.mean([effect(np.array(p, object)) >= effect(labels) - 1e-12 for p in set(itertools.permutations(labels))])
    got = one(P.tanova(design(spark, range(6), labels, [None] * 6, x), draws=4000, posthoc=False))
    assert got["statistic"] == pytest.approx(effect(labels)) and abs(got["p_uncorrected"] - exact) < 0.03
    items = spark.createDataFrame([(0, "condition", f"u{i // 4}", 0, i % 4, f"i{i}") for i in range(12)], "t int, kind string, unit string, g int, c int, item string")
    seen = {}
    for r in P._permuted(items, 500, 1).where("draw >= 0").collect():
        seen.setdefault((int(r["item"][1:]) // 4, r["draw"]), []).append((r["item"], r["label"]))
    assert all(sorted(label for _, label in v) == [0, 1, 2, 3] for v in seen.values())  # within units
    orders = [tuple(label for _, label in sorted(v)) for (u, _), v in seen.items() if u == 0]
    assert len(set(orders)) == 24 and max(orders.count(o) for o in set(orders)) < 45


def test_regressions_in_memory_against_closed_forms():
    rng = np.random.default_rng(7)
    g = np.repeat(np.arange(40), 10)
    x = rng.normal(size=400)
    y = 1 + 2 * x + np.repeat(rng.normal(size=40), 10) + rng.normal(size=400)
    m = np.column_stack((np.ones(400), x))
    beta, cov, between, within = LR.mixed(m, y, g)
    v = between * (g[:, None] == g[None]) + within * np.eye(400)
    w = np.linalg.inv(v)
    assert np.allclose(beta, np.linalg.solve(m.T @ w @ m, m.T @ w @ y)) and np.allclose(cov, np.linalg.inv(m.T @ w @ m)) and 0.5 < between < 2 and 0.7 < within < 1.4

    def loss(b, s):
        u = b * (g[:, None] == g[None]) + s * np.eye(400)
        a = np.linalg.solve(u, m)
        e = y - m @ np.linalg.solve(m.T @ a, a.T @ y)
        return np.linalg.slogdet(u)[1] + e @ np.linalg.solve(u, e)

    assert all(loss(between * p, within * q) >= loss(between, within) - 1e-6 for p, q in ((1.05, 1), (0.95, 1), (1, 1.05), (1, 0.95)))
    ols, robust = LR.ols_clustered(m, y, g)
    e, bread = y - m @ ols, np.linalg.inv(m.T @ m)
    meat = sum(np.outer(s, s) for s in (m[g == k].T @ e[g == k] for k in range(40)))
    assert np.allclose(robust, 40 / 39 * 399 / 398 * bread @ meat @ bread)
    # a saturated logit has the logits of the shares
    z = np.tile([0.0, 1.0], 200)
    hits = (rng.random(400) < np.where(z == 1, 0.7, 0.4)).astype(float)
    b, c, _ = LR.gee(np.column_stack((np.ones(400), z)), hits, np.arange(400), exchangeable=False)
    logit = lambda p: math.log(p / (1 - p))
    assert abs(b[0] - logit(hits[z == 0].mean())) < 1e-8 and abs(b.sum() - logit(hits[z == 1].mean())) < 1e-8
    n, k = np.array([100, 100]), np.array([hits[z == i].sum() / 2 for i in (0, 1)])
    counted, _, _ = LR.gee(np.array([[1.0, 0], [1, 1]]), k, np.arange(2), exchangeable=False, trials=n)
    assert np.allclose(counted, [logit(k[0] / 100), logit(k[1] / 100) - logit(k[0] / 100)])
    # the exchangeable equations hold at the solution
    shift = np.repeat(rng.normal(size=40), 10)
    won = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + x + shift)))).astype(float)
    b, _, alpha = LR.gee(m, won, g)
    mu = 1 / (1 + np.exp(-m @ b))
    s = np.sqrt(mu * (1 - mu))
    r = np.linalg.inv((1 - alpha) * np.eye(10) + alpha)
    score = sum((m[g == k] * s[g == k, None]).T @ r @ ((won - mu) / s)[g == k] for k in range(40))
    assert np.abs(score).max() < 1e-6 and 0 < alpha < 0.5


def test_sums_of_clusters_give_the_regressions_in_memory(spark):
    rng = np.random.default_rng(17)
    rows = []
    for study in "st":
        shift = {c: rng.normal() for c in range(25)}
        for i in range(500):
            c = 0 if i < 170 else int(rng.integers(25))  # one cluster has a third of all rows
            v, level = float(rng.normal()), "abc"[int(rng.integers(2 if study == "t" else 3))]
            y = 1 + 2 * v + (level == "b") + shift[c] + float(rng.normal())
            won = float(rng.random() < 1 / (1 + math.exp(-(0.3 + v + shift[c]))))
            rows.append((study, f"c{c}", level, v, y, won, float(rng.integers(1, 6))))
    data = spark.createDataFrame(rows, "study string, p string, c string, v double, y double, won double, lost double").repartition(5)
    for model, outcome in (("ols", "y"), ("mixed", "y"), ("gee_binomial", "won"), ("gee_gaussian", "y"), ("binomial_counts", "won")):
        got = R.modelled(data, ["study"], outcome, ["c", "v", "c:v"], "p", model, "lost" if model == "binomial_counts" else None).collect()
        for study in "st":
            own = [r for r in rows if r[0] == study]
            levels = sorted({r[2] for r in own})[1:]
            x = np.array([[1.0, *(float(r[2] == k) for k in levels), r[3], *((r[2] == k) * r[3] for k in levels)] for r in own])
            y, cluster = np.array([r[4] if outcome == "y" else r[5] for r in own]), np.array([r[1] for r in own])
            rho = None
            if model == "ols":
                beta, cov = LR.ols_clustered(x, y, cluster)
            elif model == "mixed":
                beta, cov, between, within = LR.mixed(x, y, cluster)
                rho = between / (between + within)
            elif model == "binomial_counts":
                beta, cov, _ = LR.gee(x, y, cluster, "binomial", False, trials=y + np.array([r[6] for r in own]))
            else:
                beta, cov, rho = LR.gee(x, y, cluster, model.removeprefix("gee_"), model == "gee_binomial")
            mine = [r for r in got if r["study"] == study]
            assert [r["column"] for r in mine] == ["(intercept)", *(f"c[{k}]" for k in levels), "v", *(f"c[{k}]:v" for k in levels)]
            assert np.allclose([r["estimate"] for r in mine], beta, atol=1e-6) and np.allclose([r["std_error"] for r in mine], np.sqrt(np.diag(cov)), rtol=1e-5)
            assert rho is None or mine[0]["correlation"] == pytest.approx(rho, abs=1e-6)


def test_models_as_tables(spark):
    rng = np.random.default_rng(8)
    rows = [("s", int(p), "ab"[i % 2], float(v), float(rng.normal() + v + (i % 2))) for p in range(20) for i, v in enumerate(rng.normal(size=6))] + [("t", 0, "a", 1.0, 1.0), ("s", 3, None, 1.0, 1.0)]
    x = spark.createDataFrame(rows, "study string, p int, c string, v double, y double")
    got = R.modelled(x, ["study"], "y", ["c", "v", "c:v"], "p", "mixed").collect()
    assert [r["column"] for r in got] == ["(intercept)", "c[b]", "v", "c[b]:v"] and {r["study"] for r in got} == {"s"} and all(r["n_rows"] == 120 and r["n_clusters"] == 20 for r in got)
    v = {r["column"]: r for r in got}
    assert abs(v["v"]["estimate"] - 1) < 4 * v["v"]["std_error"] and v["v"]["p_value"] < 1e-4 and abs(v["v"]["term_chi2"] - v["v"]["z"] ** 2) < 1e-6
    with pytest.raises(ValueError):
        R.modelled(x, ["study"], "y", ["v"], "p", "other")
    res = R.residualised(x, "y", ["v"])
    got = one(res.agg(F.sum("residual").alias("s"), F.sum(F.col("residual") * F.col("v")).alias("t")))
    assert abs(got["s"]) < 1e-9 and abs(got["t"]) < 1e-9 and R.residualised(x.limit(0), "y", ["v"]).count() == 0


# -- files


def test_manifests_and_recordings(spark, tmp_path):
    for name in ("sub-01/eeg/sub-01_EC.set", "sub-01/eeg/sub-01_rest_eyesopen.fif", "sub-02/eeg/02_EO.set", "sub-02/notes.set", "sub-02/behaviour/eeg/x.set", "sub-02/eeg/readme.txt"):
        (tmp_path / "raw" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / name).write_bytes(b"x" * 7)
    files = SF.recordings(spark, f"file://{tmp_path}/raw")
    assert sorted(r["name"] for r in files.collect()) == ["02_EO.set", "sub-01_EC.set", "sub-01_rest_eyesopen.fif"] and {r["size"] for r in files.collect()} == {7}
    made = SF.manifest_of(files).collect()
    assert [(r["participant"], r["condition"]) for r in made] == [("sub-01", "eyes_closed"), ("sub-01", "eyes_open"), ("02", "eyes_open")]
    (tmp_path / "m.tsv").write_text("Subject_ID\tTask\tFile\nsub-9\t\ta/sub-9_EC.set\n\trest\t/abs/sub-3/x.set\nz\tz\t\n")
    got = SF.read_manifest(spark, f"file://{tmp_path}/m.tsv").collect()
    assert sorted((r["participant"], r["condition"], r["group"]) for r in got) == [("sub-3", "rest", "all"), ("sub-9", "EC", "all")]
    assert {r["file_path"] for r in got} == {"/abs/sub-3/x.set", f"file://{tmp_path}/a/sub-9_EC.set"}
    empty = spark.createDataFrame([], "participant string, condition string, group string, file_path string")
    kept = SF.preferred_manifest([empty], spark.createDataFrame([("suj_1", "intero", "", "b"), ("suj_1", "intero", "x", "a")], empty.schema)).collect()
    assert [(r["file_path"], r["study"]) for r in kept] == [("a", "unknown")]


def test_sequences_and_behaviour(spark, tmp_path):
    for name, state in (("sub-7_intero_sequence.csv", "MS_A"), ("sub-7_intero_global_sequence.csv", "state B"), ("suj_150_extero.csv", "C")):
        (tmp_path / name).write_text(f"sample_index,microstate_name,gfp\n0,{state},1.5\n1,{state},x\n")
    got = SF.read_sequences(spark, f"file://{tmp_path}/s*.csv").collect()
    assert {(r["participant"], r["condition"], r["state"], r["group"], r["study"]) for r in got} == {("sub-7", "intero", "B", "ANX", "ANX"), ("suj_150", "extero", "C", "NANX", "ANX")} and len(got) == 4 and sorted(r["gfp"] or 0 for r in got) == [0, 0, 1.5, 1.5]
    manifest = spark.createDataFrame([("sub-7", "intero", "hypertensive", "f")], "participant string, condition string, group string, file_path string")
    assert {r["group"] for r in SF.read_sequences(spark, f"file://{tmp_path}/s*.csv", manifest).collect()} == {"HTN", "NANX"}
    (tmp_path / "b.csv").write_text("Score,ID,Note\n3,sub-01,ok\nScore,ID,Note\n4,sub-02,\n")
    assert sorted(map(tuple, SF.read_behaviour(spark, f"file://{tmp_path}/b.csv").collect())) == [("sub-01", "Note", "ok"), ("sub-01", "Score", "3"), ("sub-02", "Score", "4")]
    names = SF.templates(spark.createDataFrame([(4, i, [float(i)]) for i in range(4)] + [(5, 0, [9.0])], "k int, state int, map array<double>"), "ABC", 4)
    assert [(r["label"], r["map"]) for r in names.orderBy("map").collect()] == [("A", [0.0]), ("B", [1.0]), ("C", [2.0]), ("X4", [3.0])]


def test_configuration(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": {"x": 2, "p": "~/d/$NAME/${OTHER}"}, "l": ["$NAME"]}))
    got = SF.configuration(str(tmp_path / "c.json"), {"a": {"x": 1, "y": 3}, "b": 4}, {"HOME": "/h", "NAME": "n"})
    assert got == {"a": {"x": 2, "y": 3, "p": "/h/d/n/${OTHER}"}, "b": 4, "l": ["n"]} and SF.configuration(None, {"q": "~"}, {"HOME": "/h"}) == {"q": "/h"}


def test_sinks(spark, tmp_path):
    x = spark.createDataFrame([(1, 0, [1.0, float("nan")], "A"), (1, 1, [2.0, 3.0], "B")], "fit int, state int, map array<double>, label string")
    K.write_table(x, f"file://{tmp_path}/t", "csv")
    assert spark.read.csv(f"file://{tmp_path}/t", header=True).count() == 2
    K.write_matrix(x, f"file://{tmp_path}/m", ["fit", "state"])
    assert spark.read.csv(f"file://{tmp_path}/m", header=True).columns == ["fit", "state", "ch_001", "ch_002"]
    text = one(K.solution_json(x, ["fit"], {"method": "m"}))["json"]
    told = json.loads(text)
    assert told["k_estimated"] == 2 and told["estimated_microstates"]["state_02"] == [2.0, 3.0] and told["metadata"] == {"method": "m"} and [m["label"] for m in told["matches"]] == ["A", "B"]
    back = SF.state_maps(spark.createDataFrame([(9, text)], "id int, j string"), "j").collect()
    assert {(r["state"], tuple(r["map"])) for r in back} >= {("state_02", (2.0, 3.0))}
    K.write_bundle(x, f"file://{tmp_path}/b", ["fit"])
    K.write_bundle(x.withColumn("fit", F.lit(2)), f"file://{tmp_path}/b", ["fit"])
    assert spark.read.parquet(f"file://{tmp_path}/b").count() == 4
    calls = []

    def make(todo):
        calls.append(sorted(r["c"] for r in todo.collect()))
        return todo.withColumn("r", F.col("c") * 10)

    work, path = spark.createDataFrame([(1,), (2,)], "c int"), f"file://{tmp_path}/r"
    assert K.resumed(work, ["c"], path, {"v": 1}, make).count() == 2
    more = K.resumed(work.union(spark.createDataFrame([(3,)], "c int")), ["c"], path, {"v": 1}, make)
    assert sorted(r["r"] for r in more.collect()) == [10, 20, 30] and calls == [[1, 2], [3]]
    K.resumed(work, ["c"], path, {"v": 2}, make)
    assert calls[-1] == [1, 2]


# -- recordings


def mat5(variables, compress=False):
    """A MATLAB 5 file by the format's description."""
    import struct
    import zlib

    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    def matrix(name, v):
        if isinstance(v, str):
            body, kind, shape = element(4, np.array([ord(c) for c in v], "<u2").tobytes()), 4, (1, len(v))
        elif isinstance(v, list) and v and isinstance(v[0], dict):
            fields = list(v[0])
            body = struct.pack("<HHI", 5, 4, 16) + element(1, b"".join(f.encode().ljust(16, b"\0") for f in fields)) + b"".join(matrix("", r[f]) for r in v for f in fields)
            kind, shape = 2, (1, len(v))
        elif isinstance(v, list):
            body, kind, shape = b"".join(matrix("", x) for x in v), 1, (1, len(v))
        else:
            a = np.atleast_2d(np.asarray(v))
            kind, code, dtype = (7, 7, "<f4") if a.dtype == np.float32 else (6, 9, "<f8")
            body, shape = element(code, a.astype(dtype).tobytes(order="F")), a.shape
        head = element(6, struct.pack("<II", kind, 0)) + element(5, np.array(shape, "<i4").tobytes()) + (struct.pack("<HH", 1, len(name)) + name.encode().ljust(4, b"\0") if 0 < len(name) <= 4 else element(1, name.encode()))
        return element(14, head + body)

    parts = [matrix(k, v) for k, v in variables.items()]
    if compress:
        parts = [struct.pack("<II", 15, len(z)) + z for z in (zlib.compress(p) for p in parts)]
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + b"".join(parts)


def edf(x, rate, bits=16):
    n, size = len(x), 2 if bits == 16 else 3
    top = 2 ** (bits - 1) - 1
    columns = [("EEG Fz", "EEG Cz", "Status")[i].ljust(16) for i in range(n)], [" " * 80] * n, ["uV".ljust(8)] * n, ["-100".ljust(8)] * n, ["100".ljust(8)] * n, [str(-top - 1).ljust(8)] * n, [str(top).ljust(8)] * n, [" " * 80] * n, [str(rate).ljust(8)] * n, [" " * 32] * n
    records = x.shape[1] // rate
    head = "0".ljust(8) + " " * 80 + " " * 80 + "01.01.0101.01.01" + str(256 * (n + 1)).ljust(8) + " " * 44 + str(records).ljust(8) + "1".ljust(8) + str(n).ljust(4)
    digital = np.round((x + 100) / 200 * (2 * top + 1) - top - 1).astype(np.int32)
    body = b"".join(v.to_bytes(size, "little", signed=True) for r in range(records) for row in digital[:, r * rate : (r + 1) * rate] for v in row.tolist())
    return (head + "".join("".join(c) for c in columns)).encode() + body


def test_recordings_in_files(spark, tmp_path):
    from stateflux.sources.recordings import read_recordings

    rng = np.random.default_rng(9)
    x = rng.uniform(-90, 90, (3, 40))
    places = [{"labels": c, "X": float(i), "Y": 0.5, "Z": [] if i == 2 else 1.0} for i, c in enumerate(("Fz", "Cz", "Pz"))]
    places[2]["Z"] = np.empty((0, 0))
    (tmp_path / "a.set").write_bytes(mat5({"EEG": [{"data": x.astype(np.float32), "srate": 200.0, "chanlocs": places, "comments": "text"}]}))
    (tmp_path / "b.mat").write_bytes(mat5({"X": x.T, "sfreq": 128.0, "channel_labels": ["F1", "F2", "F3"]}, compress=True))
    (tmp_path / "c.edf").write_bytes(edf(x, 20))
    (tmp_path / "d.bdf").write_bytes(edf(x, 20, 24))
    (tmp_path / "e.cnt").write_bytes(b"?")
    (tmp_path / "f.mat").write_bytes(b"MATLAB 7.3")
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("a.set", "b.mat", "c.edf", "d.bdf", "e.cnt", "f.mat")], "path string")
    samples, channels = read_recordings(files)
    got: dict = {}
    for r in samples.orderBy("path", "pos").collect():
        got.setdefault(r["path"][-5:], []).append(r["v"])
    assert set(got) == {"a.set", "b.mat", "c.edf", "d.bdf"} and all(len(v) == 40 for v in got.values())
    for name, error in (("a.set", 1e-4), ("b.mat", 1e-12), ("c.edf", 0.005), ("d.bdf", 1e-4)):
        assert np.abs(np.array(got[name]).T - x).max() < error, name
    told = {(r["path"][-5:], r["idx"]): r for r in channels.collect()}
    assert [told["a.set", i]["label"] for i in range(3)] == ["Fz", "Cz", "Pz"] and told["a.set", 1]["x"] == 1 and told["a.set", 2]["z"] is None and told["a.set", 0]["rate"] == 200
    assert told["b.mat", 2]["label"] == "F3" and told["b.mat", 0]["rate"] == 128 and told["c.edf", 1]["label"] == "EEG Cz" and told["c.edf", 0]["rate"] == 20
    assert "no decoder" in told["e.cnt", None]["error"] and "MATLAB 5" in told["f.mat", None]["error"]
    own, _ = read_recordings(files.where("path like '%cnt'"), {"cnt": lambda data: {"x": np.ones((2, 3)), "rate": 1.0, "labels": ["a", "b"], "places": [[0, 0, 1]] * 2}})
    assert own.count() == 3 and read_recordings(files.limit(0))[0].count() == 0


def test_duplicate_pairs_of_many_states(spark):
    x = np.random.default_rng(4).normal(size=(6000, 32))
    x[5999] = -2 * x[7]
    began = time.time()
    states = spark.createDataFrame(pd.DataFrame({"g": 1, "state": np.arange(6000), "map": x.tolist()}), "g long, state long, map array<double>").repartition(4)
    odd = spark.createDataFrame([(1, 9000, [1.0, 2.0]), (1, 9001, [4.0, 8.0]), (2, 9002, [1.0, 2.0]), (1, 9003, None)], "g long, state long, map array<double>")
    got = sorted((r["g"], r["a"], r["b"], round(r["similarity"], 9)) for r in M.duplicate_pairs(states.unionByName(odd), ["g"], least=0.7).collect())
    assert time.time() - began < 60
    u = x - x.mean(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.abs(u @ u.T)
    want = [(1, int(a), int(b), round(float(s[a, b]), 9)) for a, b in zip(*np.nonzero(np.triu(s >= 0.7, 1)))]
    assert len(want) > 10 and got == sorted([*want, (1, 9000, 9001, 1.0)])


def test_average_ranks_of_a_group_in_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [(g, None if v == 7 else math.nan if v == 8 else float(v)) for g in ("a", "b", None) for v in rng.integers(-20, 400, 700)]
    x = spark.createDataFrame(rows, "g string, v double").withColumn("id", F.monotonically_increasing_id())
    ranked = T.average_ranks(x, ["g"], "v")
    windows = [line for line in ranked._jdf.queryExecution().sparkPlan().toString().splitlines() if "Window " in line and "v#" in line.split("[")[-1]]
    assert not any("rank(" in line for line in windows)
    over = Window.partitionBy("g").orderBy("v")
    want = x.withColumn("avg_rank", F.rank().over(over) + (F.count(F.lit(1)).over(Window.partitionBy("g", "v")) - 1) / 2.0)
    both = ([(r["id"], r["avg_rank"]) for r in df.orderBy("id").collect()] for df in (ranked, want))
    got, expected = both
    assert got == expected and len(got) == 2100
    for block in (100, 2048):
        maps = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(M.normal(rng.normal(size=(500, 5))))], "id int, k int, map array<double>")
        s = {r["id"]: r["silhouette"] for r in ST.exact_silhouette(maps, block=block).collect()}
        m = np.array([r["map"] for r in maps.orderBy("id").collect()])
        far = 1 - np.abs(m @ m.T)
        np.fill_diagonal(far, np.nan)
        means = np.array([np.nanmean(far[:, j::3], axis=1) for j in range(3)]).T
        own = means[np.arange(500), np.arange(500) % 3]
        other = np.where(np.arange(3)[None] == (np.arange(500) % 3)[:, None], np.inf, means).min(axis=1)
        assert np.allclose([s[i] for i in range(500)], (other - own) / np.maximum(own, other), atol=1e-9)


def test_partial_spearman_of_values_computed_anew_each_time(spark):
    x = spark.range(400).selectExpr("id % 2 AS g", "cast(id * 7919 % 1009 AS double) AS a", "cast(id * 31 % 397 AS double) AS b", "cast(id % 25 AS double) AS c", "cast(id % 7 AS double) AS e")
    digit = F.udf(lambda v: v + random.random() * 1e-9, "double").asNondeterministic()
    rows = lambda df: sorted(tuple(r) for r in ST.partial_spearman(df, ["g"], "a", "b", "c", "e").collect())
    got = rows(x.withColumn("b", digit("b")))
    assert [r[1] for r in got] == [200, 200] and got == rows(x)


def test_equal_sums_in_any_order_are_equal(spark, tmp_path):
    cents = [(i, 10 + (i // 2 * 7919 + j * j * 377) % 9973) for i in range(120) for j in (range(9) if i % 2 else range(8, -1, -1))]
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT i AS c_custkey, 'A' AS c_mktsegment, (i * 31 % 101)::DOUBLE AS c_acctbal, (i % 25)::INT AS c_nationkey FROM range(120) t(i)")
    con.execute("CREATE TABLE orders (o_custkey BIGINT, o_totalprice DOUBLE)")
    con.executemany("INSERT INTO orders VALUES (?, ? / 100.0)", cents)
    assert con.execute("SELECT count(DISTINCT s) > 60 FROM (SELECT sum(o_totalprice) AS s FROM orders GROUP BY o_custkey)").fetchone()[0]
    for t in ("customer", "orders"):
        con.execute(f"COPY {t} TO '{tmp_path / t}.parquet' (FORMAT parquet)")
    con.execute("ALTER TABLE orders ALTER o_totalprice TYPE DECIMAL(18, 2)")
    same(QUERIES["t8_partial_spearman"](spark, str(tmp_path)), con, SQL["t8_partial_spearman"])
    odd = {"null": [None, None], "nan": [1.0, math.nan], "inf": [math.inf, 2.0], "large": [1e300, 1.5, None], "fine": [1e-12, 2e-12, 5.5], "less": [-0.1, -0.2, 0.1]}
    got = spark.createDataFrame([(k, v) for k, vs in odd.items() for v in vs], "k string, v double").groupBy("k").agg(T.exact_sum(F.col("v")).alias("s"))
    got = {r["k"]: r["s"] for r in got.collect()}
    assert got["null"] is None and math.isnan(got["nan"]) and got["inf"] == math.inf and got["large"] == 1e300 and got["less"] == -0.2
    assert abs(got["fine"] - 5.500000000003) < 1e-14


def test_silhouettes_send_a_map_to_few_blocks(spark):
    maps = spark.range(3000).selectExpr("id", "id % 3 AS k", "array(sin(id), cos(id)) AS map")
    plan = ST.exact_silhouette(maps, block=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "42), 16)" in plan and "42), 300)" not in plan


def test_filters_of_many_short_signals(spark):
    x = spark.range(0, 400_000, numPartitions=4).selectExpr("int(id / 50) AS rec", "0 AS ch", "int(id % 50) AS pos", "sin(id * id) AS x")
    for kind in ("butterworth", "fft"):
        began = time.time()
        got = {(r["rec"], r["pos"]): r["x"] for r in G.filtered(x, 100.0, 8.0, 20.0, kind).where("rec % 1000 = 7").collect()}
        assert time.time() - began < 20 and len(got) == 400
        for rec in range(7, 8000, 1000):
            v = np.sin(np.arange(50 * rec, 50 * rec + 50, dtype=float) ** 2)
            want = G.brick_wall(v, 100.0, 8.0, 20.0) if kind == "fft" else G.forth_and_back(*G.butterworth(8.0, 20.0, 100.0), v)
            assert np.allclose([got[rec, i] for i in range(50)], want, atol=1e-6)
