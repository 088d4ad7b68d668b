"""Distributed fits against planted states, the same fits in memory, and each other's ways of dealing the work."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateflux.operators import clustering as C
from stateflux.operators.fits import assignment
from stateflux.operators.rounds import Rounds
from tests import local_fits as local


def planted(k=4, n=400, channels=12, noise=0.05, seed=0):
    rng = np.random.default_rng(seed)
    truth = C.normal(rng.normal(size=(k, channels)))
    labels = rng.integers(0, k, n)
    x = truth[labels] * rng.choice([-1.0, 1.0], n)[:, None] * rng.uniform(0.5, 2, n)[:, None]
    return truth, labels, x + noise * rng.normal(size=x.shape), rng.uniform(0.5, 2, n)


def frame(spark, x, g=None, more="", values=None):
    values = values or [()] * len(x)
    g = np.ones(len(x)) if g is None else g
    return spark.createDataFrame([(i, v.tolist(), float(w), *m) for i, (v, w, m) in enumerate(zip(x, g, values))], f"id long, map array<double>, g double{more}")


def states(rows, k):
    return np.array([r["map"] for r in sorted((r for r in rows if r["k"] == k), key=lambda r: r["state"])])


def alike(a, b):
    sim = np.abs(a @ b.T)
    return min(sim[i, j] for i, j in assignment(sim))


@pytest.mark.parametrize("method", C.METHODS)
def test_planted_states_and_the_fit_in_memory(spark, method):
    truth, labels, x, g = planted()
    data = frame(spark, x, g).repartition(5)
    fits = C.fitted(data, [], [3, 4, 5, 400, 1], method, restarts=6, gfp="g")
    rows = fits.collect()
    assert {r["k"] for r in rows} == {3, 4, 5} and all(r["n_maps"] == len(x) for r in rows)
    assert alike(states(rows, 4), truth) > 0.98
    found = {r["id"]: r["state"] for r in C.labelled(data, fits.where("k = 4"), [], gfp="g").collect()}
    pairs = dict((b, a) for a, b in assignment(np.abs(truth @ states(rows, 4).T)))
    assert np.mean([pairs[found[i]] == labels[i] for i in range(len(x))]) > 0.98
    # the same in memory
    u, engine = C.normal(x), local.modified_kmeans if method == "koenig" else local.topographic_kmeans
    fits_in_memory = [engine(u, g**2, 4, seed) for seed in range(8)]
    centres, own = min(fits_in_memory, key=lambda f: (g**2 * (1 - np.abs(u @ f[0].T).max(axis=1) ** 2)).sum())
    assert alike(states(rows, 4), centres) > 0.9999
    want = local.fit_measures(u, own, centres, g**2)
    got = {r["k"]: r for r in C.model_comparison(fits, []).collect()}
    for name, value in want.items():
        assert got[4][name] == pytest.approx(value, rel=1e-3, abs=1e-6), name
    assert got[4]["gev"] > got[3]["gev"] + 0.02 and got[4]["silhouette"] > got[3]["silhouette"]
    if method == "spm_vb":
        assert max((3, 4, 5), key=lambda k: got[k]["free_energy"]) == 4 and got[4]["bic"] > got[3]["bic"]


def test_the_driver_or_the_executors_update(spark, monkeypatch):
    truth, _, x, g = planted(n=150, channels=6)
    data = frame(spark, x, g)
    a = C.fitted(data, [], [3], "spm_vb", restarts=2, gfp="g", rounds=6).collect()
    monkeypatch.setattr(C, "FEW", 0)
    monkeypatch.setattr(C, "HELD", 1 << 10)  # sums are passed on all the time
    b = C.fitted(data.repartition(4), [], [3], "spm_vb", restarts=2, gfp="g", rounds=6).collect()
    assert np.allclose(np.abs((states(a, 3) * states(b, 3)).sum(axis=1)), 1, atol=1e-8)
    for name in ("gev", "free_energy", "bic", "covariance"):
        assert a[0][name] == pytest.approx(b[0][name], rel=1e-6)


def test_sets_are_fitted_as_if_alone(spark, request):
    truth, _, x, g = planted(n=330)
    values = [("big" if i < 300 else "small",) for i in range(330)]  # one set has nearly all maps
    data = frame(spark, x, g, ", grp string", values)
    rows = C.fitted(data, ["grp"], [4], restarts=4, gfp="g").collect()
    for name in ("big", "small"):
        alone = C.fitted(data.where(F.col("grp") == name), [], [4], restarts=4, gfp="g").collect()
        assert alike(states([r for r in rows if r["grp"] == name], 4), states(alone, 4)) > 1 - 1e-9
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    blocks = C.in_blocks(data, ["grp"], "id", "map", "g").where("node like '%big%'").select(F.spark_partition_id().alias("p"), "n").collect()
    assert len({r["p"] for r in blocks}) > 1 and sum(r["n"] for r in blocks) == 300  # and is not one task's


def test_edges(spark):
    _, _, x, _ = planted(n=60)
    odd = [(99, None, 1.0), (98, [float("nan")] * 12, 1.0), (97, [None] * 12, 1.0), (96, [1.0] * 12, 0.0), (95, [float("inf")] * 12, 1.0)]
    data = frame(spark, x).unionByName(spark.createDataFrame(odd, "id long, map array<double>, g double"))
    rows = C.fitted(data, [], [3], restarts=2, gfp="g").collect()
    assert rows[0]["n_maps"] == 60 and len(rows) == 3
    assert C.fitted(data.limit(0), [], [3]).count() == 0
    with pytest.raises(ValueError):
        C.fitted(data, [], [3], "none")
    same = spark.createDataFrame([(i, [1.0, -1.0, 0.0]) for i in range(9)], "id long, map array<double>")  # one map, again and again
    got = C.fitted(same, [], [2], restarts=1).collect()
    assert sorted(r["n_state"] for r in got) == [0, 9] and got[0]["gev"] == pytest.approx(1)


def test_features_are_the_components_of_outer_products(spark):
    _, _, x, g = planted(n=300, channels=7, noise=0.4)
    with Rounds(spark) as work:
        blocks = work.written(C.in_blocks(frame(spark, x, g).repartition(3), [], "id", "map", "g"), "blocks")
        rows = C.with_features(work, blocks).collect()
    f = np.concatenate([np.frombuffer(r["f"]).reshape(r["n"], -1) for r in rows])[np.argsort(np.concatenate([r["ids"] for r in rows]))]
    want = local.components(local.projective(C.normal(x)))
    assert f.shape == want.shape and np.allclose(f @ f.T, want @ want.T, atol=1e-4)


def test_free_energy_never_falls():
    rng = np.random.default_rng(1)
    f = np.concatenate([rng.normal(size=(150, 2)) * 0.2 + c for c in ((0, 0), (4, 0), (0, 4))])
    f = (f - f.mean(axis=0)) @ np.linalg.inv(np.linalg.cholesky(np.cov(f.T))).T
    block, best = SimpleNamespace(f=f, n=len(f)), {}
    for k in (1, 2, 3, 5):
        energies = []
        labels = local.repaired(f, np.abs(f[:, None] - f[rng.choice(len(f), k, replace=False)][None]).sum(axis=2).argmin(axis=1), k)
        r = np.full((len(f), k), 0.1 / k)
        r[np.arange(len(f)), labels] += 0.9
        theta = C.Posterior.of(*C.split(k, C.moments(block, r, np.zeros(len(f)))[0][0])[1:])
        for _ in range(40):
            theta, score, _ = C.maximisation(k, theta, C.expectation(block, k, theta))
            energies.append(-score)
        assert all(b >= a - 1e-6 * abs(a) for a, b in zip(energies, energies[1:]))
        best[k] = energies[-1]
        in_memory = local.variational_mixture(f, k, labels, rounds=40, tol=0)
        assert energies[-1] == pytest.approx(in_memory["free_energy"], rel=1e-4)
    assert best[3] > max(best[1], best[2])


def test_hierarchy_files_and_bank(spark):
    truth, _, x, _ = planted(n=360)
    values = [("ab"[i % 2], i % 6, f"f{i % 12}") for i in range(360)] + [("a", 99, "few")] * 2 + [(None, 1, "none")]
    data = frame(spark, np.vstack([x, x[:3]]), None, ", grp string, p int, file string", values).withColumnRenamed("g", "gfp")
    nodes = C.hierarchy(data, 4, [["grp"], ["grp", "p"], ["grp", "p", "file"]], restarts=4).cache()
    rows = nodes.collect()
    assert {(r["level"], r["node"]) for r in rows if r["level"] in ("global", "grp")} == {("global", ""), ("grp", "a"), ("grp", "b")}
    assert {r["node"] for r in rows if r["level"] == "grp|p"} == {f"{'ab'[p % 2]}|{p}" for p in range(6)} | {"a|99"}
    assert sum(r["level"] == "grp|p|file" for r in rows) == 4 * 13
    of = lambda level, node: np.array([r["map"] for r in sorted((r for r in rows if (r["level"], r["node"]) == (level, node)), key=lambda r: r["state"])])
    for r in rows:
        assert abs(np.dot(r["map"], of("global", "")[r["state"]])) > 0.95  # states keep their parents' order
    assert np.allclose(of("grp|p", "a|99"), of("grp", "a"))  # too few maps to fit
    # a node's result is its own fit from the same start
    alone = C.hierarchy(data.where("grp = 'b'"), 4, [], restarts=4).collect()
    assert alike(of("grp", "b"), np.array([r["map"] for r in alone])) > 1 - 1e-5
    banked = C.bank(nodes.where("level = 'grp|p|file' and n_maps > 4"), ["grp", "p", "file"])
    one = banked.where("file = 'f1'").first()
    assert one["gfp"] == pytest.approx((one["n_maps"] / 4) ** 0.5)
    meta = C.fitted(banked, ["grp"], [4], restarts=4, gfp="gfp")
    got = meta.collect()
    assert all(alike(states([r for r in got if r["grp"] == g], 4), truth) > 0.98 for g in "ab")
    assert C.labelled(banked, meta, ["grp"], gfp="gfp").count() == banked.count()


def test_models_are_completed_and_collapsed(spark):
    truth, _, x, _ = planted()
    data = frame(spark, x)
    two = spark.createDataFrame([(i, truth[i].tolist()) for i in range(2)], "state int, map array<double>")
    full = np.array([r["map"] for r in C.completed(data, two, [], 4).orderBy("state").collect()])
    assert alike(full, truth) > 0.9 and np.allclose(full[:2], truth[:2])
    u, best = C.normal(x), np.abs(C.normal(x) @ truth[:2].T).max(axis=1)
    assert np.allclose(full[2], u[best.argmin()])  # the map least like the two
    assert C.completed(data, two, [], 1).count() == 1
    five = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate([truth[0], truth[1], -truth[0] + 0.01, truth[2], truth[3]])], "state int, map array<double>")
    rows = C.collapsed(data, five, []).orderBy("state").collect()
    assert [r["root"] for r in rows] == [0, 1, 3, 4] and alike(np.array([r["map"] for r in rows]), truth) > 0.99


def test_one_set_is_dealt_to_many_tasks(spark, request):
    _, _, x, g = planted()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    blocks = C.in_blocks(frame(spark, x, g).coalesce(1), [], "id", "map", "g").select(F.spark_partition_id().alias("p"), "n").collect()
    assert len({r["p"] for r in blocks}) > 1 and sum(r["n"] for r in blocks) == len(x)


@pytest.mark.parametrize("held", [1, 64 << 20])
def test_a_pass_ends_with_axes_not_gram_matrices(spark, monkeypatch, held):
    truth, _, x, g = planted()
    monkeypatch.setattr(C, "HELD", held)
    u, own = C.normal(x), np.abs(C.normal(x) @ truth.T)
    labels, best = own.argmax(axis=1), own.max(axis=1)
    with Rounds(spark) as work:
        blocks = work.written(C.in_blocks(frame(spark, x, g).repartition(5), [], "id", "map", "g"), "blocks")
        columns, models = ["node", "n", "x", "w", "h"], spark.createDataFrame([("{}", 7, 4, truth.ravel().tolist())], "node string, model int, k int, theta array<double>")
        for given in ({"{}": [(7, 4, truth.ravel())]}, models):
            rows = C.swept(blocks, given, C.nearest(False), columns, 0, C.with_axis).collect()
            assert [(r["model"], r["state"]) for r in sorted(rows, key=lambda r: r["state"])] == [(7, j) for j in range(4)]
            for r in rows:
                at, v = labels == r["state"], np.array(r["v"])
                assert len(v) == 3 + 12 and v[0] == at.sum() and v[2] == pytest.approx((g[at] ** 2).sum())
                assert np.allclose(v[3:], C.principal(u[at].T @ u[at], u[at].sum(axis=0)), atol=1e-9)
                assert r["far"] == pytest.approx(best[at].min()) and np.allclose(r["far_map"], u[at][best[at].argmin()])
