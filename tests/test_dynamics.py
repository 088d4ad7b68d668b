"""Axis dynamics as sums of all tasks, held against a record in memory."""

from __future__ import annotations

import math
import time

import numpy as np

from stateflux.operators import sequences as S
from tests import local_dynamics as local


def test_dynamics_are_those_of_records_in_memory(spark):
    rng = np.random.default_rng(5)
    centres = spark.createDataFrame([(k, rng.normal(size=6).tolist()) for k in range(3)], "k int, centre array<double>")
    rows = [(rec, 2 * i, rng.normal(size=6).tolist(), int(k)) for rec in (1, 2) for i, k in enumerate(np.repeat(rng.integers(0, 2 if rec == 2 else 3, 60), 4))]
    x = spark.createDataFrame([*rows, (3, 0, rng.normal(size=6).tolist(), 0)], "rec int, pos int, map array<double>, k int").repartition(5)
    x = x.unionByName(x.where("pos = 0").selectExpr("rec", "-1 as pos", "map", "cast(null as int) as k")).selectExpr("*", "1 as _extra")
    got = {(r["rec"], r["k"]): r.asDict() for r in S.axis_dynamics(x, centres, 50.0).collect()}
    want = {(r["rec"], r["k"]): r.asDict() for r in local.axis_dynamics(x.where("k is not null"), centres, 50.0).collect()}
    assert set(got) == set(want) and len(got) == 9
    turned = {"precession_deg_s", "net_cycles_s", "positive_fraction", "negative_fraction"}  # their sign is that of the components
    for key, w in want.items():
        g = got[key]
        assert g["n_samples"] == w["n_samples"] + 1 and g["n_active"] == w["n_active"] and g["n_runs"] == w["n_runs"]
        for name in set(w) - turned - {"rec", "k", "n_samples", "active_fraction"}:
            a, b = (math.nan if v is None else v for v in (g[name], w[name]))
            assert np.isclose(a, b, rtol=1e-6, atol=1e-7, equal_nan=True), (key, name, a, b)
        if w["net_cycles_s"] is not None and g["net_cycles_s"] is not None:
            assert np.isclose(abs(g["net_cycles_s"]), abs(w["net_cycles_s"]), atol=1e-7, equal_nan=True)
    assert S.axis_dynamics(x.limit(0), centres, 50.0).count() == 0


def test_planes_of_many_small_groups_take_one_batch_an_arrow_batch(spark):
    rows = spark.range(0, 40_000, numPartitions=2).selectExpr("int(id / 4) AS rec", "int(id / 4) % 3 AS k", "array(1d, 0d, 0d) AS axis", "array(sin(id), cos(3 * id), sin(id * id)) AS v")
    began = time.time()
    got = {r["rec"]: r["v_pc"] for r in S.principal_planes(rows, ["rec", "k"], ["v"], "axis").collect()}
    assert time.time() - began < 20 and len(got) == 10_000
    for rec in (0, 777, 9_999):
        i = np.arange(4 * rec, 4 * rec + 4, dtype=float)
        x = np.stack((np.sin(i), np.cos(3 * i), np.sin(i * i)), axis=1)
        s = np.linalg.svd(x - x.mean(axis=0))[1] ** 2
        assert np.allclose([got[rec]["first"], got[rec]["second"]], 100 * s[:2] / s.sum())
