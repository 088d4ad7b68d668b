"""Beats planted in noise, drift and gaps; annotations of a code channel; blocks of any length decide alike."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from stateflux.operators import beats

RATE = 250.0


def cardiac(seed: int, noise: float, seconds: int = 120, flip: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A channel with sharp beats, broad waves after them and drift, and the positions of the beats."""
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * RATE))
    at = np.cumsum(rng.normal(0.85, 0.05, int(seconds / 0.85) - 2) * RATE).astype(int)
    tall = 1 + 0.3 * np.sin(at / 4000)
    bump = lambda shift, width, size: sum(s * size * np.exp(-(((t - a - shift) / width) ** 2)) for a, s in zip(at, tall))
    x = bump(0, 3, 1.0) + bump(-8, 3, -0.15) + bump(8, 3, -0.25) + bump(70, 20, 0.3) + 2 * np.sin(t / 900) + noise * rng.normal(size=len(t))
    return (-x if flip else x), at


@pytest.mark.parametrize(("noise", "flip", "least"), [(0.0, False, 1.0), (0.03, True, 1.0), (0.08, False, 0.98)])
def test_planted_beats_are_found(spark, noise, flip, least):
    x, at = cardiac(3, noise, flip=flip)
    rows = spark.createDataFrame(pd.DataFrame({"rec": "a", "pos": np.arange(len(x)), "x": x}))
    got = np.array(sorted(r["pos"] for r in beats.detected_beats(rows, RATE).collect()))
    hits = sum(np.abs(got - a).min() <= 4 for a in at)
    false = sum(np.abs(at - g).min() > 4 for g in got)
    assert hits >= least * len(at) and false <= (1 - least) * len(at) + 1
    assert {r["sign"] for r in beats.detected_beats(rows, RATE).collect()} == {-1 if flip else 1}


def test_blocks_do_not_matter(spark):
    parts = []
    for i, rec in enumerate(("a", "b", None)):
        x, _ = cardiac(i, 0.05, 30)
        part = pd.DataFrame({"rec": rec, "pos": np.arange(len(x)) + 17 * i, "x": x})
        parts.append(part[(part["pos"] < 2000) | (part["pos"] > 2300)])
    rows = spark.createDataFrame(pd.concat(parts), "rec string, pos long, x double")
    rows = rows.unionByName(rows.limit(50)).selectExpr("*", "'x' as sign", "1 as _extra")
    found = [sorted(map(str, beats.detected_beats(rows, RATE, block=b).collect())) for b in (1, 1 << 20)]
    assert found[0] == found[1] and len(found[0]) > 60
    # by definition, on one record
    one = rows.where("rec = 'a'").select("pos", "x").distinct().toPandas().set_index("pos")["x"].sort_index()
    kept = [r["pos"] for r in beats.detected_beats(rows.where("rec = 'a'"), RATE).collect()]

    def height(p: int) -> float:
        return one[p] - max(one.loc[p - 25 : p].min(), one.loc[p : p + 25].min())

    assert all(height(p) == max(height(q) for q in one.loc[p - 75 : p + 75].index) for p in kept[:5])


def test_channels_without_beats(spark):
    schema = "rec string, pos long, x double"
    flat = spark.createDataFrame([("a", i, 1.0) for i in range(500)] + [("b", i, None) for i in range(5)] + [("c", 1, float("nan"))], schema)
    assert beats.detected_beats(flat, RATE).count() == 0
    assert beats.detected_beats(spark.createDataFrame([], schema), RATE).count() == 0


def test_code_annotations(spark):
    code = [5, 5, 0, 0, 1, 1, 3, 2, 2, 0, None, 65536, 65536, 7, 0, 4]
    rows = [("a", i, c) for i, c in enumerate(code)] + [("b", 0, 0), ("b", 2, 9), ("b", 3, 9)]
    docs = spark.createDataFrame(rows, "rec string, pos long, code long")
    for block in (1, 3, 1 << 16):
        got = sorted(map(tuple, beats.code_annotations(docs, 2.0, block=block).collect()))
        # 5 begins the record, 2 falls, 7 follows a greater ignored code, b's 9 comes after a gap
        assert got == [("a", 4, 2.0, 1.0, "1"), ("a", 6, 3.0, 0.5, "3"), ("a", 15, 7.5, None, "4")], block
    assert beats.code_annotations(docs.limit(0), 2.0).count() == 0
