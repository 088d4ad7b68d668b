"""Queries of beats and of annotations in sampled channels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stateflux.operators import beats
from stateflux.operators import sequences as S
from stateflux.plans.registry import query
from stateflux.plans.sequence_queries import EV
from stateflux.sources.tables import sequence

#: Events in order of time, a record for each user, as samples at one a second.
SAMPLES = f"{EV}, s AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY us, seq) - 1 AS pos, gfp AS x FROM ev)"
BEATS = f"""WITH {SAMPLES},
q AS (SELECT rec, pos, x - greatest(min(x) OVER l, min(x) OVER r) AS up, least(max(x) OVER l, max(x) OVER r) - x AS down FROM s
 WINDOW l AS (PARTITION BY rec ORDER BY pos RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), r AS (PARTITION BY rec ORDER BY pos RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING)),
c AS (SELECT *, coalesce(max(up) OVER b, 0) AS ub, coalesce(max(up) OVER a, 0) AS ua, coalesce(max(down) OVER b, 0) AS db, coalesce(max(down) OVER a, 0) AS da FROM q
 WINDOW b AS (PARTITION BY rec ORDER BY pos RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY rec ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
p AS (SELECT rec, pos, 1 AS sign, up AS height FROM c WHERE up > ub AND up >= ua UNION ALL SELECT rec, pos, -1, down FROM c WHERE down > db AND down >= da),
t AS (SELECT rec, sign, pos // 20 AS slot, max(height) AS top FROM p GROUP BY ALL),
g AS (SELECT rec, arg_max(sign, (m, sign)) AS sign FROM (SELECT rec, sign, quantile_disc(top, 0.5) AS m FROM t GROUP BY ALL) GROUP BY rec),
v AS (SELECT a.rec, a.sign, a.slot, quantile_disc(b.top, 0.5) AS level FROM t a JOIN t b ON a.rec = b.rec AND a.sign = b.sign AND abs(a.slot - b.slot) <= 5 GROUP BY ALL),
beats AS (SELECT p.rec, p.pos, p.height, p.sign FROM p JOIN g ON p.rec = g.rec AND p.sign = g.sign JOIN v ON p.rec = v.rec AND p.sign = v.sign AND p.pos // 20 = v.slot WHERE height >= 0.5 * level)
"""


def _samples(spark, d):
    return sequence(spark, d).select("rec", (F.row_number().over(S._over("rec")) - 1).alias("pos"), F.col("gfp").alias("x"))


def _beats(spark, d):
    return beats.detected_beats(_samples(spark, d), 1.0, width_s=2.0, refractory_s=3.0, slot_s=20.0)


@query(BEATS + "SELECT rec, pos, height, sign FROM beats")
def s17_detected_beats(spark, d):
    return _beats(spark, d)


@query(BEATS + ", i AS (SELECT rec, pos - lag(pos) OVER (PARTITION BY rec ORDER BY pos) AS gap FROM beats) SELECT rec, count(*) AS n, round(median(gap), 6) AS median_s FROM i GROUP BY rec HAVING count(*) >= 5 AND median(gap) BETWEEN 4 AND 9")
def s17_detected_trains(spark, d):
    at = _beats(spark, d).withColumn("us", F.col("pos") * 1_000_000)
    return S.plausible_trains(at, 4.0, 9.0).withColumn("median_s", F.round("median_s", 6))


@query(f"""WITH {SAMPLES}, k AS (SELECT rec, pos, CAST(floor(x) AS BIGINT) % 5 AS code FROM s), l AS (SELECT *, lag(code) OVER (PARTITION BY rec ORDER BY pos) AS old FROM k),
h AS (SELECT *, lead(pos) OVER (PARTITION BY rec ORDER BY pos) AS nxt FROM l WHERE code <> old)
SELECT rec, pos, pos / 4.0 AS onset_s, (nxt - pos) / 4.0 AS duration_s, CAST(code AS VARCHAR) AS description FROM h WHERE code > old AND code NOT IN (0, 3)""")
def s14_code_annotations(spark, d):
    rows = _samples(spark, d).withColumn("code", F.floor("x") % 5)
    return beats.code_annotations(rows, 4.0, ignored=(3,))
