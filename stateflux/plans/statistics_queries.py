"""Queries of test statistics in closed form, and the SQL that gives the same rows; tail probabilities have queries of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from stateflux.functions.special import p_value
from stateflux.operators import statistics as S
from stateflux.operators.regression import residualised
from stateflux.operators.tables import exact_sum
from stateflux.plans.registry import query
from stateflux.sources.tables import sequence, table


def _sides(spark, d):
    side = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(side("F").alias("a"), side("O").alias("b"))


def _ticks(spark, d):
    return sequence(spark, d).select("state", F.cos(F.col("gfp") / 100.0).alias("a"), F.sin(F.col("gfp") / 100.0).alias("b"))


@query("""WITH x AS (SELECT c_mktsegment AS g, c_acctbal AS v FROM customer), r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk, v FROM x), n AS (SELECT count(*) AS n FROM x), t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*) AS c FROM x GROUP BY v)), s AS (SELECT sum(rs * rs / m) AS s, count(*) AS k FROM (SELECT sum(rk) AS rs, count(*) AS m FROM r GROUP BY g))
SELECT round((12.0 / (n * (n + 1.0)) * s - 3 * (n + 1)) / (1 - t / (n * (n * n - 1.0))), 6) AS h, k - 1 AS df, round((12.0 / (n * (n + 1.0)) * s - 3 * (n + 1)) / (1 - t / (n * (n * n - 1.0))) / (n - 1.0), 6) AS epsilon2 FROM n, t, s""")
def t6_kruskal_wallis(spark, d):
    return S.kruskal_wallis(table(spark, d, "customer"), "c_mktsegment", "c_acctbal")


@query("""WITH x AS (SELECT p_type AS g, p_size AS v FROM part), l AS (SELECT g, count(*) AS n FROM x GROUP BY g), p AS (SELECT a.g AS a, b.g AS b, a.n AS n_a, b.n AS n_b FROM l a JOIN l b ON a.g < b.g),
m AS (SELECT a, b, n_a, n_b, x.g, v, rank() OVER w + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY a, b, v) AS c FROM p JOIN x ON x.g IN (a, b) WINDOW w AS (PARTITION BY a, b ORDER BY v)),
s AS (SELECT a, b, n_a, n_b, sum(rk) FILTER (g = a) AS r, sum(c * c - 1) AS t FROM m GROUP BY ALL), z AS (SELECT *, r - n_a * (n_a + 1) / 2.0 AS u, n_a + n_b AS n FROM s)
SELECT a, b, n_a, n_b, u, round(sign(u - n_a * n_b / 2.0) * greatest(abs(u - n_a * n_b / 2.0) - 0.5, 0) / sqrt(n_a * n_b / 12.0 * (n + 1 - t / (n * (n - 1.0)))), 6) AS z FROM z""")
def t6_rank_sums(spark, d):
    return S.rank_sums(table(spark, d, "part").withColumn("v", F.col("p_size").cast("double")), "p_type", "v").select("a", "b", "n_a", "n_b", "u", "z")


@query("""WITH m AS (SELECT l_suppkey AS u, avg(l_quantity) FILTER (l_linestatus = 'F') AS a, avg(l_quantity) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY ALL), s AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, count(a) AS na, count(b) AS nb FROM m)
SELECT round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 4) AS df, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohen_d FROM s""")
def t7_welch(spark, d):
    return S.welch(_sides(spark, d), "a", "b")


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_discount - 0.05), 6) AS mean, round(avg(l_discount - 0.05) / (stddev_samp(l_discount - 0.05) / sqrt(count(*))), 6) AS t, count(*) - 1 AS df, round(avg(l_discount - 0.05) / stddev_samp(l_discount - 0.05), 6) AS cohen_d FROM lineitem GROUP BY 1")
def t7_one_sample(spark, d):
    return S.one_sample(table(spark, d, "lineitem").withColumn("v", F.col("l_discount") - 0.05), ["l_returnflag"], "v")


_RANKS = "rank() OVER (PARTITION BY f ORDER BY {0}) + (count(*) OVER (PARTITION BY f, {0}) - 1) / 2.0 AS r{1}"


@query(f"""WITH x AS (SELECT l_returnflag AS f, l_quantity AS a, l_extendedprice AS b FROM lineitem), r AS (SELECT f, {_RANKS.format("a", 1)}, {_RANKS.format("b", 2)} FROM x) SELECT f AS feature, count(*) AS n, round(corr(r1, r2), 6) AS rho FROM r GROUP BY f""")
def t8_spearman(spark, d):
    x = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "feature")
    return S.spearman(x, ["feature"], "l_quantity", "l_extendedprice")


@query(f"""WITH x AS (SELECT c_mktsegment AS f, c_acctbal AS a, n AS b, c_nationkey AS c, c_custkey % 7 AS e FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey),
r AS (SELECT f, {", ".join(_RANKS.format(c, i) for i, c in enumerate("abce", 1))} FROM x), k AS (SELECT f, count(*) AS n, corr(r1, r2) AS ab, corr(r1, r3) AS ac, corr(r1, r4) AS ae, corr(r2, r3) AS bc, corr(r2, r4) AS be, corr(r3, r4) AS ce FROM r GROUP BY f),
h AS (SELECT f, n, (ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)) AS x, (ae - ac * ce) / sqrt((1 - ac * ac) * (1 - ce * ce)) AS y, (be - bc * ce) / sqrt((1 - bc * bc) * (1 - ce * ce)) AS z FROM k) SELECT f AS feature, n, CASE WHEN n >= 10 THEN round((x - y * z) / sqrt((1 - y * y) * (1 - z * z)), 6) END AS rho FROM h""")
def t8_partial_spearman(spark, d):
    spent = table(spark, d, "orders").groupBy("o_custkey").agg(exact_sum(F.col("o_totalprice")).alias("b"))
    x = table(spark, d, "customer").join(spent, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("feature"), F.col("c_acctbal").alias("a"), "b", F.col("c_nationkey").cast("double").alias("c"), (F.col("c_custkey") % 7).cast("double").alias("e"))
    return S.partial_spearman(x, ["feature"], "a", "b", "c", "e")


@query("""WITH x AS (SELECT l_returnflag AS f, l_extendedprice AS y, l_quantity AS x FROM lineitem), m AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM x) SELECT f, count(*) AS n, round(avg(abs(y - i - s * x)), 3) AS mean_abs, round(stddev_pop(y - i - s * x), 3) AS sd FROM x, m GROUP BY f""")
def a23_residuals(spark, d):
    x = residualised(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return x.groupBy(F.col("l_returnflag").alias("f")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs("residual")), 3).alias("mean_abs"), F.round(F.stddev_pop("residual"), 3).alias("sd"))


@query("""WITH f AS (SELECT l_suppkey AS u, l_returnflag AS feature, avg(l_quantity) AS value FROM lineitem GROUP BY ALL), dm AS (SELECT s_suppkey AS u, unnest(['two', 'many', 'text']) AS variable, unnest([CAST(s_suppkey % 2 AS VARCHAR), CAST(s_nationkey AS VARCHAR), 'Group ' || (s_suppkey % 3)]) AS t FROM supplier),
x AS (SELECT u, feature, variable, value, t, TRY_CAST(t AS DOUBLE) AS x FROM f JOIN dm USING (u)), w AS (SELECT feature, count(*) AS n, count(*) FILTER (x = 0) AS n0, count(*) FILTER (x = 1) AS n1, avg(value) FILTER (x = 0) AS m0, avg(value) FILTER (x = 1) AS m1, var_samp(value) FILTER (x = 0) AS v0, var_samp(value) FILTER (x = 1) AS v1 FROM x WHERE variable = 'two' GROUP BY 1),
r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rb FROM x WHERE variable = 'many'), sp AS (SELECT feature, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY 1),
k AS (SELECT feature, t, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY feature, value) AS c FROM x WHERE variable = 'text'), ks AS (SELECT feature, t, sum(rk) AS rs, count(*) AS m, sum(c * c - 1) AS q FROM k GROUP BY ALL),
kk AS (SELECT feature, sum(m) AS n, count(*) AS g, (12.0 / (sum(m) * (sum(m) + 1)) * sum(rs * rs / m) - 3 * (sum(m) + 1)) / (1 - sum(q) / (1.0 * sum(m) * (sum(m) * sum(m) - 1))) AS h FROM ks GROUP BY 1)
SELECT feature, 'two' AS variable, 'welch_t_test' AS analysis, n, round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 6) AS statistic, round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 6) AS effect_size, round((v0 / n0 + v1 / n1) ** 2 / (v0 * v0 / (n0 * n0 * (n0 - 1)) + v1 * v1 / (n1 * n1 * (n1 - 1))), 4) AS df FROM w WHERE n >= 10
UNION ALL SELECT feature, 'many', 'spearman', n, rho, rho, n - 2 FROM sp WHERE n >= 10 UNION ALL SELECT feature, 'text', 'kruskal_wallis', CAST(n AS BIGINT), round(h, 6), round((h - g + 1) / (n - g), 6), g - 1 FROM kk WHERE n >= 10""")
def t9_demographic_effects(spark, d):
    features = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("u"), F.col("l_returnflag").alias("feature")).agg(F.avg("l_quantity").alias("value"))
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), t.alias("text")) for v, t in (("two", (k % 2).cast("string")), ("many", F.col("s_nationkey").cast("string")), ("text", F.concat(F.lit("Group "), (k % 3).cast("string"))))])
    demographics = s.select(k.alias("u"), F.explode(cells).alias("c")).select("u", "c.*")
    return S.demographic_effects(features, demographics, "u")


@query("""WITH x AS (SELECT event_type AS state, cos(value / 100.0) AS a, sin(value / 100.0) AS b FROM events), m AS (SELECT state, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM x GROUP BY 1)
SELECT state, n, round(n * (ma * ma * vb - 2 * ma * mb * c + mb * mb * va) / (va * vb - c * c), 4) AS t2, round((n - 2.0) / (2.0 * (n - 1)) * n * (ma * ma * vb - 2 * ma * mb * c + mb * mb * va) / (va * vb - c * c), 4) AS f FROM m WHERE n > 3""")
def t10_hotelling(spark, d):
    return S.hotelling(_ticks(spark, d), "a", "b", ["state"])


@query()
def t_tail_probabilities(spark, d):
    """p of the tests above; tests hold the tails against tables."""
    welch, h, hot = S.welch(_sides(spark, d), "a", "b", True), t6_kruskal_wallis(spark, d), t10_hotelling(spark, d)
    rows = welch.select(F.lit("welch").alias("test"), F.col("t").alias("statistic"), "p_value")
    rows = rows.unionByName(h.select(F.lit("kruskal_wallis").alias("test"), F.col("h").alias("statistic"), p_value("chi2", F.col("h"), F.col("df")).alias("p_value")))
    return rows.unionByName(hot.select(F.concat(F.lit("hotelling_"), "state").alias("test"), F.col("f").alias("statistic"), p_value("f", F.col("f"), F.lit(2.0), F.col("n") - 2).alias("p_value")))


@query("SELECT l_linestatus, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1")
def t15_simple_regression(spark, d):
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope(p, q), 4).alias("slope"), F.round(F.regr_intercept(p, q), 4).alias("intercept"))
