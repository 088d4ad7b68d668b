"""Queries on result tables: joins with checks, paired designs, selection of the number of states, flags and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from stateflux.functions import text as X
from stateflux.operators import tables as T
from stateflux.plans.registry import query
from stateflux.sources.tables import table


@query("""WITH m AS (SELECT s_nationkey AS k, s_name, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier WHERE s_nationkey < 20)
SELECT c_custkey, coalesce(s_name, 'nation' || c_nationkey) AS matched, coalesce(s_acctbal, 0) AS balance, s_name IS NOT NULL AS found FROM customer LEFT JOIN (SELECT * FROM m WHERE r = 1) ON k = c_nationkey""")
def j1_first_match(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    manifest = table(spark, d, "supplier").where("s_nationkey < 20").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("matched"), F.col("s_acctbal").alias("balance"), "s_suppkey")
    out = T.first_match(rows, manifest, ["k"], [F.col("s_suppkey")], {"matched": F.concat(F.lit("nation"), F.col("k").cast("string")), "balance": F.lit(0.0)})
    return out.select("c_custkey", "matched", "balance", "found")


@query("""WITH a AS (SELECT l_suppkey AS s, CAST(year(l_shipdate) AS INTEGER) AS y, l_returnflag AS f, l_linenumber AS n, count(*) AS hits, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), b AS (SELECT l_suppkey AS s, CAST(year(l_shipdate) AS INTEGER) AS y, l_returnflag AS f, l_linenumber AS n, round(avg(l_discount), 6) AS coverage FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT s, y, f, n, hits, q, coverage FROM a JOIN b USING (s, y, f, n)""")
def j2_four_key_join(spark, d):
    keys = [F.col("l_suppkey").alias("s"), F.year("l_shipdate").alias("y"), F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("n")]
    x = table(spark, d, "lineitem").select(*keys, "l_linestatus", "l_quantity", "l_discount")
    a = x.where("l_linestatus = 'F'").groupBy("s", "y", "f", "n").agg(F.count(F.lit(1)).alias("hits"), F.sum("l_quantity").alias("q"))
    b = x.where("l_linestatus = 'O'").groupBy("s", "y", "f", "n").agg(F.round(F.avg("l_discount"), 6).alias("coverage"))
    return a.join(b, ["s", "y", "f", "n"])


@query("""WITH g AS (SELECT l_suppkey AS k, CAST(year(l_shipdate) AS INTEGER) AS y, l_returnflag AS f, l_linestatus AS s, round(avg(l_extendedprice), 6) AS v FROM lineitem GROUP BY ALL), p AS (SELECT k, y, f, max(v) FILTER (s = 'F') AS a, max(v) FILTER (s = 'O') AS b FROM g GROUP BY ALL)
SELECT k, y, f, round(a + 1e-7, 4) AS a, round(b + 1e-7, 4) AS b, round(b - a + 1e-7, 4) AS diff FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def j3_paired_methods(spark, d):
    keys = ["k", "y", "f"]
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("y"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), "l_extendedprice")
    means = x.groupBy(*keys, "s").agg(F.round(F.avg("l_extendedprice"), 6).alias("v"))
    out = T.paired(means, keys, "s", "F", "O", "v", complete=False)
    return out.select(*keys, *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("a", "b", "diff")])  # halves go up in both engines


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'C' || (o_custkey // 10) ELSE 'id' || o_custkey END AS participant FROM orders""")
def j5_alias_resolution(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit(" id"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("participant"))
    c = table(spark, d, "customer").where("c_custkey % 10 = 0")
    aliases = c.select(F.concat(F.lit("id"), F.col("c_custkey").cast("string")).alias("alias"), F.concat(F.lit("C"), F.floor(F.col("c_custkey") / 10).cast("string")).alias("canonical"))
    return T.resolved(rows, "participant", aliases.union(aliases))


@query("""WITH x AS (SELECT l_linestatus || (l_suppkey % 13) AS m, l_returnflag AS c FROM lineitem WHERE NOT (l_suppkey % 13 = 5 AND l_returnflag = 'R') AND NOT (l_linestatus = 'O' AND l_suppkey % 13 = 7 AND l_returnflag <> 'N')),
f AS (SELECT m FROM x GROUP BY m HAVING count(DISTINCT c) = (SELECT count(DISTINCT c) FROM x)), s AS (SELECT c FROM x GROUP BY c HAVING count(DISTINCT m) = (SELECT count(DISTINCT m) FROM x))
SELECT m, c, count(*) AS n, m IN (SELECT m FROM f) AS full_support, c IN (SELECT c FROM s) AS shared FROM x GROUP BY m, c""")
def j13_support_filters(spark, d):
    x = table(spark, d, "lineitem").select(F.concat("l_linestatus", (F.col("l_suppkey") % 13).cast("string")).alias("m"), F.col("l_returnflag").alias("c"), "l_linestatus", (F.col("l_suppkey") % 13).alias("r"))
    x = x.where(~((F.col("r") == 5) & (F.col("c") == "R")) & ~((F.col("l_linestatus") == "O") & (F.col("r") == 7) & (F.col("c") != "N"))).select("m", "c")
    counts = x.groupBy("m", "c").agg(F.count(F.lit(1)).alias("n"))
    full, shared = (T.having_all(counts, a, b).select(a).distinct().withColumn(name, F.lit(True)) for a, b, name in (("m", "c", "full_support"), ("c", "m", "shared")))
    out = counts.join(full, "m", "left").join(shared, "c", "left")
    return out.select("m", "c", "n", F.coalesce("full_support", F.lit(False)).alias("full_support"), F.coalesce("shared", F.lit(False)).alias("shared"))


@query("""WITH x AS (SELECT DISTINCT o_custkey AS u, o_orderstatus AS c FROM orders), n AS (SELECT u FROM x GROUP BY u HAVING count(DISTINCT c) >= 2), t AS (SELECT count(DISTINCT u) * count(DISTINCT c) AS cells, count(*) AS present FROM x)
SELECT u, c, cells, present, cells = present AS complete FROM x, t WHERE u IN (SELECT u FROM n)""")
def j14_units_with_two_conditions(spark, d):
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("u"), F.col("o_orderstatus").alias("c")).distinct()
    return T.having_some(x, "u", "c", 2).crossJoin(F.broadcast(T.all_cells(x, "u", "c"))).select("u", "c", "cells", "present", "complete")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def j16_exact_positions(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return lines.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_partkey IS NOT NULL)")
def o3_difference(spark, d):
    often = table(spark, d, "lineitem").where("l_quantity > 49")
    return table(spark, d, "part").join(often, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("""WITH u AS (SELECT 0 AS t, p_partkey AS o, p_type AS l FROM part WHERE p_partkey > 3 UNION ALL SELECT 1, c_custkey, c_mktsegment FROM customer UNION ALL SELECT 2, p_partkey, p_name FROM part), f AS (SELECT l, min((t, o)) AS f FROM u GROUP BY l)
SELECT l AS label, CAST(row_number() OVER (ORDER BY f, l) AS INTEGER) AS place FROM f""")
def o4_label_order(spark, d):
    part, customer = table(spark, d, "part"), table(spark, d, "customer")
    frames = [part.where("p_partkey > 3").select(F.col("p_partkey").alias("o"), F.col("p_type").alias("label")), customer.select(F.col("c_custkey").alias("o"), F.col("c_mktsegment").alias("label")), part.select(F.col("p_partkey").alias("o"), F.col("p_name").alias("label"))]
    return T.label_order(frames, "label", "o")


@query("""WITH x AS (SELECT o_custkey, count(*) AS n_beats, count(*) FILTER (o_orderstatus = 'F') AS n_hits, count(*) FILTER (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') AS taps, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS m, stddev_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS s FROM orders GROUP BY 1)
SELECT o_custkey, n_beats, n_hits, n_beats - n_hits AS n_misses, round(m, 4) AS mean_latency, round(s, 4) AS sd_latency, round(n_hits / n_beats, 6) AS hit_rate, round((n_beats - n_hits) / n_beats, 6) AS miss_rate, taps - n_hits AS extra_taps, round((taps - n_hits) / n_beats, 6) AS extra_taps_per_beat FROM x""")
def g12_hit_rates(spark, d):
    hit = F.col("o_orderstatus") == "F"
    tap = F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2")
    beats = table(spark, d, "orders").select("o_custkey", hit.alias("hit"), F.when(hit, F.col("o_totalprice")).alias("latency"), tap.alias("tap"))
    return T.hit_summary(beats, ["o_custkey"])


@query("SELECT o_custkey, count(*) AS n, round(var_samp(o_totalprice) / 1e6, 6) AS variance, round(1e9 / var_samp(o_totalprice), 6) AS inverse_variance, round(-ln(var_samp(o_totalprice)), 6) AS log_inverse FROM orders GROUP BY o_custkey HAVING count(*) >= 3 AND var_samp(o_totalprice) > 0")
def g30_latency_consistency(spark, d):
    v = T.consistency(table(spark, d, "orders"), ["o_custkey"], "o_totalprice")
    return v.select("o_custkey", "n", F.round(F.col("variance") / 1e6, 6).alias("variance"), F.round(F.col("inverse_variance") * 1e9, 6).alias("inverse_variance"), F.round("log_inverse", 6).alias("log_inverse"))


@query("""WITH x AS (SELECT l_suppkey % 5 AS b, CAST(l_linenumber AS INTEGER) AS t, CAST(l_quantity AS INTEGER) % 7 + 1 AS p FROM lineitem), l AS (SELECT t AS l FROM x UNION SELECT p FROM x), c AS (SELECT b, t, p, count(*) AS n FROM x GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY b, t) AS rate FROM c), m AS (SELECT t, p, sum(rate) AS s FROM r GROUP BY ALL), n AS (SELECT count(DISTINCT b) AS n FROM x)
SELECT a.l AS t, e.l AS p, round(coalesce(s / n.n, 0), 6) AS mean_rate FROM l a CROSS JOIN l e CROSS JOIN n LEFT JOIN m ON m.t = a.l AND m.p = e.l""")
def g16_mean_confusion(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("b"), F.col("l_linenumber").cast("int").alias("t"), (F.col("l_quantity").cast("int") % 7 + 1).alias("p"))
    return T.mean_confusion(x, "b", "t", "p").withColumn("mean_rate", F.round("mean_rate", 6))


@query("""WITH s AS (SELECT CAST(l_orderkey % 5 AS INTEGER) AS fold, sum(l_discount) AS s, count(*) AS n FROM lineitem GROUP BY 1)
SELECT fold, round((sum(s) OVER () - s) / (sum(n) OVER () - n), 6) AS train_mean, round(s / n, 6) AS test_mean, round(abs(s / n - (sum(s) OVER () - s) / (sum(n) OVER () - n)), 6) AS error FROM s""")
def g27_fold_errors(spark, d):
    out = T.fold_errors(table(spark, d, "lineitem"), (F.col("l_orderkey") % 5).cast("int"), "l_discount")
    return out.select("fold", *[F.round(c, 6).alias(c) for c in ("train_mean", "test_mean", "error")])


@query("""SELECT count(*) FILTER (c) AS n_correct, count(*) FILTER (NOT c) AS n_incorrect, round(avg(v) FILTER (c), 6) AS mean_correct, round(avg(v) FILTER (NOT c), 6) AS mean_incorrect, round(avg(v) FILTER (c) - avg(v) FILTER (NOT c), 6) AS mean_difference FROM (SELECT l_tax AS v, CAST(l_quantity AS INTEGER) % 7 + 1 = l_linenumber AS c FROM lineitem)""")
def g32_correct_groups(spark, d):
    x = table(spark, d, "lineitem")
    out = T.grouped_difference(x, "l_tax", F.col("l_quantity").cast("int") % 7 + 1 == F.col("l_linenumber"))
    return out.select("n_correct", "n_incorrect", *[F.round(c, 6).alias(c) for c in ("mean_correct", "mean_incorrect", "mean_difference")])


# -- selection of the number of states


METRICS = ["gev", "calinski_harabasz", "silhouette", "free_energy", "log_likelihood", "bic", "icl", "covariance"]
CURVES = """c0 AS (SELECT l_returnflag || (l_suppkey % 4) AS fit, l_linenumber AS k, avg(l_discount) AS a, avg(l_quantity) AS q, avg(l_tax) AS t FROM lineitem GROUP BY ALL), c AS (SELECT fit, k, round(a * k, 6) AS gev, round(q, 6) AS calinski_harabasz, round(t * 10, 6) AS silhouette, round(ln(k) * 100 + q, 6) AS free_energy,
 round(q * 3, 6) AS log_likelihood, round(q - k, 6) AS bic, round(q - 2 * k, 6) AS icl, round(5.0 / k + t, 6) AS covariance FROM c0)"""
_MM = "coalesce(CASE WHEN max({0}) OVER w - min({0}) OVER w > 2.220446049250313e-16 THEN ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END, 0)"


def _chord(source: str, y: str, name: str, keep: str) -> str:
    """Two steps of SQL: both axes scaled, then the distance from the line through the ends."""
    return f"""{name}0 AS (SELECT *, {_MM.format("k")} AS sx, {_MM.format(y)} AS sy FROM {source} WINDOW w AS (PARTITION BY fit)),
{name}1 AS (SELECT *, first_value(sx) OVER o AS x0, last_value(sx) OVER o AS x1, first_value(sy) OVER o AS y0, last_value(sy) OVER o AS y1 FROM {name}0 WINDOW o AS (PARTITION BY fit ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT {keep}, CASE WHEN k <> min(k) OVER w AND k <> max(k) OVER w THEN abs((y1 - y0) * sx - (x1 - x0) * sy + x1 * y0 - y1 * x0) / sqrt((y1 - y0) ** 2 + (x1 - x0) ** 2 + 2.220446049250313e-16) ELSE 0 END AS {name} FROM {name}1 WINDOW w AS (PARTITION BY fit))"""


_KEEP = "fit, k, " + ", ".join(METRICS)
SCORES = f"""{CURVES}, t AS (SELECT *, max(covariance) OVER (PARTITION BY fit) - covariance AS tight FROM c), {_chord("t", "free_energy", "fe", _KEEP + ", tight")}, {_chord("fe", "tight", "ce", _KEEP + ", tight, fe")},
e AS (SELECT *, first_value(k) OVER (PARTITION BY fit ORDER BY fe DESC, k) AS bend FROM ce),
sc AS (SELECT *, gev AS score_gev, calinski_harabasz AS score_calinski_harabasz, CASE WHEN count(*) OVER w <= 4 OR (k <> min(k) OVER w AND k <> max(k) OVER w) THEN silhouette END AS score_silhouette, free_energy AS score_free_energy, log_likelihood AS score_log_likelihood, bic AS score_bic, icl AS score_icl,
 CASE WHEN max(fe) OVER w <= 2.220446049250313e-16 THEN free_energy ELSE fe END AS score_free_energy_elbow, 0.6 * exp(-abs(k - bend)) + 0.4 * (silhouette + 1) / 2 AS score_elbow_sil_combined, tight AS score_covariance, CASE WHEN max(ce) OVER w <= 2.220446049250313e-16 THEN tight ELSE ce END AS score_covariance_elbow,
 0.45 * {_MM.format("fe")} + 0.35 * {_MM.format("ce")} + 0.15 * {_MM.format("tight")} + 0.05 * {_MM.format("free_energy")} AS score_free_energy_covariance FROM e WINDOW w AS (PARTITION BY fit))"""


def _curves(spark, d):
    x = table(spark, d, "lineitem").select(F.concat("l_returnflag", (F.col("l_suppkey") % 4).cast("string")).alias("fit"), F.col("l_linenumber").alias("k"), "l_discount", "l_quantity", "l_tax")
    k, q = F.col("k"), F.avg("l_quantity")
    r = lambda c, name: F.round(c, 6).alias(name)
    return x.groupBy("fit", "k").agg(r(F.avg("l_discount") * k, "gev"), r(q, "calinski_harabasz"), r(F.avg("l_tax") * 10, "silhouette"), r(F.ln("k") * 100 + q, "free_energy"), r(q * 3, "log_likelihood"), r(q - k, "bic"), r(q - 2 * k, "icl"), r(5.0 / k + F.avg("l_tax"), "covariance"))


@query(f"""WITH {CURVES}, {_chord("c", "free_energy", "elbow", "fit, k, free_energy")} SELECT fit, k, round(elbow, 6) AS elbow, round(lag(free_energy) OVER w - 2 * free_energy + lead(free_energy) OVER w, 5) AS curvature FROM elbow WINDOW w AS (PARTITION BY fit ORDER BY k)""")
def w11_elbow(spark, d):
    out = T.curvature(T.elbow(_curves(spark, d), ["fit"], "k", "free_energy"), ["fit"], "k", "free_energy")
    return out.select("fit", "k", F.round("elbow", 6).alias("elbow"), F.round("curvature", 5).alias("curvature"))


@query(f"""WITH {SCORES}, u AS (""" + " UNION ALL ".join(f"SELECT fit, k, '{c}' AS criterion, CAST(score_{c} AS DOUBLE) AS score FROM sc" for c in T.CRITERIA) + """), r AS (SELECT *, row_number() OVER (PARTITION BY fit, criterion ORDER BY round(score, 9) DESC, k) AS r FROM u WHERE score IS NOT NULL)
SELECT fit, k, criterion, round(score, 6) AS score FROM r WHERE r = 1""")
def w12_select_k(spark, d):
    return T.chosen(_curves(spark, d), ["fit"], "k").withColumn("score", F.round("score", 6))


@query(f"WITH {SCORES} SELECT fit, k, " + ", ".join(f"round({_MM.format(m)}, 6) AS {m}_norm" for m in METRICS) + ", " + ", ".join(f"round(score_{c}, 6) AS score_{c}, score_{c} IS NOT NULL AND row_number() OVER (PARTITION BY fit ORDER BY round(score_{c}, 9) DESC NULLS LAST, k) = 1 AS selected_by_{c}" for c in T.CRITERIA) + " FROM sc WINDOW w AS (PARTITION BY fit)")
def w13_candidates(spark, d):
    out = T.candidate_rows(_curves(spark, d), ["fit"], "k", METRICS)
    return out.select("fit", "k", *[F.round(f"{m}_norm", 6).alias(f"{m}_norm") for m in METRICS], *[c for n in T.CRITERIA for c in (F.round(f"score_{n}", 6).alias(f"score_{n}"), F.col(f"selected_by_{n}"))])


@query(f"WITH {CURVES} SELECT fit, k, gev, free_energy FROM c WHERE k = 4")
def m8_solution_for_k(spark, d):
    from stateflux.operators.fits import solution

    return solution(_curves(spark, d), ["fit"], 4).select("fit", "k", "gev", "free_energy")


# -- flags and samples


@query("""WITH x AS (SELECT p_partkey, (p_partkey % 21 - 10) / 10.0 AS est, (p_partkey % 5 + 1) / 5.0 AS sd, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_partkey % 10) / 100.0 END AS q FROM part), y AS (SELECT *, round(est - 1.96 * sd, 6) AS low, round(est + 1.96 * sd, 6) AS high FROM x)
SELECT p_partkey, low, high, low > 0 OR high < 0 AS away_from_zero, coalesce(q < 0.05, false) AS fdr_found, (low > 0 OR high < 0) AND coalesce(q < 0.05, false) AS both FROM y""")
def w17_deviation_flags(spark, d):
    k = F.col("p_partkey")
    est, sd = (k % 21 - 10) / 10.0, (k % 5 + 1) / 5.0
    x = table(spark, d, "part").select("p_partkey", F.round(est - 1.96 * sd, 6).alias("low"), F.round(est + 1.96 * sd, 6).alias("high"), F.when(k % 11 != 0, (k % 10) / 100.0).alias("q"))
    return T.deviation_flags(x, "low", "high", "q").drop("q")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def w20_top_rows(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('7|' || o_orderkey), o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey FROM x WHERE r <= 3")
def w21_seeded_sample(spark, d):
    return T.seeded_sample(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], 3, 7).select("o_custkey", "o_orderkey")
