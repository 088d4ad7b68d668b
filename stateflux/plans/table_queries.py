"""Queries on result tables, vectors and labels, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stateflux.functions import text as X
from stateflux.operators import arrays as A
from stateflux.operators import tables as T
from stateflux.plans.registry import query
from stateflux.sources.tables import maps, sequence, table

MAPS = "mp AS (SELECT vec_id AS id, label AS grp, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS map FROM embeddings)"
CEN = MAPS.replace("mp AS", "cn AS").replace("FROM embeddings", "FROM embeddings WHERE vec_id < 7")
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"
SCORES = f"{MAPS}, {CEN}, sc AS (SELECT m.id, m.grp, m.map, c.id AS k, {DOT.format('m.map', 'c.map')} AS corr FROM mp m, cn c), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(abs(corr), 12) DESC, k) AS r FROM sc), asg AS (SELECT * FROM rk WHERE r = 1)"


def _line(spark, d):
    return table(spark, d, "lineitem")


def _centres(spark, d):
    return maps(spark, d).where("id < 7").select(F.col("id").alias("k"), F.col("map").alias("centre"))


# -- parsing


@query("""SELECT page_id, coalesce(nullif(regexp_extract(url, '(sub-[A-Za-z0-9]+)', 1), ''), nullif(regexp_extract(url, '([^/]+)/[^/]+$', 1), ''), printf('row%03d', page_id)) AS participant,
 trim(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '_') AS ident, CASE WHEN regexp_matches(url, '/(en|fr)/') THEN 'EO' WHEN regexp_matches(url, '/(de|es)/') THEN 'EC' ELSE 'other' END AS condition FROM pages""")
def p1_path_identifiers(spark, d):
    condition = F.when(F.col("url").rlike("/(en|fr)/"), "EO").when(F.col("url").rlike("/(de|es)/"), "EC").otherwise("other")
    return table(spark, d, "pages").select("page_id", X.participant(F.col("url"), F.col("page_id")).alias("participant"), X.identifier(F.col("url")).alias("ident"), condition.alias("condition"))


# -- scaling, ranks, adjustment


@query("""WITH x AS (SELECT c_custkey, c_mktsegment, c_acctbal AS v, avg(c_acctbal) OVER w AS m, stddev_pop(c_acctbal) OVER w AS s, min(c_acctbal) OVER w AS lo, max(c_acctbal) OVER w AS hi FROM customer WINDOW w AS (PARTITION BY c_mktsegment))
SELECT c_custkey, round(CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END, 6) AS z, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS unit FROM x""")
def p17_standardise(spark, d):
    return T.standardised(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal").select("c_custkey", F.round("z", 6).alias("z"), F.round("unit", 6).alias("unit"))


@query("SELECT c_custkey, rank() OVER w + (count(*) OVER (PARTITION BY c_mktsegment, round(c_acctbal, -3)) - 1) / 2.0 AS avg_rank FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY round(c_acctbal, -3))")
def w10_average_ranks(spark, d):
    c = table(spark, d, "customer").withColumn("v", F.round("c_acctbal", -3))
    return T.average_ranks(c, ["c_mktsegment"], "v").select("c_custkey", "avg_rank")


PV = "p AS (SELECT p_partkey AS id, p_brand AS g, (hash_ % 997 + 1) / 1000.0 * ((p_partkey % 13) + 1) / 14.0 AS p FROM (SELECT *, p_partkey * 7919 AS hash_ FROM part))"


def _pvalues(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), F.col("p_brand").alias("g"), ((k * 7919 % 997 + 1) / 1000.0 * (k % 13 + 1) / 14.0).alias("p"))


@query(f"""WITH {PV}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, id) AS r, count(*) OVER (PARTITION BY g) AS n FROM p), q AS (SELECT *, p * n / r AS raw FROM r)
SELECT id, g, round(least(min(raw) OVER (PARTITION BY g ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) AS q FROM q""")
def w6_benjamini_hochberg(spark, d):
    return T.benjamini_hochberg(_pvalues(spark, d), ["g"], "p", "id").select("id", "g", F.round("q", 6).alias("q"))


@query(f"""WITH {PV}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, id) AS r, count(*) OVER (PARTITION BY g) AS n FROM p)
SELECT id, g, round(least(max((n - r + 1) * p) OVER (PARTITION BY g ORDER BY r ROWS UNBOUNDED PRECEDING), 1.0), 6) AS p_holm FROM r""")
def w7_holm(spark, d):
    return T.holm(_pvalues(spark, d), ["g"], "p", "id").select("id", "g", F.round("p_holm", 6).alias("p_holm"))


@query("SELECT c_custkey, CAST(ceil(5.0 * row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) / count(*) OVER (PARTITION BY c_mktsegment)) AS INTEGER) AS grp FROM customer")
def w8_quintiles(spark, d):
    return T.quantile_groups(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", "c_custkey").select("c_custkey", "grp")


@query("SELECT * EXCLUDE r FROM (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def w18_first_rows(spark, d):
    return T.first_row(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


# -- joins


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j4_intersection(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""WITH a AS (SELECT c_mktsegment AS s, c_nationkey AS n, round(avg(c_acctbal), 6) AS v FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL), b AS (SELECT c_mktsegment AS s, round(avg(c_acctbal), 6) AS v FROM customer WHERE c_mktsegment < 'F' GROUP BY ALL), g AS (SELECT round(avg(c_acctbal), 6) AS v FROM customer)
SELECT c_custkey, coalesce(a.v, b.v, g.v) AS v, CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 ELSE 2 END AS level FROM customer c LEFT JOIN a ON a.s = c.c_mktsegment AND a.n = c.c_nationkey LEFT JOIN b ON b.s = c.c_mktsegment, g""")
def j7_fallback_lookup(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("s"), F.col("c_nationkey").alias("n"), "c_acctbal")
    v = F.round(F.avg("c_acctbal"), 6).alias("v")
    levels = [(c.where("c_custkey % 3 = 0").groupBy("s", "n").agg(v), ["s", "n"]), (c.where("s < 'F'").groupBy("s").agg(v), ["s"]), (c.groupBy().agg(v), [])]
    return T.fallback(c.select("c_custkey", "s", "n"), levels, "v").select("c_custkey", "v", "level")


@query("SELECT DISTINCT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag || l_linestatus) = (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem)")
def j14_relational_division(spark, d):
    x = _line(spark, d).select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("cell"))
    return T.having_all(x, "l_suppkey", "cell").select("l_suppkey").distinct()


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def j17_spec_build(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus").distinct()


@query("SELECT c_custkey AS k, c_acctbal AS bal, NULL AS nat FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_nationkey FROM supplier")
def o1_stacked(spark, d):
    return T.stacked([table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nat"))])


@query("SELECT n_nationkey AS k FROM nation INTERSECT SELECT CAST(s_nationkey AS INTEGER) FROM supplier")
def o2_set_intersection(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


# -- summaries


@query("""WITH g AS (SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, n, round(m, 6) AS mean, round(s, 6) AS sd, round(s / sqrt(n), 6) AS sem, round(m - 1.96 * s / sqrt(n), 6) AS low, round(m + 1.96 * s / sqrt(n), 6) AS high FROM g""")
def g13_descriptives(spark, d):
    return T.described(_line(spark, d), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("""WITH x AS (SELECT l_linestatus AS method, l_returnflag AS criterion, CAST(l_linenumber AS INTEGER) AS k_true, CAST(l_quantity AS INTEGER) % 7 + 1 AS k_est FROM lineitem)
SELECT method, criterion, count(*) AS n, round(avg(CASE WHEN k_est = k_true THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(abs(k_est - k_true)), 6) AS k_abs_error, round(avg(k_est - k_true), 6) AS k_signed_error, round(stddev_samp(k_est - k_true), 6) AS sd, round(avg(CASE WHEN k_est > k_true THEN 1.0 ELSE 0 END), 6) AS over_rate FROM x GROUP BY ALL""")
def g15_k_accuracy(spark, d):
    e = F.col("k_est") - F.col("k_true")
    x = _line(spark, d).select(F.col("l_linestatus").alias("method"), F.col("l_returnflag").alias("criterion"), F.col("l_linenumber").alias("k_true"), (F.col("l_quantity").cast("int") % 7 + 1).alias("k_est"))
    return x.groupBy("method", "criterion").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((e == 0).cast("double")), 6).alias("accuracy"), F.round(F.avg(F.abs(e)), 6).alias("k_abs_error"), F.round(F.avg(e), 6).alias("k_signed_error"), F.round(F.stddev_samp(e), 6).alias("sd"), F.round(F.avg((e > 0).cast("double")), 6).alias("over_rate"))


@query("""WITH x AS (SELECT l.quality AS t, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d USING (doc_id)), ls AS (SELECT t AS l FROM x UNION SELECT p FROM x), g AS (SELECT a.l AS t, b.l AS p FROM ls a, ls b), c AS (SELECT g.t, g.p, count(x.t) AS n FROM g LEFT JOIN x ON x.t = g.t AND x.p = g.p GROUP BY ALL)
SELECT t, p, n, round(n / nullif(sum(n) OVER (PARTITION BY t), 0), 6) AS share FROM c""")
def g16_confusion(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("t"), (F.col("n_chars") > 1500).cast("int").alias("p"))
    return T.confusion(x, "t", "p")


@query("""SELECT l_returnflag AS grp, l_linestatus AS cond, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS INTEGER) AS lvl, count(*) AS n, round(avg(l_discount), 5) AS mean FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def g17_grouping_sets(spark, d):
    x = _line(spark, d).select(F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("cond"), "l_discount")
    return x.cube("grp", "cond").agg(F.grouping_id().cast("int").alias("lvl"), F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 5).alias("mean"))


@query("SELECT l_returnflag, count(DISTINCT (l_suppkey, l_linenumber)) AS cells, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_returnflag")
def g18_distinct_cells(spark, d):
    return _line(spark, d).groupBy("l_returnflag").agg(F.countDistinct(F.struct("l_suppkey", "l_linenumber")).alias("cells"), F.countDistinct("l_orderkey").alias("orders"))


@query("WITH u AS (SELECT DISTINCT l_suppkey, l_linestatus, l_quantity FROM lineitem) SELECT l_linestatus, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS med, count(*) AS n FROM u GROUP BY l_linestatus")
def g19_distinct_then_median(spark, d):
    return _line(spark, d).select("l_suppkey", "l_linestatus", "l_quantity").distinct().groupBy("l_linestatus").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.median("l_quantity"), 6).alias("med"), F.count(F.lit(1)).alias("n"))


@query("""SELECT l_linestatus AS method, round(avg(l_discount) FILTER (l_returnflag = 'A'), 6) AS a, round(avg(l_discount) FILTER (l_returnflag = 'N'), 6) AS n, round(avg(l_discount) FILTER (l_returnflag = 'R'), 6) AS r FROM lineitem GROUP BY l_linestatus""")
def g27_factor_grid(spark, d):
    grid = _line(spark, d).groupBy(F.col("l_linestatus").alias("method")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg("l_discount"), 6))
    return grid.select("method", *[F.col(c).alias(c.lower()) for c in "ANR"])


@query("""WITH b AS (SELECT l_suppkey AS blk, l_linenumber AS rep, avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) AS a, avg(CASE WHEN l_linestatus = 'O' THEN l_discount END) AS b FROM lineitem GROUP BY ALL), m AS (SELECT blk, avg(round(b - a, 9)) AS diff FROM b WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY blk)
SELECT count(*) AS blocks, round(avg(diff), 6) AS improvement, count(*) FILTER (round(diff, 9) > 0) AS wins, count(*) FILTER (round(diff, 9) = 0) AS ties, count(*) FILTER (round(diff, 9) < 0) AS losses FROM m""")
def g28_block_improvement(spark, d):
    side = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_discount")))
    cells = _line(spark, d).groupBy("l_suppkey", "l_linenumber").agg(side("F").alias("a"), side("O").alias("b")).where("a is not null and b is not null")
    diff = F.round("diff", 9)
    return cells.groupBy("l_suppkey").agg(F.avg(F.round(F.col("b") - F.col("a"), 9)).alias("diff")).groupBy().agg(F.count(F.lit(1)).alias("blocks"), F.round(F.avg("diff"), 6).alias("improvement"), F.count_if(diff > 0).alias("wins"), F.count_if(diff == 0).alias("ties"), F.count_if(diff < 0).alias("losses"))


@query("SELECT year(l_shipdate) AS y, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY ALL")
def g29_design_crosstab(spark, d):
    return _line(spark, d).groupBy(F.year("l_shipdate").cast("long").alias("y")).pivot("l_linestatus", ["F", "O"]).count().select("y", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("""WITH e AS (SELECT l_returnflag AS curve, l_suppkey AS unit, avg(l_quantity) AS y, var_samp(l_quantity) / count(*) AS v FROM lineitem GROUP BY ALL HAVING count(*) > 2 AND var_samp(l_quantity) > 0), a AS (SELECT curve, sum(1 / v) AS s0, sum(y / v) / sum(1 / v) AS m, sum(1 / v / v) AS s2, count(*) AS k FROM e GROUP BY curve),
q AS (SELECT e.curve, sum((y - m) * (y - m) / v) AS q FROM e JOIN a USING (curve) GROUP BY e.curve), t AS (SELECT a.curve, greatest(0, coalesce((q - (k - 1)) / nullif(s0 - s2 / s0, 0), 0)) AS tau2 FROM a JOIN q USING (curve)), m2 AS (SELECT curve, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS m2 FROM e JOIN t USING (curve) GROUP BY curve)
SELECT curve, unit, round(tau2, 6) AS tau2, round(tau2 / (tau2 + v) * y + (1 - tau2 / (tau2 + v)) * m2, 6) AS shrunk FROM e JOIN t USING (curve) JOIN m2 USING (curve)""")
def g31_shrinkage(spark, d):
    e = _line(spark, d).groupBy(F.col("l_returnflag").alias("curve"), F.col("l_suppkey").alias("unit")).agg(F.avg("l_quantity").alias("y"), (F.var_samp("l_quantity") / F.count(F.lit(1))).alias("v"), F.count(F.lit(1)).alias("n")).where("n > 2 and v > 0")
    return T.shrunk(e, ["curve"], "y", "v").select("curve", "unit", F.round("tau2", 6).alias("tau2"), F.round("shrunk", 6).alias("shrunk"))


@query("SELECT count(*) AS n, count(text) AS text, count(lang) AS lang, count(DISTINCT source) AS sources FROM documents")
def g34_inventory(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("text"), F.count("lang").alias("lang"), F.countDistinct("source").alias("sources"))


# -- selection of the number of states


CURVE = "c AS (SELECT l_returnflag AS fit, l_linenumber AS k, avg(l_discount) * l_linenumber AS score FROM lineitem GROUP BY l_returnflag, l_linenumber)"


def _curve(spark, d):
    return _line(spark, d).groupBy(F.col("l_returnflag").alias("fit"), F.col("l_linenumber").alias("k")).agg((F.avg("l_discount") * F.first("l_linenumber")).alias("score"))


@query("SELECT l_returnflag AS criterion, round(avg(l_discount), 9) AS score FROM lineitem GROUP BY ALL ORDER BY score DESC, criterion LIMIT 1")
def w19_best_criterion(spark, d):
    means = _line(spark, d).groupBy(F.col("l_returnflag").alias("criterion")).agg(F.round(F.avg("l_discount"), 9).alias("score"))
    return means.orderBy(F.col("score").desc(), "criterion").limit(1)


# -- vectors


@query(f"WITH {SCORES} SELECT id, k, round(corr, 6) AS corr FROM asg")
def a12_polarity_invariant_assignment(spark, d):
    return A.assigned(maps(spark, d), _centres(spark, d)).select("id", "k", F.round("corr", 6).alias("corr"))


@query(f"WITH {SCORES} SELECT k, count(*) AS n_maps, round(sum(corr * corr) / sum({DOT.format('map', 'map')}), 6) AS gev, round(sum({DOT.format('map', 'map')} - corr * corr), 6) AS wss, round(avg(abs(corr)), 6) AS mean_abs_corr FROM asg GROUP BY k")
def g20_explained_variance(spark, d):
    return A.fit_statistics(A.assigned(maps(spark, d), _centres(spark, d)), ["k"])


@query(f"""WITH {SCORES}, r AS (SELECT id, abs(corr) AS s, row_number() OVER (PARTITION BY id ORDER BY abs(corr) DESC) AS r2 FROM sc), p AS (SELECT id, 1 - max(s) FILTER (r2 = 1) AS a, 1 - max(s) FILTER (r2 = 2) AS b FROM r GROUP BY id)
SELECT id, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 6) AS silhouette FROM p""")
def g21_centroid_silhouette(spark, d):
    return A.centroid_silhouette(maps(spark, d), _centres(spark, d)).withColumn("silhouette", F.round("silhouette", 6))


@query(f"WITH {MAPS}, p AS (SELECT grp, generate_subscripts(map, 1) AS pos, unnest(map) AS x FROM mp), m AS (SELECT grp, pos, avg(x) AS m FROM p GROUP BY ALL), g AS (SELECT *, m - avg(m) OVER (PARTITION BY pos) AS d FROM m), r AS (SELECT grp, avg(d * d) AS ms FROM g GROUP BY grp) SELECT round(sqrt(avg(ms)), 6) AS statistic, count(*) AS n_levels FROM r")
def t4_tanova_statistic(spark, d):
    return A.level_statistic(maps(spark, d).select("grp", F.posexplode("map").alias("pos", "x")), "grp")


NB = "n AS (SELECT n_nationkey AS id, cos(n_nationkey) AS x, sin(n_nationkey) AS y, n_nationkey / 10.0 AS z FROM nation)"


@query(f"""WITH {NB}, p AS (SELECT a.id, b.id AS nb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM n a, n b WHERE a.id <> b.id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY d, nb) AS INTEGER) AS rank FROM p), k AS (SELECT * FROM r WHERE rank <= 4)
SELECT id, nb, rank, round(d, 6) AS d, round(1 / d / sum(1 / d) OVER (PARTITION BY id), 6) AS weight FROM k""")
def a7_neighbour_weights(spark, d):
    n = F.col("n_nationkey")
    points = table(spark, d, "nation").select(n.alias("id"), F.cos(n).alias("x"), F.sin(n).alias("y"), (n / 10.0).alias("z"))
    return T.neighbours(points, "id", ["x", "y", "z"], 4).withColumn("d", F.round("d", 6)).withColumn("weight", F.round("weight", 6))


# -- statistics in closed form


@query("""SELECT l_returnflag AS feature, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY ALL""")
def t8_correlation_and_regression(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return _line(spark, d).groupBy(F.col("l_returnflag").alias("feature")).agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(q, p), 6).alias("pearson"), F.round(F.regr_slope(p, q), 4).alias("slope"), F.round(F.regr_intercept(p, q), 4).alias("intercept"))


@query("""WITH m AS (SELECT o_custkey AS u, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY ALL), x AS (SELECT c_mktsegment AS grp, b - a AS dv FROM m JOIN customer ON u = c_custkey WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT grp, count(*) AS n, round(avg(dv), 4) AS mean_diff, round(avg(dv) / (stddev_samp(dv) / sqrt(count(*))), 6) AS t, round(avg(dv) / stddev_samp(dv), 6) AS cohen_d FROM x GROUP BY grp""")
def t16_paired_differences(spark, d):
    mean = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    m = table(spark, d, "orders").groupBy("o_custkey").agg(mean("F").alias("a"), mean("O").alias("b")).where("a is not null and b is not null")
    x = m.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("grp"), (F.col("b") - F.col("a")).alias("dv"))
    g = x.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("dv").alias("m"), F.stddev_samp("dv").alias("s"))
    return g.select("grp", "n", F.round("m", 4).alias("mean_diff"), F.round(T.ratio(F.col("m"), F.col("s") / F.sqrt(F.col("n").cast("double"))), 6).alias("t"), F.round(T.ratio(F.col("m"), F.col("s")), 6).alias("cohen_d"))
