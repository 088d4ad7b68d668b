"""Queries on maps and channels, and the SQL that gives the same rows. Vectors are returned whole, an element a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from stateflux.functions import geometry as G
from stateflux.operators import arrays as A
from stateflux.operators import backfit as B
from stateflux.operators import channels as C
from stateflux.operators import statistics as S
from stateflux.plans.parsing_queries import FIB
from stateflux.plans.registry import query
from stateflux.plans.table_queries import DOT, MAPS, SCORES, _centres
from stateflux.sources.tables import maps, table

UNIT = f"{MAPS}, ce AS (SELECT id, grp, map, list_transform(map, lambda x: x - list_avg(map)) AS c FROM mp), un AS (SELECT id, grp, map, c, sqrt({DOT.format('c', 'c')}) AS s, list_transform(c, lambda x: x / sqrt({DOT.format('c', 'c')})) AS u FROM ce)"


def _cells(df, key: str, v, name: str = "value"):
    return df.select(key, F.posexplode(v).alias("pos", "x")).select(key, "pos", F.round("x", 6).alias(name))


@query(f"WITH {UNIT}, e AS (SELECT id, s, unnest(range(64)) AS pos, unnest(c) AS a, unnest(u) AS b FROM un) SELECT id, CAST(pos AS INTEGER) AS pos, round(a, 6) AS average_reference, round(b, 6) AS unit, round(a / (s / 8), 6) AS unit_rms, round(s / 8, 6) AS gfp_rms, round(s / sqrt(63), 6) AS gfp_sd FROM e")
def a1_normalised_maps(spark, d):
    m = F.col("map")
    x = maps(spark, d).select("id", F.posexplode(F.arrays_zip(A.centred(m).alias("a"), A.unit(m).alias("u"), A.unit_rms(m).alias("r"))).alias("pos", "v"), F.round(A.gfp_rms(m), 6).alias("gfp_rms"), F.round(A.gfp_sd(m), 6).alias("gfp_sd"))
    return x.select("id", "pos", F.round("v.a", 6).alias("average_reference"), F.round("v.u", 6).alias("unit"), F.round("v.r", 6).alias("unit_rms"), "gfp_rms", "gfp_sd")


NEAR = """pr AS (SELECT a.idx AS target, b.idx AS source, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM fib a, fib b WHERE a.idx <> b.idx), nr AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(d, 12), source) AS r FROM pr),
wt AS (SELECT target, source, (1 / d) / sum(1 / d) OVER (PARTITION BY target) AS w FROM nr WHERE r <= 4)"""


@query(f"""WITH {FIB}, {MAPS}, {NEAR}, wm AS (SELECT target, source, -0.5 * w AS w FROM wt UNION ALL SELECT idx, idx, 1.0 FROM fib), e AS (SELECT id, unnest(range(64)) AS ch, unnest(map) AS x FROM mp)
SELECT id, target AS ch, round(sum(x * w), 6) AS x FROM e JOIN wm ON source = ch GROUP BY id, target""")
def a7_laplacian(spark, d):
    weights = C.spatial_filter(G.fibonacci_sphere(spark, 64), "laplacian", 4, 0.5)
    x = maps(spark, d).select("id", F.posexplode("map").alias("ch", "x"))
    return C.applied(x, weights, ["id"]).select("id", "ch", F.round("x", 6).alias("x"))


@query(f"""WITH {FIB}, {MAPS}, tg AS (SELECT idx, x * cos(radians(10)) - y * sin(radians(10)) AS x, x * sin(radians(10)) + y * cos(radians(10)) AS y, z FROM fib WHERE idx % 2 = 0 UNION ALL SELECT idx + 100, x, y, z FROM fib WHERE idx % 16 = 1),
pr AS (SELECT a.idx AS target, b.idx AS source, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM tg a, fib b), nr AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(d, 12), source) AS r FROM pr),
rw AS (SELECT target, source, CASE WHEN min(d) OVER (PARTITION BY target) <= 2.220446049250313e-16 THEN CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END ELSE 1 / (d * d + 2.220446049250313e-16) END AS raw FROM nr WHERE r <= 6), wt AS (SELECT target, source, raw / sum(raw) OVER (PARTITION BY target) AS w FROM rw),
e AS (SELECT id, unnest(range(64)) AS ch, unnest(map) AS x FROM mp) SELECT id, target AS ch, round(sum(x * w), 6) AS x FROM e JOIN wt ON source = ch GROUP BY id, target""")
def a8_interpolated_channels(spark, d):
    fib = G.fibonacci_sphere(spark, 64)
    rx, ry = G.rotated(F.col("x"), F.col("y"), 10)
    targets = fib.where("idx % 2 = 0").select("idx", rx.alias("x"), ry.alias("y"), "z").unionByName(fib.where("idx % 16 = 1").withColumn("idx", F.col("idx") + 100))
    x = maps(spark, d).select("id", F.posexplode("map").alias("ch", "x"))
    return C.applied(x, C.inverse_distance(fib, targets, 6), ["id"]).select("id", "ch", F.round("x", 6).alias("x"))


NAMES = ["FP1", "fp2", "F7", "F3", "Fz", "F4", "F8", "T3", "C3", "Cz", "C4", "T8/T4", "T5/P7", "P3", "PZ", "P4", "T6", "O1", "X", "Fp1"]
_ALL = "[" + ", ".join(f"'{x}'" for x in NAMES) + "]"
_LEADS = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(C.LEADS_19, 1))


@query(f"""WITH l AS (SELECT n_nationkey AS idx, list_extract({_ALL}, CAST(n_nationkey % 20 + 1 AS INTEGER)) AS label FROM nation), t(place, lead, older) AS (VALUES {_LEADS}),
m AS (SELECT place, lead, idx, label, CASE WHEN lower(label) = lower(lead) THEN 0 WHEN older <> '' AND lower(label) = lower(older) THEN 1 ELSE 2 END AS k FROM l, t WHERE lower(label) = lower(lead) OR (older <> '' AND (lower(label) = lower(older) OR lower(label) IN (lower(lead) || '/' || lower(older), lower(older) || '/' || lower(lead)))))
SELECT place, lead, idx, label FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY k, idx) AS r FROM m) WHERE r = 1""")
def a9_montage(spark, d):
    k = F.col("n_nationkey")
    labels = table(spark, d, "nation").select(k.alias("idx"), F.element_at(F.array(*[F.lit(x) for x in NAMES]), (k % len(NAMES) + 1).cast("int")).alias("label"))
    return C.montage(labels, "10-20-20")


@query("""WITH f AS (SELECT l_suppkey % 7 AS file, l_linenumber AS idx, 'EEG ' || printf('%03d', l_partkey % 40) AS label, l_partkey % 40 AS c FROM lineitem WHERE l_partkey % 40 <= 30 + l_suppkey % 7), n AS (SELECT count(DISTINCT file) AS n, min(file) AS first FROM f),
k AS (SELECT c FROM f GROUP BY c HAVING count(DISTINCT file) = (SELECT n FROM n)) SELECT CAST(c AS VARCHAR) AS label, min(idx) AS idx FROM f WHERE file = (SELECT first FROM n) AND c IN (SELECT c FROM k) GROUP BY c""")
def a10_common_channels(spark, d):
    x = table(spark, d, "lineitem").where("l_partkey % 40 <= 30 + l_suppkey % 7")
    files = x.select((F.col("l_suppkey") % 7).alias("file"), F.col("l_linenumber").alias("idx"), F.format_string("EEG %03d", F.col("l_partkey") % 40).alias("label"))
    return C.common_channels(files)


@query(f"""WITH {FIB}, {MAPS}, ob AS (SELECT idx FROM fib WHERE idx % 5 <> 0), pr AS (SELECT a.idx AS target, b.idx AS source, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM fib a, fib b WHERE a.idx % 5 = 0 AND b.idx % 5 <> 0),
nr AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(d, 12), source) AS r FROM pr), wt AS (SELECT target, source, (1 / (d * d + 2.220446049250313e-16)) / sum(1 / (d * d + 2.220446049250313e-16)) OVER (PARTITION BY target) AS w FROM nr WHERE r <= 6 UNION ALL SELECT idx, idx, 1.0 FROM ob),
e AS (SELECT id, unnest(range(64)) AS ch, unnest(map) AS x FROM mp) SELECT id, target AS ch, round(sum(x * w), 6) AS x FROM e JOIN wt ON source = ch GROUP BY id, target""")
def a11_remapped_channels(spark, d):
    fib = G.fibonacci_sphere(spark, 64)
    have = fib.where("idx % 5 <> 0")
    named = lambda f, p: f.select("idx", F.concat(F.lit(p), F.col("idx").cast("string")).alias("label"))
    spec = C.remap_spec(named(have, "EEG 0"), named(fib, "chan"), have, fib)
    x = maps(spark, d).select("id", F.posexplode("map").alias("ch", "x"))
    return C.applied(x, spec, ["id"]).select("id", "ch", F.round("x", 6).alias("x"))


@query(f"WITH {MAPS}, g AS (SELECT id, map, i, unnest(range(i, 64)) AS j FROM (SELECT id, map, unnest(range(64)) AS i FROM mp)) SELECT id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(map[i + 1] * map[j + 1] * CASE WHEN i = j THEN 1 ELSE sqrt(2) END, 6) AS value FROM g WHERE i < 8 AND j < 8")
def a14_outer_products(spark, d):
    # the first eight channels of every map: all 2,080 cells of each would be a million rows of one formula
    o = maps(spark, d).select("id", F.posexplode(A.outer(F.slice("map", 1, 8))).alias("p", "x"))
    i = F.floor((17 - F.sqrt(289.0 - 8 * F.col("p"))) / 2).cast("int")
    o = o.withColumn("i", i)
    return o.select("id", "i", (F.col("p") - (F.col("i") * (17 - F.col("i")) / 2).cast("int") + F.col("i")).cast("int").alias("j"), F.round("x", 6).alias("value"))


@query(f"WITH {MAPS}, r AS (SELECT map AS ref FROM mp WHERE id = 0), x AS (SELECT id, map, {DOT.format('map', 'ref')} AS dp FROM mp, r), e AS (SELECT id, dp, unnest(range(64)) AS pos, unnest(map) AS x FROM x) SELECT id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN dp < 0 THEN -x ELSE x END, 6) AS value FROM e")
def a19_sign_alignment(spark, d):
    ref = maps(spark, d).where("id = 0").select(F.col("map").alias("ref"))
    return _cells(maps(spark, d).crossJoin(F.broadcast(ref)), "id", A.aligned(F.col("map"), F.col("ref")))  # the reference is one row


@query(f"WITH {MAPS}, p AS (SELECT grp, id, unnest(range(64)) AS pos, unnest(map) AS x FROM mp) SELECT grp, CAST(pos AS INTEGER) AS pos, round(sum((id % 3 + 1) * x) / sum(id % 3 + 1), 6) AS value FROM p GROUP BY ALL")
def a20_weighted_mean_maps(spark, d):
    w = A.mean_map(maps(spark, d).withColumn("w", F.col("id") % 3 + 1), ["grp"], weight=F.col("w").cast("double"))
    return _cells(w, "grp", F.col("mean_map"))


@query(f"""WITH {UNIT}, a AS (SELECT u AS a FROM un WHERE id = 0), b AS (SELECT u AS b FROM un WHERE id = 1), x AS (SELECT id, {DOT.format('a', 'b')} AS ab, {DOT.format('c', 'a')} AS xa, {DOT.format('c', 'b')} AS xb, {DOT.format('c', 'c')} AS xx FROM un, a, b),
y AS (SELECT *, (xa - ab * xb) / (1 - ab * ab) AS p, (xb - ab * xa) / (1 - ab * ab) AS q FROM x), z AS (SELECT *, greatest(xx - p * xa - q * xb, 0) AS pair, xx - greatest(xa * xa, xb * xb) AS single FROM y)
SELECT id, round(abs(p) / (abs(p) + abs(q)), 5) AS first, round(abs(q) / (abs(p) + abs(q)), 5) AS second, round(least(abs(p), abs(q)) / (abs(p) + abs(q)), 5) AS secondary, round(greatest(0, (single - pair) / greatest(single, 2.220446049250313e-16)), 5) AS gain FROM z WHERE id > 1""")
def a21_two_state_fit(spark, d):
    x = maps(spark, d)
    ref = x.where("id < 2").groupBy().agg(*[F.first(F.when(F.col("id") == i, A.unit(F.col("map"))), ignorenulls=True).alias(c) for i, c in ((0, "a"), (1, "b"))])
    fit = x.where("id > 1").crossJoin(F.broadcast(ref)).select("id", B.two_state(A.centred(F.col("map")), F.col("a"), F.col("b")).alias("f"))  # one row
    return fit.select("id", *[F.round(f"f.{c}", 5).alias(c) for c in ("first", "second", "secondary", "gain")])


@query(f"""WITH {MAPS}, x AS (SELECT id, map[:8] AS v, map[9:16] AS m FROM mp) SELECT id, round(greatest(-1, least(1, v[1] * 10)), 6) AS clamped, round(list_max(v) + ln(list_sum(list_transform(v, lambda t: exp(t - list_max(v))))), 6) AS log_sum_exp,
 round(-0.5 * (8 * ln(2 * pi()) + list_sum(list_transform(list_zip(v, m), lambda p: ln(0.01 + p[2] * p[2]) + (p[1] - p[2]) * (p[1] - p[2]) / (0.01 + p[2] * p[2])))), 5) AS log_pdf, round(list_sum(list_transform(m, lambda t: ln(0.01 + t * t))), 6) AS log_det FROM x""")
def a24_gaussian_terms(spark, d):
    v, m = F.slice("map", 1, 8), F.slice("map", 9, 8)
    variance = F.transform(m, lambda t: 0.01 + t * t)
    return maps(spark, d).select("id", F.round(A.clamped(F.col("map")[0] * 10), 6).alias("clamped"), F.round(A.log_sum_exp(v), 6).alias("log_sum_exp"), F.round(A.gaussian_log_pdf(v, m, variance), 5).alias("log_pdf"), F.round(A.total(F.transform(variance, F.ln)), 6).alias("log_det"))


def _labels(spark, d, r: int, prefix: str):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").where(k % r != 0).select(k.alias("idx"), F.concat(F.lit(prefix), (k % 15).cast("string")).alias("label"))


@query("WITH a AS (SELECT CAST(n_nationkey % 15 AS VARCHAR) AS label, min(n_nationkey) AS idx_one FROM nation WHERE n_nationkey % 3 <> 0 GROUP BY 1), b AS (SELECT CAST(n_nationkey % 15 AS VARCHAR) AS label, min(n_nationkey) AS idx_two FROM nation WHERE n_nationkey % 4 <> 0 GROUP BY 1) SELECT * FROM a JOIN b USING (label)")
def j6_matched_channels(spark, d):
    return C.matched_labels(_labels(spark, d, 3, "EEG 0"), _labels(spark, d, 4, "Chan"), least=4)


@query("""WITH s AS (SELECT s_nationkey AS file, s_suppkey AS c, s_acctbal AS x FROM supplier), h AS (SELECT file, count(*) AS n, count(*) FILTER (c % 3 <> file % 4) AS hits FROM s GROUP BY 1)
SELECT s.file, 'Ch ' || c AS label, CASE WHEN hits >= greatest(4, ceil(0.5 * n)) AND c % 3 <> s.file % 4 THEN -x ELSE x END AS x, CASE WHEN hits >= greatest(4, ceil(0.5 * n)) AND c % 3 <> s.file % 4 THEN 'sidecar' ELSE 'own' END AS source FROM s JOIN h USING (file)""")
def j15_sidecar_override(spark, d):
    s = table(spark, d, "supplier")
    own = s.select(F.col("s_nationkey").alias("file"), F.concat(F.lit("Ch "), F.col("s_suppkey").cast("string")).alias("label"), *[F.col("s_acctbal").alias(c) for c in "xyz"], (F.col("s_suppkey") % 3 != F.col("s_nationkey") % 4).alias("hit"))
    side = own.where("hit").select("file", F.upper(F.replace("label", F.lit(" "), F.lit(""))).alias("label"), *[(-F.col(c)).alias(c) for c in "xyz"])
    return C.overridden(own.drop("hit"), side).select("file", "label", "x", "source")


@query(f"""WITH {SCORES}, f AS (SELECT k, unnest(range(8)) AS pos, unnest(map[:8]) AS x FROM asg), p AS (SELECT k, pos, count(*) AS m, avg(x) AS mu, var_pop(x) * count(*) AS w FROM f GROUP BY ALL), g AS (SELECT *, sum(m * mu) OVER (PARTITION BY pos) / sum(m) OVER (PARTITION BY pos) AS gm FROM p),
s AS (SELECT sum(w) AS w, sum(m * (mu - gm) * (mu - gm)) AS b, count(DISTINCT k) AS k, sum(m) FILTER (pos = 0) AS n FROM g) SELECT CAST(n AS BIGINT) AS n, k, round((b / (k - 1)) / (w / (n - k)), 5) AS score FROM s""")
def g22_calinski_harabasz(spark, d):
    rows = A.assigned(maps(spark, d), _centres(spark, d)).select("k", F.slice("map", 1, 8).alias("f"))
    return S.calinski_harabasz(rows).withColumn("score", F.round("score", 5))


@query(f"""WITH {SCORES}, f AS (SELECT id, k, unnest(range(6)) AS pos, unnest(map[:6]) AS x FROM asg), o AS (SELECT pos, greatest(coalesce(var_samp(x), 0), 1e-8) AS gv FROM f GROUP BY pos), ri AS (SELECT greatest(1e-8, median(gv) * 1e-4) AS ridge FROM o), n AS (SELECT count(*) AS n, count(DISTINCT k) AS kk FROM asg),
mo AS (SELECT k, f.pos, count(*) AS m, avg(x) AS mu, greatest(CASE WHEN count(*) >= 2 THEN var_samp(x) ELSE any_value(gv) END, 1e-8) + any_value(ridge) AS v FROM f JOIN o USING (pos), ri GROUP BY k, f.pos),
jo AS (SELECT id, mo.k, ln(any_value(m) / any_value(n) + 2.220446049250313e-16) - 0.5 * sum(ln(2 * pi()) + ln(v) + (x - mu) ** 2 / v) AS j FROM f JOIN mo ON f.pos = mo.pos, n GROUP BY id, mo.k), tp AS (SELECT id, k, j, max(j) OVER (PARTITION BY id) AS t FROM jo),
ll AS (SELECT id, t + ln(sum(exp(j - t)) + 2.220446049250313e-16) AS ll FROM tp GROUP BY id, t), en AS (SELECT sum(-exp(j - ll) * ln(exp(j - ll) + 2.220446049250313e-16)) AS h FROM tp JOIN ll USING (id)), su AS (SELECT sum(ll) AS s FROM ll)
SELECT n, CAST(kk AS INTEGER) AS k, round(s, 4) AS log_likelihood, round(s - 0.5 * ((kk - 1) + 2 * kk * 6) * ln(n), 4) AS bic, round(s - 0.5 * ((kk - 1) + 2 * kk * 6) * ln(n) - h, 4) AS icl, round(h, 4) AS assignment_entropy FROM su, en, n""")
def g23_matrix_evidence(spark, d):
    rows = A.assigned(maps(spark, d), _centres(spark, d)).select("k", F.slice("map", 1, 6).alias("f"))
    out = S.matrix_evidence(rows)
    return out.select("n", "k", *[F.round(c, 4).alias(c) for c in ("log_likelihood", "bic", "icl", "assignment_entropy")])


@query(f"""WITH {SCORES}, uu AS (SELECT id, k, list_transform(map, lambda x: x / sqrt({DOT.format('map', 'map')})) AS u FROM asg), pr AS (SELECT a.id, a.k, b.k AS o, a.id = b.id AS same, abs({DOT.format('a.u', 'b.u')}) AS s FROM uu a, uu b),
me AS (SELECT id, k, o, sum(1 - s) / nullif(count(*), 0) AS d FROM pr WHERE NOT (k = o AND (same OR round(s, 9) >= 1)) GROUP BY ALL), ab AS (SELECT u.id, coalesce(max(d) FILTER (o = u.k), 0) AS a, min(d) FILTER (o <> u.k) AS b FROM uu u LEFT JOIN me ON me.id = u.id GROUP BY u.id)
SELECT id, round(coalesce((coalesce(b, a) - a) / nullif(greatest(a, coalesce(b, a)), 0), 0), 6) AS silhouette FROM ab""")
def g21_exact_silhouette(spark, d):
    m = F.col("map")
    rows = A.assigned(maps(spark, d), _centres(spark, d)).select("id", "k", A.let(A.norm(m), lambda s: F.transform(m, lambda x: x / s)).alias("map"))
    return S.exact_silhouette(rows).withColumn("silhouette", F.round("silhouette", 6))


SOFT = f"{MAPS}, sq AS (SELECT id, list_transform(map[:3], lambda x: x * x) AS t, list_transform(map[2:4], lambda x: x * x) AS e FROM mp), we AS (SELECT id, list_transform(t, lambda x: x / list_sum(t)) AS t, list_transform(e, lambda x: x / list_sum(e)) AS e, id % 4 = 0 AS o FROM sq)"


def _weights(spark, d):
    share = lambda v: A.let(F.transform(v, lambda x: x * x), lambda w: A.let(A.total(w), lambda s: F.transform(w, lambda x: x / s)))
    return maps(spark, d).select("id", "grp", share(F.slice("map", 1, 3)).alias("truth"), share(F.slice("map", 2, 3)).alias("estimate"), (F.col("id") % 4 == 0).alias("overlap"))


@query(f"""WITH {SOFT}, r AS (SELECT id, o, list_position(t, list_max(t)) = list_position(e, list_max(e)) AS hit, list_sum(list_transform(list_zip(t, e), lambda p: abs(p[1] - p[2]))) / 3 AS err, list_filter([1, 2, 3], lambda i: t[i] > 1e-6) AS ta, list_filter([1, 2, 3], lambda i: e[i] > 1e-6) AS ea FROM we),
c AS (SELECT pos, avg(t) AS t, avg(e) AS e FROM (SELECT unnest([0, 1, 2]) AS pos, unnest(t) AS t, unnest(e) AS e FROM we) GROUP BY pos)
SELECT (SELECT count(*) FROM r) AS n, (SELECT round(avg(CAST(hit AS INTEGER)), 6) FROM r) AS top1_accuracy, (SELECT round(avg(err), 6) FROM r) AS weight_mae, (SELECT round(avg(CAST(hit AS INTEGER)), 6) FROM r WHERE o) AS top1_accuracy_overlap, (SELECT round(avg(err), 6) FROM r WHERE o) AS weight_mae_overlap,
 (SELECT round(avg(CAST(len(ta) <= len(ea) AND ta = ea AS INTEGER)), 6) FROM r WHERE o AND len(ta) >= 2) AS pair_accuracy_overlap, round(corr(t, e), 5) AS coverage_corr, round(avg(abs(e - t)), 6) AS coverage_mae, round(sqrt(avg((e - t) ** 2)), 6) AS coverage_rmse, round(sum(abs(e - t)), 6) AS coverage_l1, round(max(abs(e - t)), 6) AS coverage_linf FROM c""")
def g25_backfit_diagnostics(spark, d):
    out = B.diagnostics(_weights(spark, d))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("top1_accuracy", "weight_mae", "top1_accuracy_overlap", "weight_mae_overlap", "pair_accuracy_overlap")], F.round("coverage_corr", 5).alias("coverage_corr"), *[F.round(f"coverage_{c}", 6).alias(f"coverage_{c}") for c in ("mae", "rmse", "l1", "linf")])


@query(f"""WITH {SOFT}, g AS (SELECT grp, t FROM we JOIN mp USING (id)), n AS (SELECT grp, count(*) AS n, least(5, greatest(3, CAST(round(count(*) ** (1.0 / 4)) AS INTEGER))) AS b FROM g GROUP BY grp), c AS (SELECT g.grp, n, b, list_transform(t, lambda x: CAST(least(floor(x * b), b - 1) AS INTEGER)) AS cell FROM g JOIN n USING (grp)), k AS (SELECT grp, n, b, cell, count(*) AS c FROM c GROUP BY ALL)
SELECT grp, any_value(n) AS n, CASE WHEN any_value(n) >= 16 THEN round(log2(any_value(n)) - sum(c * log2(c)) / any_value(n) - 3 * log2(any_value(b)), 6) END AS entropy_bits FROM k GROUP BY grp""")
def g5_joint_entropy(spark, d):
    from stateflux.operators.sequences import joint_entropy

    return joint_entropy(_weights(spark, d), ["grp"], "truth").withColumn("entropy_bits", F.round("entropy_bits", 6))


@query(f"""WITH {MAPS}, r AS (SELECT grp, map[1] AS x, map[2] AS y FROM mp), s AS (SELECT grp, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) AS x, (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) AS y, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY grp)),
b AS (SELECT *, least(16, greatest(6, CAST(round(sqrt(n) / 2) AS INTEGER))) AS b FROM s), c AS (SELECT grp, n, CAST(least(floor(x * b), b - 1) AS INTEGER) AS i, CAST(least(floor(y * b), b - 1) AS INTEGER) AS j, count(*) AS c FROM b GROUP BY ALL),
p AS (SELECT grp, n, c / n AS p, sum(c) OVER (PARTITION BY grp, i) / n AS px, sum(c) OVER (PARTITION BY grp, j) / n AS py FROM c), t AS (SELECT grp, any_value(n) AS n, sum(p * log2(p / (px * py))) AS mi, sum(-p * log2(px)) AS hx, sum(-p * log2(py)) AS hy FROM p GROUP BY grp)
SELECT grp, n, CASE WHEN n >= 16 THEN round(mi, 6) END AS mi_bits, CASE WHEN n >= 16 THEN round(mi / greatest(sqrt(hx * hy), 2.220446049250313e-16), 6) END AS nmi FROM t""")
def g7_binned_information(spark, d):
    from stateflux.operators.sequences import binned_information

    x = maps(spark, d).select("grp", F.col("map")[0].alias("x"), F.col("map")[1].alias("y"))
    return binned_information(x, ["grp"], "x", "y").select("grp", "n", F.round("mi_bits", 6).alias("mi_bits"), F.round("nmi", 6).alias("nmi"))


@query(f"""WITH {UNIT}, ct AS (SELECT id AS k, u AS cu FROM un WHERE id < 7), ds AS (SELECT un.id, grp, k, 1 - abs({DOT.format('u', 'cu')}) AS d FROM un, ct), al AS (SELECT sqrt(avg(d * d) + 2.220446049250313e-16) AS s FROM ds), sg AS (SELECT k, sqrt(avg(d * d) FILTER (grp = k) + 2.220446049250313e-16) AS s FROM ds GROUP BY k),
se AS (SELECT k, greatest(0.5 * coalesce(sg.s, al.s), 2.220446049250313e-16) AS s FROM sg, al), ra AS (SELECT id, ds.k, exp(-0.5 * d * d / (s * s + 2.220446049250313e-16)) AS w FROM ds JOIN se USING (k)) SELECT id, k AS state, round(w / greatest(sum(w) OVER (PARTITION BY id), 2.220446049250313e-16), 6) AS weight FROM ra""")
def m11_gaussian_weights(spark, d):
    centres, x = _centres(spark, d), maps(spark, d)
    sigmas = B.spreads(x.select(F.col("grp").alias("k"), "map"), centres)
    out = B.gaussian(x.withColumnRenamed("map", "v"), centres, sigmas)
    return out.select("id", F.posexplode("weights").alias("p", "w")).select("id", F.col("p").cast("long").alias("state"), F.round("w", 6).alias("weight"))


@query(f"""WITH {UNIT}, ct AS (SELECT id AS k, u AS cu FROM un WHERE id < 7), ds AS (SELECT un.id, k, abs({DOT.format('u', 'cu')}) AS r FROM un, ct), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(r, 12) DESC, k) AS n FROM ds) SELECT id, k, round(r, 6) AS confidence FROM rk WHERE n = 1""")
def m10_hard_backfit(spark, d):
    return B.hard(maps(spark, d).withColumnRenamed("map", "v"), _centres(spark, d)).select("id", "k", F.round("confidence", 6).alias("confidence"))


@query("WITH x AS (SELECT label, floor(vec_id / 10) AS f, unnest(range(8)) AS freq, unnest(list_transform(embedding[:8], lambda x: CAST(x AS DOUBLE) * x)) AS p, vec_id % 5 + 1 AS n FROM embeddings) SELECT label, CAST(freq AS INTEGER) AS freq, round(sum(p * n) / sum(n), 6) AS power, count(*) AS n_records FROM x GROUP BY ALL")
def g33_mean_spectra(spark, d):
    from stateflux.operators.signals import mean_spectra

    v = F.transform(F.slice("map", 1, 8), lambda x: x * x)
    x = maps(spark, d).select(F.col("grp").alias("label"), F.posexplode(v).alias("freq", "power"), (F.col("id") % 5 + 1).alias("n_samples"))
    return mean_spectra(x, ["label"]).withColumn("power", F.round("power", 6))


@query(f"WITH {SCORES}, f AS (SELECT k, abs(corr) AS r, corr * corr AS q, {DOT.format('map', 'map')} AS p FROM asg), n AS (SELECT count(*) AS n, sum(p - q) / sum(p) AS rv FROM f) SELECT k, count(*) AS n_maps, round(count(*) / any_value(n), 6) AS share, round(avg(r), 6) AS mean_abs_corr, round(any_value(rv), 6) AS residual_variance, round(any_value(rv) * (63.0 / 56.0) ** 2, 6) AS cross_validation FROM f, n GROUP BY k")
def g20_state_shares(spark, d):
    return A.state_shares(A.assigned(maps(spark, d), _centres(spark, d)), 7)


@query(f"WITH {UNIT}, e AS (SELECT id, unnest(range(64)) AS pos, unnest(u) AS b FROM un) SELECT id, CAST(pos AS INTEGER) AS pos, round(b, 6) AS value FROM e")
def a2_unit_maps(spark, d):
    return _cells(maps(spark, d), "id", A.unit(F.col("map")))


@query(f"WITH {UNIT}, e AS (SELECT id, unnest(range(64)) AS pos, unnest(u) AS b FROM un) SELECT id, CAST(pos AS INTEGER) AS pos, round(b * 8, 6) AS value FROM e")
def a3_unit_rms_maps(spark, d):
    return _cells(maps(spark, d), "id", A.unit_rms(F.col("map")))


@query(f"WITH {MAPS} SELECT id, round(list_stddev_pop(map), 6) AS gfp_rms, round(list_stddev_samp(map), 6) AS gfp_sd FROM mp")
def a4_field_power(spark, d):
    return maps(spark, d).select("id", F.round(A.gfp_rms(F.col("map")), 6).alias("gfp_rms"), F.round(A.gfp_sd(F.col("map")), 6).alias("gfp_sd"))


@query(f"WITH {SCORES} SELECT id, k, round(corr, 6) AS corr FROM sc")
def j11_maps_by_states(spark, d):
    centres = _centres(spark, d)
    return maps(spark, d).crossJoin(F.broadcast(centres)).select("id", "k", F.round(A.dot(F.col("map"), F.col("centre")), 6).alias("corr"))  # seven states


@query(f"WITH {UNIT} SELECT x.grp, x.id AS a, y.id AS b, round(abs({DOT.format('x.u', 'y.u')}), 6) AS similarity FROM un x JOIN un y ON x.grp = y.grp AND x.id < y.id WHERE abs({DOT.format('x.u', 'y.u')}) >= 0.3")
def m5_duplicate_pairs(spark, d):
    from stateflux.operators.fits import duplicate_pairs

    return duplicate_pairs(maps(spark, d).withColumnRenamed("id", "state"), ["grp"], least=0.3).withColumn("similarity", F.round("similarity", 6))


@query("""WITH c AS (SELECT c_custkey AS idx, c_nationkey AS n, c_custkey % 4 = 0 AS bare FROM customer), r AS (SELECT n_nationkey AS n FROM nation WHERE n_nationkey % 3 > 0)
SELECT idx, 'Chan' || c.n AS label, CAST(CASE WHEN bare THEN CASE WHEN r.n IS NOT NULL THEN -1.0 * r.n END ELSE 1.0 END AS DOUBLE) AS x, CASE WHEN NOT bare THEN 'own' WHEN r.n IS NOT NULL THEN 'reference' END AS source FROM c LEFT JOIN r ON r.n = c.n""")
def s15_backfilled_montage(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation").where("n_nationkey % 3 > 0")
    x = F.when(F.col("c_custkey") % 4 != 0, 1.0)
    own = c.select(F.col("c_custkey").alias("idx"), F.concat(F.lit("Chan"), F.col("c_nationkey").cast("string")).alias("label"), *[x.alias(a) for a in "xyz"])
    reference = n.select(F.concat(F.lit("EEG 0"), F.col("n_nationkey").cast("string")).alias("label"), *[(-F.col("n_nationkey")).cast("double").alias(a) for a in "xyz"])
    return C.backfilled(own, reference).select("idx", "label", "x", "source")


@query(f"WITH {MAPS} SELECT id, " + ", ".join(f"round(map[{i}], 6) AS ch_{i:03d}" for i in range(1, 65)) + " FROM mp")
def k2_matrix_columns(spark, d):
    from stateflux.sinks.files import matrix_columns

    return matrix_columns(maps(spark, d).withColumn("map", F.transform("map", lambda x: F.round(x, 6))), ["id"], 64)


@query(f"WITH {MAPS}, e AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY id) AS s, map FROM mp), c AS (SELECT grp, s, unnest(range(64)) AS pos, unnest(map) AS x FROM e) SELECT grp, printf('state_%02d', s) AS state, CAST(pos AS INTEGER) AS pos, round(x, 6) AS value FROM c")
def k3_solutions_as_json(spark, d):
    from pyspark.sql import Window

    from stateflux.sinks.files import solution_json
    from stateflux.sources.files import state_maps

    place = F.row_number().over(Window.partitionBy("grp").orderBy("id")) - 1
    text = solution_json(maps(spark, d).withColumn("state", place), ["grp"], {"method": "topo_kmeans"})
    back = state_maps(text, "json", key="grp")
    return back.select("grp", "state", F.posexplode("map").alias("pos", "x")).select("grp", "state", "pos", F.round("x", 6).alias("value"))


@query(f"WITH {MAPS}, e AS (SELECT id, map FROM mp WHERE id < 7), c AS (SELECT id, unnest(range(64)) AS pos, unnest(map) AS x FROM e) SELECT chr(CAST(65 + id AS INTEGER)) AS label, CAST(pos AS INTEGER) AS pos, round(x, 6) AS value FROM c")
def s6_templates(spark, d):
    from stateflux.sources.files import templates

    states = _centres(spark, d).select(F.col("k").alias("state"), F.col("centre").alias("map"))
    return _cells(templates(states), "label", F.col("map"))
