"""Sequence queries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from stateflux.operators import sequences as S
from stateflux.plans.registry import query
from stateflux.sources.tables import sequence

EV = "ev AS (SELECT user_id AS rec, epoch_us(ts) AS us, event_id AS seq, event_type AS state, value AS gfp FROM events)"
RUNS = f"""{EV}, en AS (SELECT *, CASE WHEN lag(state) OVER w IS NULL OR lag(state) OVER w <> state THEN 1 ELSE 0 END AS e FROM ev WINDOW w AS (PARTITION BY rec ORDER BY us, seq)),
ru AS (SELECT *, CAST(sum(e) OVER (PARTITION BY rec ORDER BY us, seq) AS BIGINT) AS run FROM en),
runs AS (SELECT rec, run, state, count(*) AS n, min(us) AS start_us, max(us) AS stop_us, avg(gfp) AS gfp_mean FROM ru GROUP BY rec, run, state)"""
#: Added before a mean of values with few decimals is rounded: halves, which occur, then go up in both engines, however the sum was formed.
UP = 1e-9
PHASE = f"""{EV}, m AS (SELECT *, CASE WHEN state = 'click' THEN us END AS mk FROM ev),
ph0 AS (SELECT *, last_value(mk IGNORE NULLS) OVER (PARTITION BY rec ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r0,
 first_value(mk IGNORE NULLS) OVER (PARTITION BY rec ORDER BY us, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r1 FROM m),
ph AS (SELECT rec, us, seq, state, gfp, 2 * pi() * (us - r0) / (r1 - r0) AS phase FROM ph0 WHERE r0 IS NOT NULL AND r1 IS NOT NULL AND r1 > r0)"""


@query(f"""WITH {RUNS}, ps AS (SELECT rec, state, sum(n) AS ns, count(*) AS occ, sum(gfp_mean * n) AS gs, avg(n) AS rm, median(n) AS rmed FROM runs GROUP BY rec, state),
r AS (SELECT rec, count(*) AS total, (max(us) - min(us)) / 1e6 AS sec FROM ev GROUP BY rec), g AS (SELECT * FROM r, (SELECT DISTINCT state FROM ev))
SELECT g.rec, g.state, CAST(coalesce(ns, 0) AS BIGINT) AS n_samples, round(coalesce(ns / total, 0), 6) AS coverage, round(gs / ns, 6) AS mean_gfp, coalesce(occ, 0) AS occurrences,
 round(coalesce(occ, 0) / nullif(sec, 0), 6) AS rate_hz, round(rm, 6) AS run_mean, round(rmed, 6) AS run_median FROM g LEFT JOIN ps ON g.rec = ps.rec AND g.state = ps.state""")
def g1_state_metrics(spark, d):
    return S.state_metrics(sequence(spark, d))


@query(f"WITH {RUNS} SELECT rec, run, state, n, start_us, stop_us, round(gfp_mean, 6) AS gfp_mean FROM runs")
def w3_run_islands(spark, d):
    return S.runs(sequence(spark, d)).withColumn("gfp_mean", F.round("gfp_mean", 6))


@query(f"WITH {RUNS} SELECT rec, state, count(*) AS entries FROM runs GROUP BY rec, state")
def g3_state_entries(spark, d):
    return S.entries(sequence(spark, d)).where("entry").groupBy("rec", "state").agg(F.count(F.lit(1)).alias("entries"))


@query(f"WITH {EV}, c AS (SELECT rec, state, count(*) AS n FROM ev GROUP BY rec, state) SELECT rec, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy_bits FROM c GROUP BY rec")
def g4_entropy(spark, d):
    return S.entropy(sequence(spark, d))


@query(f"""WITH {EV}, t AS (SELECT state AS from_state, lead(state) OVER (PARTITION BY rec ORDER BY us, seq) AS to_state FROM ev), c AS (SELECT from_state, to_state, count(*) AS n FROM t WHERE to_state <> from_state GROUP BY ALL)
SELECT from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY from_state), 6) AS share FROM c""")
def g3_transitions(spark, d):
    return S.transitions(sequence(spark, d))


@query(f"""WITH {EV}, c AS (SELECT rec, state, count(*) AS n FROM ev GROUP BY rec, state), s AS (SELECT rec, state, n / sum(n) OVER (PARTITION BY rec) AS p FROM c),
x AS (SELECT a.rec, a.state AS state_i, b.state AS state_j, a.p AS pi, b.p AS pj, 1 - a.p - b.p AS z FROM s a JOIN s b ON a.rec = b.rec AND a.state < b.state),
y AS (SELECT *, CASE WHEN pi * (1 - pj) > 0 THEN pi * log2(pi / (pi * (1 - pj))) ELSE 0 END + CASE WHEN pj * (1 - pi) > 0 THEN pj * log2(pj / (pj * (1 - pi))) ELSE 0 END
 + CASE WHEN z > 1e-9 THEN z * log2(z / greatest((1 - pi) * (1 - pj), 1e-12)) ELSE 0 END AS mi,
 -(pi * log2(pi) + CASE WHEN 1 - pi > 1e-12 THEN (1 - pi) * log2(1 - pi) ELSE 0 END) AS hi, -(pj * log2(pj) + CASE WHEN 1 - pj > 1e-12 THEN (1 - pj) * log2(1 - pj) ELSE 0 END) AS hj FROM x)
SELECT rec, state_i, state_j, round(mi, 6) AS mi_bits, round(mi / greatest(sqrt(hi * hj), 2.220446049250313e-16), 6) AS nmi FROM y""")
def g6_pairwise_information(spark, d):
    return S.pairwise_information(sequence(spark, d))


@query(f"""WITH {RUNS}, c AS (SELECT *, CASE WHEN e = 1 AND run > 1 THEN 1 ELSE 0 END AS ch FROM ru)
SELECT rec, seq, state, max(ch) OVER (PARTITION BY rec ORDER BY us, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS near FROM c""")
def w5_transition_neighbourhood(spark, d):
    return S.near_change(sequence(spark, d), 2).select("rec", "seq", "state", "near")


@query(f"""WITH {EV}, x AS (SELECT *, lag(gfp) OVER w AS l, lead(gfp) OVER w AS r, quantile_cont(gfp, 0.5) OVER (PARTITION BY rec) AS f FROM ev WINDOW w AS (PARTITION BY rec ORDER BY us, seq))
SELECT rec, seq, us, state, gfp FROM x WHERE gfp > l AND gfp >= r AND gfp >= f""")
def w1_local_maxima(spark, d):
    return S.local_maxima(sequence(spark, d), 0.5).select("rec", "seq", "us", "state", "gfp")


@query(f"""WITH {RUNS}, i AS (SELECT *, CASE WHEN max(stop_us) OVER p IS NULL OR start_us > max(stop_us) OVER p + 3600000000 THEN 1 ELSE 0 END AS nw FROM runs WINDOW p AS (PARTITION BY rec ORDER BY start_us, stop_us, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY rec ORDER BY start_us, stop_us, run ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM i)
SELECT rec, island, min(start_us) AS start_us, max(stop_us) AS stop_us, count(*) AS n FROM j GROUP BY rec, island""")
def w9_merge_intervals(spark, d):
    return S.merged_intervals(S.runs(sequence(spark, d)), 3_600_000_000)


@query(f"""WITH {EV} SELECT rec, seq, round((us - lag(us) OVER w) / 1e6, 6) AS rr_prev, round((lead(us) OVER w - us) / 1e6, 6) AS rr_next FROM ev WHERE state = 'click' WINDOW w AS (PARTITION BY rec ORDER BY us, seq)""")
def w14_beat_intervals(spark, d):
    return S.beats(sequence(spark, d), "click").select("rec", "seq", F.round("rr_prev", 6).alias("rr_prev"), F.round("rr_next", 6).alias("rr_next"))


@query(f"WITH {PHASE} SELECT rec, seq, round(phase, 6) AS phase FROM ph")
def j8_asof_phase(spark, d):
    return S.phase(sequence(spark, d), "click").select("rec", "seq", F.round("phase", 6).alias("phase"))


@query(f"""WITH {EV}, b AS (SELECT *, CASE WHEN state = 'click' THEN us END AS mk FROM ev WHERE state IN ('click', 'purchase')),
n AS (SELECT *, last_value(mk IGNORE NULLS) OVER (PARTITION BY rec ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS l, first_value(mk IGNORE NULLS) OVER (PARTITION BY rec ORDER BY us, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM b),
h AS (SELECT *, CASE WHEN r IS NULL OR us - l <= r - us THEN l ELSE r END AS hit_us FROM n WHERE state = 'purchase')
SELECT rec, seq, us, hit_us, round((us - hit_us) / 1e6, 6) AS delay_s FROM h WHERE abs(us - hit_us) <= 86400000000""")
def j9_nearest_event(spark, d):
    return S.nearest(sequence(spark, d), "purchase", "click", 86_400).withColumn("delay_s", F.round("delay_s", 6))


@query(f"""WITH {EV}, p AS (SELECT e.rec, e.seq, e.state, c.us AS centre_us FROM ev e JOIN ev c ON e.rec = c.rec AND c.state = 'click' AND e.us >= c.us + 3600000000 AND e.us < c.us + 86400000000)
SELECT rec, state, count(*) AS n, count(DISTINCT seq) AS n_samples FROM p GROUP BY rec, state""")
def j10_interval_join(spark, d):
    ev = sequence(spark, d)
    return S.within(ev, ev.where("state = 'click'"), 3600, 86_400).groupBy("rec", "state").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("n_samples"))


@query(f"""WITH {PHASE}, mm AS (SELECT state, count(*) AS n, avg(cos(phase)) AS c1, avg(sin(phase)) AS s1, avg(cos(2 * phase)) AS c2, avg(sin(2 * phase)) AS s2 FROM ph GROUP BY state)
SELECT state, n, round(c1, 6) AS cos1, round(s1, 6) AS sin1, round(c2, 6) AS cos2, round(s2, 6) AS sin2, round(sqrt(c1 * c1 + s1 * s1), 6) AS resultant, round(CASE WHEN atan2(s1, c1) < 0 THEN atan2(s1, c1) + 2 * pi() ELSE atan2(s1, c1) END, 6) AS mean_phase FROM mm""")
def g9_circular_moments(spark, d):
    return S.circular(S.phase(sequence(spark, d), "click"), ["state"])


@query(f"""WITH {PHASE}, b AS (SELECT *, CAST(least(floor(phase / (2 * pi()) * 24), 23) AS INTEGER) AS bin FROM ph), c AS (SELECT bin, state, count(*) AS n, round(avg(gfp) + 1e-9, 6) AS mean_gfp FROM b GROUP BY bin, state)
SELECT bin, state, n, mean_gfp, round(n / sum(n) OVER (PARTITION BY bin), 6) AS coverage FROM c""")
def g10_phase_bins(spark, d):
    return S.phase_bins(S.phase(sequence(spark, d), "click"), 24, []).withColumn("mean_gfp", F.round(F.col("mean_gfp") + UP, 6))


@query(f"""WITH {EV}, p AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY us, seq) AS pos FROM ev), m AS (SELECT *, CASE WHEN state = 'click' OR gfp > 150 THEN pos END AS mp, CASE WHEN state = 'click' OR gfp > 150 THEN state END AS ms FROM p),
f AS (SELECT *, last_value(mp IGNORE NULLS) OVER b AS lp, last_value(ms IGNORE NULLS) OVER b AS ls, first_value(mp IGNORE NULLS) OVER a AS rp, first_value(ms IGNORE NULLS) OVER a AS rs FROM m
 WINDOW b AS (PARTITION BY rec ORDER BY us, seq ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY rec ORDER BY us, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT rec, seq, CASE WHEN rp IS NULL OR (lp IS NOT NULL AND pos <= floor((lp + rp) / 2)) THEN ls ELSE rs END AS filled FROM f""")
def w4_fill_from_peaks(spark, d):
    return S.fill_from_peaks(sequence(spark, d), (F.col("state") == "click") | (F.col("gfp") > 150)).select("rec", "seq", "filled")


@query(f"""WITH {PHASE}, b AS (SELECT state, CAST(least(floor(phase / (2 * pi()) * 24), 23) AS INTEGER) AS bin, gfp FROM ph), a AS (SELECT state, bin, round(avg(gfp) + 1e-9, 6) AS m FROM b GROUP BY state, bin),
f AS (SELECT *, bin - row_number() OVER (PARTITION BY state ORDER BY bin) AS island FROM a WHERE m > 50) SELECT state, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS n_bins, max(abs(m)) AS peak FROM f GROUP BY state, island""")
def w16_bin_clusters(spark, d):
    return S.adjacent_clusters(g10_phase_bins(spark, d), F.col("mean_gfp") > 50, ["state"], "bin", "mean_gfp")


@query(f"""WITH {RUNS}, p AS (SELECT rec, state, sum(n) AS n, sum(gfp_mean * n) / sum(n) AS g FROM runs GROUP BY rec, state)
SELECT state, count(*) AS n_records, round(avg(n), 6) AS mean_n, round(avg(g), 6) AS mean_gfp FROM p GROUP BY state""")
def g14_two_level_means(spark, d):
    per = sequence(spark, d).groupBy("rec", "state").agg(F.count(F.lit(1)).alias("n"), F.avg("gfp").alias("g"))
    return per.groupBy("state").agg(F.count(F.lit(1)).alias("n_records"), F.round(F.avg("n"), 6).alias("mean_n"), F.round(F.avg("g"), 6).alias("mean_gfp"))


@query(f"""WITH {EV}, x AS (SELECT rec, median(gfp) AS med, quantile_cont(gfp, 0.9) AS q, count(*) AS n FROM ev GROUP BY rec), y AS (SELECT ev.*, med, q, n, abs(gfp - med) AS dev FROM ev JOIN x USING (rec)), z AS (SELECT rec, median(dev) AS mad FROM y GROUP BY rec),
t AS (SELECT y.rec, seq, gfp, CASE WHEN n >= 5 THEN CASE WHEN mad > 2.220446049250313e-16 THEN med + 1.4826 * mad ELSE q END END AS threshold FROM y JOIN z ON y.rec = z.rec)
SELECT rec, seq, round(threshold, 6) AS threshold, coalesce(gfp <= threshold, true) OR sum(CAST(coalesce(gfp <= threshold, true) AS INTEGER)) OVER (PARTITION BY rec) < 5 AS keep FROM t""")
def g11_mad_outliers(spark, d):
    out = S.upper_outliers(sequence(spark, d), ["rec"], "gfp", 1.0, 0.9)
    return out.select("rec", "seq", F.round("threshold", 6).alias("threshold"), "keep")


@query(f"""WITH {EV}, r AS (SELECT rec, min(us) AS a FROM ev GROUP BY rec), o AS (SELECT ev.*, row_number() OVER (PARTITION BY rec ORDER BY us, seq) AS pos FROM ev), st AS (SELECT DISTINCT state FROM ev), md AS (SELECT unnest(['hard', 'mixture']) AS mode),
w AS (SELECT rec, mode, st.state, pos, gfp, CASE WHEN mode = 'hard' THEN CAST(o.state = st.state AS DOUBLE) WHEN o.state = st.state THEN 0.75 WHEN st.state = 'view' AND o.state <> 'view' THEN 0.25 ELSE 0 END AS w, o.state = st.state AS assigned FROM o, st, md),
e AS (SELECT *, assigned AND NOT coalesce(lag(assigned) OVER (PARTITION BY rec, mode, state ORDER BY pos), false) AS en FROM w), s AS (SELECT rec, mode, state, count(*) AS n_samples, sum(w) AS sw, sum(w * gfp) AS sg, avg(CAST(assigned AS INTEGER)) AS sa, count(*) FILTER (en) AS se FROM e GROUP BY ALL)
SELECT rec, mode, state, n_samples, CASE WHEN sw > 0 THEN round(sw / n_samples, 6) END AS occupancy, CASE WHEN sw > 0 THEN round(100 * sa, 6) END AS percentage_present, CASE WHEN sw > 0 THEN round(sg / sw, 6) END AS mean_gfp, CASE WHEN sw > 0 THEN se END AS occurrences, CASE WHEN sw > 0 THEN round(se / (n_samples / 250.0), 6) END AS rate_hz FROM s""")
def g2_backfit_metrics(spark, d):
    ev = sequence(spark, d)
    states, modes = ev.select(F.col("state").alias("k")).distinct(), spark.createDataFrame([("hard",), ("mixture",)], "mode string")
    rows = ev.crossJoin(F.broadcast(states)).crossJoin(F.broadcast(modes))  # a few states, two modes
    own = F.col("state") == F.col("k")
    soft = F.when(own, 0.75).when((F.col("k") == "view") & (F.col("state") != "view"), 0.25).otherwise(0.0)
    rows = rows.select("rec", "mode", "us", "seq", F.col("k").alias("state"), "gfp", own.alias("assigned"), F.when(F.col("mode") == "hard", own.cast("double")).otherwise(soft).alias("w"))
    out = S.backfit_metrics(rows, 250.0, ["rec", "mode"], ["us", "seq"])
    return out.select("rec", "mode", "state", "n_samples", *[F.round(c, 6).alias(c) for c in ("occupancy", "percentage_present", "mean_gfp")], "occurrences", F.round("rate_hz", 6).alias("rate_hz"))


@query(f"""WITH {PHASE}, n AS (SELECT rec, count(*) AS n FROM ph GROUP BY rec), s AS (SELECT rec, state, count(*) AS m, sum(cos(phase)) AS c1, sum(sin(phase)) AS s1, sum(cos(2 * phase)) AS c2, sum(sin(2 * phase)) AS s2, avg(gfp * cos(phase)) AS g1, avg(gfp * sin(phase)) AS h1 FROM ph GROUP BY ALL)
SELECT s.rec, state, n AS n_phase_samples, round(m / n, 6) AS coverage, round(c1 / n, 6) AS cos1, round(s1 / n, 6) AS sin1, round(c2 / n, 6) AS cos2, round(s2 / n, 6) AS sin2, round(sqrt(c1 * c1 + s1 * s1) / n, 6) AS resultant, round(CASE WHEN atan2(s1, c1) < 0 THEN atan2(s1, c1) + 2 * pi() ELSE atan2(s1, c1) END, 5) AS mean_phase, round(g1 + 1e-9, 5) AS gfp_cos1, round(h1 + 1e-9, 5) AS gfp_sin1 FROM s JOIN n ON s.rec = n.rec""")
def g9_circular_states(spark, d):
    out = S.circular_states(S.phase(sequence(spark, d), "click"))
    return out.withColumns({c: F.round(F.col(c) + UP, 5) for c in ("gfp_cos1", "gfp_sin1")})


@query(f"""WITH {PHASE.replace("phase FROM ph0", "phase, r0, r1 FROM ph0")} SELECT rec, r0, round(avg(CASE WHEN state = 'view' THEN 1.0 ELSE 0 END) FILTER (us - r0 >= 36000000000 AND us - r0 < 720000000000), 6) AS early, round(avg(CASE WHEN state = 'view' THEN 1.0 ELSE 0 END) FILTER (NOT (us - r0 >= 36000000000 AND us - r0 < 720000000000)), 6) AS late FROM ph GROUP BY rec, r0""")
def j10_period_shares(spark, d):
    out = S.period_shares(S.phase(sequence(spark, d), "click"), "view", (36_000.0, 720_000.0))
    return out.select("rec", "r0", F.round("early", 6).alias("early"), F.round("late", 6).alias("late"))


@query(f"""WITH {EV}, b AS (SELECT *, CASE WHEN state = 'click' THEN us END AS mk FROM ev WHERE state IN ('click', 'purchase')),
n AS (SELECT *, last_value(mk IGNORE NULLS) OVER (PARTITION BY rec ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS l, first_value(mk IGNORE NULLS) OVER (PARTITION BY rec ORDER BY us, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM b),
h AS (SELECT *, CASE WHEN r IS NULL OR us - l <= r - us THEN l ELSE r END AS hit_us FROM n WHERE state = 'purchase'), k AS (SELECT *, row_number() OVER (PARTITION BY rec, hit_us ORDER BY abs(us - hit_us), us, seq) AS q FROM h WHERE abs(us - hit_us) <= 864000000000) SELECT rec, seq, us, hit_us, round((us - hit_us) / 1e6, 6) AS delay_s FROM k WHERE q = 1""")
def j9_best_event(spark, d):
    return S.nearest(sequence(spark, d), "purchase", "click", 864_000, best=True).withColumn("delay_s", F.round("delay_s", 6))


@query(f"""WITH {EV}, c AS (SELECT rec, seq, us, round((us - lag(us) OVER w) / 1e6, 6) AS rr_prev, round((lead(us) OVER w - us) / 1e6, 6) AS rr_next FROM ev WHERE state = 'click' WINDOW w AS (PARTITION BY rec ORDER BY us, seq)) SELECT rec, seq, rr_prev, rr_next FROM c WHERE rr_prev BETWEEN 3600 AND 864000 AND rr_next BETWEEN 3600 AND 864000""")
def w14_plausible_beats(spark, d):
    out = S.beats(sequence(spark, d), "click", limits_s=(3600.0, 864_000.0))
    return out.select("rec", "seq", F.round("rr_prev", 6).alias("rr_prev"), F.round("rr_next", 6).alias("rr_next"))


@query(f"""WITH {EV}, x AS (SELECT *, lag(gfp) OVER w AS l, lead(gfp) OVER w AS r FROM ev WINDOW w AS (PARTITION BY rec ORDER BY us, seq)), f AS (SELECT rec, quantile_cont(gfp, 0.9) AS a, quantile_cont(gfp, 0.6) AS b, quantile_cont(gfp, 0.2) AS c FROM ev GROUP BY rec), t AS (SELECT x.*, a, b, c FROM x JOIN f ON x.rec = f.rec WHERE gfp > l AND gfp >= r),
n AS (SELECT rec, count(*) FILTER (gfp >= a) AS na, count(*) FILTER (gfp >= b) AS nb, count(*) FILTER (gfp >= c) AS nc FROM t GROUP BY rec) SELECT t.rec, seq, gfp FROM t JOIN n ON t.rec = n.rec WHERE gfp >= CASE WHEN na >= 6 THEN a WHEN nb >= 6 THEN b WHEN nc >= 6 THEN c WHEN nc > 0 THEN c WHEN nb > 0 THEN b ELSE a END""")
def w1_peak_schedule(spark, d):
    return S.local_maxima(sequence(spark, d), [0.9, 0.6, 0.2], 6).select("rec", "seq", "gfp")


@query(f"""WITH {EV}, i0 AS (SELECT rec, us AS a, us + 360000000000 AS b, seq FROM ev WHERE state = 'click'), i1 AS (SELECT *, CASE WHEN max(b) OVER p IS NULL OR a > max(b) OVER p THEN 1 ELSE 0 END AS nw FROM i0 WINDOW p AS (PARTITION BY rec ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i2 AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM i1), iv AS (SELECT rec, g, min(a) AS a, max(b) AS b FROM i2 GROUP BY rec, g) SELECT ev.rec, seq, row_number() OVER (PARTITION BY ev.rec ORDER BY us, seq) - 1 AS pos FROM ev JOIN iv ON ev.rec = iv.rec AND us BETWEEN a AND b""")
def s16_cropped_intervals(spark, d):
    ev = sequence(spark, d)
    spans = ev.where("state = 'click'").select("rec", F.col("us").alias("start_us"), (F.col("us") + 360_000_000_000).alias("stop_us"))
    return S.cropped(ev, S.merged_intervals(spans, 0)).select("rec", "seq", F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {EV}, g AS (SELECT rec, us, (us - lag(us) OVER (PARTITION BY rec ORDER BY us)) / 1e6 AS gap FROM ev WHERE state = 'click'), m AS (SELECT rec, count(*) AS n, median(gap) AS md FROM g GROUP BY rec) SELECT rec, n, round(md + 1e-9, 6) AS median_s FROM m WHERE n >= 5 AND md BETWEEN 10000 AND 200000""")
def s17_plausible_trains(spark, d):
    return S.plausible_trains(sequence(spark, d).where("state = 'click'"), 10_000.0, 200_000.0).withColumn("median_s", F.round(F.col("median_s") + UP, 6))


@query(f"""WITH {EV}, x AS (SELECT rec, seq, CASE WHEN rec % 2 = 0 THEN 'intero' ELSE 'feedback' END AS cond, CASE WHEN rec % 3 = 0 THEN 'code 10' || (seq % 8) ELSE 'HBT_' || substr('abcd', CAST(seq % 4 + 1 AS INTEGER), 1) || (seq % 3) END AS dsc FROM ev), m(cond, mk, pf) AS (VALUES ('intero', 'HBT_b1', true), ('intero', 'HBT_b2', true), ('feedback', 'HBT_c', true), ('intero', '103', false), ('intero', '104', false), ('feedback', '105', false)),
j AS (SELECT rec, seq, cond, dsc, pf FROM x JOIN m USING (cond) WHERE contains(dsc, mk)), b AS (SELECT rec, max(CAST(pf AS INTEGER)) AS p FROM j GROUP BY rec) SELECT DISTINCT j.rec, seq, cond AS condition, dsc AS description FROM j JOIN b ON j.rec = b.rec AND CAST(pf AS INTEGER) = p""")
def s18_marker_events(spark, d):
    ev, seq = sequence(spark, d), F.col("seq")
    code = F.concat(F.lit("code 10"), (seq % 8).cast("string"))
    tap = F.concat(F.lit("HBT_"), F.substring(F.lit("abcd"), (seq % 4 + 1).cast("int"), F.lit(1)), (seq % 3).cast("string"))
    rows = ev.select("rec", "seq", F.when(F.col("rec") % 2 == 0, "intero").otherwise("feedback").alias("condition"), F.when(F.col("rec") % 3 == 0, code).otherwise(tap).alias("description"))
    markers = [("intero", "HBT_b1", True), ("intero", "HBT_b2", True), ("feedback", "HBT_c", True), ("intero", "103", False), ("intero", "104", False), ("feedback", "105", False)]
    return S.marker_events(rows, spark.createDataFrame(markers, "condition string, marker string, preferred boolean"))
