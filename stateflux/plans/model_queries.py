"""Fits, resampling, regressions and signals on the provided tables. SQL cannot express them: tests hold each against a definition, an enumeration or planted states."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stateflux.operators import arrays as A
from stateflux.operators import backfit as B
from stateflux.operators import clustering as C
from stateflux.operators import fits as M
from stateflux.operators import regression as R
from stateflux.operators import resampling as P
from stateflux.operators import sequences as S
from stateflux.operators import signals as G
from stateflux.plans.registry import query
from stateflux.plans.table_queries import _centres
from stateflux.sources.files import templates
from stateflux.sources.tables import maps, sequence, table

KS = [3, 4, 5]


def _signal(spark, d):
    """Events as a signal: a record for each user, positions in order of time, eight channels of phases of the value."""
    pos = F.row_number().over(S._over("rec")) - 1
    channels = F.array(*[F.sin(F.col("gfp") / 20.0 + 0.7 * c) * (1 + c / 4.0) for c in range(8)])
    return sequence(spark, d).withColumn("pos", pos).withColumn("v", channels)


def _fit(method):
    def run(spark, d):
        fits = C.fitted(maps(spark, d).withColumn("half", F.col("id") % 2), ["half"], KS, method, restarts=5)
        return C.model_comparison(fits, ["half"])

    return run


@query()
def m1_mixture_states(spark, d):
    return _fit("spm_vb")(spark, d)


@query()
def m2_modified_kmeans(spark, d):
    return _fit("koenig")(spark, d)


@query()
def m3_seeded_kmeans(spark, d):
    return _fit("spm_kmeans")(spark, d)


@query()
def m4_topographic_kmeans(spark, d):
    return _fit("topo_kmeans")(spark, d)


@query()
def m4_scaled_kmeans(spark, d):
    return C.fitted(maps(spark, d), [], [4], restarts=1).select(F.col("state").alias("k"), F.col("map").alias("centre"), "gev")


@query("""WITH x AS (SELECT label AS grp, vec_id AS id, vec_id % 5 + 1 AS gfp FROM embeddings), w AS (SELECT grp, count(*) AS n, sum(gfp * gfp) AS weight, count(*) FILTER (id < 14) AS priors FROM x GROUP BY grp)
SELECT grp, n + 3 * priors AS n_maps, round(CAST(weight AS DOUBLE) * CASE WHEN priors > 0 THEN 1.25 ELSE 1 END, 6) AS weight FROM w""")
def m6_priors(spark, d):
    x = maps(spark, d).withColumn("gfp", (F.col("id") % 5 + 1).cast("double"))
    priors = x.where("id < 14").select("grp", "map")
    return M.with_priors(x.select("grp", "map", "gfp"), priors, ["grp"], 3, 0.25).groupBy("grp").agg(F.count(F.lit(1)).alias("n_maps"), F.round(F.sum(F.col("gfp") * F.col("gfp")), 6).alias("weight"))


@query()
def m7_hierarchy(spark, d):
    x = maps(spark, d).select("id", "map", (F.col("grp") % 2).alias("grp"), (F.col("id") % 3).alias("condition"), (F.col("id") % 6).alias("participant"), F.lit(1.0).alias("gfp"))
    return C.hierarchy(x, 4, [["grp"], ["condition"], ["grp", "participant"], ["grp", "participant", "condition"]], restarts=5)


@query()
def m5_completed_models(spark, d):
    """Models of too few states, from the given maps, brought to five."""
    x = maps(spark, d).withColumn("half", F.col("id") % 2)
    first = x.where("id < 6").select("half", F.floor(F.col("id") / 2).cast("int").alias("state"), "map")
    return C.completed(x, first, ["half"], 5).select("half", "state", F.transform("map", lambda v: F.round(v, 6)).alias("map"))


@query()
def m5_collapsed_models(spark, d):
    x = maps(spark, d).withColumn("half", F.col("id") % 2)
    first = x.where("id < 12").select("half", F.floor(F.col("id") / 2).cast("int").alias("state"), "map")
    return C.collapsed(x, first, ["half"], 0.2).select("half", "state", "root", F.transform("map", lambda v: F.round(v, 6)).alias("map"))


@query()
def m7_meta_states(spark, d):
    """Of each condition, the states of a bank of all its participants' states, and how many of these are of each."""
    x = maps(spark, d).select("id", "map", (F.col("id") % 3).alias("condition"), (F.col("id") % 6).alias("participant"), F.lit(1.0).alias("gfp"))
    keys = ["condition", "participant"]
    banked = C.bank(C.hierarchy(x, 4, [["condition"], keys], restarts=2).where("level = 'condition|participant'"), keys)
    meta = C.fitted(banked, ["condition"], [4], restarts=2, gfp="gfp")
    return C.labelled(banked, meta, ["condition"], gfp="gfp").groupBy("condition", "state").agg(F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("similarity"))


@query()
def m9_template_alignment(spark, d):
    fits = C.fitted(maps(spark, d).withColumn("half", F.col("id") % 2), ["half"], [4], restarts=5)
    return M.template_alignment(fits, templates(_centres(spark, d).select(F.col("k").alias("state"), F.col("centre").alias("map"))), ["half"])


@query()
def j12_assignment(spark, d):
    x = A.assigned(maps(spark, d), _centres(spark, d)).groupBy("grp", "k").agg(F.sum(F.abs("corr")).alias("similarity"))
    return M.matched(x.withColumn("fold", F.col("k") * 0), ["fold"], "grp", "k")


@query()
def g24_recovery(spark, d):
    fits = C.fitted(maps(spark, d).withColumn("half", F.col("id") % 2), ["half"], KS, restarts=5)
    truth = _centres(spark, d)
    sims = fits.crossJoin(F.broadcast(truth.select(F.col("k").alias("j"), "centre"))).select("half", "k", F.col("state").alias("i"), "j", F.abs(A.dot(A.unit(F.col("map")), A.unit(F.col("centre")))).alias("similarity"))  # seven states
    sizes = fits.groupBy("half", "k").agg(F.count(F.lit(1)).alias("k_est")).withColumn("k_true", F.lit(7))
    return M.recovery(M.matched(sims, ["half", "k"]), sizes, ["half", "k"])


@query()
def g26_identity_accuracy(spark, d):
    aligned = m9_template_alignment(spark, d).select("half", "state", "label", "corr")
    pairs = aligned.select("half", F.col("label").alias("label_true"), F.when(F.col("state") % 2 == 0, F.col("label")).otherwise("X").alias("label_est"), F.col("corr").alias("similarity"))
    sizes = aligned.groupBy("half").agg(F.count(F.lit(1)).alias("k_est")).withColumn("k_true", F.lit(7))
    return B.identity_accuracy(pairs, sizes, ["half"])


@query()
def m12_transition_weights(spark, d):
    centres = _centres(spark, d).select("k", F.slice("centre", 1, 8).alias("centre"))
    rows = B.hard(_signal(spark, d), centres)
    out = B.transition_aware(rows, centres, rate=250.0, peak=F.col("state") == "click")
    return out.select("rec", "pos", "k", "mixed", F.transform("weights", lambda x: F.round(x, 6)).alias("weights"))


@query()
def a13_components(spark, d):
    rows = maps(spark, d)
    mean, axes, shares, _ = M.principal_components(rows, share=0.999, most=8)
    return M.scores(rows, mean, axes).select("id", F.transform("scores", lambda x: F.round(x, 6)).alias("scores"), F.lit(round(float(shares.sum()), 6)).alias("explained"))


@query()
def a15_rank(spark, d):
    *_, rank = M.principal_components(maps(spark, d))
    return spark.createDataFrame([(rank,)], "rank int")


@query()
def a16_principal_centres(spark, d):
    x = A.assigned(maps(spark, d), _centres(spark, d)).select("k", A.unit(F.col("map")).alias("map"))
    return M.principal_centres(x).select("k", "n_maps", F.transform("centre", lambda x: F.round(x, 6)).alias("centre"))


@query()
def a18_feature_components(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).alias("n"))
    scores, _ = M.feature_components(x, [c for c in x.columns if c != "o_custkey"], "o_custkey")
    return scores


@query()
def g8_axis_dynamics(spark, d):
    centres = _centres(spark, d).select("k", F.slice("centre", 1, 8).alias("centre"))
    rows = B.hard(_signal(spark, d), centres).withColumnRenamed("v", "map")
    return S.axis_dynamics(rows, centres, 250.0)


def _long(spark, d):
    return _signal(spark, d).select("rec", "pos", F.posexplode("v").alias("ch", "x"))


@query()
def a5_band_pass(spark, d):
    return G.filtered(_long(spark, d), 100.0, 2.0, 20.0)


@query()
def a6_butterworth(spark, d):
    return G.filtered(_long(spark, d), 100.0, 8.0, 20.0, "butterworth")


@query()
def a22_welch_spectra(spark, d):
    return G.spectra(_signal(spark, d), 100.0, [float(f) for f in range(2, 46)], 0.5)


@query()
def m13_spectral_parameters(spark, d):
    return G.spectral_parameters(G.mean_spectra(a22_welch_spectra(spark, d).withColumn("grp", F.col("rec") % 5), ["grp"]), ["grp"])


def _improvements(spark, d):
    side = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    x = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("metric"), "l_suppkey").agg((side("O") - side("F")).alias("improvement"))
    return x.where("improvement is not null")


@query()
def t1_bootstrap_and_sign_flips(spark, d):
    return P.paired_tests(_improvements(spark, d), ["metric"], "improvement", "l_suppkey", draws=2000, boots=1000)


def _design(spark, d):
    x = maps(spark, d).select((F.col("id") % 40).alias("unit"), F.concat(F.lit("g"), (F.col("id") % 2).cast("string")).alias("grp"), F.concat(F.lit("c"), (F.floor(F.col("id") / 40) % 2).cast("string")).alias("condition"), (F.floor(F.col("id") / 80) % 3).cast("int").alias("state"), F.slice("map", 1, 16).alias("map")).where("state is not null")
    means = A.mean_map(x, ["unit", "grp", "condition", "state"]).withColumnRenamed("mean_map", "map")
    return means


@query()
def t3_tanova(spark, d):
    return P.tanova(_design(spark, d), draws=200)


@query()
def t5_bayesian_tanova(spark, d):
    return P.tanova(_design(spark, d), draws=200, posthoc=False, bayesian=True)


def _beats(spark, d):
    x = table(spark, d, "orders")
    hit = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    return x.select((F.col("o_custkey") % 60).alias("participant"), F.concat(F.lit("s"), (F.col("o_custkey") % 2).cast("string")).alias("study"), F.col("o_orderpriority").alias("condition"), hit.alias("hit"), (F.col("o_totalprice") / 1e5).alias("coverage"), F.log(F.col("o_totalprice") + 1).alias("latency"))


@query()
def t11_mixed_model(spark, d):
    return R.modelled(_beats(spark, d), ["study"], "latency", ["condition", "hit"], "participant", "mixed")


@query()
def t12_gee(spark, d):
    rows = _beats(spark, d)
    return R.modelled(rows, ["study"], "hit", ["condition", "coverage"], "participant", "gee_binomial").unionByName(R.modelled(rows, ["study"], "latency", ["coverage"], "participant", "gee_gaussian"))


@query()
def t13_binomial_counts(spark, d):
    counts = _beats(spark, d).groupBy("study", "participant", "condition").agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("misses"), F.avg("coverage").alias("coverage"))
    return R.modelled(counts, ["study"], "hits", ["condition", "coverage"], "participant", "binomial_counts", failures="misses")


PLACED = "e AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS pos, value AS gfp FROM events)"


@query(f"""WITH RECURSIVE {PLACED}, n AS (SELECT *, lag(gfp) OVER w AS l, lead(gfp) OVER w AS r FROM e WINDOW w AS (PARTITION BY rec ORDER BY pos)),
q AS (SELECT rec, quantile_cont(gfp, 0.3) AS floor FROM e GROUP BY rec), p AS (SELECT rec, pos, gfp, row_number() OVER (PARTITION BY rec ORDER BY gfp DESC, pos) AS i FROM n JOIN q USING (rec) WHERE gfp > l AND gfp >= r AND gfp >= floor),
c(rec, i, kept) AS (SELECT rec, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM q UNION ALL SELECT c.rec, p.i, CASE WHEN len(list_filter(kept, lambda k: abs(k - p.pos) <= 3)) = 0 THEN list_append(kept, p.pos) ELSE kept END FROM c JOIN p ON p.rec = c.rec AND p.i = c.i + 1),
l AS (SELECT rec, kept FROM c QUALIFY row_number() OVER (PARTITION BY rec ORDER BY i DESC) = 1)
SELECT p.rec, p.pos, p.gfp FROM p JOIN l USING (rec) WHERE list_contains(kept, p.pos)""")
def w2_spaced_peaks(spark, d):
    rows = sequence(spark, d).withColumn("pos", F.row_number().over(S._over("rec")).cast("long"))
    return S.spaced_peaks(S.local_maxima(rows, 0.3), 3).select("rec", "pos", "gfp")


@query(f"""WITH RECURSIVE {PLACED}, m AS (SELECT rec, pos FROM e WHERE gfp > 50),
k(rec, pos) AS (SELECT rec, min(pos) FROM m GROUP BY rec UNION ALL SELECT k.rec, min(m.pos) FROM k JOIN m ON m.rec = k.rec AND m.pos > k.pos + 2 GROUP BY k.rec, k.pos)
SELECT rec, CAST(pos AS BIGINT) AS pos FROM k""")
def w15_collapsed_train(spark, d):
    rows = sequence(spark, d).withColumn("pos", F.row_number().over(S._over("rec")).cast("long"))
    return S.collapsed_train(rows.where("gfp > 50"), 2)


@query()
def m14_backfit_benchmarks(spark, d):
    """Of each record: how often every sample's own state is that of its nearest peak of field power, and how much of the samples one state, or a mixture at transitions, leaves."""
    centres = _centres(spark, d).select("k", F.slice("centre", 1, 8).alias("centre"))
    power, over = A.gfp_rms(F.col("v")), S._over("rec", ("pos",))
    rows = _signal(spark, d).withColumn("power", power)
    rows = rows.withColumn("peak", F.coalesce((F.col("power") > F.lag("power").over(over)) & (F.col("power") >= F.lead("power").over(over)), F.lit(False)))
    every = B.hard(rows, centres)
    nearest = B.hard(rows, centres, peak=F.col("peak")).select("rec", "pos", F.col("k").alias("k_peak"))
    both = B.transition_aware(every, centres, 250.0, peak=F.col("peak")).withColumnRenamed("weights", "soft").join(nearest, ["rec", "pos"])
    one = F.element_at("soft", F.col("k") + 1)
    return both.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("k") == F.col("k_peak")).cast("double")).alias("agreement"), F.avg(F.col("mixed").cast("double")).alias("mixed"), F.avg(one).alias("weight_of_own_state"))


@query()
def s14_equalised_signals(spark, d):
    return G.equalised(_signal(spark, d), 100.0, 64.0)
