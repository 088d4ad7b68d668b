"""Queries that parse identifiers, labels and numbers, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stateflux.functions import geometry as G
from stateflux.functions import text as X
from stateflux.operators import tables as T
from stateflux.plans.registry import query
from stateflux.sources.files import state_maps
from stateflux.sources.tables import table


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _picked(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], key: str) -> str:
    return f"list_extract({_sql_list(values)}, CAST({key} % {len(values)} + 1 AS INTEGER))"


PATHS = ["a/sub-1_EC.set", "x/rest_eyesopen.fif", "closed/run.edf", "suj_01_intero_fb.csv", "heppy/suj_2_HBT_c.csv", "b/extero.csv", "interoception/suj_3.csv", "intero_1.csv", "raw/suj_003_pp_raw.fif", "a_Full.fif", "rest.set", "sub-2_EO.closed.set"]
WORDS = ["EC", " eyes-closed ", "Eye Open", "OPEN", "closed", "rest 1", "", "E.O."]


@query(rf"""WITH x AS (SELECT page_id, {_pick_sql(PATHS, "page_id")} AS path, {_pick_sql(WORDS, "page_id")} AS word FROM pages),
y AS (SELECT *, upper(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '')) AS stem, lower(regexp_extract(path, '([^/]*)$', 1)) AS name, trim(regexp_replace(lower(trim(word)), '[^a-z0-9]+', '_', 'g'), '_') AS k FROM x)
SELECT page_id, CASE WHEN contains(stem, '_EC') OR contains(stem, 'CLOSED') THEN 'EC' WHEN contains(stem, '_EO') OR contains(stem, 'OPEN') THEN 'EO' ELSE 'condition' END AS eyes,
 CASE WHEN regexp_matches(name, 'intero_fb|intero-fb|interofb') THEN 'intero_fb' WHEN regexp_matches(name, 'feedback|hbt_c') THEN 'feedback' WHEN contains(name, 'extero') THEN 'extero' WHEN contains(name, 'intero') THEN 'intero' WHEN contains(name, 'full') OR regexp_matches(name, '^suj_\d+_pp_raw\.fif$') THEN 'full' ELSE 'unknown' END AS task,
 CASE WHEN k IN ('ec', 'eyes_closed', 'eye_closed', 'closed') THEN 'EC' WHEN k IN ('eo', 'eyes_open', 'eye_open', 'open') THEN 'EO' ELSE trim(word) END AS condition FROM y""")
def p2_conditions(spark, d):
    path, word = _picked(PATHS, F.col("page_id")), _picked(WORDS, F.col("page_id"))
    return table(spark, d, "pages").select("page_id", X.eyes_from_path(path).alias("eyes"), X.task_from_path(path).alias("task"), X.condition(word).alias("condition"))


@query("SELECT s_suppkey AS participant, s_name AS name, s_acctbal AS balance, 'all' AS grp FROM supplier")
def p3_header_aliases(spark, d):
    s = table(spark, d, "supplier").withColumnsRenamed({"s_suppkey": "Subject ID", "s_name": "S-Name", "s_acctbal": "Acct.Bal"})
    return X.aliased(s, {"participant": ["participant", "subject_id"], "name": ["sname"], "balance": ["balance", "acct_bal"], "grp": ["group", "cohort"]}, {"grp": "all"})


LABELS = ["EEG channel 007", "00a1", "Chan-Fz ", "EEG 000", "eegchannelchanC3", "Fp1-Ref", " channel 12", "T7/T3"]
STATES = ["MS_A", "state B", "Microstate C", "ms", "MS-State_D", " e ", "STATE", "MSSTATE1"]


@query(rf"""WITH x AS (SELECT s_suppkey, {_pick_sql(LABELS, "s_suppkey")} AS l, {_pick_sql(STATES, "s_suppkey")} AS s, s_name FROM supplier),
y AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(l), '\s+', '', 'g'), '^eeg', ''), '^channel', ''), '^chan', ''), '[^a-z0-9]', '', 'g') AS c, regexp_replace(upper(trim(s)), '[^A-Z0-9]+', '', 'g') AS t FROM x),
z AS (SELECT *, CASE WHEN starts_with(t, 'MS') AND length(t) > 2 THEN substr(t, 3) ELSE t END AS u FROM y)
SELECT s_suppkey, CASE WHEN regexp_full_match(c, '[0-9]+') THEN coalesce(nullif(regexp_replace(c, '^0+', ''), ''), '0') ELSE c END AS channel, CASE WHEN starts_with(u, 'STATE') THEN replace(u, 'STATE', '') ELSE u END AS state,
 coalesce(nullif(trim(regexp_replace(lower(trim(l)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unnamed') AS slug, trim(regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g'), '_') AS ident FROM z""")
def p4_labels(spark, d):
    label, state = _picked(LABELS, F.col("s_suppkey")), _picked(STATES, F.col("s_suppkey"))
    return table(spark, d, "supplier").select("s_suppkey", X.channel(label).alias("channel"), X.state_name(state).alias("state"), X.slug(label).alias("slug"), X.identifier(F.col("s_name")).alias("ident"))


METHODS = ["SPM_VB ", "kmeans_koenig", "Koenig-kmeans v2", "standard  kmeans", "kmeans-standard", "other_one", ""]
CRITERIA = ["elbow", "GFP", "global_explained_variance", "free-energy elbow_sil", "silhouette_only", "covariance_raw", "CH", "calinski_harabasz", "bic", "free energy"]


@query(rf"""WITH x AS (SELECT p_partkey, trim(lower({_pick_sql(METHODS, "p_partkey")})) AS m0, trim(lower({_pick_sql(CRITERIA, "p_partkey")})) AS c0 FROM part),
y AS (SELECT p_partkey, regexp_replace(regexp_replace(m0, '[_-]', ' ', 'g'), '\s+', ' ', 'g') AS m, regexp_replace(regexp_replace(c0, '[_-]', ' ', 'g'), '\s+', ' ', 'g') AS c FROM x)
SELECT p_partkey, m AS token, CASE WHEN contains(m, 'spm vb') THEN 'spm vb' WHEN regexp_matches(m, 'kmeans koenig|koenig kmeans') THEN 'koenig kmeans' WHEN regexp_matches(m, 'standard kmeans|kmeans standard') THEN 'standard kmeans' ELSE m END AS method,
 CASE WHEN contains(c, 'elbow sil') THEN 'elbow sil combined' WHEN c IN ('elbow', 'free energy elbow only') THEN 'free energy elbow' WHEN c IN ('gfp', 'global field power', 'global explained variance') THEN 'gev' WHEN c = 'silhouette only' THEN 'silhouette'
 WHEN c IN ('covariance raw', 'covariance min') THEN 'covariance' WHEN c IN ('calinski harabasz', 'ch') THEN 'calinski harabasz score' ELSE c END AS criterion FROM y""")
def p6_methods_and_criteria(spark, d):
    m, c = _picked(METHODS, F.col("p_partkey")), _picked(CRITERIA, F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", X.token(m).alias("token"), X.method(m).alias("method"), X.criterion(c).alias("criterion"))


NAMES = ["Anxiety", "non-anxious control", "", "HTN", "Hypertensive", "NON HTN", "unknown", "Other group"]


@query(rf"""WITH x AS (SELECT c_custkey, {_pick_sql(NAMES, "c_custkey")} AS g, c_custkey % 1000 AS n FROM customer),
y AS (SELECT *, regexp_replace(upper(trim(g)), '[^A-Z0-9]+', '', 'g') AS k, CASE WHEN n >= 1 AND n < 100 THEN 'ANX' WHEN n >= 100 AND n < 200 THEN 'NANX' WHEN n >= 700 AND n < 800 THEN 'HTN' WHEN n >= 800 AND n < 900 THEN 'NHTN' ELSE 'unknown' END AS r FROM x),
z AS (SELECT *, CASE WHEN k IN ('', 'NAN', 'NONE', 'UNKNOWN') THEN r WHEN k IN ('ANX', 'ANXIETY', 'ANXIOUS') THEN 'ANX' WHEN k IN ('NANX', 'NONANX', 'NONANXIOUS', 'NONANXIETY', 'NONANXIOUSCONTROL') THEN 'NANX' WHEN k IN ('HTN', 'HYPERTENSION', 'HYPERTENSIVE') THEN 'HTN' WHEN k IN ('NHTN', 'NONHTN', 'NONHYPERTENSION', 'NONHYPERTENSIVE') THEN 'NHTN' ELSE trim(g) END AS grp FROM y)
SELECT c_custkey, r AS by_number, grp, CASE WHEN grp IN ('ANX', 'NANX') THEN 'ANX' WHEN grp IN ('HTN', 'NHTN') THEN 'HTN' ELSE 'unknown' END AS study FROM z""")
def p7_groups_and_studies(spark, d):
    sid = F.concat(F.lit("suj_"), (F.col("c_custkey") % 1000).cast("string"))
    group = X.group(_picked(NAMES, F.col("c_custkey")), sid)
    return table(spark, d, "customer").select("c_custkey", X.group_of_number(sid).alias("by_number"), group.alias("grp"), X.study(group).alias("study"))


NUMBERS = [">5", "1,234.5", '"7"', "NA", "n/a", "", " 3e2 ", ">=4", "<.5", "-2.", "1 2", "abc", "none"]
FLAGS = ["1", "True", '"yes"', "no", " T ", "0", "", "Y"]
NUMBER_SQL = r"""CASE WHEN regexp_full_match(trim(regexp_replace(replace(regexp_replace(trim({0}), '^"+|"+$', '', 'g'), ',', ''), '^[<>]', '')), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN TRY_CAST(trim(regexp_replace(replace(regexp_replace(trim({0}), '^"+|"+$', '', 'g'), ',', ''), '^[<>]', '')) AS DOUBLE) END"""


@query(rf"""WITH x AS (SELECT o_orderkey, {_pick_sql(NUMBERS, "o_orderkey")} AS t, {_pick_sql(FLAGS, "o_orderkey")} AS f, o_orderstatus FROM orders)
SELECT o_orderkey, {NUMBER_SQL.format("t")} AS num, lower(regexp_replace(trim(f), '^"+|"+$', '', 'g')) IN ('1', 'true', 't', 'yes', 'y') AS flag, CASE WHEN o_orderkey % 3 = 0 THEN {NUMBER_SQL.format("t")} ELSE (o_orderkey % 50 + o_orderkey % 50 + 5) / 2.0 END AS mid,
 CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE o_orderstatus END AS status FROM x""")
def p8_tolerant_parsing(spark, d):
    k = F.col("o_orderkey")
    text, low = _picked(NUMBERS, k), (k % 50).cast("string")
    bins = F.when(k % 3 == 0, text).otherwise(F.concat(low, F.lit(" - "), (k % 50 + 5).cast("string")))
    return table(spark, d, "orders").select("o_orderkey", X.number(text).alias("num"), X.flag(_picked(FLAGS, k)).alias("flag"), X.age_midpoint(bins).alias("mid"), X.filled(F.when(k % 7 == 0, F.lit(" ")).otherwise(F.col("o_orderstatus")), "unknown").alias("status"))


FIB = "fib AS (SELECT CAST(i AS INTEGER) AS idx, sqrt(greatest(0, 1 - z * z)) * cos(phi) AS x, sqrt(greatest(0, 1 - z * z)) * sin(phi) AS y, z FROM (SELECT i, 1 - 2 * (i + 0.5) / 64 AS z, 2 * pi() * (((i + 0.5) * (sqrt(5) - 1) / 2) - floor((i + 0.5) * (sqrt(5) - 1) / 2)) AS phi FROM range(64) t(i)))"
CHANNELS = ["Fz", "EOG1", "ECG", "m1", " A2 ", "Cz", "REFx", "Oz", "STI 014"]


@query(rf"""WITH {FIB}, p AS (SELECT *, {_pick_sql(CHANNELS, "idx")} AS label FROM fib)
SELECT idx, round(0.5 - degrees(atan2(z, sqrt(x * x + y * y))) / 180, 6) AS radius, NOT regexp_matches(upper(trim(label)), '^(EXG|EOG|HEOG|VEOG|ECG|EKG|EMG|GSR|RESP|TRIG|STATUS|STI|MISC|AUX|REF)') AND upper(trim(label)) NOT IN ('A1', 'A2', 'M1', 'M2', 'CB1', 'CB2', 'LM', 'RM')
 AND 0.5 - degrees(atan2(z, sqrt(x * x + y * y))) / 180 <= 0.45 AS on_scalp FROM p""")
def p11_scalp_mask(spark, d):
    xyz = [F.col(c) for c in "xyz"]
    return G.fibonacci_sphere(spark, 64).select("idx", F.round(G.head_radius(*xyz), 6).alias("radius"), G.on_scalp(_picked(CHANNELS, F.col("idx")), *xyz, limit=0.45).alias("on_scalp"))


@query(rf"""WITH {FIB}, p AS (SELECT idx, x, y, z, radians(idx * 17) AS t, (idx % 7) / 10.0 AS r FROM fib), q AS (SELECT *, r * cos(t) AS px, r * sin(t) AS py, sqrt(greatest(0, 1 - least(1, r / 0.5) * least(1, r / 0.5))) AS pz FROM p),
u AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS n FROM q)
SELECT idx, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, CASE WHEN r > 0 THEN round(px / n, 6) END AS px, CASE WHEN r > 0 THEN round(py / n, 6) END AS py, CASE WHEN r > 0 THEN round(pz / n, 6) END AS pz, round(x * cos(radians(30)) - y * sin(radians(30)), 6) AS rx, round(x * sin(radians(30)) + y * cos(radians(30)), 6) AS ry FROM u""")
def p12_positions(spark, d):
    place = G.from_polar((F.col("idx") * 17).cast("double"), (F.col("idx") % 7) / 10.0)
    rx, ry = G.rotated(F.col("x"), F.col("y"), 30)
    r = lambda c, name: F.round(c, 6).alias(name)
    return G.fibonacci_sphere(spark, 64).withColumn("p", place).select("idx", *[r(F.col(c), c) for c in "xyz"], *[r(F.col(f"p.{c}"), f"p{c}") for c in "xyz"], r(rx, "rx"), r(ry, "ry"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(l_linenumber AS INTEGER) AS t, CAST(l_quantity AS INTEGER) % 7 + 1 AS e FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, e - t AS k_signed_error, abs(e - t) AS k_abs_error, (e - t) * (e - t) AS k_sq_error, e < t AS under, e > t AS over, e = t AS correct, greatest(t - least(t, e, 4), 0) AS missed, greatest(e - least(t, e, 4), 0) AS extra FROM x""")
def p13_selection_errors(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.col("l_linenumber").cast("int").alias("k_true"), (F.col("l_quantity").cast("int") % 7 + 1).alias("k_est"))
    x = x.withColumn("m", F.least("k_true", "k_est", F.lit(4)))
    return T.selection_errors(x, matched="m").drop("k_true", "k_est", "m")


@query("""WITH x AS (SELECT p_partkey, p_retailprice AS a, CASE WHEN p_size % 5 > 0 THEN CAST(p_size % 5 AS DOUBLE) ELSE 0.0 END AS b, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS c FROM part)
SELECT p_partkey, a AS copied, round((a + b + coalesce(c, 0)) / CASE WHEN c IS NULL THEN 2 ELSE 3 END, 6) AS mean, round(a - b, 6) AS diff, round(a / nullif(b, 0), 6) AS ratio, round(c - a, 6) AS diff_null FROM x""")
def p14_score_composites(spark, d):
    a, b, c = F.col("p_retailprice"), (F.col("p_size") % 5).cast("double"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("double"))
    s = lambda vs, how: F.round(T.score(vs, how), 6)
    return table(spark, d, "part").select("p_partkey", T.score([a, b], "copy").alias("copied"), s([a, b, c], "mean").alias("mean"), s([a, b], "diff").alias("diff"), s([a, b], "ratio").alias("ratio"), s([c, a], "diff").alias("diff_null"))


@query("WITH x AS (SELECT CASE WHEN c_custkey % 6 = 0 THEN 'NA' ELSE '>' || c_custkey END AS mostly, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS half, CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE '1' END AS few FROM customer)\n" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER (trim({c}) <> '') AS filled, count({NUMBER_SQL.format(c)}) AS numbers, count({NUMBER_SQL.format(c)}) >= 0.8 * count(*) FILTER (trim({c}) <> '') AS numeric FROM x" for c in ("mostly", "name", "half", "few")))
def p15_numeric_columns(spark, d):
    k = F.col("c_custkey")
    x = table(spark, d, "customer").select(F.when(k % 6 == 0, "NA").otherwise(F.concat(F.lit(">"), k.cast("string"))).alias("mostly"), F.col("c_name").alias("name"), F.when(k % 2 == 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("half"), F.when(k % 4 == 0, "x").otherwise("1").alias("few"))
    return T.numeric_columns(x, ["mostly", "name", "half", "few"])


@query("SELECT event_id, value AS v FROM events WHERE event_id % 4 = 3")
def p16_finite_values(spark, d):
    k = F.col("event_id") % 4
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(None).cast("double")).when(k == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", v.alias("v")).where(X.finite(F.col("v")))


@query("""WITH n AS (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1), j AS (SELECT s, unnest(range(0, 20)) AS j, n FROM n WHERE n > 20),
k AS (SELECT DISTINCT s, (3 * 19 + 2 * j * (n - 1)) // (2 * 19) AS r FROM j), x AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer)
SELECT c_mktsegment, c_custkey FROM x JOIN n ON s = c_mktsegment WHERE n <= 20 OR (c_mktsegment, r) IN (SELECT (s, r) FROM k)""")
def p19_even_sample(spark, d):
    return T.spread_sample(table(spark, d, "customer"), ["c_mktsegment"], "c_custkey", 20).select("c_mktsegment", "c_custkey")


@query("SELECT vec_id AS id, 70 AS size, 70 - len(embedding) AS n_null, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, round(list_sum(list_transform(embedding[:5], lambda x: CAST(x AS DOUBLE))), 6) AS first_five FROM embeddings")
def p20_padded_vectors(spark, d):
    from stateflux.operators import arrays as A

    v = F.col("embedding").cast("array<double>")
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), A.padded(v, 70).alias("v"), A.padded(v, 5).alias("w"))
    return x.select("id", F.size("v").alias("size"), F.size(F.filter("v", lambda x: x.isNull())).cast("long").alias("n_null"), F.round(A.total(F.filter("v", lambda x: x.isNotNull())), 6).alias("total"), F.round(A.total(F.col("w")), 6).alias("first_five"))


@query("SELECT c_custkey, 'balance' AS feature, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey FROM customer")
def p21_long_features(spark, d):
    x = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return x.unpivot(["c_custkey"], ["balance", "nation"], "feature", "value")


@query("""WITH m AS (SELECT o_custkey, o_orderpriority AS f, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS eo, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS ec FROM orders GROUP BY ALL)
SELECT o_custkey, 'delta__EO_minus_EC__' || f AS name, round(eo - ec, 4) AS delta FROM m WHERE eo IS NOT NULL AND ec IS NOT NULL""")
def p22_condition_deltas(spark, d):
    condition = F.when(F.col("o_orderstatus") == "O", "EO").when(F.col("o_orderstatus") == "F", "EC")
    x = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("name"), condition.alias("condition"), F.col("o_totalprice").alias("value"))
    return T.condition_deltas(x, "o_custkey", "EO", "EC").withColumn("delta", F.round("delta", 4))


SUFFIXES = [("__ring", "jewel"), ("ring", "band"), ("plate", "dish"), ("e", "other_e")]


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE replace(p_name, ' ', '__') END AS n FROM part)
SELECT p_partkey, n AS name, CASE WHEN ends_with(n, '__ring') THEN 'jewel' WHEN ends_with(n, 'ring') THEN 'band' WHEN ends_with(n, 'plate') THEN 'dish' WHEN ends_with(n, 'e') THEN 'other_e' END AS domain FROM x""")
def p23_suffix_rules(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("__")))
    return table(spark, d, "part").select("p_partkey", name.alias("name"), X.by_suffix(name, SUFFIXES).alias("domain"))


@query("""WITH x AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events), m AS (SELECT event_id, unnest([1, 2]) AS s, k FROM x)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE s WHEN 1 THEN 'A' ELSE 'B' END ELSE 'state_0' || s END AS state, CASE s WHEN 1 THEN k ELSE -k END AS first, CAST(CASE s WHEN 1 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS second FROM m""")
def s10_json_state_maps(spark, d):
    k = F.get_json_object("props", "$.k")
    # objects of arrays and objects of objects are two layouts; one document has one of them
    plain = F.format_string('{"estimated_microstates": {"A": [%s, 1.0], "B": [-%s, 0.5]}}', k, k)
    nested = F.format_string('{"estimated_microstates": {"A": {"map": [%s, 1.0]}, "B": {"map": [-%s, 0.5]}}}', k, k)
    listed = F.format_string('{"estimated_microstates": [[%s, 1.0], [-%s, 0.5]]}', k, k)
    text = F.when(F.col("event_id") % 2 == 1, listed).when(F.col("event_id") % 4 == 0, plain).otherwise(nested)
    x = table(spark, d, "events").select("event_id", text.alias("json"))
    return state_maps(x, "json", key="event_id").select("event_id", "state", F.col("map")[0].alias("first"), F.col("map")[1].alias("second"))


@query(r"""SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '_') AS ident, coalesce(nullif(trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unnamed') AS slug, coalesce(nullif(trim(regexp_replace(lower(trim(repeat('!', CAST(page_id % 3 AS INTEGER)))), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unnamed') AS empty FROM pages""")
def p5_identifiers(spark, d):
    signs = F.repeat(F.lit("!"), (F.col("page_id") % 3).cast("int"))
    return table(spark, d, "pages").select("page_id", X.identifier(F.col("url")).alias("ident"), X.slug(F.col("url")).alias("slug"), X.slug(signs).alias("empty"))


@query(rf"""WITH x AS (SELECT p_partkey, regexp_replace(upper(trim({_pick_sql(STATES, "p_partkey")} || (p_size % 2))), '[^A-Z0-9]+', '', 'g') AS t FROM part), y AS (SELECT p_partkey, CASE WHEN starts_with(t, 'MS') AND length(t) > 2 THEN substr(t, 3) ELSE t END AS u FROM x)
SELECT p_partkey, CASE WHEN starts_with(u, 'STATE') THEN replace(u, 'STATE', '') ELSE u END AS state FROM y""")
def p9_state_names(spark, d):
    name = F.concat(_picked(STATES, F.col("p_partkey")), (F.col("p_size") % 2).cast("string"))
    return table(spark, d, "part").select("p_partkey", X.state_name(name).alias("state"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'all' WHEN c_custkey % 3 = 1 THEN 'all' ELSE c_mktsegment END AS grp FROM customer")
def p10_defaults(spark, d):
    k = F.col("c_custkey") % 3
    return table(spark, d, "customer").select("c_custkey", X.filled(F.when(k == 1, "  ").when(k == 2, F.col("c_mktsegment")), "all").alias("grp"))


@query("""WITH x AS (SELECT p_partkey, p_type, CASE WHEN p_type = 'PROMO' THEN 1.0 ELSE p_retailprice END AS v FROM part) SELECT p_partkey, round(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0 END, 6) AS unit FROM x WINDOW w AS (PARTITION BY p_type)""")
def p18_min_max(spark, d):
    x = table(spark, d, "part").withColumn("v", F.when(F.col("p_type") == "PROMO", 1.0).otherwise(F.col("p_retailprice")))
    return T.standardised(x, ["p_type"], "v").select("p_partkey", F.round("unit", 6).alias("unit"))
