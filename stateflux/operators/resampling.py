"""Bootstrap, sign flips, permutations and Bayesian bootstrap.

Draws follow from hashes of what is drawn and the draw's number, so results do not
depend on where anything runs. Observations stay in their tasks: each adds its own
to sums by draw and level.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stateflux.operators import arrays as A
from stateflux.operators.rounds import Rounds

#: Draws in a chunk, and bytes of sums that a task holds before it passes them on.
CHUNK, HELD = 500, 64 << 20


#: Of a Poisson variable of mean 1, the chances of at most 0, 1, ...; beyond the last none occurs in practice.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(19)])


def paired_tests(improvements: DataFrame, by: list[str], value: str, order: str, draws: int = 20_000, boots: int = 2_000, seed: int = 0) -> DataFrame:
    """by, n, mean, ci_low, ci_high, p_value, effect_dz: of each metric's improvements the mean, the 2.5 and 97.5 percentiles of its bootstrap, the one-sided p of random signs (null for one row), and the mean over the SD.

    Signs and how often a row is drawn (Poisson counts of mean 1, the bootstrap of
    tables in parts) follow from a hash of ``order``, which tells a metric's rows
    apart, and the draw's number. Each task adds its rows to the sums of all draws,
    so no metric is gathered. The observed sum counts as one of the draws.
    """
    node = (F.to_json(F.struct(*by)) if by else F.lit("{}")).alias("node")
    v = F.col(value).cast("double")
    rows = improvements.select(node, F.xxhash64(order, F.lit(seed)).alias("h"), F.when(F.abs(v) < float("inf"), v).alias("x"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, own in frame.groupby("node"):
                own = own.dropna(subset=["x"])
                x, h = own["x"].to_numpy(float), own["h"].to_numpy()
                parts = [[len(x), x.sum(), (x**2).sum()]]
                for at in range(0, draws, CHUNK):
                    parts.append(np.where(_uniform(h, np.arange(at, min(draws, at + CHUNK))) < 0.5, -1.0, 1.0) @ x)
                counts = []
                for at in range(0, boots, CHUNK):
                    c = np.searchsorted(POISSON, _uniform(h, draws + np.arange(at, min(boots, at + CHUNK))), side="right").astype(float)
                    parts.append(c @ x)
                    counts.append(c.sum(axis=1))
                yield pd.DataFrame({"node": [name], "v": [np.concatenate(parts + counts)]})

    def tests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, v in zip(frame["node"], frame["v"]):
                v = np.asarray(v, float)
                n, total, square = int(v[0]), v[1], v[2]
                mean = total / n if n else None
                sd = math.sqrt(max(0.0, (square - total * total / n) / (n - 1))) if n > 1 else 0.0
                signs, sums, counts = v[3 : 3 + draws], v[3 + draws : 3 + draws + boots], v[3 + draws + boots :]
                means = sums[counts > 0] / counts[counts > 0]
                low, high = np.percentile(means, [2.5, 97.5]) if len(means) else (math.nan, math.nan)
                p = (1 + int((signs >= total - 1e-12 * max(1.0, abs(total))).sum())) / (draws + 1) if n > 1 and draws else math.nan
                out.append((name, n, mean, float(low), float(high), p, mean / sd if n and sd > 1e-9 * max(1.0, abs(mean)) else None))
            yield pd.DataFrame(out, columns=["node", "n", "mean", "ci_low", "ci_high", "p_value", "effect_dz"])

    got = rows.mapInPandas(work, "node string, v array<double>").groupBy("node").agg(vector_to_array(Summarizer.metrics("sum").summary(array_to_vector("v"))["sum"]).alias("v"))
    out = got.mapInPandas(tests, "node string, n long, mean double, ci_low double, ci_high double, p_value double, effect_dz double")
    key = F.from_json("node", ", ".join(f"`{c}` {improvements.schema[c].dataType.simpleString()}" for c in by)) if by else None
    return out.select(*[key[c].alias(c) for c in by], *[c for c in out.columns if c != "node"])


# -- topographic analysis of variance


def unit_rms(m: np.ndarray) -> np.ndarray:
    c = m - m.mean(axis=-1, keepdims=True)
    s = np.sqrt((c**2).mean(axis=-1, keepdims=True))
    return c / np.where(s <= 2.220446049250313e-16, 1.0, s)


def main_effect(means: np.ndarray, renormalise: bool = False) -> np.ndarray:
    """Of each state the root mean square of level means' (levels, states, channels) deviations from their mean."""
    m = unit_rms(means) if renormalise else means
    return np.sqrt(((m - m.mean(axis=0)) ** 2).mean(axis=(0, 2)))


def interaction(cells: np.ndarray, renormalise: bool = False) -> np.ndarray:
    """Of each state the root mean square of what group and condition means together leave of the cells (groups, conditions, states, channels)."""
    m = unit_rms(cells) if renormalise else cells
    left = m - m.mean(axis=1, keepdims=True) - m.mean(axis=0, keepdims=True) + m.mean(axis=(0, 1))
    return np.sqrt((left**2).mean(axis=(0, 1, 3)))


#: Levels of a factor: their pairs are tests.
LEVELS = 50
OBSERVED = -1


class Test(NamedTuple):
    """A test's name, the factor it permutes (or ``interaction``), and the levels its rows are of (None: all)."""

    name: str
    kind: str
    groups: tuple | None = None
    conditions: tuple | None = None


def tests_of(groups: list, conditions: list, posthoc: bool = True) -> list[Test]:
    """The tests that levels allow: both factors, their interaction, and pairs and simple effects after them."""
    out = [Test("group", "group")] * bool(groups) + [Test("condition", "condition")] * bool(conditions) + [Test("group_x_condition", "interaction")] * bool(groups and conditions)
    if posthoc:
        out += [Test(f"group_pair_{a}_vs_{b}", "group", (a, b)) for a, b in itertools.combinations(groups, 2)]
        out += [Test(f"condition_pair_{a}_vs_{b}", "condition", None, (a, b)) for a, b in itertools.combinations(conditions, 2)]
        if groups and conditions:
            out += [Test(f"condition_within_{a}", "condition", (a,)) for a in groups] + [Test(f"group_at_{b}", "group", None, (b,)) for b in conditions]
    return out


def _observations(rows: DataFrame, tests: list[Test], complete: bool) -> DataFrame:
    """t, kind, unit, g, c, item, x: each test's observations after its filters; g and c number the levels (-1: none), x are the states' maps, one after the other.

    A group test's are units: the mean of a unit's maps, each turned along the mean
    of all, at unit root mean square.
    """
    among = lambda c, values: F.lit(True) if values is None else F.coalesce(F.col(c).isin(*values), F.lit(False))
    own = F.filter(F.array(*[F.when(among("grp", t.groups) & among("condition", t.conditions), F.lit(i)) for i, t in enumerate(tests)]), lambda i: i.isNotNull())
    kind = F.element_at(F.array(*[F.lit(t.kind) for t in tests]), F.col("t") + 1)
    each = rows.withColumn("t", F.explode(own)).withColumn("kind", kind)
    # units with every condition of the test, or with two, or all
    have = each.groupBy("t", "unit").agg(F.countDistinct("condition").alias("n"), F.max("kind").alias("kind"))
    every = each.groupBy("t").agg(F.countDistinct("condition").alias("most"))
    enough = (F.col("n") == F.col("most")) if complete else (F.col("kind") != "condition") | (F.col("n") >= 2)
    each = each.join(have.join(F.broadcast(every), "t").where(enough).select("t", "unit"), ["t", "unit"], "left_semi")  # a row for each test
    plain = each.where("kind <> 'group'")
    cells = each.where("kind = 'group'").select("t", "unit", "g", F.posexplode("x").alias("pos", "v"))
    means = cells.groupBy("t", "unit", "pos").agg(F.avg("v").alias("v"), F.max("g").alias("g"), F.min(F.when(F.col("g") >= 0, F.col("g"))).alias("least"))
    mixed = F.raise_error(F.concat(F.lit("a unit is in several groups: "), F.col("unit")))
    middle = cells.groupBy("t", "pos").agg(F.avg("v").alias("r"))
    channels = F.first("_n").alias("_n")
    size = rows.select(F.col("channels").alias("_n")).limit(1)
    joined = means.withColumn("g", F.when(F.coalesce("least", F.col("g")) == F.col("g"), F.col("g")).otherwise(mixed.cast("int"))).join(F.broadcast(middle), ["t", "pos"])  # a row for each test, state and channel
    joined = joined.crossJoin(F.broadcast(size)).withColumn("s", F.floor(F.col("pos") / F.col("_n")))  # one row
    by_state = joined.groupBy("t", "unit", "g", "s").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("m"), F.sum(F.col("v") * F.col("r")).alias("along"), channels)
    turned = A.unit_rms(F.transform("m", lambda v: v * F.when(F.col("along") < 0, -1.0).otherwise(1.0)))
    by_unit = by_state.groupBy("t", "unit", "g").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("s", turned.alias("m")))), lambda s: s["m"])).alias("x"))
    by_unit = by_unit.select("t", F.lit("group").alias("kind"), "unit", "g", F.lit(-1).alias("c"), F.col("unit").alias("item"), "x")
    return by_unit.unionByName(plain.select("t", "kind", "unit", "g", "c", F.concat_ws("|", "unit", "g", "c").alias("item"), "x"))


def _permuted(items: DataFrame, draws: int, seed: int) -> DataFrame:
    """t, item, draw, label: each draw's labels, from the ranks of hashes of item and draw; groups' among all units, conditions' within a unit; OBSERVED is the design's own.

    Only names and labels are ranked, never maps. A draw's ranks are one sort of its units.
    """
    scope = ["t", "scope"]
    base = items.select("t", F.when(F.col("kind") == "group", "").otherwise(F.col("unit")).alias("scope"), "item", F.when(F.col("kind") == "group", F.col("g")).otherwise(F.col("c")).alias("label"))
    base = base.withColumn("pos", F.row_number().over(Window.partitionBy(*scope).orderBy("item")))
    drawn = base.select(*scope, "item", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")) if draws > 0 else base.select(*scope, "item", F.lit(0).alias("draw")).where("false")
    order = Window.partitionBy(*scope, "draw").orderBy(F.xxhash64("item", "draw", F.lit(seed)), "item")
    ranks = drawn.withColumn("pos", F.row_number().over(order))
    return ranks.join(base.select(*scope, "pos", "label"), [*scope, "pos"]).select("t", "item", "draw", "label").unionByName(base.select("t", "item", F.lit(OBSERVED).alias("draw"), "label"))


def _uniform(h: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1), one for each draw and hash."""
    z = h.astype(np.uint64)[None] + (draws.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2.0**-54


def level_sums(spark: SparkSession, observations: DataFrame, tests: list[Test], n_conditions: int, draws: int, seed: int, bayesian: bool) -> DataFrame:
    """t, draw, level, v: the weight of a level's observations and the weighted sums of their maps, by test and draw.

    A draw permutes labels or, ``bayesian``, gives each unit an exponential weight,
    which is a Dirichlet draw once means divide by the weights' sum. Each task adds
    its observations to the sums of CHUNK draws at a time.
    """
    crossed = np.array([t.kind == "interaction" for t in tests])
    if bayesian:
        chunk = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-draws // CHUNK) - 1)))).alias("chunk")
        met = observations.select("t", "g", F.when(F.col("kind") == "group", F.col("g")).otherwise(F.col("c")).alias("own"), F.xxhash64("unit", F.lit(seed)).alias("h"), "x", chunk)
    else:
        labels = _permuted(observations, draws, seed).groupBy("t", "item", F.floor(F.col("draw") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("draw", "label"))).alias("d"))
        met = observations.join(labels, ["t", "item"]).select("t", "g", "chunk", "x", F.col("d.draw").alias("draws"), F.col("d.label").alias("labels"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            for (t, chunk), own in frame.groupby(["t", "chunk"]):
                x = np.stack(own["x"].to_numpy()).astype(float)
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                if bayesian:
                    first = np.array([OBSERVED] if chunk == 0 else [], int)
                    numbers = np.concatenate([first, np.arange(chunk * CHUNK, min(draws, (chunk + 1) * CHUNK))])
                    weights = np.where(numbers[:, None] == OBSERVED, 1.0, -np.log(_uniform(own["h"].to_numpy(), numbers)))
                    labels = np.broadcast_to(own["own"].to_numpy(), weights.shape)
                else:
                    numbers, labels = np.asarray(own["draws"].iloc[0]), np.stack(own["labels"].to_numpy()).T
                    weights = np.ones(labels.shape)
                level = np.where(labels < 0, -1, own["g"].to_numpy()[None] * n_conditions + labels) if crossed[t] else labels
                for one in np.unique(level[level >= 0]):
                    sums = (weights * (level == one)) @ x
                    key = (int(t), int(chunk), int(one))
                    held[key] = (numbers, held[key][1] + sums) if key in held else (numbers, sums)
            if sum(s.nbytes for _, s in held.values()) > HELD:
                yield from _passed(held)
                held = {}
        yield from _passed(held)

    got = met.mapInPandas(work, "t int, draw int, level int, v array<double>")
    return got.groupBy("t", "draw", "level").agg(vector_to_array(Summarizer.metrics("sum").summary(array_to_vector("v"))["sum"]).alias("v"))


def _passed(held: dict) -> Iterator[pd.DataFrame]:
    for (t, _, level), (numbers, sums) in held.items():
        yield pd.DataFrame({"t": t, "draw": numbers.astype(np.int32), "level": level, "v": list(sums)})


def tanova(templates: DataFrame, draws: int = 5000, seed: int = 1, complete: bool = True, renormalise: bool = False, posthoc: bool = True, bayesian: bool = False, rope: float = 0.05, unit: str = "unit", group: str | None = "grp", condition: str | None = "condition", state: str = "state", map_: str = "map") -> DataFrame:
    """One row for each test and state of ``templates`` (unit, group, condition, state, map): the statistic and, from ``draws`` permutations, its p alone and by the greatest state of each; or, ``bayesian``, the posterior of weighted means.

    Permutations move group labels among units, condition labels within units.
    Maps are never gathered: see :func:`level_sums`. Every observation has the
    same states and channels; of repeated ones the mean counts. The levels of the
    factors, LEVELS at most each, go to the driver.
    """
    spark = templates.sparkSession
    named = templates.select(F.col(unit).cast("string").alias("unit"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("grp"), (F.col(condition).cast("string") if condition else F.lit(None).cast("string")).alias("condition"), F.col(state).alias("state"), F.posexplode(map_).alias("pos", "v")).where("unit is not null")
    merged = named.groupBy("unit", "grp", "condition", "state", "pos").agg(F.avg("v").alias("v")).groupBy("unit", "grp", "condition", "state").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("state", "m")))
    rows = merged.groupBy("unit", "grp", "condition").agg(ordered.alias("s")).select("unit", "grp", "condition", F.flatten("s.m").alias("x"), F.col("s.state").alias("states"), F.size(F.col("s.m")[0]).alias("channels"))
    levels = {c: [r[0] for r in rows.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).limit(LEVELS + 1).collect()] for c in ("grp", "condition")}
    if max(map(len, levels.values())) > LEVELS:
        raise ValueError(f"more than {LEVELS} levels of a factor")
    tests = tests_of(levels["grp"], levels["condition"], posthoc)
    names = rows.select("states").first()
    schema = "effect string, kind string, state int, statistic double"
    if not tests or names is None:
        return spark.createDataFrame([], schema)
    number = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(v) for v in levels[c]]).cast("array<string>"), F.col(c)) - 1, F.lit(-1)).cast("int")
    with Rounds(spark) as work:
        rows = work.written(rows.withColumn("g", number("grp")).withColumn("c", number("condition")), "design")
        observations = work.written(_observations(rows, tests, complete), "observations")
        sizes = {r["t"]: r for r in observations.groupBy("t").agg(F.countDistinct("unit").alias("units"), F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("g") >= 0, F.col("g"))).alias("groups"), F.countDistinct(F.when(F.col("c") >= 0, F.col("c"))).alias("conditions"), F.countDistinct(F.when((F.col("g") >= 0) & (F.col("c") >= 0), F.struct("g", "c"))).alias("cells")).collect()}
        notes = {}
        for i, t in enumerate(tests):
            r = sizes.get(i)
            if t.kind == "group":
                notes[i] = "too few units or groups" if not r or r["units"] < 3 or r["groups"] < 2 else ""
            elif t.kind == "condition":
                notes[i] = "too few conditions" if not r or r["conditions"] < 2 else ""
            else:
                notes[i] = "an empty cell" if not r or r["groups"] < 2 or r["conditions"] < 2 or r["cells"] < r["groups"] * r["conditions"] else ""
        run = [i for i in notes if not notes[i]]
        k = len(names["states"])
        sums = level_sums(spark, observations.where(F.col("t").isin(run)), tests, max(1, len(levels["condition"])), draws, seed, bayesian)
        gathered = sums.groupBy("t", "draw").agg(F.array_sort(F.collect_list(F.struct("level", "v"))).alias("s")).select("t", "draw", F.col("s.level").alias("levels"), F.col("s.v").alias("v"))
        crossed, n_conditions = {i for i, t in enumerate(tests) if t.kind == "interaction"}, max(1, len(levels["condition"]))

        def values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for t, draw, level, v in frame.itertuples(index=False):
                    v = np.stack(v)
                    means = (v[:, 1:] / v[:, :1]).reshape(len(v), k, -1)
                    if t in crossed:
                        g, c = np.unique(level // n_conditions), np.unique(level % n_conditions)
                        got = interaction(means.reshape(len(g), len(c), k, -1), renormalise) if len(level) == len(g) * len(c) else np.full(k, np.nan)
                    else:
                        got = main_effect(means, renormalise)
                    yield pd.DataFrame({"t": t, "draw": draw, "state": np.arange(k, dtype=np.int32), "x": got})

        drawn = work.written(gathered.mapInPandas(values, "t int, draw int, state int, x double"), "draws")
        facts = [(i, s, t.name, t.kind, sizes[i]["units"] if i in sizes else 0, sizes[i]["n"] if i in sizes else 0, draws if not notes[i] else 0, notes[i]) for i, t in enumerate(tests) for s in range(k)]
        head = spark.createDataFrame(facts, "t int, state int, effect string, kind string, n_units long, n_observations long, n_draws long, note string")
        observed = drawn.where(F.col("draw") == OBSERVED).select("t", "state", F.col("x").alias("statistic"))
        head = head.join(F.broadcast(observed), ["t", "state"], "left")  # a row for each test and state
        draw = drawn.where(F.col("draw") != OBSERVED).withColumn("top", F.max("x").over(Window.partitionBy("t", "draw")))
        if bayesian:
            above = F.avg((F.col("x") > rope).cast("double"))
            post = draw.groupBy("t", "state").agg(F.avg("x").alias("posterior_mean"), F.stddev_samp("x").alias("posterior_sd"), F.median("x").alias("posterior_median"), F.percentile("x", F.lit(0.025)).alias("ci_low"), F.percentile("x", F.lit(0.975)).alias("ci_high"), above.alias("prob_gt_rope"))
            out = head.join(F.broadcast(post), ["t", "state"], "left").withColumn("prob_le_rope", 1 - F.col("prob_gt_rope"))
            out = out.withColumn("evidence_ratio", (F.col("prob_gt_rope") + 2.220446049250313e-16) / (F.col("prob_le_rope") + 2.220446049250313e-16))
            return work.result(out.drop("t"), "tanova")
        # a permutation that leaves the design as it is gives the same sums in another order
        least = F.col("statistic") * (1 - 1e-9)
        over = draw.join(F.broadcast(observed), ["t", "state"]).groupBy("t", "state").agg(F.sum((F.col("x") >= least).cast("long")).alias("over"), F.sum((F.col("top") >= least).cast("long")).alias("over_max"))
        p = lambda c: F.when(F.col("n_draws") > 0, (1 + F.col(c)) / (F.col("n_draws") + 1))
        out = head.join(F.broadcast(over), ["t", "state"], "left").select("effect", "kind", "state", "statistic", p("over").alias("p_uncorrected"), p("over_max").alias("p_max_state"), "n_units", "n_observations", F.col("n_draws").alias("n_permutations"), "note")
        return work.result(out, "tanova")
