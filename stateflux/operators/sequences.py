"""Operators on label sequences: runs, state metrics, information, events in time.

A sequence has a record, an order (one or more columns) and a state. All windows
are partitioned by record, so records spread over tasks; nothing is collected. What
comes next is looked for with a running frame over the descending order: a frame
that begins at the current row and has no end would be summed anew for each row.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stateflux.operators import arrays as A
from stateflux.operators.rounds import Rounds
from stateflux.operators.tables import small

ORDER = ("us", "seq")


def _over(rec: str, order: tuple[str, ...] = ORDER):
    return Window.partitionBy(rec).orderBy(*order)


def last_seen(value: Column, rec: str, order: tuple[str, ...] = ORDER, own: bool = True) -> Column:
    """The last value that is not null up to a sample, or before it."""
    return F.last(value, ignorenulls=True).over(_over(rec, order).rowsBetween(Window.unboundedPreceding, 0 if own else -1))


def next_seen(value: Column, rec: str, order: tuple[str, ...] = ORDER, own: bool = True) -> Column:
    """The first value that is not null from a sample on, or after it."""
    back = Window.partitionBy(rec).orderBy(*[F.col(c).desc() for c in order])
    return F.last(value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0 if own else -1))


def entries(df: DataFrame, rec: str = "rec", state: str = "state", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Adds ``entry``: whether a sample begins a run (the first of its record does)."""
    before = F.lag(state).over(_over(rec, order))
    return df.withColumn("entry", before.isNull() | (before != F.col(state)))


def runs(df: DataFrame, rec: str = "rec", state: str = "state", gfp: str = "gfp", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Run-length islands: rec, run (from 1), state, n, start_us, stop_us, gfp_mean."""
    run = F.sum(F.col("entry").cast("long")).over(_over(rec, order).rowsBetween(Window.unboundedPreceding, 0))
    return entries(df, rec, state, order).withColumn("run", run).groupBy(rec, "run", state).agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("start_us"), F.max("us").alias("stop_us"), F.avg(gfp).alias("gfp_mean"))


def state_metrics(df: DataFrame, rec: str = "rec", state: str = "state", gfp: str = "gfp") -> DataFrame:
    """Of every record and state, dense: coverage, mean GFP, entries, entry rate, mean and median run length.

    A state that a record lacks has coverage 0 and null GFP and lengths.
    """
    per_run = runs(df, rec, state, gfp)
    per_state = per_run.groupBy(rec, state).agg(F.sum("n").alias("n_samples"), F.count(F.lit(1)).alias("occurrences"), F.sum(F.col("gfp_mean") * F.col("n")).alias("gfp_sum"), F.avg("n").alias("run_mean"), F.median("n").alias("run_median"))
    records = df.groupBy(rec).agg(F.count(F.lit(1)).alias("total"), ((F.max("us") - F.min("us")) / 1e6).alias("seconds"))
    grid = records.crossJoin(small(df.select(state).distinct(), 10_000))  # a few states, by definition of a label
    out = grid.join(per_state, [rec, state], "left")
    return out.select(
        rec, state, F.coalesce("n_samples", F.lit(0)).alias("n_samples"), F.round(F.coalesce(F.col("n_samples") / F.col("total"), F.lit(0.0)), 6).alias("coverage"), F.round(F.col("gfp_sum") / F.col("n_samples"), 6).alias("mean_gfp"),
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.round(F.try_divide(F.coalesce("occurrences", F.lit(0)), F.col("seconds")), 6).alias("rate_hz"), F.round("run_mean", 6).alias("run_mean"), F.round("run_median", 6).alias("run_median"),
    )


def entropy(df: DataFrame, rec: str = "rec", state: str = "state") -> DataFrame:
    """Shannon entropy, in bits, of a record's state shares."""
    counts = df.groupBy(rec, state).agg(F.count(F.lit(1)).alias("n"))
    # -sum p log2 p = log2 N - sum n log2 n / N: one aggregation of the counts
    return counts.groupBy(rec).agg(F.round(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 6).alias("entropy_bits"))


def transitions(df: DataFrame, rec: str = "rec", state: str = "state") -> DataFrame:
    """Counts and row shares of changes from one state to another, over all records."""
    moved = df.withColumn("to", F.lead(state).over(_over(rec))).where(F.col("to").isNotNull() & (F.col("to") != F.col(state)))
    counts = moved.groupBy(F.col(state).alias("from_state"), F.col("to").alias("to_state")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("from_state")), 6))


def pairwise_information(df: DataFrame, rec: str = "rec", state: str = "state") -> DataFrame:
    """Mutual information, in bits, of the indicators of two states of a record, and over the geometric mean of their entropies.

    States exclude one another, so the joint table follows from the two shares.
    """
    share = df.groupBy(rec, state).agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(rec)))
    a, b = (share.select(rec, F.col(state).alias(f"state_{x}"), F.col("p").alias(f"p{x}")) for x in "ij")
    pairs = a.join(b, rec).where("state_i < state_j")
    term = lambda p, q: F.when(p > 1e-12, p * F.log2(p / q)).otherwise(0.0)
    h = lambda p: -(F.when(p > 1e-12, p * F.log2(p)).otherwise(0.0) + F.when(1 - p > 1e-12, (1 - p) * F.log2(1 - p)).otherwise(0.0))
    pi, pj = F.col("pi"), F.col("pj")
    none = 1 - pi - pj
    mi = term(pi, pi * (1 - pj)) + term(pj, pj * (1 - pi)) + F.when(none > 1e-9, none * F.log2(none / F.greatest((1 - pi) * (1 - pj), F.lit(1e-12)))).otherwise(0.0)
    return pairs.select(rec, "state_i", "state_j", F.round(mi, 6).alias("mi_bits"), F.round(mi / F.greatest(F.sqrt(h(pi) * h(pj)), F.lit(2.220446049250313e-16)), 6).alias("nmi"))


def near_change(df: DataFrame, half: int, rec: str = "rec", state: str = "state", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Adds ``near``: whether a run other than the first begins within ``half`` samples."""
    changed = entries(df, rec, state, order).withColumn("change", F.col("entry") & F.lag(F.lit(1)).over(_over(rec, order)).isNotNull())
    return changed.withColumn("near", F.max(F.col("change").cast("int")).over(_over(rec, order).rowsBetween(-half, half)) == 1).drop("entry", "change")


def local_maxima(df: DataFrame, share: float | Sequence[float], least: int = 0, rec: str = "rec", value: str = "gfp", order: tuple[str, ...] = ORDER, tie: str = "right") -> DataFrame:
    """Peaks of a record that reach its quantile ``share``: above one neighbour, not below the other.

    A tie with the sample after is allowed, or with ``tie="left"`` that with the one
    before. Of several shares, in the order given, the first that leaves ``least``
    peaks counts, else the last that leaves any.
    """
    shares = [share] if isinstance(share, float) else list(share)
    w = _over(rec, order)
    left, right = F.col(value) - F.lag(value).over(w), F.col(value) - F.lead(value).over(w)
    tops = df.withColumn("_top", (left > 0) & (right >= 0) if tie == "right" else (left >= 0) & (right > 0)).where("_top").drop("_top")
    floors = df.groupBy(rec).agg(F.percentile(value, F.array(*[F.lit(x) for x in shares])).alias("_floors"))
    met = tops.join(floors, rec)
    if len(shares) > 1:
        counts = met.groupBy(rec).agg(*[F.count_if(F.col(value) >= F.col("_floors")[i]).alias(f"_n{i}") for i in range(len(shares))])
        enough = F.coalesce(*[F.when(F.col(f"_n{i}") >= max(1, least), F.lit(i)) for i in range(len(shares))], *[F.when(F.col(f"_n{i}") > 0, F.lit(i)) for i in reversed(range(len(shares)))], F.lit(0))
        met = met.join(counts.select(rec, enough.alias("_use")), rec)
    else:
        met = met.withColumn("_use", F.lit(0))
    return met.where(F.col(value) >= F.col("_floors")[F.col("_use")]).drop("_floors", "_use")


#: Positions in a block of a record, at least: what lies near its borders is copied to its neighbours.
BLOCK = 1 << 14


def spaced_peaks(peaks: DataFrame, distance: int, rec: str = "rec", pos: str = "pos", value: str = "gfp", strict: bool = True) -> DataFrame:
    """Of the peaks of a record, highest first (ties to the earlier), those with no chosen one within ``distance``; without ``strict`` one exactly that far does not count.

    In rounds: a peak higher than all undecided ones that near is chosen, and those
    that near to it are left out. Records are worked on in blocks, with copies of
    what is near their borders, so that a long one is many tasks. There are as many
    rounds as the longest row of ever higher peaks, each near to the next, has.
    Peaks without a value come last; those of one position are one peak.
    """
    near = distance if strict else distance - 1
    width = max(BLOCK, 8 * near)
    with Rounds(peaks.sparkSession) as work:
        left = peaks.select(F.col(rec).alias("r"), F.col(pos).cast("long").alias("p"), F.coalesce(F.col(value).cast("double"), F.lit(float("-inf"))).alias("v")).groupBy("r", "p").agg(F.max("v").alias("v"))
        left, chosen = work.written(left, "peaks"), []
        while True:
            at = lambda shift: F.floor((F.col("p") + shift) / width)
            dealt = left.withColumn("b", F.explode(F.array_distinct(F.array(at(-2 * near), at(0), at(2 * near)))))
            around = Window.partitionBy("r", "b").orderBy("p").rangeBetween(-near, near)
            # two halos: the choice of what is near a point depends on what is near that
            top = F.max(F.struct("v", (-F.col("p")).alias("n"))).over(around)
            marked = dealt.withColumn("top", F.col("p") == -top["n"]).withColumn("out", F.max(F.col("top").cast("int")).over(around) == 1)
            own = work.written(marked.where(F.col("b") == at(0)).select("r", "p", "v", "top", "out"), "round")
            chosen.append(own.where("top").select("r", "p"))
            before, left = left, own.where("not out").select("r", "p", "v")
            if len(chosen) == 1:
                work.dropped(before)
            if left.isEmpty():
                break
        kept = functools.reduce(DataFrame.unionByName, chosen)
        kept = work.result(kept.withColumnRenamed("r", "_r").withColumnRenamed("p", "_p"), "chosen")
    return peaks.join(kept, F.col(rec).eqNullSafe(F.col("_r")) & (F.col(pos) == F.col("_p")), "left_semi")


def collapsed_train(marks: DataFrame, gap: int, rec: str = "rec", pos: str = "pos") -> DataFrame:
    """Of marked positions, those more than ``gap`` after the last one kept; the first is kept.

    A mark that far from the one before it is kept whatever precedes it, so marks
    fall into islands. In an island a kept mark leads to the first mark beyond its
    gap; who is led to is found by doubling the leaps, in rounds whose number grows
    with the logarithm of an island's kept marks.
    """
    with Rounds(marks.sparkSession) as work:
        rows = marks.select(F.col(rec).alias("r"), F.col(pos).cast("long").alias("p")).where("p is not null").distinct()
        earlier = Window.partitionBy("r").orderBy("p")
        first = F.coalesce(F.col("p") - F.lag("p").over(earlier) > gap, F.lit(True))
        # seen from behind, the marks beyond the gap are a frame that only grows
        beyond = Window.partitionBy("r").orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, -(gap + 1))
        leaps = work.written(rows.withColumn("first", first).withColumn("to", F.min("p").over(beyond)), "marks")
        reached = leaps.where("first").select("r", "p")
        leaps = leaps.where("to is not null").join(leaps.where("not first").select(F.col("r").alias("_r"), F.col("p").alias("_to")), F.col("r").eqNullSafe(F.col("_r")) & (F.col("to") == F.col("_to"))).select("r", "p", "to")
        reached, leaps = work.written(reached, "reached"), work.written(leaps, "leaps")
        same = F.col("r").eqNullSafe(F.col("_r"))
        while not leaps.isEmpty():
            start = reached.select(F.col("r").alias("_r"), F.col("p").alias("_p"))
            more = leaps.join(start, same & (F.col("p") == F.col("_p"))).select("r", F.col("to").alias("p"))
            on = leaps.select(F.col("r").alias("_r"), F.col("p").alias("_p"), F.col("to").alias("_to"))
            double = leaps.join(on, same & (F.col("to") == F.col("_p"))).select("r", "p", F.col("_to").alias("to"))
            old = reached, leaps
            reached, leaps = work.written(reached.unionByName(more).distinct(), "reached"), work.written(double, "leaps")
            for table in old:
                work.dropped(table)
        kinds = marks.select(rec, pos).schema
        return work.result(reached.select(F.col("r").alias(rec), F.col("p").cast(kinds[pos].dataType).alias(pos)), "train")


def plausible_trains(events: DataFrame, low_s: float = 0.25, high_s: float = 2.5, rec: str = "rec", at: str = "us") -> DataFrame:
    """rec, n, median_s: trains of at least five events whose median interval is within the limits."""
    w = Window.partitionBy(rec).orderBy(at)
    gaps = events.withColumn("_gap", (F.col(at) - F.lag(at).over(w)) / 1e6)
    out = gaps.groupBy(rec).agg(F.count(F.lit(1)).alias("n"), F.median("_gap").alias("median_s"))
    return out.where((F.col("n") >= 5) & F.col("median_s").between(low_s, high_s))


def marker_events(events: DataFrame, markers: DataFrame, rec: str = "rec", condition: str = "condition", text: str = "description") -> DataFrame:
    """Events whose description has one of their condition's markers (condition, marker, preferred); the others count only where no event of the record has a preferred one."""
    met = events.join(F.broadcast(markers), condition).where(F.col(text).contains(F.col("marker")))  # a handful of markers
    best = met.groupBy(rec).agg(F.max(F.col("preferred").cast("int")).alias("_best"))
    used = met.join(best, rec).where(F.col("preferred").cast("int") == F.col("_best"))
    return used.select(events.columns).distinct()


def cropped(points: DataFrame, intervals: DataFrame, rec: str = "rec", at: str = "us", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Points within the intervals (rec, start_us, stop_us) of their record, ends included, with ``pos``: their place, from 0, in the intervals one after the other.

    Intervals must not overlap: merge them first. Both are one sorted stream; no point meets another interval than the last one begun.
    """
    marks = intervals.select(rec, F.col("start_us").alias(at), F.struct("start_us", "stop_us").alias("_span"))
    both = points.withColumn("_span", F.lit(None).cast(marks.schema["_span"].dataType)).withColumn("_kind", F.lit(1)).unionByName(marks.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    span = F.last("_span", ignorenulls=True).over(Window.partitionBy(rec).orderBy(at, "_kind", *[c for c in order if c != at]).rowsBetween(Window.unboundedPreceding, 0))
    inside = both.withColumn("_in", span).where((F.col("_kind") == 1) & (F.col(at) <= F.col("_in.stop_us")))
    return inside.withColumn("pos", F.row_number().over(_over(rec, order)) - 1).select(*points.columns, "pos")


def merged_intervals(df: DataFrame, gap: int, rec: str = "rec", start: str = "start_us", stop: str = "stop_us") -> DataFrame:
    """Intervals of a record that overlap or lie within ``gap`` of each other, as one."""
    w = Window.partitionBy(rec).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("new", (reach.isNull() | (F.col(start) > reach + gap)).cast("long"))
    return flagged.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(rec, "island").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count(F.lit(1)).alias("n"))


def beats(df: DataFrame, event: str, rec: str = "rec", state: str = "state", limits_s: tuple[float, float] | None = None) -> DataFrame:
    """Reference events of each record with the intervals before and after, in seconds.

    With ``limits_s``, those whose intervals are both within: the first and the last of a record go.
    """
    w = Window.partitionBy(rec).orderBy("us", "seq")
    marked = df.where(F.col(state) == event).select(rec, "us", "seq")
    out = marked.withColumn("rr_prev", (F.col("us") - F.lag("us").over(w)) / 1e6).withColumn("rr_next", (F.lead("us").over(w) - F.col("us")) / 1e6)
    return out if limits_s is None else out.where(F.col("rr_prev").between(*limits_s) & F.col("rr_next").between(*limits_s))


def phase(df: DataFrame, event: str, rec: str = "rec", state: str = "state") -> DataFrame:
    """As-of join of every sample with the reference events around it (r0, r1), as an angle between them in [0, 2 pi).

    One sort of the record each way: the last event at or before a sample and the
    first after it are carried along, so no sample meets another one's events.
    """
    mark = F.when(F.col(state) == event, F.col("us"))
    found = df.withColumn("r0", last_seen(mark, rec)).withColumn("r1", next_seen(mark, rec, own=False))
    return found.where("r0 is not null and r1 is not null and r1 > r0").withColumn("phase", 2 * math.pi * (F.col("us") - F.col("r0")) / (F.col("r1") - F.col("r0")))


def period_shares(phased: DataFrame, primary: str, early_s: tuple[float, float], rec: str = "rec", state: str = "state") -> DataFrame:
    """rec, r0, early, late: of the samples of each interval between reference events (from :func:`phase`) the share in the primary state, in the stretch ``early_s`` after the event and in the rest; null without samples."""
    since = F.col("us") - F.col("r0")
    early = (since >= int(early_s[0] * 1e6)) & (since < int(early_s[1] * 1e6))
    hit = (F.col(state) == primary).cast("double")
    return phased.groupBy(rec, "r0").agg(F.avg(F.when(early, hit)).alias("early"), F.avg(F.when(~early, hit)).alias("late"))


def nearest(df: DataFrame, event: str, target: str, limit_s: float, rec: str = "rec", state: str = "state", best: bool = False) -> DataFrame:
    """Each event with the nearest target of its record within ``limit_s`` seconds; a tie goes to the earlier one.

    With ``best``, of the events that have one target only the nearest, the earlier of two.
    """
    mark = F.when(F.col(state) == target, F.col("us"))
    both = df.where(F.col(state).isin(event, target)).withColumn("left_us", last_seen(mark, rec)).withColumn("right_us", next_seen(mark, rec))
    d0, d1 = F.col("us") - F.col("left_us"), F.col("right_us") - F.col("us")
    hit = F.when(d1.isNull() | (d0 <= d1), F.col("left_us")).otherwise(F.col("right_us"))
    met = both.where(F.col(state) == event).withColumn("hit_us", hit).where(F.abs(F.col("us") - F.col("hit_us")) <= int(limit_s * 1e6)).select(rec, "seq", "us", "hit_us", ((F.col("us") - F.col("hit_us")) / 1e6).alias("delay_s"))
    if best:
        met = met.withColumn("_r", F.row_number().over(Window.partitionBy(rec, "hit_us").orderBy(F.abs("delay_s"), "us", "seq"))).where("_r = 1").drop("_r")
    return met


def within(points: DataFrame, centres: DataFrame, low_s: float, high_s: float, rec: str = "rec") -> DataFrame:
    """Range join: points (rec, us, ...) in [centre + low, centre + high) of the centres (rec, us) of their record.

    Both sides are cut into buckets as wide as the range; a centre goes to the
    buckets that it reaches, so the join is on equal keys and its work is that
    of the matches.
    """
    low, high = int(low_s * 1e6), int(high_s * 1e6)
    width = max(1, high - low)
    spans = centres.select(rec, F.col("us").alias("centre_us")).withColumn("bucket", F.explode(F.sequence(F.floor((F.col("centre_us") + low) / width), F.floor((F.col("centre_us") + high - 1) / width))))
    return points.withColumn("bucket", F.floor(F.col("us") / width)).join(spans, [rec, "bucket"]).where((F.col("us") >= F.col("centre_us") + low) & (F.col("us") < F.col("centre_us") + high)).drop("bucket")


def circular(df: DataFrame, by: list[str], angle: str = "phase") -> DataFrame:
    """First and second circular moments, resultant length and mean angle in [0, 2 pi)."""
    moments = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[f(F.lit(k) * F.col(angle)).alias(f"{name}{k}") for k in (1, 2) for name, f in (("cos", lambda x: F.avg(F.cos(x))), ("sin", lambda x: F.avg(F.sin(x))))])
    mean = F.atan2("sin1", "cos1")
    return moments.select(*by, "n", *[F.round(c, 6).alias(c) for c in ("cos1", "sin1", "cos2", "sin2")], F.round(F.hypot("cos1", "sin1"), 6).alias("resultant"), F.round(F.when(mean < 0, mean + 2 * math.pi).otherwise(mean), 6).alias("mean_phase"))


def phase_bins(df: DataFrame, bins: int, by: list[str], state: str = "state", gfp: str = "gfp", angle: str = "phase") -> DataFrame:
    """Counts, shares among a bin's samples, and mean GFP of each state in equal bins of angle."""
    binned = df.withColumn("bin", F.least(F.floor(F.col(angle) / (2 * math.pi) * bins), F.lit(bins - 1)).cast("int"))
    counts = binned.groupBy(*by, "bin", state).agg(F.count(F.lit(1)).alias("n"), F.avg(gfp).alias("mean_gfp"))
    return counts.withColumn("coverage", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by, "bin")), 6))


def circular_states(phased: DataFrame, rec: str = "rec", state: str = "state", gfp: str = "gfp", angle: str = "phase") -> DataFrame:
    """Of every record and state that occurs: coverage, first and second moments of its indicator over all samples, resultant, angle, and the moments of GFP over its own samples."""
    total = phased.groupBy(rec).agg(F.count(F.lit(1)).alias("n_phase_samples"))
    sums = phased.groupBy(rec, state).agg(
        F.count(F.lit(1)).alias("m"), *[F.sum(f(F.lit(k) * F.col(angle))).alias(f"{name}{k}") for k in (1, 2) for name, f in (("cos", F.cos), ("sin", F.sin))],
        F.avg(F.col(gfp) * F.cos(angle)).alias("gfp_cos1"), F.avg(F.col(gfp) * F.sin(angle)).alias("gfp_sin1"),
    )
    met = sums.join(total, rec)
    n, mean = F.col("n_phase_samples"), F.atan2("sin1", "cos1")
    return met.select(
        rec, state, "n_phase_samples", F.round(F.col("m") / n, 6).alias("coverage"), *[F.round(F.col(c) / n, 6).alias(c) for c in ("cos1", "sin1", "cos2", "sin2")],
        F.round(F.hypot("cos1", "sin1") / n, 6).alias("resultant"), F.round(F.when(mean < 0, mean + 2 * math.pi).otherwise(mean), 5).alias("mean_phase"), "gfp_cos1", "gfp_sin1",
    )


def fill_from_peaks(df: DataFrame, is_peak: Column, rec: str = "rec", state: str = "state", order: tuple[str, ...] = ORDER) -> DataFrame:
    """``filled``: the state of the nearest peak by position; from the midpoint on, that of the next one."""
    placed = df.withColumn("_pos", F.row_number().over(_over(rec, order))).withColumn("_mark", F.when(is_peak, F.struct("_pos", state)))
    both = placed.withColumn("_l", last_seen(F.col("_mark"), rec, order)).withColumn("_n", next_seen(F.col("_mark"), rec, order))
    to_left = F.col("_n").isNull() | (F.col("_l").isNotNull() & (F.col("_pos") <= F.floor((F.col("_l._pos") + F.col("_n._pos")) / 2)))
    return both.withColumn("filled", F.when(to_left, F.col(f"_l.{state}")).otherwise(F.col(f"_n.{state}"))).drop("_pos", "_mark", "_l", "_n")


def backfit_metrics(weights: DataFrame, rate: float, keys: list[str], order: list[str], state: str = "state") -> DataFrame:
    """Of each key and state: occupancy (mean weight), percentage of samples assigned, GFP weighted by it, occurrences, and their rate.

    ``weights`` has a row for each sample and state: keys, order, state, w, gfp and
    ``assigned``, whether the state is the sample's own. Null weights are 0. A
    state without weight has null metrics.
    """
    w = F.coalesce("w", F.lit(0.0))
    before = F.lag("assigned").over(Window.partitionBy(*keys, state).orderBy(*order))
    marked = weights.withColumn("_entry", F.col("assigned") & ~F.coalesce(before, F.lit(False)))
    sums = marked.groupBy(*keys, state).agg(F.count(F.lit(1)).alias("n_samples"), F.sum(w).alias("_w"), F.sum(w * F.col("gfp")).alias("_g"), F.avg(F.col("assigned").cast("double")).alias("_a"), F.sum(F.col("_entry").cast("long")).alias("_e"))
    there = F.col("_w") > 2.220446049250313e-16
    seconds = F.col("n_samples") / rate
    return sums.select(
        *keys, state, "n_samples", F.when(there, F.col("_w") / F.col("n_samples")).alias("occupancy"), F.when(there, 100 * F.col("_a")).alias("percentage_present"),
        F.when(there, F.try_divide(F.col("_g"), F.col("_w"))).alias("mean_gfp"), F.when(there, F.col("_e")).alias("occurrences"), F.when(there, F.col("_e") / seconds).alias("rate_hz"),
    )


def joint_entropy(rows: DataFrame, by: list[str], weights: str) -> DataFrame:
    """entropy_bits: the differential entropy of a group's rows of weights, each summing to one, by three to five equal bins a dimension; null for fewer than 16 rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    bins = F.least(F.lit(5), F.greatest(F.lit(3), F.round(F.pow(F.col("_n").cast("double"), 1.0 / F.greatest(F.size(weights) + 1, F.lit(2)))).cast("int")))
    binned = rows.withColumn("_n", n).withColumn("_b", bins).withColumn("_cell", F.transform(weights, lambda x: F.least(F.floor(F.greatest(x, F.lit(0.0)) * F.col("_b")), F.col("_b") - 1).cast("int")))
    counts = binned.groupBy(*by, "_n", "_b", F.size(weights).alias("_d"), "_cell").agg(F.count(F.lit(1)).alias("c"))
    h = F.log2(F.first("_n").cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / F.first("_n") - F.first("_d") * F.log2(F.first("_b").cast("double"))
    return counts.groupBy(*by).agg(F.first("_n").alias("n"), F.when(F.first("_n") >= 16, h).alias("entropy_bits"))


def binned_information(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """n, mi_bits, nmi of two quantities of a group, each scaled to [0, 1], by 6 to 16 equal bins; null for fewer than 16 rows or a constant quantity."""
    w = Window.partitionBy(*by)
    scaled = rows.withColumn("_n", F.count(F.lit(1)).over(w))
    for name, c in (("_x", a), ("_y", b)):
        low, high = F.min(c).over(w), F.max(c).over(w)
        scaled = scaled.withColumn(name, F.when(high > low, (F.col(c) - low) / (high - low)))
    bins = F.least(F.lit(16), F.greatest(F.lit(6), F.round(F.sqrt(F.col("_n").cast("double")) / 2).cast("int")))
    cell = lambda c: F.least(F.floor(F.col(c) * F.col("_b")), F.col("_b") - 1).cast("int").alias(c)
    counts = scaled.withColumn("_b", bins).groupBy(*by, "_n", cell("_x"), cell("_y")).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("_p", F.col("c") / F.col("_n")).withColumn("_px", F.sum("c").over(Window.partitionBy(*by, "_x")) / F.col("_n")).withColumn("_py", F.sum("c").over(Window.partitionBy(*by, "_y")) / F.col("_n"))
    # a marginal's entropy is the mean of -log2 of it over the joint
    sums = counts.groupBy(*by).agg(F.first("_n").alias("n"), F.sum(F.col("_p") * F.log2(F.col("_p") / (F.col("_px") * F.col("_py")))).alias("mi"), F.sum(-F.col("_p") * F.log2("_px")).alias("hx"), F.sum(-F.col("_p") * F.log2("_py")).alias("hy"), F.count_if(F.col("_x").isNull() | F.col("_y").isNull()).alias("_flat"))
    good = (F.col("n") >= 16) & (F.col("_flat") == 0)
    return sums.select(*by, "n", F.when(good, F.col("mi")).alias("mi_bits"), F.when(good, F.col("mi") / F.greatest(F.sqrt(F.col("hx") * F.col("hy")), F.lit(2.220446049250313e-16))).alias("nmi"))


def upper_outliers(df: DataFrame, by: list[str], value: str, multiplier: float = 3.0, share: float = 0.995, least: int = 5) -> DataFrame:
    """Adds ``threshold`` and ``keep``: values up to median + multiplier * 1.4826 * MAD, or, where the MAD is 0, up to the quantile ``share``.

    A group with fewer than max(5, ``least``) values, or one that would keep fewer than ``least``, keeps all.
    """
    medians = df.groupBy(*by).agg(F.median(value).alias("_m"), F.percentile(value, F.lit(share)).alias("_q"), F.count(value).alias("_n"))
    dev = df.join(medians, by)
    mads = dev.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("_m"))).alias("_mad"))
    dev = dev.join(mads, by).withColumn("threshold", F.when(F.col("_n") >= max(5, least), F.when(F.col("_mad") > 2.220446049250313e-16, F.col("_m") + multiplier * 1.4826 * F.col("_mad")).otherwise(F.col("_q"))))
    below = F.coalesce(F.col(value) <= F.col("threshold"), F.lit(True))
    kept = F.sum(below.cast("long")).over(Window.partitionBy(*by))
    return dev.withColumn("keep", below | (kept < least)).drop("_m", "_q", "_n", "_mad")


def principal_planes(rows: DataFrame, keys: list[str], vectors: list[str], axis: str) -> DataFrame:
    """keys and, for each column of vectors, the struct <column>_pc: first, second (per cent of the variance), on_axis (the first component's cosine with the axis, absolute), one, two (the components).

    Cross products are summed by Arrow batch, then over the batches of a key.
    The largest entry of a component is positive, so that its sign is settled;
    of two components whose variances are equal, any may be the first. Null for
    fewer than two rows or no variance.
    """
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]

    def partial(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, np.int64)
            for i in range(len(keys)):
                values = batch.column(i).dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(values.dictionary) + values.indices.to_numpy(), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            ends, first = np.append(starts[1:], len(order)), pa.array(order[starts])
            out = [batch.column(i).take(first) for i in range(len(keys))]
            out += [pa.array(ends - starts, pa.int64()), batch.column(len(keys)).take(first)]
            for i in range(len(vectors)):
                x = batch.column(len(keys) + 1 + i).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(order), -1)[order]
                grams = np.stack([(x[m:n].T @ x[m:n]).ravel() for m, n in zip(starts, ends)])
                sums_ = np.hstack((np.add.reduceat(x, starts, axis=0), grams))
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * sums_.shape[1], pa.int32()), pa.array(sums_.ravel())))
            yield pa.RecordBatch.from_arrays(out, [*keys, "n", "axis", *vectors])

    sums = rows.select(*keys, axis, *vectors).mapInArrow(partial, ", ".join([*kinds, "n long", "axis array<double>", *(f"{v} array<double>" for v in vectors)]))
    sums = sums.groupBy(*keys).agg(F.sum("n").alias("n"), F.first("axis").alias("axis"), *[vector_to_array(Summarizer.sum(array_to_vector(v))).alias(v) for v in vectors])
    plane = "struct<first:double,second:double,on_axis:double,one:array<double>,two:array<double>>"

    def planes(n: np.ndarray, sums_: np.ndarray, to: np.ndarray) -> list:
        d = to.shape[1]
        mean, gram = sums_[:, :d] / n[:, None], sums_[:, d:].reshape(-1, d, d)
        size, basis = np.linalg.eigh(np.where((n > 1)[:, None, None], gram - n[:, None, None] * mean[:, :, None] * mean[:, None, :], 0.0))
        size, basis = np.maximum(size[:, ::-1], 0), basis[:, :, ::-1]
        top = np.take_along_axis(basis, np.abs(basis).argmax(axis=1)[:, None], axis=1)
        basis = basis * np.sign(top)
        whole = size.sum(axis=1)
        on_axis = np.abs(np.einsum("gd,gd->g", basis[:, :, 0], to))
        some, two = (n > 1) & (whole / np.maximum(n - 1, 1) > 1e-15), d > 1
        return [{"first": 100 * s[0] / t, "second": 100 * s[1] / t if two else None, "on_axis": a, "one": b[:, 0].tolist(), "two": b[:, 1].tolist() if two else None} if ok else None for s, t, a, b, ok in zip(size, whole, on_axis, basis, some)]

    def solved(batches):
        for pdf in batches:
            n, wide = pdf["n"].to_numpy(), pdf["axis"].map(len).to_numpy()
            for v in vectors:
                out = np.empty(len(pdf), object)
                for d in np.unique(wide):
                    at = np.flatnonzero(wide == d)
                    for i, found in zip(at, planes(n[at], np.stack(pdf[v].to_numpy()[at]), np.stack(pdf["axis"].to_numpy()[at]))):
                        out[i] = found
                pdf[f"{v}_pc"] = pd.Series(out, index=pdf.index, dtype=object)
            yield pdf[[*keys, *(f"{v}_pc" for v in vectors)]]

    return sums.mapInPandas(solved, ", ".join([*kinds, *(f"{v}_pc {plane}" for v in vectors)]))


def axis_dynamics(samples: DataFrame, centres: DataFrame, rate: float, least: int = 2, rec: str = "rec", order: str = "pos", map_: str = "map", state: str = "k") -> DataFrame:
    """How the samples of each record and state move about the state's axis: projections, angles, energy, principal components of the residual and its precession.

    Samples (rec, pos, map, k) meet their own state's axis (k, centre) only; what
    they are to it are columns, its sums are taken in every task, and the two
    principal components of the residual are joined back for the phases. A record
    has a row for each state of ``centres``; a state with fewer than ``least``
    samples, or two, has null measures. Samples of no state count in ``n_samples`` alone.
    Positions of a record differ.
    """
    axes = small(centres.select(F.col("k").alias(state), A.unit("centre").alias("_axis")), 1000)
    w = Window.partitionBy(rec).orderBy(order)
    rows = samples.select(rec, order, map_, state).join(axes, state, "left").withColumn("_next", F.coalesce(F.lag(state).over(w) == F.col(state), F.lit(False)))
    rows = rows.withColumn("_map", F.col(map_).cast("array<double>")).withColumn("_unit", A.unit("_map"))
    rows = rows.withColumn("_s", A.dot("_map", "_axis")).withColumn("_p", A.clamped(A.dot("_unit", "_axis")))
    rows = rows.withColumn("_rest", F.zip_with("_unit", "_axis", lambda u, a: F.when(F.col("_p") < 0, -u).otherwise(u) - F.abs("_p") * a))
    of = rows.where("_axis is not null")
    planes = principal_planes(of, [rec, state], ["_unit", "_rest"], "_axis")
    parts = [(name, f"{v}_pc.{field}") for name, v, field in (("pc1_pct", "_unit", "first"), ("pc2_pct", "_unit", "second"), ("pc1_axis_corr", "_unit", "on_axis"), ("residual_pc1_pct", "_rest", "first"), ("residual_pc2_pct", "_rest", "second"))]
    planes = planes.select(F.col(rec).alias("_r"), F.col(state).alias("_k"), F.col("_rest_pc.one").alias("_one"), F.col("_rest_pc.two").alias("_two"), *[F.col(path).alias(name) for name, path in parts])
    at = of.join(planes, F.col(rec).eqNullSafe(F.col("_r")) & (F.col(state) == F.col("_k")), "left")
    at = at.withColumn("_phase", F.when(F.col("_two").isNotNull(), F.atan2(A.dot("_rest", "_two"), A.dot("_rest", "_one"))))
    at = at.withColumn("_angle", F.degrees(F.acos(F.abs("_p")))).withColumn("_before", F.when(F.col("_next"), F.lag("_s").over(w)))
    turn = F.col("_phase") - F.lag("_phase").over(w)
    at = at.withColumn("_turn", F.when(F.col("_next"), turn - 2 * math.pi * F.floor((turn + math.pi) / (2 * math.pi))))
    n, seconds, deg = F.count(F.lit(1)), F.count(F.lit(1)) / rate, rate * 180 / math.pi
    size = F.abs("_turn")
    measures = {
        "projection_rms": F.sqrt(F.avg(F.col("_s") * F.col("_s"))), "projection_sd": F.stddev("_s"), "projection_mean_abs": F.avg(F.abs("_s")), "zero_crossing_hz": F.count_if(F.col("_s") * F.col("_before") < 0) / seconds,
        "energy_fraction": F.avg(F.col("_p") * F.col("_p")), "angle_mean_deg": F.avg("_angle"), "angle_sd_deg": F.stddev("_angle"), "angle_median_deg": F.median("_angle"), "perpendicular_fraction": F.avg(1 - F.col("_p") * F.col("_p")),
        "phase_resultant": F.sqrt(F.pow(F.avg(F.cos("_phase")), 2) + F.pow(F.avg(F.sin("_phase")), 2)),
        "precession_deg_s": F.avg("_turn") * deg, "precession_abs_deg_s": F.avg(size) * deg, "precession_median_deg_s": F.median(size) * deg, "abs_cycles_s": F.sum(size) / (2 * math.pi) / seconds, "net_cycles_s": F.sum("_turn") / (2 * math.pi) / seconds,
        "directionality": F.abs(F.sum("_turn")) / F.greatest(F.sum(size), F.lit(1e-15)), "positive_fraction": F.avg((F.col("_turn") > 0).cast("int")), "negative_fraction": F.avg((F.col("_turn") < 0).cast("int")),
    }
    stats = at.groupBy(rec, state).agg(n.alias("n_active"), F.count_if(~F.col("_next")).alias("n_runs"), *[m.alias(name) for name, m in measures.items()], *[F.first(name).alias(name) for name, _ in parts])
    # a row for each record and state: the states are few, the records' totals one row each
    names = axes.agg(F.collect_set(state).alias("_states"))
    every = samples.groupBy(rec).agg(n.alias("n_samples")).crossJoin(F.broadcast(names)).select(F.col(rec).alias("_r"), "n_samples", F.explode("_states").alias("_k"))  # one row
    out = every.join(stats, F.col(rec).eqNullSafe(F.col("_r")) & (F.col(state) == F.col("_k")), "left")
    active = F.coalesce("n_active", F.lit(0))
    enough = active >= max(2, least)
    shown = "projection_rms projection_sd projection_mean_abs zero_crossing_hz energy_fraction pc1_pct pc2_pct pc1_axis_corr angle_mean_deg angle_sd_deg angle_median_deg perpendicular_fraction residual_pc1_pct residual_pc2_pct phase_resultant precession_deg_s precession_abs_deg_s precession_median_deg_s abs_cycles_s net_cycles_s directionality positive_fraction negative_fraction".split()
    return out.select(
        F.col("_r").alias(rec), F.col("_k").alias(state), "n_samples", active.alias("n_active"), (active / F.col("n_samples")).alias("active_fraction"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
        *[F.when(enough, F.col(c)).alias(c) for c in shown],
    )


def adjacent_clusters(df: DataFrame, flag: Column, by: list[str], at: str, effect: str) -> DataFrame:
    """Runs of neighbouring flagged bins: first, last, number, and the largest absolute effect."""
    flagged = df.where(flag).withColumn("island", F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at)))
    return flagged.groupBy(*by, "island").agg(F.min(at).alias("first_bin"), F.max(at).alias("last_bin"), F.count(F.lit(1)).alias("n_bins"), F.max(F.abs(F.col(effect))).alias("peak")).drop("island")
