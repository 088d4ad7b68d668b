"""Events found in sampled channels: beats of a cardiac channel, annotations of a code channel.

A record's samples (rec, pos, x) are dealt to blocks of positions with copies of
those that a block's border needs, so a long record is many tasks and every
decision is made once. Windows reach over positions, not rows: a gap is a gap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a block, at least.
BLOCK = 1 << 16
#: Codes of a status channel that mark the device's own state, not an event.
NO_EVENT = (65536, 65542)


def dealt(samples: DataFrame, before: int, after: int, block: int, pos: str) -> DataFrame:
    """Adds ``_b``, the block that a sample is of or near, and ``_own``, whether it is of it; a block sees ``before`` and ``after`` positions of its neighbours."""
    at = lambda shift: F.floor((F.col(pos) + shift) / block)
    near = F.explode(F.array_distinct(F.array(at(-after), at(0), at(before))))
    return samples.select("*", near.alias("_b")).withColumn("_own", at(0) == F.col("_b"))


def detected_beats(samples: DataFrame, rate: float, width_s: float = 0.1, refractory_s: float = 0.3, slot_s: float = 2.0, reach: int = 5, share: float = 0.5, rec: str = "rec", pos: str = "pos", x: str = "x", block: int = BLOCK) -> DataFrame:
    """rec, pos, height, sign of the beats of each record's channel.

    A sample's height is by how much it stands above the higher of the two
    lowest samples within ``width_s`` before and after it (``sign`` 1), or below
    alike (-1); slow drifts and offsets hardly change it. A candidate is the
    highest within the refractory time on both sides, the earliest of equal
    ones. It is a beat if it has ``share`` of the (lower) median, over ``reach``
    slots of ``slot_s`` on both sides, of each slot's highest candidate, so the
    threshold follows the signal. The sign with the larger median over the
    record is taken, 1 if they are equal. Samples that are null or not a number
    are none; repeated positions count once, by their greatest height. A record
    without any variation has no beats.

    Samples are shuffled once, to blocks. What follows has the candidates alone:
    at most one in a refractory time, gathered by slot.
    """
    h, r, slot = (max(1, round(s * rate)) for s in (width_s, refractory_s, slot_s))
    rows = samples.select(rec, F.col(pos).cast("long").alias(pos), F.col(x).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    w = Window.partitionBy(rec, "_b").orderBy(pos)
    left, right = w.rangeBetween(-h, 0), w.rangeBetween(0, h)
    up = F.col("_x") - F.greatest(F.min("_x").over(left), F.min("_x").over(right))
    down = F.least(F.max("_x").over(left), F.max("_x").over(right)) - F.col("_x")
    seen = dealt(rows, h + r, h + r, max(block, 4 * (h + r)), pos).withColumn("_up", up).withColumn("_down", down)
    most = lambda c, a, b: F.coalesce(F.max(c).over(w.rangeBetween(a, b)), F.lit(0.0))
    found = lambda c, sign: F.when((F.col(c) > most(c, -r, -1)) & (F.col(c) >= most(c, 1, r)), F.struct(F.lit(sign).alias("sign"), F.col(c).alias("height")))
    peaks = seen.withColumn("_found", F.array_compact(F.array(found("_up", 1), found("_down", -1)))).where("_own and size(_found) > 0").select(rec, pos, F.inline("_found"))
    peaks = peaks.groupBy(rec, "sign", F.floor(F.col(pos) / slot).alias("_slot"), pos).agg(F.max("height").alias("height"))
    slots = peaks.groupBy(rec, "sign", "_slot").agg(F.max("height").alias("_top"), F.collect_list(F.struct(pos, "height")).alias("_peaks"))  # a slot has slot / refractory of them
    median = F.expr("percentile_disc(0.5) within group (order by _top)")
    near = slots.select(rec, "sign", "_top", F.explode(F.sequence(F.col("_slot") - reach, F.col("_slot") + reach)).alias("_at"), "_slot", "_peaks")
    near = near.withColumn("_peaks", F.when(F.col("_at") == F.col("_slot"), F.col("_peaks")))
    levels = near.groupBy(rec, "sign", "_at").agg(median.alias("_level"), F.first("_peaks", ignorenulls=True).alias("_peaks")).where("_peaks is not null")
    signs = slots.groupBy(rec, "sign").agg(median.alias("_m")).groupBy(rec).agg(F.max_by("sign", F.struct("_m", "sign")).alias("sign"))
    return levels.join(signs, [rec, "sign"]).select(rec, "sign", "_level", F.inline("_peaks")).where(F.col("height") >= share * F.col("_level")).select(rec, pos, "height", "sign")


def code_annotations(samples: DataFrame, rate: float, ignored: Sequence[int] = NO_EVENT, rec: str = "rec", pos: str = "pos", code: str = "code", block: int = BLOCK) -> DataFrame:
    """rec, pos, onset_s, duration_s, description of the events of a code channel: positions at which the code rises, from none (0) or another.

    The first sample of a record, or after a gap, begins no event. An event lasts
    until the code changes again, and has null as its duration if it does not.
    ``ignored`` codes are no events. A null code is 0. Positions are met once in a record.

    Samples are shuffled once, to blocks with one sample of the block before;
    only the changes are sorted by record.
    """
    rows = samples.select(rec, F.col(pos).cast("long").alias(pos), F.coalesce(F.col(code).cast("long"), F.lit(0)).alias("_code"))
    w = Window.partitionBy(rec, "_b").orderBy(pos)
    before = F.when(F.lag(pos).over(w) == F.col(pos) - 1, F.lag("_code").over(w))
    changes = dealt(rows, 1, 0, block, pos).withColumn("_before", before).where("_own and _code <> _before")
    following = F.lead(pos).over(Window.partitionBy(rec).orderBy(pos))
    changes = changes.withColumn("_next", following).where((F.col("_code") > F.col("_before")) & ~F.col("_code").isin(*ignored, 0))
    return changes.select(rec, pos, (F.col(pos) / rate).alias("onset_s"), ((F.col("_next") - F.col(pos)) / rate).alias("duration_s"), F.col("_code").cast("string").alias("description"))
