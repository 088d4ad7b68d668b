"""Places of channels on the head, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16
#: Labels of channels that are not on the scalp, by their beginning and as a whole.
AUXILIARY = r"^(EXG|EOG|HEOG|VEOG|ECG|EKG|EMG|GSR|RESP|TRIG|STATUS|STI|MISC|AUX|REF)"
MASTOIDS = ["A1", "A2", "M1", "M2", "CB1", "CB2", "LM", "RM"]


def unit(x: Column, y: Column, z: Column) -> Column:
    """A struct (x, y, z) of length one; null for a null, infinite or zero vector."""
    n = F.sqrt(x * x + y * y + z * z)
    return F.when((n > EPS) & (n < float("inf")), F.struct((x / n).alias("x"), (y / n).alias("y"), (z / n).alias("z")))


def from_polar(theta_deg: Column, radius: Column) -> Column:
    """The unit vector of a place on a head seen from above; null if the radius is not positive."""
    theta = F.radians(theta_deg)
    inner = F.least(F.lit(1.0), radius / 0.5)
    up = F.sqrt(F.greatest(F.lit(0.0), 1 - inner * inner))
    return F.when(radius > 0, unit(radius * F.cos(theta), radius * F.sin(theta), up))


def placed(x: Column, y: Column, z: Column, theta_deg: Column, radius: Column) -> Column:
    """Cartesian coordinates where there are any, else polar ones."""
    return F.coalesce(unit(x, y, z), from_polar(theta_deg, radius))


def rotated(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    """A turn about the upward axis."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return x * c - y * s, x * s + y * c


def head_radius(x: Column, y: Column, z: Column) -> Column:
    """0 at the top, 0.5 at the level of the ears."""
    return F.when(F.sqrt(x * x + y * y + z * z) > EPS, 0.5 - F.degrees(F.atan2(z, F.sqrt(x * x + y * y))) / 180)


def on_scalp(label: Column, x: Column, y: Column, z: Column, limit: float = 0.5) -> Column:
    """Whether a channel is on the scalp: its label is not an auxiliary one and its place is within the limit. Without a place: no."""
    name = F.upper(F.trim(F.coalesce(label, F.lit(""))))
    return ~name.rlike(AUXILIARY) & ~name.isin(*MASTOIDS) & F.coalesce(head_radius(x, y, z) <= limit + EPS, F.lit(False))


def fibonacci_sphere(spark: SparkSession, n: int) -> DataFrame:
    """idx (from 0), x, y, z: ``n`` evenly spread places on the unit sphere."""
    i = F.col("id") + 0.5
    golden = (math.sqrt(5) - 1) / 2
    phi = 2 * math.pi * F.pmod(i * golden, F.lit(1.0))
    z = 1 - 2 * i / n
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    return spark.range(n).select(F.col("id").cast("int").alias("idx"), (r * F.cos(phi)).alias("x"), (r * F.sin(phi)).alias("y"), z.alias("z"))
