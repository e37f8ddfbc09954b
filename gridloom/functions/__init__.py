"""Functions that Spark lacks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps; 93 are enough for any two longs."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))

    def step(s, _):
        return F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).cast("long").alias("y")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.try_divide(F.abs(a), gcd(a, b)).cast("long") * F.abs(b))


def trunc(x: Column) -> Column:
    """Towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def date_bin(seconds: int, ts: Column, origin: Column | None = None) -> Column:
    """Start of the interval of so many seconds, counted from the origin (1970), that holds a timestamp."""
    base = F.unix_micros(origin) if origin is not None else F.lit(0)
    width = seconds * 1_000_000
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts) - base, F.lit(width)))


def approx_percentile_weighted(x: Column, weight: Column, p: float) -> Column:
    """Percentile of values counted with integer weights (exact, by frequencies)."""
    return F.percentile(x, F.lit(p), weight)
