"""Range joins as equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, key: str, other: str, below: float, above: float, how: str = "inner") -> DataFrame:
    """Pairs with left.key - below < right.other < left.key + above, or at those ends: filter the result for open ends.

    Values fall in buckets as wide as the range; a left row meets the two or three buckets its range touches, a right row is in one: no
    pair comes twice, none is lost, and both sides shuffle by bucket instead of meeting all rows. Integers must stay below 2**53.
    """
    width = float(below + above) or 1.0
    lows, highs = F.floor((F.col(f"__l.{key}") - below) / width), F.floor((F.col(f"__l.{key}") + above) / width)
    a = left.select(F.struct("*").alias("__l")).withColumn("__bucket", F.explode(F.sequence(lows, highs)))
    b = right.select(F.struct("*").alias("__r")).withColumn("__bucket", F.floor(F.col(f"__r.{other}") / width))
    inside = (F.col(f"__r.{other}") >= F.col(f"__l.{key}") - below) & (F.col(f"__r.{other}") <= F.col(f"__l.{key}") + above)
    return a.join(b, "__bucket").where(inside).select("__l", "__r")
