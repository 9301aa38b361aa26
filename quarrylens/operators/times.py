"""Joins in time: the last row before, and the intervals around a moment.

``asof`` sorts both sides together within a key's time bins and carries the last right row
forward; what a bin inherits comes from a row a bin.  So a key of any number of rows is
split by its bins.  ``within`` gives each interval the level of its length, on which it
touches two bins at most, and each moment one bin a level that occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], bin_seconds: int = 86_400, within_seconds: int | None = None, ties: list[str] | None = None) -> DataFrame:
    """Each left row with the ``values`` of the last right row of its key up to its time.

    Both sides have ``by`` and the timestamp ``at``; of right rows of one moment the last
    by ``ties`` counts.  Left rows without such a row, with a null key or a null time, keep
    nulls; with ``within_seconds`` older right rows don't count.
    """
    known = right.where(F.col(at).isNotNull())
    for c in by:
        known = known.where(F.col(c).isNotNull())
    carried = F.struct(F.col(at).alias("_at"), *(F.col(c) for c in (ties or [])), *(F.col(c).alias(f"_v_{c}") for c in values))
    bins = F.floor(F.unix_micros(at) / (bin_seconds * MICROS)).alias("_bin")
    keys = [F.col(c) for c in by]
    rows = left.select(*keys, bins, F.col(at), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(known.select(carried.alias("x")).schema["x"].dataType).alias("_held"))
    held = known.select(*keys, bins, F.col(at), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), carried.alias("_held"))
    both = rows.unionByName(held)
    before = Window.partitionBy(*by, "_bin").orderBy(F.col(at), F.col("_side"), F.col("_held")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_held", ignorenulls=True).over(before)).where("_side = 1")
    # the last right row of each bin, and what the bins after it inherit: a row a bin
    ends = held.groupBy(*by, "_bin").agg(F.max("_held").alias("_end"))
    every = rows.select(*by, "_bin").distinct().join(ends, [*by, "_bin"], "full_outer")
    earlier = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    inherited = every.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).where("_before is not null").drop("_end")
    joined = seen.join(inherited, [*by, "_bin"], "left").withColumn("_last", F.coalesce("_last", "_before"))
    fits: Column = F.col("_last").isNotNull()
    if within_seconds is not None:
        fits = fits & (F.unix_micros(F.col(at)) - F.unix_micros(F.col("_last._at")) <= within_seconds * MICROS)
    return joined.select("_row.*", *(F.when(fits, F.col(f"_last._v_{c}")).alias(c) for c in values))


def within(moments: DataFrame, intervals: DataFrame, by: list[str], at: str, begin: str, end: str) -> DataFrame:
    """Each moment with each interval of its key around it (``begin <= at < end``).

    Column names other than ``by`` differ.  Empty and null intervals hold nothing.
    """
    micros = lambda c: F.unix_micros(F.col(c))
    length = micros(end) - micros(begin)
    level = F.ceil(F.log2(length.cast("double"))).cast("int")
    own = intervals.where(F.col(begin) < F.col(end)).withColumn("_level", level)
    size = F.expr("shiftleft(1L, _level)")
    own = own.withColumn("_bin", F.explode(F.sequence(F.floor(micros(begin) / size), F.floor((micros(end) - 1) / size))))
    levels = [r["_level"] for r in own.select("_level").distinct().collect()]  # 63 at most
    if not levels:
        return moments.join(intervals, by).where("false")
    opened = moments.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, sorted(levels)))))
    opened = opened.withColumn("_bin", F.floor(micros(at) / F.expr("shiftleft(1L, _level)")))
    met = opened.join(own, [*by, "_level", "_bin"])
    return met.where((F.col(begin) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_level", "_bin")
