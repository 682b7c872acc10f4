"""Exact quantiles of large groups by rank selection over successive value ranges.

A quantile is the value of one rank, or lies between those of two.  Each round counts the values of a range in some
hundreds of parts and keeps the part that holds the rank, so a group's values are never gathered: a round is one scan with
a combined aggregate.  Parts remember their smallest and largest value, which is what the next round divides; so a few
values far out cost one round, not many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borewatch.operators.ordering import BROADCAST_ROWS, join_null_safe
from borewatch.session import stored_once

# Parts of a range, and values of a range that are sorted rather than divided again.
PARTS, FEW = 512, 4096


def exact_quantiles(
    df: DataFrame, value: str, keys: list[str], shares: list[float], names: list[str], few: int = FEW, parts: int = PARTS
) -> DataFrame:
    """Per group the quantiles of a column, with linear interpolation between ranks: keys and one column per name.

    Nulls and NaN don't count; groups without values have null quantiles.  Infinite values are values like any other.
    """
    if not keys:
        whole = exact_quantiles(df.withColumn("_all", F.lit(0)), value, ["_all"], shares, names, few, parts)
        return whole.drop("_all")
    v = F.col(value).cast("double")
    rows = df.select(*keys, F.when(~F.isnan(v), v).alias("_v"))
    groups = stored_once(
        rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    )
    place = F.array(*[(F.col("_n") - 1) * F.lit(float(s)) for s in shares])
    ranks = F.array_distinct(F.flatten(F.transform(place, lambda p: F.array(F.floor(p), F.ceil(p)))))
    # What is sought: a rank of the group, in a range of values of which `_n` are in it and `_below` are smaller.
    open_ranges = groups.filter("_n > 0").select(
        *keys, F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_below"), "_n", "_low", "_high"
    )
    done = None
    while True:
        single = F.col("_low") == F.col("_high")
        settled = open_ranges.filter(single).select(*keys, "_rank", F.col("_low").alias("_value"))
        small = open_ranges.filter(~single & (F.col("_n") <= few))
        found = stored_once(settled.unionByName(_sorted_out(rows, small, keys)))
        done = found if done is None else done.unionByName(found)
        open_ranges = open_ranges.filter(~single & (F.col("_n") > few))
        if open_ranges.isEmpty():
            break
        open_ranges = stored_once(_narrowed(rows, open_ranges, keys, parts))
    known = done.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_values"))
    out = join_null_safe(groups.select(*keys, "_n"), known, keys, "left")

    def at(rank: Column) -> Column:
        return F.col("_values")[rank]

    def quantile(share: float) -> Column:
        p = (F.col("_n") - 1) * F.lit(float(share))
        low, high = at(F.floor(p)), at(F.ceil(p))
        return F.when(low == high, low).otherwise(low + (high - low) * (p - F.floor(p)))

    return out.select(*keys, *[quantile(s).alias(n) for s, n in zip(shares, names)])


def _inside(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the ranges of their group that hold them; a group has a few ranges at most."""
    distinct = ranges.select(*keys, "_low", "_high").distinct()
    distinct = F.broadcast(distinct) if distinct.count() <= BROADCAST_ROWS else distinct.hint("merge")
    met = join_null_safe(rows.filter("_v is not null"), distinct, keys)
    return met.filter(F.col("_v").between(F.col("_low"), F.col("_high")))


def _sorted_out(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Values of the ranks whose ranges hold few values."""
    if small.isEmpty():
        return small.select(*keys, "_rank", F.col("_low").alias("_value"))
    order = Window.partitionBy(*keys, "_low", "_high").orderBy("_v")
    numbered = _inside(rows, small, keys).withColumn("_at", F.row_number().over(order) - 1)
    asked = small.withColumn("_at", F.col("_rank") - F.col("_below")).select(*keys, "_low", "_high", "_rank", "_at")
    return join_null_safe(asked, numbered, [*keys, "_low", "_high", "_at"]).select(*keys, "_rank", F.col("_v").alias("_value"))


def _narrowed(rows: DataFrame, ranges: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Each rank with the part of its range that holds it."""
    v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
    width = high - low
    # infinite ends have parts of their own, which leaves a finite range between them
    inner = F.when(width < float("inf"), F.least(F.lit(parts - 2), F.floor((v - low) / width * (parts - 1)))).otherwise(F.lit(1))
    part = F.when(v == low, 0).when(v == high, parts - 1).otherwise(F.greatest(F.lit(1), inner))
    counted = _inside(rows, ranges, keys).groupBy(*keys, "_low", "_high", part.cast("int").alias("_part")).agg(
        F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_from"), F.max("_v").alias("_to")
    )
    # at most `parts` rows of a range
    before = Window.partitionBy(*keys, "_low", "_high").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    met = join_null_safe(ranges, counted, [*keys, "_low", "_high"])
    start = F.col("_below") + F.col("_before")
    held = met.filter((F.col("_rank") >= start) & (F.col("_rank") < start + F.col("_m")))
    return held.select(
        *keys, "_rank", start.alias("_below"), F.col("_m").alias("_n"), F.col("_from").alias("_low"), F.col("_to").alias("_high")
    )
