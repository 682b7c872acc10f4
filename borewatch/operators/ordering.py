"""Ordered series per key that survive a key holding a large share of all rows.

Row ordinals, trailing frames and running totals are usually written as one window per
key, which puts a whole key into one task.  `KeyedSeries` keeps that plan (one shuffle)
while every key is small, and cuts larger keys into blocks of consecutive rows:

* ordinals of large keys come from one range shuffle on (key, order) and a prefix sum over
  partition sizes, so no task sees more than its range;
* each block carries the last `halo` rows of the block before it, so trailing frames of up
  to `halo` rows are exact inside a block;
* running sums and minima are two-level: inside the block, plus the total of earlier blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, Window, WindowSpec
from pyspark.sql import functions as F

from borewatch.session import cut_lineage

POS = "_pos"
BLOCK = "_block"
HALO = "_halo"

# Rows of one key a single task may sort and buffer; a key above this is cut into blocks.
DEFAULT_BLOCK_ROWS = 1_000_000

# Largest counted row number of a narrow side for which a broadcast is asked for.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class KeyedSeries:
    """Rows with their 1-based ordinal per key (`_pos`), block number and halo mark."""

    df: DataFrame
    keys: list[str]
    split: bool
    block_rows: int
    halo: int

    @classmethod
    def build(
        cls,
        df: DataFrame,
        keys: list[str],
        order: list[str],
        halo: int = 0,
        block_rows: int = DEFAULT_BLOCK_ROWS,
    ) -> "KeyedSeries":
        if block_rows < max(halo, 1):
            raise ValueError("block_rows must be at least the halo")
        # Key column only, combined map-side; one row reaches the driver.
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        large = sizes.filter(F.col("_n") > block_rows)
        found = large.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys")).first()
        by_key = Window.partitionBy(*keys).orderBy(*order)
        if not found["keys"]:
            placed = df.withColumn(POS, F.row_number().over(by_key).cast("long"))
            return cls(_one_block(placed), keys, False, block_rows, halo)
        large = small_side(large.select(*keys), found["keys"])
        small_rows = join_null_safe(df, large, keys, "left_anti").withColumn(POS, F.row_number().over(by_key).cast("long"))
        large_rows = _range_ordinals(join_null_safe(df, large, keys, "left_semi"), keys, order, found, block_rows)
        placed = small_rows.unionByName(large_rows.select(*small_rows.columns))
        return cls(_blocks(placed, block_rows, halo), keys, True, block_rows, halo)

    @classmethod
    def from_ordinals(
        cls, df: DataFrame, keys: list[str], pos: str, split: bool, halo: int = 0, block_rows: int = DEFAULT_BLOCK_ROWS
    ) -> "KeyedSeries":
        """Wrap rows whose ordinal is already known; `split` says whether some key exceeds a block."""
        placed = df.withColumn(POS, F.col(pos).cast("long"))
        blocked = _blocks(placed, block_rows, halo) if split else _one_block(placed)
        return cls(blocked, keys, split, block_rows, halo)

    @property
    def group(self) -> list[str]:
        return [*self.keys, BLOCK]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(POS)

    def trailing(self, first: int, last: int) -> WindowSpec:
        """Frame from `first` to `last` rows relative to the current one (both <= 0)."""
        self.demand(-first)
        return self.window().rowsBetween(first, last)

    def demand(self, rows: int) -> None:
        """Refuse a frame of more rows than the halo, whether or not a key is cut into blocks."""
        if rows > self.halo:
            raise ValueError(f"frame of {rows} rows needs a halo of as many rows, got {self.halo}")

    def transform(self, step: Callable[[DataFrame], DataFrame]) -> "KeyedSeries":
        return replace(self, df=step(self.df))

    def rows(self, keep_position: bool = True) -> DataFrame:
        """The original rows once each, without halo copies."""
        out = (self.df.filter(~F.col(HALO)) if self.split else self.df).drop(HALO)
        return out if keep_position else out.drop(POS, BLOCK)

    def running(self, value: Column, out: str, how: str = "sum") -> "KeyedSeries":
        """Running sum, minimum or maximum from the first row of the key up to the current row."""
        combine = {"sum": F.sum, "min": F.min, "max": F.max}[how]
        own = F.when(~F.col(HALO), value) if self.split else value
        upto = self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = self.df.withColumn("_own", own).withColumn(out, combine("_own").over(upto))
        if not self.split:
            return replace(self, df=local.drop("_own"))
        # One row per block: the window below spans the blocks of a key, not its rows.
        earlier = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        totals = (
            local.groupBy(*self.group)
            .agg(combine("_own").alias("_total"))
            .select(*self.group, combine("_total").over(earlier).alias("_before"))
        )
        joined = join_null_safe(local, totals, self.group, "left")
        if how == "sum":
            value_upto = F.coalesce(F.col(out), F.lit(0)) + F.coalesce(F.col("_before"), F.lit(0))
        else:
            value_upto = {"min": F.least, "max": F.greatest}[how](F.col(out), F.col("_before"))
        return replace(self, df=joined.withColumn(out, value_upto).drop("_own", "_before"))


def _one_block(placed: DataFrame) -> DataFrame:
    return placed.withColumn(BLOCK, F.lit(0).cast("long")).withColumn(HALO, F.lit(False))


def _blocks(placed: DataFrame, block_rows: int, halo: int) -> DataFrame:
    """Number the blocks, and repeat the last `halo` rows of each block in the next one."""
    home = F.floor((F.col(POS) - 1) / F.lit(block_rows)).cast("long")
    inside = (F.col(POS) - 1) % F.lit(block_rows)
    copies = F.when(
        inside >= block_rows - halo,
        F.array(
            F.struct(home.alias(BLOCK), F.lit(False).alias(HALO)),
            F.struct((home + 1).alias(BLOCK), F.lit(True).alias(HALO)),
        ),
    ).otherwise(F.array(F.struct(home.alias(BLOCK), F.lit(False).alias(HALO))))
    return placed.withColumn("_copy", F.explode(copies)).select("*", "_copy.*").drop("_copy")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on `keys` of both sides where null meets null; the keys of the left side stay."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only for a counted, small side; otherwise leave the join to the optimizer."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _range_ordinals(df: DataFrame, keys: list[str], order: list[str], found: Row, block_rows: int) -> DataFrame:
    """Exact ordinal per key from a range shuffle: rank in the global order minus the key's first rank."""
    partitions = max(2, -(-found["rows"] // block_rows))
    ordered = (
        df.repartitionByRange(partitions, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_rid", F.monotonically_increasing_id())
    )
    # Range bounds come from a sample: fix the outcome before it is read more than once.
    ordered = cut_lineage(ordered).withColumn("_part", F.shiftrightunsigned("_rid", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    ranked = ordered.join(small_side(offsets, partitions), "_part").withColumn(
        "_rank", F.col("_offset") + F.col("_rid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    first = ranked.groupBy(*keys).agg(F.min("_rank").alias("_first"))
    return (
        join_null_safe(ranked, small_side(first, found["keys"]), keys)
        .withColumn(POS, F.col("_rank") - F.col("_first") + 1)
        .drop("_rid", "_part", "_offset", "_rank", "_first")
    )
