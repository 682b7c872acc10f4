"""Helpers shared by the operators: words, tables written once, running totals, components."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from borewatch.session import ensure_checkpoint_dir

#: A word is a run of anything but the six ASCII white-space characters.
GAP = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sides of at most this many narrow rows (some 100 bytes each) are broadcast; larger ones are joined by key.
BROADCAST_ROWS = 50_000
#: Rows of a key above which it is joined apart from the others.
HUB = 512
#: Parts over which the neighbours of a node are dealt where stars of a graph are joined.
HUB_PARTS = 8
#: Parts in which a large group of equal rows is numbered.
COPY_BUCKETS = 256


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared checkpoint folder and read them back.

    Columnar and compressed, so later steps read only the columns they name, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(docs: DataFrame) -> list[Column]:
    """The whole row as one struct, so that its columns can't clash with an operator's own, and a row number, which is
    fixed once the rows are written."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return [row.alias("carried"), F.monotonically_increasing_id().alias("row_no")]


def join_counted(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join `df` with a side that is usually small: broadcast where its counted rows allow it, a sort-merge join
    (whose skewed partitions are split at run time) where they don't."""
    small = F.broadcast(small) if small.count() <= BROADCAST_ROWS else small.hint("merge")
    return df.join(small, list(on), how)


def join_hubs(df: DataFrame, side: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join `df` with a side of at most one row per key, where a few keys may hold most rows of `df`.

    Rows of keys with more than HUB rows are joined with their counted keys by broadcast where those are few; the rest,
    at most HUB rows a key, by merge. Null keys join nothing.
    """
    hubs = df.groupBy(on).agg(F.count("*").alias("hub__rows")).where(F.col("hub__rows") > HUB).select(on)
    hubs = hubs.where(F.col(on).isNotNull())
    found = hubs.count()
    if not found or found > BROADCAST_ROWS:
        return df.join(side.hint("merge"), on, how)
    # few rows, so they are written as one file
    hubs = materialise(hubs.repartition(1))
    few = materialise(side.join(F.broadcast(hubs), on, "left_semi").repartition(1))
    many = df.join(F.broadcast(hubs), on, "left_semi").join(F.broadcast(few), on, how)
    rest = df.join(F.broadcast(hubs), on, "left_anti").join(side.hint("merge"), on, how)
    return many.unionByName(rest)


def copy_numbers(df: DataFrame, mark: str, row_no: str = "row_no") -> DataFrame:
    """Add copy_no: 0 where at most HUB rows share a `mark`, else the row's number among them, from 1.

    Tells equal rows of a large group apart, so that a hash over it deals them out. Which of the equal rows has which
    number doesn't matter; the numbers are the same however the rows are partitioned.
    """
    hubs = df.groupBy(mark).agg(F.count("*").alias("n")).where(F.col("n") > HUB).select(mark)
    found = hubs.count()
    if not found:
        return df.withColumn("copy_no", F.lit(0).cast("long"))
    hubs = materialise(hubs.repartition(1 + found // BROADCAST_ROWS))
    few = F.broadcast(hubs) if found <= BROADCAST_ROWS else hubs.hint("merge")
    rest = df.join(few, mark, "left_anti").withColumn("copy_no", F.lit(0).cast("long"))
    many = df.join(few, mark, "left_semi").withColumns(
        {"copy__bucket": F.pmod(F.xxhash64(row_no), F.lit(COPY_BUCKETS)), "copy__one": F.lit(1)}
    )
    many = running(many, [mark], "copy__bucket", [row_no], {"copy_no": "copy__one"})
    return rest.unionByName(many.drop("copy__bucket", "copy__one"))


def running(
    df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column | str], sums: dict[str, str]
) -> DataFrame:
    """Running totals within `group` in the order (bucket, *order), the own row included.

    Two levels: totals of (group, bucket) make the offsets, and only the rows of one bucket are sorted together, so a
    group with a third of all rows is spread over as many tasks as it has buckets. `sums` maps new columns to summed
    ones. Keys must not be null. Rows equal in the whole order stand in any order among themselves.
    """
    keys = [*group, bucket]
    parts = df.groupBy(*keys).agg(*(F.sum(col).alias(f"{out}__part") for out, col in sums.items()))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *keys, *(F.coalesce(F.sum(f"{out}__part").over(before), F.lit(0)).alias(f"{out}__before") for out in sums)
    )
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = df.withColumns({out: F.sum(col).over(upto) for out, col in sums.items()})
    joined = inner.join(offsets, keys)
    return joined.withColumns({out: F.col(out) + F.col(f"{out}__before") for out in sums}).drop(
        *(f"{out}__before" for out in sums)
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table (a, b): rows (node, component_id) with the smallest node of each component.

    Alternates large-star and small-star steps until the edges stop changing; every star takes its minimum by a
    combined aggregate and meets it in HUB_PARTS parts, so a hub needs no single task. Nodes without an edge are not
    listed.
    """

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        """pairs (u, v). Large: all neighbours above u go to the least of u and its neighbours. Small: the other way."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # rows of a hub are dealt over parts, each of which meets a copy of its minimum
        dealt = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(HUB_PARTS)))
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HUB_PARTS - 1).cast("long")))
        joined = dealt.join(least.select("u", "m", copies.alias("part")).hint("merge"), ["u", "part"])
        if large:
            return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("a <> b").distinct()

    now = materialise(tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))

    def sign(df: DataFrame) -> tuple:
        mark = F.xxhash64("a", "b")
        return tuple(df.agg(F.count("*"), F.sum(mark.cast("decimal(20,0)")), F.bit_xor(mark)).first())

    last, seen = None, sign(now)
    while seen != last and seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        larger = tidy(stars(both, large=True))
        # each edge points from its larger end to its smaller
        down = larger.select(F.col("a").alias("u"), F.col("b").alias("v"))
        now = materialise(tidy(stars(down, large=False)))
        last, seen = seen, sign(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component_id")).unionByName(roots)


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def hexed_share(value: Column, salt: str) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of `salt:value`: the same in every run and in any other engine."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(value.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
