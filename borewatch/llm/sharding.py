"""Sharding by sampled splitters. DataFrame functions only.

A sample in which a record's chance grows with its size gives quantiles of the key: borders of ranges of about equal
bytes. Ranges that turn out overfull (a key that many records share) are subdivided by a hash of the id. Exact sizes
per range then place every record on one line, which is cut into shards of equal bytes; the sample decides only how
evenly the work is spread, not what comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borewatch.llm.common import copy_numbers, join_counted, materialise, running

SAMPLE_A_RANGE = 20
LEAST_RANGES, MOST_RANGES, RANGE_ROWS = 1024, 16_384, 100_000


def splitters(records: DataFrame, ranges: int, total: int) -> list[int]:
    """Borders between `ranges` ranges of key: quantiles of a sample of about SAMPLE_A_RANGE * ranges records, drawn
    with a chance in proportion to size; a record larger than the sampling step counts as often as it holds steps."""
    step = max(1.0, total / (SAMPLE_A_RANGE * ranges))
    draw = F.pmod(F.xxhash64("record", F.lit("draw")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    hits = F.floor(F.col("size") / step + draw).cast("long")
    marks = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    # a record counts once for each step it holds; all together there are about as many as the sample has records
    sample = records.select("key", hits.alias("hits")).where("hits > 0")
    sample = sample.select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("hits"))).alias("hit"))
    found = sample.agg(F.percentile_approx("key", marks, F.lit(100 * ranges)).alias("m")).first()["m"]
    return sorted(set(found or []))


def range_of(key: Column, borders: list[int]) -> Column:
    """Number of borders below the key, by bisection."""
    if not borders:
        return F.lit(0)
    steps = [1 << i for i in range(len(borders).bit_length() - 1, -1, -1)]
    table = F.lit(borders)

    def halve(at: Column, step: Column) -> Column:
        fits = at + step <= len(borders)
        return F.when(fits & (F.get(table, at + step - 1) < key), at + step).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), halve)


def place(records: DataFrame, n_shards: int) -> DataFrame:
    """Shard and slot of records (record, key long, size long > 0; other columns are kept)."""
    n, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, n // RANGE_ROWS))
    part = range_of(F.col("key"), splitters(records, ranges, total))
    dealt = records.withColumn("part", part)
    full = dealt.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    goal, rows = F.lit(max(1.0, total / ranges)), F.lit(max(1.0, n / ranges))
    pieces = F.greatest(F.col("part_size") / goal, F.col("part_rows") / rows)
    pieces = F.when(pieces > 2, F.ceil(pieces)).otherwise(F.lit(1))
    full = materialise(full.select("part", pieces.cast("long").alias("pieces")))
    dealt = join_counted(dealt, full, ["part"])
    # a high bit field for the range, a low one for the piece: one long orders both
    piece = F.pmod(F.xxhash64("record", F.lit("piece")), F.col("pieces"))
    dealt = dealt.withColumn("strip", F.shiftleft(F.col("part").cast("long"), 40) + piece).withColumn("one", F.lit(1))
    dealt = dealt.withColumn("block", F.col("part") % 1)  # one group: offsets over the line of all strips
    order = [F.col("key"), F.col("record")]
    line = running(dealt, ["block"], "strip", order, {"bytes_to": "size", "rows_to": "one"})
    middle = F.col("bytes_to") - F.col("size") / 2
    shard = F.least(F.floor(middle * n_shards / F.lit(float(max(1, total)))), F.lit(n_shards - 1)).cast("int")
    line = materialise(line.withColumn("shard", shard).drop("part", "pieces", "strip", "one", "block", "bytes_to"))
    first = line.groupBy("shard").agg(F.min("rows_to").alias("first_row"))
    return line.join(F.broadcast(first), "shard").withColumn("slot", F.col("rows_to") - F.col("first_row"))


def shards(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n_shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    The key is a hash of the text, so copies stand side by side and a group is cut only at a border of shards or where
    it overfills a range. Size: UTF-8 bytes plus 1. Shards differ by at most the largest document, or so; slots count
    from 0 without gaps. Null texts count as empty; null ids are sharded as any other, and rows that repeat an id and
    text share a key and take slots of their own; where they are more than 512, they are dealt out by a number. Empty tables give no rows; other columns are not looked at.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    records = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("key"),
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("record"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    records = copy_numbers(materialise(records).withColumn("same", F.xxhash64("record", "key")), "same")
    records = records.withColumn("record", F.concat_ws(":", "record", "copy_no")).drop("same", "copy_no", "row_no")
    out = place(materialise(records), n_shards)
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", n_shards: int = 16) -> DataFrame:
    """Write the documents as Parquet folders `shard=N`, rows in slot order within files of consecutive slots; returns
    the plan. Files hold 2^16 slots at most, so a shard is written by as many tasks as it needs."""
    plan = materialise(shards(docs, text=text, doc_id=doc_id, n_shards=n_shards))
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    mark = Window.partitionBy("doc_id", "text_crc32").orderBy("shard", "slot")
    same = Window.partitionBy(F.col(doc_id), crc).orderBy(F.lit(1))
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(doc_id).alias("d"),
                       crc.alias("c"), F.row_number().over(same).alias("copy"))
    right = plan.withColumn("copy_no", F.row_number().over(mark))
    on = left.d.eqNullSafe(right.doc_id) & (left.c == right.text_crc32) & (left.copy == right.copy_no)
    placed = left.join(right, on).select("row.*", "shard", "slot")
    file = F.floor(F.col("slot") / (1 << 16))
    placed.repartition("shard", file).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return plan
