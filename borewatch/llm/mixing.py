"""Mixing sources to target weights by Efraimidis-Spirakis keys. DataFrame functions only.

Every document draws the exponential key -ln(u) / weight, where u comes from a hash of its id and text and the weight is
its quality; within a source, documents in the order of their keys are a weighted sample without replacement of every
length. A source whose target is above its size first gives whole epochs; the rest of the target is taken from the
front of that order, by a prefix sum of the sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borewatch.llm.common import carried, copy_numbers, hexed_share, join_counted, let, materialise, running, words

#: Characters of a word that lower the default quality weight.
ODD = r"[0-9#*$%&|<>@^~_=+\\/{}\[\]]"
#: Buckets of the key order in a source: at least the first, and enough for about the second number of documents each.
LEAST_BUCKETS, BUCKET_ROWS = 1024, 100_000


def quality_weight(text: Column, found: Column) -> Column:
    """The default weight: the squared share of a text's word characters that are no digits or signs, 0.01 at least."""
    n_chars = F.length(F.array_join(found, ""))
    n_odd = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(ODD))

    def squared(c: Column) -> Column:
        clean = (c[0] - c[1]) / c[0]
        return F.when(c[0] == 0, F.lit(0.01)).otherwise(F.greatest(clean * clean, F.lit(0.01)))

    return let(F.array(n_chars, n_odd), squared)


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Words to take of each source. sources: skey, source, source_size.

    Sources by code point, null last, weigh `weights` in turn and share `share` of all sizes; no target is above `most`
    times its source's size, and what is cut off is shared anew by weight among the others until none is above.
    Sources are cut in the order of their ratio of limit to weight, so one pass in that order finds all that are cut.
    The table has a row a source, for each of which a mix states a weight, so it is sorted in one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "skey")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumns(
        {
            "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
            "cut_before": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "weight_left": F.sum("weight").over(rest),
        }
    )
    over = (F.col("budget") - F.col("cut_before")) / F.col("weight_left") * F.col("weight") >= F.col("limit")
    s = s.withColumn("is_cut", over)
    cut = F.sum(F.when(F.col("is_cut"), F.col("limit")).otherwise(0.0)).over(everything)
    left = F.sum(F.when(F.col("is_cut"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("is_cut"), F.col("limit")).otherwise((F.col("budget") - cut) / left * F.col("weight"))
    return s.select("skey", "source_size", "n_docs", target.alias("target"))


def mix(
    docs: DataFrame,
    *,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weight: Column | None = None,
    source_weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    salt: str = "mix",
    carry: bool = False,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies. With `carry`: the whole rows
    that are taken, as `carried`, and their copies.

    `copies` whole copies of the document belong to the mix and `taken` = copies * size. The document at the border of
    the budget is taken if at least half of it fits, so a source misses its target by half a document at most.
    Null texts have size 0; null sources form a source of their own, the last; null ids draw as the empty id. A key is
    drawn from id and text, and where more than 512 rows are equal in both also from a number among them. Empty tables give no rows. Other columns,
    whatever their names, are not looked at. A document of size 0 takes nothing; it has the copies of its place.
    """
    body, origin = F.col(text), F.col(source)
    read = docs.select(
        F.col(doc_id).alias("doc_id"),
        body.alias("body"),
        origin.alias("source"),
        words(body).alias("w"),
        *([] if weight is None else [weight.alias("worth")]),
        *(carried(docs)[:1] if carry else []),
    )
    worth = quality_weight(F.col("body"), F.col("w")) if weight is None else F.col("worth")
    sized = read.select(
        "doc_id",
        "source",
        F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source")).alias("skey"),
        F.size("w").cast("long").alias("size"),
        F.md5(F.coalesce("body", F.lit("")).cast("binary")).alias("tie"),
        worth.alias("worth"),
        F.monotonically_increasing_id().alias("row_no"),
        *(["carried"] if carry else []),
    )
    sized = materialise(sized).withColumn("same", F.xxhash64("doc_id", "tie"))
    numbered = copy_numbers(sized.drop("carried"), "same")
    drawn = hexed_share(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "tie", "copy_no"), salt)
    keyed = numbered.withColumn("key", -F.log(drawn) / F.col("worth"))
    sources = keyed.groupBy("skey").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs"),
        F.avg("key").alias("mean_key"),
    )
    plan = targets(sources, source_weights, share, most).join(sources.select("skey", "mean_key"), "skey")
    rows = join_counted(keyed, materialise(plan), ["skey"])
    buckets = F.greatest(F.lit(LEAST_BUCKETS), F.ceil(F.col("n_docs") / BUCKET_ROWS))
    # 1 - exp(-key / mean) keeps the order of the keys and spreads them evenly
    bucket = F.floor(buckets * (1 - F.exp(-F.col("key") / F.col("mean_key"))))
    rows = rows.withColumn("bucket", F.coalesce(bucket, F.lit(0)))
    order = [F.col("key"), F.col("doc_id"), F.col("tie")]
    rows = running(rows, ["skey"], "bucket", order, {"upto": "size"})
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    once_more = F.when(F.col("upto") - F.col("size") / 2 < rest, 1).otherwise(0)
    copies = (epochs + once_more).cast("long")
    out = rows.withColumns({"taken": copies * F.col("size"), "copies": copies})
    if carry:
        # the decisions are narrow; they meet the whole rows again by row number
        return sized.select("carried", "row_no").join(out.select("row_no", "copies").where("copies > 0"), "row_no")
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of `docs`."""
    taken = mix(docs, carry=True, **options)
    repeated = taken.select("carried", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select("carried.*")
