"""Hard-negative mining by Fagin's threshold algorithm.

Rows are dealt into slices of bounded size. In a slice every dimension has its list of rows sorted by that component.
An anchor reads each list from its top where its own component is positive and from its bottom where it is negative
(sorted access), and works out the whole integer score of every row it meets there (random access). What the last read
entries would score together, the threshold, bounds the rows not met yet: a window of scores is done once the threshold
falls strictly below the score of its k-th row, so that no tie is lost, or below the window itself. Two passes, first for
the positives of an anchor, then for the negatives in the windows that its positives set; each slice returns at most k
rows of a window, and the best k of all slices are the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borewatch.llm.common import materialise
from borewatch.session import ship_package

#: Rows of a slice and anchors of a block, which meet in one task.
SLICE, ANCHORS = 4096, 2048
#: Entries of each list read in the first step; later steps read twice as many as the one before.
STEP = 32
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is from LOW to HIGH hundredths of its positive's.
LOW, HIGH = 30, 90
FLOOR = -(1 << 63)


@dataclass
class Lists:
    """Integer vectors with the order of their rows in every dimension, smallest component first."""

    x: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> "Lists":
        return cls(x, np.argsort(x, axis=0, kind="stable").T)


def threshold_scan(lists: Lists, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int):
    """Rows met and their scores, enough to hold the best k rows of each window [low, high], all ties with the k-th
    included, among the rows that `allowed` marks. Also returns how many entries each list was read to."""
    n = len(lists.x)
    met = np.zeros(n, dtype=bool)
    rows, scores = [], []
    open_windows = list(windows)
    used = np.flatnonzero(anchor)
    up = anchor[used] > 0
    depth, step = 0, STEP

    def meet(found: np.ndarray) -> None:
        new = np.unique(found[~met[found]])
        met[new] = True
        new = new[allowed[new]]
        rows.append(new)
        scores.append(lists.x[new] @ anchor)

    if not len(used):
        # every score is zero, and no list says more than another
        meet(np.arange(n))
        return np.concatenate(rows), np.concatenate(scores), 0
    while depth < n and open_windows:
        end = min(n, depth + step)
        top = lists.order[used[up], n - end : n - depth]
        bottom = lists.order[used[~up], depth:end]
        meet(np.concatenate([top.ravel(), bottom.ravel()]))
        depth, step = end, step * 2
        last = np.where(up, lists.order[used, n - depth], lists.order[used, depth - 1])
        bound = int((lists.x[last, used] * anchor[used]).sum())
        seen = np.concatenate(scores)
        open_windows = [w for w in open_windows if not _done(seen, bound, *w, k)]
    return np.concatenate(rows), np.concatenate(scores), depth


def _done(seen: np.ndarray, bound: int, low: int, high: int, k: int) -> bool:
    if bound < low:
        return True
    inside = seen[(seen >= low) & (seen <= high)]
    return len(inside) >= k and bound < np.partition(inside, len(inside) - k)[len(inside) - k]


def _best(rows: np.ndarray, scores: np.ndarray, ids: "Ids", low: int, high: int, k: int) -> np.ndarray:
    """Places in `rows` of the best k of a window: higher scores first, then smaller ids, null ids last."""
    inside = np.flatnonzero((scores >= low) & (scores <= high))
    at = rows[inside]
    return inside[np.lexsort((ids.number[at], ids.absent[at], -scores[inside]))[:k]]


@dataclass
class Ids:
    """Ids as numbers without nulls, which pandas would turn into floats: zero and `absent` for null."""

    number: np.ndarray
    absent: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame) -> "Ids":
        return cls(rows["row_id"].to_numpy(dtype=np.int64), rows["no_id"].to_numpy(dtype=bool))


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in column])


def _frame(parts: list[tuple], names: tuple[str, ...]) -> pd.DataFrame:
    """One table from tuples of equally long arrays; a number stands for an array of it."""
    columns = {name: [np.zeros(0, dtype=np.int64)] for name in names}
    for part in parts:
        size = max(np.size(p) if np.ndim(p) else 0 for p in part)
        for name, values in zip(names, part):
            columns[name].append(values if np.ndim(values) else np.full(size, values))
    return pd.DataFrame({name: np.concatenate(c) for name, c in columns.items()}).astype({"no_id": bool})


NEAR = ("anchor_no", "row_no", "row_id", "no_id", "score")
FAR = ("anchor_no", "low", "high", "row_id", "no_id", "score")


def _positives(k: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            groups = rows.groupby("label").indices
            for label, some in anchors.groupby("label"):
                if label not in groups:
                    continue
                own = rows.iloc[groups[label]]
                lists, ids, row_no = Lists.of(_vectors(own["vector"])), Ids.of(own), own["row_no"].to_numpy()
                for at, anchor in zip(some["row_no"], _vectors(some["vector"])):
                    found, scores, _ = threshold_scan(lists, anchor, row_no != at, [(FLOOR, -FLOOR - 1)], k)
                    best = _best(found, scores, ids, FLOOR, -FLOOR - 1, k)
                    kept = found[best]
                    out.append((at, row_no[kept], ids.number[kept], ids.absent[kept], scores[best]))
        return _frame(out, NEAR)

    return run


def _negatives(k: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            lists, ids, labels = Lists.of(_vectors(rows["vector"])), Ids.of(rows), rows["label"].to_numpy()
            for at, label, anchor, lows, highs in zip(
                anchors["row_no"], anchors["label"], _vectors(anchors["vector"]), anchors["lows"], anchors["highs"]
            ):
                windows = [(int(a), int(b)) for a, b in zip(lows, highs)]
                found, scores, _ = threshold_scan(lists, anchor, labels != label, windows, k)
                for low, high in windows:
                    best = _best(found, scores, ids, low, high, k)
                    kept = found[best]
                    out.append((at, low, high, ids.number[kept], ids.absent[kept], scores[best]))
        return _frame(out, FAR)

    return run


def _meet(anchors: DataFrame, rows: DataFrame, slices: int, blocks: int, run, schema: str) -> DataFrame:
    """Every block of anchors with every slice of rows of the same length of vectors."""
    left = anchors.withColumn("block", F.pmod(F.xxhash64("row_no", F.lit(1)), F.lit(blocks)))
    left = left.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = rows.withColumn("slice", F.pmod(F.xxhash64("row_no", F.lit(2)), F.lit(slices)).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["dim", "block", "slice"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def _window(score: Column, low: int, high: int) -> list[Column]:
    """Least and greatest whole score s with low * score <= 100 * s <= high * score."""
    return [
        (-F.floor(-(score.cast("decimal(30,0)") * low) / 100)).cast("long").alias("low"),
        F.floor(score.cast("decimal(30,0)") * high / 100).cast("long").alias("high"),
    ]


def mine(
    vectors: DataFrame,
    *,
    anchors: Column,
    row_id: str = "vec_id",
    label: str = "label",
    vector: str = "vector",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """Hard negatives of the rows that `anchors` marks, from integer vectors (`vector`, array of bigint).

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its
    first `positives` other rows of the same label, the first `negatives` rows of other labels whose score, the inner
    product with the anchor, is from `low` to `high` hundredths of the positive's. Higher scores come first, ties by
    smaller id, null ids last. Rows with a null label, a null vector or a null component take no part, nor do those with
    a component so large that a score might not fit a long (about 2^63 divided by the length, square root of that).
    Vectors meet only vectors of their length. Rows that repeat an id are rows of their own: each may be an anchor, a
    positive or a negative. A row whose `anchors` is null is none. Windows of negative positive scores are empty, since
    `high` is above `low`. Empty tables give no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    v = F.col(vector)
    largest = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    fits = F.coalesce(largest * largest * F.size(v) < float(1 << 62), F.size(v) == 0)
    sound = F.col(label).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull()) & fits
    rows = materialise(
        vectors.where(sound).select(
            F.monotonically_increasing_id().alias("row_no"),
            F.coalesce(F.col(row_id).cast("long"), F.lit(0)).alias("row_id"),
            F.col(row_id).isNull().alias("no_id"),
            F.col(label).cast("string").alias("label"),
            F.size(v).alias("dim"),
            v.cast("array<bigint>").alias("vector"),
            F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
        )
    )
    chosen = rows.where("is_anchor").drop("is_anchor")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a")).first()
    slices, blocks = max(1, -(-sizes["n"] // SLICE)), max(1, -(-sizes["a"] // ANCHORS))
    others = rows.drop("is_anchor")

    def named(out: str) -> Column:
        return F.when(~F.col("no_id"), F.col("row_id")).alias(out)

    near = _meet(
        chosen, others, slices, blocks, _positives(positives),
        "anchor_no long, row_no long, row_id long, no_id boolean, score long",
    )
    order = Window.partitionBy("anchor_no").orderBy(F.desc("score"), "no_id", "row_id", "row_no")
    near = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)
    near = materialise(near.select("anchor_no", named("row_id"), "score", *_window(F.col("score"), low, high)))

    spans = near.where("low <= high").groupBy("anchor_no").agg(
        F.collect_set(F.struct("low", "high")).alias("spans")
    )  # at most `positives` spans of an anchor
    asked = chosen.join(spans.withColumnRenamed("anchor_no", "row_no"), "row_no").select(
        "row_no", "label", "dim", "vector", F.col("spans.low").alias("lows"), F.col("spans.high").alias("highs")
    )
    asked = materialise(asked)
    far = _meet(
        asked, others, slices, blocks, _negatives(negatives),
        "anchor_no long, low long, high long, row_id long, no_id boolean, score long",
    )
    order = Window.partitionBy("anchor_no", "low", "high").orderBy(F.desc("score"), "no_id", "row_id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    starts = chosen.select(F.col("row_no").alias("anchor_no"), named("anchor_id"))
    pairs = near.select("anchor_no", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"), "low", "high")
    return (
        pairs.join(starts, "anchor_no")
        .join(far.withColumn("negative_id", named("row_id")), ["anchor_no", "low", "high"])
        .select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


def scaled(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double; null where the vector or a component is null or not finite, or
    a result lies beyond 2^62."""
    raw = F.transform(embedding, lambda e: e.cast("double"))
    sound = F.forall(raw, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) * scale < float(1 << 62)))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(raw, lambda e: F.floor(e * scale)))


def relabelled(vec_id: Column, label: Column, step: int = 7, labels: int = 10) -> Column:
    """The label, moved to the next of `labels` where the id is divisible by `step`."""
    return F.when(F.coalesce(vec_id % step == 0, F.lit(False)), (label + 1) % labels).otherwise(label)
