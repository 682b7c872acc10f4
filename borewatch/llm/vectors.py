"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random directions. Two vectors collide on a direction where the projection of one
lies in the window centred at the other's. A pair at the threshold differs on a direction by a normal deviate of known
spread, so the window and the least number of collisions can be set for a wanted recall; pairs with that many collisions
are verified by their cosine. Vectors are sorted into strips of the first projection, and only strips that a window can
reach are compared, block against block. A pair of blocks returns link counts and a spanning forest, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borewatch.llm.common import components, materialise
from borewatch.session import ship_package

THRESHOLD = 0.98
#: Directions, window in spreads of a pair at the threshold, and width of a strip in the same unit.
DIRECTIONS, WINDOW, STRIP = 24, 2.5, 4.0
#: A pair at the threshold is passed on with at least this probability.
RECALL = 0.9999
#: Vectors of a block.
BLOCK = 1024
SEED = 17


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(dim, DIRECTIONS)) / math.sqrt(dim)


def spread(dim: int, threshold: float) -> float:
    """Standard deviation of the difference of two unit vectors at the threshold, projected on a direction."""
    return math.sqrt(2 * (1 - threshold) / dim)


def least_collisions(recall: float = RECALL) -> int:
    """The most collisions that can be asked for if a pair at the threshold shall have them with this probability."""
    hit = math.erf(WINDOW / math.sqrt(2))
    tail = 0.0
    for k in range(DIRECTIONS, -1, -1):
        tail += math.comb(DIRECTIONS, k) * hit**k * (1 - hit) ** (DIRECTIONS - k)
        if tail >= recall:
            return k
    return 0


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y (unit vectors) that collide often enough and have a cosine of at least the threshold."""
    dim = x.shape[1]
    window = np.float32(WINDOW * spread(dim, threshold))
    along = directions(dim)
    px, py = (x @ along).astype(np.float32), (y @ along).astype(np.float32)
    hits = np.zeros((len(x), len(y)), dtype=np.uint8)
    for j in range(DIRECTIONS):
        hits += np.abs(px[:, j, None] - py[None, :, j]) <= window
    i, j = np.nonzero(hits >= least_collisions())
    keep = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return i[keep], j[keep]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n nodes."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        alone = right.empty and rows["own"].iloc[0]
        right = left if alone else right
        if left.empty or right.empty:
            return pd.DataFrame({"rid": [], "links": [], "root": []}).astype("int64")
        x, y = (np.stack([np.frombuffer(v, dtype="<f8") for v in side["unit"]]) for side in (left, right))
        i, j = close_pairs(x, y, threshold)
        if alone:
            i, j = i[i < j], j[i < j]
        a, b = left["rid"].to_numpy(), right["rid"].to_numpy()
        n_a, n_b = left["n"].to_numpy(), right["n"].to_numpy()
        both = np.concatenate([a, b]) if not alone else a
        shift = 0 if alone else len(a)
        links = np.zeros(len(both), dtype=np.int64)
        np.add.at(links, i, n_b[j])
        np.add.at(links, j + shift, n_a[i])
        root = both[_forest(len(both), i, j + shift)]
        some = links > 0
        return pd.DataFrame({"rid": both[some], "links": links[some], "root": root[some]})

    return run


def _units(batches):
    """Unit vector as bytes, and the strip of its first projection."""
    import pyarrow as pa

    for batch in batches:
        units, strips = [], []
        for v in batch.column("embedding").to_pylist():
            own = np.array(v, dtype=np.float64)
            own = own / np.abs(own).max()
            own /= math.sqrt(own @ own)
            units.append(own.astype("<f8").tobytes())
            strips.append(math.floor(float(own @ directions_first(len(own))) / (STRIP * spread(len(own), THRESHOLD))))
        kept = [c for c in batch.schema.names if c != "embedding"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(units, pa.binary()), pa.array(strips, pa.int64())],
            [*kept, "unit", "strip"],
        )


_FIRST: dict[int, np.ndarray] = {}


def directions_first(dim: int) -> np.ndarray:
    if dim not in _FIRST:
        _FIRST[dim] = directions(dim)[:, 0]
    return _FIRST[dim]


def near_duplicates(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal labels (and equal lengths) link at a cosine of THRESHOLD or more, in double precision. Vectors that
    are null, empty, zero or hold nulls, NaN or infinities, and those without a label, link with nothing and form their
    own components. Equal vectors of a label are compared once and count as often as they occur. Null ids are listed in
    the component of their vector, whose id is the smallest that isn't null. Empty tables give no rows; other columns
    are not looked at. Pairs at the threshold are missed with a probability of about 1 - RECALL, plus that of a pivot
    difference beyond a strip; closer pairs less.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = finite & F.exists(v, lambda x: x != 0) & F.col(label).isNotNull()
    rows = materialise(
        vectors.select(
            F.monotonically_increasing_id().alias("row_no"),
            F.col(vec_id).alias("vec_id"),
            F.coalesce(sound, F.lit(False)).alias("sound"),
            F.col(label).cast("string").alias("label"),
            v.alias("embedding"),
            F.size(F.col(embedding)).alias("dim"),
        )
    )
    usable = rows.where("sound").withColumn("mark", F.xxhash64("embedding"))
    alike = ["label", "dim", "mark", "embedding"]
    reps = materialise(usable.groupBy(*alike).agg(F.min("row_no").alias("rid"), F.count("*").alias("n")))
    kept = reps.select("rid", "label", "dim", "n", "embedding")
    schema = T.StructType([f for f in kept.schema.fields if f.name != "embedding"])
    schema = schema.add("unit", T.BinaryType()).add("strip", T.LongType())
    points = materialise(kept.mapInArrow(_units, schema))
    # blocks of a strip, and how many the strip above has
    strip = ["label", "dim", "strip"]
    blocks = points.groupBy(*strip).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    near = blocks
    for step, name in ((1, "above"), (-1, "below")):
        other = blocks.select("label", "dim", (F.col("strip") - step).alias("strip"), F.col("blocks").alias(name))
        near = near.join(other, strip, "left")
    placed = points.join(near, strip).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))

    def numbers(n):
        """0 to n - 1; none for null."""
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    block = F.col("block")

    def meet(lower, a, b, side, own):
        return F.struct(
            lower.alias("lower"), a.alias("a"), b.alias("b"), F.lit(side).alias("side"), F.lit(own).alias("own")
        )

    inside = F.transform(
        numbers(F.col("blocks")),
        lambda o: F.struct(
            F.col("strip").alias("lower"), F.least(block, o).alias("a"), F.greatest(block, o).alias("b"),
            F.when(o >= block, 0).otherwise(1).alias("side"), F.lit(True).alias("own"),
        ),
    )
    up = F.transform(numbers(F.col("above")), lambda o: meet(F.col("strip"), block, o, 0, False))
    down = F.transform(numbers(F.col("below")), lambda o: meet(F.col("strip") - 1, o, block, 1, False))
    meetings = placed.select("rid", "label", "dim", "n", "unit", F.explode(F.concat(inside, up, down)).alias("m"))
    meetings = meetings.select("rid", "label", "dim", "n", "unit", "m.*")
    found = meetings.groupBy("label", "dim", "lower", "a", "b", "own").applyInPandas(
        _compare(THRESHOLD), "rid long, links long, root long"
    )
    found = materialise(found)
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")).where("a <> b"))
    table = reps.select("rid", *alike, "n").join(links, "rid", "left").join(
        joined.withColumnRenamed("node", "rid").withColumnRenamed("component_id", "comp"), "rid", "left"
    )
    table = materialise(
        table.select("label", "dim", "mark", "embedding", F.coalesce("comp", "rid").alias("comp"),
                     (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    )
    linked = usable.join(table.hint("merge"), alike).select("vec_id", "row_no", "n_links", "comp")
    ids = linked.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    linked = linked.join(ids, "comp").select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
