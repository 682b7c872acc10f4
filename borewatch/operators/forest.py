"""Isolation forest per key and training epoch (D3).

Retraining is a function of the row ordinal, so every epoch of every key is known up front.
Rows of one block travel to one task together with the history before them; inside the task
all trees of a forest grow level by level as array operations.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borewatch.operators.ordering import BLOCK, HALO, POS, KeyedSeries, join_null_safe
from borewatch.operators.passes import ROWS_AT_ONCE, Batches, Pass, doubles, whole_groups

SUBSAMPLE = 256
FIT_AT = "_fit_at"
HISTORY = "_history"
# Readings, each once for every tree, that are walked down the trees at a time.
WALKED_TOGETHER = 16_384


@dataclass(frozen=True)
class ForestSpec:
    """Size of a forest and the line from its decision value to a score in 0..1."""

    trees: int
    contamination: float
    feature_share: float
    shift: float
    span: float
    seed: int = 42


V1_FOREST = ForestSpec(trees=100, contamination=0.05, feature_share=1.0, shift=0.3, span=0.6)
V2_FOREST = ForestSpec(trees=200, contamination=0.02, feature_share=0.8, shift=0.2, span=0.5)


def epochs_v1(first_fit: int = 50, retrain: Column | int = 72, history: Column | int = 168) -> dict[str, Column]:
    """Version 1 fits at rows 50, 50 + retrain, ...; the current row is part of the history."""
    every = retrain if isinstance(retrain, Column) else F.lit(retrain)
    depth = history if isinstance(history, Column) else F.lit(history)
    fit_at = F.lit(first_fit) + F.floor((F.col(POS) - first_fit) / every) * every
    usable = (F.col(POS) >= first_fit) & (depth >= first_fit)
    return {FIT_AT: F.when(usable, fit_at).cast("long"), HISTORY: depth.cast("long")}


def epochs_v2(train_rows: Column, retrain: int = 60, history: int = 500, least: int = 90) -> dict[str, Column]:
    """Version 2 fits once on the training rows, then every 60 rows; never after a short training."""
    since = F.col(POS) - train_rows
    fit_at = train_rows + F.floor(since / retrain) * retrain
    return {
        FIT_AT: F.when((train_rows >= least) & (since > 0), fit_at).cast("long"),
        HISTORY: F.lit(history).cast("long"),
    }


def forest_pass(keys: list[str], features: list[str], spec: ForestSpec, out: str = "if_score") -> Pass:
    """Adds the forest score of each row, 0 where no forest exists yet.

    Needs `_fit_at` and `_history`.  A group is one block and its halo, so its size is bounded.
    """
    def run(batches: Batches) -> Batches:
        for table, groups in whole_groups(batches, [*keys, BLOCK]):
            values, fit_at = doubles(table, features), doubles(table, [FIT_AT])[:, 0]
            position, depth = table.column(POS).to_numpy(), doubles(table, [HISTORY])[:, 0]
            own = ~table.column(HALO).to_numpy().astype(bool)
            result = np.zeros(table.num_rows)
            for a, b in groups:
                key = "|".join(str(table.column(k).slice(a, 1).to_pandas().iloc[0]) for k in keys)
                at = slice(a, b)
                result[at] = _group_scores(values[at], position[at], own[at], fit_at[at], depth[at], key, spec)
            yield from table.append_column(out, pa.array(result)).to_batches(max_chunksize=ROWS_AT_ONCE)

    return Pass([T.StructField(out, T.DoubleType())], [FIT_AT, HISTORY], run)


def _group_scores(
    values: np.ndarray, position: np.ndarray, own: np.ndarray, fit_at: np.ndarray, history: np.ndarray, key: str, spec: ForestSpec
) -> np.ndarray:
    result = np.zeros(len(values))
    if np.isnan(values).any():
        values = pd.DataFrame(values).ffill().to_numpy()
    complete = ~np.isnan(values).any(axis=1)
    for epoch in np.unique(fit_at[own & ~np.isnan(fit_at)]):
        rows = own & (fit_at == epoch)
        depth = int(history[rows][0])
        learn = values[(position > epoch - depth) & (position <= epoch) & complete]
        if len(learn) >= 20:
            forest = fit_forest(learn, spec, zlib.crc32(key.encode()), int(epoch))
            result[rows] = forest.score(np.nan_to_num(values[rows]), spec)
    return result


@dataclass
class Forest:
    """Trees as complete binary heaps: row t is a tree, column i a node, children 2i+1 and 2i+2."""

    mean: np.ndarray
    scale: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    depth: int
    normaliser: float
    offset: float = 0.0

    def samples(self, values: np.ndarray) -> np.ndarray:
        """Minus 2^(-mean path / expected path): near -1 is isolated quickly."""
        x = (values - self.mean) / self.scale
        rows = np.broadcast_to(np.arange(len(x)), (len(self.feature), len(x)))
        return self.decision(self.paths(x, rows))

    def decision(self, paths: np.ndarray) -> np.ndarray:
        return -(2.0 ** (-paths.mean(axis=0) / self.normaliser))

    def paths(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Path length in each tree (row of `rows`) of the standardised readings named there.

        A leaf sends everything to the left, and its path length stands at the lowest node on that way: all readings take
        `depth` steps and none is looked for on the way.
        """
        trees, nodes = self.feature.shape
        leaf = self.feature < 0
        feature, cut = np.where(leaf, 0, self.feature).ravel(), np.where(leaf, np.inf, self.threshold).ravel()
        low = self.path[:, :1]
        for level in range(self.depth):
            first, span = 2**level - 1, 2**level
            under = self.path[:, 2 * first + 1 : 2 * first + 1 + 2 * span].copy()
            under[:, ::2] = np.where(leaf[:, first : first + span], low, under[:, ::2])
            low = under
        flat, width = np.ascontiguousarray(x).ravel(), x.shape[1]
        out = np.empty(rows.shape)
        # some trees at a time: what they read stays in the processor's cache
        some = max(1, WALKED_TOGETHER // max(1, rows.shape[1]))
        for t in range(0, trees, some):
            base = (rows[t : t + some] * width).ravel()
            held = len(rows[t : t + some])
            root = np.repeat(np.arange(t, t + held) * nodes, rows.shape[1])
            # `node` is a place among all trees: children of root + i are root + 2i + 1 and root + 2i + 2
            node, forward = root.copy(), 1 - root
            for _ in range(self.depth):
                right = flat.take(base + feature.take(node)) > cut.take(node)
                node += node
                node += forward
                node += right
            node -= root
            node += np.repeat(np.arange(t, t + held) * low.shape[1], rows.shape[1]) - (low.shape[1] - 1)
            out[t : t + some] = low.ravel().take(node).reshape(held, -1)
        return out

    def score(self, values: np.ndarray, spec: ForestSpec) -> np.ndarray:
        decision = self.samples(values) - self.offset
        return np.clip((spec.shift - decision) / spec.span, 0.0, 1.0)


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def fit_forest(values: np.ndarray, spec: ForestSpec, *seed: int) -> Forest:
    """Standardise, grow every tree of the forest at once, and set the contamination offset.

    Samples of a node stand together, so a level is a few passes over the samples that still move: those alone in their
    node, or equal in all features, have their path length and leave.
    """
    rng = np.random.default_rng([spec.seed, *seed])
    n, width = values.shape
    mean, scale = values.mean(axis=0), values.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    x = (values - mean) / scale
    size = min(SUBSAMPLE, n)
    depth = int(np.ceil(np.log2(max(size, 2))))
    trees = spec.trees
    # which rows a tree sees counts, not their order
    dealt = np.argpartition(rng.random((trees, n)), size - 1, axis=1)
    allowed_count = max(1, int(spec.feature_share * width))
    allowed = np.argsort(rng.random((trees, width)), axis=1)[:, :allowed_count].ravel()
    nodes = 2 ** (depth + 1) - 1
    feature = np.full(trees * nodes, -1)
    threshold = np.zeros(trees * nodes)
    population = np.zeros(trees * nodes, dtype=np.int64)
    population[::nodes] = size
    expected = expected_path(np.arange(size + 1))
    paths = np.empty(trees * n)
    flat = x.ravel()
    # nodes of the level that may be split: tree, place in the level, samples; and these samples, node by node
    tree, place, count = np.arange(trees), np.zeros(trees, dtype=np.int64), np.full(trees, size)
    row = dealt[:, :size].ravel()
    sample, base = row + np.repeat(tree * n, size), row * width
    if size < 2:
        paths[sample] = expected[size]
        tree, place, count, sample, base = tree[:0], place[:0], count[:0], sample[:0], base[:0]
    for level in range(depth):
        first, span = 2**level - 1, 2**level
        slot = tree * span + place
        turn = rng.integers(0, allowed_count, trees * span)[slot]
        share = rng.random(trees * span)[slot]
        if not len(tree):
            continue
        start = np.cumsum(count) - count
        chosen = allowed[tree * allowed_count + turn]
        value = flat.take(base + np.repeat(chosen, count))
        low, high = np.minimum.reduceat(value, start), np.maximum.reduceat(value, start)
        splits = high > low
        for attempt in range(1, allowed_count):
            if splits.all():
                break
            # nodes whose samples are equal in that feature try their next one
            again = np.flatnonzero(~splits)
            inside = np.flatnonzero(np.repeat(~splits, count))
            number = count[again]
            other = allowed[tree[again] * allowed_count + (turn[again] + attempt) % allowed_count]
            found = flat.take(base[inside] + np.repeat(other, number))
            at = np.cumsum(number) - number
            value[inside] = found
            chosen[again], low[again], high[again] = other, np.minimum.reduceat(found, at), np.maximum.reduceat(found, at)
            splits[again] = high[again] > low[again]
        if not splits.all():
            stay = np.repeat(~splits, count)
            paths[sample[stay]] = level + np.repeat(expected[count[~splits]], count[~splits])
            sample, base, value = sample[~stay], base[~stay], value[~stay]
            tree, place, count, chosen, low, high, share = (
                a[splits] for a in (tree, place, count, chosen, low, high, share)
            )
            if not len(tree):
                continue
            start = np.cumsum(count) - count
        cut = low + share * (high - low)
        heap = tree * nodes + first + place
        feature[heap], threshold[heap] = chosen, cut
        right = value > np.repeat(cut, count)
        rights = np.add.reduceat(right, start, dtype=np.int64)
        left_child = tree * nodes + 2 * (first + place) + 1
        population[left_child], population[left_child + 1] = count - rights, rights
        # all left children, then all right ones
        order = np.concatenate([np.flatnonzero(~right), np.flatnonzero(right)])
        sample, base = sample.take(order), base.take(order)
        tree, count = np.concatenate([tree, tree]), np.concatenate([count - rights, rights])
        place = np.concatenate([2 * place, 2 * place + 1])
        if level + 1 == depth:
            paths[sample] = depth + np.repeat(expected[count], count)
            break
        more = count > 1
        moves = np.repeat(more, count)
        paths[sample[~moves]] = level + 1 + expected[1]
        sample, base = sample[moves], base[moves]
        tree, place, count = tree[more], place[more], count[more]
    level_of = np.floor(np.log2(np.arange(nodes) + 1))
    path = level_of[None, :] + expected[population].reshape(trees, nodes)
    forest = Forest(
        mean, scale, feature.reshape(trees, nodes), threshold.reshape(trees, nodes), path, depth, float(expected[size])
    )
    paths = paths.reshape(trees, n)
    if size < n:
        rest = dealt[:, size:]
        np.put_along_axis(paths, rest, forest.paths(x, rest), axis=1)
    forest.offset = float(np.percentile(forest.decision(paths), 100.0 * spec.contamination))
    return forest


MODEL = (
    "center ARRAY<DOUBLE>, scale ARRAY<DOUBLE>, roots ARRAY<INT>, split_feature ARRAY<INT>, split_value ARRAY<DOUBLE>, "
    "child ARRAY<INT>, path ARRAY<DOUBLE>, depth INT, normaliser DOUBLE, offset DOUBLE, fit_at BIGINT"
)
# Readings that meet a model in one row; a model is some 1.5 MB, so it is copied once for as many.
SCORED_TOGETHER = 2048
# Models in a stored file: some 50 MB.
MODELS_A_FILE = 32


def flat_nodes(forest: Forest) -> dict[str, np.ndarray]:
    """The nodes of all trees as one table, level by level: feature (-1 at a leaf), split, left child (the right one
    follows it) and path length of a leaf; `roots` are the rows of the roots."""
    trees, nodes = forest.feature.shape
    kept = np.zeros((trees, nodes), dtype=bool)
    kept[:, 0] = True
    for i in range((nodes - 1) // 2):
        inner = kept[:, i] & (forest.feature[:, i] >= 0)
        kept[:, 2 * i + 1] = kept[:, 2 * i + 2] = inner
    place = np.cumsum(kept.ravel()).reshape(trees, nodes) - 1
    tree, node = np.nonzero(kept)
    feature = forest.feature[tree, node]
    left = np.minimum(2 * node + 1, nodes - 1)
    return {
        "roots": place[:, 0],
        "split_feature": feature,
        "split_value": forest.threshold[tree, node],
        "child": np.where(feature >= 0, place[tree, left], -1),
        "path": forest.path[tree, node],
    }


# The arrays of a packed forest, each with its kind of number.
PACKED = {
    "center": "<f8", "scale": "<f8", "roots": "<i4", "split_feature": "<i2", "split_value": "<f8", "child": "<i4", "path": "<f8",
}


def pack_forest(forest: Forest) -> dict[str, bytes]:
    """The arrays of a forest, its nodes as a flat table, as bytes."""
    arrays = {"center": forest.mean, "scale": forest.scale, **flat_nodes(forest)}
    return {name: np.asarray(arrays[name]).astype(kind).tobytes() for name, kind in PACKED.items()}


def unpack_forest(row: dict) -> Forest:
    """The forest of packed arrays, and of its depth, normaliser and offset."""
    return load_forest(row | {name: np.frombuffer(row[name], dtype=kind) for name, kind in PACKED.items()})


def fit_models(
    series: KeyedSeries, features: list[str], spec: ForestSpec, history: int = 500, least: int = 90
) -> DataFrame:
    """One saved forest per key, trained on its last `history` rows: a row with the flat table of its nodes.

    Keys with fewer than `least` complete rows have none.
    """
    keys = series.keys
    ends = series.rows().groupBy(*keys).agg(F.max(POS).alias("_end"))
    last = join_null_safe(series.rows(), ends, keys).filter(F.col(POS) > F.col("_end") - history)
    schema = T.StructType([series.df.schema[k] for k in keys])
    for field in T.StructType.fromDDL(MODEL).fields:
        schema.add(field)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(POS)[features].ffill().dropna().to_numpy(dtype=float)
        if len(values) < least:
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema.fields})
        key = "|".join(str(pdf[k].iloc[0]) for k in keys)
        end = int(pdf[POS].max())
        model = fit_forest(values, spec, zlib.crc32(key.encode()), end)
        row = {
            **{k: pdf[k].iloc[0] for k in keys},
            "center": model.mean.tolist(), "scale": model.scale.tolist(),
            **{name: values.tolist() for name, values in flat_nodes(model).items()},
            "depth": model.depth, "normaliser": model.normaliser, "offset": model.offset, "fit_at": end,
        }
        return pd.DataFrame({name: [value] for name, value in row.items()})

    return last.select(*keys, POS, *features).groupBy(*keys).applyInPandas(fit, schema)


def stored_score(values: Column, model: dict[str, Column], spec: ForestSpec) -> Column:
    """Score of one reading (an array of its features) by a stored forest, as look-ups in the arrays of its nodes."""
    centred = F.zip_with(values, model["center"], lambda v, c: v - c)
    x = F.zip_with(centred, model["scale"], lambda v, s: v / s)

    def leaf(root: Column, x: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            feature = F.get(model["split_feature"], node)
            right = (F.get(x, feature) > F.get(model["split_value"], node)).cast("int")
            return F.when(feature < 0, node).otherwise(F.get(model["child"], node) + right)

        return F.aggregate(F.sequence(F.lit(1), model["depth"]), root, step)

    def mean_path(x: Column) -> Column:
        total = F.aggregate(model["roots"], F.lit(0.0), lambda held, root: held + F.get(model["path"], leaf(root, x)))
        return total / F.size(model["roots"])

    # the standardised reading is worked out once for all trees
    path = F.element_at(F.transform(F.array(x), mean_path), 1)
    decision = -F.pow(F.lit(2.0), -path / model["normaliser"]) - model["offset"]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(spec.shift) - decision) / F.lit(spec.span)))


def score_stored(
    rows: DataFrame, models: DataFrame, keys: list[str], position: str, features: list[str], spec: ForestSpec,
    out: str = "if_score",
) -> DataFrame:
    """Add the score of each reading by the stored forest of its key, 0 where there is none.

    No Python: readings of a key are put together by the thousand, meet the row of their model and are walked down its
    trees by array look-ups.  Missing features read as 0, as in training.
    """
    names = T.StructType.fromDDL(MODEL).fieldNames()
    reading = F.struct(
        F.struct(*rows.columns).alias("row"),
        F.array(*[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features]).alias("values"),
    )
    slices = rows.select(*keys, F.floor(F.col(position) / SCORED_TOGETHER).alias("_slice"), reading.alias("_r"))
    # at most SCORED_TOGETHER readings in a row
    packed = slices.groupBy(*keys, "_slice").agg(F.collect_list("_r").alias("_rows"))
    met = join_null_safe(packed, models.select(*keys, F.struct(*names).alias("_model")).hint("merge"), keys, "left")
    model = {n: F.col(f"_model.{n}") for n in names}
    scored = F.transform(
        "_rows",
        lambda r: F.struct(
            r["row"].alias("row"),
            F.when(F.col("_model").isNull(), F.lit(0.0)).otherwise(stored_score(r["values"], model, spec)).alias(out),
        ),
    )
    return met.select(F.explode(scored).alias("_s")).select("_s.row.*", f"_s.{out}")


def load_forest(row: pd.Series) -> Forest:
    """The forest of a stored row, in the form that trains: heaps instead of a table."""
    roots = np.asarray(row["roots"], dtype=np.int64)
    feature, split, child, path = (np.asarray(row[c]) for c in ("split_feature", "split_value", "child", "path"))
    nodes = 2 ** (int(row["depth"]) + 1) - 1
    grids = np.full((len(roots), nodes), -1), np.zeros((len(roots), nodes)), np.zeros((len(roots), nodes))
    at, here = roots, np.zeros(len(roots), dtype=np.int64)
    tree = np.arange(len(roots))
    while len(at):
        for grid, values in zip(grids, (feature, split, path)):
            grid[tree, here] = values[at]
        inner = feature[at] >= 0
        at, here, tree = at[inner], here[inner], tree[inner]
        at = np.concatenate([child[at], child[at] + 1]).astype(np.int64)
        here, tree = np.concatenate([2 * here + 1, 2 * here + 2]), np.concatenate([tree, tree])
    return Forest(
        np.asarray(row["center"]), np.asarray(row["scale"]), *grids, int(row["depth"]), float(row["normaliser"]), float(row["offset"])
    )
