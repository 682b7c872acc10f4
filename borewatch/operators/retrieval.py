"""Batch retrieval for a table of queries.

Queries are rows, so one plan answers all of them.  Lexical candidates come from the rarest
term of a query; vectors are compared in blocks of bounded size and only the best of each block
leave the task.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borewatch.functions import text as tx
from borewatch.functions.fixed import INCIDENT_WORDS, STOPWORDS, TOKEN_PATTERN
from borewatch.functions.severity import round_tie_even
from borewatch.operators.ordering import small_side
from borewatch.session import cut_lineage, ship_package, stored_once

# Retrieval settings.
TOP_K = 14
SEMANTIC_WEIGHT = 0.55
OVERVIEW_WEIGHT = 0.42
MIN_FUSED = 0.04
OVERLAP_WEIGHT = 0.28
OVERVIEW_CHUNKS = 14
OVERVIEW_FLOOR = 0.92
WEAK_COVERAGE = 0.38
RELIEF_COVERAGE = 0.24
RELIEF_RELEVANCE = 0.18
FALLBACK_TERMS = 14

BM25_K1 = 1.2
BM25_B = 0.75

# Bytes of vectors on either side of one comparison of slices.
SLICE_BYTES = 32 * 1024 * 1024
# Similarities held at a time inside a task.
SCORES_AT_ONCE = 4_000_000
# Overview chunks that a query is rated against in one go.
OVERVIEW_BLOCK = 256
# Queries in one slice of a cell.
QUERY_BLOCK = 1024
EMBEDDING_SIZE = 64
# Terms whose buckets a task remembers, and the longest of them.
KNOWN_TERMS, KNOWN_LETTERS = 1 << 18, 64
# Texts whose terms are counted into one batch.
TEXTS_AT_ONCE = 200

CHUNK_KEY = ["document_id", "chunk_index"]


def pool_size(k: int) -> int:
    return max(4 * k, 36)


def lexical_limit(k: int) -> int:
    return max(3 * k, k + 24)


class _Buckets(dict):
    """Term -> its bucket, plus `size` where it counts negatively; forgets all once it holds KNOWN_TERMS."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, term: str) -> int:
        digest = hashlib.md5(term.encode()).hexdigest()
        code = int(digest[:6], 16) % self.size + (0 if int(digest[6], 16) < 8 else self.size)
        if len(self) >= KNOWN_TERMS:
            self.clear()
        if len(term) <= KNOWN_LETTERS:
            self[term] = code
        return code


def _signed_counts(size: int):
    """Per row of lower-case text (`_text`) the signed number of its tokens in each bucket, `_v`; the other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, find = _Buckets(size), re.compile(TOKEN_PATTERN).findall
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            counts = np.zeros((batch.num_rows, size))
            for row, text in enumerate(batch.column(at)):
                codes = [known[t] for t in find(text.as_py() or "")]
                if codes:
                    both = np.bincount(codes, minlength=2 * size)
                    counts[row] = both[:size] - both[size:]
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size)
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(c for _, c in kept), pa.ListArray.from_arrays(ends, pa.array(counts.ravel()))], [*(n for n, _ in kept), "_v"]
            )

    return run


def _unit_length(size: int):
    """Rows with `_v`, the last column, scaled to `embedding`; those of length zero go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            norm = np.sqrt((counts * counts).sum(axis=1))
            some = norm > 0
            unit = counts[some] / norm[some, None]
            ends = pa.array(np.arange(len(unit) + 1, dtype=np.int32) * size)
            kept = batch.filter(pa.array(some))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(unit.ravel()))], [*kept.schema.names[:-1], "embedding"]
            )

    return run


def hashed_embedding(df: DataFrame, keys: list[str], text: str, size: int = EMBEDDING_SIZE) -> DataFrame:
    """Keys with `embedding`: signed token counts by hash bucket, scaled to unit length.

    The default embedding; a model can be injected as any function that adds the column.  A text is counted where it is
    read, so one row of `size` counts per text is shuffled and no token is; texts of one key add up.
    """
    ship_package(df.sparkSession)
    rows = df.select(*keys, F.lower(F.col(text)).alias("_text"))
    schema = rows.drop("_text").schema.add("_v", T.ArrayType(T.DoubleType()))
    parts = rows.mapInArrow(_signed_counts(size), schema)
    sums = parts.groupBy(*keys).agg(*[F.sum(F.get("_v", F.lit(i))).alias(f"_{i}") for i in range(size)])
    summed = sums.select(*keys, F.array(*[F.col(f"_{i}") for i in range(size)]).alias("_v"))
    return summed.mapInArrow(_unit_length(size), summed.drop("_v").schema.add("embedding", T.ArrayType(T.DoubleType())))


def semantic_top_k(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    query_key: str = "query_id",
    chunk_keys: list[str] = CHUNK_KEY,
    min_similarity: float | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Exact k nearest chunks per query by cosine: query, chunk keys, similarity, rank.

    Both sides are cut into slices of about `slice_bytes` of vectors, and every pair of slices is
    compared in one task, which returns only its best k per query; the ranking cuts to k again
    before its shuffle.  Rows without a vector neither ask nor answer.
    """
    held = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    q = queries.select(query_key, "embedding").filter(held)
    c = chunks.select(*chunk_keys, "embedding").filter(held)
    asks, parts = _slices(q, slice_bytes), _slices(c, slice_bytes)
    # Few slices would leave most of a cluster idle.
    parts = max(parts, -(-queries.sparkSession.sparkContext.defaultParallelism // asks))
    left = q.select(
        F.pmod(F.xxhash64(query_key), F.lit(asks)).alias("_ask"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_part"),
        query_key,
        F.col("embedding").alias("_asked"),
    )
    right = c.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asks - 1).cast("long"))).alias("_ask"),
        F.pmod(F.xxhash64(*chunk_keys), F.lit(parts)).alias("_part"),
        *chunk_keys,
        F.col("embedding").alias("_held"),
    )
    best = _best_in_groups(left, right, ["_ask", "_part"], k, query_key, chunk_keys)
    if min_similarity is not None:
        best = best.filter(F.col("similarity") >= min_similarity)
    order = Window.partitionBy(query_key).orderBy(F.desc("similarity"), *chunk_keys)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _slices(vectors: DataFrame, slice_bytes: int) -> int:
    """How many slices of `slice_bytes` the vectors fill."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("width")).first()
    return max(1, -(-size["n"] * size["width"] * 8 // slice_bytes))


def _best_in_groups(
    left: DataFrame, right: DataFrame, group: list[str], k: int, query_key: str, chunk_keys: list[str]
) -> DataFrame:
    """Best k chunks (`_held`) per query (`_asked`) within each group of both sides."""
    schema = T.StructType(
        [left.schema[query_key], *[right.schema[c] for c in chunk_keys], T.StructField("similarity", T.DoubleType())]
    )

    def compare(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(held):
            return pd.DataFrame(columns=schema.fieldNames())
        held = held.sort_values(chunk_keys, kind="stable")
        q = _unit(np.stack(asks["_asked"].to_numpy()).astype(float))
        c = _unit(np.stack(held["_held"].to_numpy()).astype(float))
        ids, names = asks[query_key].to_numpy(), {name: held[name].to_numpy() for name in chunk_keys}
        step = max(1, SCORES_AT_ONCE // len(c))
        found = []
        for start in range(0, len(q), step):
            row, column, score = best_columns(q[start : start + step] @ c.T, k)
            picked = {name: values[column] for name, values in names.items()}
            found.append(pd.DataFrame({query_key: ids[start + row], **picked, "similarity": score}))
        return pd.concat(found, ignore_index=True)

    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(compare, schema)


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the k largest scores per row; equal scores go to the first column.

    Scores are rounded to nine digits, so that copies of a vector tie on every engine.
    """
    scores = np.round(scores, 9)
    keep = min(k, scores.shape[1])
    columns = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
    floor = np.take_along_axis(scores, columns, axis=1).min(axis=1, keepdims=True)
    tied = np.flatnonzero((scores >= floor).sum(axis=1) > keep)
    if len(tied):
        columns[tied] = np.argsort(-scores[tied], axis=1, kind="stable")[:, :keep]
    row = np.repeat(np.arange(len(scores)), keep)
    return row, columns.ravel(), np.take_along_axis(scores, columns, axis=1).ravel()


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm > 0, norm, 1.0)


def cell_index(chunks: DataFrame, keys: list[str], cells: int = 100, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(chunks with their cell, cell centres): the inverted-file form of the vector index (K7)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = chunks.withColumn("_v", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    model = KMeans(k=cells, seed=seed, featuresCol="_v", predictionCol="cell", maxIter=10).fit(vectors)
    centres = np.stack(model.clusterCenters())
    return model.transform(vectors).select(*keys, "embedding", "cell"), centres


def approximate_top_k(
    queries: DataFrame,
    indexed: DataFrame,
    centres: np.ndarray,
    k: int,
    probes: int = 10,
    query_key: str = "query_id",
    chunk_keys: list[str] = CHUNK_KEY,
    slice_rows: int = QUERY_BLOCK,
    cell_rows: int = 50_000,
) -> DataFrame:
    """k nearest chunks among the `probes` nearest cells of each query (K7).

    Cells and the queries probing them are cut into slices of bounded size; a pair of slices is
    compared in one task, which returns only its best k per query.
    """
    spread = np.linalg.norm(centres, axis=1, keepdims=True)
    unit = centres / np.where(spread > 0, spread, 1.0)

    @F.pandas_udf("array<int>")
    def nearest_cells(vectors: pd.Series) -> pd.Series:
        scores = _unit(np.stack(vectors.to_numpy()).astype(float)) @ unit.T
        order = np.argsort(-scores, axis=1)[:, :probes]
        return pd.Series(list(order.astype("int32")))

    probing = queries.select(query_key, "embedding", F.explode(nearest_cells("embedding")).alias("cell"))
    sizes = indexed.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / cell_rows)).alias("_parts"))
    asked = probing.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / slice_rows)).alias("_asks"))
    # One row per cell: at most `cells` rows.
    grid = F.broadcast(sizes.join(asked, "cell"))
    left = (
        probing.join(grid, "cell")
        .withColumn("_ask", F.pmod(F.xxhash64(query_key), F.col("_asks")))
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        .select("cell", "_ask", "_part", query_key, F.col("embedding").alias("_asked"))
    )
    right = (
        indexed.join(grid, "cell")
        .withColumn("_part", F.pmod(F.xxhash64(*chunk_keys), F.col("_parts")))
        .withColumn("_ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_asks") - 1)))
        .select("cell", "_ask", "_part", *chunk_keys, F.col("embedding").alias("_held"))
    )
    best = _best_in_groups(left, right, ["cell", "_ask", "_part"], k, query_key, chunk_keys)
    order = Window.partitionBy(query_key).orderBy(F.desc("similarity"), *chunk_keys)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (keys, lower-case `_text`) to keys, length, term, tf, head, one row per term of a text."""
    find, stopped = re.compile(TOKEN_PATTERN).findall, frozenset(STOPWORDS)
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        kept = [n for i, n in enumerate(batch.schema.names) if i != at]
        for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(start, TEXTS_AT_ONCE)
            rows, lengths, terms, counts, heads = [], [], [], [], []
            for text in part.column(at):
                # a dict keeps the first term in front
                held = Counter([t for t in find(text.as_py() or "") if t not in stopped])
                rows.append(len(held))
                lengths.append(sum(held.values()))
                heads.append(len(terms))
                terms += held
                counts += held.values()
            sizes = np.array(rows, dtype=np.int64)
            row = np.repeat(np.arange(len(rows)), sizes)
            head = np.zeros(len(terms), dtype=bool)
            head[np.array(heads, dtype=np.int64)[sizes > 0]] = True
            columns = [part.column(n).take(pa.array(row)) for n in kept]
            columns += [pa.array(np.array(lengths, dtype=np.int32)[row]), pa.array(terms, pa.string())]
            columns += [pa.array(counts, pa.int64()), pa.array(head)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "length", "term", "tf", "head"])


def postings(chunks: DataFrame, keys: list[str] = CHUNK_KEY, text: str = "content") -> DataFrame:
    """Inverted index: keys, length, term, tf, and `head` on one row per chunk.

    Stopwords are left out, as queries leave them out.  A chunk is counted in the task that reads it, and only rows of
    keys that several chunks share are shuffled, to add up what is equal in keys, length and term.  `chunks` is read twice.
    """
    fields = [("length", T.IntegerType()), ("term", T.StringType()), ("tf", T.LongType()), ("head", T.BooleanType())]

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, "length", "term").agg(F.sum("tf").alias("tf"), F.bool_or("head").alias("head"))

    return counted_by_text(chunks, keys, text, _term_counts, fields, added)


def counted_by_text(
    chunks: DataFrame, keys: list[str], text: str, count: Callable, fields: list[tuple], added: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """`count` over Arrow batches (keys, lower-case `_text`), which gives keys and `fields`, in the task that reads a text.

    Of keys that several chunks share the rows go through `added`; no others are shuffled.
    """
    ship_package(chunks.sparkSession)
    rows = chunks.select(*keys, F.lower(F.col(text)).alias("_text"))
    schema = rows.drop("_text").schema
    for name, kind in fields:
        schema.add(name, kind)
    # a hash, as keys may be null; unlike keys of one hash do no harm
    mark = F.xxhash64(*keys)
    shared = chunks.groupBy(mark.alias("_mark")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_mark")
    shared = cut_lineage(shared)
    found = shared.count()
    if not found:
        return rows.mapInArrow(count, schema)
    marked, shared = rows.withColumn("_mark", mark), small_side(shared, found)
    alone, several = (
        marked.join(shared, "_mark", how).drop("_mark").mapInArrow(count, schema) for how in ("left_anti", "left_semi")
    )
    return alone.unionByName(added(several))


def query_ladder(
    queries: DataFrame, query_key: str = "query_id", text: str = "query", first_terms: int | None = FALLBACK_TERMS
) -> DataFrame:
    """Per query the term sets tried in turn: all terms, the first `first_terms` substantive ones (None: all of these),
    then one term at a time by length."""
    every = F.array_distinct(tx.meaningful_tokens(F.col(text)))
    main = F.col("_main")
    by_length = F.transform(
        F.array_sort(F.transform(main, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))),
        lambda s: F.array(s["t"]),
    )
    rungs = F.concat(
        F.array(F.struct(F.lit(0).alias("level"), F.col("_every").alias("terms"))),
        F.when(
            F.size(main) >= 2, F.array(F.struct(F.lit(1).alias("level"), (F.slice(main, 1, first_terms) if first_terms else main).alias("terms")))
        ).otherwise(F.array().cast("array<struct<level:int,terms:array<string>>>")),
        F.transform(by_length, lambda t, i: F.struct((i + 2).alias("level"), t.alias("terms"))),
    )
    return (
        queries.select(query_key, every.alias("_every"), tx.substantive_tokens(F.col(text)).alias("_main"))
        .select(query_key, F.explode(rungs).alias("_r"))
        .select(query_key, "_r.level", "_r.terms")
        .filter(F.size("terms") > 0)
    )


def lexical_top_k(
    queries: DataFrame,
    index: DataFrame,
    limit: int,
    query_key: str = "query_id",
    text: str = "query",
    keys: list[str] = CHUNK_KEY,
    first_terms: int | None = FALLBACK_TERMS,
) -> DataFrame:
    """Chunks that hold every term of a query, best BM25 first; easier rungs only where stricter fail.

    Copies of a query are answered once.  The rarest term of a rung alone proposes candidates, as
    a match must hold it; they are then checked term by term on (chunk, term), so a common term
    is never joined on its own unless a query has nothing else.
    """
    named = queries.select(query_key, F.sha2(text, 256).alias("_q"), text)
    ladder = query_ladder(named.select("_q", text).dropDuplicates(["_q"]), "_q", text, first_terms)
    rungs = cut_lineage(
        ladder.select("_q", "level", F.size("terms").alias("n_terms"), F.explode_outer("terms").alias("term"))
    )
    # Of the index only the asked terms are shuffled; every step below reads these.
    corpus = index.agg(
        F.struct(F.count_if("head").alias("n"), (F.sum(F.when(F.col("head"), F.col("length"))) / F.count_if("head")).alias("mean"))
    )
    index = stored_once(
        index.join(small_side(rungs.select("term").distinct(), rungs.count()), "term", "left_semi").withColumn(
            "_corpus", corpus.scalar()
        )
    )
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = cut_lineage(rungs.join(frequency, "term"))
    terms = asked.count()
    # At most `limit` rows per query; the second stage needs to know which queries are left.
    strict = cut_lineage(_matching(asked.filter("level < 2"), terms, index, limit, keys))
    rest = asked.filter("level >= 2").join(strict.select("_q").distinct(), "_q", "left_anti")
    longest = rest.groupBy("_q").agg(F.min(F.struct("level", "n_terms", "term", "df")).alias("_m")).select("_q", "_m.*")
    found = strict.unionByName(_matching(longest, terms, index, limit, keys))
    return found.join(named.select(query_key, "_q"), "_q").select(query_key, *keys, "level", "score", "rank")


def _matching(asked: DataFrame, terms: int, index: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """Best chunks per query that hold all terms of its lowest rung with any match.

    `terms` bounds the rows of `asked`.  The index, with the facts of its corpus (each chunk counts once, in the row marked
    as its head), is never broadcast, whatever its estimated size.
    """
    rung = ["_q", "level", "n_terms"]
    rarest = (
        asked.groupBy(*rung)
        .agg(F.min(F.struct("df", "term"))["term"].alias("term"), F.count(F.lit(1)).alias("_known"))
        .filter(F.col("_known") == F.col("n_terms"))
    )
    whole = index.hint("merge")
    candidates = small_side(rarest.select(*rung, "term"), terms).join(whole.select(*keys, "term"), "term").drop("term")
    hits = (
        candidates.join(small_side(asked.select("_q", "level", "term", "df"), terms), ["_q", "level"])
        .join(whole, [*keys, "term"])
        # One entry per term of the query.
        .groupBy(*rung, *keys, "length", "_corpus")
        .agg(F.collect_list(F.struct("term", "df", "tf")).alias("_hits"))
        .filter(F.size("_hits") == F.col("n_terms"))
    )
    facts = F.col("_corpus")

    def weight(hit: Column) -> Column:
        idf = F.log(1 + (facts["n"] - hit["df"] + 0.5) / (hit["df"] + 0.5))
        damp = BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / facts["mean"])
        return idf * hit["tf"] * (BM25_K1 + 1) / (hit["tf"] + damp)

    total = F.aggregate(F.array_sort("_hits"), F.lit(0.0), lambda acc, h: acc + weight(h))
    # Lower rungs sort first, so cutting to the limit also keeps the best rung; the second window
    # then sees at most `limit` rows of a query.
    order = Window.partitionBy("_q").orderBy("level", F.desc("score"), *keys)
    best_rung = F.min("level").over(Window.partitionBy("_q"))
    return (
        hits.withColumn("score", F.round(total, 9))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .withColumn("_best", best_rung)
        .filter(F.col("level") == F.col("_best"))
        .select("_q", *keys, "level", "score", "rank")
    )


def fuse(
    semantic: DataFrame, lexical: DataFrame, weights: DataFrame, query_key: str = "query_id", keys: list[str] = CHUNK_KEY
) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists.

    `weights` holds the semantic weight per query as `alpha`.
    """
    group = [query_key, *keys]
    joined = (
        semantic.select(*group, F.col("rank").alias("sem_rank"))
        .join(lexical.select(*group, F.col("rank").alias("lex_rank")), group, "full")
        .join(weights.select(query_key, "alpha"), query_key)
    )
    zero = F.lit(0.0)
    score = F.coalesce(F.col("alpha") * tx.rrf(F.col("sem_rank")), zero) + F.coalesce(
        (1 - F.col("alpha")) * tx.rrf(F.col("lex_rank")), zero
    )
    order = Window.partitionBy(query_key).orderBy(F.desc("fused"), F.asc_nulls_last("sem_rank"), F.asc_nulls_last("lex_rank"))
    return (
        joined.withColumn("fused", score)
        .withColumn("relevance", F.least(F.lit(1.0), F.col("fused") * 120))
        .withColumn("fused_rank", F.row_number().over(order))
        .drop("alpha")
    )


def _best_overlaps(count: int, keys: list[str], names: list[str]) -> Callable:
    """Of queries (`query_id`, `_terms`) and chunks (keys, lower-case `_text`, `_length`) the pairs that may be among the
    best `count` of a query by overlap and length, with both.

    A term that occurs in a text lies in a run of characters that terms are made of, and the terms in a run are looked up
    once for all queries and texts that share it.
    """
    last: dict = {}

    def lookup(terms: list[str]) -> tuple[dict, Callable, list[int], dict]:
        if last.get("terms") != terms:
            letters = "".join(re.escape(c) for c in sorted({c for t in terms for c in t}))
            runs = re.compile(f"[{letters}]+").findall if letters else lambda _: []
            sizes = sorted({len(t) for t in terms if t})
            last.update(terms=terms, found=({t: i for i, t in enumerate(terms)}, runs, sizes, {}))
        return last["found"]

    def within(run: str, ids: dict, sizes: list[int]) -> list[int]:
        found = {ids.get(run[i : i + n]) for n in sizes if n <= len(run) for i in range(len(run) - n + 1)}
        return [i for i in found if i is not None]

    def compare(asks: pa.Table, held: pa.Table) -> pa.Table:
        queries = [t or [] for t in asks.column("_terms").to_pylist()]
        ids, runs, sizes, known = lookup(sorted({t for terms in queries for t in terms}))
        wanted = np.zeros((len(queries), len(ids)), dtype=np.float32)
        for row, terms in enumerate(queries):
            for term in terms:
                wanted[row, ids[term]] += 1
        there = np.zeros((len(ids), held.num_rows), dtype=np.float32)
        for column, text in enumerate(held.column("_text").to_pylist()):
            if text is None:
                continue
            present = {ids[""]} if "" in ids else set()
            for run in set(runs(text)):
                inside = known.get(run)
                if inside is None:
                    inside = within(run, ids, sizes)
                    if len(run) <= KNOWN_LETTERS:
                        if len(known) >= KNOWN_TERMS:
                            known.clear()
                        known[run] = inside
                present.update(inside)
            there[list(present), column] = 1
        matched = (wanted @ there).astype(np.int64)
        number = np.array([len(t) for t in queries], dtype=np.int64)
        length = pc.fill_null(held.column("_length"), -1).to_numpy().astype(np.int64)
        place = matched * (length.max(initial=0) + 2) + length + 1
        keep = np.ones(place.shape, dtype=bool)
        if held.num_rows > count:
            keep = place >= -np.partition(-place, count - 1, axis=1)[:, count - 1 : count]
        row, column = np.nonzero(keep)
        overlap = matched[row, column] / np.maximum(number[row], 1)
        chunks = held.select([*keys, "_length"]).take(pa.array(column))
        columns = {"query_id": asks.column("query_id").take(pa.array(row)), "_overlap": pa.array(overlap)}
        columns.update({n: chunks.column(n) for n in chunks.column_names})
        return pa.table({n: columns[n] for n in names})

    return compare


def overview_front(
    queries: DataFrame, chunks: DataFrame, pattern: str = "%Field_Overview%", count: int = OVERVIEW_CHUNKS, shortest: int = 180
) -> DataFrame:
    """For overview queries the overview chunks to put first: query, chunk keys, front_rank.

    Chunks of 180 characters or more are preferred if there are enough; then by overlap with the
    query, length and index.  Every overview chunk is ranked: both sides are dealt into slices, a
    pair of slices meets in one task, which reads a text once for all its queries, and only the
    best `count` per query and task, with what is equal to the last of them, are shuffled.
    """
    pool = chunks.filter(F.col("source_path").ilike(pattern)).select(*CHUNK_KEY, "content")
    long = F.length(tx.strip(F.col("content"))) >= shortest
    size = pool.agg(F.count(F.lit(1)).alias("n"), F.count_if(long).alias("long")).first()
    if size["long"] >= min(4, count // 2):
        pool = pool.filter(long)
    blocks = max(1, -(-size["n"] // OVERVIEW_BLOCK))
    wanted = queries.filter(tx.is_overview_query(F.col("query")))
    asks = max(1, -(-wanted.count() // QUERY_BLOCK))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    asking = wanted.select(
        "query_id",
        tx.substantive_tokens(F.col("query")).alias("_terms"),
        F.pmod(F.xxhash64("query_id"), F.lit(asks)).alias("_ask"),
        numbers(blocks).alias("_block"),
    )
    dealt = pool.select(
        *CHUNK_KEY, F.lower("content").alias("_text"), F.length("content").alias("_length"),
        F.pmod(F.xxhash64(*CHUNK_KEY), F.lit(blocks)).alias("_block"), numbers(asks).alias("_ask"),
    )
    schema = T.StructType([asking.schema["query_id"], *[dealt.schema[c] for c in CHUNK_KEY]])
    schema.add("_overlap", T.DoubleType()).add(dealt.schema["_length"])
    ship_package(queries.sparkSession)
    pair = ["_ask", "_block"]
    rated = asking.groupBy(*pair).cogroup(dealt.groupBy(*pair)).applyInArrow(_best_overlaps(count, CHUNK_KEY, schema.fieldNames()), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("_overlap"), F.desc("_length"), "chunk_index", "document_id")
    return (
        rated.withColumn("front_rank", F.row_number().over(order))
        .filter(F.col("front_rank") <= count)
        .select("query_id", *CHUNK_KEY, "front_rank")
    )


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = TOP_K,
    min_fused: float = MIN_FUSED,
    alpha: float | None = None,
    index: DataFrame | None = None,
    overview_pattern: str = "%Field_Overview%",
    well_filter: bool = False,
) -> DataFrame:
    """Hybrid retrieval for every query: the top chunks in order.

    `queries` has query_id, query, embedding (and well_id with `well_filter`); `chunks` has the
    chunk columns with title, doc_type, source_path and embedding.  Result columns: query_id, chunk
    keys, relevance, position.  See `answer` for coverage and the weak-evidence flag.
    """
    if index is None:
        # Read several times below: build it once.
        index = stored_once(postings(chunks))
    spec = queries.select("query_id", "query", *(["well_id"] if well_filter else []))
    weight = F.lit(alpha) if alpha is not None else F.when(
        tx.is_overview_query(F.col("query")), F.lit(OVERVIEW_WEIGHT)
    ).otherwise(F.lit(SEMANTIC_WEIGHT))
    pool = pool_size(k)
    semantic = semantic_top_k(queries, chunks.filter(F.col("embedding").isNotNull()), pool, min_similarity=0.0)
    lexical = lexical_top_k(spec, index, lexical_limit(pool))
    fused = fuse(semantic, lexical, spec.withColumn("alpha", weight))
    front = overview_front(spec, chunks, overview_pattern)
    merged = (
        fused.join(front, ["query_id", *CHUNK_KEY], "full")
        .withColumn(
            "relevance",
            F.when(F.col("front_rank").isNull(), F.col("relevance")).otherwise(
                F.greatest(F.coalesce("relevance", F.lit(0.0)), F.lit(OVERVIEW_FLOOR))
            ),
        )
    )
    by_query = Window.partitionBy("query_id")
    in_order = by_query.orderBy(F.asc_nulls_last("front_rank"), F.asc_nulls_last("fused_rank"))
    # Lists hold at most the two pools and the overview, so these windows are short.
    listed = merged.withColumn("_place", F.row_number().over(in_order)).withColumn(
        "_any_kept", F.max((F.col("relevance") >= min_fused).cast("int")).over(by_query)
    )
    content = chunks.select(*CHUNK_KEY, "title", "content", *(["well_id"] if well_filter else []))
    if well_filter:
        content = content.withColumnRenamed("well_id", "_chunk_well")
    # Texts are large whatever the estimate says: never the broadcast side.
    read = listed.join(content.hint("merge"), CHUNK_KEY).join(spec, "query_id")
    if well_filter:
        read = read.filter(F.col("well_id").isNull() | (F.col("well_id") == F.col("_chunk_well")))
    candidate = (F.col("_any_kept") == 0) | (F.col("relevance") >= min_fused)
    rerank = (
        F.col("relevance")
        + OVERLAP_WEIGHT * tx.share_contained(tx.substantive_tokens(F.col("query")), F.lower("content"))
        + tx.overview_bonus(F.col("query"), F.col("title"), F.col("content"))
    )
    ranked = read.withColumn("_candidate", candidate).withColumn("rerank_score", rerank)
    best_first = by_query.orderBy(F.desc("_candidate"), F.desc("rerank_score"), "_place")
    placed = ranked.withColumn("_rank", F.row_number().over(best_first)).withColumn(
        "_found", F.count_if("_candidate").over(by_query)
    )
    short = F.least(F.col("_found"), F.lit(k)) < min(k, 3)
    refill = F.row_number().over(by_query.orderBy("_place"))
    final = placed.withColumn("_refill", refill).withColumn("_short", short)
    kept = final.filter(
        F.when(F.col("_short"), F.col("_refill") <= max(k, 3)).otherwise(F.col("_candidate") & (F.col("_rank") <= k))
    )
    return kept.select(
        "query_id", *CHUNK_KEY, "relevance", "rerank_score",
        F.when(F.col("_short"), F.col("_refill")).otherwise(F.col("_rank")).alias("position"),
    )


def answer(queries: DataFrame, retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per query: context, citations, source_coverage, weak_evidence, num_chunks.

    At most k chunks per query are collected.
    """
    content = chunks.select(*CHUNK_KEY, "content", "section", "page_number", "title", "doc_type")
    section = F.when(
        F.coalesce("section", F.lit("")) != "", F.concat(F.lit(", "), F.col("section"))
    ).otherwise(F.lit(""))
    source = F.concat(
        F.lit("[Source "), F.col("position").cast("string"), F.lit(": "), F.col("title"), F.lit(" ("), F.col("doc_type"),
        section, F.lit(")] (relevance: "), F.format_string("%.2f", round_tie_even(F.round("relevance", 4), 2)), F.lit(")\n"), F.col("content"),
    )
    citation = F.struct(
        "document_id",
        F.col("title").alias("document_title"),
        F.col("doc_type").alias("document_type"),
        "section",
        F.col("page_number").alias("page"),
        F.round("relevance", 4).alias("relevance_score"),
        F.substring("content", 1, 300).alias("excerpt"),
    )
    grouped = (
        retrieved.join(content.hint("merge"), CHUNK_KEY)
        .groupBy("query_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("position", source.alias("source"), F.col("content").alias("body"), citation.alias("citation")))
            ).alias("_list"),
            F.max("relevance").alias("max_relevance"),
            F.count(F.lit(1)).alias("num_chunks"),
        )
    )
    full = queries.select("query_id", "query").join(grouped, "query_id", "left")
    body = F.array_join(F.transform("_list", lambda s: s["body"]), " ")
    coverage = F.when(F.col("num_chunks").isNull(), F.lit(0.0)).otherwise(
        tx.source_coverage(tx.coverage_terms(F.col("query")), body)
    )
    weak = weak_evidence(F.col("_coverage"), F.coalesce("max_relevance", F.lit(0.0))) | F.col("num_chunks").isNull()
    note = F.when(
        F.col("weak_evidence"),
        F.lit(
            "\n\nNOTE: Retrieval coverage for substantive query terms is below the configured evidence gate. "
            "Prefer confirming against primary sources or human review before acting."
        ),
    ).otherwise(F.lit(""))
    context = F.coalesce(
        F.array_join(F.transform("_list", lambda s: s["source"]), "\n\n---\n\n"), F.lit("No relevant documents found.")
    )
    return (
        full.withColumn("_coverage", coverage)
        .withColumn("weak_evidence", weak)
        .select(
            "query_id",
            "query",
            F.concat(context, note).alias("context"),
            F.transform("_list", lambda s: s["citation"]).alias("citations"),
            F.round("_coverage", 4).alias("source_coverage"),
            "weak_evidence",
            F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"),
        )
    )


def weak_evidence(coverage: Column, best: Column) -> Column:
    """Low coverage, unless moderate coverage meets a relevant chunk."""
    relief = (coverage >= RELIEF_COVERAGE) & (best >= RELIEF_RELEVANCE)
    return (coverage < WEAK_COVERAGE) & ~relief


def incident_citations(answers: DataFrame) -> DataFrame:
    """Add the citations whose title or type names an incident."""
    def is_incident(c: Column) -> Column:
        name = F.lower(F.concat(c["document_title"], c["document_type"]))
        found = F.lit(False)
        for word in INCIDENT_WORDS:
            found = found | name.contains(word)
        return found

    return answers.withColumn("incident_citations", F.filter("citations", is_incident))
