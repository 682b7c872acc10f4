"""Lexical retrieval by cover density over a positional index of stems.

A chunk answers a query if it holds the stems of all its terms.  Its score adds up its covers, the
shortest spans that hold every term: each counts a tenth, divided by one plus the number of other
words in it.  So terms that stand together count for more than terms far apart, and "pumps" finds
"pumping".
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borewatch.functions.fixed import STOPWORDS, TOKEN_PATTERN
from borewatch.functions.stem import stem_of, with_stems
from borewatch.operators.ordering import small_side
from borewatch.operators.retrieval import CHUNK_KEY, KNOWN_LETTERS, TEXTS_AT_ONCE, counted_by_text, query_ladder
from borewatch.session import cut_lineage, stored_once

# Fixed value: weight of a term at an unmarked place.
PLAIN_WEIGHT = 0.1
# Words whose stems a task remembers.
KNOWN_WORDS = 1 << 19
STOPPED = frozenset(STOPWORDS)


def vocabulary(words: DataFrame, term: str = "term") -> DataFrame:
    """(term, stem) of every distinct word; counted on the map side before the shuffle."""
    return with_stems(words.select(F.col(term).alias("term")).distinct(), "term")


class _Stems(dict):
    """Word -> its stem, None for stopwords; forgets all once it holds KNOWN_WORDS."""

    def __missing__(self, word: str) -> str | None:
        stem = None if word in STOPPED else stem_of(word)
        if len(self) >= KNOWN_WORDS:
            self.clear()
        if len(word) <= KNOWN_LETTERS:
            self[word] = stem
        return stem


def _stem_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (keys, lower-case `_text`) to keys, stem, places, one row per stem of a text."""
    known, find = _Stems(), re.compile(TOKEN_PATTERN).findall
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        kept = [n for i, n in enumerate(batch.schema.names) if i != at]
        for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(start, TEXTS_AT_ONCE)
            rows, stems, sizes, places = [], [], [], []
            for text in part.column(at):
                held = defaultdict(list)
                for place, stem in enumerate(map(known.__getitem__, find(text.as_py() or ""))):
                    held[stem].append(place)
                held.pop(None, None)
                rows.append(len(held))
                stems += held
                sizes += map(len, held.values())
                places.extend(chain.from_iterable(held.values()))
            row = pa.array(np.repeat(np.arange(len(rows)), np.array(rows, dtype=np.int64)))
            ends = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
            columns = [part.column(n).take(row) for n in kept]
            columns += [pa.array(stems, pa.string()), pa.ListArray.from_arrays(ends, pa.array(places, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "stem", "places"])


def positional_index(chunks: DataFrame, keys: list[str] = CHUNK_KEY, text: str = "content") -> DataFrame:
    """Keys, stem and the sorted positions at which words of that stem stand; all words count as places, stopwords are
    left out.  Words are stemmed and placed in the task that reads a chunk, and only rows of keys that several chunks
    share are shuffled.  `chunks` is read twice."""
    fields = [("stem", T.StringType()), ("places", T.ArrayType(T.IntegerType()))]

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, "stem").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))

    return counted_by_text(chunks, keys, text, _stem_places, fields, added)


def stemmed_ladder(queries: DataFrame, query_key: str, text: str, first_terms: int | None) -> DataFrame:
    """Per query and rung its distinct stems: (query, level, n_terms, stem)."""
    rungs = query_ladder(queries, query_key, text, first_terms)
    terms = rungs.select(query_key, "level", F.explode("terms").alias("term"))
    stems = vocabulary(terms)
    named = terms.join(stems.hint("merge"), "term").select(query_key, "level", "stem").distinct()
    sizes = Window.partitionBy(query_key, "level")
    return named.withColumn("n_terms", F.count(F.lit(1)).over(sizes))


def cover_density(entries: Column, n_terms: Column) -> Column:
    """Score of a chunk from its entries (place, number of the term from 0), in order of place.

    A scan keeps the last entry of every term.  Where all terms have been met, the oldest of those
    entries begins the shortest span that ends here; it is a cover unless a span from the same
    beginning was closed before.
    """
    entry = "struct<place:int,at:int>"
    state = F.struct(
        F.transform(F.sequence(F.lit(1), n_terms), lambda _: F.lit(None).cast(entry)).alias("last"),
        F.lit(-1).alias("begun"), F.lit(0.0).alias("score"), F.lit(0).alias("at"),
    )

    def step(held: Column, e: Column) -> Column:
        here = F.struct(e["place"].alias("place"), held["at"].alias("at"))
        last = F.transform(held["last"], lambda x, i: F.when(i == e["term"], here).otherwise(x))

        def closed(last: Column) -> Column:
            begin = F.array_min(last)
            whole = ~F.exists(last, lambda x: x.isNull())
            fresh = whole & (begin["place"] > held["begun"])
            others = (e["place"] - begin["place"]) - (held["at"] - begin["at"])
            inside = held["at"] - begin["at"]
            noise = F.when(others >= 0, others).otherwise(F.floor(inside / 2).cast("int"))
            return F.struct(
                last.alias("last"),
                F.when(fresh, begin["place"]).otherwise(held["begun"]).alias("begun"),
                F.when(fresh, held["score"] + F.lit(PLAIN_WEIGHT) / (1 + noise)).otherwise(held["score"]).alias("score"),
                (held["at"] + 1).alias("at"),
            )

        # `last` is worked out once
        return F.element_at(F.transform(F.array(last), closed), 1)

    return F.aggregate(entries, state, step, lambda held: held["score"])


def cover_density_top_k(
    queries: DataFrame,
    index: DataFrame,
    limit: int,
    query_key: str = "query_id",
    text: str = "query",
    keys: list[str] = CHUNK_KEY,
    first_terms: int | None = 14,
) -> DataFrame:
    """Best chunks per query by cover density: query, keys, level, score, rank.

    All terms are asked for first, then the first `first_terms` substantive ones (None: all of them), then one term at a
    time, the longest first.  Copies of a query are answered once.  Of the index only the asked stems are shuffled; the
    rarest stem of a rung proposes candidates.
    """
    named = queries.select(query_key, F.sha2(text, 256).alias("_q"), text)
    ladder = stemmed_ladder(named.select("_q", text).dropDuplicates(["_q"]), "_q", text, first_terms)
    rungs = cut_lineage(ladder)
    wanted = rungs.select("stem").distinct()
    kept = stored_once(index.join(small_side(wanted, rungs.count()), "stem", "left_semi"))
    frequency = kept.groupBy("stem").agg(F.count(F.lit(1)).alias("df"))
    asked = cut_lineage(rungs.join(frequency, "stem"))
    terms = asked.count()
    strict = cut_lineage(_matching(asked.filter("level < 2"), terms, kept, limit, keys))
    rest = asked.filter("level >= 2").join(strict.select("_q").distinct(), "_q", "left_anti")
    longest = rest.groupBy("_q").agg(F.min(F.struct("level", "n_terms", "stem", "df")).alias("_m")).select("_q", "_m.*")
    found = strict.unionByName(_matching(longest, terms, kept, limit, keys))
    return found.join(named.select(query_key, "_q"), "_q").select(query_key, *keys, "level", "score", "rank")


def _matching(asked: DataFrame, terms: int, index: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """Best chunks per query that hold all stems of its lowest rung with any match."""
    rung = ["_q", "level", "n_terms"]
    per_rung = asked.groupBy(*rung).agg(
        F.min(F.struct("df", "stem"))["stem"].alias("stem"), F.array_sort(F.collect_set("stem")).alias("_stems")
    ).filter(F.size("_stems") == F.col("n_terms"))
    # The index is merged, whatever its estimated size; the asked side is counted.
    proposed = small_side(per_rung.select(*rung, "stem"), terms).join(index.hint("merge").select(*keys, "stem"), "stem")
    hits = (
        proposed.drop("stem")
        .join(small_side(asked.select("_q", "level", "stem"), terms), ["_q", "level"])
        .join(index.hint("merge"), [*keys, "stem"])
        .groupBy(*rung, *keys)
        .agg(F.collect_list(F.struct("stem", "places")).alias("_hits"))
        .filter(F.size("_hits") == F.col("n_terms"))
    )
    numbered = F.transform(F.array_sort("_hits"), lambda h, i: F.transform(
        h["places"], lambda p: F.struct(p.alias("place"), i.alias("term"))))
    score = cover_density(F.array_sort(F.flatten(numbered)), F.col("n_terms").cast("int"))
    order = Window.partitionBy("_q").orderBy("level", F.desc("score"), *keys)
    return (
        hits.withColumn("score", F.round(score, 9))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .withColumn("_best", F.min("level").over(Window.partitionBy("_q")))
        .filter(F.col("level") == F.col("_best"))
        .select("_q", *keys, "level", "score", "rank")
    )
