"""Hashed features of whole texts as array operations over their UTF-8 bytes, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes looked at together; a longer text is cut between words.
STRIP = 1 << 20
PRIME = np.uint32(0x01000193)
SPREAD = np.uint32(0x9E3779B1)
#: White space: the six ASCII characters.
SPACES = (b"\t", b"\n", b"\x0b", b"\f", b"\r", b" ")
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Letters: a-z, A-Z and all bytes of characters beyond ASCII.
IS_LETTER = np.zeros(256, dtype=bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def strips(texts: list[bytes], most: int = STRIP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, number of the text each byte belongs to) for runs of texts of at most `most` bytes, every text preceded
    and followed by a space. Longer texts are cut after white space where there is some, so no word is lost or split."""
    parts, owners, held = [], [], 0

    def given():
        sizes = np.array([len(p) + 1 for p in parts])
        return np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8), np.repeat(owners + owners[-1:], [*sizes, 1])

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + most)
            if end < len(text):
                cut = max(text.rfind(space, at, end) for space in SPACES)
                end = cut + 1 if cut > at else end
            piece = text[at:end]
            if parts and held + len(piece) > most:
                yield given()
                parts, owners, held = [], [], 0
            parts.append(piece)
            owners.append(i)
            held += len(piece)
            at = end
    if parts:
        yield given()


def words_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the first and last entries are False."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 32-bit polynomial hash of each word."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint32)
    sizes = ends - starts
    power = np.cumprod(np.full(int(sizes.max()), PRIME, dtype=np.uint32), dtype=np.uint32)
    inside = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    return np.add.reduceat((data[inside].astype(np.uint32) + np.uint32(1)) * power[place], first, dtype=np.uint32)


def bucket(hashes: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Buckets 0 to 2^bits - 1."""
    h = (hashes ^ np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)) * SPREAD
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, label: str, text: str, doc_id: str, held_out: Column, most: int) -> DataFrame:
    """Rows (id, y, body) for learning: of each class, at most `most` labelled ids outside the held-out fold, the first by
    a hash of the id, and of each id one text, the one with the least hash. Ids that are labelled both ways teach nothing.
    The ids are bounded by the parameter, so they are broadcast; one pass over the texts, reduced per id before its
    shuffle."""
    usable = labels.where(~F.coalesce(held_out, F.lit(True)) & F.col(label).isin(0, 1))
    usable = usable.groupBy(F.col(doc_id).alias("id")).agg(
        F.min(F.col(label).cast("int")).alias("y"), F.max(F.col(label).cast("int")).alias("other")
    ).where("y = other and id is not null").select("id", "y")
    order = [F.xxhash64(F.col("id")), F.col("id")]
    some = [usable.where(F.col("y") == y).orderBy(*order).limit(most) for y in (0, 1)]
    chosen = some[0].unionByName(some[1])
    texts = docs.select(F.col(doc_id).alias("id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("body"))
    held = texts.join(F.broadcast(chosen), "id")
    return held.groupBy("id", "y").agg(F.min_by("body", F.xxhash64("body")).alias("body"))


def share_of_ones(labels: DataFrame, *, label: str, held_out: Column) -> float:
    """Share of label 1 among the rows to learn from, over all of them."""
    usable = labels.where(~F.coalesce(held_out, F.lit(True)) & F.col(label).isin(0, 1))
    share = usable.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return min(max(share if share is not None else 0.5, 1e-3), 1 - 1e-3)


def fold_rows(docs: DataFrame, score, *, text: str, doc_id: str, held_out: Column, extra: list[Column] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row (and `extra`); score maps texts as bytes to numbers."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        *extra,
        F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("body"),
    )
    schema = T.StructType([f for f in rows.schema.fields if f.name != "body"]).add("score", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                found = score(part.column("body").to_pylist())
                kept = [c for c in part.schema.names if c != "body"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(found, pa.float64())], [*kept, "score"]
                )

    scored = rows.mapInArrow(run, schema)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
