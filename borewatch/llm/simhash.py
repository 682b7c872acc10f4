"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints link at `radius` 3 or fewer differing bits. Every distinct fingerprint emits all its variants within
half the radius, rounded down to one bit; fingerprints that meet in a variant are at most two bits apart, so they link
as they are, and a chain through those that share a variant links them all without forming pairs. For the odd third
bit, the 64 bits are cut into four blocks, and each block in turn is left out: if three bits differ, at least one lies
in some block, the other two outside it, and the variants of the remaining 48 bits meet. Those meetings are only
candidates. A meeting whose fingerprints are in one component already is dropped; the others are verified pair by pair
where few meet, and where many meet, by variants at one bit from the one side and at two from the other, which meet
exactly at three bits or fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from borewatch.llm.common import carried, components, join_counted, materialise
from borewatch.session import ship_package

SEED, SHINGLE = 42, 3
N_BLOCKS, BLOCK = 4, 16
#: In a meeting of at most so many fingerprints, the pairs are verified; larger ones go by variants.
FEW = 32
#: Hashes turned into bits at a time.
STRIP = 1 << 16


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the hashes of shingles of `shingle` words; 0 without a word.

    Words are split at ASCII white space and A-Z is lower-cased, which is what these methods of bytes do.
    """
    found = (text or b"").lower().split()
    if not found:
        return 0
    whole = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    n = len(found) - shingle + 1
    if n < 1:
        return digest(whole, SEED)
    ends, at = [], -1
    for word in found:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    hashes = [digest(whole[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, n, STRIP):
        strip = np.array(hashes[k : k + STRIP], dtype="<u8")
        counts += np.unpackbits(strip.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [signed(fingerprint(t, shingle)) for t in batch.column("body").to_pylist()]
            kept = [(f, batch.column(f)) for f in batch.schema.names if f != "body"]
            columns = [c for _, c in kept] + [pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [f for f, _ in kept] + ["fp"])

    return run


def with_fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """rows (body binary, ...): the other columns and `fp` long."""
    ship_package(rows.sparkSession)
    kept = rows.drop("body")
    schema = kept.schema.add("fp", "long")
    return rows.mapInArrow(_fingerprints(shingle), schema)


def _masks(bits: list[int], most: int) -> list[int]:
    """Flips of up to `most` (1 or 2) of the bits."""
    flips = [0] + [1 << i for i in bits]
    if most == 2:
        flips += [1 << i | 1 << j for k, i in enumerate(bits) for j in bits[k + 1 :]]
    return [signed(x) for x in flips]


def _variants(fp, flips: list[int]):
    return F.transform(F.lit(flips), lambda x: fp.bitwiseXOR(x))


def _spread(prints: DataFrame) -> DataFrame:
    """Deal a small table out anew, for work that makes many rows of each of its rows."""
    return prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def links_of_two(prints: DataFrame) -> DataFrame:
    """Edges of numbers that connect all fingerprints at most two bits apart: neighbours in the order of those that share
    a variant. prints: (fp, node)."""
    flips = _masks(list(range(64)), 1)
    ball = _spread(prints).select("node", F.explode(_variants(F.col("fp"), flips)).alias("at"))
    chain = Window.partitionBy("at").orderBy("node")
    edges = ball.select(F.col("node").alias("a"), F.lag("node").over(chain).alias("b"))
    return edges.where("b is not null").distinct()


def _outside(prints: DataFrame, *columns: str) -> DataFrame:
    """Variants with one block left out; the empty block holds the block's number instead."""
    keys = []
    for j in range(N_BLOCKS):
        block = ((1 << BLOCK) - 1) << (BLOCK * j)
        rest = [i for i in range(64) if not block >> i & 1]
        tag = (j + 1) << (BLOCK * j)
        flips = [signed((x & (1 << 64) - 1) | tag) for x in _masks(rest, 1)]
        keys.append(_variants(F.col("fp").bitwiseAND(F.lit(signed(~block & (1 << 64) - 1))), flips))
    return _spread(prints).select(*columns, F.explode(F.concat(*keys)).alias("at"))


def links_of_three(prints: DataFrame) -> DataFrame:
    """Edges (a, b) of components, for fingerprints (fp, comp) that differ in three bits or fewer across components."""
    # dealt out by variant before aggregating: a variant has few rows, so combining them earlier would save nothing
    met = _outside(prints, "comp").repartition("at").groupBy("at").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = materialise(met.where("lo <> hi").select("at"))
    members = materialise(join_counted(_outside(prints, "fp", "comp"), mixed, ["at"], "inner"))
    sizes = members.groupBy("at").agg(F.count("*").alias("n"))
    members = members.join(sizes, "at")
    few = members.where(F.col("n") <= FEW)
    other = few.select("at", F.col("fp").alias("fp2"), F.col("comp").alias("comp2"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= 3
    pairs = few.join(other.hint("merge"), "at").where((F.col("comp") < F.col("comp2")) & close)
    pairs = pairs.select(F.col("comp2").alias("a"), F.col("comp").alias("b"))
    many = members.where(F.col("n") > FEW).select("fp", "comp").distinct()
    bits = list(range(64))
    one = many.select("comp", F.explode(_variants(F.col("fp"), _masks(bits, 1))).alias("at"))
    one = one.groupBy("at").agg(F.min("comp").alias("b"))
    two = many.select(F.col("comp").alias("a"), F.explode(_variants(F.col("fp"), _masks(bits, 2))).alias("at"))
    far = two.join(one.hint("merge"), "at").where("a <> b").select("a", "b")
    return pairs.unionByName(far).distinct()


def groups(prints: DataFrame) -> DataFrame:
    """prints: distinct fingerprints `fp`. Rows (fp, comp): the number of its component.

    Fingerprints are numbered as they are written; small numbers shuffle in fewer bytes than random 64-bit values.
    """
    numbered = materialise(prints.select("fp", F.monotonically_increasing_id().alias("node")))
    own = components(links_of_two(numbered)).withColumnRenamed("component_id", "comp")
    first = materialise(numbered.join(own, "node", "left").select("fp", F.coalesce("comp", "node").alias("comp")))
    joined = components(links_of_three(first)).withColumnRenamed("node", "comp")
    return first.join(joined, "comp", "left").select("fp", F.coalesce("component_id", "comp").alias("comp"))


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest reachable id).

    Null and empty texts, and those of white space, have fingerprint zero and link like any other. Equal texts share a
    fingerprint and are compared once. Null ids are listed with the component of their text, whose id is the smallest
    that isn't null, or null if all are. Rows that repeat an id are listed as often. Empty tables give no rows; other
    columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("body"))
    rows = materialise(with_fingerprints(rows, shingle))
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = groups(prints.select("fp"))
    least = prints.join(found, "fp")
    ids = least.groupBy("comp").agg(F.min("least").alias("component_id"))
    table = least.select("fp", "comp").join(ids, "comp").select("fp", "component_id")
    out = join_counted(rows, materialise(table), ["fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """One document of each group, the one with the smallest id, with the columns of `docs`; a null id yields to any
    other, and of rows that repeat an id one stays."""
    rows = docs.select(*carried(docs), F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("body"))
    rows = materialise(with_fingerprints(rows, shingle))
    found = groups(materialise(rows.select("fp").distinct()))
    narrow = join_counted(rows.select("fp", "doc_id", "row_no"), materialise(found), ["fp"])
    best = narrow.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_no")).alias("best"))
    winners = best.select("best.row_no")
    return rows.select("carried", "row_no").join(winners, "row_no", "left_semi").select("carried.*")
