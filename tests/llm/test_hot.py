"""A third of all rows under one id, contradictory labels, long texts with tabs, and tables without rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from borewatch.llm import common, language, mixing, packing, quality_model, sharding, simhash, terms, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def hot(spark):
    """1,800 rows; 600 of them have id 7, equal texts as well, and 300 more id 7 with texts of their own."""
    rng = random.Random(4)
    words = "river stone winter garden letter cloud road house tree mill".split()
    rows = [(7, "the same words over and over again", "en", "s0", 1)] * 600
    rows += [(7, " ".join(rng.choices(words, k=9)) + f" {i}", "en", "s1", 1) for i in range(300)]
    rows += [(100 + i, " ".join(rng.choices(words, k=5 + i % 30)) + f" {i}", "en", f"s{i % 3}", 1) for i in range(900)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def test_sample_bound_holds(spark, hot):
    labels = spark.createDataFrame([(7, 1), (7, 1), (101, 0), (102, 0), (102, 1), (103, None), (None, 1)], "doc_id long, quality int")
    for most in (1, 5):
        out = terms.labelled_sample(hot, labels, label="quality", text="text", doc_id="doc_id", held_out=F.lit(False), most=most)
        rows = out.collect()
        assert Counter((r["id"], r["y"]) for r in rows) == {(7, 1): 1, (101, 0): 1}
        again = out.repartition(3).collect()
        assert sorted(bytes(r["body"]) for r in rows) == sorted(bytes(r["body"]) for r in again)


def test_models_learn_from_hot_ids(spark, hot):
    labels = spark.createDataFrame([(100 + i, int(i % 2)) for i in range(300)] + [(7, 1), (7, 0)], "doc_id long, y int")
    marked = labels.withColumnsRenamed({"y": "quality"}).withColumn("toxic", F.col("quality"))
    assert quality_model.classify(hot, marked, sample=40).count() == 1800
    assert toxicity.score(hot, marked, sample=40).count() == 1800


def test_a_language_with_a_single_id_is_learned(spark):
    rows = [(1000 + i, f"the river and the stone {i} of winter", "en", None, 1) for i in range(400)]
    rows += [(8, "zzyk qqal wvuz xxop jyzq " * 20, "xx", None, 1)] * 400
    out = language.identify(spark.createDataFrame(rows, DOCS).repartition(3), fold=(4, 9), sample=20)
    found = Counter((r.doc_id == 8, r.lang_pred) for r in out.collect())
    assert found == {(False, "en"): 400, (True, "xx"): 400}


def test_copies_are_numbered(spark, hot):
    rows = hot.select(F.xxhash64("doc_id", "text").alias("mark"), F.monotonically_increasing_id().alias("row_no"))
    out = common.copy_numbers(rows, "mark").collect()
    by_mark = Counter(r.mark for r in out)
    large = {m for m, n in by_mark.items() if n > common.HUB}
    assert len(large) == 1 and len(out) == 1800
    assert sorted(r.copy_no for r in out if r.mark in large) == list(range(1, 601))
    assert {r.copy_no for r in out if r.mark not in large} == {0}


def test_mix_deals_out_rows_of_one_id(hot):
    def taken(df):
        return Counter((r.doc_id, r.size, r.copies) for r in mixing.mix(df).collect())

    out = taken(hot)
    assert sum(out.values()) == 1800 and out == taken(hot.repartition(3))
    same = {c: n for (d, size, c), n in out.items() if d == 7 and size == 7}
    assert sum(same.values()) == 600 and len(same) == 2, "rows equal in all are neither all taken nor all left"


def test_shards_deal_out_rows_of_one_id(hot):
    out = sharding.shards(hot).collect()
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    assert len(out) == 1800 and max(sizes.values()) - min(sizes.values()) < 2 * max(r.size for r in out)
    for shard in sizes:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


def test_splitters_weigh_records_by_size(spark):
    # small records have small keys, large ones large keys: half of the bytes lie above key 990
    rows = [(k, 1 if k < 990 else 99, f"r{k}") for k in range(1000)]
    df = spark.createDataFrame(rows, "key long, size long, record string")
    borders = sharding.splitters(df, 64, sum(r[1] for r in rows))
    assert 22 <= sum(b < 990 for b in borders) <= 42, "each record counting once, 62 of 63 borders would lie there"


def test_hubs_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB", 20)
    star = [(0, i) for i in range(1, 200)] + [(500, 500 + i) for i in range(1, 15)] + [(600, 601), (199, 700)]
    edges = spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in star], "a long, b long").repartition(3)
    out = {r["node"]: r["component_id"] for r in common.components(edges).collect()}
    assert {out[i] for i in [*range(200), 700]} == {0} and {out[500 + i] for i in range(15)} == {500} and out[601] == 600


def test_texts_are_cut_between_words_at_any_white_space(spark):
    words = re.compile(rb"[^\x20\x09-\x0D]+")
    rng = random.Random(6)
    text = b"".join(bytes(rng.choices(b"abcde", k=rng.randrange(1, 9))) + rng.choice([b"\t", b"\r", b"\x0b", b"\f"]) for _ in range(400))
    got = []
    for data, owner in terms.strips([text, b"x\ty", b""], 64):
        assert len(data) == len(owner) <= 64 + 2 * 3
        got += words.findall(data.tobytes())
    assert got == words.findall(text) + [b"x", b"y"]


def test_long_texts_are_read_to_their_end(spark):
    """Above the strip of a megabyte, with tabs alone between the words."""
    filler = "river\tstone\t" * 120_000
    rows = [(1, filler + "venomword", "en", "s", 1), (2, filler, "en", "s", 1)]
    rows += [(10 + i, "venomword river", "en", "s", 1) for i in range(40)] + [(100 + i, "river stone", "en", "s", 1) for i in range(40)]
    labels = [(10 + i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score(docs, marks, fold=(5, 9)).collect()}
    assert out[1] > out[2]
    assert len(filler) > terms.STRIP
    named = {r.doc_id: r.lang_pred for r in language.identify(docs, fold=(4, 9)).collect()}
    assert named[1] == named[2] == "en"


def test_pack_and_simhash_of_equal_rows(spark, hot):
    import public_tokenizers

    out = packing.pack(hot, tokenizer=public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(out) == 1800
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096
    groups = simhash.near_duplicates(hot)
    assert groups.count() == 1800 and groups.where("doc_id = 7").select("component_id").distinct().count() >= 1


def test_other_tokenizer_files_are_used_plainly():
    import public_tokenizers

    words, bytes_ = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    assert isinstance(packing._ids(words), packing.Ids) and isinstance(packing._ids(bytes_), packing.PlainIds)
    texts = ["A pump, a PUMP.", "", "x\ty  z"]
    whole = [packing._encoder(bytes_).encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(memoryview(b).cast("I")) for b in packing._ids(bytes_).of(texts)] == whole


def test_pipeline_without_rows(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
