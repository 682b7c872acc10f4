import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from borewatch.operators import metrics
from borewatch.operators import retrieval as rt

DOCS = [
    ("d1", 0, "pump failure on well alpha caused by sand and scale in the pump"),
    ("d1", 1, "the separator upset was traced to a stuck valve"),
    ("d2", 0, "pump inspection schedule for alpha and bravo wells"),
    ("d3", 0, "gas coning increased the ratio; choke adjusted"),
    ("d4", 0, "**6** wells are listed. Wells represented: alpha, bravo. " + "Peak oil 5,000.0 BOPD here. Peak oil 4,000 BOPD there. " * 4),
]


@pytest.fixture(scope="module")
def chunks(spark):
    base = spark.createDataFrame(DOCS, "document_id STRING, chunk_index INT, content STRING").withColumns(
        {
            "title": F.when(F.col("document_id") == "d4", "Field production overview").otherwise(F.concat(F.lit("Incident "), "document_id")),
            "doc_type": F.lit("Well Report"), "section": F.lit("Body"), "page_number": F.lit(None).cast("int"),
            "source_path": F.when(F.col("document_id") == "d4", "x/VOLVE_Field_Overview_a.md").otherwise("y.md"),
        }
    )
    return base.join(rt.hashed_embedding(base, rt.CHUNK_KEY, "content"), rt.CHUNK_KEY).cache()


def ask(spark, *texts):
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id INT, query STRING")
    return queries.join(rt.hashed_embedding(queries, ["query_id"], "query"), "query_id", "left")


def vectors(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id INT, embedding ARRAY<DOUBLE>").repartition(5)


def test_passes_do_not_change_the_neighbours(spark):
    v = vectors(spark, 300, 1)
    q = v.withColumnRenamed("vec_id", "query_id")
    one = rt.semantic_top_k(q, v, 7, chunk_keys=["vec_id"]).collect()
    many = rt.semantic_top_k(q, v, 7, chunk_keys=["vec_id"], slice_bytes=16 * 8 * 50).collect()
    assert sorted(one) == sorted(many) and len(one) == 2100
    held = {r["vec_id"]: np.array(r["embedding"]) for r in v.collect()}
    unit = np.stack([held[i] / np.linalg.norm(held[i]) for i in range(300)])
    want = np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :7]
    got = {}
    for r in one:
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert all([got[i][k + 1] for k in range(7)] == want[i].tolist() for i in range(300))


def test_copies_tie_by_key():
    row, column, score = rt.best_columns(np.array([[0.5, 0.9, 0.9, 0.9, 0.1], [0.1, 0.2, 0.3, 0.4, 0.5]]), 2)
    assert column.tolist()[:2] == [1, 2] and sorted(column.tolist()[2:]) == [3, 4]
    assert row.tolist() == [0, 0, 1, 1] and score[0] == 0.9


def test_cells_find_most_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16)) * 3
    rows = [(i, (centres[i % 8] + rng.normal(size=16)).tolist()) for i in range(400)]
    v = spark.createDataFrame(rows, "vec_id INT, embedding ARRAY<DOUBLE>")
    q = v.withColumnRenamed("vec_id", "query_id")
    exact = {(r["query_id"], r["vec_id"]) for r in rt.semantic_top_k(q, v, 5, chunk_keys=["vec_id"]).collect()}
    indexed, found_centres = rt.cell_index(v, ["vec_id"], cells=8)
    for limits in ({}, {"slice_rows": 40, "cell_rows": 30}):
        near = rt.approximate_top_k(q, indexed, found_centres, 5, probes=3, chunk_keys=["vec_id"], **limits).collect()
        assert len({(r["query_id"], r["vec_id"]) for r in near} & exact) / len(exact) > 0.9


def test_postings_shuffle_only_what_shares_a_key(spark):
    alone = [("a", 0, "Pump pump the sand"), ("b", 0, ""), ("c", 0, None), ("d", 1, "the of")]
    twice = [("e", 0, "sand pump pump"), ("e", 0, "sand sand gas"), ("e", 0, "gas"), (None, 0, "scale"), (None, 0, "scale")]
    schema = "document_id STRING, chunk_index INT, content STRING"
    index = rt.postings(spark.createDataFrame(alone, schema))
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    found = sorted(tuple(r) for r in index.collect())
    assert found == [("a", 0, 3, "pump", 2, True), ("a", 0, 3, "sand", 1, False)]
    both = {tuple(r) for r in rt.postings(spark.createDataFrame(alone + twice, schema).repartition(5)).collect()}
    assert both - set(found) == {
        ("e", 0, 3, "sand", 3, True), ("e", 0, 3, "pump", 2, False), ("e", 0, 3, "gas", 1, False), ("e", 0, 1, "gas", 1, True),
        (None, 0, 1, "scale", 2, True),
    }


def test_lexical_ladder(spark, chunks):
    queries = ask(spark, "pump alpha sand", "pump alpha volcano", "volcano zebra inspection", "volcano", "pump alpha sand")
    rows = rt.lexical_top_k(queries, rt.postings(chunks), 10).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["level"], r["document_id"]))
    # All terms; else single terms by length, the first that occurs.
    assert found[0] == [(0, "d1")] and found[4] == found[0]
    # "volcano" is longest but absent; of the two next longest "alpha" occurs, in three chunks.
    assert {lvl for lvl, _ in found[1]} == {3} and sorted(d for _, d in found[1]) == ["d1", "d2", "d4"]
    assert found[2] == [(2, "d2")] and 3 not in found


def test_hybrid_answers(spark, chunks):
    queries = ask(spark, "pump failure sand scale", "how many wells are listed in the field overview", "zebra volcano")
    found = rt.retrieve(queries, chunks, 3)
    rows = found.collect()
    best = {r["query_id"]: r["document_id"] for r in rows if r["position"] == 1}
    assert best[0] == "d1" and best[1] == "d4"
    assert all(0 <= r["relevance"] <= 1 for r in rows)
    front = [r for r in rows if r["query_id"] == 1 and r["document_id"] == "d4"][0]
    assert front["relevance"] >= 0.92 and front["rerank_score"] > 1.9
    answers = {r["query_id"]: r for r in rt.incident_citations(rt.answer(queries, found, chunks)).collect()}
    assert answers[0]["source_coverage"] == 1.0 and not answers[0]["weak_evidence"]
    assert answers[0]["context"].startswith("[Source 1: Incident d1 (Well Report, Body)] (relevance: ")
    assert answers[2]["weak_evidence"] and answers[2]["context"].endswith("before acting.")
    assert [c["document_id"] for c in answers[0]["incident_citations"]] == [
        c["document_id"] for c in answers[0]["citations"] if c["document_title"].startswith("Incident")
    ]


def test_weak_evidence_relief(spark):
    df = spark.createDataFrame([(0.38, 0.0), (0.37, 0.18), (0.37, 0.17), (0.23, 0.9)], "c DOUBLE, r DOUBLE")
    assert [r[0] for r in df.select(rt.weak_evidence(F.col("c"), F.col("r"))).collect()] == [False, False, True, True]


def test_every_overview_chunk_is_ranked(spark, chunks):
    filler = spark.range(300).select(
        F.lit("z").alias("document_id"), F.col("id").cast("int").alias("chunk_index"),
        F.when(F.col("id") == 299, "highest peak wells " * 20).otherwise(F.repeat(F.lit("x "), 100)).alias("content"),
        F.lit("a/Field_Overview_z.md").alias("source_path"),
    )
    queries = ask(spark, "which well has the highest peak", "pump failure").select("query_id", "query")
    front = sorted(tuple(r) for r in rt.overview_front(queries, filler, count=3).select("query_id", "chunk_index", "front_rank").collect())
    assert front == [(0, 0, 2), (0, 1, 3), (0, 299, 1)]


def test_gold_names_match_by_base_or_ending(spark):
    sources = spark.createDataFrame(
        [("a", "x/y/Report_1.md"), ("b", "1.md"), ("c", None), ("d", ""), ("e", "q/other.md")], "document_id STRING, source_path STRING"
    )
    found = spark.createDataFrame([(q, d) for q in (0, 1, 2) for d in "abcde"] + [(0, "a")], "query_id INT, document_id STRING")
    gold = spark.createDataFrame([(0, " z/REPORT_1.md/ "), (1, "1.md"), (2, None)], "query_id INT, source STRING")
    got = sorted(tuple(r) for r in metrics.gold_matches(found, sources, gold).collect())
    assert got == [(0, "a"), (0, "b"), (1, "a"), (1, "b")]
    weak = found.select("query_id").distinct().withColumn("weak_evidence", F.col("query_id") == 2)
    audit = metrics.retrieval_audit(metrics.gold_per_query(weak, found, sources, gold)).first()
    assert (audit["queries_with_gold"], audit["query_hits"], audit["chunk_hits"], audit["chunk_misses"]) == (2, 2, 5, 11)
    assert audit["miss_and_weak_evidence"] == 1 and audit["retrieval_recall"] == 1.0


def test_embedding_counts_each_text_where_it_is_read(spark):
    rows = [(1, "Pump pump SAND"), (1, "sand a/b-c"), (2, None), (3, "Kelvin İx"), (None, "pump"), (None, "valve"), (4, "!!"), (5, "")]
    df = spark.createDataFrame(rows, "id INT, body STRING").repartition(3)
    found = rt.hashed_embedding(df, ["id"], "body", size=8)
    # One row per text is shuffled, once; before, every bucket of a text was, and then the texts again.
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {}
    for key, body in rows:
        for token in re.findall(r"[a-z0-9][a-z0-9\-_/]*", (body or "").lower()):
            digest = hashlib.md5(token.encode()).hexdigest()
            want.setdefault(key, np.zeros(8))[int(digest[:6], 16) % 8] += 1 if int(digest[6], 16) < 8 else -1
    got = {r["id"]: r["embedding"] for r in found.collect()}
    assert got == {k: (v / np.sqrt((v * v).sum())).tolist() for k, v in want.items() if v.any()}


def test_remembered_buckets_are_bounded(monkeypatch):
    monkeypatch.setattr(rt, "KNOWN_TERMS", 3)
    known, fresh = rt._Buckets(64), rt._Buckets(64)
    for i in range(50):
        assert known[f"term{i % 7}"] == fresh.__missing__(f"term{i % 7}") and len(known) <= 3


def test_overview_overlap_is_that_of_every_pair(spark, monkeypatch):
    """Terms are sought once in a run of letters that chunks share; before, each query searched each text for each term."""
    from borewatch.functions import text as tx

    rng = np.random.default_rng(11)
    words = ["pump", "pumps", "sand", "highest", "thousand", "\u0130sland", "a-b/c", "peak_peak", "x" * 90 + "sandpump", "z\u00e9ro"]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(60)] + [None, "", "Peak"]
    chunks = spark.createDataFrame(
        [("d" if i % 3 else None, i % 50, t, "a/Field_Overview_z.md") for i, t in enumerate(texts)],
        "document_id string, chunk_index int, content string, source_path string",
    )
    asked = ["Which well has the highest peak, sand and pump", "how many wells thousand a-b/c", "Compare all wells highest z\u00e9ro land", "pump"]
    queries = spark.createDataFrame(list(enumerate(asked)) + [(0, asked[1])], "query_id int, query string")
    wide = queries.filter(tx.is_overview_query(F.col("query"))).crossJoin(chunks.filter(F.length(tx.strip(F.col("content"))) >= 40)).select(
        "query_id", *rt.CHUNK_KEY, F.length("content").alias("n"),
        tx.share_contained(tx.substantive_tokens(F.col("query")), F.lower("content")).alias("o"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("o"), F.desc("n"), "chunk_index", "document_id")
    want = wide.withColumn("r", F.row_number().over(order)).filter("r <= 9").select("query_id", *rt.CHUNK_KEY, "r")
    for block in (7, 256):
        monkeypatch.setattr(rt, "OVERVIEW_BLOCK", block)
        front = rt.overview_front(queries, chunks, count=9, shortest=40)
        assert sorted(map(repr, map(tuple, front.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    # no pair of a query and a text leaves a task unless it may be among the best
    compare = rt._best_overlaps(2, rt.CHUNK_KEY, ["query_id", *rt.CHUNK_KEY, "_overlap", "_length"])
    held = pa.table({"document_id": ["d"] * 50, "chunk_index": range(50), "_text": ["sand"] * 50, "_length": range(50)})
    out = compare(pa.table({"query_id": [1], "_terms": [["sand", "pump"]]}), held)
    assert out.column("chunk_index").to_pylist() == [48, 49] and out.column("_overlap").to_pylist() == [0.5, 0.5]
