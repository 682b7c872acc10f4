import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from borewatch.operators import production_stats as stats
from borewatch.operators.retrieval import CHUNK_KEY, hashed_embedding
from borewatch.plans import corpus
from borewatch.schema import CHUNK, DOCUMENT, ESCALATION
from borewatch.sources import buckets, documents, named_files, production, tables, topics
from borewatch.sources.named_files import files_below, read_named, write_named
from borewatch.streaming.jobs import append_batches

HEADER = "DATEPRD,NPD_WELL_BORE_NAME,NPD_FIELD_NAME,FLOW_KIND,ON_STREAM_HRS,BORE_OIL_VOL,BORE_WAT_VOL,BORE_GAS_VOL,AVG_DOWNHOLE_PRESSURE,AVG_WHP_P,AVG_WHT_P,AVG_CHOKE_SIZE_P"
DAILY = [
    "2014-04-07, A-1 ,VOLVE,production,24,100,50,15000,250,30,80,50",
    "2014-04-08,A-1,,production,1,0,0,10,,,,",
    "2014-04-09,A-1,VOLVE,production,0.9,100,50,1,1,1,1,1",
    "2014-04-10,A-1,VOLVE,injection,24,100,50,1,1,1,1,1",
    ",A-1,VOLVE,production,24,100,50,1,1,1,1,1",
    "2014-04-11,,VOLVE,production,24,100,50,1,1,1,1,1",
    "2014-04-12,B,VOLVE,production,24,-5,oops,7,1,1,1,1",
]


def test_daily_scan(spark, tmp_path):
    path = tmp_path / "daily.csv"
    path.write_text("\n".join([HEADER, *DAILY]) + "\n")
    raw = production.read_daily(spark, str(path))
    rows = production.normalise_daily(raw).orderBy("well_id", "timestamp").collect()
    assert [(r["well_id"], r["timestamp"].day) for r in rows] == [("A-1", 7), ("A-1", 8), ("B", 12)]
    first, idle, odd = rows
    assert (first["oil_rate_bopd"], first["water_cut_pct"], first["gas_oil_ratio"]) == (629.0, 33.3, 842.0)
    assert (first["bhp_psi"], first["wh_temp_f"], first["choke_64ths"]) == (3626.0, 176.0, 32.0)
    assert first["is_producing"] and not idle["is_producing"]
    # Missing gauges read as zero, so a missing temperature is 32 F.
    assert (idle["bhp_psi"], idle["wh_temp_f"], idle["water_cut_pct"], idle["gas_oil_ratio"]) == (0.0, 32.0, 0.0, 0.0)
    assert idle["field_name"] == "VOLVE" and odd["oil_rate_bopd"] == 0.0 and odd["water_cut_pct"] == 0.0
    nulls = production.normalise_daily(raw, missing_as_null=True).filter("well_id = 'A-1' and day(timestamp) = 8").first()
    assert nulls["wh_temp_f"] is None and nulls["bhp_psi"] is None
    assert production.normalise_daily(raw, producers_only=False).count() == 4


def monthly_file(tmp_path, rows):
    path = tmp_path / "monthly.csv"
    names = "prfInformationCarrier;prfYear;prfMonth;prfPrdOilNetMillSm3;prfPrdGasNetBillSm3;prfPrdOeNetMillSm3;prfPrdProducedWaterInFieldMillSm3"
    path.write_text("\n".join([names, *rows]) + "\n", encoding="utf-8")
    return str(path)


def test_monthly_scan_and_statistics(spark, tmp_path):
    rows = [f"Draugen;2010;{m};{0.1 * m:.1f};0.01;1;0.2" for m in range(1, 13)]
    rows += ["DRAUGEN;2012;2;1.2;0.01;1;0.0", "Volve;2010;1;0;0;0;0", "Draugen;1999;1;9;9;9;9", "Draugen;bad;1;1;1;1;1", "Draugen;2011;13;0.1;0;0;0"]
    raw = production.read_monthly(spark, monthly_file(tmp_path, rows))
    df = production.normalise_monthly(raw, [" draugen "])
    found = {(r["field_name"], r["year"], r["month"]): r for r in df.collect()}
    assert len(found) == 14 and ("Draugen", 1999, 1) not in found
    leap = found[("DRAUGEN", 2012, 2)]
    assert leap["days_in_month"] == 29 and leap["oil_bopd"] == round(1.2e6 * 6.28981 / 29)
    assert found[("Draugen", 2011, 13)]["days_in_month"] == 30
    assert found[("Draugen", 2010, 3)]["date"] == dt.date(2010, 3, 1)
    every = production.normalise_monthly(raw)
    volve = every.filter("field_name = 'Volve'").first()
    assert volve["water_cut_pct"] == 0.0 and volve["gor_scf_bbl"] == 0.0
    statistics = {r["field_name"]: r for r in stats.field_statistics(every).collect()}
    assert statistics["Volve"]["peak_year"] == 0 and statistics["Draugen"]["months_of_data"] == 13
    facts = stats.with_field_facts(spark.createDataFrame([("volve",), ("Oseberg",), ("Elsewhere",)], "field_name STRING"), stats.field_statistics(every))
    basis = {r["field_name"]: (r["basis"], r["operator"]) for r in facts.collect()}
    assert basis == {"volve": ("measured", "Equinor"), "Oseberg": ("published", "Equinor"), "Elsewhere": (None, None)}
    context = stats.period_context(every, "draugen", 2011, 1).filter("field_name = 'Draugen'").first()
    # No lower month, no upper bound: January 2010 to the end of the table.
    assert context["max_oil_bopd_12m"] == found[("Draugen", 2010, 12)]["oil_bopd"] and context["period"] == "2011-01"
    folder = str(tmp_path / "cache")
    first = production.production_data(spark, monthly_file(tmp_path, rows), folder)
    again = production.production_data(spark, "/nowhere", folder)
    assert first[0].count() == again[0].count() == 15 and again[1].count() == 3
    with pytest.raises(ValueError):
        production.normalise_monthly(spark.createDataFrame([(1,)], "x INT"))


def test_wellbore_map(spark):
    raw = spark.createDataFrame(
        [("1", "A-1", "Volve", "2010", "1", "0.1", "0.01", "0", "0.2", "0.3")],
        "wlbNpdidWellbore STRING, wlbWellboreName STRING, prfInformationCarrier STRING, prfYear STRING, prfMonth STRING, "
        "prfPrdOilNetMillSm3 STRING, prfPrdGasNetBillSm3 STRING, prfPrdNGLNetMillSm3 STRING, prfPrdWaterNetMillSm3 STRING, prfPrdOeNetMillSm3 STRING",
    )
    row = production.normalise_wellbore_monthly(raw).first()
    assert row["well_id"] == "A-1" and row["water_net_mill_sm3"] == 0.2 and row["water_cut_pct"] > 60


def test_message_decoding(spark):
    good = {"timestamp": "2024-01-01T00:00:00+02:00", "well_id": "W", "oil_rate_bopd": 1.0, "water_cut_pct": 2.0}
    values = [json.dumps(good), json.dumps(good | {"bhp_psi": None}), "{oops", json.dumps(good | {"timestamp": "soon"}), json.dumps({k: v for k, v in good.items() if k != "well_id"})]
    decoded = topics.decode(spark.createDataFrame([(v,) for v in values], "value STRING"))
    assert [r["problem"] for r in decoded.collect()] == [None, "null feature: bhp_psi", "malformed message", "unreadable timestamp", None]
    fine = topics.usable(decoded).collect()
    assert [(r["well_id"], r["bhp_psi"], r["timestamp"]) for r in fine] == [("W", 0.0, dt.datetime(2023, 12, 31, 22)), ("unknown", 0.0, dt.datetime(2023, 12, 31, 22))]
    assert topics.quarantined(decoded).count() == 3
    out = topics.encode(topics.usable(decoded)).first()
    assert out["key"] == "W" and json.loads(out["value"])["oil_rate_bopd"] == 1.0


def embed(chunks):
    vectors = hashed_embedding(chunks, CHUNK_KEY, "embedding_text")
    return chunks.join(vectors.withColumn("embedding", F.col("embedding").cast("array<float>")), CHUNK_KEY, "left")


def test_ingest_replaces_documents(spark, tmp_path):
    source = tmp_path / "docs"
    (source / "well_reports").mkdir(parents=True)
    (source / "well_reports" / "a.md").write_text("# A\n## One\n" + "word " * 700)
    (source / "b.txt").write_text("plain text")
    (source / "blank.md").write_text(" \n")
    (source / "c.csv").write_text("no")
    store = [str(tmp_path / n) for n in ("documents", "chunks")]
    counts = documents.ingest(spark, documents.read_corpus(spark, str(source)), *store, embed)
    assert {r["source_path"].rsplit("/", 1)[1]: r["total_chunks"] for r in counts.collect()} == {"a.md": 3, "b.txt": 1}
    (source / "well_reports" / "a.md").write_text("# A2\nshort")
    documents.ingest(spark, documents.read_corpus(spark, str(source)), *store, embed)
    docs, chunks = buckets.read_buckets(spark, store[0], DOCUMENT), buckets.read_buckets(spark, store[1], CHUNK)
    assert {r["title"] for r in docs.collect()} == {"A2", "b"} and chunks.count() == 2
    assert all(len(r["embedding"]) == 64 for r in chunks.collect())
    cleared = buckets.clear_buckets(spark, {store[0]: DOCUMENT, store[1]: CHUNK})
    assert list(cleared.values()) == [2, 2] and buckets.read_buckets(spark, store[1], CHUNK).isEmpty()


def daily_frame(spark):
    rows = []
    for w, wells in enumerate(["15/9-F-1 C", "15/9-F-12"]):
        for i in range(70):
            day = dt.datetime(2014, 1, 1) + dt.timedelta(days=i)
            rows.append((day, wells, "VOLVE", float(1000 + 10 * i + w), float(i), 800.0, 3000.0 * (1 - w), 150.0, 40.0, i != 3))
    ddl = "timestamp TIMESTAMP, well_id STRING, field_name STRING, oil_rate_bopd DOUBLE, water_cut_pct DOUBLE, gas_oil_ratio DOUBLE, bhp_psi DOUBLE, wh_temp_f DOUBLE, choke_64ths DOUBLE, is_producing BOOLEAN"
    return spark.createDataFrame(rows, ddl)


def test_generated_corpus_and_golden_set(spark, tmp_path):
    daily = daily_frame(spark)
    cases = corpus.golden_cases(daily).orderBy("id").collect()
    # Four on the field, six for the well with pressure, five for the one without.
    assert [c["id"] for c in cases] == [f"VGT-{i:03d}" for i in range(1, 16)]
    assert [c["category"] for c in cases].count("field_overview") == 4
    assert "**15/9-F-12** at about **1691.0 BOPD**" in cases[2]["ground_truth"]
    assert cases[2]["document_sources"] == [corpus.FIELD_DOCUMENT, "Volve_RealDaily_15-9-F-12.md"]
    assert "140" in cases[3]["ground_truth"]
    text = {r["name"]: r["text"] for r in corpus.reports(daily).collect()}
    assert len(text) == 3 and "| 2014-02 | 28 | 1445.0 | 44.5 |" in text["Volve_RealDaily_15-9-F-1_C.md"]
    assert "- **Producing days:** 69" in text["Volve_RealDaily_15-9-F-1_C.md"]
    blocks = corpus.reference_lines(corpus.golden_cases(daily)).collect()
    overview = sorted((b for b in blocks if b["name"] == corpus.FIELD_DOCUMENT), key=lambda b: b["block_no"])
    assert len(overview) == 1 + 4 + 4 and overview[0]["text"].startswith("# VOLVE Field Overview RealDailyProduction\n")
    folders = [str(tmp_path / n) for n in ("corpus", "golden", "documents", "chunks")]
    counts = corpus.resync(spark, daily, *folders, embed)
    assert counts.count() == 3 and counts.agg(F.sum("total_chunks")).first()[0] > 10
    assert files_below(folders[0]) == sorted(text) and {r["name"]: r["text"] for r in read_named(spark, folders[0]).collect()} == text
    documents.write_blocks(corpus.reference_lines(corpus.golden_cases(daily)), str(tmp_path / "blocks"))
    whole = {r["name"]: r["text"] for r in read_named(spark, str(tmp_path / "blocks")).collect()}
    parts = sorted(blocks, key=lambda b: (b["name"], b["block_no"]))
    assert whole == {n: "".join(b["text"] for b in parts if b["name"] == n) for n in {b["name"] for b in parts}}


def test_many_named_files(spark, tmp_path):
    folder = str(tmp_path / "many")
    pages = spark.range(600).select(F.format_string("a %%41+%d.md", "id").alias("name"), F.concat(F.lit("\u00fc\r\n"), "id").alias("text"))
    empty = spark.createDataFrame([("empty.md", None)], "name string, text string")
    write_named(spark.createDataFrame([("old.md", "gone"), ("a %41+7.md", "old")], "name string, text string"), folder)
    write_named(pages.unionByName(empty), folder)
    assert len(files_below(folder)) == 601 and "old.md" not in files_below(folder)
    (tmp_path / "many" / "bad.md").write_bytes(b"a\xff")
    (tmp_path / "many" / "_hidden").write_text("no")
    found = read_named(spark, folder)
    # A task takes many files; before, it took as many as fit their opening costs, 32.
    assert found.rdd.getNumPartitions() == 1
    want = {f"a %41+{i}.md": f"\u00fc\r\n{i}" for i in range(600)} | {"bad.md": "a\ufffd"}
    assert {r["name"]: r["text"] for r in found.collect()} == want


def test_named_files_are_dealt_into_slices(tmp_path, monkeypatch):
    monkeypatch.setattr(named_files, "SLICE_FILES", 3)
    monkeypatch.setattr(named_files, "SLICE_BYTES", 10)
    for name, size in zip("abcdefgh", (1, 1, 1, 1, 9, 30, 0, 2)):
        (tmp_path / name).write_text("x" * size)
    reader = named_files.NamedTextReader(str(tmp_path))
    assert ["".join(s.names) for s in reader.partitions()] == ["abc", "de", "f", "h"]
    monkeypatch.setattr(named_files, "BATCH_BYTES", 2)
    assert [b.to_pydict() for b in reader.read(reader.partitions()[0])] == [
        {"name": ["a", "b"], "text": ["x", "x"]}, {"name": ["c"], "text": ["x"]}
    ]


def test_golden_file(spark, tmp_path):
    path = tmp_path / "golden.json"
    path.write_text(json.dumps([{"id": "1", "category": "c", "question": "q", "expected_topics": ["t"], "ground_truth": "g", "document_sources": ["a.md", "b.md"]}], indent=1))
    assert documents.read_golden(spark, str(path)).first()["document_sources"] == ["a.md", "b.md"]


def test_escalation_table_is_idempotent(spark, tmp_path):
    from borewatch.streaming.jobs import escalate_batches

    batch = spark.sql(
        "SELECT 'i1' investigation_id, 'W' well_id, true should_escalate, array('LOW_CONFIDENCE') escalation_reasons, 'LOW' risk_level, "
        "0.5D confidence_score, 'why' escalation_message, 'x' root_cause_hypothesis UNION ALL SELECT 'i2', 'W', false, array(), 'LOW', 0.9D, NULL, 'y'"
    )
    published = []
    run = escalate_batches(str(tmp_path / "queue"), lambda df: published.append(df.count()))
    run(batch, 0)
    run(batch, 0)
    assert tables.read_table(spark, str(tmp_path / "queue"), ESCALATION).count() == 1 and published == [1]
    # another stream on the same table, whose batch ids begin at 0 as well
    other = batch.withColumn("investigation_id", F.concat(F.lit("other"), "investigation_id"))
    escalate_batches(str(tmp_path / "queue"), lambda df: published.append(df.count()))(other, 0)
    assert tables.read_table(spark, str(tmp_path / "queue"), ESCALATION).count() == 2 and published == [1, 1]


def test_escalations_reach_the_topic_after_a_failed_publish(spark, tmp_path):
    from borewatch.streaming.jobs import escalate_batches

    batch = spark.sql(
        "SELECT 'i1' investigation_id, 'W' well_id, true should_escalate, array('LOW_CONFIDENCE') escalation_reasons, 'LOW' risk_level, "
        "0.5D confidence_score, 'why' escalation_message, 'x' root_cause_hypothesis"
    )

    def broken(_):
        raise RuntimeError("the topic is away")

    with pytest.raises(RuntimeError):
        escalate_batches(str(tmp_path / "queue"), broken)(batch, 0)
    published = []
    escalate_batches(str(tmp_path / "queue"), lambda df: published.extend(df.collect()))(batch, 0)
    stored = tables.read_table(spark, str(tmp_path / "queue"), ESCALATION).collect()
    assert len(stored) == 1 and published == stored


def test_appended_rows_are_read_back(spark, tmp_path):
    folder = str(tmp_path / "log")
    tables.append_rows(spark.range(3), folder, "a")
    tables.append_rows(spark.range(2), folder, "b")
    tables.append_rows(spark.range(2), folder, "b")
    assert tables.read_table(spark, folder, "id BIGINT").count() == 5
    for batch, n in ((0, 4), (0, 4), (1, 1)):
        append_batches(folder, "s")(spark.range(n), batch)
    append_batches(folder, "other")(spark.range(2), 0)
    assert tables.read_table(spark, folder, "id BIGINT").count() == 12


def test_upsert_keeps_one_row_per_key(spark):
    old = spark.createDataFrame([(1, "a")], "k INT, v STRING")
    new = spark.createDataFrame([(1, "b"), (1, "c"), (2, "d")], "k INT, v STRING")
    out = tables.upsert(old, new, ["k"]).collect()
    assert sorted(r["k"] for r in out) == [1, 2] and "a" not in {r["v"] for r in out}


def test_the_driver_holds_little_of_each_named_file(tmp_path, monkeypatch):
    """What a writing task reports and what a reading task is told take a few bytes for each file, whatever its name."""
    import pickle

    monkeypatch.setattr(named_files, "ENTRIES_AT_ONCE", 7)
    names = [f"{'long' * 30}-{i}.md" for i in range(400)]
    folder = tmp_path / "out"
    folder.mkdir()
    for old in ("gone.md", names[3], *(f"old-{i}" for i in range(20))):
        (folder / old).write_text("old")
    writer = named_files.NamedTextWriter(str(folder), overwrite=True)
    parts = [names[:150], [], names[150:]]
    messages = [writer.write(iter([{"name": n, "text": t} for n in part for t in (n, "!")])) for part in parts]
    assert sum(len(pickle.dumps(m)) for m in messages) < 40 * len(names)
    writer.commit(messages)
    assert files_below(str(folder)) == sorted(names) and not list(folder.glob("_attempt*"))
    slices = named_files.NamedTextReader(str(folder)).partitions()
    assert sum(len(pickle.dumps(s)) for s in slices) < 40 * len(names)
    assert [n for s in slices for n in s.names] == sorted(names)
    assert (folder / names[3]).read_text() == names[3] + "!"
    twice = [writer.write(iter([{"name": "a.md", "text": "x"}])) for _ in range(2)]
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit(twice)
    assert files_below(str(folder)) == sorted(names) and not list(folder.glob("_attempt*"))


def test_ingestion_embeds_a_chunk_once(spark, tmp_path):
    embedded = spark.sparkContext.accumulator(0)

    def embed(chunks):
        def run(parts):
            for part in parts:
                embedded.add(len(part))
                yield part.assign(embedding=[[1.0]] * len(part))

        return chunks.mapInPandas(run, f"{chunks._jdf.schema().toDDL()}, embedding ARRAY<FLOAT>")

    corpus = spark.createDataFrame([(f"a/{i}.md", "word " * 1300) for i in range(5)], "path string, text string")
    totals = documents.ingest(spark, corpus, str(tmp_path / "documents"), str(tmp_path / "chunks"), embed).collect()
    assert len(totals) == 5 and {r["total_chunks"] for r in totals} == {3}
    assert embedded.value == 15
