"""Names in texts against a plain search."""

import random

import pytest

from borewatch.operators import names, queues
from borewatch.operators.names import names_in_texts


def found(spark, given, texts):
    n = spark.createDataFrame([(x,) for x in given], "well string")
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc long, text string").repartition(3)
    rows = [(r["well"], r["doc"]) for r in names_in_texts(n, t, "well", ["doc"], "text").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def plain(given, texts):
    return {(n, i) for n in given for i, t in enumerate(texts) if n and t and n.lower() in t.lower()}


@pytest.mark.parametrize("piece", [512, 4])
def test_names_equal_a_plain_search(spark, monkeypatch, piece):
    monkeypatch.setattr(names, "PIECE", piece)
    rng = random.Random(piece)
    given = ["A-1", "a-1", "A-12", "15/9-F-1 C", "x", "É", "ab", "aaa", "aaaa", "W\nX", "", None, "not there at all", "a-1 and b"]
    given += ["".join(rng.choices("abc-1 ", k=rng.randrange(1, 9))) for _ in range(60)]
    texts = ["".join(rng.choices("abcABC-12 é\n", k=rng.randrange(0, 60))) for _ in range(60)]
    texts += ["well 15/9-f-1 C and w\nx", "", None, "a" * 40, "Aé", "x", "a-1 and b"]
    given = [g for i, g in enumerate(given) if g not in given[:i]]
    assert found(spark, given, texts) == plain(given, texts)


def test_nothing(spark):
    assert found(spark, [], ["a"]) == set() and found(spark, ["a"], []) == set() and found(spark, ["", None], ["a"]) == set()


def test_a_long_text_and_many_names(spark):
    rng = random.Random(1)
    given = [f"W-{i:06d}/{'abcdef'[i % 6]}" for i in range(100_000)]
    held = rng.sample(range(100_000), 300)
    filler = "".join(f"pump {rng.randrange(10**6)} at W-{rng.randrange(10**6):06d} was checked; " for _ in range(140_000))
    parts = [filler[k * len(filler) // 300 : (k + 1) * len(filler) // 300] + given[i].lower() for k, i in enumerate(held)]
    text = "".join(parts)
    assert len(text) > 5_000_000
    want = {(given[i], 0) for i in held}
    got = found(spark, given, [text, "none"])
    assert want <= got and all(n.lower() in text for n, _ in got)
    # the others in the text are there by chance of the filler
    assert len(got) <= len(want) + 5


def test_chunks_of_maintenance_are_worked_out_once(spark):
    """A long scan of texts, as a cut into chunks is, isn't repeated for every step that reads its rows."""
    worked = spark.sparkContext.accumulator(0)

    def cut(batches):
        for batch in batches:
            worked.add(batch.num_rows)
            yield batch

    rows = [(f"d{i}", i % 3, "t", "Maintenance Log", f"pump of W-{i} and w-{i + 1}", None if i % 2 else "W-7") for i in range(40)]
    schema = "document_id string, chunk_index int, title string, doc_type string, content string, well_id string"
    texts = spark.createDataFrame(rows, schema).repartition(2)
    chunks = texts.mapInArrow(cut, schema).selectExpr("*", "timestamp_seconds(chunk_index) AS indexed_at")
    wells = spark.createDataFrame([("W-7",), ("W-12",), ("W-99",)], "well_id string")
    got = {(r.well_id, r.document_id) for r in queues.maintenance_records(wells, chunks, newest=100).collect()}
    assert {d for w, d in got if w == "W-12"} == {"d11", "d12"} and {w for w, _ in got} == {"W-7", "W-12"}
    assert {d for w, d in got if w == "W-7"} == {f"d{i}" for i in range(0, 40, 2)} | {"d7"}
    assert worked.value == len(rows)
