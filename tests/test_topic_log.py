"""Topics as logs of files: offsets, restarts, replays, batches that run twice."""

import json
import zlib

import pytest

from borewatch.sources import topic_log
from borewatch.sources.named_files import files_below, read_named, write_named
from borewatch.streaming import jobs


def messages(spark, numbers):
    return spark.createDataFrame([(f"w{i % 7}" if i % 11 else None, json.dumps({"i": i})) for i in numbers], "key string, value string")


def test_a_restart_loses_and_repeats_nothing(spark, tmp_path):
    topic, out, state = (str(tmp_path / n) for n in ("topic", "out", "state"))
    topic_log.send_to_log(messages(spark, range(50)).repartition(3), topic, 4)
    assert jobs.run_to_end(topic_log.read_log(spark, topic), out, state).count() == 50
    assert jobs.run_to_end(topic_log.read_log(spark, topic), out, state).count() == 50
    topic_log.send_to_log(messages(spark, range(50, 90)), topic, 4)
    topic_log.send_to_log(messages(spark, range(90, 95)), topic, 4)
    rows = jobs.run_to_end(topic_log.read_log(spark, topic), out, state).collect()
    assert sorted(json.loads(r["value"])["i"] for r in rows) == list(range(95))
    places = {(r["partition"], r["offset"]) for r in rows}
    assert len(places) == 95
    for p, end in topic_log.ends(topic).items():
        assert {o for q, o in places if q == int(p)} == set(range(end)), "offsets have no gaps"
    for r in rows:
        assert r["partition"] == (zlib.crc32(r["key"].encode()) % 4 if r["key"] else 0)
    # another reader has its own place, and a late one may begin at the end
    again = jobs.run_to_end(topic_log.read_log(spark, topic), str(tmp_path / "out2"), str(tmp_path / "state2"))
    assert again.count() == 95
    late = jobs.run_to_end(topic_log.read_log(spark, topic, "latest"), str(tmp_path / "out3"), str(tmp_path / "state3"))
    assert late.count() == 0


def test_streams_write_each_batch_once(spark, tmp_path):
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    topic_log.send_to_log(messages(spark, range(30)), source, 4)

    def copy(name):
        stream = topic_log.read_log(spark, source)
        writer = topic_log.stream_to_log(stream, target, str(tmp_path / name), name, 3)
        writer.trigger(availableNow=True).start().awaitTermination()

    copy("a")
    copy("a")
    assert sum(topic_log.ends(target).values()) == 30
    copy("b")
    assert sum(topic_log.ends(target).values()) == 60


def test_a_batch_cut_off_halfway_is_completed(tmp_path):
    rows = [{"key": k, "value": "v"} for k in "abcdefgh"]
    writer = topic_log.TopicStreamWriter(str(tmp_path), 4, "s")
    whole = writer.write(iter(rows))
    writer.commit([whole], 0)
    before = topic_log.segments(str(tmp_path))
    lost = before[0]
    (tmp_path / f"p{lost.partition}").joinpath(lost.path.rsplit("/", 1)[1]).unlink()
    writer.commit([writer.write(iter(rows)), None], 0)
    assert topic_log.segments(str(tmp_path)) == before
    writer.abort([writer.write(iter(rows))], 1)
    assert topic_log.segments(str(tmp_path)) == before
    writer.commit([writer.write(iter(rows))], 1)
    assert sum(topic_log.ends(str(tmp_path)).values()) == 16


def test_named_files(spark, tmp_path):
    folder = str(tmp_path / "pages")
    pages = spark.createDataFrame([("a b+c%20é.md", "one\n"), ("b.md", None), ("c.md", "x\r\ny" * 1000)], "name string, text string")
    for _ in range(2):
        write_named(pages, folder)
        assert files_below(folder) == ["a b+c%20é.md", "b.md", "c.md"]
    got = {r["name"]: r["text"] for r in read_named(spark, folder).collect()}
    assert got["a b+c%20é.md"] == "one\n" and got["c.md"] == "x\r\ny" * 1000
    write_named(pages.where("name = 'b.md'"), folder, overwrite=False)
    assert len(files_below(folder)) == 3
    write_named(pages.where("name = 'b.md'"), folder)
    assert files_below(folder) == ["b.md"]
    with pytest.raises(Exception, match="not a file name"):
        write_named(spark.createDataFrame([("../x", "t")], "name string, text string"), folder)
    assert files_below(folder) == ["b.md"]
