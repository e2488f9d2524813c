"""Topics with offsets and commits, capped streams with kept statistics, history written once."""

import json
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugewell.operators.report import append_run, run_history
from gaugewell.plans.views import declared, declared_profile
from gaugewell.session import create_once
from gaugewell.sources import topic_log
from gaugewell.sources.topics import FileTopic, LogTopic
from gaugewell.streaming import ingest
from gaugewell.streaming.payload import encode

PROFILE = declared_profile([declared("id", "integer", min_value=0.0, max_value=1e9), declared("name", "string")])


@pytest.fixture
def topic(tmp_path):
    return LogTopic(str(tmp_path / "topic"), partitions=3)


def messages(spark, low, high, tasks=2):
    rows = spark.range(low, high, 1, tasks).selectExpr("id", "concat('n', id) as name")
    return encode(rows).select(F.concat(F.lit("k"), F.get_json_object("value", "$.id").cast("int") % 7).alias("key"), "value")


def ids(frame):
    return sorted(json.loads(r.value)["id"] for r in frame.collect())


def test_offsets_are_dense_and_keys_in_order(spark, topic):
    for low in (0, 100, 200):
        topic.write(messages(spark, low, low + 100), batch_id=f"b{low}")
    rows = topic.read(spark).collect()
    assert sorted(json.loads(r.value)["id"] for r in rows) == list(range(300))
    by_partition, by_key = {}, {}
    for r in rows:
        by_partition.setdefault(r.partition, []).append(r.offset)
        by_key.setdefault(r.key, []).append((r.partition, r.offset, json.loads(r.value)["id"]))
    assert all(sorted(o) == list(range(len(o))) for o in by_partition.values())
    for found in by_key.values():
        assert len({p for p, _, _ in found}) == 1
        assert [n for _, _, n in sorted(found)] == sorted(n for _, _, n in found)
    assert topic.end_offsets() == {p: len(o) for p, o in by_partition.items()}


def test_a_batch_is_written_once_and_ranges_are_read_again(spark, topic, monkeypatch):
    monkeypatch.setattr(topic_log, "GROUP_ROWS", 10)
    topic.write(messages(spark, 0, 50), batch_id="one")
    first = topic.end_offsets()
    for _ in range(2):
        topic.write(messages(spark, 50, 120), batch_id="two")
    files = {p.name for p in (topic_log.local_path(topic.path) / "segments").iterdir()}
    log = topic_log.Log(topic_log.local_path(topic.path)).refresh()
    assert files == {s["file"] for e in log.entries for s in e["segments"]} and len(log.entries) == 2
    assert ids(topic.read(spark, start=first)) == list(range(50, 120))
    assert ids(topic.read(spark, end=first)) == list(range(50))
    some = {p: n // 2 for p, n in first.items()}
    found = topic.read(spark, start=some, end=first).collect()
    assert sorted((r.partition, r.offset) for r in found) == [(p, o) for p in sorted(first) for o in range(some[p], first[p])]
    assert topic.read(spark, start="latest").count() == 0
    topic.write(messages(spark, 120, 121))  # without an id every write counts
    topic.write(messages(spark, 120, 121))
    assert topic.read(spark).count() == 122


def test_concurrent_commits_take_turns(tmp_path):
    def commit(number):
        for k in range(20):
            topic_log.Log(tmp_path).append(f"{k}" if k < 5 else f"{number}-{k}", [{"partition": k % 2, "file": f"{number}-{k}", "count": 3}])

    threads = [threading.Thread(target=commit, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = topic_log.Log(tmp_path).refresh()
    batches = Counter(e["batch"] for e in log.entries)
    assert set(batches.values()) == {1} and len(batches) == 5 + 4 * 15
    for p in (0, 1):
        segments = [s for e in log.entries for s in e["segments"] if s["partition"] == p]
        assert [s["offset"] for s in segments] == list(range(0, 3 * len(segments), 3))
    assert not [f for f in (tmp_path / "log").iterdir() if f.name.startswith(".")]


def test_null_keys_values_and_empty_writes(spark, topic):
    rows = spark.createDataFrame([(None, "a"), (None, "b"), ("", None), ("k", ""), (None, "é\n")], "key string, value string")
    topic.write(rows.limit(0), batch_id="empty")
    topic.write(rows, batch_id="some")
    assert Counter((r.key, r.value) for r in topic.read(spark).collect()) == Counter(map(tuple, rows.collect()))
    with pytest.raises(ValueError, match="mounted"):
        LogTopic("hdfs://host/topic").end_offsets()


def test_streams_between_topics_write_each_batch_once(spark, topic, tmp_path):
    topic.write(messages(spark, 0, 60), batch_id="a")
    other = LogTopic(str(tmp_path / "other"), partitions=2)

    def copy():
        stream = topic.read_stream(spark).writeStream.format(topic_log.FORMAT).option("path", other.path).option("partitions", 2)
        stream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    copy()
    topic.write(messages(spark, 60, 90), batch_id="b")
    copy()
    assert ids(other.read(spark)) == list(range(90))
    # a batch that ran again after its commit was lost is known by its number
    last = sorted((tmp_path / "checkpoint" / "commits").iterdir())[-1]
    for file in (last, last.parent / f".{last.name}.crc"):
        file.unlink(missing_ok=True)
    copy()
    assert ids(other.read(spark)) == list(range(90))


@pytest.mark.parametrize("most", [13, 1000])
def test_the_cap_is_exact_and_later_batches_are_not_read(spark, topic, most):
    for low in (0, 30, 60):
        broken = spark.createDataFrame([(f"k{i}", f"{{broken {low + i}") for i in range(4)], "key string, value string")
        topic.write(messages(spark, low, low + 30, 3).union(broken), batch_id=f"b{low}")
    ingestion = ingest.Ingestion.fresh(spark)
    ingest.run(topic.read_stream(spark), ingestion, profile=PROFILE, max_records=most)
    assert ingestion.validated(spark).count() == min(most, 90)
    assert ingestion.statistics(spark).first().total_records == min(most, 90)
    ingest.run(topic.read_stream(spark), ingestion, profile=PROFILE, max_records=most)
    assert ingestion.validated(spark).count() == min(most, 90)


@pytest.mark.parametrize("most", [0, 1, 5, 31, 32, 33, 99, 100, 101])
def test_the_last_message_taken_is_found_in_its_task(spark, most, monkeypatch):
    monkeypatch.setattr(ingest, "_BLOCK_BITS", 3)
    value = F.when(F.col("id") % 4 == 1, "broken").otherwise(F.format_string('{"id": %d}', "id"))
    rows = spark.range(0, 133, 1, 5).select(F.lit("k").alias("key"), value.alias("value"))
    found = ingest.up_to_record(rows, most)
    good = [r.value for r in found.where("value <> 'broken'").collect()]
    assert len(good) == min(most, 100) and sorted(int(g[7:-1]) for g in good) == [i for i in range(133) if i % 4 != 1][:most]
    # malformed messages in front of the last one taken, and none behind it unless all were taken
    assert found.count() == (133 if most > 100 else 0 if not most else [i for i in range(133) if i % 4 != 1][most - 1] + 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Limit" not in plan


def test_statistics_are_kept_over_restarts_and_read_no_rows(spark, topic):
    ingestion = ingest.Ingestion.fresh(spark)
    assert ingestion.statistics(spark) is None
    for number in range(4):
        topic.write(messages(spark, 10 * number, 10 * number + 10), batch_id=f"{number}")
        topic.write(spark.createDataFrame([("k", '{"id": "x", "name": "n"}')], "key string, value string"), batch_id=f"bad {number}")
        ingest.run(topic.read_stream(spark), ingest.Ingestion(ingestion.root), profile=PROFILE)
        found = ingestion.statistics(spark)
        row = found.first()
        assert (row.total_records, row.valid_records, row.invalid_records) == (11 * (number + 1), 10 * (number + 1), number + 1)
        assert row.success_rate == pytest.approx(100 * 10 / 11)
        assert "totals" in found.inputFiles()[0] and "validated" not in str(found.inputFiles())
    assert len(ingestion._batches(spark)) <= 2  # older rows are gone


def test_a_file_topic_writes_a_batch_once(spark, tmp_path):
    topic = FileTopic(str(tmp_path / "files"))
    for _ in range(2):
        topic.write(messages(spark, 0, 10), batch_id="a/b")
    topic.write(messages(spark, 10, 12))
    assert ids(topic.read(spark)) == list(range(12))
    ingestion = ingest.run(topic.read_stream(spark), ingest.Ingestion.fresh(spark), profile=PROFILE)
    assert ingestion.validated(spark).count() == 12


def test_a_run_is_in_the_history_once(spark, tmp_path):
    stats = spark.createDataFrame([(10, 9, 1, 90.0)], "total_records long, valid_records long, invalid_records long, success_rate double")
    path = str(tmp_path / "history")
    assert [append_run(stats, path, run_id="monday") for _ in range(3)] == [1, 0, 0]
    assert append_run(stats.withColumn("total_records", F.lit(99)), path, run_id="monday") == 0
    assert append_run(stats, path) == append_run(stats, path) == 1
    rows = run_history(spark, path).collect()
    assert len(rows) == 3 and [r.total_records for r in rows if r.run_id == "monday"] == [10]
    with pytest.raises(ValueError):
        append_run(stats.union(stats), path, run_id="twice")

    added = []
    threads = [threading.Thread(target=lambda n=n: added.append(create_once(spark, f"{path}/x.json", f'{{"run_id": "{n}"}}'))) for n in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(added) == [False] * 7 + [True] and run_history(spark, path).count() == 4
