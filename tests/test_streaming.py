"""Micro-batch ingestion over file topics with several batches."""

import pytest
from pyspark.sql import functions as F

from gaugewell.operators.profile import TableProfile, learn_profile
from gaugewell.plans.flows import file_to_topic, file_to_topic_to_analysis, send_from_file
from gaugewell.plans.views import declared, declared_profile
from gaugewell.session import scratch_path
from gaugewell.sources.topics import FileTopic
from gaugewell.streaming import ingest
from gaugewell.streaming.payload import encode, validate_payloads


@pytest.fixture
def topic(spark):
    """Three files of ten numbered records; the last has texts for numbers."""
    topic = FileTopic(scratch_path(spark, "topic"), max_files_per_batch=1)
    for start in (0, 10):
        topic.write(encode(spark.range(start, start + 10).selectExpr("id", "concat('n', id) AS name").coalesce(1)))
    bad = spark.range(20, 30).selectExpr("concat('x', id) AS id", "concat('n', id) AS name")
    topic.write(encode(bad.coalesce(1)))
    return topic


def counts(rows):
    batch = F.regexp_extract("_metadata.file_path", r"/batch-(\d+)/", 1).cast("int").alias("batch")
    return {(r.batch, r._is_valid): r["count"] for r in rows.groupBy(batch, "_is_valid").count().collect()}


def test_learned_once_and_frozen(spark, topic):
    run = ingest.run(topic.read_stream(spark), ingest.Ingestion.fresh(spark))
    rows = run.validated(spark)
    assert rows.count() == 30
    assert run.profile(spark).fields == ["id", "name"]
    assert run.profile(spark)["id"].total_values == 10
    assert counts(rows)[(2, False)] == 10
    assert run.statistics(spark).first().invalid_records == 10


def test_cap_is_exact_across_batches(spark, topic):
    run = ingest.run(topic.read_stream(spark), ingest.Ingestion.fresh(spark), max_records=13)
    assert run.validated(spark).count() == 13


def test_resumes_without_duplicates(spark, topic):
    ingestion = ingest.Ingestion.fresh(spark)
    ingest.run(topic.read_stream(spark), ingestion)
    topic.write(encode(spark.range(30, 35).selectExpr("id", "'n' AS name").coalesce(1)))
    ingest.run(topic.read_stream(spark), ingestion)
    assert ingestion.validated(spark).count() == 35


def test_failing_batch_may_be_skipped(spark, topic):
    class Broken(TableProfile):
        def save(self, *args):
            raise RuntimeError("no room")

    broken = Broken([])
    ingestion = ingest.Ingestion.fresh(spark)
    ingest.run(topic.read_stream(spark), ingestion, profile=broken, skip_failed_batches=True)
    assert ingestion.validated(spark) is None


def test_absent_null_and_typed_payload_values(spark):
    profile = declared_profile([
        declared("a", "integer", min_value=0.0, max_value=10.0),
        declared("b", "string", nullable=True), declared("c", "boolean"),
    ])
    texts = ['{"a": 1, "b": null, "c": true}', '{"a": 25.9, "c": 1}', '{"b": "x", "c": "no", "zzz": 2}',
             '{"a": "7", "b": "", "c": 1.0}']
    messages = spark.createDataFrame([(t,) for t in texts], "value string")
    found = validate_payloads(messages.coalesce(1), profile).orderBy("_record_id").collect()
    assert [round(r._quality_score, 4) for r in found] == [
        round((1 + 0.9 + 1) / 3, 4), round((0.7 + 0.8 + 1) / 3, 4), round((0 + 1 + 1) / 3, 4),
        round((1 + 0.9 + 0.5) / 3, 4),
    ]
    assert found[0].c == "True" and found[1].a == "25.9"
    assert found[1]._warnings == ["Optional field 'b' is missing"]
    assert found[2]._errors == ["Field 'a': Required field is missing"]
    assert found[2]._warnings == ["Unexpected field 'zzz' found"]


def test_batch_and_payload_verdicts_agree(spark, table):
    orders = table("orders").drop("o_orderdate")
    profile = learn_profile(orders.where("o_orderkey < 500"))
    from gaugewell.operators.validate import validate

    direct = validate(orders, profile).agg(F.sum("_quality_score"), F.count_if("_is_valid")).first()
    through = validate_payloads(encode(orders), profile).agg(F.sum("_quality_score"), F.count_if("_is_valid")).first()
    assert direct[1] == through[1] and direct[0] == pytest.approx(through[0])


def test_flows(spark, inputs, tmp_path):
    path = inputs("customers")
    topic = FileTopic(str(tmp_path / "topic"))
    results = file_to_topic_to_analysis(spark, path, topic, str(tmp_path / "out"))
    assert results["file_to_topic"]["sending"]["sent_records"] == 30
    assert results["topic_to_analysis"]["processing_summary"]["valid_records"] == 30
    raw = FileTopic(str(tmp_path / "raw"))
    assert send_from_file(spark, path, raw, "CustomerID")["sent_records"] == 30
    assert raw.read(spark).where("key = 'KAAAA'").count() == 1
    unchecked = FileTopic(str(tmp_path / "unchecked"))
    assert file_to_topic(spark, path, unchecked, validate_before_send=False)["status"] == "success"
