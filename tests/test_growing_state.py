"""Profiles that grow and keys that are watched over batches."""

import json

import pytest
from pyspark.sql import functions as F

from gaugewell.operators.contract import Contract
from gaugewell.operators.profile import learn_profile
from gaugewell.operators.profile_state import ProfileState
from gaugewell.session import remove_path
from gaugewell.sources.topics import LogTopic
from gaugewell.streaming.keys import STATE_STORE, KeyWatch, key_counts


def facts(profile):
    found = []
    for p in profile:
        values = {**vars(p)}
        values.pop("sample_values")
        found.append({k: round(v, 6) if isinstance(v, float) else v for k, v in values.items() if k != "rules"})
    return found


def whole(profile):
    return {p.field: {k: round(v, 6) if isinstance(v, float) else v for k, v in p.rules.items()} for p in profile}


def test_increments_give_the_profile_of_all_rows(spark, table, tmp_path):
    orders = table("orders").withColumn("note", F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("x" * 300), (F.col("o_orderkey") % 7).cast("string"))))
    state = ProfileState(str(tmp_path / "state"))
    assert len(state.profile(spark)) == 0
    for part in range(4):
        batch = orders.where(F.col("o_orderkey") % 4 == part)
        assert state.add(batch, f"{part}") is True
        assert state.add(orders, f"{part}") is False  # an id that was counted
        if part == 2:
            assert state.compact(spark, most=2) is True and state.compact(spark, most=2) is False
    expected = learn_profile(orders)
    found = state.profile(spark)
    assert facts(found) == facts(expected) and whole(found) == whole(expected)
    assert sorted(state.batches(spark)) == ["0", "1", "2", "3"]
    plan = state.counts(spark)._jdf.queryExecution().executedPlan().toString()
    assert "orders" not in plan


def test_fields_come_and_go(spark, tmp_path):
    state = ProfileState(str(tmp_path / "state"))
    first = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, old string")
    second = spark.createDataFrame([("4", 2.5, None), ("x", None, "z")], "id string, `new field` double, third string")
    state.add(first, "one")
    state.add(first.limit(0), "none")
    state.add(second, "two")
    found = state.profile(spark)
    expected = learn_profile(first.withColumn("id", F.col("id").cast("string")).unionByName(second, allowMissingColumns=True))
    assert found.fields == ["id", "old", "new field", "third"] and facts(found) == facts(expected)


def test_a_batch_that_failed_half_way_does_not_count(spark, tmp_path):
    state = ProfileState(str(tmp_path / "state"))
    frame = spark.range(20).selectExpr("id", "id % 3 as kind")
    state.add(frame, "one")
    state.add(frame, "two")
    manifest = sorted((tmp_path / "state" / "manifests").iterdir())[-1]
    lost = json.loads(manifest.read_text())["batches"][0]
    remove_path(spark, str(manifest))
    assert state.profile(spark)["id"].total_values == 20
    assert state.add(frame, lost) is True
    assert state.profile(spark)["id"].total_values == 40


def test_keys_are_known_over_batches_and_restarts(spark, tmp_path):
    topic = LogTopic(str(tmp_path / "topic"), partitions=3)
    watch, contract = KeyWatch(str(tmp_path / "watch")), Contract(primary_key="key")
    send = lambda keys, name: topic.write(spark.createDataFrame([(k, "v") for k in keys], "key string, value string").repartition(2), batch_id=name)
    assert watch.repeated(spark).count() == 0
    send([f"k{i}" for i in range(20)] + ["hot"] * 500, "one")
    watch.run(topic.read_stream(spark), contract)
    assert [(r.key, r.copies, r.found_in) for r in watch.repeated(spark).collect()] == [("hot", 500, [0])]
    send([f"k{i}" for i in range(15, 30)] + [None, "hot"], "two")
    KeyWatch(watch.root).run(topic.read_stream(spark), contract)
    send(["k0", None, "new"], "three")
    KeyWatch(watch.root).run(topic.read_stream(spark), contract)
    found = {r.key: (r.copies, r.found_in) for r in watch.repeated(spark).collect()}
    assert found == {"hot": (501, [0, 1]), **{f"k{i}": (2, [1]) for i in range(15, 20)}, "k0": (2, [2]), None: (2, [2])}


def test_a_contract_needs_its_key(spark):
    with pytest.raises(AttributeError):
        KeyWatch("/nowhere").run(spark.readStream.format("rate").load(), Contract())


def test_keys_are_counted_without_python_for_each_key(spark, tmp_path):
    topic = LogTopic(str(tmp_path / "topic"), partitions=2)
    topic.write(spark.createDataFrame([("a", "v"), ("a", "w"), ("b", "v")], "key string, value string"), batch_id="one")
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    watch = KeyWatch(str(tmp_path / "watch")).run(topic.read_stream(spark), Contract(primary_key="key"))
    assert [(r.key, r.copies) for r in watch.repeated(spark).collect()] == [("a", 2)]
    assert {name: spark.conf.get(name, None) for name in STATE_STORE} == before
    plan = key_counts(topic.read_stream(spark), Contract(primary_key="key"))._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "InPandas" not in plan and "MapInArrow" not in plan
