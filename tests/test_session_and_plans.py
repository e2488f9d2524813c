"""Scratch folders, and the shape of plans that must not grow back."""

import os
import subprocess
import sys
import time
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gaugewell.operators.profile import learn_profile, profile_frame
from gaugewell.operators.report import validation_report
from gaugewell.operators.validate import validate
from gaugewell.plans import queries as Q
from gaugewell.session import scratch_path
from gaugewell.streaming.payload import validate_payloads


def test_a_cluster_must_name_its_shared_folder():
    conf = SimpleNamespace(get=lambda name, default=None: None, set=lambda name, value: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch_path(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)), "x")


def test_a_report_scans_twice_at_most(spark, table):
    people = table("orders")
    profile = learn_profile(people)
    plan = validation_report(validate(people, profile), profile)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2


def test_payload_fields_are_read_once(spark):
    plan = validate_payloads(Q._event_messages(spark, "/root/testdata/sf0.001"), Q._EVENT_PROFILE)
    fields = len(Q._EVENT_PROFILE.fields)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("variant_get") <= 3 * fields


def test_validation_of_many_columns_is_built_in_seconds(spark):
    wide = spark.range(50).select(*[(F.col("id") % (i + 3)).cast("string").alias(f"c{i}") for i in range(60)])
    profile = learn_profile(wide)
    started = time.time()
    validate(wide, profile).schema
    assert time.time() - started < 20


def test_samples_and_ties_do_not_depend_on_length(spark):
    rows = [(f"{i:02d}" * (10 if i % 2 else 400), f"v{i % 12}") for i in range(30) for _ in range(400 // 30 + 20)]
    found = {r.field: r for r in profile_frame(spark.createDataFrame(rows, "long string, few string")).collect()}
    texts = sorted({r[0] for r in rows})
    assert found["long"].categories == texts[:20]
    assert len(found["few"].sample_values) == 10


BARE = """
import sys
sys.path.insert(0, {root!r})
from gaugewell.plans.flows import validate_file
from gaugewell.session import local_session, scratch_path, scratch_root
from gaugewell.sources.topics import FileTopic
from gaugewell.streaming import ingest
from gaugewell.streaming.payload import encode

spark = local_session("2")
assert spark.conf.get("spark.checkpoint.dir", None) is None
open({file!r}, "w").write("id,name\\n" + "".join(f"{{i}},n{{i}}\\n" for i in range(40)))
found = validate_file(spark, {file!r}, {out!r})
assert found["total_records"] == 40, found
topic = FileTopic(scratch_path(spark, "topic"))
topic.write(encode(spark.range(10).selectExpr("id", "'n' as name")))
assert ingest.run(topic.read_stream(spark), ingest.Ingestion.fresh(spark)).statistics(spark).first().total_records == 10
assert scratch_root(spark) == scratch_root(spark)
print("done")
"""


def test_a_plain_local_session_needs_no_settings(tmp_path):
    """Without spark.checkpoint.dir, and without the settings that this machine may have."""
    code = BARE.format(root=str(Path(__file__).resolve().parents[1]), file=str(tmp_path / "t.csv"), out=str(tmp_path / "out"))
    (tmp_path / "conf").mkdir()
    ran = subprocess.run([sys.executable, "-c", code], env={**os.environ, "SPARK_CONF_DIR": str(tmp_path / "conf")}, cwd=tmp_path,
                         capture_output=True, text=True, timeout=300)
    assert ran.stdout.strip().endswith("done"), ran.stderr[-3000:]
