"""Known results of small inputs that the tests write themselves."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from gaugewell.operators.clean import to_records
from gaugewell.operators.contract import route_orders, write_routed
from gaugewell.operators.customer import customer_records
from gaugewell.operators.profile import learn_profile
from gaugewell.operators.report import error_pattern_counts, run_statistics, validation_details
from gaugewell.operators.validate import validate
from gaugewell.plans.flows import topic_to_analysis, validate_file
from gaugewell.session import scratch_path
from gaugewell.sources.files import load, read_csv
from gaugewell.sources.topics import FileTopic
from small_inputs import orders as order_rows


@pytest.fixture(scope="module")
def employees(spark, inputs):
    return to_records(read_csv(spark, inputs("employees")))


@pytest.fixture(scope="module")
def employee_profile(employees):
    return learn_profile(employees)


def types_of(profile):
    return {p.field: p.detected_type for p in profile}


def details(validated):
    return [
        (r.quality_score, r.errors, r.warnings) for r in validation_details(validated).collect()
    ]


def errors_per_field(validated):
    return {
        r.pattern.split("'")[1]: r.errors for r in error_pattern_counts(validated).collect()
    }


def test_customers_all_excellent(spark, inputs, tmp_path):
    out = str(tmp_path / "out")
    before = set(glob.glob(scratch_path(spark, "validated").rsplit("/", 1)[0] + "/validated-*"))
    results = validate_file(spark, inputs("customers"), out)
    assert results["total_records"] == results["valid_records"] == 30
    assert results["high_quality_records"] == 30 and results["low_quality_records"] == 0
    assert results["success_rate"] == "100.00%"
    good = spark.read.option("header", True).csv(results["written"]["good_data"])
    assert good.count() == 30 and good.columns[-1] == "_source_file"
    report = json.loads(spark.read.text(results["report_path"]).first().value)
    assert report["summary"]["success_rate"] == "100.00%"
    assert report["quality_distribution"]["excellent"] == 30
    assert report["validation_errors"] == []
    schema = json.loads(report["schema_summary"])
    assert schema["field_types"] == {"boolean": 1, "string": 9}
    # the flow leaves no copy of its rows behind
    assert set(glob.glob(scratch_path(spark, "validated").rsplit("/", 1)[0] + "/validated-*")) == before


def test_customers_from_json_agree_with_csv(spark, inputs):
    from_csv = to_records(load(spark, inputs("customers")))
    from_json = to_records(load(spark, inputs("customers_json")))
    assert set(from_csv.columns) == set(from_json.columns)
    texts = from_csv.select(*[F.initcap(F.col(c).cast("string")).alias(c) for c in from_csv.columns])
    others = from_json.select(*[F.initcap(c).alias(c) for c in from_csv.columns])
    assert texts.exceptAll(others).isEmpty()
    assert types_of(learn_profile(from_json))["MetroArea"] == "boolean"


def test_orders_are_routed_three_ways(spark, inputs, tmp_path):
    orders = read_csv(spark, inputs("orders"))
    routed = route_orders(orders)
    written = write_routed(routed, str(tmp_path / "routed"))
    for status, ids in order_rows()[1].items():
        assert {r.OrderID for r in load(spark, written[status]).collect()} == ids


def test_employees(employees, employee_profile):
    kinds = types_of(employee_profile)
    assert kinds["EmployeeID"] == "currency"
    assert kinds["BirthDate"] == kinds["HireDate"] == "date"
    validated = validate(employees, employee_profile)
    stats = run_statistics(validated).first()
    assert (stats.total_records, stats.valid_records) == (9, 8)
    assert round(stats.success_rate, 2) == 88.89
    assert errors_per_field(validated) == {"BirthDate": 1}
    assert [r[1] for r in details(validated)] == [0, 0, 0, 1, 0, 0, 0, 0, 0]


def test_customers_under_employee_schema(spark, inputs, employee_profile):
    customers = to_records(load(spark, inputs("customers")))
    validated = validate(customers, employee_profile)
    assert run_statistics(validated).first().valid_records == 0
    counts = errors_per_field(validated)
    missing = {p.field for p in employee_profile if not p.nullable} - {"City"}
    assert missing <= set(counts) and all(counts[f] == 30 for f in missing)
    unexpected = len(customers.columns) - 1
    assert all(r[2] >= unexpected for r in details(validated))


def test_customer_model_without_renaming_rejects_all(spark, inputs):
    customers = to_records(load(spark, inputs("customers")))
    # no column has a model name, so nine required fields are missing in each row
    bare = customer_records(customers.toDF(*[f"x_{c}" for c in customers.columns]), rename=False)
    assert bare.where("_is_valid").isEmpty()
    assert bare.select(F.size("_errors").alias("n")).distinct().first().n == 9
    renamed = customer_records(customers)
    assert renamed.where("_is_valid").count() == 30
    assert renamed.agg(F.max("_quality_score")).first()[0] == 1.0  # no segment here is a listed one


def test_five_people(spark, inputs):
    people = to_records(load(spark, inputs("people")))
    profile = learn_profile(people)
    assert types_of(profile) == {
        "name": "string", "age": "phone", "email": "email", "city": "string",
    }
    stats = run_statistics(validate(people, profile)).first()
    assert stats.excellent_quality == stats.valid_records == 5


def test_empty_topic(spark, tmp_path):
    topic = FileTopic(scratch_path(spark, "empty-topic"))
    topic.write(spark.createDataFrame([], "key string, value string"))
    results = topic_to_analysis(spark, topic, str(tmp_path / "out"))
    assert results["processing_summary"]["total_records"] == 0
    assert results["processing_summary"]["success_rate"] == "0.00%"
    assert results["written"] == {}
    report = json.loads(spark.read.text(results["report_path"]).first().value)
    assert report["data_quality_insights"] == ["No data processed yet"]
    assert report["schema_summary"] is None
    assert not glob.glob(str(tmp_path / "out" / "good_data*"))
