"""Validation, splits and reports."""

from pyspark.sql import functions as F

from gaugewell.operators.profile import TableProfile, learn_profile
from gaugewell.operators.report import (
    error_patterns,
    quality_distribution,
    reporter_insights,
    run_statistics,
    validator_insights,
)
from gaugewell.operators.validate import (
    data_columns,
    split_by_quality,
    validate,
    with_position,
)
from gaugewell.plans.views import declared, declared_profile


def insights(frame):
    return [r.insight for r in frame.orderBy("position").collect()]


def test_scores_multiply_and_issues_stack(spark):
    profile = declared_profile([declared("mail", "email", min_length=5, max_length=8)])
    rows = [("a@b.co",), ("bad",), ("much too long",), ("",), (None,)]
    judged = validate(spark.createDataFrame(rows, "mail string"), profile).collect()
    scores = [round(r._quality_score, 4) for r in judged]
    assert scores == [1.0, round(0.5 * 0.7 * 0.6, 4), round(0.5 * 0.8 * 0.6, 4), 0.0, 0.0]
    assert judged[1]._errors == [
        "Field 'mail': Invalid email format",
        "Field 'mail': Value too short (min: 5)",
        "Field 'mail': Value doesn't match expected pattern",
    ]
    assert [i.issue for i in judged[2]._issues] == [
        "invalid_format", "length_violation", "inconsistent_pattern",
    ]
    assert judged[4]._errors == ["Field 'mail': Field cannot be null"]


def test_raw_values_are_judged_by_their_storage(spark):
    profile = declared_profile([declared("n", "integer"), declared("x", "float")])
    frame = spark.createDataFrame([(25.9, 25), (float("inf"), 3)], "n double, x bigint")
    judged = validate(frame, profile).collect()
    # 25.9 truncates to an integer; a whole number has no point, so it is no float
    assert judged[0]._errors == ["Field 'x': Invalid float format"]
    assert judged[1]._errors == ["Field 'n': Invalid integer format", "Field 'x': Invalid float format"]


def test_missing_unexpected_and_category_warnings(spark):
    profile = declared_profile([
        declared("tier", "categorical", allowed_values=["a"]),
        declared("note", "string", nullable=True), declared("code", "string"),
    ])
    row = validate(spark.createDataFrame([("b", 1)], "tier string, extra int"), profile,
                   review_warnings=True).first()
    assert row._warnings == [
        "Field 'tier' has unexpected category: b", "Optional field 'note' is missing",
        "Unexpected field 'extra' found", "Data quality score is 0.57 - consider reviewing",
        "Poor data quality detected - manual review recommended",
    ]
    assert row._errors == ["Field 'code': Required field is missing"]


def test_own_source_file_column_is_replaced(spark):
    frame = spark.createDataFrame([("x", "old")], "v string, _source_file string")
    judged = validate(frame, learn_profile(frame), source_file="new")
    assert judged.columns.count("_source_file") == 1
    assert judged.first()._source_file == "new"
    assert data_columns(judged) == ["v"]


def test_wide_table(spark):
    width = 250
    frame = spark.range(50).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(width)])
    judged = validate(frame, learn_profile(frame))
    stats = run_statistics(judged).first()
    assert stats.total_records == stats.valid_records == 50


def test_splits_cover_all_rows_once(spark, table):
    orders = table("orders")
    judged = validate(orders, declared_profile([
        declared("o_totalprice", "currency"), declared("o_orderstatus", "categorical", allowed_values=["F"]),
        declared("o_comment", "string", nullable=True),
    ]), record_id="o_orderkey")
    high, low = split_by_quality(judged, 0.95)
    assert high.count() + low.count() == orders.count()
    assert high.join(low, "o_orderkey", "left_semi").isEmpty()


def test_empty_profile_and_empty_table(spark):
    frame = spark.createDataFrame([("a",)], "v string")
    row = validate(frame, TableProfile([])).first()
    assert (row._quality_score, row._is_valid) == (0.0, False)
    judged = validate(frame.limit(0), learn_profile(frame))
    assert run_statistics(judged).first().success_rate == 0.0
    assert quality_distribution(judged).isEmpty() and error_patterns(judged).isEmpty()
    assert insights(validator_insights(judged)) == ["No data processed yet"]
    assert insights(reporter_insights(judged)) == ["No data to analyze"]


def test_verdict_filter_does_not_copy_the_tests(spark, table):
    customers = table("customer")
    profile = declared_profile([declared("c_name", "email"), declared("c_mktsegment", "url")])
    judged = validate(customers, profile).where(~F.col("_is_valid")).select("_errors")
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[a-zA-Z0-9._%+-]+@") == 1


def test_positions_are_dense(spark):
    frame = spark.range(0, 1000, 1, 7)
    found = with_position(frame).orderBy("id").select("_position").collect()
    assert [r._position for r in found] == list(range(1000))
