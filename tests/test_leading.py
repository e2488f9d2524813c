"""Leading values by bounded summaries against plain counts."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugewell.operators.leading import Summary, distinct_estimate, leading_values


def plain(values, top):
    return [(i + 1, v, n) for i, (v, n) in enumerate(sorted(Counter(values).items(), key=lambda x: (-x[1], x[0]))[:top])]


def found(leading, field):
    return sorted((r.position, r.value, r.frequency) for r in leading.frame.collect() if r.field == field)


@pytest.mark.parametrize("capacity", [4, 40, 4096])
def test_leading_values_are_exact(spark, capacity):
    draw = random.Random(capacity)
    skewed = [f"w{min(int(draw.paretovariate(0.8)), 10 ** 6)}" for _ in range(6000)]
    unique = [f"u{i}" for i in range(6000)]
    few = [draw.choice(["a", "b", None]) for _ in range(6000)]
    frame = spark.createDataFrame(list(zip(skewed, unique, few, [None] * 6000)), "skewed string, `all different` string, few string, none string").repartition(5)
    leading = leading_values(frame, top=8, capacity=capacity)
    assert found(leading, "skewed") == plain(skewed, 8)
    assert found(leading, "all different") == plain(unique, 8)  # all tie: only counting all of them can tell
    assert found(leading, "few") == plain([v for v in few if v], 8)
    assert found(leading, "none") == [] and "none" not in leading.bounds
    if capacity < 6000 // 5:
        assert "all different" in leading.recounted
    if capacity == 40:
        assert leading.recounted == ["all different"]


def test_a_clear_lead_is_found_without_counting_all(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("hot"), (F.col("id") % 7).cast("string"))).otherwise(F.col("id").cast("string")).alias("v"))
    leading = leading_values(rows.repartition(6), top=7, capacity=200)
    assert not leading.recounted and leading.candidates <= 6 * 200 and leading.bounds["v"] < 2000
    assert {r.value for r in leading.frame.collect()} == {f"hot{i}" for i in range(7)}


def test_a_field_that_bounds_cannot_decide_is_counted_once(spark):
    values = [f"u{i}" for i in range(3000)] + ["u7", "u9", "u9"]
    frame = spark.createDataFrame([(v, "a") for v in values], "wide string, narrow string").repartition(5)
    leading = leading_values(frame, top=4, capacity=50)
    assert leading.recounted == ["wide"] and leading.candidates == 1  # no candidate of the wide field is joined with all values
    assert found(leading, "wide") == plain(values, 4) and found(leading, "narrow") == [(1, "a", 3003)]


def test_a_summary_bounds_what_it_dropped():
    draw = random.Random(4)
    values = [str(min(int(draw.paretovariate(0.5)), 5000)) for _ in range(20_000)]
    summary = Summary(50)
    for at in range(0, len(values), 700):
        summary.add(pa.array(values[at:at + 700]))
    kept = dict(zip(*summary.rows()))
    for value, n in Counter(values).items():
        assert kept.get(value, 0) <= n <= kept.get(value, 0) + summary.bound


def test_distinct_counts_are_estimated_within_the_stated_error(spark):
    rows = spark.range(100_000).select(F.col("id").alias("all"), (F.col("id") % 997).alias("some"), F.lit(None).cast("string").alias("none"))
    estimate = {r.field: r.distinct for r in distinct_estimate(rows.repartition(4)).collect()}
    error = 1.04 / 2 ** 7
    assert abs(estimate["all"] - 100_000) <= 3 * error * 100_000 and abs(estimate["some"] - 997) <= 3 * error * 997 and estimate["none"] == 0
