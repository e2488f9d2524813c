"""Statistics, distributions, error patterns, insights and trends of validated rows."""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.functions.quality import QUALITY_LEVELS, percent_text
from gaugewell.operators.profile import TableProfile, schema_summary
from gaugewell.operators.validate import HIGH_QUALITY_SCORE, bad_rows, data_columns
from gaugewell.session import create_once

TOP_PATTERNS = 10
DETAIL_ROWS = 10
REPORTED_ERRORS = 50

# Insight texts, with the lowest success rate of each band.
VALIDATOR_BANDS = [
    (95, "Excellent data quality - very high success rate with intelligent validation"),
    (80, "Good data quality - acceptable success rate"),
    (60, "Fair data quality - consider data source review"),
    (0, "Poor data quality - immediate attention required"),
]
REPORTER_BANDS = [
    (95, "Excellent data quality with very high success rate"),
    (85, "Good data quality with acceptable success rate"),
    (70, "Fair data quality - consider data source review"),
    (0, "Poor data quality - immediate attention required"),
]
FIELDS_DETECTED = "Automatically detected {} fields with {} different data types"
COMMON_TYPE = "Most common data type: {} ({} fields)"
MOSTLY_EXCELLENT = "Majority of valid records have excellent quality scores"
VALIDATOR_MANY_POOR = "High percentage of poor quality records among valid data"
REPORTER_MANY_POOR = "High percentage of poor quality records - review data collection processes"
STRONG_QUALITY = "Strong overall data quality suitable for production use"
HIGH_THROUGHPUT = "High processing throughput achieved"
LOW_THROUGHPUT = "Low processing throughput - consider optimization"
WORST_FIELD = "Most problematic field: '%s' with %d validation issues"
COMMON_ERROR = "Most common validation issue: %s"
CONCENTRATED = "Over 50%% of errors are related to %s - focus on fixing this issue"
VALIDATOR_NOTHING = "No data processed yet"
REPORTER_NOTHING = "No data to analyze"
EXCELLENT_SHARE, POOR_SHARE, STRONG_SHARE = 80, 30, 90
FAST_RECORDS_PER_SECOND, SLOW_RECORDS_PER_SECOND = 1000, 100


def statistics_columns(threshold: float | None = None, counts: Column | None = None) -> list[Column]:
    """Aggregates of a run, for ``agg`` or for ``observe``; levels count valid rows only.

    ``counts`` says which rows stand for a record, if not all do.
    """
    valid, counts = F.col("_is_valid"), F.lit(True) if counts is None else counts
    tests = {"total_records": counts, "valid_records": counts & valid, "invalid_records": counts & ~valid}
    tests |= {f"{level}_quality": counts & valid & (F.col("_quality_level") == level) for level in QUALITY_LEVELS}
    if threshold is not None:
        high = valid & (F.col("_quality_score") >= threshold)
        tests |= {"high_quality_count": counts & high, "low_quality_count": counts & ~high}
    return [F.count_if(test).alias(name) for name, test in tests.items()]


def success_rate(valid: Column, total: Column) -> Column:
    """Percentage of valid records; 0 for none at all."""
    return F.when(total == 0, 0.0).otherwise(valid / total * 100)


def run_statistics(validated: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row of counters and the success rate."""
    return validated.agg(*statistics_columns(threshold)).withColumn(
        "success_rate", success_rate(F.col("valid_records"), F.col("total_records"))
    )


def level_counts(validated: DataFrame) -> DataFrame:
    """Rows per quality level over all rows, invalid ones too."""
    level = F.col("_quality_level")
    counts = validated.agg(*[F.count_if(level == n).alias(n) for n in QUALITY_LEVELS])
    return counts.unpivot([], QUALITY_LEVELS, "quality_level", "records")


def quality_distribution(validated: DataFrame) -> DataFrame:
    """Count and share of each level among the valid rows; empty if none is valid."""
    stats = validated.agg(*statistics_columns())
    total = F.col("valid_records")
    return (
        stats.unpivot(
            ["valid_records"], [f"{n}_quality" for n in QUALITY_LEVELS], "level", "records"
        )
        .where(total > 0)
        .select(
            F.replace("level", F.lit("_quality"), F.lit("")).alias("quality_level"),
            "records",
            (F.col("records") / total * 100).alias("percentage"),
        )
    )


def error_pattern_counts(validated: DataFrame) -> DataFrame:
    """Errors of invalid rows counted by the text before the colon."""
    error = F.explode("_errors").alias("error")
    pattern = F.when(F.col("error").contains(":"), F.split_part("error", F.lit(":"), F.lit(1)))
    return (
        bad_rows(validated)
        .select(error)
        .groupBy(pattern.alias("pattern"))
        .agg(F.count(F.lit(1)).alias("errors"))
        .na.fill("general", ["pattern"])
    )


def error_patterns(validated: DataFrame, top: int = TOP_PATTERNS) -> DataFrame:
    """The most frequent error patterns."""
    return (
        error_pattern_counts(validated)
        .orderBy(F.col("errors").desc(), F.col("pattern").asc())
        .limit(top)
    )


def problem_fields(validated: DataFrame) -> DataFrame:
    """Number of errors per field over the invalid rows."""
    return (
        bad_rows(validated)
        .select(F.explode("_issues").alias("issue"))
        .groupBy(F.col("issue.field").alias("field"))
        .agg(F.count(F.lit(1)).alias("errors"))
    )


def most_problematic_field(validated: DataFrame) -> DataFrame:
    """The field with most errors; no row if there is no error."""
    return problem_fields(validated).orderBy(F.col("errors").desc(), F.col("field").asc()).limit(1)


def validation_details(validated: DataFrame, rows: int = DETAIL_ROWS) -> DataFrame:
    """Status, score and error counts of the first rows."""
    return (
        validated.orderBy("_record_id")
        .limit(rows)
        .select(
            "_record_id",
            F.when(F.col("_is_valid"), "Valid").otherwise("Invalid").alias("status"),
            F.round("_quality_score", 2).alias("quality_score"),
            F.size("_errors").alias("errors"),
            F.size("_warnings").alias("warnings"),
        )
    )


def first_errors(validated: DataFrame, rows: int = REPORTED_ERRORS) -> DataFrame:
    """The first invalid rows with everything known about them."""
    record = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in data_columns(validated)])
    return (
        bad_rows(validated)
        .orderBy("_record_id")
        .limit(rows)
        .select(
            "_record_id",
            record.alias("original_data"),
            F.col("_errors").alias("errors"),
            F.col("_warnings").alias("warnings"),
            F.col("_quality_score").alias("quality_score"),
            F.col("_field_scores").alias("field_scores"),
            F.date_format("_processed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        )
    )


def summary_metrics(stats: DataFrame, duration_seconds: float | None) -> DataFrame:
    """Executive summary: totals, rate, speed and class of the run."""
    rate = F.col("success_rate")
    seconds = F.lit(duration_seconds).cast("double")
    return stats.select(
        "total_records",
        "valid_records",
        "invalid_records",
        rate,
        F.when(rate >= 90, "success").when(rate >= 70, "warning").otherwise("error").alias(
            "success_class"
        ),
        seconds.alias("processing_duration"),
        F.when(seconds > 0, F.col("total_records") / seconds).otherwise(0.0).alias(
            "records_per_second"
        ),
    )


# ------------------------------------------------------------------ insights


def statistics_and_worst(validated: DataFrame, items: Column, threshold: float | None = None) -> DataFrame:
    """One row: the statistics, and ``worst``, the most frequent of the texts in ``items`` over
    the invalid rows with its ``errors``. One pass: the items of a row are rows of their own,
    of which the first counts for the record."""
    rows = validated.select(
        "_is_valid", "_quality_level", "_quality_score",
        F.posexplode_outer(F.when(~F.col("_is_valid"), items)).alias("_at", "_item"),
    )
    counters = statistics_columns(threshold, F.coalesce("_at", F.lit(0)) == 0)
    counted = rows.groupBy("_item").agg(F.count("_item").alias("_errors"), *counters)
    names = [c for c in counted.columns if c not in ("_item", "_errors")]
    first = F.min(F.when(F.col("_errors") > 0, F.struct((-F.col("_errors")).alias("n"), F.col("_item").alias("item"))))
    total = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names], first.alias("first"))
    return total.select(
        *names, success_rate(F.col("valid_records"), F.col("total_records")).alias("success_rate"),
        F.when(F.col("first").isNotNull(), F.struct(F.col("first.item").alias("item"), (-F.col("first.n")).alias("errors"))).alias("worst"),
    )


def _listed(insights: list[Column], nothing: str) -> Column:
    """The insights that apply."""
    return F.when(F.col("total_records") == 0, F.array(F.lit(nothing))).otherwise(F.array_compact(F.array(*insights)))


def _numbered(stats: DataFrame, listed: Column) -> DataFrame:
    """One row per insight, numbered from 1."""
    return stats.select(F.posexplode(listed).alias("position", "insight")).select(
        (F.col("position") + 1).alias("position"), "insight"
    )


def _band(bands: list[tuple[float, str]]) -> Column:
    rate = F.col("success_rate")
    return F.coalesce(*[F.when(rate >= lowest, text) for lowest, text in bands])


def _share(level: str) -> Column:
    valid = F.col("valid_records")
    return F.when(valid > 0, F.col(f"{level}_quality") / valid * 100)


def _level_insight(many_poor: str) -> Column:
    return F.when(_share("excellent") >= EXCELLENT_SHARE, MOSTLY_EXCELLENT).when(
        _share("poor") >= POOR_SHARE, many_poor
    )


def _worst_field(validated: DataFrame) -> DataFrame:
    return statistics_and_worst(validated, F.transform("_issues", lambda i: i["field"]))


def _validator_list(profile: TableProfile | None) -> Column:
    """The validator's insights over a row of statistics and the worst field."""
    insights: list[Column] = []
    if profile is not None:
        kinds = Counter(p.detected_type for p in profile)
        insights.append(F.lit(FIELDS_DETECTED.format(len(profile), len(kinds))))
        insights += [F.lit(COMMON_TYPE.format(*top)) for top in kinds.most_common(1)]
    worst = F.when(F.col("worst").isNotNull(), F.format_string(WORST_FIELD, "worst.item", "worst.errors"))
    return _listed([*insights, _band(VALIDATOR_BANDS), _level_insight(VALIDATOR_MANY_POOR), worst], VALIDATOR_NOTHING)


def validator_insights(validated: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """What the validator says about the run."""
    return _numbered(_worst_field(validated), _validator_list(profile))


def reporter_insights(validated: DataFrame, duration_seconds: float | None = None) -> DataFrame:
    """What the report says about the run."""
    insights = [
        _band(REPORTER_BANDS),
        _level_insight(REPORTER_MANY_POOR),
        F.when(_share("excellent") + _share("good") >= STRONG_SHARE, STRONG_QUALITY),
    ]
    if duration_seconds:
        speed = F.col("total_records") / F.lit(duration_seconds)
        insights.append(
            F.when(speed >= FAST_RECORDS_PER_SECOND, HIGH_THROUGHPUT).when(
                speed < SLOW_RECORDS_PER_SECOND, LOW_THROUGHPUT
            )
        )
    worst = F.col("worst")
    insights += [
        F.when(worst.isNotNull(), F.format_string(COMMON_ERROR, worst["item"])),
        F.when(worst["errors"] / F.col("invalid_records") > 0.5, F.format_string(CONCENTRATED, worst["item"])),
    ]
    patterns = F.transform("_errors", lambda e: F.when(e.contains(":"), F.split_part(e, F.lit(":"), F.lit(1))).otherwise("general"))
    return _numbered(statistics_and_worst(validated, patterns), _listed(insights, REPORTER_NOTHING))


# ------------------------------------------------------------------ reports


def validation_report(
    validated: DataFrame,
    profile: TableProfile | None = None,
    duration_seconds: float | None = None,
) -> DataFrame:
    """One row: summary, level counts, schema summary, first errors, insights.

    Two passes: one for all counts, one for the first errors.
    """
    spark = validated.sparkSession
    errors = first_errors(validated)
    details = [c for c in errors.columns if c != "_record_id"]
    # at most REPORTED_ERRORS items
    listed = errors.agg(
        F.transform(
            F.sort_array(
                F.collect_list(F.struct("_record_id", F.to_json(F.struct(*details)).alias("json")))
            ),
            lambda e: e["json"],
        ).alias("e")
    )
    schema = F.lit(None).cast("string")
    if profile is not None:
        summary = schema_summary(profile.to_frame(spark))
        schema = summary.select(F.to_json(F.struct(*summary.columns))).scalar()
    return _worst_field(validated).select(
        F.struct(
            "total_records", "valid_records", "invalid_records",
            percent_text(F.col("success_rate")).alias("success_rate"),
            F.lit(duration_seconds).cast("double").alias("processing_duration"),
            F.lit(profile is not None).alias("schema_learned"),
        ).alias("summary"),
        F.struct(*[F.col(f"{n}_quality").alias(n) for n in QUALITY_LEVELS]).alias(
            "quality_distribution"
        ),
        schema.alias("schema_summary"),
        listed.scalar().alias("validation_errors"),
        _validator_list(profile).alias("data_quality_insights"),
    )


def processing_summary(
    validated: DataFrame,
    threshold: float = HIGH_QUALITY_SCORE,
    duration_seconds: float | None = None,
) -> DataFrame:
    """One row: processing summary, quality metrics, data splits."""
    stats = run_statistics(validated, threshold)
    seconds = F.lit(duration_seconds).cast("double")
    return stats.select(
        F.struct(
            "total_records", "valid_records", "invalid_records",
            percent_text(F.col("success_rate")).alias("success_rate"),
            F.coalesce(F.format_string("%.2fs", seconds), F.lit("N/A")).alias(
                "processing_duration"
            ),
            F.when(seconds > 0, F.col("total_records") / seconds).otherwise(0.0).alias(
                "records_per_second"
            ),
        ).alias("processing_summary"),
        F.struct(
            *[f"{n}_quality" for n in QUALITY_LEVELS], "high_quality_count", "low_quality_count"
        ).alias("quality_metrics"),
        F.struct(
            F.col("valid_records").alias("good_data_count"),
            F.col("invalid_records").alias("bad_data_count"),
            F.lit(threshold).alias("quality_threshold"),
        ).alias("data_splits"),
    )


# ------------------------------------------------------------------ trend


HISTORY_SCHEMA = "run_id string, processing_start_time timestamp, total_records bigint, valid_records bigint, invalid_records bigint, success_rate double"


def append_run(stats: DataFrame, history_path: str, started_at: Column | None = None, run_id: str | Column | None = None) -> int:
    """Add the statistics of a run, or of some, to the history, once for each run id; the number of runs added.

    A run is a row and a file of its own, which comes into being whole or not at all. Whoever adds a run
    again, after a failure or at the same time, finds it there and adds nothing. Without an id every call adds new runs.
    """
    spark = stats.sparkSession
    started = started_at if started_at is not None else F.current_timestamp()
    given = F.uuid() if run_id is None else F.lit(run_id) if isinstance(run_id, str) else run_id.cast("string")
    rows = stats.select(
        given.alias("run_id"), started.cast("timestamp").alias("processing_start_time"), "total_records", "valid_records",
        "invalid_records", "success_rate")
    text = F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    found = rows.select("run_id", text.alias("text")).collect()  # a row for each run
    if len({r["run_id"] for r in found}) < len(found):
        raise ValueError("each run needs an id of its own")
    names = [hashlib.sha256(r["run_id"].encode()).hexdigest() for r in found]
    return sum(create_once(spark, f"{history_path.rstrip('/')}/{name}.json", r["text"]) for name, r in zip(names, found))


def run_history(spark: SparkSession, history_path: str) -> DataFrame:
    """The runs that were added."""
    return spark.read.schema(HISTORY_SCHEMA).json(history_path)


def quality_trend(history: DataFrame) -> DataFrame:
    """Success rate and size of the runs over time."""
    return history.select("processing_start_time", "success_rate", "total_records").orderBy(
        "processing_start_time"
    )
