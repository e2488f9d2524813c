"""The four end-to-end flows.

Validated rows are written once as columnar files in the shared folder, with the
run's counters observed during that write; splits and reports then scan only the
columns they need.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gaugewell.operators.clean import to_records
from gaugewell.operators.profile import TableProfile, learn_profile
from gaugewell.operators.report import (
    append_run,
    processing_summary,
    run_statistics,
    statistics_columns,
    validation_report,
)
from gaugewell.operators.validate import HIGH_QUALITY_SCORE, data_columns, validate
from gaugewell.session import remove_path, scratch_path
from gaugewell.sources.files import load
from gaugewell.sources.sinks import write_json_row, write_splits
from gaugewell.sources.topics import FileTopic, KafkaTopic
from gaugewell.streaming.ingest import Ingestion, run
from gaugewell.streaming.payload import encode

Topic = KafkaTopic | FileTopic


def _percent(part: int, whole: int) -> str:
    return f"{part / whole * 100:.2f}%" if whole else "0%"


def store_validated(validated: DataFrame, threshold: float) -> tuple[DataFrame, dict, str]:
    """Write validated rows once; the stored table, the counters seen on the way, and its path."""
    spark = validated.sparkSession
    path = scratch_path(spark, "validated")
    seen = Observation("validated rows")
    validated.observe(seen, *statistics_columns(threshold)).write.parquet(path)
    return spark.read.parquet(path), seen.get, path


def validate_file(
    spark: SparkSession,
    path: str,
    output_dir: str,
    quality_threshold: float = HIGH_QUALITY_SCORE,
    profile: TableProfile | None = None,
    history_path: str | None = None,
    run_id: str | None = None,
    **read_options,
) -> dict:
    """File -> clean -> learn -> validate -> splits and reports."""
    started = time.time()
    records = to_records(load(spark, path, **read_options))
    if profile is None:
        profile = learn_profile(records, sample_values=3)
    validated, seen, stored = store_validated(validate(records, profile, source_file=path), quality_threshold)
    written = write_splits(
        validated, output_dir, quality_threshold,
        good=seen["valid_records"], high=seen["high_quality_count"],
    )
    duration = time.time() - started
    out = output_dir.rstrip("/")
    report = write_json_row(
        validation_report(validated, profile, duration), f"{out}/validation_report.json"
    )
    summary = write_json_row(
        processing_summary(validated, quality_threshold, duration),
        f"{out}/processing_summary.json",
    )
    if history_path:
        append_run(run_statistics(validated), history_path, run_id=run_id)
    remove_path(spark, stored)
    return {
        "status": "success",
        "total_records": seen["total_records"],
        "valid_records": seen["valid_records"],
        "invalid_records": seen["invalid_records"],
        "high_quality_records": seen["high_quality_count"],
        "low_quality_records": seen["low_quality_count"],
        "success_rate": _percent(seen["valid_records"], seen["total_records"]),
        "report_path": report,
        "summary_path": summary,
        "output_directory": output_dir,
        "written": written,
    }


def send(records: DataFrame, topic: Topic, key_field: str | None = None) -> dict:
    """Write records to a topic and report what was sent."""
    started = time.time()
    seen = Observation("sent records")
    value = F.col("value")
    topic.write(
        encode(records, key_field).observe(
            seen,
            F.count(F.lit(1)).alias("total"),
            F.count_if(value.isNotNull()).alias("sent"),
        )
    )
    duration = time.time() - started
    total, sent = seen.get["total"], seen.get["sent"]
    return {
        "total_records": total,
        "sent_records": sent,
        "error_records": total - sent,
        "success_rate": sent / total * 100 if total else 0,
        "duration_seconds": duration,
        "records_per_second": sent / duration if duration > 0 else 0,
        "target_topic": topic.name,
    }


def send_from_file(
    spark: SparkSession, path: str, topic: Topic, key_field: str | None = None, **read_options
) -> dict:
    """File -> clean -> topic, unvalidated."""
    stats = send(to_records(load(spark, path, **read_options)), topic, key_field)
    return {**stats, "source_file": path}


def file_to_topic(
    spark: SparkSession,
    path: str,
    topic: Topic,
    validate_before_send: bool = True,
    key_field: str | None = None,
    **read_options,
) -> dict:
    """File -> clean -> validate -> topic; only valid records are sent."""
    records = to_records(load(spark, path, **read_options))
    results: dict = {
        "flow": "file_to_topic",
        "input_file": path,
        "topic": topic.name,
        "validation_enabled": validate_before_send,
        "columns": records.columns,
    }
    if validate_before_send:
        profile = learn_profile(records)
        validated, seen, stored = store_validated(
            validate(records, profile, source_file=path), HIGH_QUALITY_SCORE
        )
        columns = [F.col("`" + c.replace("`", "``") + "`") for c in data_columns(validated)]
        records = validated.where("_is_valid").select(*columns, "_source_file")
        results["validation"] = {
            "total_validated": seen["total_records"],
            "valid_records": seen["valid_records"],
            "invalid_records": seen["invalid_records"],
            "success_rate": _percent(seen["valid_records"], seen["total_records"]),
        }
    results["sending"] = send(records, topic, key_field)
    if validate_before_send:
        remove_path(spark, stored)
    results["status"] = "success"
    return results


def topic_to_analysis(
    spark: SparkSession,
    topic: Topic,
    output_dir: str,
    max_records: int | None = None,
    timeout_seconds: float | None = 60,
    quality_threshold: float = HIGH_QUALITY_SCORE,
    profile: TableProfile | None = None,
    format: str = "csv",
) -> dict:
    """Topic -> validate -> splits and reports, from the start of the topic."""
    started = time.time()
    ingestion = run(
        topic.read_stream(spark), Ingestion.fresh(spark), timeout_seconds,
        profile=profile, max_records=max_records,
    )
    duration = time.time() - started
    out = output_dir.rstrip("/")
    validated = ingestion.validated(spark)
    if validated is None:
        empty = spark.createDataFrame(
            [], "_is_valid boolean, _quality_score double, _quality_level string, _errors array<string>, "
            "_warnings array<string>, _issues array<struct<field:string,issue:string,description:string>>, "
            "_field_scores map<string,double>, _record_id bigint, _source_file string, "
            "_processed_at timestamp, _empty string",
        )
        validated, learned = empty, None
    else:
        learned = ingestion.profile(spark)
    written = write_splits(validated, output_dir, quality_threshold, format)
    report = write_json_row(
        validation_report(validated, learned, duration), f"{out}/validation_report.json"
    )
    summary_row = processing_summary(validated, quality_threshold, duration)
    summary = write_json_row(summary_row, f"{out}/processing_summary.json")
    counts = summary_row.first().asDict(recursive=True)
    return {
        "status": "success",
        **counts,
        "report_path": report,
        "summary_path": summary,
        "output_directory": output_dir,
        "written": written,
    }


def file_to_topic_to_analysis(
    spark: SparkSession,
    path: str,
    topic: Topic,
    output_dir: str,
    max_records: int | None = None,
    timeout_seconds: float | None = 60,
    quality_threshold: float = HIGH_QUALITY_SCORE,
) -> dict:
    """Both halves; the second reads back what the first sent."""
    first = file_to_topic(spark, path, topic)
    second = topic_to_analysis(
        spark, topic, output_dir, max_records, timeout_seconds, quality_threshold
    )
    return {
        "flow": "file_to_topic_to_analysis",
        "file_to_topic": first,
        "topic_to_analysis": second,
        "status": "success",
    }
