"""gaugewell: profiling, validation and routing of tables and streams on Spark."""

from gaugewell.functions.detectors import Detectors
from gaugewell.operators.clean import clean, flatten, to_records
from gaugewell.operators.profile import TableProfile, learn_profile, profile_frame, schema_summary
from gaugewell.operators.report import run_statistics, validation_report
from gaugewell.operators.validate import (
    bad_rows,
    good_rows,
    split_by_quality,
    validate,
)
from gaugewell.session import configure, local_session
from gaugewell.sources.files import load
from gaugewell.sources.sinks import save

__all__ = [
    "Detectors", "TableProfile", "bad_rows", "clean", "configure", "flatten", "good_rows",
    "learn_profile", "load", "local_session", "profile_frame", "run_statistics", "save",
    "schema_summary", "split_by_quality", "to_records", "validate", "validation_report",
]
