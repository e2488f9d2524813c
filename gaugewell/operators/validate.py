"""Validation of every record against a learned profile.

The profile lives on the driver (one row per column), so its rules become
literals of one narrow projection: no join, no shuffle, no Python per row.

Each field is judged once, into a small integer of *marks*; score, issues and
warnings are then cheap functions of those integers.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions.detectors import Detectors, is_integer, to_number
from gaugewell.functions.quality import quality_level
from gaugewell.functions.text import is_absent, value_text
from gaugewell.operators.profile import NUMERIC_TYPES, FieldProfile, TableProfile
from gaugewell.session import configure

VALID_SCORE = 0.6
HIGH_QUALITY_SCORE = 0.8

WHOLE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType)
# allowed values that a number column can hold
INTEGER = re.compile(r"-?\d{1,18}")
NUMBER = re.compile(r"-?\d+(\.\d+)?(e[+-]\d+)?|-?inf")

# Marks of a field.
MISSING, NOT_GIVEN, NULL, EMPTY = 1, 2, 4, 8
TYPE, SHORT, LONG, BELOW, ABOVE, CATEGORY, PATTERN = 16, 32, 64, 128, 256, 512, 1024
# What a mark leaves of a field's score, in the order they multiply.
FIELD_SCORES = [(MISSING | NULL, 0.0), (NOT_GIVEN, 0.8), (EMPTY, 0.9)]
FACTORS = [
    (TYPE, 0.5), (SHORT, 0.7), (LONG, 0.8), (BELOW | ABOVE, 0.7), (CATEGORY, 0.9), (PATTERN, 0.6),
]
# Issue and text of each mark, in the order they are listed.
ISSUES = [
    (MISSING, "missing_value", "Required field is missing"),
    (NULL, "missing_value", "Field cannot be null"),
    (TYPE, "invalid_format", "Invalid {type} format"),
    (SHORT, "length_violation", "Value too short (min: {min_length})"),
    (LONG, "length_violation", "Value too long (max: {max_length})"),
    (BELOW, "out_of_range", "Value below minimum ({min_value})"),
    (ABOVE, "out_of_range", "Value above maximum ({max_value})"),
    (PATTERN, "inconsistent_pattern", "Value doesn't match expected pattern"),
]
# Warning texts.
NOT_GIVEN_WARNING = "Optional field '{}' is missing"
CATEGORY_WARNING = "Field '{}' has unexpected category: "
STRANGER_WARNING = "Unexpected field '%s' found"
REVIEW_WARNING = "Data quality score is %.2f - consider reviewing"
POOR_WARNING = "Poor data quality detected - manual review recommended"
ISSUE_MARKS = MISSING | NULL | TYPE | SHORT | LONG | BELOW | ABOVE | PATTERN

ISSUE_TYPE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("field", "issue", "description")]
)
NO_ISSUES = T.ArrayType(ISSUE_TYPE)
NO_TEXTS = T.ArrayType(T.StringType())

VALIDATION_COLUMNS = [
    "_record_id", "_is_valid", "_quality_score", "_quality_level", "_field_scores",
    "_issues", "_errors", "_warnings", "_source_file", "_processed_at",
]


@dataclass
class FieldView:
    """How one profiled field is read from a record.

    ``value`` and ``dtype`` are set for typed columns: numbers and times are then
    judged as such, and their text is rendered only where a rule needs it.
    """

    text: Column
    absent: Column
    whole: Column  # whether the raw value converts to an integer
    present: Column | None = None  # None: every record has the field
    number: Column | None = None
    value: Column | None = None
    dtype: T.DataType | None = None

    def is_type(self, detectors: Detectors, kind: str) -> Column:
        if isinstance(self.dtype, WHOLE_TYPES):
            return detectors.test_whole(kind, self.value.cast("bigint"))
        if isinstance(self.dtype, T.DoubleType):
            return detectors.test_real(kind, self.value, self.text)
        if isinstance(self.dtype, (*TIME_TYPES, T.DateType)):
            return detectors.test_time(kind, self.text, isinstance(self.dtype, T.DateType))
        return detectors.test(kind, self.text)

    def is_one_of(self, allowed: list[str]) -> Column:
        """Whether the text is among ``allowed``; numbers and times by value."""
        if isinstance(self.dtype, WHOLE_TYPES):
            return self.value.isin([int(v) for v in allowed if INTEGER.fullmatch(v)])
        if isinstance(self.dtype, T.DoubleType):
            return self.value.isin([float(v) for v in allowed if NUMBER.fullmatch(v)])
        if isinstance(self.dtype, (*TIME_TYPES, T.DateType)):
            literals = [F.lit(v).try_cast(self.dtype) for v in allowed]
            return F.coalesce(self.value.isin(*literals), F.lit(False))
        return self.text.isin(list(allowed))


def column_view(column: Column, dtype: T.DataType) -> FieldView:
    """The view of a typed column."""
    text = value_text(column, dtype)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = F.abs(column) < float("inf")
    elif isinstance(dtype, (T.NumericType, T.BooleanType)):
        whole = F.lit(True)
    elif isinstance(dtype, T.StringType):
        whole = is_integer(column)
    else:
        whole = F.lit(False)
    number = column.cast("double") if isinstance(dtype, T.NumericType) else to_number(text)
    return FieldView(
        text, is_absent(column, dtype), whole, number=number, value=column, dtype=dtype
    )


def frame_views(df: DataFrame, profile: TableProfile) -> dict[str, FieldView]:
    """Views of the profiled fields that ``df`` has."""
    return {
        f.name: column_view(df["`" + f.name.replace("`", "``") + "`"], f.dataType)
        for f in df.schema.fields
        if f.name in set(profile.fields)
    }


# ------------------------------------------------------------------ marks


def _value_marks(view: FieldView, profile: FieldProfile, detectors: Detectors) -> Column:
    """Marks of a value that is there."""
    rules, kind, text = profile.rules, profile.detected_type, view.text
    marks: list[Column] = []

    def mark(condition: Column, bit: int) -> None:
        marks.append(F.when(condition, F.lit(bit)).otherwise(F.lit(0)))

    if detectors.has_patterns(kind):
        # one test serves both the type check and the pattern rule
        failed = ~view.is_type(detectors, kind)
        mark(failed, TYPE | (PATTERN if rules.get("patterns") else 0))
    elif kind == "integer":
        mark(~view.whole, TYPE)
    elif kind in detectors.functions:
        mark(~view.is_type(detectors, kind), TYPE)
    if rules.get("min_length") is not None and rules.get("max_length") is not None:
        length = F.length(text)
        marks.append(
            F.when(length < rules["min_length"], F.lit(SHORT))
            .when(length > rules["max_length"], F.lit(LONG))
            .otherwise(F.lit(0))
        )
    if kind in NUMERIC_TYPES and rules.get("min_value") is not None:
        marks.append(
            F.when(view.number < rules["min_value"], F.lit(BELOW))
            .when(view.number > rules["max_value"], F.lit(ABOVE))
            .otherwise(F.lit(0))
        )
    if rules.get("categorical") and rules.get("allowed_values"):
        mark(~view.is_one_of(rules["allowed_values"]), CATEGORY)
    return reduce(lambda a, b: a.bitwiseOR(b), marks) if marks else F.lit(0)


def _field_marks(view: FieldView | None, profile: FieldProfile, detectors: Detectors) -> Column:
    gone = F.lit(NOT_GIVEN if profile.nullable else MISSING)
    if view is None:
        return gone
    empty = F.lit(EMPTY if profile.nullable else NULL)
    marks = F.when(view.absent, empty).otherwise(_value_marks(view, profile, detectors))
    if view.present is not None:
        marks = F.when(view.present, marks).otherwise(gone)
    return marks


def _has(marks: Column, bits: int) -> Column:
    return marks.bitwiseAND(F.lit(bits)) != 0


# Scores and issues are written as SQL text: one call to the session per field, not one per branch.


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _score(marks: str) -> Column:
    """The score of the field whose marks are in the column named ``marks``."""
    factors = " * ".join(f"CASE WHEN ({marks} & {bits}) <> 0 THEN {factor}D ELSE 1.0D END" for bits, factor in FACTORS)
    fixed = " ".join(f"WHEN ({marks} & {bits}) <> 0 THEN {score}D" for bits, score in FIELD_SCORES)
    return F.expr(f"CASE WHEN {marks} = 0 THEN 1.0D {fixed} ELSE {factors} END")


def _field_issues(marks: str, profile: FieldProfile) -> list[str]:
    """The issues that a field can have, null where they do not apply."""
    rules = profile.rules
    limits = ("min_length", "max_length", "min_value", "max_value")
    facts = {name: rules.get(name) for name in limits}
    possible = ISSUE_MARKS & ~(MISSING | NULL if profile.nullable else 0)
    if facts["min_length"] is None or facts["max_length"] is None:
        possible &= ~(SHORT | LONG)
    if facts["min_value"] is None:
        possible &= ~(BELOW | ABOVE)
    return [
        f"CASE WHEN ({marks} & {bit}) <> 0 THEN named_struct('field', {_literal(profile.field)}, 'issue', {_literal(issue)}, "
        f"'description', {_literal(text.format(type=profile.detected_type, **facts))}) END"
        for bit, issue, text in ISSUES
        if bit & possible
    ]


def _field_warnings(marks: Column, view: FieldView | None, profile: FieldProfile) -> list[Column]:
    name, warnings = profile.field, []
    if profile.nullable and (view is None or view.present is not None):
        warnings.append(F.when(_has(marks, NOT_GIVEN), F.lit(NOT_GIVEN_WARNING.format(name))))
    if view is not None and profile.rules.get("categorical"):
        text = F.concat(F.lit(CATEGORY_WARNING.format(name)), view.text)
        warnings.append(F.when(_has(marks, CATEGORY), text))
    return warnings


def _sum(terms: list[Column]) -> Column:
    """Left-to-right sum, in blocks so that wide tables keep shallow expressions."""
    while len(terms) > 1:
        terms = [
            reduce(lambda a, b: a + b, terms[i : i + 100]) for i in range(0, len(terms), 100)
        ]
    return terms[0]


# ------------------------------------------------------------------ records


def judge_records(
    df: DataFrame,
    views: dict[str, FieldView],
    profile: TableProfile,
    unexpected: Iterable[str] | Column = (),
    record_id: str | Column | None = None,
    source_file: str | Column | None = None,
    review_warnings: bool = False,
) -> DataFrame:
    """Append the validation columns to ``df``.

    ``unexpected`` names the fields that the profile does not know: a list if all
    records share it, else an array column.
    """
    configure(df.sparkSession)
    fields = list(profile)
    detectors = profile.detectors
    marks = [
        _field_marks(views.get(p.field), p, detectors).alias(f"_marks_{i}")
        for i, p in enumerate(fields)
    ]
    # The gate is always open, but the optimizer cannot see that: without it, a filter
    # on the verdict is pushed below the marks, copying every test into every use.
    gate = (F.spark_partition_id() >= 0).alias("_gate")
    marked = df.select("*", *marks, gate).where("_gate")
    names = [F.col(f"_marks_{i}") for i in range(len(fields))]
    any_mark = reduce(lambda a, b: a.bitwiseOR(b), names, F.lit(0))

    scores = [_score(f"_marks_{i}") for i in range(len(fields))]
    score = _sum(scores) / len(scores) if scores else F.lit(0.0)
    issues = [c for i, p in enumerate(fields) for c in _field_issues(f"_marks_{i}", p)]
    warnings = [c for m, p in zip(names, fields) for c in _field_warnings(m, views.get(p.field), p)]
    no_texts = F.array().cast(NO_TEXTS)
    if isinstance(unexpected, Column):
        strangers = F.transform(
            F.coalesce(unexpected, no_texts),
            lambda name: F.format_string(STRANGER_WARNING, name),
        )
    else:
        listed = [F.lit(STRANGER_WARNING % name) for name in unexpected]
        strangers = F.array(*listed) if listed else no_texts

    if record_id is None:
        record_id = F.monotonically_increasing_id()
    elif isinstance(record_id, str):
        record_id = F.col(record_id).cast("bigint")
    if not isinstance(source_file, Column):
        source_file = F.lit(source_file).cast("string")

    # a record's own column of such a name is judged, then replaced
    own = [F.col("`" + c.replace("`", "``") + "`") for c in data_columns(df)]
    has_issue = _has(any_mark, ISSUE_MARKS)
    judged = marked.select(
        *own,
        record_id.alias("_record_id"),
        score.alias("_quality_score"),
        (
            F.create_map(*[x for p, s in zip(fields, scores) for x in (F.lit(p.field), s)])
            if fields
            else F.create_map().cast("map<string,double>")
        ).alias("_field_scores"),
        F.when(has_issue, F.expr(f"array_compact(array({', '.join(issues)}))").cast(NO_ISSUES))
        .otherwise(F.array().cast(NO_ISSUES)).alias("_issues")
        if fields
        else F.array().cast(NO_ISSUES).alias("_issues"),
        (
            F.concat(
                F.when(any_mark != 0, F.array_compact(F.array(*warnings))).otherwise(no_texts),
                strangers,
            )
            if warnings
            else strangers
        ).alias("_warnings"),
        source_file.alias("_source_file"),
        has_issue.alias("_has_issue"),
    )
    quality = F.col("_quality_score")
    warned = F.col("_warnings")
    if review_warnings:
        review = F.format_string(REVIEW_WARNING, quality)
        poor = F.lit(POOR_WARNING)
        warned = (
            F.when(quality < 0.6, F.concat(warned, F.array(review, poor)))
            .when(quality < 0.8, F.array_append(warned, review))
            .otherwise(warned)
        )
    return judged.select(
        *own,
        "_record_id",
        (~F.col("_has_issue") & (quality >= VALID_SCORE)).alias("_is_valid"),
        "_quality_score",
        quality_level(quality).alias("_quality_level"),
        "_field_scores",
        "_issues",
        F.transform(
            "_issues",
            lambda i: F.concat(
                F.lit("Field '"), i["field"], F.lit("': "), i["description"]
            ),
        ).alias("_errors"),
        warned.alias("_warnings"),
        "_source_file",
        F.current_timestamp().alias("_processed_at"),
    )


def validate(
    df: DataFrame,
    profile: TableProfile,
    record_id: str | Column | None = None,
    source_file: str | Column | None = None,
    review_warnings: bool = False,
) -> DataFrame:
    """Validate every row of ``df`` against ``profile``.

    Columns the profile does not know give warnings; profiled columns that ``df``
    lacks are missing in every row.
    """
    known = set(profile.fields)
    unexpected = [c for c in df.columns if c not in known]
    return judge_records(
        df, frame_views(df, profile), profile, unexpected, record_id, source_file, review_warnings
    )


def with_position(df: DataFrame, name: str = "_position") -> DataFrame:
    """Append the dense 0-based position of each row in scan order.

    One counting job tells each partition how many rows precede it; only those
    counts (one per partition) reach the driver.
    """
    tagged = df.select("*", F.monotonically_increasing_id().alias("_row"))
    part = F.shiftright("_row", 33)
    counts = {
        r["part"]: r["n"]
        for r in tagged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    start, running = [], 0
    for p in sorted(counts):
        start.append((p, running))
        running += counts[p]
    offsets = df.sparkSession.createDataFrame(start, "part long, start long")
    return (
        tagged.withColumn("part", part.cast("bigint"))
        # one row per partition of the scan
        .join(F.broadcast(offsets), "part", "left")
        .select(
            *[F.col("`" + c.replace("`", "``") + "`") for c in df.columns],
            (F.col("start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).alias(name),
        )
    )


# ------------------------------------------------------------------ splits


def data_columns(validated: DataFrame) -> list[str]:
    """The columns of the record itself."""
    return [c for c in validated.columns if c not in VALIDATION_COLUMNS]


def good_rows(validated: DataFrame) -> DataFrame:
    return validated.where("_is_valid")


def bad_rows(validated: DataFrame) -> DataFrame:
    return validated.where(~F.col("_is_valid"))


def split_by_quality(
    validated: DataFrame, threshold: float = HIGH_QUALITY_SCORE
) -> tuple[DataFrame, DataFrame]:
    """(high, low): valid rows of at least ``threshold``, and all other rows."""
    high = F.col("_is_valid") & (F.col("_quality_score") >= threshold)
    return validated.where(high), validated.where(~high)


def with_validated_data(validated: DataFrame) -> DataFrame:
    """Append the record as ``_validated_data``, null where it is not valid."""
    record = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in data_columns(validated)])
    return validated.withColumn("_validated_data", F.when(F.col("_is_valid"), record))


def accumulate(batches: Iterable[DataFrame]) -> DataFrame:
    """All rows of several validated batches, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)
