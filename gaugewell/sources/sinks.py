"""Writers: tables by format, splits, JSON reports."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.operators.validate import HIGH_QUALITY_SCORE, data_columns, split_by_quality

OUTPUT_FORMATS = ["csv", "json", "parquet"]


def save(
    df: DataFrame, path: str, format: str | None = None, mode: str = "overwrite", **options
) -> str:
    """Write ``df`` in ``format``, or in the one the path ends with.

    The result is a directory with one file per task.  CSV has no nested values,
    so they are written as JSON text.
    """
    format = format or PurePosixPath(path).suffix.lower().lstrip(".")
    if format not in OUTPUT_FORMATS:
        raise ValueError(f"Unsupported output format: {format}. Supported: {OUTPUT_FORMATS}")
    if format == "csv":
        nested = (T.StructType, T.ArrayType, T.MapType)
        for f in df.schema.fields:
            if isinstance(f.dataType, nested):
                df = df.withColumn(f.name, F.to_json(F.col("`" + f.name.replace("`", "``") + "`")))
        options = {"header": True, "escape": '"', **options}
    elif format == "json":
        options = {"ignoreNullFields": False, **options}
    df.write.mode(mode).format(format).options(**options).save(path)
    return path


def write_splits(
    validated: DataFrame,
    output_dir: str,
    threshold: float = HIGH_QUALITY_SCORE,
    format: str = "csv",
    good: int | None = None,
    high: int | None = None,
) -> dict[str, str]:
    """Write the good and the high-quality rows, each only if there are any.

    Pass the known counts as ``good`` and ``high`` to save the check.
    """
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in data_columns(validated)]
    columns.append(F.col("_source_file"))
    high_rows, _ = split_by_quality(validated, threshold)
    written = {}
    for name, rows, count in (
        ("good_data", validated.where("_is_valid"), good),
        ("high_quality_data", high_rows, high),
    ):
        if count if count is not None else not rows.isEmpty():
            path = f"{output_dir.rstrip('/')}/{name}.{format}"
            written[name] = save(rows.select(*columns), path, format)
    return written


def write_json_row(row: DataFrame, path: str) -> str:
    """Write a one-row report as a JSON object."""
    row.select(F.to_json(F.struct(*row.columns), {"ignoreNullFields": "false"})).write.mode(
        "overwrite"
    ).text(path)
    return path
