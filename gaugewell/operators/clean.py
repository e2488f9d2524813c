"""Cleaning of a table before it is profiled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions.text import (
    CLEAN_NULL_TOKENS,
    TRIMMED_NULL_TOKENS,
    WHITESPACE,
    null_if_token,
    strip,
)


def standardize_names(df: DataFrame) -> DataFrame:
    """Trim column names and put underscores for spaces."""
    return df.toDF(*[c.strip(WHITESPACE).replace(" ", "_") for c in df.columns])


def clean_text(text: Column) -> Column:
    """Null tokens to null, whitespace trimmed, textual nulls to null."""
    return null_if_token(strip(null_if_token(text, CLEAN_NULL_TOKENS)), TRIMMED_NULL_TOKENS)


def clean(df: DataFrame) -> DataFrame:
    """Standardize names and clean every text column."""
    named = standardize_names(df)
    columns = []
    for f in named.schema.fields:
        column = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, T.StringType):
            column = clean_text(column).alias(f.name)
        columns.append(column)
    return named.select(*columns)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is null."""
    return df.na.drop("all")


def to_records(df: DataFrame, clean_data: bool = True, drop_empty: bool = True) -> DataFrame:
    """The rows that go into validation."""
    if clean_data:
        df = clean(df)
    return drop_empty_rows(df) if drop_empty else df


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects as columns with dotted names; arrays stay as they are."""

    def leaves(prefix: str, path: Column, dtype: T.DataType):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                name = f"{prefix}.{f.name}" if prefix else f.name
                yield from leaves(name, path.getField(f.name), f.dataType)
        else:
            yield path.alias(prefix)

    columns = []
    for f in df.schema.fields:
        columns += leaves(f.name, F.col("`" + f.name.replace("`", "``") + "`"), f.dataType)
    return df.select(*columns)
