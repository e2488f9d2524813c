"""Text forms of values: rendering, trimming, null tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens read as null from delimited text.
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]
# Tokens cleaning turns into null before and after trimming.
CLEAN_NULL_TOKENS = ["", "NULL", "null", "None"]
TRIMMED_NULL_TOKENS = ["nan", "None", "<NA>"]

# The characters Python's str.strip() removes.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(WHITESPACE))


def null_if_token(text: Column, tokens: list[str]) -> Column:
    """Null where the text is exactly one of ``tokens``."""
    return F.when(~text.isin(tokens), text)


def double_text(x: Column) -> Column:
    """A double as Python prints it: positional from 1e-4 up to 1e16."""
    size, text = F.abs(x), x.cast("string")
    digits = F.rtrim(x.try_cast("decimal(38,22)").cast("string"), F.lit("0"))
    positional = F.regexp_replace(digits, r"\.$", ".0")
    # 1.0E16 -> 1e+16, 1.5E-5 -> 1.5e-05
    scientific = F.regexp_replace(F.replace(text, F.lit(".0E"), F.lit("E")), r"E-(\d)$", "e-0$1")
    scientific = F.replace(scientific, F.lit("E-"), F.lit("e-"))
    scientific = F.replace(scientific, F.lit("E"), F.lit("e+"))
    return (
        F.when((size >= 1e-3) & (size < 1e7) | (size == 0), text)
        .when((size >= 1e-4) & (size < 1e16), positional)
        .when(F.isnan(x), "nan")
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .otherwise(scientific)
    )


def value_text(value: Column, dtype: T.DataType) -> Column:
    """The text a value is judged by: what Python's ``str`` would print."""
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(dtype, T.FloatType):
        # through text, so that 0.1f stays 0.1
        return double_text(value.cast("string").cast("double"))
    if isinstance(dtype, T.DoubleType):
        return double_text(value)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(value, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    if isinstance(dtype, T.VariantType):
        return F.to_json(value)
    return value.cast("string")


def is_absent(value: Column, dtype: T.DataType) -> Column:
    """Null, NaN or the empty string."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return value.isNull() | F.isnan(value)
    if isinstance(dtype, T.StringType):
        return value.isNull() | (value == "")
    return value.isNull()

