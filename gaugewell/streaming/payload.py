"""Messages: records as JSON payloads, and payloads as records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions.detectors import is_integer, is_json, to_number
from gaugewell.functions.json_types import json_rows, json_schema, json_type
from gaugewell.functions.text import double_text
from gaugewell.operators.profile import TableProfile
from gaugewell.operators.validate import VALIDATION_COLUMNS, FieldView, judge_records


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _json_ready(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(column, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    if isinstance(dtype, T.DecimalType):
        return column.cast("string")
    return column


def encode(df: DataFrame, key_field: str | None = None) -> DataFrame:
    """(key, value): each row as a JSON object, nulls kept, times in ISO form."""
    columns = [
        _json_ready(F.col(_quoted(f.name)), f.dataType).alias(f.name) for f in df.schema.fields
    ]
    key = F.col(_quoted(key_field)).cast("string") if key_field else F.lit(None).cast("string")
    return df.select(
        key.alias("key"),
        F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"),
    )


def is_payload(value: Column) -> Column:
    """True for text that is exactly one JSON object."""
    return F.coalesce(value.rlike(r"^[ \t\n\r]*\{") & is_json(value), F.lit(False))


def well_formed(messages: DataFrame) -> DataFrame:
    return messages.where(is_payload(F.col("value")))


def malformed(messages: DataFrame) -> DataFrame:
    return messages.where(~is_payload(F.col("value")))


def decode(messages: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Well-formed payloads as typed rows of a known schema."""
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("record")
    return well_formed(messages).select(parsed).select("record.*")


def payload_table(messages: DataFrame) -> DataFrame:
    """Payloads as a table whose schema is inferred, for learning a profile.

    One aggregate finds the schema; nothing is written. The first payload's fields come first.
    """
    payloads = well_formed(messages).select("value")
    schema = json_schema(payloads.agg(json_type(F.col("value"))).first()[0])
    head = payloads.select(F.json_object_keys("value").alias("names")).limit(1).collect()
    return json_rows(payloads, "value", schema, head[0]["names"] if head else [])


def _variant_path(name: str) -> str:
    quote = "'" if '"' in name else '"'
    return f"$[{quote}{name}{quote}]"


def _field_columns(i: int) -> tuple[list[Column], list[Column]]:
    """What is read of the field in ``_node_i``: its kind, text and number, then how it is judged.

    Two steps of a projection each: what the second uses several times is computed once.
    """
    node = F.col(f"_node_{i}")
    kind, plain, number = F.col(f"_kind_{i}"), F.col(f"_plain_{i}"), F.col(f"_double_{i}")
    read = [
        F.schema_of_variant(node).alias(f"_kind_{i}"),
        F.try_variant_get(node, "$", "string").alias(f"_plain_{i}"),
        F.try_variant_get(node, "$", "double").alias(f"_double_{i}"),
        node.isNotNull().alias(f"_present_{i}"),
        F.is_variant_null(node).alias(f"_null_{i}"),
    ]
    text = (
        F.when(kind == "BOOLEAN", F.initcap(plain))
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), double_text(number))
        .otherwise(plain)
    )
    whole = F.when(kind == "STRING", is_integer(plain)).otherwise(
        kind.isin("BIGINT", "BOOLEAN", "DOUBLE") | kind.startswith("DECIMAL")
    )
    judged = [
        text.alias(f"_text_{i}"),
        (F.col(f"_null_{i}") | (plain == "")).alias(f"_empty_{i}"),
        whole.alias(f"_whole_{i}"),
        F.col(f"_present_{i}"),
        F.when(kind == "STRING", to_number(plain)).otherwise(number).alias(f"_number_{i}"),
    ]
    return read, judged


def validate_payloads(
    messages: DataFrame, profile: TableProfile, source_file: str | None = "kafka_stream"
) -> DataFrame:
    """Validate payloads against a profile; fields come out as text columns.

    Fields the profile does not know give warnings, fields a payload lacks count
    as missing, both per record.
    """
    parsed = well_formed(messages).select(
        F.try_parse_json("value").alias("_payload"), F.json_object_keys("value").alias("_keys")
    )
    names = list(profile.fields)
    nodes = [F.try_variant_get("_payload", _variant_path(n), "variant").alias(f"_node_{i}") for i, n in enumerate(names)]
    read, judging = zip(*(_field_columns(i) for i in range(len(names)))) if names else ((), ())
    rows = (
        parsed.select("_keys", *nodes)
        .select("_keys", *(c for columns in read for c in columns))
        .select("_keys", *(c for columns in judging for c in columns))
    )
    staged = {
        name: FieldView(
            F.col(f"_text_{i}"), F.col(f"_empty_{i}"), F.col(f"_whole_{i}"), F.col(f"_present_{i}"), F.col(f"_number_{i}"))
        for i, name in enumerate(names)
    }
    unexpected = F.array_except("_keys", F.array(*[F.lit(n) for n in profile.fields]))
    judged = judge_records(rows, staged, profile, unexpected, source_file=source_file)
    kept = [c for c in judged.columns if c not in rows.columns]
    named = [
        F.col(f"_text_{i}").alias(name)
        for i, name in enumerate(profile.fields)
        if name not in VALIDATION_COLUMNS
    ]
    return judged.select(*named, *kept)
