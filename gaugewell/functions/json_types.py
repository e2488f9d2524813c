"""Schemas of JSON texts, found by one aggregate over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_type(text: Column) -> Column:
    """Aggregate: the type that fits all JSON texts, as text; those that are none do not count."""
    return F.schema_of_variant_agg(F.try_parse_json(text))


def _parts(text: str) -> list[str]:
    """The members of a list that is delimited by commas; those inside brackets and quoted names do not count."""
    found, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "`":
            quoted = not quoted
        elif not quoted:
            depth += (c in "<(") - (c in ">)")
            if c == "," and not depth:
                found.append(text[at:i].strip())
                at = i + 1
    return [p for p in [*found, text[at:].strip()] if p]


def _data_type(text: str) -> T.DataType | None:
    """The column type for a type of JSON texts; None for an object without members.

    Numbers with a fraction are doubles, and what is of several types, or null, is text, as the JSON reader has it.
    """
    kind, _, inner = text.partition("<")
    inner = inner.removesuffix(">")
    if kind == "OBJECT":
        fields = []
        for part in _parts(inner):
            if part.startswith("`"):
                end = part.index("`:")
                name, member = part[1:end].replace("``", "`"), part[end + 2:]
            else:
                name, _, member = part.partition(":")
            if (found := _data_type(member.strip())) is not None:
                fields.append(T.StructField(name, found))
        return T.StructType(fields) if fields else None
    if kind == "ARRAY":
        return T.ArrayType(_data_type(inner) or T.StringType())
    if kind.startswith("DECIMAL"):
        precision, scale = map(int, kind[8:-1].split(","))
        return T.DoubleType() if scale else T.DecimalType(precision, 0) if precision > 19 else T.LongType()
    return {"BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType()}.get(kind, T.StringType())


def json_schema(text: str | None) -> T.StructType:
    """The columns for JSON objects of the given type."""
    found = _data_type(text) if text else None
    return found if isinstance(found, T.StructType) else T.StructType([])


def json_rows(texts: DataFrame, column: str, schema: T.StructType, first: list[str] | None = None, options: dict | None = None) -> DataFrame:
    """JSON objects as rows; the columns named in ``first`` come first."""
    names = [k for k in dict.fromkeys(first or []) if k in schema.names]
    names += [n for n in schema.names if n not in names]
    row = F.from_json(column, schema, {"mode": "PERMISSIVE", **(options or {})}) if names else F.struct()
    quoted = ["row.`" + n.replace("`", "``") + "`" for n in names]
    return texts.select(row.alias("row")).select(*(F.col(q).alias(n) for q, n in zip(quoted, names)))
