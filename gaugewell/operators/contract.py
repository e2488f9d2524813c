"""Declared contracts: typed rules per field, a primary key, three-way routing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions.detectors import is_boolean, is_date, is_datetime, is_integer, parses_as_float, to_time
from gaugewell.sources.sinks import save

# How the text of a value is checked against a declared type.
TYPE_CHECKS = {
    "string": None, "integer": is_integer, "float": parses_as_float, "boolean": is_boolean,
    "date": is_date, "datetime": is_datetime,
}


@dataclass
class FieldRule:
    dtype: str = "string"
    nullable: bool = True
    regex: str | None = None

    def __post_init__(self) -> None:
        if self.dtype not in TYPE_CHECKS:
            raise ValueError(f"Unknown type {self.dtype!r}; known types: {list(TYPE_CHECKS)}")


@dataclass
class Contract:
    fields: dict[str, FieldRule] = field(default_factory=dict)
    primary_key: str | None = None

    @classmethod
    def from_dict(cls, spec: dict) -> Contract:
        """From the parsed form of a YAML or JSON contract."""
        return cls(
            {name: FieldRule(**rule) for name, rule in spec.get("fields", {}).items()},
            spec.get("primary_key"),
        )


def _conforms(value: Column, stored: T.DataType, declared: str) -> Column:
    """A value is of the declared type by its storage, or else by its text."""
    if isinstance(stored, T.NumericType) and declared in ("integer", "float"):
        # whole numbers beside nulls are stored as doubles
        return F.lit(True) if declared == "float" else F.floor(value) == value
    if isinstance(stored, (T.DateType, T.TimestampType, T.TimestampNTZType)) and declared in ("date", "datetime"):
        return F.lit(isinstance(stored, T.DateType) == (declared == "date"))
    return TYPE_CHECKS[declared](value.cast("string"))


def _breaches(name: str, rule: FieldRule, stored: T.DataType) -> list[Column]:
    value = F.col("`" + name.replace("`", "``") + "`")
    text = value.cast("string")

    def breach(condition: Column, kind: str, what: str) -> Column:
        return F.when(
            condition,
            F.struct(
                F.lit(name).alias("field"), F.lit(kind).alias("rule"), F.lit(what).alias("detail")
            ),
        )

    found = []
    if not rule.nullable:
        found.append(breach(value.isNull(), "nullable", "Field cannot be null"))
    if TYPE_CHECKS[rule.dtype]:
        bad = value.isNotNull() & ~_conforms(value, stored, rule.dtype)
        found.append(breach(bad, "dtype", f"Value is not of type {rule.dtype}"))
    if rule.regex:
        found.append(breach(~text.rlike(rule.regex), "regex", "Value does not match the pattern"))
    return found


def check_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """Append ``_breaches``: the contract rules each row breaks, in field order."""
    breaches = []
    for name, rule in contract.fields.items():
        if name in df.columns:
            breaches += _breaches(name, rule, df.schema[name].dataType)
        elif not rule.nullable:
            breaches.append(
                F.struct(
                    F.lit(name).alias("field"), F.lit("missing").alias("rule"),
                    F.lit("Required field is missing").alias("detail"),
                )
            )
    return df.withColumn("_breaches", F.array_compact(F.array(*breaches)))


def duplicate_keys(df: DataFrame, contract: Contract) -> DataFrame:
    """Primary-key values that occur more than once; counted before the shuffle."""
    key = F.col("`" + contract.primary_key.replace("`", "``") + "`")
    return (
        df.groupBy(key.alias(contract.primary_key))
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def breach_counts(checked: DataFrame) -> DataFrame:
    """Rows per field and broken rule."""
    return (
        checked.select(F.explode("_breaches").alias("b"))
        .groupBy(F.col("b.field").alias("field"), F.col("b.rule").alias("rule"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def route(df: DataFrame, required: Sequence[str], suspicious: Column) -> DataFrame:
    """Append ``status``: violation if a required value is null, quarantine if
    suspicious, else accepted."""
    lacking = F.lit(False)
    for name in required:
        lacking = lacking | F.col("`" + name.replace("`", "``") + "`").isNull()
    return df.withColumn(
        "status",
        F.when(lacking, "violation").when(suspicious, "quarantine").otherwise("accepted"),
    )


def route_orders(
    df: DataFrame,
    optional: Sequence[str] = ("ShipRegion",),
    amount: str = "Freight",
    ordered: str = "OrderDate",
    shipped: str = "ShippedDate",
) -> DataFrame:
    """The routing of orders: no nulls but in ``optional``, no negative amount, no
    shipping before the order."""
    required = [c for c in df.columns if c not in optional]
    suspicious = (F.col(amount).cast("double") < 0) | (_time(df, shipped) < _time(df, ordered))
    return route(df, required, suspicious)


def _time(df: DataFrame, name: str) -> Column:
    """A column as times; texts in any of the known formats."""
    value = F.col("`" + name.replace("`", "``") + "`")
    return to_time(value) if isinstance(df.schema[name].dataType, T.StringType) else value.cast("timestamp")


def write_routed(routed: DataFrame, folder: str, format: str = "csv") -> dict[str, str]:
    """Write the three routed sets, each as a table of its own; where they are."""
    return {status: save(rows, f"{folder.rstrip('/')}/{status}.{format}") for status, rows in by_status(routed).items()}


def by_status(routed: DataFrame) -> dict[str, DataFrame]:
    """The three routed sets."""
    return {
        status: routed.where(F.col("status") == status)
        for status in ("accepted", "quarantine", "violation")
    }
