"""The fixed customer model: renaming, normalisation, length rules, quality score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.quality import quality_level
from gaugewell.functions.text import strip

# Model field and the column name it is read from.
FIELD_ALIASES = {
    "customer_id": "CustomerID",
    "company_name": "CompanyName",
    "contact_name": "ContactName",
    "contact_title": "ContactTitle",
    "city": "City",
    "region": "Region",
    "postal_code": "PostalCode",
    "country": "Country",
    "segment": "Segment",
    "metro_area": "MetroArea",
}
# Shortest and longest raw text of each field.
LENGTHS = {
    "customer_id": (1, 10),
    "company_name": (1, 200),
    "contact_name": (1, 100),
    "contact_title": (1, 100),
    "city": (1, 50),
    "region": (0, 50),
    "postal_code": (1, 20),
    "country": (2, 50),
}
# Fixed values.
SEGMENTS = [
    "Healthcare", "Government", "Corporate", "Hospitality", "Retail", "Education", "Finance",
]
TRUE_WORDS = ["true", "yes", "1", "y"]
FALSE_WORDS = ["false", "no", "0", "n"]
OPTIONAL = ["region"]


def rename_fields(df: DataFrame) -> DataFrame:
    """Give aliased columns their model names."""
    return df.withColumnsRenamed({alias: name for name, alias in FIELD_ALIASES.items()})


def title_case(text: Column) -> Column:
    """Every run of letters capitalised, also after hyphens and apostrophes."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def metro_flag(text: Column) -> Column:
    """Boolean words as a boolean; null for any other text."""
    word = strip(F.lower(text))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def normalized(name: str, text: Column) -> Column:
    """The stored form of a field."""
    if name == "customer_id":
        return F.upper(strip(text))
    if name in ("contact_name", "company_name", "postal_code"):
        return strip(text)
    if name == "segment":
        return title_case(strip(text))
    return text


def _error(condition: Column, name: str, what: str) -> Column:
    return F.when(condition, F.lit(f"Field '{name}': {what}"))


def _field_error(name: str, raw: Column) -> Column:
    """The first rule a field breaks, or null."""
    checks = []
    if name not in OPTIONAL:
        checks.append(_error(raw.isNull(), name, "Required field is missing"))
    if name in LENGTHS:
        low, high = LENGTHS[name]
        length = F.length(raw)
        checks.append(_error(length < low, name, f"Value too short (min: {low})"))
        checks.append(_error(length > high, name, f"Value too long (max: {high})"))
    if name in ("customer_id", "contact_name", "company_name"):
        checks.append(_error(strip(raw) == "", name, "Value cannot be empty after trimming"))
    if name == "postal_code":
        short = F.length(strip(raw)) < 3
        checks.append(_error(short, name, "Postal code must be at least 3 characters"))
    if name == "segment":
        checks.append(_error(raw == "", name, "Segment is required"))
    return F.coalesce(*checks)


def _filled(column: Column) -> Column:
    return F.coalesce(F.length(strip(column)) > 0, F.lit(False))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def customer_score(columns: dict[str, Column]) -> Column:
    """Points of a customer over ten; eleven points exist, so 1.1 is reachable."""
    required = ["customer_id", "company_name", "contact_name", "city", "postal_code", "country"]
    points = [_filled(columns[n]).cast("int") for n in required]
    points += [_filled(columns[n]).cast("int") for n in ("region", "contact_title")]
    points.append(_flag(F.length(columns["customer_id"]) >= 3))
    points.append(_flag(F.length(columns["postal_code"]) >= 5))
    points.append(_flag(columns["segment"].isin(SEGMENTS)))
    total = points[0]
    for point in points[1:]:
        total = total + point
    return total / 10


def customer_records(df: DataFrame, rename: bool = True) -> DataFrame:
    """Normalised customers with errors, score and level.

    Fields the table lacks are missing in every row.  ``metro_area`` is null where
    its text is no boolean word; the text stays in ``metro_area_text``.
    """
    source = rename_fields(df) if rename else df
    text = {
        name: source[name].cast("string") if name in source.columns
        else F.lit(None).cast("string")
        for name in FIELD_ALIASES
    }
    staged = source.select(*[column.alias(name) for name, column in text.items()])
    raw = {name: F.col(name) for name in FIELD_ALIASES}
    errors = [_field_error(name, column) for name, column in raw.items()]
    columns = [normalized(n, c).alias(n) for n, c in raw.items() if n != "metro_area"]
    shaped = staged.select(
        *columns,
        metro_flag(raw["metro_area"]).alias("metro_area"),
        raw["metro_area"].alias("metro_area_text"),
        F.array_compact(F.array(*errors)).alias("_errors"),
    )
    score = customer_score({name: F.col(name) for name in FIELD_ALIASES})
    return shaped.select(
        "*",
        (F.size("_errors") == 0).alias("_is_valid"),
        F.coalesce(F.col("segment").isin(SEGMENTS), F.lit(False)).alias("_known_segment"),
        score.alias("_quality_score"),
        quality_level(score).alias("_quality_level"),
    )
