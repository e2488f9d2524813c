"""ANSI SQL that states the expected result of each registered query."""

from __future__ import annotations

from gaugewell.functions.detectors import (
    BOOLEAN_WORDS,
    PATTERNS,
    Detectors,
)
from gaugewell.operators.profile import FieldProfile
from gaugewell.plans.views import View

# Numbers as the oracles read them, stated apart from the engine's patterns.
_GAP, _SIGN, _RUN = r"[ \t\n\r\f]*", "[-+]?", "[0-9]+(_[0-9]+)*"
_POWER = f"([eE]{_SIGN}{_RUN})?"
INTEGER_TEXT = f"^{_GAP}{_SIGN}{_RUN}{_GAP}$"
POINT_NUMBER_TEXT = f"^{_GAP}{_SIGN}({_RUN}[.]({_RUN})?|[.]{_RUN}){_POWER}{_GAP}$"
FLOAT_TEXT = f"(?i)^{_GAP}{_SIGN}({_RUN}([.]({_RUN})?)?{_POWER}|[.]{_RUN}{_POWER}|inf|infinity|nan){_GAP}$"
PLAIN_NUMBER_TEXT = f"^{_GAP}{_SIGN}([0-9]+[.]?[0-9]*|[.][0-9]+)([eE]{_SIGN}[0-9]+)?{_GAP}$"

# The formats of dates and times.
DATE_FORMATS = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y",
                "%B %d, %Y", "%d %B %Y"]
DATETIME_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S",
                    "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%SZ", "%m/%d/%Y %H:%M:%S"]


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def is_type(kind: str, v: str) -> str:
    """Boolean SQL: text ``v`` is of a type; null for null."""
    if kind in PATTERNS:
        tests = [f"regexp_matches({v}, {quote(p)}, 'i')" for p in PATTERNS[kind]]
        return "(" + " OR ".join(tests) + ")"
    if kind == "integer":
        return f"regexp_matches({v}, {quote(INTEGER_TEXT)})"
    if kind == "float":
        return f"regexp_matches({v}, {quote(POINT_NUMBER_TEXT)})"
    if kind == "boolean":
        return f"(lower({v}) IN ({', '.join(quote(w) for w in BOOLEAN_WORDS)}))"
    if kind == "date":
        return f"(try_strptime({v}, {sql_list(DATE_FORMATS)}) IS NOT NULL)"
    if kind == "datetime":
        return f"(try_strptime({v}, {sql_list(DATETIME_FORMATS)}) IS NOT NULL)"
    if kind == "json":
        # the bare words Python takes and no other spelling of them
        words = "('nan', 'inf', '-inf', 'infinity', '-infinity')"
        return (f"(json_valid({v}) AND lower(trim({v})) NOT IN {words} "
                f"OR trim({v}) IN ('NaN', 'Infinity', '-Infinity'))")
    raise ValueError(kind)


def number(v: str, kind: str) -> str:
    if kind == "string":
        return f"CASE WHEN regexp_matches({v}, {quote(PLAIN_NUMBER_TEXT)}) THEN TRY_CAST({v} AS DOUBLE) END"
    if kind in ("bigint", "double"):
        return f"CAST({v} AS DOUBLE)"
    return "CAST(NULL AS DOUBLE)"


def cells(view: View) -> str:
    """(ordinal, field, v, n) of every value of a view named src."""
    parts = []
    for i, (name, (kind, _)) in enumerate(view.columns.items()):
        v = f'"{name}"'
        parts.append(
            f"SELECT {i} AS ordinal, {quote(name)} AS field, CAST({v} AS VARCHAR) AS v, "
            f"{number(v, kind)} AS n FROM src"
        )
    return " UNION ALL ".join(parts)


def detection(view: View, kind: str) -> str:
    hit = is_type(kind, "v")
    return (
        f"WITH src AS ({view.sql}), cells AS ({cells(view)}) "
        f"SELECT field, count(*) AS rows, count(*) FILTER (WHERE v IS NOT NULL AND {hit}) AS hits "
        "FROM cells GROUP BY field"
    )


# ------------------------------------------------------------------ profile


def profile_ctes(view: View, order: list[str] | None = None) -> str:
    """CTEs up to ``profile``: one row per field with unrounded columns."""
    order = order or Detectors().order
    hits = ", ".join(
        f"count(*) FILTER (WHERE v IS NOT NULL AND {is_type(kind, 'v')}) AS h_{kind}"
        for kind in order
    )
    parses = f"regexp_matches(v, {quote(FLOAT_TEXT)})"
    dated = f"({is_type('date', 'v')} OR {is_type('datetime', 'v')})"
    best = "greatest(" + ", ".join(f"h_{k}" for k in order) + ", h_categorical)"
    choose = " ".join(f"WHEN h_{k} = best THEN {quote(k)}" for k in order)
    own = " ".join(f"WHEN {quote(k)} THEN h_{k}" for k in PATTERNS)
    return f"""
src AS ({view.sql}),
cells AS ({cells(view)}),
hits AS (
  SELECT ordinal, field, count(*) AS total_values, count(*) - count(v) AS null_count,
    count(v) AS filled, count(DISTINCT v) AS unique_values,
    min(length(v)) AS shortest, max(length(v)) AS longest, avg(length(v)) AS mean_length,
    min(n) AS lowest, max(n) AS highest, avg(n) AS mean, stddev_samp(n) AS deviation,
    count(*) FILTER (WHERE v IS NOT NULL AND {parses}) AS h_parses,
    count(*) FILTER (WHERE v IS NOT NULL AND {dated}) AS h_dated,
    {hits}
  FROM cells GROUP BY ordinal, field),
flagged AS (
  SELECT *, CASE WHEN filled > 0 AND CAST(unique_values AS DOUBLE) / filled < 0.1e0
    AND unique_values < 50 THEN filled ELSE 0 END AS h_categorical FROM hits),
ranked AS (SELECT *, {best} AS best FROM flagged),
typed AS (
  SELECT *, CASE WHEN filled = 0 OR best = 0 OR CAST(best AS DOUBLE) / filled < 0.8e0 THEN 'string'
    {choose} ELSE 'categorical' END AS detected_type FROM ranked),
scored AS (
  SELECT *,
    (filled > 0 AND (CAST(unique_values AS DOUBLE) / total_values < 0.1e0
      OR detected_type = 'categorical')) AS is_categorical,
    CASE WHEN filled = 0 THEN 0e0 ELSE CAST(filled AS DOUBLE) / total_values END AS completeness_score,
    CASE WHEN filled = 0 THEN 0e0 ELSE
      CAST(CASE detected_type {own} ELSE filled END AS DOUBLE) / filled END AS consistency_score,
    CASE WHEN filled = 0 THEN 0e0 ELSE
      CAST(CASE detected_type WHEN 'integer' THEN h_integer WHEN 'float' THEN h_parses
        WHEN 'boolean' THEN h_boolean WHEN 'date' THEN h_dated WHEN 'datetime' THEN h_dated
        ELSE filled END AS DOUBLE) / filled END AS validity_score
  FROM typed),
profile AS (
  SELECT field, ordinal, detected_type, null_count > 0 AS nullable, filled, total_values,
    null_count, unique_values,
    CASE WHEN detected_type IN ('string', 'email', 'phone', 'url') THEN shortest END AS min_length,
    CASE WHEN detected_type IN ('string', 'email', 'phone', 'url') THEN longest END AS max_length,
    CASE WHEN detected_type IN ('string', 'email', 'phone', 'url') THEN mean_length END AS avg_length,
    CASE WHEN detected_type IN ('integer', 'float') THEN lowest END AS min_value,
    CASE WHEN detected_type IN ('integer', 'float') THEN highest END AS max_value,
    CASE WHEN detected_type IN ('integer', 'float') THEN mean END AS mean_value,
    CASE WHEN detected_type IN ('integer', 'float') THEN deviation END AS std_value,
    is_categorical, completeness_score, consistency_score, validity_score,
    (completeness_score + consistency_score + validity_score) / 3 AS overall_quality_score
  FROM scored),
counted AS (
  SELECT c.ordinal, c.field, c.v, count(*) AS frequency FROM cells c
  JOIN profile p ON c.ordinal = p.ordinal WHERE p.is_categorical AND c.v IS NOT NULL
  GROUP BY c.ordinal, c.field, c.v),
leaders AS (
  SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY frequency DESC, v) AS rank FROM counted
  QUALIFY rank <= 20)"""


def profile(view: View) -> str:
    return f"""WITH {profile_ctes(view)}
SELECT field, ordinal, detected_type, nullable, total_values, null_count, unique_values,
  min_length, max_length, round(avg_length, 4) AS avg_length, round(min_value, 4) AS min_value,
  round(max_value, 4) AS max_value, round(mean_value, 4) AS mean_value,
  round(std_value, 4) AS std_value, is_categorical,
  round(completeness_score, 6) AS completeness_score,
  round(consistency_score, 6) AS consistency_score, round(validity_score, 6) AS validity_score,
  round(overall_quality_score, 6) AS overall_quality_score
FROM profile"""


def types(view: View, order: list[str] | None = None) -> str:
    return f"WITH {profile_ctes(view, order)} SELECT field, detected_type FROM profile"


def categories(view: View) -> str:
    return (f"WITH {profile_ctes(view)} SELECT field, rank AS position, v AS value, frequency FROM leaders")


RULES = """, listed AS (
  SELECT ordinal, string_agg(v, '|' ORDER BY rank) AS allowed FROM leaders GROUP BY ordinal),
rules AS (
  SELECT p.field, p.ordinal, p.detected_type AS type, p.nullable, NOT p.nullable AS required,
    greatest(1, p.min_length - 2) AS min_length, p.max_length + 10 AS max_length,
    p.min_value - 2 * p.std_value AS min_value, p.max_value + 2 * p.std_value AS max_value,
    l.allowed AS allowed_values
  FROM profile p LEFT JOIN listed l ON p.ordinal = l.ordinal)"""


def rules(view: View) -> str:
    return f"""WITH {profile_ctes(view)} {RULES}
SELECT field, type, nullable, required,
  CASE WHEN max_length IS NULL THEN NULL ELSE min_length END AS min_length, max_length,
  round(min_value, 4) AS min_value, round(max_value, 4) AS max_value, allowed_values FROM rules"""


# ------------------------------------------------------------------ validation


def _convertible(kind: str, storage: str, v: str) -> str:
    """Boolean SQL: the raw value converts to integer."""
    if storage == "string":
        return is_type("integer", v)
    return "TRUE" if storage in ("bigint", "double") else "FALSE"


def _field(name: str, rule: FieldProfile, storage: str | None) -> tuple[str, list[tuple[str, str]], str]:
    """(score, [(condition, description)], category condition) of one field."""
    rules, kind = rule.rules, rule.detected_type
    if storage is None:
        if rule.nullable:
            return "0.8e0", [], "FALSE"
        return "0e0", [("TRUE", "Required field is missing")], "FALSE"
    v = f'CAST("{name}" AS VARCHAR)'
    gone = f'("{name}" IS NULL' + (f" OR \"{name}\" = '')" if storage == "string" else ")")
    conditions: list[tuple[str, str, str]] = []
    if kind == "integer":
        conditions.append((f"NOT {_convertible(kind, storage, v)}", f"Invalid {kind} format", "0.5e0"))
    elif kind not in ("string", "categorical"):
        conditions.append((f"NOT {is_type(kind, v)}", f"Invalid {kind} format", "0.5e0"))
    if rules.get("min_length") is not None:
        low, high = rules["min_length"], rules["max_length"]
        conditions.append((f"length({v}) < {low}", f"Value too short (min: {low})", "0.7e0"))
        conditions.append((f"length({v}) > {high}", f"Value too long (max: {high})", "0.8e0"))
    if kind in ("integer", "float") and rules.get("min_value") is not None:
        n = number(f'"{name}"', storage)
        low, high = rules["min_value"], rules["max_value"]
        conditions.append((f"({n}) < {low}", f"Value below minimum ({low})", "0.7e0"))
        conditions.append((f"({n}) > {high}", f"Value above maximum ({high})", "0.7e0"))
    category = "FALSE"
    if rules.get("allowed_values"):
        allowed = rules["allowed_values"]
        some = "TRUE"
        if isinstance(allowed, list):
            allowed = ", ".join(quote(a) for a in allowed)
        else:  # a subquery, empty for a field that is not categorical
            some = f"EXISTS ({allowed})"
        category = f"(NOT {gone} AND {some} AND {v} NOT IN ({allowed}))"
    if rules.get("patterns"):
        conditions.append(
            (f"NOT {is_type(kind, v)}", "Value doesn't match expected pattern", "0.6e0"))
    pattern_last = [c for c in conditions if c[2] != "0.6e0"]
    product = " * ".join(
        ["1e0"] + [f"(CASE WHEN {c} THEN {f} ELSE 1e0 END)" for c, _, f in pattern_last]
        + [f"(CASE WHEN {category} THEN 0.9e0 ELSE 1e0 END)"]
        + [f"(CASE WHEN {c} THEN {f} ELSE 1e0 END)" for c, _, f in conditions if f == "0.6e0"]
    )
    score = f"CASE WHEN {gone} THEN {'0.9e0' if rule.nullable else '0e0'} ELSE {product} END"
    issues = [] if rule.nullable else [(gone, "Field cannot be null")]
    issues += [(f"(NOT {gone} AND {c})", d) for c, d, _ in conditions]
    return score, issues, category


def validated(view: View, profile_rows, key: str, ctes: str = "") -> str:
    """CTE body: one row per record with score, errors (texts) and warnings (texts)."""
    scores, errors, warnings = [], [], []
    names = [p.field for p in profile_rows]
    for rule in profile_rows:
        name = rule.field
        storage = view.columns[name][0] if name in view.columns else None
        score, issues, category = _field(name, rule, storage)
        scores.append(f"({score})")
        errors += [
            f"CASE WHEN {c} THEN {quote(f'Field {chr(39)}{name}{chr(39)}: {d}')} END" for c, d in issues
        ]
        if storage is None and rule.nullable:
            warnings.append(quote(f"Optional field '{name}' is missing"))
        if category != "FALSE":
            text = quote(f"Field '{name}' has unexpected category: ")
            warnings.append(f'CASE WHEN {category} THEN {text} || CAST("{name}" AS VARCHAR) END')
    warnings += [quote(f"Unexpected field '{n}' found") for n in view.columns if n not in names]
    keep = "lambda x: x IS NOT NULL"
    warned = f"list_filter([{', '.join(warnings)}], {keep})" if warnings else "[]::VARCHAR[]"
    total = " + ".join(scores)
    return f"""
source_rows AS ({view.sql}),
judged AS (
  SELECT *, "{key}" AS record_id, ({total}) / {len(scores)} AS score,
    list_filter([{', '.join(errors)}], {keep}) AS errors, {warned} AS warnings
  FROM source_rows),
validated AS (
  SELECT *, (len(errors) = 0 AND score >= 0.6e0) AS is_valid,
    CASE WHEN score >= 0.9e0 THEN 'excellent' WHEN score >= 0.8e0 THEN 'good'
      WHEN score >= 0.6e0 THEN 'fair' ELSE 'poor' END AS level
  FROM judged)"""


STATS = """stats AS (
  SELECT count(*) AS total_records, count(*) FILTER (WHERE is_valid) AS valid_records,
    count(*) FILTER (WHERE NOT is_valid) AS invalid_records,
    count(*) FILTER (WHERE is_valid AND level = 'excellent') AS excellent_quality,
    count(*) FILTER (WHERE is_valid AND level = 'good') AS good_quality,
    count(*) FILTER (WHERE is_valid AND level = 'fair') AS fair_quality,
    count(*) FILTER (WHERE is_valid AND level = 'poor') AS poor_quality,
    count(*) FILTER (WHERE is_valid AND score >= 0.8e0) AS high_quality_count,
    count(*) FILTER (WHERE NOT (is_valid AND score >= 0.8e0)) AS low_quality_count,
    CASE WHEN count(*) = 0 THEN 0e0
      ELSE CAST(count(*) FILTER (WHERE is_valid) AS DOUBLE) / count(*) * 100 END AS success_rate
  FROM validated)"""

PATTERN_COUNTS = """patterns AS (
  SELECT split_part(e, ':', 1) AS pattern, count(*) AS errors
  FROM (SELECT unnest(errors) AS e FROM validated WHERE NOT is_valid) GROUP BY 1)"""
