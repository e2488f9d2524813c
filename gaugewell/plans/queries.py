"""The registered queries and the SQL that states their results.

Every query reads the given tables whole, directly or through a derived view.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.functions.detectors import Detectors
from gaugewell.functions.quality import QUALITY_LEVELS
from gaugewell.operators import clean as C
from gaugewell.operators import contract as K
from gaugewell.operators import customer as M
from gaugewell.operators import joblog as J
from gaugewell.operators import report as R
from gaugewell.operators import validate as V
from gaugewell.operators.contract import Contract
from gaugewell.operators.leading import leading_values
from gaugewell.operators.profile import (
    TableProfile,
    field_digest,
    field_quality_counts,
    learn_profile,
    profile_frame,
    schema_summary,
    spread,
    type_counts,
)
from gaugewell.operators.profile_state import ProfileState
from gaugewell.plans import oracles as O
from gaugewell.plans import views as W
from gaugewell.plans.views import View
from gaugewell.session import configure, scratch_path
from gaugewell.sources import files as S
from gaugewell.sources.sinks import save, write_json_row, write_splits
from gaugewell.sources.topics import FileTopic, LogTopic
from gaugewell.streaming import ingest as I
from gaugewell.streaming import payload as P
from gaugewell.streaming.keys import KeyWatch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), str(sf_dir).rstrip("/"))

    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = oracle


def query(name: str, oracle: str | None = None):
    def wrap(function: Query) -> Query:
        register(name, function, oracle)
        return function

    return wrap


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ------------------------------------------------------------------ detectors


def _detect(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and hits of one type per column of the mixed-form table."""
    people = spread(W.PEOPLE.frame(spark, sf_dir))
    texts = people.select(*[F.col(c).cast("string").alias(c) for c in people.columns])
    long = texts.unpivot([], people.columns, "field", "v")
    hit = F.coalesce(Detectors().test(kind, F.col("v")), F.lit(False))
    return (
        # each distinct text is tested once
        long.groupBy("field", "v").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("field")
        .agg(F.sum("n").alias("rows"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits"))
    )


for _kind in Detectors().order:
    register(f"detect_{_kind}", partial(_detect, _kind), O.detection(W.PEOPLE, _kind))


def _types(view: View, mode: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = learn_profile(view.frame(spark, sf_dir), Detectors(mode=mode))
    return profile.to_frame(spark).select("field", "detected_type")


register("detect_types_reference", partial(_types, W.PEOPLE, "reference"), O.types(W.PEOPLE))
register(
    "detect_types_strict_numeric", partial(_types, W.TABLES["lineitem"], "strict_numeric"),
    O.types(W.TABLES["lineitem"], Detectors(mode="strict_numeric").order),
)


@query("detect_types_custom_family", """
SELECT 'p_brand' AS field, 'brand_code' AS detected_type UNION ALL
SELECT 'p_name', CASE WHEN count(*) > 0 THEN 'two_words' END FROM part""")
def _custom_types(spark, sf_dir):
    """A caller's own pattern family and detector function."""
    detectors = Detectors(
        patterns={"brand_code": [r"^Brand#\d+$"]},
        functions={"two_words": lambda text: F.size(F.split(text, " ")) == 2},
    )
    parts = read(spark, sf_dir, "part").select("p_brand", "p_name")
    return learn_profile(parts, detectors).to_frame(spark).select("field", "detected_type")


# ------------------------------------------------------------------ profiles


def _rounded(frame: DataFrame, digits: dict[str, int]) -> DataFrame:
    return frame.select(
        *[
            F.round(c, digits[c]).alias(c) if c in digits else F.col(c)
            for c in frame.columns
        ]
    )


PROFILE_DIGITS = {
    "avg_length": 4, "min_value": 4, "max_value": 4, "mean_value": 4, "std_value": 4,
    "completeness_score": 6, "consistency_score": 6, "validity_score": 6,
    "overall_quality_score": 6,
}


def _profile(view: View, spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = profile_frame(view.frame(spark, sf_dir), sample_values=0)
    return _rounded(
        frame.drop("sample_values", "categories", "category_frequencies", "rules"), PROFILE_DIGITS
    )


for _name, _view in W.TABLES.items():
    register(f"profile_{_name}", partial(_profile, _view), O.profile(_view))


def _in_increments(view: View, key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned in three increments, one of them tried twice; the last only reads its own rows and the stored counts."""
    state, frame = ProfileState(scratch_path(spark, "profile-state")), view.frame(spark, sf_dir)
    for part in (0, 1, 1, 2):
        state.add(frame.where(F.pmod(F.xxhash64(key), F.lit(3)) == part), f"day {part}")
    state.compact(spark, most=2)
    found = state.profile(spark).to_frame(spark)
    return _rounded(found.drop("sample_values", "categories", "category_frequencies", "rules"), PROFILE_DIGITS)


register("profile_orders_in_increments", partial(_in_increments, W.TABLES["orders"], "o_orderkey"), O.profile(W.TABLES["orders"]))
register("profile_customer_in_increments", partial(_in_increments, W.TABLES["customer"], "c_custkey"), O.profile(W.TABLES["customer"]))


@query("leading_words", """WITH words AS (SELECT unnest(string_split("text", ' ')) AS value FROM documents),
counted AS (SELECT value, count(*) AS frequency FROM words GROUP BY value)
SELECT 'word' AS field, row_number() OVER (ORDER BY frequency DESC, value) AS position, value, frequency FROM counted QUALIFY position <= 20""")
def _leading_words(spark, sf_dir):
    """The most frequent of very many values, by summaries of the tasks and an exact recount."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    return leading_values(words, capacity=2000).frame


@query("leading_values_lineitem", """WITH cells AS (SELECT 'l_partkey' AS field, CAST(l_partkey AS VARCHAR) AS value FROM lineitem
  UNION ALL SELECT 'l_shipdate', CAST(CAST(l_shipdate AS DATE) AS VARCHAR) FROM lineitem),
counted AS (SELECT field, value, count(*) AS frequency FROM cells GROUP BY ALL)
SELECT field, row_number() OVER (PARTITION BY field ORDER BY frequency DESC, value) AS position, value, frequency FROM counted QUALIFY position <= 20""")
def _leading_lineitem(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("l_shipdate"))
    return leading_values(lines, capacity=300).frame


def _categories(view: View, spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = profile_frame(view.frame(spark, sf_dir), sample_values=0)
    return frame.select(
        "field", F.posexplode("categories").alias("position", "value"), "category_frequencies"
    ).select(
        "field", (F.col("position") + 1).alias("position"), "value",
        F.col("category_frequencies")[F.col("value")].alias("frequency"),
    )


def _rules(view: View, spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = profile_frame(view.frame(spark, sf_dir), sample_values=0).select("field", "rules.*")
    return _rounded(
        rules.withColumn("allowed_values", F.array_join("allowed_values", "|")),
        {"min_value": 4, "max_value": 4},
    ).drop("categorical", "patterns")


for _name in ("lineitem", "documents", "people"):
    _view = W.TABLES[_name]
    register(f"top_categories_{_name}", partial(_categories, _view), O.categories(_view))
    register(f"rules_{_name}", partial(_rules, _view), O.rules(_view))


register("top_categories_tied_long_texts", partial(_categories, W.TIED), O.categories(W.TIED))
register("profile_all_null_column", partial(_profile, W.TIED), O.profile(W.TIED))


def _sample_counts(view: View, spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many distinct samples as asked for, or as there are."""
    found = profile_frame(view.frame(spark, sf_dir), sample_values=10)
    return found.select("field", F.size(F.array_distinct("sample_values")).cast("bigint").alias("samples"))


for _name in ("lineitem", "people", "labels", "nation"):
    _view = W.TABLES[_name]
    register(
        f"sample_counts_{_name}", partial(_sample_counts, _view),
        f"WITH src AS ({_view.sql}), cells AS ({O.cells(_view)}) "
        "SELECT field, least(10, count(DISTINCT v)) AS samples FROM cells GROUP BY field",
    )


@query("sample_values_people", f"""
WITH src AS ({W.PEOPLE.sql}), cells AS ({O.cells(W.PEOPLE)})
SELECT field, count(DISTINCT v) > 0 AS has_samples, TRUE AS all_from_column FROM cells GROUP BY field""")
def _samples(spark, sf_dir):
    """Every sample is a value of its column, and no column with values lacks samples."""
    people = W.PEOPLE.frame(spark, sf_dir)
    samples = profile_frame(people).select("field", F.explode("sample_values").alias("v"))
    texts = spread(people).select(*[F.col(c).cast("string").alias(c) for c in people.columns])
    values = texts.unpivot([], people.columns, "field", "v").distinct().withColumn("found", F.lit(True))
    # at most ten samples per column
    return (
        values.join(F.broadcast(samples), ["field", "v"], "right")
        .groupBy("field")
        .agg(
            (F.count("v") > 0).alias("has_samples"),
            F.bool_and(F.coalesce("found", F.lit(False))).alias("all_from_column"),
        )
    )


@query("learn_on_sample", f"""
WITH {O.profile_ctes(View("(SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000) AS head", W.TABLES["orders"].columns))}
SELECT field, detected_type, total_values, unique_values FROM profile""")
def _learn_sample(spark, sf_dir):
    """Schema learned on the first 1000 records."""
    orders = read(spark, sf_dir, "orders")
    profile = learn_profile(orders, sample_size=1000, order_by="o_orderkey")
    return profile.to_frame(spark).select("field", "detected_type", "total_values", "unique_values")


def _people_profile(spark, sf_dir) -> DataFrame:
    return profile_frame(W.PEOPLE.frame(spark, sf_dir), sample_values=0)


_PEOPLE_CTES = O.profile_ctes(W.PEOPLE)
_FIELD_LEVEL = """CASE WHEN overall_quality_score >= 0.9e0 THEN 'excellent'
  WHEN overall_quality_score >= 0.8e0 THEN 'good' WHEN overall_quality_score >= 0.6e0 THEN 'fair'
  ELSE 'poor' END"""

register(
    "schema_type_counts",
    lambda spark, d: type_counts(_people_profile(spark, d)),
    f"WITH {_PEOPLE_CTES} SELECT detected_type, count(*) AS fields FROM profile GROUP BY detected_type",
)
register(
    "schema_quality_counts",
    lambda spark, d: field_quality_counts(_people_profile(spark, d)),
    f"""WITH {_PEOPLE_CTES}, levelled AS (SELECT {_FIELD_LEVEL} AS quality_level FROM profile)
SELECT l AS quality_level, count(quality_level) AS fields
FROM (SELECT unnest(['excellent', 'good', 'fair', 'poor']) AS l) LEFT JOIN levelled ON l = quality_level
GROUP BY l""",
)
register(
    "schema_field_digest",
    lambda spark, d: _rounded(
        field_digest(_people_profile(spark, d)), {"completeness": 6, "quality_score": 6}
    ).drop("sample_values"),
    f"""WITH {_PEOPLE_CTES} SELECT field, detected_type AS type, nullable, unique_values,
round(completeness_score, 6) AS completeness, round(overall_quality_score, 6) AS quality_score FROM profile""",
)
register(
    "schema_summary",
    lambda spark, d: schema_summary(_people_profile(spark, d)).select(
        "total_fields",
        F.col("field_types")["string"].cast("bigint").alias("string_fields"),
        F.size("field_types").alias("kinds"),
        "quality_distribution.*",
        F.size("fields").alias("digests"),
    ),
    f"""WITH {_PEOPLE_CTES}, levelled AS (SELECT *, {_FIELD_LEVEL} AS l FROM profile)
SELECT count(*) AS total_fields, count(*) FILTER (WHERE detected_type = 'string') AS string_fields,
count(DISTINCT detected_type) AS kinds, count(*) FILTER (WHERE l = 'excellent') AS excellent,
count(*) FILTER (WHERE l = 'good') AS good, count(*) FILTER (WHERE l = 'fair') AS fair,
count(*) FILTER (WHERE l = 'poor') AS poor, count(*) AS digests FROM levelled""",
)


@query("profile_stored_and_loaded", f"WITH {_PEOPLE_CTES} SELECT field, detected_type, nullable FROM profile")
def _stored(spark, sf_dir):
    path = scratch_path(spark, "profile")
    learn_profile(W.PEOPLE.frame(spark, sf_dir)).save(spark, path)
    return TableProfile.load(spark, path).to_frame(spark).select("field", "detected_type", "nullable")


# ------------------------------------------------------------------ cleaning

_DIRTY = View("customer", {
    " customer key ": ("bigint", "c_custkey"),
    "full name": ("string", W.PEOPLE.columns["full_name"][1]),
    "mkt segment": ("string", "CASE WHEN c_custkey % 23 IN (1, 2, 3, 5) THEN NULL WHEN c_custkey % 6 = 0 "
                              "THEN '<NA>' WHEN c_custkey % 6 = 1 THEN '  ' ELSE ' ' || c_mktsegment END"),
})
_CLEANED = f"""WITH src AS ({_DIRTY.sql}),
nulled AS (SELECT " customer key " AS customer_key,
  CASE WHEN "full name" IN ('', 'NULL', 'null', 'None') THEN NULL ELSE trim("full name") END AS full_name,
  CASE WHEN "mkt segment" IN ('', 'NULL', 'null', 'None') THEN NULL ELSE trim("mkt segment") END AS mkt_segment
  FROM src),
cleaned AS (SELECT customer_key,
  CASE WHEN full_name IN ('nan', 'None', '<NA>') THEN NULL ELSE full_name END AS full_name,
  CASE WHEN mkt_segment IN ('nan', 'None', '<NA>') THEN NULL ELSE mkt_segment END AS mkt_segment
  FROM nulled)"""

register("clean_table", lambda s, d: C.clean(_DIRTY.frame(s, d)), f"{_CLEANED} SELECT * FROM cleaned")
register(
    "clean_and_drop_empty_rows",
    lambda s, d: C.to_records(_DIRTY.frame(s, d).select("full name", "mkt segment")),
    f"{_CLEANED} SELECT full_name, mkt_segment FROM cleaned "
    "WHERE full_name IS NOT NULL OR mkt_segment IS NOT NULL",
)
register(
    "standardize_column_names",
    lambda s, d: C.standardize_names(_DIRTY.frame(s, d)).select("customer_key", "full_name"),
    f'SELECT " customer key " AS customer_key, "full name" AS full_name FROM ({_DIRTY.sql})',
)


@query("flatten_nested", """
SELECT o_orderkey AS "key", o_custkey AS "who.customer", o_orderstatus AS "who.state.code",
o_totalprice AS "amount" FROM orders""")
def _flatten(spark, sf_dir):
    nested = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.struct(
            F.col("o_custkey").alias("customer"),
            F.struct(F.col("o_orderstatus").alias("code")).alias("state"),
        ).alias("who"),
        F.col("o_totalprice").alias("amount"),
    )
    return C.flatten(nested)


@query("record_positions", "SELECT count(*) AS rows, count(*) - 1 AS last, 0 AS first FROM lineitem")
def _positions(spark, sf_dir):
    """Positions are dense and start at zero."""
    lines = V.with_position(read(spark, sf_dir, "lineitem").select("l_orderkey"))
    return lines.agg(
        F.count_distinct("_position").alias("rows"), F.max("_position").alias("last"),
        F.min("_position").cast("int").alias("first"),
    )


# ------------------------------------------------------------------ validation


def _validated(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    rows = W.DIRTY_CUSTOMERS.frame(spark, sf_dir)
    return V.validate(rows, W.CUSTOMER_PROFILE, record_id="c_custkey", **options)


_V = O.validated(W.DIRTY_CUSTOMERS, W.CUSTOMER_PROFILE, "c_custkey")


def _verdicts(validated: DataFrame) -> DataFrame:
    return validated.select(
        F.col("_record_id").alias("record_id"),
        F.round("_quality_score", 6).alias("score"),
        F.col("_is_valid").alias("is_valid"),
        F.col("_quality_level").alias("level"),
        F.array_join("_errors", "; ").alias("errors"),
        F.array_join("_warnings", "; ").alias("warnings"),
    )


_VERDICTS = ("SELECT record_id, round(score, 6) AS score, is_valid, level, "
             "array_to_string(errors, '; ') AS errors, array_to_string(warnings, '; ') AS warnings "
             "FROM validated")

register("validate_customers", lambda s, d: _verdicts(_validated(s, d)), f"WITH {_V} {_VERDICTS}")
register(
    "validate_every_rule",
    lambda s, d: _verdicts(
        V.validate(W.VALIDATED_PEOPLE.frame(s, d), W.PEOPLE_PROFILE, record_id="id")
    ),
    f"WITH {O.validated(W.VALIDATED_PEOPLE, W.PEOPLE_PROFILE, 'id')} {_VERDICTS}",
)

_LEARNED_FIELDS = {
    "email": "email", "phone": "phone", "day": "date", "extra": "string", "tier": "categorical",
    "real": "float", "full_name": "string", "postal": "postal_code",
}


def _learned_rows():
    """Rules whose numbers are scalar subqueries over the learned rules."""
    rows = []
    for name, kind in _LEARNED_FIELDS.items():
        at = f"FROM rules WHERE field = '{name}'"
        rules: dict = {}
        if kind in ("string", "email", "phone", "url"):
            rules |= {k: f"(SELECT {k} {at})" for k in ("min_length", "max_length")}
        if kind in ("integer", "float"):
            rules |= {k: f"(SELECT {k} {at})" for k in ("min_value", "max_value")}
        rules["allowed_values"] = f"SELECT v FROM leaders WHERE field = '{name}'"
        if kind in O.PATTERNS:
            rules["patterns"] = O.PATTERNS[kind]
        rows.append(W.declared(name, kind, nullable=name in ("full_name", "tier"), **rules))
    return rows


_LEARNED_VIEW = W.PEOPLE.only("id", *_LEARNED_FIELDS)


def _validate_learned(spark, sf_dir):
    people = _LEARNED_VIEW.frame(spark, sf_dir)
    profile = learn_profile(people.drop("id"))
    judged = V.validate(people, profile, record_id="id")
    return judged.select(
        F.col("_record_id").alias("record_id"),
        F.round("_quality_score", 6).alias("score"),
        F.col("_is_valid").alias("is_valid"),
        F.size("_errors").alias("errors"),
        F.size(F.array_distinct("_issues.field")).alias("bad_fields"),
    )


# ------------------------------------------------------------------ splits and statistics

def _split(which: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    validated = _validated(spark, sf_dir)
    high, low = V.split_by_quality(validated)
    rows = {
        "good": V.good_rows(validated), "bad": V.bad_rows(validated), "high": high, "low": low,
    }[which]
    return rows.select(
        F.col("_record_id").alias("record_id"), F.round("_quality_score", 6).alias("score")
    )


for _which, _where in {
    "good": "is_valid", "bad": "NOT is_valid", "high": "is_valid AND score >= 0.8e0",
    "low": "NOT (is_valid AND score >= 0.8e0)",
}.items():
    register(
        f"{_which}_quality_rows" if _which in ("high", "low") else f"{_which}_rows",
        partial(_split, _which),
        f"WITH {_V} SELECT record_id, round(score, 6) AS score FROM validated WHERE {_where}",
    )

_ROUND_RATE = {"success_rate": 6}
_COUNTS = ", ".join(["total_records", "valid_records", "invalid_records"] + [f"{n}_quality" for n in QUALITY_LEVELS])

register(
    "run_statistics",
    lambda s, d: _rounded(R.run_statistics(_validated(s, d), 0.8), _ROUND_RATE),
    f"WITH {_V}, {O.STATS} SELECT {_COUNTS}, high_quality_count, low_quality_count, "
    "round(success_rate, 6) AS success_rate FROM stats",
)
register(
    "level_counts_all_rows",
    lambda s, d: R.level_counts(_validated(s, d)),
    f"WITH {_V} SELECT l AS quality_level, count(level) AS records FROM "
    "(SELECT unnest(['excellent', 'good', 'fair', 'poor']) AS l) LEFT JOIN validated ON l = level GROUP BY l",
)
register(
    "quality_distribution",
    lambda s, d: _rounded(R.quality_distribution(_validated(s, d)), {"percentage": 6}),
    f"""WITH {_V}, {O.STATS}, unrolled AS (
  SELECT unnest(['excellent', 'good', 'fair', 'poor']) AS quality_level,
    unnest([excellent_quality, good_quality, fair_quality, poor_quality]) AS records, valid_records FROM stats)
SELECT quality_level, records, round(CAST(records AS DOUBLE) / valid_records * 100, 6) AS percentage
FROM unrolled WHERE valid_records > 0""",
)
register(
    "error_patterns",
    lambda s, d: R.error_patterns(V.validate(W.VALIDATED_PEOPLE.frame(s, d), W.PEOPLE_PROFILE, "id")),
    f"WITH {O.validated(W.VALIDATED_PEOPLE, W.PEOPLE_PROFILE, 'id')}, {O.PATTERN_COUNTS} "
    "SELECT pattern, errors FROM patterns ORDER BY errors DESC, pattern LIMIT 10",
)
register(
    "most_problematic_field",
    lambda s, d: R.most_problematic_field(_validated(s, d)),
    f"WITH {_V}, {O.PATTERN_COUNTS} SELECT split_part(pattern, '''', 2) AS field, errors FROM patterns "
    "ORDER BY errors DESC, pattern LIMIT 1",
)
register(
    "validation_details",
    lambda s, d: R.validation_details(_validated(s, d)).withColumnRenamed("_record_id", "record_id"),
    f"WITH {_V} SELECT record_id, CASE WHEN is_valid THEN 'Valid' ELSE 'Invalid' END AS status, "
    "round(score, 2) AS quality_score, len(errors) AS errors, len(warnings) AS warnings "
    "FROM validated ORDER BY record_id LIMIT 10",
)
register(
    "first_invalid_records",
    lambda s, d: R.first_errors(_validated(s, d)).select(
        F.col("_record_id").alias("record_id"),
        F.col("original_data.c_name").alias("c_name"),
        F.array_join("errors", "; ").alias("errors"),
        F.array_join("warnings", "; ").alias("warnings"),
        F.round("quality_score", 6).alias("quality_score"),
        F.round(F.col("field_scores")["c_name"], 6).alias("name_score"),
    ),
    f"""WITH {_V} SELECT record_id, c_name, array_to_string(errors, '; ') AS errors,
array_to_string(warnings, '; ') AS warnings, round(score, 6) AS quality_score,
round({O._field('c_name', W.CUSTOMER_PROFILE['c_name'], 'string')[0]}, 6) AS name_score
FROM validated WHERE NOT is_valid ORDER BY record_id LIMIT 50""",
)
register(
    "summary_metrics",
    lambda s, d: _rounded(
        R.summary_metrics(R.run_statistics(_validated(s, d)), 2.5),
        {"success_rate": 6, "records_per_second": 6},
    ),
    f"""WITH {_V}, {O.STATS} SELECT total_records, valid_records, invalid_records,
round(success_rate, 6) AS success_rate, CASE WHEN success_rate >= 90 THEN 'success'
WHEN success_rate >= 70 THEN 'warning' ELSE 'error' END AS success_class,
2.5e0 AS processing_duration, round(total_records / 2.5e0, 6) AS records_per_second FROM stats""",
)
_INSIGHT_LIST = """SELECT CAST(generate_subscripts(l, 1) AS INTEGER) AS position, unnest(l) AS insight FROM listed"""
register(
    "validator_insights",
    lambda s, d: R.validator_insights(_validated(s, d), W.CUSTOMER_PROFILE),
    f"""WITH {_V}, {O.STATS}, {O.PATTERN_COUNTS}, listed AS (SELECT list_filter([
  'Automatically detected 7 fields with 5 different data types',
  'Most common data type: currency (2 fields)',
  CASE WHEN success_rate >= 95 THEN 'Excellent data quality - very high success rate with intelligent validation'
    WHEN success_rate >= 80 THEN 'Good data quality - acceptable success rate'
    WHEN success_rate >= 60 THEN 'Fair data quality - consider data source review'
    ELSE 'Poor data quality - immediate attention required' END,
  CASE WHEN CAST(excellent_quality AS DOUBLE) / valid_records * 100 >= 80
    THEN 'Majority of valid records have excellent quality scores'
    WHEN CAST(poor_quality AS DOUBLE) / valid_records * 100 >= 30
    THEN 'High percentage of poor quality records among valid data' END,
  (SELECT 'Most problematic field: ''' || split_part(pattern, '''', 2) || ''' with ' || errors || ' validation issues'
    FROM patterns ORDER BY errors DESC, pattern LIMIT 1)], lambda x: x IS NOT NULL) AS l FROM stats)
{_INSIGHT_LIST}""",
)
register(
    "reporter_insights",
    lambda s, d: R.reporter_insights(_validated(s, d), 2.5),
    f"""WITH {_V}, {O.STATS}, {O.PATTERN_COUNTS},
top AS (SELECT pattern, errors FROM patterns ORDER BY errors DESC, pattern LIMIT 1),
listed AS (SELECT list_filter([
  CASE WHEN success_rate >= 95 THEN 'Excellent data quality with very high success rate'
    WHEN success_rate >= 85 THEN 'Good data quality with acceptable success rate'
    WHEN success_rate >= 70 THEN 'Fair data quality - consider data source review'
    ELSE 'Poor data quality - immediate attention required' END,
  CASE WHEN CAST(excellent_quality AS DOUBLE) / valid_records * 100 >= 80
    THEN 'Majority of valid records have excellent quality scores'
    WHEN CAST(poor_quality AS DOUBLE) / valid_records * 100 >= 30
    THEN 'High percentage of poor quality records - review data collection processes' END,
  CASE WHEN CAST(excellent_quality + good_quality AS DOUBLE) / valid_records * 100 >= 90
    THEN 'Strong overall data quality suitable for production use' END,
  CASE WHEN total_records / 2.5e0 >= 1000 THEN 'High processing throughput achieved'
    WHEN total_records / 2.5e0 < 100 THEN 'Low processing throughput - consider optimization' END,
  (SELECT 'Most common validation issue: ' || pattern FROM top),
  CASE WHEN CAST((SELECT errors FROM top) AS DOUBLE) / invalid_records > 0.5
    THEN 'Over 50% of errors are related to ' || (SELECT pattern FROM top) || ' - focus on fixing this issue' END
  ], lambda x: x IS NOT NULL) AS l FROM stats)
{_INSIGHT_LIST}""",
)


@query("validation_report", f"""WITH {_V}, {O.STATS} SELECT total_records, valid_records, invalid_records,
printf('%.2f%%', success_rate) AS success_rate, TRUE AS schema_learned,
excellent_quality AS excellent, good_quality AS good, fair_quality AS fair, poor_quality AS poor,
least(50, invalid_records) AS listed_errors FROM stats""")
def _report(spark, sf_dir):
    """The report as written and read back as JSON."""
    path = scratch_path(spark, "report")
    write_json_row(R.validation_report(_validated(spark, sf_dir), W.CUSTOMER_PROFILE, 1.0), path)
    return spark.read.json(path).select(
        "summary.total_records", "summary.valid_records", "summary.invalid_records",
        "summary.success_rate", "summary.schema_learned", "quality_distribution.*",
        F.size("validation_errors").cast("bigint").alias("listed_errors"),
    )


@query("processing_summary", f"""WITH {_V}, {O.STATS} SELECT total_records, valid_records,
invalid_records, printf('%.2f%%', success_rate) AS success_rate, '2.50s' AS processing_duration,
round(total_records / 2.5e0, 6) AS records_per_second, excellent_quality, good_quality,
fair_quality, poor_quality, high_quality_count, low_quality_count, valid_records AS good_data_count,
invalid_records AS bad_data_count, 0.8e0 AS quality_threshold FROM stats""")
def _summary(spark, sf_dir):
    path = scratch_path(spark, "summary")
    write_json_row(R.processing_summary(_validated(spark, sf_dir), 0.8, 2.5), path)
    row = spark.read.json(path).select("processing_summary.*", "quality_metrics.*", "data_splits.*")
    return _rounded(row, {"records_per_second": 6})


register(
    "quality_levels",
    lambda s, d: _validated(s, d).groupBy(F.col("_quality_level").alias("level"), F.col("_is_valid").alias("is_valid"))
    .agg(F.count(F.lit(1)).alias("records")),
    f"WITH {_V} SELECT level, is_valid, count(*) AS records FROM validated GROUP BY level, is_valid",
)
register(
    "error_messages",
    lambda s, d: _validated(s, d).select(F.explode("_errors").alias("error")).groupBy("error")
    .agg(F.count(F.lit(1)).alias("n")),
    f"WITH {_V} SELECT error, count(*) AS n FROM (SELECT unnest(errors) AS error FROM validated) GROUP BY error",
)
register(
    "review_warnings",
    lambda s, d: _validated(s, d, review_warnings=True).select(F.explode("_warnings").alias("warning"))
    .groupBy("warning").agg(F.count(F.lit(1)).alias("n")),
    f"""WITH {_V}, reviewed AS (SELECT list_concat(warnings, list_filter([
  CASE WHEN score < 0.8e0 THEN printf('Data quality score is %.2f - consider reviewing', score) END,
  CASE WHEN score < 0.6e0 THEN 'Poor data quality detected - manual review recommended' END],
  lambda x: x IS NOT NULL)) AS w FROM validated)
SELECT warning, count(*) AS n FROM (SELECT unnest(w) AS warning FROM reviewed) GROUP BY warning""",
)
register(
    "validated_data",
    lambda s, d: V.with_validated_data(_validated(s, d)).select(
        F.col("_record_id").alias("record_id"), F.col("_validated_data.c_name").alias("valid_name")
    ),
    f"WITH {_V} SELECT record_id, CASE WHEN is_valid THEN c_name END AS valid_name FROM validated",
)
register(
    "source_file_after_validation",
    lambda s, d: _validated(s, d, source_file="customers.csv").groupBy(F.col("_source_file").alias("source_file"))
    .agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("_is_valid")).alias("valid")),
    f"WITH {_V} SELECT 'customers.csv' AS source_file, count(*) AS records, "
    "count(*) FILTER (WHERE is_valid) AS valid FROM validated",
)
_DRIFT = W.declared_profile([
    W.declared("c_custkey", "currency"), W.declared("c_fax", "phone"),
    W.declared("c_memo", "string", nullable=True),
])
register(
    "schema_drift",
    lambda s, d: _verdicts(V.validate(read(s, d, "customer"), _DRIFT, "c_custkey")),
    f"WITH {O.validated(W.TABLES['customer'], _DRIFT, 'c_custkey')} {_VERDICTS}",
)
register(
    "validate_learned_profile",
    _validate_learned,
    # the CTEs of the profile and of the validation share one statement
    f"""WITH {O.profile_ctes(_LEARNED_VIEW.only(*_LEARNED_FIELDS))} {O.RULES},
{O.validated(_LEARNED_VIEW, _learned_rows(), 'id')}
SELECT record_id, round(score, 6) AS score, is_valid, len(errors) AS errors,
len(list_distinct(list_transform(errors, lambda e: split_part(e, ':', 1)))) AS bad_fields FROM validated""",
)


@query("accumulate_batches", f"""WITH {_V} SELECT is_valid, batch, count(*) AS records
FROM (SELECT is_valid, CASE WHEN record_id % 2 = 0 THEN 'even' ELSE 'odd' END AS batch FROM validated)
GROUP BY is_valid, batch""")
def _accumulate(spark, sf_dir):
    """Two validated batches, one without a column the other has."""
    validated = _validated(spark, sf_dir)
    even = validated.where("_record_id % 2 = 0").withColumn("batch", F.lit("even"))
    odd = validated.where("_record_id % 2 <> 0").drop("c_name").withColumn("batch", F.lit("odd"))
    return V.accumulate([even, odd]).groupBy(F.col("_is_valid").alias("is_valid"), "batch").agg(
        F.count(F.lit(1)).alias("records")
    )


# ------------------------------------------------------------------ contract and model

_CONTRACT = K.Contract.from_dict({
    "fields": {
        "OrderID": {"dtype": "integer", "nullable": False},
        "CustomerID": {"dtype": "string", "nullable": False, "regex": "^[A-Z0-9]{5}$"},
        "EmployeeID": {"dtype": "integer", "nullable": False},
        "OrderDate": {"dtype": "string", "nullable": False, "regex": r"^\d{4}-\d{2}-\d{2}$"},
        "ShippedDate": {"dtype": "string", "nullable": True, "regex": r"^\d{4}-\d{2}-\d{2}$"},
        "Freight": {"dtype": "float", "nullable": False},
        "ShipCity": {"dtype": "string", "nullable": False},
    },
    "primary_key": "OrderID",
})
_ORDERS = f"WITH src AS ({W.DIRTY_ORDERS.sql})"
register(
    "contract_breaches",
    lambda s, d: K.breach_counts(K.check_contract(W.DIRTY_ORDERS.frame(s, d), _CONTRACT)),
    f"""{_ORDERS}, broken AS (
SELECT 'CustomerID' AS field, 'nullable' AS rule, count(*) AS rows FROM src WHERE "CustomerID" IS NULL UNION ALL
SELECT 'CustomerID', 'regex', count(*) FROM src WHERE NOT regexp_matches("CustomerID", '^[A-Z0-9]{{5}}$') UNION ALL
SELECT 'EmployeeID', 'dtype', count(*) FROM src WHERE "EmployeeID" IS NOT NULL AND TRY_CAST("EmployeeID" AS BIGINT) IS NULL UNION ALL
SELECT 'ShippedDate', 'regex', count(*) FROM src WHERE NOT regexp_matches("ShippedDate", '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') UNION ALL
SELECT 'Freight', 'nullable', count(*) FROM src WHERE "Freight" IS NULL UNION ALL
SELECT 'ShipCity', 'missing', count(*) FROM src) SELECT * FROM broken WHERE rows > 0""",
)
register(
    "contract_duplicate_keys",
    lambda s, d: K.duplicate_keys(W.DIRTY_ORDERS.frame(s, d), _CONTRACT),
    f'{_ORDERS} SELECT "OrderID", count(*) AS copies FROM src GROUP BY "OrderID" HAVING count(*) > 1',
)
_LACKS = " OR ".join(f'"{c}" IS NULL' for c in W.DIRTY_ORDERS.columns if c != "ShipRegion")
_ROUTED = f"""{_ORDERS}, routed AS (SELECT *, CASE WHEN {_LACKS} THEN 'violation'
WHEN "Freight" < 0 OR "ShippedDate" < "OrderDate" THEN 'quarantine' ELSE 'accepted' END AS status FROM src)"""
register(
    "route_orders",
    lambda s, d: K.route_orders(W.DIRTY_ORDERS.frame(s, d)).select("OrderID", "CustomerID", "Freight", "status"),
    f'{_ROUTED} SELECT "OrderID", "CustomerID", "Freight", status FROM routed',
)
register(
    "routed_counts",
    lambda s, d: K.route_orders(W.DIRTY_ORDERS.frame(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("orders")),
    f"{_ROUTED} SELECT status, count(*) AS orders FROM routed GROUP BY status",
)

# Types are told by detectors, so spellings that only a cast takes are breaches, whatever their length.
_TYPED = View("orders", {
    "amount": ("string", "CASE WHEN o_orderkey % 500 = 2 THEN '1' || repeat('_1', 50000) WHEN o_orderkey % 5 = 0 THEN '1.0d' "
                         "WHEN o_orderkey % 5 = 1 THEN '0x1.0p3' WHEN o_orderkey % 5 = 3 THEN 'n/a' "
                         "ELSE CAST(o_orderkey AS STRING) || '.5' END"),
    "pieces": ("string", "CASE WHEN o_orderkey % 500 = 4 THEN '7' || repeat('_7', 50000) || CASE WHEN o_orderkey % 1000 = 4 THEN 'x' ELSE '' END "
                         "WHEN o_orderkey % 4 = 1 THEN '1__0' WHEN o_orderkey % 4 = 2 THEN '3.0' ELSE CAST(o_orderkey AS STRING) END"),
    "day": ("string", "CASE o_orderkey % 3 WHEN 0 THEN '2025-02-30' WHEN 1 THEN '12/31/2025' ELSE '31-12-2025' END"),
    "moment": ("string", "CASE o_orderkey % 3 WHEN 0 THEN '2025-02-03 04:05:06' WHEN 1 THEN 'zz' ELSE '2025-02-03' END"),
})
_TYPED_CONTRACT = K.Contract.from_dict({"fields": {
    "amount": {"dtype": "float"}, "pieces": {"dtype": "integer"}, "day": {"dtype": "date"}, "moment": {"dtype": "datetime"}}})
register(
    "contract_types",
    lambda s, d: K.breach_counts(K.check_contract(_TYPED.frame(s, d), _TYPED_CONTRACT)),
    f"WITH src AS ({_TYPED.sql}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS field, 'dtype' AS rule, count(*) AS rows FROM src WHERE NOT {test} HAVING count(*) > 0"
        for c, test in (("amount", f"regexp_matches(amount, {O.quote(O.FLOAT_TEXT)})"), ("pieces", O.is_type("integer", "pieces")),
                        ("day", O.is_type("date", "day")), ("moment", O.is_type("datetime", "moment")))),
)


@query("route_orders_by_date", """SELECT o_orderkey AS "OrderID", CASE WHEN o_orderkey % 7 < 2 THEN 'quarantine' ELSE 'accepted' END AS status FROM orders""")
def _route_dates(spark, sf_dir):
    """Dates as months first, shipped two days before to four days after the order: compared as dates, not as texts."""
    shipped = F.date_add("o_orderdate", (F.col("o_orderkey") % 7 - 2).cast("int"))
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("OrderID"), F.date_format("o_orderdate", "M/d/yyyy").alias("OrderDate"),
        F.date_format(shipped, "M/d/yyyy").alias("ShippedDate"), F.lit("1.5").alias("Freight"),
    )
    return K.route_orders(orders).select("OrderID", "status")


@query("write_routed_orders", f"{_ROUTED} SELECT status, count(*) AS orders FROM routed GROUP BY status")
def _write_routed(spark, sf_dir):
    """The three routed sets, written and read again."""
    written = K.write_routed(K.route_orders(W.DIRTY_ORDERS.frame(spark, sf_dir)), scratch_path(spark, "routed"), "parquet")
    parts = [S.load(spark, path).select("status") for path in written.values()]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("status").agg(F.count(F.lit(1)).alias("orders"))


_LEN = {n: f'length("{a}")' for n, a in M.FIELD_ALIASES.items()}


def _model_error(name: str) -> str:
    """SQL: the first error of a model field, or null."""
    column = f'"{M.FIELD_ALIASES[name]}"'
    checks = []

    def add(condition: str, what: str) -> None:
        checks.append(f"WHEN {condition} THEN {O.quote(f'Field {chr(39)}{name}{chr(39)}: {what}')}")

    if name != "region":
        add(f"{column} IS NULL", "Required field is missing")
    if name in M.LENGTHS:
        low, high = M.LENGTHS[name]
        add(f"length({column}) < {low}", f"Value too short (min: {low})")
        add(f"length({column}) > {high}", f"Value too long (max: {high})")
    if name in ("customer_id", "contact_name", "company_name"):
        add(f"trim({column}) = ''", "Value cannot be empty after trimming")
    if name == "postal_code":
        add(f"length(trim({column})) < 3", "Postal code must be at least 3 characters")
    if name == "segment":
        add(f"{column} = ''", "Segment is required")
    return f"CASE {' '.join(checks)} END"


_SEGMENT = """CASE trim("Segment") WHEN 'healthcare' THEN 'Healthcare' WHEN 'GOVERNMENT' THEN 'Government'
WHEN 'retail' THEN 'Retail' WHEN 'o-neils retail' THEN 'O-Neils Retail' ELSE trim("Segment") END"""
_KNOWN = f"({_SEGMENT}) IN ({', '.join(O.quote(x) for x in M.SEGMENTS)})"
_MODEL = f"""WITH src AS ({W.MODEL_CUSTOMERS.sql}), model AS (
SELECT upper(trim("CustomerID")) AS customer_id, trim("CompanyName") AS company_name,
  trim("ContactName") AS contact_name, "ContactTitle" AS contact_title, "City" AS city, "Region" AS region,
  trim("PostalCode") AS postal_code, "Country" AS country, {_SEGMENT} AS segment,
  CASE WHEN lower(trim("MetroArea")) IN ('true', 'yes', '1', 'y') THEN TRUE
    WHEN lower(trim("MetroArea")) IN ('false', 'no', '0', 'n') THEN FALSE END AS metro_area,
  "MetroArea" AS metro_area_text,
  list_filter([{', '.join(_model_error(n) for n in M.FIELD_ALIASES)}], lambda x: x IS NOT NULL) AS errors,
  coalesce({_KNOWN}, FALSE) AS known_segment FROM src),
scored AS (SELECT *, ({' + '.join(f"CASE WHEN length(trim({n})) > 0 THEN 1 ELSE 0 END" for n in
  ['customer_id', 'company_name', 'contact_name', 'city', 'postal_code', 'country', 'region', 'contact_title'])}
  + CASE WHEN length(customer_id) >= 3 THEN 1 ELSE 0 END + CASE WHEN length(postal_code) >= 5 THEN 1 ELSE 0 END
  + CASE WHEN known_segment THEN 1 ELSE 0 END) / 10e0 AS score FROM model)"""
register(
    "customer_model_fields",
    lambda s, d: M.customer_records(W.MODEL_CUSTOMERS.frame(s, d)).select(*M.FIELD_ALIASES, "metro_area_text"),
    f"{_MODEL} SELECT {', '.join(M.FIELD_ALIASES)}, metro_area_text FROM scored",
)
register(
    "customer_model_scores",
    lambda s, d: M.customer_records(W.MODEL_CUSTOMERS.frame(s, d)).select(
        "company_name", F.array_join("_errors", "; ").alias("errors"), F.col("_is_valid").alias("is_valid"),
        F.col("_known_segment").alias("known_segment"), F.col("_quality_score").alias("score"),
        F.col("_quality_level").alias("level"),
    ),
    f"""{_MODEL} SELECT company_name, array_to_string(errors, '; ') AS errors, len(errors) = 0 AS is_valid,
known_segment, score, CASE WHEN score >= 0.9e0 THEN 'excellent' WHEN score >= 0.8e0 THEN 'good'
WHEN score >= 0.6e0 THEN 'fair' ELSE 'poor' END AS level FROM scored""",
)
register(
    "customer_model_without_renaming",
    lambda s, d: M.customer_records(W.MODEL_CUSTOMERS.frame(s, d), rename=False).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("_is_valid")).alias("valid")
    ),
    # of the aliased names only those that differ from the model's by case alone are found
    f"""WITH src AS ({W.MODEL_CUSTOMERS.sql}) SELECT count(*) AS records, 0 AS valid FROM src""",
)


# ------------------------------------------------------------------ job log

_JOBS = f"WITH jobs AS ({W.JOBS.sql}), done AS (SELECT * FROM jobs WHERE status = 'completed')"
register(
    "job_statistics",
    lambda s, d: _rounded(J.job_statistics(W.JOBS.frame(s, d)), _ROUND_RATE),
    f"""{_JOBS} SELECT count(*) AS total_jobs, count(*) FILTER (WHERE status = 'completed') AS completed_jobs,
count(*) FILTER (WHERE status = 'failed') AS failed_jobs, count(*) FILTER (WHERE status = 'running') AS running_jobs,
CAST(sum(total_records) FILTER (WHERE status = 'completed') AS BIGINT) AS total_records,
CAST(sum(valid_records) FILTER (WHERE status = 'completed') AS BIGINT) AS valid_records,
CAST(sum(invalid_records) FILTER (WHERE status = 'completed') AS BIGINT) AS invalid_records,
round(CAST(sum(valid_records) FILTER (WHERE status = 'completed') AS DOUBLE)
  / CAST(sum(total_records) FILTER (WHERE status = 'completed') AS DOUBLE) * 100, 6) AS success_rate FROM jobs""",
)
_QUARANTINE = f"""{_JOBS}, quarantined AS (SELECT job_id AS id, filename,
'Validation failed: ' || invalid_records || ' invalid records' AS reason,
CASE WHEN invalid_records > total_records * 0.1 THEN 'high' ELSE 'medium' END AS severity,
invalid_records AS records, total_records, updated_at AS quarantine_date,
CAST(greatest(0, 100 - floor(round(success_rate, 2))) AS BIGINT) AS risk_score
FROM done WHERE invalid_records > 0)"""
register("quarantined_jobs", lambda s, d: J.quarantined_jobs(W.JOBS.frame(s, d)),
         f"{_QUARANTINE} SELECT * FROM quarantined")
register(
    "results_overview",
    lambda s, d: J.results_overview(W.JOBS.frame(s, d)),
    f"""{_JOBS} SELECT count(*) FILTER (WHERE status = 'completed') AS completed_jobs,
count(*) FILTER (WHERE status = 'failed') AS failed_jobs,
count(*) FILTER (WHERE status IN ('running', 'pending')) AS running_jobs,
CAST(round(avg(round(success_rate, 2)) FILTER (WHERE status = 'completed')) AS BIGINT) AS average_quality_score,
CAST(sum(invalid_records) AS BIGINT) AS total_issues FROM jobs""",
)
register(
    "risk_overview",
    lambda s, d: J.risk_overview(J.quarantined_jobs(W.JOBS.frame(s, d))),
    f"""{_QUARANTINE} SELECT count(*) AS items, count(*) FILTER (WHERE risk_score >= 80) AS high_risk_items,
count(*) FILTER (WHERE risk_score >= 50 AND risk_score < 80) AS medium_risk_items,
count(*) FILTER (WHERE risk_score < 50) AS low_risk_items, CAST(sum(records) AS BIGINT) AS quarantined_records
FROM quarantined""",
)
register(
    "risk_buckets",
    lambda s, d: J.with_risk_bucket(J.quarantined_jobs(W.JOBS.frame(s, d))).select("id", "risk_score", "risk_bucket"),
    f"""{_QUARANTINE} SELECT id, risk_score, CASE WHEN risk_score >= 80 THEN 'HIGH' WHEN risk_score >= 50
THEN 'MEDIUM' ELSE 'LOW' END AS risk_bucket FROM quarantined""",
)
register("high_risk_jobs", lambda s, d: J.high_risk(J.quarantined_jobs(W.JOBS.frame(s, d))),
         f"{_QUARANTINE} SELECT * FROM quarantined WHERE risk_score >= 80")
register(
    "newest_jobs",
    lambda s, d: J.newest_jobs(W.JOBS.frame(s, d)).select("job_id", "created_at", "status"),
    f"{_JOBS} SELECT job_id, created_at, status FROM jobs",
)
register(
    "recent_jobs",
    lambda s, d: J.newest_jobs(W.JOBS.frame(s, d), J.RECENT_JOBS).select("job_id", "created_at", "status"),
    f"{_JOBS} SELECT job_id, created_at, status FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 5",
)


@query("quality_trend", """SELECT date_trunc('year', o_orderdate) AS processing_start_time,
count(*) AS total_records, round(CAST(count(*) FILTER (WHERE o_totalprice >= 100000) AS DOUBLE)
  / count(*) * 100, 6) AS success_rate FROM orders GROUP BY 1""")
def _trend(spark, sf_dir):
    """One run per year of orders, appended to a history table."""
    path = scratch_path(spark, "history")
    runs = read(spark, sf_dir, "orders").groupBy(
        F.date_trunc("year", "o_orderdate").alias("started")
    ).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col("o_totalprice") >= 100000).alias("valid_records"),
        F.count_if(F.col("o_totalprice") < 100000).alias("invalid_records"),
    )
    stats = runs.withColumn(
        "success_rate", R.success_rate(F.col("valid_records"), F.col("total_records"))
    )
    for _ in range(2):  # the second time, as after a failure, adds nothing
        R.append_run(stats, path, F.col("started"), run_id=F.date_format("started", "yyyy"))
    return _rounded(R.quality_trend(R.run_history(spark, path)), _ROUND_RATE)


# ------------------------------------------------------------------ sources and sinks


def _text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as they come in a delimited file."""
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("key"),
        F.expr("CASE c_custkey % 9 WHEN 0 THEN 'NULL' WHEN 1 THEN 'n/a' WHEN 2 THEN '#N/A' WHEN 3 THEN 'NaN' "
               "WHEN 4 THEN '<NA>' WHEN 5 THEN '' ELSE c_name END").alias("name"),
        F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE CAST(c_nationkey AS STRING) END").alias("nation"),
        F.col("c_acctbal").cast("string").alias("balance"),
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'TRUE' ELSE 'False' END").alias("even"),
        F.concat(F.lit("A, \"quoted\" "), "c_mktsegment").alias("note"),
    )


_FILE_ROWS = """SELECT c_custkey AS "key", CASE WHEN c_custkey % 9 <= 5 THEN NULL ELSE c_name END AS name,
CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS nation, c_acctbal AS balance,
c_custkey % 2 = 0 AS even, 'A, "quoted" ' || c_mktsegment AS note FROM customer"""


def _delimited(spark, sf_dir, sep: str, extension: str, encoding: str = "UTF-8") -> str:
    path = scratch_path(spark, "table") + f".{extension}"
    writer = _text_table(spark, sf_dir).write.option("header", True).option("sep", sep)
    writer.option("encoding", encoding).option("escape", '"').option("emptyValue", "").csv(path)
    return path


register("read_csv_null_tokens_and_types",
         lambda s, d: S.load(s, _delimited(s, d, ",", "csv"), encoding="UTF-8"), _FILE_ROWS)
register("read_tsv", lambda s, d: S.load(s, _delimited(s, d, "\t", "tsv")), _FILE_ROWS)
register("read_text_with_delimiter",
         lambda s, d: S.load(s, _delimited(s, d, "|", "txt"), delimiter="|"), _FILE_ROWS)


@query("read_csv_separator_fallback", """SELECT c_custkey AS "key", c_name AS name,
c_name || ', ' || c_mktsegment AS note FROM customer""")
def _fallback(spark, sf_dir):
    """Under ',' some rows have too many fields, so ';' is found."""
    path = scratch_path(spark, "table") + ".csv"
    read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.concat_ws(", ", "c_name", "c_mktsegment").alias("note"),
    ).write.option("header", True).option("sep", ";").csv(path)
    return S.load(spark, path)


@query("read_csv_reader_options", """SELECT c_custkey AS "key", CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name FROM customer""")
def _reader_options(spark, sf_dir):
    """Options of the caller reach the parser: another separator, a null mark of its own, lines that are comments."""
    path = scratch_path(spark, "options") + ".csv"
    key = F.col("c_custkey")
    line = F.concat(F.when(key % 5 == 0, F.lit("! not a row\n")).otherwise(""), key.cast("string"), F.lit(";"), F.when(key % 4 == 0, "--").otherwise(F.col("c_name")))
    files = read(spark, sf_dir, "customer").groupBy(F.floor(key / 1000).alias("n")).agg(F.array_join(F.collect_list(line), "\n").alias("lines"))
    files.select(F.concat(F.lit("key;name\n"), "lines")).write.option("maxRecordsPerFile", 1).text(path)
    return S.load(spark, path, sep=";", nullValue="--", comment="!")


def _encoded(encoding: str, spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "table") + ".csv"
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("Zürich é "), "c_name").alias("name")
    )
    rows.write.option("header", True).option("encoding", encoding).csv(path)
    return S.load(spark, path).withColumn("encoding", F.lit(S.detect_encoding(spark, path)))


for _encoding, _found in (("UTF-8", "UTF-8"), ("ISO-8859-1", "ISO-8859-1")):
    register(
        f"read_csv_encoding_{_encoding.lower().replace('-', '_')}", partial(_encoded, _encoding),
        f"SELECT c_custkey, 'Zürich é ' || c_name AS name, '{_found}' AS encoding FROM customer",
    )


def _free_text(key, name):
    """A field with line ends, quotes and separators in it, which depend on the key."""
    return F.when(key % 3 == 0, F.concat_ws("\n", name, F.lit('said "no", twice'), F.lit(""), name)).when(key % 3 == 1, F.concat(F.lit('"'), name)).otherwise(name)


_FREE_TEXT = """CASE c_custkey % 3 WHEN 0 THEN c_name || chr(10) || 'said "no", twice' || chr(10) || chr(10) || c_name
WHEN 1 THEN '"' || c_name ELSE c_name END AS note"""


def _quoted_file(spark: SparkSession, sf_dir: str, encoding: str, mark: str = "") -> str:
    """A file with all customers, in quotes, whose notes go over lines."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    key = F.col("c_custkey")
    line = F.concat_ws(",", key.cast("string"), quoted(_free_text(key, F.col("c_name"))), F.lit("é漢" if encoding.startswith("UTF-16") else "é"))
    rows = read(spark, sf_dir, "customer").select(F.concat(line, F.lit("\r\n")).alias("line"), "c_custkey")
    files = rows.groupBy(F.floor(F.col("c_custkey") / 20000).alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda r: r["line"]), "").alias("lines"))
    path = scratch_path(spark, "quoted") + ".csv"
    text = F.concat(F.lit(mark + "key,note,mark\n"), "lines")
    files.select(text).write.option("maxRecordsPerFile", 1).option("encoding", encoding).option("lineSep", "\n").text(path)
    return path


@query("read_csv_quoted_line_ends", f"SELECT c_custkey AS \"key\", {_FREE_TEXT}, 'é' AS mark FROM customer")
def _quoted_lines(spark, sf_dir):
    """Records over several lines, read by ranges."""
    return S.load(spark, _quoted_file(spark, sf_dir, "UTF-8"))


@query("read_csv_quoted_line_ends_iso_8859_1", f"SELECT c_custkey AS \"key\", {_FREE_TEXT}, 'é' AS mark FROM customer")
def _quoted_lines_latin(spark, sf_dir):
    path = scratch_path(spark, "latin") + ".csv"
    whole = spark.read.option("lineSep", "\x00").text(_quoted_file(spark, sf_dir, "UTF-8"))
    latin = whole.select(F.encode("value", "ISO-8859-1").alias("b")).select(F.col("b").cast("string"))
    # a task may hold many files, each with a header of its own
    latin.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    return S.load(spark, path)


for _wide in ("UTF-16LE", "UTF-16BE"):
    register(
        f"read_csv_{_wide.lower().replace('-', '_')}",
        lambda s, d, e=_wide: S.load(s, _quoted_file(s, d, e, "\ufeff")),
        f"SELECT c_custkey AS \"key\", {_FREE_TEXT}, 'é漢' AS mark FROM customer",
    )


@query("infer_storage_types", """SELECT 'key' AS field, 'bigint' AS storage, count(*) AS rows FROM customer UNION ALL
SELECT 'name', 'string', count(*) FROM customer UNION ALL SELECT 'nation', 'double', count(*) FROM customer UNION ALL
SELECT 'balance', 'double', count(*) FROM customer UNION ALL SELECT 'even', 'boolean', count(*) FROM customer UNION ALL
SELECT 'note', 'string', count(*) FROM customer""")
def _storage(spark, sf_dir):
    frame = S.load(spark, _delimited(spark, sf_dir, ",", "csv"))
    kinds = spark.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in frame.schema.fields], "field string, storage string"
    )
    return kinds.withColumn("rows", frame.select(F.count(F.lit(1))).scalar())


def _round_trip(table: str, format: str, spark, sf_dir) -> DataFrame:
    frame = read(spark, sf_dir, table)
    path = save(frame, scratch_path(spark, table) + f".{format}")
    loaded = S.load(spark, path)
    return loaded.select(*[F.col(f.name).cast(f.dataType) for f in frame.schema.fields])


for _format in ("csv", "json", "parquet"):
    register(f"save_and_load_{_format}", partial(_round_trip, "orders", _format), "SELECT * FROM orders")


@query("read_json_lines", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _json_lines(spark, sf_dir):
    path = scratch_path(spark, "parts") + ".jsonl"
    read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").write.json(path)
    return S.load(spark, path)


@query("read_json_nested_lines", """SELECT event_id, props, user_id AS "who.user", event_type AS "who.kind" FROM events""")
def _json_nested(spark, sf_dir):
    path = scratch_path(spark, "events") + ".json"
    read(spark, sf_dir, "events").select(
        "event_id", "props", F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("who")
    ).write.json(path)
    return C.flatten(S.load(spark, path)).select("event_id", "props", "`who.user`", "`who.kind`")


@query("read_json_array_document", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _json_array(spark, sf_dir):
    """Documents of up to 1000 customers, each an array over several lines."""
    path = scratch_path(spark, "customers") + ".json"
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    documents = rows.groupBy(F.floor(F.col("c_custkey") / 1000).alias("part")).agg(
        F.collect_list(F.struct(*rows.columns)).alias("customers")
    )
    documents.select(F.to_json("customers", {"pretty": "true"})).write.option(
        "maxRecordsPerFile", 1
    ).text(path)
    return S.load(spark, path).select("c_custkey", "c_name", "c_acctbal")


@query("read_json_one_line_array", "SELECT p_partkey, p_name FROM part")
def _json_one_line(spark, sf_dir):
    """Arrays of up to 1000 parts, each on one line of its own file."""
    path = scratch_path(spark, "parts") + ".json"
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    documents = rows.groupBy(F.floor(F.col("p_partkey") / 1000).alias("part")).agg(F.collect_list(F.struct(*rows.columns)).alias("parts"))
    documents.select(F.to_json("parts")).write.option("maxRecordsPerFile", 1).text(path)
    return S.load(spark, path).select("p_partkey", "p_name")


def _array_file(spark: SparkSession, sf_dir: str, broken: bool) -> str:
    """Documents of up to 20,000 parts, each an array with an element on each line; some are no objects if asked for."""
    element = F.to_json(F.struct("p_partkey", F.concat(F.lit('}],"{['), "p_name").alias("name"), F.struct(F.array("p_size").alias("sizes")).alias("more")))
    if broken:
        element = F.when(F.col("p_partkey") % 10 == 3, F.concat(F.lit('[{"key": '), F.col("p_partkey").cast("string"), F.lit("}]"))).otherwise(element)
    rows = read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20000).alias("n"), element.alias("element"))
    path = scratch_path(spark, "array") + ".json"
    text = F.concat(F.lit("[\n "), F.array_join(F.collect_list("element"), ",\n "), F.lit("\n]"))
    rows.groupBy("n").agg(text.alias("text")).select("text").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("read_json_large_array", "SELECT p_partkey, '}],\"{[' || p_name AS name, p_size AS size FROM part")
def _json_large(spark, sf_dir):
    """Arrays over many lines, cut into their elements by ranges."""
    return S.load(spark, _array_file(spark, sf_dir, False)).select("p_partkey", "name", F.col("more.sizes")[0].cast("int").alias("size"))


@query("json_array_rejects", "SELECT '[{\"key\": ' || CAST(p_partkey AS VARCHAR) || '}]' AS value FROM part WHERE p_partkey % 10 = 3")
def _json_array_rejects(spark, sf_dir):
    """Elements that are no objects come back as they are; the reader refuses the file."""
    path = _array_file(spark, sf_dir, True)
    try:
        S.load(spark, path)
    except ValueError:
        return S.json_rejects(spark, path).select(F.btrim("value", F.lit(" \n")).alias("value"))
    raise AssertionError("an array with elements that are no objects was read")


@query("json_line_rejects", "SELECT '{\"key\": ' || CAST(p_partkey AS VARCHAR) || ',,}' AS value FROM part WHERE p_partkey % 10 = 3")
def _json_rejects(spark, sf_dir):
    """Lines that are no JSON object come back as they are; the reader refuses the file."""
    path = scratch_path(spark, "parts") + ".jsonl"
    good = F.format_string('{"key": %d}', "p_partkey")
    bad = F.format_string('{"key": %d,,}', "p_partkey")
    read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 10 == 3, bad).otherwise(good)).write.text(path)
    try:
        S.load(spark, path)
    except ValueError:
        return S.json_rejects(spark, path)
    raise AssertionError("a file with lines that are no JSON object was read")


for _extension, _sep in (("csv", ","), ("tsv", "\t")):
    @query(f"{_extension}_long_rows", f"""SELECT CAST(c_custkey AS VARCHAR) || '{_sep}' || c_name || repeat('{_sep}', 1 + CAST(c_custkey % 3 AS INTEGER)) AS raw
FROM customer WHERE c_custkey % 10 = 3""")
    def _long_rows(spark, sf_dir, extension=_extension, sep=_sep):
        """Rows with surplus fields, empty ones too, come back as they are; the reader refuses the file."""
        path = scratch_path(spark, "customers") + f".{extension}"
        key = F.col("c_custkey").cast("string")
        surplus = F.when(F.col("c_custkey") % 10 == 3, F.expr(f"repeat('{sep}', 1 + cast(c_custkey % 3 as int))")).otherwise("")
        line = F.concat(key, F.lit(sep), "c_name", surplus)
        # a file is a header and the lines of up to 1000 customers
        files = read(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 1000).alias("n")).agg(
            F.array_join(F.collect_list(line), "\n").alias("lines"))
        files.select(F.concat(F.lit(f"key{sep}name\n"), "lines")).write.option("maxRecordsPerFile", 1).text(path)
        try:
            S.read_delimited(spark, path, sep=sep)
        except ValueError:
            return S.long_rows(spark, path, sep)
        raise AssertionError("a file with surplus fields was read")


@query("read_xml_behind_comments", "SELECT p_partkey, p_size FROM part")
def _xml_comments(spark, sf_dir):
    """Documents of up to 1000 parts behind a long comment that holds another element."""
    path = scratch_path(spark, "parts") + ".xml"
    part = F.format_string("<part><p_partkey>%d</p_partkey><p_size>%d</p_size></part>", "p_partkey", F.col("p_size").cast("bigint"))
    documents = read(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 1000).alias("n")).agg(
        F.array_join(F.collect_list(part), "\n").alias("parts"))
    comment = "<?xml version='1.0'?>\n<!-- <note>\n" + "not a row\n" * 60 + "</note> -->\n<parts>\n"
    documents.select(F.concat(F.lit(comment), "parts", F.lit("\n</parts>"))).write.option("maxRecordsPerFile", 1).text(path)
    return S.load(spark, path).select("p_partkey", F.col("p_size").cast("int").alias("p_size"))


@query("read_parquet_pruned", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")
def _parquet(spark, sf_dir):
    return S.read_parquet(
        spark, f"{sf_dir}/lineitem.parquet", columns=["l_orderkey", "l_quantity"],
        filters=(F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25),
    )


@query("read_xml", "SELECT p_partkey, p_name, p_size FROM part")
def _xml(spark, sf_dir):
    path = scratch_path(spark, "parts") + ".xml"
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    rows.write.format("xml").option("rootTag", "parts").option("rowTag", "part").save(path)
    return S.load(spark, path).select("p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"))


@query("write_splits", f"""WITH {_V} SELECT 'good_data' AS split, count(*) AS rows, count(DISTINCT c_name) AS names
FROM validated WHERE is_valid UNION ALL SELECT 'high_quality_data', count(*), count(DISTINCT c_name)
FROM validated WHERE is_valid AND score >= 0.8e0""")
def _write_splits(spark, sf_dir):
    written = write_splits(_validated(spark, sf_dir), scratch_path(spark, "splits"), format="parquet")
    tables = [
        spark.read.parquet(path).select(F.lit(name).alias("split"), "c_name") for name, path in written.items()
    ]
    return V.accumulate(tables).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("c_name").alias("names")
    )


# ------------------------------------------------------------------ messages and streams


def _event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages; some are broken, some lack a field or have another."""
    events = read(spark, sf_dir, "events")
    messages = P.encode(events, "event_id")
    i = F.col("key").cast("bigint")
    return messages.select(
        "key",
        F.when(i % 50 == 0, F.expr("left(value, length(value) - 3)"))
        .when(i % 50 == 1, F.lit(""))
        .when(i % 50 == 2, F.concat("value", F.lit("}")))
        .when(i % 50 == 3, F.regexp_replace("value", '"user_id":\\d+,', ""))
        .when(i % 50 == 4, F.regexp_replace("value", "}$", ',"zzz":2}'))
        .when(i % 50 == 5, F.regexp_replace("value", '"event_type":"[a-z]+"', '"event_type":null'))
        .otherwise(F.col("value"))
        .alias("value"),
    )


def _topic(spark: SparkSession, sf_dir: str) -> FileTopic:
    topic = FileTopic(scratch_path(spark, "topic"))
    topic.write(_event_messages(spark, sf_dir))
    return topic


@query("encode_payload", "SELECT event_id, user_id, event_type, value, props FROM events")
def _encode(spark, sf_dir):
    """Encoded and decoded events are the events."""
    messages = P.encode(read(spark, sf_dir, "events"))
    schema = "event_id bigint, user_id bigint, event_type string, value double, props string"
    return P.decode(messages, schema)


@query("encode_timestamps", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS ts FROM events""")
def _encode_ts(spark, sf_dir):
    messages = P.encode(read(spark, sf_dir, "events").select("event_id", "ts"))
    return P.decode(messages, "event_id bigint, ts string")


@query("message_keys", """SELECT CAST(user_id AS VARCHAR) AS "key", count(*) AS messages FROM events GROUP BY user_id""")
def _keys(spark, sf_dir):
    messages = P.encode(read(spark, sf_dir, "events"), "user_id")
    return messages.groupBy("key").agg(F.count(F.lit(1)).alias("messages"))


@query("send_statistics", "SELECT count(*) AS total_records, count(*) AS sent_records, 0 AS error_records, 100e0 AS success_rate, count(*) AS stored FROM events")
def _send(spark, sf_dir):
    from gaugewell.plans.flows import send

    topic = FileTopic(scratch_path(spark, "topic"))
    stats = send(read(spark, sf_dir, "events"), topic, "event_id")
    row = {k: stats[k] for k in ("total_records", "sent_records", "error_records")}
    sent = spark.createDataFrame([row], "total_records bigint, sent_records bigint, error_records bigint")
    return sent.select(
        "*", F.lit(float(stats["success_rate"])).alias("success_rate"),
        topic.read(spark).select(F.count(F.lit(1))).scalar().alias("stored"),
    )


_DECODABLE = "SELECT event_id FROM events WHERE event_id % 50 NOT IN (0, 1, 2)"
register(
    "drop_malformed_messages",
    lambda s, d: P.well_formed(_event_messages(s, d)).select(F.col("key").cast("bigint").alias("event_id")),
    _DECODABLE,
)
register(
    "malformed_messages",
    lambda s, d: P.malformed(_event_messages(s, d)).select(F.col("key").cast("bigint").alias("event_id")),
    "SELECT event_id FROM events WHERE event_id % 50 IN (0, 1, 2)",
)

_EVENT_PROFILE = W.declared_profile([
    W.declared("event_id", "integer", min_value=0.0, max_value=1e9),
    W.declared("ts", "datetime"),
    W.declared("user_id", "integer", min_value=0.0, max_value=1e9),
    W.declared("event_type", "categorical", nullable=True, allowed_values=["click", "view"]),
    W.declared("value", "float", min_value=0.0, max_value=50.0),
    W.declared("props", "json"),
])
# record by record: user_id missing (% 50 = 3), unexpected field (4), null event_type (5);
# a float needs a point in its text, which every event value has
_EVENT_VERDICTS = """judged AS (SELECT event_id,
  CASE WHEN event_id % 50 = 3 THEN 0e0 ELSE 1e0 END AS s_user,
  CASE WHEN event_id % 50 = 5 THEN 0.9e0 WHEN event_type NOT IN ('click', 'view') THEN 0.9e0 ELSE 1e0 END AS s_type,
  CASE WHEN value > 50 THEN 0.7e0 ELSE 1e0 END AS s_value,
  CASE WHEN event_id % 50 = 3 THEN 1 ELSE 0 END + CASE WHEN value > 50 THEN 1 ELSE 0 END AS errors,
  CASE WHEN event_id % 50 = 4 THEN 1 ELSE 0 END
    + CASE WHEN event_id % 50 <> 5 AND event_type NOT IN ('click', 'view') THEN 1 ELSE 0 END AS warnings
  FROM events WHERE event_id % 50 NOT IN (0, 1, 2)),
scored AS (SELECT *, (1e0 + 1e0 + s_user + s_type + s_value + 1e0) / 6 AS score FROM judged),
validated AS (SELECT *, errors = 0 AND score >= 0.6e0 AS is_valid,
  CASE WHEN score >= 0.9e0 THEN 'excellent' WHEN score >= 0.8e0 THEN 'good' WHEN score >= 0.6e0 THEN 'fair'
  ELSE 'poor' END AS level FROM scored)"""


def _stream(spark: SparkSession, sf_dir: str, **options) -> I.Ingestion:
    topic = _topic(spark, sf_dir)
    return I.run(topic.read_stream(spark), I.Ingestion.fresh(spark), **options)


@query("validate_payloads", f"""WITH {_EVENT_VERDICTS}
SELECT event_id, round(score, 6) AS score, is_valid, level, errors, warnings FROM validated""")
def _payloads(spark, sf_dir):
    """Absent, null and unexpected fields are told apart per message."""
    judged = P.validate_payloads(_event_messages(spark, sf_dir), _EVENT_PROFILE)
    return judged.select(
        F.col("event_id").cast("bigint").alias("event_id"), F.round("_quality_score", 6).alias("score"),
        F.col("_is_valid").alias("is_valid"), F.col("_quality_level").alias("level"),
        F.size("_errors").alias("errors"), F.size("_warnings").alias("warnings"),
    )


@query("stream_validate_frozen_profile", f"""WITH {_EVENT_VERDICTS}
SELECT event_id, round(score, 6) AS score, is_valid, 'kafka_stream' AS source_file FROM validated""")
def _stream_frozen(spark, sf_dir):
    rows = _stream(spark, sf_dir, profile=_EVENT_PROFILE).validated(spark)
    return rows.select(
        F.col("event_id").cast("bigint").alias("event_id"), F.round("_quality_score", 6).alias("score"),
        F.col("_is_valid").alias("is_valid"), F.col("_source_file").alias("source_file"),
    )


@query("stream_learns_on_first_batch", """SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props', 'zzz']) AS field,
count(*) AS validated FROM events WHERE event_id % 50 NOT IN (0, 1, 2)""")
def _stream_learn(spark, sf_dir):
    ingestion = _stream(spark, sf_dir)
    profile = ingestion.profile(spark).to_frame(spark).select("field")
    # the first batch is the whole topic here, so the unexpected field is learned too
    total = ingestion.validated(spark).select(F.count(F.lit(1))).scalar()
    return profile.withColumn("validated", total)


@query("stream_statistics", f"""WITH {_EVENT_VERDICTS}, {O.STATS} SELECT {_COUNTS},
round(success_rate, 6) AS success_rate FROM stats""")
def _stream_stats(spark, sf_dir):
    return _rounded(_stream(spark, sf_dir, profile=_EVENT_PROFILE).statistics(spark), _ROUND_RATE)


@query("stream_results", f"""WITH {_EVENT_VERDICTS}, {O.STATS} SELECT total_records, excellent_quality,
high_quality_count, low_quality_count, valid_records AS good_data_count, invalid_records AS bad_data_count FROM stats""")
def _stream_results(spark, sf_dir):
    rows = _stream(spark, sf_dir, profile=_EVENT_PROFILE).validated(spark)
    return R.processing_summary(rows).select(
        "processing_summary.total_records", "quality_metrics.excellent_quality",
        "quality_metrics.high_quality_count", "quality_metrics.low_quality_count",
        "data_splits.good_data_count", "data_splits.bad_data_count",
    )


@query("stream_rejects_malformed", """SELECT event_id FROM events WHERE event_id % 50 IN (0, 1, 2)""")
def _stream_rejects(spark, sf_dir):
    rejected = _stream(spark, sf_dir, profile=_EVENT_PROFILE).rejected(spark)
    return rejected.select(F.col("key").cast("bigint").alias("event_id"))


@query("stream_max_records", f"SELECT least(25, count(*)) AS validated FROM ({_DECODABLE})")
def _stream_cap(spark, sf_dir):
    """The cap is the feature: stop after a number of records."""
    rows = _stream(spark, sf_dir, profile=_EVENT_PROFILE, max_records=25).validated(spark)
    return rows.agg(F.count(F.lit(1)).alias("validated"))


def _log_topic(spark: SparkSession, sf_dir: str, parts: int = 4, **options) -> LogTopic:
    """Events as messages in a topic of several partitions, written in several commits."""
    topic = LogTopic(scratch_path(spark, "log-topic"), partitions=4, **options)
    messages = _event_messages(spark, sf_dir)
    for part in range(parts):
        topic.write(messages.where(F.pmod(F.col("key").cast("bigint"), F.lit(parts)) == part), batch_id=f"part-{part}")
    return topic


@query("stream_cap_over_batches", f"""WITH decodable AS ({_DECODABLE})
SELECT (SELECT count(*) FROM decodable) // 2 AS validated, (SELECT count(*) FROM decodable) // 2 AS counted, true AS stopped_before_the_end""")
def _stream_cap_batches(spark, sf_dir):
    """The cap is exact over several batches, and the stream does not read on."""
    topic = _log_topic(spark, sf_dir)
    total = P.well_formed(topic.read(spark)).count()
    ingestion = I.Ingestion.fresh(spark)
    for _ in range(2):  # the second run finds the ingestion full
        I.run(topic.read_stream(spark), ingestion, profile=_EVENT_PROFILE, max_records=total // 2)
    taken = ingestion.validated(spark).count() + (ingestion.rejected(spark).count())
    row = (ingestion.validated(spark).count(), ingestion.statistics(spark).first()["total_records"], taken < topic.read(spark).count())
    return spark.createDataFrame([row], "validated bigint, counted bigint, stopped_before_the_end boolean")


@query("stream_running_statistics", f"""WITH {_EVENT_VERDICTS}, parts AS (SELECT unnest([0, 1, 2, 3]) AS part)
SELECT part, count(*) AS total_records, count(*) FILTER (is_valid) AS valid_records, count(*) FILTER (NOT is_valid) AS invalid_records,
  count(*) FILTER (is_valid AND level = 'excellent') AS excellent_quality, count(*) FILTER (is_valid AND level = 'good') AS good_quality,
  round(count(*) FILTER (is_valid) * 100e0 / count(*), 6) AS success_rate
FROM parts JOIN validated ON event_id % 4 <= part GROUP BY part""")
def _stream_running(spark, sf_dir):
    """Statistics after each of several runs of one ingestion; each run starts anew from what is stored."""
    topic = LogTopic(scratch_path(spark, "log-topic"), partitions=4)
    root, messages, found = scratch_path(spark, "ingestion"), _event_messages(spark, sf_dir), None
    for part in range(4):
        topic.write(messages.where(F.pmod(F.col("key").cast("bigint"), F.lit(4)) == part), batch_id=f"part-{part}")
        ingestion = I.run(topic.read_stream(spark), I.Ingestion(root), profile=_EVENT_PROFILE)
        # a row of a stored counter: taken now, as the next run replaces it
        row = ingestion.statistics(spark).select("total_records", "valid_records", "invalid_records", "excellent_quality", "good_quality", "success_rate").first()
        now = spark.createDataFrame([(part, *row)], "part int, total_records bigint, valid_records bigint, invalid_records bigint, excellent_quality bigint, good_quality bigint, success_rate double")
        found = now if found is None else found.union(now)
    return _rounded(found, _ROUND_RATE)


@query("topic_offset_replay", """WITH numbered AS (SELECT event_id, user_id FROM events)
SELECT event_id, CAST(user_id AS VARCHAR) AS "key" FROM numbered WHERE event_id % 3 = 1""")
def _topic_offsets(spark, sf_dir):
    """What lies between the end offsets before a commit and those after it is that commit, read again by offsets."""
    topic = LogTopic(scratch_path(spark, "log-topic"), partitions=4)
    messages, ends = P.encode(read(spark, sf_dir, "events").select("event_id", "user_id"), "user_id"), []
    for part in range(3):
        mine = F.pmod(F.get_json_object("value", "$.event_id").cast("bigint"), F.lit(3)) == part
        topic.write(messages.where(mine), batch_id=f"part-{part}")
        ends.append(topic.end_offsets())
    rows = topic.read(spark, start=ends[0], end=ends[1])
    return rows.select(F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"), "key")


@query("topic_retried_write", """SELECT CAST(user_id AS VARCHAR) AS "key", count(*) AS messages, 1 AS partitions, true AS in_order FROM events GROUP BY user_id""")
def _topic_retry(spark, sf_dir):
    """A write that is tried again doubles nothing; a key is in one partition, its messages in the order they were written."""
    topic = LogTopic(scratch_path(spark, "log-topic"), partitions=5)
    events = read(spark, sf_dir, "events").repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    messages = P.encode(events.select("event_id", "user_id"), "user_id")
    for _ in range(3):
        topic.write(messages, batch_id="all")
    number = F.get_json_object("value", "$.event_id").cast("bigint")
    # offsets of a key rise with its events if sorting by one sorts by the other
    rows = topic.read(spark).groupBy("key").agg(
        F.count(F.lit(1)).alias("messages"), F.count_distinct("partition").cast("int").alias("partitions"),
        F.array_sort(F.collect_list(F.struct("offset", number.alias("n")))).alias("all"))
    numbers = F.transform("all", lambda r: r["n"])
    return rows.select("key", "messages", "partitions", (numbers == F.array_sort(numbers)).alias("in_order"))


@query("stream_repeated_keys", """SELECT CAST(event_id AS VARCHAR) AS "key", 2 AS copies FROM events WHERE event_id % 4 = 1""")
def _stream_keys(spark, sf_dir):
    """Keys that come again in a later batch, also one that another run of the stream has read."""
    topic, watch = LogTopic(scratch_path(spark, "log-topic"), partitions=4), KeyWatch.fresh(spark)
    messages, number = P.encode(read(spark, sf_dir, "events").select("event_id"), "event_id"), F.col("key").cast("bigint") % 4
    contract = Contract(primary_key="key", fields={})
    for name, part in (("first", number < 2), ("second", number == 2), ("third", (number == 1) | (number == 3))):
        topic.write(messages.where(part), batch_id=name)
        watch.run(topic.read_stream(spark), contract)
    return watch.repeated(spark).select("key", F.col("copies").cast("int").alias("copies"))


@query("stream_replay", f"SELECT count(*) AS first_run, count(*) AS second_run FROM ({_DECODABLE})")
def _stream_replay(spark, sf_dir):
    """A fresh ingestion reads the topic from its start again."""
    topic = _topic(spark, sf_dir)
    counts = []
    for _ in range(2):
        ingestion = I.run(topic.read_stream(spark), I.Ingestion.fresh(spark), profile=_EVENT_PROFILE)
        counts.append(ingestion.validated(spark).select(F.count(F.lit(1))).scalar())
    return spark.range(1).select(counts[0].alias("first_run"), counts[1].alias("second_run"))


@query("send_from_file", "SELECT CAST(c_custkey AS VARCHAR) AS \"key\", count(*) AS messages FROM customer GROUP BY c_custkey")
def _send_file(spark, sf_dir):
    """File to topic without validation: one message per row, under its key."""
    from gaugewell.plans.flows import send_from_file

    path = save(read(spark, sf_dir, "customer"), scratch_path(spark, "customers") + ".csv")
    topic = FileTopic(scratch_path(spark, "topic"))
    send_from_file(spark, path, topic, "c_custkey")
    return topic.read(spark).groupBy("key").agg(F.count(F.lit(1)).alias("messages"))


@query("flow_full_round_trip", """SELECT count(*) AS loaded, count(*) AS sent, count(*) AS consumed,
count(*) AS good FROM customer""")
def _flow(spark, sf_dir):
    """File to topic and back: what was sent is read, validated and split."""
    from gaugewell.plans.flows import file_to_topic_to_analysis

    path = save(read(spark, sf_dir, "customer"), scratch_path(spark, "customers") + ".csv")
    topic = FileTopic(scratch_path(spark, "topic"))
    results = file_to_topic_to_analysis(
        spark, path, topic, scratch_path(spark, "results"), timeout_seconds=None
    )
    first, second = results["file_to_topic"], results["topic_to_analysis"]
    good = spark.read.option("header", True).csv(second["written"]["good_data"])
    row = (
        first["validation"]["total_validated"], first["sending"]["sent_records"],
        second["processing_summary"]["total_records"],
    )
    counts = spark.createDataFrame([row], "loaded bigint, sent bigint, consumed bigint")
    return counts.withColumn("good", good.select(F.count(F.lit(1))).scalar())
