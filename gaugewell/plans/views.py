"""Derived tables for the registered queries.

The given tables are clean, so their rows are turned into dirty ones by
expressions that Spark SQL and ANSI engines read alike.  Every view has one row
per row of its base table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gaugewell.operators.profile import FieldProfile, TableProfile


@dataclass
class View:
    base: str
    columns: dict[str, tuple[str, str]]  # name -> (kind, expression)

    @property
    def sql(self) -> str:
        items = ", ".join(f'{e} AS "{n}"' for n, (_, e) in self.columns.items())
        return f"SELECT {items} FROM {self.base}"

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        table = spark.read.parquet(f"{sf_dir}/{self.base}.parquet")
        return table.selectExpr(*[f"{e} AS `{n}`" for n, (_, e) in self.columns.items()])

    def only(self, *names: str) -> View:
        return View(self.base, {n: self.columns[n] for n in names})


def _text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


K = "c_custkey"
_K = _text(K)
_MD5 = f"md5({_K})"
_YEAR = _text(f"1990 + {K} % 30")
_MONTH = _text(f"1 + {K} % 12")
_DAY = _text(f"1 + {K} % 28")
_MM, _DD = f"lpad({_MONTH}, 2, '0')", f"lpad({_DAY}, 2, '0')"
_ISO = f"{_YEAR} || '-' || {_MM} || '-' || {_DD}"


def _case(modulus: int, forms: list[str], otherwise: str) -> str:
    """The i-th form where the key leaves remainder i."""
    whens = " ".join(f"WHEN {K} % {modulus} = {i} THEN {f}" for i, f in enumerate(forms))
    return f"CASE {whens} ELSE {otherwise} END"


PEOPLE = View(
    "customer",
    {
        "id": ("bigint", K),
        "full_name": ("string", _case(
            23, [f"'  ' || c_name || ' '", "'NULL'", "''", "'None'", "' nan '", "NULL"], "c_name")),
        "email": ("string", _case(
            9, [f"'user' || {_K} || '.example.com'", f"'User.' || {_K} || '+x@Mail.Example.ORG'"],
            f"'user' || {_K} || '@example.com'")),
        "phone": ("string", _case(
            11, [f"'(' || {_text(f'200 + {K} % 700')} || ') 555-' || {_text(f'1000 + {K} % 9000')}",
                 f"'555.' || {_text(f'100 + {K} % 900')} || '.1234'", "'call me'"],
            f"'+1' || {_text(f'2000000000 + {K}')}")),
        "site": ("string", _case(
            12, [f"'http://shop.example.com:8080/a/b.c?x={{}}&y=' || {_K}", f"'ftp://example.com/' || {_K}",
                 f"'HTTPS://example.org/p_' || {_K} || '?q=1&r=a%20b#top'", "'https://exa mple.com'"],
            f"'https://www.example.com/item/' || {_K}")),
        "token": ("string", _case(
            10, [f"substr({_MD5}, 1, 8) || '-' || substr({_MD5}, 9, 4) || '-7' || substr({_MD5}, 14, 3) "
                 f"|| '-a' || substr({_MD5}, 18, 3) || '-' || substr({_MD5}, 21, 12)"],
            f"upper(substr({_MD5}, 1, 8)) || '-' || substr({_MD5}, 9, 4) || '-4' || substr({_MD5}, 14, 3) "
            f"|| '-b' || substr({_MD5}, 18, 3) || '-' || substr({_MD5}, 21, 12)")),
        "price": ("string", _case(
            10, [f"'$1,' || {_text(f'100 + {K} % 900')} || '.50'", f"{_K} || '.25 EUR'", f"'-' || {_K}",
                 f"{_K} || 'usd'", f"'EUR ' || {_K}"],
            f"{_K} || '.99'")),
        "share": ("string", _case(
            8, [f"{_K} || '.5%'", f"'%' || {_K}"], f"{_text(f'{K} % 100')} || '%'")),
        "postal": ("string", _case(
            10, ["'K1A 0B1'", "'h0h0h0'", f"{_text(f'10000 + {K} % 90000')} || '-6789'", "'12'", "'1234567'"],
            f"{_text(f'10000 + {K} % 90000')}")),
        "address": ("string", _case(
            15, [f"'256.1.1.' || {_text(f'{K} % 256')}", "'10.0.0'"],
            f"{_text(f'{K} % 256')} || '.' || {_text(f'({K} * 7) % 256')} || '.0.1'")),
        "card": ("string", _case(
            10, [f"'4111 1111 1111 ' || {_text(f'1000 + {K} % 9000')}", "'41111111'"],
            f"'4111-1111-1111-' || {_text(f'1000 + {K} % 9000')}")),
        "national_id": ("string", _case(
            9, ["'123456789'", "'12-345-6789'"],
            f"{_text(f'100 + {K} % 900')} || '-' || {_text(f'10 + {K} % 90')} || '-' || {_text(f'1000 + {K} % 9000')}")),
        "whole": ("string", _case(
            12, [f"'-' || {_K}", f"'+' || {_K}", "'1_000'", f"' ' || {_K} || ' '", f"'00' || {_K}", "'12a'"],
            f"'-' || {_text(f'{K} + 5')}")),
        "real": ("string", _case(
            12, [f"'-' || {_K} || '.5'", f"{_K} || '.'", f"'.' || {_K}", f"{_K} || '.5e3'", "'1e5'", "'1.0d'"],
            f"'-' || {_text(f'{K} % 97')} || '.25'")),
        "flag": ("string", _case(7, ["'yes'", "'No'", "'TRUE'", "'n'", "'1'"], "'false'")),
        "day": ("string", _case(
            12, [_ISO, f"{_MONTH} || '/' || {_DAY} || '/' || {_YEAR}", f"{_DAY} || '/' || {_MONTH} || '/' || {_YEAR}",
                 f"{_YEAR} || '/' || {_MM} || '/' || {_DD}", f"{_DD} || '-' || {_MM} || '-' || {_YEAR}",
                 f"{_MM} || '-' || {_DD} || '-' || {_YEAR}", f"'March ' || {_DAY} || ', ' || {_YEAR}",
                 f"{_DAY} || ' june ' || {_YEAR}", f"{_YEAR} || '-02-30'", f"{_YEAR} || '-13-01'"],
            f"{_YEAR} || '-' || {_MONTH} || '-' || {_DAY}")),
        "moment": ("string", _case(
            11, [f"{_ISO} || ' 10:20:30'", f"{_ISO} || ' 1:2:3.5'", f"{_ISO} || 'T23:59:59'",
                 f"{_ISO} || 'T00:00:00.123456'", f"{_ISO} || 'T05:06:07Z'",
                 f"{_MM} || '/' || {_DD} || '/' || {_YEAR} || ' 11:12:13'", f"{_ISO} || ' 25:00:00'", f"{_ISO} || ' 10:20'"],
            f"{_ISO} || ' 08:00:' || {_text(f'10 + {K} % 50')}")),
        "extra": ("string", _case(
            12, [f"'[1, 2, ' || {_K} || ']'", "'{\"a\": 1, \"a\": 2}'", "'null'", "' true '", "'\"text\"'",
                 "'{\"a\": 1} x'", "'{bad'", "'007'", "'-1.5e3'"],
            f"'{{\"k\": ' || {_K} || ', \"t\": [\"x\", null]}}'")),
        "tier": ("string", _case(20, ["'platinum'", "NULL", "''"],
                                 f"CASE WHEN {K} % 3 = 0 THEN 'gold' WHEN {K} % 3 = 1 THEN 'silver' ELSE 'bronze' END")),
        "balance": ("double", f"CASE WHEN {K} % 19 = 0 THEN NULL ELSE c_acctbal END"),
        "segment": ("string", "c_mktsegment"),
    },
)

# Orders with injected defects, for the declared contract and routing.
O = "o_orderkey"
DIRTY_ORDERS = View(
    "orders",
    {
        "OrderID": ("bigint", f"CASE WHEN {O} % 101 = 0 THEN 1 ELSE {O} END"),
        "CustomerID": ("string", f"CASE WHEN {O} % 31 = 0 THEN NULL WHEN {O} % 7 = 0 THEN 'MILLER' "
                                 f"ELSE 'C' || lpad({_text('o_custkey % 10000')}, 4, '0') END"),
        "EmployeeID": ("string", f"CASE WHEN {O} % 37 = 0 THEN 'x1' ELSE {_text(f'1 + {O} % 9')} END"),
        "OrderDate": ("string", f"substr({_text('o_orderdate')}, 1, 10)"),
        "ShippedDate": ("string", f"CASE WHEN {O} % 41 = 0 THEN NULL WHEN {O} % 13 = 0 THEN '1990-01-01' "
                                  f"WHEN {O} % 17 = 0 THEN '2030/01/01' ELSE '2030-01-01' END"),
        "Freight": ("double", f"CASE WHEN {O} % 43 = 0 THEN NULL WHEN {O} % 11 = 0 THEN -o_totalprice ELSE o_totalprice END"),
        "ShipName": ("string", "o_orderpriority"),
        "ShipRegion": ("string", f"CASE WHEN {O} % 2 = 0 THEN NULL ELSE o_orderstatus END"),
    },
)

# Customers in the shape of the fixed customer model.
MODEL_CUSTOMERS = View(
    "customer",
    {
        "CustomerID": ("string", _case(
            17, ["NULL", "'   '", f"'idididid' || {_K} || 'long'", "' ab '"], f"' c' || {_K} || ' '")),
        "CompanyName": ("string", _case(19, ["NULL", "''"], "' ' || c_name")),
        "ContactName": ("string", _case(21, ["'  '"], "'Contact ' || c_name")),
        "ContactTitle": ("string", _case(23, ["NULL"], "'Owner'")),
        "City": ("string", _case(25, ["''"], f"'City ' || {_text('c_nationkey')}")),
        "Region": ("string", _case(3, ["NULL"], f"'R' || {_text('c_nationkey')}")),
        "PostalCode": ("string", _case(13, ["'1'", "NULL", "'123'"], f"' ' || {_text(f'10000 + {K} % 80000')}")),
        "Country": ("string", _case(29, ["'U'"], "'USA'")),
        "Segment": ("string", _case(
            9, ["'healthcare'", "' GOVERNMENT '", "'retail'", "'o-neils retail'", "''", "NULL"],
            "'Finance'")),
        "MetroArea": ("string", _case(6, ["'TRUE'", "'no'", "' Y '", "'maybe'", "NULL"], "'0'")),
    },
)

# One validation job per order.
JOBS = View(
    "orders",
    {
        "job_id": ("bigint", O),
        "filename": ("string", f"'file_' || {_text(O)} || '.csv'"),
        "action": ("string", "'validate'"),
        "status": ("string", "CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'failed' "
                             f"WHEN {O} % 4 = 0 THEN 'pending' WHEN {O} % 4 = 1 THEN 'running' ELSE 'completed' END"),
        "created_at": ("timestamp", "o_orderdate"),
        "updated_at": ("timestamp", "o_orderdate"),
        "total_records": ("bigint", f"CAST(100 + {O} % 900 AS BIGINT)"),
        "valid_records": ("bigint", f"CAST(100 + {O} % 900 - ({O} % 10) * ({O} % 11) AS BIGINT)"),
        "invalid_records": ("bigint", f"CAST(({O} % 10) * ({O} % 11) AS BIGINT)"),
        "success_rate": ("double", f"CAST(100 + {O} % 900 - ({O} % 10) * ({O} % 11) AS DOUBLE) "
                                   f"/ CAST(100 + {O} % 900 AS DOUBLE) * 100"),
    },
)


def _plain(base: str, **kinds: str) -> View:
    return View(base, {name: (kind, name) for name, kind in kinds.items()})


TABLES = {
    "region": _plain("region", r_regionkey="bigint", r_name="string"),
    "nation": _plain("nation", n_nationkey="bigint", n_name="string", n_regionkey="bigint"),
    "customer": _plain("customer", c_custkey="bigint", c_name="string", c_nationkey="bigint",
                       c_acctbal="double", c_mktsegment="string"),
    "supplier": _plain("supplier", s_suppkey="bigint", s_name="string", s_nationkey="bigint",
                       s_acctbal="double"),
    "part": _plain("part", p_partkey="bigint", p_name="string", p_brand="string", p_type="string",
                   p_size="bigint", p_retailprice="double"),
    "orders": _plain("orders", o_orderkey="bigint", o_custkey="bigint", o_orderstatus="string",
                     o_totalprice="double", o_orderdate="timestamp", o_orderpriority="string"),
    "lineitem": _plain("lineitem", l_orderkey="bigint", l_partkey="bigint", l_suppkey="bigint",
                       l_linenumber="bigint", l_quantity="double", l_extendedprice="double",
                       l_discount="double", l_tax="double", l_returnflag="string",
                       l_linestatus="string", l_shipdate="timestamp"),
    "events": _plain("events", event_id="bigint", ts="timestamp", user_id="bigint",
                     event_type="string", value="double", props="string"),
    "documents": _plain("documents", doc_id="bigint", text="string", lang="string",
                        source="string", n_chars="bigint"),
    "pages": _plain("pages", page_id="bigint", url="string", html="string"),
    "conversations": _plain("conversations", conv_id="bigint", turn="bigint", role="string",
                            text="string"),
    "benchmark": _plain("benchmark", item_id="bigint", text="string"),
    "labels": _plain("labels", doc_id="bigint", quality="bigint", toxic="bigint"),
    "people": PEOPLE,
}

# Thirty texts of 100 to 4740 characters, equally frequent where the keys are, and an empty column.
TIED = View("customer", {
    "tied": ("string", f"repeat(lpad({_text(f'{K} % 30')}, 2, '0'), 50 + 80 * ({K} % 30))"),
    "nothing": ("string", "CAST(NULL AS STRING)"),
})


def declared(field: str, kind: str, nullable: bool = False, **rules) -> FieldProfile:
    """A hand-written profile row."""
    return FieldProfile(
        field=field, ordinal=0, detected_type=kind, nullable=nullable,
        is_categorical="allowed_values" in rules,
        rules={"type": kind, "nullable": nullable, "required": not nullable, **rules},
    )


def declared_profile(rows: list[FieldProfile]) -> TableProfile:
    profile = TableProfile([])
    for ordinal, row in enumerate(rows):
        row.ordinal = ordinal
        if profile.detectors.has_patterns(row.detected_type):
            row.rules["patterns"] = profile.detectors.patterns[row.detected_type]
        if "allowed_values" in row.rules:
            row.rules["categorical"] = True
    profile.profiles = rows
    return profile


# A declared profile of PEOPLE: every kind of rule, one required and one optional
# field the table lacks; full_name and segment are unknown to it.
PEOPLE_PROFILE = declared_profile([
    declared("id", "integer", min_value=0.0, max_value=1000.0),
    declared("email", "email", min_length=15, max_length=24),
    declared("phone", "phone"),
    declared("site", "url", min_length=8, max_length=60),
    declared("price", "currency"),
    declared("postal", "postal_code"),
    declared("whole", "integer", min_value=-800.0, max_value=800.0),
    declared("real", "float", min_value=-90.0, max_value=700.0),
    declared("flag", "boolean"),
    declared("day", "date"),
    declared("moment", "datetime"),
    declared("extra", "json"),
    declared("tier", "categorical", nullable=True, allowed_values=["gold", "silver"]),
    declared("balance", "float", nullable=True, min_value=-500.0, max_value=9000.0),
    declared("region_code", "string", nullable=True),
])
PEOPLE_FIELDS = ["id", "full_name", "email", "phone", "site", "price", "postal", "whole", "real",
                 "flag", "day", "moment", "extra", "tier", "balance", "segment"]
VALIDATED_PEOPLE = PEOPLE.only(*PEOPLE_FIELDS)

# Rows of the mixed-quality kind: most are valid, so that splits and levels differ.
CUSTOMER_PROFILE = declared_profile([
    declared("c_custkey", "currency"),
    declared("c_name", "string", min_length=10, max_length=18),
    declared("c_nationkey", "currency"),
    declared("c_acctbal", "float", nullable=True, min_value=-500.0, max_value=9500.0),
    declared("c_mktsegment", "categorical", nullable=True,
             allowed_values=["AUTOMOBILE", "BUILDING", "FURNITURE"]),
    declared("c_comment", "string", nullable=True),
    declared("c_phone", "phone", nullable=True),
])
DIRTY_CUSTOMERS = View(
    "customer",
    {
        "c_custkey": ("bigint", K),
        "c_name": ("string", _case(16, [f"c_name || ' the second'", "'short'", "''"], "c_name")),
        "c_nationkey": ("bigint", f"CASE WHEN {K} % 14 = 0 THEN NULL ELSE c_nationkey END"),
        "c_acctbal": ("double", f"CASE WHEN {K} % 5 = 0 THEN NULL ELSE c_acctbal END"),
        "c_mktsegment": ("string", f"CASE WHEN {K} % 6 = 0 THEN NULL ELSE c_mktsegment END"),
        "c_comment": ("string", f"CASE WHEN {K} % 2 = 0 THEN NULL ELSE c_name END"),
        "c_phone": ("string", f"CASE WHEN {K} % 3 = 0 THEN '' WHEN {K} % 25 = 1 THEN 'none' ELSE {_text(f'2000000000 + {K}')} END"),
    },
)
