"""Detectors and text rendering against what Python says of the same values."""

import json
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions.detectors import BOOLEAN_WORDS, PATTERNS, Detectors
from gaugewell.operators.contract import Contract, check_contract
from gaugewell.functions.text import WHITESPACE, double_text, strip, value_text
from gaugewell.plans.oracles import DATE_FORMATS, DATETIME_FORMATS

LITERALS = [
    "25", "5", "2.5", "-5", "-2.5", "12345", "0", "1", "True", "yes", "2025-09-01", "2025-9-1",
    "2025-02-30", "2025-09-01 01:02:03.5", "1_000", "007", '{"a":1,"a":2}', "NaN", "1.0d", "0x1.0p3",
    "a@b.co", "A.B+c%d@x-y.example.ORG", "a@b", "(555) 123-4567", "+1 555.123.4567", "5551234567",
    "https://x.org/a?b=c#d", "https://x.org:80", "ftp://x.org", "$1,234.50", "12 EUR", "12usd", "12.5%",
    "%5", "K1A 0B1", "12345-6789", "1.2.3.4", "256.1.1.1", "4111-1111-1111-1111", "123-45-6789",
    "123456789", "1.", ".5", "1e5", "1.5e3", "+7", " 8 ", "--1", "1__0", "_1", "inf", "-Infinity", "nan",
    "March 5, 2024", "may 5,  2024", "5 June 2024", "13/01/2024", "01/13/2024", "31-12-2024", "2024/1/5",
    "0000-01-01", "24-01-01", "2024-01-01T10:00:00Z", "2024-01-01t10:00:00z", "2024-01-01T10:00:00.123",
    "2024-01-01 25:00:00", "1/2/2024 3:4:5", "2024-01-01 10:00", '[1, 2', '{"a": 1} x', "1 2", '"text"',
    "[1,2] [3]", "{bad", "null", "", " ", "text\n", "12345\n", "1-800", "Y", "TRUE", "N",
    "550e8400-e29b-41d4-a716-446655440000", "550e8400-e29b-71d4-a716-446655440000",
]


def parses(function, *errors):
    try:
        function()
        return True
    except errors:
        return False


def dated(text, formats):
    return any(parses(lambda f=f: datetime.strptime(text, f), ValueError) for f in formats)


def expected(kind, text):
    if kind in PATTERNS:
        return any(re.match(p, text, re.IGNORECASE) for p in PATTERNS[kind])
    if kind == "integer":
        return parses(lambda: int(text), ValueError)
    if kind == "float":
        return "." in text and parses(lambda: float(text), ValueError)
    if kind == "boolean":
        return text.lower() in BOOLEAN_WORDS
    if kind == "date":
        return dated(text, DATE_FORMATS)
    if kind == "datetime":
        return dated(text, DATETIME_FORMATS)
    return parses(lambda: json.loads(text), ValueError)


def random_texts(count):
    rng = random.Random(7)
    alphabet = "0123456789-+./: ,%$@eE_{}[]\"aTZ"
    return ["".join(rng.choices(alphabet, k=rng.randint(1, 14))) for _ in range(count)]


def test_every_type_on_every_text(spark):
    texts = sorted(set(LITERALS + random_texts(1500)))
    detectors = Detectors()
    tests = [detectors.test(kind, F.col("v")).alias(kind) for kind in detectors.order]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", *tests).collect()
    wrong = [
        (kind, row.v, row[kind])
        for row in rows for kind in detectors.order if bool(row[kind]) != bool(expected(kind, row.v))
    ]
    assert wrong == []


def test_numbers_are_tested_alike_by_value_and_by_text(spark):
    rng = random.Random(3)
    wholes = [0, 1, 5, 9, 10, 99, 999, 1000, 999999, 10**6, 10**9, 123456789, 10**10, 10**14, 10**15, 10**16, -1, -12345]
    wholes += [rng.randint(0, 10 ** rng.randint(1, 17)) for _ in range(300)]
    reals = [0.0, 1.0, -1.0, 0.5, 1e-4, 1e-5, 1e15, 1e16, 1.5e20, 123456.7891, 1123456.7891, 1e7, float("inf"), -2.5e-7]
    reals += [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 18) for _ in range(300)]
    detectors = Detectors()
    n, x = F.col("n"), F.col("x")
    for column, dtype, values in ((n, "n bigint", wholes), (x, "x double", reals)):
        text = value_text(column, T.LongType() if column is n else T.DoubleType())
        checks = []
        for kind in detectors.order:
            by_value = (
                detectors.test_whole(kind, column) if column is n
                else detectors.test_real(kind, column, text)
            )
            checks.append((by_value == detectors.test(kind, text)).alias(kind))
        frame = spark.createDataFrame([(v,) for v in values], dtype).select(text.alias("t"), *checks)
        wrong = [(k, r.t) for r in frame.collect() for k in detectors.order if not r[k]]
        assert wrong == []


def test_doubles_are_rendered_as_python_does(spark):
    rng = random.Random(11)
    values = [0.1, 100.0, 1e7, 12345678.0, 1234567.891, 9007199254740992.0, 1e16, 1.5e20, 1e-3, 5e-4, 1.25e-5,
              1e-5, 0.0, -0.0, -2.5e8, 123456789.123, 1e22, float("inf"), float("-inf")]
    values += [round(rng.uniform(-1e9, 1e9), rng.randint(0, 4)) for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    rows = frame.select("x", double_text(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in rows if str(r.x) != r.t] == []


def test_strip_removes_every_python_whitespace(spark):
    row = spark.range(1).select(strip(F.lit(f"{WHITESPACE}a b{WHITESPACE}")).alias("v")).first()
    assert row.v == "a b"


def test_unknown_mode_is_refused():
    with pytest.raises(ValueError):
        Detectors(mode="loose")


def test_long_values_do_not_overflow_the_stack(spark):
    long = ["1" + "_1" * 50_000, "1." + "1_" * 50_000 + "1", "9" * 100_000, "1e" + "1_" * 50_000 + "x", "a@" * 50_000]
    frame = spark.createDataFrame([(t,) for t in long], "v string")
    detectors = Detectors()
    found = frame.select(*[detectors.test(k, F.col("v")).alias(k) for k in ("integer", "float", "currency", "url", "email")]).collect()
    assert [r.integer for r in found] == [True, False, True, False, False]
    assert [r.float for r in found] == [False, True, False, False, False]


def test_contract_types_by_detector(spark):
    frame = spark.createDataFrame([("1.0d", "zz", 1.0), ("0x1.0p3", "2025-13-01 00:00:00", 1.5), ("1.5", "2025-12-01 00:00:00", None)],
                                  "f string, t string, n double")
    contract = Contract.from_dict({"fields": {"f": {"dtype": "float"}, "t": {"dtype": "datetime"}, "n": {"dtype": "integer"}}})
    found = [[b.field for b in r._breaches] for r in check_contract(frame, contract).collect()]
    assert found == [["f", "t"], ["f", "t", "n"], []]
    with pytest.raises(ValueError, match="Unknown type"):
        Contract.from_dict({"fields": {"f": {"dtype": "decimal"}}})
