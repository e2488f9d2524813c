"""Semantic-type detectors: boolean columns over the text of a value.

A ``Detectors`` registry maps a type name to a list of regular expressions
(a *pattern family*) or to a function ``Column -> Column``.  Both kinds may be
added or replaced by the caller; the order of the registry decides ties.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern families, in the order that decides ties.
PATTERNS: dict[str, list[str]] = {
    "email": [r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"],
    "phone": [
        r"^\+?1?[-.\s]?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})$",
        r"^\+?[1-9]\d{1,14}$",
    ],
    "url": [
        r"^https?://(?:[-\w.])+(?:\:[0-9]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:\#(?:[\w.])*)?)?$"
    ],
    "uuid": [r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"],
    "currency": [
        r"^\$?[\d,]+\.?\d*$",
        r"^[\d,]+\.?\d*\s?(USD|EUR|GBP|JPY|CAD|AUD)$",
    ],
    "percentage": [r"^\d+\.?\d*%$"],
    "postal_code": [
        r"^\d{5}(-\d{4})?$",
        r"^[A-Z]\d[A-Z]\s?\d[A-Z]\d$",
        r"^\d{4,6}$",
    ],
    "ip_address": [
        r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
    ],
    "credit_card": [r"^\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$"],
    "social_security": [r"^\d{3}-?\d{2}-?\d{4}$"],
}
# Patterns above whose parts overlap try every split of a long run of digits before they give up.
# These match the same texts and never look back.
LINEAR = {
    r"^\$?[\d,]+\.?\d*$": r"^\$?[\d,]++(?:\.\d*+)?+$",
    r"^[\d,]+\.?\d*\s?(USD|EUR|GBP|JPY|CAD|AUD)$": r"^[\d,]++(?:\.\d*+)?+\s?(?:USD|EUR|GBP|JPY|CAD|AUD)$",
    r"^\d+\.?\d*%$": r"^\d++(?:\.\d*+)?+%$",
}
# Words read as booleans.
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0", "y", "n"]

# Repeated groups are possessive: Java matches others by recursion, one call per repeat, and a
# long value would overflow the stack of its task.
_DIGITS = r"\d+(?:_\d+)*+"
_EXPONENT = rf"(?:[eE][+-]?{_DIGITS})?"
INTEGER_TEXT = rf"^\s*[+-]?{_DIGITS}\s*$"
POINT_NUMBER_TEXT = rf"^\s*[+-]?(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS}){_EXPONENT}\s*$"
PLAIN_NUMBER_TEXT = r"^\s*[+-]?(?:\d++(?:\.\d*+)?+|\.\d++)(?:[eE][+-]?\d++)?\s*$"
FLOAT_TEXT = (
    rf"(?i)^\s*[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?{_EXPONENT}|\.{_DIGITS}{_EXPONENT}|inf|infinity|nan)\s*$"
)
JSON_SCALAR = (
    r"^[ \t\n\r]*(-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?"
    r"|true|false|null|NaN|-?Infinity)[ \t\n\r]*$"
)
CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d"


def matches(text: Column, pattern: str) -> Column:
    """The whole-text, case-insensitive match all pattern families use."""
    # (?d): only \n ends a line, so $ means what it means in Python
    return text.rlike(f"(?di){LINEAR.get(pattern, pattern)}")


def any_pattern(patterns: list[str]) -> Callable[[Column], Column]:
    return lambda text: reduce(lambda a, b: a | b, [matches(text, p) for p in patterns])


def is_integer(text: Column) -> Column:
    return text.rlike(INTEGER_TEXT)


def is_float(text: Column) -> Column:
    """A number written with a decimal point."""
    return text.rlike(POINT_NUMBER_TEXT)


def parses_as_float(text: Column) -> Column:
    """Any text Python's ``float`` takes, with or without a point."""
    return text.rlike(FLOAT_TEXT)


def to_number(text: Column) -> Column:
    """The finite double a text denotes, else null; no Java-only spellings."""
    number = F.when(text.rlike(PLAIN_NUMBER_TEXT), text).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def is_boolean(text: Column) -> Column:
    return F.lower(text).isin(BOOLEAN_WORDS)


def _day_exists(text: Column, shape: str, formats: list[str]) -> Column:
    # the shape test keeps the parser, which is slow on failure, off other text
    shaped = F.when(text.rlike(shape), text)
    return F.coalesce(*[F.try_to_date(shaped, fmt) for fmt in formats]).isNotNull()


def is_date(text: Column) -> Column:
    worded = F.regexp_replace(text, r"\s+", " ")
    return (
        _day_exists(text, r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$", ["yyyy-M-d"])
        | _day_exists(text, r"^(?!0000)\d{4}/\d{1,2}/\d{1,2}$", ["yyyy/M/d"])
        | _day_exists(text, r"^\d{1,2}/\d{1,2}/(?!0000)\d{4}$", ["M/d/yyyy", "d/M/yyyy"])
        | _day_exists(text, r"^\d{1,2}-\d{1,2}-(?!0000)\d{4}$", ["d-M-yyyy", "M-d-yyyy"])
        | _day_exists(worded, r"^[A-Za-z]{3,9} \d{1,2}, (?!0000)\d{4}$", ["MMMM d, yyyy"])
        | _day_exists(worded, r"^\d{1,2} [A-Za-z]{3,9} (?!0000)\d{4}$", ["d MMMM yyyy"])
    )


# Formats of days and times, in the order that decides between month and day first.
TIME_FORMATS = [
    "yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "d-M-yyyy", "M-d-yyyy", "MMMM d, yyyy", "d MMMM yyyy",
    "yyyy-M-d H:m:s", "yyyy-M-d H:m:s.SSSSSS", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'", "M/d/yyyy H:m:s",
]


def to_time(text: Column) -> Column:
    """The time that a date or datetime text denotes, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for fmt in TIME_FORMATS])


def is_datetime(text: Column) -> Column:
    spaced = rf"^(?!0000)\d{{4}}-\d{{1,2}}-\d{{1,2}}\s+{CLOCK}(?:\.\d{{1,6}})?$"
    lettered = rf"(?i)^(?!0000)\d{{4}}-\d{{1,2}}-\d{{1,2}}T{CLOCK}(?:\.\d{{1,6}}|Z)?$"
    american = rf"^\d{{1,2}}/\d{{1,2}}/(?!0000)\d{{4}}\s+{CLOCK}$"
    day = F.regexp_extract(text, r"^([\d/-]+)", 1)
    return (
        F.when(
            text.rlike(spaced) | text.rlike(lettered),
            F.try_to_date(day, "yyyy-M-d").isNotNull(),
        )
        .when(text.rlike(american), F.try_to_date(day, "M/d/yyyy").isNotNull())
        .otherwise(F.lit(False))
    )


def is_json(text: Column) -> Column:
    """One JSON document and nothing after it.

    The variant parser stops at the end of the first value, so the text is also
    parsed as the sole element of an array and of an object: only a text that is
    exactly one value passes both.
    """
    document = F.when(text.rlike(r'^[ \t\n\r]*[{\["]'), text)
    in_array = F.concat(F.lit("["), document, F.lit("]"))
    in_object = F.concat(F.lit('{"v":'), document, F.lit("}"))
    return text.rlike(JSON_SCALAR) | (
        F.try_parse_json(in_array).isNotNull() & F.try_parse_json(in_object).isNotNull()
    )


FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "integer": is_integer,
    "float": is_float,
    "boolean": is_boolean,
    "date": is_date,
    "datetime": is_datetime,
    "json": is_json,
}


# What the built-in tests say about the text of a whole number, without the text.
WHOLE_NUMBER_TESTS: dict[str, Callable[[Column], Column]] = {
    "phone": lambda n: n.between(10, 10**15 - 1),
    "currency": lambda n: n >= 0,
    "postal_code": lambda n: n.between(1000, 999_999),
    "credit_card": lambda n: n.between(10**15, 10**16 - 1),
    "social_security": lambda n: n.between(10**8, 10**9 - 1),
    "integer": lambda n: n.isNotNull(),
    "boolean": lambda n: n.isin(0, 1),
    "json": lambda n: n.isNotNull(),
}
# Types that no number's text has (besides those above).
NEVER_WHOLE = [
    "email", "url", "uuid", "percentage", "ip_address", "float", "date", "datetime",
]
NEVER_REAL = [
    "email", "url", "uuid", "percentage", "postal_code", "ip_address", "credit_card",
    "social_security", "integer", "boolean", "date", "datetime",
]


class Detectors:
    """The types a profile can detect, in tie-breaking order.

    ``mode="reference"`` tries pattern families first, so plain non-negative
    numbers come out as phone or currency.  ``mode="strict_numeric"`` tries
    integer and float before them.
    """

    def __init__(
        self,
        patterns: dict[str, list[str]] | None = None,
        functions: dict[str, Callable[[Column], Column]] | None = None,
        mode: str = "reference",
    ):
        if mode not in ("reference", "strict_numeric"):
            raise ValueError(f"Unknown detector mode: {mode}")
        self.patterns = {**PATTERNS, **(patterns or {})}
        self.functions = {**FUNCTIONS, **(functions or {})}
        self.mode = mode
        order = [*self.patterns, *(n for n in self.functions if n not in self.patterns)]
        if mode == "strict_numeric":
            numeric = ["integer", "float"]
            order = numeric + [n for n in order if n not in numeric]
        self.order = order

    def test(self, name: str, text: Column) -> Column:
        """True where ``text`` is of type ``name``."""
        if name in self.patterns:
            return any_pattern(self.patterns[name])(text)
        return self.functions[name](text)

    def _built_in(self, name: str) -> bool:
        if name in self.patterns:
            return self.patterns[name] == PATTERNS.get(name)
        return self.functions[name] is FUNCTIONS.get(name)

    def test_whole(self, name: str, number: Column) -> Column:
        """The test of a whole number's text; no regular expression if built in."""
        if self._built_in(name):
            if name in WHOLE_NUMBER_TESTS:
                return WHOLE_NUMBER_TESTS[name](number)
            if name in NEVER_WHOLE:
                return F.lit(False)
        return self.test(name, number.cast("string"))

    def test_real(self, name: str, number: Column, text: Column) -> Column:
        """The test of a double's text; most need only its size."""
        by_text = self.test(name, text)
        if self._built_in(name):
            size = F.abs(number)
            # printed with digits around a point: no exponent, no sign
            plain = (number >= 1e-4) & (number < 1e16)
            if name in NEVER_REAL:
                return F.lit(False)
            if name == "currency":
                return F.when(plain, True).otherwise(by_text)
            if name == "float":
                return F.when((size >= 1e-4) & (size < 1e16), True).otherwise(by_text)
            if name == "json":
                return size < float("inf")
        return by_text

    def test_time(self, name: str, text: Column, day_only: bool = False) -> Column:
        """The test of a date's or timestamp's text, which has one fixed form."""
        if self._built_in(name):
            return F.lit(name == ("date" if day_only else "datetime"))
        return self.test(name, text)

    def has_patterns(self, name: str) -> bool:
        return name in self.patterns
