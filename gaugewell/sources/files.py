"""File scans: CSV, delimited text, JSON, JSON Lines, Parquet and XML."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions.detectors import PLAIN_NUMBER_TEXT
from gaugewell.functions.text import CSV_NULL_TOKENS, null_if_token
from gaugewell.functions.json_types import json_rows, json_schema, json_type
from gaugewell.operators.clean import flatten
from gaugewell.session import path_exists
from gaugewell.sources.ranges import WIDE, Quoting, header_names, json_elements, quoted_records

SEPARATORS = [",", ";", "\t", "|"]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# ------------------------------------------------------------------ encoding


def _survey(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The encoding, and whether a line may end inside quotes: one that does has an odd number of them."""
    lines = spark.read.text(path)
    head = F.hex(F.substring(F.to_binary(F.hex("value"), F.lit("hex")), 1, 2))
    first = F.col("_metadata.file_block_start") == 0
    marks = {e: F.count_if(first & (head == mark.hex().upper())).alias(e) for e, mark in WIDE.items()}
    row = lines.agg(
        F.count_if(~F.is_valid_utf8("value")).alias("broken"), *marks.values(),
        F.count_if((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).alias("odd"),
    ).first()
    wide = [e for e in WIDE if row[e]] if row["broken"] else []
    return wide[0] if wide else "ISO-8859-1" if row["broken"] else "UTF-8", row["odd"] > 0


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line is, else UTF-16 if a file starts with its mark, else ISO-8859-1.

    One aggregate over the lines; pass ``encoding`` and ``multiline`` to the readers to save it.
    """
    found = _survey(spark, path)[0]
    return "UTF-16" if found in WIDE else found


# ------------------------------------------------------------------ delimited text


class _Lines:
    """Delimited text with a record on each line, by the CSV reader."""

    def __init__(self, spark: SparkSession, path: str, sep: str, encoding: str, options: dict, multiline: bool = False) -> None:
        reader = (
            spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
            .option("quote", '"').option("escape", '"').option("multiLine", multiline).options(**options)
        )
        self.path, self.sep, self.reader = path, sep, reader
        self.texts = reader.csv(path)
        self.columns = self.texts.columns

    def long(self) -> DataFrame:
        """(raw): rows with more fields than the header has names."""
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(self.columns))])
        schema = schema.add("_malformed", T.StringType())
        reader = self.reader.option("columnNameOfCorruptRecord", "_malformed")
        # with pruning the parser would not count the fields of a row
        rows = reader.option("columnPruning", False).schema(schema).csv(self.path)
        long = F.col("_malformed").isNotNull() & (_fields(F.col("_malformed"), self.sep) > len(self.columns))
        # the parser does not run for the marks alone, so a field is asked for as well
        asked = F.col("c0").isNull() | F.col("c0").isNotNull()
        return rows.where(long & asked).select(F.col("_malformed").alias("raw"), "c0").select("raw")


class _Records:
    """Delimited text whose records may go over lines, or are in two bytes a character: all tasks read a file at once."""

    def __init__(self, spark: SparkSession, path: str, sep: str, encoding: str, options: dict) -> None:
        quoting = Quoting(sep, '"', encoding)
        records = quoted_records(spark, path, quoting)
        header = records.where("first").orderBy("file").limit(1).collect()
        self.sep, self.columns = sep, header_names(header[0]["value"], quoting) if header else []
        self.records = records.where(~F.col("first"))
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(self.columns))])
        parsed = F.from_csv("value", schema.toDDL(), {"sep": sep, "quote": '"', "escape": '"', **options}) if self.columns else F.lit(None)
        self.texts = self.records.select(parsed.alias("row")).select(
            *(F.col(f"row.c{i}").alias(name) for i, name in enumerate(self.columns)))

    def long(self) -> DataFrame:
        return self.records.where(_fields(F.col("value"), self.sep) > len(self.columns)).select(F.col("value").alias("raw"))


def _fields(raw: Column, sep: str) -> Column:
    """Number of fields of a row; what is quoted from the beginning of a field on holds no separator."""
    sep = re.escape(sep)
    return F.size(F.split(F.regexp_replace(raw, rf'(^|{sep})"(?:[^"]|"")*+(?:"|\z)', "$1"), sep, -1))


def _source(spark: SparkSession, path: str, encoding: str | None, multiline: bool | None, options: dict):
    """What reads the file under a given separator."""
    wide = encoding is not None and encoding.upper().startswith("UTF-16")
    if encoding is None or multiline is None or encoding.upper() == "UTF-16":
        found, odd = _survey(spark, path)
        encoding = found if encoding is None or wide and found in WIDE else encoding
        multiline = odd if multiline is None else multiline
    if encoding.upper() in (*WIDE, "UTF-16"):
        name = encoding.upper() if encoding.upper() in WIDE else "UTF-16LE"
        return lambda sep: _Records(spark, path, sep, name, options)
    if multiline and encoding.upper() in ("UTF-8", "ISO-8859-1"):
        return lambda sep: _Records(spark, path, sep, encoding.upper(), options)
    return lambda sep: _Lines(spark, path, sep, encoding, options, bool(multiline))


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    encoding: str | None = None,
    multiline: bool | None = None,
    fallback: bool = False,
    typed: bool = True,
    nullable_int_as_double: bool = True,
    cut_long_rows: bool = False,
    **options,
) -> DataFrame:
    """Delimited text with a header; null tokens read as null, types inferred.

    Line ends inside quotes belong to their field; ``multiline`` says whether there are any, and is found
    out if it is not given. ``fallback`` tries the other separators when the rows do not fit under ``sep``;
    the first one under which no row has too many fields is taken. Rows that are longer
    than the header are an error, unless ``cut_long_rows`` asks to drop their surplus.
    """
    source = _source(spark, path, encoding, multiline, options)
    found = source(sep)
    if not cut_long_rows and (long := found.long().count() if found.columns else 0):
        for candidate in SEPARATORS if fallback else []:
            if candidate != sep and not (found := source(candidate)).long().count():
                break
        else:
            raise ValueError(f"Unable to read file {path}: {long} rows are longer than the header")
    texts = found.texts.select(
        *[null_if_token(F.col(_quoted(c)), CSV_NULL_TOKENS).alias(c) for c in found.columns]
    )
    return infer_storage(texts, nullable_int_as_double) if typed else texts


def long_rows(
    spark: SparkSession, path: str, sep: str = ",", encoding: str | None = "UTF-8", multiline: bool | None = None, **options
) -> DataFrame:
    """The raw text (``raw``) of rows with more fields than the header has names."""
    return _source(spark, path, encoding, multiline, options)(sep).long()


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV with separator fallback."""
    return read_delimited(spark, path, **{"sep": ",", "fallback": True, **options})


def read_text(spark: SparkSession, path: str, delimiter: str = "\t", **options) -> DataFrame:
    """Delimited text, tab by default."""
    return read_delimited(spark, path, sep=delimiter, **options)


def infer_storage(texts: DataFrame, nullable_int_as_double: bool = True) -> DataFrame:
    """Cast all-text columns to bigint, double or boolean where every value fits.

    One aggregate over the table.  A whole-number column with nulls becomes double
    (as it does in pandas) unless ``nullable_int_as_double`` is off.
    """
    if not texts.columns:
        return texts
    tests = []
    for i, name in enumerate(texts.columns):
        value = F.col(_quoted(name))
        whole = value.rlike(r"^\s*[+-]?\d+\s*$") & value.try_cast("bigint").isNotNull()
        tests += [
            F.count(value).alias(f"filled_{i}"),
            F.count_if(whole).alias(f"whole_{i}"),
            F.count_if(value.rlike(PLAIN_NUMBER_TEXT)).alias(f"number_{i}"),
            F.count_if(value.isin("True", "TRUE", "true", "False", "FALSE", "false")).alias(
                f"flag_{i}"
            ),
        ]
    found = texts.agg(F.count(F.lit(1)).alias("rows"), *tests).first()
    columns: list[Column] = []
    for i, name in enumerate(texts.columns):
        value = F.col(_quoted(name))
        filled = found[f"filled_{i}"]
        dtype = None
        if found["rows"] and not filled:
            dtype = "double"
        elif filled and found[f"whole_{i}"] == filled:
            partial = filled < found["rows"]
            dtype = "double" if partial and nullable_int_as_double else "bigint"
        elif filled and found[f"number_{i}"] == filled:
            dtype = "double"
        elif filled and found[f"flag_{i}"] == filled:
            dtype = "boolean"
        columns.append(value.try_cast(dtype).alias(name) if dtype else value)
    return texts.select(*columns)


# ------------------------------------------------------------------ JSON


def _structure(spark: SparkSession, path: str) -> tuple[str, list[str], bool, int, int]:
    """First character, keys of the first record, whether the first line is an object of its own,
    and how many lines there are and are objects of their own. No text leaves the cluster."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    text = F.trim("value")
    own = text.startswith("{") & F.try_parse_json(text).isNotNull()
    head = lines.select(
        F.substring(text, 1, 1).alias("start"), own.alias("own"), F.when(own, F.json_object_keys(text)).alias("names")
    ).first()
    if head is None:
        return "", [], False, 0, 0
    count = lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(own).alias("own")).first()
    return head["start"], head["names"] or [], bool(head["own"]), count["lines"], count["own"]


def _is_object(text: Column) -> Column:
    return text.rlike(r"^[ \t\n\r]*\{") & F.try_parse_json(text).isNotNull()


def json_rejects(spark: SparkSession, path: str) -> DataFrame:
    """What (``value``) is no JSON object: of the lines of JSON Lines, or of the elements of an array."""
    if _structure(spark, path)[0] == "[":
        return json_elements(spark, path).where(~_is_object(F.col("value")))
    text = F.trim("value")
    return spark.read.text(path).where((text != "") & ~_is_object(text))


def _array_table(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """A row per object of an array, wherever its lines end; read by all tasks."""
    elements = json_elements(spark, path)
    own = _is_object(F.col("value"))
    found = elements.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(own).alias("own"), json_type(F.when(own, F.col("value"))).alias("type")).first()
    if found["own"] < found["rows"]:
        raise ValueError(f"Unable to parse JSON file {path}: {found['rows'] - found['own']} of {found['rows']} elements are no JSON object")
    schema = json_schema(found["type"])
    head = elements.limit(1).select(F.json_object_keys("value").alias("names")).collect()
    return json_rows(elements, "value", schema, head[0]["names"] if head else [], options)


def read_json(spark: SparkSession, path: str, **options) -> DataFrame:
    """A JSON document, or JSON Lines.

    The lines decide: if the first is an object of its own, or most are, the file is JSON
    Lines and a line that is not one is an error. Otherwise the file is one document: an
    array gives a row per object, an object one row, flattened when all its values are nested.
    """
    start, keys, first_own, lines, own = _structure(spark, path)
    if start not in ("[", "{"):
        raise ValueError(f"Unable to parse JSON file {path}: unsupported JSON structure")
    if start == "[":
        return _array_table(spark, path, options)
    if first_own or 2 * own > lines:
        if own < lines:
            raise ValueError(f"Unable to parse JSON file {path}: {lines - own} of {lines} lines are no JSON object")
        frame, single = spark.read.options(**options).json(path), lines == 1
        first = [k for k in keys if k in frame.columns]  # inference sorts the columns by name
        frame = frame.select(*[_quoted(c) for c in first + [c for c in frame.columns if c not in first]])
    else:
        frame, single = spark.read.option("multiLine", True).options(**options).json(path), True
        if "_corrupt_record" in frame.columns:
            raise ValueError(f"Unable to parse JSON file {path}")
    nested = (T.StructType, T.ArrayType, T.MapType)
    if single and all(isinstance(f.dataType, nested) for f in frame.schema.fields):
        return flatten(frame)
    return frame


# ------------------------------------------------------------------ Parquet, XML


def read_parquet(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    filters: Column | str | None = None,
    **options,
) -> DataFrame:
    """Parquet; ``columns`` and ``filters`` reach the scan."""
    frame = spark.read.options(**options).parquet(path)
    if filters is not None:
        frame = frame.where(filters)
    return frame.select(*columns) if columns else frame


def _row_tag(spark: SparkSession, path: str) -> str:
    """The name of the first element inside the root, by a pull parser that reads no further."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(target).isDirectory():
        parts = [s.getPath() for s in files.listStatus(target)]
        target = min((p for p in parts if p.getName()[0] not in "._"), key=lambda p: p.getName())
    factory = jvm.javax.xml.stream.XMLInputFactory.newInstance()
    factory.setProperty("javax.xml.stream.supportDTD", False)
    factory.setProperty("javax.xml.stream.isSupportingExternalEntities", False)
    stream = files.open(target)
    try:
        reader, found = factory.createXMLStreamReader(stream), 0
        while reader.hasNext():
            found += reader.next() == 1  # the start of an element
            if found == 2:
                return reader.getLocalName()
    finally:
        stream.close()
    raise ValueError(f"Unable to read XML file {path}: no rows inside the root element")


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None, **options) -> DataFrame:
    """XML with one element per row."""
    tag = row_tag or _row_tag(spark, path)
    return spark.read.format("xml").option("rowTag", tag).options(**options).load(path)


# ------------------------------------------------------------------ router


# What reads a file, by the ending of its name.
READERS = {
    "csv": read_csv, "json": read_json, "jsonl": read_json, "parquet": read_parquet, "xml": read_xml,
    "txt": read_text, "dat": read_text, "tsv": lambda spark, path, **options: read_text(spark, path, **{**options, "delimiter": "\t"}),
}


def get_supported_formats() -> list[str]:
    return list(READERS)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a file by its extension."""
    path = str(path)
    if not path_exists(spark, path):
        raise FileNotFoundError(f"File not found: {path}")
    extension = PurePosixPath(path).suffix.lower().lstrip(".")
    if extension not in READERS:
        raise ValueError(f"Unsupported file format: {extension}. Supported formats: {list(READERS)}")
    return READERS[extension](spark, path, **options)
