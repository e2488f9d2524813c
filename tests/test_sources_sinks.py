"""Readers, writers and topics."""

import json

import pytest
from pyspark.sql import functions as F

from gaugewell.operators.clean import to_records
from gaugewell.plans.queries import QUERIES
from gaugewell.sources.files import (
    detect_encoding,
    get_supported_formats,
    load,
    read_csv,
    read_json,
    read_text,
    read_xml,
)
from gaugewell.sources.sinks import save
from gaugewell.sources.topics import FileTopic, KafkaTopic
from gaugewell.streaming.payload import decode, encode, is_payload


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.mark.parametrize(("encoding", "found"), [
    ("utf-8", "UTF-8"), ("utf-16", "UTF-16"), ("latin-1", "ISO-8859-1"),
])
def test_encodings(spark, tmp_path, encoding, found):
    path = write(tmp_path / "t.csv", "name,n\nZürich,1\nGenève,2\n", encoding)
    assert detect_encoding(spark, path) == found
    assert rows(load(spark, path)) == [("Zürich", 1), ("Genève", 2)]


def test_separator_fallback(spark, tmp_path):
    # no row has too many fields under ',', so the file stays one column
    path = write(tmp_path / "a.csv", "x;y\n1;2\n")
    assert load(spark, path).columns == ["x;y"]
    path = write(tmp_path / "b.csv", "x;y\n1,5;2,5\n3;4\n")
    assert rows(load(spark, path)) == [("1,5", "2,5"), ("3", "4")]
    path = write(tmp_path / "c.csv", "x,y\n1,2,3\n")
    assert load(spark, path).columns == ["x,y"]  # the first separator that fits
    path = write(tmp_path / "d.csv", "x,y;z|w\tv\n1,2,3;1;2|3|4\t5\t6\n")
    with pytest.raises(ValueError, match="Unable to read file"):
        load(spark, path)


def test_types_and_null_tokens(spark, tmp_path):
    path = write(tmp_path / "t.csv", "i,j,f,b,s,e\n1,1,1.5,TRUE,NULL,\n2,,2,False,x,NaN\n")
    frame = load(spark, path)
    kinds = [f.dataType.simpleString() for f in frame.schema.fields]
    assert kinds == ["bigint", "double", "double", "boolean", "string", "double"]
    assert rows(frame)[0] == (1, 1.0, 1.5, True, None, None)
    exact = read_csv(spark, path, nullable_int_as_double=False)
    assert dict(exact.dtypes)["j"] == "bigint"


def test_cleaning_keeps_whitespace_only_text(spark):
    frame = spark.createDataFrame([(" NULL ", "  "), ("None", " nan "), (None, None)], [" a b ", "c"])
    assert to_records(frame).columns == ["a_b", "c"]
    assert rows(to_records(frame)) == [("NULL", "")]


def test_delimited_text(spark, tmp_path):
    assert rows(load(spark, write(tmp_path / "t.tsv", "x\ty\n1\tq\n"))) == [(1, "q")]
    assert rows(load(spark, write(tmp_path / "t.dat", "x\ty\n1\tq\n"))) == [(1, "q")]
    path = write(tmp_path / "t.txt", "x|y\n1|q\n")
    assert rows(load(spark, path, delimiter="|")) == [(1, "q")]
    assert read_text(spark, path).columns == ["x|y"]


def test_json_forms(spark, tmp_path):
    array = write(tmp_path / "a.json", json.dumps([{"z": 1, "a": "x"}, {"z": 2, "a": None}], indent=2))
    assert {(r.z, r.a) for r in load(spark, array).collect()} == {(1, "x"), (2, None)}
    one = write(tmp_path / "o.json", json.dumps({"z": 1, "n": {"m": 2}}, indent=2))
    assert load(spark, one).first().n.m == 2
    nested = write(tmp_path / "n.json", json.dumps({"p": {"q": {"r": 1}}, "l": [1, 2]}, indent=2))
    flat = load(spark, nested)
    assert set(flat.columns) == {"p.q.r", "l"}
    lines = write(tmp_path / "l.jsonl", '{"z": 1, "a": {"b": 2}}\n{"z": 2}\n')
    frame = load(spark, lines)
    assert frame.columns == ["z", "a"] and frame.count() == 2
    with pytest.raises(ValueError):
        read_json(spark, write(tmp_path / "s.json", "42"))
    with pytest.raises(ValueError):
        read_json(spark, write(tmp_path / "b.json", "{\n broken"))


def test_xml(spark, tmp_path):
    path = write(tmp_path / "t.xml", "<?xml version='1.0'?><rows><row><a>1</a><b>x</b></row>"
                                     "<row><a>2</a><b>y</b></row></rows>")
    assert rows(load(spark, path)) == [(1, "x"), (2, "y")]
    assert read_xml(spark, path, row_tag="row").count() == 2


def test_router_refuses(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="Unsupported file format"):
        load(spark, write(tmp_path / "t.xlsx", "x"))
    assert "csv" in get_supported_formats()


@pytest.mark.parametrize("format", ["csv", "json", "parquet"])
def test_save_and_load(spark, tmp_path, format):
    frame = spark.createDataFrame([(1, "a, \"b\"", 1.5), (2, None, None)], "i int, s string, x double")
    path = save(frame, str(tmp_path / "deep" / f"t.{format}"))
    loaded = load(spark, path).select("i", "s", "x")
    assert sorted(rows(loaded)) == [(1, 'a, "b"', 1.5), (2, None, None)]


def test_save_refuses_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported output format"):
        save(spark.range(1), str(tmp_path / "t.xyz"))


def test_payloads(spark):
    frame = spark.sql("SELECT 1 AS id, timestamp'2024-01-02 03:04:05' AS t, "
                      "timestamp'2024-01-02 03:04:05.5' AS u, CAST('NaN' AS DOUBLE) AS x, NULL AS n")
    message = encode(frame, "id").first()
    assert message.key == "1"
    assert json.loads(message.value) == {
        "id": 1, "t": "2024-01-02T03:04:05", "u": "2024-01-02T03:04:05.500000", "x": None, "n": None,
    }
    texts = ['{"a": 1}', ' {"a": 1} ', '{"a": 1', "", '{"a": 1}}', "[1]", "5", None]
    messages = spark.createDataFrame([(t,) for t in texts], "value string")
    good = [r.ok for r in messages.select(is_payload(F.col("value")).alias("ok")).collect()]
    assert good == [True, True] + [False] * 6
    assert rows(decode(messages, "a int")) == [(1,), (1,)]


def test_kafka_options():
    topic = KafkaTopic("t", ["a:1", "b:2"], max_offsets_per_batch=100)
    source = topic.source_options()
    assert source["subscribe"] == "t" and source["startingOffsets"] == "earliest"
    assert source["kafka.bootstrap.servers"] == "a:1,b:2" and source["maxOffsetsPerTrigger"] == "100"
    sink = topic.sink_options()
    assert sink["kafka.compression.type"] == "snappy" and sink["kafka.acks"] == "all"


def test_file_topic_round_trip(spark, tmp_path):
    topic = FileTopic(str(tmp_path / "topic"))
    topic.write(encode(spark.range(3)))
    topic.write(encode(spark.range(3, 5)))
    assert {r.id for r in decode(topic.read(spark), "id bigint").collect()} == set(range(5))


def test_readers_raise_rather_than_lose_rows(spark, tmp_path):
    good = "".join(f'{{"a": {i}}}\n' for i in range(110))
    with pytest.raises(ValueError, match="1 of 111"):
        load(spark, write(tmp_path / "bad.jsonl", good + '{"a": 1,,}\n'))
    with pytest.raises(ValueError, match="1 of 111"):
        load(spark, write(tmp_path / "bad_first.jsonl", '{"a": 1\n' + good))
    for name in ("t.tsv", "t.dat"):
        with pytest.raises(ValueError, match="longer than the header"):
            load(spark, write(tmp_path / ("long_" + name), "x\ty\n1\t2\t3\n"))
    with pytest.raises(ValueError, match="longer than the header"):
        read_csv(spark, write(tmp_path / "empty_fields.csv", "x,y\n1,2,,\n"), fallback=False)
    assert rows(load(spark, write(tmp_path / "short.csv", 'x,y\n1\n"a,b",2\n'))) == [("1", None), ("a,b", 2.0)]


def test_json_documents_by_structure(spark, tmp_path):
    assert load(spark, write(tmp_path / "one_line.json", '[{"a": 1}, {"a": 2}]')).count() == 2
    nested = '{\n "items": [\n  {"a": 1},\n  {"a": 2}\n ],\n "n": 2\n}'
    assert load(spark, write(tmp_path / "document.json", nested)).count() == 1


def test_xml_rows_behind_comments(spark, tmp_path):
    comment = "<!-- <note> not a row\n" + "line\n" * 60 + "-->"
    path = write(tmp_path / "c.xml", f"<?xml version='1.0'?>{comment}<rows><row><a>1</a></row><row><a>2</a></row></rows>")
    assert sorted(r.a for r in load(spark, path).collect()) == [1, 2]


@pytest.mark.parametrize("name", ["csv_long_rows", "tsv_long_rows"])
def test_files_of_long_rows_grow_in_number(spark, name):
    files = QUERIES[name](spark, "/root/testdata/sf0.1").inputFiles()
    sizes = [r["count"] for r in spark.read.text(files).groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) == len(sizes) + 15_000 and max(sizes) <= 1001
