"""Files whose records lines do not delimit, cut into many ranges."""

import csv
import io
import json
import random

import pytest

from gaugewell.sources import files, ranges
from gaugewell.sources.files import json_rejects, load, long_rows, read_csv, read_json, read_text


@pytest.fixture
def small_ranges(spark):
    """Many ranges of odd and even sizes in small files."""
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def scan_tasks(frame):
    return frame.rdd.getNumPartitions()


def table(draw, rows, letters):
    """Rows of fields with breaks, quotes and separators in them."""
    out = []
    for i in range(rows):
        kind = draw.random()
        field = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))
        if kind < 0.2:
            field += draw.choice(["\n", "\n\n", ',"\n', '"\n"', "\n,x\n"]) + "tail"
        if kind < 0.02:  # goes over several ranges
            field += "long line\n" * 300
        out.append((f"id{i}", field, f"v{draw.randint(0, 9)}x"))
    return out


def as_csv(rows, sep, draw):
    out = io.StringIO()
    for row in [("id", "field", "last"), *rows]:
        csv.writer(out, delimiter=sep, lineterminator=draw.choice(["\n", "\r\n"])).writerow(row)
        if draw.random() < 0.05:
            out.write("\n")
    return out.getvalue()


def clean(text):
    return None if text in files.CSV_NULL_TOKENS or text == "" else text


@pytest.mark.parametrize("encoding, letters", [
    ("utf-8", "abé漢 ,\"'"), ("utf-8-sig", "ab,\""), ("iso-8859-1", "abéÿ,\"'"),
    ("utf-16-le", "ab਋Ā਀ਢ,\"😀"), ("utf-16-be", "ab਋Ā\u000b∀,\"😀"), ("utf-16", "ab,\"é")])
@pytest.mark.parametrize("size", [1701])
def test_line_ends_inside_quotes(spark, tmp_path, small_ranges, encoding, letters, size):
    draw = random.Random(f"{encoding}{size}")
    rows = table(draw, 250, letters)
    text = as_csv(rows, ",", draw)
    data = text.encode(encoding)
    if encoding in ("utf-16-le", "utf-16-be"):
        data = "﻿".encode(encoding) + data
    path = tmp_path / "t.csv"
    path.write_bytes(data)
    small_ranges(size)
    frame = read_csv(spark, str(path), typed=False)
    assert frame.columns == ["id", "field", "last"]
    assert scan_tasks(spark.read.text(str(path))) > 3
    assert sorted(map(tuple, frame.collect())) == sorted(tuple(map(clean, r)) for r in rows)
    assert "binaryFile" not in frame._jdf.queryExecution().toString()


def test_quotes_inside_fields_open_nothing(spark, tmp_path, small_ranges):
    lines = ["a,b,c"]
    for i in range(300):
        lines.append(draw_line := f'{i},5" pipe {i},"x ""y"" {i}"')
        if i % 7 == 0:
            lines.append(f'n{i},"two\nlines" and "more,z')
    path = tmp_path / "q.csv"
    path.write_text("\n".join(lines))
    small_ranges(512)
    found = {r.a: (r.b, r.c) for r in read_csv(spark, str(path), typed=False).collect()}
    assert len(found) == 343 and draw_line
    assert found["5"] == ('5" pipe 5', 'x "y" 5') and found["n7"][1] == "z" and found["n7"][0].startswith('"two\nlines')
    whole = read_csv(spark, str(path), typed=False, multiline=True).collect()
    assert {r.a: (r.b, r.c) for r in whole} == found


def test_several_files_each_with_its_header(spark, tmp_path, small_ranges):
    expected = []
    for number in range(4):
        rows = [(f"{number}-{i}", f"x\ny{i}" if i % 3 else "plain") for i in range(50 * number)]
        expected += rows
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([("k", "v"), *rows])
        (tmp_path / f"part{number}.csv").write_text(out.getvalue())
    small_ranges(333)
    found = read_csv(spark, str(tmp_path), typed=False)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_long_rows_and_other_separators_over_lines(spark, tmp_path, small_ranges):
    small_ranges(64)
    path = tmp_path / "l.csv"
    path.write_text('a,b\n1,"x\ny"\n2,"p\nq",3\n4,5\n')
    assert [r.raw for r in long_rows(spark, str(path)).collect()] == ['2,"p\nq",3']
    with pytest.raises(ValueError, match="1 rows are longer"):
        read_csv(spark, str(path), fallback=False)
    assert sorted(r.a for r in read_csv(spark, str(path), cut_long_rows=True).collect()) == [1, 2, 4]
    path = tmp_path / "s.csv"
    path.write_text('a;b\n1;"x,\ny"\n2;"x,,\ny"\n')
    assert sorted(map(tuple, load(spark, str(path)).collect())) == [(1, "x,\ny"), (2, "x,,\ny")]
    path = tmp_path / "t.tsv"
    path.write_bytes('a\ta\t\n1\t"x\n\ty"\t2\n'.encode("utf-16"))
    frame = read_text(spark, str(path))
    assert frame.columns == ["a0", "a1", "_c2"] and tuple(frame.first()) == (1, "x\n\ty", 2)


def test_a_quote_that_never_closes_and_empty_files(spark, tmp_path, small_ranges):
    small_ranges(16)
    path = tmp_path / "o.csv"
    path.write_text('a,b\n1,2\n3,"open\n5,6\n7,8\n')
    assert sorted(map(tuple, read_csv(spark, str(path), typed=False).collect())) == [("1", "2"), ("3", "open\n5,6\n7,8")]
    (tmp_path / "e.csv").write_text("")
    assert read_csv(spark, str(tmp_path / "e.csv"), multiline=True).count() == 0


def documents(draw, count):
    def value(depth):
        kind = draw.randrange(9 if depth < 3 else 6)
        if kind == 6:
            return {draw.choice(["k", "}", "[", '"q"', "\\"]): value(depth + 1) for _ in range(draw.randint(0, 3))}
        if kind == 7:
            return [value(depth + 1) for _ in range(draw.randint(0, 3))]
        return [draw.randint(-9, 9), draw.random(), True, None, "".join(draw.choice('ab{}[],:"\\\n é') for _ in range(draw.randint(0, 40))), "}" * 9, "x" * 20, "\\", "]"][kind]
    return [{"id": i, "text": "".join(draw.choice('a}]{["\\,') for _ in range(draw.choice([0, 5, 60, 900]))), "any": json.dumps(value(0)), "n": draw.choice([1, 2.5])} for i in range(count)]


@pytest.mark.parametrize("indent, size", [(None, 6000), (2, 7001)])
def test_json_arrays_by_ranges(spark, tmp_path, small_ranges, indent, size):
    draw = random.Random(f"{indent}{size}")
    found = documents(draw, 200)
    path = tmp_path / "a.json"
    path.write_text(" \n" + json.dumps(found, indent=indent, ensure_ascii=draw.random() < 0.5) + "\n")
    small_ranges(size)
    frame = read_json(spark, str(path))
    assert frame.columns == ["id", "text", "any", "n"] and dict(frame.dtypes) == {"id": "bigint", "text": "string", "any": "string", "n": "double"}
    assert sorted((r.id, r.text, r.any, r.n) for r in frame.collect()) == [(d["id"], d["text"], d["any"], float(d["n"])) for d in found]
    assert scan_tasks(ranges.json_elements(spark, str(path))) > 3
    assert json_rejects(spark, str(path)).count() == 0


def test_json_elements_that_are_no_objects(spark, tmp_path, small_ranges):
    elements = ['{"a": {"b": [1, 2.5]}, "s": "}{"}', "1", '"x,]"', "[1, {\"q\": 2}]", '{"a": }', "null", '{"e": {}, "big": 123456789012345678901}']
    path = tmp_path / "m.json"
    path.write_text("[" + " ,\n".join(elements * 40) + "]")
    small_ranges(128)
    assert sorted(r.value.strip() for r in json_rejects(spark, str(path)).collect()) == sorted(e for e in elements * 40 if e not in (elements[0], elements[6]))
    with pytest.raises(ValueError, match="200 of 280 elements"):
        read_json(spark, str(path))
    path.write_text("[" + ",".join([elements[0], elements[6]] * 40) + "]")
    frame = read_json(spark, str(path))
    assert dict(frame.dtypes) == {"a": "struct<b:array<double>>", "s": "string", "big": "decimal(21,0)"}
    assert frame.where("a.b[1] = 2.5").count() == frame.where("big is not null").count() == 40
    for broken in ('[{"a": 1}, {"b": "open]', '[{"a": 1}', '[{"a": 1}]]', '[{"a": [1}]'):
        path.write_text(broken)
        with pytest.raises(ValueError):
            read_json(spark, str(path))
    path.write_text("[ \n ]")
    assert read_json(spark, str(path)).count() == 0


def test_latin_files_of_one_task_keep_their_headers_apart(spark, tmp_path, small_ranges):
    """The query's input is many files, of which a task may copy several."""
    from gaugewell.plans.queries import QUERIES

    spark.range(40).selectExpr("id * 20000 AS c_custkey", "'Customer' || id AS c_name").write.parquet(str(tmp_path / "customer.parquet"))
    small_ranges(1 << 20)
    rows = QUERIES["read_csv_quoted_line_ends_iso_8859_1"](spark, str(tmp_path))
    assert sorted(r.key for r in rows.collect()) == [i * 20000 for i in range(40)]
