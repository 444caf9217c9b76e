"""Round trips for the exports (S5-S8) and the readers."""

import csv
import glob
import json
import os

import pytest

from contactlake.sinks.export import (export_name, write_csv, write_json_array, write_json_lines,
                                      write_txt)
from contactlake.sources.readers import business_requests, url_lines

ROWS = [(1, "A, Inc.", "Cat", "", "a@x.com", "https://a.com/", 'Say "hi"'),
        (2, " lead", "", "(212) 555-0100", "", "", "line\nbreak"),
        (3, "C", "Cat\r2", "", "", "", "")]
SCHEMA = "ord long, name string, category string, phone string, email string, website string, address string"


def _read_all(path, pattern="part-*"):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(os.path.join(path, pattern))))


def test_csv_round_trip(spark, tmpdir_run):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = os.path.join(tmpdir_run, "csv")
    write_csv(df, out, single_file=True)
    rows = list(csv.reader(_read_all(out).splitlines(keepends=True)))
    assert rows[0] == ["Business Name", "Category", "Phone", "Email", "Website", "Address"]
    assert rows[1] == ["A, Inc.", "Cat", "", "a@x.com", "https://a.com/", 'Say "hi"']
    assert rows[2][0] == " lead" and rows[2][5] == "line\nbreak"
    assert len(rows) == 4
    many = os.path.join(tmpdir_run, "csv_parts")
    write_csv(df.repartition(3), many)
    assert _read_all(many) == _read_all(out)            # one header, whatever the parts


def test_json_round_trip(spark, tmpdir_run):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = os.path.join(tmpdir_run, "jsonl")
    write_json_lines(df, out, fields=["name", "phone"], single_file=True)
    objs = [json.loads(x) for x in _read_all(out).splitlines()]
    assert objs == [{"name": "A, Inc.", "phone": ""}, {"name": " lead", "phone": "(212) 555-0100"},
                    {"name": "C", "phone": ""}]
    arr = os.path.join(tmpdir_run, "jsonarr")
    write_json_array(df, arr, fields=["name", "address"])
    text = _read_all(arr)
    expected = [{"name": r[1], "address": r[6]} for r in ROWS]
    assert json.loads(text) == expected
    assert text == json.dumps(expected, indent=2, ensure_ascii=False) + "\n"


def test_txt_layout_and_guards(spark, tmpdir_run):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = os.path.join(tmpdir_run, "txt")
    write_txt(df, out, fields=["name", "phone"], only_without_website=True)
    text = _read_all(out)
    assert text.startswith("Business 1:\n" + "=" * 21 + "\nBusiness Name:  lead\nPhone: (212) 555-0100\n\n")
    assert "Business 2:\n" + "=" * 21 + "\nBusiness Name: C\nPhone: N/A\n" in text
    empty = spark.createDataFrame([(i, None, None) for i in range(20)], "ord long, name string, phone string")
    write_txt(empty.repartition(5), out, fields=["name", "phone"])
    assert [x for x in _read_all(out).split("\n") if x.startswith("Business ") and x.endswith(":")] == [f"Business {i}:" for i in range(1, 21)]
    with pytest.raises(ValueError):
        write_txt(df, out, fields=[])
    assert export_name(True, "csv") == "businesses-without-website.csv"


def test_readers(spark, tmpdir_run):
    p = os.path.join(tmpdir_run, "urls.txt")
    open(p, "w").write("a.com\n\n  b.com  \n")
    assert [r.raw for r in url_lines(spark, p).orderBy("ord").collect()] == ["a.com", "b.com"]
    j = os.path.join(tmpdir_run, "req.json")
    open(j, "w").write('{"businesses": [{"name": "A", "phone": "1"}, {"name": "B"}]}\n{"businesses": 5}\n')
    open(j, "a").write('{"businesses": [{"name": "C"}]}\nnot json\n')
    rows, errors = business_requests(spark, j)
    got = rows.orderBy("request", "ord").collect()
    assert [(r.request.line, r.ord, r.name, r.phone) for r in got] == [(0, 0, "A", "1"), (0, 1, "B", ""), (2, 0, "C", "")]
    assert [(r.request.line, r.body) for r in errors.orderBy("request").collect()] == [(1, '{"businesses": 5}'), (3, "not json")]
