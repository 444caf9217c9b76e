"""Readers on files that are read in many splits."""

import json
import os

from contactlake.sources import readers


def test_lines_over_many_splits(spark, tmpdir_run):
    a = [f"  https://site{i}.example/{'x' * (i % 97)} " if i % 5 else "" for i in range(20_000)]
    b = ["only.example\r", "", " two.example"]
    for name, lines in (("a.txt", a), ("b.txt", b)):
        with open(os.path.join(tmpdir_run, name), "w", newline="") as f:
            f.write("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        t = readers.numbered_lines(spark, tmpdir_run)
        assert t.rdd.getNumPartitions() > 5
        rows = readers.url_lines(spark, tmpdir_run).collect()
        all_ = readers.url_lines(spark, tmpdir_run, across_files=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = sorted((r.file.rsplit("/", 1)[1], r.ord, r.raw) for r in rows)
    want = sorted([("a.txt", i, x.strip()) for i, x in enumerate(a) if x] + [("b.txt", 0, "only.example"), ("b.txt", 2, "two.example")])
    assert got == want
    assert sorted((r.ord, r.raw) for r in all_)[-2:] == [(20_000, "only.example"), (20_002, "two.example")]


def test_requests_over_splits(spark, tmpdir_run):
    bodies = [json.dumps({"businesses": [{"name": f"n{i}", "phone": None}, {"name": f"m{i}"}]}) if i % 3 else '{"businesses": [' for i in range(300)]
    with open(os.path.join(tmpdir_run, "r.jsonl"), "w") as f:
        f.write("\n".join(bodies) + "\n\n")
    rows, errors = readers.business_requests(spark, tmpdir_run)
    got = {(r.request.line, r.ord): (r.name, r.phone) for r in rows.collect()}
    assert got == {(i, k): (f"{c}{i}", "") for i in range(300) if i % 3 for k, c in enumerate("nm")}
    assert sorted(r.request.line for r in errors.collect()) == list(range(0, 300, 3))
