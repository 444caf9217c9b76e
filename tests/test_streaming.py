"""Streaming replays equal the batch operators."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from contactlake.operators.enrich import page_contacts
from contactlake.operators.reports import accumulate_pages
from contactlake.sources import fixtures
from contactlake.streaming.incremental import accumulate_stream, contacts_stream


def test_contacts_stream_equals_batch(spark, tmpdir_run):
    src = os.path.join(tmpdir_run, "pages")
    fixtures.site_pages(spark, SF_SMALL).write.parquet(src)
    out = os.path.join(tmpdir_run, "contacts")
    q = contacts_stream(spark, src, out, os.path.join(tmpdir_run, "ck1"))
    q.awaitTermination(300)
    got = spark.read.parquet(out).select("url", "best_email", "best_phone")
    want = page_contacts(spark.read.parquet(src)).select("url", "best_email", "best_phone")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_accumulate_stream_equals_batch(spark, tmpdir_run):
    b = fixtures.businesses(spark, SF_SMALL).withColumn("query", F.col("category")) \
        .withColumn("page", (F.floor(F.col("ord") / 50) + 1).cast("long"))
    src = os.path.join(tmpdir_run, "rows")
    table = os.path.join(tmpdir_run, "acc")
    schema = b.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    # Pages arrive in order: one file per page number, one stream run each.
    for p in sorted(r.page for r in b.select("page").distinct().collect()):
        b.where(F.col("page") == p).write.mode("append").parquet(src)
        q = accumulate_stream(spark, src, schema, table, os.path.join(tmpdir_run, "ck2"))
        q.awaitTermination(300)
    got = spark.read.parquet(table).select("query", "page", "ord")
    want = accumulate_pages(b).select("query", "page", "ord")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_split_page_and_repeated_batch(spark, tmpdir_run):
    from contactlake.streaming.incremental import _append_new
    table = os.path.join(tmpdir_run, "acc2")
    run = _append_new(table)
    make = lambda rows: spark.createDataFrame(rows, "query string, page long, name string, ord long")
    run(make([("q", 1, "a", 1), ("q", 1, None, 2)]), 0)
    second = make([("q", 1, "a", 3), ("q", 2, "a", 4), ("q", 2, "b", 5), ("q", 2, None, 6)])
    run(second, 1)
    run(second, 1)                                      # the batch runs again after a failure
    run(make([("q", 3, "b", 7), ("q", 3, "c", 8)]), 2)
    got = sorted(r.ord for r in spark.read.parquet(table).collect())
    assert got == [1, 2, 3, 5, 8]
