"""Costly rows are dealt out over the tasks and computed once."""

from pathlib import Path

from pyspark.sql import functions as F

from contactlake.operators import batches, reports
from contactlake.plans.queries import REGISTRY
from contactlake.sinks import export
from contactlake.sources import fixtures, tables


def customers(spark, folder, n=90):
    """One small file of customers."""
    t = spark.range(n).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment"))
    t.coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def counted(spark, n=40):
    """Rows with an ord, and how often one of them was computed."""
    seen = spark.sparkContext.accumulator(0)

    def tick(x):
        seen.add(1)
        return x

    t = spark.range(n).repartition(4)
    return t.select(F.udf(tick, "long")("id").alias("ord")), seen


def test_spread_one_file_over_the_cores(spark, tmpdir_run):
    folder = customers(spark, tmpdir_run)
    one = tables.read_table(spark, folder, "customer")
    assert one.rdd.getNumPartitions() == 1
    assert fixtures.businesses(spark, folder).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(tables.spread(one).collect()) == sorted(one.collect())
    wide = spark.range(9).repartition(3 * spark.sparkContext.defaultParallelism + 1)
    assert tables.spread(wide) is wide


def test_pairs_read_computed_features(spark, tmpdir_run):
    pairs = REGISTRY["duplicate_pairs"](spark, customers(spark, tmpdir_run))
    assert "parquet" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() > 0


def test_short_phones_meet_contained_ones(spark):
    from contactlake.operators import dedup
    rows = [(1, "Harbor Bakery Shop", "212-555-0101", "a@h.example", "h.example", "1 Quay"),
            (2, "Harbor Bakery Shop", "0101", "a@h.example", "h.example", "1 Quay"),
            (3, "Harbor Bakery Shop", "212-555-0101", "a@g.example", "g.example", "2 Quay")]
    t = spark.createDataFrame(rows, "ord long, name string, phone string, email string, website string, address string")
    feat = t.transform(dedup.with_dedup_features()).select(*dedup.FEATURE_COLS)
    assert [tuple(r) for r in dedup.duplicate_edges(feat).select("a", "b").collect()] == [(1, 2)]


def test_page_index_computes_rows_once(spark, tmpdir_run):
    t, seen = counted(spark)
    reports.write_page_index(t, f"{tmpdir_run}/index")
    assert seen.value == 40
    assert [r["ord"] for r in reports.indexed_page(spark, f"{tmpdir_run}/index", 3).collect()] == list(range(20, 30))


def test_numbering_computes_rows_once(spark):
    t, seen = counted(spark)
    got = sorted((r["ord"], r["number"]) for r in export.numbered(t).collect())
    assert got == [(i, i + 1) for i in range(40)]
    assert seen.value == 40


def test_export_filters_computed_rows(spark, tmpdir_run):
    from contactlake.plans.queries import without_website
    t = without_website(spark, customers(spark, tmpdir_run))
    assert "parquet" not in t._jdf.queryExecution().optimizedPlan().toString()
    assert t.count() > 0


def test_state_bucket_is_one_file(spark, tmpdir_run):
    b = fixtures.businesses(spark, customers(spark, tmpdir_run)).repartition(8)
    folder = f"{tmpdir_run}/state"
    first = batches.dedup_batch(b.where("ord < 60"), folder, 0)
    second = batches.dedup_batch(b.where("ord >= 60"), folder, 1)
    assert first.count() and second.count()
    # adaptive reading may split nothing here, so each bucket was written by one task
    leaves = [p for p in Path(folder).rglob("bucket=*") if p.is_dir()]
    assert leaves and all(len(list(p.glob("*.parquet"))) == 1 for p in leaves)
