"""Structured Streaming variants.

* ``contacts_stream``: new pages (a Parquet folder) -> T3/T4/T6/T7 per page
  -> Parquet sink.  Stateless and narrow, so each micro-batch is the batch
  operator on the new files.
* ``accumulate_stream``: result pages arriving over time -> J6.  The table is
  partitioned by micro-batch; a batch writes its own partition and overwrites
  only that, so one that failed half-way and runs again leaves no duplicates.
  A batch reads of the earlier ones only (query, name, first page), which is
  the state: a row stays if its name is new and its page is the first with it
  in the batch, or if its page is the name's first page (so a page split over
  two batches keeps its repeats).  Assumes pages of one query arrive in page
  order, as they do in the source (page k is requested after page k-1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.operators.enrich import page_contacts

PAGE_SCHEMA = "page_id long, url string, html string"


def contacts_stream(spark: SparkSession, pages_dir: str, out_dir: str, checkpoint_dir: str,
                    available_now: bool = True):
    """Start the contact-extraction stream; returns the StreamingQuery."""
    pages = spark.readStream.schema(PAGE_SCHEMA).parquet(pages_dir)
    c = page_contacts(pages)
    w = (c.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _append_new(table_dir: str):
    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("query", "name").agg(F.min("page").alias("__first"))
        if _exists(spark, table_dir):
            held = (spark.read.parquet(table_dir).where(F.col("epoch") < epoch_id)
                    .groupBy("query", "name").agg(F.min("page").alias("__held")))
            same = first["query"].eqNullSafe(held["query"]) & first["name"].eqNullSafe(held["name"])
            first = first.join(held, same, "left").select(
                first["query"], first["name"], F.coalesce("__held", "__first").alias("__first"))
        same = batch["query"].eqNullSafe(first["query"]) & batch["name"].eqNullSafe(first["name"])
        fresh = batch.join(first, same & (batch["page"] == first["__first"]), "left_semi")
        fresh.write.mode("overwrite").parquet(f"{table_dir}/epoch={epoch_id}")
    return run


def accumulate_stream(spark: SparkSession, pages_dir: str, schema: str, table_dir: str,
                      checkpoint_dir: str, available_now: bool = True):
    """Start the J6 accumulation stream over result rows with columns
    (query, page, name, ...); returns the StreamingQuery."""
    rows = spark.readStream.schema(schema).parquet(pages_dir)
    w = rows.writeStream.foreachBatch(_append_new(table_dir)).option("checkpointLocation", checkpoint_dir)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
