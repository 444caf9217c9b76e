"""Input readers: URL lists (S2) and business JSON (S3).

Files are read in splits.  A line's number follows from its place in its split
(rows of a split are consecutive in their task) and the counts of the splits
before it, a small table that is joined back; so a file of any size is many
tasks, and no task or row holds a whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from contactlake.functions.text import js_trim

BUSINESS_SCHEMA = StructType([StructField(c, StringType()) for c in
                              ["name", "phone", "email", "website", "address", "category"]])
REQUEST_SCHEMA = StructType([StructField("businesses", ArrayType(BUSINESS_SCHEMA))])


def numbered_lines(spark: SparkSession, path: str, across_files: bool = False) -> DataFrame:
    """(file, line, value) of text files cut at line feeds, blank lines
    included; ``line`` counts from 0 in each file, or with ``across_files``
    through all files in the order of their names."""
    t = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")
    splits = t.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("file", "block") if across_files else Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "block", (before - F.col("first")).alias("shift"))
    return t.join(starts, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("line"), "value")


def url_lines(spark: SparkSession, path: str, across_files: bool = False) -> DataFrame:
    """Text file(s) -> (file, ord, raw) for every non-blank line, trimmed;
    ``ord`` is the line's number (``numbered_lines``)."""
    t = numbered_lines(spark, path, across_files)
    return t.select("file", F.col("line").alias("ord"), js_trim("value").alias("raw")).where(F.col("raw") != "")


def url_lines_from_column(df: DataFrame, col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """S2 on a column holding newline-joined URLs (one request per row);
    ``keep`` names the columns that tell the requests apart."""
    lines = df.select(*keep, F.posexplode(F.split(F.col(col), "\n")).alias("pos", "raw"))
    return lines.select(*keep, F.col("pos").cast(LongType()).alias("ord"), js_trim("raw").alias("raw")) \
                .where(F.col("raw") != "")


def business_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3 on JSON Lines of request bodies: (rows, errors) as in
    ``businesses_from_column``; request is (file, line number)."""
    t = numbered_lines(spark, path).where(js_trim("value") != "")
    t = t.select(F.struct("file", "line").alias("request"), F.col("value").alias("body"))
    return businesses_from_column(t, "request", "body")


def businesses_from_column(df: DataFrame, request: str, body: str) -> tuple[DataFrame, DataFrame]:
    """S3: request bodies ``{"businesses": [...]}`` -> rows (request, ord,
    fields; ord is the place in the request) and errors (request, body, error)
    for bodies that are no such object."""
    t = df.select(F.col(request).alias("request"), F.col(body).alias("body"),
                  F.from_json(F.col(body), REQUEST_SCHEMA)["businesses"].alias("b"))
    rows = t.where(F.col("b").isNotNull()).select("request", F.posexplode("b").alias("ord", "r")).select(
        "request", F.col("ord").cast(LongType()).alias("ord"),
        *[F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c) for c in BUSINESS_SCHEMA.fieldNames()])
    errors = t.where(F.col("b").isNull()).select("request", "body", F.lit("Invalid businesses data").alias("error"))
    return rows, errors
