"""Reports, filters, display text and paging.

All aggregates are single-pass ``agg`` calls (partial aggregation before the
shuffle; no per-row driver work).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactlake.functions.text import col_, js_round, nonblank
from contactlake.session import ensure_checkpoint_dir

# --- fixed values: export fields in order, with their labels ---------------
EXPORT_FIELDS = [("name", "Business Name"), ("category", "Category"), ("phone", "Phone"),
                 ("email", "Email"), ("website", "Website"), ("address", "Address")]
PAGE_SIZE = 10
CATEGORY_DISPLAY_MAX, ADDRESS_DISPLAY_MAX = 60, 25


def coverage_stats(df: DataFrame) -> DataFrame:
    """A1: total rows and rows with a non-blank phone, e-mail, website."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(nonblank("phone")).alias("with_phone"),
                  F.count_if(nonblank("email")).alias("with_email"),
                  F.count_if(nonblank("website")).alias("with_website"))


def without_website(df: DataFrame) -> DataFrame:
    """website empty or blank."""
    return df.where(~nonblank("website"))


def export_counts(df: DataFrame) -> DataFrame:
    """A2: rows without a website; per-field counts for both export scopes
    (all rows / only rows without a website)."""
    nw = ~nonblank("website")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(nw).alias("without_website"),
        F.count_if(nonblank("phone")).alias("all_phone"),
        F.count_if(nonblank("email")).alias("all_email"),
        F.count_if(nonblank("website")).alias("all_website"),
        F.count_if(nw & nonblank("phone")).alias("nw_phone"),
        F.count_if(nw & nonblank("email")).alias("nw_email"),
        F.count_if(nw & nonblank("website")).alias("nw_website"))


def select_fields(df: DataFrame, fields=None, labels: bool = True) -> DataFrame:
    """chosen fields in the fixed order, optionally renamed to labels."""
    chosen = [(k, lab) for k, lab in EXPORT_FIELDS if fields is None or k in fields]
    if not chosen:
        raise ValueError("no export field selected")
    return df.select(*[F.coalesce(F.col(k), F.lit("")).alias(lab if labels else k) for k, lab in chosen])


def _cut(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def display_columns() -> list[Column]:
    """list texts (category <= 60, address <= 25 chars, placeholders)."""
    def present(c):
        return F.coalesce(col_(c), F.lit("")) != ""
    return [
        F.when(present("category"), _cut(F.col("category"), CATEGORY_DISPLAY_MAX)).otherwise(F.lit(""))
         .alias("category_text"),
        F.when(present("phone"), F.col("phone")).otherwise(F.lit("No phone")).alias("phone_text"),
        F.when(present("email"), F.col("email")).otherwise(F.lit("No email")).alias("email_text"),
        F.when(present("website"), F.col("website")).otherwise(F.lit("No website")).alias("website_text"),
        F.when(present("address"), _cut(F.col("address"), ADDRESS_DISPLAY_MAX)).otherwise(F.lit("No address"))
         .alias("address_text"),
    ]


def page_slice(df: DataFrame, page: int, page_size: int = PAGE_SIZE, order: str = "ord") -> DataFrame:
    """L2: rows [(p-1)*size, p*size) by ``order`` (a top-k style limit)."""
    return df.orderBy(order).offset((page - 1) * page_size).limit(page_size)


def write_page_index(df: DataFrame, path: str, order: str = "ord") -> None:
    """A rank index under ``path``, written once: the rows dealt and sorted by
    ranges of ``order``, and where each range starts."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # computed once: the range bounds are sampled from the rows before these are dealt
    rows = df.checkpoint(eager=True).repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()).sortWithinPartitions(order)
    rows.write.partitionBy("__part").parquet(f"{path}/rows")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)        # a row a range
    counts = spark.read.parquet(f"{path}/rows").groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).write.parquet(f"{path}/starts")


def indexed_page(spark: SparkSession, path: str, page: int, page_size: int = PAGE_SIZE, order: str = "ord") -> DataFrame:
    """L2 on a rank index: reads only the ranges that hold rows of the page,
    however deep it lies."""
    first = (page - 1) * page_size
    starts = spark.read.parquet(f"{path}/starts").where((F.col("start") < first + page_size) & (F.col("start") + F.col("n") > first))
    parts = {r["__part"]: r["start"] for r in starts.collect()}                         # page_size ranges at most
    rows = spark.read.parquet(f"{path}/rows").where(F.col("__part").isin(list(parts))).drop("__part")
    return rows.orderBy(order).offset(first - min(parts.values(), default=first)).limit(page_size)


def numbered_within(df: DataFrame, group: str, order: str = "ord", out: str = "number", width: int = 1000) -> DataFrame:
    """``df`` with consecutive numbers from 1 by ``order`` (integers) inside
    each group: rows are numbered inside stretches of ``width`` order values,
    and the rows of earlier stretches, counted per group, are added.  So a
    window holds one stretch, however large the group is."""
    t = df.withColumn("__s", F.floor(F.col(order) / width))
    w = Window.partitionBy(group).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    before = t.groupBy(group, "__s").agg(F.count(F.lit(1)).alias("__n")).select(
        F.col(group).alias("__g"), F.col("__s").alias("__t"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    t = t.withColumn("__i", F.row_number().over(Window.partitionBy(group, "__s").orderBy(order)))
    j = t.join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__s") == F.col("__t")))
    return j.withColumn(out, F.col("__before") + F.col("__i")).drop("__s", "__t", "__g", "__i", "__before")


def page_meta(df: DataFrame, page_col: str = "page", page_size: int = PAGE_SIZE,
              group=()) -> DataFrame:
    """A5 on a result table: per page (and group) the row count, whether a
    next/previous page exists and the page total."""
    g = list(group)
    keys = g or ["__all"]
    if not g:
        df = df.withColumn("__all", F.lit(1))
    per = df.groupBy(*keys, page_col).agg(F.count(F.lit(1)).alias("rows"))
    tot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_results"))
    j = per.join(tot, keys)
    total_pages = F.ceil(F.col("total_results") / F.lit(float(page_size))).cast("bigint")
    return j.select(*g, F.col(page_col).cast("bigint").alias("current_page"),
                    F.col("rows").cast("bigint").alias("rows"),
                    (F.col(page_col) < total_pages).alias("has_next_page"),
                    (F.col(page_col) > 1).alias("has_previous_page"),
                    total_pages.alias("total_pages"),
                    F.col("total_results").cast("bigint").alias("total_results"))


def listing_page_meta(total_results, page, has_next) -> list[Column]:
    """A5 from one result page's markers: total pages = ceil(total/10), or
    page + 1 when a next marker exists and no total is shown."""
    t, p, n = col_(total_results), col_(page), col_(has_next)
    pages = F.when(t > 0, F.ceil(t / F.lit(float(PAGE_SIZE)))).otherwise(p + F.when(n, 1).otherwise(0))
    return [p.alias("current_page"), n.alias("has_next_page"), (p > 1).alias("has_previous_page"),
            pages.cast("bigint").alias("total_pages"), t.cast("bigint").alias("total_results")]


def mean_confidence(conf_emails, conf_phones) -> list[Column]:
    """(emails + phones) / 2 and its rounded percent."""
    m = (col_(conf_emails) + col_(conf_phones)) / 2
    return [m.alias("confidence"), js_round(m * 100).cast("bigint").alias("confidence_pct")]


def errors_by_category(errors: DataFrame) -> DataFrame:
    """A3: count per category (one row per category)."""
    return errors.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def accumulate_pages(rows: DataFrame, query: str = "query", page: str = "page",
                     name: str = "name") -> DataFrame:
    """Page 1 is taken whole; a later page adds the rows whose exact name
    appeared on no earlier page of the same query (repeats inside one page
    are kept).  Equivalent closed form: keep a row iff its page is the first
    page its name appears on - one grouped minimum and a join."""
    first = rows.groupBy(query, name).agg(F.min(page).alias("__first"))
    same = rows[query].eqNullSafe(first[query]) & rows[name].eqNullSafe(first[name])
    return rows.join(first, same & (rows[page] == first["__first"]), "left_semi")
