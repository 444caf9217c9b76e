"""Result freshness: the source's in-memory TTL cache as tables.

Entries are rows ``(key, fetched_at, ttl_ms, ...)``; "now" is a parameter
(for the crawl log: its latest ``fetched_at``, never the wall clock).  Every
operator is a grouped aggregate or a filter, so it scales with the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlake.functions.text import JSWS, col_
from contactlake.session import ensure_checkpoint_dir

# --- fixed values: TTL classes in milliseconds ------------------------------
DEFAULT_TTL_MS = 3_600_000
TTL_MS = {
    "search": 1_800_000,
    "contacts": 86_400_000,
    "content": 3_600_000,
    "custom_scrape": 1_800_000,
    "ai_business_info": 86_400_000,
}


def cache_key(prefix, *params) -> Column:
    """``prefix:p1:p2...`` with the joined params lower-cased and runs of
    whitespace turned into ``_``."""
    joined = F.concat_ws(":", *[col_(p) for p in params])
    return F.concat(col_(prefix), F.lit(":"), F.regexp_replace(F.lower(joined), f"[{JSWS}]+", "_"))


def set_key(arr) -> Column:
    """Key of a URL list: a hash of the whole sorted list joined by ``|``
    (a prefix of it, as in the source, lets different lists collide)."""
    return F.sha2(F.array_join(F.array_sort(col_(arr)), "|"), 256)


def ttl_ms(kind) -> Column:
    """TTL class of an entry kind (default one hour)."""
    m = F.create_map(*[x for k, v in TTL_MS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, col_(kind)), F.lit(DEFAULT_TTL_MS)).cast("bigint")


def latest_by_key(entries: DataFrame, key: str = "key", order=("fetched_at", "event_id"),
                  payload=()) -> DataFrame:
    """C3 upsert: last write per key wins (one grouped maximum)."""
    g = entries.groupBy(key).agg(F.max(F.struct(*order, *payload)).alias("__l"))
    return g.select(key, *[F.col(f"__l.{c}").alias(c) for c in (*order, *payload)])


def with_freshness(now, ts: str = "fetched_at", ttl: str = "ttl_ms"):
    """C4: ``age_ms`` and ``fresh`` (hit iff now - ts <= ttl)."""
    def t(df: DataFrame) -> DataFrame:
        age_us = F.unix_micros(col_(now).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
        return df.withColumn("age_ms", F.floor(age_us / 1000).cast("bigint")) \
                 .withColumn("fresh", age_us <= F.col(ttl) * 1000)
    return t


def log_now(log: DataFrame, ts: str = "fetched_at") -> DataFrame:
    """One-row frame with the log's "now" (its latest timestamp)."""
    return log.agg(F.max(ts).alias("now"))


def cache_entries(log: DataFrame) -> DataFrame:
    """Crawl-log rows as cache entries: successful fetches keyed by
    ``kind:url`` with their TTL class."""
    return (log.where((F.col("status") >= 200) & (F.col("status") < 300))
            .select(cache_key("kind", "url").alias("key"), "kind", "url", "fetched_at", "event_id",
                    ttl_ms("kind").alias("ttl_ms")))


def lookup_as_of(entries: DataFrame, lookups: DataFrame, key: str = "key", at: str = "at", ts: str = "fetched_at", tie: str = "event_id",
                 payload: tuple[str, ...] = ("ttl_ms",)) -> DataFrame:
    """C4 at the time of each lookup: ``lookups`` plus ``entry``, a struct of
    ``ts``, ``tie`` and ``payload`` of the latest entry of the lookup's key that
    is not later than it (the greatest ``tie`` of equal times), or null.

    Entries and lookups are one sorted table, dealt into ranges of (key, time),
    so a hot key is many tasks.  Inside a range the last entry before a lookup
    is a running value; what a range lacks is carried over from the earlier
    ranges of the key, of which a grouped maximum each is kept."""
    ensure_checkpoint_dir(lookups.sparkSession)
    entry = F.struct(ts, tie, *payload)
    old = entries.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("__k"), F.col(ts).alias("__t"), F.lit(0).alias("__kind"), entry.alias("__e"))
    new = lookups.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.struct(*lookups.columns).alias("__l"))
    t = old.unionByName(new, allowMissingColumns=True)
    order = ["__k", "__t", "__kind", F.col(f"__e.{tie}")]
    n = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = t.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    run = Window.partitionBy("__part", "__k").orderBy("__t", "__kind", F.col(f"__e.{tie}")).rowsBetween(Window.unboundedPreceding, 0)
    found = t.withColumn("__e", F.last("__e", ignorenulls=True).over(run)).where("__kind = 1")
    # one row a range and key: the carry of a key looks at as many rows as it has ranges
    ends = t.groupBy("__k", "__part").agg(F.max("__e").alias("__m"))
    before = Window.partitionBy("__k").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("__k", "__part", F.last("__m", ignorenulls=True).over(before).alias("__c")).where("__c is not null")
    j = found.join(carry, ["__k", "__part"], "left")
    return j.select("__l.*", F.coalesce("__e", "__c").alias("entry"))


def sweep(entries_fresh: DataFrame) -> DataFrame:
    """Drop expired entries."""
    return entries_fresh.where("fresh")
