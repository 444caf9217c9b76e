"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm import common


def _stars(edges: DataFrame) -> bool:
    """Whether every edge leads straight to its component's smallest id: no id
    has two edges down, and none has edges both up and down."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("b").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where(
        "down > 1 or (down > 0 and up > 0)").isEmpty()


def _round(edges: DataFrame) -> DataFrame:
    """A large-star step and a small-star step."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a != b").distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(down, "a")
    return (joined.select("a", F.col("m").alias("b")).unionByName(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))
            .where("a != b").distinct())


def outside_largest(members: DataFrame, size: int) -> DataFrame:
    """``members`` (key, c, ...) of the buckets that hold several components c, plus
    ``main``, the bucket's largest one, and ``blocks``: how many blocks of about
    ``size`` the members outside it fill.  Two members of different components
    are not both inside it, so only those outside meet the whole bucket."""
    n = members.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    main = n.groupBy("key").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("all")).where("all > top.n")
    return members.join(main.select("key", F.col("top.c").alias("main"),
                                    F.ceil((F.col("all") - F.col("top.n")) / size).cast("int").alias("blocks")), "key")


def dealt(mixed: DataFrame, member: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``outside_largest`` outside the largest component, each in one
    block, and all rows once for each block of their bucket."""
    minor = mixed.where("c != main").withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    return minor, mixed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))


def components(links: DataFrame, label: str = "components", up: int = 0) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``links``
    (columns a, b).  Large-star and small-star steps (each links neighbours to
    the smallest one known) until only stars are left: the number of rounds grows
    with the logarithm of the size, hot nodes are grouped minima and joins, and
    every round is cut by a table in the shared folder, which goes after the next
    one; the result is a table too, in the scope that ``common.materialize`` takes for ``up``."""
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    spark = links.sparkSession
    with common.scratch(spark):
        edges = common.materialize(edges, label)
        while not _stars(edges):
            edges = common.materialize(_round(edges), label)
            common.only_last(spark)
        out = edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
            edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
        return common.materialize(out, label, up=up + 1)
