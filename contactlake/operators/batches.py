"""Ordered dedup (D9) over arriving batches.

Rows that earlier batches kept are final and come before all new rows.  So a
new row goes if a kept one has its signature or an edge to it, and the others
are resolved among themselves.  The state is the kept rows' features, written
by batch into buckets of two keys - the host, and the exact (phone digits,
name, address, e-mail) that edges between hosts need - and a batch reads the
buckets that its own rows fall into, nothing else.  Each batch has a folder of
its own that a replay overwrites, and reads the batches before it only, so a
batch can be run again after a crash at any point.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.functions import similarity as SIM
from contactlake.operators import dedup as D
from contactlake.session import ensure_checkpoint_dir

#: Buckets of either key; a batch lists those it touches, so the number is bounded.
BUCKETS = 256
STATE = ("ord long, phone string, email string, website string, nname string, naddr string, pd string, host string, sig string, "
         "batch int, kind string, bucket int")


def _bucket(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in cols]), F.lit(BUCKETS)).cast("int")


def _bucketed(feat: DataFrame) -> DataFrame:
    """Each row once by its host (without ``www.``) and once by its exact key."""
    t = feat.withColumn("__h", F.regexp_replace("host", r"^www\.", ""))
    by_host = t.withColumn("kind", F.lit("host")).withColumn("bucket", _bucket("__h"))
    exact = t.withColumn("kind", F.lit("exact")).withColumn("bucket", _bucket("pd", "nname", "naddr", "email"))
    return by_host.unionByName(exact).drop("__h")


def kept_before(spark: SparkSession, path: str, batch: int, touched: DataFrame) -> DataFrame | None:
    """Features of the rows kept by batches before this one, from the buckets
    that ``touched`` (kind, bucket) names; null if there is no earlier batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    earlier = [f"{path}/batch={n}" for n in range(batch) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}/_SUCCESS"))]
    if not earlier:
        return None
    t = spark.read.option("basePath", path).schema(STATE).parquet(*earlier)
    wanted = {}
    for r in touched.distinct().collect():          # 2 * BUCKETS rows at most
        wanted.setdefault(r["kind"], []).append(r["bucket"])
    chosen = F.lit(False)
    for kind, buckets in wanted.items():
        chosen = chosen | (F.col("kind") == kind) & F.col("bucket").isin(buckets)
    return t.where(chosen).select(*D.FEATURE_COLS).dropDuplicates(["ord"])


def dedup_batch(rows: DataFrame, path: str, batch: int) -> DataFrame:
    """The rows of one batch that D9 keeps after all earlier batches (numbers
    below ``batch``; every ``ord`` here comes after theirs); the state under
    ``path`` gains the batch's kept rows.  Columns as in ``dedup_ordered``."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    rows = rows.checkpoint()
    feat = rows.transform(D.with_dedup_features()).select(*D.FEATURE_COLS).checkpoint()
    new_feat, state = feat, kept_before(spark, path, batch, _bucketed(feat).select("kind", "bucket"))
    if state is not None:
        state = state.checkpoint()
        gone = feat.join(state.select("sig").distinct(), "sig", "left_semi").select("ord")
        left = feat.join(gone, "ord", "left_anti").checkpoint()
        both = left.unionByName(state).checkpoint()             # the joins read it several times
        pairs = D.candidate_pairs(both)
        new = left.select(F.col("ord").alias("b"))
        old = state.select(F.col("ord").alias("a"))
        across = pairs.join(new, "b", "left_semi").join(old, "a", "left_semi")
        edges = D.score_pairs(both, across).where(F.col("score") > SIM.DUPLICATE_THRESHOLD)
        new_feat = left.join(edges.select(F.col("b").alias("ord")).distinct(), "ord", "left_anti").checkpoint()
    kept = rows.join(D.kept_rows(new_feat), "ord", "left_semi").checkpoint()
    own = feat.join(kept.select("ord"), "ord", "left_semi")
    # dealt by bucket first, so that a bucket is one file and not one from each task
    _bucketed(own).repartition("kind", "bucket").write.mode("overwrite").partitionBy("kind", "bucket").parquet(f"{path}/batch={batch}")
    return kept


def stream_batches(path: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each micro-batch is resolved against the
    state under ``path`` and its kept rows go to ``write(rows, batch)``, which
    must overwrite what an earlier run of that batch wrote."""
    def run(df: DataFrame, batch: int) -> None:
        write(dedup_batch(df, path, batch), batch)
    return run
