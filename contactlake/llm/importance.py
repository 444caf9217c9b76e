"""Op 13: importance resampling towards a target distribution.

Texts are lower-cased (A-Z only), every run of separators becomes one space,
and an overlapped regular-expression scan with boundary lookarounds emits the
spans of all n-grams directly; the CRC-32 of a span's bytes is its bucket.  A
bucket's gain is the logarithm of how much likelier the target's features fall
into it than the corpus's, both smoothed by one; a document's weight is the
mean of its features' gains.  Adding Gumbel noise, which depends on the seed
and the document's id only, and taking the highest scores draws documents
without replacement in proportion to the exponentials of their weights.

The documents are scanned once: each one's buckets and counts are written to
the shared folder as arrays (``buckets`` entries at most), and each task adds
one row with the sums over its documents, which Spark adds up; the driver sees
``buckets`` gains, whatever the corpus.  Weights are read from the arrays.
Ranks come from one range-partitioned sort of narrow rows: counts per partition
are summed up to starts, so no task sees all rows.  Ties of the score are cut by
the id.

Edge cases: null texts have no words, an empty mean counts as 0; a null doc_id
hashes as an empty string and ranks after others of its score; repeated rows
are drawn each; empty tables give no rows (an empty target gives gains from
the smoothing alone); other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from operator import methodcaller

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactlake.llm import common

BUCKETS = 10_000
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def collapsed(text: bytes) -> bytes:
    """The words of a text with single spaces between."""
    return b" ".join(text.translate(PLAIN).split())


def scanners(longest: int) -> list:
    """One pattern for each n: n words, a boundary before and after."""
    import regex
    return [regex.compile(rb"(?<![^ ])[^ ]+" + rb"(?: [^ ]+){%d}" % (n - 1) * (n > 1) + rb"(?![^ ])") for n in range(1, longest + 1)]


class Buckets(dict):
    """Bucket of each gram seen; ``KNOWN`` only bounds memory."""
    KNOWN = 500_000

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, gram: bytes) -> int:
        if len(self) >= self.KNOWN:
            self.clear()
        b = self[gram] = zlib.crc32(gram) % self.buckets
        return b


def bucket_sums(plain: bytes, patterns, bucket_of: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams, sorted, and how often each occurs."""
    group = methodcaller("group")
    found = [np.fromiter(map(bucket_of.__getitem__, map(group, p.finditer(plain, overlapped=True))), np.int64) for p in patterns]
    return np.unique(np.concatenate(found), return_counts=True)


FEATURES = "doc_id long, total boolean, n_words long, buckets binary, counts binary"


def features(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Per document its buckets and counts (little-endian 32 and 64 bits), and
    per task a row (``total``) with their sums; written to the shared folder."""
    def run(batches):
        import pyarrow as pa
        patterns, bucket_of, sums = scanners(longest), Buckets(buckets), np.zeros(buckets, np.int64)
        kinds = pa.schema([("doc_id", pa.int64()), ("total", pa.bool_()), ("n_words", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())])
        row = lambda i, total, words, at, n: {"doc_id": i, "total": total, "n_words": words, "buckets": at.astype("<u4").tobytes(),
                                              "counts": n.astype("<i8").tobytes()}
        for whole in batches:
            for batch in common.by_bytes(whole, "text"):
                rows = []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    plain = collapsed(text)
                    at, n = bucket_sums(plain, patterns, bucket_of)
                    sums[at] += n
                    rows.append(row(i, False, plain.count(b" ") + 1 if plain else 0, at, n))
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pylist([row(None, True, 0, at, sums[at])], schema=kinds)

    return common.materialize(common.documents_of(docs).mapInArrow(run, FEATURES), "features")


def bucket_counts(table: DataFrame) -> dict[int, int]:
    """Occurrences by bucket over all documents of a features table."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(at, "<u4").astype(np.int64)), pa.array(np.frombuffer(n, "<i8"))],
                                                 names=["bucket", "n"])

    sums = table.where("total").select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in sums.collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket, counts smoothed by one."""
    big_s, big_t = sum(source.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * (big_s + buckets) / ((source.get(b, 0) + 1) * (big_t + buckets))))
                     for b in range(buckets)], np.int64)


def noise(seed: str, doc_id) -> int:
    """floor(1000 * Gumbel noise) from the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: str = "2024") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of all documents; ``target``
    is any (id, text) table whose distribution is aimed at."""
    own = features(docs, longest, buckets)
    gain = gains(bucket_counts(own), bucket_counts(features(target, longest, buckets)), buckets)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            rows = []
            for i, words, at, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(counts, "<i8")
                weight = int(gain[np.frombuffer(at, "<u4")] @ n) // int(n.sum()) if len(n) else 0
                rows.append((i, words, int(n.sum()), weight, weight + noise(seed, i)))
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "n_words", "n_features", "weight", "score"])

    table = own.where("not total").select("doc_id", "n_words", "buckets", "counts")
    return table.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS,
              seed: str = "2024") -> DataFrame:
    """Every document with doc_id, n_features, weight, score and ``rank``:
    1, 2, ... for the ``percent`` of the documents of ``least_words`` words that
    are drawn, null for the others."""
    spark = docs.sparkSession
    scored = common.materialize(weights(docs, target, longest, buckets, seed), "weights")
    able = F.col("n_words") >= least_words
    count = scored.where(able).count()
    order = [F.when(able, F.lit(0)).otherwise(F.lit(1)), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    width = common.parallelism(spark)
    parts = common.materialize(scored.repartitionByRange(width, *order).withColumn("part", F.spark_partition_id()), "weights-sorted")
    sizes = parts.where(able).groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long")
    rank = F.col("before") + nth
    drawn = able & (rank <= F.lit(percent * count // 100))
    return (parts.join(F.broadcast(starts), "part", "left")
            .select("doc_id", "n_features", "weight", "score", F.when(drawn, rank).alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn by ``resampled``, unchanged."""
    ids = resampled(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == ids["__drawn"], "left_semi")
