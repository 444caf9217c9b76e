"""Shared folder, materialised tables and Arrow batches of bounded bytes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of text that a Python task handles at once (one longer text is handled alone).
BATCH_BYTES = 4 << 20
#: The same where a task also holds models or tables of words.
SMALL_BATCH_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where
    none is set, a local session gets a scratch folder of its own, any other an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-llm-", dir="/tmp"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


#: Paths of the tables written in each open ``scratch`` scope, the innermost last.
_SCOPES: list[list[str]] = []
#: Shuffle files go when the query that wrote them ends, not when the driver's garbage collector finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, up: int = 0) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts
    the lineage, survives lost executors, keeps column pruning.  The table goes
    with the ``scratch`` scope that lies ``up`` scopes around the innermost one, if there is one."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if len(_SCOPES) > up:
        _SCOPES[-1 - up].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def only_last(spark: SparkSession) -> None:
    """Delete the tables of the innermost scope but the one written last."""
    own = _SCOPES[-1]
    _delete(spark, own[:-1])
    del own[:-1]


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables materialised inside the block are deleted at its end.  What leaves
    the block must be materialised itself, into a scope around it."""
    own: list[str] = []
    _SCOPES.append(own)
    try:
        yield
    finally:
        _SCOPES.pop()
        _delete(spark, own)


def parallelism(spark: SparkSession) -> int:
    """Reducers of an exchange: the session's shuffle partitions, which are
    set in proportion to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string); null texts become empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def unused(label: str) -> str:
    """A column name that no table has."""
    return f"__{label}_{uuid.uuid4().hex}"


def sheltered(docs: DataFrame, *working: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but the ``working`` ones under names that no
    operator uses, and the names now in the columns' order; ``restored`` undoes it."""
    now = {c: c if c in working else unused(f"c{i}") for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in now.items())), now


def restored(df: DataFrame, now: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(f"`{n}`").alias(c) for c, n in now.items()))


def by_bytes(batch, column: str, limit: int = BATCH_BYTES):
    """Consecutive slices of an Arrow batch whose ``column`` holds about
    ``limit`` bytes at most (a longer single value is a slice of its own)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, batch.num_rows
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    if not n:
        yield pa.RecordBatch.from_arrays([c for c in batch.columns], schema=batch.schema)
