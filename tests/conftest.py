import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from contactlake import ensure_checkpoint_dir, get_spark
    s = get_spark("local[*]", shuffle_partitions=8)
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmpdir_run():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def one_col(spark, values, expr_fn, name="x"):
    """Evaluate a Column function over literal inputs, in order."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, {name} string")
    return [r[0] for r in df.orderBy("i").select(expr_fn(F.col(name))).collect()]
