import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from contactlake import get_spark
    s = get_spark("local[4]", shuffle_partitions=4)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-llm-test-", dir="/tmp"))
    yield s


@pytest.fixture(scope="session")
def small():
    """(doc_id, text) of the smallest table."""
    import pyarrow.parquet as pq
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    return list(zip(*(c.to_pylist() for c in t.columns), strict=True))


#: Nulls, empty and blank texts, repeated rows, ties, a very long text, odd characters.
EDGE = [(None, "a null id with some words in it"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one two"),
        (6, "x" * 200_000), (7, "word " * 30_000), (8, "日本語 テキスト 🙂 é ñ <|endoftext|> don't"), (9, "a\nb\na\nb\n" * 50),
        (10, "The Quick brown fox jumps over the lazy dog " * 3), (11, "the quick Brown fox jumps over the lazy dog " * 3)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")
