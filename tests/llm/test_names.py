"""Columns of any name pass the pipeline's operators untouched."""

import pytest
from pyspark.sql import functions as F

from contactlake.llm import decontaminate, line_dedup, near_dedup, quality, token_counts

NAMES = ["low", "high", "mean_low", "mean_high", "_mean", "_lang", "_root", "_doc_mid", "kept", "n_words", "base_failed", "log_ppl", "_hit",
         "_items", "n_hit", "n_items", "contaminated", "_gone", "_id", "removed", "cls", "component", "_m", "_r", "key"]
TEXT = ("the quick brown fox jumps over the lazy dog and then it rests for a while beside the old mill near the river "
        "where people walk with their children on sunny days and talk about the weather and the news of the town "
        "before the evening comes and everybody goes home to have supper at a large wooden table")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{TEXT} number {'abcdefgh'[i]} {'xyz' * (i + 1)}", "en", 7) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    return df.select("*", *(F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in NAMES))


@pytest.mark.parametrize("name", ["quality", "line_dedup", "near_dedup", "decontaminate", "mask"])
def test_clashing_columns(spark, docs, name):
    bench = spark.createDataFrame([("q", "some other words that never stand in any of these documents at all")], "item_id string, text string")
    out = {"quality": lambda: quality.filtered(docs), "line_dedup": lambda: line_dedup.deduplicated(docs),
           "near_dedup": lambda: near_dedup.deduplicated(docs), "decontaminate": lambda: decontaminate.decontaminate(docs, bench),
           "mask": lambda: token_counts.mask_edits(docs).drop("edits")}[name]()
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in NAMES)
