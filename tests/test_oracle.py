"""Every registered query against its DuckDB oracle (the correctness gate,
run locally on the smallest tables)."""

import pytest

from conftest import SF_SMALL
from contactlake.plans.check import compare, run_oracle
from contactlake.plans.oracle import ORACLE
from contactlake.plans.queries import REGISTRY


@pytest.mark.parametrize("name", sorted(k for k in REGISTRY if k in ORACLE))
def test_query_matches_oracle(spark, name):
    res = compare(REGISTRY[name](spark, SF_SMALL).toPandas(), run_oracle(ORACLE[name], SF_SMALL))
    assert res["values_match"], res


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())
