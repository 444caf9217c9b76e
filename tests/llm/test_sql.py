"""Queries of the subpackage: registration, and DuckDB SQL where there is any."""

import pytest

from contactlake.llm.queries import QUERIES, SQL
from contactlake.plans.check import compare, run_oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    res = compare(QUERIES[name](spark, SF).toPandas(), run_oracle(SQL[name], SF))
    assert res["values_match"], res


def test_registered(spark):
    import __spark_entry__ as E
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()
    assert set(SQL) <= set(E.oracle_sql())
