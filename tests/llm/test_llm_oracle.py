"""The operators that SQL can express equal their DuckDB twins on the small driver tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_queries_match_duckdb(spark):
    from oracle_check import compare

    from thermocline.llm.queries import SQL

    res = compare(spark, SF, keys=sorted(SQL), verbose=False)
    assert all(v.startswith("ok") for v in res.values()), res
