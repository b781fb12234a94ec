"""Quartiles of all filings come from ranges of values, not from one task's buffer."""

import pytest

from solvara import plans


@pytest.mark.parametrize("name", ["ag14_profile", "ag15_tails"])
def test_no_percentile_buffer(spark, name):
    assert "percentile(" not in plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
