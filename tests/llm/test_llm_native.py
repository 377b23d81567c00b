"""The operators dealt as native have no Python in their plans."""

import re

import pytest

from heronkb.llm import queries


@pytest.mark.parametrize("name", ["op8_ring", "op9_url_filter"])
def test_no_python(spark, small, name):
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)
