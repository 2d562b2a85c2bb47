"""Every registered query of the library against its SQL on the smallest tables."""

import os

import pytest

from tests.oracle import both
from tidegraph import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(set(plans.ORACLES)))
def test_matches_sql(spark, name):
    ours, theirs = both(plans.QUERIES[name](spark, SF), plans.ORACLES[name], SF)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_python_functions_ship_after_one_was_used(spark):
    plans.QUERIES["t1_clean_pages"](spark, SF).count()
    assert plans.QUERIES["p4_claim_pipeline"](spark, SF).count() > 0
