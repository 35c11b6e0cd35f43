"""Registered queries against the comparison engine on the small tables.

`python -m checks.compare <dir>` runs all of them; here are the quick ones.
"""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks import compare

SF = "/root/testdata/sf0.001"
QUICK = [
    "material_validity", "allowed_split", "size_tokens", "best_offer", "query_expansion", "staged_stop",
    "column_roles", "sparse_row_merge", "connection_codes", "reconcile", "catalogue_list", "nested_orders", "search_urls",
]
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_equal(spark, con, name):
    ok, message = compare.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message


def test_every_query_has_sql_or_a_brute_force_test():
    own = {n for n in entry.queries() if n != "pipeline" and not n.startswith("op")}
    assert own - set(entry.oracle_sql()) == {"catalogue_match_full"}


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["article", "n_lines", "pieces"]
