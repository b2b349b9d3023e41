import pytest

from riskloom.plans.catalogue import QUERIES, SQL
from tests.differential import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    ours, theirs, only_ours, only_theirs = compare(spark, con, FOLDER, QUERIES[name], SQL[name])
    assert not only_ours and not only_theirs and ours == theirs


#: Queries without SQL that find nothing in the generated files; their rules are checked by the *_examples queries.
NOTHING = {"endpoints", "endpoint_scores", "import_edges", "resource_leaks", "ir_live_definitions", "repair_findings", "repair_by_rule", "repair_recommendations"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert (len(rows) == 0) == (name in NOTHING)
