"""Every registered query beside its oracle, on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from strandgraph.plans import registry
from tests.compare import compare, connect

QUERIES = registry.QUERIES
ORACLE = registry.ORACLE


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    rows, problem = compare(QUERIES[name](spark, folder), con, ORACLE.get(name))
    assert not problem
    assert rows >= 0


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)
    # See test_semantics and test_fuzzy for these.
    assert set(QUERIES) - set(ORACLE) == {"rouge_l", "metric_report", "weighted_pairs", "link_weighted", "link_graph"}
    assert set(QUERIES) <= set(entry.queries())
