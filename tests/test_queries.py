"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from millrace.plans import load_all
from tests.compare import check, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()  # the queries of corpus operators have tests of their own
MAY_BE_EMPTY = {"graph_jaccard", "graph_adamic_adar", "join_single_row", "agg_filter_having", "pattern_times"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_names():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["l_orderkey", "o_orderdate", "revenue"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict, note, _ = check(spark, con, FOLDER, name, QUERIES, ORACLES)
    good = {"ok", "rows"} | ({"EMPTY"} if name in MAY_BE_EMPTY else set())
    assert verdict in good, f"{verdict}: {note}"
