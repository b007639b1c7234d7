import pytest

import oracle
from millrace.plans import catalog

SIZES = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def cons():
    return {sf: oracle.connection(sf) for sf in SIZES}


@pytest.mark.parametrize("sf", SIZES)
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, cons, name, sf):
    oracle.check(spark, cons[sf], sf, catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "user_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", ["millrace.llm.queries", "corpus_pipeline", "xxhash"])
def test_the_entry_works_without_the_training_data_operators(monkeypatch, gone):
    import sys

    import __spark_entry__ as entry

    for name in list(sys.modules):
        if name.startswith(("millrace.llm", "corpus_pipeline")):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)  # importing it fails
    with pytest.warns(UserWarning, match="left out"):
        found = entry.queries()
    assert set(catalog.QUERIES) <= set(found) and "pipeline" not in found


def test_rules_are_broadcast_and_facts_are_not(spark):
    plan = catalog.QUERIES["wildcard_subscription"](spark, SIZES[0])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("BuildRight") == plan.count("BroadcastHashJoin") > 0
