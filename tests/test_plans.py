from pathlib import Path

import pytest
from oracle import same

from quarry import plans

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(spark, sf_dir, plans.queries()[name], SQL[name])


#: queries without SQL, and the tests that compare each with plain loops
BRUTE = {
    "crawled_contacts": "test_crawled_contacts", "folded_groups": "test_fold", "link_rounds": "test_frontier", "matched_contacts": "test_contact_fold", "parsed_pages": "test_frontier", "useful_pages": "test_crawled_contacts",
    "page_verdicts": "test_page_verdicts", "contact_outcomes": "test_contact_claims", "contact_outcome_summary": "test_contact_claims", "contact_verification_summary": "test_contact_claims",
}


def test_each_query_has_sql_or_plain_loops():
    missing = set(plans.queries()) - set(SQL) - set(BRUTE)
    assert not missing and all((Path(__file__).parent / f"{t}.py").exists() for t in BRUTE.values())


def test_flagship_is_one_plan_without_python(spark, sf_dir):
    text = plans.queries()[plans.FLAGSHIP](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_filters_reach_the_scan(spark, sf_dir):
    text = plans.queries()["stored_merge"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate)" in text


def test_entry_imports_and_registers(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
