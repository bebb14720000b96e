"""Every named query of the engine against its SQL, or for rows where it has none."""

from __future__ import annotations

import pytest

from docloom.plans import catalog
from tests import oracle


@pytest.fixture(scope="module")
def db(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf_dir, db, name):
    oracle.same(catalog.QUERIES[name](spark, sf_dir), db, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    """Their values are tested with their operators; here on the small tables."""
    assert catalog.QUERIES[name](spark, sf_dir).collect()


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_is_pruned(spark, sf_dir):
    plan = catalog.QUERIES["in_list_filter"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(lang" in plan.replace("Or(", "") or "In(lang, [de,fr])" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan
