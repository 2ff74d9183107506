"""Every registered query of the core library against its SQL."""

import pytest

from symbolary.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_and_oracle_agree(name, same):
    same(catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["rank", "id", "label", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
