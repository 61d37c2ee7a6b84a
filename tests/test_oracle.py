"""Every registered query beside its SQL on the smallest tables."""

import pytest

from ledgerlens.plans import catalog
from tests.oracle import compare, duck

ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]) == ""
    else:
        assert df.columns and df.count() >= 0


def test_oracle_has_no_strangers():
    assert set(ORACLE) <= set(catalog.queries())
