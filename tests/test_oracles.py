"""Every query with an oracle, row by row against DuckDB on the small tables."""

import pytest

from quern import plans
from tests.conftest import SF


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(str(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = duck.execute(plans.ORACLES[name])
    assert mine == rows([d[0] for d in theirs.description], theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
