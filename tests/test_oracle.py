"""Every query with an oracle equals its DuckDB SQL on the small driver tables."""

import pytest

from oracle_check import compare, duck_connect, schema_diff

from deskflow.plans import oracle_sql, queries

NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def duck(sf_dir):
    return duck_connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, sf_dir, duck, name):
    sq = queries()[name](spark, sf_dir)
    sdf = sq.toPandas()
    rel = duck.sql(oracle_sql()[name])
    odf = rel.df()
    err = compare(sdf, odf)
    assert err is None, err
    assert not schema_diff(sq.dtypes, rel.columns, [str(t) for t in rel.types])


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
