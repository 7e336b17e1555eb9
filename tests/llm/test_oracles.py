"""Queries of this subpackage against their SQL."""

import math

import pytest

from fieldspan.llm import registry


def shaped(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    found = registry.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    wanted = sorted((tuple(map(shaped, r)) for r in cursor.fetchall()), key=str)
    assert sorted(found.columns) == sorted(columns)
    assert sorted((tuple(shaped(r[c]) for c in columns) for r in found.collect()), key=str) == wanted
