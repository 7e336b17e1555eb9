"""Every query of the catalogue against its SQL at the smallest scale."""

import math

import duckdb
import pytest

from fieldspan.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shaped(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    rows = found.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    wanted = sorted((tuple(map(shaped, r)) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(shaped(r[c]) for c in columns) for r in rows), key=str) == wanted


def test_entry_imports_without_the_llm_folder():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['fieldspan.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'latency_pct' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
