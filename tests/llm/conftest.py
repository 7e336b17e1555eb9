import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def texts():
    """Documents with every odd case: nulls, empty and long texts, ties, repeated rows, signs beyond the BMP."""
    return [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", None, None),
        (4, "one two three four five", "en", "b"),
        (4, "one two three four five", "en", "b"),
        (None, "null id text", "en", "b"),
        (5, "x" * 200_000, "en", "c"),
        (6, "word 😀 " * 20_000, "de", "c"),
        (7, "Ünï çødé: DE89 3704 0044 0532 0130 00, a.b@c.de 10.0.0.1 4111 1111 1111 1111 +1 555 123-4567", "fr", None),
        (8, "one two three four five six", "en", "b"),
    ]
