import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cuesheet.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", **{"spark.driver.memory": "6g"})


def plain(value):
    """A value as Python data that compares by equality, whatever engine made it."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return None if value != value else repr(value)
    return value


def rows_of(df, *columns):
    """Sorted rows of a Spark DataFrame as tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(plain(v) for v in r) for r in picked.collect()), key=repr)


def oracle_rows(sql, sf_dir=SMALL):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)


def assert_matches(df, sql, sf_dir=SMALL):
    names, expected = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == names
    assert rows_of(df, *names) == expected
