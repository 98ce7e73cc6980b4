"""Every catalog query against its oracle at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from tributary import catalog

SF = Path("/root/testdata/sf0.001")


def rows(frame, columns):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v.item() if hasattr(v, "item") else v
    return sorted(repr([plain(v) for v in r]) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in SF.iterdir():
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_oracle(spark, duck, name):
    found = catalog.QUERIES[name](spark, str(SF)).toPandas()
    wanted = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found, sorted(found.columns)) == rows(wanted, sorted(found.columns))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
