import collections
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pressmill import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.isoformat()[:19] if hasattr(value, "isoformat") else value


def bag(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return collections.Counter(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_same_as_sql(spark, duck, sf_dir, name):
    df = core.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in core.ORACLE_SQL:
        found = duck.execute(core.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert bag(rows, df.columns) == bag(found.fetchall(), names)
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_training_data_operators():
    here = os.path.dirname(core.__file__)
    for path in glob.glob(f"{here}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "pressmill.llm" not in open(path).read(), path
