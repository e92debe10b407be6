"""Every query of the library proper against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from strandline.plans import load
from strandline.plans.registry import ORACLE, QUERIES

load()
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def key(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else repr(v) for v in row)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DIR)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"{DIR}/{t}.parquet").filter("false").write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.split("_")[0] in {"top03", "top05", "fn01", "fn02", "win10", "ml18", "ml21", "ml22", "ml26", "st15", "udf03", "recall", "ml03", "fn09", "ml09", "fn05", "fn07", "st05", "st02", "st09", "top04", "jn08"}))
def test_query_on_empty_tables(spark, empty_dir, name):
    QUERIES[name](spark, empty_dir).collect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(key([r[c] for c in cols]) for r in df.collect())
    want = db.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    assert got == sorted(key([r[want.columns.index(c)] for c in cols]) for r in want.fetchall())
