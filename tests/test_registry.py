"""The registered queries fit together with their SQL, and the flagship runs."""

import duckdb
import pytest

import __spark_entry__ as E
from suite.views import TABLES
from verify import digest


def test_every_oracle_belongs_to_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) > 130


def test_flagship(spark):
    df = E.entry(spark)
    assert df.count() == 10 and df.columns[0] == "name"


@pytest.mark.parametrize("name", ["missing_by_column", "key_uniqueness", "check_missing", "fix_fill_median", "split_train_test"])
def test_small_scale_agrees_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = E.queries()[name](spark, sf_dir)
    got = con.execute(E.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(columns, got.fetchall())
