"""The driver's contract on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["sequence_score", "decay_r2", "kmer_presence", "sample_select"])
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "lineitem", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = entry.queries()[name](spark, DATA).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(df):  # nulls are equal
        plain = df[columns].astype(object).where(df[columns].notna(), None)
        return sorted(map(tuple, plain.itertuples(index=False)), key=str)

    assert rows(got) == rows(want)
