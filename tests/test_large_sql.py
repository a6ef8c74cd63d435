"""Queries of decay fits against their SQL on more sequences than the small tables have."""

from __future__ import annotations

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest

from kmerloom.plans import registry


@pytest.fixture(scope="module")
def lineitem(spark, tmp_path_factory):
    """A folder with more than 10,000 parts a year, so that the noise is that above a percentile."""
    rng = np.random.default_rng(4)
    n, years = 26_000, 5
    part, year = np.repeat(np.arange(1, n + 1), years), np.tile(np.arange(years), n)
    rate = np.repeat(rng.uniform(0.0, 0.8, n), years)
    level = 4000 * np.exp(-rate * year) * np.exp(rng.normal(0, np.array([0.1, 0.2, 0.3, 0.25, 0.15])[year]))
    # the fixture divides by the year and the part
    quantity = np.floor(level) * (1 + (year + 1) * (1 + part % 4))
    dates = [datetime.datetime(1996 + y, 7, 1) for y in range(years)]
    frame = pd.DataFrame({"l_partkey": part, "l_quantity": quantity, "l_shipdate": pd.Series(dates).iloc[year].to_numpy()})
    folder = tmp_path_factory.mktemp("many")
    spark.createDataFrame(frame).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(None if pd.isna(v) else v for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", ["column_noise", "decay_gof_even_df", "good_fit_mask", "regression_select_rows"])
def test_more_than_ten_thousand_values_a_time(spark, lineitem, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{lineitem}/lineitem.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()[name]).fetchdf()
    got = registry.queries()[name](spark, lineitem).toPandas()
    assert len(got) and rows_of(got) == rows_of(want)
