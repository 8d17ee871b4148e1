"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run and give rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import DATA

from lattica import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{DATA}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name not in queries.ORACLES:
        assert len(got)
        return
    want = duck.sql(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    sort = lambda x: x[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(sort(got), sort(want), check_dtype=False, rtol=1e-6, atol=2e-5)


def test_density_weights_of_all_customers(spark):
    got = queries.QUERIES["density_weights_2d"](spark, DATA).toPandas()
    assert sorted(got.c_custkey) == sorted(r.c_custkey for r in spark.read.parquet("/root/testdata/sf0.001/customer.parquet").select("c_custkey").collect())
    more = queries.QUERIES["density_weights_2d"](spark, "/root/testdata/sf0.01")
    assert more.count() == spark.read.parquet("/root/testdata/sf0.01/customer.parquet").count()


def test_whitening_and_compression_use_all_components(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    got = queries.noise_prewhitening(spark, DATA).toPandas().pivot(index="y", columns="x", values="re").loc[[r.vec_id for r in rows]].to_numpy()
    want = x @ np.linalg.inv(np.linalg.cholesky(x.T @ x / len(x))).T
    np.testing.assert_allclose(got, want, atol=1e-4)
    got = queries.coil_compression(spark, DATA).toPandas().pivot(index="y", columns="x", values="re").loc[[r.vec_id for r in rows]].to_numpy()
    top = np.linalg.eigh(np.cov(x.T, bias=True))[1][:, ::-1][:, :3]
    np.testing.assert_allclose(got, abs(x @ top), atol=1e-4)
