"""The whole tables go through the queries: a grid of six layers, deeper than the smallest given one."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orefield import schema as S
from orefield.operators import linalg
from orefield.operators.wavelet import Wavelet, lift
from orefield.plans import inversion, queries
from orefield.plans.inversion import problem_of
from orefield.plans.queries import QUERIES

LAYERS = 6


@pytest.fixture(scope="module")
def deep(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("deep"))
    key = F.col("id")
    spark.range(100 * LAYERS).select(key.alias("p_partkey"), (1 + key * 7 % 50).alias("p_size"), (900.0 + key * 13 % 1000).alias("p_retailprice")).write.parquet(f"{d}/part.parquet")
    spark.range(40).select(key.alias("s_suppkey"), (key % 25).alias("s_nationkey"), (key * 10.5).alias("s_acctbal")).write.parquet(f"{d}/supplier.parquet")
    spark.range(900).select((key % 300).alias("l_orderkey"), (key * 11 % 600).alias("l_partkey"), (key % 10 / 100.0).alias("l_discount")).write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize("kind", [Wavelet.HAAR, Wavelet.D4])
def test_wavelets_of_the_whole_grid(spark, deep, kind):
    x = S.model(spark, deep).orderBy("cell_id").toPandas().density.to_numpy().reshape(LAYERS, 10, 10)
    there, back = x, x
    for axis, n in enumerate(x.shape):
        there = np.moveaxis(lift(np.moveaxis(there, axis, 0).reshape(n, -1), kind).reshape(n, *np.delete(x.shape, axis)), 0, axis)
        back = np.moveaxis(np.linalg.solve(lift(np.eye(n), kind), np.moveaxis(back, axis, 0).reshape(n, -1)).reshape(n, *np.delete(x.shape, axis)), 0, axis)
    for name, want in ((f"wavelet_{kind.name.lower()}", there), (f"wavelet_{kind.name.lower()}_inverse", back)):
        rows = QUERIES[name](spark, deep).toPandas()
        assert len(rows) == 100 * LAYERS
        got = np.full(x.shape, np.nan)
        got[rows.k, rows.j, rows.i] = rows.v
        assert np.abs(got - want).max() < 1e-5


def test_all_rows_are_stacked(spark, deep):
    a = S.sparse(spark, deep).toPandas()
    got = QUERIES["stacked_blocks"](spark, deep).toPandas()
    n = a.row_id.max() + 1
    assert a.row_id.max() >= 50
    want = {(x.row_id, x.col_id): x.v for x in a.itertuples()} | {(x.row_id + n, x.col_id): 2 * x.v for x in a.itertuples()}
    assert len(got) == len(want) == 2 * len(a)
    assert {(x.row_id, x.col_id): x.v for x in got.itertuples()} == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("name", ["inversion_gravity", "inversion_joint"])
def test_inversions_take_the_whole_grid(spark, deep, monkeypatch, name):
    seen, kernels, most = [], [], {}

    def watched(spark, name, obs, cells, measured, column_weight, settings, rate=1.0, **more):
        seen.append((cells.count(), column_weight, settings, rate))
        p = problem_of(spark, name, obs, cells, measured, column_weight, settings, rate, **more)
        kernels.append(p.kernel)
        return p

    monkeypatch.setattr(queries, "problem_of", watched)
    monkeypatch.setattr(inversion, "lines_operator", lambda *a: linalg.lines_operator(*a, **most))
    here = QUERIES[name](spark, deep).toPandas()
    for n, w, settings, rate in seen:
        assert n == w.size == 100 * LAYERS and settings.dims == (10, 10, LAYERS)
        assert rate < 1 and settings.wavelet is Wavelet.HAAR and np.ptp(w) > 0
    most["most"] = 0
    there = QUERIES[name](spark, deep).toPandas()
    x, u = np.random.default_rng(3).normal(size=100 * LAYERS), np.random.default_rng(4).normal(size=40)
    for a, b in zip(kernels[: len(kernels) // 2], kernels[len(kernels) // 2 :], strict=True):  # the driver's and the executors'
        assert np.allclose(a.apply(x), b.apply(x)) and np.allclose(a.transposed(u), b.transposed(u))
    assert np.allclose(here, there, rtol=0.2, atol=0.1 * np.abs(here.to_numpy()).max())  # rounding grows in the rounds
    if name == "inversion_gravity":
        assert here.data_cost.iloc[-1] < 0.05 and here.inside.iloc[-1] > 2.5 * abs(here.outside.iloc[-1])
    else:
        assert here.cost_grav.iloc[-1] < 0.1 and here.cost_magn.iloc[-1] < 0.5


def test_two_layers_without_compression_are_fitted(spark, deep):
    cells, obs, _ = queries.planted(spark, deep)
    cells = cells.where("k < 2")
    truth = np.array([x.truth for x in cells.orderBy("cell_id").collect()])
    settings = inversion.Settings((10, 10, 2), (S.DX, S.DY, S.DZ), major=3, minor=20, wavelet=Wavelet.HAAR)
    p = problem_of(spark, "grav", obs, cells, np.zeros(obs.count()), np.ones(truth.size), settings)
    p.measured = inversion.predicted(p, truth)
    p.weight = 1 / float(np.abs(p.measured).max())
    inversion.invert([p], settings)
    assert p.costs == sorted(p.costs, reverse=True) and p.costs[-1] < 1e-2


def test_all_blocks_of_cross_gradient_entries(spark, deep):
    """Six blocks, and their values the SQL's on a grid that has inner cells; DuckDB reads the folders by a pattern."""
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{deep}/part.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["cross_gradient_entries"]).df()
    got = QUERIES["cross_gradient_entries"](spark, deep).toPandas()
    key = ["cell_id", "axis", "problem", "col_id"]
    assert len(got.groupby(["axis", "problem"])) == 6
    assert got.groupby(["axis", "problem"]).size().min() > 0
    both = got.merge(want, on=key, suffixes=("", "_sql"))
    assert len(got) == len(want) == len(both) and np.allclose(both.v, both.v_sql, atol=1e-7)
