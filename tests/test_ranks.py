"""Distributed ranks against pandas, on values of which a third are equal."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import ranks, resample, sampling
from cohortspark.queries import bindings


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    n = 3000
    v = np.where(rng.random(n) < 0.35, 7.0, np.round(rng.normal(5, 3, n), 2))
    v[:40] = np.nan
    return pd.DataFrame({"id": np.arange(n), "g": rng.integers(0, 3, n), "v": v})


@pytest.fixture(scope="module")
def table(spark, frame):
    return spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).cache()


def test_large_integers_keep_their_order(spark):
    """Neighbours that are one double are told apart."""
    top = 2 ** 53
    df = spark.createDataFrame([(i, top + 7 - i) for i in range(7)], "id long, v long")
    got = {r["v"]: r["r"] for r in ranks.row_number(df, "v", "id", "r").collect()}
    assert [got[v] for v in sorted(got)] == list(range(1, 8))
    got = {r["v"]: r["r"] for r in ranks.row_number(df, "v", "id", "r", descending=True).collect()}
    assert [got[v] for v in sorted(got)] == list(range(7, 0, -1))


def test_ranks_match_pandas(table, frame):
    got = ranks.tied_rank(table, "v", "r").toPandas().sort_values("id")
    assert np.allclose(got.r, frame.v.rank(), equal_nan=True)
    got = ranks.tied_rank(table, "v", "r", ["g"], "min", True).toPandas().sort_values("id")
    assert np.allclose(got.r.astype(float), frame.groupby("g").v.rank(method="min", ascending=False), equal_nan=True)
    got = ranks.row_number(table, "v", "id", "r", descending=True).toPandas().sort_values("id")
    assert np.allclose(got.r.astype(float), frame.v.rank(method="first", ascending=False), equal_nan=True)
    q = ranks.quantiles(table, "v", {"a": 0.25, "b": 0.5, "c": 0.9}, ["g"]).toPandas().sort_values("g")
    assert np.allclose(q[["a", "b", "c"]], frame.groupby("g").v.quantile([0.25, 0.5, 0.9]).unstack())
    binned = ranks.equal_frequency(table, "v", "id", 10, "b").toPandas().sort_values("id")
    assert np.allclose(binned.b.astype(float), pd.qcut(frame.v.rank(method="first"), 10, labels=False) + 1, equal_nan=True)


def test_text_tie_break_and_scales(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": [f"u{i:05d}" for i in rng.permutation(2000)], "v": 1.0})
    got = ranks.row_number(spark.createDataFrame(pdf), "v", "k", "r").toPandas().sort_values("k")
    assert (got.r.to_numpy() == np.arange(1, 2001)).all()
    wide = pd.DataFrame({"f": ["a"] * 500 + ["b"] * 500, "v": np.r_[rng.random(500), rng.random(500) * 1e6]})
    q = ranks.quantiles(spark.createDataFrame(wide), "v", {"m": 0.5}, ["f"], scale_of="f").toPandas().set_index("f").m.sort_index()
    assert np.allclose(q, wide.groupby("f").v.median())


def test_no_base_window_without_partition(table):
    plan = ranks.row_number(table, "v", "id", "r")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert windows and all("_bucket" in line for line in windows)
    assert "Python" not in plan


def test_bins_edges_and_running_sum(table, frame, spark):
    edges = ranks.quantile_edges(table, "v", 5)
    want = pd.qcut(frame.v, 5, duplicates="drop", retbins=True)[1]
    assert np.allclose(edges, want)
    labels = list(range(len(edges) - 1))
    got = table.select("id", ranks.cut(F.col("v"), edges, labels, True).alias("b")).toPandas().sort_values("id")
    assert np.allclose(got.b, pd.qcut(frame.v, 5, labels=False, duplicates="drop"), equal_nan=True)
    total = ranks.running_sum(spark.range(100).select("id", (F.col("id") * 2).alias("m")), "id", "m", "s").toPandas().sort_values("id")
    assert (total.s == np.cumsum(np.arange(100) * 2)).all()


def test_permutation_keeps_groups_and_ignores_partitioning(table, frame):
    a = resample.permute(table, ["v"], ["id"], 5, ["g"]).toPandas().sort_values("id").reset_index(drop=True)
    b = resample.permute(table.repartition(3), ["v"], ["id"], 5, ["g"]).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
    for g, part in a.groupby("g"):
        assert sorted(part.v.fillna(-99)) == sorted(frame[frame.g == g].v.fillna(-99))
    assert (a.v.fillna(-99).to_numpy() != frame.v.fillna(-99).to_numpy()).any()


def test_samples(table, frame):
    assert sampling.sample_rows(table, 100, ["id"]).count() == 100
    kept = sampling.sample_groups(table, "g", 1200).groupBy("g").count().toPandas()
    sizes = frame.groupby("g").size()
    assert all(sizes[r.g] == r["count"] for _, r in kept.iterrows())
    assert kept["count"].sum() >= 1200 and kept["count"].sum() - kept["count"].min() < 1200


def test_quantiles_of_small_and_large_groups_agree(spark, monkeypatch):
    """One window per group, or range buckets: the same numbers, NULL groups, ties and repeated rows included."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 37 > 0, F.col("id") % 37).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(50)) / 7).alias("v")).unionByName(
        spark.createDataFrame([(1, None), (99, 2.5), (None, -0.0)], "k long, v double"))
    probs = {"a": 0.25, "b": 0.5, "c": 1.0}
    read = lambda: sorted(map(tuple, ranks.quantiles(rows, "v", probs, ["k"]).collect()), key=repr)
    small = read()
    monkeypatch.setattr(ranks, "SMALL_GROUP", 3)
    assert small == read() and len(small) == 38


def test_students_of_two_years_are_built_once(spark, folder):
    assert bindings.two_years(spark, folder) is bindings.two_years(spark, folder)
