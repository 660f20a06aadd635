"""Distributed isotonic regression against pooling of all points in one place."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark import contracts as C
from cohortspark.models import candidates as M
from cohortspark.operators import isotonic


def plain(x, n, s):
    """Knots (x, value) of the fit, means of adjacent violators pooled one by one."""
    order = np.argsort(x)
    blocks = []
    for i in order:
        blocks.append([float(n[i]), float(s[i]), x[i], x[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, t, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + t, blocks[-1][2], high]
    return np.array([(b[2 + i], b[1] / b[0]) for b in blocks for i in range(2)])


SHAPES = {
    "noise": lambda g, x: g.integers(0, 2, len(x)), "rising": lambda g, x: (g.random(len(x)) < x).astype(int), "falling": lambda g, x: (g.random(len(x)) > x).astype(int),
    "steps": lambda g, x: (np.floor(x * 4) % 2).astype(int), "all": lambda g, x: np.ones(len(x), int), "late": lambda g, x: (x > 0.95).astype(int), "early": lambda g, x: (x < 0.05).astype(int)}


def test_many_curves(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows, want = [], {}
    for c, (name, shape) in enumerate(SHAPES.items()):
        for digits in (1, 3, 6):
            x = np.unique(np.round(draw.random(400), digits))
            n = draw.integers(1, 6, len(x))
            s = shape(draw, x) * n if digits < 6 else np.minimum(n, shape(draw, x) * draw.integers(0, 6, len(x)))
            key = 3 * c + (1, 3, 6).index(digits)
            want[key] = plain(x, n, s)
            rows += [(key, float(a), int(b), float(t)) for a, b, t in zip(x, n, s)]
    df = spark.createDataFrame(rows, "curve int, x double, n int, s double").repartition(5)
    curves = isotonic.fit(df)
    asked = spark.createDataFrame([(k, float(v)) for k in want for v in [*np.linspace(-0.1, 1.1, 57), *want[k][:40, 0]]], "curve int, x double").distinct()
    got = isotonic.evaluate(curves, asked, "v").collect()
    assert len(got) == asked.count()
    for r in got:
        assert abs(r["v"] - np.interp(r["x"], want[r["curve"]][:, 0], want[r["curve"]][:, 1])) < 1e-9, r
    for key in want:
        values = [b["value"] for b in curves.blocks.where(F.col("curve") == key).orderBy("x_low").collect()]
        assert np.allclose(values, want[key][::2, 1]) if len(values) == len(want[key]) // 2 else np.allclose(np.unique(np.round(values, 9)), np.unique(np.round(want[key][:, 1], 9)))


def test_a_million_rising_points(spark):
    """Nothing pools, so every point stays a block; only ranges meet on the driver."""
    points = spark.range(1_000_000).select(F.lit(0).alias("curve"), F.col("id").cast("double").alias("x"), F.lit(1).alias("n"), (F.col("id") / 1e6).alias("s"))
    curves = isotonic.fit(points)
    wrong = curves.blocks.where(F.abs(F.col("value") - F.col("x_low") / 1e6) > 1e-9)
    assert curves.blocks.count() == 1_000_000 and wrong.count() == 0


def test_edges(spark):
    schema = "curve int, x double, n int, s double"
    none = isotonic.fit(spark.createDataFrame([], schema))
    assert none.blocks.count() == 0
    one = isotonic.fit(spark.createDataFrame([(0, 0.5, 4, 1.0)], schema))
    asked = spark.createDataFrame([(0, 0.1), (0, 0.5), (0, 9.0)], "curve int, x double")
    assert [r["v"] for r in isotonic.evaluate(one, asked, "v").collect()] == [0.25] * 3


def test_one_column_rule_in_folds_equals_single_fits(spark):
    draw = np.random.default_rng(6)
    n = 900
    x = np.where(draw.random(n) < 0.3, 50.0, np.round(draw.uniform(0, 100, n)))
    rows = [(i, i % 37, int(draw.random() < 1 - v / 100), 1.0, None if i % 11 == 0 else float(v), i % 3) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, f"row_id long, {C.GROUP} long, {C.TARGET} int, {C.WEIGHT} double, v double, fold int")
    rule = M.univariate("r", "v")
    together = {r["row_id"]: r[M.SCORE] for r in M.out_of_fold(df, rule, 3)[0].collect()}
    for f in range(3):
        alone = rule.fit(df.where(F.col("fold") != f), 1).score(df.where(F.col("fold") == f)).collect()
        assert len(alone) == 300 and all(abs(together[r["row_id"]] - r[M.SCORE]) < 1e-12 for r in alone)
    assert len(together) == n and len({round(together[i], 12) for i in range(0, n, 33)}) <= 3


def test_bridges_are_sought_without_shuffling_the_blocks(spark, monkeypatch):
    """Points are dealt to their cells once; the steps and the last reading take the stored partitions as they are."""
    from pyspark.sql.classic.dataframe import DataFrame
    dealt, plain = [], DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda self, *a: dealt.append(a) or plain(self, *a))
    isotonic.fit(spark.range(600).selectExpr("0 AS curve", "id AS x", "1 AS n", "(id * 7919) % 13 AS s"))
    assert len(dealt) == 1
