"""Closed-form columns and metrics against direct computation."""
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.functions import stats
from cohortspark.operators import metrics, profile, quality, resample


def test_normal_and_t(spark):
    zs = [-40.0, -8.5, -3.0, -1.96, -0.1, 0.0, 0.3, 1.0, 2.5, 7.5, 40.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", stats.normal_cdf(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * math.erfc(-r.z / math.sqrt(2))) < 1e-13 for r in got)
    # tabulated two-sided values: the 0.975 point has p = 0.05 for every degree of freedom
    rows = [(t, i + 1) for i, t in enumerate(stats.T_975)]
    got = spark.createDataFrame(rows, "t double, df int").select(stats.t_two_sided_p(F.col("t"), F.col("df")).alias("p"), stats.t_quantile_975(F.col("df")).alias("q"), "t").collect()
    assert all(abs(r.p - 0.05) < 1e-8 and r.q == r.t for r in got)
    far = spark.range(1).select(stats.t_quantile_975(F.lit(60)).alias("q")).first().q
    assert abs(far - 2.000297822) < 1e-5


def test_wilson(spark):
    df = spark.createDataFrame([(0, 10), (5, 10), (10, 10), (0, 0)], "k int, n int")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    rows = df.select(low.alias("l"), high.alias("h")).collect()
    assert abs(rows[0].l) < 1e-12 and abs(rows[0].h - 0.27753) < 1e-4
    assert abs(rows[1].l - 0.23659) < 1e-4 and abs(rows[1].h - 0.76341) < 1e-4
    assert rows[3].l is None


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(2)
    n = 2000
    g = rng.integers(0, 60, n)
    effect = rng.normal(0, 1.2, 60)
    p = np.round(1 / (1 + np.exp(-(effect[g] + rng.normal(0, 0.5, n)))), 2)
    y = (rng.random(n) < p).astype(int)
    return pd.DataFrame({"id": np.arange(n), "g": g, "p": p, "y": y})


def brute(y, p):
    d = p[y == 1][:, None] - p[y == 0][None, :]
    auc = ((d > 0).sum() + 0.5 * (d == 0).sum()) / d.size
    ap, ks, last = 0.0, 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit, alarm = ((p >= t) & (y == 1)).sum(), (p >= t).sum()
        tpr, fpr = hit / y.sum(), (alarm - hit) / (1 - y).sum()
        ap += (tpr - last) * hit / alarm
        last, ks = tpr, max(ks, tpr - fpr)
    return auc, ap, ks


def test_ranking_metrics(spark, scores):
    df = spark.createDataFrame(scores)
    r = metrics.ranking_metrics(df, "y", "p").first()
    auc, ap, ks = brute(scores.y.to_numpy(), scores.p.to_numpy())
    assert abs(r.roc_auc - auc) < 1e-12 and abs(r.pr_auc - ap) < 1e-12 and abs(r.ks - ks) < 1e-12
    assert abs(r.brier - ((scores.p - scores.y) ** 2).mean()) < 1e-12
    by = metrics.ranking_metrics(df, "y", "p", ["g"]).toPandas().set_index("g")
    for g, part in scores.groupby("g"):
        if part.y.nunique() == 2:
            assert abs(by.loc[g].roc_auc - brute(part.y.to_numpy(), part.p.to_numpy())[0]) < 1e-12
        else:
            assert pd.isna(by.loc[g].roc_auc)
    t = metrics.best_f1_threshold(df, "y", "p").first().limiar
    f1 = {c: 2 * ((scores.p >= c) & (scores.y == 1)).sum() / ((scores.p >= c).sum() + scores.y.sum()) for c in set(scores.p)}
    assert abs(f1[t] - max(f1.values())) < 1e-12


def test_cluster_interval_wider_than_row_interval(spark, scores):
    df = spark.createDataFrame(scores)
    cluster = resample.cluster_bootstrap(df, "y", "p", "g", 60).toPandas().set_index("metrica")
    rows = resample.cluster_bootstrap(df, "y", "p", "id", 60).toPandas().set_index("metrica")
    width = lambda t, m: t.loc[m].ic_alto - t.loc[m].ic_baixo
    assert width(cluster, "brier") > width(rows, "brier")
    assert cluster.loc["roc_auc"].ic_baixo < cluster.loc["roc_auc"].pontual < cluster.loc["roc_auc"].ic_alto


def test_replicate_weights_draw_as_many_groups(spark, scores):
    df = spark.createDataFrame(scores)
    w = resample.replicate_weights(df, ["g"], 20).groupBy("rep").agg(F.sum("w").alias("s")).toPandas()
    assert len(w) == 20 and (w.s == 60).all()
    again = resample.replicate_weights(df.repartition(3), ["g"], 20)
    assert resample.replicate_weights(df, ["g"], 20).exceptAll(again).count() == 0


def test_paired_bootstrap_of_equal_scores(spark, scores):
    df = spark.createDataFrame(scores).withColumn("q", F.col("p"))
    r = resample.paired_auc_bootstrap(df, "y", "p", "q", "g", 20).first()
    assert r.delta == 0 and r.ic95_baixo == 0 and r.p_bootstrap == 1.0


def test_correlation_bootstrap(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    pdf = pd.DataFrame({"id": range(300), "x": x, "y": 0.7 * x + rng.normal(size=300)})
    r = resample.correlation_bootstrap(spark.createDataFrame(pdf), "id", "x", "y", 200).first()
    want = np.corrcoef(pdf.x, pdf.y)[0, 1]
    assert abs(r.corr_pearson - want) < 1e-12 and r.ic_low < want < r.ic_high
    assert abs((r.ic_high - r.ic_low) / 2 - 1.96 * (1 - want**2) / math.sqrt(300)) < 0.03


@pytest.mark.parametrize("slice_rows, counts_bytes", [(2_048, 64 << 20), (7, 60 * 4 * 5)])
def test_bootstrap_against_resampled_rows(spark, scores, monkeypatch, slice_rows, counts_bytes):
    """Every replicate rebuilt by drawing the groups' rows, with hot scores, several rounds and groups without a name."""
    monkeypatch.setattr(resample, "SLICE", slice_rows)
    monkeypatch.setattr(resample, "COUNTS_BYTES", counts_bytes)
    pdf = scores.assign(p=np.where(scores.id % 3 == 0, 0.5, scores.p), q=scores.p.round(1), g=scores.g.where(scores.g > 0).astype("Int64"))
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf[["id", "g", "y", "p", "q"]].astype(object).itertuples(index=False)]
    df = spark.createDataFrame(rows, "id long, g long, y int, p double, q double").repartition(3)
    replicates = 12
    names = sorted({r[1] for r in rows}, key=lambda g: (hashlib.md5(f"42:0:{'' if g is None else g}".encode()).hexdigest()[:15]))
    parts = {g: pdf[pdf.g.isna()] if g is None else pdf[pdf.g == g] for g in names}
    table = []
    for rep in range(replicates):
        drawn = [names[int(hashlib.md5(f"42:{rep}:{i}".encode()).hexdigest()[:15], 16) % len(names)] for i in range(len(names))]
        some = pd.concat([parts[g] for g in drawn])
        y, p = some.y.to_numpy(), some.p.to_numpy()
        table.append((*brute(y, p)[:2], ((p - y) ** 2).mean(), y.mean(), brute(y, some.q.to_numpy())[0] - brute(y, p)[0]))
    want = np.array(table)
    got = resample.cluster_bootstrap(df, "y", "p", "g", replicates, additive={"share": F.col("y")}).toPandas().set_index("metrica")
    for i, m in enumerate(("roc_auc", "pr_auc", "brier", "share")):
        low, high = np.percentile(want[:, i], [2.5, 97.5])
        assert np.allclose([got.loc[m].ic_baixo, got.loc[m].ic_alto, got.loc[m].desvio_bootstrap], [low, high, want[:, i].std(ddof=1)], atol=1e-12)
        assert got.loc[m].n_reamostras == replicates
    r = resample.paired_auc_bootstrap(df, "y", "p", "q", "g", replicates).first()
    assert np.allclose([r.ic95_baixo, r.ic95_alto], np.percentile(want[:, 4], [2.5, 97.5]), atol=1e-12) and r.p_bootstrap == (want[:, 4] <= 0).mean()


def test_bootstrap_of_nothing(spark):
    empty = spark.createDataFrame([], "y int, p double, g long")
    assert resample.cluster_bootstrap(empty, "y", "p", "g", 5).where("n_reamostras > 0").count() == 0
    with pytest.raises(ValueError):
        list(resample.rounds([1 << 30], 5))


def test_corrected_t(spark):
    rows = [(0.02,), (0.01,), (0.03,), (0.015,), (0.025,)]
    r = resample.corrected_t(spark.createDataFrame(rows, "d double"), "d").first()
    d = np.array([x[0] for x in rows])
    t = d.mean() / math.sqrt(d.var(ddof=1) * (1 / 5 + 1 / 4))
    assert abs(r.t_nadeau_bengio - t) < 1e-9 and r.folds_a_favor == 5 and 0.015 < r.p_valor < 0.02


def test_variance_inflation(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=500), rng.normal(size=500)
    pdf = pd.DataFrame({"a": a, "b": b, "c": a + 0.1 * rng.normal(size=500), "k": 1.0})
    got = profile.variance_inflation(spark.createDataFrame(pdf), ["a", "b", "c"]).toPandas().set_index("feature").vif
    want = np.diag(np.linalg.inv(np.corrcoef(pdf[["a", "b", "c"]].to_numpy(), rowvar=False)))
    assert np.allclose(got.loc[["a", "b", "c"]], want)
    with pytest.raises(quality.QualityError):
        profile.variance_inflation(spark.createDataFrame(pdf), ["a", "k"])


def test_smoothing_truth_table(spark):
    df = spark.createDataFrame([(0, 0.8, 60.0), (30, 0.8, 60.0), (None, 0.8, 60.0)], "n int, r double, m double")
    got = [r[0] for r in df.select(profile.smoothed_rate(F.col("r") * 100, F.col("n"), F.col("m"), 30)).collect()]
    assert got == [60.0, 70.0, 60.0]


def test_drawn_counts_never_reach_the_driver(spark, monkeypatch):
    """Blocks of few units and few draws at once give the same counts, as a table; what is collected does not grow with the units."""
    monkeypatch.setattr(resample, "BLOCK", 7)
    monkeypatch.setattr(resample, "DRAWS", 10)
    sizes = [40, 0, 23]
    counts = resample.drawn_counts(spark, sizes, 3, 9, 42)
    assert isinstance(counts, type(spark.range(1)))
    got = {(r["_u"], r["_i"]): resample._unpacked([r["_w"]], 6)[0].tolist() for r in counts.collect()}
    numbers = lambda rep, n: [int(hashlib.md5(f"42:{rep}:{i}".encode()).hexdigest()[:15], 16) % n + 1 for i in range(n)]
    want = {(u, i): [numbers(rep, n).count(i) for rep in range(3, 9)] for u, n in enumerate(sizes) for i in range(1, n + 1)}
    assert got == want


def test_draw_numbers_are_md5(spark):
    for low, high, rep in ((0, 1, 0), (5, 1234, 999), (99_990, 100_020, 7), (3, 3, 1)):
        want = [int(hashlib.md5(f"42:{rep}:{i}".encode()).hexdigest()[:15], 16) for i in range(low, high)]
        assert resample._draw_numbers(42, rep, low, high).tolist() == want
