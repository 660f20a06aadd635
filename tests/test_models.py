"""Split, model, calibration and interpretation invariants on a small synthetic cohort."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark import contracts as C
from cohortspark.models import batched, calibration, interpret, preprocess, report, robustness, split, tuning
from cohortspark.models import candidates as M
from cohortspark.operators import metrics, quality

FEATURES = ("mun_taxa_alfab_lag1", "mun_n_alunos_lag1", "nome_regiao", "caderno")


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(4)
    n, groups = 1500, 60
    g = rng.integers(0, groups, n)
    rate = rng.uniform(20, 90, groups)
    y = (rng.random(n) < 1 - rate[g] / 100).astype(int)
    lag = np.where(g % 7 == 0, np.nan, np.round(rate[g], 1))
    pdf = pd.DataFrame({
        "row_id": np.arange(n), C.GROUP: g, C.TARGET: y, C.WEIGHT: 1.0 + g % 3, "mun_taxa_alfab_lag1": lag, "mun_n_alunos_lag1": 10 + g,
        "nome_regiao": np.where(g % 2 == 0, "N", "S"), "caderno": rng.choice([1, 2, 3, 43], n, p=[0.4, 0.3, 0.295, 0.005])})
    df = spark.createDataFrame(pdf).withColumn("mun_taxa_alfab_lag1", F.when(~F.isnan("mun_taxa_alfab_lag1"), F.col("mun_taxa_alfab_lag1")))
    return df.cache(), pdf


@pytest.fixture(scope="module")
def dealt(cohort):
    return split.folds(cohort[0], 3).cache()


def test_splits(cohort, dealt):
    df, pdf = cohort
    marked = split.holdout(df)
    split.assert_disjoint(marked, "teste")
    assert marked.where("teste").select(C.GROUP).distinct().count() == 12 and marked.count() == len(pdf)
    split.assert_disjoint(dealt, "fold")
    table = dealt.groupBy("fold").agg(F.avg(C.TARGET).alias("p"), F.count(F.lit(1)).alias("n")).toPandas()
    assert len(table) == 3 and table.n.sum() == len(pdf) and table.p.max() - table.p.min() < 0.12
    with pytest.raises(quality.QualityError):
        split.assert_disjoint(df.withColumn("s", F.col("row_id") % 2), "s")
    assert split.folds(df.repartition(2), 3).exceptAll(dealt).count() == 0


def test_preprocessor(cohort):
    df, pdf = cohort
    fitted = preprocess.fit_preprocessor(df, FEATURES)
    names = [c.name for c in fitted.columns]
    assert "mun_taxa_alfab_lag1=NULL" in names and "mun_n_alunos_lag1=NULL" not in names
    assert {"caderno=1", "caderno=2", "caderno=3", f"caderno={preprocess.POOLED}"} <= set(names) and "caderno=43" not in names
    x = np.array([r.features.toArray() for r in fitted.transform(df.orderBy("row_id")).collect()])
    filled = pdf.mun_taxa_alfab_lag1.fillna(pdf.mun_taxa_alfab_lag1.median())
    want = (filled - filled.mean()) / filled.std(ddof=0)
    assert np.allclose(x[:, names.index("mun_taxa_alfab_lag1")], want)
    unseen = df.limit(1).withColumn("caderno", F.lit(99).cast("long")).withColumn("nome_regiao", F.lit("O'este"))
    v = fitted.transform(unseen).first().features.toArray()
    assert v[names.index(f"caderno={preprocess.POOLED}")] == 1 and v[names.index("nome_regiao=N")] == 0


def test_candidates_and_calibration(spark, cohort, dealt):
    models = [M.prior(), M.univariate("regra", "mun_taxa_alfab_lag1"), M.logistic(FEATURES, "logistica", True)]
    table = M.evaluate_in_folds(dealt, models, 3)
    means = table.groupBy("modelo").agg(F.avg("roc_auc").alias("a")).toPandas().set_index("modelo").a
    assert means["dummy_prior"] == 0.5 and means["regra"] > 0.6 and means["logistica"] > 0.6
    again = M.evaluate_in_folds(dealt, models, 3, done=table)
    assert again.count() == 9
    oof, _ = M.out_of_fold(dealt, models[2], 3)
    assert oof.count() == 1500 and oof.where(F.col(M.SCORE).isNull()).count() == 0
    curve = M.fit_isotonic(oof, C.TARGET, M.SCORE)
    cal = M.apply_isotonic(curve, oof, M.SCORE, "c")
    a, b = metrics.auc(oof, C.TARGET, M.SCORE).first()[0], metrics.auc(cal, C.TARGET, "c").first()[0]
    assert abs(a - b) < 1e-12
    gain = calibration.crossfit_gain(oof, 3).first()
    assert abs(gain.ganho_brier - (gain.brier_bruto - gain.brier_calibrado)) < 1e-12


def test_folds_fitted_together_score_as_one_by_one(spark, cohort, dealt):
    tree = M.boosting(FEATURES, "b", maxIter=3, maxDepth=2, minInstancesPerNode=5)
    (alone, _), (both, seconds) = (M.out_of_fold(dealt, tree, 3, together=n) for n in (1, 3))
    assert alone.count() == 1500 and alone.exceptAll(both).count() == both.exceptAll(alone).count() == 0 and set(seconds) == {0, 1, 2}
    assert M.fits_at_once(dealt.coalesce(1), 3) == 3 and M.fits_at_once(dealt.repartition(64), 3) == 1


def test_comparison_fits_the_whole_models(spark, cohort, monkeypatch):
    """The forest and the boosting of the comparison have all features and the reference's trees, over five folds."""
    from cohortspark.queries import modelling
    asked = {}
    monkeypatch.setattr(modelling, "matrix", lambda spark, folder: cohort[0])
    monkeypatch.setattr(modelling.M, "evaluate_in_folds", lambda df, models, k, **more: asked.update(df=df, k=k, models={c.name: c for c in models}) or df.withColumns({"segundos": F.lit(0), "papel": F.lit("")}))
    modelling.candidate_comparison(spark, "")
    assert asked["k"] == 5 and asked["df"].select("fold").distinct().count() == 5
    assert list(asked["models"]) == ["dummy_prior", "heuristica_taxa_municipal", "heuristica_proficiencia_municipal", "logistica_podada", "random_forest", "boosting_padrao"]
    forest, boosting = asked["models"]["random_forest"], asked["models"]["boosting_padrao"]
    assert forest.features == boosting.features == C.MODEL_FEATURES
    assert forest.extra == {"numTrees": 200, "maxDepth": 16, "minInstancesPerNode": 500, "featureSubsetStrategy": "sqrt"}
    assert boosting.extra == {"maxIter": 400, "stepSize": 0.05, "maxDepth": 6, "minInstancesPerNode": 200, "subsamplingRate": 0.8}


def test_logistic_matches_newton(cohort):
    df, pdf = cohort
    scorer = M.logistic(("mun_n_alunos_lag1", "nome_regiao"), "l").fit(df, 1)
    x = np.array([r.features.toArray() for r in scorer.preprocessor.transform(df.orderBy("row_id")).collect()])
    y = pdf[C.TARGET].to_numpy()
    z = np.c_[np.ones(len(y)), x]
    w, penalty = np.zeros(z.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty + 1e-12 * np.eye(len(w)), z.T @ (p - y) + penalty @ w)
    assert np.allclose(scorer.classifier.coefficients.toArray(), w[1:], atol=2e-3)


def test_report_and_saved_model(spark, cohort):
    import tempfile
    df, _ = cohort
    strata = {"nome_regiao": F.col("nome_regiao")}
    result = report.build_report(df, M.logistic(FEATURES, "l", True), 3, replicates=10, strata=strata, minimum=50)
    assert result.tables["ranking"].first().roc_auc > 0.6 and result.tables["estratos"].count() == 2
    low, cap = result.thresholds.first()[:2]
    assert 0 < low < 1 and 0 < cap < 1
    path = tempfile.mkdtemp(prefix="cohortspark-model-")
    report.save_model(result, path, df, FEATURES)
    model, meta = report.load_model(spark, path)
    before = result.scorer.base.score(df).select("row_id", M.SCORE).orderBy("row_id").limit(5).collect()
    from pyspark.ml.functions import vector_to_array
    after = model.transform(df).select("row_id", vector_to_array("probability")[1].alias("s")).orderBy("row_id").limit(5).collect()
    assert np.allclose([r[1] for r in before], [r[1] for r in after]) and meta.count() == 1


def test_a_report_makes_only_the_tables_that_are_read(cohort, monkeypatch):
    """The strata of the held-out side need neither the thresholds nor any other table."""
    df, _ = cohort
    for name in ("cluster_bootstrap",):
        monkeypatch.setattr(report.resample, name, lambda *a, **k: pytest.fail("not asked for"))
    for name in ("ranking_metrics", "calibration_curve", "capacity_curve", "lift_by_decile", "group_fit", "best_f1_threshold"):
        monkeypatch.setattr(report.metrics, name, lambda *a, **k: pytest.fail("not asked for"))
    result = report.build_report(df, M.logistic(FEATURES, "l", True), 3, replicates=10, strata={"nome_regiao": F.col("nome_regiao")}, minimum=50)
    assert {"ranking", "estratos", "intervalos", "resumo_split"} <= set(result.tables) and len(result.tables) == 10
    assert result.tables["resumo_split"].count() == 2 and result.tables["resumo_split"] is result.tables["resumo_split"]


def test_scores_of_a_linear_report_carry_no_model_object(cohort, monkeypatch):
    """The plan that scores unseen rows is made of plain columns: nothing in it but Spark's own expressions is serialised."""
    df, _ = cohort
    made = M.scorer_of(M.logistic(FEATURES, "l", True), df, 1)
    scored = made.score(df)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "features" not in scored.columns
    alone = M.logistic(FEATURES, "l", True).fit(df, 1).score(df)
    both = scored.select("row_id", M.SCORE).join(alone.select("row_id", F.col(M.SCORE).alias("b")), "row_id").toPandas()
    assert len(both) == df.count() and np.allclose(both[M.SCORE], both.b, atol=1e-5)
    monkeypatch.setattr(M.LinearOrTreeScorer, "score", lambda *a, **k: pytest.fail("a model object in the plan"))
    assert robustness.drift(df, df, lambda: M.logistic(FEATURES, "l", True), ("a", "b")).count() == 3
    assert calibration.fit_calibrated(split.folds(df, 3), M.logistic(FEATURES, "l", True), 3).score(df).count() == df.count()


def test_attributions_add_up(cohort):
    df, _ = cohort
    linear = M.logistic(FEATURES, "l", True).batch(df, [F.lit(True)])
    long = interpret.linear_attributions(linear, df).long()
    scores = df.select("row_id", batched.probability(linear.base, linear.fitted.gamma(), F.lit(0)).alias("p"))
    margins = scores.select("row_id", F.expr("ln(p / (1 - p))").alias(M.SCORE))
    total = long.groupBy("row_id").agg(F.sum("valor").alias("s")).join(margins, "row_id").toPandas()
    assert len(total) == df.count() and np.allclose((total[M.SCORE] - total.s).std(), 0, atol=1e-8) and abs(total.s.mean()) < 1e-9
    tree = M.boosting(FEATURES, "b", maxIter=4, maxDepth=3, minInstancesPerNode=5).fit(df, 1)
    walks = interpret.sampled_attributions(tree, df, FEATURES, 20, 2)
    assert walks.select("row_id").distinct().count() == 20
    # every order walks from a sampled row to the row itself, so over the sample the sums follow the margins
    sums = walks.groupBy("row_id").agg(F.sum("valor").alias("s")).join(tree.score(df, margin=True).select("row_id", M.SCORE), "row_id").toPandas()
    assert np.corrcoef(sums.s, sums[M.SCORE])[0, 1] > 0.5


def test_grouped_cancellation(spark):
    a = (0.4, -0.2, 0.9, -0.5)
    rows = [(i, "a", "f1", v) for i, v in enumerate(a)] + [(i, "b", "f2", -v) for i, v in enumerate(a)] + [(i, "c", "f3", 0.3) for i in range(4)]
    df = spark.createDataFrame(rows, "row_id int, coluna string, feature string, valor double")
    families = spark.createDataFrame([("f1", "x"), ("f2", "x"), ("f3", "y")], "feature string, familia string")
    t = interpret.grouped_importance(df, families, "familia").toPandas().set_index("familia")
    assert abs(t.loc["x"].media_do_abs_da_soma) < 1e-12 and t.loc["x"].cancelamento_interno == 1 and abs(t.loc["y"].cancelamento_interno) < 1e-12
    with pytest.raises(quality.QualityError):
        interpret.family_of(["f1", "f2"], {"x": ("f1",), "y": ("f1",)})
    with pytest.raises(quality.QualityError):
        interpret.origin_of_levels(["fonte_lag_uf_gold"], ["fonte_lag", "fonte_lag_uf"], "_")
    assert set(interpret.family_of()) == set(C.MODEL_FEATURES)


def test_controls(cohort):
    df, _ = cohort
    scorer = M.logistic(FEATURES, "l", True).fit(df, 1)
    t = robustness.invariance(scorer, df, ["caderno", "mun_taxa_alfab_lag1"], 2).toPandas().set_index("coluna").queda_media
    assert t["mun_taxa_alfab_lag1"] > 0.05 > abs(t["caderno"])


def test_settings_and_edges(spark):
    assert tuning.draw_settings(5) == tuning.draw_settings(5) and len(tuning.extended_grid({"a": 1}, {"a": (2, 3), "b": (4, 5)})) == 4
    table = spark.createDataFrame([(0, 0.6, 10.0, 5.0), (1, 0.7, 20.0, 6.0), (2, 0.65, 15.0, 7.0)], "iteracao int, roc_auc double, p double, q double")
    flags = {r.parametro: r.na_borda for r in tuning.edge_flags(table, ["p", "q"]).collect()}
    assert flags == {"p": True, "q": False}


def test_rows_without_group_are_refused(spark):
    df = spark.createDataFrame([(1, 1), (None, 0), (2, 1)], "g int, y int")
    for make in (lambda: split.holdout(df, group="g"), lambda: split.folds(df, 2, label="y", group="g")):
        with pytest.raises(quality.QualityError):
            make()


def test_nan_is_flagged_like_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    fitted = preprocess.fit_preprocessor(df, ["x"])
    flags = [r["features"][1] for r in fitted.transform(df).collect()]
    assert flags[1] == flags[3] > 0 > flags[0] == flags[2]
