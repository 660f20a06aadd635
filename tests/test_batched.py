"""Models of many training sets in shared scans against one fit each, and against plain numpy."""
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortspark import contracts as C
from cohortspark.models import batched, interpret, robustness, split
from cohortspark.models import candidates as M
from cohortspark.operators import metrics, ranks, sampling

FEATURES = ("mun_taxa_alfab_lag1", "mun_n_alunos_lag1", "uf_taxa_alfab_lag1", "nome_regiao", "sigla_uf", "caderno")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    n, groups = 1200, 50
    g = rng.integers(0, groups, n)
    rate = rng.uniform(20, 90, groups)
    pdf = pd.DataFrame({
        "row_id": np.arange(n), C.GROUP: g, C.TARGET: (rng.random(n) < 1 - rate[g] / 100).astype(int), C.WEIGHT: 1.0,
        "mun_taxa_alfab_lag1": np.where(g % 7 == 0, np.nan, np.round(rate[g], 1)), "mun_n_alunos_lag1": 1e7 + g, "uf_taxa_alfab_lag1": 5.0,
        "nome_regiao": np.where(g % 5 == 0, None, np.where(g % 2 == 0, "N", "S'")), "sigla_uf": np.where(g < 2, "only", "rest"),
        "caderno": [None if x == 9 else str(x) for x in rng.choice([1, 2, 3, 43, 9], n, p=[0.4, 0.29, 0.295, 0.005, 0.01])]})
    schema = f"row_id long, {C.GROUP} long, {C.TARGET} int, {C.WEIGHT} double, mun_taxa_alfab_lag1 double, mun_n_alunos_lag1 double, uf_taxa_alfab_lag1 double, nome_regiao string, sigla_uf string, caderno string"
    records = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.astype(object).itertuples(index=False)]
    return split.folds(spark.createDataFrame(records, schema), 3).cache()


@pytest.mark.parametrize("indicators", [True, False])
def test_every_fold_equals_its_own_fit(rows, indicators):
    candidate = M.logistic(FEATURES, "l", indicators)
    made = candidate.batch(rows, batched.fold_sets(3))
    scored, _ = M.out_of_fold(rows, candidate, 3)
    together = {r["row_id"]: r[M.SCORE] for r in scored.collect()}
    for i in range(3):
        alone = candidate.fit(rows.where(F.col("fold") != i), 1)
        names = {c.name: v for c, v in zip(alone.preprocessor.columns, alone.classifier.coefficients)}
        got = dict(zip((c.name for c in made.fitted.designs[i].columns), made.fitted.beta[i][1:]))
        assert set(got) == set(names) and max(abs(got[k] - names[k]) for k in names) < 1e-5
        for r in alone.score(rows.where(F.col("fold") == i)).collect():
            assert abs(together[r["row_id"]] - r[M.SCORE]) < 1e-6


def test_model_columns_are_standardised(rows):
    base = batched.base_of(rows, FEATURES)
    packed = batched.blocks(rows, base, [F.lit(True)], [F.col(C.TARGET)])
    design = batched.designs(rows, packed, base, [F.lit(True)], True)[0]
    x = np.concatenate([b[0] for b in batched.unpacked(iter(packed.toArrow().to_batches()))]) @ design.matrix
    for i, c in enumerate(design.columns, 1):
        if c.kind in ("value", "missing"):
            assert abs(x[:, i].mean()) < 1e-8 and (abs(x[:, i].std() - 1) < 1e-8 or c.feature == "uf_taxa_alfab_lag1")
        else:
            assert set(np.round(x[:, i], 12)) <= {0.0, 1.0}


def test_slope_is_zero_at_the_solution(rows):
    made = M.logistic(FEATURES, "l").batch(rows, batched.fold_sets(3)).fitted
    scored, _ = M.out_of_fold(rows.withColumn("fold", F.col("fold")), M.logistic(FEATURES, "l"), 3)
    assert made.steps < 20
    # The intercept is free, so scores of a training set add up to its ones.
    base = batched.base_of(rows, FEATURES)
    for i in range(3):
        p = batched.probability(base, made.gamma(), F.lit(i))
        off = rows.where(F.col("fold") != i).agg(F.sum(p - F.col(C.TARGET))).first()[0]
        assert abs(off) < 1e-6


def test_permuted_labels_are_permutations(rows):
    made = robustness.permuted_labels(rows, 4, 3, 5).select("row_id", C.GROUP, C.TARGET, "_labels").toPandas()
    labels = np.array(made._labels.tolist())
    assert (labels[:, 0] == made[C.TARGET]).all() and (labels.sum(axis=0) == labels[:, 0].sum()).all()
    inside = made.groupby(C.GROUP).apply(lambda d: np.array(d._labels.tolist()).sum(axis=0).tolist(), include_groups=False)
    assert all(len(set([v[0], *v[5:]])) == 1 for v in inside)
    assert len({tuple(c) for c in labels.T}) == 8
    again = robustness.permuted_labels(rows.repartition(3), 4, 3, 5).select("row_id", "_labels").toPandas()
    assert made.set_index("row_id")._labels.to_dict() == again.set_index("row_id")._labels.to_dict()


def test_permutation_test(rows):
    table = robustness.permutation_test(rows.drop("fold"), M.logistic(FEATURES, "l"), 6, 4, 3).toPandas()
    real = table[table.tipo == "real"].roc_auc.iloc[0]
    assert len(table) == 11 and real > 0.6 and real > table[table.tipo == "nulo_global"].roc_auc.max()
    # Inside the groups the rate of a group stays, so the municipal rate still ranks.
    assert table[table.tipo == "nulo_dentro_do_municipio"].roc_auc.min() > 0.58
    dealt = split.folds(rows.drop("fold"), 3)
    scored, _ = M.out_of_fold(dealt, M.logistic(FEATURES, "l"), 3)
    assert abs(real - metrics.auc(scored, C.TARGET, M.SCORE, ["fold"]).agg(F.avg("auc")).first()[0]) < 1e-9


def test_learning_curve_equals_single_fits(rows):
    plain = rows.drop("fold")
    wanted = (0.25, 1.0)
    candidate = M.logistic(FEATURES, "l")
    got = robustness.learning_curve(plain, candidate, wanted, (42, 7)).toPandas()
    marked = split.holdout(plain, 0.25, C.SEED).cache()
    train, check = marked.where("not teste"), marked.where("teste")
    for r in got.itertuples():
        sample = train if r.fracao == 1 else sampling.sample_groups(train, C.GROUP, int(round(r.fracao * train.count())), r.seed_amostra)
        assert sample.count() == r.n_alunos_treino and sample.select(C.GROUP).distinct().count() == r.n_municipios_treino
        scorer = candidate.fit(sample.drop("teste"), 1)
        assert abs(metrics.auc(scorer.score(check), C.TARGET, M.SCORE).first()[0] - r.roc_auc_validacao) < 1e-3
    assert len(got) == 3


def test_leave_one_region_out_keeps_rows_without_region(rows):
    table = robustness.leave_one_region_out(rows, M.logistic(("mun_taxa_alfab_lag1", "mun_n_alunos_lag1"), "l")).toPandas().set_index("regiao_de_teste")
    counts = rows.groupBy("nome_regiao").count().toPandas().set_index("nome_regiao")["count"]
    assert set(table.index) == {"N", "S'"} and all(table.n_teste[k] == counts[k] and table.n_treino[k] == 1200 - counts[k] for k in table.index)
    assert (table.roc_auc > 0.5).all()


def test_limits(spark, rows):
    with pytest.raises(batched.QualityError):
        batched.blocks(rows, batched.base_of(rows, FEATURES), [F.lit(True)] * 65, [F.col(C.TARGET)])
    nothing = rows.limit(0)
    made = M.logistic(FEATURES, "l").batch(nothing, batched.fold_sets(3))
    assert made.fitted.steps == 1 and M.out_of_fold(nothing, M.logistic(FEATURES, "l"), 3)[0].count() == 0


def test_drops_of_a_linear_model(rows):
    """Every block and repeat against the same shuffle done on the raw columns and scored again."""
    marked = rows.withColumn("teste", F.col(C.GROUP) % 4 == 0).cache()
    made = M.logistic(FEATURES, "l", True).batch(marked, [~F.col("teste")])
    check = marked.where("teste")
    blocks = {"taxa": ["mun_taxa_alfab_lag1"], "duas": ["mun_taxa_alfab_lag1", "nome_regiao"], "fora": ["rede_grupo"], "tudo": list(FEATURES)}
    got = robustness.linear_drops(made, check, blocks, 3, 5).toPandas().set_index("bloco")
    assert got.loc["fora"].queda_media == 0 and got.loc["fora"].queda_dp == 0 and (got.n_repeticoes == 3).all() and got.loc["duas"].n_features == 2

    n = check.count()
    target = ranks.hash_position(check, ["row_id"], 5, "_at", salt=1)
    drops = {name: [] for name in blocks}
    for r in range(3):
        origin = ranks.hash_position(check.withColumn("rep", F.lit(r)), ["rep", "row_id"], 5, "_at", salt=2).select("_at", *[F.col(f).alias(f"_{f}") for f in FEATURES])
        pairs = target.join(origin, "_at").cache()
        assert pairs.count() == n
        for name, columns in blocks.items():
            moved = pairs.withColumns({c: F.col(f"_{c}") for c in columns if c in FEATURES})
            p = batched.probability(made.base, made.fitted.gamma(), F.lit(0))
            drops[name].append(metrics.auc(moved.select(C.TARGET, p.alias("p")), C.TARGET, "p").first()[0])
    plain = metrics.auc(check.select(C.TARGET, batched.probability(made.base, made.fitted.gamma(), F.lit(0)).alias("p")), C.TARGET, "p").first()[0]
    for name, values in drops.items():
        lost = plain - np.array(values)
        assert abs(got.loc[name].roc_auc_referencia - plain) < 1e-9
        assert abs(got.loc[name].queda_media - lost.mean()) < 1e-9 and abs(got.loc[name].queda_dp - lost.std(ddof=1)) < 1e-9
    assert robustness.linear_drops(made, check.limit(0), blocks, 2).count() in (0, len(blocks))


def test_readings_of_a_linear_model(rows):
    made = M.logistic(FEATURES, "l", True).batch(rows, [F.lit(True)])
    reading = interpret.linear_attributions(made, rows)
    families = {f: "lag" if f.endswith("lag1") else "estrutura" for f in FEATURES}
    table = rows.sparkSession.createDataFrame(list(families.items()), "feature string, familia string")
    long = reading.long().cache()
    for key, group_of, mapping in (("familia", families, table), ("feature", {f: f for f in FEATURES}, None)):
        a = interpret.grouped_reading(reading, group_of, key).toPandas().set_index(key).sort_index()
        b = interpret.grouped_importance(long, mapping, key).toPandas().set_index(key).sort_index()
        assert list(a.index) == list(b.index) and np.allclose(a[b.columns].astype(float), b.astype(float), atol=1e-9)
    assert abs(interpret.importance_by_column(long).agg(F.sum("participacao")).first()[0] - 1) < 1e-9


def test_coefficients_of_all_folds_at_once(rows):
    got = interpret.linear_coefficients(rows, FEATURES, 3).toPandas().set_index("coluna")
    alone = {}
    for i in range(3):
        scorer = M.logistic(FEATURES).fit(rows.where(F.col("fold") != i), 1)
        for c, b in zip(scorer.preprocessor.columns, scorer.classifier.coefficients):
            alone.setdefault(c.name, []).append(b)
    whole = M.logistic(FEATURES).fit(rows, 1)
    x = np.array([r.features.toArray() for r in whole.preprocessor.transform(rows).collect()])
    for i, (c, b) in enumerate(zip(whole.preprocessor.columns, whole.classifier.coefficients)):
        r = got.loc[c.name]
        assert abs(r.coeficiente - b) < 1e-4 and abs(r.razao_de_chances - np.exp(r.coeficiente)) < 1e-9
        assert abs(r.coeficiente_dp_entre_folds - np.std(alone[c.name], ddof=1)) < 1e-4 and r.folds_com_a_coluna == 3
        assert abs(r.contribuicao_dp - abs(r.coeficiente) * x[:, i].std(ddof=1)) < 1e-6
    assert len(got) == x.shape[1]


def test_blocks_are_read_in_place():
    """A block is a view of its batch, whose memory is not held twice."""
    x = np.arange(12, dtype="<f8").reshape(3, 4)
    cells = [pa.array([v], pa.binary()) for v in (x.tobytes(), bytes([1, 0, 1]), bytes([0, 1, 1]))]
    batch = pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), *cells], names=["n", "x", "s", "y"])
    ((got, s, y),) = batched.unpacked(iter([batch]))
    assert (got == x).all() and s.ravel().tolist() == [1, 0, 1] and y.ravel().tolist() == [0, 1, 1]
    low, high = batch.column("x").buffers()[2].address, batch.column("x").buffers()[2].size
    assert low <= got.ctypes.data < low + high


def test_area_of_packed_ranges(spark):
    """Ties within and across pieces, a range without rows, a check of one class."""
    rng = np.random.default_rng(3)
    score, y = np.round(rng.normal(size=3000), 2), rng.integers(0, 2, 3000)
    edges = np.array([-9.0, -0.5, 0.0, 0.0, 0.5])
    made = [b for part in np.array_split(np.arange(3000), 7) for b in metrics.pieces_of(iter([(4, score[part], y[part], edges), (5, score[part], y[part] * 0, edges)]))]
    pieces = spark.createDataFrame(pa.Table.from_batches(made))
    got = {r["check"]: r["auc"] for r in metrics.auc_of_pieces(pieces).collect()}
    pos, neg = score[y == 1], score[y == 0]
    assert got[5] is None and abs(got[4] - ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)) < 1e-12


def test_scores_of_drops_and_checks_are_not_shuffled_one_by_one(rows, monkeypatch):
    """A shuffled row per score is what made them grow: the area comes from packed ranges, many of them too."""
    monkeypatch.setattr(metrics, "RANGE_ROWS", 100)
    monkeypatch.setattr(metrics, "ranking_from_histogram", lambda *a, **k: pytest.fail("a row per score"))
    made = M.logistic(FEATURES, "l").batch(rows, batched.fold_sets(3))
    scored = made.packed.toArrow().to_batches()
    x, s, y = (np.concatenate(v) for v in zip(*batched.unpacked(iter(scored))))
    p = batched._sigmoid(x @ made.fitted.gamma())
    got = robustness._auc_of_checks(made, [(m, m, False) for m in range(3)])
    for m in range(3):
        own = s[:, m] == 0
        pos, neg = p[own & (y[:, 0] == 1), m], p[own & (y[:, 0] == 0), m]
        assert abs(got[m] - ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)) < 1e-9
    drops = {r["bloco"]: r["queda_media"] for r in robustness.linear_drops(made, rows, {"taxa": ["mun_taxa_alfab_lag1"], "nada": []}, 2).collect()}
    assert drops["nada"] == 0 and drops["taxa"] > 0.02


def test_labels_of_a_set_share_its_curvature(rows, monkeypatch):
    """Many labels: the same models as one by one, though a model's own curvature is not summed in every step."""
    labelled = robustness.permuted_labels(rows, 5, 3, 5)
    sent, summed = [], batched._summed
    monkeypatch.setattr(batched, "_summed", lambda *a: sent.append(summed(*a)) or sent[-1])
    made = M.logistic(FEATURES, "l").batch(labelled, batched.fold_sets(3), F.col("_labels"), n_labels=9)
    lengths = [len(v) for step in sent[1:] for v in step.values()]
    assert sum(n > 100 for n in lengths) < len(lengths) / 2
    for l in (0, 2, 8):
        alone = M.logistic(FEATURES, "l").batch(labelled.withColumn("_own", F.col("_labels")[l]), batched.fold_sets(3), "_own")
        for t in range(3):
            assert np.allclose(made.fitted.beta[3 * l + t], alone.fitted.beta[t], atol=1e-7)


@pytest.mark.parametrize("fine", [2, 10_000])
def test_cuts_of_labels_in_ranges(rows, monkeypatch, fine):
    """Ranges of two rows or of all: the ones are the rows of the smallest hashes, and a group without ones keeps its rows."""
    monkeypatch.setattr(robustness, "CUT_ROWS", fine)
    some = rows.withColumn(C.TARGET, F.when(F.col(C.GROUP) == 3, 0).otherwise(F.col(C.TARGET)))
    h = [F.shiftrightunsigned(F.xxhash64(F.lit(5), F.lit(i), "row_id"), 11).alias(f"h{i}") for i in (0, 1)]
    got = robustness.permuted_labels(some, 1, 1, 5).select(C.GROUP, C.TARGET, "_labels", *h).toPandas()
    assert len(got) == 1200 and got[got[C.GROUP] == 3]._labels.map(sum).sum() == got[got[C.GROUP] == 3]._labels.map(lambda v: v[1]).sum()
    assert (got._labels.map(lambda v: v[1]) == (got.h0.rank() <= got[C.TARGET].sum())).all()
    of_group = got.groupby(C.GROUP)
    assert (got._labels.map(lambda v: v[2]) == (of_group.h1.rank() <= of_group[C.TARGET].transform("sum"))).all()
