"""Grouped splits, candidate models, calibration, search and robustness over the modelling dataset.

Linear models run with production parameters: all folds, permutations and samples share their scans. The candidates are compared with
their default parameters; the boosting of the searches and of the sampled attributions is small, since MLlib fits one by one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import contracts as C
from cohortspark.functions import cleaning
from cohortspark.models import batched, calibration, report, robustness, split, tuning
from cohortspark.models import candidates as M
from cohortspark.operators import metrics, resample
from cohortspark.queries import bindings as B
from cohortspark.queries.evaluation import md5_order
from cohortspark.queries.registry import query
from cohortspark.session import materialize

SMALL = ("mun_taxa_alfab_lag1", "mun_taxa_presenca_lag1", "mun_n_alunos_lag1", "uf_taxa_alfab_lag1", "tem_historico_municipio", "rede_grupo", "nome_regiao")


_BUILT: dict[tuple[str, str], object] = {}


def matrix(spark, folder):
    """The modelling dataset is a stored product: built once per application and folder, then reread."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _BUILT:
        _BUILT[key] = materialize(B.dataset(spark, folder))
    return _BUILT[key]


def small_boosting(features=SMALL, name="boosting", **params):
    return M.boosting(features, name, **{"maxIter": 8, "stepSize": 0.2, "maxDepth": 3, "minInstancesPerNode": 20, **params})


FOLDS = 5


def in_fixed_folds(spark, folder):
    """Folds that need no random order: by the number of the municipality."""
    return matrix(spark, folder).withColumn("fold", F.pmod(F.col(C.GROUP), F.lit(FOLDS)).cast("int"))


PRUNED_NUMBERS = tuple(c for c in C.PRUNED_FEATURES if c not in C.CATEGORICAL_FEATURES)
PRUNED_LEVELS = tuple(c for c in C.PRUNED_FEATURES if c in C.CATEGORICAL_FEATURES)


@query("fold_preprocessing", B.with_ctes(" UNION ALL ".join(f"""
SELECT fold, '{c}' AS feature, n_treino, mediana, avg(coalesce(x, mediana)) AS media, stddev_pop(coalesce(x, mediana)) AS desvio FROM (
  SELECT k.fold, CAST({c} AS DOUBLE) AS x, count(*) OVER w AS n_treino,
         CASE WHEN count(*) OVER w > count({c}) OVER w THEN median(CAST({c} AS DOUBLE)) OVER w END AS mediana
  FROM dataset JOIN (VALUES (0), (1), (2), (3), (4)) AS k(fold) ON id_municipio % 5 <> k.fold WINDOW w AS (PARTITION BY k.fold)) AS t GROUP BY ALL"""
    for c in PRUNED_NUMBERS), "dataset"), ["mediana", "media", "desvio"])
def fold_preprocessing(spark, folder):
    """What each of five training sets learns about its numbers, from one scan."""
    rows = in_fixed_folds(spark, folder)
    sets = batched.fold_sets(FOLDS)
    base = batched.base_of(rows, C.PRUNED_FEATURES)
    made = batched.designs(rows, batched.blocks(rows, base, sets, [F.col(C.TARGET)]), base, sets)
    table = []
    for fold, design in enumerate(made):
        for line, column in zip(design.matrix.T[1:], design.columns):
            if column.kind == "value":
                at, miss, centre = base.numeric[column.feature]
                fill = float(line[1 + miss] / line[1 + at] + centre)
                table.append((fold, column.feature, design.rows, fill if design.missing[column.feature] else None, float(centre - line[0] / line[1 + at]), float(1 / line[1 + at])))
    return spark.createDataFrame(table, "fold int, feature string, n_treino long, mediana double, media double, desvio double")


@query("fold_slopes", B.with_ctes("""
SELECT k.fold, coluna, 0.0::DOUBLE AS inclinacao
FROM dataset JOIN (VALUES (0), (1), (2), (3), (4)) AS k(fold) ON id_municipio % 5 <> k.fold,
LATERAL (SELECT unnest(['intercepto', """ + ", ".join([f"'{c}'" for c in PRUNED_NUMBERS] + [f"'{c}=' || coalesce(CAST({c} AS VARCHAR), 'AUSENTE')" for c in PRUNED_LEVELS]) + """]) AS coluna) AS l
GROUP BY ALL""", "dataset"), ["inclinacao"])
def fold_slopes(spark, folder):
    """The slope of the penalised loss of every fold's model along each of its columns, summed by Spark from the scores: zero at
    the solution. Columns are those the training set knows."""
    rows = in_fixed_folds(spark, folder)
    made = M.logistic().batch(rows, batched.fold_sets(FOLDS))
    gamma = made.fitted.gamma()
    fold = F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))
    seen = rows.withColumn("modelo", fold).where(F.col("modelo") != F.col("fold"))
    miss = batched.probability(made.base, gamma, F.col("modelo")) - F.col(C.TARGET)
    sums = seen.groupBy("modelo").agg(*[F.sum(e * miss).alias(f"s{i}") for i, e in enumerate((F.lit(1.0), *made.base.entries))])
    table = []
    for r in sums.collect():
        design, beta = made.fitted.designs[r["modelo"]], made.fitted.beta[r["modelo"]]
        slope = design.matrix.T @ [r[f"s{i}"] for i in range(len(made.base.entries) + 1)]
        slope[1:] += beta[1:]
        table += [(r["modelo"], name, float(v)) for name, v in zip(("intercepto", *(c.name for c in design.columns)), slope)]
    return spark.createDataFrame(table, "fold int, coluna string, inclinacao double")


HOLDOUT = {"sides": f"""SELECT id_municipio, ordem <= ceil(0.2::DOUBLE * total) AS teste FROM (
  SELECT id_municipio, row_number() OVER (ORDER BY {md5_order("'42:0:' || id_municipio")}, id_municipio) AS ordem, count(*) OVER () AS total FROM (SELECT DISTINCT id_municipio FROM dataset) AS d) AS t"""}


@query("group_holdout", B.with_ctes("SELECT id_municipio, teste, count(*) AS linhas FROM dataset JOIN sides USING (id_municipio) GROUP BY 1, 2", "dataset", extra=HOLDOUT))
def group_holdout(spark, folder):
    """A fifth of the municipalities, whole: the side of each."""
    return split.holdout(matrix(spark, folder)).groupBy(C.GROUP, "teste").agg(F.count(F.lit(1)).alias("linhas"))


@query("holdout_summary", B.with_ctes("""
SELECT teste, count(*) AS n_alunos, count(DISTINCT id_municipio) AS n_municipios, avg(risco_nao_alfabetizacao) AS prevalencia
FROM dataset JOIN sides USING (id_municipio) GROUP BY 1""", "dataset", extra=HOLDOUT), ["prevalencia"])
def holdout_summary(spark, folder):
    return split.split_summary(split.holdout(matrix(spark, folder)), "teste")


@query("stratified_group_folds", B.with_ctes(f"""
SELECT id_municipio, CAST(CASE WHEN turn < 5 THEN turn ELSE 9 - turn END AS INTEGER) AS fold FROM (
  SELECT id_municipio, (row_number() OVER (ORDER BY 2 * len(list_filter(edges[2 : len(edges) - 1], lambda e: n > e)) + p, {md5_order("'42:' || id_municipio")}) - 1) % 10 AS turn FROM (
    SELECT *, (SELECT list_sort(list_distinct(quantile_cont(n, [0, 0.2, 0.4, 0.6, 0.8, 1]))) FROM (SELECT count(*) AS n FROM dataset GROUP BY id_municipio) AS c) AS edges
    FROM (SELECT id_municipio, count(*) AS n, avg(risco_nao_alfabetizacao) AS p FROM dataset GROUP BY 1) AS s) AS t) AS u""", "dataset"))
def stratified_group_folds(spark, folder):
    """The fold of every municipality: size tiers, then prevalence, dealt out in a serpentine."""
    return split.folds(matrix(spark, folder)).select(C.GROUP, "fold").distinct()


@query("preprocessing_columns")
def preprocessing_columns(spark, folder):
    """Model matrix columns, their source feature and their mean and deviation on the training rows."""
    from pyspark.ml.functions import vector_to_array

    from cohortspark.models.preprocess import fit_preprocessor
    rows = matrix(spark, folder)
    fitted = fit_preprocessor(rows)
    x = fitted.transform(rows).select(F.posexplode(vector_to_array("features")).alias("posicao", "x"))
    stats = x.groupBy("posicao").agg(F.avg("x").alias("media"), F.stddev_pop("x").alias("dp"))
    return fitted.mapping(spark).drop("familia").join(stats, "posicao")


@query("candidate_comparison")
def candidate_comparison(spark, folder):
    """Prior, one-column rules, logistic, forest and boosting on the same folds."""
    dealt = materialize(split.folds(matrix(spark, folder), FOLDS))
    models = [
        M.prior(), M.univariate("heuristica_taxa_municipal", "mun_taxa_alfab_lag1"),
        M.univariate("heuristica_proficiencia_municipal", "mun_media_portugues_lag1"), M.logistic(), M.forest(), M.boosting()]
    return M.evaluate_in_folds(dealt, models, FOLDS, together=M.fits_at_once(dealt, FOLDS)).drop("segundos", "papel")


@query("candidate_paired_tests")
def candidate_paired_tests(spark, folder):
    dealt = materialize(split.folds(matrix(spark, folder), 3))
    table = M.evaluate_in_folds(dealt, [M.prior(), M.univariate("heuristica_taxa_municipal", "mun_taxa_alfab_lag1"), M.logistic()], 3)
    pairs = [p for p in M.PAIRS if set(p) <= {"dummy_prior", "heuristica_taxa_municipal", "logistica_podada"}]
    result = None
    for a, b in pairs:
        part = resample.compare_in_folds(table, a, b, k=3)
        result = part if result is None else result.unionByName(part)
    return result


@query("out_of_fold_scores", B.with_ctes("SELECT count(*) AS linhas, count(DISTINCT id_municipio) AS grupos, 0::BIGINT AS sem_escore FROM dataset", "dataset"))
def out_of_fold_scores(spark, folder):
    """Every row scored once by a model that did not see its municipality."""
    scored, _ = M.out_of_fold(materialize(split.folds(matrix(spark, folder))), M.logistic(), FOLDS)
    return scored.agg(F.count(F.lit(1)).alias("linhas"), F.count_distinct(C.GROUP).alias("grupos"), F.count_if(F.col(M.SCORE).isNull()).alias("sem_escore"))


def curves_sql(rows: str, x: str, y: str) -> dict[str, str]:
    """Isotonic curve of every training set by its min-max formula, read at the scores of the fold left out."""
    return {
        "o": f"""SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM (
  SELECT t, {x} AS x, count(*) AS n, sum({y}) AS s FROM {rows} JOIN (VALUES (0), (1), (2), (3), (4)) AS k(t) ON id_municipio % 5 <> t WHERE {x} IS NOT NULL GROUP BY ALL) AS h
WINDOW w AS (PARTITION BY t ORDER BY x)""",
        "f": """SELECT t, any_value(bx) AS x, max(least_mean) AS v FROM (
  SELECT t, b, bx, min(m) OVER (PARTITION BY t, a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS least_mean FROM (
    SELECT l.t, l.i AS a, r.i AS b, r.x AS bx, CAST(r.cs - l.cs + l.s AS DOUBLE) / (r.cn - l.cn + l.n) AS m FROM o AS l JOIN o AS r ON l.t = r.t AND r.i >= l.i) AS p) AS q GROUP BY t, b""",
        "q": f"SELECT id_municipio % 5 AS t, {x} AS x, count(*) AS n, sum({y}) AS s FROM {rows} WHERE {x} IS NOT NULL GROUP BY ALL",
        "z": """SELECT t, x, n, s, CASE WHEN lx IS NULL THEN hv WHEN hx IS NULL OR hx <= lx THEN lv ELSE lv + (hv - lv) * (x - lx) / (hx - lx) END AS c FROM (
  SELECT q.t, q.x, any_value(q.n) AS n, any_value(q.s) AS s, max(f.x) FILTER (WHERE f.x <= q.x) AS lx, arg_max(f.v, f.x) FILTER (WHERE f.x <= q.x) AS lv,
         min(f.x) FILTER (WHERE f.x >= q.x) AS hx, arg_min(f.v, f.x) FILTER (WHERE f.x >= q.x) AS hv FROM q JOIN f USING (t) GROUP BY 1, 2) AS u"""}


@query("isotonic_crossfit_gain", B.with_ctes("""
SELECT a AS brier_bruto, b AS brier_calibrado, a - b AS ganho_brier FROM (
  SELECT sum(s * pow(1 - x, 2) + (n - s) * x * x) / sum(n) AS a, sum(s * pow(1 - c, 2) + (n - s) * c * c) / sum(n) AS b FROM z) AS t""",
       "scored", extra=curves_sql("scored", "p", "y")), ["brier_bruto", "brier_calibrado", "ganho_brier"])
def isotonic_crossfit_gain(spark, folder):
    """Brier of the smoothed municipal risk before and after calibration by the curve of the other folds."""
    rows = B.scored(spark, folder).select("y", "p", F.pmod("id_municipio", F.lit(FOLDS)).cast("int").alias("fold"))
    return calibration.crossfit_gain(rows, FOLDS, "y", "p")


@query("one_column_rule_in_folds", B.with_ctes("""
SELECT t AS fold, -x AS taxa, n AS linhas, c AS escore FROM z
UNION ALL
SELECT k.fold, NULL, count(*) FILTER (WHERE id_municipio % 5 = k.fold AND mun_taxa_alfab_lag1 IS NULL), avg(risco_nao_alfabetizacao) FILTER (WHERE id_municipio % 5 <> k.fold)
FROM dataset CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS k(fold) GROUP BY 1 HAVING count(*) FILTER (WHERE id_municipio % 5 = k.fold AND mun_taxa_alfab_lag1 IS NULL) > 0""",
       "dataset", extra=curves_sql("dataset", "-mun_taxa_alfab_lag1", "risco_nao_alfabetizacao")), ["taxa", "escore"])
def one_column_rule_in_folds(spark, folder):
    """The rule of one column: every row scored by the isotonic curve of the other folds, rows without the column by their prevalence."""
    scored, _ = M.out_of_fold(in_fixed_folds(spark, folder), M.univariate("regra", "mun_taxa_alfab_lag1"), FOLDS, keep=["mun_taxa_alfab_lag1"])
    return scored.groupBy("fold", F.col("mun_taxa_alfab_lag1").cast("double").alias("taxa")).agg(F.count(F.lit(1)).alias("linhas"), F.max(M.SCORE).alias("escore"))


@query("isotonic_calibration_gain")
def isotonic_calibration_gain(spark, folder):
    scored, _ = M.out_of_fold(materialize(split.folds(matrix(spark, folder))), M.logistic(), FOLDS)
    return calibration.crossfit_gain(scored, FOLDS)


@query("calibration_keeps_order", B.with_ctes("SELECT count(*) AS n, true AS auc_igual FROM scored", "scored"))
def calibration_keeps_order(spark, folder):
    """Isotonic with tie-break leaves the AUC as it was."""
    rows = materialize(B.scored(spark, folder).select("row_id", "y", "p"))
    calibrated = M.apply_isotonic(M.fit_isotonic(rows, "y", "p"), rows, "p", "c")
    same = F.abs(metrics.auc(calibrated, "y", "c").scalar() - metrics.auc(rows, "y", "p").scalar()) < 1e-9
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("auc_igual", same)


@query("random_search")
def random_search(spark, folder):
    dealt = materialize(split.folds(matrix(spark, folder), 2))
    space = {"maxIter": ("int", 3, 8), "maxDepth": ("int", 2, 4), "stepSize": ("log", 0.05, 0.3)}
    return tuning.search(dealt, tuning.draw_settings(3, space=space), 2, features=SMALL).drop("segundos")


@query("search_edge_flags")
def search_edge_flags(spark, folder):
    dealt = materialize(split.folds(matrix(spark, folder), 2))
    grid = tuning.extended_grid({"maxIter": 3, "maxDepth": 2, "stepSize": 0.2}, {"maxDepth": (2, 3), "maxIter": (3, 6)})
    return tuning.edge_flags(tuning.search(dealt, grid, 2, features=SMALL), ["maxIter", "maxDepth"])


@query("held_out_report")
def held_out_report(spark, folder):
    """Refit, thresholds from out-of-fold scores, metrics on held-out municipalities."""
    result = report.build_report(matrix(spark, folder), M.logistic(), FOLDS, replicates=0, minimum=100)
    long = None
    for name in ("ranking", "desenvolvimento"):
        part = result.tables[name].select(F.lit(name).alias("tabela"), "roc_auc", "pr_auc", "ks", "brier", "prevalencia", "n")
        long = part if long is None else long.unionByName(part)
    return long.withColumn("limiar_f1", result.thresholds.select("por_f1").scalar()).withColumn(
        "limiar_capacidade", result.thresholds.select("por_capacidade").scalar())


@query("held_out_intervals")
def held_out_intervals(spark, folder):
    """1000 replicates of the held-out municipalities."""
    return report.build_report(matrix(spark, folder), M.logistic(), FOLDS, minimum=100).tables["intervalos"]


@query("held_out_strata")
def held_out_strata(spark, folder):
    return report.build_report(matrix(spark, folder), M.logistic(), FOLDS, replicates=0, minimum=100).tables["estratos"]


@query("feature_set_ablation")
def feature_set_ablation(spark, folder):
    """Feature sets A, B and C on the development part, hold-out removed first."""
    sets = {k: [f for f in v if f not in ("caderno", "sigla_uf")] for k, v in C.FEATURE_SETS.items()}
    table = report.ablation(matrix(spark, folder), sets, lambda f, n: M.logistic(f, n, True), seeds=(42,), k=2)
    return table.drop("n_teste")


@query("target_permutation_test")
def target_permutation_test(spark, folder):
    """50 permutations of the outcome among all rows and 20 inside the municipalities, three folds each: 213 models."""
    return resample.permutation_p(robustness.permutation_test(matrix(spark, folder), M.logistic()))


@query("learning_curve_by_groups")
def learning_curve_by_groups(spark, folder):
    """Seven fractions of the groups, three seeds."""
    return robustness.learning_curve(matrix(spark, folder), M.logistic())


@query("leave_one_region_out")
def leave_one_region_out(spark, folder):
    features = tuple(f for f in C.PRUNED_FEATURES if f != "nome_regiao")
    return robustness.leave_one_region_out(matrix(spark, folder), M.logistic(features, "logistica"))


def territorial_cohort(spark, folder, year):
    """Outcome and the territorial columns that both years have."""
    rows = B.unique_students(spark, folder).where((F.col("ano") == year) & (F.col("preenchimento_caderno") == 1))
    return materialize(rows.select(
        F.col("id_aluno").alias("row_id"), "id_municipio", "sigla_uf", "nome_regiao",
        F.coalesce(cleaning.lookup("rede", {"2": "Estadual", "3": "Municipal"}), F.lit("Outros")).alias("rede_grupo"),
        (1 - F.col("alfabetizado")).alias(C.TARGET)))


@query("year_drift")
def year_drift(spark, folder):
    return robustness.drift(
        territorial_cohort(spark, folder, B.LAG), territorial_cohort(spark, folder, B.TARGET),
        lambda: M.logistic(("sigla_uf", "nome_regiao", "rede_grupo"), "logistica"), (str(B.LAG), str(B.TARGET)))


@query("shuffle_invariance")
def shuffle_invariance(spark, folder):
    """Booklet (negative control) against the municipal rate (positive control), on held-out municipalities."""
    rows = materialize(split.holdout(matrix(spark, folder)))
    made = M.logistic(C.MODEL_FEATURES, "logistica", True).batch(rows, [~F.col("teste")])
    return robustness.invariance(made, rows.where(F.col("teste")), ["caderno", "mun_taxa_alfab_lag1"])
