"""Ranking, threshold, calibration and resampling metrics of a lag-only score."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import metrics, resample
from cohortspark.queries import bindings as B
from cohortspark.queries.quality import AUC_OF
from cohortspark.queries.registry import query, sql_round

AP = "(SELECT sum(n_pos / CAST(pos AS DOUBLE) * tp / CAST(tp + fp AS DOUBLE)) FROM hist)"
KS = "(SELECT greatest(0.0, max(tp / CAST(pos AS DOUBLE) - fp / CAST(neg AS DOUBLE))) FROM hist)"
ALL = f"""SELECT ({AUC_OF.format(y='y', s='p', t='scored')}) AS roc_auc, {AP} AS pr_auc, {KS} AS ks, avg(pow(p - y, 2)) AS brier, avg(y) AS prevalencia, count(*) AS n FROM scored"""
METRICS = ["roc_auc", "pr_auc", "ks", "brier", "prevalencia"]


@query("ranking_metrics", B.with_ctes(ALL, "hist"), METRICS)
def ranking_metrics(spark, folder):
    return metrics.ranking_metrics(B.scored(spark, folder), "y", "p")


@query("ks_statistic", B.with_ctes(f"SELECT {KS} AS ks", "hist"), ["ks"])
def ks_statistic(spark, folder):
    return metrics.ks(B.scored(spark, folder), "y", "p")


@query("roc_auc", B.with_ctes(f"SELECT ({AUC_OF.format(y='y', s='p', t='scored')}) AS auc", "scored"), ["auc"])
def roc_auc(spark, folder):
    return metrics.auc(B.scored(spark, folder), "y", "p")


@query("threshold_metrics", B.with_ctes("""
SELECT 0.5::DOUBLE AS limiar, vp / CAST(vp + fn AS DOUBLE) AS recall, vp / CAST(vp + fp AS DOUBLE) AS precisao, 2.0 * vp / CAST(2 * vp + fp + fn AS DOUBLE) AS f1,
  vn / CAST(vn + fp AS DOUBLE) AS especificidade, (vp + fp) / CAST(vp + fp + fn + vn AS DOUBLE) AS taxa_de_alerta, vp, fp, fn, vn FROM (
  SELECT count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS vp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn,
    count(*) FILTER (WHERE p < 0.5 AND y = 0) AS vn FROM scored) AS c""", "scored"), ["limiar", "recall", "precisao", "f1", "especificidade", "taxa_de_alerta"])
def threshold_metrics(spark, folder):
    return metrics.threshold_metrics(B.scored(spark, folder), "y", "p", 0.5)


@query("best_f1_threshold", B.with_ctes("""
SELECT p AS limiar FROM hist ORDER BY round(2.0 * tp / CAST(tp + fp + pos AS DOUBLE), 12) DESC, p LIMIT 1""", "hist"), ["limiar"])
def best_f1_threshold(spark, folder):
    return metrics.best_f1_threshold(B.scored(spark, folder), "y", "p")


@query("capacity_curve", B.with_ctes("""
SELECT f AS fracao_atendida, c AS n_atendidos, k / CAST(t AS DOUBLE) AS recall, k / CAST(c AS DOUBLE) AS precisao, (k / CAST(c AS DOUBLE)) / (t / CAST(n AS DOUBLE)) AS lift FROM (
  SELECT f, max(c) AS c, sum(CASE WHEN rn <= c THEN y ELSE 0 END) AS k, sum(y) AS t, count(*) AS n FROM (
    SELECT y, row_number() OVER (PARTITION BY f ORDER BY p DESC, row_id) AS rn, f,
      greatest(CAST(round_even(round(f * count(*) OVER (PARTITION BY f), 9), 0) AS BIGINT), 1) AS c FROM scored CROSS JOIN (
      SELECT unnest([0.05::DOUBLE, 0.1, 0.2, 0.3, 0.4, 0.5]) AS f) AS g) AS x GROUP BY 1) AS z""", "scored"), ["fracao_atendida", "recall", "precisao", "lift"])
def capacity_curve(spark, folder):
    return metrics.capacity_curve(B.scored(spark, folder), "y", "p", "row_id")


def _binned(bins: int, order: str) -> str:
    return (f"SELECT y, p, CAST(greatest(1, ceil(round((rn - 1) * {bins}.0::DOUBLE / (total - 1), 9))) AS INTEGER) AS b FROM ("
            f"SELECT *, row_number() OVER (ORDER BY p {order}, row_id) AS rn, count(*) OVER () AS total FROM scored) AS x")


@query("lift_by_decile", B.with_ctes("SELECT b AS decil, count(*) AS n, avg(y) AS taxa, avg(y) / (SELECT avg(y) FROM scored) AS lift FROM binned GROUP BY 1", "scored",
       extra={"binned": _binned(10, "DESC")}), ["taxa", "lift"])
def lift_by_decile(spark, folder):
    return metrics.lift_by_decile(B.scored(spark, folder), "y", "p", "row_id")


@query("calibration_curve", B.with_ctes("SELECT b - 1 AS bin, count(*) AS n, avg(p) AS predito, avg(y) AS observado FROM binned GROUP BY 1", "scored",
       extra={"binned": _binned(20, "")}), ["predito", "observado"])
def calibration_curve(spark, folder):
    return metrics.calibration_curve(B.scored(spark, folder), "y", "p", "row_id")


STRATA = ("nome_regiao", "rede", "sigla_uf")


@query("stratified_metrics", B.with_ctes("""
WITH h AS (SELECT d, e, p, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM strata GROUP BY 1, 2, 3),
c AS (SELECT *, sum(n_pos) OVER w AS tp, sum(n_neg) OVER w AS fp, CAST(sum(n_pos) OVER (PARTITION BY d, e) AS DOUBLE) AS pos, CAST(sum(n_neg) OVER (PARTITION BY d, e) AS DOUBLE) AS neg
  FROM h WINDOW w AS (PARTITION BY d, e ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT d AS dimensao, e AS estrato, CAST(max(pos + neg) AS BIGINT) AS n, max(pos / (pos + neg)) AS prevalencia,
  CASE WHEN max(pos + neg) >= 500 THEN sum(n_pos * (neg - fp + n_neg / 2.0) / (pos * neg)) END AS roc_auc,
  CASE WHEN max(pos + neg) >= 500 THEN sum(n_pos / pos * tp / CAST(tp + fp AS DOUBLE)) END AS pr_auc,
  CASE WHEN max(pos + neg) >= 500 THEN max(greatest(0.0, tp / pos - fp / neg)) END AS ks,
  CASE WHEN max(pos + neg) >= 500 THEN sum(n_pos * pow(p - 1, 2) + n_neg * p * p) / max(pos + neg) END AS brier FROM c GROUP BY 1, 2""".replace("\nWITH h AS", "SELECT * FROM (WITH h AS", 1) + ") AS z", "scored",
    extra={"strata": " UNION ALL ".join(f"SELECT '{s}' AS d, {s} AS e, y, p FROM scored" for s in STRATA)}), ["prevalencia", "roc_auc", "pr_auc", "ks", "brier"])
def stratified_metrics(spark, folder):
    """Strata below 500 rows stay in the table without metrics."""
    return metrics.stratified_metrics(B.scored(spark, folder), "y", "p", {s: F.col(s) for s in STRATA})


@query("score_to_group", B.with_ctes("""
SELECT id_municipio, count(*) AS n_alunos_avaliados, sum(peso_aluno) AS populacao_estimada, coalesce(var_samp(p), 0.0::DOUBLE) AS variancia_do_escore,
  sum(y * peso_aluno) / sum(peso_aluno) AS taxa_observada_de_risco, sum(p * peso_aluno) / sum(peso_aluno) AS risco_medio_oof FROM scored GROUP BY 1""", "scored"),
    ["populacao_estimada", "variancia_do_escore", "taxa_observada_de_risco", "risco_medio_oof"])
def score_to_group(spark, folder):
    return metrics.aggregate_scores(B.scored(spark, folder), "y", "p", "id_municipio", "peso_aluno")


@query("group_fit_by_size", B.with_ctes("""
SELECT m AS porte_minimo, count(*) AS n_municipios, 1 - sum(pow(o - q, 2)) / (var_pop(o) * count(*)) AS r2, corr(o, q) AS correlacao, avg(q - o) AS vies_medio FROM (
  SELECT count(*) AS n, sum(y * peso_aluno) / sum(peso_aluno) AS o, sum(p * peso_aluno) / sum(peso_aluno) AS q FROM scored GROUP BY id_municipio) AS t
CROSS JOIN (VALUES (0), (3), (6)) AS f(m) WHERE n >= m GROUP BY 1""", "scored"), ["r2", "correlacao", "vies_medio"])
def group_fit_by_size(spark, folder):
    return metrics.group_fit(B.scored(spark, folder), "y", "p", "id_municipio", "peso_aluno", (0, 3, 6))


def md5_order(text: str) -> str:
    return f"substr(md5({text}), 1, 15)"


def draws(sizes: str, level: str = "", replicates: int = 1000) -> str:
    """How often each unit is drawn in each replicate; ``sizes`` has one row (per level) with ``size``."""
    keep = f"{level}, " if level else ""
    return f"""SELECT {keep}rep, idx, count(*) AS w FROM (
  SELECT {keep}rep, CAST('0x' || {md5_order("'42:' || rep || ':' || i")} AS BIGINT) % size + 1 AS idx
  FROM (SELECT {keep}size, unnest(range(size)) AS i FROM {sizes}) AS s CROSS JOIN range({replicates}) AS r(rep)) AS d GROUP BY ALL"""


BOOT = {
    "g": f"SELECT id_municipio, row_number() OVER (ORDER BY {md5_order("'42:0:' || id_municipio")}, id_municipio) AS idx, count(*) OVER () AS size FROM (SELECT DISTINCT id_municipio FROM scored) AS t",
    "w": draws("(SELECT DISTINCT size FROM g) AS z"),
    "sides": f"SELECT id_municipio, y, 'b' AS side, p AS s FROM scored UNION ALL SELECT id_municipio, y, 'a', {sql_round('p', 1)} FROM scored",
    "drawn": """SELECT side, rep, s, sum(w * pos) AS pos, sum(w * neg) AS neg FROM (
  SELECT 'point' AS kind, idx, side, s, sum(y) AS pos, sum(1 - y) AS neg FROM sides JOIN g USING (id_municipio) GROUP BY ALL) AS h
  JOIN (SELECT * FROM w UNION ALL SELECT -1 AS rep, idx, 1 AS w FROM g) AS v USING (idx) GROUP BY ALL""",
    "measured": """SELECT side, rep, sum(pos * (neg_before + neg / 2.0)) / (any_value(all_pos) * any_value(all_neg)) AS roc_auc,
  sum(CASE WHEN pos > 0 THEN pos / all_pos * (all_pos - pos_before) / (all_pos - pos_before + all_neg - neg_before) ELSE 0 END) AS pr_auc,
  sum(pos * (s - 1) * (s - 1) + neg * s * s) / (any_value(all_pos) + any_value(all_neg)) AS brier, any_value(all_pos) / (any_value(all_pos) + any_value(all_neg)) AS prevalencia
FROM (SELECT side, rep, s, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg, CAST(sum(pos) OVER u - pos AS DOUBLE) AS pos_before, CAST(sum(neg) OVER u - neg AS DOUBLE) AS neg_before,
        CAST(sum(pos) OVER t AS DOUBLE) AS all_pos, CAST(sum(neg) OVER t AS DOUBLE) AS all_neg
      FROM drawn WINDOW u AS (PARTITION BY side, rep ORDER BY s), t AS (PARTITION BY side, rep)) AS c GROUP BY 1, 2""",
}


@query("cluster_bootstrap", B.with_ctes("""
SELECT metrica, max(v) FILTER (WHERE rep < 0) AS pontual, quantile_cont(v, 0.025) FILTER (WHERE rep >= 0) AS ic_baixo, quantile_cont(v, 0.975) FILTER (WHERE rep >= 0) AS ic_alto,
       stddev_samp(v) FILTER (WHERE rep >= 0) AS desvio_bootstrap, count(v) FILTER (WHERE rep >= 0) AS n_reamostras
FROM (UNPIVOT (SELECT rep, roc_auc, pr_auc, brier, prevalencia FROM measured WHERE side = 'b') ON roc_auc, pr_auc, brier, prevalencia INTO NAME metrica VALUE v) AS l GROUP BY 1""",
       "scored", extra=BOOT), ["pontual", "ic_baixo", "ic_alto", "desvio_bootstrap"])
def cluster_bootstrap(spark, folder):
    """Intervals of AUC, AP, Brier and prevalence, resampling whole municipalities."""
    return resample.cluster_bootstrap(B.scored(spark, folder), "y", "p", "id_municipio", additive={"prevalencia": F.col("y")})


@query("cluster_bootstrap_point", B.with_ctes(f"SELECT roc_auc, pr_auc, brier FROM ({ALL}) AS a", "hist"), ["roc_auc", "pr_auc", "brier"])
def cluster_bootstrap_point(spark, folder):
    """The point values beside the intervals are the plain metrics."""
    table = resample.cluster_bootstrap(B.scored(spark, folder), "y", "p", "id_municipio", 5)
    return table.agg(*[F.max(F.when(F.col("metrica") == m, F.col("pontual"))).alias(m) for m in ("roc_auc", "pr_auc", "brier")])


@query("paired_bootstrap", B.with_ctes("""
SELECT max(x) FILTER (WHERE rep < 0) AS auc_base, max(z) FILTER (WHERE rep < 0) AS auc_alternativo, max(z - x) FILTER (WHERE rep < 0) AS delta,
       quantile_cont(z - x, 0.025) FILTER (WHERE rep >= 0) AS ic95_baixo, quantile_cont(z - x, 0.975) FILTER (WHERE rep >= 0) AS ic95_alto,
       avg(CASE WHEN z - x <= 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE rep >= 0) AS p_bootstrap, count(*) FILTER (WHERE rep >= 0) AS n_reamostras
FROM (SELECT rep, max(roc_auc) FILTER (WHERE side = 'a') AS x, max(roc_auc) FILTER (WHERE side = 'b') AS z FROM measured GROUP BY 1) AS t""",
       "scored", extra=BOOT), ["auc_base", "auc_alternativo", "delta", "ic95_baixo", "ic95_alto", "p_bootstrap"])
def paired_bootstrap(spark, folder):
    """Difference of AUC between two scores on the same draws."""
    rows = B.scored(spark, folder).withColumn("p2", F.round("p", 1))
    return resample.paired_auc_bootstrap(rows, "y", "p2", "p", "id_municipio")


CV = """SELECT fold, modelo, v AS roc_auc FROM (SELECT caderno AS fold, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) AS b
  FROM scored GROUP BY 1) AS t, LATERAL (VALUES ('base', b), ('alt', a)) AS m(modelo, v)"""


def fold_table(spark, folder):
    """Accuracy per booklet of two rules, shaped like a fold table."""
    rows = B.scored(spark, folder)
    table = rows.groupBy(F.col("caderno").alias("fold")).agg(
        F.avg(F.when((F.col("p") >= 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0)).alias("alt"), F.avg(F.when(F.col("y") == 1, 1.0).otherwise(0.0)).alias("base"))
    return table.select("fold", F.explode(F.create_map(F.lit("base"), F.col("base"), F.lit("alt"), F.col("alt"))).alias("modelo", "roc_auc"))


# 7 folds: 6 degrees of freedom, two-sided p in closed form
P6 = "1 - s * (1 + c / 2 + 3 * c * c / 8)"


@query("corrected_fold_test", B.with_ctes(f"""
SELECT 'roc_auc' AS metrica, 'base' AS base, 'alt' AS alternativo, CAST(n AS INTEGER) AS n_folds, m AS delta_medio, sd AS delta_dp, f AS folds_a_favor,
  m - 2.446911851 * e AS ic95_baixo, m + 2.446911851 * e AS ic95_alto, m / e AS t_nadeau_bengio, {P6} AS p_valor FROM (
  SELECT *, sin(atan(abs(m / e) / sqrt(6))) AS s, pow(cos(atan(abs(m / e) / sqrt(6))), 2) AS c FROM (
    SELECT *, sqrt(sd * sd * (1.0::DOUBLE / n + 0.25)) AS e FROM (
      SELECT count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd, count(*) FILTER (WHERE d > 0) AS f FROM (
        SELECT fold, CAST(max(roc_auc) FILTER (WHERE modelo = 'alt') - max(roc_auc) FILTER (WHERE modelo = 'base') AS DOUBLE) AS d FROM cv GROUP BY 1) AS x) AS y) AS z) AS w""",
    "scored", extra={"cv": CV}), ["delta_medio", "delta_dp", "ic95_baixo", "ic95_alto", "t_nadeau_bengio", "p_valor"])
def corrected_fold_test(spark, folder):
    return resample.compare_in_folds(fold_table(spark, folder), "base", "alt")


@query("fold_summary", B.with_ctes("SELECT modelo, avg(roc_auc) AS roc_auc, stddev_samp(roc_auc) AS roc_auc_dp, min(roc_auc) AS roc_auc_minimo, max(roc_auc) AS roc_auc_maximo FROM cv GROUP BY 1",
       "scored", extra={"cv": CV}), ["roc_auc", "roc_auc_dp", "roc_auc_minimo", "roc_auc_maximo"])
def fold_summary(spark, folder):
    return resample.summarize_folds(fold_table(spark, folder), ["modelo"], {"roc_auc": ("media", "dp", "minimo", "maximo")})


@query("metric_pivot_by_fold", B.with_ctes("SELECT fold, max(roc_auc) FILTER (WHERE modelo = 'base') AS base, max(roc_auc) FILTER (WHERE modelo = 'alt') AS alt FROM cv GROUP BY 1",
       "scored", extra={"cv": CV}), ["base", "alt"])
def metric_pivot_by_fold(spark, folder):
    return fold_table(spark, folder).groupBy("fold").pivot("modelo", ["base", "alt"]).agg(F.max("roc_auc"))
