"""Cohort profiling over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import contracts as C
from cohortspark.operators import profile
from cohortspark.queries import bindings as B
from cohortspark.queries.evaluation import draws, md5_order
from cohortspark.queries.joins import TWO, rates
from cohortspark.queries.quality import AUC_OF
from cohortspark.queries.registry import query


def wilson_sql(k: str, n: str) -> str:
    d = f"(1 + 3.8416::DOUBLE / {n})"
    c = f"(({k} / {n} + 3.8416::DOUBLE / (2 * {n})) / {d})"
    h = f"(1.96::DOUBLE * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8416::DOUBLE / (4 * {n} * {n})) / {d})"
    return f"{c} - {h} AS ic_low, {c} + {h} AS ic_high"


K, N = "CAST(k AS DOUBLE)", "CAST(n AS DOUBLE)"
PROFILED = ("ano", "id_escola", "rede", "presenca", "alfabetizado", "proficiencia", "peso_aluno", "sigla_uf")


def measured(spark, folder):
    return B.students(spark, folder).where(F.col("preenchimento_caderno") == 1)


def present(spark, folder, year):
    return B.students(spark, folder).where((F.col("ano") == year) & (F.col("presenca") == 1))


@query("column_profile", B.with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS coluna, '{t}' AS tipo, count(DISTINCT {c}) AS n_unicos, 1 - count({c}) / CAST(count(*) AS DOUBLE) AS pct_nulo FROM students"
    for c, t in zip(PROFILED, ("int", "bigint", "string", "int", "int", "double", "double", "string"))), "students"), ["pct_nulo"])
def column_profile(spark, folder):
    return profile.column_profile(B.students(spark, folder).select(*PROFILED)).drop("exemplo")


@query("prevalence_by_year", B.with_ctes(f"""
SELECT ano, n AS n_alunos, k AS n_alfabetizados, {K} / n AS taxa_alfabetizado, 1 - {K} / n AS taxa_risco, {wilson_sql(K, N)}
FROM (SELECT ano, count(*) AS n, sum(alfabetizado)::BIGINT AS k FROM students WHERE preenchimento_caderno = 1 GROUP BY 1) AS t""", "students"),
    ["taxa_alfabetizado", "taxa_risco", "ic_low", "ic_high"])
def prevalence_by_year(spark, folder):
    return profile.prevalence_by_year(measured(spark, folder))


CATEGORY = f"""SELECT {{c}}, n, k, {K} / n AS taxa, {wilson_sql(K, N)} FROM (
  SELECT {{c}}, count(*) AS n, sum(alfabetizado)::BIGINT AS k FROM students WHERE preenchimento_caderno = 1 GROUP BY 1) AS t"""


@query("rate_by_state", B.with_ctes(f"SELECT *, ic_high - ic_low AS amplitude_ic FROM ({CATEGORY.format(c='sigla_uf')}) AS x", "students"),
       ["taxa", "ic_low", "ic_high", "amplitude_ic"])
def rate_by_state(spark, folder):
    return profile.rate_by_category(measured(spark, folder), "sigla_uf")


@query("interval_overlap_of_booklets", B.with_ctes(f"""
SELECT count(*) AS n_niveis, min(taxa) AS taxa_min, max(taxa) AS taxa_max, (max(taxa) - min(taxa)) * 100 AS amplitude_taxas_pp, max(ic_low) AS maior_ic_low,
  min(ic_high) AS menor_ic_high, max(ic_low) <= min(ic_high) AS todos_ics_se_sobrepoem FROM ({CATEGORY.format(c='caderno')}) AS x""", "students"),
    ["taxa_min", "taxa_max", "amplitude_taxas_pp", "maior_ic_low", "menor_ic_high"])
def interval_overlap_of_booklets(spark, folder):
    return profile.interval_overlap(profile.rate_by_category(measured(spark, folder), "caderno"))


@query("nulls_by_year", B.with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS coluna, " + ", ".join(f"count(*) FILTER (WHERE ano = {y} AND {c} IS NULL) / CAST(count(*) FILTER (WHERE ano = {y}) AS DOUBLE) AS pct_{y}" for y in (B.LAG, B.TARGET))
    + " FROM published_mun" for c in ("taxa_alfabetizacao", "media_portugues", "rede")), "published_mun"), [f"pct_{B.LAG}", f"pct_{B.TARGET}"])
def nulls_by_year(spark, folder):
    return profile.nulls_by_period(B.published_municipal(spark, folder), "ano", [B.LAG, B.TARGET], ["taxa_alfabetizacao", "media_portugues", "rede"])


@query("unit_size_profile", B.with_ctes("SELECT 'id_municipio' AS chave, count(*) AS n_unidades, avg(n) AS media, " + ", ".join(
    f"quantile_cont(n::DOUBLE, {p / 100}) AS p{p}" for p in profile.SIZE_PERCENTILES) + """, 100 * sqrt(0.25::DOUBLE / quantile_cont(n::DOUBLE, 0.5)) AS erro_padrao_da_taxa_na_mediana_pp
FROM (SELECT id_municipio, count(*) AS n FROM students WHERE presenca = 1 GROUP BY 1) AS t""", "students"),
    ["media", "erro_padrao_da_taxa_na_mediana_pp", *[f"p{p}" for p in profile.SIZE_PERCENTILES]])
def unit_size_profile(spark, folder):
    return profile.size_profile(B.students(spark, folder).where(F.col("presenca") == 1), "id_municipio")


@query("rate_by_unit", B.with_ctes("SELECT * FROM lag", "students", extra={"lag": TWO["lag"]}), ["taxa"])
def rate_by_unit(spark, folder):
    return rates(spark, folder, B.LAG)


def _avg_rank(c: str) -> str:
    return f"rank() OVER (PARTITION BY m ORDER BY {c}) + (count(*) OVER (PARTITION BY m, {c}) - 1) / 2.0"


@query("rate_persistence", B.with_ctes(f"""
SELECT m AS porte_minimo, count(*) AS n_unidades, corr(x, y) AS corr_pearson, corr(rx, ry) AS corr_spearman FROM (
  SELECT m, x, y, {_avg_rank('x')} AS rx, {_avg_rank('y')} AS ry FROM (
    SELECT l.taxa AS x, a.taxa AS y, m FROM lag AS l JOIN atual AS a USING (id_municipio) CROSS JOIN (VALUES (0), (2), (4)) AS t(m)
    WHERE l.n >= m AND a.n >= m) AS j) AS r GROUP BY 1 HAVING count(*) >= 30""", "students", extra=TWO), ["corr_pearson", "corr_spearman"])
def rate_persistence(spark, folder):
    return profile.persistence_point(rates(spark, folder, B.LAG), rates(spark, folder, B.TARGET), "id_municipio", (0, 2, 4))


PERSISTENCE = {
    **TWO,
    "j": f"""SELECT m, id_municipio, x, y, rank_x, rank_y, row_number() OVER (PARTITION BY m ORDER BY {md5_order("'42:0:' || id_municipio")}, id_municipio) AS idx, count(*) OVER (PARTITION BY m) AS size FROM (
  SELECT m, id_municipio, x, y, {_avg_rank('x')} AS rank_x, {_avg_rank('y')} AS rank_y FROM (
    SELECT id_municipio, l.taxa AS x, a.taxa AS y, m FROM lag AS l JOIN atual AS a USING (id_municipio) CROSS JOIN (VALUES (0), (2), (4)) AS t(m) WHERE l.n >= m AND a.n >= m) AS k) AS r""",
    "w": draws("(SELECT DISTINCT m, size FROM j) AS z", "m"),
    "c": """SELECT m, rep, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS r FROM (
  SELECT m, rep, CAST(sum(w) AS DOUBLE) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * y) AS sxy, sum(w * x * x) AS sxx, sum(w * y * y) AS syy
  FROM (SELECT m, idx, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM j) AS q JOIN w USING (m, idx) GROUP BY 1, 2) AS s""",
}


@query("rate_persistence_intervals", B.with_ctes("""
SELECT porte_minimo, corr_pearson, n_unidades, ic_low, ic_high, corr_spearman
FROM (SELECT m AS porte_minimo, corr(x, y) AS corr_pearson, count(*) AS n_unidades, corr(rank_x, rank_y) AS corr_spearman FROM j GROUP BY 1 HAVING count(*) >= 30) AS a
JOIN (SELECT m AS porte_minimo, quantile_cont(r, 0.025) AS ic_low, quantile_cont(r, 0.975) AS ic_high FROM c GROUP BY 1) AS b USING (porte_minimo)""",
       "students", extra=PERSISTENCE), ["corr_pearson", "ic_low", "ic_high", "corr_spearman"])
def rate_persistence_intervals(spark, folder):
    """The same correlations with a bootstrap interval over municipalities."""
    return profile.persistence(rates(spark, folder, B.LAG), rates(spark, folder, B.TARGET), "id_municipio", (0, 2, 4))


NUMERIC = ("mun_taxa_presenca_lag1", "mun_n_alunos_lag1", "mun_n_escolas_lag1", "uf_taxa_alfab_lag1", "esc_taxa_alfab_lag1")


@query("correlation_of_features", B.with_ctes(" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS correlacao FROM dataset" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]), "dataset"), ["correlacao"])
def correlation_of_features(spark, folder):
    return profile.correlation_pairs(B.dataset(spark, folder), NUMERIC)


@query("redundant_feature_pairs", B.with_ctes("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS correlacao FROM dataset" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:])
    + ") AS x WHERE abs(correlacao) >= 0.5", "dataset"), ["correlacao"])
def redundant_feature_pairs(spark, folder):
    return profile.redundant_pairs(B.dataset(spark, folder), NUMERIC, 0.5)


@query("variance_inflation_pair", B.with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, 1 / (1 - pow(corr(mun_n_alunos_lag1, mun_n_escolas_lag1), 2)) AS vif FROM dataset" for c in ("mun_n_alunos_lag1", "mun_n_escolas_lag1")), "dataset"), ["vif"])
def variance_inflation_pair(spark, folder):
    """Two columns, where the inflation has a closed form."""
    return profile.variance_inflation(B.dataset(spark, folder), ["mun_n_alunos_lag1", "mun_n_escolas_lag1"])


@query("variance_inflation")
def variance_inflation(spark, folder):
    return profile.variance_inflation(B.dataset(spark, folder), NUMERIC)


@query("goal_gap", B.with_ctes(f"""
SELECT id_municipio, g.meta_alfabetizacao_{B.TARGET} AS meta, a.taxa * 100 AS taxa_pct, a.taxa * 100 - g.meta_alfabetizacao_{B.TARGET} AS gap_pp,
  a.taxa * 100 - g.meta_alfabetizacao_{B.TARGET} >= 0 AS atingiu_meta FROM (SELECT * FROM goals_mun WHERE ano = {B.TARGET}) AS g JOIN atual AS a USING (id_municipio)""",
    "students", "goals_mun", extra={"atual": TWO["atual"]}), ["meta", "taxa_pct", "gap_pp"])
def goal_gap(spark, folder):
    goals = B.goals_municipal(spark, folder).where(F.col("ano") == B.TARGET).select("id_municipio", F.col(f"meta_alfabetizacao_{B.TARGET}").alias("meta"))
    observed = rates(spark, folder, B.TARGET).select("id_municipio", (F.col("taxa") * 100).alias("taxa_pct"))
    return profile.goal_gap(goals, observed, "id_municipio", "meta", "taxa_pct")


@query("goal_determinism", B.with_ctes(" UNION ALL ".join(
    f"SELECT 'meta_alfabetizacao_{y}' AS meta, count(DISTINCT {c}) AS n_valores_distintos, 1 - count({c}) / CAST(count(*) AS DOUBLE) AS pct_nulo, avg({c}) AS media, "
    f"stddev_samp({c}) AS desvio_padrao, CASE WHEN count(DISTINCT {c}) > 1 THEN corr({c}, taxa_alfabetizacao) END AS corr_com_taxa_base FROM goals_mun"
    for y, c in ((y, f"meta_alfabetizacao_{y}") for y in B.GOAL_YEARS)), "goals_mun"), ["pct_nulo", "media", "desvio_padrao", "corr_com_taxa_base"])
def goal_determinism(spark, folder):
    """The last goal is the same for everyone: no correlation is defined."""
    return profile.goal_determinism(B.goals_municipal(spark, folder), [f"meta_alfabetizacao_{y}" for y in B.GOAL_YEARS])


HISTORY = {"now": f"SELECT * FROM students WHERE ano = {B.TARGET} AND presenca = 1",
           "old": f"SELECT DISTINCT id_municipio FROM students WHERE ano = {B.LAG} AND presenca = 1",
           "flagged": "SELECT n.*, o.id_municipio IS NOT NULL AS tem FROM now AS n LEFT JOIN old AS o ON n.id_municipio = o.id_municipio"}


@query("lag_coverage", B.with_ctes("""
SELECT 'id_municipio' AS chave, count(DISTINCT id_municipio) AS unidades_atual, (SELECT count(*) FROM old) AS unidades_lag,
  count(DISTINCT id_municipio) FILTER (WHERE tem) / CAST(count(DISTINCT id_municipio) AS DOUBLE) AS pct_unidades_com_historico,
  avg(CAST(tem AS INTEGER)) AS pct_alunos_com_historico, count(*) FILTER (WHERE NOT tem) AS alunos_sem_historico FROM flagged""", "students", extra=HISTORY),
    ["pct_unidades_com_historico", "pct_alunos_com_historico"])
def lag_coverage(spark, folder):
    return profile.lag_coverage(present(spark, folder, B.TARGET), present(spark, folder, B.LAG), "id_municipio")


@query("history_profile", B.with_ctes(f"""
SELECT grupo, n AS n_alunos, {K} / n AS taxa_alfabetizado, {wilson_sql(K, N)} FROM (
  SELECT CASE WHEN tem THEN 'com histórico' ELSE 'sem histórico' END AS grupo, count(*) AS n, sum(alfabetizado) AS k FROM flagged GROUP BY 1) AS t""", "students", extra=HISTORY),
    ["taxa_alfabetizado", "ic_low", "ic_high"])
def history_profile(spark, folder):
    return profile.history_profile(present(spark, folder, B.TARGET), present(spark, folder, B.LAG), "id_municipio")


@query("lag_coverage_by_state", B.with_ctes("""
SELECT sigla_uf, count(*) AS n_alunos, avg(CAST(tem AS INTEGER)) AS pct_com_historico, count(DISTINCT id_municipio) AS n_unidades FROM flagged GROUP BY 1""", "students", extra=HISTORY),
    ["pct_com_historico"])
def lag_coverage_by_state(spark, folder):
    return profile.lag_coverage_by(present(spark, folder, B.TARGET), present(spark, folder, B.LAG), "id_municipio", "sigla_uf")


@query("variance_between_municipalities", B.with_ctes("""
WITH u AS (SELECT id_municipio, id_escola, count(*) AS n, avg(alfabetizado) AS t FROM students WHERE presenca = 1 GROUP BY 1, 2 HAVING count(*) >= 2),
g AS (SELECT avg(t) AS m FROM u), p AS (SELECT id_municipio, count(*) AS c, avg(t) AS t FROM u GROUP BY 1)
SELECT CAST(2 AS INTEGER) AS porte_minimo, (SELECT count(*) FROM u) AS n_unidades, (SELECT count(*) FROM p) AS n_grupos, e / d AS variancia_entre, 1 - e / d AS variancia_dentro
FROM (SELECT (SELECT sum(c * pow(p.t - g.m, 2)) FROM p, g) AS e, (SELECT sum(pow(u.t - g.m, 2)) FROM u, g) AS d) AS x""".replace("WITH u AS", "SELECT * FROM (WITH u AS", 1) + ") AS z", "students"),
    ["variancia_entre", "variancia_dentro"])
def variance_between_municipalities(spark, folder):
    return profile.variance_between(B.students(spark, folder).where(F.col("presenca") == 1), "id_escola", "id_municipio", minimum=2)


FEATURE_AUC = ("mun_taxa_alfab_lag1", "mun_taxa_presenca_lag1", "mun_n_alunos_lag1", "mun_prof_p50_lag1", "uf_taxa_alfab_lag1", "esc_taxa_alfab_lag1", "caderno")


@query("feature_auc_ranking", B.with_ctes("SELECT *, greatest(auc, 1 - auc) AS auc_orientada FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, (SELECT count({f}) / CAST(count(*) AS DOUBLE) FROM dataset) AS pct_disponivel, ({AUC_OF.format(y='risco_nao_alfabetizacao', s=f, t='dataset')}) AS auc"
    for f in FEATURE_AUC) + ") AS x", "dataset"), ["pct_disponivel", "auc", "auc_orientada"])
def feature_auc_ranking(spark, folder):
    from cohortspark.operators import metrics
    return metrics.auc_by_feature(B.dataset(spark, folder), C.TARGET, FEATURE_AUC)


BANDS = ((0, 30), (30, 50), (50, None))


@query("auc_by_school_size", B.with_ctes(" UNION ALL ".join(
    f"SELECT '{n}' AS faixa_porte, (SELECT count(*) FROM {t}) AS n_alunos, (SELECT count(DISTINCT id_escola) FROM {t}) AS n_escolas, "
    f"({AUC_OF.format(y='risco_nao_alfabetizacao', s='esc_taxa_alfab_lag1', t=t)}) AS auc WHERE (SELECT count(*) FROM {t}) >= 100"
    for n, t in (("0–30", "b0"), ("30–50", "b1"), ("≥ 50", "b2"))), "dataset", "unique_students",
    extra={f"b{i}": f"SELECT d.*, u.id_escola FROM dataset AS d JOIN unique_students AS u ON u.id_aluno = d.row_id AND u.ano = {B.TARGET} WHERE esc_n_alunos_lag1 >= {a} AND {f"esc_n_alunos_lag1 < {b} AND" if b else ""} esc_taxa_alfab_lag1 IS NOT NULL" for i, (a, b) in enumerate(BANDS)}), ["auc"])
def auc_by_school_size(spark, folder):
    schools = B.two_years(spark, folder).where(F.col("ano") == B.TARGET).select(F.col("id_aluno").alias("row_id"), "id_escola")
    return profile.auc_by_size_band(B.dataset(spark, folder).join(schools, "row_id"), "esc_taxa_alfab_lag1", "esc_n_alunos_lag1", C.TARGET, "id_escola", BANDS, least=100)


@query("absence_bias", B.with_ctes(f"""
SELECT quintil_presenca, m AS n_municipios, n AS n_alunos_presentes, k, taxa_presenca_media, {K} / n AS taxa_alfabetizado, {wilson_sql(K, N)} FROM (
  SELECT CASE WHEN r <= q1 THEN 'Q1' WHEN r <= q2 THEN 'Q2' WHEN r <= q3 THEN 'Q3' WHEN r <= q4 THEN 'Q4' ELSE 'Q5' END AS quintil_presenca,
    count(*) AS m, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, avg(r) AS taxa_presenca_media FROM pop CROSS JOIN (
    SELECT quantile_cont(r, 0.2) AS q1, quantile_cont(r, 0.4) AS q2, quantile_cont(r, 0.6) AS q3, quantile_cont(r, 0.8) AS q4 FROM pop) AS e GROUP BY 1) AS t""", "students",
    extra={"pop": """SELECT id_municipio, avg(presenca) AS r, count(*) FILTER (WHERE presenca = 1) AS n, sum(alfabetizado) FILTER (WHERE presenca = 1) AS k
  FROM students GROUP BY 1 HAVING count(*) FILTER (WHERE presenca = 1) >= 20"""}), ["taxa_presenca_media", "taxa_alfabetizado", "ic_low", "ic_high"])
def absence_bias(spark, folder):
    return profile.absence_bias(B.students(spark, folder))


@query("presence_by_state", B.with_ctes("""
SELECT sigla_uf, count(*) AS n_total, count(*) FILTER (WHERE presenca = 1) AS n_presentes, avg(presenca) AS taxa_presenca,
  avg(alfabetizado) FILTER (WHERE presenca = 1) AS taxa_alfabetizado FROM students GROUP BY 1""", "students"), ["taxa_presenca", "taxa_alfabetizado"])
def presence_by_state(spark, folder):
    return profile.presence_by(B.students(spark, folder), "sigla_uf")


@query("lag_level_by_state", B.with_ctes("""
SELECT sigla_uf, count(*) AS uf_n_avaliados_lag1, avg(presenca) AS uf_taxa_presenca_lag1, count(*) FILTER (WHERE presenca = 1) AS uf_n_alunos_lag1,
  avg(alfabetizado) FILTER (WHERE presenca = 1) AS uf_taxa_alfab_lag1, avg(proficiencia) AS uf_prof_media_lag1, stddev_samp(proficiencia) AS uf_prof_sd_lag1,
  quantile_cont(proficiencia, 0.25) AS uf_prof_p25_lag1, quantile_cont(proficiencia, 0.5) AS uf_prof_p50_lag1, quantile_cont(proficiencia, 0.75) AS uf_prof_p75_lag1,
  quantile_cont(proficiencia, 0.75) - quantile_cont(proficiencia, 0.25) AS uf_prof_iqr_lag1 FROM lag_students GROUP BY 1""", "lag_students"),
    ["uf_taxa_presenca_lag1", "uf_taxa_alfab_lag1", "uf_prof_media_lag1", "uf_prof_sd_lag1", "uf_prof_p25_lag1", "uf_prof_p50_lag1", "uf_prof_p75_lag1", "uf_prof_iqr_lag1"])
def lag_level_by_state(spark, folder):
    return profile.lag_level(B.unique_students(spark, folder).where(F.col("ano") == B.LAG), "sigla_uf", "uf")


GRID = (0, 5, 30, 100)


@query("smoothing_grid", B.with_ctes(" UNION ALL ".join(
    f"SELECT {k}.0::DOUBLE AS k, ({AUC_OF.format(y='risco_nao_alfabetizacao', s='s', t=f's{k}')}) AS auc" for k in GRID), "dataset",
    extra={f"s{k}": f"""SELECT risco_nao_alfabetizacao, CAST(round(CAST(CAST((coalesce(esc_taxa_alfab_lag1 * 100, mun_taxa_alfab_lag1) * coalesce(esc_n_alunos_lag1, 0)
  + mun_taxa_alfab_lag1 * {k}) / nullif(coalesce(esc_n_alunos_lag1, 0) + {k}, 0) AS VARCHAR) AS DECIMAL(38, 15)), 12) AS DOUBLE) AS s FROM dataset""" for k in GRID}), ["auc"])
def smoothing_grid(spark, folder):
    rows = B.dataset(spark, folder).withColumn("esc_pct", F.col("esc_taxa_alfab_lag1") * 100)
    return profile.smoothing_grid(rows, C.TARGET, "esc_pct", "esc_n_alunos_lag1", "mun_taxa_alfab_lag1", GRID)


DICT_NUM, DICT_CAT = ("mun_taxa_alfab_lag1", "uf_taxa_alfab_lag1", "esc_taxa_alfab_lag1"), ("rede_grupo", "sigla_uf", "fonte_lag_municipal")
BLOCKS = {**{f: "municipio" for f in C.MUNICIPAL_FEATURES}, **{f: "uf" for f in C.STATE_FEATURES}, **{f: "escola" for f in C.SCHOOL_FEATURES},
          **{f: "cobertura" for f in C.COVERAGE_FEATURES}, **{f: "estrutural" for f in C.STRUCTURAL_FEATURES}}


@query("feature_dictionary", B.with_ctes("SELECT *, abs(auc - 0.5) AS forca FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{BLOCKS[f]}' AS bloco, '{'numérica' if f in DICT_NUM else 'categórica'}' AS tipo, (SELECT count({f}) / CAST(count(*) AS DOUBLE) FROM dataset) AS cobertura, "
    f"(SELECT count(DISTINCT {f}) FROM dataset) AS n_unicos, " + (f"({AUC_OF.format(y='risco_nao_alfabetizacao', s=f, t='dataset')})" if f in DICT_NUM else "NULL") + " AS auc"
    for f in (*DICT_NUM, *DICT_CAT)) + ") AS x", "dataset"), ["cobertura", "auc", "forca"])
def feature_dictionary(spark, folder):
    return profile.feature_dictionary(B.dataset(spark, folder), C.TARGET, DICT_NUM, DICT_CAT, BLOCKS)


@query("shuffle_control")
def shuffle_control(spark, folder):
    """School feature against its shuffles inside the state and overall; the municipal feature as ceiling."""
    return profile.shuffle_control(B.dataset(spark, folder), C.TARGET, "esc_taxa_alfab_lag1", "mun_taxa_alfab_lag1", "sigla_uf", ["row_id"], (42, 43))


@query("category_rate_auc", B.with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS coluna, ({AUC_OF.format(y='alfabetizado', s='s', t=f'c{i}')}) AS auc" for i, c in enumerate(("sigla_uf", "nome_regiao"))), "students",
    extra={f"c{i}": f"SELECT alfabetizado, avg(alfabetizado) OVER (PARTITION BY {c}) AS s FROM students WHERE preenchimento_caderno = 1" for i, c in enumerate(("sigla_uf", "nome_regiao"))}), ["auc"])
def category_rate_auc(spark, folder):
    return profile.category_rate_auc(measured(spark, folder), "alfabetizado", ["sigla_uf", "nome_regiao"])


@query("yearly_change", B.with_ctes("""
SELECT faixa, count(*) AS n, avg(d) AS media, stddev_samp(d) AS dp, min(d) AS minimo, max(d) AS maximo, quantile_cont(d, 0.25) AS p25, quantile_cont(d, 0.5) AS p50,
  quantile_cont(d, 0.75) AS p75, avg(CAST(d < 0 AS INTEGER)) AS share_que_piorou FROM (
  SELECT 'todos' AS faixa, (a.taxa - l.taxa) * 100 AS d FROM lag AS l JOIN atual AS a USING (id_municipio) UNION ALL
  SELECT '< 50', (a.taxa - l.taxa) * 100 FROM lag AS l JOIN atual AS a USING (id_municipio) WHERE a.n < 50 AND l.n < 50) AS x GROUP BY 1""", "students", extra=TWO),
    ["media", "dp", "minimo", "maximo", "p25", "p50", "p75", "share_que_piorou"])
def yearly_change(spark, folder):
    return profile.yearly_change(rates(spark, folder, B.LAG), rates(spark, folder, B.TARGET), "id_municipio")


PATTERN = ("mun_taxa_presenca_lag1", "mun_prof_p50_lag1", "mun_meta_2024_lag1", "esc_taxa_alfab_lag1")


@query("missingness_patterns", B.with_ctes("SELECT " + ", ".join(f"{c} IS NULL AS falta_{c}" for c in PATTERN) + ", count(*) AS n FROM dataset GROUP BY ALL", "dataset"))
def missingness_patterns(spark, folder):
    return profile.missingness_patterns(B.dataset(spark, folder), PATTERN)


@query("score_histogram_by_class", B.with_ctes("""
SELECT alfabetizado, CAST(least(floor((proficiencia - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, count(*) AS n FROM students CROSS JOIN (
  SELECT min(proficiencia) AS lo, max(proficiencia) AS hi FROM students) AS s WHERE proficiencia IS NOT NULL GROUP BY 1, 2""", "students"))
def score_histogram_by_class(spark, folder):
    return profile.class_histogram(B.students(spark, folder), "proficiencia", "alfabetizado", 40)


@query("size_histogram_log10", B.with_ctes("""
SELECT 0 AS classe, CAST(least(floor((v - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM t CROSS JOIN (SELECT min(v) AS lo, max(v) AS hi FROM t) AS s GROUP BY 1, 2""",
    "students", extra={"t": "SELECT id_municipio, log10(count(*)) AS v FROM students WHERE presenca = 1 GROUP BY 1"}))
def size_histogram_log10(spark, folder):
    sizes = B.students(spark, folder).where(F.col("presenca") == 1).groupBy("id_municipio").agg(F.log10(F.count(F.lit(1))).alias("v"))
    return profile.class_histogram(sizes.withColumn("classe", F.lit(0)), "v", "classe", 20)
