"""Territorial products: shrinkage, rankings, clusters and goal scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import contracts as C
from cohortspark.models import kmeans
from cohortspark.operators import metrics
from cohortspark.plans import clusters, features, goals, ranking
from cohortspark.queries import bindings as B
from cohortspark.queries.aggregates import POPULATION, population
from cohortspark.queries.modelling import matrix
from cohortspark.queries.registry import query
from cohortspark.session import materialize

NOT_EVALUATED = ("BRAZIL", "CHINA")

UNITS = """SELECT id_municipio, count(*) AS n, sum(peso_aluno) AS w, coalesce(var_samp(p), 0.0::DOUBLE) AS v,
  sum(y * peso_aluno) / sum(peso_aluno) AS o, sum(p * peso_aluno) / sum(peso_aluno) AS s FROM scored GROUP BY 1"""
FIT1 = """SELECT mu, t2, nz / t2 AS k FROM (SELECT max(m) AS mu, (sum(n * pow(s - m, 2)) - sum(v)) / sum(n) AS t2, sum(n * v) / sum(n) AS nz
  FROM units CROSS JOIN (SELECT sum(s * n) / sum(n) AS m FROM units) AS g) AS f"""
FIT2 = """SELECT mu, t2, nz / t2 AS k FROM (SELECT max(m) AS mu, (sum(n * pow(o - s, 2)) - sum(m * (1 - m))) / sum(n) AS t2, sum(n * m * (1 - m)) / sum(n) AS nz
  FROM units CROSS JOIN (SELECT sum(o * n) / sum(n) AS m FROM units) AS g) AS f"""
SHRUNK = """SELECT u.*, (n * s + f1.k * f1.mu) / (n + f1.k) AS rs, (n * o + f2.k * s) / (n + f2.k) AS ra FROM units AS u CROSS JOIN fit1 AS f1 CROSS JOIN fit2 AS f2"""
RANK_CTES = {"units": UNITS, "fit1": FIT1, "fit2": FIT2, "shrunk": SHRUNK, "pop": POPULATION.format(y=B.TARGET)}
NA = "('BRAZIL', 'CHINA')"
RANKED = f"""SELECT id_municipio, nome_municipio, p.sigla_uf, p.nome_regiao, n AS n_alunos_avaliados, w AS populacao_estimada, taxa_presenca AS taxa_presenca_2024,
  s AS risco_medio_oof, rs AS risco_suavizado, rs * w AS criancas_em_risco, taxa_alfab_ponderada AS taxa_alfabetizacao_2024, o AS taxa_observada_de_risco,
  ra AS taxa_observada_ajustada, mun_taxa_alfab_lag1, NOT (p.sigla_uf IN {NA}) AS modelo_avaliado,
  mun_taxa_alfab_lag1 IS NULL OR mun_taxa_alfab_lag1 < 65 AS faixa_shap_taxa_municipal, false AS incerteza_posicao_quantificada
FROM shrunk JOIN pop AS p USING (id_municipio) JOIN (SELECT id_municipio, nome_municipio FROM territory) AS t USING (id_municipio)
LEFT JOIN (SELECT id_municipio, mun_taxa_alfab_lag1 FROM store_municipio) AS m USING (id_municipio)"""


def _bin(position: str) -> str:
    return f"CAST(greatest(1, ceil(round(({position} - 1) * 10.0::DOUBLE / (count(*) OVER (PARTITION BY modelo_avaliado) - 1), 9))) AS INTEGER)"


POSITIONS = f"""SELECT *, CASE WHEN modelo_avaliado THEN pt END AS posicao_por_taxa, CASE WHEN modelo_avaliado THEN {_bin('pt')} END AS decil_por_taxa,
  CASE WHEN modelo_avaliado THEN pv END AS posicao_por_volume, CASE WHEN modelo_avaliado THEN {_bin('pv')} END AS decil_por_volume FROM (
  SELECT *, row_number() OVER (PARTITION BY modelo_avaliado ORDER BY round(risco_suavizado, 12) DESC, id_municipio) AS pt,
    row_number() OVER (PARTITION BY modelo_avaliado ORDER BY round(criancas_em_risco, 12) DESC, id_municipio) AS pv FROM ranking0) AS x"""
RANK_CTES_ALL = {**RANK_CTES, "ranking0": RANKED, "ranking": POSITIONS}
# Scores and their means per unit at twelve decimals, as the ranking reads them: equal units tie and are placed by their id.
UNITS_TIED = UNITS.replace("sum(p * peso_aluno) / sum(peso_aluno)", "round(sum(p * peso_aluno) / sum(peso_aluno), 12)").replace(
    "FROM scored", "FROM (SELECT * REPLACE (round(p, 12) AS p) FROM scored) AS scored")
RANK_FLOATS = ["populacao_estimada", "taxa_presenca_2024", "risco_medio_oof", "risco_suavizado", "criancas_em_risco", "taxa_alfabetizacao_2024",
               "taxa_observada_de_risco", "taxa_observada_ajustada", "mun_taxa_alfab_lag1"]
COLS = ", ".join(C.RANKING_COLUMNS)


def scored_units(spark, folder):
    return materialize(metrics.aggregate_scores(B.scored(spark, folder), "y", "p", "id_municipio", "peso_aluno"))


def context_of(spark, folder, rows):
    lag = features.municipal_rates(rows.where(F.col("ano") == B.LAG), B.published_municipal(spark, folder), B.LAG)
    return ranking.territory_context(B.territory(spark, folder), population(spark, folder, B.TARGET, rows), lag)


def full_ranking(spark, folder):
    rows = B.two_years(spark, folder)
    return ranking.build_ranking(B.scored(spark, folder, rows), context_of(spark, folder, rows), "y", "p", NOT_EVALUATED)[0]


@query("shrinkage_parameters", B.with_ctes("""
SELECT 'escore do modelo' AS quantidade, mu, t2 AS tau2, k FROM fit1 UNION ALL SELECT 'taxa observada', mu, t2, k FROM fit2""", "scored",
    extra={k: v for k, v in RANK_CTES.items() if k in ("units", "fit1", "fit2")}), ["mu", "tau2", "k"])
def shrinkage_parameters(spark, folder):
    fits = ranking.with_shrunken_rates(scored_units(spark, folder))[1]
    parts = [f.select(F.lit(n).alias("quantidade"), "mu", "tau2", "k") for n, f in fits.items()]
    return parts[0].unionByName(parts[1])


@query("shrunken_rates", B.with_ctes("SELECT id_municipio, rs AS risco_suavizado, ra AS taxa_observada_ajustada FROM shrunk", "scored",
       extra={k: v for k, v in RANK_CTES.items() if k != "pop"}), ["risco_suavizado", "taxa_observada_ajustada"])
def shrunken_rates(spark, folder):
    return ranking.with_shrunken_rates(scored_units(spark, folder))[0].select("id_municipio", "risco_suavizado", "taxa_observada_ajustada")


@query("territory_context", B.with_ctes("""
SELECT id_municipio, nome_municipio, p.sigla_uf, p.nome_regiao, taxa_presenca AS taxa_presenca_2024, taxa_alfab_ponderada AS taxa_alfabetizacao_2024, mun_taxa_alfab_lag1
FROM pop AS p JOIN (SELECT id_municipio, nome_municipio FROM territory) AS t USING (id_municipio) LEFT JOIN (SELECT id_municipio, mun_taxa_alfab_lag1 FROM store_municipio) AS m USING (id_municipio)""",
    "unique_students", "store_municipio", extra={"pop": RANK_CTES["pop"]}), ["taxa_presenca_2024", "taxa_alfabetizacao_2024", "mun_taxa_alfab_lag1"])
def territory_context(spark, folder):
    return context_of(spark, folder, B.two_years(spark, folder))


@query("risk_ranking", B.with_ctes(f"SELECT {COLS} FROM ranking", "scored", "store_municipio", extra={**RANK_CTES_ALL, "units": UNITS_TIED}), RANK_FLOATS)
def risk_ranking(spark, folder):
    """Flagship: shrunken weighted risk of every territory, two orders, deciles and caveats."""
    return full_ranking(spark, folder)


@query("published_order_head", B.with_ctes("""
SELECT id_municipio, posicao_por_taxa FROM ranking WHERE posicao_por_taxa <= 100""", "scored", "store_municipio", extra=RANK_CTES_ALL))
def published_order_head(spark, folder):
    """First hundred rows of the publication order (units without a position come last)."""
    return ranking.published_order(full_ranking(spark, folder)).limit(100).select("id_municipio", "posicao_por_taxa")


ORDER_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS ordenacao, * FROM (SELECT * FROM ranking WHERE modelo_avaliado ORDER BY round({c}, 12) DESC, id_municipio LIMIT 50) AS t{i}"
    for i, (n, c) in enumerate(ranking.ORDERINGS))


@query("top_list_concentration", B.with_ctes(f"""
SELECT ordenacao, quantile_cont(n_alunos_avaliados::DOUBLE, 0.5) AS n_alunos_mediano, count(*) FILTER (WHERE n_alunos_avaliados < 50) AS municipios_com_menos_de_50_alunos,
  sum(criancas_em_risco) AS criancas_em_risco, quantile_cont(taxa_presenca_2024, 0.5) AS taxa_presenca_mediana,
  count(*) FILTER (WHERE id_municipio IN (SELECT id_municipio FROM tops WHERE ordenacao = '{ranking.ORDERINGS[2][0]}')) AS municipios_em_comum_com_a_lista_por_taxa,
  sum(criancas_em_risco) / (SELECT sum(criancas_em_risco) FROM ranking WHERE modelo_avaliado) AS share_das_criancas_em_risco
FROM tops GROUP BY 1""", "scored", "store_municipio", extra={**RANK_CTES_ALL, "tops": ORDER_SQL}),
    ["n_alunos_mediano", "criancas_em_risco", "taxa_presenca_mediana", "share_das_criancas_em_risco"])
def top_list_concentration(spark, folder):
    return ranking.concentration(full_ranking(spark, folder))


@query("presence_risk_curve", B.with_ctes("""
SELECT b - 1 AS bin, avg(taxa_presenca_2024) AS presenca, avg(taxa_observada_de_risco) AS observado, avg(risco_suavizado) AS modelo, count(*) AS n FROM (
  SELECT *, CAST(greatest(1, ceil(round((rn - 1) * 20.0::DOUBLE / (total - 1), 9))) AS INTEGER) AS b FROM (
    SELECT *, row_number() OVER (ORDER BY taxa_presenca_2024, id_municipio) AS rn, count(*) OVER () AS total FROM ranking WHERE modelo_avaliado) AS x) AS y GROUP BY 1""",
    "scored", "store_municipio", extra=RANK_CTES_ALL), ["presenca", "observado", "modelo"])
def presence_risk_curve(spark, folder):
    return ranking.presence_curve(full_ranking(spark, folder))


# --- clusters --------------------------------------------------------------------------------------
def cluster_base(spark, folder):
    goals_lag = B.goals_municipal(spark, folder).where(F.col("ano") == B.LAG)
    levels = B.published_municipal(spark, folder).where((F.col("ano") == B.TARGET) & (F.col("rede") == C.PUBLIC_CODE))
    rows = B.two_years(spark, folder)
    return clusters.clustering_base(population(spark, folder, B.TARGET, rows), population(spark, folder, B.LAG, rows), goals_lag, levels, matrix(spark, folder))


CLUSTER_SQL = f"""
SELECT id_municipio, p.sigla_uf, p.nome_regiao, p.n_avaliados, p.taxa_alfab_ponderada AS taxa_alfabetizacao_2024, p.prof_media_ponderada AS media_portugues_2024,
  p.taxa_presenca AS taxa_presenca_2024, {', '.join(B.LEVELS)}, share_rede_estadual, coalesce(q.taxa_alfab_ponderada, g.t / 100) AS taxa_alfabetizacao_2023,
  log10(p.n_avaliados) AS log_porte
FROM pop AS p LEFT JOIN (SELECT id_municipio, taxa_alfab_ponderada FROM pop_lag) AS q USING (id_municipio)
LEFT JOIN (SELECT id_municipio, taxa_alfabetizacao AS t FROM goals_mun WHERE ano = {B.LAG}) AS g USING (id_municipio)
LEFT JOIN (SELECT id_municipio, {', '.join(B.LEVELS)} FROM published_mun WHERE ano = {B.TARGET} AND rede = '5') AS l USING (id_municipio)
LEFT JOIN (SELECT id_municipio, sum(CASE WHEN rede_grupo = 'Estadual' THEN peso_aluno ELSE 0 END) / sum(peso_aluno) AS share_rede_estadual FROM dataset GROUP BY 1) AS s USING (id_municipio)"""


@query("clustering_base", B.with_ctes(CLUSTER_SQL, "dataset", "goals_mun", "published_mun",
       extra={"pop": POPULATION.format(y=B.TARGET), "pop_lag": POPULATION.format(y=B.LAG)}), [*clusters.FEATURES])
def clustering_base(spark, folder):
    return cluster_base(spark, folder)


@query("cluster_count_selection")
def cluster_count_selection(spark, folder):
    vectors = clusters.standardized(cluster_base(spark, folder))
    return clusters.choose_k(vectors, kmeans.fit(vectors, "id_municipio", clusters.K_GRID))


@query("cluster_profiles")
def cluster_profiles(spark, folder):
    return clusters.cluster_territories(cluster_base(spark, folder)).profile


@query("cluster_region_shares")
def cluster_region_shares(spark, folder):
    return clusters.cluster_territories(cluster_base(spark, folder)).regions


# --- goals -----------------------------------------------------------------------------------------
def goal_base(spark, folder):
    rows = B.two_years(spark, folder)
    return goals.goals_base(B.goals_municipal(spark, folder), population(spark, folder, B.TARGET, rows), population(spark, folder, B.LAG, rows), B.TARGET, B.GOAL_YEARS[-1])


GOAL_SQL = f"""
SELECT id_municipio, taxa_2023, taxa_2024, {', '.join(f'meta_{2024 + i}' for i in range(7))}, n_avaliados AS n_alunos_avaliados, taxa_presenca AS taxa_presenca_2024,
  sigla_uf, nome_regiao, n_alunos_2023 FROM (SELECT id_municipio, taxa_alfabetizacao AS taxa_2023 FROM goals_mun WHERE ano = {B.LAG}) AS a
FULL JOIN (SELECT id_municipio, taxa_alfabetizacao AS taxa_2024, {', '.join(f'meta_alfabetizacao_{y} AS meta_{2024 + i}' for i, y in enumerate(B.GOAL_YEARS))}
  FROM goals_mun WHERE ano = {B.TARGET}) AS b USING (id_municipio) JOIN pop USING (id_municipio)
LEFT JOIN (SELECT id_municipio, n_avaliados AS n_alunos_2023 FROM pop_lag) AS c USING (id_municipio)"""
GOAL_CTES = {"pop": POPULATION.format(y=B.TARGET), "pop_lag": POPULATION.format(y=B.LAG), "gb": GOAL_SQL}


@query("goals_base", B.with_ctes("SELECT * FROM gb", "unique_students", "goals_mun", extra=GOAL_CTES),
       ["taxa_2023", "taxa_2024", "taxa_presenca_2024", *[f"meta_{2024 + i}" for i in range(7)]])
def goals_base(spark, folder):
    return goal_base(spark, folder)


def projector(spark, folder):
    base = materialize(goal_base(spark, folder))
    train = base.dropna(subset=["taxa_2023", "taxa_2024", "n_alunos_2023"]).withColumn("fold", F.lit(0))
    return base, goals.fit_projector(train, "taxa_2023", "n_alunos_2023", "taxa_2024")


@query("goal_projector_moments", B.with_ctes("""
SELECT prior, k, sum(n * (t4 - (n * t3 + k * prior * 100) / (n + k))) / sum(n) AS deriva FROM tr CROSS JOIN (
  SELECT prior, prior * (1 - prior) / greatest(ff - prior * prior - prior * (1 - prior) * inv, 1e-12) AS k FROM (
    SELECT sum(n * t3 / 100) / sum(n) AS prior, sum(n * t3 / 100 * t3 / 100) / sum(n) AS ff, count(*) / CAST(sum(n) AS DOUBLE) AS inv FROM tr) AS m) AS f GROUP BY 1, 2""",
    "unique_students", "goals_mun", extra={**GOAL_CTES, "tr": "SELECT taxa_2023 AS t3, taxa_2024 AS t4, n_alunos_2023 AS n FROM gb WHERE taxa_2023 IS NOT NULL AND taxa_2024 IS NOT NULL AND n_alunos_2023 IS NOT NULL"}),
    ["prior", "k", "deriva"])
def goal_projector_moments(spark, folder):
    """Shrinkage and drift of the projector (the closed-form part)."""
    train = goal_base(spark, folder).dropna(subset=["taxa_2023", "taxa_2024", "n_alunos_2023"]).withColumn("fold", F.lit(0))
    return goals.moments(materialize(train), "taxa_2023", "n_alunos_2023", "taxa_2024").select("prior", "k", "deriva")


@query("goal_projector_fit")
def goal_projector_fit(spark, folder):
    return projector(spark, folder)[1]


@query("goal_scenarios")
def goal_scenarios(spark, folder):
    return goals.publishable(*projector(spark, folder))


@query("goal_volatility_by_size")
def goal_volatility_by_size(spark, folder):
    return goals.volatility_by_size(*projector(spark, folder))


@query("goal_territorial_evaluation")
def goal_territorial_evaluation(spark, folder):
    return goals.evaluate_transition(goal_base(spark, folder))


@query("goal_evaluation_summary")
def goal_evaluation_summary(spark, folder):
    return goals.summarize_evaluation(goals.evaluate_transition(goal_base(spark, folder)))


@query("goal_rankings_without_model")
def goal_rankings_without_model(spark, folder):
    return goals.rankings_without_model(goals.evaluate_transition(goal_base(spark, folder)))


@query("goal_probability_deciles")
def goal_probability_deciles(spark, folder):
    return goals.probability_deciles(materialize(goals.evaluate_transition(goal_base(spark, folder))))


@query("goal_yearly_funnel", B.with_ctes(" UNION ALL ".join(
    f"SELECT CAST({y} AS INTEGER) AS ano, count(*) FILTER (WHERE taxa_2024 >= meta_{y}) AS municipios_que_ja_atingem_com_a_taxa_de_2024, "
    f"avg(CASE WHEN taxa_2024 >= meta_{y} THEN 1.0 ELSE 0.0 END) AS share_que_ja_atinge, quantile_cont(meta_{y}, 0.5) AS meta_mediana, "
    f"quantile_cont(meta_{y} - taxa_2024, 0.5) AS gap_mediano, quantile_cont(meta_{y} - taxa_2024, 0.5) / {y - 2024} AS gap_mediano_anualizado_pp "
    f"FROM gb WHERE taxa_2024 IS NOT NULL AND meta_2025 IS NOT NULL" for y in range(2025, 2031)), "unique_students", "goals_mun", extra=GOAL_CTES),
    ["share_que_ja_atinge", "meta_mediana", "gap_mediano", "gap_mediano_anualizado_pp"])
def goal_yearly_funnel(spark, folder):
    return goals.yearly_funnel(goal_base(spark, folder))


@query("goal_diagnostics")
def goal_diagnostics(spark, folder):
    base, fit = projector(spark, folder)
    return goals.diagnostics(materialize(goals.publishable(base, fit)), base, base.count())
