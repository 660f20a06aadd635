"""Grouped aggregates over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions.stats import weighted_mean
from cohortspark.operators import aggregates
from cohortspark.queries import bindings as B
from cohortspark.queries.layers import STUDENT_METRICS
from cohortspark.queries.registry import query, sql_round


@query("student_metrics_by_network", B.with_ctes(STUDENT_METRICS, "students"),
       ["proficiencia_media", "proporcao_presenca", "taxa_alfabetizacao_observada", "proficiencia_media_ponderada"])
def student_metrics_by_network(spark, folder):
    return aggregates.student_metrics(B.students(spark, folder))


@query("composite_network_rollup", B.with_ctes("""
SELECT ano, rede, count(*) AS n, sum(presenca)::BIGINT AS presentes FROM (SELECT ano, rede, presenca FROM students UNION ALL
  SELECT ano, '5', presenca FROM students WHERE rede IN ('2', '3') UNION ALL SELECT ano, '0', presenca FROM students) AS x GROUP BY 1, 2""", "students"))
def composite_network_rollup(spark, folder):
    """Own code, public union and total from one scan."""
    return aggregates.with_composite_networks(B.students(spark, folder)).groupBy("ano", "rede").agg(
        F.count(F.lit(1)).alias("n"), F.sum("presenca").alias("presentes"))


@query("country_simple_means", B.with_ctes(f"""
SELECT ano, serie, rede, {sql_round('avg(taxa_alfabetizacao)', 2)} AS taxa_alfabetizacao_brasil,
  {sql_round('avg(media_portugues)', 2)} AS media_portugues_brasil FROM published_uf GROUP BY 1, 2, 3""", "published_uf"),
    ["taxa_alfabetizacao_brasil", "media_portugues_brasil"])
def country_simple_means(spark, folder):
    return aggregates.country_means(B.published_state(spark, folder))


@query("country_weighted_means", B.with_ctes(f"""
SELECT ano, serie, code AS rede, {sql_round('sum(alfabetizado * peso_aluno) / sum(peso_aluno) * 100', 2)} AS taxa_alfabetizacao_brasil_ponderada,
  {sql_round('sum(proficiencia * peso_aluno) / sum(CASE WHEN proficiencia IS NOT NULL THEN peso_aluno END)', 2)} AS media_portugues_brasil_ponderada
FROM (SELECT *, rede AS code FROM students UNION ALL SELECT *, '5' FROM students WHERE rede IN ('2', '3') UNION ALL SELECT *, '0' FROM students) AS x
WHERE presenca = 1 GROUP BY 1, 2, 3""", "students"), ["taxa_alfabetizacao_brasil_ponderada", "media_portugues_brasil_ponderada"])
def country_weighted_means(spark, folder):
    return aggregates.country_weighted_means(B.students(spark, folder))


@query("weighted_mean_by_unit", B.with_ctes("""
SELECT ano, id_municipio, sum(proficiencia * peso_aluno) / nullif(sum(CASE WHEN proficiencia IS NOT NULL THEN peso_aluno END), 0) AS media
FROM students GROUP BY 1, 2""", "students"), ["media"])
def weighted_mean_by_unit(spark, folder):
    return B.students(spark, folder).groupBy("ano", "id_municipio").agg(weighted_mean(F.col("proficiencia"), F.col("peso_aluno")).alias("media"))


@query("score_distribution_shape", B.with_ctes("""
SELECT id_municipio, stddev_samp(proficiencia) AS mun_prof_sd_lag1, quantile_cont(proficiencia, 0.25) AS mun_prof_p25_lag1,
  quantile_cont(proficiencia, 0.5) AS mun_prof_p50_lag1, quantile_cont(proficiencia, 0.75) AS mun_prof_p75_lag1,
  quantile_cont(proficiencia, 0.75) - quantile_cont(proficiencia, 0.25) AS mun_prof_iqr_lag1
FROM students WHERE proficiencia IS NOT NULL GROUP BY 1""", "students"),
    ["mun_prof_sd_lag1", "mun_prof_p25_lag1", "mun_prof_p50_lag1", "mun_prof_p75_lag1", "mun_prof_iqr_lag1"])
def score_distribution_shape(spark, folder):
    return aggregates.distribution_shape(B.students(spark, folder), "id_municipio", "mun")


@query("presence_and_enrolment", B.with_ctes("""
SELECT id_escola, avg(presenca) AS esc_taxa_presenca_lag1, count(*) AS esc_n_matriculados_lag1 FROM students GROUP BY 1""", "students"), ["esc_taxa_presenca_lag1"])
def presence_and_enrolment(spark, folder):
    return aggregates.attendance(B.students(spark, folder), "id_escola", "esc")


POPULATION = f"""
SELECT id_municipio, count(*) FILTER (WHERE presenca = 1) AS n_avaliados, avg(alfabetizado) FILTER (WHERE presenca = 1) AS taxa_alfab_simples,
  avg(proficiencia) AS prof_media_simples, sum(alfabetizado * peso_aluno) / sum(peso_aluno) AS taxa_alfab_ponderada,
  sum(proficiencia * peso_aluno) / sum(CASE WHEN proficiencia IS NOT NULL THEN peso_aluno END) AS prof_media_ponderada,
  sum(peso_aluno) AS soma_pesos, avg(presenca) AS taxa_presenca, CAST({{y}} AS INTEGER) AS ano, any_value(sigla_uf) AS sigla_uf, any_value(nome_regiao) AS nome_regiao
FROM unique_students WHERE ano = {{y}} GROUP BY 1 HAVING count(*) FILTER (WHERE presenca = 1) > 0"""
POPULATION_FLOATS = ["taxa_alfab_simples", "prof_media_simples", "taxa_alfab_ponderada", "prof_media_ponderada", "soma_pesos", "taxa_presenca"]


def population(spark, folder, year, rows=None):
    return aggregates.population_table(B.unique_students(spark, folder) if rows is None else rows, B.territory(spark, folder), year)


@query("population_table", B.with_ctes(POPULATION.format(y=B.TARGET), "unique_students"), POPULATION_FLOATS)
def population_table(spark, folder):
    return population(spark, folder, B.TARGET)


@query("category_weight_share", B.with_ctes("""
SELECT id_municipio, sum(CASE WHEN rede_grupo = 'Estadual' THEN peso_aluno ELSE 0 END) / sum(peso_aluno) AS share_rede_estadual FROM dataset GROUP BY 1""", "dataset"),
    ["share_rede_estadual"])
def category_weight_share(spark, folder):
    return aggregates.category_weight_share(B.dataset(spark, folder), "id_municipio", F.col("rede_grupo") == "Estadual", "peso_aluno", "share_rede_estadual")


@query("distinct_counts_by_state", B.with_ctes("""
SELECT sigla_uf, count(DISTINCT id_municipio) AS municipios, count(DISTINCT id_escola) AS escolas, count(DISTINCT id_aluno) AS alunos FROM students GROUP BY 1""", "students"))
def distinct_counts_by_state(spark, folder):
    """Distinct counts through distinct pairs: two shuffles per measure, no growing set."""
    rows = B.students(spark, folder)
    tables = [rows.select("sigla_uf", c).distinct().groupBy("sigla_uf").agg(F.count(F.lit(1)).alias(a))
              for c, a in (("id_municipio", "municipios"), ("id_escola", "escolas"), ("id_aluno", "alunos"))]
    return tables[0].join(tables[1], "sigla_uf").join(tables[2], "sigla_uf")


@query("first_and_modal_network", B.with_ctes("""
SELECT id_municipio, min_by(rede, row(ano, id_aluno, rede)) AS primeira, any_value(moda) AS moda FROM students JOIN (
  SELECT id_municipio, min_by(rede, row(-n, rede)) AS moda FROM (SELECT id_municipio, rede, count(*) AS n FROM students GROUP BY 1, 2) AS c GROUP BY 1) AS m USING (id_municipio)
GROUP BY 1""", "students"))
def first_and_modal_network(spark, folder):
    """First value by an explicit order, and the commonest value (smallest on a tie)."""
    rows = B.students(spark, folder)
    first = rows.groupBy("id_municipio").agg(F.min_by("rede", F.struct("ano", "id_aluno", "rede")).alias("primeira"))
    cells = rows.groupBy("id_municipio", "rede").agg(F.count(F.lit(1)).alias("n"))
    mode = cells.groupBy("id_municipio").agg(F.min_by("rede", F.struct(-F.col("n"), F.col("rede"))).alias("moda"))
    return first.join(mode, "id_municipio")


@query("frequency_shares", B.with_ctes("""
SELECT sigla_uf, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS participacao FROM students GROUP BY 1""", "students"), ["participacao"])
def frequency_shares(spark, folder):
    return aggregates.frequency_shares(B.students(spark, folder), "sigla_uf")


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query("crosstab_row_shares", B.with_ctes("SELECT rede, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE nome_regiao = '{r}') AS DOUBLE) / count(*) AS \"{r}\"" for r in REGIONS) + " FROM students GROUP BY 1", "students"), REGIONS)
def crosstab_row_shares(spark, folder):
    return aggregates.crosstab_row_shares(B.students(spark, folder), "rede", "nome_regiao", REGIONS)


@query("score_summary", B.with_ctes("""
SELECT ano, count(proficiencia) AS n, avg(proficiencia) AS media, stddev_samp(proficiencia) AS dp, min(proficiencia) AS minimo, max(proficiencia) AS maximo,
  quantile_cont(proficiencia, 0.25) AS p25, quantile_cont(proficiencia, 0.5) AS p50, quantile_cont(proficiencia, 0.75) AS p75 FROM students GROUP BY 1""", "students"),
    ["media", "dp", "minimo", "maximo", "p25", "p50", "p75"])
def score_summary(spark, folder):
    return aggregates.measure_summary(B.students(spark, folder), "proficiencia", ["ano"])


@query("level_bands", B.with_ctes("SELECT ano, " + ", ".join(
    f"avg({B.LEVELS[i]}) + avg({B.LEVELS[i + 1]}) + avg({B.LEVELS[i + 2]}) AS {n}" for i, n in ((0, "niveis_0_a_2"), (3, "niveis_3_a_5"), (6, "niveis_6_a_8")))
    + " FROM published_mun WHERE rede = '5' GROUP BY 1", "published_mun"), ["niveis_0_a_2", "niveis_3_a_5", "niveis_6_a_8"])
def level_bands(spark, folder):
    return aggregates.level_bands(B.published_municipal(spark, folder).where(F.col("rede") == "5"), B.LEVELS, ["ano"])


@query("deviation_from_municipality", B.with_ctes("""
SELECT id_municipio, id_escola, n, k / CAST(n AS DOUBLE) - pk / CAST(pn AS DOUBLE) AS taxa FROM (
  SELECT id_municipio, id_escola, count(*) AS n, sum(alfabetizado) AS k FROM students WHERE presenca = 1 GROUP BY 1, 2) AS u
JOIN (SELECT id_municipio, count(*) AS pn, sum(alfabetizado) AS pk FROM students WHERE presenca = 1 GROUP BY 1) AS p USING (id_municipio)""", "students"), ["taxa"])
def deviation_from_municipality(spark, folder):
    return aggregates.deviation_from_parent(B.students(spark, folder).where(F.col("presenca") == 1), "id_escola", "id_municipio")


@query("share_of_total", B.with_ctes("""
SELECT sigla_uf, sum(peso_aluno) AS peso, sum(peso_aluno) / sum(sum(peso_aluno)) OVER () AS participacao FROM students GROUP BY 1""", "students"), ["peso", "participacao"])
def share_of_total(spark, folder):
    table = B.students(spark, folder).groupBy("sigla_uf").agg(F.sum("peso_aluno").alias("peso"))
    return aggregates.share_of_total(table, "peso")
