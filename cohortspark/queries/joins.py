"""Join shapes and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import contracts as C
from cohortspark.operators import profile, sampling
from cohortspark.plans import medallion
from cohortspark.queries import bindings as B
from cohortspark.queries.registry import query


@query("dimension_enrichment", B.with_ctes("""
SELECT p.ano, p.rede, t.nome_regiao, count(*) AS n, count(*) FILTER (WHERE nome_municipio IS NULL) AS orfaos
FROM published_mun AS p LEFT JOIN (SELECT * FROM territory WHERE nome_regiao <> 'ASIA') AS t USING (id_municipio) GROUP BY ALL""", "published_mun"))
def dimension_enrichment(spark, folder):
    """Left join to a directory that lacks one region."""
    dims = {"municipio": B.territory(spark, folder).where(F.col("nome_regiao") != "ASIA")}
    rows = medallion.enrich(B.published_municipal(spark, folder), "municipio", dims)
    return rows.groupBy("ano", "rede", "nome_regiao").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("nome_municipio").isNull()).alias("orfaos"))


@query("null_derived_key_join", B.with_ctes(f"""
SELECT s.rede, count(*) AS n, count(g.sigla_uf) AS com_meta FROM students AS s LEFT JOIN goals_uf AS g
  ON g.ano = s.ano AND g.sigla_uf = s.sigla_uf AND (CASE WHEN s.rede IN ('2', '3') THEN '5' END) = (CASE g.rede WHEN 'Pública' THEN '5' END)
WHERE presenca = 1 GROUP BY 1""", "students", "goals_uf"))
def null_derived_key_join(spark, folder):
    """A NULL derived key never matches: private-network students get no public goal."""
    goals = B.goals_state(spark, folder)
    table = medallion.gold_students({C.STUDENTS.name: B.students(spark, folder), C.STATE_GOALS.name: goals})
    return table.groupBy("rede").agg(F.count(F.lit(1)).alias("n"), F.count("percentual_participacao_uf").alias("com_meta"))


RATE = "SELECT id_municipio, count(*) AS n, avg(alfabetizado) AS taxa FROM students WHERE ano = {y} AND preenchimento_caderno = 1 GROUP BY 1"
TWO = {"lag": RATE.format(y=B.LAG), "atual": RATE.format(y=B.TARGET)}


def rates(spark, folder, year, key="id_municipio"):
    rows = B.students(spark, folder).where((F.col("ano") == year) & (F.col("preenchimento_caderno") == 1))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("alfabetizado").alias("taxa"))


@query("two_period_join", B.with_ctes("""
SELECT id_municipio, l.n AS n_lag, l.taxa AS taxa_lag, a.n AS n_atual, a.taxa AS taxa_atual FROM lag AS l JOIN atual AS a USING (id_municipio)""",
    "students", extra=TWO), ["taxa_lag", "taxa_atual"])
def two_period_join(spark, folder):
    return profile.two_periods(rates(spark, folder, B.LAG), rates(spark, folder, B.TARGET), "id_municipio")


@query("territory_full_outer", B.with_ctes("""
SELECT id_municipio, n, t5, t3 FROM lag FULL JOIN piv_mun USING (id_municipio)""", "students", "piv_mun", extra={"lag": TWO["lag"]}), ["t5", "t3"])
def territory_full_outer(spark, folder):
    """Own aggregates ∪ published aggregates."""
    from cohortspark.operators import aggregates
    published = aggregates.pivot_published(B.published_municipal(spark, folder), "id_municipio", B.LAG)
    return rates(spark, folder, B.LAG).join(published, "id_municipio", "full_outer").select(
        "id_municipio", "n", F.col("taxa_alfabetizacao_r5").alias("t5"), F.col("taxa_alfabetizacao_r3").alias("t3"))


def _year(spark, folder, year):
    return B.students(spark, folder).where((F.col("ano") == year) & (F.col("presenca") == 1))


@query("membership_flag", B.with_ctes(f"""
SELECT sigla_uf, tem_historico, count(*) AS n FROM (SELECT s.sigla_uf, k.id_municipio IS NOT NULL AS tem_historico FROM students AS s LEFT JOIN
  (SELECT DISTINCT id_municipio FROM students WHERE ano = {B.LAG} AND presenca = 1) AS k USING (id_municipio) WHERE ano = {B.TARGET} AND presenca = 1) AS x
GROUP BY ALL""", "students"))
def membership_flag(spark, folder):
    flagged = profile.with_history_flag(_year(spark, folder, B.TARGET), _year(spark, folder, B.LAG), "id_municipio")
    return flagged.groupBy("sigla_uf", "tem_historico").agg(F.count(F.lit(1)).alias("n"))


@query("semi_anti_coverage", B.with_ctes(f"""
SELECT (SELECT count(*) FROM (SELECT id_municipio FROM a WHERE id_municipio NOT IN (SELECT id_municipio FROM l)) AS x) AS sem_microdado,
  (SELECT count(*) FROM a WHERE id_municipio NOT IN (SELECT id_municipio FROM l) AND id_municipio IN (SELECT id_municipio FROM piv_mun WHERE t5 IS NOT NULL)) AS cobre_r5,
  (SELECT count(*) FROM a WHERE id_municipio NOT IN (SELECT id_municipio FROM l) AND id_municipio IN (SELECT id_municipio FROM piv_mun WHERE t3 IS NOT NULL)) AS cobre_r3,
  (SELECT count(*) FROM a WHERE id_municipio IN (SELECT id_municipio FROM l)) AS com_microdado""", "students", "piv_mun",
    extra={"a": f"SELECT DISTINCT id_municipio FROM students WHERE ano = {B.TARGET} AND presenca = 1",
           "l": f"SELECT DISTINCT id_municipio FROM students WHERE ano = {B.LAG} AND presenca = 1"}))
def semi_anti_coverage(spark, folder):
    """Which municipalities without own history does each published network cover?"""
    from cohortspark.operators import aggregates
    now = _year(spark, folder, B.TARGET).select("id_municipio").distinct()
    old = _year(spark, folder, B.LAG).select("id_municipio").distinct()
    missing = now.join(old, "id_municipio", "left_anti")
    published = aggregates.pivot_published(B.published_municipal(spark, folder), "id_municipio", B.LAG)

    def size(df):
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    return missing.agg(F.count(F.lit(1)).alias("sem_microdado")).select(
        "sem_microdado",
        size(missing.join(published.where(F.col("taxa_alfabetizacao_r5").isNotNull()), "id_municipio", "left_semi")).alias("cobre_r5"),
        size(missing.join(published.where(F.col("taxa_alfabetizacao_r3").isNotNull()), "id_municipio", "left_semi")).alias("cobre_r3"),
        size(now.join(old, "id_municipio", "left_semi")).alias("com_microdado"))


@query("three_level_lag_join", B.with_ctes("""
SELECT count(*) AS linhas, count(esc_taxa_alfab_lag1) AS com_escola, count(mun_taxa_alfab_lag1) AS com_municipio, count(uf_taxa_alfab_lag1) AS com_uf,
  count(DISTINCT row_id) AS alunos FROM dataset""", "dataset"))
def three_level_lag_join(spark, folder):
    """Guarded many-to-one joins keep the cohort's rows."""
    from cohortspark.plans import features
    from cohortspark.queries.layers import store
    rows = features.cohort(B.unique_students(spark, folder), B.TARGET)
    joined = features.join_features(rows, store(spark, folder))
    return joined.agg(
        F.count(F.lit(1)).alias("linhas"), F.count("esc_taxa_alfab_lag1").alias("com_escola"), F.count("mun_taxa_alfab_lag1").alias("com_municipio"),
        F.count("uf_taxa_alfab_lag1").alias("com_uf"), F.count_distinct("id_aluno").alias("alunos"))


@query("municipality_to_state_lookup", """
SELECT n_name AS sigla_uf, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE l_linestatus = 'F' GROUP BY 1""")
def municipality_to_state_lookup(spark, folder):
    rows = B.students(spark, folder).where(F.col("presenca") == 1).select("id_municipio")
    counted = rows.groupBy("id_municipio").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(B.territory(spark, folder), "id_municipio", "left").groupBy("sigla_uf").agg(F.sum("n").alias("n"))


@query("union_of_periods", B.with_ctes(f"""
SELECT periodo, count(*) AS n, sum(alfabetizado)::BIGINT AS k FROM (SELECT 'lag' AS periodo, alfabetizado FROM students WHERE ano = {B.LAG}
  UNION ALL SELECT 'alvo', alfabetizado FROM students WHERE ano = {B.TARGET}) AS u GROUP BY 1""", "students"))
def union_of_periods(spark, folder):
    rows = B.students(spark, folder)
    parts = [rows.where(F.col("ano") == y).select(F.lit(p).alias("periodo"), "alfabetizado") for p, y in (("lag", B.LAG), ("alvo", B.TARGET))]
    return parts[0].unionByName(parts[1]).groupBy("periodo").agg(F.count(F.lit(1)).alias("n"), F.sum("alfabetizado").alias("k"))


@query("distinct_unit_territory", B.with_ctes("SELECT DISTINCT id_escola, sigla_uf FROM students", "students"))
def distinct_unit_territory(spark, folder):
    return B.students(spark, folder).select("id_escola", "sigla_uf").distinct()


@query("key_set_difference", B.with_ctes("""
SELECT count(*) FILTER (WHERE a.id_municipio IS NOT NULL AND l.id_municipio IS NULL) AS so_a,
  count(*) FILTER (WHERE a.id_municipio IS NULL) AS so_b, count(*) FILTER (WHERE a.id_municipio IS NOT NULL AND l.id_municipio IS NOT NULL) AS em_ambos,
  count(*) FILTER (WHERE a.id_municipio IS NULL OR l.id_municipio IS NULL) = 0 AS iguais,
  count(*) FILTER (WHERE l.id_municipio IS NULL) = 0 AS a_contido_em_b
FROM atual AS a FULL JOIN lag AS l ON a.id_municipio = l.id_municipio""", "students", extra=TWO))
def key_set_difference(spark, folder):
    return sampling.key_set_difference(rates(spark, folder, B.TARGET).select("id_municipio"), rates(spark, folder, B.LAG).select("id_municipio"))


@query("top_list_overlap", B.with_ctes("""
SELECT count(*) AS em_comum FROM (SELECT id_municipio FROM atual ORDER BY n DESC, id_municipio LIMIT 200) AS a
JOIN (SELECT id_municipio FROM lag ORDER BY n DESC, id_municipio LIMIT 200) AS b USING (id_municipio)""", "students", extra=TWO))
def top_list_overlap(spark, folder):
    """Intersection of two top-200 lists."""
    tops = [sampling.top_k(rates(spark, folder, y), "n", "id_municipio", 200).select("id_municipio") for y in (B.TARGET, B.LAG)]
    return sampling.overlap(*tops)
