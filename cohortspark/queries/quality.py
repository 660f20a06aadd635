"""Gates, reconciliations and audits over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import contracts as C
from cohortspark.functions.stats import weighted_mean
from cohortspark.operators import quality
from cohortspark.plans import features
from cohortspark.queries import bindings as B
from cohortspark.queries.registry import query


@query("deduplicated_students", B.with_ctes("SELECT * FROM unique_students", "unique_students"), ["proficiencia", "peso_aluno"])
def deduplicated_students(spark, folder):
    return B.unique_students(spark, folder)


@query("duplicate_summary", B.with_ctes("""
SELECT sum(n)::BIGINT AS antes, count(*) AS depois, sum(n - 1)::BIGINT AS removidos
FROM (SELECT count(*) AS n FROM students GROUP BY ano, id_aluno) AS g""", "students"))
def duplicate_summary(spark, folder):
    return quality.duplicate_summary(B.students(spark, folder), ["ano", "id_aluno"])


@query("critical_null_report", B.with_ctes("""
SELECT coluna, registros, nulos, 100.0 * nulos / registros AS pct_nulo FROM (
  SELECT 'proficiencia' AS coluna, count(*) AS registros, count(*) - count(proficiencia) AS nulos FROM students
  UNION ALL SELECT 'peso_aluno', count(*), count(*) - count(peso_aluno) FROM students
  UNION ALL SELECT 'alfabetizado', count(*), count(*) - count(alfabetizado) FROM students) AS x""", "students"), ["pct_nulo"])
def critical_null_report(spark, folder):
    return quality.critical_null_table(B.students(spark, folder), ["proficiencia", "peso_aluno", "alfabetizado"])


@query("quality_gate_measures", B.with_ctes("""
SELECT count(*) AS registros, count(DISTINCT ano) AS n_anos, 0::BIGINT AS removidos, count(id_municipio) AS com_chave,
       count(*) FILTER (WHERE id_municipio IS NOT NULL AND nome_municipio IS NULL) AS orfaos,
       count(*) FILTER (WHERE taxa_alfabetizacao IS NULL) AS nulos_taxa_alfabetizacao
FROM published_mun LEFT JOIN (SELECT id_municipio, nome_municipio FROM territory WHERE nome_regiao <> 'ASIA') AS t USING (id_municipio)""",
    "published_mun"))
def quality_gate_measures(spark, folder):
    """Everything the null and orphan gates need in one aggregate; one region is missing from the directory."""
    directory = B.territory(spark, folder).where(F.col("nome_regiao") != "ASIA").select("id_municipio", "nome_municipio")
    rows = B.published_municipal(spark, folder).join(directory, "id_municipio", "left")
    table = quality.quality_aggregate(rows, ["taxa_alfabetizacao"], "municipio")
    return table.withColumn("n_anos", F.size("anos").cast("bigint")).drop("anos")


@query("join_cardinality_guard", B.with_ctes(f"""
SELECT sum(l)::BIGINT AS linhas_antes, sum(l * greatest(r, 1))::BIGINT AS linhas_depois, count(*) FILTER (WHERE r > 1) AS chaves_repetidas,
       sum(CASE WHEN r = 0 THEN l ELSE 0 END)::BIGINT AS sem_par
FROM (SELECT coalesce(n, 0) AS l, coalesce(m, 0) AS r FROM
  (SELECT id_municipio, count(*) AS n FROM students WHERE ano = {B.TARGET} GROUP BY 1) AS a FULL JOIN
  (SELECT id_municipio, count(*) AS m FROM published_mun WHERE ano = {B.LAG} GROUP BY 1) AS b USING (id_municipio)) AS x""", "students", "published_mun"))
def join_cardinality_guard(spark, folder):
    """The trap the guard is for: the published table has several networks per municipality."""
    now = B.students(spark, folder).where(F.col("ano") == B.TARGET)
    return quality.join_cardinality(now, B.published_municipal(spark, folder).where(F.col("ano") == B.LAG), ["id_municipio"])


@query("guarded_weight_join", B.with_ctes(f"""
SELECT id_aluno, alfabetizado, peso_aluno FROM unique_students WHERE ano = {B.TARGET} AND presenca = 1 AND preenchimento_caderno = 1""",
    "unique_students"), ["peso_aluno"])
def guarded_weight_join(spark, folder):
    """Same-year weight attached one to one."""
    rows = B.unique_students(spark, folder)
    return features.attach_weight(features.cohort(rows, B.TARGET), rows, B.TARGET).select("id_aluno", "alfabetizado", "peso_aluno")


@query("territory_directory", B.with_ctes("""
SELECT DISTINCT id_municipio, sigla_uf, nome_regiao FROM students""", "students"))
def territory_directory(spark, folder):
    """Directory from the student rows; a municipality in two states would stop it."""
    return quality.build_directory(B.students(spark, folder).select("id_municipio", "sigla_uf", "nome_regiao"))


@query("territory_conflicts", B.with_ctes("""
SELECT id_escola, count(DISTINCT sigla_uf) AS n_ufs FROM students GROUP BY 1 HAVING count(DISTINCT sigla_uf) > 1""", "students"))
def territory_conflicts(spark, folder):
    return quality.territory_conflicts(B.students(spark, folder), "id_escola", "sigla_uf")


@query("row_reconciliation", B.with_ctes(f"""
SELECT count(*) AS chaves, count(*) FILTER (WHERE nb IS NULL) AS so_a, count(*) FILTER (WHERE na IS NULL) AS so_b,
  count(*) FILTER (WHERE na > 1) AS repetidas_a, count(*) FILTER (WHERE nb > 1) AS repetidas_b,
  count(*) FILTER (WHERE na IS NOT NULL AND nb IS NOT NULL AND ta IS DISTINCT FROM tb) AS alvo_diferente
FROM (SELECT id_aluno, count(*) AS na, max(alfabetizado) AS ta FROM students WHERE ano = {B.TARGET} AND presenca = 1 GROUP BY 1) AS a
FULL JOIN (SELECT id_aluno, count(*) AS nb, max(alfabetizado) AS tb FROM unique_students WHERE ano = {B.TARGET} AND preenchimento_caderno = 1
  GROUP BY 1) AS b USING (id_aluno)""", "students", "unique_students"))
def row_reconciliation(spark, folder):
    raw = B.students(spark, folder).where((F.col("ano") == B.TARGET) & (F.col("presenca") == 1))
    return quality.reconcile_rows(raw, features.cohort(B.unique_students(spark, folder), B.TARGET), ["id_aluno"], "alfabetizado")


@query("published_reconciliation", B.with_ctes(f"""
SELECT leitura, count(*) AS n, avg(abs(t - taxa_alfabetizacao)) AS mae, corr(t, taxa_alfabetizacao) AS correlacao FROM (
  SELECT 'ponderada' AS leitura, id_municipio, sum(alfabetizado * peso_aluno) / sum(peso_aluno) * 100 AS t FROM students
    WHERE ano = {B.LAG} AND presenca = 1 AND rede IN ('2', '3') GROUP BY 2
  UNION ALL SELECT 'simples', id_municipio, avg(alfabetizado) * 100 FROM students
    WHERE ano = {B.LAG} AND presenca = 1 AND rede IN ('2', '3') GROUP BY 2) AS m
JOIN (SELECT id_municipio, taxa_alfabetizacao FROM published_mun WHERE ano = {B.LAG} AND rede = '5' AND taxa_alfabetizacao IS NOT NULL) AS p USING (id_municipio)
GROUP BY 1""", "students", "published_mun"), ["mae", "correlacao"])
def published_reconciliation(spark, folder):
    """Mean absolute error of weighted and simple municipal rates against the published ones."""
    rows = B.students(spark, folder).where((F.col("ano") == B.LAG) & (F.col("presenca") == 1) & F.col("rede").isin(*C.PUBLIC_NETWORKS))
    rates = rows.groupBy("id_municipio").agg(
        (weighted_mean(F.col("alfabetizado"), F.col("peso_aluno")) * 100).alias("w"), (F.avg("alfabetizado") * 100).alias("s"))
    published = B.published_municipal(spark, folder).where((F.col("ano") == B.LAG) & (F.col("rede") == "5"))
    one = quality.agreement(rates, published, "id_municipio", "w", "taxa_alfabetizacao").withColumn("leitura", F.lit("ponderada"))
    return one.unionByName(quality.agreement(rates, published, "id_municipio", "s", "taxa_alfabetizacao").withColumn("leitura", F.lit("simples")))


SPEARMAN_FEATURES = ("mun_taxa_alfab_lag1", "mun_taxa_presenca_lag1", "mun_n_alunos_lag1", "uf_taxa_alfab_lag1", "esc_taxa_alfab_lag1", "caderno")


def spearman_sql(source: str, x: str, y: str) -> str:
    return (f"SELECT corr(rx, ry) FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx, "
            f"rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry FROM {source} "
            f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS r")


@query("leakage_spearman", B.with_ctes(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, abs(({spearman_sql('dataset', f, 'risco_nao_alfabetizacao')})) AS spearman_abs" for f in SPEARMAN_FEATURES), "dataset"),
    ["spearman_abs"])
def leakage_spearman(spark, folder):
    return quality.feature_target_spearman(B.dataset(spark, folder), C.TARGET, SPEARMAN_FEATURES)


AUC_OF = """SELECT (sum(CASE WHEN {y} = 1 THEN r END) - sum({y}) * (sum({y}) + 1) / 2.0) / (sum({y}) * (count(*) - sum({y}))) FROM (
  SELECT {y}, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS r FROM {t} WHERE {s} IS NOT NULL) AS q"""


@query("deterministic_cut", B.with_ctes(f"""
SELECT count(*) AS n, max(proficiencia) FILTER (WHERE alfabetizado = 0) AS maximo_classe_0, min(proficiencia) FILTER (WHERE alfabetizado = 1) AS minimo_classe_1,
  {B.CUT}::DOUBLE AS limiar_declarado,
  max(proficiencia) FILTER (WHERE alfabetizado = 0) >= min(proficiencia) FILTER (WHERE alfabetizado = 1) AS ha_sobreposicao,
  corr(proficiencia, alfabetizado) AS correlacao, ({AUC_OF.format(y='alfabetizado', s='proficiencia', t='students')}) AS auc
FROM students WHERE proficiencia IS NOT NULL""", "students"), ["maximo_classe_0", "minimo_classe_1", "limiar_declarado", "correlacao", "auc"])
def deterministic_cut(spark, folder):
    return quality.deterministic_cut(B.students(spark, folder), "alfabetizado", "proficiencia", B.CUT)


def _recycled(spark, folder, year):
    """Part numbers as student ids: the same numbers return every year for other municipalities."""
    line, orders = B.table(spark, folder, "lineitem"), B.table(spark, folder, "orders")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).where(F.year("l_shipdate") == year).select(
        F.col("l_partkey").alias("id_aluno"), F.col("l_suppkey").alias("id_escola"), F.col("o_custkey").alias("id_municipio"))


@query("recycled_student_ids", f"""
WITH a AS (SELECT id, s, m FROM (SELECT l_partkey AS id, l_suppkey AS s, o_custkey AS m, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, o_custkey) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(l_shipdate) = {B.LAG}) AS x WHERE rn = 1),
b AS (SELECT id, s, m FROM (SELECT l_partkey AS id, l_suppkey AS s, o_custkey AS m, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, o_custkey) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(l_shipdate) = {B.TARGET}) AS x WHERE rn = 1)
SELECT (SELECT count(*) FROM a) AS ids_lag, (SELECT count(*) FROM b) AS ids_atual, count(*) AS ids_em_ambos_anos,
  avg(CAST(a.s = b.s AS INTEGER)) AS pct_mesma_escola, avg(CAST(a.m = b.m AS INTEGER)) AS pct_mesmo_municipio,
  count(*) FILTER (WHERE a.s <> b.s) AS pares_falsos_estimados FROM a JOIN b ON a.id = b.id""", ["pct_mesma_escola", "pct_mesmo_municipio"])
def recycled_student_ids(spark, folder):
    return quality.recycled_students(_recycled(spark, folder, B.LAG), _recycled(spark, folder, B.TARGET))


def _home(year: int) -> str:
    return f"SELECT id_escola, min(id_municipio) AS m, count(*) AS n FROM students WHERE ano = {year} AND presenca = 1 GROUP BY 1"


@query("recycled_school_ids", B.with_ctes(f"""
SELECT count(l.m) AS escolas_lag, count(a.m) AS escolas_atual, count(*) FILTER (WHERE l.m IS NOT NULL AND a.m IS NOT NULL) AS ids_em_ambos_anos,
  CAST(count(*) FILTER (WHERE l.m = a.m) AS DOUBLE) / count(*) FILTER (WHERE l.m IS NOT NULL AND a.m IS NOT NULL) AS pct_mesmo_municipio,
  CAST(count(*) FILTER (WHERE tl.sigla_uf = ta.sigla_uf) AS DOUBLE) / count(*) FILTER (WHERE l.m IS NOT NULL AND a.m IS NOT NULL) AS pct_mesma_uf,
  sum(CASE WHEN l.m <> a.m THEN a.n ELSE 0 END)::BIGINT AS alunos_com_escola_falsa,
  sum(CASE WHEN l.m <> a.m THEN a.n ELSE 0 END) / CAST(sum(a.n) AS DOUBLE) AS pct_alunos_com_escola_falsa,
  ({spearman_sql('hl', 'id_escola', 'm')}) AS spearman_lag, ({spearman_sql('ha', 'id_escola', 'm')}) AS spearman_atual
FROM hl AS l FULL JOIN ha AS a ON l.id_escola = a.id_escola LEFT JOIN territory AS tl ON tl.id_municipio = l.m LEFT JOIN territory AS ta ON ta.id_municipio = a.m""",
    "students", extra={"hl": _home(B.LAG), "ha": _home(B.TARGET)}),
    ["pct_mesmo_municipio", "pct_mesma_uf", "pct_alunos_com_escola_falsa", "spearman_lag", "spearman_atual"])
def recycled_school_ids(spark, folder):
    rows = B.students(spark, folder)
    return quality.recycled_schools(rows.where(F.col("ano") == B.LAG), rows.where(F.col("ano") == B.TARGET), B.territory(spark, folder))


@query("id_prefix_audit", B.with_ctes("""
SELECT prefixo, sum(n)::BIGINT AS n, sum(ok) / CAST(sum(n) AS DOUBLE) AS pct_prefixo_igual, count(*) AS n_ufs,
  min_by(sigla_uf, row(-n, sigla_uf)) AS uf_dominante FROM (
  SELECT id // 1000000000 AS prefixo, sigla_uf, count(*) AS n, count(*) FILTER (WHERE id // 1000000000 = codigo_uf) AS ok
  FROM (SELECT *, codigo_uf * 1000000000::BIGINT + id_aluno + CASE WHEN rede = '4' THEN 1000000000::BIGINT ELSE 0 END AS id FROM students) AS s
  GROUP BY 1, 2) AS c GROUP BY 1""", "students"), ["pct_prefixo_igual"])
def id_prefix_audit(spark, folder):
    """Ids that carry the state code in front; private-network ids are off by one."""
    rows = B.students(spark, folder)
    shift = F.when(F.col("rede") == "4", F.lit(1000000000)).otherwise(F.lit(0))
    rows = rows.withColumn("id", F.col("codigo_uf").cast("bigint") * 1000000000 + F.col("id_aluno") + shift)
    return quality.prefix_table(rows, "id", 1000000000, F.col("codigo_uf").cast("bigint"))


@query("participation_equals_presence", B.with_ctes(f"""
SELECT count(*) AS n, avg(abs(o - p)) AS mae, corr(o, p) AS correlacao FROM
  (SELECT id_municipio, avg(presenca) * 100 AS o FROM students WHERE ano = {B.LAG} AND rede = '3' GROUP BY 1) AS a
  JOIN (SELECT id_municipio, percentual_participacao AS p FROM goals_mun WHERE ano = {B.LAG}) AS b USING (id_municipio)""", "students", "goals_mun"),
    ["mae", "correlacao"])
def participation_equals_presence(spark, folder):
    observed = B.students(spark, folder).where((F.col("ano") == B.LAG) & (F.col("rede") == "3")).groupBy("id_municipio").agg(
        (F.avg("presenca") * 100).alias("o"))
    published = B.goals_municipal(spark, folder).where(F.col("ano") == B.LAG)
    return quality.agreement(observed, published, "id_municipio", "o", "percentual_participacao")


@query("informative_nulls", B.with_ctes("""
SELECT mun_meta_2024_lag1 IS NULL AS sem_valor, count(DISTINCT id_municipio) AS n_unidades, count(*) AS n, avg(risco_nao_alfabetizacao) AS taxa
FROM dataset GROUP BY 1""", "dataset"), ["taxa"])
def informative_nulls(spark, folder):
    return quality.informative_nulls(B.dataset(spark, folder), "mun_meta_2024_lag1", C.TARGET, "id_municipio")


@query("null_means_absent", B.with_ctes("""
SELECT count(*) AS n, avg(CAST((proficiencia IS NULL) = (presenca = 0) AS INTEGER)) AS concordancia FROM students""", "students"), ["concordancia"])
def null_means_absent(spark, folder):
    return quality.null_agreement(B.students(spark, folder), "proficiencia", F.col("presenca") == 0)
