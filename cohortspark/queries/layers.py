"""Sources, cleaning and the three layers over the bound tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark import contracts as C
from cohortspark.functions import cleaning
from cohortspark.operators import aggregates, quality
from cohortspark.plans import features, medallion
from cohortspark.queries import bindings as B
from cohortspark.queries.registry import query, sql_round
from cohortspark.session import materialize, shared_folder
from cohortspark.sources import tables

FIXED_CLOCK = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.NETWORK_LABELS.items())
CODES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.GOAL_NETWORK_CODES.items())


def raw_results(spark, folder):
    """Published municipal results as an untidy all-text file would deliver them."""
    p = B.published_municipal(spark, folder)
    return p.select(
        F.concat(F.col("ano").cast("string"), F.lit(".0")).alias("Ano "),
        F.concat(F.lit("  "), F.lpad(F.col("id_municipio").cast("string"), 9, "0"), F.lit(" ")).alias("ID Município"),
        F.col("serie").alias("SÉRIE"), F.col("rede").alias("Rede"),
        F.coalesce(F.col("taxa_alfabetizacao").cast("string"), F.lit("n/d")).alias("Taxa  Alfabetização"),
        F.when(F.col("media_portugues") > 640, "   ").otherwise(F.col("media_portugues").cast("string")).alias("Média-Português"))


CLEAN_SQL = f"""
SELECT ano, lpad(CAST(id_municipio AS VARCHAR), 9, '0') AS id_municipio, serie, rede, taxa_alfabetizacao,
       CASE WHEN media_portugues > 640 THEN NULL ELSE media_portugues END AS media_portugues,
       CASE rede {LABELS} ELSE rede END AS rede_nome, '2º ano do Ensino Fundamental' AS serie_nome
FROM published_mun"""


@query("clean_results_layer", B.with_ctes(CLEAN_SQL, "published_mun"), ["taxa_alfabetizacao", "media_portugues"])
def clean_results_layer(spark, folder):
    """Names, blanks, types and labels of the clean layer."""
    return medallion.clean(cleaning.rename_ascii(raw_results(spark, folder)), C.MUNICIPAL_RESULTS)


@query("raw_layer_audit", B.with_ctes("""
SELECT 'bronze' AS _pipeline_stage, 'landing' AS _source_layer, '2024-01-02' AS _bronze_ingestion_date,
       '20240102_030405' AS _bronze_ingestion_timestamp, 'avaliacao_alfabetizacao_municipio' AS _bronze_source_entity,
       count(*) AS linhas, count(DISTINCT id_municipio) AS municipios FROM published_mun""", "published_mun"))
def raw_layer_audit(spark, folder):
    bronze = medallion.to_bronze(raw_results(spark, folder), C.MUNICIPAL_RESULTS, now=FIXED_CLOCK)
    audit = [c for c in bronze.columns if c.startswith("_")]
    return bronze.groupBy(*audit).agg(F.count(F.lit(1)).alias("linhas"), F.count_distinct("id_municipio").alias("municipios"))


def landing_files(spark, folder):
    """The bound tables as the raw text files of their entities."""
    places = B.territory(spark, folder)
    frames = {
        C.STUDENTS: B.students(spark, folder).drop("sigla_uf", "nome_regiao", "codigo_uf"),
        C.MUNICIPAL_RESULTS: B.published_municipal(spark, folder), C.STATE_RESULTS: B.published_state(spark, folder),
        C.MUNICIPAL_GOALS: B.goals_municipal(spark, folder), C.STATE_GOALS: B.goals_state(spark, folder), C.COUNTRY_GOALS: B.goals_country(spark, folder),
        C.MUNICIPAL_DIRECTORY: places.select("id_municipio", F.col("nome_municipio").alias("Nome"), "sigla_uf", "nome_uf", "nome_regiao"),
        C.STATE_DIRECTORY: places.select(F.col("sigla_uf").alias("Sigla"), F.col("nome_uf").alias("Nome"), F.col("nome_regiao").alias("Região")).distinct()}
    landing = shared_folder(spark, "landing")
    for entity, df in frames.items():
        tables.write_product(df, f"{landing}/{entity.file}", "csv")
    return landing


@query("landed_layers", B.with_ctes("""
SELECT 'silver' AS camada, 'avaliacao_alfabetizacao_municipio' AS tabela, ano, rede, count(*) AS linhas, count(taxa_alfabetizacao) AS com_taxa,
       sum(taxa_alfabetizacao) AS soma_taxa, count(*) AS nomeados FROM published_mun GROUP BY ano, rede
UNION ALL SELECT 'gold', 'analise', ano, rede, count(*), count(taxa_alfabetizacao), sum(taxa_alfabetizacao), count(*) FROM published_mun GROUP BY ano, rede
UNION ALL SELECT 'silver', 'avaliacao_alfabetizacao_aluno', ano, NULL, count(DISTINCT (id_aluno, id_escola)), NULL, NULL, count(DISTINCT (id_aluno, id_escola))
FROM students GROUP BY ano""", "published_mun", "students"), ["soma_taxa"])
def landed_layers(spark, folder):
    """Raw files written, ingested as text, cleaned, gated, published and joined to the analysis table, then reread."""
    landing = landing_files(spark, folder)
    name = f"camadas_{uuid.uuid4().hex}"
    try:
        medallion.run_bronze(spark, landing, f"{name}_bronze")
        medallion.run_silver(spark, f"{name}_bronze", f"{name}_silver")
        medallion.run_gold(spark, f"{name}_silver", f"{name}_gold")
        parts = []
        for layer, table, rate in (("silver", C.MUNICIPAL_RESULTS.name, "taxa_alfabetizacao"), ("gold", "analise", "taxa_alfabetizacao_municipio")):
            parts.append(spark.table(f"{name}_{layer}.{table}").groupBy(F.lit(layer).alias("camada"), F.lit(table).alias("tabela"), "ano", "rede").agg(
                F.count(F.lit(1)).alias("linhas"), F.count(rate).alias("com_taxa"), F.sum(rate).alias("soma_taxa"), F.count("nome_municipio").alias("nomeados")))
        parts.append(spark.table(f"{name}_silver.{C.STUDENTS.name}").groupBy("ano").agg(F.count(F.lit(1)).alias("linhas"), F.count("nome_municipio").alias("nomeados")).select(
            F.lit("silver").alias("camada"), F.lit(C.STUDENTS.name).alias("tabela"), "ano", F.lit(None).cast("string").alias("rede"), "linhas",
            F.lit(None).cast("long").alias("com_taxa"), F.lit(None).cast("double").alias("soma_taxa"), "nomeados"))
        return materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    finally:
        for layer in ("bronze", "silver", "gold"):
            spark.sql(f"DROP SCHEMA IF EXISTS {name}_{layer} CASCADE")


@query("typed_rows_per_year", """
SELECT CAST(year(l_shipdate) AS SMALLINT) AS ano, count(*) AS n, sum(CAST(l_suppkey AS BIGINT))::BIGINT AS soma_escola,
       max(l_extendedprice) AS maior FROM lineitem GROUP BY 1""", ["maior"])
def typed_rows_per_year(spark, folder):
    """Text to narrow types by declared schema, then counts per year."""
    line = B.table(spark, folder, "lineitem")
    text = line.select(F.year("l_shipdate").cast("string").alias("ano"), F.col("l_suppkey").cast("string").alias("id_escola"),
                       F.col("l_extendedprice").cast("string").alias("valor"))
    kinds = {"ano": T.ShortType(), "id_escola": T.IntegerType(), "valor": T.DoubleType()}
    typed = text.select(*[tables.narrow(F.col(c), k).alias(c) for c, k in kinds.items()])
    return typed.groupBy("ano").agg(F.count(F.lit(1)).alias("n"), F.sum("id_escola").alias("soma_escola"), F.max("valor").alias("maior"))


@query("pruned_year_scan", """
SELECT o_custkey AS id_municipio, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE year(o_orderdate) = 2000 GROUP BY 1""", ["total"])
def pruned_year_scan(spark, folder):
    """Year filter and two columns reach the Parquet scan."""
    start, end = F.lit("2000-01-01").cast("timestamp_ntz"), F.lit("2001-01-01").cast("timestamp_ntz")
    rows = tables.read_product(spark, f"{folder}/orders.parquet", ["o_custkey", "o_totalprice", "o_orderdate"])
    rows = rows.where((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end))
    return rows.groupBy(F.col("o_custkey").alias("id_municipio")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("joined_years_scan", """
SELECT CAST(year(l_shipdate) AS INT) AS ano, count(*) AS n, sum(CAST(l_suppkey AS BIGINT))::BIGINT AS soma_escola,
       max(l_extendedprice * CASE WHEN year(l_shipdate) = 1996 THEN 2 ELSE 1 END) AS maior
FROM lineitem WHERE year(l_shipdate) IN (SELECT year(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') GROUP BY 1""", ["maior"])
def joined_years_scan(spark, folder):
    """Raw CSV to a typed dataset per year, one year delivered again with changed values, read for the years of another table."""
    raw, stored = shared_folder(spark, "linhas-csv"), shared_folder(spark, "linhas-por-ano")
    line = B.table(spark, folder, "lineitem")
    tables.write_product(line.select(F.year("l_shipdate").alias("ano"), F.col("l_suppkey").alias("id_escola"), F.col("l_extendedprice").alias("valor")), raw, "csv")
    schema = T.StructType([T.StructField("ano", T.ShortType()), T.StructField("id_escola", T.IntegerType()), T.StructField("valor", T.DoubleType())])
    typed = tables.read_typed_csv(spark, raw, schema, schema.fieldNames())
    years = [r["ano"] for r in typed.select("ano").where("ano IS NOT NULL").distinct().collect()]
    tables.write_by_year(typed, stored, years)
    tables.write_by_year(typed.where(F.col("ano") == 1996).withColumn("valor", F.col("valor") * 2), stored, [1996])
    orders = B.table(spark, folder, "orders").where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    rows = tables.in_years(tables.read_product(spark, stored), orders.select(F.year("o_orderdate").alias("ano")))
    return rows.groupBy("ano").agg(F.count(F.lit(1)).alias("n"), F.sum("id_escola").alias("soma_escola"), F.max("valor").alias("maior"))


@query("published_public_network", B.with_ctes(
    "SELECT ano, id_municipio, taxa_alfabetizacao, media_portugues FROM published_mun WHERE rede = '5'", "published_mun"),
    ["taxa_alfabetizacao", "media_portugues"])
def published_public_network(spark, folder):
    return B.published_municipal(spark, folder).where(F.col("rede") == C.PUBLIC_CODE).select(
        "ano", "id_municipio", "taxa_alfabetizacao", "media_portugues")


@query("source_fingerprints")
def source_fingerprints(spark, folder):
    """Row count and content hash of every source table."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    return tables.fingerprints({n: B.table(spark, folder, n) for n in names})


@query("fingerprint_check", """
SELECT (SELECT count(*) FROM orders) AS linhas, 0::BIGINT AS fontes_alteradas""")
def fingerprint_check(spark, folder):
    """A table and its reshuffled copy have the same fingerprint."""
    orders = B.table(spark, folder, "orders")
    changed = tables.check_manifest(tables.fingerprint(orders, "orders"), tables.fingerprint(orders.repartition(7, "o_custkey"), "orders"))
    return orders.agg(F.count(F.lit(1)).alias("linhas")).withColumn(
        "fontes_alteradas", changed.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("altered_copies", """
SELECT 'orders_valor' AS fonte, count(*) AS linhas FROM orders UNION ALL SELECT 'orders_texto_nulo', count(*) FROM orders
UNION ALL SELECT 'orders_repetida', count(*) + 1 FROM orders""")
def altered_copies(spark, folder):
    """Stored copies against the manifest of their source: only those with a changed cell or a repeated row are named."""
    orders = B.table(spark, folder, "orders")
    least = orders.agg(F.min("o_orderkey")).scalar()
    first = F.col("o_orderkey") == least
    one = orders.where(first).orderBy("o_custkey", "o_totalprice").limit(1)
    copies = {
        "orders_igual": orders.repartition("o_custkey"),
        "orders_valor": orders.withColumn("o_totalprice", F.when(first, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))),
        "orders_texto_nulo": orders.withColumn("o_orderstatus", F.when(~first, F.col("o_orderstatus"))),
        "orders_repetida": orders.unionByName(one)}
    stored = {}
    for name, copy in copies.items():
        path = shared_folder(spark, name)
        tables.write_product(copy, path)
        stored[name] = tables.read_product(spark, path)
    source = tables.fingerprint(orders, "orders")
    names = F.explode(F.array(*[F.lit(n) for n in copies])).alias("fonte")
    manifest = source.select(names, "linhas", "soma_hash")
    return tables.check_manifest(tables.fingerprints(stored), manifest).select("fonte", "linhas")


@query("network_code_translation", B.with_ctes(f"""
SELECT ano, rede AS rede_texto, CASE rede {CODES} END AS rede, count(*) AS n FROM goals_mun GROUP BY ALL""", "goals_mun"))
def network_code_translation(spark, folder):
    goals = B.goals_municipal(spark, folder).withColumn("rede_texto", F.col("rede"))
    coded, _ = cleaning.translate_codes(goals, "rede", C.GOAL_NETWORK_CODES)
    return coded.groupBy("ano", "rede_texto", "rede").agg(F.count(F.lit(1)).alias("n"))


@query("unmapped_networks", B.with_ctes(f"""
SELECT DISTINCT rede FROM goals_mun WHERE rede IS NOT NULL AND CASE rede {CODES} END IS NULL""", "goals_mun"))
def unmapped_networks(spark, folder):
    return cleaning.translate_codes(B.goals_municipal(spark, folder), "rede", C.GOAL_NETWORK_CODES)[1]


OWN_GOAL = "CASE ano " + " ".join(f"WHEN {y} THEN meta_alfabetizacao_{y}" for y in B.GOAL_YEARS) + " END"


def state_sql(value: str, goal: str) -> str:
    return (f"CASE WHEN {goal} IS NULL THEN 'Sem meta' WHEN {value} IS NULL THEN 'Sem dado' "
            f"WHEN {value} >= {goal} THEN 'Atingida' ELSE 'Abaixo' END")


@query("goal_of_own_year", B.with_ctes(f"SELECT ano, id_municipio, rede, {OWN_GOAL} AS meta FROM goals_mun", "goals_mun"), ["meta"])
def goal_of_own_year(spark, folder):
    goals = B.goals_municipal(spark, folder)
    return goals.select("ano", "id_municipio", "rede", cleaning.value_of_own_year(goals.columns, "meta_alfabetizacao_").alias("meta"))


@query("goal_state_flags", B.with_ctes(f"""
SELECT ano, estado, count(*) AS n FROM (
  SELECT p.ano, {state_sql('p.taxa_alfabetizacao', 'g.meta')} AS estado FROM published_mun AS p LEFT JOIN (
    SELECT ano, id_municipio, {OWN_GOAL} AS meta FROM goals_mun) AS g ON p.ano = g.ano AND p.id_municipio = g.id_municipio) AS s
GROUP BY ALL""", "published_mun", "goals_mun"))
def goal_state_flags(spark, folder):
    goals = B.goals_municipal(spark, folder)
    own = goals.select("ano", "id_municipio", cleaning.value_of_own_year(goals.columns, "meta_alfabetizacao_").alias("meta"))
    joined = B.published_municipal(spark, folder).join(own, ["ano", "id_municipio"], "left")
    return joined.groupBy("ano", cleaning.goal_state("taxa_alfabetizacao", "meta").alias("estado")).agg(F.count(F.lit(1)).alias("n"))


def silver_tables(spark, folder):
    """The clean layer as the analysis layer reads it: labels and territory attached."""
    dims = {"municipio": B.territory(spark, folder).drop("codigo_uf")}
    results = B.published_municipal(spark, folder)
    results = results.withColumns({"rede_nome": cleaning.decode("rede", C.NETWORK_LABELS), "serie_nome": cleaning.decode("serie", C.GRADE_LABELS)})
    return {
        C.MUNICIPAL_RESULTS.name: medallion.enrich(results, "municipio", dims),
        C.STATE_RESULTS.name: B.published_state(spark, folder),
        C.STUDENTS.name: B.students(spark, folder),
        C.MUNICIPAL_GOALS.name: B.goals_municipal(spark, folder),
        C.STATE_GOALS.name: B.goals_state(spark, folder),
        C.COUNTRY_GOALS.name: B.goals_country(spark, folder),
    }


STUDENT_METRICS = f"""
SELECT ano, id_municipio, serie, code AS rede, count(*) AS alunos_total, sum(presenca)::BIGINT AS alunos_presentes,
       sum(alfabetizado)::BIGINT AS alunos_alfabetizados, {sql_round("avg(proficiencia)", 2)} AS proficiencia_media,
       {sql_round("CAST(sum(presenca) AS DOUBLE) / count(*) * 100", 2)} AS proporcao_presenca,
       CASE WHEN sum(presenca) > 0 THEN {sql_round("CAST(sum(alfabetizado) AS DOUBLE) / sum(presenca) * 100", 2)} END AS taxa_alfabetizacao_observada,
       CASE WHEN sum(CASE WHEN proficiencia IS NOT NULL THEN peso_aluno END) > 0 THEN
         {sql_round("sum(proficiencia * peso_aluno) / sum(CASE WHEN proficiencia IS NOT NULL THEN peso_aluno END)", 2)} END AS proficiencia_media_ponderada
FROM (SELECT *, rede AS code FROM students UNION ALL SELECT *, '5' FROM students WHERE rede IN ('2', '3')
      UNION ALL SELECT *, '0' FROM students) AS x GROUP BY 1, 2, 3, 4"""
GOALS_BY_CODE = "SELECT *, CASE rede {codes} END AS code, {own} AS meta FROM {src}"
GOLD_SQL = f"""
SELECT ano, id_municipio, nome_municipio, sigla_uf, nome_uf, nome_regiao, serie_nome, rede, rede_nome, alunos_total,
  alunos_presentes, alunos_alfabetizados, proporcao_presenca, taxa_alfabetizacao_observada, dif AS diferenca_taxa_observada_municipio_pp,
  CASE WHEN dif IS NULL THEN 'Sem dado' WHEN dif <= 5.0 THEN 'Consistente' ELSE 'Divergente' END AS consistencia_taxa_municipio,
  proficiencia_media, proficiencia_media_ponderada, taxa_alfabetizacao_municipio, media_portugues_municipio,
  meta_m AS meta_alfabetizacao_municipio, part_m AS percentual_participacao_municipio,
  {state_sql('taxa_alfabetizacao_municipio', 'meta_m')} AS meta_atingida_municipio,
  {state_sql('proporcao_presenca', 'part_m')} AS meta_atingida_presenca_municipio,
  taxa_alfabetizacao_uf, media_portugues_uf, meta_u AS meta_alfabetizacao_uf, part_u AS percentual_participacao_uf,
  {state_sql('taxa_alfabetizacao_uf', 'meta_u')} AS meta_atingida_uf,
  {state_sql('proporcao_presenca', 'part_u')} AS meta_atingida_presenca_uf,
  taxa_alfabetizacao_brasil, media_portugues_brasil, taxa_alfabetizacao_brasil_oficial, meta_b AS meta_alfabetizacao_brasil,
  part_b AS percentual_participacao_brasil, {state_sql('taxa_alfabetizacao_brasil_oficial', 'meta_b')} AS meta_atingida_brasil,
  {state_sql('proporcao_presenca', 'part_b')} AS meta_atingida_presenca_brasil
FROM (
  SELECT b.ano, b.id_municipio, t.nome_municipio, t.sigla_uf, t.nome_uf, t.nome_regiao, '2º ano do Ensino Fundamental' AS serie_nome,
    b.rede, CASE b.rede {LABELS} END AS rede_nome, a.* EXCLUDE (ano, id_municipio, serie, rede),
    b.taxa_alfabetizacao AS taxa_alfabetizacao_municipio, b.media_portugues AS media_portugues_municipio,
    abs(a.taxa_alfabetizacao_observada - b.taxa_alfabetizacao) AS dif, gm.meta AS meta_m, gm.percentual_participacao AS part_m,
    pu.taxa_alfabetizacao AS taxa_alfabetizacao_uf, pu.media_portugues AS media_portugues_uf, gu.meta AS meta_u,
    gu.percentual_participacao AS part_u, br.taxa_alfabetizacao_brasil, br.media_portugues_brasil,
    gb.taxa_alfabetizacao AS taxa_alfabetizacao_brasil_oficial, gb.meta AS meta_b, gb.percentual_participacao AS part_b
  FROM published_mun AS b LEFT JOIN territory AS t ON b.id_municipio = t.id_municipio
  LEFT JOIN ({STUDENT_METRICS}) AS a ON a.ano = b.ano AND a.id_municipio = b.id_municipio AND a.serie = b.serie AND a.rede = b.rede
  LEFT JOIN published_uf AS pu ON pu.ano = b.ano AND pu.sigla_uf = t.sigla_uf AND pu.serie = b.serie AND pu.rede = b.rede
  LEFT JOIN (SELECT ano, serie, rede, {sql_round("avg(taxa_alfabetizacao)", 2)} AS taxa_alfabetizacao_brasil,
      {sql_round("avg(media_portugues)", 2)} AS media_portugues_brasil FROM published_uf GROUP BY 1, 2, 3) AS br
    ON br.ano = b.ano AND br.serie = b.serie AND br.rede = b.rede
  LEFT JOIN ({GOALS_BY_CODE.format(codes=CODES, own=OWN_GOAL, src='goals_mun')}) AS gm ON gm.ano = b.ano AND gm.id_municipio = b.id_municipio AND gm.code = b.rede
  LEFT JOIN ({GOALS_BY_CODE.format(codes=CODES, own=OWN_GOAL, src='goals_uf')}) AS gu ON gu.ano = b.ano AND gu.sigla_uf = t.sigla_uf AND gu.code = b.rede
  LEFT JOIN ({GOALS_BY_CODE.format(codes=CODES, own=OWN_GOAL, src='goals_br')}) AS gb ON gb.ano = b.ano AND gb.code = b.rede
) AS u"""
GOLD_FLOATS = [c for c in C.GOLD_COLUMNS if c.startswith(("taxa", "media", "meta_alf", "percentual", "prop", "prof", "dif"))]
GOLD_CTES = ("students", "published_mun", "published_uf", "goals_mun", "goals_uf", "goals_br")


@query("gold_analysis_table", B.with_ctes(GOLD_SQL, *GOLD_CTES), GOLD_FLOATS)
def gold_analysis_table(spark, folder):
    return medallion.gold_analysis(silver_tables(spark, folder))


@query("gold_student_table", B.with_ctes(f"""
SELECT s.ano, id_aluno, id_escola, s.id_municipio, s.sigla_uf, nome_regiao, serie, s.rede, caderno, preenchimento_caderno,
  gm.meta AS meta_alfabetizacao_municipio, gm.percentual_participacao AS percentual_participacao_municipio,
  gu.meta AS meta_alfabetizacao_uf, gu.percentual_participacao AS percentual_participacao_uf,
  gb.meta AS meta_alfabetizacao_brasil, gb.percentual_participacao AS percentual_participacao_brasil, alfabetizado
FROM students AS s
LEFT JOIN ({GOALS_BY_CODE.format(codes=CODES, own=OWN_GOAL, src='goals_mun')}) AS gm ON gm.ano = s.ano AND gm.id_municipio = s.id_municipio AND gm.code = s.rede
LEFT JOIN ({GOALS_BY_CODE.format(codes=CODES, own=OWN_GOAL, src='goals_uf')}) AS gu ON gu.ano = s.ano AND gu.sigla_uf = s.sigla_uf AND s.rede IN ('2', '3') AND gu.code = '5'
LEFT JOIN ({GOALS_BY_CODE.format(codes=CODES, own=OWN_GOAL, src='goals_br')}) AS gb ON gb.ano = s.ano AND s.rede IN ('2', '3') AND gb.code = '5'
WHERE presenca = 1""", *GOLD_CTES), [c for c in C.GOLD_STUDENT_COLUMNS if c.startswith(("meta", "percentual"))])
def gold_student_table(spark, folder):
    return medallion.gold_students(silver_tables(spark, folder))


@query("consistency_divergence", B.with_ctes(f"""
SELECT count(d) AS avaliados, count(*) FILTER (WHERE d > 5.0) AS divergentes, 100.0 * count(*) FILTER (WHERE d > 5.0) / count(d) AS pct_divergente
FROM (SELECT diferenca_taxa_observada_municipio_pp AS d FROM ({GOLD_SQL}) AS g) AS x""", *GOLD_CTES), ["pct_divergente"])
def consistency_divergence(spark, folder):
    return quality.consistency_rate(gold_analysis_table(spark, folder), "diferenca_taxa_observada_municipio_pp")


@query("presence_filter_counts", B.with_ctes("""
SELECT count(*) AS total, count(*) FILTER (WHERE presenca = 1) AS mantidos, count(*) FILTER (WHERE presenca <> 1) AS descartados FROM students""", "students"))
def presence_filter_counts(spark, folder):
    return medallion.presence_counts(B.students(spark, folder))


DATASET_FLOATS = [
    "peso_aluno", "esc_taxa_alfab_lag1", "esc_taxa_presenca_lag1", "esc_prof_p25_lag1", "esc_prof_p50_lag1", "esc_prof_p75_lag1",
    "esc_prof_sd_lag1", "esc_prof_iqr_lag1", "mun_share_rede_estadual_lag1", "mun_taxa_presenca_lag1", "mun_prof_p25_lag1",
    "mun_prof_p50_lag1", "mun_prof_p75_lag1", "mun_prof_sd_lag1", "mun_prof_iqr_lag1", "mun_taxa_alfab_lag1",
    "mun_media_portugues_lag1", "mun_meta_2024_lag1", "uf_taxa_presenca_lag1", "uf_taxa_alfab_lag1", "uf_media_portugues_lag1",
    "esc_taxa_alfab_lag1_suav", "mun_desvio_vs_uf"]


@query("modelling_dataset", B.with_ctes("SELECT * FROM dataset", "dataset"), DATASET_FLOATS)
def modelling_dataset(spark, folder):
    """Cohort of the target year with school, municipal and state lags."""
    return B.dataset(spark, folder)


@query("model_matrix", B.with_ctes(
    f"SELECT row_id, id_municipio, peso_aluno, risco_nao_alfabetizacao, {', '.join(C.MODEL_FEATURES)} FROM dataset", "dataset"),
    [c for c in DATASET_FLOATS if c in C.MODEL_FEATURES or c == "peso_aluno"])
def model_matrix(spark, folder):
    return features.model_matrix(B.dataset(spark, folder))


@query("measured_cohort", B.with_ctes(f"""
SELECT id_aluno, id_escola, id_municipio, sigla_uf, nome_regiao, rede, caderno, alfabetizado, peso_aluno FROM unique_students
WHERE ano = {B.TARGET} AND presenca = 1 AND preenchimento_caderno = 1""", "unique_students"), ["peso_aluno"])
def measured_cohort(spark, folder):
    return features.cohort(B.unique_students(spark, folder), B.TARGET)


@query("lag_provenance_shares", B.with_ctes("""
SELECT fonte_lag_municipal, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS participacao FROM dataset GROUP BY 1""", "dataset"), ["participacao"])
def lag_provenance_shares(spark, folder):
    return features.history_share(B.dataset(spark, folder))


def lag_students(spark, folder):
    return B.two_years(spark, folder).where(F.col("ano") == B.LAG)


def store(spark, folder):
    return features.feature_store(
        B.two_years(spark, folder), B.published_municipal(spark, folder), B.published_state(spark, folder),
        B.goals_municipal(spark, folder), B.territory(spark, folder), B.LAG)


STORE = {
    "escola": lambda spark, folder: features.school_features(lag_students(spark, folder)),
    "municipio": lambda spark, folder: features.municipal_features(
        lag_students(spark, folder), B.published_municipal(spark, folder), B.goals_municipal(spark, folder), B.LAG),
    "uf": lambda spark, folder: features.state_features(
        lag_students(spark, folder), B.published_state(spark, folder), B.territory(spark, folder), B.LAG),
}


for _name, _key in (("escola", "id_escola"), ("municipio", "id_municipio"), ("uf", "sigla_uf")):
    _prefix = {"escola": "esc", "municipio": "mun", "uf": "uf"}[_name]

    @query(f"feature_store_{_name}", B.with_ctes(f"SELECT * FROM store_{_name}", f"store_{_name}"),
           [c for c in DATASET_FLOATS if c.startswith(_prefix) and not c.endswith(("_suav", "_vs_uf"))])
    def _feature_table(spark, folder, name=_name):
        return STORE[name](spark, folder)


@query("published_pivot_by_network", B.with_ctes("""
SELECT id_municipio, t5 AS taxa_alfabetizacao_r5, m5 AS media_portugues_r5, t3 AS taxa_alfabetizacao_r3, m3 AS media_portugues_r3 FROM piv_mun""", "piv_mun"),
    ["taxa_alfabetizacao_r5", "media_portugues_r5", "taxa_alfabetizacao_r3", "media_portugues_r3"])
def published_pivot_by_network(spark, folder):
    return aggregates.pivot_published(B.published_municipal(spark, folder), "id_municipio", B.LAG)
