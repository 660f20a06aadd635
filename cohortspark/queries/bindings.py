"""The cohort tables bound to the given star schema, as DataFrames and as SQL text.

A student row is a line item of an order; its municipality, state and region are the customer, nation
and region; its school is the supplier. The published results and the goals come from the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.stats import clip
from cohortspark.operators import quality
from cohortspark.plans import features
from cohortspark.queries.registry import sql_round
from cohortspark.session import materialize

LAG, TARGET = 1999, 2000
CUT = 35000.0
GOAL_YEARS = tuple(range(2000, 2007))
LEVELS = tuple(f"proporcao_aluno_nivel_{i}" for i in range(9))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def territory(spark: SparkSession, folder: str) -> DataFrame:
    c, n, r = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    places = n.join(r, n.n_regionkey == r.r_regionkey)
    return c.join(places, c.c_nationkey == places.n_nationkey).select(
        F.col("c_custkey").alias("id_municipio"), F.col("c_name").alias("nome_municipio"),
        F.col("n_name").alias("sigla_uf"), F.col("n_name").alias("nome_uf"), F.col("r_name").alias("nome_regiao"),
        F.col("n_nationkey").alias("codigo_uf"))


def students(spark: SparkSession, folder: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Row grain, all years or those from the first to the last given, absentees included."""
    line, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    if years:  # a range of dates is pushed to the scan, a function of the date is not
        line = line.where((F.col("l_shipdate") >= F.lit(f"{years[0]}-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(f"{years[1] + 1}-01-01").cast("timestamp_ntz")))
    here = F.col("l_linestatus") == "F"
    measured = here & ~((F.col("l_tax") > 0.075) & (F.col("l_quantity") <= 5))
    score = F.when(measured, F.floor("l_extendedprice").cast("double") + ((F.col("o_custkey") * 7919) % 101 - 50) * 1000)
    places = territory(spark, folder).select("id_municipio", "sigla_uf", "nome_regiao", "codigo_uf")
    # orders meet their territory first, so that the line items are shuffled once only
    placed = orders.select("o_orderkey", "o_custkey").join(places, F.col("o_custkey") == F.col("id_municipio"))
    return line.join(placed, line.l_orderkey == placed.o_orderkey).select(
        F.year("l_shipdate").alias("ano"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id_aluno"),
        F.col("l_suppkey").alias("id_escola"), "id_municipio",
        F.when(F.col("l_returnflag") == "A", "2").when(F.col("l_returnflag") == "N", "3").otherwise("4").alias("rede"),
        F.lit("2").alias("serie"), F.col("l_linenumber").alias("caderno"), here.cast("int").alias("presenca"),
        measured.cast("int").alias("preenchimento_caderno"),
        F.coalesce((score >= CUT).cast("int"), F.lit(0)).alias("alfabetizado"), score.alias("proficiencia"),
        F.when(here, F.col("l_quantity")).alias("peso_aluno"), "sigla_uf", "nome_regiao", "codigo_uf")


PAYLOAD = ("id_escola", "id_municipio", "rede", "serie", "caderno", "presenca", "preenchimento_caderno",
           "alfabetizado", "proficiencia", "peso_aluno", "sigla_uf", "nome_regiao", "codigo_uf")


#: The student first: rows are sorted by it, which hardly ever ties, instead of by one of two years.
STUDENT_KEYS = ["id_aluno", "ano"]


def unique_students(spark: SparkSession, folder: str) -> DataFrame:
    """One row per year and student: the smallest payload survives."""
    return quality.deduplicate(students(spark, folder).select("ano", "id_aluno", *PAYLOAD), STUDENT_KEYS)


_BUILT: dict[tuple[str, str], DataFrame] = {}


def two_years(spark: SparkSession, folder: str) -> DataFrame:
    """Unique students of the lag and the target year, a stored product: evaluated once per application and folder, then reread."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _BUILT:
        rows = students(spark, folder, (LAG, TARGET)).where(F.col("ano").isin(LAG, TARGET)).select("ano", "id_aluno", *PAYLOAD)
        _BUILT[key] = materialize(quality.deduplicate(rows, STUDENT_KEYS))
    return _BUILT[key]


def _order_units(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        F.year("o_orderdate").alias("ano"), F.col("o_custkey").alias("id_municipio"), F.floor("o_totalprice").cast("double").alias("v"),
        "o_orderpriority")
    if "sigla_uf" in keys:
        orders = orders.join(territory(spark, folder).select("id_municipio", "sigla_uf"), "id_municipio")
    band = F.least(F.floor(F.col("v") / 60000), F.lit(8))
    return orders.groupBy("ano", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.max(F.col("o_orderpriority") == "5-LOW").alias("low"), F.max(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        *[(F.count_if(band == i) / F.count(F.lit(1))).alias(c) for i, c in enumerate(LEVELS)])


def _published(units: DataFrame, key: str) -> DataFrame:
    five = F.when(F.col("n") >= 2, F.struct(F.lit("5").alias("rede"), F.lit(16.0).alias("b")))
    three = F.struct(F.lit("3").alias("rede"), F.lit(15.0).alias("b"))
    long = units.select("ano", key, "n", "m", "low", *LEVELS, F.explode(F.array_compact(F.array(five, three))).alias("p"))
    gone = (F.col("n") == 1) & F.col("low")
    return long.select(
        "ano", key, F.lit("2").alias("serie"), F.col("p.rede").alias("rede"),
        F.when(~gone, F.round(F.col("p.b") + F.col("m") / 10000, 2)).alias("taxa_alfabetizacao"),
        F.round(F.lit(600.0) + F.col("m") / 2000, 2).alias("media_portugues"), *LEVELS)


def published_municipal(spark: SparkSession, folder: str) -> DataFrame:
    return _published(_order_units(spark, folder, "id_municipio"), "id_municipio")


def published_state(spark: SparkSession, folder: str) -> DataFrame:
    return _published(_order_units(spark, folder, "sigla_uf"), "sigla_uf")


def _goals(units: DataFrame, keys: list[str], network) -> DataFrame:
    base = units.select(
        "ano", *keys, network.alias("rede"), F.round(15.0 + F.col("m") / 10000, 2).alias("taxa_alfabetizacao"),
        F.least(F.lit(60.0) + F.col("n") * 5.0, F.lit(100.0)).alias("percentual_participacao"),
        (F.floor(F.col("m") / 120000) + 1).cast("int").alias("nivel_alfabetizacao"))
    rate = F.col("taxa_alfabetizacao")
    return base.select("*", *[
        F.round(rate + (80 - rate) * (i / 6), 2).alias(f"meta_alfabetizacao_{y}") for i, y in enumerate(GOAL_YEARS)])


def goals_municipal(spark: SparkSession, folder: str) -> DataFrame:
    network = F.when((F.col("n") == 1) & F.col("urgent"), "Comunitária").otherwise("Municipal")
    return _goals(_order_units(spark, folder, "id_municipio"), ["id_municipio"], network)


def goals_state(spark: SparkSession, folder: str) -> DataFrame:
    return _goals(_order_units(spark, folder, "sigla_uf"), ["sigla_uf"], F.lit("Pública")).drop("nivel_alfabetizacao")


def goals_country(spark: SparkSession, folder: str) -> DataFrame:
    return _goals(_order_units(spark, folder), [], F.lit("Pública")).drop("nivel_alfabetizacao")


def dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Modelling dataset of the target year; ``row_id`` is the student."""
    rows = two_years(spark, folder).drop("codigo_uf").withColumn("row_id", F.col("id_aluno"))
    return features.modelling_dataset(
        rows, published_municipal(spark, folder), published_state(spark, folder), goals_municipal(spark, folder),
        territory(spark, folder), TARGET)


def scored(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """Measured students of the target year with a lag-only score: the smoothed risk of their municipality."""
    rows = (two_years(spark, folder) if rows is None else rows).where(F.col("preenchimento_caderno") == 1)
    lag = rows.where(F.col("ano") == LAG).groupBy("id_municipio").agg(
        F.count(F.lit(1)).alias("n_lag"), F.sum(1 - F.col("alfabetizado")).alias("k_lag"))
    now = rows.where(F.col("ano") == TARGET).join(lag, "id_municipio", "left")
    n, k = F.coalesce("n_lag", F.lit(0)), F.coalesce("k_lag", F.lit(0))
    return now.select(
        F.col("id_aluno").alias("row_id"), "id_municipio", "id_escola", "sigla_uf", "nome_regiao", "rede", "caderno",
        (1 - F.col("alfabetizado")).alias("y"), ((k + 2.5) / (n + 5)).alias("p"), "peso_aluno", n.alias("n_lag"),
        clip(F.col("proficiencia") / 100000, 0.0, 1.0).alias("p_alt"))


# --- the same tables as SQL text -------------------------------------------------------------------
def _goal_columns() -> str:
    return ", ".join(
        sql_round(f"taxa_alfabetizacao + (80 - taxa_alfabetizacao) * {i / 6!r}::DOUBLE", 2) + f" AS meta_alfabetizacao_{y}"
        for i, y in enumerate(GOAL_YEARS))


def _level_columns() -> str:
    return ", ".join(
        f"CAST(count(*) FILTER (WHERE least(floor(floor(o_totalprice) / 60000), 8) = {i}) AS DOUBLE) / count(*) AS {c}"
        for i, c in enumerate(LEVELS))


def _units_sql(key: str) -> str:
    head = f", {key}" if key else ""
    return (f"SELECT CAST(year(o_orderdate) AS INTEGER) AS ano{head}, count(*) AS n, avg(floor(o_totalprice)) AS m, "
            f"max(o_orderpriority) AS pr, {_level_columns()} FROM orders JOIN territory ON o_custkey = id_municipio "
            f"GROUP BY 1{', 2' if key else ''}")


def _published_sql(source: str, key: str) -> str:
    levels = ", ".join(LEVELS)
    one = ("SELECT ano, {k}, '2' AS serie, '{code}' AS rede, CASE WHEN NOT (n = 1 AND pr = '5-LOW') THEN "
           + sql_round("{b} + m / 10000", 2) + " END AS taxa_alfabetizacao, " + sql_round("600.0::DOUBLE + m / 2000", 2)
           + " AS media_portugues, {l} FROM {s}{w}")
    return (one.format(k=key, code="5", b="16.0::DOUBLE", l=levels, s=source, w=" WHERE n >= 2") + " UNION ALL "
            + one.format(k=key, code="3", b="15.0::DOUBLE", l=levels, s=source, w=""))


def _goals_sql(source: str, key: str, network: str, level: bool) -> str:
    keys = f"{key}, " if key else ""
    drop = ", nivel_alfabetizacao" if level else ""
    return (f"SELECT ano, {keys}rede, taxa_alfabetizacao, percentual_participacao{drop}, {_goal_columns()} FROM ("
            f"SELECT ano, {keys}{network} AS rede, {sql_round('15.0::DOUBLE + m / 10000', 2)} AS taxa_alfabetizacao, "
            f"least(60.0::DOUBLE + n * 5.0::DOUBLE, 100.0::DOUBLE) AS percentual_participacao, "
            f"CAST(floor(m / 120000) + 1 AS INTEGER) AS nivel_alfabetizacao FROM {source}) AS g")


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "territory": ((), """
SELECT c_custkey AS id_municipio, c_name AS nome_municipio, n_name AS sigla_uf, n_name AS nome_uf,
       r_name AS nome_regiao, n_nationkey AS codigo_uf
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "students": (("territory",), f"""
SELECT ano, id_aluno, id_escola, s.id_municipio, rede, serie, caderno, presenca, preenchimento_caderno,
       CAST(CASE WHEN proficiencia >= {CUT} THEN 1 ELSE 0 END AS INTEGER) AS alfabetizado, proficiencia, peso_aluno,
       sigla_uf, nome_regiao, codigo_uf
FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS ano, l_orderkey * 10 + l_linenumber AS id_aluno, l_suppkey AS id_escola,
        o_custkey AS id_municipio, CASE l_returnflag WHEN 'A' THEN '2' WHEN 'N' THEN '3' ELSE '4' END AS rede,
        '2' AS serie, l_linenumber AS caderno, CAST(l_linestatus = 'F' AS INTEGER) AS presenca,
        CAST(l_linestatus = 'F' AND NOT (l_tax > 0.075 AND l_quantity <= 5) AS INTEGER) AS preenchimento_caderno,
        CASE WHEN l_linestatus = 'F' AND NOT (l_tax > 0.075 AND l_quantity <= 5)
             THEN floor(l_extendedprice) + ((o_custkey * 7919) % 101 - 50) * 1000 END AS proficiencia,
        CASE WHEN l_linestatus = 'F' THEN l_quantity END AS peso_aluno
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS s
JOIN territory USING (id_municipio)"""),
    "unique_students": (("students",), f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY ano, id_aluno ORDER BY {', '.join(f'{c} NULLS FIRST' for c in PAYLOAD)}) AS rn
  FROM students) AS d WHERE rn = 1"""),
    "units_mun": (("territory",), _units_sql("id_municipio")),
    "units_uf": (("territory",), _units_sql("sigla_uf")),
    "units_all": (("territory",), _units_sql("")),
    "published_mun": (("units_mun",), _published_sql("units_mun", "id_municipio")),
    "published_uf": (("units_uf",), _published_sql("units_uf", "sigla_uf")),
    "goals_mun": (("units_mun",), _goals_sql(
        "units_mun", "id_municipio", "CASE WHEN n = 1 AND pr = '1-URGENT' THEN 'Comunitária' ELSE 'Municipal' END", True)),
    "goals_uf": (("units_uf",), _goals_sql("units_uf", "sigla_uf", "'Pública'", False)),
    "goals_br": (("units_all",), _goals_sql("units_all", "", "'Pública'", False)),
    "lag_students": (("unique_students",), f"SELECT * FROM unique_students WHERE ano = {LAG}"),
    "store_escola": (("lag_students",), """
SELECT id_escola, count(*) FILTER (WHERE presenca = 1) AS esc_n_alunos_lag1,
       avg(alfabetizado) FILTER (WHERE presenca = 1) AS esc_taxa_alfab_lag1,
       avg(presenca) AS esc_taxa_presenca_lag1, count(*) AS esc_n_matriculados_lag1,
       quantile_cont(proficiencia, 0.25) AS esc_prof_p25_lag1, quantile_cont(proficiencia, 0.5) AS esc_prof_p50_lag1,
       quantile_cont(proficiencia, 0.75) AS esc_prof_p75_lag1, stddev_samp(proficiencia) AS esc_prof_sd_lag1,
       quantile_cont(proficiencia, 0.75) - quantile_cont(proficiencia, 0.25) AS esc_prof_iqr_lag1
FROM lag_students GROUP BY 1 HAVING count(*) FILTER (WHERE presenca = 1) > 0"""),
    "piv_mun": (("published_mun",), f"""
SELECT id_municipio, max(taxa_alfabetizacao) FILTER (WHERE rede = '5') AS t5, max(taxa_alfabetizacao) FILTER (WHERE rede = '3') AS t3,
       max(media_portugues) FILTER (WHERE rede = '5') AS m5, max(media_portugues) FILTER (WHERE rede = '3') AS m3
FROM published_mun WHERE ano = {LAG} GROUP BY 1"""),
    "piv_uf": (("published_uf",), f"""
SELECT sigla_uf, max(taxa_alfabetizacao) FILTER (WHERE rede = '5') AS t5, max(taxa_alfabetizacao) FILTER (WHERE rede = '3') AS t3,
       max(media_portugues) FILTER (WHERE rede = '5') AS m5, max(media_portugues) FILTER (WHERE rede = '3') AS m3
FROM published_uf WHERE ano = {LAG} GROUP BY 1"""),
    "store_municipio": (("lag_students", "piv_mun", "goals_mun"), f"""
SELECT id_municipio, mun_n_alunos_lag1, mun_n_escolas_lag1, mun_share_rede_estadual_lag1, mun_taxa_presenca_lag1,
       mun_n_matriculados_lag1, mun_prof_p25_lag1, mun_prof_p50_lag1, mun_prof_p75_lag1, mun_prof_sd_lag1,
       mun_prof_p75_lag1 - mun_prof_p25_lag1 AS mun_prof_iqr_lag1,
       coalesce(gold * 100, t5, t3) AS mun_taxa_alfab_lag1, coalesce(m5, m3) AS mun_media_portugues_lag1,
       CASE WHEN gold IS NOT NULL THEN 'gold' WHEN t5 IS NOT NULL THEN 'agregado_r5' WHEN t3 IS NOT NULL THEN 'agregado_r3'
            ELSE 'sem_historico' END AS fonte_lag_municipal,
       meta_alfabetizacao_{TARGET} AS mun_meta_2024_lag1, nivel_alfabetizacao AS mun_nivel_alfabetizacao_lag1
FROM (SELECT id_municipio, count(*) FILTER (WHERE presenca = 1) AS mun_n_alunos_lag1,
        count(DISTINCT id_escola) FILTER (WHERE presenca = 1) AS mun_n_escolas_lag1,
        avg(CAST(rede = '2' AS INTEGER)) FILTER (WHERE presenca = 1) AS mun_share_rede_estadual_lag1,
        sum(alfabetizado * peso_aluno) / sum(peso_aluno) AS gold, avg(presenca) AS mun_taxa_presenca_lag1,
        count(*) AS mun_n_matriculados_lag1, quantile_cont(proficiencia, 0.25) AS mun_prof_p25_lag1,
        quantile_cont(proficiencia, 0.5) AS mun_prof_p50_lag1, quantile_cont(proficiencia, 0.75) AS mun_prof_p75_lag1,
        stddev_samp(proficiencia) AS mun_prof_sd_lag1
      FROM lag_students GROUP BY 1 HAVING count(*) FILTER (WHERE presenca = 1) > 0) AS b
FULL JOIN piv_mun USING (id_municipio)
LEFT JOIN (SELECT * FROM goals_mun WHERE ano = {LAG}) AS g USING (id_municipio)"""),
    "store_uf": (("lag_students", "piv_uf"), """
SELECT sigla_uf, uf_n_alunos_lag1, uf_taxa_presenca_lag1, uf_n_matriculados_lag1,
       coalesce(gold * 100, t5, t3) AS uf_taxa_alfab_lag1, coalesce(m5, m3) AS uf_media_portugues_lag1,
       CASE WHEN gold IS NOT NULL THEN 'gold' WHEN t5 IS NOT NULL THEN 'agregado_r5' WHEN t3 IS NOT NULL THEN 'agregado_r3'
            ELSE 'sem_historico' END AS fonte_lag_uf
FROM (SELECT sigla_uf, count(*) FILTER (WHERE presenca = 1) AS uf_n_alunos_lag1,
        sum(alfabetizado * peso_aluno) / sum(peso_aluno) AS gold, avg(presenca) AS uf_taxa_presenca_lag1,
        count(*) AS uf_n_matriculados_lag1
      FROM lag_students GROUP BY 1 HAVING count(*) FILTER (WHERE presenca = 1) > 0) AS b
FULL JOIN piv_uf USING (sigla_uf)"""),
    "dataset": (("unique_students", "store_escola", "store_municipio", "store_uf"), f"""
SELECT * EXCLUDE (id_escola, rede, alfabetizado, fonte_m, fonte_u),
       1 - alfabetizado AS risco_nao_alfabetizacao,
       CAST(esc_taxa_alfab_lag1 IS NOT NULL AS INTEGER) AS tem_historico_escola,
       CAST(coalesce(fonte_m, '') = 'gold' AS INTEGER) AS tem_historico_municipio,
       coalesce(fonte_m, 'sem_historico') AS fonte_lag_municipal, coalesce(fonte_u, 'sem_historico') AS fonte_lag_uf,
       (coalesce(esc_taxa_alfab_lag1 * 100, mun_taxa_alfab_lag1) * coalesce(esc_n_alunos_lag1, 0) + mun_taxa_alfab_lag1 * 30)
         / (coalesce(esc_n_alunos_lag1, 0) + 30) AS esc_taxa_alfab_lag1_suav,
       mun_taxa_alfab_lag1 - uf_taxa_alfab_lag1 AS mun_desvio_vs_uf,
       CASE rede WHEN '2' THEN 'Estadual' WHEN '3' THEN 'Municipal' ELSE 'Outros' END AS rede_grupo
FROM (SELECT id_aluno AS row_id, id_escola, id_municipio, sigla_uf, nome_regiao, rede, caderno, alfabetizado, peso_aluno
      FROM unique_students WHERE ano = {TARGET} AND presenca = 1 AND preenchimento_caderno = 1) AS c
LEFT JOIN store_escola USING (id_escola)
LEFT JOIN (SELECT * EXCLUDE (fonte_lag_municipal), fonte_lag_municipal AS fonte_m FROM store_municipio) AS m USING (id_municipio)
LEFT JOIN (SELECT * EXCLUDE (fonte_lag_uf), fonte_lag_uf AS fonte_u FROM store_uf) AS u USING (sigla_uf)"""),
    "scored": (("unique_students",), f"""
SELECT id_aluno AS row_id, id_municipio, id_escola, sigla_uf, nome_regiao, rede, caderno, 1 - alfabetizado AS y,
       (coalesce(k_lag, 0) + 2.5::DOUBLE) / (coalesce(n_lag, 0) + 5) AS p, peso_aluno, coalesce(n_lag, 0) AS n_lag,
       least(greatest(proficiencia / 100000, 0.0::DOUBLE), 1.0::DOUBLE) AS p_alt
FROM unique_students LEFT JOIN (
  SELECT id_municipio, count(*) AS n_lag, sum(1 - alfabetizado)::BIGINT AS k_lag FROM unique_students
  WHERE ano = {LAG} AND preenchimento_caderno = 1 GROUP BY 1) AS lag USING (id_municipio)
WHERE ano = {TARGET} AND preenchimento_caderno = 1"""),
    "ranked": (("scored",), """
SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM scored"""),
    # score table of the evaluation queries: cumulative counts from the highest score down
    "hist": (("scored",), """
SELECT p, n_pos, n_neg, sum(n_pos) OVER w AS tp, sum(n_neg) OVER w AS fp, sum(n_pos) OVER () AS pos, sum(n_neg) OVER () AS neg
FROM (SELECT p, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM scored GROUP BY p) AS h
WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)"""),
}


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a SELECT with the named table definitions and everything they need."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        needs, text = CTES[name]
        for n in needs:
            add(n)
        ordered.setdefault(name, text)

    for n in names:
        add(n)
    ordered.update(extra or {})
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in ordered.items()) + "\n" + body
