"""Raw → clean → analysis layers. Transformations are pure; actions happen at gates and sinks only."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark import contracts as C
from cohortspark.functions import cleaning
from cohortspark.operators import aggregates, quality
from cohortspark.sources import tables

log = logging.getLogger(__name__)
Tables = Mapping[str, DataFrame]


# --- raw layer -------------------------------------------------------------------------------------
def to_bronze(raw: DataFrame, entity: C.Entity, source: str = "landing", now: datetime | None = None) -> DataFrame:
    technical = [c for c in raw.columns if c.startswith("_bronze")]
    named = cleaning.rename_ascii(raw.drop(*technical))
    if technical:
        named = cleaning.rename_ascii(raw, keep_technical=True)
    return named.withColumns(cleaning.audit_columns("bronze", entity.name, source, now))


def run_bronze(spark: SparkSession, landing: str, schema: str, entities: Sequence[C.Entity] = C.RAW_ENTITIES) -> list[str]:
    """Ingest every entity whose file exists; an absent file is skipped, an error stops the run."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    written = []
    for entity in entities:
        raw = tables.read_landing(spark, landing, entity)
        if raw is not None:
            tables.save_table(to_bronze(raw, entity), f"{schema}.{entity.name}", entity.output_files)
            written.append(entity.name)
    return written


# --- clean layer -----------------------------------------------------------------------------------
def state_dimension(directory: DataFrame) -> DataFrame:
    rows = directory.select(F.trim("sigla").alias("sigla_uf"), F.trim("nome").alias("nome_uf"), F.trim("regiao").alias("nome_regiao"))
    return quality.deduplicate(rows, ["sigla_uf"])


def municipal_dimension(directory: DataFrame) -> DataFrame:
    rows = directory.select(
        F.trim(F.col("id_municipio").cast("string")).alias("id_municipio"), F.trim("nome").alias("nome_municipio"),
        *[F.trim(c).alias(c) for c in ("sigla_uf", "nome_uf", "nome_regiao")])
    return quality.deduplicate(rows, ["id_municipio"])


def enrich(df: DataFrame, dimension: str | None, dims: Tables) -> DataFrame:
    """Left join to the territory dimension; its size decides the strategy at run time."""
    key = {"uf": "sigla_uf", "municipio": "id_municipio"}.get(dimension or "")
    if key is None or key not in df.columns:
        return df
    dim = dims[dimension]
    return df.join(dim.select(key, *[c for c in dim.columns if c != key and c not in df.columns]), key, "left")


def clean(df: DataFrame, entity: C.Entity) -> DataFrame:
    """Names, blanks, types and labels."""
    df = cleaning.apply_types(cleaning.blank_to_null(cleaning.rename_ascii(df, keep_technical=True)), entity)
    labels = {"rede": ("rede_nome", C.NETWORK_LABELS), "serie": ("serie_nome", C.GRADE_LABELS)}
    return df.withColumns({out: cleaning.decode(c, m) for c, (out, m) in labels.items() if c in df.columns})


def to_silver(bronze: DataFrame, entity: C.Entity, dims: Tables, now: datetime | None = None, surplus: str | None = None) -> DataFrame:
    unique = quality.deduplicate(clean(bronze, entity), entity.keys, surplus)
    return enrich(unique, entity.dimension, dims).withColumns(cleaning.audit_columns("silver", entity.name, "bronze", now))


def run_silver(spark: SparkSession, source: str, target: str, entities: Sequence[C.Entity] = C.CLEAN_ENTITIES,
               max_null_pct: float = C.MAX_CRITICAL_NULL_PCT, max_orphan_pct: float = C.MAX_ORPHAN_PCT) -> dict[str, quality.QualityReport]:
    """Each entity is evaluated once: the gates read what the write of the staged table has measured, and a table that fails
    them never takes the place of the published one."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {target}")
    raw = tables.load_tables(spark, source, [e.name for e in C.RAW_ENTITIES], ["dim_uf", "dim_municipio"])
    dims = {"uf": state_dimension(raw["dim_uf"]), "municipio": municipal_dimension(raw["dim_municipio"])}
    reports = {}
    for entity in entities:
        if entity.name not in raw:
            continue
        table = f"{target}.{entity.name}"
        staged = tables.staged_name(table)
        silver = to_silver(raw[entity.name], entity, dims, surplus="_surplus")
        silver, seen = quality.observed(silver, entity.critical, entity.dimension, "_surplus")
        try:
            tables.save_table(silver.drop("_surplus"), staged, entity.output_files)
            reports[entity.name] = quality.report_of(seen.get, entity.critical)
            quality.enforce(reports[entity.name], entity.name, max_null_pct, max_orphan_pct)
        except Exception:
            spark.sql(f"DROP TABLE IF EXISTS {staged}")
            raise
        tables.publish(spark, table, staged)
    return reports


# --- analysis layer --------------------------------------------------------------------------------
def coded_goals(goals: DataFrame, keys: Sequence[str], level: str, extra: Mapping[str, str] | None = None) -> DataFrame:
    """Goals at the grain of the join: text network to code, the goal of the row's own year."""
    coded, _ = cleaning.translate_codes(goals, "rede", C.GOAL_NETWORK_CODES)
    return coded.select(
        *keys, cleaning.value_of_own_year(goals.columns, "meta_alfabetizacao_").alias(f"meta_alfabetizacao_{level}"),
        F.col("percentual_participacao").alias(f"percentual_participacao_{level}"),
        *[F.col(c).alias(a) for c, a in (extra or {}).items()])


def gold_analysis(t: Tables) -> DataFrame:
    """Municipal results beside student, state and country measures and the goals of their year."""
    base = t[C.MUNICIPAL_RESULTS.name].select(
        "ano", "id_municipio", "nome_municipio", "sigla_uf", "nome_uf", "nome_regiao", "serie", "serie_nome", "rede", "rede_nome",
        F.col("taxa_alfabetizacao").alias("taxa_alfabetizacao_municipio"), F.col("media_portugues").alias("media_portugues_municipio"))
    states = t[C.STATE_RESULTS.name]
    cell = ["serie", "rede"]
    if C.STUDENTS.name in t:
        base = base.join(aggregates.student_metrics(t[C.STUDENTS.name]), ["ano", "id_municipio", *cell], "left")
    base = base.join(states.select(
        "ano", "sigla_uf", *cell, F.col("taxa_alfabetizacao").alias("taxa_alfabetizacao_uf"),
        F.col("media_portugues").alias("media_portugues_uf")), ["ano", "sigla_uf", *cell], "left")
    base = base.join(aggregates.country_means(states), ["ano", *cell], "left")
    goal_tables = (
        (C.MUNICIPAL_GOALS.name, ["ano", "id_municipio", "rede"], "municipio", None),
        (C.STATE_GOALS.name, ["ano", "sigla_uf", "rede"], "uf", None),
        (C.COUNTRY_GOALS.name, ["ano", "rede"], "brasil", {"taxa_alfabetizacao": "taxa_alfabetizacao_brasil_oficial"}),
    )
    for name, keys, level, extra in goal_tables:
        if name in t:
            base = base.join(coded_goals(t[name], keys, level, extra), keys, "left")
    flags = {}
    for level, rate in (("municipio", "taxa_alfabetizacao_municipio"), ("uf", "taxa_alfabetizacao_uf"), ("brasil", "taxa_alfabetizacao_brasil_oficial")):
        for flag, value, goal in (
            (f"meta_atingida_{level}", rate, f"meta_alfabetizacao_{level}"),
            (f"meta_atingida_presenca_{level}", "proporcao_presenca", f"percentual_participacao_{level}"),
        ):
            if value in base.columns and goal in base.columns:
                flags[flag] = cleaning.goal_state(value, goal)
    base = base.withColumns(flags)
    if "taxa_alfabetizacao_observada" in base.columns:
        difference = "diferenca_taxa_observada_municipio_pp"
        base = base.withColumn(difference, F.abs(F.col("taxa_alfabetizacao_observada") - F.col("taxa_alfabetizacao_municipio")))
        base = base.withColumn("consistencia_taxa_municipio", cleaning.consistency_state(difference, C.CONSISTENCY_TOLERANCE_PP))
    return cleaning.select_existing(base, C.GOLD_COLUMNS)


def gold_students(t: Tables) -> DataFrame:
    """One row per present student with goals of its municipality, state and country; no score, no weight."""
    if C.STUDENTS.name not in t:
        raise tables.MissingInput("the student table is missing, the student product cannot be built")
    base = t[C.STUDENTS.name].where(F.col("presenca") == 1)
    if C.MUNICIPAL_GOALS.name in t:
        keys = ["ano", "id_municipio", "rede"]
        base = base.join(coded_goals(t[C.MUNICIPAL_GOALS.name], keys, "municipio"), keys, "left")
    public = F.when(F.col("rede").isin(*C.PUBLIC_NETWORKS), F.lit(C.PUBLIC_CODE))
    for name, keys, level in ((C.STATE_GOALS.name, ["ano", "sigla_uf"], "uf"), (C.COUNTRY_GOALS.name, ["ano"], "brasil")):
        if name in t:
            goals = coded_goals(t[name], [*keys, "rede"], level).withColumnsRenamed({c: f"_{level}_{c}" for c in [*keys, "rede"]})
            condition = public == F.col(f"_{level}_rede")
            for k in keys:
                condition = condition & (F.col(k) == F.col(f"_{level}_{k}"))
            base = base.join(goals, condition, "left").drop(*[f"_{level}_{c}" for c in [*keys, "rede"]])
    return cleaning.select_existing(base, C.GOLD_STUDENT_COLUMNS)


def presence_counts(students: DataFrame) -> DataFrame:
    """Rows kept and dropped by the presence filter."""
    return students.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("presenca") == 1).alias("mantidos"),
        (F.count(F.lit(1)) - F.count_if(F.col("presenca") == 1)).alias("descartados"))


def run_gold(spark: SparkSession, source: str, target: str, analysis: str = "analise", students: str = "ml_aluno") -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {target}")
    silver = tables.load_tables(spark, source, [e.name for e in C.CLEAN_ENTITIES], C.REQUIRED_FOR_GOLD)
    audit = cleaning.gold_audit_columns(target)
    tables.save_table(gold_analysis(silver).withColumns(audit), f"{target}.{analysis}")
    if C.STUDENTS.name in silver:
        tables.save_table(gold_students(silver).withColumns(audit), f"{target}.{students}")
