"""Temporal feature store (sources of the lag year only) and the modelling dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark import contracts as C
from cohortspark.functions import cleaning
from cohortspark.functions.stats import share, weighted_mean
from cohortspark.operators import aggregates, profile, quality


COHORT_COLUMNS = ("row_id", "id_aluno", "id_escola", "id_municipio", "sigla_uf", "nome_regiao", "rede", "caderno",
                  "alfabetizado", C.WEIGHT)


def coalesce_sources(base: DataFrame, prefix: str, gold_rate: str) -> DataFrame:
    """Own cohort (fraction → percent), then network 5, then network 3, with the provenance beside."""
    rate, label = cleaning.first_available({
        C.SOURCE_GOLD: F.col(gold_rate) * 100, C.SOURCE_R5: F.col("taxa_alfabetizacao_r5"),
        C.SOURCE_R3: F.col("taxa_alfabetizacao_r3")}, C.SOURCE_NONE)
    out = "fonte_lag_municipal" if prefix == "mun" else f"fonte_lag_{prefix}"
    return base.withColumns({
        f"{prefix}_taxa_alfab_lag1": rate, out: label,
        f"{prefix}_media_portugues_lag1": F.coalesce("media_portugues_r5", "media_portugues_r3"),
    }).drop(gold_rate, "taxa_alfabetizacao_r5", "taxa_alfabetizacao_r3", "media_portugues_r5", "media_portugues_r3")


def school_features(students: DataFrame) -> DataFrame:
    """Aggregates per school id of the lag year (a declared negative control: the id is recycled)."""
    here = aggregates.present()
    base = students.groupBy("id_escola").agg(
        F.count_if(here).alias("esc_n_alunos_lag1"), F.avg(F.when(here, F.col("alfabetizado"))).alias("esc_taxa_alfab_lag1"),
        F.avg("presenca").alias("esc_taxa_presenca_lag1"), F.count(F.lit(1)).alias("esc_n_matriculados_lag1"))
    return base.where(F.col("esc_n_alunos_lag1") > 0).join(
        aggregates.distribution_shape(students, "id_escola", "esc"), "id_escola", "left")


def municipal_rates(students: DataFrame, published: DataFrame, year: int) -> DataFrame:
    """Own aggregates ∪ published aggregates with the coalesced rate and its provenance."""
    here = aggregates.present()
    base = students.groupBy("id_municipio").agg(
        F.count_if(here).alias("mun_n_alunos_lag1"),
        F.count_distinct(F.when(here, F.col("id_escola"))).alias("mun_n_escolas_lag1"),
        F.avg(F.when(here, (F.col("rede") == "2").cast("double"))).alias("mun_share_rede_estadual_lag1"),
        weighted_mean(F.when(here, F.col("alfabetizado")), F.col("peso_aluno")).alias("_gold"),
        F.avg("presenca").alias("mun_taxa_presenca_lag1"), F.count(F.lit(1)).alias("mun_n_matriculados_lag1"),
    ).where(F.col("mun_n_alunos_lag1") > 0)
    base = base.join(aggregates.pivot_published(published, "id_municipio", year), "id_municipio", "full_outer")
    return coalesce_sources(base, "mun", "_gold")


def municipal_features(students: DataFrame, published: DataFrame, goals: DataFrame, year: int) -> DataFrame:
    """Rates and provenance, the shape of the score distribution, and the goal and level of the lag year's row."""
    base = municipal_rates(students, published, year)
    base = base.join(aggregates.distribution_shape(students, "id_municipio", "mun"), "id_municipio", "left")
    own_year = goals.where(F.col("ano") == year).select(
        "id_municipio", F.col(f"meta_alfabetizacao_{year + 1}").alias("mun_meta_2024_lag1"),
        F.col("nivel_alfabetizacao").alias("mun_nivel_alfabetizacao_lag1"))
    return base.join(own_year, "id_municipio", "left")


def state_features(students: DataFrame, published: DataFrame, directory: DataFrame, year: int) -> DataFrame:
    """As the municipal block, over the municipality → state lookup."""
    here = aggregates.present()
    placed = students.drop("sigla_uf").join(directory.select("id_municipio", "sigla_uf"), "id_municipio", "left")
    base = placed.where(F.col("sigla_uf").isNotNull()).groupBy("sigla_uf").agg(
        F.count_if(here).alias("uf_n_alunos_lag1"),
        weighted_mean(F.when(here, F.col("alfabetizado")), F.col("peso_aluno")).alias("_gold"),
        F.avg("presenca").alias("uf_taxa_presenca_lag1"), F.count(F.lit(1)).alias("uf_n_matriculados_lag1"),
    ).where(F.col("uf_n_alunos_lag1") > 0)
    base = base.join(aggregates.pivot_published(published, "sigla_uf", year), "sigla_uf", "full_outer")
    return coalesce_sources(base, "uf", "_gold")


def feature_store(students_lag: DataFrame, published_mun: DataFrame, published_uf: DataFrame, goals: DataFrame,
                  directory: DataFrame, year: int) -> dict[str, DataFrame]:
    """The three keyed tables of the lag year; no row of the target year can enter."""
    lag = students_lag.where(F.col("ano") == year)
    return {
        "escola": school_features(lag),
        "municipio": municipal_features(lag, published_mun, goals, year),
        "uf": state_features(lag, published_uf, directory, year),
    }


def cohort(students: DataFrame, year: int) -> DataFrame:
    """Students of the target year whose outcome was measured."""
    measured = (F.col("ano") == year) & (F.col("presenca") == 1) & (F.col("preenchimento_caderno") == 1)
    return cleaning.select_existing(students.where(measured), COHORT_COLUMNS)


def attach_weight(rows: DataFrame, students: DataFrame, year: int, keys: Sequence[str] = ("id_aluno",)) -> DataFrame:
    """Same-year weight, one to one; a student without weight is an error."""
    weights = students.where((F.col("ano") == year) & (F.col("presenca") == 1)).select(*keys, C.WEIGHT)
    return quality.guarded_left_join(rows.drop(C.WEIGHT), weights, keys, "one_to_one", C.WEIGHT)


def join_features(rows: DataFrame, store: Mapping[str, DataFrame], guard: bool = True) -> DataFrame:
    """School, municipality and state lags, many to one: the cohort keeps its rows.

    The store tables are grouped by their key, so uniqueness holds by construction; ``guard`` proves it
    for tables that come from elsewhere.
    """
    for name, key in (("escola", "id_escola"), ("municipio", "id_municipio"), ("uf", "sigla_uf")):
        if guard:
            quality.assert_unique(store[name], [key], name)
        rows = rows.join(store[name], key, "left")
    return rows


def derive(rows: DataFrame, k: float = C.SMOOTHING_K) -> DataFrame:
    """Inverted target, coverage flags, provenance default, smoothing, contrast with the state, network group."""
    known = F.col("fonte_lag_municipal") == C.SOURCE_GOLD
    rows = rows.withColumns({
        C.TARGET: (1 - F.col("alfabetizado")).cast("int"),
        "tem_historico_escola": F.col("esc_taxa_alfab_lag1").isNotNull().cast("int"),
        "tem_historico_municipio": F.coalesce(known, F.lit(False)).cast("int"),
        "fonte_lag_municipal": F.coalesce("fonte_lag_municipal", F.lit(C.SOURCE_NONE)),
        "fonte_lag_uf": F.coalesce("fonte_lag_uf", F.lit(C.SOURCE_NONE)),
        "esc_taxa_alfab_lag1_suav": profile.smoothed_rate(
            F.col("esc_taxa_alfab_lag1") * 100, F.col("esc_n_alunos_lag1"), F.col("mun_taxa_alfab_lag1"), k),
        "mun_desvio_vs_uf": F.col("mun_taxa_alfab_lag1") - F.col("uf_taxa_alfab_lag1"),
        "rede_grupo": F.coalesce(cleaning.lookup("rede", {"2": "Estadual", "3": "Municipal"}), F.lit("Outros")),
    })
    return rows.drop("id_aluno", "id_escola", "rede", "alfabetizado")


def model_matrix(df: DataFrame, features: Sequence[str] = C.MODEL_FEATURES) -> DataFrame:
    """The only door to a model: features exist, none is forbidden or operational; target and group ride along."""
    cleaning.require_columns(df, features)
    forbidden = sorted(set(features) & set(C.FORBIDDEN_FEATURES))
    if forbidden:
        raise ValueError(f"forbidden feature in the model matrix: {forbidden}")
    operational = sorted(set(features) & set(C.OPERATIONAL_COLUMNS))
    if operational:
        raise ValueError(f"operational column in the model matrix: {operational}")
    carried = [c for c in ("row_id", C.GROUP, C.WEIGHT, C.TARGET) if c in df.columns]
    return df.select(*carried, *features)


def verify(df: DataFrame, numeric: Sequence[str], limit: float = 0.95) -> None:
    """Leakage checks of the finished dataset; a failure stops the build."""
    leaked = sorted((set(df.columns) & set(C.FORBIDDEN_FEATURES)) - {C.GROUP, C.WEIGHT})
    if leaked:
        raise quality.QualityError(f"forbidden columns in the dataset: {leaked}")
    bad = df.agg(F.count_if(~F.coalesce(F.col(C.TARGET).isin(0, 1), F.lit(False))).alias("t"), F.count_if(F.col(C.GROUP).isNull()).alias("g")).first()
    if bad["t"] or bad["g"]:
        raise quality.QualityError(f"{bad['t']} rows with a bad target, {bad['g']} without a group")
    quality.enforce_no_leak(df, C.TARGET, numeric, limit)


def modelling_dataset(students: DataFrame, published_mun: DataFrame, published_uf: DataFrame, goals: DataFrame,
                      directory: DataFrame, target_year: int) -> DataFrame:
    """Cohort of the target year with the lag features of the year before; one row per student."""
    store = feature_store(students, published_mun, published_uf, goals, directory, target_year - 1)
    return derive(join_features(cohort(students, target_year), store, guard=False))


def history_share(df: DataFrame) -> DataFrame:
    """Provenance shares of the municipal lag over the cohort."""
    return df.groupBy("fonte_lag_municipal").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "participacao", F.col("n") / df.agg(F.count(F.lit(1)).alias("t")).scalar())


def coverage_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), share(F.col("tem_historico_municipio") == 1).alias("pct_municipio"),
                  share(F.col("tem_historico_escola") == 1).alias("pct_escola"))
