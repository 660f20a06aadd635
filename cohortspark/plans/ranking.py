"""Shrinkage and the published risk rankings of territories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.contracts import RANKING_COLUMNS
from cohortspark.operators import metrics, ranks, sampling
from cohortspark.session import materialize

NOT_EVALUATED = ("AC", "DF")
FLAT_BAND_LIMIT = 65.0
TOP = 50
#: Decimals to which scores, and their means per unit, are read by the ranking: sums of doubles have no fixed order, so without
#: them units of equal size and score would be placed by the last bit.
SCORE_DIGITS = 12


def shrink(df: DataFrame, value: str, n: str, sampling_variance: Column, prior: Column | float | None, out: str) -> tuple[DataFrame, DataFrame]:
    """Empirical-Bayes credibility: each unit moves to the prior as far as its measure is noisy.

    τ² is the dispersion around the prior minus the expected sampling variance, both weighted by size.
    ``prior`` None means the size-weighted mean. Returns the units with the shrunken value and the
    one-row table (mu, tau2, k). Noise larger than the dispersion is an error.
    """
    w, v = F.col(n).cast("double"), F.col(value)
    mean = df.agg((F.sum(v * w) / F.sum(w)).alias("mu")).scalar()
    centre = mean if prior is None else (prior if isinstance(prior, Column) else F.lit(float(prior)))
    base = df.withColumns({"_prior": centre, "_var": sampling_variance})
    weight = F.sum(w)
    parts = base.agg(
        (F.sum(v * w) / weight).alias("mu"),
        ((F.sum(w * (v - F.col("_prior")) ** 2) - F.sum(w * F.col("_var"))) / weight).alias("tau2"),
        (F.sum(w * w * F.col("_var")) / weight).alias("noise"))
    message = F.concat(F.lit("sampling noise exceeds the observed dispersion, tau2 = "), F.col("tau2").cast("string"))
    fit = parts.select("mu", F.when(F.col("tau2") > 0, F.col("tau2")).otherwise(F.raise_error(message).cast("double")).alias("tau2"), "noise")
    fit = fit.select("mu", "tau2", (F.col("noise") / F.col("tau2")).alias("k"))
    k = fit.select("k").scalar()
    shrunk = base.withColumn(out, (w * v + k * F.col("_prior")) / (w + k)).drop("_prior", "_var")
    return shrunk, fit


def binomial_variance(mean: Column, n: str) -> Column:
    return mean * (1 - mean) / F.col(n)


def territory_context(names: DataFrame, population: DataFrame, lag: DataFrame) -> DataFrame:
    """Name, territory, presence and the lag rate of every unit."""
    table = population.select(
        "id_municipio", "sigla_uf", "nome_regiao", F.col("taxa_presenca").alias("taxa_presenca_2024"),
        F.col("taxa_alfab_ponderada").alias("taxa_alfabetizacao_2024"))
    return names.select("id_municipio", "nome_municipio").join(table, "id_municipio").join(
        lag.select("id_municipio", "mun_taxa_alfab_lag1"), "id_municipio", "left")


def with_shrunken_rates(units: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Both shrinkages: of the mean score to its own mean, and of the observed rate to the mean score."""
    score, fit_score = shrink(
        units, "risco_medio_oof", "n_alunos_avaliados", F.col("variancia_do_escore") / F.col("n_alunos_avaliados"), None, "risco_suavizado")
    n = F.col("n_alunos_avaliados")
    mean = units.agg((F.sum(F.col("taxa_observada_de_risco") * n) / F.sum(n)).alias("m")).scalar()
    both, fit_rate = shrink(
        score.withColumn("_m", mean), "taxa_observada_de_risco", "n_alunos_avaliados", binomial_variance(F.col("_m"), "n_alunos_avaliados"),
        F.col("risco_medio_oof"), "taxa_observada_ajustada")
    return both.drop("_m"), {"escore do modelo": fit_score, "taxa observada": fit_rate}


def build_ranking(scores: DataFrame, context: DataFrame, label: str, score: str, not_evaluated: Sequence[str] = NOT_EVALUATED,
                  weight: str = "peso_aluno") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Two orders (rate, volume) with deciles and caveat flags; territories the model cannot order keep NULL.

    Units whose size, mean score and (for the volume) weight are equal tie exactly and are placed by their id."""
    scores = scores.withColumn(score, F.round(score, SCORE_DIGITS))
    units = metrics.aggregate_scores(scores, label, score, "id_municipio", weight)
    units = materialize(units.withColumn("risco_medio_oof", F.round("risco_medio_oof", SCORE_DIGITS)))
    table, fits = with_shrunken_rates(units)
    table = table.join(context, "id_municipio", "left").withColumns({
        "criancas_em_risco": F.col("risco_suavizado") * F.col("populacao_estimada"),
        "modelo_avaliado": ~F.coalesce(F.col("sigla_uf").isin(*not_evaluated), F.lit(False)),
        "faixa_shap_taxa_municipal": F.col("mun_taxa_alfab_lag1").isNull() | (F.col("mun_taxa_alfab_lag1") < FLAT_BAND_LIMIT),
        "incerteza_posicao_quantificada": F.lit(False)})
    for name, value in (("taxa", "risco_suavizado"), ("volume", "criancas_em_risco")):
        eligible = table.withColumn("_v", F.when(F.col("modelo_avaliado"), F.round(F.col(value), 12)))
        placed = ranks.row_number(eligible, "_v", "id_municipio", f"posicao_por_{name}", descending=True, with_total="_total")
        decile = ranks.frequency_bin(F.col(f"posicao_por_{name}"), F.col("_total"), 10)
        table = placed.withColumn(f"decil_por_{name}", decile).drop("_v", "_total")
    return table.select(*RANKING_COLUMNS), fits


def published_order(ranking: DataFrame) -> DataFrame:
    """Rows in publication order; units without a position last."""
    return ranking.orderBy(F.col("posicao_por_taxa").asc_nulls_last(), "id_municipio")


ORDERINGS = (
    ("taxa observada crua", "taxa_observada_de_risco"), ("taxa observada ajustada", "taxa_observada_ajustada"),
    ("risco do modelo (publicado)", "risco_suavizado"), ("volume de crianças (publicado)", "criancas_em_risco"),
)


def concentration(ranking: DataFrame, top: int = TOP) -> DataFrame:
    """What each of four orders puts on top: size, children, presence, overlap with the published list."""
    evaluated = materialize(ranking.where(F.col("modelo_avaliado")))
    total = evaluated.agg(F.sum("criancas_em_risco").alias("t")).scalar()
    parts = None
    for name, column in ORDERINGS:
        rounded = evaluated.withColumn("_v", F.round(F.col(column), 12))
        part = sampling.top_k(rounded, "_v", "id_municipio", top).withColumn("ordenacao", F.lit(name)).drop("_v")
        parts = part if parts is None else parts.unionByName(part)
    parts = materialize(parts)
    published = parts.where(F.col("ordenacao") == ORDERINGS[2][0]).select("id_municipio", F.lit(1).alias("_p"))
    return parts.join(published, "id_municipio", "left").groupBy("ordenacao").agg(
        F.percentile("n_alunos_avaliados", F.lit(0.5)).alias("n_alunos_mediano"),
        F.count_if(F.col("n_alunos_avaliados") < 50).alias("municipios_com_menos_de_50_alunos"),
        F.sum("criancas_em_risco").alias("criancas_em_risco"), F.percentile("taxa_presenca_2024", F.lit(0.5)).alias("taxa_presenca_mediana"),
        F.count("_p").alias("municipios_em_comum_com_a_lista_por_taxa"),
    ).withColumn("share_das_criancas_em_risco", F.col("criancas_em_risco") / total)


def presence_curve(ranking: DataFrame, bins: int = 20) -> DataFrame:
    """Mean presence, observed and modelled risk over equal-frequency presence bins."""
    binned = ranks.equal_frequency(ranking.where(F.col("modelo_avaliado")), "taxa_presenca_2024", "id_municipio", bins, "bin")
    return binned.where(F.col("bin").isNotNull()).groupBy((F.col("bin") - 1).alias("bin")).agg(
        F.avg("taxa_presenca_2024").alias("presenca"), F.avg("taxa_observada_de_risco").alias("observado"),
        F.avg("risco_suavizado").alias("modelo"), F.count(F.lit(1)).alias("n"))
