"""Goal scenarios: shrunken persistence plus drift, censored to 0–100, judged on unseen territories."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.contracts import SEED
from cohortspark.functions.stats import NORMAL_975, clip, normal_cdf, share
from cohortspark.operators import metrics, ranks, resample
from cohortspark.operators.quality import QualityError, assert_unique
from cohortspark.session import materialize

SIZE_EDGES = (0, 25, 50, 100, 200, 500, 1000, float("inf"))
FOLD = "fold"
SCENARIO = "cenario_condicional_sem_validacao_em_ano_futuro"


def goals_base(goals: DataFrame, population: DataFrame, population_lag: DataFrame, year: int, last: int) -> DataFrame:
    """Two years of the published rate side by side, the goals, and the sizes of both years."""
    now = goals.where(F.col("ano") == year).select(
        "id_municipio", F.col("taxa_alfabetizacao").alias("taxa_2024"),
        *[F.col(f"meta_alfabetizacao_{y}").alias(f"meta_{2024 + y - year}") for y in range(year, last + 1)])
    before = goals.where(F.col("ano") == year - 1).select("id_municipio", F.col("taxa_alfabetizacao").alias("taxa_2023"))
    sizes = population.select("id_municipio", F.col("n_avaliados").alias("n_alunos_avaliados"),
                              F.col("taxa_presenca").alias("taxa_presenca_2024"), "sigla_uf", "nome_regiao")
    lag_sizes = population_lag.select("id_municipio", F.col("n_avaliados").alias("n_alunos_2023"))
    return before.join(now, "id_municipio", "full_outer").join(sizes, "id_municipio").join(lag_sizes, "id_municipio", "left")


def check_domain(df: DataFrame, rates: Sequence[str], sizes: Sequence[str]) -> None:
    """Rates in 0–100, positive sizes, nothing missing, at least one row."""
    bad = F.lit(False)
    for c in rates:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | ~F.col(c).between(0, 100)
    for c in sizes:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.col(c) <= 0)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).first()
    if not row["n"] or row["bad"]:
        raise QualityError(f"{row['bad']} of {row['n']} rows outside the domain (rates {list(rates)} in 0–100, sizes {list(sizes)} > 0)")


def moments(train: DataFrame, rate: str, size: str, outcome: str) -> DataFrame:
    """Per fold: size-weighted mean rate, credibility constant k and weighted drift."""
    n, f = F.col(size).cast("double"), F.col(rate) / 100
    first = train.groupBy(FOLD).agg(
        (F.sum(n * f) / F.sum(n)).alias("prior"), (F.sum(n * f * f) / F.sum(n)).alias("_ff"), (F.count(F.lit(1)) / F.sum(n)).alias("_inv"))
    noise = F.col("prior") * (1 - F.col("prior"))
    tau2 = F.greatest(F.col("_ff") - F.col("prior") ** 2 - noise * F.col("_inv"), F.lit(1e-12))
    shaped = first.select(FOLD, "prior", (noise / tau2).alias("k"))
    with_fit = train.join(F.broadcast(shaped), FOLD)  # one row per fold
    drift = with_fit.groupBy(FOLD).agg((F.sum(n * (F.col(outcome) - smoothed(rate, size))) / F.sum(n)).alias("deriva"))
    return shaped.join(drift, FOLD)


def smoothed(rate: str, size: str) -> Column:
    return (F.col(size) * F.col(rate) + F.col("k") * F.col("prior") * 100) / (F.col(size) + F.col("k"))


def fit_dispersion(residuals: DataFrame, grid: int = 15, zooms: int = 9) -> DataFrame:
    """(a, c) of the variance a²/n + c² by likelihood, all folds at once.

    The likelihood needs only (n, count, sum of squares), so the rows are reduced to distinct sizes once;
    every zoom evaluates a grid of candidates over that table in one aggregate and narrows around the best.
    """
    table = materialize(residuals.groupBy(FOLD, "n").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("r") ** 2).alias("q")))
    spark = residuals.sparkSession
    folds = [r[FOLD] for r in table.select(FOLD).distinct().collect()]
    centre = {f: (math.log(100.0), math.log(10.0)) for f in folds}
    half = 10.0
    best: dict[int, tuple[float, float, float]] = {}
    for _ in range(zooms):
        step = 2 * half / (grid - 1)
        points = [(f, min(max(centre[f][0] - half + i * step, -10.0), 10.0), min(max(centre[f][1] - half + j * step, -10.0), 10.0))
                  for f in folds for i in range(grid) for j in range(grid)]
        candidates = spark.createDataFrame(points, f"{FOLD} int, la double, lc double")
        var = F.exp(2 * F.col("la")) / F.col("n") + F.exp(2 * F.col("lc"))
        cost = table.join(F.broadcast(candidates), FOLD).groupBy(FOLD, "la", "lc").agg(
            F.sum(0.5 * (F.col("m") * F.log(var) + F.col("q") / var)).alias("cost"))
        for r in cost.groupBy(FOLD).agg(F.min(F.struct("cost", "la", "lc")).alias("b")).collect():
            b = r["b"]
            best[r[FOLD]] = (b["cost"], b["la"], b["lc"])
            centre[r[FOLD]] = (b["la"], b["lc"])
        half = 1.5 * step
    rows = [(f, math.exp(b[1]), math.exp(b[2]), b[0]) for f, b in best.items()]
    return spark.createDataFrame(rows, f"{FOLD} int, a double, c double, custo double")


def fit_projector(train: DataFrame, rate: str, size: str, outcome: str) -> DataFrame:
    """One parameter row per fold: prior, k, drift, a, c. ``train`` holds each fold's own training rows."""
    check_domain(train, [rate, outcome], [size])
    train = materialize(train)
    fit = materialize(moments(train, rate, size, outcome))
    residual = train.join(F.broadcast(fit), FOLD).select(
        FOLD, F.col(size).cast("double").alias("n"), (F.col(outcome) - smoothed(rate, size) - F.col("deriva")).alias("r"))
    return materialize(fit.join(fit_dispersion(residual), FOLD))


def predict(df: DataFrame, fit: DataFrame, rate: str, size: str, goal: str) -> DataFrame:
    """Median, 95 % interval and probability of staying below the goal; mass sits at 0 and at 100."""
    rows = df.join(F.broadcast(fit), FOLD)  # one parameter row per fold
    centre = smoothed(rate, size) + F.col("deriva")
    deviation = F.sqrt(F.col("a") ** 2 / F.col(size) + F.col("c") ** 2)
    below = F.when(F.col(goal) <= 0, 0.0).when(F.col(goal) > 100, 1.0).otherwise(normal_cdf((F.col(goal) - centre) / deviation))
    return rows.select(
        *df.columns, smoothed(rate, size).alias("taxa_suavizada"), clip(centre, 0.0, 100.0).alias("projecao"), deviation.alias("dp_latente"),
        clip(centre - NORMAL_975 * deviation, 0.0, 100.0).alias("inferior"), clip(centre + NORMAL_975 * deviation, 0.0, 100.0).alias("superior"),
        below.alias("p_abaixo"))


TRANSITION = ("id_municipio", "taxa_2023", "taxa_2024", "meta_2024", "n_alunos_2023")


def evaluate_transition(base: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    """Every territory predicted by a projector fitted without its fold; one row per territory is required."""
    rows = base.dropna(subset=list(TRANSITION)).select(*TRANSITION)
    assert_unique(rows, ["id_municipio"], "goal evaluation")
    dealt = ranks.hash_position(rows, ["id_municipio"], seed, "_pos").withColumn(FOLD, F.pmod(F.col("_pos") - 1, F.lit(k)).cast("int")).drop("_pos")
    dealt = materialize(dealt)
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("_own"))
    train = dealt.withColumnRenamed(FOLD, "_own").select("*", F.explode(others).alias(FOLD)).drop("_own")
    fit = fit_projector(train, "taxa_2023", "n_alunos_2023", "taxa_2024")
    prevalence = train.groupBy(FOLD).agg(share(F.col("taxa_2024") < F.col("meta_2024")).alias("baseline_prevalencia"))
    scored = predict(dealt, fit, "taxa_2023", "n_alunos_2023", "meta_2024").join(F.broadcast(prevalence), FOLD)
    return scored.withColumns({
        "ficou_abaixo": (F.col("taxa_2024") < F.col("meta_2024")).cast("int"),
        "coberto": F.col("taxa_2024").between(F.col("inferior"), F.col("superior")),
        "gap_ate_meta": F.col("meta_2024") - F.col("taxa_2023"), "taxa_2023_invertida": -F.col("taxa_2023")})


def summarize_evaluation(oof: DataFrame, replicates: int = 1000, seed: int = SEED) -> DataFrame:
    """Bootstrap table: AUC, Brier, gain over the prior, coverage."""
    y, p, b = F.col("ficou_abaixo"), F.col("p_abaixo"), F.col("baseline_prevalencia")
    return resample.cluster_bootstrap(
        materialize(oof), "ficou_abaixo", "p_abaixo", "id_municipio", replicates, seed,
        {"ganho_brier_sobre_baseline": (b - y) ** 2 - (p - y) ** 2, "cobertura_intervalo_95": F.col("coberto").cast("double")})


def rankings_without_model(oof: DataFrame) -> DataFrame:
    """AUC of the projection and of two rankings that need no model."""
    plain = F.array(*[F.struct(F.lit(n).alias("leitura"), F.col(c).cast("double").alias("s")) for n, c in (
        ("projecao_com_shrinkage_e_deriva", "p_abaixo"), ("gap_ate_a_meta_sem_modelo", "gap_ate_meta"), ("taxa_2023_invertida", "taxa_2023_invertida"))])
    long = oof.select("ficou_abaixo", F.explode(plain).alias("x")).select("ficou_abaixo", "x.*")
    return metrics.auc(long, "ficou_abaixo", "s", ["leitura"])


def volatility_by_size(base: DataFrame, fit: DataFrame) -> DataFrame:
    rows = base.dropna(subset=["taxa_2023", "taxa_2024", "n_alunos_2023"]).withColumn(FOLD, F.lit(0)).join(F.broadcast(fit), FOLD)
    rows = rows.withColumn("residuo", F.col("taxa_2024") - smoothed("taxa_2023", "n_alunos_2023") - F.col("deriva"))
    labels = [f"({int(a)}, {'inf' if math.isinf(b) else int(b)}]" for a, b in zip(SIZE_EDGES[:-1], SIZE_EDGES[1:])]
    rows = materialize(rows.withColumn("faixa", ranks.cut(F.col("n_alunos_2023"), SIZE_EDGES, labels)))
    table = rows.groupBy("faixa").agg(F.count(F.lit(1)).alias("n_municipios"), F.stddev_samp("residuo").alias("evolucao_dp"), F.max("a").alias("_a"), F.max("c").alias("_c"))
    median = ranks.quantiles(rows, "n_alunos_2023", {"porte_mediano": 0.5}, ["faixa"])
    return table.join(median, "faixa").withColumn(
        "dp_ajustado", F.sqrt(F.col("_a") ** 2 / F.col("porte_mediano") + F.col("_c") ** 2)).drop("_a", "_c")


def probability_deciles(oof: DataFrame) -> DataFrame:
    """Predicted against observed share over value deciles of the probability (equal cuts merged)."""
    edges = ranks.quantile_edges(oof, "p_abaixo", 10)
    decile = ranks.cut(F.col("p_abaixo"), edges, list(range(len(edges) - 1)), include_lowest=True)
    return oof.groupBy(decile.alias("decil")).agg(
        F.count(F.lit(1)).alias("n_municipios"), F.avg("p_abaixo").alias("probabilidade_prevista"), F.avg("ficou_abaixo").alias("fracao_observada"))


def publishable(base: DataFrame, fit: DataFrame) -> DataFrame:
    """Scenario of the next goal for every territory that has one."""
    rows = base.dropna(subset=["taxa_2024", "meta_2025", "n_alunos_avaliados"]).withColumn(FOLD, F.lit(0))
    p = predict(rows, fit, "taxa_2024", "n_alunos_avaliados", "meta_2025").join(F.broadcast(fit.select(FOLD, "a", "c")), FOLD)
    p = p.withColumnsRenamed({
        "taxa_suavizada": "taxa_2024_suavizada", "projecao": "projecao_2025", "dp_latente": "dp_latente_pp", "inferior": "intervalo_2025_inferior",
        "superior": "intervalo_2025_superior", "p_abaixo": "p_abaixo_da_meta_2025"})
    return p.withColumns({
        "gap_de_esforco_2025": F.col("meta_2025") - F.col("taxa_2024"),
        "meta_dentro_do_intervalo": F.col("meta_2025").between(F.col("intervalo_2025_inferior"), F.col("intervalo_2025_superior")),
        "natureza_resultado": F.lit(SCENARIO),
        "porte_abaixo_referencia_dispersao": F.col("n_alunos_avaliados") < F.ceil((F.col("a") / F.col("c")) ** 2)}).drop(FOLD, "a", "c")


def yearly_funnel(base: DataFrame, years: Sequence[int] = tuple(range(2025, 2031))) -> DataFrame:
    """Per goal year: median goal, who already reaches it, median gap, gap per year."""
    rows = base.dropna(subset=["taxa_2024", "meta_2025", "n_alunos_avaliados"])
    cells = F.array(*[F.struct(F.lit(y).alias("ano"), F.col(f"meta_{y}").alias("meta")) for y in years])
    long = rows.select("taxa_2024", F.explode(cells).alias("p")).select("taxa_2024", "p.*").withColumn("gap", F.col("meta") - F.col("taxa_2024"))
    reached = F.col("taxa_2024") >= F.col("meta")
    table = long.groupBy("ano").agg(F.count_if(reached).alias("municipios_que_ja_atingem_com_a_taxa_de_2024"), share(reached).alias("share_que_ja_atinge"))
    medians = ranks.quantiles(long, "meta", {"meta_mediana": 0.5}, ["ano"]).join(ranks.quantiles(long, "gap", {"gap_mediano": 0.5}, ["ano"]), "ano")
    return table.join(medians, "ano").withColumn("gap_mediano_anualizado_pp", F.col("gap_mediano") / (F.col("ano") - 2024))


def diagnostics(products: DataFrame, base: DataFrame, total_units: int | Column) -> DataFrame:
    """One row: gaps, shares inside the interval, width, evolution of the last transition."""
    gap, width = F.col("gap_de_esforco_2025"), F.col("intervalo_2025_superior") - F.col("intervalo_2025_inferior")
    rows = products.withColumn("_width", width)
    q = ranks.quantiles(rows, "gap_de_esforco_2025", {"gap_mediano": 0.5, "gap_p95": 0.95})
    w = ranks.quantiles(rows, "_width", {"largura_mediana_do_intervalo_pp": 0.5})
    known = base.dropna(subset=["taxa_2023", "taxa_2024", "n_alunos_2023"]).withColumn("d", F.col("taxa_2024") - F.col("taxa_2023"))
    evolution = known.agg(F.stddev_samp("d").alias("evolucao_dp_pp"), share(F.col("d") < 0).alias("share_que_piorou"))
    total = total_units if isinstance(total_units, Column) else F.lit(total_units)
    table = rows.agg(
        F.count(F.lit(1)).alias("n_municipios_com_meta_publicada"), F.avg(gap).alias("gap_medio"), share(gap <= 0).alias("ja_superam_a_meta"),
        share(F.col("p_abaixo_da_meta_2025").between(0.4, 0.6)).alias("share_com_probabilidade_entre_40_e_60"),
        share(F.col("meta_dentro_do_intervalo")).alias("share_com_meta_dentro_do_intervalo_de_95"),
        share(F.col("porte_abaixo_referencia_dispersao")).alias("share_abaixo_referencia_dispersao"))
    return table.select(
        "*", (total - F.col("n_municipios_com_meta_publicada")).alias("n_municipios_sem_meta"), q.select("gap_mediano").scalar().alias("gap_mediano"),
        q.select("gap_p95").scalar().alias("gap_p95"), w.scalar().alias("largura_mediana_do_intervalo_pp"),
        evolution.select("evolucao_dp_pp").scalar().alias("evolucao_dp_pp"), evolution.select("share_que_piorou").scalar().alias("share_que_piorou"))
