"""Territory profiles: clustering base, choice of k, relabelled clusters and their tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.contracts import PROFICIENCY_LEVELS, SEED
from cohortspark.models import kmeans
from cohortspark.operators import aggregates, ranks
from cohortspark.operators.quality import QualityError
from cohortspark.session import materialize

K_GRID = tuple(range(3, 9))
MAX_REGIONS = 500
FEATURES = (
    "taxa_alfabetizacao_2023", "taxa_alfabetizacao_2024", "media_portugues_2024", "taxa_presenca_2024", "log_porte", "share_rede_estadual",
) + PROFICIENCY_LEVELS
NAMES = {0: "alfabetização consolidada", 1: "faixa intermediária", 2: "risco alto e cobertura menor"}


def clustering_base(population: DataFrame, population_lag: DataFrame, goals_lag: DataFrame, levels: DataFrame, cohort: DataFrame) -> DataFrame:
    """One row per municipality: two years of rates (own, else published), score, presence, size, network, levels."""
    base = population.select(
        "id_municipio", "sigla_uf", "nome_regiao", "n_avaliados", F.col("taxa_alfab_ponderada").alias("taxa_alfabetizacao_2024"),
        F.col("prof_media_ponderada").alias("media_portugues_2024"), F.col("taxa_presenca").alias("taxa_presenca_2024"))
    own = population_lag.select("id_municipio", F.col("taxa_alfab_ponderada").alias("_own"))
    published = goals_lag.select("id_municipio", (F.col("taxa_alfabetizacao") / 100).alias("_pub"))
    share = aggregates.category_weight_share(cohort, "id_municipio", F.col("rede_grupo") == "Estadual", "peso_aluno", "share_rede_estadual")
    joined = base
    for part in (own, published, levels.select("id_municipio", *PROFICIENCY_LEVELS), share):
        joined = joined.join(part, "id_municipio", "left")
    return joined.withColumns({
        "taxa_alfabetizacao_2023": F.coalesce("_own", "_pub"), "log_porte": F.log10("n_avaliados")}).drop("_own", "_pub")


def standardized(base: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Complete rows with a population-standardized array ``features``."""
    complete = base.dropna(subset=list(features))
    row = complete.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    scaled = F.array(*[(F.col(c).cast("double") - (row[f"m_{c}"] or 0.0)) / (row[f"s_{c}"] or 1.0) for c in features])
    return materialize(kmeans.usable(complete.withColumn("features", scaled)))


def choose_k(vectors: DataFrame, fits: Mapping[int, kmeans.Clustering]) -> DataFrame:
    """Inertia, silhouette (squared Euclidean, linear in the rows), smallest cluster, drop of inertia."""
    grid = sorted(fits)
    quality = kmeans.silhouettes(vectors, [fits[k] for k in grid])
    rows, before = [], None
    for k, silhouette in zip(grid, quality):
        inertia = round(fits[k].inertia, 4)
        rows.append((k, inertia, silhouette, int(fits[k].sizes.min()), None if before is None else round(before - inertia, 4)))
        before = inertia
    return vectors.sparkSession.createDataFrame(rows, "k int, inercia double, silhueta double, menor_cluster long, queda_de_inercia double")


@dataclass
class Clusters:
    assignments: DataFrame
    selection: DataFrame
    profile: DataFrame
    regions: DataFrame
    low_presence: DataFrame


def cluster_territories(base: DataFrame, grid: Sequence[int] = K_GRID, restarts: int = 10, seed: int = SEED, names: dict[int, str] = NAMES) -> Clusters:
    """KMeans at the best silhouette, clusters numbered by falling literacy rate, with their tables."""
    vectors = standardized(base)
    fits = kmeans.fit(vectors, "id_municipio", grid, restarts, seed=seed)
    if not fits:
        raise QualityError("no complete municipality to cluster")
    selection = choose_k(vectors, fits)
    k = selection.orderBy(F.col("silhueta").desc_nulls_last(), "k").first()["k"]
    labelled = vectors.withColumn("prediction", kmeans.nearest(fits[k]))
    means = labelled.groupBy("prediction").agg(F.avg("taxa_alfabetizacao_2024").alias("t"))
    order = means.withColumn("cluster", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("t").desc(), "prediction")) - 1)
    label = F.coalesce(*[F.when(F.col("cluster") == i, n) for i, n in names.items()], F.concat(F.lit("perfil "), F.col("cluster").cast("string")))
    rows = labelled.join(F.broadcast(order.select("prediction", "cluster")), "prediction").withColumn("cluster_nome", label)
    rows = materialize(rows.select("id_municipio", "sigla_uf", "nome_regiao", "cluster", "cluster_nome", "n_avaliados", *FEATURES))
    keys = ["cluster", "cluster_nome"]
    profile = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_municipios"), F.sum("n_avaliados").alias("alunos_avaliados"),
        F.avg("taxa_alfabetizacao_2023").alias("taxa_2023"), F.avg("taxa_alfabetizacao_2024").alias("taxa_2024"),
        F.avg("media_portugues_2024").alias("media_portugues"), F.avg("taxa_presenca_2024").alias("taxa_presenca"),
        F.avg("share_rede_estadual").alias("share_rede_estadual"))
    median = ranks.quantiles(rows, "n_avaliados", {"porte_mediano": 0.5}, ["cluster"])
    profile = profile.join(median, "cluster").join(aggregates.level_bands(rows, PROFICIENCY_LEVELS, ["cluster"]), "cluster")
    regions = [r[0] for r in rows.select("nome_regiao").distinct().orderBy("nome_regiao").limit(MAX_REGIONS + 1).collect()]
    if len(regions) > MAX_REGIONS:
        raise QualityError(f"more than {MAX_REGIONS} regions, the composition cannot be a column each")
    edges = ranks.quantile_edges(rows, "taxa_presenca_2024", 10)
    lowest = rows.where(F.col("taxa_presenca_2024") <= edges[1]) if len(edges) > 1 else rows
    return Clusters(rows, selection, profile, aggregates.crosstab_row_shares(rows, "cluster_nome", "nome_regiao", regions),
                    aggregates.frequency_shares(lowest, "cluster_nome"))
