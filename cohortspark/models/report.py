"""Final refit and held-out report: decisions on out-of-fold scores, measures on unseen groups."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.contracts import GROUP, SEED, TARGET, WEIGHT
from cohortspark.models import candidates as M
from cohortspark.models import split
from cohortspark.models.calibration import CalibratedScorer, fit_calibrated
from cohortspark.operators import metrics, ranks, resample
from cohortspark.session import materialize
from cohortspark.sources.tables import fingerprint, write_product

CAPACITY = 0.20


class Tables(Mapping):
    """Tables by name, each made when it is first asked for: a reader of one does not pay for the others."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


class Report:
    """A fitted scorer and its scores of the held-out rows; what is read from the out-of-fold scores is made when it is asked for."""

    def __init__(self, scorer: CalibratedScorer, scores: DataFrame, tables: Mapping[str, Callable[[Report], DataFrame]]):
        self.scorer, self.scores = scorer, scores
        self.tables = Tables({name: functools.partial(make, self) for name, make in tables.items()})

    @functools.cached_property
    def oof(self) -> DataFrame:
        return materialize(self.scorer.calibrate(self.scorer.oof))

    @functools.cached_property
    def oof_ranking(self) -> DataFrame:
        return materialize(metrics.ranking_from_histogram(metrics.score_histogram(self.oof, TARGET, M.SCORE)))

    @functools.cached_property
    def thresholds(self) -> DataFrame:
        return materialize(thresholds(self.oof, ranking=self.oof_ranking))


def presence_level(df: DataFrame, column: str = "mun_taxa_presenca_lag1") -> Column:
    """Quintile of the presence rate; no history is its own level."""
    labels = ["q1_menor_presenca", "q2", "q3", "q4", "q5_maior_presenca"]
    edges = ranks.quantile_edges(df, column, 5)
    return F.coalesce(ranks.cut(F.col(column), edges, labels, include_lowest=True), F.lit("sem_historico"))


def default_strata(df: DataFrame) -> dict[str, Column]:
    return {
        "tem_historico_municipio": F.col("tem_historico_municipio").cast("string"),
        "fonte_lag_municipal": F.col("fonte_lag_municipal"), "nome_regiao": F.col("nome_regiao"), "sigla_uf": F.col("sigla_uf"),
        "rede_grupo": F.col("rede_grupo"), "quintil_presenca_municipal": presence_level(df),
        "tem_lag_de_uf": F.when(F.col("uf_taxa_alfab_lag1").isNull(), "sem_lag").otherwise("demais_ufs"),
    }


def thresholds(oof: DataFrame, capacity: float = CAPACITY, ranking: DataFrame | None = None) -> DataFrame:
    """F1-maximising and capacity threshold, both from out-of-fold scores; ``ranking`` is their ranking table where it is there."""
    f1 = metrics.best_f1_threshold(oof, TARGET, M.SCORE) if ranking is None else ranking.select(F.col("limiar_f1").alias("limiar"))
    cut = ranks.quantiles(oof, M.SCORE, {"por_capacidade": 1 - capacity})
    return f1.select(F.col("limiar").alias("por_f1"), cut.scalar().alias("por_capacidade"), F.lit(capacity).alias("fracao_de_capacidade"))


def build_report(df: DataFrame, candidate: M.Candidate, k: int = 5, seed: int = SEED, replicates: int = 1000,
                 strata: Mapping[str, Column] | None = None, minimum: int = 500) -> Report:
    """Hold out whole groups, calibrate on the rest, measure on the held-out part."""
    marked = materialize(split.holdout(df, seed=seed))
    split.assert_disjoint(marked, "teste")
    dev = materialize(split.folds(marked.where(~F.col("teste")).drop("teste"), k, seed))
    scorer = fit_calibrated(dev, candidate, k, seed)
    held = marked.where(F.col("teste"))
    scores = materialize(scorer.score(held))

    def limits(made: Report) -> DataFrame:
        row = made.thresholds.first()
        at = [metrics.threshold_metrics(scores, TARGET, M.SCORE, row[name]).withColumn("criterio", F.lit(name)) for name in ("por_f1", "por_capacidade")]
        return at[0].unionByName(at[1])

    return Report(scorer, scores, {
        "ranking": lambda made: metrics.ranking_metrics(scores, TARGET, M.SCORE),
        "desenvolvimento": lambda made: made.oof_ranking.drop("limiar_f1"),
        "limiares": limits,
        "intervalos": lambda made: resample.cluster_bootstrap(scores, TARGET, M.SCORE, GROUP, replicates, seed),
        "estratos": lambda made: metrics.stratified_metrics(scores, TARGET, M.SCORE, default_strata(held) if strata is None else strata, minimum),
        "calibracao": lambda made: metrics.calibration_curve(scores, TARGET, M.SCORE, "row_id"),
        "capacidade": lambda made: metrics.capacity_curve(scores, TARGET, M.SCORE, "row_id"),
        "decis": lambda made: metrics.lift_by_decile(scores, TARGET, M.SCORE, "row_id"),
        "r2_municipal": lambda made: metrics.group_fit(scores, TARGET, M.SCORE, GROUP, WEIGHT),
        "resumo_split": lambda made: split.split_summary(marked, "teste"),
    })


def save_model(report: Report, path: str, dataset: DataFrame, features: Sequence[str]) -> None:
    """MLlib pipeline, calibration curve and a one-row metadata table with the dataset fingerprint."""
    base = report.scorer.base
    PipelineModel([*base.preprocessor.model.stages, base.classifier]).write().overwrite().save(f"{path}/pipeline")
    write_product(report.scorer.curve.blocks, f"{path}/isotonic")
    meta = report.thresholds.select(
        "*", F.lit(report.scorer.apply).alias("calibracao_aplicada"), F.lit(report.scorer.gain).alias("ganho_brier"),
        F.array(*[F.lit(f) for f in features]).alias("features"), fingerprint(dataset, "dataset").select("soma_hash").scalar().alias("soma_hash"))
    write_product(meta, f"{path}/metadata")


def load_model(spark, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/pipeline"), spark.read.parquet(f"{path}/metadata")


def ablation(df: DataFrame, sets: Mapping[str, Sequence[str]], make, seeds: Sequence[int] = (42, 7, 2024), k: int = 5, seed: int = SEED) -> DataFrame:
    """Feature sets × seeds × folds on the development part only; the hold-out never changes with the seeds.

    ``make(features, name)`` builds the candidate.
    """
    dev = materialize(split.holdout(df, seed=seed).where(~F.col("teste")).drop("teste"))
    table = None
    for s in seeds:
        dealt = materialize(split.folds(dev, k, s))
        for name, features in sets.items():
            scored, seconds = M.out_of_fold(dealt, make(features, name), k, s)
            part = metrics.ranking_metrics(scored, TARGET, M.SCORE, ["fold"]).select(
                F.lit(s).alias("seed"), "fold", F.lit(name).alias("conjunto"), F.lit(len(features)).alias("n_features"), "roc_auc", "pr_auc",
                F.col("n").alias("n_teste"))
            part = materialize(part)
            table = part if table is None else table.unionByName(part)
    return table


def compare_sets(table: DataFrame, base: str, alternative: str, k: int = 5) -> DataFrame:
    return resample.compare_in_folds(table, base, alternative, k=k, model="conjunto", fold=("seed", "fold"))
