"""Candidate models behind one small interface: fit on a table, score a table."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from cohortspark.contracts import GROUP, MODEL_FEATURES, PRUNED_FEATURES, SEED, TARGET, WEIGHT
from cohortspark.models import batched
from cohortspark.models.preprocess import Preprocessor, fit_preprocessor
from cohortspark.operators import isotonic, metrics, ranks
from cohortspark.session import ensure_checkpoint_dir, materialize

SCORE = "escore"
TIE_EPSILON = 1e-9
GBT_DEFAULTS = {"maxIter": 400, "stepSize": 0.05, "maxDepth": 6, "minInstancesPerNode": 200, "subsamplingRate": 0.8}
FOREST_DEFAULTS = {"numTrees": 200, "maxDepth": 16, "minInstancesPerNode": 500, "featureSubsetStrategy": "sqrt"}


class Scorer:
    """A fitted model: adds ``escore`` = P(target = 1)."""

    def score(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass
class PriorScorer(Scorer):
    prevalence: float

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn(SCORE, F.lit(self.prevalence))


@dataclass
class LinearOrTreeScorer(Scorer):
    preprocessor: Preprocessor
    classifier: Any

    def score(self, df: DataFrame, margin: bool = False) -> DataFrame:
        vectors = self.preprocessor.model.transform(df)
        scored = self.classifier.transform(vectors)
        source = "rawPrediction" if margin else "probability"
        return scored.select(*df.columns, vector_to_array(source)[1].alias(SCORE))


@dataclass
class ProjectedScorer(Scorer):
    """A linear model of all rows of ``train``: scores are a projection over plain columns, so that no model object travels with the
    plan. The MLlib stages, which only a saved model needs, are fitted when they are asked for."""

    made: batched.Batch
    candidate: Candidate
    train: DataFrame
    seed: int

    def score(self, df: DataFrame) -> DataFrame:
        return df.select(*df.columns, batched.probability(self.made.base, self.made.fitted.gamma(), F.lit(0)).alias(SCORE))

    @functools.cached_property
    def stages(self) -> LinearOrTreeScorer:
        return self.candidate.fit(self.train, self.seed)

    @property
    def preprocessor(self) -> Preprocessor:
        return self.stages.preprocessor

    @property
    def classifier(self) -> Any:
        return self.stages.classifier


def scorer_of(candidate: Candidate, train: DataFrame, seed: int) -> Scorer:
    """The candidate fitted to all rows of ``train``, by its batch form where it has one."""
    if candidate.batch:
        return ProjectedScorer(candidate.batch(train, [F.lit(True)]), candidate, train, seed)
    return candidate.fit(train, seed)


def break_ties(calibrated: Column, rank: Column, n: Column) -> Column:
    """Original order inside the plateaus: shifts of at most 2e-9, still inside [0, 1]."""
    return calibrated * (1 - 2 * TIE_EPSILON) + TIE_EPSILON * (1 + rank / n)


def score_points(df: DataFrame, label: str, score: str | Column, by: str | None = None) -> DataFrame:
    """(by, x, n, s): outcomes and their sum per score, of rows that have both."""
    rows = df.select(*([by] if by else []), (F.col(score) if isinstance(score, str) else score).cast("double").alias("x"), F.col(label).cast("double").alias("_y"))
    return rows.dropna(subset=["x", "_y"]).groupBy(*([by] if by else []), "x").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"))


def fit_isotonic(df: DataFrame, label: str, score: str) -> isotonic.Curves:
    """Isotonic fit on the (score -> outcomes) table instead of the rows."""
    return isotonic.fit(score_points(df, label, score).withColumn("curve", F.lit(0)))


def fit_isotonic_in_folds(points: DataFrame, k: int, fold: str = "fold") -> isotonic.Curves:
    """Curve t is that of all folds but t; one fit for all."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: t != F.col(fold))
    spread = points.select(F.explode(others).alias("curve"), "x", "n", "s")
    return isotonic.fit(spread.groupBy("curve", "x").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))


#: Copies of a curve's value, among which the rows of its score are dealt.
SALTS = 16


def apply_isotonic(model: isotonic.Curves, df: DataFrame, score: str, out: str, missing: float | Column | None = None, curve: str | None = None) -> DataFrame:
    """Calibrated score with the order of the raw one kept (among rows of one ``curve``); NULL raw scores take ``missing``.

    The curve is read once per distinct score; a score that many rows share is joined back by row salts."""
    plain = [c for c in df.columns if c != out]
    by = [curve] if curve else []
    ranked = ranks.tied_rank(df.where(F.col(score).isNotNull()), score, "_rank", by)
    which = F.col(curve) if curve else F.lit(0)
    known = df.where(F.col(score).isNotNull()).select(which.cast("int").alias("curve"), F.col(score).cast("double").alias("x"))
    asked = known.groupBy("curve", "x").agg(F.count(F.lit(1)).alias("n"))
    values = isotonic.evaluate(model, asked, "iso").select(
        F.col("curve").alias("_c"), F.col("x").alias("_x"), "iso", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    totals = known.groupBy("curve").agg(F.count(F.lit(1)).alias("_total")).withColumnRenamed("curve", "_t")
    salt = F.pmod(F.xxhash64(*plain), F.lit(SALTS))
    rows = ranked.join(values, (which.cast("int") == F.col("_c")) & (F.col(score).cast("double") == F.col("_x")) & (salt == F.col("_salt")))
    rows = rows.join(F.broadcast(totals), F.col("_c") == F.col("_t"))  # one row per curve
    done = rows.select(*plain, break_ties(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("iso"))), F.col("_rank"), F.col("_total")).alias(out))
    rest = df.where(F.col(score).isNull()).select(*plain, (missing if isinstance(missing, Column) else F.lit(missing)).cast("double").alias(out))
    return done.unionByName(rest)


@dataclass
class UnivariateScorer(Scorer):
    """Ranks by one column through an isotonic curve; NULL → prevalence of the training rows."""

    column: str
    sign: float
    prevalence: float
    curve: isotonic.Curves

    def score(self, df: DataFrame) -> DataFrame:
        raw = df.withColumn("_raw", F.col(self.column).cast("double") * self.sign)
        return apply_isotonic(self.curve, raw, "_raw", SCORE, self.prevalence).drop("_raw")


Fit = Callable[[DataFrame, int], Scorer]


@dataclass(frozen=True)
class Candidate:
    name: str
    role: str
    fit: Fit
    features: tuple[str, ...] = MODEL_FEATURES
    extra: dict[str, Any] = field(default_factory=dict)
    #: Fits many training sets and labels in shared scans: the arguments of :func:`batched.fit` without the features.
    batch: Callable[..., batched.Batch] | None = None
    #: Scores every row by the model of the other folds: (table, folds, fold column) -> table with the score.
    in_folds: Callable[[DataFrame, int, str], DataFrame] | None = None


def prior() -> Candidate:
    def fit(train: DataFrame, seed: int) -> Scorer:
        return PriorScorer(float(train.agg(F.avg(TARGET)).first()[0]))

    return Candidate("dummy_prior", "piso absoluto", fit)


def univariate(name: str, column: str, sign: float = -1.0) -> Candidate:
    def fit(train: DataFrame, seed: int) -> Scorer:
        prevalence = float(train.agg(F.avg(TARGET)).first()[0])
        curve = fit_isotonic(train.withColumn("_raw", F.col(column).cast("double") * sign), TARGET, "_raw")
        return UnivariateScorer(column, sign, prevalence, curve)

    def in_folds(df: DataFrame, k: int, fold: str) -> DataFrame:
        raw = df.withColumn("_raw", F.col(column).cast("double") * sign)
        curves = fit_isotonic_in_folds(score_points(raw, TARGET, "_raw", fold), k, fold)
        sums = {r[fold]: (r["n"], r["s"]) for r in df.groupBy(fold).agg(F.count(TARGET).alias("n"), F.sum(TARGET).alias("s")).collect()}
        n, s = (sum(v[i] or 0 for v in sums.values()) for i in range(2))
        rest = {f: (n - v[0], s - (v[1] or 0)) for f, v in sums.items()}
        prevalence = F.create_map(*[F.lit(x) for f, (m, t) in rest.items() for x in (f, t / m if m else 0.0)])[F.col(fold)] if rest else F.lit(None)
        return apply_isotonic(curves, raw, "_raw", SCORE, prevalence, fold).drop("_raw")

    return Candidate(name, "regra de uma variável", fit, (column,), in_folds=in_folds)


def _vectors(train: DataFrame, features: Sequence[str], indicators: bool) -> tuple[Preprocessor, DataFrame]:
    preprocessor = fit_preprocessor(train, features, indicators)
    return preprocessor, preprocessor.transform(train, F.col(TARGET).cast("double").alias("label"))


def logistic(features: Sequence[str] = PRUNED_FEATURES, name: str = "logistica_podada", indicators: bool = False) -> Candidate:
    """Ridge logistic regression; the penalty 1/n equals an inverse strength of one on the summed loss."""
    def fit(train: DataFrame, seed: int) -> LinearOrTreeScorer:
        preprocessor, vectors = _vectors(train, features, indicators)
        n = train.count()
        model = LogisticRegression(regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-7)
        return LinearOrTreeScorer(preprocessor, model.fit(vectors))

    def batch(df: DataFrame, sets: Sequence[Column], label: str | Column = TARGET, **more: Any) -> batched.Batch:
        return batched.fit(df, sets, label, features, indicators, **more)

    return Candidate(name, "linear interpretável", fit, tuple(features), batch=batch)


def forest(features: Sequence[str] = MODEL_FEATURES, name: str = "random_forest", **params: Any) -> Candidate:
    settings = {**FOREST_DEFAULTS, **params}

    def fit(train: DataFrame, seed: int) -> LinearOrTreeScorer:
        preprocessor, vectors = _vectors(train, features, True)
        return LinearOrTreeScorer(preprocessor, RandomForestClassifier(seed=seed, **settings).fit(vectors))

    return Candidate(name, "não linear, sem boosting", fit, tuple(features), settings)


def boosting(features: Sequence[str] = MODEL_FEATURES, name: str = "boosting_padrao", **params: Any) -> Candidate:
    settings = {**GBT_DEFAULTS, **params}

    def fit(train: DataFrame, seed: int) -> LinearOrTreeScorer:
        preprocessor, vectors = _vectors(train, features, True)
        return LinearOrTreeScorer(preprocessor, GBTClassifier(seed=seed, **settings).fit(vectors))

    return Candidate(name, "boosting", fit, tuple(features), settings)


def default_candidates(tuned: dict[str, Any] | None = None) -> list[Candidate]:
    return [
        prior(), univariate("heuristica_taxa_municipal", "mun_taxa_alfab_lag1"),
        univariate("heuristica_proficiencia_municipal", "mun_media_portugues_lag1"), logistic(), forest(), boosting(),
        boosting(name="boosting_tunado", **(tuned or {})),
    ]


# Comparisons to publish, from the floor up.
PAIRS = (
    ("dummy_prior", "heuristica_taxa_municipal"), ("heuristica_taxa_municipal", "heuristica_proficiencia_municipal"),
    ("heuristica_taxa_municipal", "logistica_podada"), ("logistica_podada", "boosting_padrao"),
    ("boosting_padrao", "boosting_tunado"), ("boosting_tunado", "random_forest"), ("heuristica_taxa_municipal", "boosting_tunado"),
)


def fits_at_once(df: DataFrame, k: int) -> int:
    """How many folds' fits give every core four tasks; one where a table alone does, so that only one fit is held at a time."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(k, 4 * cores // max(1, df.rdd.getNumPartitions())))


def out_of_fold(df: DataFrame, candidate: Candidate, k: int, seed: int = SEED, fold: str = "fold", keep: Sequence[str] = (),
                together: int = 1) -> tuple[DataFrame, dict[int, float]]:
    """Every row scored by a model that never saw its group; fit seconds per fold beside.

    A candidate with a batch form is fitted to all folds in the same scans, and its scores are a projection of ``df``; one with a
    form for folds shares their passes. Others are fitted ``together`` folds at a time; more than one share the seconds."""
    kept = [c for c in dict.fromkeys(["row_id", GROUP, TARGET, WEIGHT, fold, *keep]) if c in df.columns]
    if candidate.batch:
        start = time.time()
        made = candidate.batch(df, batched.fold_sets(k, fold))
        each = (time.time() - start) / k
        return df.select(*kept, batched.probability(made.base, made.fitted.gamma(), F.col(fold)).alias(SCORE)), dict.fromkeys(range(k), each)
    if candidate.in_folds:
        start = time.time()
        scored = materialize(candidate.in_folds(df, k, fold).select(*kept, SCORE))
        return scored, dict.fromkeys(range(k), (time.time() - start) / k)

    def one(i: int) -> tuple[DataFrame, float]:
        start = time.time()
        scorer = candidate.fit(df.where(F.col(fold) != i), seed)
        took = time.time() - start
        return materialize(scorer.score(df.where(F.col(fold) == i)).select(*kept, SCORE)), took

    ensure_checkpoint_dir(df.sparkSession)
    with ThreadPoolExecutor(together) as pool:
        made = list(pool.map(inheritable_thread_target(df.sparkSession)(one), range(k)))
    return functools.reduce(DataFrame.unionByName, [part for part, _ in made]), {i: took for i, (_, took) in enumerate(made)}


def evaluate_in_folds(df: DataFrame, candidates: Sequence[Candidate], k: int = 5, seed: int = SEED, done: DataFrame | None = None, together: int = 1) -> DataFrame:
    """One row per model and fold; models already in ``done`` keep their rows and are not refitted."""
    ready = set() if done is None else {r["modelo"] for r in done.select("modelo").distinct().collect()}
    table = done
    for c in candidates:
        if c.name in ready:
            continue
        scored, seconds = out_of_fold(df, c, k, seed, together=together)
        measured = metrics.ranking_metrics(scored, TARGET, SCORE, ["fold"])
        clock = F.create_map(*[v for i, s in seconds.items() for v in (F.lit(i), F.lit(round(s, 1)))])[F.col("fold")]
        rows = measured.select(
            F.lit(c.name).alias("modelo"), F.lit(c.role).alias("papel"), "fold", F.lit(len(c.features)).alias("n_features"),
            "roc_auc", "pr_auc", "ks", "brier", "prevalencia", "n", clock.alias("segundos"))
        rows = materialize(rows)
        table = rows if table is None else table.unionByName(rows)
    return table
