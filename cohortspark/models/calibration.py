"""Isotonic calibration fitted out of fold and used only when it pays on rows it was not fitted to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.contracts import SEED, TARGET
from cohortspark.models.candidates import SCORE, Candidate, Scorer, apply_isotonic, fit_isotonic, fit_isotonic_in_folds, out_of_fold, score_points, scorer_of
from cohortspark.operators import isotonic
from cohortspark.session import materialize


def crossfit_gain(oof: DataFrame, k: int, label: str = TARGET, score: str = SCORE) -> DataFrame:
    """Brier before and after calibration, each fold calibrated by the curve of the others.

    Both follow from the outcomes per score; the tie-break, which moves a score by 2e-9 at most, is left out."""
    points = materialize(score_points(oof, label, score, "fold"))
    curves = fit_isotonic_in_folds(points, k)
    read = isotonic.evaluate(curves, points.withColumn("curve", F.col("fold")), "cal")
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cal")))
    brier = lambda p: F.sum(F.col("s") * (1 - p) ** 2 + (F.col("n") - F.col("s")) * p ** 2) / F.sum("n")
    table = read.agg(brier(F.col("x")).alias("brier_bruto"), brier(c).alias("brier_calibrado"))
    return table.withColumn("ganho_brier", F.col("brier_bruto") - F.col("brier_calibrado"))


@dataclass
class CalibratedScorer(Scorer):
    base: Scorer
    curve: isotonic.Curves
    apply: bool
    gain: float
    oof: DataFrame

    def calibrate(self, df: DataFrame) -> DataFrame:
        """``escore`` calibrated when the curve has proven useful, untouched otherwise."""
        if not self.apply:
            return df
        raw = df.withColumnRenamed(SCORE, "_bruto")
        return apply_isotonic(self.curve, raw, "_bruto", SCORE).drop("_bruto")

    def score(self, df: DataFrame) -> DataFrame:
        return self.calibrate(materialize(self.base.score(df)))


def fit_calibrated(df: DataFrame, candidate: Candidate, k: int = 5, seed: int = SEED, apply: bool | None = None) -> CalibratedScorer:
    """``df`` carries the folds; the base model is refitted on all rows."""
    oof, _ = out_of_fold(df, candidate, k, seed)
    gain = float(crossfit_gain(oof, k).first()["ganho_brier"])
    return CalibratedScorer(scorer_of(candidate, df, seed), fit_isotonic(oof, TARGET, SCORE), gain > 0 if apply is None else apply, gain, oof)
