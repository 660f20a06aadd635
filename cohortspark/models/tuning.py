"""Random search over mapped boosting parameters on whole-group samples, resumable, with an edge check."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.contracts import SEED, TARGET
from cohortspark.models import candidates as M
from cohortspark.operators import metrics
from cohortspark.session import materialize

# Ranges: (kind, low, high). Leaves, column sampling and leaf penalties have no counterpart in MLlib.
SPACE: Mapping[str, tuple[str, float, float]] = {
    "maxIter": ("int", 200, 899), "maxDepth": ("int", 4, 12), "stepSize": ("log", 0.01, 0.2),
    "minInstancesPerNode": ("int", 50, 2000), "subsamplingRate": ("float", 0.6, 1.0),
}


def draw_settings(n: int, seed: int = SEED, space: Mapping[str, tuple[str, float, float]] = SPACE) -> list[dict[str, Any]]:
    rng = random.Random(seed)

    def one(kind: str, low: float, high: float):
        if kind == "int":
            return rng.randint(int(low), int(high))
        return math.exp(rng.uniform(math.log(low), math.log(high))) if kind == "log" else rng.uniform(low, high)

    return [{name: one(*spec) for name, spec in space.items()} for _ in range(n)]


def _try(df: DataFrame, number: int, settings: Mapping[str, Any], k: int, seed: int, features: Sequence[str]) -> DataFrame:
    scored, seconds = M.out_of_fold(df, M.boosting(features, **settings), k, seed)
    folds = metrics.ranking_metrics(scored, TARGET, M.SCORE, ["fold"])
    table = folds.agg(F.avg("roc_auc").alias("roc_auc"), F.stddev_samp("roc_auc").alias("roc_auc_dp"), F.avg("brier").alias("brier"))
    return materialize(table.select(
        F.lit(number).alias("iteracao"), "roc_auc", "roc_auc_dp", "brier", F.lit(round(sum(seconds.values()), 1)).alias("segundos"),
        *[F.lit(float(v)).alias(n) for n, v in settings.items()]))


def search(df: DataFrame, settings: Sequence[Mapping[str, Any]], k: int = 5, seed: int = SEED,
           features: Sequence[str] = M.MODEL_FEATURES, done: DataFrame | None = None) -> DataFrame:
    """One row per setting; iterations already in ``done`` are kept and skipped."""
    ready = set() if done is None else {r["iteracao"] for r in done.select("iteracao").collect()}
    table = done
    for i, s in enumerate(settings):
        if i not in ready:
            row = _try(df, i, s, k, seed, features)
            table = row if table is None else table.unionByName(row)
    return table


def best_settings(table: DataFrame, space: Mapping[str, tuple[str, float, float]] = SPACE) -> dict[str, Any]:
    row = table.orderBy(F.col("roc_auc").desc(), "iteracao").first()
    return {n: int(row[n]) if spec[0] == "int" else float(row[n]) for n, spec in space.items()}


def extended_grid(best: Mapping[str, Any], beyond: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    """All combinations past the edge of the named parameters, the others fixed at the optimum."""
    grid: list[dict[str, Any]] = [dict(best)]
    for name, values in beyond.items():
        grid = [{**g, name: v} for g in grid for v in values]
    return grid


def edge_flags(table: DataFrame, parameters: Sequence[str], slack: float = 0.05) -> DataFrame:
    """Did the optimum land within 5 % of the sampled range's border?"""
    best = table.agg(*[F.max_by(p, F.struct("roc_auc", -F.col("iteracao"))).alias(f"b_{p}") for p in parameters],
                     *[F.min(p).alias(f"l_{p}") for p in parameters], *[F.max(p).alias(f"h_{p}") for p in parameters])
    rows = best.select(F.explode(F.array(*[F.struct(
        F.lit(p).alias("parametro"), F.col(f"b_{p}").cast("double").alias("escolhido"), F.col(f"l_{p}").cast("double").alias("minimo_amostrado"),
        F.col(f"h_{p}").cast("double").alias("maximo_amostrado")) for p in parameters])).alias("p")).select("p.*")
    span = F.col("maximo_amostrado") - F.col("minimo_amostrado")
    near = (F.col("escolhido") <= F.col("minimo_amostrado") + slack * span) | (F.col("escolhido") >= F.col("maximo_amostrado") - slack * span)
    return rows.withColumn("na_borda", (span > 0) & near)
