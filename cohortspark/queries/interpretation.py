"""Attributions, permutations, coefficients and their triangulation, all measured on held-out municipalities."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import contracts as C
from cohortspark.models import candidates as M
from cohortspark.models import interpret, split
from cohortspark.queries.modelling import FOLDS, SMALL, matrix, small_boosting
from cohortspark.queries.registry import query
from cohortspark.session import materialize

FAMILY = {f: name for name, group in C.FEATURE_FAMILIES.items() for f in group}
REPEATS = 10


def families(spark):
    return spark.createDataFrame([(f, FAMILY[f]) for f in C.MODEL_FEATURES if f in FAMILY], "feature string, familia string")


def sides(spark, folder):
    return materialize(split.holdout(matrix(spark, folder)))


def held_out(spark, folder):
    """(model of all features trained on the development side, rows of the held-out side)."""
    rows = sides(spark, folder)
    made = M.logistic(C.MODEL_FEATURES, "logistica", True).batch(rows, [~F.col("teste")])
    return made, rows.where(F.col("teste"))


def attributions(spark, folder, keep=()):
    return interpret.linear_attributions(*held_out(spark, folder), keep)


@query("linear_attribution_importance")
def linear_attribution_importance(spark, folder):
    return interpret.importance_by_column(attributions(spark, folder).long())


@query("sampled_attribution_importance")
def sampled_attribution_importance(spark, folder):
    """Sampled Shapley values of the boosting model on 1,000 held-out rows, eight orders each."""
    rows = sides(spark, folder)
    scorer = small_boosting().fit(rows.where(~F.col("teste")), C.SEED)
    return interpret.importance_by_column(interpret.sampled_attributions(scorer, rows.where(F.col("teste")), SMALL))


@query("attribution_by_feature")
def attribution_by_feature(spark, folder):
    return interpret.grouped_reading(attributions(spark, folder), {f: f for f in C.MODEL_FEATURES}, "feature")


@query("attribution_by_family")
def attribution_by_family(spark, folder):
    return interpret.grouped_reading(attributions(spark, folder), FAMILY, "familia")


@query("attribution_slice_change")
def attribution_slice_change(spark, folder):
    """The same reading on the whole held-out side and where the lag came from the own cohort."""
    made = attributions(spark, folder, ["fonte_lag_municipal"])
    sliced = interpret.LinearReading(made.columns, interpret.with_slices(made.rows, "fonte_lag_municipal", C.SOURCE_GOLD))
    return interpret.slice_change(interpret.grouped_reading(sliced, {f: f for f in C.MODEL_FEATURES}, "feature", ["recorte"]), C.SOURCE_GOLD)


@query("permutation_importance")
def permutation_importance(spark, folder):
    """Twenty features, ten repeats."""
    return interpret.permutation_importance(*held_out(spark, folder), C.MODEL_FEATURES, REPEATS)


@query("block_permutation_ratio")
def block_permutation_ratio(spark, folder):
    """Five families shuffled together against the sum of their features, ten repeats, all in one plan."""
    blocks = {**{n: list(b) for n, b in C.FEATURE_FAMILIES.items()}, **{f: [f] for f in FAMILY}}
    drops = materialize(interpret.block_permutation(*held_out(spark, folder), blocks, REPEATS))
    of_families = F.col("bloco").isin(*C.FEATURE_FAMILIES)
    return interpret.block_against_singles(drops.where(of_families), drops.where(~of_families).withColumnRenamed("bloco", "feature"), families(spark))


def coefficients(spark, folder):
    """The pruned model on the development side and on its five folds."""
    return interpret.linear_coefficients(materialize(split.folds(sides(spark, folder).where(~F.col("teste")), FOLDS)), C.PRUNED_FEATURES, FOLDS)


@query("linear_coefficients")
def linear_coefficients(spark, folder):
    return coefficients(spark, folder)


@query("linear_contribution_by_feature")
def linear_contribution_by_feature(spark, folder):
    return interpret.contribution_by_feature(coefficients(spark, folder))


@query("reading_triangulation")
def reading_triangulation(spark, folder):
    made, rows = held_out(spark, folder)
    shap = interpret.grouped_reading(interpret.linear_attributions(made, rows), {f: f for f in C.MODEL_FEATURES}, "feature")
    singles = interpret.permutation_importance(made, rows, C.MODEL_FEATURES, REPEATS)
    return interpret.triangulate(shap, singles, interpret.contribution_by_feature(coefficients(spark, folder)))
