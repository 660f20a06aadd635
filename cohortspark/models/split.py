"""Splits by whole groups: hold-out, stratified folds, and the check that no group crosses a split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.contracts import GROUP, SEED, TARGET
from cohortspark.operators import ranks
from cohortspark.operators.quality import QualityError


def assert_disjoint(df: DataFrame, side: str, group: str = GROUP) -> None:
    crossing = df.groupBy(group).agg(F.min(side).alias("a"), F.max(side).alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
    bad = crossing.limit(5).collect()
    if bad:
        raise QualityError(f"groups on both sides of {side}: {[r[group] for r in bad]}")


def assert_grouped(df: DataFrame, group: str) -> None:
    """Splits by group are undefined for rows without one, and must not lose them."""
    if df.where(F.col(group).isNull()).limit(1).count():
        raise QualityError(f"rows without {group}")


def holdout(df: DataFrame, fraction: float = 0.20, seed: int = SEED, group: str = GROUP, out: str = "teste") -> DataFrame:
    """Marks a fraction of the *groups* (rounded up) as held out, in a seeded hash order."""
    assert_grouped(df, group)
    groups = ranks.hash_position(df.select(group).distinct(), [group], seed, "_pos")
    total = df.agg(F.count_distinct(group).alias("n")).scalar()
    sides = groups.select(group, (F.col("_pos") <= F.ceil(F.lit(fraction) * total)).alias(out))
    return df.join(sides, group)


def folds(df: DataFrame, k: int = 5, seed: int = SEED, label: str = TARGET, group: str = GROUP, out: str = "fold") -> DataFrame:
    """Adds a fold per group: groups ordered by size tier and prevalence are dealt out in a serpentine."""
    assert_grouped(df, group)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.avg(label).alias("_p"))
    edges = ranks.quantile_edges(sizes, "_n", 5)
    tier = sum((F.when(F.col("_n") > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    keyed = sizes.select(group, (2 * tier + F.coalesce("_p", F.lit(0.0))).alias("_order"), ranks.md5_number(F.lit(seed), F.col(group)).alias("_tie"))
    placed = ranks.row_number(keyed, "_order", "_tie", "_pos")
    turn = F.pmod(F.col("_pos") - 1, F.lit(2 * k))
    dealt = placed.select(group, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias(out))
    return df.join(dealt, group)


def split_summary(df: DataFrame, side: str, label: str = TARGET, group: str = GROUP) -> DataFrame:
    return df.groupBy(side).agg(
        F.count(F.lit(1)).alias("n_alunos"), F.count_distinct(group).alias("n_municipios"), F.avg(label).alias("prevalencia"))
