"""Top-k and seeded samples that do not depend on how the data is partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.contracts import SEED
from cohortspark.operators import ranks


def top_k(df: DataFrame, value: str, key: str, k: int, largest: bool = True) -> DataFrame:
    order = F.col(value).desc_nulls_last() if largest else F.col(value).asc_nulls_last()
    return df.orderBy(order, F.col(key)).limit(k)


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), the first ones in a seeded hash order of the key."""
    return ranks.hash_position(df, key, seed, "_pos").where(F.col("_pos") <= n).drop("_pos")


def sample_groups(df: DataFrame, group: str, budget: int, seed: int = SEED) -> DataFrame:
    """Whole groups in a seeded order until the row budget is reached; no group is split."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    placed = ranks.hash_position(sizes, [group], seed, "_pos")
    filled = ranks.cumulate(placed, "_pos", ["_size"])
    return df.join(filled.where(F.col("_size_before") < budget).select(group), group, "left_semi")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Size of the intersection of two key lists."""
    return a.intersect(b).agg(F.count(F.lit(1)).alias("em_comum"))


def key_set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys only on the left, only on the right, on both sides, and whether the sets are equal or nested."""
    key = a.columns
    sides = a.distinct().withColumn("_l", F.lit(1)).unionByName(b.distinct().withColumn("_l", F.lit(2)))
    flags = sides.groupBy(*key).agg(F.sum("_l").alias("_l"))
    return flags.agg(
        F.count_if(F.col("_l") == 1).alias("so_a"), F.count_if(F.col("_l") == 2).alias("so_b"),
        F.count_if(F.col("_l") == 3).alias("em_ambos")).withColumns({
            "iguais": (F.col("so_a") == 0) & (F.col("so_b") == 0), "a_contido_em_b": F.col("so_a") == 0})
