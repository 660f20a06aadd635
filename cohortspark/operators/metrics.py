"""Exact ranking, threshold and calibration metrics from score histograms.

A histogram has one row per (strata, score) with the number of positives and negatives. One cumulative
pass over it gives AUC, average precision, KS and the best threshold, for all strata at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.stats import pearson, share
from cohortspark.operators import ranks


def known_scores(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rows that can be ranked: a 0/1 label and a score that is neither NULL nor NaN."""
    value = F.col(score).cast("double")
    return df.withColumn("_score", F.when(value == 0, F.lit(0.0)).otherwise(value)).where(
        F.col("_score").isNotNull() & ~F.isnan("_score") & F.col(label).isin(0, 1))


def score_histogram(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: Column | None = None,
) -> DataFrame:
    """(by, score) → n_pos, n_neg; ``weight`` is a whole-number frequency weight."""
    one = F.lit(1) if weight is None else weight
    return known_scores(df, label, score).groupBy(*by, F.col("_score").alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, one).otherwise(0)).cast("bigint").alias("n_pos"),
        F.sum(F.when(F.col(label) == 0, one).otherwise(0)).cast("bigint").alias("n_neg"),
    )


def ranking_from_histogram(
    hist: DataFrame, by: Sequence[str] = (), edges: Sequence[float] | None = None, scale_of: str | None = None,
) -> DataFrame:
    """roc_auc, pr_auc, ks, brier, prevalencia, n and the F1 threshold per stratum."""
    c = ranks.cumulate(hist, "score", ["n_pos", "n_neg"], by, edges, scale_of)
    pos, neg = F.col("n_pos_total").cast("double"), F.col("n_neg_total").cast("double")
    both = (pos > 0) & (neg > 0)
    true_pos = F.col("n_pos_total") - F.col("n_pos_before")
    false_pos = F.col("n_neg_total") - F.col("n_neg_before")
    alarms = true_pos + false_pos
    s = F.col("score")
    f1 = 2.0 * true_pos / (alarms + pos)
    table = c.where(alarms > 0).groupBy(*by).agg(
        F.sum(F.when(both, F.col("n_pos") * (F.col("n_neg_before") + F.col("n_neg") / 2) / (pos * neg))).alias("roc_auc"),
        F.sum(F.when(both, F.col("n_pos") / pos * true_pos / alarms)).alias("pr_auc"),
        F.max(F.when(both, F.greatest(F.lit(0.0), true_pos / pos - false_pos / neg))).alias("ks"),
        F.try_divide(F.sum(F.col("n_pos") * (s - 1) * (s - 1) + F.col("n_neg") * s * s),
                     F.sum(F.col("n_pos") + F.col("n_neg"))).alias("brier"),
        F.try_divide(F.sum("n_pos"), F.sum(F.col("n_pos") + F.col("n_neg"))).alias("prevalencia"),
        F.sum(F.col("n_pos") + F.col("n_neg")).cast("bigint").alias("n"),
        F.max_by(s, F.struct(F.round(f1, 12), -s)).alias("limiar_f1"),
    )
    return table


def ranking_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return ranking_from_histogram(score_histogram(df, label, score, by), by).drop("limiar_f1")


def ks(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, label, score, by).select(*by, "ks")


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC with ties at half credit; NULL scores dropped, NULL result with one class only."""
    return ranking_metrics(df, label, score, by).select(*by, F.col("roc_auc").alias("auc"))


#: Outcomes per score of one check within one range of scores, packed as numbers.
PIECE = "check int, cell int, score binary, n_pos binary, n_neg binary"
#: Rows of a check that one range holds, about, and most ranges of a check.
RANGE_ROWS, MAX_RANGES = 100_000, 4096


def ranges_for(rows: int) -> int:
    return max(1, min(MAX_RANGES, -(-rows // RANGE_ROWS)))


def pieces_of(checks: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """``PIECE`` rows of (check, scores, 0/1 labels, range limits); equal scores are summed, NaN is left out."""
    made: list[list] = [[], [], [], [], []]
    for check, scores, labels, edges in checks:
        known = ~np.isnan(scores)
        score, at = np.unique(scores[known], return_inverse=True)
        pos = np.bincount(at, labels[known], len(score)).astype("<i4")
        neg = np.bincount(at, minlength=len(score)).astype("<i4") - pos
        cuts = np.searchsorted(score, edges, "right").tolist()
        for cell, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(score)])):
            if low < high:
                for held, value in zip(made, (check, cell, score[low:high].tobytes(), pos[low:high].tobytes(), neg[low:high].tobytes())):
                    held.append(value)
    if made[0]:
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, types)], names=[c.split()[0] for c in PIECE.split(", ")])


def auc_of_pieces(pieces: DataFrame) -> DataFrame:
    """(check, auc): every range of a check is put in order by itself, ranges are added up in theirs."""
    def areas(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(name)])
        score, at = np.unique(read("score", "<f8"), return_inverse=True)
        pos, neg = (np.bincount(at, read(name, "<i4"), len(score)).astype(np.int64) for name in ("n_pos", "n_neg"))
        area = (pos * (np.cumsum(neg) - neg + neg / 2)).sum()
        return pa.table([table.column("check").slice(0, 1), table.column("cell").slice(0, 1), pa.array([int(pos.sum())]), pa.array([int(neg.sum())]), pa.array([float(area)])],
                        names=["check", "cell", "pos", "neg", "area"])

    cells = pieces.groupBy("check", "cell").applyInArrow(areas, "check int, cell int, pos long, neg long, area double")
    before = F.coalesce(F.sum("neg").over(Window.partitionBy("check").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.withColumn("before", before).groupBy("check").agg(
        F.try_divide(F.sum(F.col("area") + F.col("pos") * F.col("before")), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def melt_features(df: DataFrame, label: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, score, label) rows, aggregated to a histogram by the caller in the same stage."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*by, label, F.explode(pairs).alias("p")).select(*by, label, "p.feature", "p.value")


def auc_by_feature(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Univariate AUC of many features in one histogram; availability and orientation beside it."""
    long = melt_features(df, label, features)
    filled = df.agg(*[share(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))).alias(f) for f in features])
    available = filled.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("pct_disponivel")) for f in features])).alias("p")).select("p.*")
    hist = score_histogram(long, label, "value", ["feature"])
    scored = ranking_from_histogram(hist, ["feature"], scale_of="feature").select("feature", F.col("roc_auc").alias("auc"))
    return available.join(scored, "feature", "left").withColumn(
        "auc_orientada", F.greatest("auc", 1 - F.col("auc")))


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates when ``score >= threshold`` raises the alarm."""
    limit = F.lit(float(threshold)) if not isinstance(threshold, Column) else threshold
    alarm, positive = F.col(score) >= limit, F.col(label) == 1
    counted = df.groupBy(*by).agg(
        F.max(limit).alias("limiar"),
        F.count_if(alarm & positive).alias("vp"), F.count_if(alarm & ~positive).alias("fp"),
        F.count_if(~alarm & positive).alias("fn"), F.count_if(~alarm & ~positive).alias("vn"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, fn, tn = F.col("vp"), F.col("fp"), F.col("fn"), F.col("vn")
    return counted.select(
        *by, "limiar", ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp).alias("precisao"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tn, tn + fp).alias("especificidade"),
        ratio(tp + fp, tp + fp + fn + tn).alias("taxa_de_alerta"), "vp", "fp", "fn", "vn",
    )


def best_f1_threshold(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Observed score whose use as threshold maximises F1 (the lowest one on a tie)."""
    return ranking_from_histogram(score_histogram(df, label, score, by), by).select(
        *by, F.col("limiar_f1").alias("limiar"))


CAPACITY_FRACTIONS = (0.05, 0.10, 0.20, 0.30, 0.40, 0.50)


def capacity_curve(df: DataFrame, label: str, score: str, key: str, fractions: Sequence[float] = CAPACITY_FRACTIONS) -> DataFrame:
    """Recall, precision and lift when the top fraction by score is served; ties by ``key``.

    The cut size is the half-even rounded share of the rows, one at least.
    """
    placed = ranks.row_number(df.select(label, score, key), score, key, "_pos", descending=True, with_total="_n")
    cuts = {f: F.greatest(F.bround(F.round(F.lit(float(f)) * F.col("_n"), 9)), F.lit(1)) for f in fractions}
    hits = [F.sum(F.when(F.col("_pos") <= cut, F.col(label)).otherwise(0)).alias(f"h{i}") for i, cut in enumerate(cuts.values())]
    served = [F.max(cut).alias(f"s{i}") for i, cut in enumerate(cuts.values())]
    sums = placed.agg(F.sum(label).alias("total"), F.avg(label).alias("mean"), F.count(F.lit(1)).alias("rows"), *hits, *served)
    each = F.explode(F.array(*[
        F.struct(F.lit(float(f)).alias("fracao_atendida"), F.col(f"h{i}").alias("hits"), F.col(f"s{i}").alias("served")) for i, f in enumerate(cuts)]))
    return sums.where("rows > 0").select("total", "mean", each.alias("c")).select(
        "c.fracao_atendida",
        F.col("c.served").cast("bigint").alias("n_atendidos"),
        F.try_divide("c.hits", "total").alias("recall"),
        (F.col("c.hits") / F.col("c.served")).alias("precisao"),
        F.try_divide(F.col("c.hits") / F.col("c.served"), F.col("mean")).alias("lift"))


def lift_by_decile(df: DataFrame, label: str, score: str, key: str, bins: int = 10) -> DataFrame:
    binned = ranks.equal_frequency(df.select(label, score, key), score, key, bins, "decil", descending=True)
    table = binned.groupBy("decil").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("_k"))
    total = table.agg((F.sum("_k") / F.sum("n")).alias("m")).scalar()
    return table.select("decil", "n", (F.col("_k") / F.col("n")).alias("taxa"),
                        F.try_divide(F.col("_k") / F.col("n"), total).alias("lift"))


def calibration_curve(df: DataFrame, label: str, score: str, key: str, bins: int = 20) -> DataFrame:
    binned = ranks.equal_frequency(df.select(label, score, key), score, key, bins, "bin")
    return binned.groupBy((F.col("bin") - 1).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("predito"), F.avg(label).alias("observado"))


def stratified_metrics(df: DataFrame, label: str, score: str, strata: Mapping[str, Column], minimum: int = 500) -> DataFrame:
    """One row per (dimension, level); small or one-class levels stay, with NULL metrics."""
    levels = F.array(*[
        F.struct(F.lit(name).alias("dimensao"), level.cast("string").alias("estrato")) for name, level in strata.items()])
    long = df.select(label, score, F.explode(levels).alias("s")).select(label, score, "s.*").where(
        F.col("estrato").isNotNull())
    table = ranking_metrics(long, label, score, ["dimensao", "estrato"])
    measured = (F.col("n") >= minimum) & F.col("roc_auc").isNotNull()
    return table.select(
        "dimensao", "estrato", "n", "prevalencia",
        *[F.when(measured, F.col(m)).alias(m) for m in ("roc_auc", "pr_auc", "ks", "brier")])


def aggregate_scores(
    df: DataFrame, label: str, score: str, group: str, weight: str | None = None,
) -> DataFrame:
    """Scores to group grain: size, population, weighted observed and predicted rate, score variance."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_alunos_avaliados"),
        F.sum(w).alias("populacao_estimada"),
        F.coalesce(F.var_samp(score), F.lit(0.0)).alias("variancia_do_escore"),
        (F.sum(F.col(label) * w) / F.sum(w)).alias("taxa_observada_de_risco"),
        (F.sum(F.col(score) * w) / F.sum(w)).alias("risco_medio_oof"),
    )


def group_fit(
    df: DataFrame, label: str, score: str, group: str, weight: str | None = None, minimums: Sequence[int] = (0, 50, 200),
) -> DataFrame:
    """R², correlation and mean bias of the group risk against the observed rate, by minimum size."""
    table = aggregate_scores(df, label, score, group, weight).select(
        F.col("n_alunos_avaliados").alias("n"), F.col("taxa_observada_de_risco").alias("o"),
        F.col("risco_medio_oof").alias("p"),
        F.explode(F.array(*[F.lit(m) for m in minimums])).alias("porte_minimo"))
    o, p = F.col("o"), F.col("p")
    return table.where(F.col("n") >= F.col("porte_minimo")).groupBy("porte_minimo").agg(
        F.count(F.lit(1)).alias("n_municipios"),
        (1 - F.try_divide(F.sum((o - p) * (o - p)), F.var_pop(o) * F.count(o))).alias("r2"),
        pearson(o, p).alias("correlacao"),
        F.avg(p - o).alias("vies_medio"),
    )
