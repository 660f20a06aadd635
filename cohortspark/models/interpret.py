"""Three readings of a model — attributions, permutations, linear coefficients — and how they agree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.contracts import FEATURE_FAMILIES, MODEL_FEATURES, NOISE_FLOOR, PRUNED_FEATURES, SEED, TARGET
from cohortspark.models import batched
from cohortspark.models import candidates as M
from cohortspark.models.preprocess import OutputColumn
from cohortspark.models.robustness import linear_drops, shuffled_drop
from cohortspark.operators import ranks
from cohortspark.operators.quality import QualityError, spearman
from cohortspark.operators.sampling import sample_rows
from cohortspark.session import materialize

TOP_FEATURES, TOP_LINEAR = 5, 3


def family_of(features: Sequence[str] = MODEL_FEATURES, families: Mapping[str, Sequence[str]] = FEATURE_FAMILIES) -> dict[str, str]:
    """Feature → family; gaps and overlaps of the partition are errors."""
    flat = [f for group in families.values() for f in group]
    repeated = sorted({f for f in flat if flat.count(f) > 1})
    missing, extra = sorted(set(features) - set(flat)), sorted(set(flat) - set(features))
    if repeated or missing or extra:
        raise QualityError(f"families do not partition the features: repeated {repeated}, missing {missing}, extra {extra}")
    return {f: name for name, group in families.items() for f in group}


def origin_of_levels(outputs: Sequence[str], columns: Sequence[str], separator: str = "=") -> dict[str, str]:
    """Each encoded column back to its source; a name that fits two sources is an error."""
    origin = {}
    for o in outputs:
        fits = [c for c in columns if o.startswith(f"{c}{separator}")]
        if len(fits) != 1:
            raise QualityError(f"ambiguous origin of {o!r}: {fits}")
        origin[o] = fits[0]
    return origin


# --- additive attributions -------------------------------------------------------------------------
def _linear_form(base: batched.Base, line: np.ndarray) -> Column:
    """constant + sum of weights times base entries, terms of weight zero left out."""
    return sum((entry * float(w) for entry, w in zip(base.entries, line[1:]) if w), F.lit(float(line[0])))


@dataclass(frozen=True)
class LinearReading:
    """Rows with ``_v``, the attribution of each of ``columns`` in their order."""

    columns: tuple[OutputColumn, ...]
    rows: DataFrame

    def long(self, keep: Sequence[str] = ()) -> DataFrame:
        names = F.array(*[F.struct(F.lit(c.name).alias("coluna"), F.lit(c.feature).alias("feature")) for c in self.columns])
        cells = self.rows.select("row_id", *keep, F.posexplode("_v").alias("i", "valor"))
        return cells.select("row_id", *keep, names[F.col("i")].alias("c"), "valor").select("row_id", *keep, "c.*", "valor")


def linear_attributions(made: batched.Batch, df: DataFrame, keep: Sequence[str] = (), model: int = 0) -> LinearReading:
    """Exact attributions coef * (x - mean over ``df``) of every row, as a projection: one aggregate for the means, no sample."""
    design, beta = made.fitted.designs[made.fitted.pairs[model][0]], made.fitted.beta[model]
    at = df.agg(*[F.avg(e).alias(f"e{i}") for i, e in enumerate(made.base.entries)]).first()
    entry_means = np.array([1.0, *[m or 0.0 for m in at]])
    lines = design.matrix[:, 1:] * beta[1:]
    lines[0] -= entry_means @ lines
    values = F.array(*[_linear_form(made.base, line) for line in lines.T])
    return LinearReading(design.columns, df.select("row_id", *keep, values.alias("_v")))


def grouped_reading(reading: LinearReading, group_of: Mapping[str, str], key: str, by: Sequence[str] = ()) -> DataFrame:
    """``grouped_importance`` of a linear reading: a row sums its own groups, so that rows are never shuffled by their id."""
    members: dict[str, list[int]] = {}
    for i, c in enumerate(reading.columns):
        members.setdefault(group_of[c.feature], []).append(i)
    total = lambda at, of: sum((of(F.col("_v")[i]) for i in at[1:]), of(F.col("_v")[at[0]]))
    cells = [F.struct(
        F.lit(name).alias(key), F.lit(len(at)).cast("bigint").alias("c"), F.lit(len({reading.columns[i].feature for i in at})).cast("bigint").alias("f"),
        total(at, lambda v: v).alias("s"), total(at, F.abs).alias("a")) for name, at in members.items()]
    return _published(reading.rows.select(*by, F.explode(F.array(*cells)).alias("g")).select(*by, "g.*"), key, by)


def sampled_attributions(scorer: M.LinearOrTreeScorer, df: DataFrame, features: Sequence[str], n: int = 1000, orders: int = 8,
                         seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """Shapley values by sampled feature orders against sampled background rows, on the margin scale.

    Every (row, order) walks from its background row to the row itself, one feature per step; the walk is
    a join and an explode, and all steps are scored by one transform. Contributions of a row sum to the
    difference of its margin from the background margins.
    """
    sample = materialize(sample_rows(df, n, ["row_id"], seed).select("row_id", *keep, *features))
    size = sample.count()
    placed = ranks.hash_position(sample, ["row_id"], seed, "_pos", salt=7)
    walks = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("_order"))
    walks = walks.withColumn("_bg", F.pmod(F.xxhash64(F.lit(seed), "row_id", "_order"), F.lit(max(size, 1))) + 1)
    background = placed.select(F.col("_pos").alias("_bg"), *[F.col(f).alias(f"_b_{f}") for f in features])
    walks = walks.join(background, "_bg")
    keys = F.sort_array(F.array(*[
        F.struct(F.xxhash64(F.lit(seed), "row_id", "_order", F.lit(f)).alias("h"), F.lit(f).alias("f")) for f in features]))
    walks = walks.withColumn("_seq", F.transform(keys, lambda p: p["f"]))
    steps = walks.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(features)))).alias("_step"))
    mixed = steps.select(
        "row_id", *[k for k in keep if k not in features], "_order", "_step", "_seq",
        *[F.when(F.array_position("_seq", f) <= F.col("_step"), F.col(f)).otherwise(F.col(f"_b_{f}")).alias(f) for f in features])
    scored = scorer.score(mixed, margin=True)
    walk = Window.partitionBy("row_id", "_order").orderBy("_step")
    gain = F.col(M.SCORE) - F.lag(M.SCORE).over(walk)
    moved = scored.select("row_id", *keep, "_step", F.col("_seq")[F.greatest(F.col("_step") - 1, F.lit(0))].alias("feature"), gain.alias("g"))
    return moved.where(F.col("_step") > 0).groupBy("row_id", *keep, "feature").agg(F.avg("g").alias("valor")).select(
        "row_id", *keep, F.col("feature").alias("coluna"), "feature", "valor")


def importance_by_column(attributions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    table = attributions.groupBy(*by, "coluna", "feature").agg(F.avg(F.abs("valor")).alias("shap_medio_abs"), F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy(*(by or [F.lit(0)]))
    return table.withColumn("participacao", F.try_divide(F.col("shap_medio_abs"), F.sum("shap_medio_abs").over(total)))


def grouped_importance(attributions: DataFrame, mapping: DataFrame | None, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group of columns: sum of mean |·|, mean |sum|, deviation, share and internal cancellation.

    ``mapping`` (feature → ``key``) is small metadata; None when ``key`` is already in the attributions.
    """
    rows = attributions if mapping is None else attributions.join(F.broadcast(mapping), "feature")
    inside = rows.groupBy(*by, key, "row_id").agg(
        F.sum("valor").alias("s"), F.sum(F.abs("valor")).alias("a"), F.count(F.lit(1)).alias("c"), F.count_distinct("feature").alias("f"))
    return _published(inside, key, by)


def _published(inside: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """One row per group from rows (s, a, c, f): sum, sum of sizes, columns and features of the group in one row."""
    table = inside.groupBy(*by, key).agg(
        F.count(F.lit(1)).alias("n"), F.max("c").alias("n_colunas"), F.max("f").alias("n_features"), F.avg("a").alias("soma_das_medias_abs"),
        F.avg(F.abs("s")).alias("media_do_abs_da_soma"), F.stddev_samp("s").alias("dp_da_soma"))
    total = Window.partitionBy(*(by or [F.lit(0)]))
    return table.withColumns({
        "participacao": F.try_divide(F.col("media_do_abs_da_soma"), F.sum("media_do_abs_da_soma").over(total)),
        "cancelamento_interno": F.coalesce(1 - F.try_divide(F.col("media_do_abs_da_soma"), F.col("soma_das_medias_abs")), F.lit(0.0))})


def with_slices(attributions: DataFrame, slice_column: str, value: str) -> DataFrame:
    """Every row under 'global' and, where it belongs, under its slice."""
    return attributions.withColumn("recorte", F.explode(F.array_compact(F.array(
        F.lit("global"), F.when(F.col(slice_column) == value, F.lit(value))))))


def slice_change(importance: DataFrame, value: str, key: str = "feature") -> DataFrame:
    """Relative change of every feature between the whole sample and the slice, and the rank agreement."""
    wide = importance.groupBy(key).pivot("recorte", ["global", value]).agg(F.max("media_do_abs_da_soma"))
    wide = materialize(wide.select(key, F.col("global"), F.col(f"`{value}`").alias("recorte")))
    return wide.withColumn("variacao", F.try_divide(F.col("recorte"), F.col("global")) - 1).withColumn(
        "spearman", spearman(wide, "global", "recorte").scalar())


# --- permutation importance ------------------------------------------------------------------------
def permutation_importance(
    model: M.Scorer | batched.Batch, df: DataFrame, features: Sequence[str], repeats: int = 10, seed: int = SEED, floor: float = NOISE_FLOOR,
) -> DataFrame:
    """AUC drop per feature; all features and repeats of a linear model share one plan."""
    table = _drops(model, df, {f: [f] for f in features}, repeats, seed)
    return table.withColumnRenamed("bloco", "feature").drop("n_features").withColumn("acima_do_piso", F.col("queda_media") > floor)


def block_permutation(
    model: M.Scorer | batched.Batch, df: DataFrame, blocks: Mapping[str, Sequence[str]], repeats: int = 10, seed: int = SEED, floor: float = NOISE_FLOOR,
) -> DataFrame:
    return _drops(model, df, dict(blocks), repeats, seed).withColumn("acima_do_piso", F.col("queda_media") > floor)


def _drops(model, df, blocks, repeats, seed):
    return (linear_drops if isinstance(model, batched.Batch) else shuffled_drop)(model, df, blocks, repeats, seed)


def block_against_singles(blocks: DataFrame, singles: DataFrame, families: DataFrame) -> DataFrame:
    """Drop of a family shuffled together against the sum of its single drops."""
    sums = singles.join(F.broadcast(families), "feature").groupBy(F.col("familia").alias("bloco")).agg(F.sum("queda_media").alias("soma_das_colunas_isoladas"))
    return blocks.join(sums, "bloco").select(
        "bloco", "soma_das_colunas_isoladas", F.col("queda_media").alias("familia_embaralhada_junta"),
        F.try_divide(F.col("queda_media"), F.col("soma_das_colunas_isoladas")).alias("razao"))


# --- linear coefficients ---------------------------------------------------------------------------
def linear_coefficients(df: DataFrame, features: Sequence[str] = PRUNED_FEATURES, k: int = 5) -> DataFrame:
    """Coefficients, odds ratios, spread and sign flips over the folds, deviation of coef·x (by column name).

    ``df`` carries the folds. The model of all rows and those of the folds share their scans.
    """
    made = M.logistic(features).batch(df, [F.lit(True), *batched.fold_sets(k)])
    whole, beta = made.fitted.designs[0], made.fitted.beta[0]
    in_folds: dict[str, list[float]] = {}
    for design, b in zip(made.fitted.designs[1:], made.fitted.beta[1:]):
        if design.rows:
            for c, value in zip(design.columns, b[1:]):
                in_folds.setdefault(c.name, []).append(float(value))
    spread = df.agg(F.lit(0), *[F.stddev_samp(_linear_form(made.base, line)).alias(f"c{i}") for i, line in enumerate(whole.matrix.T[1:])]).first()[1:]
    rows = []
    for c, b, sx in zip(whole.columns, beta[1:].tolist(), spread):
        own = in_folds.get(c.name, [])
        sd = float(np.std(own, ddof=1)) if len(own) > 1 else None
        flips = len({bool(v > 0) for v in own if v}) > 1 if own else None
        rows.append((c.name, c.feature, b, sd, len(own) or None, flips, abs(b) * sx if sx is not None else None))
    schema = ("coluna string, feature string, coeficiente double, coeficiente_dp_entre_folds double, folds_com_a_coluna long, "
              "troca_de_sinal_entre_folds boolean, contribuicao_dp double")
    return df.sparkSession.createDataFrame(rows, schema).select(
        "coluna", "feature", "coeficiente", F.exp("coeficiente").alias("razao_de_chances"), "coeficiente_dp_entre_folds", "folds_com_a_coluna",
        "troca_de_sinal_entre_folds", "contribuicao_dp")


def contribution_by_feature(coefficients: DataFrame) -> DataFrame:
    return coefficients.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_colunas"), F.sum("contribuicao_dp").alias("contribuicao_dp"), F.max("razao_de_chances").alias("maior_razao_de_chances"))


# --- triangulation ---------------------------------------------------------------------------------
def triangulate(shap: DataFrame, permutation: DataFrame, linear: DataFrame) -> DataFrame:
    """Three ranks per feature, how many readings can see it, how many put it on top, and a verdict."""
    table = shap.select("feature", F.col("media_do_abs_da_soma").alias("shap")).join(
        permutation.select("feature", F.col("queda_media").alias("permutacao"), F.col("queda_dp").alias("permutacao_dp"), "acima_do_piso"), "feature", "full_outer"
    ).join(linear.select("feature", F.col("contribuicao_dp").alias("logistica")), "feature", "left")
    for c in ("shap", "permutacao", "logistica"):
        table = ranks.tied_rank(table, c, f"posicao_{c}", method="min", descending=True)
    seen = F.col("logistica").isNotNull()
    top = {
        "shap": F.coalesce(F.col("posicao_shap") <= TOP_FEATURES, F.lit(False)),
        "permutacao": F.coalesce(F.col("posicao_permutacao") <= TOP_FEATURES, F.lit(False)),
        "logistica": F.coalesce(F.col("posicao_logistica") <= TOP_LINEAR, F.lit(False)) & seen,
    }
    table = table.withColumn("leituras_disponiveis", 2 + seen.cast("int")).withColumn(
        "leituras_no_topo", sum((c.cast("int") for c in top.values()), F.lit(0)))
    agree = (F.col("leituras_no_topo") == F.col("leituras_disponiveis")) & top["shap"]
    above = F.coalesce(F.col("acima_do_piso"), F.lit(False))
    return table.withColumn(
        "veredito", F.when(agree & above, "fator").when(agree, "topo em todas as leituras, mas abaixo do piso de ruído")
        .when(F.col("leituras_no_topo") == 1, "achado sobre a leitura").when(F.col("leituras_no_topo") >= 2, "relevante, sem consenso").otherwise("secundária"))
