"""Quality gates, reconciliations and identifier audits. Only the gates run an action: one small row."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cohortspark.contracts import CONSISTENCY_TOLERANCE_PP, MAX_CRITICAL_NULL_PCT, MAX_ORPHAN_PCT
from cohortspark.functions.stats import pearson, share
from cohortspark.operators import metrics, ranks
from cohortspark.session import materialize

log = logging.getLogger(__name__)
DIMENSION_PROBES = {"municipio": ("id_municipio", "nome_municipio"), "uf": ("sigla_uf", "nome_uf")}


class QualityError(RuntimeError):
    """A gate failed; nothing was written."""


def deduplicate(df: DataFrame, keys: Sequence[str], surplus: str | None = None) -> DataFrame:
    """One row per business key: the smallest payload, so that the survivor never varies.

    A partial aggregate, not a window: a key with very many copies shrinks before the shuffle.
    ``surplus`` names a column for the number of copies removed.
    """
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return df if surplus is None else df.withColumn(surplus, F.lit(0).cast("bigint"))
    payload = [c for c in df.columns if c not in keys]
    extra = [(F.count(F.lit(1)) - 1).alias(surplus)] if surplus else []
    if not payload:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
            *keys, *([(F.col("_n") - 1).alias(surplus)] if surplus else []))
    kept = df.groupBy(*keys).agg(F.min(F.struct(*payload)).alias("_row"), *extra)
    return kept.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns],
                       *([surplus] if surplus else []))


def duplicate_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.sum("_n").alias("antes"), F.count(F.lit(1)).alias("depois"),
                      F.sum(F.col("_n") - 1).alias("removidos"))


@dataclass(frozen=True)
class QualityReport:
    rows: int
    removed: int
    years: list[int]
    null_pct: dict[str, float]
    keyed: int
    orphans: int


def quality_measures(df: DataFrame, critical: Sequence[str], dimension: str | None = None, surplus: str | None = None) -> list[Column]:
    """Everything the gates need as aggregates: rows, years, NULL counts, orphans, removed copies."""
    key, probe = DIMENSION_PROBES.get(dimension or "", (None, None))
    linked = key in df.columns and probe in df.columns
    years = F.sort_array(F.collect_set("ano")) if "ano" in df.columns else F.array().cast("array<int>")
    zero = F.lit(0).cast("bigint")
    return [
        F.count(F.lit(1)).alias("registros"),
        years.alias("anos"),
        (F.coalesce(F.sum(surplus), zero) if surplus else zero).alias("removidos"),
        (F.count(key) if linked else zero).alias("com_chave"),
        (F.count_if(F.col(key).isNotNull() & F.col(probe).isNull()) if linked else zero).alias("orfaos"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulos_{c}") for c in critical if c in df.columns],
    ]


def quality_aggregate(df: DataFrame, critical: Sequence[str], dimension: str | None = None, surplus: str | None = None) -> DataFrame:
    return df.agg(*quality_measures(df, critical, dimension, surplus))


def observed(df: DataFrame, critical: Sequence[str], dimension: str | None = None, surplus: str | None = None) -> tuple[DataFrame, Observation]:
    """``df`` that takes its measures while another action, a write, evaluates it: no scan of their own."""
    seen = Observation()
    # An observation takes aggregates and literals, and every literal here is a count of nothing.
    return df.observe(seen, *quality_measures(df, critical, dimension, surplus)), seen


def quality_report(df: DataFrame, critical: Sequence[str], dimension: str | None = None, surplus: str | None = None) -> QualityReport:
    return report_of(quality_aggregate(df, critical, dimension, surplus).first().asDict(), critical)


def report_of(row: Mapping[str, Any], critical: Sequence[str]) -> QualityReport:
    total = row["registros"]
    nulls = {c: 100 * row[f"nulos_{c}"] / total for c in critical if f"nulos_{c}" in row and total}
    return QualityReport(total, row["removidos"], [y for y in row["anos"] if y is not None], nulls, row["com_chave"], row["orfaos"])


def enforce(report: QualityReport, entity: str, max_null_pct: float = MAX_CRITICAL_NULL_PCT, max_orphan_pct: float = MAX_ORPHAN_PCT) -> None:
    """Stop before anything is published when a limit is reached (at the limit already fails)."""
    log.info("[%s] rows=%d removed=%d years=%s nulls=%s orphans=%d/%d", entity, report.rows, report.removed,
             report.years, report.null_pct, report.orphans, report.keyed)
    breaches = {c: round(p, 1) for c, p in report.null_pct.items() if p >= max_null_pct}
    if breaches:
        raise QualityError(f"[{entity}] NULL share of critical columns at or above {max_null_pct}%: {breaches}")
    if report.keyed and 100 * report.orphans / report.keyed >= max_orphan_pct:
        raise QualityError(f"[{entity}] {report.orphans} of {report.keyed} keyed rows have no dimension row (limit {max_orphan_pct}%)")


def critical_null_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quality report as a table: rows, NULL count and NULL % per critical column."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return row.select("n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("coluna"), F.col(c).alias("nulos")) for c in columns])).alias("p")).select(
        "p.coluna", F.col("n").alias("registros"), "p.nulos", F.try_divide(100.0 * F.col("p.nulos"), F.col("n")).alias("pct_nulo"))


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if repeated:
        raise QualityError(f"{what}: key {list(keys)} is not unique, e.g. {[tuple(r)[:-1] for r in repeated]}")


def guarded_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "many_to_one",
                      not_null: str | None = None) -> DataFrame:
    """Left join that cannot multiply rows: the right key is proven unique first (and the left one for 1:1)."""
    assert_unique(right, keys, "right side of the join")
    if how == "one_to_one":
        assert_unique(left, keys, "left side of the join")
    joined = left.join(right, list(keys), "left")
    if not_null and joined.where(F.col(not_null).isNull()).limit(1).count():
        raise QualityError(f"join left {not_null} NULL for some rows")
    return joined


def join_cardinality(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Evidence behind the guard: rows before and after, repeated right keys."""
    counts = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    paired = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l")).join(counts, list(keys), "full_outer")
    l, r = F.coalesce("_l", F.lit(0)), F.coalesce("_r", F.lit(0))
    return paired.agg(
        F.sum(l).alias("linhas_antes"), F.sum(l * F.greatest(r, F.lit(1))).alias("linhas_depois"),
        F.count_if(r > 1).alias("chaves_repetidas"), F.sum(F.when(r == 0, l).otherwise(0)).alias("sem_par"))


def territory_conflicts(rows: DataFrame, key: str = "id_municipio", parent: str = "sigla_uf") -> DataFrame:
    return rows.groupBy(key).agg(F.count_distinct(parent).alias("n_ufs")).where("n_ufs > 1")


def build_directory(rows: DataFrame, key: str = "id_municipio", parent: str = "sigla_uf") -> DataFrame:
    """Territory dimension; a key with two parents is an error and is looked for before the dedup."""
    bad = territory_conflicts(rows, key, parent).limit(5).collect()
    if bad:
        raise QualityError(f"{key} under more than one {parent}: {[r[key] for r in bad]}")
    return deduplicate(rows.where(F.col(key).isNotNull()), [key])


def reconcile_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Same key set, no repeated key and the same target for every key, as counts of violations."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.max(target).alias(f"t_{name}"))

    both = side(a, "a").join(side(b, "b"), list(keys), "full_outer")
    na, nb = F.col("n_a"), F.col("n_b")
    return both.agg(
        F.count(F.lit(1)).alias("chaves"), F.count_if(nb.isNull()).alias("so_a"), F.count_if(na.isNull()).alias("so_b"),
        F.count_if(na > 1).alias("repetidas_a"), F.count_if(nb > 1).alias("repetidas_b"),
        F.count_if(na.isNotNull() & nb.isNotNull() & ~F.col("t_a").eqNullSafe(F.col("t_b"))).alias("alvo_diferente"))


def agreement(observed: DataFrame, published: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Units compared, mean absolute error and correlation of two readings of one quantity."""
    pair = observed.select(key, F.col(a).alias("_a")).join(published.select(key, F.col(b).alias("_b")), key)
    pair = pair.where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return pair.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mae"),
                    pearson("_a", "_b").alias("correlacao"))


def consistency_rate(df: DataFrame, difference: str, tolerance: float = CONSISTENCY_TOLERANCE_PP) -> DataFrame:
    d = F.col(difference)
    return df.agg(F.count(d).alias("avaliados"), F.count_if(d > tolerance).alias("divergentes"),
                  F.try_divide(100.0 * F.count_if(d > tolerance), F.count(d)).alias("pct_divergente"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman correlation of complete pairs through exact average ranks."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    counted = pairs.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("n"))
    return _weighted_spearman(counted)


def _weighted_spearman(counted: DataFrame, by: Sequence[str] = (), scale_of: str | None = None) -> DataFrame:
    counted = materialize(counted)

    def ranks_of(column: str, out: str) -> DataFrame:
        hist = counted.groupBy(*by, column).agg(F.sum("n").alias("n"))
        c = ranks.cumulate(hist, column, ["n"], by, scale_of=scale_of)
        return c.select(*by, column, (F.col("n_before") + (F.col("n") + 1) / 2).alias(out))

    joined = ranks._join(counted, ranks_of("_x", "rx"), [*by, "_x"])
    joined = ranks._join(joined, ranks_of("_y", "ry"), [*by, "_y"])
    n, rx, ry = F.col("n"), F.col("rx"), F.col("ry")
    moments = joined.groupBy(*by).agg(
        F.sum(n).cast("double").alias("n"), F.sum(n * rx).alias("sx"), F.sum(n * ry).alias("sy"),
        F.sum(n * rx * ry).alias("sxy"), F.sum(n * rx * rx).alias("sxx"), F.sum(n * ry * ry).alias("syy"))
    n = F.col("n")
    return moments.select(*by, F.try_divide(
        n * F.col("sxy") - F.col("sx") * F.col("sy"),
        F.sqrt((n * F.col("sxx") - F.col("sx") ** 2) * (n * F.col("syy") - F.col("sy") ** 2))).alias("spearman"))


def feature_target_spearman(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """|Spearman| of every feature with the target, all features in one histogram."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("_x")) for f in features])
    long = df.select(F.col(target).cast("double").alias("_y"), F.explode(pairs).alias("p")).select("_y", "p.*")
    counted = long.where(F.col("_x").isNotNull() & F.col("_y").isNotNull()).groupBy("feature", "_x", "_y").agg(
        F.count(F.lit(1)).alias("n"))
    return _weighted_spearman(counted, ["feature"], "feature").select("feature", F.abs("spearman").alias("spearman_abs"))


def enforce_no_leak(df: DataFrame, target: str, features: Sequence[str], limit: float = 0.95) -> None:
    worst = feature_target_spearman(df, target, features).orderBy(F.col("spearman_abs").desc_nulls_last()).first()
    if worst is not None and worst["spearman_abs"] is not None and worst["spearman_abs"] >= limit:
        raise QualityError(f"{worst['feature']} follows the target too closely (|Spearman| {worst['spearman_abs']:.3f})")


def deterministic_cut(df: DataFrame, label: str, measure: str, declared: float) -> DataFrame:
    """Is the label a cut of the measure? Highest of class 0 against lowest of class 1."""
    known = df.where(F.col(measure).isNotNull())
    base = known.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col(label) == 0, F.col(measure))).alias("maximo_classe_0"),
        F.min(F.when(F.col(label) == 1, F.col(measure))).alias("minimo_classe_1"),
        pearson(measure, label).alias("correlacao"))
    return base.select(
        "n", "maximo_classe_0", "minimo_classe_1", F.lit(float(declared)).alias("limiar_declarado"),
        (F.col("maximo_classe_0") >= F.col("minimo_classe_1")).alias("ha_sobreposicao"), "correlacao",
        metrics.auc(known, label, measure).scalar().alias("auc"))


def recycled_students(lag: DataFrame, current: DataFrame, unit: str = "id_aluno", school: str = "id_escola",
                      town: str = "id_municipio") -> DataFrame:
    """How many ids return next year, and how many of those point at the same school or municipality."""
    def once(df: DataFrame, year: str) -> DataFrame:
        return df.groupBy(unit).agg(F.min(F.struct(school, town)).alias(year))

    pairs = once(lag, "a").join(once(current, "b"), unit, "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    same_school = both & F.col(f"a.{school}").eqNullSafe(F.col(f"b.{school}"))
    same_town = both & F.col(f"a.{town}").eqNullSafe(F.col(f"b.{town}"))
    shared = F.count_if(both)
    return pairs.agg(
        F.count("a").alias("ids_lag"), F.count("b").alias("ids_atual"), shared.alias("ids_em_ambos_anos"),
        F.try_divide(F.count_if(same_school), shared).alias("pct_mesma_escola"),
        F.try_divide(F.count_if(same_town), shared).alias("pct_mesmo_municipio"),
        (shared - F.count_if(same_school)).alias("pares_falsos_estimados"))


def recycled_schools(lag: DataFrame, current: DataFrame, directory: DataFrame) -> DataFrame:
    """Does a school id stay in its municipality? Students behind ids that moved; id order against territory."""
    def home(df: DataFrame, out: str) -> DataFrame:
        return df.where(F.col("presenca") == 1).groupBy("id_escola").agg(
            F.min("id_municipio").alias(out), F.count(F.lit(1)).alias(f"n_{out}"))

    pairs = home(lag, "lag").join(home(current, "atual"), "id_escola", "full_outer")
    state = directory.select("id_municipio", "sigla_uf")
    pairs = pairs.join(state.select(F.col("id_municipio").alias("lag"), F.col("sigla_uf").alias("uf_lag")), "lag", "left")
    pairs = pairs.join(state.select(F.col("id_municipio").alias("atual"), F.col("sigla_uf").alias("uf_atual")), "atual", "left")
    both = F.col("lag").isNotNull() & F.col("atual").isNotNull()
    moved = both & (F.col("lag") != F.col("atual"))
    students = F.sum(F.when(moved, F.col("n_atual")).otherwise(0))
    return pairs.agg(
        F.count("lag").alias("escolas_lag"), F.count("atual").alias("escolas_atual"),
        F.count_if(both).alias("ids_em_ambos_anos"),
        F.try_divide(F.count_if(both & (F.col("lag") == F.col("atual"))), F.count_if(both)).alias("pct_mesmo_municipio"),
        F.try_divide(F.count_if(both & (F.col("uf_lag") == F.col("uf_atual"))), F.count_if(both)).alias("pct_mesma_uf"),
        students.alias("alunos_com_escola_falsa"),
        F.try_divide(students, F.sum("n_atual")).alias("pct_alunos_com_escola_falsa"),
    ).select(
        "*", spearman(home(lag, "m"), "id_escola", "m").scalar().alias("spearman_lag"),
        spearman(home(current, "m"), "id_escola", "m").scalar().alias("spearman_atual"))


def prefix_table(df: DataFrame, unit: str, unit_divisor: int, state_code: Column, state: str = "sigla_uf") -> DataFrame:
    """Per id prefix: rows, share whose prefix is the state code, states seen and the commonest one."""
    prefix = (F.col(unit) / F.lit(unit_divisor)).cast("bigint")
    cells = df.select(prefix.alias("prefixo"), F.col(state).alias("uf"), (prefix == state_code).alias("ok")).groupBy(
        "prefixo", "uf").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok"))
    return cells.groupBy("prefixo").agg(
        F.sum("n").alias("n"), (F.sum("ok") / F.sum("n")).alias("pct_prefixo_igual"),
        F.count("uf").alias("n_ufs"), F.min_by("uf", F.struct(-F.col("n"), F.col("uf"))).alias("uf_dominante"))


def informative_nulls(df: DataFrame, column: str, label: str, unit: str) -> DataFrame:
    """Units and outcome rate with and without a value."""
    return df.groupBy(F.col(column).isNull().alias("sem_valor")).agg(
        F.count_distinct(unit).alias("n_unidades"), F.count(F.lit(1)).alias("n"), F.avg(label).alias("taxa"))


def null_agreement(df: DataFrame, column: str, condition: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), share(F.col(column).isNull() == condition).alias("concordancia"))
