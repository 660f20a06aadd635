"""Cohort profiling: grouped rates with intervals, lag coverage, dispersion, collinearity, histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.stats import pearson, share, wilson
from cohortspark.operators import aggregates, metrics, ranks, resample
from cohortspark.operators.quality import QualityError, _weighted_spearman


def column_profile(df: DataFrame) -> DataFrame:
    """Type, exact distinct count, NULL share and the smallest value of every column.

    The columns are unpivoted to (column, text value) and counted in two partial aggregates, so no
    per-column distinct set is ever held in one place.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cells = F.array(*[F.struct(F.lit(c).alias("coluna"), F.lit(k).alias("tipo"), F.col(c).cast("string").alias("v"))
                      for c, k in kinds.items()])
    levels = df.select(F.explode(cells).alias("p")).select("p.*").groupBy("coluna", "tipo", "v").agg(
        F.count(F.lit(1)).alias("n"))
    return levels.groupBy("coluna", "tipo").agg(
        F.count("v").alias("n_unicos"),
        (F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("pct_nulo"),
        F.min("v").alias("exemplo"))


def _with_interval(df: DataFrame, k: str, n: str) -> DataFrame:
    low, high = wilson(F.col(k), F.col(n))
    return df.withColumns({"ic_low": low, "ic_high": high})


def prevalence_by_year(df: DataFrame, label: str = "alfabetizado", year: str = "ano") -> DataFrame:
    table = df.groupBy(year).agg(F.count(label).alias("n_alunos"), F.sum(label).alias("n_alfabetizados"))
    table = table.withColumns({
        "taxa_alfabetizado": F.col("n_alfabetizados") / F.col("n_alunos"),
        "taxa_risco": 1 - F.col("n_alfabetizados") / F.col("n_alunos")})
    return _with_interval(table, "n_alfabetizados", "n_alunos")


def rate_by_category(df: DataFrame, category: str, label: str = "alfabetizado") -> DataFrame:
    table = df.where(F.col(category).isNotNull()).groupBy(category).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("k"))
    table = _with_interval(table.withColumn("taxa", F.col("k") / F.col("n")), "k", "n")
    return table.withColumn("amplitude_ic", F.col("ic_high") - F.col("ic_low"))


def interval_overlap(rates: DataFrame) -> DataFrame:
    """Is there one value inside all intervals? The spread of the rates beside the answer."""
    return rates.agg(
        F.count(F.lit(1)).alias("n_niveis"), F.min("taxa").alias("taxa_min"), F.max("taxa").alias("taxa_max"),
        ((F.max("taxa") - F.min("taxa")) * 100).alias("amplitude_taxas_pp"),
        F.max("ic_low").alias("maior_ic_low"), F.min("ic_high").alias("menor_ic_high"),
        (F.max("ic_low") <= F.min("ic_high")).alias("todos_ics_se_sobrepoem"))


def nulls_by_period(df: DataFrame, period: str, values: Sequence, columns: Sequence[str]) -> DataFrame:
    """NULL share per column, one output column per period (or source)."""
    shares = df.agg(*[
        F.try_divide(F.count_if((F.col(period) == v) & F.col(c).isNull()), F.count_if(F.col(period) == v)).alias(f"{c}@{v}")
        for c in columns for v in values])
    return shares.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("coluna"), *[F.col(f"`{c}@{v}`").alias(f"pct_{v}") for v in values]) for c in columns
    ])).alias("p")).select("p.*")


SIZE_PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def size_profile(df: DataFrame, key: str) -> DataFrame:
    """Distribution of the rows per unit and the standard error of a rate at the median size."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    names = {f"p{p}": p / 100 for p in SIZE_PERCENTILES}
    q = ranks.quantiles(sizes, "n", names).select(F.struct(*names).alias("q")).scalar()
    table = sizes.agg(F.count(F.lit(1)).alias("n_unidades"), F.avg("n").alias("media"))
    return table.withColumn("q", q).select(
        F.lit(key).alias("chave"), "n_unidades", "media", "q.*",
        (100 * F.sqrt(F.lit(0.25) / F.col("q.p50"))).alias("erro_padrao_da_taxa_na_mediana_pp"))


def two_periods(lag: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Inner 1:1 join of two period tables with ``_lag`` / ``_atual`` suffixes."""
    def named(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(key, *[F.col(c).alias(f"{c}{suffix}") for c in df.columns if c != key])

    return named(lag, "_lag").join(named(current, "_atual"), key)


def persistence(lag: DataFrame, current: DataFrame, key: str, minimums: Sequence[int] = (0, 20, 50, 200),
                least: int = 30, replicates: int = 1000) -> DataFrame:
    """Correlation of the unit rates of two years by minimum size, with a bootstrap interval."""
    pairs = two_periods(lag, current, key)
    long = pairs.select("*", F.explode(F.array(*[F.lit(m) for m in minimums])).alias("porte_minimo")).where(
        (F.col("n_lag") >= F.col("porte_minimo")) & (F.col("n_atual") >= F.col("porte_minimo")))
    pearson = resample.correlation_bootstrap(long, key, "taxa_lag", "taxa_atual", replicates, by=["porte_minimo"])
    counted = long.groupBy("porte_minimo", F.col("taxa_lag").alias("_x"), F.col("taxa_atual").alias("_y")).agg(
        F.count(F.lit(1)).alias("n"))
    rank_corr = _weighted_spearman(counted, ["porte_minimo"]).withColumnRenamed("spearman", "corr_spearman")
    return pearson.where(F.col("n_unidades") >= least).join(rank_corr, "porte_minimo")


def persistence_point(lag: DataFrame, current: DataFrame, key: str, minimums: Sequence[int] = (0, 20, 50, 200), least: int = 30) -> DataFrame:
    """Point estimates of :func:`persistence` only."""
    long = two_periods(lag, current, key).select(
        "*", F.explode(F.array(*[F.lit(m) for m in minimums])).alias("porte_minimo")).where(
        (F.col("n_lag") >= F.col("porte_minimo")) & (F.col("n_atual") >= F.col("porte_minimo")))
    point = long.groupBy("porte_minimo").agg(
        F.count(F.lit(1)).alias("n_unidades"), pearson("taxa_lag", "taxa_atual").alias("corr_pearson"))
    counted = long.groupBy("porte_minimo", F.col("taxa_lag").alias("_x"), F.col("taxa_atual").alias("_y")).agg(
        F.count(F.lit(1)).alias("n"))
    rank_corr = _weighted_spearman(counted, ["porte_minimo"]).withColumnRenamed("spearman", "corr_spearman")
    return point.where(F.col("n_unidades") >= least).join(rank_corr, "porte_minimo")


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair (upper triangle) in one aggregate of p·(p−1)/2 buffers."""
    names = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = df.agg(*[pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(names)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"`{i}`").alias("correlacao"))
        for i, (a, b) in enumerate(names)])).alias("p")).select("p.*")


def redundant_pairs(df: DataFrame, columns: Sequence[str], limit: float = 0.95) -> DataFrame:
    return correlation_pairs(df, columns).where(F.abs("correlacao") >= limit)


def variance_inflation(df: DataFrame, columns: Sequence[str], drop_incomplete: bool = True) -> DataFrame:
    """Diagonal of the inverse correlation matrix; only the p × p matrix reaches the driver."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    rows = rows.dropna() if drop_incomplete else rows
    spread = rows.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    flat = [c for c in columns if not spread[c]]
    if flat:
        raise QualityError(f"columns without variance, inflation undefined: {flat}")
    position = {c: i for i, c in enumerate(columns)}
    matrix = np.eye(len(columns))
    for r in correlation_pairs(rows, columns).collect():
        i, j = position[r["feature_a"]], position[r["feature_b"]]
        matrix[i, j] = matrix[j, i] = r["correlacao"]
    singular = np.linalg.matrix_rank(matrix) < len(columns)
    inverse = np.linalg.pinv(matrix) if singular else np.linalg.inv(matrix)
    return df.sparkSession.createDataFrame(
        [(c, float(inverse[i, i])) for c, i in position.items()], "feature string, vif double")


def goal_gap(goals: DataFrame, observed: DataFrame, key: str, goal: str, rate_pct: str) -> DataFrame:
    joined = goals.join(observed, key)
    return joined.withColumn("gap_pp", F.col(rate_pct) - F.col(goal)).withColumn("atingiu_meta", F.col("gap_pp") >= 0)


def goal_determinism(goals: DataFrame, columns: Sequence[str], base: str = "taxa_alfabetizacao") -> DataFrame:
    """Is a goal only the base rate rewritten? Spread and correlation; constant goals have none."""
    cells = F.array(*[F.struct(F.lit(c).alias("meta"), F.col(c).cast("double").alias("v")) for c in columns])
    long = goals.select(F.col(base).alias("b"), F.explode(cells).alias("p")).select("b", "p.*")
    pairs = F.count_if(F.col("v").isNotNull() & F.col("b").isNotNull())
    table = long.groupBy("meta").agg(
        F.count_distinct("v").alias("n_valores_distintos"), share(F.col("v").isNull()).alias("pct_nulo"),
        F.avg("v").alias("media"), F.stddev_samp("v").alias("desvio_padrao"), pairs.alias("_pairs"),
        pearson("v", "b").alias("_c"))
    return table.withColumn("corr_com_taxa_base", F.when(
        (F.col("n_valores_distintos") > 1) & (F.col("_pairs") > 2), F.col("_c"))).drop("_pairs", "_c")


def with_history_flag(cohort: DataFrame, lag: DataFrame, key: str, out: str = "tem_historico") -> DataFrame:
    """Membership of the key in the lag period as a flag."""
    known = lag.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_known", F.lit(True))
    return cohort.join(known, key, "left").withColumn(out, F.col("_known").isNotNull()).drop("_known")


def lag_coverage(cohort: DataFrame, lag: DataFrame, key: str) -> DataFrame:
    """Units and rows of the cohort whose key existed in the lag period."""
    now = cohort.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    old = lag.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_old", F.lit(1))
    both = now.join(old, key, "full_outer")
    here, known = F.col("n").isNotNull(), F.col("_old").isNotNull()
    return both.agg(
        F.count("n").alias("unidades_atual"), F.count("_old").alias("unidades_lag"),
        F.try_divide(F.count_if(here & known), F.count("n")).alias("pct_unidades_com_historico"),
        F.try_divide(F.sum(F.when(known, F.col("n")).otherwise(0)), F.sum("n")).alias("pct_alunos_com_historico"),
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("alunos_sem_historico"),
    ).select(F.lit(key).alias("chave"), "*")


def history_profile(cohort: DataFrame, lag: DataFrame, key: str, label: str = "alfabetizado") -> DataFrame:
    flagged = with_history_flag(cohort, lag, key)
    table = flagged.groupBy(F.when(F.col("tem_historico"), "com histórico").otherwise("sem histórico").alias("grupo")).agg(
        F.count(F.lit(1)).alias("n_alunos"), F.sum(label).alias("_k"))
    table = table.withColumn("taxa_alfabetizado", F.col("_k") / F.col("n_alunos"))
    return _with_interval(table, "_k", "n_alunos").drop("_k")


def lag_coverage_by(cohort: DataFrame, lag: DataFrame, key: str, by: str) -> DataFrame:
    return with_history_flag(cohort, lag, key).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_alunos"), share(F.col("tem_historico")).alias("pct_com_historico"),
        F.count_distinct(key).alias("n_unidades"))


def variance_between(df: DataFrame, unit: str, parent: str, label: str = "alfabetizado", minimum: int = 20) -> DataFrame:
    """Share of the variance of unit rates that lies between parent groups."""
    units = df.groupBy(parent, unit).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("taxa")).where(F.col("n") >= minimum)
    parents = units.groupBy(parent).agg(
        F.count(F.lit(1)).alias("m"), F.avg("taxa").alias("t"), F.sum("taxa").alias("s"), F.sum(F.col("taxa") ** 2).alias("q"))
    total = F.sum("q") - F.sum("s") ** 2 / F.sum("m")
    between = F.sum(F.col("m") * F.col("t") ** 2) - F.sum("s") ** 2 / F.sum("m")
    return parents.agg(
        F.sum("m").alias("n_unidades"), F.count(F.lit(1)).alias("n_grupos"),
        F.try_divide(between, total).alias("variancia_entre")).select(
        F.lit(minimum).alias("porte_minimo"), "*", (1 - F.col("variancia_entre")).alias("variancia_dentro"))


SIZE_BANDS = ((0, 20), (20, 50), (50, 80), (80, None))


def auc_by_size_band(df: DataFrame, feature: str, size: str, label: str, unit: str, bands=SIZE_BANDS, least: int = 1000) -> DataFrame:
    band = None
    for low, high in bands:
        name = f"≥ {low}" if high is None else f"{low}–{high}"
        inside = F.col(size) >= low if high is None else (F.col(size) >= low) & (F.col(size) < high)
        band = F.when(inside, name) if band is None else band.when(inside, name)
    rows = df.withColumn("faixa_porte", band).where(F.col("faixa_porte").isNotNull() & F.col(feature).isNotNull())
    sizes = rows.groupBy("faixa_porte").agg(F.count(F.lit(1)).alias("n_alunos"), F.count_distinct(unit).alias("n_escolas"))
    return sizes.where(F.col("n_alunos") >= least).join(metrics.auc(rows, label, feature, ["faixa_porte"]), "faixa_porte", "left")


def absence_bias(students: DataFrame, key: str = "id_municipio", bins: int = 5, least: int = 20) -> DataFrame:
    """Outcome of the present students by quantile of the presence rate of their unit."""
    here = F.col("presenca") == 1
    units = students.groupBy(key).agg(
        F.avg("presenca").alias("taxa_presenca"), F.count_if(here).alias("n"),
        F.sum(F.when(here, F.col("alfabetizado"))).alias("k")).where(F.col("n") >= least)
    edges = ranks.quantile_edges(units, "taxa_presenca", bins)
    label = ranks.cut(F.col("taxa_presenca"), edges, [f"Q{i + 1}" for i in range(max(len(edges) - 1, 1))], include_lowest=True)
    table = units.groupBy(label.alias("quintil_presenca")).agg(
        F.count(F.lit(1)).alias("n_municipios"), F.sum("n").alias("n_alunos_presentes"), F.sum("k").alias("k"),
        F.avg("taxa_presenca").alias("taxa_presenca_media"))
    table = table.withColumn("taxa_alfabetizado", F.col("k") / F.col("n_alunos_presentes"))
    return _with_interval(table, "k", "n_alunos_presentes")


def presence_by(students: DataFrame, by: str) -> DataFrame:
    here = F.col("presenca") == 1
    return students.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(here).alias("n_presentes"),
        F.avg("presenca").alias("taxa_presenca"), F.avg(F.when(here, F.col("alfabetizado"))).alias("taxa_alfabetizado"))


def lag_level(students: DataFrame, key: str, prefix: str) -> DataFrame:
    """Lag aggregate of any level: enrolment, presence, rate, mean, deviation and quartiles of the score."""
    here = F.col("presenca") == 1
    base = students.groupBy(key).agg(
        F.count(F.lit(1)).alias(f"{prefix}_n_avaliados_lag1"), F.avg("presenca").alias(f"{prefix}_taxa_presenca_lag1"),
        F.count_if(here).alias(f"{prefix}_n_alunos_lag1"),
        F.avg(F.when(here, F.col("alfabetizado"))).alias(f"{prefix}_taxa_alfab_lag1"),
        F.avg(F.when(here, F.col("proficiencia"))).alias(f"{prefix}_prof_media_lag1"))
    return base.where(F.col(f"{prefix}_n_alunos_lag1") > 0).join(
        aggregates.distribution_shape(students, key, prefix), key, "left")


def smoothed_rate(unit_rate: Column, unit_n: Column, parent_rate: Column, k: Column | float) -> Column:
    """(rate·n + parent·k) / (n + k); a unit without history takes the parent rate."""
    n = F.coalesce(unit_n, F.lit(0))
    k = F.lit(float(k)) if not isinstance(k, Column) else k
    return F.try_divide(F.coalesce(unit_rate, parent_rate) * n + parent_rate * k, n + k)


SMOOTHING_GRID = (0, 5, 10, 20, 30, 50, 100, 200, 500)


def smoothing_grid(df: DataFrame, label: str, unit_rate: str, unit_n: str, parent_rate: str, grid: Sequence[int] = SMOOTHING_GRID) -> DataFrame:
    """AUC of the smoothed rate for every k of the grid, in one pass."""
    reduced = df.groupBy(label, unit_rate, unit_n, parent_rate).agg(F.count(F.lit(1)).alias("_c"))
    long = reduced.select("*", F.explode(F.array(*[F.lit(float(k)) for k in grid])).alias("k"))
    long = long.withColumn("s", F.round(smoothed_rate(F.col(unit_rate), F.col(unit_n), F.col(parent_rate), F.col("k")), 12))
    hist = metrics.score_histogram(long, label, "s", ["k"], F.col("_c"))
    return metrics.ranking_from_histogram(hist, ["k"]).select("k", F.col("roc_auc").alias("auc"))


def feature_dictionary(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], blocks: Mapping[str, str]) -> DataFrame:
    """Block, kind, coverage, distinct values, AUC and strength of every feature."""
    both = [*numeric, *categorical]
    profile = column_profile(df.select(*both)).select(
        F.col("coluna").alias("feature"), (1 - F.col("pct_nulo")).alias("cobertura"), "n_unicos")
    scored = metrics.auc_by_feature(df, label, numeric).select("feature", "auc")
    kind = F.when(F.col("feature").isin(*categorical), "categórica").otherwise("numérica")
    block = F.create_map(*[F.lit(v) for f in both for v in (f, blocks.get(f, "derivada"))])[F.col("feature")]
    return profile.join(scored, "feature", "left").select(
        "feature", block.alias("bloco"), kind.alias("tipo"), "cobertura", "n_unicos", "auc", F.abs(F.col("auc") - 0.5).alias("forca"))


def category_rate_auc(df: DataFrame, label: str, categories: Sequence[str]) -> DataFrame:
    """In-sample AUC of every category's own rate: the histogram is the category table itself."""
    cells = F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(c).cast("string").alias("nivel")) for c in categories])
    levels = df.select(F.col(label).alias("y"), F.explode(cells).alias("p")).select("y", "p.*").where(
        F.col("nivel").isNotNull()).groupBy("coluna", "nivel").agg(F.sum("y").alias("k"), F.count("y").alias("n"))
    hist = levels.groupBy("coluna", (F.col("k") / F.col("n")).alias("score")).agg(
        F.sum("k").cast("bigint").alias("n_pos"), F.sum(F.col("n") - F.col("k")).cast("bigint").alias("n_neg"))
    return metrics.ranking_from_histogram(hist, ["coluna"]).select("coluna", F.col("roc_auc").alias("auc"))


def yearly_change(lag: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Change of the unit rate in percentage points and the share that got worse, all and by size band."""
    pairs = two_periods(lag, current, key).withColumn("delta_pp", (F.col("taxa_atual") - F.col("taxa_lag")) * 100)
    both = lambda low, high: F.col("n_lag").between(low, high) & F.col("n_atual").between(low, high)
    bands = F.array_compact(F.array(
        F.lit("todos"), F.when(both(0, 49), "< 50"), F.when(both(50, 199), "50–200"), F.when((F.col("n_lag") >= 200) & (F.col("n_atual") >= 200), ">= 200")))
    long = pairs.select("delta_pp", F.explode(bands).alias("faixa"))
    return aggregates.measure_summary(long, "delta_pp", ["faixa"]).join(
        long.groupBy("faixa").agg(share(F.col("delta_pp") < 0).alias("share_que_piorou")), "faixa")


def missingness_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*[F.col(c).isNull().alias(f"falta_{c}") for c in columns]).agg(F.count(F.lit(1)).alias("n"))


def class_histogram(df: DataFrame, measure: str, label: str, bins: int) -> DataFrame:
    """Equal-width histogram by class between the exact minimum and maximum (the maximum closes the last bin)."""
    known = df.where(F.col(measure).isNotNull())
    span = known.agg(F.struct(F.min(measure).alias("lo"), F.max(measure).alias("hi")).alias("s")).scalar()
    rows = known.withColumn("s", span)
    width = (F.col("s.hi") - F.col("s.lo")) / bins
    place = F.floor(F.try_divide(F.col(measure) - F.col("s.lo"), width))
    return rows.groupBy(label, F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def shuffle_control(df: DataFrame, label: str, feature: str, parent_feature: str, within: str, key: Sequence[str],
                    seeds: Sequence[int] = (42, 43, 44)) -> DataFrame:
    """AUC of a unit feature against its shuffles inside the territory and overall, and the parent feature."""
    needed = df.select(*dict.fromkeys([*key, within, label, feature, parent_feature]))
    parts = [needed.select(label, F.explode(F.array(
        F.struct(F.lit("real").alias("leitura"), F.lit(0).alias("seed"), F.col(feature).cast("double").alias("s")),
        F.struct(F.lit("municipal").alias("leitura"), F.lit(0).alias("seed"), F.col(parent_feature).cast("double").alias("s")),
    )).alias("p")).select(label, "p.*")]
    for seed in seeds:
        for name, groups in (("dentro_uf", [within]), ("global", [])):
            moved = resample.permute(needed, [feature], key, seed, groups)
            parts.append(moved.select(label, F.lit(name).alias("leitura"), F.lit(seed).alias("seed"), F.col(feature).cast("double").alias("s")))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return metrics.auc(long, label, "s", ["leitura", "seed"]).groupBy("leitura").agg(
        F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("dp"))
