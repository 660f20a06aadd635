"""Train-only preprocessing as a savable MLlib pipeline: one SQL projection and one assembler."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.contracts import CATEGORICAL_FEATURES, MODEL_FEATURES, RARE_CATEGORICAL_FEATURES
from cohortspark.operators import ranks
from cohortspark.operators.quality import QualityError

ABSENT, POOLED = "AUSENTE", "infrequente"


@dataclass(frozen=True)
class OutputColumn:
    """One column of the model matrix and the raw feature it came from."""

    name: str
    feature: str
    kind: str  # value, missing or level


@dataclass(frozen=True)
class Preprocessor:
    model: PipelineModel
    columns: tuple[OutputColumn, ...]

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        return self.model.transform(df).select(*keep, "features")

    def mapping(self, spark, families: dict[str, str] | None = None) -> DataFrame:
        """Model column → raw feature (→ family) as a table."""
        families = families or {}
        rows = [(i, c.name, c.feature, c.kind, families.get(c.feature)) for i, c in enumerate(self.columns)]
        return spark.createDataFrame(rows, "posicao int, coluna string, feature string, tipo string, familia string")


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _numeric_stats(df: DataFrame, numeric: Sequence[str]) -> dict[str, dict[str, float]]:
    """Median, and mean and population deviation after imputing it, for all columns together."""
    def long(columns: Sequence[str]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in columns])
        return df.select(F.explode(cells).alias("p")).select("p.*").withColumn("v", F.when(~F.isnan("v"), F.col("v")))

    moments = long(numeric).groupBy("f").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("k"), F.avg("v").alias("a"), F.var_pop("v").alias("s")).collect()
    partial = [r["f"] for r in moments if r["k"] < r["n"]]
    medians = {r["f"]: r["m"] for r in ranks.quantiles(long(partial), "v", {"m": 0.5}, ["f"], scale_of="f").collect()} if partial else {}
    stats = {}
    for r in moments:
        med = medians.get(r["f"], 0.0)
        known, gone = r["k"] / r["n"], 1 - r["k"] / r["n"]
        a, s = (r["a"], r["s"]) if r["k"] else (0.0, 0.0)
        mean = known * a + gone * med
        var = known * (s + (a - mean) ** 2) + gone * (med - mean) ** 2
        stats[r["f"]] = {"median": med, "mean": mean, "sd": var**0.5 or 1.0, "gone": gone, "gone_sd": (known * gone) ** 0.5 or 1.0}
    return stats


def _levels(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, list[tuple[str, int]]]:
    cells = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v")) for c in columns])
    counts = df.select(F.explode(cells).alias("p")).groupBy("p.f", "p.v").agg(F.count(F.lit(1)).alias("n"))
    wide = counts.groupBy("f").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > limit).collect()
    if wide:
        raise QualityError(f"too many levels to encode: {[(r['f'], r['k']) for r in wide]}")
    table: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    for r in counts.orderBy("f", "v").collect():
        table[r["f"]].append((r["v"], r["n"]))
    return table


def fit_preprocessor(
    df: DataFrame, features: Sequence[str] = MODEL_FEATURES, indicators: bool = True, min_frequency: float = 0.01, max_levels: int = 1000,
) -> Preprocessor:
    """Numbers: median, NULL indicator, scale. Categories: one column per level, unknown ones all zero.

    Rare-prone categories pool levels below ``min_frequency``; unseen levels join the pool.
    """
    rare = [c for c in features if c in RARE_CATEGORICAL_FEATURES]
    categorical = [c for c in features if c in CATEGORICAL_FEATURES]
    numeric = [c for c in features if c not in rare and c not in categorical]
    expressions: list[tuple[str, OutputColumn]] = []
    stats = _numeric_stats(df, numeric) if numeric else {}
    for c in numeric:
        s = stats[c]
        expressions.append((
            f"(coalesce(nanvl(cast(`{c}` as double), null), {s['median']!r}D) - {s['mean']!r}D) / {s['sd']!r}D", OutputColumn(c, c, "value")))
    for c in numeric if indicators else ():
        s = stats[c]
        if s["gone"]:
            expressions.append((f"(if(nanvl(cast(`{c}` as double), null) is null, 1D, 0D) - {s['gone']!r}D) / {s['gone_sd']!r}D", OutputColumn(f"{c}=NULL", c, "missing")))
    levels = _levels(df, [*categorical, *rare], max_levels) if categorical or rare else {}
    for c in categorical:
        named: dict[str, int] = {}
        for v, n in levels[c]:
            named[ABSENT if v is None else v] = named.get(ABSENT if v is None else v, 0) + n
        for v in sorted(named):
            expressions.append((f"if(coalesce(cast(`{c}` as string), {_quote(ABSENT)}) = {_quote(v)}, 1D, 0D)", OutputColumn(f"{c}={v}", c, "level")))
    for c in rare:
        known = [(v, n) for v, n in levels[c] if v is not None]
        total = sum(n for _, n in levels[c])
        if not known:
            continue
        common = min(known, key=lambda p: (-p[1], p[0]))[0]
        value = f"coalesce(cast(`{c}` as string), {_quote(common)})"
        kept = [v for v, n in known if n >= min_frequency * total]
        for v in kept:
            expressions.append((f"if({value} = {_quote(v)}, 1D, 0D)", OutputColumn(f"{c}={v}", c, "level")))
        if len(kept) < len(known) and kept:
            inside = ", ".join(_quote(v) for v in kept)
            expressions.append((f"if({value} in ({inside}), 0D, 1D)", OutputColumn(f"{c}={POOLED}", c, "level")))
    projection = ", ".join(f"{e} AS `_x{i}`" for i, (e, _) in enumerate(expressions))
    stages = [
        SQLTransformer(statement=f"SELECT *, {projection} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_x{i}" for i in range(len(expressions))], outputCol="features", handleInvalid="keep"),
    ]
    return Preprocessor(PipelineModel(stages), tuple(c for _, c in expressions))
