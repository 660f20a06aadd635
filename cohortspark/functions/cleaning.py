"""Column-name and value cleaning: every function is a projection, no action, no UDF."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.contracts import DOUBLE_PREFIXES, Entity


def ascii_snake(name: str, keep_technical: bool = False) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    snake = re.sub(r"[\W_]+", "_", plain.strip().lower()).strip("_")
    return f"_{snake}" if keep_technical and name.startswith("_") else snake


def rename_ascii(df: DataFrame, keep_technical: bool = False) -> DataFrame:
    """All columns to ASCII snake_case; two names that collapse into one are an error."""
    names = [ascii_snake(c, keep_technical) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"column names collide after renaming: {clash}")
    return df.toDF(*names)


def audit_columns(layer: str, entity: str, source: str, now: datetime | None = None) -> dict[str, Column]:
    """Audit columns of the raw (``bronze``) and clean (``silver``) layers."""
    now = now or datetime.now(timezone.utc)
    verb = "ingestion" if layer == "bronze" else "processing"
    return {
        f"_{layer}_{verb}_date": F.lit(now.strftime("%Y-%m-%d")),
        f"_{layer}_{verb}_timestamp": F.lit(now.strftime("%Y%m%d_%H%M%S")),
        f"_{layer}_source_entity": F.lit(entity),
        "_source_layer": F.lit(source),
        "_pipeline_stage": F.lit(layer),
    }


def gold_audit_columns(catalog: str, now: datetime | None = None) -> dict[str, Column]:
    now = now or datetime.now(timezone.utc)
    return {
        "_gold_processing_date": F.lit(now.strftime("%Y-%m-%d")),
        "_gold_processing_timestamp": F.lit(now.strftime("%Y%m%d_%H%M%S")),
        "_gold_source_catalog": F.lit(catalog),
        "_pipeline_stage": F.lit("gold"),
    }


def blank_to_null(df: DataFrame) -> DataFrame:
    """Trim every text column and turn empty text into NULL; technical columns pass through."""
    return df.select(*[
        F.nullif(F.trim(f.name), F.lit("")).alias(f.name)
        if isinstance(f.dataType, T.StringType) and not f.name.startswith("_") else F.col(f.name)
        for f in df.schema.fields
    ])


def to_integer(column: Column) -> Column:
    """Text to int through double, so that ``1.0`` survives and unparsable text is NULL."""
    return column.try_cast("double").try_cast("int")


def apply_types(df: DataFrame, entity: Entity) -> DataFrame:
    def typed(name: str) -> Column:
        column = F.col(name)
        if name in entity.integers:
            return to_integer(column)
        if name in entity.doubles or name.startswith(DOUBLE_PREFIXES):
            return column.try_cast("double")
        if name in entity.strings:
            return column.cast("string")
        return column

    return df.select(*[typed(c).alias(c) for c in df.columns])


def lookup(column: Column | str, mapping: Mapping[str, str]) -> Column:
    """Literal map lookup; a key outside the map gives NULL."""
    column = F.col(column) if isinstance(column, str) else column
    return F.create_map(*[F.lit(v) for v in chain(*mapping.items())])[column]


def decode(column: str, mapping: Mapping[str, str]) -> Column:
    """Label of a code; text outside the code list is kept as it is."""
    return F.coalesce(lookup(column, mapping), F.col(column))


def translate_codes(df: DataFrame, column: str, mapping: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Replace a text code; also return the distinct values that have no translation."""
    code = lookup(column, mapping)
    unmapped = df.where(F.col(column).isNotNull() & code.isNull()).select(column).distinct()
    return df.withColumn(column, code), unmapped


def value_of_own_year(columns: Sequence[str], prefix: str, year: str = "ano") -> Column:
    """The wide column ``<prefix><year>`` that belongs to the row's own year, NULL if there is none."""
    years = sorted(int(c[len(prefix):]) for c in columns if c.startswith(prefix) and c[len(prefix):].isdigit())
    if not years:
        return F.lit(None).cast("double")
    return F.coalesce(*[F.when(F.col(year) == y, F.col(f"{prefix}{y}")) for y in years])


def goal_state(value: str, goal: str) -> Column:
    """No goal beats no data; then reached (value at or above the goal) or below."""
    return (
        F.when(F.col(goal).isNull(), "Sem meta")
        .when(F.col(value).isNull(), "Sem dado")
        .when(F.col(value) >= F.col(goal), "Atingida")
        .otherwise("Abaixo")
    )


def consistency_state(difference: str, tolerance: float) -> Column:
    return (
        F.when(F.col(difference).isNull(), "Sem dado")
        .when(F.col(difference) <= tolerance, "Consistente")
        .otherwise("Divergente")
    )


def first_available(sources: Mapping[str, Column], missing: str) -> tuple[Column, Column]:
    """Value of the first non-NULL source in priority order, and the label of where it came from."""
    value = F.coalesce(*sources.values())
    label = F.coalesce(*[F.when(c.isNotNull(), F.lit(k)) for k, c in sources.items()], F.lit(missing))
    return value, label


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "features") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} missing from the dataset: {missing}")


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])
