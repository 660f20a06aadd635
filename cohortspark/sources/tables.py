"""Raw files, catalog tables and Parquet products: every read is lazy, every write is one job."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.contracts import Entity

log = logging.getLogger(__name__)
VERSION = "__v"


class MissingInput(RuntimeError):
    """A required table or file is not there."""


def read_landing(spark: SparkSession, folder: str, entity: Entity) -> DataFrame | None:
    """Raw delimited file with every column as text and the source file beside it; None if absent."""
    try:
        raw = spark.read.csv(f"{folder.rstrip('/')}/{entity.file}", header=True, sep=entity.delimiter, inferSchema=False)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("[%s] no file %s in %s, skipped", entity.name, entity.file, folder)
        return None
    return raw.select("*", F.col("_metadata.file_path").alias("_bronze_source_file"))


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Typed CSV: the header decides the position, the schema the type; unknown columns are not read."""
    kept = [c for c in columns if c not in drop]
    raw = spark.read.csv(path, header=True, inferSchema=False)
    kinds = {f.name: f.dataType for f in schema.fields}
    return raw.select(*[narrow(F.col(c), kinds[c]).alias(c) for c in kept])


def narrow(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return column.try_cast("double")
    return column.try_cast("double").try_cast(kind.simpleString())


def write_by_year(df: DataFrame, path: str, years: Sequence[int], year: str = "ano") -> DataFrame:
    """Parquet dataset partitioned by year, zstd; returns the row counts of the given years as stored.

    Only partitions that ``df`` has rows for are replaced, so one year can be delivered again while the others stay.
    """
    kept = df.where(F.col(year).isin(*years))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(year).parquet(path)
    stored = df.sparkSession.read.parquet(path).where(F.col(year).isin(*years))
    return stored.groupBy(year).agg(F.count(F.lit(1)).alias("n"))


def in_years(rows: DataFrame, years: DataFrame, year: str = "ano") -> DataFrame:
    """Rows of a dataset partitioned by year whose year is in ``years``; other partitions are not read.

    The list is cast to SMALLINT and made distinct, so at most 65,536 rows are broadcast, and the same broadcast prunes
    the partitions when the plan runs. NULL years match nothing.
    """
    listed = years.select(F.col(year).cast("smallint").alias(year)).where(F.col(year).isNotNull()).distinct()
    return rows.join(F.broadcast(listed), rows[year] == listed[year].cast(rows.schema[year].dataType), "left_semi")


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def load_tables(spark: SparkSession, schema: str, names: Sequence[str], required: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The tables of a layer that exist; a missing required one stops the run."""
    found = {n: spark.table(f"{schema}.{n}") for n in names if table_exists(spark, f"{schema}.{n}")}
    missing = [n for n in required if n not in found]
    if missing:
        raise MissingInput(f"required tables missing from {schema}: {missing}")
    for name in set(names) - set(found):
        log.warning("%s.%s does not exist and is left out", schema, name)
    return found


def save_table(df: DataFrame, table: str, files: int | None = None, partition: str = "ano", fmt: str = "parquet") -> None:
    """Overwrite a managed table, partitioned by year when there is one; ``files`` merges small outputs.

    Outputs are merged by their size when the write runs, so a table that is not small is still written by many tasks, and what
    comes before the write keeps its own width."""
    if files:
        df = df.hint("rebalance")
    writer = df.write.format(fmt).mode("overwrite").option("overwriteSchema", "true")
    if partition in df.columns:
        writer = writer.partitionBy(partition)
    writer.saveAsTable(table)


def staged_name(table: str) -> str:
    """A new version of a table, invisible under the table's own name until it is published."""
    return f"{table}{VERSION}{uuid.uuid4().hex[:12]}"


def publish(spark: SparkSession, table: str, staged: str) -> None:
    """Points the table's name, a view, at a staged version: one change in the catalog, no row is read or written again.

    The version replaced stays until the next publication, so that running readers finish; versions that were never published
    or are older go."""
    schema, name = table.rsplit(".", 1)
    replaced = None
    if table_exists(spark, table):
        if spark.catalog.getTable(table).tableType == "VIEW":
            replaced = spark.sql(f"SHOW TBLPROPERTIES {table} ('versao')").first()["value"]
        else:  # written by ``save_table``: has no pointer yet
            spark.sql(f"DROP TABLE {table}")
    spark.sql(f"CREATE OR REPLACE VIEW {table} TBLPROPERTIES ('versao' = '{staged}') AS SELECT * FROM {staged}")
    for row in spark.sql(f"SHOW TABLES IN {schema} LIKE '{name}{VERSION}*'").collect():
        version = f"{schema}.{row['tableName']}"
        if version not in (staged, replaced):
            spark.sql(f"DROP TABLE IF EXISTS {version}")


def read_product(spark: SparkSession, path: str, columns: Sequence[str] | None = None, year: int | None = None) -> DataFrame:
    """Parquet scan with the year filter (partition pruning) and the column list pushed to the files."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise MissingInput(f"{path} does not exist; build the product first") from error
        raise
    if year is not None:
        df = df.where(F.col("ano") == year)
    return df.select(*columns) if columns else df


def read_reference(spark: SparkSession, path: str, schema: T.StructType, network: str | None = None) -> DataFrame:
    """Small reference CSV with a declared schema, optionally one network only."""
    df = read_typed_csv(spark, path, schema, schema.fieldNames())
    return df if network is None else df.where(F.col("rede") == network)


def write_product(df: DataFrame, path: str, fmt: str = "parquet", partition: Sequence[str] = ()) -> None:
    """Product sink: Parquet, CSV with header, or JSON lines."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if fmt == "parquet":
        writer = writer.option("compression", "zstd")
    if partition:
        writer = writer.partitionBy(*partition)
    writer.save(path)


def fingerprint(df: DataFrame, source: str) -> DataFrame:
    """Order-insensitive content fingerprint: row count and the sum of the row hashes."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(df.columns)]
    return df.agg(
        F.count(F.lit(1)).alias("linhas"),
        F.coalesce(F.sum(F.xxhash64(*cells).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("soma_hash"),
    ).select(F.lit(source).alias("fonte"), "linhas", "soma_hash")


def fingerprints(sources: Mapping[str, DataFrame]) -> DataFrame:
    tables = [fingerprint(df, name) for name, df in sources.items()]
    result = tables[0]
    for t in tables[1:]:
        result = result.unionByName(t)
    return result


def check_manifest(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources whose fingerprint is absent from or different in the manifest (empty = unchanged)."""
    old = manifest.select("fonte", F.col("linhas").alias("_l"), F.col("soma_hash").alias("_h"))
    joined = current.join(old, "fonte", "full_outer")
    return joined.where(~(F.col("linhas").eqNullSafe(F.col("_l")) & F.col("soma_hash").eqNullSafe(F.col("_h"))))
