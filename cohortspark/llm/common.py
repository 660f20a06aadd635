"""Helpers shared by the corpus operators: staged tables, word splits, stable draws."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.session import ensure_checkpoint_dir

#: ASCII white space and the complement of the word characters, as regular expressions of the JVM.
SPACES = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for bytes in Python: upper-case letters lowered, then every non-word byte made a blank.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_WORDS = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in LOWER)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back: evaluated once, survives lost
    executors, short lineage, and columnar unlike a checkpoint."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/staged-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, every other character kept; NULL is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def blank_words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def plain_words(text: Column) -> Column:
    """Lower-cased runs of digits, letters and all characters beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(text), NOT_WORD), "")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the printed id modulo ``folds``; a NULL id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first of its longer forms that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
