"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target words over source words. Documents of a source
stand in the order (size, md5 of the id, id); their expected copies are prefix-summed, one random offset per
source is added, and a document is emitted once for each whole number its interval crosses. Ordering by size spreads the draw
over all sizes, so that the taken words miss the target by about the largest document at most.

The rank in the order is a sum of three parts, none of which gathers a source in one task: documents of smaller sizes
(from the table of sizes per source), documents of the same size whose md5 starts lower, and the place in that piece.
A size that a third of all rows share is cut by its md5 digits like any other.

Defined cases: a NULL text has size 0; a NULL source is a source of its own, last in order; a source without
words has target 0 and gives no copies; a NULL id ranks as the empty text; repeated rows are drawn one by one; an empty table
gives an empty result. One row per source is ordered in one task: sources are the entries of a mixing recipe.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import blank_words, stage, unused

#: Rows that one piece of a hot size should hold; fixes how many md5 digits cut it.
PIECE_ROWS = 20_000


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """(source, source_size, target): ``share`` of all words split by weight, none above ``cap`` times its source.

    Capped sources are those of the smallest cap-to-weight ratio; in that order the level at which the rest is
    shared follows from two running sums, so no rounds of resharing are needed."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1))
    weighed = weighed.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    everything, order = Window.partitionBy(), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    levels = weighed.withColumn("level", level)
    shared = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return levels.withColumn("shared", shared).select(
        "source", "source_size", F.least("most", F.coalesce(F.col("weight") * F.col("shared"), F.col("most"))).alias("target"))


def offset(seed: int):
    """A number in [0, 1) from the seed and the source: 48 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2 ** 48))


def mix(
    documents: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
    weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0, carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, and the columns in ``carry``."""
    sized = stage(documents.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(blank_words(F.col(text))).cast("long").alias("size"), *carry))
    digits = max(2, math.ceil(math.log(max(sized.count(), 1) / PIECE_ROWS, 16)))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = sized.withColumn("key", key).withColumn("piece", F.substring("key", 1, digits))
    per_piece = sized.groupBy("source", "size", "piece").agg(F.count(F.lit(1)).alias("n"))
    per_size = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    up_to = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    smaller = per_size.select(F.col("source").alias("s"), F.col("size").alias("z"), F.coalesce(F.sum("n").over(up_to("source", "size")), F.lit(0)).alias("smaller"))
    goal = targets(sized, weights, share, cap).withColumnRenamed("source", "t")
    start = per_piece.withColumn("lower", F.coalesce(F.sum("n").over(up_to("source", "size", "piece")), F.lit(0)))
    start = start.join(smaller, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    start = start.join(goal, F.col("source").eqNullSafe(F.col("t"))).select(
        "s", "z", F.col("piece").alias("p"), (F.col("smaller") + F.col("lower")).alias("start"), "source_size", "target",
        offset(seed).alias("offset"))
    placed = sized.withColumn("place", F.row_number().over(Window.partitionBy("source", "size", "piece").orderBy("key", "doc_id")))
    placed = placed.join(start, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("piece") == F.col("p")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("start") + F.col("place")
    crossed = F.floor(rank * rate + F.col("offset")) - F.floor((rank - 1) * rate + F.col("offset"))
    copies = F.least(crossed, F.ceil(rate)).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carry)


def emitted(documents: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **recipe) -> DataFrame:
    """The rows of ``documents``, all columns, each as often as it is drawn. ``documents`` must be a stored table: a row is
    known by its place in it."""
    row, copies = unused(documents, "mixing_row"), unused(documents, "mixing_copies")
    numbered = documents.withColumn(row, F.monotonically_increasing_id())
    drawn = mix(numbered, doc_id, source, text, carry=(row,), **recipe).where("copies > 0").select(row, F.col("copies").alias(copies))
    each = F.explode(F.sequence(F.lit(1), F.col(copies)))
    return numbered.join(drawn, row).select(*[F.col(f"`{c}`") for c in documents.columns], each.alias(unused(documents, "mixing_copy"))).select(
        *[F.col(f"`{c}`") for c in documents.columns])


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
weighed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
ratios AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS ratio FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ratios),
goals AS (
  SELECT source, source_size, least(most, coalesce(weight * max(CASE WHEN level <= ratio THEN level END) OVER (), most)) AS target
  FROM levels),
drawn AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id) AS place,
         CAST(('0x' || substr(md5('0:' || coalesce(s.source, '')), 1, 12)) AS UBIGINT)::DOUBLE / 281474976710656.0 AS shift
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(place * rate + shift) - floor((place - 1) * rate + shift), ceil(rate)) AS BIGINT) * size AS taken
FROM drawn
"""
