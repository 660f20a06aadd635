"""Exact global order statistics without a single-task window.

Values are cut into ranges by approximate quantile edges. The edges are one small row, read once and
embedded as literals, so both uses of the buckets see the same cuts; any edges give the same ranks.
A value that is itself an edge gets a bucket of its own, so a value held by a third of the rows is
never mixed with others and its rows can be spread further.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortspark.session import materialize, shuffle_width

_B, _SUB, _V, _REST = "_bucket", "_sub", "_value", "_rest"


def fit_edges(df: DataFrame, value: str | Column, buckets: int | None = None) -> list[float]:
    """At most ``buckets`` distinct cut points; one partial aggregate and one row to the driver."""
    buckets = buckets or shuffle_width(df.sparkSession)
    column = F.col(value) if isinstance(value, str) else value
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(column.cast("double"), probs, 4 * buckets).alias("e")).first()
    return sorted({float(e) for e in (row["e"] or []) if math.isfinite(e)}) or [0.0]


def _measure(df: DataFrame, value: str) -> list[float]:
    """Raw quantile cut points (repeats kept) in one aggregate."""
    buckets = shuffle_width(df.sparkSession)
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), probs, 4 * buckets).alias("e")).first()
    return [float(e) for e in (row["e"] or []) if math.isfinite(e)]


def add_bucket(df: DataFrame, value: str, edges: Sequence[float], out: str = _B) -> DataFrame:
    """Order-preserving bucket: even numbers hold exactly one value (an edge), odd ones what lies between."""
    splits = [-float("inf"), *edges, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_cut_in", outputCol="_cut", handleInvalid="keep")
    lower = F.array(*[F.lit(float(s)) for s in splits])[F.col("_cut").cast("int")]
    return (
        cut.transform(df.withColumn("_cut_in", F.col(value).cast("double")))
        .withColumn(out, (2 * F.col("_cut") + F.when(F.col("_cut_in") == lower, 0).otherwise(1)).cast("int"))
        .drop("_cut_in", "_cut")
    )


MAX_EDGE_LEVELS = 500


def fit_edges_by(df: DataFrame, value: str, level: str, buckets: int | None = None) -> dict[str, list[float]] | None:
    """Cut points per level of a short list (feature names); None if the list is not short."""
    buckets = min(buckets or shuffle_width(df.sparkSession), 256)
    probs = [i / buckets for i in range(1, buckets)]
    rows = df.groupBy(F.col(level).cast("string").alias("k")).agg(
        F.percentile_approx(F.col(value).cast("double"), probs, 4 * buckets).alias("e")).limit(MAX_EDGE_LEVELS + 1).collect()
    if len(rows) > MAX_EDGE_LEVELS or any(r["k"] is None for r in rows):
        return None
    return {r["k"]: sorted({float(e) for e in (r["e"] or []) if math.isfinite(e)}) or [0.0] for r in rows}


def add_bucket_by(df: DataFrame, value: str, level: str, edges: Mapping[str, Sequence[float]], out: str = _B) -> DataFrame:
    """As :func:`add_bucket` with the cut points of the row's own level."""
    if not edges:
        return df.withColumn(out, F.lit(0))
    own = F.create_map(*[c for k, es in edges.items() for c in (F.lit(k), F.array(*[F.lit(e) for e in es]))])[F.col(level).cast("string")]
    v = F.col(value).cast("double")
    below = F.size(F.filter(own, lambda e: e < v))
    return df.withColumn(out, (2 * below + F.when(F.array_contains(own, v), 1).otherwise(0)).cast("int"))


def _offsets(totals: DataFrame, measures: Sequence[str], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Prefix sums over the bucket totals only: as many rows as there are buckets."""
    key = [F.col(c) for c in by] or [F.lit(0)]
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    return totals.select(
        *by, *order,
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"_t_{m}") for m in measures],
    )


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], bounded: bool = False) -> DataFrame:
    """Equi-join that keeps the left copies of the keys; group keys match null-safe, internal ones are never NULL.

    ``bounded`` says that the right side has one row per range bucket, a few thousand at most, and is sent to all tasks.
    """
    right = right.select(*[F.col(c).alias(f"_j_{c}" if c in keys else c) for c in right.columns])
    condition = None
    for k in keys:
        same = left[k] == right[f"_j_{k}"] if k.startswith("_") else left[k].eqNullSafe(right[f"_j_{k}"])
        condition = same if condition is None else condition & same
    return left.join(F.broadcast(right) if bounded else right, condition).drop(*[f"_j_{k}" for k in keys])


def cumulate(
    hist: DataFrame, value: str, measures: Sequence[str], by: Sequence[str] = (),
    edges: Sequence[float] | None = None, scale_of: str | None = None, stored: bool = False,
) -> DataFrame:
    """Running totals in ascending value order over a histogram with one row per (by, value).

    Adds ``<m>_before`` (strictly lower values) and ``<m>_total`` for every measure. ``scale_of`` names
    a ``by`` column with few levels (features) whose values live on different scales; ``stored`` says that ``hist``
    needs no checkpoint.
    """
    own_edges = None
    if edges is None:
        hist = hist if stored else materialize(hist)
        cuts = _measure(hist, value)
        own_edges = fit_edges_by(hist, value, scale_of) if scale_of else None
        edges = (sorted(set(cuts)) or [0.0]) if own_edges is None else None
    rows = add_bucket(hist, value, edges) if own_edges is None else add_bucket_by(hist, value, scale_of, own_edges)
    totals = rows.groupBy(*by, _B).agg(*[F.sum(m).alias(m) for m in measures])
    joined = _join(rows, _offsets(totals, measures, by, [_B]), [*by, _B], not by)
    local = Window.partitionBy(*by, _B).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        *hist.columns,
        *[(F.col(f"_o_{m}") + F.coalesce(F.sum(m).over(local), F.lit(0))).alias(f"{m}_before") for m in measures],
        *[F.col(f"_t_{m}").alias(f"{m}_total") for m in measures],
    )


SMALL_GROUP = 10_000


def _cumulate_small(hist: DataFrame, value: str, measure: str, by: Sequence[str]) -> DataFrame:
    """:func:`cumulate` for groups of a bounded number of values: one shuffle."""
    group = Window.partitionBy(*by)
    before = group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return hist.select(
        "*", F.coalesce(F.sum(measure).over(before), F.lit(0)).alias(f"{measure}_before"), F.sum(measure).over(group).alias(f"{measure}_total"))


def quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (), scale_of: str | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, for groups of any size.

    ``probs`` maps output names to probabilities. A group is never gathered: the distinct values are
    counted, ranked by range buckets, and only the two order statistics per quantile are kept. Where no group has
    more than ``SMALL_GROUP`` distinct values, each is ranked by one window, without buckets.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_rows"))
    small = False
    if by and scale_of is None:
        hist = materialize(hist)
        small = (hist.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= SMALL_GROUP
    ranked = _cumulate_small(hist, value, "_rows", by) if small else cumulate(hist, value, ["_rows"], by, scale_of=scale_of, stored=bool(by) and scale_of is None)
    picks, names = [], []
    for name, p in probs.items():
        position = F.round((F.col("_rows_total") - 1) * F.lit(float(p)), 9)
        for side, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            inside = (F.col("_rows_before") <= index) & (index < F.col("_rows_before") + F.col("_rows"))
            picks.append(F.max(F.when(inside, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_{name}_f"))
        names.append(name)
    picked = ranked.groupBy(*by).agg(*picks)
    return picked.select(*by, *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n) for n in names
    ])


def _tie_value(df: DataFrame, tie: str) -> Column:
    """A number that sorts like the tie-break column (text: its first six bytes)."""
    if isinstance(df.schema[tie].dataType, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(tie, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(tie).cast("double")


def _rest(df: DataFrame, value: str, descending: bool) -> Column:
    """What a whole number differs from its double by, in rank order: with the double it identifies the number."""
    if not isinstance(df.schema[value].dataType, T.LongType):
        return F.lit(0)
    whole = F.col(value).cast("decimal(38,0)")
    return ((whole - F.col(value).cast("double").cast("decimal(38,0)")) * (-1 if descending else 1)).cast("int")


def row_number(
    df: DataFrame, value: str, tie: str, out: str, descending: bool = False, by: Sequence[str] = (),
    with_total: str | None = None,
) -> DataFrame:
    """Global (or per-group) ordinal rank by (value, tie ascending), no partition larger than a range bucket.

    Rows with a NULL value get no rank (NULL). ``tie`` must be unique within equal values.
    """
    plain = df.columns
    ordered = df.withColumn(_V, F.col(value).cast("double") * (-1 if descending else 1)).withColumn(
        _V, F.when(F.col(_V) == 0, F.lit(0.0)).otherwise(F.col(_V)))
    ordered = materialize(ordered)
    known = ordered.where(F.col(_V).isNotNull())
    cuts = _measure(known, _V)
    # The double only picks the bucket; whole numbers beyond 2**53 are told apart by themselves.
    exact = F.col(value).desc() if descending else F.col(value).asc()
    blank = [F.lit(None).cast("bigint").alias(c) for c in [out] + ([with_total] if with_total else [])]
    unknown = ordered.where(F.col(_V).isNull()).select(*plain, *blank)
    edges = sorted(set(cuts)) or [0.0]
    hot = sorted({e for e in cuts if cuts.count(e) > 1})
    rows = add_bucket(known, _V, edges)
    if hot:
        # Values that fill whole ranges: their rows are cut again by the tie-break column, the finer the
        # fewer such values there are, so that the number of pieces stays a small multiple of the width.
        pieces = max(8, 2 * shuffle_width(df.sparkSession) // len(hot))
        tie_edges = fit_edges(known.where(F.col(_V).isin(hot)), _tie_value(known, tie), pieces)
        rows = add_bucket(rows.withColumn("_tie_key", _tie_value(known, tie)), "_tie_key", tie_edges, "_tie_bucket")
        rows = rows.withColumn(_SUB, F.when(F.col(_B) % 2 == 0, F.col("_tie_bucket")).otherwise(0)).drop("_tie_key", "_tie_bucket")
    else:
        rows = rows.withColumn(_SUB, F.lit(0))
    rows = rows.withColumn(_REST, F.when(F.col(_B) % 2 == 0, _rest(df, value, descending)).otherwise(0))
    place = [_B, _REST, _SUB]
    totals = rows.groupBy(*by, *place).agg(F.count(F.lit(1)).alias("_cnt"))
    joined = _join(rows, _offsets(totals, ["_cnt"], by, place), [*by, *place])
    local = Window.partitionBy(*by, *place).orderBy(_V, exact, tie)
    extra = [F.col("_t__cnt").alias(with_total)] if with_total else []
    ranked = joined.select(*plain, (F.col("_o__cnt") + F.row_number().over(local)).alias(out), *extra)
    return ranked.unionByName(unknown)


def tied_rank(
    df: DataFrame, value: str, out: str, by: Sequence[str] = (), method: str = "average", descending: bool = False,
) -> DataFrame:
    """Rank with ties (``average`` or ``min``) for every row; NULL values keep a NULL rank."""
    plain = df.columns
    ordered = df.withColumn(_V, F.col(value).cast("double") * (-1 if descending else 1))
    ordered = materialize(ordered)
    known = ordered.where(F.col(_V).isNotNull())
    unknown = ordered.where(F.col(_V).isNull()).select(*plain, F.lit(None).cast(rank_type(method)).alias(out))
    cuts = _measure(known, _V)
    rows = add_bucket(known, _V, sorted(set(cuts)) or [0.0])
    spread = F.pmod(F.xxhash64(*plain), F.lit(shuffle_width(df.sparkSession))).cast("int")
    rows = rows.withColumn(_SUB, F.when(F.col(_B) % 2 == 0, spread).otherwise(0))
    rows = rows.withColumn(_REST, F.when(F.col(_B) % 2 == 0, _rest(df, value, descending)).otherwise(0))
    place = [_B, _REST]
    totals = rows.groupBy(*by, *place).agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = _offsets(totals, ["_cnt"], by, place)
    joined = _join(_join(rows, totals, [*by, *place]), offsets, [*by, *place])
    local = Window.partitionBy(*by, *place, _SUB).orderBy(_V, F.col(value).desc() if descending else F.col(value).asc())
    same = Window.partitionBy(*by, *place, _SUB, _V, F.col(value))
    single = F.col(_B) % 2 == 0
    first = F.when(single, F.lit(1)).otherwise(F.rank().over(local))
    ties = F.when(single, F.col("_cnt")).otherwise(F.count(F.lit(1)).over(same))
    rank = F.col("_o__cnt") + first + ((ties - 1) / 2 if method == "average" else F.lit(0))
    rank = rank.cast("double" if method == "average" else "bigint")
    ranked = joined.select(*plain, rank.alias(out))
    return ranked.unionByName(unknown)


def rank_type(method: str) -> str:
    return "double" if method == "average" else "bigint"


def frequency_bin(position: Column, total: Column, bins: int) -> Column:
    """Equal-frequency bin 1..bins of an ordinal position: quantile cuts of the ranks, right-closed."""
    cut = F.ceil(F.round((position - 1) * F.lit(bins) / (total - 1), 9))
    return F.when(position.isNotNull(), F.when(total <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), cut))).cast("int")


def equal_frequency(
    df: DataFrame, value: str, tie: str, bins: int, out: str, descending: bool = False, by: Sequence[str] = (),
) -> DataFrame:
    ranked = row_number(df, value, tie, "_position", descending, by, with_total="_total")
    return ranked.withColumn(out, frequency_bin(F.col("_position"), F.col("_total"), bins)).drop("_position", "_total")


def quantile_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """Exact quantile edges with duplicates removed: bins + 1 numbers at most, read once."""
    names = {f"e{i}": i / bins for i in range(bins + 1)}
    row = quantiles(df, value, names).first()
    return [] if row is None else sorted({float(row[n]) for n in names})


def cut(column: Column, edges: Sequence[float], labels: Sequence, include_lowest: bool = False) -> Column:
    """Right-closed bins over given edges; outside the edges and NULL give NULL."""
    result = None
    for i, (low, high, label) in enumerate(zip(edges[:-1], edges[1:], labels)):
        above = column >= low if include_lowest and i == 0 else column > low
        inside = above & (column <= high)
        result = F.when(inside, label) if result is None else result.when(inside, label)
    return result if result is not None else F.lit(None)


def md5_number(*parts: Column) -> Column:
    """60 bits of the MD5 of the printed parts, joined by colons: any engine with MD5 draws the same."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_position(
    df: DataFrame, key: Sequence[str], seed: int, out: str, by: Sequence[str] = (), salt: int = 0,
) -> DataFrame:
    """Position of every row in a seeded random order, a function of (key, seed) alone.

    The order is a hash, so its leading bits cut it into even ranges without looking at the data.
    """
    plain = df.columns
    bits = max(3, math.ceil(math.log2(shuffle_width(df.sparkSession))))
    rows = df.withColumn("_h", md5_number(F.lit(seed), F.lit(salt), *[F.col(c) for c in key]))
    rows = rows.withColumn(_B, F.shiftright("_h", 60 - bits).cast("int"))
    totals = rows.groupBy(*by, _B).agg(F.count(F.lit(1)).alias("_cnt"))
    joined = _join(rows, _offsets(totals, ["_cnt"], by, [_B]), [*by, _B], not by)
    local = Window.partitionBy(*by, _B).orderBy("_h", *key)
    return joined.select(*plain, (F.col("_o__cnt") + F.row_number().over(local)).alias(out))


def running_sum(df: DataFrame, order: str, measure: str, out: str) -> DataFrame:
    """Inclusive running sum over a column of unique order values."""
    total = cumulate(df, order, [measure])
    return total.withColumn(out, F.col(f"{measure}_before") + F.col(measure)).drop(
        f"{measure}_before", f"{measure}_total")
