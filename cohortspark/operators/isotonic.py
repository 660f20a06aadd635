"""Isotonic regression of any number of points, many curves at once, nothing gathered on the driver.

The fit is the slope of the greatest convex minorant of the points (weight so far, sum so far). Scores are cut into ranges:

1. each range pools its own points (adjacent violators) into blocks of rising means, which are its own minorant; stacks of blocks
   merge like a monoid, so only what happens across the limits of ranges is left to find;
2. across each limit runs at most one segment of the whole minorant, a bridge. It is the line that touches the points on either
   side from below: its slope is the root of a falling function, found for all limits of all curves by safeguarded Newton
   steps, each one scan in which every range answers with its touching point per limit;
3. blocks under a bridge give way to it, the others stay as they are where they are.

The driver holds ranges^2 numbers per curve. Between blocks the curve is linear, beyond the ends constant.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators import ranks
from cohortspark.session import materialize, shuffle_width

#: Score ranges of a curve and curves of one fit.
MAX_RANGES, MAX_CURVES = 128, 64
MOST_STEPS = 200
BLOCK = "cell int, x_low double, x_high double, n double, s double"


@dataclass(frozen=True)
class Curves:
    """``blocks`` (curve, x_low, x_high, value) of all curves, and the range limits they were cut at."""

    blocks: DataFrame
    edges: tuple[float, ...]


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(cell, its columns) of rows sorted by cell."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        cuts = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), len(columns[0])]
        for low, high in zip(cuts[:-1], cuts[1:]):
            if low == high:
                continue
            if last is not None and columns[0][low] != last:
                yield int(last), [np.concatenate(c) for c in zip(*held)]
                held = []
            last = columns[0][low]
            held.append([c[low:high] for c in columns[1:]])
    if held:
        yield int(last), [np.concatenate(c) for c in zip(*held)]


def pooled(x: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[list, list, list, list]:
    """Blocks (x_low, x_high, n, s) of rising means of points in rising order."""
    lows, highs, ns, ss = [], [], [], []
    for at, weight, total in zip(x.tolist(), n.tolist(), s.tolist()):
        low = at
        while ns and ss[-1] * weight >= total * ns[-1]:
            weight, total, low = weight + ns.pop(), total + ss.pop(), lows.pop()
            highs.pop()
        lows.append(low)
        highs.append(at)
        ns.append(weight)
        ss.append(total)
    return lows, highs, ns, ss


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cell, (x, n, s) in _cells_of(batches):
        made = pooled(x, n, s)
        yield pa.RecordBatch.from_arrays([pa.array([cell] * len(made[0]), pa.int32()), *[pa.array(c, pa.float64()) for c in made]], names=[c.split()[0] for c in BLOCK.split(", ")])


def fit(points: DataFrame) -> Curves:
    """Curves of ``points`` (curve int, x, n, s): ``n`` outcomes with the sum ``s`` at score ``x``, one row per curve and score."""
    spark = points.sparkSession
    points = materialize(points.select(F.col("curve").cast("int").alias("curve"), F.col("x").cast("double").alias("x"), F.col("n").cast("double").alias("n"), F.col("s").cast("double").alias("s")))
    edges = ranks.fit_edges(points, "x", min(MAX_RANGES, shuffle_width(spark)))
    cells = 2 * len(edges) + 4
    placed = ranks.add_bucket(points, "x", edges, "_range").select((F.col("curve") * cells + F.col("_range")).alias("cell"), "x", "n", "s")
    # Stored partitions are read as they were written: whole cells in order, so that no step shuffles or sorts them again.
    stacks = materialize(placed.repartition("cell").sortWithinPartitions("cell", "x").mapInArrow(_pool, BLOCK))
    totals = stacks.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("x_low").alias("low"), F.max("x_high").alias("high"), F.min(F.col("s") / F.col("n")).alias("least"), F.max(F.col("s") / F.col("n")).alias("most")).orderBy("cell").collect()
    curves: dict[int, list] = {}
    for r in totals:
        curves.setdefault(r["cell"] // cells, []).append(r)
    if len(curves) > MAX_CURVES:
        raise ValueError(f"{len(curves)} curves, {MAX_CURVES} at most")
    limits = {c: _Limits(rows) for c, rows in curves.items()}
    _bridge(stacks, limits, cells)
    keep, bridges = {}, []
    for c, found in limits.items():
        for j, r in enumerate(found.rows):
            start = found.right[j - 1][0] if j and found.spans(j - 1) else found.before[j][0]
            end = found.left[j][0] if j + 1 < len(found.rows) and found.spans(j) else found.before[j][0] + r["n"]
            keep[r["cell"]] = (start - found.before[j][0], end - found.before[j][0])
        seen = set()
        for b in range(len(found.rows) - 1):
            (wl, sl, low), (wr, sr, high) = found.left[b], found.right[b]
            if found.spans(b) and (wl, wr) not in seen:
                seen.add((wl, wr))
                bridges.append((c, float(low), float(high), float((sr - sl) / (wr - wl))))

    def surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, (low, high, n, s) in _cells_of(batches):
            start, end = keep[cell]
            after = np.cumsum(n)
            slack = 1e-9 * after[-1]
            left = (after - n >= start - slack) & (after <= end + slack)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(left.sum()), cell // cells, np.int32)), pa.array(low[left]), pa.array(high[left]), pa.array(s[left] / n[left])], names=["curve", "x_low", "x_high", "value"])

    schema = "curve int, x_low double, x_high double, value double"
    own = stacks.mapInArrow(surviving, schema)
    return Curves(materialize(own.unionByName(spark.createDataFrame(bridges, schema))), tuple(edges))


class _Limits:
    """The limits between the ranges of one curve: where each one's bridge begins and ends."""

    def __init__(self, rows: list):
        self.rows = rows
        sums = np.cumsum([(0.0, 0.0), *[(r["n"], r["s"]) for r in rows]], axis=0)
        self.before = sums[:-1]
        self.ends = sums[1:]
        many = len(rows) - 1
        self.low, self.high = np.full(many, min(r["least"] for r in rows) - 1.0), np.full(many, max(r["most"] for r in rows) + 1.0)
        self.slope = np.array([sums[-1][1] / sums[-1][0]] * many)
        self.left: list[tuple[float, float, float]] = [(0.0, 0.0, 0.0)] * many
        self.right: list[tuple[float, float, float]] = [(0.0, 0.0, 0.0)] * many
        self.through = [False] * many
        self.open = list(range(many))

    def spans(self, b: int) -> bool:
        return self.right[b][0] > self.left[b][0]

    def step(self, answers: dict[int, np.ndarray]) -> None:
        """``answers[j]``: per open limit the touching point (weight, sum, score before it, score after it) of range j."""
        rest = []
        for i, b in enumerate(self.open):
            slope = self.slope[b]
            touch = []
            for j in range(len(self.rows)):
                w, s, below, above = answers[j][i]
                if np.isnan(above):
                    above = self.rows[j + 1]["low"] if j + 1 < len(self.rows) else np.nan
                if np.isnan(below):
                    below = self.rows[j - 1]["high"] if j else np.nan
                touch.append((w + self.before[j][0], s + self.before[j][1], below, above))
            height = [p[1] - slope * p[0] for p in touch]
            at_left = min(range(b + 1), key=lambda j: (height[j], j))
            at_right = min(range(b + 1, len(touch)), key=lambda j: (height[j], -j))
            l, r = touch[at_left], touch[at_right]
            before = self.left[b][:2], self.right[b][:2]
            self.left[b], self.right[b] = (l[0], l[1], l[3]), (r[0], r[1], r[2])
            # Both touch at the limit itself, or the line through two points touches at those two.
            if r[0] <= l[0] or self.through[b] and before == (l[:2], r[:2]):
                continue
            gap = height[at_right] - height[at_left]
            if gap > 0:
                self.low[b] = slope
            elif gap < 0:
                self.high[b] = slope
            else:
                continue
            new = (r[1] - l[1]) / (r[0] - l[0])
            self.through[b] = self.low[b] < new < self.high[b]
            self.slope[b] = new if self.through[b] else 0.5 * (self.low[b] + self.high[b])
            if self.slope[b] != slope:
                rest.append(b)
        self.open = rest


def _bridge(stacks: DataFrame, limits: dict[int, _Limits], cells: int) -> None:
    """All limits of all curves: one scan per step for those that are still open."""
    for _ in range(MOST_STEPS):
        asked = {}
        for found in limits.values():
            for j, r in enumerate(found.rows if found.open else []):
                asked[r["cell"]] = (np.array([found.slope[b] for b in found.open]), np.array([b >= j for b in found.open]))
        if not asked:
            return

        def touching(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            for cell, (low, high, n, s) in _cells_of(batches):
                if cell not in asked:
                    continue
                slopes, is_left = asked[cell]
                mean = s / n
                at = np.where(is_left, np.searchsorted(mean, slopes, "left"), np.searchsorted(mean, slopes, "right"))
                w, t = np.append(0.0, np.cumsum(n)), np.append(0.0, np.cumsum(s))
                found = np.stack([w[at], t[at], np.append(np.nan, high)[at], np.append(low, np.nan)[at]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([found.ravel().tolist()], pa.list_(pa.float64()))], names=["cell", "v"])

        rows = stacks.mapInArrow(touching, "cell int, v array<double>").collect()
        answers = {r["cell"]: np.array(r["v"]).reshape(-1, 4) for r in rows}
        for found in limits.values():
            if found.open:
                found.step({j: answers[r["cell"]] for j, r in enumerate(found.rows)})
    raise ValueError("bridges without convergence")


def evaluate(curves: Curves, points: DataFrame, out: str) -> DataFrame:
    """``points`` (with ``curve`` and ``x``) and the curve's value at each: every point meets the nearest knots on either side within
    its range of scores, and the last and first knots of the ranges around it."""
    cell = lambda df: ranks.add_bucket(df, "x", list(curves.edges), "_cell")
    ends = F.array(F.struct(F.col("x_low").alias("x"), F.col("value").alias("v")), F.struct(F.col("x_high").alias("x"), F.col("value").alias("v")))
    knots = cell(curves.blocks.select("curve", F.explode(ends).alias("k")).select("curve", "k.x", "k.v"))
    edge = knots.groupBy("curve", "_cell").agg(F.min(F.struct("x", "v")).alias("first"), F.max(F.struct("x", "v")).alias("last"))
    grid = knots.select("curve").distinct().select("curve", F.explode(F.sequence(F.lit(0), F.lit(2 * len(curves.edges) + 3))).alias("_cell"))
    along = Window.partitionBy("curve").orderBy("_cell")
    fences = grid.join(edge, ["curve", "_cell"], "left").select(
        "curve", "_cell", F.last("last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"),
        F.first("first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_above"))
    names = points.columns
    asked = cell(points).select("curve", "_cell", "x", F.struct(*names).alias("_row"), F.lit(None).cast("double").alias("v"))
    both = asked.unionByName(knots.select("curve", "_cell", "x", F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), "v"))
    own = Window.partitionBy("curve", "_cell").orderBy("x")
    knot = F.when(F.col("_row").isNull(), F.struct("x", "v"))
    placed = both.select(
        "*", F.last(knot, ignorenulls=True).over(own.rangeBetween(Window.unboundedPreceding, 0)).alias("_under"),
        F.first(knot, ignorenulls=True).over(own.rangeBetween(0, Window.unboundedFollowing)).alias("_over")).where(F.col("_row").isNotNull())
    placed = placed.join(F.broadcast(fences), ["curve", "_cell"], "left")  # curves x ranges rows
    low, high = F.coalesce("_under", "_below"), F.coalesce("_over", "_above")
    between = low["v"] + (high["v"] - low["v"]) * (F.col("x") - low["x"]) / (high["x"] - low["x"])
    value = F.when(low.isNull(), high["v"]).when(high.isNull() | (high["x"] <= low["x"]), low["v"]).otherwise(between)
    return placed.select("_row.*", value.alias(out))
