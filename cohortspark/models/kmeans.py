"""k-means for many numbers of clusters and starts at once.

Every pass over the rows serves all (k, start) pairs: tasks add up, per model and cluster, rows, vectors, squares and squared
distances of their Arrow batches, and the sums of the tasks are added by an aggregate. The driver holds the centres, whose number
is fixed by the grid. Seeds are those of k-means++: each pass adds one seed per start, the row with the least -ln(u) / D² (D: its
distance to the start's nearest seed, u: MD5 of seed, step, start and id), which is a draw in proportion to D². A start's first k
seeds serve every k, and no draw depends on partitioning.

Defined cases: rows whose vector is NULL or holds NULL, NaN or an infinity take no part; equal rows are drawn and counted one by one,
rows of one id with one vector race alike; a NULL id is the empty text; with fewer different vectors than k the further clusters stay empty;
ties go to the first cluster; an empty table gives no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.contracts import SEED
from cohortspark.operators import ranks

MAX_ITERATIONS = 50
#: A model rests once no centre moves further than this.
TOLERANCE = 1e-4


@dataclass
class Clustering:
    """Centres with what the rows nearest to them add up to."""

    k: int
    start: int
    centres: np.ndarray
    sizes: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    inertia: float


def usable(vectors: DataFrame, column: str = "features") -> DataFrame:
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col(column).isNotNull() & ~bad)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _summed(vectors: DataFrame, column: str, partial: Callable[[np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Element-wise sums over all rows of the arrays {number: array} that ``partial`` makes of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for number, values in partial(_matrix(batch.column(0), batch.num_rows)):
                    made[number] = made[number] + values if number in made else values
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([v.tolist() for v in made.values()], pa.list_(pa.float64()))], names=["number", "v"])

    cells = vectors.select(column).mapInArrow(run, "number int, v array<double>").select("number", F.posexplode("v").alias("at", "v"))
    totals = cells.groupBy("number", "at").agg(F.sum("v").alias("v")).groupBy("number").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("v"))
    return {r["number"]: np.array([x["v"] for x in r["v"]]) for r in totals.collect()}


def seeds(vectors: DataFrame, id_column: str, most: int, starts: int, column: str = "features", seed: int = SEED) -> np.ndarray:
    """(start, seed, dimension): ``most`` seeds for each start; fewer starts come back only from an empty table."""
    chosen: np.ndarray | None = None
    for step in range(most):
        draws = F.array(*[ranks.md5_number(F.lit(seed), F.lit(step), F.lit(s), F.coalesce(F.col(id_column).cast("string"), F.lit(""))) for s in range(starts)])

        def race(batches: Iterator[pa.RecordBatch], known=chosen) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                u, x = (_matrix(batch.column(i), batch.num_rows) for i in (0, 1))
                times = -np.log((u + 0.5) / 2.0 ** 60)
                for s in range(starts):
                    if known is None:
                        left = np.ones(len(x))
                    else:
                        left = ((x[:, None, :] - known[s][None]) ** 2).sum(axis=2).min(axis=1)
                    with np.errstate(divide="ignore"):
                        time = np.where(left > 0, times[:, s] / left, np.inf)
                    # Equal times are settled by the vector, so the draw does not depend on the order of rows.
                    tied = x[time == time.min()]
                    first = tied[np.lexsort(tied.T[::-1])[0]]
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([time.min()]), pa.array([first.tolist()], pa.list_(pa.float64()))], names=["start", "time", "x"])

        won = vectors.select(draws.alias("u"), column).mapInArrow(race, "start int, time double, x array<double>").groupBy("start").agg(F.min(F.struct("time", "x")).alias("first"))
        found = {r["start"]: r["first"] for r in won.collect()}
        if not found:
            return np.zeros((0, most, 0))
        # Where every row is a seed already, the first seed is repeated and its cluster stays empty.
        new = np.array([found[s]["x"] if np.isfinite(found[s]["time"]) else chosen[s][0] for s in range(starts)])[:, None, :]
        chosen = new if chosen is None else np.concatenate([chosen, new], axis=1)
    return chosen


def measured(vectors: DataFrame, models: Sequence[tuple[int, int, np.ndarray]], column: str = "features") -> list[Clustering]:
    """One pass: what the rows nearest to each centre of each model add up to."""
    def partial(x: np.ndarray):
        squares = (x ** 2).sum(axis=1)
        columns = np.column_stack([np.ones(len(x)), squares, x])
        for number, (k, _, centres) in enumerate(models):
            away = (centres ** 2).sum(axis=1) - 2 * x @ centres.T
            nearest = away.argmin(axis=1)
            member = np.zeros((len(x), k))
            member[np.arange(len(x)), nearest] = 1
            inertia = np.maximum(away[np.arange(len(x)), nearest] + squares, 0).sum()
            yield number, np.append((member.T @ columns).ravel(), inertia)

    sums = _summed(vectors, column, partial)
    out = []
    for number, (k, start, centres) in enumerate(models):
        v = sums[number]
        cells = v[:-1].reshape(k, -1)
        out.append(Clustering(k, start, centres, cells[:, 0].astype(np.int64), cells[:, 2:], cells[:, 1], float(v[-1])))
    return out


def fit(vectors: DataFrame, id_column: str, grid: Sequence[int], restarts: int = 10, column: str = "features", seed: int = SEED) -> dict[int, Clustering]:
    """The cheapest of ``restarts`` starts for each k of ``grid``; ties go to the earlier start."""
    chosen = seeds(vectors, id_column, max(grid), restarts, column, seed)
    active = [(k, s, chosen[s][:k]) for k in grid for s in range(len(chosen))]
    resting: list[Clustering] = []
    for turn in range(MAX_ITERATIONS + 1):
        if not active:
            break
        moving = []
        for m in measured(vectors, active, column):
            moved = np.where(m.sizes[:, None] > 0, m.sums / np.maximum(m.sizes, 1)[:, None], m.centres)
            if turn == MAX_ITERATIONS or ((moved - m.centres) ** 2).sum(axis=1).max() <= TOLERANCE ** 2:
                resting.append(m)
            else:
                moving.append((m.k, m.start, moved))
        active = moving
    return {k: min((m for m in resting if m.k == k), key=lambda m: (m.inertia, m.start)) for k in grid if resting}


def silhouettes(vectors: DataFrame, models: Sequence[Clustering], column: str = "features") -> list[float | None]:
    """Mean silhouette under squared distances of each model, from the sums of its clusters: one pass, linear in the rows."""
    def partial(x: np.ndarray):
        squares = (x ** 2).sum(axis=1)
        for number, m in enumerate(models):
            row = np.arange(len(x))
            own = ((m.centres ** 2).sum(axis=1) - 2 * x @ m.centres.T).argmin(axis=1)
            n = np.maximum(m.sizes, 1)
            apart = np.maximum(squares[:, None] + m.squares / n - 2 * x @ (m.sums / n[:, None]).T, 0)
            apart[:, m.sizes == 0] = np.inf
            inside = apart[row, own] * n[own] / np.maximum(n[own] - 1, 1)
            apart[row, own] = np.inf
            outside = apart.min(axis=1)
            most = np.maximum(inside, outside)
            yield number, np.array([np.where((n[own] > 1) & (most > 0), (outside - inside) / np.where(most > 0, most, 1), 0.0).sum()])

    out: list[float | None] = [None] * len(models)
    several = [i for i, m in enumerate(models) if (m.sizes > 0).sum() > 1]
    models = [models[i] for i in several]
    sums = _summed(vectors, column, partial) if several else {}
    for at, i in enumerate(several):
        out[i] = float(sums[at][0] / models[at].sizes.sum())
    return out


def nearest(model: Clustering, column: str = "features") -> Column:
    """Number of the nearest centre, the first of ties; no Python."""
    away = F.array(*[F.aggregate(F.zip_with(column, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in model.centres])
    return (F.array_position(away, F.array_min(away)) - 1).cast("int")
