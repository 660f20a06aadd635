"""Ridge logistic regressions of many training sets and many labels in shared scans.

A training set is a mark on rows (all folds but one, a sample of groups, all regions but one), a label a 0/1 column
(the outcome, or its permutations). What a model sees of a row is linear in a base vector that no training set
changes: the value (zero if missing) and a missing mark per number, one mark per level. Medians, means, deviations, the
levels a set knows and their pooling are a matrix per set from base vector to model columns. So

1. one scan sums the base vectors and their squares per set, which gives every set's preprocessing;
2. every Newton step is one scan for all models together: each task adds up gradient and curvature of the base vector,
   Spark adds the tasks up, the driver turns them by each set's matrix and solves systems of the size of the columns;
3. one scan turns the coefficients of all models into score histograms, already summed per block.

Rows are stored once as blocks of packed numbers. What reaches the driver is models x columns^2, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.contracts import CATEGORICAL_FEATURES, PRUNED_FEATURES, RARE_CATEGORICAL_FEATURES
from cohortspark.models.preprocess import ABSENT, POOLED, OutputColumn
from cohortspark.operators import metrics, ranks
from cohortspark.operators.quality import QualityError
from cohortspark.session import materialize

#: Most training sets, and most levels of all categories, of one batch: they size the driver's matrices.
MAX_SETS, MAX_LEVELS = 64, 1000
BLOCK_ROWS = 8_192
TOLERANCE = 1e-13


@dataclass(frozen=True)
class Base:
    """The base vector: its Columns, and per feature where its entries are."""

    features: tuple[str, ...]
    entries: tuple[Column, ...]
    numeric: dict[str, tuple[int, int, float]]  # value, missing mark, centre
    levels: dict[str, dict[str | None, int]]


@dataclass(frozen=True)
class Design:
    """One training set: base vector with a leading one -> model columns with a leading one."""

    matrix: np.ndarray
    columns: tuple[OutputColumn, ...]
    rows: int
    missing: dict[str, int]


def base_of(df: DataFrame, features: Sequence[str]) -> Base:
    """Levels and centres of all rows. Both only fix the coordinates; what a set learns comes from its own sums."""
    categories = [c for c in features if c in CATEGORICAL_FEATURES or c in RARE_CATEGORICAL_FEATURES]
    numeric = [c for c in features if c not in categories]
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    means = df.agg(F.lit(0), *[F.avg(value(c)).alias(c) for c in numeric]).first()
    seen: dict[str, list[str | None]] = {c: [] for c in categories}
    if categories:
        cells = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v")) for c in categories])
        pairs = df.select(F.explode(cells).alias("p")).select("p.f", "p.v").distinct().limit(MAX_LEVELS + 1).collect()
        if len(pairs) > MAX_LEVELS:
            raise QualityError(f"more than {MAX_LEVELS} levels in {categories}")
        for f, v in sorted(pairs, key=lambda r: (r["f"], r["v"] is not None, r["v"] or "")):
            seen[f].append(v)
    for c in categories:  # a NULL counts as the commonest level of such a column, also where no row of ``df`` has one
        if c in RARE_CATEGORICAL_FEATURES and c not in CATEGORICAL_FEATURES and None not in seen[c]:
            seen[c].insert(0, None)
    entries: list[Column] = []
    numbers, levels = {}, {}
    for c in features:
        if c in seen:
            levels[c] = {v: len(entries) + i for i, v in enumerate(seen[c])}
            entries += [F.col(c).cast("string").eqNullSafe(F.lit(v)).cast("double") for v in seen[c]]
        else:
            centre = float(means[c] or 0.0)
            numbers[c] = (len(entries), len(entries) + 1, centre)
            entries += [F.coalesce(value(c) - centre, F.lit(0.0)), value(c).isNull().cast("double")]
    return Base(tuple(features), tuple(entries), numbers, levels)


def blocks(df: DataFrame, base: Base, sets: Sequence[Column], labels: Sequence[Column] | Column) -> DataFrame:
    """(n, x, s, y): rows packed as numbers. ``labels`` may be one array column."""
    if len(sets) > MAX_SETS:
        raise QualityError(f"{len(sets)} training sets, {MAX_SETS} at most")
    y = labels if isinstance(labels, Column) else F.array(*[c.cast("tinyint") for c in labels])
    rows = df.select(F.array(F.lit(1.0), *base.entries).alias("x"), F.array(*[F.coalesce(s, F.lit(False)).cast("tinyint") for s in sets]).alias("s"), y.cast("array<tinyint>").alias("y"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(low, BLOCK_ROWS)
                packed = [pa.array([part.column(i).flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()], pa.binary()) for i, kind in enumerate(("<f8", "i1", "i1"))]
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), *packed], names=["n", "x", "s", "y"])

    return materialize(rows.mapInArrow(pack, "n int, x binary, s binary, y binary"))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, s, y) of each block, read where they lie in the batch: no copy of a batch is made."""
    for batch in batches:
        n, *parts = batch.columns
        for i in range(batch.num_rows):
            yield tuple(_view(p, i, kind).reshape(n[i].as_py(), -1) for p, kind in zip(parts, ("<f8", "i1", "i1")))


def _view(column: pa.BinaryArray, i: int, kind: str) -> np.ndarray:
    _, offsets, data = column.buffers()
    low, high = np.frombuffer(offsets, dtype="<i4")[column.offset + i:column.offset + i + 2].tolist()
    return np.frombuffer(data, dtype=kind, count=(high - low) // np.dtype(kind).itemsize, offset=low)


def _summed(packed: DataFrame, partial) -> dict[int, np.ndarray]:
    """Element-wise sums of the arrays {number: array} that ``partial`` makes of a task's blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for x, s, y in unpacked(batches):
            for number, values in partial(x, s, y):
                made[number] = made[number] + values if number in made else values
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([v.tolist() for v in made.values()], pa.list_(pa.float64()))], names=["number", "v"])

    cells = packed.mapInArrow(run, "number int, v array<double>").select("number", F.posexplode("v").alias("at", "v"))
    out: dict[int, dict[int, float]] = {}
    for number, at, v in cells.groupBy("number", "at").agg(F.sum("v").alias("v")).collect():
        out.setdefault(number, {})[at] = v
    return {k: np.array([cell[i] for i in range(len(cell))]) for k, cell in out.items()}


def _medians(df: DataFrame, base: Base, sets: Sequence[Column], columns: Sequence[str]) -> dict[tuple[str, int], float]:
    """Exact median of each number over each training set."""
    cells = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in columns])
    member = F.array(*[F.when(s, F.lit(t)) for t, s in enumerate(sets)])
    long = df.select(F.explode(cells).alias("p"), member.alias("t")).select("p.f", "p.v", F.explode(F.array_compact("t")).alias("t")).where(~F.isnan("v"))
    return {(r["f"], r["t"]): r["m"] for r in ranks.quantiles(long, "v", {"m": 0.5}, ["f", "t"], scale_of="f").collect()}


def designs(df: DataFrame, packed: DataFrame, base: Base, sets: Sequence[Column], indicators: bool = False, min_frequency: float = 0.01) -> list[Design]:
    """The preprocessing of every training set, from one scan (and one of quantiles where numbers are missing)."""
    width = len(base.entries) + 1

    def moments(x, s, y):
        both = np.concatenate([x, x * x], axis=1)
        return enumerate(s.T.astype(float) @ both)

    sums = _summed(packed, moments)
    sums = [sums.get(t, np.zeros(2 * width)) for t in range(len(sets))]
    partial = [c for c, (_, miss, _) in base.numeric.items() if any(v[1 + miss] for v in sums)]
    medians = _medians(df, base, sets, partial) if partial else {}
    return [_design(base, t, v[:width], v[width:], medians, indicators, min_frequency) for t, v in enumerate(sums)]


def _design(base: Base, number: int, total: np.ndarray, squares: np.ndarray, medians, indicators: bool, min_frequency: float) -> Design:
    n = total[0]
    made: list[tuple[np.ndarray, OutputColumn]] = []
    marks: list[tuple[np.ndarray, OutputColumn]] = []

    def form(parts: dict[int, float]) -> np.ndarray:
        line = np.zeros(len(total))
        for at, v in parts.items():
            line[at] = v
        return line

    for c in base.features:
        if c in base.numeric:
            at, miss, centre = base.numeric[c]
            known, gone = n - total[1 + miss], total[1 + miss]
            fill = medians.get((c, number), 0.0) - centre if gone else 0.0
            mean = (total[1 + at] + gone * fill) / n if n else 0.0
            own = total[1 + at] / known if known else 0.0
            spread = max((squares[1 + at] - known * own * own) + known * (own - mean) ** 2 + gone * (fill - mean) ** 2, 0.0) / n if n else 0.0
            # What is left of equal values by rounding is no spread.
            sd = spread ** 0.5 if spread > 1e-24 * (1 + centre * centre) else 1.0
            made.append((form({1 + at: 1 / sd, 1 + miss: fill / sd, 0: -mean / sd}), OutputColumn(c, c, "value")))
            if indicators and gone:
                share = gone / n
                sd = (share * (1 - share)) ** 0.5 or 1.0
                marks.append((form({1 + miss: 1 / sd, 0: -share / sd}), OutputColumn(f"{c}=NULL", c, "missing")))
        elif c in CATEGORICAL_FEATURES:
            named: dict[str, list[int]] = {}
            for v, at in base.levels[c].items():
                if total[1 + at]:
                    named.setdefault(ABSENT if v is None else v, []).append(1 + at)
            for v in sorted(named):
                made.append((form({i: 1.0 for i in named[v]}), OutputColumn(f"{c}={v}", c, "level")))
        else:
            counts = {v: total[1 + at] for v, at in base.levels[c].items() if v is not None and total[1 + at]}
            if not counts:
                continue
            common = min(counts, key=lambda v: (-counts[v], v))
            kept = [v for v in sorted(counts) if counts[v] >= min_frequency * n]
            pool = form({0: 1.0})
            for v in kept:
                line = form({1 + base.levels[c][v]: 1.0})
                if v == common and None in base.levels[c]:
                    line[1 + base.levels[c][None]] = 1.0
                pool = pool - line
                made.append((line, OutputColumn(f"{c}={v}", c, "level")))
            if kept and len(kept) < len(counts):
                made.append((pool, OutputColumn(f"{c}={POOLED}", c, "level")))
    lines = made + marks
    matrix = np.zeros((len(total), len(lines) + 1))
    matrix[0, 0] = 1.0
    for i, (line, _) in enumerate(lines):
        matrix[:, i + 1] = line
    return Design(matrix, tuple(c for _, c in lines), int(n), {c: int(total[1 + miss]) for c, (_, miss, _) in base.numeric.items()})


@dataclass(frozen=True)
class Fitted:
    """Model m of ``pairs[m]`` = (set, label): coefficients of its columns, and of the base vector."""

    designs: list[Design]
    pairs: list[tuple[int, int]]
    beta: list[np.ndarray]
    steps: int

    def gamma(self) -> np.ndarray:
        return np.stack([self.designs[t].matrix @ b for (t, _), b in zip(self.pairs, self.beta)], axis=1)


def _sigmoid(eta: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * eta))


def solve(packed: DataFrame, made: list[Design], pairs: Sequence[tuple[int, int]], penalty: float = 1.0, most_steps: int = 50) -> Fitted:
    """Newton steps for all models at once: summed loss + penalty/2 * |beta|^2, the intercept free.

    A step that raises a model's loss is halved; a model is done when its squared Newton decrement is below the tolerance, so
    later scans only carry those that are not. Where several labels share a set, curvature at zero is the same for all and is
    summed once a set; a model goes on with it, scaled by its own sum of p(1-p), and asks for its own curvature only when a step
    gains less than a hundredfold. Such models are held to a tolerance a ten-thousandth as large, as they come closer step by step."""
    beta = [np.zeros(made[t].matrix.shape[1]) for t, _ in pairs]
    step: list[np.ndarray | None] = [None] * len(pairs)
    loss, gap = [np.inf] * len(pairs), [np.inf] * len(pairs)
    open_models = [m for m, (t, _) in enumerate(pairs) if made[t].rows]
    first = {t: m for m, (t, _) in reversed(list(enumerate(pairs))) if made[t].rows}
    shared = len(first) < len(open_models)
    exact = set(first.values()) if shared else set(open_models)
    bent: dict[int, tuple[np.ndarray, float]] = {}
    for turn in range(1, most_steps + 1):
        todo: dict[int, list[tuple[int, int, bool]]] = {}
        for m in open_models:
            todo.setdefault(pairs[m][0], []).append((m, pairs[m][1], m in exact))
        gammas = {t: np.stack([made[t].matrix @ beta[m] for m, _, _ in models], axis=1) for t, models in todo.items()}

        def partial(x, s, y, todo=todo, gammas=gammas):
            for t, models in todo.items():
                rows = np.flatnonzero(s[:, t])
                if not len(rows):
                    continue
                xs, ys = x[rows], y[rows][:, [l for _, l, _ in models]].astype(float)
                eta = xs @ gammas[t]
                p = _sigmoid(eta)
                weight = p * (1 - p)
                slopes = xs.T @ (p - ys)
                losses, weights = (np.logaddexp(0, eta) - ys * eta).sum(axis=0), weight.sum(axis=0)
                for i, (m, _, whole) in enumerate(models):
                    curve = ((xs * weight[:, i, None]).T @ xs).ravel() if whole else []
                    yield m, np.concatenate([slopes[:, i], [losses[i], weights[i]], curve])

        sums = _summed(packed, partial)
        for m in exact:
            q = len(made[pairs[m][0]].matrix)
            bent[m] = sums[m][q + 2:].reshape(q, q), sums[m][q + 1]
        if shared and turn == 1:
            bent.update({m: bent[first[pairs[m][0]]] for m in open_models})
        left, asking = [], set()
        for m in open_models:
            a, free = made[pairs[m][0]].matrix, np.append(0.0, np.ones(len(beta[m]) - 1))
            q = len(a)
            now = sums[m][q] + 0.5 * penalty * (free * beta[m] ** 2).sum()
            if now > loss[m] * (1 + 1e-12) + 1e-12 and step[m] is not None and np.abs(step[m]).max() > 1e-12:
                step[m] = step[m] / 2
                beta[m] = beta[m] - step[m]
                left.append(m)
                asking.add(m)
                continue
            slope = a.T @ sums[m][:q] + penalty * free * beta[m]
            curve, weight = bent[m]
            curve = a.T @ (curve if m in exact else curve * (sums[m][q + 1] / weight)) @ a + np.diag(penalty * free)
            curve[0, 0] += 1e-12 * (1 + curve[0, 0])  # a set of one class has a flat intercept in the limit
            move = -np.linalg.solve(curve, slope)
            loss[m], step[m] = now, move
            beta[m] = beta[m] + move
            reached = -(slope @ move)
            if reached > TOLERANCE * (1 if m in exact else 1e-4) * (1 + abs(now)):
                left.append(m)
                if not shared or reached > 0.01 * gap[m]:
                    asking.add(m)
            gap[m] = reached
        open_models, exact = left, asking
        if not open_models:
            return Fitted(made, list(pairs), beta, turn)
    raise QualityError(f"{len(open_models)} models without convergence after {most_steps} steps")


def score_histograms(packed: DataFrame, fitted: Fitted, checks: Sequence[tuple[int, int, bool]]) -> DataFrame:
    """(check, score, n_pos, n_neg) of each check (model, set, inside): the model's scores on the rows in or out of a set,
    against the model's own label. Equal scores of a block are summed before the shuffle."""
    gamma = fitted.gamma()
    labels = [l for _, l in fitted.pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, s, y in unpacked(batches):
            p = _sigmoid(x @ gamma)
            for number, (m, t, inside) in enumerate(checks):
                rows = np.flatnonzero(s[:, t] == inside)
                if len(rows):
                    score, at = np.unique(p[rows, m], return_inverse=True)
                    pos = np.bincount(at, y[rows, labels[m]], len(score)).astype(np.int64)
                    neg = np.bincount(at, minlength=len(score)) - pos
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), number, np.int32)), pa.array(score), pa.array(pos), pa.array(neg)], names=["check", "score", "n_pos", "n_neg"])

    rows = packed.mapInArrow(run, "check int, score double, n_pos long, n_neg long")
    return rows.groupBy("check", "score").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))


#: Blocks whose scores a task holds before it packs them.
HELD_BLOCKS = 8


def _check_edges(packed: DataFrame, gamma: np.ndarray, checks: Sequence[tuple[int, int, bool]], ranges: int) -> np.ndarray:
    """Range limits of every check: quantiles of its scores in the first block of each batch, averaged. They only deal the rows."""
    probs = np.arange(1, ranges) / ranges

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, s, _ = next(unpacked(iter([batch])))
            p = _sigmoid(x @ gamma)
            found = [(number, np.quantile(p[s[:, t] == inside, m], probs)) for number, (m, t, inside) in enumerate(checks) if (s[:, t] == inside).any()]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int32()), pa.array([v.tolist() for _, v in found], pa.list_(pa.float64()))], names=["check", "v"])

    rows = packed.mapInArrow(partial, "check int, v array<double>").select("check", F.posexplode("v").alias("at", "v")).groupBy("check", "at").agg(F.avg("v").alias("v"))
    edges = np.zeros((len(checks), ranges - 1))
    for r in rows.collect():
        edges[r["check"], r["at"]] = r["v"]
    return np.maximum.accumulate(edges, axis=1)


def score_pieces(packed: DataFrame, fitted: Fitted, checks: Sequence[tuple[int, int, bool]]) -> DataFrame:
    """The rows of :func:`score_histograms` as packed pieces of score ranges, for :func:`metrics.auc_of_pieces`."""
    gamma = fitted.gamma()
    labels = [l for _, l in fitted.pairs]
    ranges = metrics.ranges_for(max(d.rows for d in fitted.designs))
    edges = _check_edges(packed, gamma, checks, ranges) if ranges > 1 else np.zeros((len(checks), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        blocks_held = 0

        def packed_up():
            return metrics.pieces_of((number, *(np.concatenate(v) for v in zip(*parts)), edges[number]) for number, parts in held.items())

        for x, s, y in unpacked(batches):
            p = _sigmoid(x @ gamma)
            for number, (m, t, inside) in enumerate(checks):
                rows = np.flatnonzero(s[:, t] == inside)
                if len(rows):
                    held.setdefault(number, []).append((p[rows, m], y[rows, labels[m]]))
            blocks_held += 1
            if blocks_held == HELD_BLOCKS:
                yield from packed_up()
                held, blocks_held = {}, 0
        yield from packed_up()

    return packed.mapInArrow(run, metrics.PIECE)


def probability(base: Base, gamma: np.ndarray, which: Column) -> Column:
    """Score of a row under model ``which`` (its number), as a Column: no Python on the way."""
    own = lambda line: F.get(F.array(*[F.lit(float(g)) for g in line]), which)
    eta = sum((entry * own(line) for entry, line in zip(base.entries, gamma[1:])), own(gamma[0]))
    return (F.lit(1.0) + F.tanh(eta * 0.5)) * 0.5


@dataclass(frozen=True)
class Batch:
    base: Base
    packed: DataFrame
    fitted: Fitted


def fit(
    df: DataFrame, sets: Sequence[Column], label: str | Column, features: Sequence[str] = PRUNED_FEATURES, indicators: bool = False, n_labels: int = 1,
    more_sets: Sequence[Column] = (),
) -> Batch:
    """All models (set, label) over ``features``; ``more_sets`` are marked in the blocks for checks but not trained on.
    ``label`` is a 0/1 column, or an array column of ``n_labels`` of them."""
    base = base_of(df, features)
    labels = [F.col(label)] if isinstance(label, str) else label
    packed = blocks(df, base, [*sets, *more_sets], labels)
    made = designs(df, packed, base, sets, indicators)
    return Batch(base, packed, solve(packed, made, [(t, l) for l in range(n_labels) for t in range(len(sets))]))


def fold_sets(k: int, fold: str = "fold") -> list[Column]:
    """Training set i: every row outside fold i."""
    return [F.col(fold) != i for i in range(k)]
