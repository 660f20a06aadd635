"""Whole-group resampling by frequency weights and the tests built on folds.

Drawing G groups with replacement is the same as giving every group a whole-number weight. The draws
are a function of (seed, replicate, draw number), so the intervals do not depend on partitioning.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.contracts import SEED
from cohortspark.functions.stats import pearson, t_quantile_975, t_two_sided_p
from cohortspark.operators import metrics, ranks
from cohortspark.session import materialize, shuffle_width


#: Bytes of the drawn counts of one block of units; more replicates take more rounds of scans.
COUNTS_BYTES = 64 << 20
#: Units of a block, and draws that a task numbers at once.
BLOCK, DRAWS = 1_024, 1 << 18
#: Messages that are hashed side by side.
MESSAGES = 1 << 14
#: Score ranges whose totals per replicate the driver adds up.
MAX_RANGES = 256
MAX_LEVELS = 256
#: Rows that meet all replicates at once.
SLICE = 2_048


def drawn(seed: int, rep: Column, draw: Column, size: Column) -> Column:
    """Which of ``size`` units (from one) a draw hits."""
    return ranks.md5_number(F.lit(seed), rep, draw) % size + 1


def replicate_weights(groups: DataFrame, key: Sequence[str], replicates: int, seed: int = SEED) -> DataFrame:
    """(rep, key, w): how often each group is drawn in each replicate; groups never drawn are absent. One row per pair: for
    counts that are to be joined; :func:`drawn_counts` holds the same draws as numbers."""
    numbered = materialize(ranks.hash_position(groups.select(*key).distinct(), key, seed, "_idx"))
    size = numbered.count()
    draws = (
        groups.sparkSession.range(size)
        .select("id", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
        .select("rep", drawn(seed, F.col("rep"), F.col("id"), F.lit(max(size, 1))).alias("_idx"))
        .groupBy("rep", "_idx").agg(F.count(F.lit(1)).alias("w"))
    )
    return draws.join(numbered, "_idx").select("rep", *key, "w")


_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * (1 << 32))) for i in range(64)]


def _md5_heads(words: np.ndarray) -> np.ndarray:
    """First 64 bits of the MD5 of many messages of one block each; ``words`` are the padded blocks, (16, messages)."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(words.shape[1], x) for x in start)
    for i in range(64):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINES[i]
        f += words[at]
        turn = np.uint32(_TURNS[i // 16][i % 4])
        a, d, c, b = d, c, b, b + ((f << turn) | (f >> (np.uint32(32) - turn)))
    first, second = ((x + y).byteswap().astype(np.uint64) for x, y in ((a, start[0]), (b, start[1])))
    return first << np.uint64(32) | second


def _draw_numbers(seed: int, rep: int, low: int, high: int) -> np.ndarray:
    """The numbers of the draws low..high-1 of a replicate, as :func:`drawn` makes them: the first 60 bits of each MD5."""
    start = np.frombuffer(f"{seed}:{rep}:".encode(), np.uint8)
    made = []
    while low < high:
        digits = len(str(low))
        end = min(high, 10 ** digits, low + MESSAGES)
        size = len(start) + digits
        if size > 55:
            raise ValueError(f"seed {seed}, replicate {rep}, draw {low}: too many digits")
        block = np.zeros((end - low, 64), np.uint8)
        block[:, :len(start)] = start
        rest = np.arange(low, end)
        for place in range(size - 1, len(start) - 1, -1):
            rest, digit = np.divmod(rest, 10)
            block[:, place] = 48 + digit
        block[:, size] = 0x80
        block[:, 56:58] = 8 * size & 255, 8 * size >> 8
        made.append(_md5_heads(np.ascontiguousarray(block.view("<u4").T)) >> np.uint64(4))
        low = end
    return np.concatenate(made).astype(np.int64) if made else np.zeros(0, np.int64)


def drawn_counts(spark: SparkSession, sizes: Sequence[int], low: int, high: int, seed: int) -> DataFrame:
    """(_u, _i, _w): for each unit _i (from one) of each universe _u of ``sizes`` units how often the replicates low..high draw it,
    as packed numbers. A task draws whole replicates and deals their counts in blocks of ``BLOCK`` units; the blocks of all
    replicates meet in the tasks that turn them into units. Nothing of it reaches the driver."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep in batch.column(0).to_pylist():
                counts = [np.zeros(n, "<u4") for n in sizes]
                most = max(sizes, default=0)
                for start in range(0, most, DRAWS):
                    numbers = _draw_numbers(seed, rep, start, min(start + DRAWS, most))
                    for n, c in zip(sizes, counts):
                        if n > start:
                            hit, times = np.unique(numbers[:n - start] % n, return_counts=True)
                            c[hit] += times.astype("<u4")
                for u, c in enumerate(counts):
                    parts = [c[at:at + BLOCK].tobytes() for at in range(0, len(c), BLOCK)]
                    if parts:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(parts), u, np.int32)), pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), rep, np.int64)), pa.array(parts, pa.binary())],
                            names=["u", "block", "rep", "c"])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*[batch.column(i).to_pylist() for i in range(4)]))
        for (u, block), held in groupby(rows, key=lambda r: r[:2]):
            counts = np.stack([np.frombuffer(r[3], "<u4") for r in held], axis=1)
            packed = counts.astype("u1") if counts.max() < 256 else counts
            names = np.arange(len(packed), dtype=np.int64) + 1 + block * BLOCK
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), u, np.int32)), pa.array(names), pa.array([c.tobytes() for c in packed], pa.binary())], names=["_u", "_i", "_w"])

    drawn_blocks = spark.range(low, high, 1, high - low).mapInArrow(draw, "u int, block int, rep long, c binary")
    met = drawn_blocks.repartition("u", "block").sortWithinPartitions("u", "block", "rep")
    return materialize(met.mapInArrow(turn, "_u int, _i long, _w binary"))


def _unpacked(counts: np.ndarray, width: int) -> np.ndarray:
    """(units, replicates) of packed counts."""
    made = np.empty((len(counts), width))
    for i, c in enumerate(counts):
        made[i] = np.frombuffer(c, "u1" if len(c) == width else "<u4")
    return made


def _with_counts(rows: DataFrame, counts: DataFrame, index: str = "_idx", universe: str | None = None) -> DataFrame:
    # Sizes of counts are guessed too small, so that a broadcast would take all of them through the driver.
    which = F.col(universe) if universe else F.lit(0)
    return rows.join(counts.hint("merge"), (which.cast("int") == F.col("_u")) & (F.col(index) == F.col("_i"))).drop("_u", "_i")


def rounds(sizes: Sequence[int], replicates: int) -> Iterator[tuple[int, int]]:
    """Ranges of replicates whose counts stay within the bound."""
    width = COUNTS_BYTES // (4 * max(sum(sizes), 1))
    if not width:
        raise ValueError(f"{sum(sizes)} units: the counts of one replicate exceed {COUNTS_BYTES} bytes")
    for low in range(0, replicates, width):
        yield low, min(low + width, replicates)


def numbered_groups(df: DataFrame, group: str, seed: int) -> tuple[DataFrame, int]:
    """(group, _idx): groups in the seeded order, and their number."""
    numbered = materialize(ranks.hash_position(df.select(group).distinct(), [group], seed, "_idx"))
    return numbered, numbered.count()


def _added(rows: DataFrame) -> dict[int, np.ndarray]:
    """{key: vector}: the vectors of equal keys added up by Spark, position by position."""
    cells = rows.select("key", F.posexplode("v").alias("at", "v")).groupBy("key", "at").agg(F.sum("v").alias("v"))
    whole = cells.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("v"))
    return {r["key"]: np.array(r["v"]) for r in whole.collect()}


def weighted_sums(rows: DataFrame, width: int, key: str, values: Sequence[str]) -> dict[int, np.ndarray]:
    """Per key the sums of ``values`` under the counts ``_w`` of every replicate, as an array (values, ``width``). Only vectors leave
    the task that reads the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, counts = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            x = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(values))])
            order = np.argsort(keys, kind="stable")
            for low in range(0, len(order), SLICE):
                part = order[low:low + SLICE]
                w = _unpacked(counts[part], width)
                edges = np.append(np.flatnonzero(np.diff(keys[part], prepend=keys[part[0]] - 1)), len(part))
                for start, end in zip(edges[:-1], edges[1:]):
                    k, total = int(keys[part[start]]), (x[:, part[start:end]] @ w[start:end]).ravel()
                    made[k] = made[k] + total if k in made else total
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([v.tolist() for v in made.values()], pa.list_(pa.float64()))], names=["key", "v"])

    narrow = rows.select(F.col(key).cast("int").alias("key"), "_w", *values)
    return {k: v.reshape(len(values), -1) for k, v in _added(narrow.mapInArrow(run, "key int, v array<double>")).items()}


def _metric_parts(score: np.ndarray, pos: np.ndarray, neg: np.ndarray, pos_before: np.ndarray, neg_before: np.ndarray, pos_all: np.ndarray, neg_all: np.ndarray) -> np.ndarray:
    """What scores (rows) add to concordance, precision and squares in each replicate."""
    true, alarms = pos_all - pos_before, pos_all - pos_before + neg_all - neg_before
    value = score[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.stack([(pos * (neg_before + neg / 2)).sum(axis=0), np.where(pos > 0, pos * true / alarms, 0.0).sum(axis=0), (pos * (value - 1) ** 2 + neg * value ** 2).sum(axis=0)])


def replicated_ranking(hist: DataFrame, counts: DataFrame, width: int, edges: Sequence[float]) -> dict[int, dict[str, np.ndarray]]:
    """Per side roc_auc, pr_auc and brier of every replicate, as vectors; NaN where a replicate has one class only.

    ``hist`` has ``_cell`` (side and score range, stored), ``_idx``, ``score``, ``n_pos`` and ``n_neg``. The first scan adds up the
    ranges' positives and negatives per replicate, which is all there is to know of a range of one score. The second reads each
    other range in score order, starts from what the ranges below hold, and adds up the parts of the metrics. A range is
    read in slices, so its size does not matter."""
    cells = 2 * len(edges) + 4
    weighted = _with_counts(hist, counts)
    totals = weighted_sums(weighted, width, "_cell", ["n_pos", "n_neg"])
    sides = sorted({c // cells for c in totals})
    before: dict[int, np.ndarray] = {}
    whole: dict[int, np.ndarray] = {}
    for s in sides:
        run_sum = np.zeros((2, width))
        for cell in sorted(c for c in totals if c // cells == s):
            before[cell] = run_sum
            run_sum = run_sum + totals[cell]
        whole[s] = run_sum
    start = hist.sparkSession.sparkContext.broadcast(({c: v for c, v in before.items() if c % 2}, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        state: dict[int, np.ndarray] = {}

        for cell, score, at, n in _whole_runs(batches):
            s = cell // cells
            lower = state.setdefault(cell, start.value[0][cell])
            pos_all, neg_all = start.value[1][s]
            first = np.flatnonzero(np.diff(score, prepend=np.nan))
            run_of = np.repeat(np.arange(len(first)), np.diff(first, append=len(score)))
            here = np.zeros((2, len(first), width))
            for low in range(0, len(score), SLICE):
                part = slice(low, low + SLICE)
                edges_of = np.flatnonzero(np.diff(run_of[part], prepend=-1))
                w = _unpacked(at[part], width)
                for i in range(2):
                    here[i, run_of[part][edges_of]] += np.add.reduceat(w * n[i, part][:, None], edges_of)
            pos, neg = here
            parts = _metric_parts(score[first], pos, neg, lower[0] + np.cumsum(pos, axis=0) - pos, lower[1] + np.cumsum(neg, axis=0) - neg, pos_all, neg_all)
            state[cell] = lower + here.sum(axis=1)
            made[s] = made[s] + parts if s in made else parts
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([v.ravel().tolist() for v in made.values()], pa.list_(pa.float64()))], names=["key", "v"])

    rows = weighted.where(F.col("_cell") % 2 == 1).select(F.col("_cell").cast("int").alias("cell"), "score", "_w", "n_pos", "n_neg")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "score")
    added = {s: v.reshape(3, width) for s, v in _added(rows.mapInArrow(run, "key int, v array<double>")).items()}
    for cell in (c for c in totals if c % 2 == 0):
        s, value = cell // cells, [-np.inf, *edges][cell % cells // 2]
        alone = _metric_parts(np.array([value]), *[x[None] for x in (*totals[cell], *before[cell])], *whole[s])
        added[s] = added[s] + alone if s in added else alone
    out = {}
    for s, v in added.items():
        concordant, precision, squares = v
        pos, neg = whole[s]
        with np.errstate(divide="ignore", invalid="ignore"):
            both = (pos > 0) & (neg > 0)
            out[s] = {"roc_auc": np.where(both, concordant / (pos * neg), np.nan), "pr_auc": np.where(both, precision / pos, np.nan), "brier": squares / (pos + neg)}
    return out


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(cell, score, drawn counts, outcomes) of rows sorted by (cell, score): some ``SLICE`` rows of one cell at a time, cut where the score
    changes."""
    held: list[np.ndarray] | None = None
    for batch in chain(batches, [None]):
        if batch is not None:
            fresh = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            held = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh)]
        if held is None or not len(held[0]):
            continue
        cell, score = held[:2]
        ends = np.flatnonzero((np.diff(cell) != 0) | (np.diff(score) != 0)) + 1
        if batch is None:
            ends = np.append(ends, len(cell))
        low = 0
        for i, end in enumerate(ends.tolist()):
            if i + 1 == len(ends) or cell[end] != cell[low] or ends[i + 1] - low > SLICE:
                yield int(cell[low]), score[low:end], held[2][low:end], np.stack([held[3][low:end], held[4][low:end]]).astype(float)
                low = end
        held = [c[low:] for c in held]


def _interval(replicated: DataFrame, names: Sequence[str]) -> DataFrame:
    """Percentile interval and spread over replicates: a table with one row per replicate."""
    stats = [F.struct(
        F.lit(n).alias("metrica"),
        F.percentile(n, F.lit(0.025)).alias("ic_baixo"), F.percentile(n, F.lit(0.975)).alias("ic_alto"),
        F.stddev_samp(n).alias("desvio_bootstrap"), F.count(n).alias("n_reamostras")) for n in names]
    return replicated.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def _point(table: DataFrame, names: Sequence[str]) -> DataFrame:
    return table.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metrica"), F.col(n).cast("double").alias("pontual")) for n in names])).alias("p")).select("p.*")


def cluster_bootstrap(
    df: DataFrame, label: str, score: str, group: str, replicates: int = 1000, seed: int = SEED,
    additive: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Percentile intervals of AUC, AP, Brier and further row means, resampling whole groups.

    Rows are first reduced to the (group, score) histogram and to per-group sums. How often each group is drawn
    is sent to the tasks as numbers, so nothing is shuffled per replicate. ``additive`` names row-level Columns whose mean is wanted.
    """
    additive = dict(additive or {})
    spark = df.sparkSession
    hist = materialize(metrics.score_histogram(df, label, score, [group]))
    numbered, size = numbered_groups(hist, group, seed)
    names = ["roc_auc", "pr_auc", "brier", *additive]
    edges = ranks.fit_edges(hist, "score", min(MAX_RANGES, shuffle_width(spark)))
    placed = materialize(ranks.add_bucket(ranks._join(hist, numbered, [group]), "score", edges, "_cell"))
    sums = None
    if additive:
        grouped = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c.cast("double")).alias(a) for a, c in additive.items()])
        sums = materialize(ranks._join(grouped, numbered, [group]).na.fill(0.0, list(additive)))
    table = []
    for low, high in rounds([min(size, BLOCK)], replicates):
        counts = drawn_counts(spark, [size], low, high, seed)
        made = replicated_ranking(placed, counts, high - low, edges).get(0, {})
        if sums is not None and made:
            added = weighted_sums(_with_counts(sums.withColumn("_key", F.lit(0)), counts), high - low, "_key", ["_n", *additive])[0]
            made |= {a: v / added[0] for a, v in zip(additive, added[1:])}
        table += [(low + i, *map(float, v)) for i, v in enumerate(zip(*made.values())) if not np.isnan(v[0])]
    replicated = spark.createDataFrame(table, "rep int, " + ", ".join(f"`{n}` double" for n in names))
    flat = hist.groupBy("score").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    point = metrics.ranking_from_histogram(flat, (), edges).select(*names[:3])
    if sums is not None:
        whole = sums.agg(*[(F.sum(a) / F.sum("_n")).alias(a) for a in additive])
        point = point.select("*", *[whole.select(a).scalar().alias(a) for a in additive])
    return _point(point, names).join(_interval(replicated, names), "metrica")


def paired_auc_bootstrap(
    df: DataFrame, label: str, score_a: str, score_b: str, group: str, replicates: int = 1000, seed: int = SEED,
) -> DataFrame:
    """Interval of AUC(b) − AUC(a) on the same draws; p = share of replicates with no advantage."""
    sides = F.array(
        F.struct(F.lit("a").alias("side"), F.col(score_a).cast("double").alias("s")),
        F.struct(F.lit("b").alias("side"), F.col(score_b).cast("double").alias("s")))
    long = df.select(label, group, F.explode(sides).alias("p")).select(label, group, "p.side", "p.s")
    spark = df.sparkSession
    hist = materialize(metrics.score_histogram(long, label, "s", ["side", group]))
    numbered, size = numbered_groups(hist, group, seed)
    edges = ranks.fit_edges(hist, "score", min(MAX_RANGES, shuffle_width(spark)))
    cells = 2 * len(edges) + 4
    placed = ranks.add_bucket(ranks._join(hist, numbered, [group]), "score", edges, "_range")
    placed = materialize(placed.withColumn("_cell", F.when(F.col("side") == "b", cells).otherwise(0) + F.col("_range")))
    table = []
    for low, high in rounds([min(size, BLOCK)], replicates):
        counts = drawn_counts(spark, [size], low, high, seed)
        made = replicated_ranking(placed, counts, high - low, edges)
        if len(made) == 2:
            table += [(low + i, float(d)) for i, d in enumerate(made[1]["roc_auc"] - made[0]["roc_auc"]) if not np.isnan(d)]
    delta = spark.createDataFrame(table, "rep int, d double")
    whole = metrics.ranking_from_histogram(
        hist.groupBy("side", "score").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg")), ["side"], edges)
    point = whole.agg(
        F.max(F.when(F.col("side") == "a", F.col("roc_auc"))).alias("auc_base"),
        F.max(F.when(F.col("side") == "b", F.col("roc_auc"))).alias("auc_alternativo"))
    spread = delta.agg(F.struct(
        F.percentile("d", F.lit(0.025)).alias("ic95_baixo"), F.percentile("d", F.lit(0.975)).alias("ic95_alto"),
        F.avg(F.when(F.col("d") <= 0, 1.0).otherwise(0.0)).alias("p_bootstrap"),
        F.count(F.lit(1)).alias("n_reamostras")).alias("s"))
    return point.withColumn("s", spread.scalar()).select(
        "auc_base", "auc_alternativo", (F.col("auc_alternativo") - F.col("auc_base")).alias("delta"), "s.*")


def correlation_bootstrap(
    units: DataFrame, key: str, x: str, y: str, replicates: int = 1000, seed: int = SEED, by: Sequence[str] = (),
) -> DataFrame:
    """Pearson correlation over units with a percentile interval, from weighted moments.

    Units are resampled within each ``by`` group (few levels, such as size thresholds). Values are centred first to keep the moments stable.
    """
    known = units.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    known = materialize(known)
    centre = known.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    known = known.withColumns({
        "x": F.col("x") - centre.select("mx").scalar(), "y": F.col("y") - centre.select("my").scalar()})
    placed = materialize(ranks.hash_position(known, [key], seed, "_idx", by).withColumns({
        "xy": F.col("x") * F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "one": F.lit(1)}))
    levels = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).limit(MAX_LEVELS + 1).collect() if by else [placed.agg(F.count(F.lit(1)).alias("_n")).first()]
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} levels of {list(by)}")
    # The number of a row's level: levels are few, so a chain of comparisons.
    level = F.lit(0)
    for i, r in enumerate(levels):
        same = [F.col(c).eqNullSafe(F.lit(r[c])) for c in by]
        level = F.when(functools.reduce(lambda p, q: p & q, same), i).otherwise(level) if by else level
    rows = placed.withColumn("_level", level)
    names = ["one", "x", "y", "xy", "xx", "yy"]
    table = []
    sizes = [r["_n"] for r in levels]
    for low, high in rounds([min(max(sizes, default=0), BLOCK)], replicates):
        counts = drawn_counts(units.sparkSession, sizes, low, high, seed)
        for i, sums in weighted_sums(_with_counts(rows, counts, universe="_level"), high - low, "_level", names).items():
            table += [(*[levels[i][c] for c in by], low + j, *map(float, v)) for j, v in enumerate(sums.T)]
    fields = "".join(f"`{c}` {placed.schema[c].dataType.simpleString()}, " for c in by)
    moments = units.sparkSession.createDataFrame(table, fields + "rep int, n double, sx double, sy double, sxy double, sxx double, syy double")
    n = F.col("n")
    r = F.try_divide(
        n * F.col("sxy") - F.col("sx") * F.col("sy"),
        F.sqrt((n * F.col("sxx") - F.col("sx") ** 2) * (n * F.col("syy") - F.col("sy") ** 2)))
    interval = moments.select(*by, r.alias("r")).groupBy(*by).agg(
        F.percentile("r", F.lit(0.025)).alias("ic_low"), F.percentile("r", F.lit(0.975)).alias("ic_high"))
    point = placed.groupBy(*by).agg(pearson("x", "y").alias("corr_pearson"), F.count(F.lit(1)).alias("n_unidades"))
    if by:
        return point.join(interval, list(by))
    return point.withColumn("i", interval.select(F.struct("ic_low", "ic_high").alias("i")).scalar()).select(
        "corr_pearson", "n_unidades", "i.*")


def corrected_t(deltas: DataFrame, delta: str, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Corrected resampled t over fold differences: the variance is inflated by 1/n + 1/(k−1)."""
    d = F.col(delta)
    base = deltas.where(d.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).cast("int").alias("n_folds"), F.avg(d).alias("delta_medio"), F.stddev_samp(d).alias("delta_dp"),
        F.count_if(d > 0).alias("folds_a_favor"))
    error = F.sqrt(F.col("delta_dp") ** 2 * (F.lit(1.0) / F.col("n_folds") + 1.0 / (k - 1)))
    df = F.col("n_folds") - 1
    margin = t_quantile_975(df) * error
    tested = base.withColumns({
        "ic95_baixo": F.col("delta_medio") - margin, "ic95_alto": F.col("delta_medio") + margin,
        "t_nadeau_bengio": F.when(F.col("delta_dp") > 0, F.col("delta_medio") / error)})
    return tested.withColumn("p_valor", F.when(
        F.col("t_nadeau_bengio").isNotNull(), t_two_sided_p(F.col("t_nadeau_bengio"), df)))


def compare_in_folds(
    cv: DataFrame, base: str, alternative: str, metric: str = "roc_auc", k: int = 5, model: str = "modelo",
    fold: Sequence[str] = ("fold",),
) -> DataFrame:
    """Paired difference per fold between two models that ran on the same folds."""
    wide = cv.groupBy(*fold).pivot(model, [base, alternative]).agg(F.avg(metric))
    deltas = wide.select((F.col(f"`{alternative}`") - F.col(f"`{base}`")).alias("d"))
    return corrected_t(deltas, "d", k).select(
        F.lit(metric).alias("metrica"), F.lit(base).alias("base"), F.lit(alternative).alias("alternativo"), "*")


def summarize_folds(cv: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """Mean/sd/min/max of fold metrics per key; ``measures`` maps a metric to the wanted statistics."""
    functions = {"media": F.avg, "dp": F.stddev_samp, "minimo": F.min, "maximo": F.max}
    return cv.groupBy(*keys).agg(*[
        functions[s](m).alias(m if s == "media" else f"{m}_{s}") for m, stats in measures.items() for s in stats])


def permutation_p(table: DataFrame) -> DataFrame:
    """p = (1 + #{null ≥ real}) / (1 + n) for every null distribution in a (tipo, roc_auc) table."""
    real = table.where(F.col("tipo") == "real").agg(F.max("roc_auc").alias("r")).scalar()
    nulls = table.where(F.col("tipo") != "real").withColumn("real", real)
    return nulls.groupBy(F.col("tipo").alias("nulo")).agg(
        F.count(F.lit(1)).alias("n_permutacoes"), F.max("real").alias("roc_auc_real"),
        F.avg("roc_auc").alias("nulo_media"), F.stddev_samp("roc_auc").alias("nulo_dp"),
        F.max("roc_auc").alias("nulo_maximo"),
        ((1 + F.count_if(F.col("roc_auc") >= F.col("real"))) / (1 + F.count(F.lit(1)))).alias("p_valor"))


def permute(df: DataFrame, columns: Sequence[str], key: Sequence[str], seed: int = SEED, within: Sequence[str] = (),
            suffix: str = "") -> DataFrame:
    """Shuffle columns among rows (inside ``within`` groups); several columns move together.

    Rows are matched through two independent random orders, so a group of any size stays distributed.
    """
    kept = df.columns if suffix else [c for c in df.columns if c not in columns]
    target = ranks.hash_position(df.select(*kept), key, seed, "_at", within, salt=1)
    origin = ranks.hash_position(
        df.select(*dict.fromkeys([*within, *key, *columns])), key, seed, "_at", within, salt=2)
    origin = origin.select(*within, "_at", *[F.col(c).alias(f"{c}{suffix}") for c in columns])
    moved = ranks._join(target, origin, [*within, "_at"]).drop("_at")
    return moved if suffix else moved.select(*df.columns)
