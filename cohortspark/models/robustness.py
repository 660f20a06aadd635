"""Is the signal real, does it transfer, does the model ignore what it must ignore?"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.contracts import GROUP, SEED, TARGET
from cohortspark.models import candidates as M
from cohortspark.models import batched, split
from cohortspark.operators import metrics, ranks, resample, sampling
from cohortspark.operators.quality import QualityError
from cohortspark.session import materialize


def _mean_fold_auc(df: DataFrame, candidate: M.Candidate, k: int, seed: int) -> DataFrame:
    scored, _ = M.out_of_fold(df, candidate, k, seed)
    return metrics.auc(scored, TARGET, M.SCORE, ["fold"]).agg(F.avg("auc").alias("roc_auc"), F.stddev_samp("auc").alias("dp"))


#: Rows of a range of hashes, about, of which a cut is one.
CUT_ROWS = 10_000


def permuted_labels(df: DataFrame, n_global: int, n_within: int, seed: int = SEED, key: str = "row_id", group: str = GROUP, label: str = TARGET, out: str = "_labels") -> DataFrame:
    """Adds an array: the 0/1 label itself, ``n_global`` permutations of it and ``n_within`` permutations inside each group.

    A permutation of a 0/1 column only chooses which rows hold its ones: those of the smallest hashes of (key, draw), as many
    as there are ones. So a draw is one cut value (per group), and rows get all their labels by comparing hashes. A cut is an
    order statistic of evenly spread hashes: counts by their leading bits name the range that holds it, and only the hashes
    of that range are put in order. Groups of any size are cut finely enough for a range to hold a few thousand rows.
    """
    hashed = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), key), 11)

    def cuts(draws: Sequence[int], by: Sequence[str]) -> DataFrame:
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("draw"), hashed(i).alias("h")) for i in draws])).alias("c")
        bits = F.least(F.lit(20), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / CUT_ROWS)).cast("int")))
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_ones")).where(F.col("_ones") > 0).select(*by, "_ones", bits.alias("_bits"))
        whole_size = None if by else (sizes.first() or (0, 0))

        def long(cut_finer: bool) -> DataFrame:
            if by:
                rows = df.select(*by, key).join(sizes.where((F.col("_bits") > 0) == F.lit(cut_finer)), list(by))
            else:
                rows = df.select(key, *[F.lit(v).alias(n) for n, v in zip(("_ones", "_bits"), whole_size)]).where(F.lit(whole_size[0] > 0 and (whole_size[1] > 0) == cut_finer))
            return rows.select(*by, "_ones", "_bits", cells).select(*by, "_ones", "c.*", F.expr("shiftright(c.h, 53 - _bits)").alias("_range"))

        totals = long(True).groupBy(*by, "draw", "_range").agg(F.count(F.lit(1)).alias("_rows"), F.max("_ones").alias("_ones"))
        before = F.sum("_rows").over(Window.partitionBy(*by, "draw").orderBy("_range")) - F.col("_rows")
        held = totals.withColumn("_left", F.col("_ones") - before).where((F.col("_left") > 0) & (F.col("_left") <= F.col("_rows")))
        finer = long(True).join(held.select(*by, "draw", "_range", "_left"), [*by, "draw", "_range"])
        one = long(False).withColumn("_left", F.col("_ones"))
        placed = one.unionByName(finer).withColumn("_at", F.row_number().over(Window.partitionBy(*by, "draw").orderBy("h")))
        return placed.where(F.col("_at") == F.col("_left")).select(*by, "draw", F.col("h").alias("cut"))

    inside = range(n_global, n_global + n_within)
    whole = {r["draw"]: r["cut"] for r in cuts(range(n_global), []).collect()} if n_global else {}
    labels = [F.col(label) == 1, *[hashed(i) <= F.lit(whole.get(i)).cast("bigint") for i in range(n_global)]]
    rows = df
    if n_within:
        held = cuts(inside, [group]).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("draw", "cut"))).alias("_cuts"))
        rows = df.join(held, group, "left")  # a group without ones has no cuts
        labels += [hashed(i) <= F.col("_cuts")[i - n_global]["cut"] for i in inside]
    return rows.withColumn(out, F.array(*[F.coalesce(c, F.lit(False)).cast("tinyint") for c in labels])).drop("_cuts")


def _auc_of_checks(made: batched.Batch, checks: Sequence[tuple[int, int, bool]]) -> dict[int, float]:
    """AUC per check: a row per model to the driver."""
    return {r["check"]: r["auc"] for r in metrics.auc_of_pieces(batched.score_pieces(made.packed, made.fitted, checks)).collect()}


def permutation_test(df: DataFrame, candidate: M.Candidate, n_global: int = 50, n_within: int = 20, k: int = 3, seed: int = SEED) -> DataFrame:
    """Real AUC beside two null distributions: outcome shuffled among all rows, or inside each group.

    With a batch form all folds of all permutations are fitted in the same scans; a permutation is one more label of a row."""
    dealt = materialize(split.folds(df, k, seed))
    names = [("real", -1), *[("nulo_global", i) for i in range(n_global)], *[("nulo_dentro_do_municipio", i) for i in range(n_within)]]
    if candidate.batch:
        rows = permuted_labels(dealt, n_global, n_within, seed)
        made = candidate.batch(rows, batched.fold_sets(k), F.col("_labels"), n_labels=len(names))
        auc = _auc_of_checks(made, [(m, t, False) for m, (t, _) in enumerate(made.fitted.pairs)])
        means = [[auc[m] for m, (_, label) in enumerate(made.fitted.pairs) if label == l and auc.get(m) is not None] for l in range(len(names))]
        table = [(kind, i, sum(v) / len(v) if v else None) for (kind, i), v in zip(names, means)]
        return df.sparkSession.createDataFrame(table, "tipo string, permutacao int, roc_auc double")
    table = None
    for kind, i in names:
        rows = dealt if i < 0 else materialize(resample.permute(dealt, [TARGET], ["row_id"], seed + i, [] if kind == "nulo_global" else [GROUP]))
        part = materialize(_mean_fold_auc(rows, candidate, k, seed).select(F.lit(kind).alias("tipo"), F.lit(i).alias("permutacao"), "roc_auc"))
        table = part if table is None else table.unionByName(part)
    return table


def group_samples(df: DataFrame, wanted: Sequence[tuple[float, int]], group: str = GROUP) -> DataFrame:
    """Adds ``_in_<i>`` for each (fraction of the rows, seed): whole groups in the seed's order until the budget is reached. One
    ranking per seed, whatever the number of fractions."""
    sizes = materialize(df.groupBy(group).agg(F.count(F.lit(1)).alias("_size")))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    marks = sizes.select(group)
    for seed in dict.fromkeys(s for _, s in wanted):
        filled = ranks.cumulate(ranks.hash_position(sizes, [group], seed, "_pos"), "_pos", ["_size"])
        own = [(F.col("_size_before") < (total if f >= 1 else int(round(f * total)))).alias(f"_in_{i}") for i, (f, s) in enumerate(wanted) if s == seed]
        marks = marks.join(filled.select(group, *own), group)
    return df.join(marks, group)


def learning_curve(df: DataFrame, candidate: M.Candidate, fractions: Sequence[float] = (0.02, 0.05, 0.10, 0.25, 0.50, 0.75, 1.0),
                   seeds: Sequence[int] = (42, 7, 2024), seed: int = SEED) -> DataFrame:
    """Train and validation AUC against the number of training *groups*."""
    marked = materialize(split.holdout(df, 0.25, seed))
    train, check = marked.where(~F.col("teste")).drop("teste"), marked.where(F.col("teste")).drop("teste")
    wanted = [(f, s) for f in fractions for s in (seeds if f < 1 else seeds[:1])]
    if candidate.batch:
        rows = materialize(group_samples(train, wanted).withColumn("_check", F.lit(False)).unionByName(check.withColumn("_check", F.lit(True)), allowMissingColumns=True))
        sets = [F.col(f"_in_{i}") for i in range(len(wanted))]
        made = candidate.batch(rows, sets, more_sets=[F.col("_check")])
        auc = _auc_of_checks(made, [c for i in range(len(wanted)) for c in ((i, i, True), (i, len(wanted), True))])
        sizes = rows.agg(*[F.count_distinct(F.when(s, F.col(GROUP))).alias(f"g{i}") for i, s in enumerate(sets)], *[F.count_if(s).alias(f"n{i}") for i, s in enumerate(sets)]).first()
        table = [(f, s, sizes[f"g{i}"], sizes[f"n{i}"], auc.get(2 * i), auc.get(2 * i + 1)) for i, (f, s) in enumerate(wanted)]
        return df.sparkSession.createDataFrame(
            table, "fracao double, seed_amostra int, n_municipios_treino long, n_alunos_treino long, roc_auc_treino double, roc_auc_validacao double")
    size = train.count()
    table = None
    for fraction, s in wanted:
        rows = train if fraction >= 1 else materialize(sampling.sample_groups(train, GROUP, int(round(fraction * size)), s))
        scorer = candidate.fit(rows, seed)
        both = scorer.score(rows.withColumn("_side", F.lit("t")).unionByName(check.withColumn("_side", F.lit("v"))))
        aucs = metrics.auc(both, TARGET, M.SCORE, ["_side"])
        sizes = rows.agg(F.count_distinct(GROUP).alias("n_municipios_treino"), F.count(F.lit(1)).alias("n_alunos_treino"))
        part = sizes.select(
            F.lit(fraction).alias("fracao"), F.lit(s).alias("seed_amostra"), "*",
            aucs.where("_side = 't'").select("auc").scalar().alias("roc_auc_treino"),
            aucs.where("_side = 'v'").select("auc").scalar().alias("roc_auc_validacao"))
        part = materialize(part)
        table = part if table is None else table.unionByName(part)
    return table


def leave_one_region_out(df: DataFrame, candidate: M.Candidate, regions: Sequence[str] | None = None, region: str = "nome_regiao", seed: int = SEED) -> DataFrame:
    """Train on all regions but one, test on that one, once per region. Rows without a region always train and are never tested."""
    if regions is None:
        found = df.select(region).where(F.col(region).isNotNull()).distinct().limit(batched.MAX_SETS + 1).collect()
        if len(found) > batched.MAX_SETS:
            raise QualityError(f"more than {batched.MAX_SETS} values of {region}")
        regions = sorted(r[0] for r in found)
    outside = [~F.col(region).eqNullSafe(F.lit(name)) for name in regions]
    if candidate.batch:
        made = candidate.batch(df, outside)
        which = F.array_position(F.array(*[F.lit(n) for n in regions]), F.col(region)).cast("int") - 1
        parts = df.where(F.col(region).isin(*regions)).select(
            F.col(region).alias("regiao_de_teste"), TARGET, batched.probability(made.base, made.fitted.gamma(), which).alias(M.SCORE))
    else:
        parts = None
        for name, rest in zip(regions, outside):
            part = candidate.fit(df.where(rest), seed).score(df.where(~rest)).select(F.col(region).alias("regiao_de_teste"), TARGET, M.SCORE)
            parts = part if parts is None else parts.unionByName(part)
        parts = materialize(parts)
    table = metrics.ranking_metrics(parts, TARGET, M.SCORE, ["regiao_de_teste"])
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return table.select("regiao_de_teste", (total - F.col("n")).alias("n_treino"), F.col("n").alias("n_teste"),
                        F.col("prevalencia").alias("prevalencia_teste"), "roc_auc")


def drift(lag: DataFrame, current: DataFrame, make, names: tuple[str, str], k: int = 3, seed: int = SEED) -> DataFrame:
    """Grouped validation inside each year against training on the first and testing on the second.

    ``make()`` builds a candidate over the columns both cohorts share.
    """
    table = None
    for name, rows in zip(names, (lag, current)):
        dealt = materialize(split.folds(rows, k, seed))
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(TARGET).alias("p"))
        part = _mean_fold_auc(dealt, make(), k, seed).select(
            F.lit(f"{name} -> {name} (CV agrupada)").alias("desenho"), size.select("n").scalar().alias("n_treino"), size.select("n").scalar().alias("n_teste"),
            size.select("p").scalar().alias("prevalencia_teste"), "roc_auc", F.col("dp").alias("dp_entre_folds"))
        part = materialize(part)
        table = part if table is None else table.unionByName(part)
    scored = M.scorer_of(make(), lag, seed).score(current)
    measured = metrics.ranking_metrics(scored, TARGET, M.SCORE)
    across = measured.select(
        F.lit(f"{names[0]} -> {names[1]} (out-of-time)").alias("desenho"), lag.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_treino"),
        F.col("n").alias("n_teste"), F.col("prevalencia").alias("prevalencia_teste"), "roc_auc", F.lit(None).cast("double").alias("dp_entre_folds"))
    return table.unionByName(across)


def shuffled_drop(scorer: M.Scorer, df: DataFrame, blocks: dict[str, Sequence[str]], repeats: int, seed: int = SEED, within: Sequence[str] = ()) -> DataFrame:
    """AUC drop when a block of raw columns is shuffled together (one row order per block and repeat)."""
    needed = df.select(*dict.fromkeys(["row_id", TARGET, *within, *_inputs(scorer, df)]))
    needed = materialize(needed)
    parts = scorer.score(needed).select(F.lit("").alias("bloco"), F.lit(0).alias("rep"), TARGET, M.SCORE)
    for number, (name, columns) in enumerate(blocks.items()):
        for r in range(repeats):
            moved = resample.permute(needed, list(columns), ["row_id"], seed + 1000 * number + r, within)
            parts = parts.unionByName(scorer.score(moved).select(F.lit(name).alias("bloco"), F.lit(r).alias("rep"), TARGET, M.SCORE))
    return _drop_table(metrics.auc(parts, TARGET, M.SCORE, ["bloco", "rep"]), blocks)


def _drop_table(aucs: DataFrame, blocks: dict[str, Sequence[str]]) -> DataFrame:
    """Mean and deviation of the drops over the repeats, from the AUC of each (bloco, rep); block '' is the reference."""
    aucs = materialize(aucs)
    reference = aucs.where("bloco = ''").select("auc").scalar()
    drops = aucs.where("bloco <> ''").withColumn("ref", reference)
    sizes = F.create_map(*[v for n, c in blocks.items() for v in (F.lit(n), F.lit(len(c)))])
    # Areas are sums of doubles in no fixed order; what is left of equal ones is no drop.
    lost = F.round(F.col("ref") - F.col("auc"), 12)
    return drops.groupBy("bloco").agg(
        F.max("ref").alias("roc_auc_referencia"), F.avg(lost).alias("queda_media"), F.stddev_samp(lost).alias("queda_dp"), F.count(F.lit(1)).cast("int").alias("n_repeticoes"),
    ).withColumn("n_features", sizes[F.col("bloco")])


def feature_parts(base: batched.Base, gamma: Sequence[float]) -> list[Column]:
    """What each feature of ``base`` adds to the margin of a row."""
    parts = []
    for f in base.features:
        at = list(base.numeric[f][:2]) if f in base.numeric else list(base.levels[f].values())
        parts.append(sum((base.entries[i] * float(gamma[1 + i]) for i in at), F.lit(0.0)))
    return parts


#: Rows whose scores a task holds before it packs them.
HELD_ROWS = 100_000


def linear_drops(
    made: batched.Batch, df: DataFrame, blocks: dict[str, Sequence[str]], repeats: int, seed: int = SEED, within: Sequence[str] = (), model: int = 0,
) -> DataFrame:
    """``shuffled_drop`` of a linear model, all blocks and repeats in one plan.

    A feature adds its own part to the margin, so shuffling a block swaps its parts for those of another row. A repeat deals
    every row one partner (a fixed order of the rows against one order per repeat), which all blocks share; scores are sums of
    parts in one order, so rows with equal features still tie. A block without a feature of the model drops by zero.
    """
    features = list(made.base.features)
    parts = F.array(*feature_parts(made.base, made.fitted.gamma()[:, model]))
    own = materialize(df.select("row_id", TARGET, *within, parts.alias("_p")))
    repeat = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep")
    target = ranks.hash_position(own, ["row_id"], seed, "_at", within, salt=1)
    origin = ranks.hash_position(own.select("row_id", *within, "_p", repeat), ["rep", "row_id"], seed, "_at", ["rep", *within], salt=2)
    pairs = ranks._join(target, origin.select("rep", *within, "_at", F.col("_p").alias("_q")), [*within, "_at"])
    plain = own.select(F.lit(-1).alias("rep"), TARGET, "_p", F.col("_p").alias("_q"))
    rows = plain.unionByName(pairs.select("rep", TARGET, "_p", "_q")).where(F.col(TARGET).isin(0, 1))
    ranges = metrics.ranges_for(own.count())
    edges = np.array(ranks.fit_edges(own, sum((F.col("_p")[i] for i in range(len(features))), F.lit(0.0)), ranges) if ranges > 1 else [])
    moved = [[f in set(columns) for f in features] for columns in blocks.values()]
    reference = repeats * len(blocks)

    def scored(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        rep, label, *scores = (np.concatenate(v) for v in zip(*held))
        for r in np.unique(rep).tolist():
            at = np.flatnonzero(rep == r)
            checks = [(reference, scores[0])] if r < 0 else [(r * len(moved) + i, v) for i, v in enumerate(scores[1:])]
            yield from metrics.pieces_of((check, v[at], label[at], edges) for check, v in checks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, label, p, q = (batch.column(i) for i in range(4))
            p, q = (c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).T for c in (p, q))
            margins = []
            for swapped in [[False] * len(features), *moved]:
                margin = np.zeros(batch.num_rows)
                for i, from_other in enumerate(swapped):  # in one order, so that equal features give equal sums
                    margin = margin + (q[i] if from_other else p[i])
                margins.append(margin)
            held.append((rep.to_numpy(), label.to_numpy(zero_copy_only=False), *margins))
            size += batch.num_rows
            if size >= HELD_ROWS:
                yield from scored(held)
                held, size = [], 0
        if held:
            yield from scored(held)

    aucs = metrics.auc_of_pieces(rows.mapInArrow(run, metrics.PIECE))
    names = F.array(*[F.lit(n) for n in blocks])
    return _drop_table(aucs.select(
        F.when(F.col("check") == reference, "").otherwise(names[F.pmod("check", F.lit(len(blocks)))]).alias("bloco"),
        F.floor(F.col("check") / len(blocks)).cast("int").alias("rep"), "auc"), blocks)


def _inputs(scorer: M.Scorer, df: DataFrame) -> list[str]:
    if isinstance(scorer, M.LinearOrTreeScorer):
        return list(dict.fromkeys(c.feature for c in scorer.preprocessor.columns))
    return [c for c in df.columns if c not in ("row_id", TARGET)]


def invariance(scorer: M.Scorer | batched.Batch, df: DataFrame, columns: Sequence[str], repeats: int = 5, seed: int = SEED) -> DataFrame:
    """Negative and positive controls: how far does the AUC move when one column is shuffled?"""
    drops = linear_drops if isinstance(scorer, batched.Batch) else shuffled_drop
    return drops(scorer, df, {c: [c] for c in columns}, repeats, seed).withColumnRenamed("bloco", "coluna").drop("n_features")


