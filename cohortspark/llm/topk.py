"""Exact top-k inner products by dual cover-tree search.

Vectors are turned into whole numbers, floor(scale * x). The upper levels of a cover tree are built from at most
``SAMPLE`` vectors (those of the smallest md5 of the id) and only lay out the data; every row is routed down to the deepest
node whose ball holds it, and the largest distance found is that node's covering radius. A node's rows are cut into
blocks by a hash, so one crowded node is many blocks; queries are cut the same way.

Two rounds compare blocks. The first compares each query block with one data block of its own node, which gives every
query a k-th score to beat. In the second a pair of a query block and a data node is dropped if

    <q, d> + r_q |d| + r_d |q| + r_q r_d,

the largest product that two points of the balls around q and d can have, is below the worst k-th score of the query
block. Inside a pair of blocks both sides get a cover tree of their own, and node pairs are pruned by the same bound against
the worst k-th score of the query node as it rises; leaves are compared by one matrix product. The best k of each block
pair meet in one ranking per query. Bounds only ever drop pairs that cannot matter, so results are exact.

Defined cases: vectors that are NULL or empty or hold NULL or non-finite components, rows without id and vectors of another
length than the most frequent one (the longer of two) take no part, nor do vectors with a component of 2**62 or more in size
after scaling. Scores are exact whole numbers; one that leaves 64 bits counts as the largest (or, negated, smallest) long. All rows
with the query's id count as its own; a repeated row counts once per occurrence as a candidate and once as a query; ties go
to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import stage

SAMPLE = 4_096
LEAF = 64
MISSES = 32
#: Rows of a block, and the least number of blocks that a smaller table is cut into.
BLOCK = 4_096
LEAST_BLOCKS = 24
LIMIT = 1 << 62
LONG = (1 << 63) - 1
#: Stands for "no score yet"; real scores are above.
NONE = -LONG - 1
RESULT = "query_id long, vec_id long, score long"


@dataclass
class Node:
    """A ball that holds all ``rows``; a leaf has no children, the children of others share out its rows."""

    center: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)

    @property
    def norm(self) -> float:
        return float(np.sqrt(self.center @ self.center))


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Each level halves the radius: rows within half of a chosen point form a child; points that cover few rows
    at that scale stay together in one child. Shape affects speed only."""
    rows = np.arange(len(points)) if rows is None else rows
    center = points[rows[0]]
    far = np.sqrt(((points[rows] - center) ** 2).sum(axis=1))
    node = Node(center, float(far.max()), rows)
    if len(rows) <= leaf or node.radius == 0:
        return node
    left, sparse, misses = rows, [], 0
    while len(left) and misses < MISSES:
        near = ((points[left] - points[left[0]]) ** 2).sum(axis=1) <= (node.radius / 2) ** 2
        if near.sum() >= leaf // 4:
            node.children.append(cover_tree(points, left[near], leaf))
            misses = 0
        else:
            sparse.append(left[near])
            misses += 1
        left = left[~near]
    rest = np.concatenate([*sparse, left]) if sparse or len(left) else left
    if len(rest) and node.children:
        far = np.sqrt(((points[rest] - center) ** 2).sum(axis=1))
        node.children.append(Node(center, float(far.max()), rest))
    return node


def largest(q: Node, d: Node) -> float:
    """Upper bound of the products of two balls, with room for rounding in proportion to the largest terms."""
    bound = float(q.center @ d.center) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius
    return bound + 1e-9 * (q.norm + q.radius) * (d.norm + d.radius) + 1e-3


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows. Every partial sum is within |a||b|, which says what arithmetic is exact."""
    fa, fb = a.astype(float), b.astype(float)
    most = float(np.sqrt((fa * fa).sum(axis=1).max() * (fb * fb).sum(axis=1).max()))
    if most < 1 << 52:
        return (fa @ fb.T).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -LONG, LONG).astype(np.int64)


class Search:
    """Best k candidates of each query; ``floor`` is a score that a query's k-th is known to reach, or NONE."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, floor: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        self.data, self.ids, self.queries, self.query_ids, self.k = data[order], ids[order], queries, query_ids, k
        self.floor = floor
        self.scores = np.full((len(queries), k), NONE)
        self.at = np.full((len(queries), k), len(ids))

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.visit(cover_tree(self.queries.astype(float)), cover_tree(self.data.astype(float)))
        kept = (self.scores != NONE) & (self.scores >= self.floor[:, None])
        q, _ = np.nonzero(kept)
        return self.query_ids[q], self.ids[self.at[kept]], self.scores[kept]

    def visit(self, q: Node, d: Node) -> None:
        worst = np.maximum(self.scores[q.rows, -1], self.floor[q.rows]).min()
        if largest(q, d) < worst:
            return
        if not q.children and not d.children:
            self.compare(q.rows, d.rows)
        for a in q.children or [q]:
            for b in sorted(d.children, key=lambda b: -largest(a, b)) if d.children else [d]:
                if a is not q or b is not d:
                    self.visit(a, b)

    def compare(self, q: np.ndarray, d: np.ndarray) -> None:
        """Merge the products of two leaves; ``d`` counts in the order of ids, so a smaller place wins a tie."""
        d = np.sort(d)
        scores = products(self.queries[q], self.data[d])
        scores[self.query_ids[q][:, None] == self.ids[d][None, :]] = NONE
        scores[scores < self.floor[q][:, None]] = NONE
        if len(d) > self.k:
            # All that reach the k-th largest product: at least k, more only if they tie with it.
            reach = np.partition(scores, len(d) - self.k, axis=1)[:, len(d) - self.k]
            able = scores >= reach[:, None]
        else:
            able = scores != NONE
        for row in range(len(q)):
            took = np.flatnonzero(able[row])
            i = q[row]
            both, places = np.concatenate([self.scores[i], scores[row, took]]), np.concatenate([self.at[i], d[took]])
            # ~ turns the order around without leaving 64 bits.
            best = np.lexsort((places, ~both))[:self.k]
            self.scores[i], self.at[i] = both[best], places[best]


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float(LIMIT)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & sound)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _nodes(tree: Node) -> list[Node]:
    """The node and all below it, parents first."""
    return [tree, *[n for c in tree.children for n in _nodes(c)]]


def _route(points: np.ndarray, nodes: list[Node], child_of: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The deepest node whose ball holds each point, and the distance from its centre; the root takes all."""
    at = np.zeros(len(points), dtype=np.int32)
    far = np.sqrt(((points - nodes[0].center) ** 2).sum(axis=1))
    todo = [(0, np.arange(len(points)))]
    while todo:
        number, held = todo.pop()
        for c in child_of[number]:
            if not len(held):
                break
            d = np.sqrt(((points[held] - nodes[c].center) ** 2).sum(axis=1))
            into = d <= nodes[c].radius
            at[held[into]], far[held[into]] = c, d[into]
            todo.append((c, held[into]))
            held = held[~into]
    return at, far


def _blocks(routed: DataFrame, size: int) -> tuple[dict[int, tuple[float, int, int]], Callable[[Column], Column]]:
    """Per node: covering radius, first block, number of blocks; and the block of a row. One row per node is collected."""
    stats = routed.groupBy("node").agg(F.max("far").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    found, first = {}, 0
    for s in sorted(stats, key=lambda s: s["node"]):
        found[s["node"]] = (s["r"], first, -(-s["n"] // size))
        first += found[s["node"]][2]
    pick = lambda k: F.element_at(F.create_map(*[F.lit(x) for n, v in found.items() for x in (n, v[k])]), F.col("node"))
    return found, lambda key: pick(1) + F.pmod(F.xxhash64(key), pick(2)).cast("int")


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the ``k`` largest integer products of each query with all other rows."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sound = whole_numbers(vectors, vec_id, vector, scale)
    widest = F.max(F.array_max(F.transform("v", F.abs))).alias("widest")
    lengths = sound.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), widest).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return empty
    dim, rows = lengths[0]["dim"], lengths[0]["n"]
    kind = "int" if lengths[0]["widest"] < 1 << 31 else "bigint"
    sound = sound.where(F.size("v") == dim).withColumn("v", F.col("v").cast(f"array<{kind}>"))
    sample = sound.orderBy(F.md5(F.col("vec_id").cast("string").cast("binary")), "vec_id").limit(SAMPLE).collect()
    nodes = _nodes(cover_tree(np.array([r["v"] for r in sample], dtype=float)))
    for n in nodes:
        n.rows = n.rows[:0]
    numbers = {id(n): i for i, n in enumerate(nodes)}
    child_of = {i: [numbers[id(c)] for c in n.children] for i, n in enumerate(nodes)}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, far = _route(_matrix(batch.column(1), dim).astype(float), nodes, child_of)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array(far, pa.float64())], names=["vec_id", "v", "node", "far"])

    routed = stage(sound.mapInArrow(route, f"vec_id long, v array<{kind}>, node int, far double"))
    size = min(BLOCK, max(-(-rows // LEAST_BLOCKS), LEAF))
    d_stats, d_block = _blocks(routed, size)
    queries = routed.where(is_query).dropDuplicates(["vec_id"])
    q_stats, q_block = _blocks(queries, size)
    if not q_stats:
        return empty
    data = routed.select("vec_id", "v", d_block(F.col("vec_id")).alias("d"))
    asked = queries.select("vec_id", "v", "node", q_block(F.col("vec_id")).alias("q"))

    def compared(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """Best candidates of each query in each pair (q, d) of blocks."""
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
            found = Search(_matrix(left.column("v"), dim), left.column("vec_id").to_numpy(), _matrix(right.column("v"), dim),
                           right.column("vec_id").to_numpy(), left.column("floor").to_numpy(), k).run()
            return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found))))

        fresh = lambda df, *names: df.select(*[F.col(c).alias(c) for c in names])
        left = fresh(asked.join(pairs, "q"), "q", "d", "vec_id", "v", "floor")
        right = fresh(data.join(fresh(pairs, "q", "d"), "d"), "q", "d", "vec_id", "v")
        return left.groupBy("q", "d").cogroup(right.groupBy("q", "d")).applyInArrow(run, RESULT)

    # Round one: a data block of the query's own node (of the root's, where the node has none).
    blocks = asked.select("q", "node").distinct()
    least = min(v[1] for v in d_stats.values())
    own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n, v in d_stats.items() for x in (n, v[1])]), F.col("node")), F.lit(least))
    none = asked.withColumn("floor", F.lit(NONE))
    first = compared(blocks.select("q", own.alias("d")), none)
    reached = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    known = stage(asked.join(reached.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left").fillna(NONE, ["floor"]))

    def surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Data blocks that a query block cannot rule out."""
        for batch in batches:
            q, d = [], []
            for block, node, worst in zip(*[c.to_pylist() for c in batch.columns]):
                ball = Node(nodes[node].center, q_stats[node][0], nodes[node].rows)
                for other, (radius, start, count) in d_stats.items():
                    if largest(ball, Node(nodes[other].center, radius, ball.rows)) >= worst:
                        q += [block] * count
                        d += range(start, start + count)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.int32())], names=["q", "d"])

    pairs = stage(known.groupBy("q", "node").agg(F.min("floor").alias("worst")).mapInArrow(surviving, "q int, d int"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return compared(pairs, known).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.x, d.x) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
