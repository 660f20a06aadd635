"""SimHash near-duplicates with pivot distance tables.

A fingerprint bit is set if it is set in over half of the XXH64 values (seed 42) of the text's word shingles, repeats
included. Fingerprints that differ in at most ``bits`` bits are linked, and documents of one connected component form a group.

The search never compares all fingerprints. A fingerprint is cut into ``bits`` + 2 blocks: two fingerprints within
``bits`` agree in two blocks at least, so each pair of blocks is a table in which linked fingerprints meet. Inside such a
bucket the distances of every fingerprint to ``PIVOTS`` reference fingerprints are tabulated. By the triangle
inequality two linked fingerprints differ by at most ``bits`` in every coordinate: the bucket is sorted by the first
coordinate, only neighbours within ``bits`` are paired, the other coordinates discard pairs one after another, and
the survivors' Hamming distance is computed. No pair within ``bits`` is lost.

Equal texts share a fingerprint and count once. A bucket of more than ``BUCKET`` fingerprints is cut exactly: the bits
outside its two blocks form ``bits`` + 1 parts, of which linked fingerprints agree in one, so it is dealt by part
instead, and one that stays above ``WIDE_BUCKET`` by pairs of blocks. A bucket gives a spanning forest, not its pairs.

Defined cases: a NULL text has no words; texts without words share fingerprint zero, linked like any other; fewer words
than a shingle make one shingle; repeated rows and ids are grouped like copies; a NULL id never becomes a component's
name unless the component has no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import LOWER, stage, unused
from cohortspark.llm.graph import components

SEED = 42
PIVOTS = 32
BUCKET = 256


def shingle_hashes(text: bytes, size: int) -> list[int]:
    words = text.translate(LOWER).split()
    if not words:
        return []
    shingles = zip(*[words[i:] for i in range(size)]) if len(words) >= size else [words]
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(s), SEED) for s in shingles]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """Majority of each bit as a signed 64-bit number."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).reshape(-1, 64)
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).view(">i8")[0])


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, row: str | None = None) -> DataFrame:
    """(doc_id, fingerprint long), one row per document, without a shuffle; with ``row``, a number, also that as ``row``."""
    kept = ["doc_id", "row"] if row else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t.as_py(), shingle)) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=[*kept, "fingerprint"])

    rows = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), *([F.col(row).cast("long").alias("row")] if row else []),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*kept, "fingerprint"]))


def pivots(width: int = 1, count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints of ``width`` words: any will do, so they follow from the seed."""
    return np.array([[xxhash.xxh64_intdigest(f"pivot {i} {k}", SEED) for k in range(width)] for i in range(count)], dtype=np.uint64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def near_pairs(prints: np.ndarray, bits: int, references: np.ndarray, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of fingerprints (rows of 64-bit words) within ``bits``, by the pivot table; about ``step`` pairs are
    held at a time."""
    table = np.stack([hamming(prints, r) for r in references], axis=1)
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0]
    after = np.searchsorted(first, first + bits, side="right") - np.arange(len(order)) - 1
    ends = np.cumsum(after)
    low = 0
    while low < len(order):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + step, side="right")))
        counts = after[low:high]
        i = np.repeat(np.arange(low, high), counts)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
        i, j = order[i], order[j]
        for p in range(1, table.shape[1]):
            near = np.abs(table[i, p] - table[j, p]) <= bits
            i, j = i[near], j[near]
        near = hamming(prints[i], prints[j]) <= bits
        yield i[near], j[near]
        low = high


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels after linking the places ``i`` and ``j``: each label is the first place of its component."""
    i, j = label[i], label[j]
    while (apart := i != j).any():
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
        while (label[label] != label).any():
            label = label[label]
        i, j = label[i], label[j]
    return label


def forest(prints: np.ndarray, bits: int, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked fingerprints, and of the first one of their component inside the bucket. The pairs of a step are
    united as they come and not kept."""
    label = np.arange(len(prints))
    for i, j in near_pairs(prints, bits, references):
        label = merged(label, i, j)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return linked, label[linked]


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[np.ndarray]:
    """Fingerprints of one bucket after another, of rows sorted by their first ``by`` columns; a bucket may span batches."""
    rest: list[np.ndarray] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(by)])
        prints = np.stack([batch.column(c).to_numpy() for c in range(by, batch.num_columns)], axis=1).view(np.uint64)
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for part, at in zip(np.split(prints, cuts), [0, *cuts]):
            key = tuple(keys[:, at])
            if key != last and rest:
                yield np.concatenate(rest)
                rest = []
            rest.append(part)
            last = key
    if rest:
        yield np.concatenate(rest)


def _piece(low: int, high: int):
    """Bits low..high-1 of a fingerprint as a column."""
    return F.shiftrightunsigned("fingerprint", low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def _cuts(width: int, parts: int) -> list[int]:
    return [width * k // parts for k in range(parts + 1)]


def _blocks(rows: DataFrame, node: str, blocks, *by: str) -> DataFrame:
    """``rows`` with the columns x, y: a group of ``blocks`` blocks is dealt by pairs of blocks, so that any two of its rows
    meet and no task holds more than two blocks."""
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(node, F.lit(7)), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    return rows.drop("blocks", "own", "other").repartition(*by, "x", "y").sortWithinPartitions(*by, "x", "y")


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): a spanning forest of each bucket over the distinct fingerprints of ``prints``."""
    edges = _cuts(64, bits + 2)
    tables = list(combinations(range(bits + 2), 2))
    key = lambda i, j: F.shiftleft(_piece(edges[i], edges[i + 1]), edges[j + 1] - edges[j]).bitwiseOR(_piece(edges[j], edges[j + 1]))
    keyed = prints.select("fingerprint", F.explode(F.array(*[
        F.struct(F.lit(n).alias("table"), key(i, j).alias("key")) for n, (i, j) in enumerate(tables)])).alias("at")).select("at.*", "fingerprint")

    def met(rows: DataFrame, *by: str) -> DataFrame:
        """Rows whose bucket has two fingerprints at least, with the bucket's size."""
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return rows.join(sizes, list(by))

    def part_keys(n: int) -> list:
        """The parts of the bits outside the blocks of table ``n``."""
        free = [b for k in range(bits + 2) if k not in tables[n] for b in range(edges[k], edges[k + 1])]
        found = []
        for p, (low, high) in enumerate(zip(_cuts(len(free), bits + 1), _cuts(len(free), bits + 1)[1:])):
            mask = sum(1 << b for b in free[low:high])
            found.append(F.struct(F.lit(p).alias("part"), F.col("fingerprint").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("value")))
        return found

    whole = stage(met(keyed, "table", "key"))
    small = whole.where(F.col("n") <= BUCKET).select("table", "key", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("value"), "n", "fingerprint")
    parts = F.lit(None)
    for n in range(len(tables)):
        parts = F.when(F.col("table") == n, F.array(*part_keys(n))).otherwise(parts) if n else F.when(F.col("table") == n, F.array(*part_keys(n)))
    large = whole.where(F.col("n") > BUCKET).select("table", "key", "fingerprint", F.explode(parts).alias("p")).select("table", "key", "p.part", "p.value", "fingerprint")
    dealt = small.unionByName(met(large, "table", "key", "part", "value").select(small.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = pivots()
        for bucket in _runs(batches, 6):
            a, b = forest(bucket, bits, references)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[x, 0].view(np.int64)) for x in (a, b)], names=["a", "b"])

    by = ["table", "key", "part", "value"]
    dealt = _blocks(dealt, "fingerprint", F.ceil(F.col("n") / WIDE_BUCKET).cast("long"), *by).select(*by, "x", "y", "fingerprint")
    return dealt.mapInArrow(run, "a long, b long")


def groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (long), component_id, the smallest doc_id reachable by links."""
    known = stage(fingerprints(documents, doc_id, text, shingle))
    distinct = known.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct.select("fingerprint"), bits))
    classes = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    named = classes.join(classes.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    return known.join(named.select("fingerprint", "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_per_group(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """The rows of ``documents`` without all but one row of each group of :func:`groups`: that of the smallest id stays, one without
    an id only in a group of such. Texts without words are one group. ``documents`` must be a stored table: a row is known by
    its place in it."""
    row = unused(documents, "simhash_row")
    numbered = documents.withColumn(row, F.monotonically_increasing_id())
    known = stage(fingerprints(numbered, doc_id, text, shingle, row))
    first = known.groupBy("fingerprint").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    roots = components(links(first.select("fingerprint"), bits))
    classes = first.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    stays = classes.groupBy("root").agg(F.min("first")["row"].alias(row))
    return numbered.join(stays.select(row), row, "left_semi").select(*[F.col(f"`{c}`") for c in documents.columns])


# Near copies of a stated Jaccard similarity of their sets of shingles.
WIDTH = 8
#: From this many shingles on, majority bits may discard a pair; below, only what is proved does.
LARGE = 500
STAR = 160
ERRORS = 6
#: Fingerprints in a block of a bucket, and shingles in a block of a group to verify.
WIDE_BUCKET = 4_096
VERIFIED = 1 << 20
#: One text in ``SAMPLED`` is read to find the commonest shingles, at most ``COMMON`` of them.
SAMPLED, COMMON = 64, 1 << 16
#: Bits of the map by which texts that are in no group stay where they are; a clash only moves one more text.
MARKS = 1 << 26


def _mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Another independent-looking hash of each hash."""
    x = hashes + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size), dtype=np.uint64))


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """``WIDTH`` words in which a bit is set if an odd number of shingles falls on it. Two sketches differ in at most as many bits
    as there are shingles in one set only."""
    counts = np.bincount((_mixed(shingles, 3_000) >> np.uint64(64 - 9)).astype(np.int64), minlength=64 * WIDTH)
    return np.packbits((counts & 1).astype(np.uint8)).view(">u8").astype(np.uint64)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """``WIDTH`` words of majority bits; zero for a set below ``LARGE``, where nothing asks for them."""
    if len(shingles) < LARGE:
        return np.zeros(WIDTH, np.uint64)
    return np.array([fingerprint(_mixed(shingles, k + 1)) for k in range(WIDTH)], dtype=np.int64).view(np.uint64)


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 shingles in an order that all texts share, ``common`` ones last. Two sets of that
    similarity or more have a shingle of their prefixes in common."""
    if not len(shingles):
        return shingles
    order = np.lexsort((_mixed(shingles, 1_000), np.isin(shingles, common)))
    return shingles[order[:len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1]]


def bits_of(similarity: float, width: int = WIDTH) -> int:
    """Most bits in which fingerprints of ``width`` words differ at that Jaccard similarity or more: what is expected of equally
    large sets, and ``ERRORS`` standard errors."""
    angle = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(64 * width * angle + ERRORS * np.sqrt(64 * width * angle * (1 - angle)))


def _apart(total, similarity: float):
    """Most shingles in one set only, of two sets of that similarity with ``total`` shingles together."""
    return total * ((1 - similarity) / (1 + similarity)) + 1e-6


def possible(sizes: np.ndarray, sketches: np.ndarray, similarity: float) -> np.ndarray:
    """Component labels of one bucket, coarser than or equal to those by similarity. Sketches are the odd bits, then the majority
    bits. Only pairs of sizes that allow the similarity and of different components are looked at."""
    order = np.argsort(sizes, kind="stable")
    n, x = sizes[order], sketches[order]
    label, bits = np.arange(len(n)), bits_of(similarity)
    ends = np.searchsorted(n, n / similarity + 1e-6, side="right")
    for i in range(len(n)):
        j = np.arange(i + 1, ends[i])
        j = j[label[j] != label[i]]
        j = j[hamming(x[j, :WIDTH], x[i, :WIDTH]) <= _apart(n[j] + n[i], similarity)]
        j = j[(n[i] < LARGE) | (hamming(x[j, WIDTH:], x[i, WIDTH:]) <= bits)]
        if len(j):
            label = merged(label, np.full(len(j), i), j)
    found = np.empty_like(label)
    found[order] = order[label]
    return found


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Component labels by the Jaccard similarity of ``sets``, which is counted. Pairs of one component are not compared again."""
    sizes = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    if not sizes.all():
        empty = np.flatnonzero(sizes == 0)
        label[empty] = empty[0]
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    held = np.zeros(len(ids) + 1, dtype=np.int64)
    for i in np.flatnonzero(sizes):
        j = np.flatnonzero((label != label[i]) & (sizes >= similarity * sizes[i] - 1e-6) & (similarity * sizes <= sizes[i] + 1e-6) & (sizes > 0))
        j = j[j > i]
        if not len(j):
            continue
        mine = ids[starts[i]:starts[i] + sizes[i]]
        held[mine] = 1
        at = np.repeat(starts[j] - (np.cumsum(sizes[j]) - sizes[j]), sizes[j]) + np.arange(sizes[j].sum())
        both = np.add.reduceat(held[ids[at]], np.cumsum(sizes[j]) - sizes[j])
        held[mine] = 0
        j = j[both >= similarity * (sizes[i] + sizes[j] - both) - 1e-9]
        if len(j):
            label = merged(label, np.full(len(j), i), j)
    return label


def _common(texts: DataFrame, shingle: int) -> np.ndarray:
    """The commonest shingles of a sample, sorted: they only decide in which order shingles are looked up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle) for t in batch.column(0)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["gram"])

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "gram long")
    counted = sample.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "gram").limit(COMMON)
    return np.sort(np.array([r["gram"] for r in counted.collect()], dtype=np.int64).view(np.uint64))


def _marked(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, packed text) of at least the ``rows``, without a shuffle."""
    mark = F.pmod(F.xxhash64("row"), F.lit(MARKS))
    # Spark counts the bits of a map from one.
    found = rows.select((mark + 1).alias("mark")).groupBy(F.bitmap_bucket_number("mark").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("bits")).collect()
    width = 1 << 15
    bits = np.zeros((MARKS // width, width // 8), dtype=np.uint8)
    for r in found:
        bits[r["bucket"] - 1] = np.frombuffer(r["bits"], dtype=np.uint8)
    sent = texts.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy()
            kept = np.flatnonzero(sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            packed = [zlib.compress(batch.column(2)[int(k)].as_py(), 1) for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(packed, pa.binary())], names=["row", "text"])

    return texts.select("row", mark.alias("mark"), "text").mapInArrow(run, "row long, text binary")


def near_copies(documents: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, class_row): each row with the row that stands for its group, the one of the smallest doc_id.

    Two texts are linked if the Jaccard similarity of their sets of shingles is ``similarity`` or more. Equal sets count once.
    Sets of that similarity share a shingle of their prefixes. All sets with one prefix shingle are compared with the
    least of them; only if some are far from it, with each other. What is compared there are sketches, and they only
    discard: odd sketches by a proved bound, majority bits of large sets with ``ERRORS`` standard errors to spare.
    What is left falls into groups that no link leaves, and inside these the shingles themselves are counted.
    Groups and buckets of any size are dealt by pairs of blocks."""
    words = [f"w{k}" for k in range(2 * WIDTH)]
    rows = documents.select(F.col(row).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    common = _common(rows, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(2)]
            if sets:
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
                sketches = np.stack([np.concatenate([odd_sketch(s), wide_fingerprint(s)]) for s in sets]).view(np.int64)
                firsts = [prefix(s, similarity, common) for s in sets]
                offsets = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, sketches.T.copy()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts).view(np.int64)))],
                    names=["row", "doc_id", "node", "n", *words, "firsts"])

    known = stage(rows.mapInArrow(run, "row long, doc_id long, node long, n long, " + ", ".join(f"{c} long" for c in words) + ", firsts array<long>"))
    sketches = known.groupBy("node").agg(F.any_value("n").alias("n"), *[F.any_value(c).alias(c) for c in words])
    first = known.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))

    firsts = known.select(F.explode("firsts").alias("gram"), "node")
    shared = firsts.groupBy("gram").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").select("gram", "leader")
    met = stage(firsts.join(shared, "gram").where("node <> leader").select("gram", "node", "leader").distinct())
    touched = met.select("node").unionByName(met.select(F.col("leader").alias("node"))).distinct()
    sketches = stage(sketches.join(touched, "node", "left_semi"))

    # A bucket whose sets are all near its least one is one possible group. Twice the bound only makes groups larger; sketches of
    # large sets that have nothing in common differ in about half their bits, so ``STAR`` keeps those apart.
    led = sketches.select(F.col("node").alias("leader"), F.col("n").alias("leader_n"), *[F.col(w).alias(f"l{w}") for w in words[:WIDTH]])
    star = met.select("node", "leader").distinct().join(sketches, "node").join(led, "leader")
    differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"l{w}"))) for w in words[:WIDTH]), F.lit(0))
    star = stage(star.where(differ <= F.least(2 * _apart(F.col("n") + F.col("leader_n"), similarity), F.lit(float(STAR)))).select("node", "leader"))
    open_grams = met.join(star, ["node", "leader"], "left_anti").select("gram").distinct()
    opened = met.join(open_grams, "gram", "left_semi")
    opened = stage(opened.select("gram", "node").unionByName(opened.select("gram", F.col("leader").alias("node"))).distinct())
    bucket = opened.join(opened.groupBy("gram").agg(F.count(F.lit(1)).alias("size")), "gram")
    blocks = F.ceil(F.col("size") / WIDE_BUCKET).cast("long")
    bucket = _blocks(bucket.join(sketches, "node"), "node", blocks, "gram").select("gram", "x", "y", "node", "n", *words)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 3):
            node = rows[:, 0].view(np.int64)
            label = possible(rows[:, 1].view(np.int64), rows[:, 2:], similarity)
            far = np.flatnonzero(label != np.arange(len(label)))
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], names=["a", "b"])

    edges = bucket.mapInArrow(linked, "a long, b long").unionByName(star.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    maybe = components(edges).withColumnRenamed("root", "maybe")

    members = stage(maybe.join(first, "node").join(sketches.select("node", "n"), "node").select("maybe", "node", "n", F.col("first.row").alias("row")))
    sizes = members.groupBy("maybe").agg(F.sum("n").alias("total"))
    members = members.join(sizes, "maybe").join(_marked(rows, members.select("row")), "row")
    members = _blocks(members, "node", F.ceil(F.greatest(F.col("total"), F.lit(1)) / VERIFIED).cast("long"), "maybe").select("maybe", "x", "y", "node", "text")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*[batch.column(c).to_pylist() for c in range(5)]))
        for _, held in groupby(rows, key=lambda r: r[:3]):
            nodes, sets = zip(*[(r[3], shingle_set(zlib.decompress(r[4]), shingle)) for r in held])
            node, label = np.array(nodes, dtype=np.int64), alike(list(sets), similarity)
            far = np.flatnonzero(label != np.arange(len(label)))
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], names=["a", "b"])

    roots = components(members.mapInArrow(verified, "a long, b long"))
    named = first.join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    named = named.select("node", "first", F.coalesce("root", "node").alias("root"))
    stands = named.groupBy("root").agg(F.min("first")["row"].alias("class_row"))
    return known.select("row", "node").join(named.join(stands, "root").select("node", "class_row"), "node").select("row", "class_row")


def one_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``documents`` without all but one row of each group of near copies. ``documents`` must be a stored table: a
    row is known by its place in it."""
    row = unused(documents, "near_copy_row")
    numbered = documents.withColumn(row, F.monotonically_increasing_id())
    dropped = near_copies(numbered, row, doc_id, text, shingle, similarity).where("row <> class_row").select(F.col("row").alias(row))
    return numbered.join(dropped, row, "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])


def printed(groups: DataFrame) -> DataFrame:
    """The fingerprint as 16 lower-case hexadecimal digits."""
    return groups.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))
