"""Language-model scores by a hierarchical Pitman-Yor model: bigram restaurants over a unigram one over the uniform base.

Tokens are words between ASCII white space, A-Z lowered, and one end per text. The context of a token is the word before it, or the
start of the text. Every context has a restaurant; all share the root restaurant as parent, whose base is uniform over the
known words and one unknown:

    p(w | u) = (c - d1 t) / (s1 + C_u) + (s1 + d1 T_u) / (s1 + C_u) p0(w)
    p0(w)    = (c0 - d0 t0) / (s0 + C0) + (s0 + d0 T0) / (s0 + C0) / (V + 1)

with c customers and t tables of word w in restaurant u, and a table there being a customer c0 of the root. Seats are sampled by
blocked Gibbs sweeps of the Chinese restaurant process: in each round all customers of every (context, word) leave and sit down
again one by one, at an old table with weight c - d t or at a new one with weight (s + d T) p0(w), p0 without their own
tables; then all customers of the root do, those tables. So every customer moves in every round, however many there are.
All pairs move at once, given the restaurants' totals; the order of arrival is not corrected for. Since given the totals the
predictive probability is linear in the counts and tables, the average over samples is the formula above with averaged tables.

A pair met once has one table, so only the pairs met more often are seated; of the others a word keeps their number. With own =
(c - d1 t) / (s1 + d1 T_u) and b = (s1 + d1 T_u) / (s1 + C_u), log p(w | u) = log b(u) + log(own(w, u) + p0(w)): what depends on the
context alone is added where that context is known as a word, as every word is the context of the token behind it.

Spark's part: words are counted first; the ``HEAD_WORDS`` most frequent get small numbers, all others are known by 62 bits of their
XXH64 value. Each task counts its (word, context) pairs and sends them, packed, to the bucket of the word; a bucket is one packed row
that has all pairs of its words. The tables of every context are summed over the cluster: one for each pair, and after a first pass
and the sampling pass what was opened beyond that. Those of the head are sent to all tasks, those of other contexts are a table, joined
with the contexts that a bucket asks for. Tokens whose pair is among the ``HEAD_PAIRS`` most frequent are scored where the text is read,
all others in the bucket of their word, which the packed model reaches in the same shuffle. What is gathered grows with the corpus, and
what is broadcast does not.

Defined cases: a NULL or empty text is one end; a NULL id belongs to the fold of the empty text; repeated rows are trained
on and scored one by one; without training rows every token is the unknown one with probability 1; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import crc_fold, stage

STRENGTH = 1.0
FIRST_ROUNDS, BURN_IN, SAMPLES = 6, 8, 8
#: Customers of a pair that are seated one at a time.
SINGLY = 32
HEAD_WORDS, HEAD_PAIRS = 1 << 18, 1 << 20
#: Bytes after which a chunk of texts ends, about a million tokens, and rows of tables packed at once.
CHUNK_BYTES, CHUNK_ROWS = 6 << 20, 1 << 18
#: Words are dealt by hash into at least that many classes, the buckets.
CLASSES = 32
#: Blanks are in no word, so their values stand for the start and the end; as a context the start is known by the end's hash.
START, END = b"\t", b" "
NUMBERS = 1 << 32


def hashed(words) -> np.ndarray:
    """62 bits of each word's hash, above all numbers of head words."""
    found = np.fromiter((xxhash.xxh64_intdigest(END if w == START else w) for w in words), dtype=np.uint64, count=len(words))
    return (found >> np.uint64(2) | np.uint64(1 << 62)).view(np.int64)


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Chunks of texts, which are the first column: (the other columns of each text; local numbers of its tokens, a start (0)
    before and an end (1) after each text; hashes of the local numbers)."""
    held, size = [], 0
    for batch in batches:
        ends, start, before = np.cumsum(pc.binary_length(batch.column(0)).to_numpy().astype(np.int64) + 1), 0, 0
        while start < batch.num_rows:
            stop = min(int(np.searchsorted(ends, before + CHUNK_BYTES - size)) + 1, batch.num_rows)
            held.append(batch.slice(start, stop - start))
            size, before, start = size + int(ends[stop - 1]) - before, int(ends[stop - 1]), stop
            if size >= CHUNK_BYTES:
                yield tokenized(pa.Table.from_batches(held).combine_chunks())
                held, size = [], 0
    if held:
        yield tokenized(pa.Table.from_batches(held).combine_chunks())


def tokenized(chunk: pa.Table) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    others = zip(*(c.to_pylist() for c in chunk.columns[1:])) if chunk.num_columns > 1 else ((),) * chunk.num_rows
    split = pc.ascii_split_whitespace(pc.ascii_lower(chunk.column(0).chunk(0).view(pa.string())))
    words = split.flatten().dictionary_encode()
    code, names = words.indices.to_numpy(), words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(split)), split.value_lengths().to_numpy())
    blank = np.flatnonzero(names == b"")
    if len(blank):
        # Between white space and an end of its text is an empty word.
        kept = code != blank[0]
        code, text, names = code[kept], text[kept], np.delete(names, blank)
        code = code - (code > blank[0])
    ends = np.cumsum(np.bincount(text, minlength=len(split)) + 2) - 1
    tokens, body = np.zeros(int(ends[-1]) + 1, dtype=np.int32), np.ones(int(ends[-1]) + 1, dtype=bool)
    tokens[ends], body[ends], body[0], body[ends[:-1] + 1] = 1, False, False, False
    tokens[body] = code + 2
    return list(others), tokens, hashed([START, END, *names])


def numbered(hashes: np.ndarray, ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The number of each head word, the hash of all others. ``ids`` are the head's hashes by number, ``order`` sorts them."""
    if not len(ids):
        return hashes
    at = order[np.minimum(np.searchsorted(ids, hashes, sorter=order), len(ids) - 1)]
    return np.where(ids[at] == hashes, at, hashes)


def frozen(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes: the high bytes of small numbers cost nothing."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return np.array([len(planes), *map(len, arrays)], dtype=np.int64).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def thawed(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data, dtype=np.int64, count=1 + len(kinds))
    planes = np.frombuffer(pa.decompress(data[sizes.nbytes:], decompressed_size=int(sizes[0]), codec="zstd", asbytes=True), dtype=np.uint8)
    made, at = [], 0
    for n, kind in zip(sizes[1:].tolist(), map(np.dtype, kinds)):
        made.append(np.ascontiguousarray(planes[at:at + n * kind.itemsize].reshape(kind.itemsize, n).T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return made


def coded(u: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Each context as its number or, outside the head, as ``head`` and its place among the contexts returned beside."""
    out = u >= head
    far, at = np.unique(u[out], return_inverse=True)
    code = u.astype(np.int32)
    code[out] = head + at
    return code, far


def decoded(code: np.ndarray, far: np.ndarray, head: int) -> np.ndarray:
    made = code.astype(np.int64)
    out = code >= head
    made[out] = far[code[out] - head]
    return made


def bound(w: np.ndarray, u: np.ndarray, head: int, *more: np.ndarray) -> bytes:
    """Rows sorted by ``w``, packed: words and their numbers of rows, coded contexts, further columns."""
    first = np.flatnonzero(np.diff(w, prepend=w[:1] - 1))
    return frozen(w[first], np.diff(np.append(first, len(w))).astype(np.int32), *coded(u, head), *more)


def _slices(w: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the rows of each bucket, sorted by word."""
    bucket = w % buckets
    order = np.lexsort((w, bucket))
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            yield int(bucket[part[0]]), part


def _columns(names: str, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) if not isinstance(a, pa.Array) else a for a in arrays], names=names.split())


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, total): every token's hash and count; ``texts`` has a binary column ``text``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, hashes in read(batches):
            yield _columns("word total", hashes[1:], np.bincount(tokens, minlength=len(hashes))[1:])

    return texts.select("text").mapInArrow(count, "word long, total long").groupBy("word").agg(F.sum("total").alias("total"))


#: What the blobs of a bucket hold. Words: their hashes or numbers, counts, pairs met once, pairs met more often; coded contexts and
#: counts of the latter. Seats: sums over the samples of the tables of those pairs, and of each word's customers and tables in the root.
WORDS, SEATS = ("i8", "i8", "i4", "i4", "i4", "i8"), ("i8", "i8", "i8")
#: Sums of a bucket: contexts, tables beyond one a pair. Top: words of the head, their customers and tables in the root; pairs, counts, tables.
SUMS, TOP = ("i8", "i8"), ("i8", "i8", "i8", "i8", "i8", "i8")


def counted(texts: DataFrame, ids: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, words, lone, far): a row per bucket; ``lone`` are the coded contexts of the pairs met once, in the order of their words,
    ``far`` the contexts outside the head that the codes point to."""
    sent, head = texts.sparkSession.sparkContext.broadcast((ids, np.argsort(ids))), len(ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, hashes in read(batches):
            known = numbered(hashes, *sent.value)
            at = np.flatnonzero(tokens)
            key, n = np.unique(tokens[at].astype(np.int64) * len(known) + tokens[at - 1], return_counts=True)
            w, u = known[key // len(known)], known[key % len(known)]
            parts = [(b, bound(w[part], u[part], head, n[part].astype(np.int32))) for b, part in _slices(w, buckets)]
            yield _columns("bucket data", np.array([b for b, _ in parts], dtype=np.int32), pa.array([d for _, d in parts], pa.binary()))

    def merge(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        held = []
        for blob in blobs:
            words, runs, code, far, n = thawed(blob, "i8", "i4", "i4", "i8", "i4")
            held.append((np.repeat(words, runs), decoded(code, far, head), n.astype(np.int64)))
        w, u, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((u, w))
        w, u, n = w[order], u[order], n[order]
        first = np.flatnonzero((np.diff(w, prepend=w[0] - 1) != 0) | (np.diff(u, prepend=u[0] - 1) != 0))
        return w[first], u[first], np.add.reduceat(n, first)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _by_bucket(batches):
            w, u, n = merge(blobs)
            new = np.diff(w, prepend=w[0] - 1) != 0
            first, word, many = np.flatnonzero(new), np.cumsum(new) - 1, n > 1
            code, far = coded(u, head)
            runs = [np.bincount(word[x], minlength=len(first)).astype(np.int32) for x in (~many, many)]
            data = [frozen(w[first], np.add.reduceat(n, first), *runs, code[many], n[many]), frozen(code[~many]), frozen(far)]
            yield _columns("bucket words lone far", pa.array([bucket], pa.int32()), *[pa.array([d], pa.binary()) for d in data])

    packed = texts.select("text").mapInArrow(count, "bucket int, data binary").repartition("bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(rows, "bucket int, words binary, lone binary, far binary")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    held, bucket = [], None
    for batch in batches:
        for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if b != bucket and held:
                yield bucket, held
                held = []
            bucket = b
            held.append(data)
    if held:
        yield bucket, held


@dataclass(frozen=True)
class Totals:
    """What the restaurants know of the whole corpus: words, tokens; hashes of the head's contexts by number, their customers and
    tables; all contexts as a table (g, customers, tables); customers and tables of the root; discounts; buckets of words."""

    words: int
    tokens: int
    ids: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    contexts: DataFrame | None
    root_customers: float
    root_tables: float
    discount: float
    root_discount: float
    buckets: int

    @property
    def back_off(self) -> np.ndarray:
        return (STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers)

    def root(self, customers, tables):
        """p0 from the customers and tables of a word in the root."""
        rest = (STRENGTH + self.root_discount * self.root_tables) / (self.words + 1)
        return (customers - self.root_discount * tables + rest) / (STRENGTH + self.root_customers)

    def plain(self) -> Totals:
        """Without the DataFrame: what tasks may hold."""
        return replace(self, contexts=None)


def seated(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """How many tables are open after ``customers`` of each pair have sat down one by one: with i seated at t tables the next opens
    one with weight ``new`` against i - ``discount`` t. Customers beyond the first ``SINGLY`` come in parties of an eighth of those
    seated, whose openings are one binomial draw; so a pair of any size takes a number of steps that grows with its logarithm."""
    order = np.argsort(-customers, kind="stable")
    c, a = customers[order], new[order]
    t = np.ones(len(c), dtype=np.int64)
    seats, most = 1, int(c[0]) if len(c) else 0
    while seats < most:
        party = 1 if seats < SINGLY else seats // 8
        live = int(np.searchsorted(-c, -seats, side="left"))
        weight, open_ = a[:live], t[:live]
        if party == 1:
            t[:live] += rng.random(live) * (weight + seats - discount * open_) < weight
        else:
            come = np.minimum(party, c[:live] - seats)
            taken = weight + seats - discount * open_
            # In the middle of the party half of it is seated, at the tables it has opened by then.
            t[:live] += rng.binomial(come, weight / (taken + (come - 1) / 2 * (1 - discount * weight / taken)))
        seats += party
    found = np.empty_like(t)
    found[order] = t
    return found


def sample(word: np.ndarray, c: np.ndarray, alone: np.ndarray, full: np.ndarray, totals: Totals, rounds: int, samples: int, seed: int):
    """Sums over the last ``samples`` rounds of the tables per pair, and of the customers and tables in the root per word. The pairs are
    those met more than once, ``word`` numbers their words from 0, ``alone`` has the other pairs of each word; ``full`` are the tables of
    each pair's restaurant. In a round all customers of every pair leave and sit down again, given what the other pairs of the word have
    in the root; then all customers of the root do."""
    rng = np.random.default_rng(seed)
    n_words = len(alone)
    rest = np.full(n_words, (STRENGTH + totals.root_discount * totals.root_tables) / (totals.words + 1))
    weight = STRENGTH + totals.discount * full
    tables = np.ones(len(c), dtype=np.int64)
    customers = alone + np.bincount(word, minlength=n_words)
    root = np.ones(n_words, dtype=np.int64)
    sums = [np.zeros(n, dtype=np.int64) for n in (len(c), n_words, n_words)]
    for turn in range(rounds + samples):
        others = customers[word] - tables
        tables = seated(c, weight * totals.root(others, np.minimum(root[word], others)), totals.discount, rng)
        customers = alone + np.bincount(word, weights=tables, minlength=n_words).astype(np.int64)
        root = seated(customers, rest, totals.root_discount, rng)
        if turn >= rounds:
            for s, x in zip(sums, (tables, customers, root)):
                s += x
    return sums


def _summed(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, x, n).astype(float)


def _opened(code: np.ndarray, far: np.ndarray, head: int, t: np.ndarray, c0: np.ndarray, t0: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, tables beyond one a pair), as sums over the samples; at -1 to -4 the root's customers, tables, and words with one and
    two customers."""
    extra = np.bincount(code, t - samples, head + len(far)).astype(np.int64)
    some = np.flatnonzero(extra)
    root = [c0.sum(), t0.sum(), samples * (c0 == samples).sum(), samples * (c0 == 2 * samples).sum()]
    return np.append(np.arange(-1, -5, -1), decoded(some, far, head)), np.append(root, extra[some])


def _totalled(rows: DataFrame, head: int) -> tuple[DataFrame, np.ndarray, list[float]]:
    """(table of what all contexts sum up to, that of the head by number, the four sums below 0) of rows (g, t)."""
    tables = stage(rows.groupBy("g").agg(F.sum("t").alias("t")))
    near = tables.where(F.col("g") < head).toArrow()
    g, t = near.column("g").to_numpy(), near.column("t").to_numpy()
    made = np.zeros(head)
    made[g[g >= 0]] = t[g >= 0]
    return tables.where(F.col("g") >= 0), made, [float(t[g == -i].sum()) for i in range(1, 5)]


def _tidy(n1: float, n2: float, other: float = 0.5) -> float:
    return min(max(n1 / (n1 + 2 * n2), 0.05), 0.95) if n1 and n2 else other


def _band(column):
    return F.floor(F.log2(column) * 8).cast("int")


def _least_band(counts: dict[int, int], most: int) -> int:
    """The lowest frequency band down to which at most ``most`` rows lie."""
    least = 1 << 30
    for band in sorted(counts, reverse=True):
        most -= counts[band]
        if most < 0:
            break
        least = band
    return least


def _head(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words by falling count."""
    least = _least_band({r["b"]: r["n"] for r in words.groupBy(_band("total").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}, HEAD_WORDS)
    near = words.where(_band("total") >= least).toArrow()
    ids, n = near.column("word").to_numpy(), near.column("total").to_numpy()
    order = np.lexsort((ids, -n))
    return ids[order], n[order].astype(float)


def bands(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(c) * 8).astype(np.int64)


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of packed tables one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


@dataclass(frozen=True)
class Model:
    """The pairs of every bucket, their seats and the tables of contexts outside the head, all packed and staged."""

    words: DataFrame
    seats: DataFrame
    beyond: DataFrame
    ids: np.ndarray

    def rows(self) -> DataFrame:
        """(bucket, word, total, c0, t0, gs, cs, ts) per word: contexts, customers and average tables of its pairs."""
        head = len(self.ids)

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, words, lone, far, seats in _blobs(batches):
                word, total, alone, movers, code, c = thawed(words, *WORDS)
                (single,), (far,), (t, c0, t0) = thawed(lone, "i4"), thawed(far, "i8"), thawed(seats, *SEATS)
                order = np.argsort(np.append(np.repeat(np.arange(len(word)), movers), np.repeat(np.arange(len(word)), alone)), kind="stable")
                ones = np.ones(len(single), dtype=np.int64)
                pairs = decoded(np.append(code, single), far, head), np.append(c, ones), np.append(t / SAMPLES, ones)
                offsets = pa.array(np.append(0, np.cumsum(movers + alone)).astype(np.int32))
                yield _columns("bucket word total c0 t0 gs cs ts", np.full(len(word), bucket, dtype=np.int32), word, total, c0 / SAMPLES, t0 / SAMPLES,
                               *[pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in pairs])

        return self.words.join(self.seats.select("bucket", "seats"), "bucket").mapInArrow(
            expand, "bucket int, word long, total long, c0 double, t0 double, gs array<long>, cs array<long>, ts array<double>")

    def collect(self) -> list:
        return self.rows().collect()


def train(texts: DataFrame) -> tuple[Model, Totals]:
    """The model, and the totals that go with it."""
    buckets = max(CLASSES, 4 * texts.rdd.getNumPartitions())
    counts = stage(word_counts(texts))
    sizes = counts.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("total"), F.lit(0)).alias("tokens")).first()
    ids, customers = _head(counts)
    head = len(ids)
    words = stage(counted(texts, ids, buckets))

    def types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of each context; at -1 to -3 pairs with one and two customers, and all."""
        for blob, lone, far in _blobs(batches):
            *_, code, c = thawed(blob, *WORDS)
            (single,), (far,) = thawed(lone, "i4"), thawed(far, "i8")
            n = np.bincount(np.append(code, single), minlength=head + len(far))
            some = np.flatnonzero(n)
            yield _columns("g t", np.append(np.arange(-1, -4, -1), decoded(some, far, head)), np.append([len(single), (c == 2).sum(), len(single) + len(c)], n[some]))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many pairs of head words there are in each band of counts."""
        for (blob,) in _blobs(batches):
            word, _, _, movers, code, c = thawed(blob, *WORDS)
            band, n = np.unique(bands(c[(np.repeat(word, movers) < head) & (code < head)]), return_counts=True)
            yield _columns("b n", band, n)

    kinds, near, ends = _totalled(words.select("words", "lone", "far").mapInArrow(types, "g long, t long"), head)
    first = Totals(sizes["words"], int(sizes["tokens"]), ids, customers, near, None, ends[2], sizes["words"] * 1.1, _tidy(*ends[:2]), 0.5, buckets)
    found = words.select("words").mapInArrow(often, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    least = _least_band({r["b"]: r["n"] for r in found}, HEAD_PAIRS)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A first pass to start from: contexts outside the head count as restaurants of one table."""
        for blob, far in _blobs(batches):
            word, _, alone, movers, code, c = thawed(blob, *WORDS)
            (far,) = thawed(far, "i8")
            full = np.append(first.tables, np.ones(len(far)))[code]
            sums = sample(np.repeat(np.arange(len(word)), movers), c, alone, full, first, FIRST_ROUNDS, 1, int(word[0]))
            yield _columns("g t", *_opened(code, far, head, *sums, 1))

    settled, more, root = _totalled(words.select("words", "far").mapInArrow(settle, "g long, t long"), head)
    second = replace(first, tables=near + more, root_customers=root[0], root_tables=root[1], root_discount=_tidy(*root[2:]))

    def asked(moving: bool):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Contexts outside the head that a bucket has pairs of, with their places; if ``moving``, pairs met more than once."""
            for bucket, blob, far in _blobs(batches):
                (far,) = thawed(far, "i8")
                at = np.arange(len(far))
                if moving:
                    code = thawed(blob, *WORDS)[4]
                    at = np.unique(code[code >= head]) - head
                yield _columns("bucket place g", np.full(len(at), bucket, dtype=np.int32), at.astype(np.int32), far[at])

        return words.select("bucket", "words" if moving else F.lit(b"").alias("words"), "far").mapInArrow(ask, "bucket int, place int, g long")

    def told(wanted: DataFrame, opened: DataFrame, samples: int) -> DataFrame:
        """(bucket, place, g, t): tables of the contexts wanted, as sums over the samples."""
        far = F.col("g") >= head
        return wanted.join(kinds.where(far).withColumnRenamed("t", "n"), "g").join(opened.where(far), "g", "left").select(
            "bucket", "place", "g", (F.col("n") * samples + F.coalesce("t", F.lit(0))).alias("t"))

    plain = second.plain()

    def seat(left: pa.Table, right: pa.Table) -> pa.Table:
        """Samples the words of a bucket."""
        word, _, alone, movers, code, c = thawed(left.column("words")[0].as_py(), *WORDS)
        place, g, t = (right.column(x).to_numpy() for x in ("place", "g", "t"))
        n = int(place.max()) + 1 if len(place) else 0
        far, full = np.zeros(n, dtype=np.int64), np.append(plain.tables, np.ones(n))
        far[place], full[head + place] = g, t
        its = np.repeat(np.arange(len(word)), movers)
        t, c0, t0 = sample(its, c, alone, full[code], plain, BURN_IN, SAMPLES, int(word[0]))
        w, near = word[its], word < head
        top = (w < head) & (code < head) & (bands(c) >= least)
        return pa.table({
            "bucket": left.column("bucket").combine_chunks(), "seats": [frozen(t, c0, t0)], "sums": [frozen(*_opened(code, far, head, t, c0, t0, SAMPLES))],
            "top": [frozen(word[near], c0[near], t0[near], w[top] * NUMBERS + code[top], c[top], t[top])]})

    def extra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (blob,) in _blobs(batches):
            yield _columns("g t", *thawed(blob, *SUMS))

    starts = told(asked(True), settled, 1)
    seats = stage(words.select("bucket", "words").groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(
        seat, "bucket int, seats binary, sums binary, top binary"))
    opened, more, root = _totalled(seats.select("sums").mapInArrow(extra, "g long, t long"), head)
    contexts = _contexts(counts, kinds, opened, ids)
    tables = near + more / SAMPLES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tables told, packed for their bucket: kind 2 by place, kind 3 by word."""
        held, size = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= CHUNK_ROWS:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def packed(held: list) -> pa.RecordBatch:
        bucket, place, g, t = (np.concatenate(x) for x in zip(*held))
        made = []
        for kind, inside in ((2, place >= 0), (3, place < 0)):
            at = np.flatnonzero(inside)
            at = at[np.lexsort((place[at] if kind == 2 else g[at], bucket[at]))]
            for part in np.split(at, np.flatnonzero(np.diff(bucket[at])) + 1):
                if len(part):
                    made.append((int(bucket[part[0]]), kind, frozen(place[part] if kind == 2 else g[part], t[part])))
        b, k, d = zip(*made)
        return _columns("bucket kind data", pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary()))

    # Tables of contexts outside the head: for the buckets that have pairs of them, and at place -1 for the bucket of the context as a word.
    whole = kinds.where(F.col("g") >= head).withColumnRenamed("t", "n").join(opened, "g", "left")
    own = whole.select((F.col("g") % buckets).cast("int").alias("bucket"), F.lit(-1).alias("place"), "g", (F.col("n") * SAMPLES + F.coalesce("t", F.lit(0))).alias("t"))
    beyond = told(asked(False), opened, SAMPLES).unionAll(own).mapInArrow(pack, "bucket int, kind int, data binary")
    totals = replace(second, tables=tables, root_customers=root[0] / SAMPLES, root_tables=root[1] / SAMPLES, contexts=contexts)
    return Model(words, seats, beyond, ids), totals


def _contexts(counts: DataFrame, kinds: DataFrame, opened: DataFrame, ids: np.ndarray) -> DataFrame:
    """(hash, customers, tables) of every context. The head's numbers become hashes again; a context has as many customers as its
    word has tokens."""
    spark = counts.sparkSession
    numbers = spark.createDataFrame(pa.table({"g": np.arange(len(ids)), "hash": ids}))
    tables = kinds.select("g", F.col("t").cast("double").alias("t")).unionAll(opened.select("g", F.col("t") / SAMPLES)).groupBy("g").agg(F.sum("t").alias("tables"))
    named = tables.join(F.broadcast(numbers), "g", "left").select(F.coalesce("hash", "g").alias("hash"), "tables")
    return counts.select(F.col("word").alias("hash"), "total").join(named, "hash").select("hash", F.col("total").cast("double").alias("customers"), "tables")


def _base(count, totals: Totals):
    return (count + 1) / (totals.tokens + totals.words + 1)


class Bucket:
    """The model of a bucket's words, for the tokens that are sent to it."""

    def __init__(self, totals: Totals, head: int, blobs: dict[int, list[tuple]]):
        self.totals, self.numbers = totals, len(totals.ids)
        nothing = np.zeros(0, dtype=np.int64)
        words, lone, far = blobs[0][0] if 0 in blobs else (frozen(*[nothing.astype(k) for k in WORDS]), frozen(nothing.astype("i4")), frozen(nothing))
        word, total, alone, movers, code, c = thawed(words, *WORDS)
        (single,), (self.far,) = thawed(lone, "i4"), thawed(far, "i8")
        t, c0, t0 = thawed(blobs[1][0][0], *SEATS) if 1 in blobs else (nothing,) * 3
        beyond = np.zeros(len(self.far))
        for blob, *_ in blobs.get(2, ()):
            place, x = thawed(blob, "i4", "i8")
            beyond[place] = x / SAMPLES
        scale = STRENGTH + totals.discount * np.append(totals.tables, beyond)
        # One sorted key per pair: the word's place in the bucket and the context's code.
        self.words, self.size, places = word, self.numbers + len(self.far) + 1, np.arange(len(word))
        self.pairs = [(np.repeat(places, movers) * self.size + code, (c - totals.discount * t / SAMPLES) / scale[code]),
                      (np.repeat(places, alone) * self.size + single, (1 - totals.discount) / scale[single])]
        # Per word and, at the end, for unknown ones: probability in the root, base, and what its restaurant adds to the token behind.
        self.p0 = totals.root(np.append(c0, 0) / SAMPLES, np.append(t0, 0) / SAMPLES)
        self.base = np.log10(_base(np.append(total, 0), totals))
        tables = np.zeros(len(word) + 1)
        named = np.flatnonzero(word < self.numbers)
        tables[named] = totals.tables[word[named]]
        for blob, *_ in blobs.get(3, ()):
            g, x = thawed(blob, "i8", "i8")
            tables[np.searchsorted(word, g)] = x / SAMPLES
        self.back = np.log10((STRENGTH + totals.discount * tables) / (STRENGTH + np.append(total, 0)))
        # Counts, bases and restaurants of the head are known where the text is read.
        self.near = int(np.searchsorted(word, head))
        self.base[:self.near] = self.back[:self.near] = 0.0

    def judged(self, data: bytes) -> bytes:
        """Texts of a blob of tokens, and for each the known tokens outside the head and the sums of base and score."""
        words, runs, code, far, texts, at = thawed(data, *TOKENS)
        here, code = np.repeat(self._places(self.words, words), runs), code.astype(np.int64)
        out = code >= self.numbers
        code[out] = self.numbers + self._places(self.far, far)[code[out] - self.numbers]
        key = here * self.size + code
        own = np.zeros(len(key))
        for pairs, value in self.pairs:
            if len(pairs):
                found = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                own += np.where(pairs[found] == key, value[found], 0.0)
        n, known = len(texts), (here >= self.near) & (here < len(self.words))
        score = np.log10(own + self.p0[here]) + self.back[here]
        return frozen(texts, np.bincount(at[known], minlength=n), _summed(at, self.base[here], n), _summed(at, score, n))

    @staticmethod
    def _places(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Places among the sorted ``known``, its length for all others."""
        at = np.searchsorted(known, asked)
        at[at < len(known)] = np.where(known[at[at < len(known)]] == asked[at < len(known)], at[at < len(known)], len(known))
        return at


#: What is sent of a chunk of texts: words, runs, coded contexts, contexts outside the head, texts, the text of each token; and per text
#: its id, whether that is null, whether it is held out, tokens, tokens in the head, sums of base and score. What comes back per text.
TOKENS, TEXTS, PARTS = ("i8", "i4", "i4", "i8", "i4", "i4"), ("i8", "?", "?", "i8", "i8", "f8", "f8"), ("i4", "i8", "f8", "f8")


def score(documents: DataFrame, model: Model, totals: Totals, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    head = min(HEAD_WORDS, len(totals.ids))
    known, buckets = totals.plain(), totals.buckets
    # Per head word: its count and probability in the root, to go with the pairs that are scored where the text is read.
    tops = [thawed(x, *TOP) for x in model.seats.select("top").toArrow().column("top").to_pylist()]
    word, c0, t0, keys, c, t = (np.concatenate(x) for x in zip(*tops)) if tops else (np.zeros(0, dtype=np.int64),) * 6
    p0 = np.zeros(len(known.ids))
    p0[word] = known.root(c0 / SAMPLES, t0 / SAMPLES)
    order = np.argsort(keys)
    order = order[(keys[order] // NUMBERS < head) & (keys[order] % NUMBERS < head)]
    w, u = keys[order] // NUMBERS, keys[order] % NUMBERS
    own = (c[order] - known.discount * t[order] / SAMPLES) / (STRENGTH + known.discount * known.tables[u])
    sent = spark.sparkContext.broadcast((known.ids, np.argsort(known.ids), keys[order], np.log10(own + p0[w]), np.log10(_base(known.customers, known)), np.log10(known.back_off[:head])))
    shared = spark.sparkContext.broadcast(known)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a chunk of texts, named by its first row, sends: tokens without a frequent pair, packed for the bucket of their word
        (kind 4); of each text the number of its tokens, what words and contexts of the head add, and the sum over the tokens with a
        frequent pair (kind 5)."""
        ids, order, keys, values, base, back = sent.value
        for rows, tokens, hashes in read(batches):
            names = numbered(hashes, ids, order)
            text = (np.cumsum(tokens == 0) - 1).astype(np.int32)
            at = np.flatnonzero(tokens)
            w, u, text = names[tokens[at]], names[tokens[at - 1]], text[at]
            place = np.full(len(w), -1)
            if len(keys):
                near = np.flatnonzero((w < head) & (u < head))
                key = w[near] * NUMBERS + u[near]
                found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                place[near] = np.where(keys[found] == key, found, -1)
            n, chunk = len(rows), rows[0][0]
            near, inside, ahead = place >= 0, u < head, w < head
            score = _summed(text[near], values[place[near]], n) + _summed(text[inside], back[u[inside]], n)
            doc = np.array([0 if r[1] is None else r[1] for r in rows], dtype=np.int64)
            made = [(chunk % 1_000_003 % buckets, 5, frozen(
                doc, np.array([r[1] is None for r in rows]), np.array([r[2] for r in rows]), np.bincount(text, minlength=n),
                np.bincount(text[ahead], minlength=n), _summed(text[ahead], base[w[ahead]], n), score))]
            w, u, text = w[~near], u[~near], text[~near]
            for b, part in _slices(w, buckets):
                of, its = np.unique(text[part], return_inverse=True)
                made.append((b, 4, bound(w[part], u[part], len(ids), of, its.astype(np.int32))))
            b, kind, data = zip(*made)
            yield _columns("bucket kind chunk data", pa.array(b, pa.int32()), pa.array(kind, pa.int32()), np.full(len(b), chunk, dtype=np.int64), pa.array(data, pa.binary()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of a bucket against its model, which comes first: a blob per chunk of texts."""
        bucket, blobs, model = None, {}, None
        for b, kind, chunk, *data in _blobs(batches):
            if b != bucket:
                bucket, blobs, model = b, {}, None
            if kind < 4:
                blobs.setdefault(kind, []).append(data)
                continue
            if kind == 4:
                if model is None:
                    model, blobs = Bucket(shared.value, head, blobs), {}
                data[0] = model.judged(data[0])
            yield _columns("chunk bucket data", pa.array([chunk], pa.int64()), pa.array([b if kind == 4 else -1], pa.int32()), pa.array([data[0]], pa.binary()))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of each chunk, which come first, with all that comes back for them."""
        names, found = "doc_id held_out n_tokens n_known base_score score", None
        for _, bucket, data in _blobs(batches):
            if bucket < 0:
                if found:
                    yield _columns(names, *found)
                doc, gone, held_out, *sums = thawed(data, *TEXTS)
                found = [pa.array(doc, mask=gone), held_out, *[x.copy() for x in sums]]
            else:
                at, *parts = thawed(data, *PARTS)
                for s, x in zip(found[3:], parts):
                    s[at] += x
        if found:
            yield _columns(names, *found)

    rows = documents.select(
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"), (crc_fold(F.col(doc_id), folds) == held).alias("held_out"))
    none, whole = F.lit(None).cast("binary"), F.lit(0).cast("long").alias("chunk")
    lines = [model.words.select("bucket", F.lit(0).alias("kind"), whole, F.col("words").alias("data"), "lone", "far")]
    sends = rows.mapInArrow(scan, "bucket int, kind int, chunk long, data binary")
    for df in (model.seats.select("bucket", F.lit(1).alias("kind"), whole, F.col("seats").alias("data")), model.beyond.select("bucket", "kind", whole, "data"), sends):
        lines.append(df.select("bucket", "kind", "chunk", "data", none.alias("lone"), none.alias("far")))
    dealt = reduce(DataFrame.unionAll, lines).repartition("bucket").sortWithinPartitions("bucket", "kind", "chunk")
    back = dealt.mapInArrow(judge, "chunk long, bucket int, data binary").repartition("chunk").sortWithinPartitions("chunk", "bucket")
    summed = back.mapInArrow(added, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def scored(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """Train on the rows outside fold ``held`` and score all."""
    learns = documents.where(crc_fold(F.col(doc_id), folds) != held).select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    model, totals = train(learns)
    return score(documents, model, totals, doc_id, text, folds, held)
