"""Exact substring de-duplication with compressed FM-indexes over shards of repeated passages.

A window is ``WINDOW`` consecutive words (runs between ASCII white space). A word is removed if a window that covers it also
starts in a document with a smaller id; windows are judged on the input.

1. Routing. The words of every window have a smallest hash among their ``GRAM``-word shingles, the window's key. Equal windows
   have equal keys, and neighbouring windows mostly share theirs, so a document falls into segments of one key each.
   A key that only one text has cannot hold a repeated window. Each batch announces its keys once, with the smallest and the
   largest row that has them, so a key with a third of all rows is a few announcements; keys whose rows differ are marked in a bit
   map. Equal texts, known by their XXH64 value, count as one row; all but the one of the smallest id lose every word that a
   window covers.
2. Segments of repeated keys go to the shard of their key, once per task and text: in a task, all but the smallest
   document of equal segments are covered at once. Keys with over ``HOT`` segments are dealt by window instead.
3. A shard writes its distinct segments one after another, sorts their suffixes by the first 16 words, and keeps the
   Burrows-Wheeler transform in a wavelet matrix of packed bits. Backward search over it finds, for all windows of the
   streamed segments together, how far a match with another place reaches (the matching statistic, up to ``WINDOW``),
   dropping a window as soon as it is alone. The smallest document in the interval of a full match decides.
4. Covered intervals meet their documents; the kept words are joined by one blank.

Nothing is compared pairwise, and a shard's size is fixed by ``SHARD_WORDS``, so shards grow in number only.

Defined cases: NULL and empty texts have no words; texts shorter than a window lose nothing; a row without id neither loses words
nor takes any from others; rows with one id do not take from one another; repeated rows get equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.collocations import bit_map, has
from cohortspark.llm.common import stage

WINDOW = 13
GRAM = 5
SHARD_WORDS = 400_000
HOT = 5_000
CACHE = 200_000
#: Size of the map of repeated keys: 2 MB at least, 64 MB at most.
MIN_BITS, MAX_BITS, BITS_PER_KEY = 1 << 24, 1 << 29, 64
DEPTH_ROUNDS = 4  # suffixes are sorted by their first 2**4 words, which must not be fewer than a window


class Hashes(dict):
    """Word -> 64-bit hash, held for at most ``CACHE`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def segments(words: list[bytes], hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows) of the maximal runs of windows with one key."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    grams = h[:n - GRAM + 1].copy()
    for j in range(1, GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[j:n - GRAM + 1 + j]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    span, least = WINDOW - GRAM + 1, grams
    width = 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[starts], starts, np.diff(np.append(starts, len(least)))


def _announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, low, high): each key of the batch with the smallest and the largest row that has it."""
    hashes = Hashes()
    for batch in batches:
        found = [(np.unique(segments(t.as_py().split(), hashes)[0]), r) for r, t in zip(batch.column("row").to_pylist(), batch.column("text"))]
        keys = np.concatenate([k for k, _ in found] or [np.zeros(0, np.uint64)]).view(np.int64)
        rows = np.repeat(np.array([r for _, r in found], dtype=np.int64), [len(k) for k, _ in found])
        order = np.argsort(keys)
        keys, rows = keys[order], rows[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
        if len(first):
            yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(np.minimum.reduceat(rows, first)), pa.array(np.maximum.reduceat(rows, first))], names=["key", "low", "high"])


def repeated_keys(rows: DataFrame):
    """Broadcast bit map of the keys that more than one row has.

    It has some ``BITS_PER_KEY`` bits per such key up to ``MAX_BITS``. A key it holds wrongly makes a segment that the index then
    finds nowhere else; none is missing."""
    told = rows.where("doc_id is not null").select("row", F.col("text").cast("binary").alias("text")).mapInArrow(_announce, "key long, low long, high long")
    repeated = stage(told.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("key"))
    bits = MIN_BITS
    while bits < min(MAX_BITS, BITS_PER_KEY * repeated.count()):
        bits *= 2
    return bit_map(repeated, F.col("key"), bits)


def kept_digest(words: list[bytes], removed: np.ndarray) -> str:
    return hashlib.sha256(b" ".join(w for w, r in zip(words, removed) if not r)).hexdigest()


PART = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("key", pa.int64()), ("start", pa.int32()),
                  ("count", pa.int32()), ("text", pa.binary()), ("n_words", pa.int64()), ("digest", pa.string())])
PARTS = "kind int, doc_id long, row long, key long, start int, count int, text binary, n_words long, digest string"
DONE, SEGMENT, COVERED, PENDING = range(4)


def _combine(found: dict[tuple[int, bytes], list[tuple[int, int, int, int]]]) -> Iterator[dict]:
    """Of equal texts, segments of the smallest document; the places of all others are covered, touching ones as one."""
    covered: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (key, text), places in found.items():
        least = min(p[0] for p in places)
        for doc, row, start, count in dict.fromkeys(places):
            if doc == least:
                yield {"kind": SEGMENT, "doc_id": doc, "row": row, "start": start, "count": count, "key": key, "text": text}
            else:
                covered.setdefault((doc, row), []).append((start, start + count))
    for (doc, row), spans in covered.items():
        first = last = None
        for start, end in sorted(spans):
            if first is not None and start <= last:
                last = max(last, end)
                continue
            if first is not None:
                yield {"kind": COVERED, "doc_id": doc, "row": row, "start": first, "count": last - first}
            first, last = start, end
        yield {"kind": COVERED, "doc_id": doc, "row": row, "start": first, "count": last - first}


def _cut(repeated):
    """Copies of a smaller document and rows without repeated keys are done; the others give segments, covered places, and
    wait with their text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, zip_, unzip = Hashes(), zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in batches:
            parts: list[dict] = []
            found: dict[tuple[int, bytes], list] = {}
            for doc, row, packed, least in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "row", "packed", "least")]):
                text = unzip.decompress(packed)
                words = text.split()
                copy = doc is not None and doc > least and len(words) >= WINDOW
                ids, starts, counts = segments([] if doc is None or doc > least else words, hashes)
                wanted = np.flatnonzero(has(repeated.value, ids))
                if not len(wanted):
                    parts.append({"kind": DONE, "doc_id": doc, "count": len(words) * copy, "n_words": len(words), "digest": kept_digest(words, np.full(len(words), copy))})
                    continue
                parts.append({"kind": PENDING, "doc_id": doc, "row": row, "text": zip_.compress(text)})
                for key, start, count in zip(ids[wanted].view(np.int64).tolist(), starts[wanted].tolist(), counts[wanted].tolist()):
                    found.setdefault((key, b" ".join(words[start:start + count + WINDOW - 1])), []).append((doc, row, start, count))
            parts += _combine(found)
            yield pa.RecordBatch.from_pylist(parts, schema=PART)

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of hot keys as single windows, keyed by their text."""
    for batch in batches:
        found: dict[tuple[int, bytes], list] = {}
        for doc, row, start, count, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "row", "start", "count", "text")]):
            words = text.split()
            for i in range(count):
                window = b" ".join(words[i:i + WINDOW])
                key = xxhash.xxh64_intdigest(window)
                found.setdefault((key - (1 << 64) if key >> 63 else key, window), []).append((doc, row, start + i, 1))
        yield pa.RecordBatch.from_pylist(list(_combine(found)), schema=PART)


class Bits:
    """A bit vector in words of 64 with the ones before each word counted."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """Rank of any symbol in a sequence, one bit vector per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray):
        self.depth = max(1, int(symbols.max()).bit_length())
        self.levels = []
        for level in range(self.depth - 1, -1, -1):
            bits = (symbols >> level) & 1
            self.levels.append(Bits(bits.astype(np.uint8)))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol[i]`` before position ``at[i]``."""
        start, end = np.zeros_like(at), at
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels):
            one = ((symbol >> level) & 1).astype(bool)
            s, e = bits.rank(start), bits.rank(end)
            start, end = np.where(one, bits.zeros + s, start - s), np.where(one, bits.zeros + e, end - e)
        return end - start


class FMIndex:
    """Over whole numbers from 1 with 0 between texts; suffixes are ordered by their first 16 symbols."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        rank = text.astype(np.int64)
        for step in (1 << r for r in range(DEPTH_ROUNDS)):
            later = np.zeros(n, dtype=np.int64)
            later[:-step] = rank[step:] + 1
            pair = rank * (int(rank.max()) + 2) + later
            rank = np.unique(pair, return_inverse=True)[1]
        self.suffixes = np.argsort(rank, kind="stable")
        self.transform = WaveletMatrix(text[self.suffixes - 1])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])

    def matching_statistics(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window: how many of its last words occur in another place too (at most ``length``), and the interval of
        suffixes that the last step found."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.suffixes))
        reach = np.zeros(len(starts), np.int64)
        active = np.arange(len(starts))
        for step in range(length):
            symbol = text[starts[active] + length - 1 - step]
            a = self.first[symbol] + self.transform.rank(symbol, low[active])
            b = self.first[symbol] + self.transform.rank(symbol, high[active])
            shared = b - a > 1
            active = active[shared]
            low[active], high[active] = a[shared], b[shared]
            reach[active] += 1
        return reach, low, high


def covered_in_shard(docs: np.ndarray, texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Per segment the half-open word intervals that windows of a smaller document cover."""
    distinct: dict[bytes, int] = {}
    of = np.array([distinct.setdefault(t, len(distinct)) for t in texts])
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, of, docs)
    numbers: dict[bytes, int] = {}
    body = [[numbers.setdefault(w, len(numbers) + 1) for w in t.split()] for t in distinct]
    sizes = np.array([len(b) for b in body])
    text = np.concatenate([np.array(b + [0]) for b in body])
    begin = np.cumsum(sizes + 1) - sizes - 1
    index = FMIndex(text)
    windows = sizes - WINDOW + 1
    owner = np.repeat(np.arange(len(body)), windows)
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    reach, low, high = index.matching_statistics(text, begin[owner] + inside, WINDOW)
    doc_of = np.repeat(least, sizes + 1)[index.suffixes]
    full = np.flatnonzero(reach == WINDOW)
    taken = np.zeros(len(owner), dtype=bool)
    if len(full):
        spans, back = np.unique(np.stack([low[full], high[full]]), axis=1, return_inverse=True)
        bounds = np.append(spans.T.reshape(-1), len(doc_of) - 1)
        smallest = np.minimum.reduceat(doc_of, bounds)[:-1:2] if bounds[-2] < len(doc_of) else np.array([doc_of[a:b].min() for a, b in spans.T])
        taken[full] = smallest[back.reshape(-1)] < least[owner[full]]
    runs: list[list[tuple[int, int]]] = [[] for _ in body]
    for o, i in zip(owner[taken].tolist(), inside[taken].tolist()):
        if runs[o] and runs[o][-1][1] >= i:
            runs[o][-1] = (runs[o][-1][0], i + WINDOW)
        else:
            runs[o].append((i, i + WINDOW))
    return [[(0, int(sizes[o]))] if d > least[o] else runs[o] for d, o in zip(docs.tolist(), of.tolist())]


def _shard(group: pa.Table) -> pa.Table:
    docs, rows, starts = (group.column(c).to_pylist() for c in ("doc_id", "row", "start"))
    out = [(d, r, s + low, s + high) for d, r, s, found in zip(docs, rows, starts, covered_in_shard(np.array(docs), group.column("text").to_pylist())) for low, high in found]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "row", "low", "high"), list(zip(*out)) or [()] * 4, kinds)})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for doc, packed, covered in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "covered")]):
            words = unzip.decompress(packed).split()
            removed = np.zeros(len(words), dtype=bool)
            for span in covered or []:
                removed[span["low"]:span["high"]] = True
            out.append((doc, len(words), int(removed.sum()), kept_digest(words, removed)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = pa.array([made.compress(t.as_py()) for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["doc_id", "row", "packed"])


def covered_places(parts: DataFrame) -> DataFrame:
    """(doc_id, row, low, high): word intervals that a smaller document covers, of the parts of all rows."""
    found = parts.where(F.col("kind") == SEGMENT)
    hot = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key")
    split = stage(found.join(hot, "key", "left_semi").select("doc_id", "row", "start", "count", "text").mapInArrow(_split, PARTS))
    dealt = found.join(hot, "key", "left_anti").unionByName(split.where(F.col("kind") == SEGMENT).select(*found.columns))
    # Segments of hot keys count as their windows too: a few shards too many rather than overfull ones.
    words = sum(d.where(F.col("kind") == SEGMENT).agg(F.sum(F.col("count") + (WINDOW - 1))).first()[0] or 0 for d in (parts, split))
    shards = max(1, -(-int(words) // SHARD_WORDS))
    matched = dealt.select(F.pmod("key", F.lit(shards)).alias("shard"), "doc_id", "row", "start", "text").groupBy("shard").applyInArrow(
        _shard, "doc_id long, row long, low int, high int")
    at_once = lambda d: d.where(F.col("kind") == COVERED).select("doc_id", "row", F.col("start").alias("low"), (F.col("start") + F.col("count") + (WINDOW - 1)).alias("high"))
    return matched.unionByName(at_once(parts)).unionByName(at_once(split))


def deduplicate(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("row"), "text")
    packed = rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(_packed, "doc_id long, row long, packed binary")
    owners = rows.where("doc_id is not null").groupBy("row").agg(F.min("doc_id").alias("least"))
    joined = packed.join(owners, "row", "left").select("doc_id", "row", "packed", "least")
    parts = stage(joined.mapInArrow(_cut(repeated_keys(rows)), PARTS))
    covered = covered_places(parts).groupBy("row", "doc_id").agg(F.collect_list(F.struct("low", "high")).alias("covered"))
    waiting = parts.where(F.col("kind") == PENDING).select("row", "doc_id", "text")
    finished = waiting.join(covered, ["row", "doc_id"], "left").select("doc_id", "text", "covered").mapInArrow(
        _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    done = parts.where(F.col("kind") == DONE).select("doc_id", "n_words", F.col("count").cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"))
    return done.unionByName(finished)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS k
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 11, 1))) AS p FROM d)),
first AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
hit AS (SELECT doc_id, p FROM win JOIN first USING (k) WHERE least < doc_id),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM hit) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS t FROM word LEFT JOIN gone USING (doc_id)
  WHERE qs IS NULL OR NOT list_contains(qs, q) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
