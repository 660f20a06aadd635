"""Token-id output packed into fixed-length rows by best-fit decreasing.

Texts are tokenised with a public byte-level vocabulary and closed by an end token. A document longer than a row is cut
into pieces of the row length and one rest, losing nothing. Pieces are dealt to shards by a hash of (document, piece), so a
very long document spreads like any other rows; each shard sorts its pieces by length, longest first, and puts each
into the bin with the smallest sufficient room. That bin is found in a segment tree over the possible rooms. A bin gives one
row: the token ids filled up to the length, cumulative segment lengths, positions that start again at each
segment, and the document and piece of each segment.

Shards are sized by the bytes of the input, so their number grows with it and the memory of a task does not. Equal runs of
the same table give equal rows; which pieces share a bin depends on the hash only, not on the layout of the input.

Defined cases: a NULL or empty text is one end token; a NULL id is kept as NULL; repeated rows are packed as often as they
occur; an empty table gives an empty result; other columns are ignored. The vocabulary file must be readable on
every executor under the given path; it is not part of this package.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.alignment import encode_cut, long_runs

# The pre-tokenisation pattern that belongs to the vocabulary and its end token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256

LENGTH = 2048
SHARD_BYTES = 4 << 20
PACKED = "shard int, bin int, input_ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<long>, parts array<int>"


class Tokenizer:
    """Text -> token ids as little-endian bytes of the narrowest kind that holds the vocabulary."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.kind = np.dtype("<u2" if len(ranks) < 1 << 16 else "<u4")
        self.runs = long_runs()
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        return encode_cut(self.encoding, text, self.runs).astype(self.kind).tobytes()


class Rooms:
    """Segment tree over the rooms 0..length: which rooms have an open bin; finds the smallest room that suffices."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.open = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, number: int) -> None:
        heapq.heappush(self.bins[room], number)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.open[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of the best fit, the oldest bin of that room; it is removed."""
        node = need + self.size
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        room = node - self.size
        self._count(room, -1)
        return room, heapq.heappop(self.bins[room])


def best_fit_decreasing(lengths: Sequence[int], length: int) -> list[list[int]]:
    """Bins of indices into ``lengths``, which must be in falling order."""
    rooms, bins = Rooms(length), []
    for index, need in enumerate(lengths):
        found = rooms.take(need) if need < length else None
        if found is None:
            found = (length, len(bins))
            bins.append([])
        room, number = found
        bins[number].append(index)
        if room > need:
            rooms.put(room - need, number)
    return bins


def tokenized(documents: DataFrame, doc_id: str, text: str, vocabulary: str, length: int, end: int) -> DataFrame:
    """(doc_id, part, ids binary): pieces of at most ``length`` tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(vocabulary)
        closing = np.array([end], dtype=tokenizer.kind).tobytes()
        width = length * tokenizer.kind.itemsize
        for batch in batches:
            ids, parts, pieces = [], [], []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                encoded = tokenizer.encode(value.as_py()) + closing
                for part, low in enumerate(range(0, len(encoded), width)):
                    ids.append(doc)
                    parts.append(part)
                    pieces.append(encoded[low:low + width])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(pieces, pa.binary())], names=["doc_id", "part", "ids"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, part int, ids binary")


def pack(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
    length: int = LENGTH, end: int = END, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per bin: shard, bin, input_ids (filled up with the end token), cu_seqlens (0 and the running ends of the
    segments), position_ids (0.. in each segment, 0 in the filling), doc_ids and parts of the segments."""
    total = documents.agg(F.sum(F.octet_length(F.col(text)) + 1)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    kind = Tokenizer(vocabulary).kind

    def bins(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("doc_id", "ascending"), ("part", "ascending"), ("ids", "ascending")])
        pieces = [np.frombuffer(p.as_py(), dtype=kind) for p in group.column("ids")]
        lengths = np.array([len(p) for p in pieces])
        order = np.argsort(-lengths, kind="stable")
        docs, parts = group.column("doc_id").to_pylist(), group.column("part").to_pylist()
        rows: dict[str, list] = {name.split()[0]: [] for name in PACKED.split(", ")}
        shard = group.column("shard")[0].as_py()
        for number, held in enumerate(best_fit_decreasing(lengths[order].tolist(), length)):
            members = [int(order[k]) for k in held]
            ids, positions = np.full(length, end, dtype=np.int32), np.zeros(length, dtype=np.int32)
            ends = np.concatenate([[0], np.cumsum(lengths[members])]).astype(np.int32)
            for m, low, high in zip(members, ends, ends[1:]):
                ids[low:high] = pieces[m]
                positions[low:high] = np.arange(high - low)
            for name, value in zip(rows, (shard, number, ids, ends, positions, [docs[m] for m in members], [parts[m] for m in members])):
                rows[name].append(value)
        kinds = [pa.int32(), pa.int32(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.table({name: pa.array(values, k) for (name, values), k in zip(rows.items(), kinds)})

    pieces = tokenized(documents, doc_id, text, vocabulary, length, end)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(bins, PACKED)
