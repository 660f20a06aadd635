"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Every text is encoded by a byte-level vocabulary A (with a space put before the text) and by a piece vocabulary B (which
puts that space itself). Where a token of A and one of B end at the same byte, the two are linked, and the text is cut
into groups there. How often a pair of ids is linked in the corpus says how well the two tokens match.

1. ``encoded``: documents are dealt to chunks, each of at most ``CHUNK_DOCS`` documents of one task. Every chunk gives one
   row per document and an inverted index: per pair of ids a bitmap of the documents that hold it, and for pairs met several
   times in a document the planes of (times - 1) written in binary. A bitmap below ``DENSE`` documents is the sorted list of
   16-bit document numbers, above that 65,536 bits.
2. ``pair_counts``: documents of different chunks differ, so merging the bitmaps of a pair adds their popcounts: the first
   plane counts documents, all planes weighted by their powers of two count links. Within a chunk the bitmaps of different
   pairs overlap; ``documents_of_b`` merges them by OR before it counts.
3. ``aligned``: the counts go back to the postings, the postings to their chunk, and each posting returns its pair's count
   to the documents in its bitmap.

Only compressed postings are shuffled, never one row per link. A pair that every chunk holds has one posting per chunk and
plane, which Spark may split in the join by pair; a chunk's postings are bounded by ``CHUNK_LINKS`` and its documents.

Defined cases: a text that is NULL, empty or not restored by the bytes of both encodings has no tokens: zeros and an empty
digest; repeated rows and rows without id are separate documents; an empty table gives no rows; other columns are
ignored. A single very long text is one chunk of its own. The vocabulary files must be readable on every executor.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import stage

# The pre-tokenisation pattern that belongs to vocabulary A, and white space as it means it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "[\t-\r \x85\xa0  -     　]"
VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"

#: Runs of white space from this length on are encoded apart: the pattern matcher recurses over them.
LONG_RUN = 4_096
CHUNK_DOCS = 1 << 16
CHUNK_LINKS = 3_000_000
DENSE = 4_096
#: Most words whose pieces a task remembers.
REMEMBERED = 200_000

POSTING = "chunk long, pair long, plane int, docs int, bits binary"
DOCUMENT = "chunk long, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
NAMES = [c.split()[0] for c in f"{DOCUMENT}, {POSTING}".split(", ") if c != "chunk long"]
ENCODED = f"{DOCUMENT}, {POSTING.split(', ', 1)[1]}"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte: itself where it is printable, else the next
    free one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def long_runs(least: int = LONG_RUN) -> re.Pattern:
    return re.compile(f"{WHITE}{{{least},}}")


def plain_ids(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of ``text`` by the path that looks for no special tokens, of which the vocabularies here have none."""
    return np.frombuffer(array("I", encoding.encode_ordinary(text)), dtype=np.uint32)


def encode_cut(encoding: tiktoken.Encoding, text: str, runs: re.Pattern) -> np.ndarray:
    """Ids of ``text``. A long run of white space is one unit of the pattern, but for its last sign where more text follows,
    since that one may join it; so the text is cut there and the run encoded as the unit it is."""
    if len(text) < LONG_RUN or not runs.search(text):
        return plain_ids(encoding, text)
    made, at = [], 0
    for run in runs.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        made += [plain_ids(encoding, text[at:run.start()]), np.array(encoding._encode_single_piece(text[run.start():end]), dtype=np.uint32)]
        at = end
    return np.concatenate([*made, plain_ids(encoding, text[at:])])


class ByteTokens:
    """Vocabulary A: ids in the order of the merges, so ids are ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): rank for token, rank in vocabulary.items()}
        self.bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.encoding = tiktoken.Encoding("alignment", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.runs = long_runs()

    def encode(self, text: str) -> np.ndarray:
        return encode_cut(self.encoding, text, self.runs)


class PieceTokens:
    """Vocabulary B. If no piece holds a space after another sign, merges never cross the start of a word, so words are
    encoded one by one and remembered; else whole texts are encoded."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.space = self.model.piece_to_id("▁")
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        if not self.by_word:
            return self.model.encode(text, num_threads=1)
        # The model itself puts one space before what it is given, so each word goes without one of its own.
        spaced = "  " in text or text[:1] == " " or text[-1:] == " "
        words = [w[1:] for w in re.findall(" *[^ ]+| +\\Z", f" {text}")] if spaced else text.split(" ")
        known, out = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = self.model.encode(word, num_threads=1) if word else [self.space]
                if len(word) < 64:
                    known[word] = ids
            out += ids
        return out


class Aligner:
    """Ids and byte ends of both encodings of a text, their groups and links."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.length = [np.array([len(t) for t in side.bytes], dtype=np.int64) for side in (self.a, self.b)]
        self.marked = [[[f"{i}{sign}" for i in range(len(side.bytes))] for sign in ",|;"] for side in (self.a, self.b)]

    def align(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A, ids of B, and of each group the last token of A and of B; None where a side does not restore the text."""
        if not text:
            return None
        want = b" " + text.encode()
        a, b = self.a.encode(" " + text), np.array(self.b.encode(text), dtype=np.int64)
        if b"".join(map(self.a.bytes.__getitem__, a.tolist())) != want or b"".join(map(self.b.bytes.__getitem__, b.tolist())) != want:
            return None
        ends_a, ends_b = np.cumsum(self.length[0][a]), np.cumsum(self.length[1][b])
        at = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[at] == ends_a)
        return a.astype(np.int64), b, last_a, at[last_a]

    def written(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: each id carries the sign after it, and tokens go to their place in one pass."""
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        place = np.empty(len(a) + len(b), dtype=object)
        signs = np.zeros(len(a), dtype=np.int8)
        signs[last_a] = 1
        place[np.arange(len(a)) + np.repeat(last_b - size_b + 1, size_a)] = [self.marked[0][s][i] for s, i in zip(signs.tolist(), a.tolist())]
        signs = np.zeros(len(b), dtype=np.int8)
        signs[last_b] = 2
        place[np.arange(len(b)) + np.repeat(last_a + 1, size_b)] = [self.marked[1][s][i] for s, i in zip(signs.tolist(), b.tolist())]
        return "".join(place.tolist())[:-1]


def bitmaps(docs: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One bitmap per run of document numbers that begins at ``starts``: short runs as they are, long ones as bits."""
    sizes = np.diff(starts, append=len(docs))
    if not (sizes >= DENSE).any():
        offsets = np.append(starts, len(docs)).astype(np.int32) * 2
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(docs.astype("<u2").tobytes())])
    return pa.array([docs[s:s + n].astype("<u2").tobytes() if n < DENSE else dense(docs[s:s + n]) for s, n in zip(starts.tolist(), sizes.tolist())], pa.binary())


def dense(docs: np.ndarray) -> bytes:
    bits = np.zeros(CHUNK_DOCS, dtype=bool)
    bits[docs] = True
    return np.packbits(bits, bitorder="little").tobytes()


def members(bits: bytes) -> np.ndarray:
    """The document numbers of a bitmap."""
    if len(bits) < CHUNK_DOCS // 8:
        return np.frombuffer(bits, dtype="<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little"))


class Chunk:
    """Documents of one task and the index of their pairs."""

    def __init__(self, number: int):
        self.number, self.rows, self.pairs, self.docs, self.times, self.links = number, [], [], [], [], 0

    def add(self, doc_id: int | None, text: str, aligner: Aligner) -> None:
        found = aligner.align(text)
        if found is None:
            self.rows.append((doc_id, 0, 0, 0, 0, ""))
            return
        a, b, last_a, last_b = found
        pairs, times = np.unique(a[last_a] << 32 | b[last_b], return_counts=True)
        digest = hashlib.sha256(aligner.written(*found).encode()).hexdigest()
        self.pairs.append(pairs)
        self.times.append(times)
        self.docs.append(np.full(len(pairs), len(self.rows), dtype=np.int32))
        self.rows.append((doc_id, len(a), len(b), len(last_a), len(last_a), digest))
        self.links += len(pairs)

    def full(self) -> bool:
        return len(self.rows) == CHUNK_DOCS or self.links >= CHUNK_LINKS

    def batches(self) -> Iterator[pa.RecordBatch]:
        def batch(n, **columns):
            kinds = {"doc": pa.int32(), "doc_id": pa.int64(), "groups_sha256": pa.string(), "plane": pa.int32(), "docs": pa.int32(), "bits": pa.binary()}
            kind = lambda c: kinds.get(c, pa.int64())
            cast = lambda c: columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], kind(c))
            made = [cast(c) if c in columns else pa.nulls(n, kind(c)) for c in NAMES]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, self.number)), *made], names=["chunk", *NAMES])

        if self.rows:
            values = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), map(list, zip(*self.rows))))
            yield batch(len(self.rows), doc=np.arange(len(self.rows), dtype=np.int32), **values)
        if not self.pairs:
            return
        pairs, docs, times = (np.concatenate(x) for x in (self.pairs, self.docs, self.times))
        order = np.argsort(pairs, kind="stable")
        pairs, docs, more = pairs[order], docs[order], times[order] - 1

        def postings(plane, pairs, docs):
            starts = np.flatnonzero(np.diff(pairs, prepend=-1))
            sizes = np.diff(starts, append=len(pairs)).astype(np.int32)
            bits = bitmaps(docs, starts)
            for low in range(0, len(starts), 50_000):
                part = slice(low, low + 50_000)
                n = len(starts[part])
                yield batch(n, pair=pairs[starts[part]], plane=np.full(n, plane, dtype=np.int32), docs=sizes[part], bits=bits[part])

        yield from postings(0, pairs, docs)
        plane = 1
        while len(more):
            odd = (more & 1).astype(bool)
            if odd.any():
                yield from postings(plane, pairs[odd], docs[odd])
            left = more > 1
            pairs, docs, more, plane = pairs[left], docs[left], more[left] >> 1, plane + 1


def encoded(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B) -> DataFrame:
    """Rows of documents (``doc`` is set) and postings (``pair`` is set) of all chunks, written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        base = TaskContext.get().partitionId() << 32
        chunk = Chunk(base)
        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunk.add(row, value.as_py(), aligner)
                if chunk.full():
                    yield from chunk.batches()
                    base += 1
                    chunk = Chunk(base)
        yield from chunk.batches()

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return stage(rows.mapInArrow(run, ENCODED))


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, a, b, n_docs, n_links, best): best if no other id of A is linked more often with the pair's id of B."""
    counts = postings.groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("docs")).otherwise(0)).alias("n_docs"), F.sum(F.expr("shiftleft(cast(docs as bigint), greatest(plane - 1, 0))")).alias("n_links"))
    counts = stage(counts.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n_docs", "n_links"))
    most = counts.groupBy("b").agg(F.max("n_links").alias("most"))
    return counts.join(most, "b").select("pair", "a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def documents_of_b(postings: DataFrame) -> DataFrame:
    """(b, n_docs): documents in which an id of B is linked at all, its pairs' bitmaps merged by OR in each chunk."""
    def merged(group: pa.Table) -> pa.Table:
        bits = np.zeros(CHUNK_DOCS, dtype=bool)
        for held in group.column("bits"):
            bits[members(held.as_py())] = True
        return pa.table({"b": group.column("b")[:1], "n": pa.array([int(bits.sum())], pa.int64())})

    rows = postings.where("plane = 0").select("chunk", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "bits")
    return rows.groupBy("chunk", "b").applyInArrow(merged, "b long, n long").groupBy("b").agg(F.sum("n").alias("n_docs"))


def returned(group: pa.Table) -> pa.Table:
    """The documents of a chunk with what its postings bring back."""
    is_doc = np.array(group.column("pair").is_null())
    rows, postings = group.filter(pa.array(is_doc)), group.filter(pa.array(~is_doc)).combine_chunks()
    order = np.argsort(rows.column("doc").to_numpy())
    total, best = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
    if len(postings):
        bits = postings.column("bits").chunk(0)
        offsets = np.frombuffer(bits.buffers()[1], dtype=np.int32)[bits.offset:bits.offset + len(bits) + 1].astype(np.int64)
        weight = 1 << np.maximum(postings.column("plane").to_numpy() - 1, 0).astype(np.int64)
        links, top = weight * postings.column("pair_links").to_numpy(), weight * np.array(postings.column("best")).astype(np.int64)
        width = np.diff(offsets)
        data = np.frombuffer(bits.buffers()[2], dtype=np.uint8)
        for k in np.flatnonzero(width == CHUNK_DOCS // 8).tolist():
            docs = members(data[offsets[k]:offsets[k + 1]].tobytes())
            total[docs] += links[k]
            best[docs] += top[k]
        listed = np.where(width < CHUNK_DOCS // 8, width // 2, 0)
        at = np.repeat(offsets[:-1] - np.cumsum(listed * 2) + listed * 2, listed) + 2 * np.arange(listed.sum())
        docs = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8
        np.add.at(total, docs, np.repeat(links, listed))
        np.add.at(best, docs, np.repeat(top, listed))
    rows = rows.take(pa.array(order))
    keep = {c: rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table({**keep, "n_best": pa.array(best), "count_sum": pa.array(total), "groups_sha256": rows.column("groups_sha256")})


def aligned(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B) -> DataFrame:
    """One row per document: tokens of both sides, groups, links, links with their B id's most frequent partner, the sum of
    the links' counts, and the digest of the groups."""
    made = encoded(documents, doc_id, text, path_a, path_b)
    postings = made.where("pair IS NOT NULL").select(*[c.split()[0] for c in POSTING.split(", ")])
    scores = pair_counts(postings).select("pair", F.col("n_links").alias("pair_links"), "best")
    back = postings.join(scores, "pair").select("chunk", "pair", "plane", "bits", "pair_links", "best")
    rows = made.where("pair IS NULL").select(*[c.split()[0] for c in DOCUMENT.split(", ")])
    return rows.unionByName(back, allowMissingColumns=True).groupBy("chunk").applyInArrow(returned, RESULT)
