"""Collocations: frequent phrases of two to four words, counted by a multikey three-way quicksort of suffix pointers.

A-Z is lowered, texts are cut at punctuation and line ends into pieces, pieces at blanks and tabs into words. A suffix is a
word with the up to three words after it in its piece.

1. Words are counted per language. A bit map of those that are frequent goes to every executor; it has a fixed size
   and may hold a word too much, never one too few, so it only saves work.
2. Leading pairs of words that may both be frequent are counted by hash. That gives a bit map of the frequent ones and one of
   the pairs too frequent to be sorted by one task.
3. Every suffix that begins with a frequent pair, cut where the next pair is infrequent, is routed by its two leading words
   to a bucket, after equal suffixes of a chunk of text were counted together. A bucket then holds all suffixes of its leading
   words: their pointers are sorted word by word, less, equal and greater apart, and the size of an equal part at depth d is
   the exact frequency of its d leading words. Parts below the least frequency are abandoned.
4. Suffixes of a pair in the second bit map would overfill a bucket. Their leading words of each length are added up by a plain
   aggregate instead, which Spark combines before the shuffle.
5. Each candidate is cut into a first part and a rest, both of them counted above, and takes the lowest score of its cuts.

The maps decide only where a suffix is counted and what is skipped; words are compared as words, so the counts are exact at
every size. Products are decimals. Buckets are sized by the number of suffixes, so a task's memory does not grow.

Defined cases: NULL is the empty text and has no words; a NULL lang is ``und``; repeated rows count as often as they occur; an
empty table gives no rows; equal scores go by count, then by the bytes of the phrase; other columns and the ids are ignored. A
piece without any punctuation is held whole by the task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import LOWER, stage

LEAST = 30
DEPTH = 4
TOP = 2000
SCALE = 2_000_000
#: Per cent of its occurrences from which a phrase inside a longer one is dropped.
INSIDE = 80
#: Bytes of text sorted at a time, bits of each map (8 MB), suffixes of a bucket.
CHUNK = 4 << 20
MARKS = 1 << 26
BUCKET = 150_000
#: Copies of a short phrase's count, among which the phrases that it begins or ends are dealt.
SALTS = 16

#: A byte that no text holds stands for the end of a piece.
END = b"\xff"
PIECES = bytes(END[0] if b in b".,;:!?\n\x0b\x0c\r" else b for b in LOWER)
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """(lang, text): lowered texts of one language put together, pieces closed by END; a long text is cut between pieces."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py().translate(PIECES)
            while len(text) > size and (cut := text.find(END, size)) >= 0:
                yield lang, text[:cut]
                text = text[cut:]
            held.setdefault(lang, []).append(text)
            total += len(text)
            if total >= size:
                yield from ((k, END.join(v)) for k, v in held.items())
                held, total = {}, 0
    yield from ((k, END.join(v)) for k, v in held.items())


class Words:
    """The words of a chunk: a dictionary, and per place the number of its word (-1 at the end of a piece)."""

    def __init__(self, lang: str, text: bytes):
        # No byte of white space is left but blank and tab, since all others end a piece.
        tokens = pa.array(text.replace(END, b" " + END + b" ").split(), pa.binary()).dictionary_encode()
        self.dictionary = tokens.dictionary
        self.at = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        end = self.dictionary.index(END).as_py()
        if end >= 0:
            self.at[self.at == end] = -1
        self.lang, self.prefix = lang, lang.encode() + b"\0"

    def hashes(self) -> np.ndarray:
        """A hash of (lang, word) per word, and zero for the end of a piece as the last."""
        return np.array([xxhash.xxh64_intdigest(self.prefix + w, 42) for w in self.dictionary.to_pylist()] + [0], dtype=np.uint64)

    def marked(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose word and next word may be frequent, and the hash of each such pair."""
        h = self.hashes()
        known = has(marks, h)
        known[-1] = False
        both = np.flatnonzero(known[self.at[:-1]] & known[self.at[1:]])
        pair = h[self.at[both]] * FIRST
        pair ^= pair >> np.uint64(29)
        pair = (pair + h[self.at[both + 1]]) * SECOND
        return both, pair ^ (pair >> np.uint64(32))


def has(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(len(marks) * 8 - 1)).astype(np.int64)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_map(rows: DataFrame, value: Column, bits: int):
    """Broadcast map with the low bits of each 64-bit value set; ``bits`` is its whole size, whatever the table's."""
    mark = F.pmod(value, F.lit(bits)) + 1  # Spark counts the bits of a map from one.
    found = rows.select(mark.alias("mark")).groupBy(F.bitmap_bucket_number("mark").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("bits")).collect()
    made = np.zeros(bits // 8, dtype=np.uint8)
    for r in found:
        low = (r["bucket"] - 1) << 12
        made[low:low + (1 << 12)] = np.frombuffer(r["bits"], dtype=np.uint8)[:bits // 8 - low]
    return rows.sparkSession.sparkContext.broadcast(made)


def read(documents: DataFrame, text: str, lang: str) -> DataFrame:
    return documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def word_counts(texts: DataFrame, chunk: int) -> DataFrame:
    """(lang, word, f) of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in chunks(batches, chunk):
            words = Words(lang, text)
            n = np.bincount(words.at[words.at >= 0], minlength=len(words.dictionary))
            kept = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kept), pa.string()), words.dictionary.take(pa.array(kept)).cast(pa.string()), pa.array(n[kept])], names=["lang", "word", "n"])

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def pair_counts(texts: DataFrame, words, chunk: int) -> DataFrame:
    """(pair, n): occurrences of the hashes of leading pairs whose words may both be frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in chunks(batches, chunk):
            pair, n = np.unique(Words(lang, text).marked(words.value)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n)], names=["pair", "n"])

    return texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


SUFFIX = "bucket long, lang string, w0 string, w1 string, w2 string, w3 string, n long"


def suffixes(texts: DataFrame, words, pairs, hot, buckets: int, chunk: int) -> DataFrame:
    """Suffixes that begin with a frequent pair, equal ones of a chunk counted together. Those of a pair in ``hot`` have no
    bucket and come once per length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in chunks(batches, chunk):
            made = Words(lang, text)
            place, pair = made.marked(words.value)
            kept = has(pairs.value, pair)
            place, pair = place[kept], pair[kept]
            if not len(place):
                continue
            known, number = np.unique(pair, return_inverse=True)
            wide = has(hot.value, known)
            # The rank of each place's pair, -1 where none begins; a suffix goes on as long as one begins at its next word.
            rank = np.full(len(made.at) + DEPTH, -1, dtype=np.int64)
            rank[place] = number
            third, fourth = rank[place + 1] >= 0, (rank[place + 1] >= 0) & (rank[place + 2] >= 0)
            at = np.append(made.at, np.full(DEPTH, -1))
            word2, word3 = np.where(third, at[place + 2], -1), np.where(fourth, at[place + 3], -1)

            def counted(which: np.ndarray, depth: int, routed: bool) -> pa.RecordBatch:
                start, w2, w3 = place[which], (word2 if depth > 2 else np.full_like(word2, -1))[which], (word3 if depth > 3 else np.full_like(word3, -1))[which]
                base = len(made.dictionary) + 1
                order = np.lexsort((w2 * base + w3, at[start] * base + at[start + 1]))
                start, w2, w3 = start[order], w2[order], w3[order]
                columns = [at[start], at[start + 1], w2, w3]
                new = np.flatnonzero(np.append(True, np.any([np.diff(c) != 0 for c in columns], axis=0))) if len(start) else np.zeros(0, dtype=np.int64)
                n = np.diff(new, append=len(start))
                text_of = lambda c: made.dictionary.take(pa.array(c[new], mask=c[new] < 0)).cast(pa.string())
                bucket = pa.array((known[rank[start[new]]] % np.uint64(buckets)).astype(np.int64), mask=np.full(len(new), not routed))
                return pa.RecordBatch.from_arrays([bucket, pa.array([lang] * len(new), pa.string()), *map(text_of, columns), pa.array(n)], names=["bucket", "lang", "w0", "w1", "w2", "w3", "n"])

            split = wide[number]
            yield counted(~split, DEPTH, True)
            if split.any():
                yield counted(split, 2, False)
                yield counted(split & third, 3, False)
                yield counted(split & fourth, 4, False)

    return texts.mapInArrow(run, SUFFIX)


def multikey_quicksort(keys: list[np.ndarray], weight: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, pointer, size) of every equal part of at least ``least``: the suffixes that agree in their first ``depth`` keys.
    ``keys[d]`` has the word at depth d of each suffix, -1 where it has ended; parts that are too small are not sorted on."""
    todo = [(np.flatnonzero(keys[0] >= 0), 0)]
    while todo:
        part, depth = todo.pop()
        if weight[part].sum() < least:
            continue
        key = keys[depth][part]
        low, middle, high = key[0], key[len(key) // 2], key[-1]
        pivot = max(min(low, middle), min(max(low, middle), high))
        equal = key == pivot
        if not equal.all():
            less = key < pivot
            todo += [(part[less], depth), (part[~less & ~equal], depth)]
            part = part[equal]
        size = int(weight[part].sum())
        if size < least:
            continue
        yield depth + 1, int(part[0]), size
        if depth + 1 < len(keys):
            todo.append((part[keys[depth + 1][part] >= 0], depth + 1))


def sorted_bucket(least: int):
    def run(group: pa.Table) -> pa.Table:
        columns = [pa.chunked_array([c for w in ("lang", "w0", "w1", "w2", "w3") for c in group.column(w).chunks], pa.string()).combine_chunks().dictionary_encode()]
        numbers = columns[0].indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).reshape(5, -1)
        dictionary = columns[0].dictionary
        # The language leads: it is the key at depth zero.
        found = [x for x in multikey_quicksort(list(numbers), group.column("n").to_numpy(), least) if x[0] > 2]
        depth, pointer, size = (np.array(x, dtype=np.int64) for x in (zip(*found) if found else ((), (), ())))
        shown = [np.where(depth > d, numbers[d][pointer], -1) for d in range(5)]
        words = [dictionary.take(pa.array(c, mask=c < 0)) for c in shown]
        phrase = pc.binary_join_element_wise(*words[1:], " ", null_handling="skip")
        return pa.table({"lang": words[0], "phrase": phrase, "words": pa.array((depth - 1).astype(np.int32)), "f": pa.array(size)})

    return run


def frequent_phrases(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, bucket: int = BUCKET, chunk: int = CHUNK, marks: int = MARKS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of one to four words that occur ``least`` times, and (lang, n) with all words."""
    texts = read(documents, text, lang)
    counts = stage(word_counts(texts, chunk))
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    single = counts.where(F.col("f") >= least)
    frequent_words = bit_map(single, F.xxhash64(F.concat("lang", F.lit("\0"), "word")), marks)
    pairs = stage(pair_counts(texts, frequent_words, chunk).where(F.col("n") >= least))
    frequent_pairs, hot = bit_map(pairs, F.col("pair"), marks), bit_map(pairs.where(F.col("n") > bucket), F.col("pair"), marks)
    size = pairs.agg(F.sum("n")).first()[0] or 0
    routed = stage(suffixes(texts, frequent_words, frequent_pairs, hot, max(1, -(-size // bucket)), chunk))
    names = ["w0", "w1", "w2", "w3"]
    by_sort = routed.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(sorted_bucket(least), "lang string, phrase string, words int, f long")
    by_sum = routed.where("bucket IS NULL").groupBy("lang", *names).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    by_sum = by_sum.select("lang", F.concat_ws(" ", *names).alias("phrase"), sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0)).alias("words"), "f")
    return stage(single.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f").unionByName(by_sort).unionByName(by_sum)), totals


def _with_count(rows: DataFrame, known: DataFrame, part: str, name: str) -> DataFrame:
    """``rows`` with the count of the phrase in ``part``; a part that many rows share is dealt among salts.

    Spark takes an exploded table to be as large as its file and would send all the copies through the driver, hence the hint."""
    salted = known.select(F.col("lang").alias("known_lang"), "phrase", F.col("f").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    on = (F.col("lang") == F.col("known_lang")) & (F.col(part) == salted["phrase"]) & (F.pmod(F.xxhash64("candidate"), F.lit(SALTS)) == F.col("salt"))
    return rows.join(salted.hint("merge"), on).drop("known_lang", "phrase", "salt")


def scored(phrases: DataFrame, inside: int = INSIDE) -> DataFrame:
    """(lang, phrase, a, l, r, score): the lowest cut of every phrase of two words or more that no longer one contains."""
    longer = phrases.where("words > 1").withColumnRenamed("phrase", "candidate").withColumnRenamed("f", "a").withColumn("w", F.split("candidate", " "))
    span = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    cuts = longer.select("lang", "candidate", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "candidate", "a", "k", span(F.lit(1), F.col("k")).alias("head"), span(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = _with_count(_with_count(cuts, phrases.where(f"words < {DEPTH}"), "head", "l"), phrases.where(f"words < {DEPTH}"), "rest", "r")
    score = F.expr(f"(cast({SCALE} as decimal(8,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.groupBy("lang", "candidate").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("cut"))
    parts = longer.where("words > 2").select("lang", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    parts = parts.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("first"))
    held = parts.select(F.col("lang").alias("in_lang"), span(F.col("first"), F.col("size")).alias("part"), "a").groupBy("in_lang", "part").agg(F.max("a").alias("most"))
    left = best.join(held.hint("merge"), (F.col("lang") == F.col("in_lang")) & (F.col("candidate") == F.col("part")), "left")
    product = lambda factor, c: F.lit(factor).cast("decimal(3,0)") * F.col(c).cast("decimal(19,0)")
    left = left.where(F.col("most").isNull() | (product(100, "most") < product(inside, "cut.a")))
    return left.select("lang", F.col("candidate").alias("phrase"), "cut.a", "cut.l", "cut.r", "cut.score")


def mine(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(documents, text, lang, least)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(phrases).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(pieces), '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (
  SELECT lang, m, array_to_string(w[s : s + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM p, (SELECT unnest(range(1, 5)) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (
  SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : m], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (
  SELECT k.lang, k.phrase, k.a, x.a AS l, y.a AS r, k.k, CAST((2000000 * CAST(k.a AS HUGEINT)) // (x.a + y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.head JOIN f y ON y.lang = k.lang AND y.phrase = k.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, array_to_string(w[s : s + z - 1], ' ') AS part, max(a) AS most
  FROM (SELECT *, unnest(range(1, m - z + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS z FROM c WHERE m > 2)) GROUP BY ALL),
q AS (
  SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.part = b.phrase WHERE i.most IS NULL OR 100 * CAST(i.most AS HUGEINT) < 80 * CAST(b.a AS HUGEINT))
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS INTEGER) AS rank, phrase, a, l, r, n, score
FROM q JOIN n USING (lang) QUALIFY rank <= 2000
"""
