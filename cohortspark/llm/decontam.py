"""Benchmark decontamination over a positional inverted index.

Texts are lower-cased (A-Z) and cut into words of digits, letters and characters beyond ASCII. A window is
``length`` consecutive words of an item (all words of a shorter one). The search follows an inverted index:

1. count the corpus occurrences of the words of all items;
2. in each window take its two rarest words, ties to the left; windows with a word the corpus lacks cannot occur;
3. store the postings (word, document, position) of those words only;
4. subtract the word's place in the item: a posting then names where the item would start in the document, and the lists of
   the rarest and of the second rarest word are intersected on (item, document, start);
5. compare the words of the surviving documents with the item around that start.

Every step is a DataFrame plan. The words of the items are broadcast only if they are counted to be at most
``BROADCAST_WORDS``; beyond that the join shuffles. A common word is the rarest of its window only if all others are
as common, and its postings are then spread by Spark's skew handling, for no step groups by word.

Defined cases: NULL and texts without words have no windows and no hits; repeated documents are judged row by
row; a repeated item counts once; an item without id marks words but is in no list of items; an empty
table on either side gives no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import plain_words, stage

LENGTH = 10
#: Most words of items that are sent to every executor: some 20 MB.
BROADCAST_WORDS = 200_000


def _small(words: DataFrame) -> DataFrame:
    return F.broadcast(words) if words.count() <= BROADCAST_WORDS else words


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), plain_words(F.col(text)).alias("item_words"))
    return items.where(F.size("item_words") > 0).distinct().withColumn("item", F.xxhash64("item_id", "item_words"))


def postings(documents: DataFrame, doc_id: str, text: str, words: DataFrame) -> DataFrame:
    """Positional index (word, doc_id, position) of the given words over all documents."""
    tokens = documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(plain_words(F.col(text))).alias("position", "word"))
    return tokens.join(_small(words), "word", "left_semi")


def rarest_words(documents: DataFrame, text: str, items: DataFrame, length: int, keep: int = 2) -> DataFrame:
    """(item, order, place, word): the ``keep`` rarest words of each window, order 0 the rarest."""
    places = items.select("item", F.posexplode("item_words").alias("place", "word"))
    vocabulary = stage(places.select("word").distinct())
    tokens = documents.select(F.explode(plain_words(F.col(text))).alias("word"))
    counts = tokens.join(_small(vocabulary), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = places.join(counts, "word").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("place", "n", "word"))).alias("known"))
    sized = items.select("item", F.size("item_words").alias("size")).join(ranked, "item")
    windows = sized.withColumn("width", F.least(F.lit(length), "size")).select(
        "item", "known", "width", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("width"))).alias("start"))
    inside = F.filter("known", lambda k: (k["place"] >= F.col("start")) & (k["place"] < F.col("start") + F.col("width")))
    whole = windows.withColumn("inside", inside).where(F.size("inside") == F.col("width"))
    by_count = F.array_sort(F.transform("inside", lambda k: F.struct(k["n"].alias("n"), k["place"].alias("place"), k["word"].alias("word"))))
    return whole.select("item", F.posexplode(F.slice(by_count, 1, keep)).alias("order", "rare")).select(
        "item", "order", "rare.place", "rare.word").distinct()


def candidates(documents: DataFrame, doc_id: str, text: str, items: DataFrame, length: int) -> DataFrame:
    """(doc_id, item, start): where the lists of the two rarest words of a window agree on the item's start."""
    rare = stage(rarest_words(documents, text, items, length))
    index = stage(postings(documents, doc_id, text, rare.select("word").distinct()))
    starts = lambda order: index.join(rare.where(F.col("order") == order), "word").select(
        "doc_id", "item", (F.col("position") - F.col("place")).alias("start")).distinct()
    # A one-word window has no second word: its first list stands for both.
    one_word = items.where(F.size("item_words").between(1, 1) | F.lit(length == 1)).select("item")
    second = starts(1).unionByName(starts(0).join(one_word, "item", "left_semi"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.item") == F.col("b.item")) & (F.col("a.start") == F.col("b.start"))
    return starts(0).alias("a").join(second.alias("b"), same, "left_semi")


def _verified(words: Column, candidate: Column, length: int) -> Column:
    """Positions of the document that lie in a window of the candidate's item."""
    item, first = candidate["item_words"], candidate["start"]
    width = F.least(F.lit(length), F.size(item))
    equal = F.transform(item, lambda w, i: F.coalesce(F.get(words, first + i) == w, F.lit(False)))
    found = F.filter(F.sequence(F.lit(0), F.size(item) - width), lambda j: F.forall(F.slice(equal, j + 1, width), lambda e: e))
    return F.flatten(F.transform(found, lambda j: F.sequence(first + j, first + j + width - 1)))


def _judged(documents: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, length: int, carry: list[str]) -> DataFrame:
    """(kept, a struct of the carried columns; words, hits)."""
    items = stage(_items(benchmark, item_id, item_text))
    found = candidates(documents, doc_id, text, items, length).join(items, "item")
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "start", "item_words")).alias("found"))
    found = found.withColumnRenamed("doc_id", "found_id")
    whole = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("kept"))
    # As a generator's output the words are computed once per row; as a projection a later filter would repeat them per position.
    judged = whole.join(found, whole["doc_id"].eqNullSafe(F.col("found_id")), "left").select("kept", F.explode(F.array(plain_words(F.col("text")))).alias("words"), "found")
    judged = judged.withColumn("hits", F.transform("found", lambda c: F.struct(c["item_id"].alias("item_id"), _verified(F.col("words"), c, length).alias("at"))))
    return judged.select("kept", "words", F.filter("hits", lambda h: F.size(h["at"]) > 0).alias("hits"))


def phrase_matches(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", length: int = LENGTH,
) -> DataFrame:
    """One row per document: doc_id, n_words, positions in a window (sorted), item_ids with such windows (sorted)."""
    none = lambda kind: F.array().cast(kind)
    return _judged(documents, benchmark, doc_id, text, item_id, item_text, length, [doc_id]).select(
        F.col(f"kept.`{doc_id}`").alias("doc_id"), F.size("words").cast("long").alias("n_words"),
        F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["at"])))), none("array<int>")).alias("positions"),
        F.coalesce(F.array_compact(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))), none("array<string>")).alias("item_ids"))


def uncontaminated(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", length: int = LENGTH,
) -> DataFrame:
    """The rows of ``documents``, all columns, in which no window of an item occurs."""
    judged = _judged(documents, benchmark, doc_id, text, item_id, item_text, length, documents.columns)
    return judged.where(F.coalesce(F.size("hits"), F.lit(0)) < 1).select("kept.*")


def proximity_matches(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", length: int = LENGTH, slop: int = 5,
) -> DataFrame:
    """(doc_id, item_id, position): the two rarest words of a window stand within ``slop`` words of their distance in
    it, at most ``slop`` words were put in or left out between them. ``position`` is that of the rarest word.

    Starts implied by the two words are put in cells of ``slop`` + 1; only neighbouring cells are compared."""
    items = stage(_items(benchmark, item_id, item_text))
    rare = stage(rarest_words(documents, text, items, length))
    index = stage(postings(documents, doc_id, text, rare.select("word").distinct()))
    at = lambda order: index.join(rare.where(F.col("order") == order), "word").select(
        "doc_id", "item", "position", (F.col("position") - F.col("place")).alias("start"))
    cell = F.floor(F.col("start") / (slop + 1))
    first = at(0).withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    second = at(1).withColumn("cell", cell).withColumnRenamed("start", "other").withColumnRenamed("doc_id", "other_id").drop("position")
    second = second.withColumnsRenamed({"item": "other_item", "cell": "other_cell"})
    near = first.join(second, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("item") == F.col("other_item")) & (F.col("cell") == F.col("other_cell")))
    near = near.where(F.abs(F.col("start") - F.col("other")) <= slop)
    return near.select("doc_id", "item", "position").distinct().join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "position")


def digest(matches: DataFrame) -> DataFrame:
    return matches.select(
        "doc_id", "n_words", F.size("positions").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("positions") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
iw AS (
  SELECT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS p FROM d, (SELECT DISTINCT n FROM iw))),
hit AS (SELECT DISTINCT doc_id, p, n, item_id FROM dw JOIN iw USING (n, k)),
places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""
