"""Toxicity by compression distance: a toxic and an ordinary zstandard dictionary, window lengths, calibrated thresholds.

A window is one word (digits, letters and characters beyond ASCII, A-Z lowered) behind a fixed filler that both dictionaries
hold; the filler keeps every frame compressible, so that lengths differ byte by byte instead of falling back to stored
blocks. A window's distance is its compressed length with the ordinary dictionary minus that with the toxic one. The
shares and counts of windows at or above each of eight thresholds enter a logistic regression fitted on training
documents that the dictionaries have not seen, which gives a score in 0 to 1.

Dictionaries are raw-content ones. The toxic one holds the words whose document frequency among toxic training rows
exceeds that among ordinary ones most; the ordinary one the words most frequent among ordinary rows; the most telling stand
last, where offsets are shortest. (The trainer that comes with the library rewards what both classes share.)

Bounds: at most ``LABELLED_ROWS`` labelled rows, those of the smallest md5 of the id, are used for fitting; their word counts
are computed in Spark, at most ``TOXIC_WORDS`` and ``ORDINARY_WORDS`` words and the calibration rows' features reach the
driver. Every document is scored whole, in the task that reads it; equal words are compressed once per cache of a worker.

Defined cases: NULL and empty texts have no windows and get the score of zero shares; labels other than 0 and 1 are ignored,
several labels of one id count as the largest; without both classes among the training labels every score is the share of
toxic ones (0 without labels); repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import LOWER, LOWER_WORDS, crc_fold, plain_words, stage

LABELLED_ROWS = 24_000
TOXIC_WORDS = 1_000
ORDINARY_WORDS = 2_000
LEAST_DOCUMENTS = 3
LONGEST_WORD = 48
LEVEL = 9
THRESHOLDS = 8
CACHE = 200_000
FILLER = b"0123456789abcdefghijklmnopqrstuvwxyz~~~~"
PENALTY = 1.0


class Distances(dict):
    """Word -> distance, held for at most ``CACHE`` words."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        made = [zstandard.ZstdCompressor(
            level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False,
            dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for d in (ordinary, toxic)]
        self.ordinary, self.toxic = made

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        window = FILLER + b"  " + word + b" "
        found = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
        self[word] = found
        return found


def features(text: bytes, distances: Distances) -> np.ndarray:
    """Shares and counts at or above each threshold, the largest and the second largest distance, a constant."""
    words = text.translate(LOWER).translate(LOWER_WORDS).split()
    seen = np.fromiter(map(distances.__getitem__, words), dtype=np.int64, count=len(words))
    counts = np.bincount(np.clip(seen, 0, THRESHOLDS), minlength=THRESHOLDS + 1)
    above = counts[::-1].cumsum()[::-1][1:]
    top = np.sort(seen)[-2:] if len(seen) else np.zeros(1)
    return np.concatenate([np.log1p(1000 * above / max(len(words), 1)), np.log1p(above), [top.max() / THRESHOLDS, top.mean() / THRESHOLDS, 1.0]])


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    prior: float

    def score(self, found: np.ndarray) -> float:
        if not self.weights:
            return self.prior
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, float(found @ np.array(self.weights))))))


def dictionary(words: list[str]) -> bytes:
    """Raw content with the first, most telling word last."""
    return b" " + b" ".join(w.encode() for w in reversed(words)) + b" " + FILLER


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + PENALTY * np.eye(len(w)), x.T @ (p - y) + PENALTY * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _featured(rows: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """``keep`` columns and the feature list of each row with a binary ``text``."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model.toxic, model.ordinary)
        for batch in batches:
            found = [features(t.as_py(), distances) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "found"])

    return rows.select(*keep, "text").mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "found array<double>"]))


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", folds: int = 5) -> Model:
    """Learn from labelled rows outside fold 0; fold 1 calibrates, the others fill the dictionaries."""
    known = labels.where(F.col(toxic).isin(0, 1)).groupBy(F.col(doc_id).alias("label_id")).agg(F.max(toxic).cast("int").alias("toxic"))
    fold = crc_fold(F.col("label_id"), folds)
    order = F.md5(F.coalesce(F.col("label_id").cast("string"), F.lit("")).cast("binary"))
    sample = known.where(fold != 0).withColumn("calibrates", fold == 1).orderBy(order, "label_id").limit(LABELLED_ROWS)
    whole = documents.select(F.col(doc_id).alias("label_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = stage(whole.join(F.broadcast(sample), "label_id").select("toxic", "calibrates", "text"))
    sizes = {(r["calibrates"], r["toxic"]): r["n"] for r in rows.groupBy("calibrates", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda kind: sum(n for (_, t), n in sizes.items() if t == kind)
    if not of(1) or not of(0):
        return Model(b"", b"", (), of(1) / max(of(0) + of(1), 1))
    spread = all(sizes.get((c, t)) for c in (True, False) for t in (0, 1))
    learns = rows.where(~F.col("calibrates")) if spread else rows
    n = [sizes[False, t] if spread else of(t) for t in (0, 1)]
    words = learns.select("toxic", F.explode(F.array_distinct(plain_words(F.col("text")))).alias("word")).where(F.length("word") <= LONGEST_WORD)
    counts = words.groupBy("word").agg(F.sum(F.col("toxic")).alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    ratio = ((F.col("t") + 0.5) / (n[1] + 1)) / ((F.col("o") + 0.5) / (n[0] + 1))
    telling = counts.where((F.col("t") >= LEAST_DOCUMENTS) & (ratio > 4)).orderBy((F.col("t") * F.log(ratio)).desc(), "word").limit(TOXIC_WORDS)
    common = counts.where("o > 0").orderBy(F.desc("o"), "word").limit(ORDINARY_WORDS)
    made = Model(*[dictionary([r["word"] for r in d.select("word").collect()]) for d in (telling, common)], weights=(), prior=0.0)
    judged = rows.where("calibrates") if spread else rows
    seen = _featured(judged.withColumn("text", F.col("text").cast("binary")), ["toxic"], made).collect()
    weights = logistic(np.array([r["found"] for r in seen]), np.array([r["toxic"] for r in seen], dtype=float))
    return Model(made.toxic, made.ordinary, tuple(weights.tolist()), of(1) / (of(0) + of(1)))


def score(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", folds: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model.toxic, model.ordinary)
        for batch in batches:
            scores = [model.score(features(t.as_py(), distances)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), (crc_fold(F.col(doc_id), folds) == 0).alias("held_out"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns, whose score is below one half."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model.toxic, model.ordinary)
        for batch in batches:
            kept = [model.score(features((t.as_py() or "").encode(), distances)) < 0.5 for t in batch.column(text)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
