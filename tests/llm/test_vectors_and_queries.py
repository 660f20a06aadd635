"""Exact search against all products; registered queries and the pipeline."""
import math

import numpy as np
import pytest
from check_oracle import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as entrypoint
import corpus_pipeline
from cohortspark.llm import queries, topk


def plain_top(rows, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v):
            vectors.setdefault(i, []).append([math.floor(64 * x) for x in v])
    out = []
    for q in vectors:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(vectors[q][0], v)), i) for i, vs in vectors.items() if i != q for v in vs)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, leaf", [(4_096, 64), (40, 8)])
def test_search(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "LEAF", leaf)
    rng = np.random.default_rng(7)
    near = rng.normal(size=6)
    rows = [(i, (rng.normal(size=6) if i % 3 else near + 0.01 * rng.normal(size=6)).tolist()) for i in range(400)]
    rows += [(500, None), (520, []), (540, [1.0] * 5), (560, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (580, [float("nan")] * 6), (600, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(601 + i, [0.5] * 6) for i in range(30)] + [(620, [0.5] * 6), (700, [0.0] * 6), (740, [0.1] * 6), (740, [0.1] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, d int")
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert got == plain_top(rows, 20)


def test_search_of_little(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0]), (21, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 21, 64 * 64 * 11)]
    assert topk.search(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.search(df.where("vec_id = 21"), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("size", [1e6, 5e5 * 2 ** 10, 2.0 ** 40])
def test_search_of_large_components(spark, size):
    """Products beyond 2**53 that differ in their last bits only, and beyond 2**63."""
    rng = np.random.default_rng(3)
    rows = [(i, (size + rng.integers(0, 4, 6) / 64).tolist()) for i in range(1, 121)]
    rows += [(140, [1e300] + [0.0] * 5), (141, [-size] * 6), (160, [0.015625] * 6)]
    got = sorted(tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).select(
        "query_id", "rank", "vec_id", "score").collect())
    most = (1 << 63) - 1
    vectors = {i: [math.floor(64 * x) for x in v] for i, v in rows if i != 140}
    expected = []
    for q in (i for i in vectors if i % 20 == 0):
        scores = sorted((-max(-most, min(most, sum(a * b for a, b in zip(vectors[q], v)))), i) for i, v in vectors.items() if i != q)
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:20])]
    assert got == sorted(expected)


def test_registered():
    registered = entrypoint.queries()
    assert [n for n in queries.QUERIES if n in registered] == list(queries.QUERIES) and "pipeline" in registered
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, folder, name):
    got = queries.QUERIES[name](spark, folder).toPandas()
    assert compare(got, duck(folder).execute(queries.ORACLE[name]).df()) == ""


def test_pipeline(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[5] > 0
    packed = {i for r in docs.select("doc_ids").collect() for i in r["doc_ids"]}
    mixed = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/source_mixing").select("doc_id").collect()}
    assert packed == mixed
