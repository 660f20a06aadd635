"""Many k and starts in shared passes: brute force, the library's silhouette, defined cases."""
import hashlib

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortspark.models import kmeans
from cohortspark.session import materialize

GRID = (2, 3, 4, 5)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    return np.concatenate([rng.normal(c, 0.4, (60, 3)) for c in ((0, 0, 0), (3, 0, 1), (0, 3, -1), (3, 3, 2))])


@pytest.fixture(scope="module")
def vectors(spark, points):
    rows = [(i, x.tolist()) for i, x in enumerate(points)]
    rows += [(900, None), (901, [1.0, float("nan"), 0.0]), (902, [1.0, None, 0.0]), (903, [float("inf"), 0.0, 0.0])]
    return materialize(kmeans.usable(spark.createDataFrame(rows, "id long, features array<double>").repartition(5)))


def plain_seeds(points, most, starts, seed):
    out = []
    for s in range(starts):
        mine = []
        for step in range(most):
            u = np.array([int(hashlib.md5(f"{seed}:{step}:{s}:{i}".encode()).hexdigest()[:15], 16) for i in range(len(points))])
            left = np.min([((points - m) ** 2).sum(axis=1) for m in mine], axis=0) if mine else np.ones(len(points))
            with np.errstate(divide="ignore"):
                mine.append(points[np.argmin(-np.log((u + 0.5) / 2.0 ** 60) / left)])
        out.append(mine)
    return np.array(out)


def plain_lloyd(points, centres):
    for _ in range(kmeans.MAX_ITERATIONS + 1):
        away = ((points[:, None] - centres) ** 2).sum(axis=2)
        own = away.argmin(axis=1)
        moved = np.array([points[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centres)])
        if ((moved - centres) ** 2).sum(axis=1).max() <= kmeans.TOLERANCE ** 2:
            break
        centres = moved
    return away.min(axis=1).sum(), np.bincount(own, minlength=len(centres))


def test_seeds_and_fits_equal_brute_force(vectors, points):
    seeds = kmeans.seeds(vectors, "id", 5, 3, seed=9)
    assert np.allclose(seeds, plain_seeds(points, 5, 3, 9))
    fits = kmeans.fit(vectors, "id", GRID, 3, seed=9)
    for k in GRID:
        runs = [plain_lloyd(points, seeds[s][:k]) for s in range(3)]
        best = min(range(3), key=lambda s: runs[s][0])
        assert np.isclose(fits[k].inertia, runs[best][0]) and (fits[k].sizes == runs[best][1]).all()


def test_assignment_and_silhouette(vectors):
    fits = kmeans.fit(vectors, "id", GRID, 10)
    measured = ClusteringEvaluator(featuresCol="v", predictionCol="prediction")
    for k, own in zip(GRID, kmeans.silhouettes(vectors, [fits[k] for k in GRID])):
        rows = vectors.withColumn("prediction", kmeans.nearest(fits[k])).withColumn("v", array_to_vector("features"))
        assert {r["prediction"]: r["count"] for r in rows.groupBy("prediction").count().collect()} == dict(enumerate(fits[k].sizes))
        assert np.isclose(measured.evaluate(rows), own)
        model = KMeans(k=k, seed=1, featuresCol="v", predictionCol="p").fit(rows)
        assert fits[k].inertia <= model.summary.trainingCost * 1.0001


def test_partitions_do_not_matter(vectors):
    a, b = (kmeans.fit(v, "id", (3,), 2)[3] for v in (vectors, vectors.repartition(1)))
    assert np.allclose(a.centres, b.centres) and a.start == b.start


def test_few_or_no_points(spark):
    schema = "id long, features array<double>"
    assert kmeans.fit(spark.createDataFrame([], schema), "id", (2, 3), 2) == {}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(7)] + [(None, [1.0, 2.0])], schema)
    fits = kmeans.fit(same, "id", (2, 3), 2)
    assert [sorted(fits[k].sizes) for k in (2, 3)] == [[0, 8], [0, 0, 8]] and fits[3].inertia == 0
    assert kmeans.silhouettes(same, [fits[2], fits[3]]) == [None, None]
    two = spark.createDataFrame([(0, [0.0]), (1, [5.0])], schema)
    fits = kmeans.fit(two, "id", (2, 3), 2)
    assert sorted(fits[3].sizes) == [0, 1, 1] and kmeans.silhouettes(two, [fits[3]]) == [0.0]
    assert two.select(F.countDistinct(kmeans.nearest(fits[2]))).first()[0] == 2
