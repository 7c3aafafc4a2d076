import random

import pytest
from brute import centroids as brute_centroids

from chorus.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def run(spark, rows, **params):
    out, cents = centroids.cluster(spark.createDataFrame([(i, v, "clash", 0) for i, v in rows], SCHEMA).repartition(3), **params)
    got = sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()], key=lambda r: (r[0] is not None, r))
    for r in out.collect():
        assert r["cluster_inertia"] == sum(g[2] for g in got if g[1] == r["cluster"])
        assert r["inertia"] == sum(g[2] for g in got)
    return got, cents


def vectors(n, seed, dim=64):
    rng = random.Random(seed)
    return [(i, [rng.gauss(i % 5, 0.3) for _ in range(dim)]) for i in range(n)]


def as_floats(rows):
    import numpy as np
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("block", [7, 4096])
def test_equals_brute_force(spark, block):
    rows = as_floats(vectors(300, 1))
    assert run(spark, rows, block=block) == brute_centroids(rows)


def test_only_whole_vectors_are_kept(spark):
    rows = vectors(40, 2)
    rows += [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [1.0] * 63 + [None]), (105, [float("nan")] + [0.0] * 63),
             (106, [float("inf")] + [0.0] * 63), (107, [float("-inf")] + [0.0] * 63)]
    rows = as_floats(rows)
    assert run(spark, rows) == brute_centroids(rows)


def test_repeated_rows_null_ids_and_ties(spark):
    rows = as_floats([(i % 4, [float(i % 3)] * 64) for i in range(30)] + [(None, [0.5] * 64)] * 3)
    assert run(spark, rows) == brute_centroids(rows)  # repeated seeds leave empty clusters, equal distances go to the smaller number


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = as_floats(vectors(3, 4))
    assert run(spark, rows) == brute_centroids(rows)
    assert run(spark, []) == ([], [])


def test_large_components_stay_exact(spark):
    rows = as_floats([(i, [float(i) * 5e4 + j for j in range(64)]) for i in range(12)])
    assert run(spark, rows, rounds=3) == brute_centroids(rows, rounds=3)
