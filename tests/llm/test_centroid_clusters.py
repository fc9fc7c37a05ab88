"""Sharded Lloyd against a plain one, with its defined results."""

import hashlib
import math

import numpy as np

from stockroom.llm import centroid_clusters as cc

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string"


def plain(rows, clusters, rounds, dimensions):
    kept = [(i, tuple(math.floor(64 * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) and abs(x) < cc.MOST for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in start[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(column) // len(m) for column in zip(*m, strict=True)] if m else c for m, c in zip(members, centroids, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    of = [sum(d for _, k, d in found if k == c) for c in range(len(centroids))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, k, d, of[k], sum(of), shas[k]) for i, k, d in found], key=str)


def run(spark, rows, clusters, rounds, dimensions, shards):
    vectors = spark.createDataFrame([(*row, 9, "x") for row in rows], SCHEMA)
    out = cc.centroid_clusters(vectors, clusters, rounds, dimensions=dimensions, shards=shards)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_equals_plain_lloyd(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(0, 2, (200, 6)))]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 7)]
    rows += [(304, [float("nan"), *[0.0] * 5]), (305, [float("-inf"), *[0.0] * 5]), (306, [None, *[0.0] * 5]), (307, [3e30, *[0.0] * 5]), (308, [2.0**20, *[0.0] * 5])]
    rows += [(400 + i, [0.5, -0.5, 0.0, 0.25, 1.0, -1.0]) for i in range(90)]  # a third of all vectors
    for clusters, shards in ((7, 4), (3, 1), (5, 6)):
        assert run(spark, rows, clusters, 3, 6, shards) == plain(rows, clusters, 3, 6)


def test_ties_empty_clusters_and_few_vectors(spark):
    same = [(i, [1.0, 1.0]) for i in range(6)]  # equal centroids: number 0 takes all, the others stay empty
    assert run(spark, same, 4, 2, 2, 2) == plain(same, 4, 2, 2)
    assert {r[1] for r in run(spark, same, 4, 2, 2, 2)} == {0}
    two = [(1, [0.0, 3.0]), (2, [-0.01, 0.0])]
    assert run(spark, two, 16, 3, 2, 2) == plain(two, 16, 3, 2)
    assert run(spark, [], 4, 2, 2, 2) == run(spark, [(1, None)], 4, 2, 2, 2) == []
