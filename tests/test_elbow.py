"""All values of k in one scan against separate fits from the same starts."""

import hashlib
import math
import random

import numpy as np
import pytest
from presslens.operators import elbow

SCHEMA = "orig_index bigint, embedding array<double>"


def points(n, dims=5, seed=3):
    rnd = random.Random(seed)
    middle = [[rnd.gauss(0, 4) for _ in range(dims)] for _ in range(6)]
    return [(i, [c + rnd.gauss(0, 1) for c in middle[rnd.randrange(6)]]) for i in range(n)]


def lloyd(rows, k, steps, seed=42, tol=0.0):
    order = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}:{seed}".encode()).hexdigest(), r[0]))
    X = np.array([e for _, e in rows], float)
    C = np.array([e for _, e in order[:k]], float)
    for _ in range(steps):
        own = ((X[:, None] - C[None]) ** 2).sum(2).argmin(1)
        new = np.array([X[own == i].mean(0) if (own == i).any() else C[i] for i in range(len(C))])
        if not np.sqrt(((new - C) ** 2).sum(1)).max() > tol:
            break
        C = new
    return ((X[:, None] - C[None]) ** 2).sum(2).min(1).sum()


def test_equal_to_separate_fits_and_scans_do_not_multiply(spark, monkeypatch):
    rows = points(400)
    scans = []
    real = elbow._pass
    monkeypatch.setattr(elbow, "_pass", lambda r, c: scans.append(len(c)) or real(r, c))
    ks = range(2, 51)
    got = {r["k"]: r["inertia"] for r in elbow.elbow_one_scan(spark.createDataFrame(rows, SCHEMA).repartition(4), ks, max_iter=6, tol=1e-9).collect()}
    assert set(got) == set(ks) and len(scans) <= 7 and scans[0] == 49
    for k in (2, 3, 7, 20, 50):
        assert got[k] == pytest.approx(lloyd(rows, k, 6, tol=1e-9), rel=1e-9)


def test_mini_batches_come_close_to_whole_steps(spark):
    rows = points(600)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r["k"]: r["inertia"] for r in elbow.elbow_one_scan(df, [1, 4, 6], max_iter=20).collect()}
    part = {r["k"]: r["inertia"] for r in elbow.elbow_one_scan(df, [1, 4, 6], max_iter=20, batches=4).collect()}
    for k in whole:
        assert part[k] == pytest.approx(whole[k], rel=0.25)


def test_defined_edges(spark):
    def curve(rows, ks=(1, 3)):
        return {r["k"]: r["inertia"] for r in elbow.elbow_one_scan(spark.createDataFrame(rows, SCHEMA), ks).collect()}

    assert curve([]) == {1: 0.0, 3: 0.0}
    assert curve([(1, None), (2, [math.nan]), (3, [None])]) == {1: 0.0, 3: 0.0}
    assert curve([(1, [2.0])]) == {1: 0.0, 3: 0.0}
    assert curve([(i, [1.0, 1.0]) for i in range(9)]) == {1: 0.0, 3: 0.0}
    assert curve([(1, [0.0]), (1, [0.0]), (2, [3.0]), (3, None)], [1])[1] == pytest.approx(6.0)
    with pytest.raises(ValueError):
        elbow.elbow_one_scan(spark.createDataFrame([], SCHEMA), [0])
