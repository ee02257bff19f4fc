"""Neighbour descent, fuzzy weights and the layout against brute force."""

import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from presslens.operators import layout as L

SCHEMA = "id bigint, e array<double>"


def blobs(n, dims, groups=8, seed=5):
    rnd = random.Random(seed)
    middle = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [(i, [c + rnd.gauss(0, .35) for c in middle[i % groups]]) for i in range(n)]


def nearest(X, k):
    D = ((X[:, None] - X[None]) ** 2).sum(2)
    np.fill_diagonal(D, np.inf)
    return np.argsort(D, axis=1, kind="stable")[:, :k]


def trustworthiness(X, Y, k):
    n = len(X)
    D = ((X[:, None] - X[None]) ** 2).sum(2)
    np.fill_diagonal(D, np.inf)
    rank = np.empty((n, n), int)
    np.put_along_axis(rank, np.argsort(D, axis=1, kind="stable"), np.arange(1, n + 1)[None].repeat(n, 0), 1)
    late = sum(max(0, rank[i, j] - k) for i in range(n) for j in nearest(Y, k)[i])
    return 1 - 2 * late / (n * k * (2 * n - 3 * k - 1))


def test_recall_and_distances_in_64_dimensions(spark):
    rows = blobs(1500, 64)
    got = {}
    for r in L.neighbour_descent(spark.createDataFrame(rows, SCHEMA), k=10).collect():
        got.setdefault(r["q"], {})[r["t"]] = r["d"]
    X = np.array([e for _, e in rows])
    true = nearest(X, 10)
    assert all(len(v) == 10 for v in got.values()) and len(got) == 1500
    assert sum(len(set(true[i]) & set(got[i])) for i in range(1500)) >= 0.9 * 15000
    assert all(d == pytest.approx(math.dist(X[q], X[t])) for q in (0, 7, 900) for t, d in got[q].items())


def test_map_keeps_neighbours_and_repeats(spark):
    rows = blobs(240, 12, 6)
    df = spark.createDataFrame(rows, "orig_index bigint, embedding array<double>")
    got = {r["orig_index"]: (r["x"], r["y"]) for r in L.neighbour_map(df, k=10, rounds=12).collect()}
    X, Y = np.array([e for _, e in rows]), np.array([got[i] for i, _ in rows])
    start = X - X.mean(0)
    start = start @ np.linalg.svd(start, full_matrices=False)[2][:2].T
    assert np.isfinite(Y).all()
    assert trustworthiness(X, Y, 10) > max(0.85, trustworthiness(X, start, 10))
    again = {r["orig_index"]: (r["x"], r["y"]) for r in L.neighbour_map(df.repartition(3), k=10, rounds=12).collect()}
    assert all(got[i] == pytest.approx(again[i], abs=1e-3) for i in got)


def test_weights(spark):
    edges = [(1, 2, 1.0), (1, 3, 2.0), (1, 4, 5.0), (2, 1, 1.0), (5, 6, 0.0), (5, 7, 0.0)]
    w = {(r["a"], r["b"]): r["w"] for r in L.fuzzy_edges(spark.createDataFrame(edges, "q bigint, t bigint, d double")).collect()}
    assert all(w[a, b] == w[b, a] for a, b in w) and w[1, 2] == pytest.approx(1) and w[5, 6] == pytest.approx(1)
    assert w[1, 2] + w[1, 3] + w[1, 4] == pytest.approx(math.log2(3), abs=1e-6)
    assert w[1, 3] > w[1, 4]


def test_defined_edges(spark):
    def places(rows):
        df = spark.createDataFrame(rows, "orig_index bigint, embedding array<double>")
        return [(r["orig_index"], r["x"], r["y"]) for r in L.neighbour_map(df, k=5, rounds=2).collect()]

    assert places([]) == []
    assert set(places([(1, None), (2, [math.nan]), (None, [1.0])])) == {(1, None, None), (2, None, None), (None, None, None)}
    one = places([(1, [1.0, 2.0]), (2, None)])
    assert {r[0]: r[1] is None for r in one} == {1: False, 2: True}
    same = places([(i, [3.0, 3.0]) for i in range(7)] + [(0, [3.0, 3.0])])
    assert len(same) == 8 and all(math.isfinite(x) and math.isfinite(y) for _, x, y in same)


def evenly(n, dims=64, seed=3):
    X = np.random.default_rng(seed).normal(size=(n, dims)).astype("float32").astype(float)
    return X / np.linalg.norm(X, axis=1)[:, None]


def test_recall_among_evenly_spread_vectors(spark):
    X = evenly(6000)
    got = {}
    for r in L.neighbour_descent(spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(X)], SCHEMA), k=15).collect():
        got.setdefault(r["q"], {})[r["t"]] = r["d"]
    hits = 0
    for i in range(0, 6000, 20):
        d = np.sqrt(((X - X[i]) ** 2).sum(1))
        d[i] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:15].tolist()) & set(got[i]))
        assert len(got[i]) == 15 and i not in got[i]
    assert hits >= 0.65 * 15 * 300  # no bucket leaves anything out here: it was 0.63


def test_copies_and_few_points(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(400)]  # three places: the neighbours of a row are its copies
    got = {}
    for r in L.neighbour_descent(spark.createDataFrame(rows, SCHEMA), k=5).collect():
        got.setdefault(r["q"], []).append((r["t"], r["d"]))
    assert len(got) == 400 and all(len({t for t, _ in v}) == 5 for v in got.values())
    assert all(d == 0 and t % 3 == q % 3 and t != q for q, v in got.items() for t, d in v)
    few = L.neighbour_descent(spark.createDataFrame(rows[:4], SCHEMA), k=5).collect()
    assert {(r["q"], r["t"]) for r in few} == {(i, j) for i in range(4) for j in range(4) if i != j}


def test_slices_that_many_visit_are_dealt_out(spark, monkeypatch):
    rows = blobs(900, 8, 3)
    monkeypatch.setattr(L, "LEAST_SLICE", 256)
    monkeypatch.setattr(L, "SHARE_SLICES", 1)
    got = {(r["q"], r["t"]) for r in L.neighbour_descent(spark.createDataFrame(rows, SCHEMA), k=10).collect()}
    true = {(i, int(j)) for i, near in enumerate(nearest(np.array([e for _, e in rows]), 10)) for j in near}
    assert len(got) == 9000 and len(got & true) >= 0.9 * 9000


MOVED = """
import glob, json, sys
import numpy as np
from pyspark.sql import SparkSession
from presslens.operators.layout import neighbour_map

at, n = sys.argv[1], int(sys.argv[2])
spark = SparkSession.builder.master("local[4]").config(map={
    "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "8", "spark.checkpoint.dir": at + "/kept",
    "spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + at, "spark.eventLog.compress": "false",
    "spark.eventLog.rolling.enabled": "false"}).getOrCreate()
X = np.random.default_rng(3).normal(size=(n, 64))
rows = [(i, e.tolist()) for i, e in enumerate(X / np.linalg.norm(X, axis=1)[:, None])]
out = neighbour_map(spark.createDataFrame(rows, "orig_index bigint, embedding array<float>"))
assert out.filter("x is not null and y is not null").count() == n
spark.stop()
moved = 0
for f in glob.glob(at + "/local-*"):
    for e in map(json.loads, open(f)):
        if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            m = e["Task Metrics"]
            moved += m["Shuffle Write Metrics"]["Shuffle Bytes Written"] + m["Disk Bytes Spilled"] + m["Output Metrics"]["Bytes Written"]
print("moved", moved)
"""


def test_what_a_map_moves_for_a_row(tmp_path):
    repo, n = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), 4000
    out = subprocess.run([sys.executable, "-c", MOVED, str(tmp_path), str(n)], cwd=repo, env=os.environ | {"PYTHONPATH": repo},
                         capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-3000:]
    assert int(out.stdout.split()[-1]) <= 20_000 * n  # it was 88,500 bytes a row


def test_a_round_in_steps_finds_the_same(spark, monkeypatch):
    rows = [(i, e.tolist()) for i, e in enumerate(evenly(1500, 16))]
    monkeypatch.setattr(L, "LEAST_SLICE", 256)
    monkeypatch.setattr(L, "BUCKET", 400)
    at_once, many = (monkeypatch.setattr(L, "VISITS", v) or {(r["q"], r["t"], r["d"]) for r in L.neighbour_descent(
        spark.createDataFrame(rows, SCHEMA), k=10, rounds=1).collect()} for v in (1000, 1))
    assert at_once == many and len(many) == 15_000


def test_candidates_leave_a_slice_in_blocks():
    import pyarrow as pa

    X = evenly(600, 8)
    X[500:] = X[:100]  # copies
    got = pa.table({"id": np.arange(600) * 3, "e": pa.array(X.tolist()), "part": np.full(600, 7, np.int32), "reach": np.full(600, np.inf),
                    "home": np.ones(600, bool), "parts": pa.array([[7]] * 600, pa.list_(pa.int32()))})
    out = L._compare(got, 5, 4)
    assert out.num_rows <= 4  # a row a bucket: it was a row for each of 3,000 candidates, which spilled at size
    found = {}
    for r in out.to_pylist():
        for q, t, d in zip(r["q"], r["t"], r["d"], strict=True):
            found.setdefault(q // 3, []).append((d, t // 3))
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    np.fill_diagonal(D, np.inf)
    for i in range(600):
        assert [j for _, j in sorted(found[i])] == sorted(range(600), key=lambda j: (D[i, j], j))[:5]  # noqa: B023


def test_files_of_a_shuffle_do_not_outlive_its_table(spark):
    import time

    from presslens.session import TIDY, cut_lineage

    def kept():
        at = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(at.apply(i).getName().startswith("shuffle_") for i in range(at.size()))

    rows, before, was = spark.range(20_000).selectExpr("id", "uuid() u").repartition(8, "u"), kept(), spark.conf.get(TIDY, None)
    table = cut_lineage(rows, True)
    for _ in range(50):
        if kept() > before:
            time.sleep(.1)
    assert kept() <= before
    assert spark.conf.get(TIDY, None) == was and table.count() == 20_000
