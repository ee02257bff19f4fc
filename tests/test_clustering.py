import numpy as np
import pytest
from pyspark.sql import functions as F

from presslens.operators import clustering as M
from presslens.operators import vectors as V
from presslens.sources.fixtures import view

SF = "/root/testdata/sf0.001"


def _dbscan_bruteforce(X, ids, eps, min_pts, min_size):
    n = len(X)
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    nb = d <= eps
    core = nb.sum(1) >= min_pts
    label = {i: None for i in range(n)}
    # components of core points: smallest id
    comp = list(range(n))

    def find(a):
        while comp[a] != a:
            comp[a] = comp[comp[a]]
            a = comp[a]
        return a

    for i in range(n):
        for j in range(n):
            if core[i] and core[j] and nb[i, j]:
                a, b = find(i), find(j)
                if a != b:
                    comp[max(a, b)] = min(a, b)
    roots = {}
    for i in range(n):
        if core[i]:
            r = find(i)
            roots.setdefault(r, []).append(i)
    for r, members in roots.items():
        lab = min(ids[m] for m in members)
        for m in members:
            label[m] = lab
    for i in range(n):
        if not core[i]:
            labs = [label[j] for j in range(n) if nb[i, j] and core[j]]
            if labs:
                label[i] = min(labs)
    sizes = {}
    for i in range(n):
        if label[i] is not None:
            sizes[label[i]] = sizes.get(label[i], 0) + 1
    return {ids[i]: (label[i] if label[i] is not None and sizes[label[i]] >= min_size else -1) for i in range(n)}


def test_density_clusters_equal_bruteforce(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 8)) * 4
    X = np.vstack([c + rng.normal(scale=0.4, size=(25, 8)) for c in centres] + [rng.normal(size=(10, 8)) * 6])
    X = np.vstack([X, X[:5]])           # exact copies
    ids = list(range(100, 100 + len(X)))
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in zip(ids, X)], "orig_index long, embedding array<double>")
    want = _dbscan_bruteforce(X, ids, 1.5, 4, 3)
    got = {r["orig_index"]: r["cluster"] for r in M.density_clusters(df, 1.5, min_pts=4, min_size=3).collect()}
    assert got == want
    got3 = {r["orig_index"]: r["cluster"]
            for r in M.density_clusters(df, 1.5, min_pts=4, min_size=3, grid_dims=3).collect()}
    assert got3 == want


def test_kmeans_assigns_nearest_centre(spark):
    cl = view(spark, SF, "clustered").select("orig_index", "embedding")
    pred, centres = M.kmeans(cl, 4, seed=1)
    again = V.assign_nearest(pred, centres, out="nearest")
    assert again.filter(F.col("nearest") != F.col("cluster")).count() == 0


def test_pca_components_orthonormal(spark):
    from pyspark.ml.feature import PCA

    cl = view(spark, SF, "clustered")
    feats = M._features(cl, "embedding")
    pc = PCA(k=3, inputCol="_features", outputCol="p").fit(feats).pc.toArray()
    assert np.allclose(pc.T @ pc, np.eye(3), atol=1e-8)
    out = M.pca(cl, 3)
    means = np.array([r["pca"] for r in out.collect()]).mean(0)
    assert np.allclose(means, 0, atol=1e-8)       # centred like sklearn


def test_elbow_curve_k1_is_total_variance(spark):
    e = view(spark, SF, "embeddings")
    curve = {r["k"]: r["inertia"] for r in M.elbow_curve(e, [1, 2, 3]).collect()}
    X = np.array([r["embedding"] for r in e.collect()], dtype=float)
    assert abs(curve[1] - ((X - X.mean(0)) ** 2).sum()) < 1e-6
    assert curve[1] >= curve[2] >= curve[3] * 0.9


def test_connected_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(i + 1, i) for i in range(9)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(12)], "vid long")
    got = {r["vid"]: r["label"] for r in M.connected_components(edges, nodes).collect()}
    assert all(got[i] == 0 for i in range(10)) and got[10] == 10 and got[11] == 11


def _weighted(spark, X):
    rows = [(i, [float(v) for v in x], 1) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "vid long, embedding array<double>, weight long")


def test_neighbours_equal_bruteforce_whatever_the_block_size(spark):
    X = np.random.default_rng(3).normal(size=(120, 4))
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 1.1)) if a != b}
    for block_rows in (7, 512):
        got = [(r["a"], r["b"]) for r in M.epsilon_neighbours(_weighted(spark, X), 1.1, block_rows=block_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_map_comparisons_stay_far_below_all_pairs(spark):
    e = view(spark, "/root/testdata/sf0.1", "embeddings")
    points = e.select(F.col("vec_id").alias("vid"), F.slice("embedding", 1, 2).alias("embedding"), F.lit(1).alias("weight"))
    n = points.count()
    assert M.compared_pairs(points, 0.02) < n * n / 50


def test_label_clusters_with_given_vectors_and_encoder(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), ("far",), ("novec",)], "l string")
    vecs = {"a": [0.0, 0.0], "b": [0.1, 0.0], "c": [0.0, 0.1], "far": [9.0, 9.0]}
    table = spark.createDataFrame(list(vecs.items()), "raw_label string, embedding array<double>")
    out = M.label_clusters(df, "l", 0.5, min_pts=2, min_size=2, pca_k=None, vectors=table).collect()
    assert {r["raw_label"]: (r["cluster_id"], r["cluster_label"]) for r in out} == {
        "a": (0, "c"), "b": (0, "c"), "c": (0, "c"), "far": (-1, "other"), "novec": (-1, "other")}

    def encoder(texts):
        return np.array([[1.0, 0.0] if t in "abc" else [0.0, 1.0] for t in texts])

    out = M.label_clusters(df, "l", 0.1, min_pts=2, min_size=2, pca_k=None, encoder=encoder).collect()
    assert {r["raw_label"]: r["cluster_label"] for r in out} == {"a": "c", "b": "c", "c": "c", "far": "far", "novec": "far"}


def test_kernels_and_centroids_with_null_and_zero_vectors(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, None), (3, 0, [0.0, 0.0]), (4, 1, [0.0, 2.0])],
                               "orig_index long, cluster int, embedding array<double>")
    q = spark.createDataFrame([([1.0, 1.0],)], "embedding array<double>")
    got = {r["orig_index"]: r["ai_score"] for r in V.semantic_score(df, q).collect()}
    assert got[2] is None and got[3] is None and abs(got[1] - 0.5 ** 0.5) < 1e-12
    cen = {r["cluster"]: (r["centroid"], r["size"]) for r in V.cluster_centroids(df, renormalise=False).collect()}
    assert cen == {0: ([0.5, 0.0], 2), 1: ([0.0, 2.0], 1)}
    plan = V.similarity_to_centroid(df, V.cluster_centroids(df))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def _clouds(n_clouds, size, dims=64, spread=0.02, seed=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_clouds, dims))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return np.vstack([c + rng.normal(scale=spread, size=(size, dims)) for c in centres])


def test_likely_neighbours_are_true_named_once_and_nearly_all(spark):
    X = _clouds(60, 50)
    n, eps = len(X), 0.3
    points = spark.createDataFrame([(i, x.tolist(), 1 + i % 3) for i, x in enumerate(X)], "vid long, embedding array<double>, weight long")
    got = [tuple(r) for r in M.likely_neighbours(points, eps, block_rows=40).collect()]
    sq = (X * X).sum(1)
    near = sq[:, None] + sq[None] - 2 * X @ X.T <= eps * eps
    np.fill_diagonal(near, False)
    want = set(zip(*np.nonzero(near)))
    assert len(want) > 100_000
    assert len(got) == len(set(got)) and {(a, b) for a, b, _ in got} <= want     # no pair is wrong or named twice
    assert all(w == 1 + b % 3 for _, b, w in got)
    assert {(b, a) for a, b, _ in got} == {(a, b) for a, b, _ in got}
    assert len(got) >= 0.9 * len(want)                                            # recall against brute force
    assert M.likely_compared(points) < n * n / 4                                  # 12 tables together


def test_density_clusters_by_candidates_equal_the_exact_ones_on_clouds(spark):
    X = np.vstack([_clouds(20, 30), _clouds(40, 1, seed=10)])
    X = np.vstack([X, X[:7]])           # exact copies
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)] + [(9999, None)], "orig_index long, embedding array<double>")
    exact = {r[0]: r[1] for r in M.density_clusters(df, 0.3).collect()}
    assert {r[0]: r[1] for r in M.density_clusters(df, 0.3, tables=12).collect()} == exact
    assert exact[9999] == -1 and len(set(exact.values())) == 21
    empty = M.density_clusters(df.limit(0), 0.3, tables=4)
    assert empty.count() == 0


def test_neighbours_are_linked_without_being_listed(spark, monkeypatch):
    """One dense ball: n^2 neighbours, but what is written follows the points."""
    import numpy as np

    rng = np.random.default_rng(3)
    X = np.concatenate([rng.normal(size=(600, 8)) * 0.05, rng.normal(size=(200, 8)) * 0.05 + 3, rng.normal(size=(9, 8)) + 40])
    df = spark.createDataFrame([(i + 7, v.tolist()) for i, v in enumerate(X)], "orig_index long, embedding array<double>")
    most, cut = [], M.cut_lineage

    def watch(rows):
        out = cut(rows)
        most.append(out.count())
        return out

    monkeypatch.setattr(M, "cut_lineage", watch)
    got = dict(map(tuple, M.density_clusters(df, 1.0, min_pts=5, min_size=5).collect()))
    assert got == {i + 7: 7 if i < 600 else 607 if i < 800 else -1 for i in range(809)}
    assert max(most) <= 10 * len(X)


def _by_definition(X, ids, eps, min_pts):
    """Labels of DBSCAN by all pairs: the least core id of a cluster, border points with the least label near them, -1 for noise."""
    import numpy as np

    near = ((X[:, None] - X[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= min_pts
    label = np.where(core, ids, np.iinfo(np.int64).max)
    while True:
        new = np.where(core, np.where(near & core[None], label[None], np.iinfo(np.int64).max).min(1), label)
        if (new == label).all():
            break
        label = new
    seen = np.where(near & core[None], label[None], np.iinfo(np.int64).max).min(1)
    return {int(i): int(v) if v < np.iinfo(np.int64).max else -1 for i, v in zip(ids, seen, strict=True)}


@pytest.mark.parametrize(("dims", "eps", "min_pts", "hubs"), [(2, .22, 4, 5), (2, .12, 6, 1), (3, .5, 5, 3), (12, 3.4, 4, 7), (12, 2.6, 3, 2)])
def test_density_labels_over_several_slices(spark, monkeypatch, dims, eps, min_pts, hubs):
    import numpy as np

    monkeypatch.setattr(M, "HUBS", hubs)
    monkeypatch.setattr(M.cells, "SLICE_BLOCKS", 1)
    monkeypatch.setattr(M.cells, "BLOCK_POINTS", 40)
    monkeypatch.setattr(M.cells, "BLOCK_ROWS", 25)
    build, meet = M.cells.build, M.cells.meet
    monkeypatch.setattr(M.cells, "build", lambda *a, **b: build(*a, block_rows=60, **b))
    met = []
    monkeypatch.setattr(M.cells, "meet", lambda q, *a, **b: met.append(q.count()) or meet(q, *a, **b))
    rng = np.random.default_rng(dims + hubs)
    X = np.concatenate([rng.normal(size=(250, dims)), rng.normal(size=(120, dims)) * .2 + 2, rng.uniform(-4, 4, size=(60, dims))])
    ids = rng.permutation(len(X)) - 50
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, X, strict=True)], "orig_index long, embedding array<double>")
    got = dict(map(tuple, M.density_clusters(df, eps, min_pts=min_pts, min_size=1).collect()))
    assert got == _by_definition(X, ids, eps, min_pts)
    assert len(met) == 2  # what its slice has not told is counted, and what is not in the largest part is connected


def test_points_that_are_told_are_not_met_again(spark, monkeypatch):
    import numpy as np

    compared = []
    hits = M.cells.within
    monkeypatch.setattr(M.cells, "within", lambda ask, have, q, t, *a: compared.append(len(q) * len(t)) or hits(ask, have, q, t, *a))
    monkeypatch.setattr(M.cells, "BLOCK_POINTS", 250)
    monkeypatch.setattr(M.cells, "BLOCK_ROWS", 50)
    n = 3000
    X = np.random.default_rng(2).uniform(-2, 2, size=(n, 4))
    got = {"id": np.arange(n) + 5, "weight": np.ones(n), "e": X}
    core, part = M._inside(got, 1.0, 4)
    assert sum(compared) < n * n / 2  # it was 2 n^2
    want = _by_definition(X, got["id"], 1.0, 4)
    assert {int(i): int(p) for i, c, p in zip(got["id"], core, part, strict=True) if c} == {
        int(i): want[int(i)] for i, c in zip(got["id"], core, strict=True) if c}


def test_repeated_keys_with_unlike_vectors_count_as_one(spark):
    rows = [(1, [0.0, 0.0]), (1, [10.0, 0.0]), (2, [0.5, 0.0]), (3, [10.5, 0.0]), (4, [50.0, 0.0])]
    df = spark.createDataFrame(rows, "orig_index long, embedding array<double>")
    assert {(r["orig_index"], r["cluster"]) for r in M.density_clusters(df, 1.0, min_pts=2, min_size=1).collect()} == {(1, 1), (2, 1), (3, 1), (4, -1)}
