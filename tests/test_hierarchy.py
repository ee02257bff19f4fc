"""Density hierarchy and search in cells against brute force."""

import math
import random

import numpy as np
import pytest
from presslens.operators import cells, hierarchy

SCHEMA = "orig_index bigint, embedding array<double>"


def blobs(seed, dims=2, copies=0):
    rnd = random.Random(seed)
    rows = []
    for centre, spread, n in (((0, 0), .3, 25), ((4, 0), .5, 20), ((4, 1.6), .15, 15), ((-3, 5), .9, 20), ((1, 2), 3, 15)):
        rows += [[centre[j % 2] + rnd.gauss(0, spread) for j in range(dims)] for _ in range(n)]
    rows += [rows[rnd.randrange(len(rows))] for _ in range(copies)]
    if copies:
        rows += [rows[3]] * 9 + [[9.0] * dims] * 7
    return [(i, r) for i, r in enumerate(rows)]


def brute(rows, min_pts, min_size):
    """Clusters straight from the definition: components of the mutual reachability graph at every level, top down."""
    ids = [i for i, e in rows if e is not None]
    X = np.array([e for _, e in rows if e is not None], dtype=float)
    n = len(ids)
    if not n:
        return {i: -1 for i, _ in rows}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    core = np.sort(D, axis=1)[:, min(min_pts, n) - 1]
    M = np.maximum(np.maximum(core[:, None], core[None]), D)
    same = D == 0
    levels = sorted({M[i, j] for i in range(n) for j in range(i) if not same[i, j]})
    least = levels[0] if levels else 1.0

    def parts(members, level):
        out, left = [], set(members)
        while left:
            todo, comp = [min(left)], set()
            while todo:
                x = todo.pop()
                if x in comp:
                    continue
                comp.add(x)
                todo += [y for y in left if y not in comp and (same[x, y] or M[x, y] <= level)]
            left -= comp
            out.append(sorted(comp))
        return out

    def descend(members, at):
        """(stability without the birth part, death sums, children) of the cluster that is ``members`` at level index ``at``."""
        joined, kids = 0.0, []
        current, k = members, at
        while True:
            lower = parts(current, levels[k - 1]) if k > 0 else [[x] for x in sorted({min(y for y in current if same[x, y]) for x in current})]
            if k == 0:  # below the least level only copies hold together
                lower = [[y for y in current if same[x[0], y]] for x in lower]
            lam = 1 / levels[k]
            big = [p for p in lower if len(p) >= min_size]
            for p in lower:
                if len(p) < min_size:
                    joined += len(p) * lam
            if len(big) != 1:
                joined += sum(map(len, big)) * lam
                kids = [(p, k - 1, levels[k]) for p in big]
                break
            current, k = big[0], k - 1
            if k < 0:
                joined += len(current) / least
                break
        return joined, kids

    def best(members, at, birth):
        if at < 0:
            joined, kids = len(members) / least, []
        else:
            joined, kids = descend(members, at)
        under = [best(*kid) for kid in kids]
        stable = joined - len(members) / birth if birth else -math.inf
        below = sum(u[0] for u in under)
        if birth and (not kids or stable >= below - 1e-9 * abs(below)):
            return stable, [members]
        return below, [c for u in under for c in u[1]]

    found = best(list(range(n)), len(levels) - 1, None)[1] if n >= min_size else []
    label = {ids[x]: min(ids[y] for y in c) for c in found for x in c}
    return {i: label.get(i, -1) for i, _ in rows}


def test_clusters_equal_the_definition(spark):
    rows = blobs(2, 5, 6) + [(10_000, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    # small groups, so that the hierarchy is folded in several rounds, and few cells, so that some are left out
    got = dict(map(tuple, hierarchy.hierarchy_clusters(df, 5, 8, group_rows=40, most_cells=4, block_rows=7).collect()))
    assert got == brute(rows, 5, 8) and len(set(got.values())) > 2


@pytest.mark.parametrize("seed", range(6))
def test_fold_of_all_edges_equals_the_definition(seed):
    rows = blobs(seed, 2 + seed % 3)
    if seed % 2:  # many equal distances
        rows = [(i, [round(x * 2) / 2 + 0.001 * (i % 7) for x in e]) for i, e in rows]
    X = np.array([e for _, e in rows])
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    core = np.sort(D, axis=1)[:, 4]
    M = np.maximum(np.maximum(core[:, None], core[None]), D)
    n = len(rows)
    first = {}
    for i in range(n):
        first.setdefault(tuple(X[i]), i)
    points = sorted(first.values())
    size = {p: sum(tuple(X[i]) == tuple(X[p]) for i in range(n)) for p in points}
    edges = [(a, b, float(M[a, b])) for k, a in enumerate(points) for b in points[k + 1:]]
    _, joined, ended = hierarchy.fold([(p, size[p], None, 0.0, 0.0, True) for p in points], edges, 8)
    up = {c: parent for c, parent, _, _ in ended}
    chosen = {c for c, _, _, ok in ended if ok}
    label = {}
    for p, c in joined:
        top = None
        while c is not None:
            top, c = (c if c in chosen else top), up.get(c)
        label[p] = top
    groups = {}
    for p, c in label.items():
        groups.setdefault(c, []).append(p)
    name = {c: min(ps) if c else -1 for c, ps in groups.items()}
    got = {i: name.get(label.get(first[tuple(X[i])]), -1) for i in range(n)}
    assert got == brute(rows, 5, 8)


def test_small_and_empty_tables_are_noise(spark):
    for rows in ([], [(1, None)], [(1, [0.0, 1.0])], [(1, [0.0, 1.0])] * 9):
        got = hierarchy.hierarchy_clusters(spark.createDataFrame(rows, SCHEMA), 3, 3).collect()
        assert len(got) == len(rows) and {r["cluster"] for r in got} <= {-1}


@pytest.mark.parametrize("dims", [2, 9])
def test_nearest_neighbours_equal_all_pairs(spark, dims):
    rows = blobs(5, dims)
    df = spark.createDataFrame(rows, "id bigint, e array<double>").repartition(3)
    _, _, near = cells.k_nearest(df, 6, most_cells=9, block_rows=8)
    X = np.array([e for _, e in rows])
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    for r in near.collect():
        want = sorted((D[r["id"], j], j) for j in range(len(rows)) if j != r["id"])[:6]
        assert [x["t"] for x in r["near"]] == [j for _, j in want]


def test_long_chains_of_any_order_settle_in_few_rounds(spark):
    import random

    from presslens.operators.clustering import connected_components

    order = list(range(6000))
    random.Random(5).shuffle(order)
    steps = [(a, b) for a, b in zip(order, order[1:], strict=False) if {a, b} != {order[2999], order[3000]}]
    edges = spark.createDataFrame(steps + [(b, a) for a, b in steps], "a long, b long")
    got = dict(map(tuple, connected_components(edges, spark.range(6001).toDF("vid"), max_rounds=14).collect()))
    assert got == {v: min(part) for part in (order[:3000], order[3000:], [6000]) for v in part}


def test_a_query_is_sent_once_a_slice_however_many_cells_it_meets(spark, monkeypatch):
    from presslens.operators.vectors import nearest_in_table

    rng = np.random.default_rng(8)
    X, Y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 400, 24)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(X)], "orig_index long, embedding array<double>")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(Y)], "cluster long, centroid array<double>")
    sent, meet = [], cells.meet

    def watch(queries, points, where, *args, **kw):  # no cell can be left out, and all lie in a few slices
        sent.append((where.slices().shape[1], int((where.bounds(X) <= 2.0).sum()), len(where.pivots)))
        return meet(queries, points, where, *args, **kw)

    monkeypatch.setattr(cells, "meet", watch)
    got = dict(map(tuple, nearest_in_table(df, table, block_rows=1).select("orig_index", "prediction").collect()))
    assert got == {i: int(j) for i, j in enumerate(((X[:, None] - Y[None]) ** 2).sum(2).argmin(1))}
    assert [s[0] for s in sent] == [4, 4] and sent[0][1] == 400 * sent[0][2] == 400 * 20


def test_products_in_single_precision_only_propose(monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_POINTS", 50)
    rng, n = np.random.default_rng(4), 400
    plain = rng.normal(size=(n, 8))
    kinds = {"plain": plain, "far from zero": 1e5 + 1e-4 * plain, "tiny": 1e-30 * plain, "large": 1e150 * plain,
             "copies": np.repeat(plain[:20], 20, 0), "one place": np.ones((n, 8)), "not finite": np.where(rng.random((n, 1)) < .1, np.nan, plain)}
    for kind, X in kinds.items():
        Q = X[rng.integers(0, n, 60)] + (0 if kind == "one place" else 1e-3 * np.nanstd(X) * rng.normal(size=(60, 8)))
        Q = np.nan_to_num(Q)
        ids = rng.permutation(n)
        D = ((Q[:, None] - X[None]) ** 2).sum(2)
        D[np.isnan(D)] = np.inf
        want = [min(range(n), key=lambda j: (D[i, j], ids[j])) for i in range(60)]  # noqa: B023
        for reach in (np.full(60, np.inf), np.sqrt(D.min(1))):
            plan = [(np.arange(i, i + 20), np.arange(j, j + 200)) for i in (0, 20, 40) for j in (0, 200)]
            q, cost, t = cells.nearest({"id": np.arange(60), "e": Q, "reach": reach}, {"id": ids, "e": X}, plan)
            assert q.tolist() == list(range(60)), kind
            assert t.tolist() == [ids[j] for j in want] and cost.tolist() == [D[i, j] for i, j in enumerate(want)], kind


def test_floats_are_sent_as_floats(spark, monkeypatch):
    from presslens.operators.vectors import nearest_in_table

    sent, meet = [], cells.meet
    monkeypatch.setattr(cells, "meet", lambda queries, points, *a, **b: sent.append((queries.schema["e"].dataType, points.schema["e"].dataType)) or meet(queries, points, *a, **b))
    rng = np.random.default_rng(5)
    X, T = rng.normal(size=(50, 6)).astype("float32"), rng.normal(size=(90, 6)).astype("float32")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "orig_index long, embedding array<float>")
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(T)], "cluster long, centroid array<float>")
    got = dict(map(tuple, nearest_in_table(df, table).select("orig_index", "prediction").collect()))
    D = ((X.astype(float)[:, None] - T.astype(float)[None]) ** 2).sum(2)
    assert [got[i] for i in range(50)] == D.argmin(1).tolist()
    assert {k.simpleString() for pair in sent for k in pair} == {"array<float>"}  # it was array<double>
