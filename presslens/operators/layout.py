"""Neighbour graph by neighbour descent and a 2-D layout of it.

* ``neighbour_descent``: rows meet in the cells of a few pivots near them, and then in rounds in the cells of their neighbours ("a
  neighbour of a neighbour is a neighbour").  Cells that lie together make up slices; a vector is sent once to a slice, not to
  each list or cell.  Distances are exact; which neighbours are found is not (the test measures recall).
* ``fuzzy_edges``: weights that fall with the distance beyond the nearest neighbour, scaled so that those of a row sum to
  log2 k, joined over both directions as a + b - a b.
* ``layout``: rounds of bounded moves from the two principal components.  Edges pull; they stay in the slice of their row, and
  only places travel.  All other rows push, summed up by the cells of a grid of bounded size, which travels with the tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.operators import cells
from presslens.operators.clustering import column_means, pca
from presslens.session import cut_lineage

#: Shape of the pull and push of two points (least distance 0.1 in a spread of 1).
CURVE_A, CURVE_B = 1.577, 0.895
#: Largest force on a row, and how many rows push for each one that pulls.
MOST_FORCE, PUSHES = 4.0, 5
#: Grid cells on each side of the centre, and their width.
GRID, CELL = 16, 1.25
#: Least points of a cell, on average; bounds of the rows of a slice; and for how many times its rows in visitors a slice is dealt out.
LEAF, LEAST_SLICE, MOST_SLICE, SHARE_SLICES = 128, 2048, 131_072, 4
#: How many visits a row, on average, are made in one step of a round.
VISITS = 4
#: Rows whose neighbours a task brings together.  The state of a row: parts to visit; neighbours, their distances and parts, nearest first; parts visited.
BUCKET = 16_384
STATE = "id bigint, bucket int, part int, go array<int>, t array<bigint>, d array<double>, near array<int>, seen array<int>, new int"


def _home(points: DataFrame, leaf: int = LEAF) -> tuple[cells.Directory, DataFrame]:
    """The cells, and the points (id, e) with their ``part``: the cell as far as it lies in one slice.

    Cells hold about ``leaf`` points or more; slices hold cells that lie together and are bounded in rows.
    """
    n, tasks = points.count(), 2 * points.sparkSession.sparkContext.defaultParallelism
    slice_rows = max(LEAST_SLICE, min(MOST_SLICE, -(-n // tasks)))
    where, placed = cells.build(points, (), max(1, min(cells.MOST_CELLS, n // leaf)), max(1, slice_rows // cells.SLICE_BLOCKS))
    part = where.slice_of(F.col("cell"), F.col("sub")) * F.lit(len(where.subs)) + F.col("cell")
    return where, placed.select("id", "e", part.cast("int").alias("part"))


def _first_parts(where: cells.Directory, homes: DataFrame, tables: int, seed: int, buckets: int) -> DataFrame:
    """(id, bucket, part, go): the parts that a row meets first, up to two of its own and of each of the cells of the nearest pivots.

    Only a cell of many copies has more than two: slices are far larger than other cells."""
    import pyarrow as pa

    held, pivots = where.slices(), len(where.subs)
    first, count = held.argmax(1), np.maximum(held.sum(1), 1)  # the slices of a cell follow each other

    def near(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, own = b.column("id").to_numpy(), b.column("part").to_numpy()
            d = where.bounds(b.column("e").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float), 0.0)
            d[:, ~held.any(1)] = np.inf
            d[np.arange(len(own)), own % pivots] = -np.inf
            cell = np.argsort(d, axis=1, kind="stable")[:, :min(tables, int(held.any(1).sum()))]
            at = (ids[:, None] + seed) % count[cell]
            at[:, 0] = own // pivots - first[own % pivots]
            go = np.stack([(first[cell] + (at + i) % count[cell]) * pivots + cell for i in (0, 1)], 2).reshape(len(ids), -1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(_bucket(ids, buckets)), b.column("part"), pa.ListArray.from_arrays(
                pa.array(np.arange(len(go) + 1, dtype=np.int32) * go.shape[1]), pa.array(go.ravel().astype(np.int32)))], names=["id", "bucket", "part", "go"])

    return homes.mapInArrow(near, "id bigint, bucket int, part int, go array<int>").withColumn("go", F.array_distinct("go"))


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """A well mixed number below ``buckets`` for every id."""
    z = ids.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return (z % np.uint64(buckets)).astype(np.int32)


def _lists(values: np.ndarray, counts: np.ndarray):
    """An Arrow array of lists of so many values each."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the row of each."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _under(G: np.ndarray, least: np.ndarray, k: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the entries of ``G`` that may reach ``least`` and be among the k greatest of their row, ties included."""
    ok = G >= (least - room)[:, None]
    many = np.flatnonzero(np.count_nonzero(ok, axis=1) > k)
    if len(many):
        some = G[many]
        ok[many] &= some >= (np.partition(some, -k, axis=1)[:, -k] - 2 * room[many])[:, None]
    return np.nonzero(ok)


class _Best:
    """The k nearest points found so far of every row, each once: distances and places of the points, nearest first, ties by id."""

    def __init__(self, ids: np.ndarray, reach: np.ndarray, k: int):
        self.ids, self.k, self.limit = ids, k, reach.astype("float64").copy()
        self.d, self.t = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, np.int32)

    def add(self, q: np.ndarray, t: np.ndarray, d: np.ndarray) -> None:
        """``q`` is in order."""
        some = (d <= self.limit[q]) & (self.ids[q] != self.ids[t])
        q, t, d = q[some], t[some], d[some]
        if not len(q):
            return
        rows, first, n = np.unique(q, return_index=True, return_counts=True)
        step = max(1, cells.MOST_PAIRS // (self.k + int(n.max())))
        for i in range(0, len(rows), step):
            self._put(rows[i:i + step], n[i:i + step], *(v[first[i]:first[i] + int(n[i:i + step].sum())] for v in (t, d)))

    def _put(self, rows, n, t, d) -> None:
        k, wide = self.k, self.k + int(n.max())
        D, T = np.full((len(rows), wide), np.inf), np.full((len(rows), wide), -1, np.int32)
        D[:, :k], T[:, :k] = self.d[rows], self.t[rows]
        at = np.repeat(np.arange(len(rows)), n), k + np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
        D[at], T[at] = d, t
        order = np.lexsort((self.ids[T], D), axis=1)
        D, T = np.take_along_axis(D, order, 1), np.take_along_axis(T, order, 1)
        D[:, 1:][T[:, 1:] == T[:, :-1]] = np.inf
        order = np.argsort(D, axis=1, kind="stable")[:, :k]
        self.d[rows], self.t[rows] = np.take_along_axis(D, order, 1), np.take_along_axis(T, order, 1)
        self.limit[rows] = np.minimum(self.limit[rows], self.d[rows, k - 1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, i = np.nonzero(np.isfinite(self.d))
        return q, self.t[q, i], self.d[q, i]


def _compare(got, k: int, buckets: int):
    """Candidates (q, t, part of t, d) in both directions of the rows of one slice and the rows that visit its parts, by the bucket of q.

    Products in single precision only propose; a distance is always that of the vectors as they are."""
    import pyarrow as pa

    ids, part, reach = (got[c].to_numpy() for c in ("id", "part", "reach"))
    X = got["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    to, asks = _flat(got["parts"])
    homes = np.flatnonzero(got["home"].to_numpy())
    homes = homes[np.lexsort((ids[homes], part[homes]))]
    order = np.lexsort((ids[asks], to))
    asks, to = asks[order], to[order]
    best, frame = _Best(ids, reach, k), cells.Frame(X)

    def offer(q, t):  # pairs of rows, in the order of q
        for i in range(0, len(q), 100_000):
            a, b = q[i:i + 100_000], t[i:i + 100_000]
            yield a, b, np.sqrt(((X[a].astype("float64") - X[b]) ** 2).sum(1))

    def both(Q, T, G, room):
        for rows, others, g, r in ((Q, T, G, room[0]), (T, Q, np.ascontiguousarray(G.T), room[1]))[:1 if own_first else 2]:
            least = -0.5 * (best.limit[rows] * frame.scale) ** 2
            x, y = _under(g, least, k + own_first, r)  # a row is among those of its own part
            by = np.argsort(rows[x], kind="stable")  # rows of one part are not in the order of the table
            for a, b, d in offer(rows[x][by], others[y][by]):
                best.add(a, b, d)

    own = part[asks] == to
    for own_first in (True, False):  # a row's own part gives the first bound
        some, into = asks[own == own_first], to[own == own_first]
        for p in np.unique(into):
            every = some[np.searchsorted(into, p):np.searchsorted(into, p, "right")]
            here = homes[np.searchsorted(part[homes], p):np.searchsorted(part[homes], p, "right")]
            for j in range(0, len(here), 4096):
                T = here[j:j + 4096]
                B, sq_t = frame.sides(X[T], True)
                step = max(1, cells.MOST_PAIRS // 2 // len(T))
                for i in range(0, len(every), step):
                    Q = every[i:i + step]
                    A, sq_q = frame.sides(X[Q], False)
                    both(Q, T, A @ B.T, (frame.unit * (sq_q + sq_t.max()), frame.unit * (sq_t + sq_q.max())))
    q, t, d = best.found()
    to = _bucket(ids[q], buckets)
    order = np.argsort(to, kind="stable")
    q, t, d = q[order], t[order], d[order]
    kinds, n = np.unique(to, return_counts=True)
    return pa.table({"bucket": pa.array(kinds, pa.int32()), "q": _lists(ids[q], n), "t": _lists(ids[t], n),
                     "part": _lists(part[t].astype(np.int32), n), "d": _lists(d, n)})


def _merger(k: int, step: int, steps: int):
    """The state of a bucket of rows after a step: the k nearest of what was near and what was found, and after the last of a
    round the parts to visit next."""
    import pyarrow as pa

    def merge(state, found):
        ids = state["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        (t, row), (d, _), (part, _), (go, go_row), (seen, seen_row) = (_flat(state[c]) for c in ("t", "d", "near", "go", "seen"))
        new_t, new_d, new_part = (_flat(found[c])[0] for c in ("t", "d", "part"))
        new_row = order[np.searchsorted(ids[order], _flat(found["q"])[0])]
        was = np.concatenate((np.ones(len(row), bool), np.zeros(len(new_row), bool)))
        row, t, d, part = (np.concatenate(v) for v in ((row, new_row), (t, new_t), (d, new_d), (part, new_part)))
        by = np.lexsort((~was, t, d, row))
        row, t, d, part, was = row[by], t[by], d[by], part[by], was[by]
        first = np.append(True, (row[1:] != row[:-1]) | (t[1:] != t[:-1]))[:len(row)]
        row, t, d, part, was = row[first], t[first], d[first], part[first], was[first]
        start = np.cumsum(np.bincount(row, minlength=len(ids))) - np.bincount(row, minlength=len(ids))
        keep = np.arange(len(row)) - start[row] < k
        row, t, d, part, was = row[keep], t[keep], d[keep], part[keep], was[keep]
        count = lambda r: np.bincount(r, minlength=len(ids))
        new = count(row[~was]) + (state["new"].to_numpy() if step else 0)
        out = {c: state[c] for c in ("id", "bucket", "part", "go")} | {
            "t": _lists(t, count(row)), "d": _lists(d, count(row)), "near": _lists(part.astype(np.int32), count(row)),
            "seen": state["seen"], "new": pa.array(new.astype(np.int32))}
        if step == steps - 1:
            wide = np.int64(1 + max((int(v.max()) for v in (part, go, seen) if len(v)), default=0))
            done = np.unique(np.concatenate((seen_row * wide + seen, go_row * wide + go)))
            wish = np.setdiff1d(row * wide + part, done)
            out |= {c: _lists((v % wide).astype(np.int32), count(v // wide)) for c, v in (("go", wish), ("seen", done))}
        return pa.table(out)

    return merge


def neighbour_descent(points: DataFrame, k: int = 15, tables: int = 20, leaf: int = LEAF, rounds: int = 6,
                      seed: int = 42, settled: float = 0.001, home: tuple[cells.Directory, DataFrame] | None = None) -> DataFrame:
    """(q, t, d): about the k nearest other points of each of ``points`` (distinct id bigint, e array of float or double, no nulls).

    A row first meets its own cell and those of the nearest pivots (``tables`` in all), then in every round the parts that hold
    its neighbours and that it has not met.  Its vector is sent once to each slice it has to meet, with the distance
    of its k-th neighbour: only what is nearer comes back, in blocks of columns that are brought together by buckets of rows.  A round of
    many visits is made in steps, and what a step has moved is removed from the disks when it has ended.  Rounds end when a share of ``settled`` or less of the edges is
    new.  Fewer than k other points give all of them once met; an empty table gives no edges.
    """
    n = points.count()
    if n < 2:
        return points.select(F.col("id").alias("q"), F.col("id").alias("t"), F.lit(0.0).alias("d")).limit(0)
    where, homes = home or _home(points, leaf)
    pivots, slices, buckets = len(where.subs), where.slices().shape[1], -(-n // BUCKET)
    slice_of = lambda part: F.floor(part / F.lit(pivots)).cast("int")
    none = [F.expr(f"cast(array() as array<{kind}>)").alias(name) for name, kind in (("t", "bigint"), ("d", "double"), ("near", "int"), ("seen", "int"))]
    state = cut_lineage(_first_parts(where, homes, tables, seed, buckets).select("id", "bucket", "part", "go", *none, F.lit(0).alias("new")), True)
    vectors = homes.select("id", "e").repartition(slices, "id").persist()
    try:
        for _ in range(1 + rounds):
            go = F.array_distinct(F.transform("go", slice_of))
            visits = {r["s"]: r["n"] for r in state.select(F.explode(go).alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()}
            steps = min(slices, max(1, -(-sum(visits.values()) // (VISITS * n))))
            for step in range(steps):  # a row's own slice is met first; what is near then bounds what comes back later
                due = F.filter("go", lambda p: F.pmod(slice_of(p) - slice_of(F.col("part")), F.lit(steps)) == step)
                calls = F.array_distinct(F.transform(due, slice_of))
                asked = {r["s"]: r["n"] for r in state.select(F.explode(calls).alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()}
                shares = [-(-asked.get(s, 1) // (SHARE_SLICES * where.slice_rows)) for s in range(slices)]  # a slice that many visit is dealt out
                rows = state.select("id", "part", due.alias("go"), F.coalesce(F.try_element_at("d", F.lit(k)), F.lit(float("inf"))).alias("reach"))
                rows = rows.join(vectors, "id").withColumn("slice", F.explode(F.array_union(F.array(slice_of(F.col("part"))), F.array_distinct(
                    F.transform("go", slice_of)))))
                of = F.try_element_at(F.array(*[F.lit(max(1, s)) for s in shares]), F.col("slice") + 1)
                mine = F.pmod(F.xxhash64("id", F.lit(seed)), of).cast("int")
                is_home = F.col("slice") == slice_of(F.col("part"))
                rows = rows.withColumn("home", is_home).withColumn("share", F.explode(
                    F.when(is_home, F.sequence(F.lit(0), of - 1)).otherwise(F.array(mine))))
                parts = F.when(F.col("share") == mine, F.filter("go", lambda p: slice_of(p) == F.col("slice"))).otherwise(F.expr("cast(array() as array<int>)"))
                met = rows.select("slice", "share", "id", "e", "part", "reach", "home", parts.alias("parts")).groupBy("slice", "share").applyInArrow(
                    lambda got: _compare(got, k, buckets), "bucket int, q array<bigint>, t array<bigint>, part array<int>, d array<double>")
                state = cut_lineage(state.groupBy("bucket").cogroup(met.groupBy("bucket")).applyInArrow(_merger(k, step, steps), STATE), True)
            if (state.agg(F.sum("new")).first()[0] or 0) <= settled * n * k:
                break
    finally:
        vectors.unpersist()
    return state.select(F.col("id").alias("q"), F.explode(F.arrays_zip("t", "d")).alias("r")).select("q", "r.t", "r.d")


def fuzzy_edges(edges: DataFrame) -> DataFrame:
    """(a, b, w) in both directions: weights in (0, 1] of the neighbour graph (q, t, d)."""
    import pyarrow as pa

    def weigh(batches):
        for b in batches:
            q, t, w = [], [], []
            for i in range(b.num_rows):
                near = b.column(1)[i].values
                d, to = near.field("d").to_numpy(), near.field("t").to_numpy()
                beyond = np.maximum(d - (d[d > 0].min() if (d > 0).any() else 0.0), 0.0)
                low, high, target = 0.0, max(1e-12, 1e3 * float(beyond.max())), np.log2(max(2, len(d)))
                for _ in range(64):  # the sum of weights grows with the scale
                    scale = (low + high) / 2
                    low, high = (low, scale) if np.exp(-beyond / max(scale, 1e-300)).sum() > target else (scale, high)
                q.append(np.full(len(d), b.column(0)[i].as_py(), np.int64))
                t.append(to)
                w.append(np.exp(-beyond / max(high, 1e-300)))
            if q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (q, t, w)], names=["a", "b", "w"])

    lists = edges.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "t"))).alias("near"))
    one = lists.mapInArrow(weigh, "a bigint, b bigint, w double").filter("w > 0")
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy("a", "b").agg(
        (F.sum("w") - F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("w"))


def _push(x: np.ndarray, y: np.ndarray, cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean push of all other rows on every row; ``cells`` has (column, line, count, mean x, mean y)."""
    own = (_cell(x)[:, None] == cells[:, 0][None]) & (_cell(y)[:, None] == cells[:, 1][None])
    rows = cells[:, 2][None] - own
    cx, cy = ((cells[:, 2][None] * cells[:, c][None] - own * p[:, None]) / np.maximum(rows, 1) for c, p in ((3, x), (4, y)))
    dx, dy = x[:, None] - cx, y[:, None] - cy
    d2 = dx * dx + dy * dy
    force = 2 * CURVE_B / ((0.001 + d2) * (1 + CURVE_A * d2 ** CURVE_B))
    share = rows / max(1, n - 1)
    return tuple((share * np.clip(force * v, -MOST_FORCE, MOST_FORCE)).sum(1) for v in (dx, dy))


def _cell(p: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(p / CELL), -GRID, GRID)


def _pull(a: np.ndarray, b: np.ndarray, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Weighted mean pull along the edges (a, b, w) on every row; ``a`` and ``b`` are places in ``x`` and ``y``."""
    dx, dy = x[a] - x[b], y[a] - y[b]
    d2 = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        pull = np.where(d2 > 0, -2 * CURVE_A * CURVE_B * d2 ** (CURVE_B - 1) / (1 + CURVE_A * d2 ** CURVE_B), 0.0)
    total = np.bincount(a, w, len(x))
    return [np.bincount(a, w * np.clip(pull * v, -MOST_FORCE, MOST_FORCE), len(x)) / np.where(total > 0, total, 1) for v in (dx, dy)]


def _mover(grid: np.ndarray, alpha: float, n: int):
    """A round's move of the rows of a slice, from their places, those of their neighbours and the edges."""
    import pyarrow as pa

    def move(places, edges):
        ids, x, y, own = (places[c].to_numpy() for c in ("id", "x", "y", "own"))
        order = np.argsort(ids, kind="stable")
        ids, x, y, own = ids[order], x[order], y[order], own[order]
        a, b = (np.searchsorted(ids, edges[c].to_numpy()) for c in "ab")
        order = np.lexsort((b, a))
        pull = [f[own] for f in _pull(a[order], b[order], edges["w"].to_numpy()[order], x, y)]
        x, y = x[own], y[own]
        push = [np.concatenate(v) for v in zip((x[:0], y[:0]), *[
            _push(x[i:i + 1000], y[i:i + 1000], grid, n) for i in range(0, len(x), 1000)], strict=True)]
        new = [np.round(v + alpha * np.clip(f + PUSHES * g, -MOST_FORCE, MOST_FORCE), 6) for v, f, g in zip((x, y), pull, push, strict=True)]
        return pa.table({"id": ids[own], "x": new[0], "y": new[1]})

    return move


def layout(points: DataFrame, graph: DataFrame, rounds: int = 20, rate: float = 0.3, seed: int = 42,
           home: tuple[cells.Directory, DataFrame] | None = None) -> DataFrame:
    """(id, x, y) of every point: moves of at most ``rate`` times ``MOST_FORCE`` a round, falling to none.

    A point without an edge is only pushed.  Coordinates are rounded to six decimals each round, so that the order of adding does not
    show; copies are told apart by a jitter drawn from the id.  Edges stay with the slice of their row; in a round a row's place
    is sent once to each slice that has an edge to it.
    """
    n = points.count()
    jitter = [(F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(1000)) / 1e5).alias(c) for i, c in enumerate("xy")]
    if n < 3:
        return points.select("id", *jitter)
    wide = len(points.first()["e"])
    flat = pca(points, min(2, wide), "e", "p")
    p = [F.coalesce(F.try_element_at("p", F.lit(i)), F.lit(0.0)) for i in (1, 2)]
    most = flat.agg(F.max(F.greatest(F.abs(p[0]), F.abs(p[1])))).first()[0] or 1.0
    state = cut_lineage(flat.select("id", *[F.round(v * (10 / most) + j, 6).alias(c) for v, j, c in zip(p, jitter, "xy", strict=True)]))
    where, homes = home or _home(points)
    slices = where.slices().shape[1]
    at_home = homes.select("id", F.floor(F.col("part") / F.lit(len(where.subs))).cast("int").alias("slice"))
    parts = 2 * slices
    edges = graph.join(at_home.withColumnRenamed("id", "a"), "a").select("slice", "a", "b", "w").repartition(parts, "slice").persist()
    wanted = edges.select(F.col("b").alias("id"), "slice").unionByName(at_home).groupBy("id").agg(F.collect_set("slice").alias("slices"))
    wanted = wanted.join(at_home, "id").select("id", "slice", "slices").repartition(parts, "id").persist()
    try:
        for step in range(rounds):
            alpha = rate * (1 - step / rounds)
            at = [F.greatest(F.lit(-GRID), F.least(F.lit(GRID), F.floor(F.col(c) / CELL))).alias(f"c{c}") for c in "xy"]
            grid = state.groupBy(*at).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
            table = np.array([tuple(r) for r in grid.orderBy("cx", "cy").collect()], dtype="float64")  # at most (2 GRID + 1)^2
            sent = state.join(wanted, "id").select("id", "x", "y", F.explode("slices").alias("to"), "slice")
            sent = sent.select(F.col("to").alias("slice"), "id", "x", "y", (F.col("to") == F.col("slice")).alias("own"))
            moved = sent.groupBy("slice").cogroup(edges.groupBy("slice")).applyInArrow(_mover(table, alpha, n), "id bigint, x double, y double")
            state = cut_lineage(moved, True)
    finally:
        edges.unpersist()
        wanted.unpersist()
    return state


def neighbour_map(df: DataFrame, key: str = "orig_index", emb_col: str = "embedding", k: int = 15, rounds: int = 20,
                  seed: int = 42) -> DataFrame:
    """``df`` with the coordinates ``x`` and ``y`` of its vectors on a neighbour-preserving map.

    Rows with a null vector, a null element, NaN or a null key have no coordinates.  Rows that repeat a key share the place of
    one of them (the least vector); equal vectors under other keys lie next to each other.  The same seed gives the same map.
    """
    ok = F.col("e").isNotNull() & F.col("id").isNotNull() & ~F.exists("e", lambda v: v.isNull() | F.isnan(v))
    kind = "array<float>" if dict(df.dtypes)[emb_col] == "array<float>" else "array<double>"  # floats travel as such
    points = cut_lineage(df.select(F.col(key).cast("bigint").alias("id"), F.col(emb_col).cast(kind).alias("e")).filter(ok)
                         .groupBy("id").agg(F.min("e").alias("e")))
    home = _home(points)
    placed = layout(points, fuzzy_edges(neighbour_descent(points, k, seed=seed, home=home)), rounds, seed=seed, home=home)
    placed = placed.withColumnRenamed("id", "_place")
    return df.join(placed, F.col(key).cast("bigint") == F.col("_place"), "left").drop("_place")
