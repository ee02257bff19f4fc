"""Exact search in cells: an inverted file over vectors with radii as bounds.

Points are assigned to the nearest of a bounded number of pivots (points drawn by hash).  A cell is described by its pivot
and its radius, the largest distance of a member: no member lies nearer to a query than the distance of its pivot less
the radius (triangle inequality).  A query first meets its own cell, which gives an upper bound, and then only the cells
whose bound does not exceed it.  Cells that lie together make up slices of bounded size.  A query is sent once to each slice that holds a cell
for it, not to each cell; a task holds a slice and a share of the queries and compares them in matrix products of bounded size.
Answers are exact; how many cells can be left out depends on the data (most in few dimensions, few among evenly
spread vectors in many).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.session import cut_lineage

#: Bound of the pivots, whose vectors travel with the search function.
MOST_CELLS = 2048
#: Most queries of a matrix product; a slice holds SLICE_BLOCKS times as many points, and a share SHARE_BLOCKS times as many queries.
BLOCK_ROWS, SLICE_BLOCKS, SHARE_BLOCKS = 512, 128, 256
#: Most pairs of a matrix product, and most points of one in single precision.
MOST_PAIRS, BLOCK_POINTS = 4_000_000, 2048


class Directory(NamedTuple):
    pivots: np.ndarray
    radius: np.ndarray
    subs: list[int]
    before: list[int]  # points of the cells before each, in an order in which cells nearby follow each other
    step: list[int]  # points of a sub
    slice_rows: int

    def slice_of(self, cell: Column, sub: Column) -> Column:
        at = [F.try_element_at(F.array(*[F.lit(x).cast("long") for x in v]), cell + 1) for v in (self.before, self.step)]
        return F.floor((at[0] + sub * at[1]) / F.lit(self.slice_rows)).cast("int")

    def slices(self) -> np.ndarray:
        """Which slices (columns) hold points of each cell (rows)."""
        ends = [(b // self.slice_rows, (b + max(0, n - 1) * s) // self.slice_rows) for b, n, s in zip(self.before, self.subs, self.step, strict=True)]
        held = np.zeros((len(ends), 1 + max(e[1] for e in ends)), bool)
        for cell, (first, last) in enumerate(ends):
            held[cell, first:last + 1] = self.subs[cell] > 0
        return held

    def bounds(self, X: np.ndarray, share: float = 1.0, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Least distance of every row to any member of every cell (of ``some``; rounded down); ``share`` 0 leaves the radius out."""
        pivots = self.pivots[some]
        d = np.sqrt(np.maximum((X * X).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (X @ pivots.T), 0))
        return d - share * (self.radius[some][None] + 1e-6 * (1 + d))


def _matrix(col, n: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(n, -1) if n else np.zeros((0, 1))


def _nearby(pivots: np.ndarray, some: np.ndarray) -> list[int]:
    """The pivots in an order in which neighbours follow each other: halved again and again along the widest axis."""
    if len(some) < 2:
        return some.tolist()
    some = some[np.argsort(pivots[some, np.ptp(pivots[some], axis=0).argmax()], kind="stable")]
    return _nearby(pivots, some[:len(some) // 2]) + _nearby(pivots, some[len(some) // 2:])


def build(points: DataFrame, extra: tuple[str, ...] = (), most_cells: int = MOST_CELLS,
          block_rows: int = BLOCK_ROWS) -> tuple[Directory, DataFrame]:
    """The directory, and the points (id, e, *extra) with their ``cell``, ``sub`` and distance ``far`` to the pivot."""
    import pyarrow as pa

    count = points.count()
    wanted = max(1, min(most_cells, round(count ** 0.5)))
    drawn = points.select("id", "e").orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    pivots = np.array([r["e"] for r in drawn], dtype="float64").reshape(len(drawn), -1 if drawn else 1)

    def assign(batches):
        for b in batches:
            X = _matrix(b.column("e"), b.num_rows)
            cell = np.zeros(b.num_rows, np.int32)
            far = np.zeros(b.num_rows)
            if b.num_rows:
                d = (X * X).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (X @ pivots.T)
                cell = d.argmin(1).astype(np.int32)
                far = np.sqrt(((X - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=[*b.schema.names, "cell", "far"])

    columns = points.select("id", "e", *extra)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema)
    placed = cut_lineage(columns.mapInArrow(assign, f"{schema}, cell int, far double"))
    radius, rows, subs = np.zeros(max(1, len(drawn))), [0] * max(1, len(drawn)), [0] * max(1, len(drawn))
    for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row per pivot
        radius[r["cell"]], rows[r["cell"]], subs[r["cell"]] = r["far"], r["n"], -(-r["n"] // block_rows)
    before, total = [0] * len(rows), 0
    for c in _nearby(pivots, np.arange(len(drawn))):
        before[c], total = total, total + rows[c]
    n_subs = F.try_element_at(F.array(*[F.lit(s) for s in subs]), F.col("cell") + 1)
    where = Directory(pivots, radius, subs, before, [n // max(1, s) for n, s in zip(rows, subs, strict=True)], SLICE_BLOCKS * block_rows)
    return where, placed.withColumn("sub", F.pmod(F.xxhash64("id"), F.greatest(n_subs, F.lit(1))).cast("int"))


def place(where: Directory, queries: DataFrame) -> DataFrame:
    """Queries (id, e) with the ``cell`` of the nearest pivot."""
    import pyarrow as pa

    def assign(batches):
        for b in batches:
            near = where.bounds(_matrix(b.column("e"), b.num_rows), 0.0).argmin(1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=["id", "e", "cell"])

    if not len(where.pivots):
        return cut_lineage(queries.limit(0).withColumn("cell", F.lit(0)))
    return cut_lineage(queries.select("id", "e").mapInArrow(assign, f"id bigint, e {queries.schema['e'].dataType.simpleString()}, cell int"))


def meet(queries: DataFrame, points: DataFrame, where: Directory, compare: Callable, schema: str, own: bool = False,
         block_rows: int = BLOCK_ROWS, extra: tuple[str, ...] = (), whole: bool = False, spare: Callable | None = None) -> DataFrame:
    """Rows of ``compare(got)`` for queries (id, e, cell, reach, *extra) and the points (id, e, cell, sub, *extra) that they have to meet.

    ``own``: only the query's own cell; else all cells within ``reach``.  ``got`` has q_id, q_e, q_reach, t_id, t_e (and q_, t_ of ``extra``) as arrays: some
    queries and all points that one of them has to meet in one slice.  A pair of query and point is compared once at most.
    ``whole``: ``compare`` is called once a task with its queries, its points (both in the order of their cells) and the plan: places of some
    queries and of all points that one of them has to meet.
    ``spare``: from the columns ``extra`` of queries and some cells, which cells (columns) each query need not meet.
    """
    import pyarrow as pa

    held = where.slices()
    every = np.arange(len(held))

    def wanted(x, some):
        """Which cells (columns, of ``some``) each query has to meet."""
        met = where.bounds(x["e"], 1.0, some) <= x["reach"][:, None] if not own else x["cell"][:, None] == some[None]
        return met & ~spare(x, some) if spare else met

    def deal(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                x = {n: part.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "reach", *extra)} | {"e": _matrix(part.column("e"), part.num_rows)}
                q, c = np.nonzero(wanted(x, every).astype(np.float32) @ held.astype(np.float32))
                yield pa.RecordBatch.from_arrays([*[x.take(pa.array(q)) for x in part.columns], pa.array(c.astype(np.int32))], names=[*part.schema.names, "slice"])

    source = queries.select("id", "e", "cell", "reach", *extra)
    sent = source.mapInArrow(deal, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema) + ", slice int")
    count = queries.count()
    busy = -(-2 * queries.sparkSession.sparkContext.defaultParallelism // held.shape[1])  # small inputs are dealt out, too
    shares = max(1, -(-count // (SHARE_BLOCKS * block_rows)), min(busy, -(-count // block_rows)))
    asked = sent.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int"))
    slices = points.select("id", "e", "cell", *extra, where.slice_of(F.col("cell"), F.col("sub")).alias("slice"),
                           F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    empty = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]).empty_table()

    def arrays(table, sort):
        got = {n: table[n].combine_chunks() for n in table.schema.names if n not in ("slice", "share", "e")}
        got = {n: v.to_numpy(zero_copy_only=False) for n, v in got.items()} | {"e": _matrix(table["e"].combine_chunks(), table.num_rows)}
        order = np.argsort(got["cell"], kind="stable")
        return {n: v[order] for n, v in got.items()} if sort else got

    def run(q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows or not t.num_rows:
            return empty
        ask, have = arrays(q, True), arrays(t, True)
        here, first = np.unique(have["cell"], return_index=True)
        last = np.append(first[1:], len(have["cell"]))

        def plan():
            i, size = 0, block_rows
            while i < len(ask["id"]):
                x = {n: v[i:i + size] for n, v in ask.items()}
                met = np.flatnonzero(wanted(x, here).any(0))
                among = int((last[met] - first[met]).sum())
                if among * len(x["e"]) > MOST_PAIRS and len(x["e"]) > 1 and not whole:  # fewer queries at once
                    size = max(1, MOST_PAIRS // among)
                end = min(i + size, len(ask["id"]))
                if among:
                    yield np.arange(i, end), np.concatenate([np.arange(first[c], last[c]) for c in met])
                i = end
                size = block_rows if size * 2 > block_rows else size * 2

        def parts():
            for q, t in plan():
                yield {f"q_{n}": v[q] for n, v in ask.items()} | {f"t_{n}": v[t] for n, v in have.items()}

        found = compare(ask, have, plan()) if whole else (b for got in parts() for b in compare(got))
        return pa.concat_tables([empty, *[pa.Table.from_batches([b]) for b in found]])

    return asked.groupBy("slice", "share").cogroup(slices.groupBy("slice", "share")).applyInArrow(run, schema)


class Frame:
    """Where single precision stands for vectors: moved and scaled so that little is lost.  It only proposes; double precision decides."""

    def __init__(self, X: np.ndarray, *more: np.ndarray):
        some = [x[np.isfinite(x).all(1)] for x in (X, *more)]
        self.centre = some[0].mean(0, dtype="float64") if len(some[0]) else np.zeros(X.shape[1])
        most = max((float(np.abs(x - self.centre).max()) for x in some if len(x)), default=0.0)
        self.scale = 2.0 ** -np.frexp(most)[1] if 0 < most < np.inf else 1.0
        self.unit = 1.1 * (X.shape[1] + 10) * 2.0 ** -24

    def sides(self, X: np.ndarray, points: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose products (queries by points) are - distance^2 / 2 in this frame, and their squared lengths.

        A product is wrong by at most ``unit`` times the sum of both squared lengths.  A point that is not finite is at no
        finite distance."""
        Y = (X - self.centre) * self.scale
        bad = ~np.isfinite(Y).all(1)
        Y[bad] = 0
        sq = (Y * Y).sum(1)
        out = np.empty((len(Y), Y.shape[1] + 2), np.float32)
        out[:, :-2] = Y
        out[:, -2], out[:, -1] = (-sq / 2, 1) if points else (1, -sq / 2)
        out[bad, -2 if points else -1] = -np.inf
        return out, sq


def squared(got: dict) -> tuple[np.ndarray, float]:
    """Squared distances by a matrix product, and how far rounding may have moved them."""
    A, B = got["q_e"], got["t_e"]
    a, b = (A * A).sum(1), (B * B).sum(1)
    near = A @ B.T
    near *= -2
    near += a[:, None]
    near += b
    return near, 1e-9 * (1 + float(a.max()) + float(b.max()))


def blocks(frame: Frame, ask: dict, have: dict, plan):
    """Products of the plan by blocks: places of queries and points, the products (:class:`Frame`) and by how much each row may be wrong."""
    T, sq_t = frame.sides(have["e"], True)
    most = float(sq_t.max())
    for q, t in plan:
        Q, sq_q = frame.sides(ask["e"][q], False)
        room = frame.unit * (sq_q + most)
        for i in range(0, len(t), BLOCK_POINTS):
            some = t[i:i + BLOCK_POINTS]
            near = T[some[0]:some[-1] + 1] if some[-1] - some[0] < len(some) else T[some]
            yield q, some, Q @ near.T, room


def within(ask: dict, have: dict, q: np.ndarray, t: np.ndarray, G: np.ndarray, room: np.ndarray, frame: Frame, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different ids within ``eps`` among the queries and points of a block of products."""
    least = -0.5 * (eps * frame.scale) ** 2
    x, y = np.nonzero((G >= (least - room)[:, None]))
    sure = G[x, y] > least + room[x]
    x, y = q[x], t[y]
    for i in np.array_split(np.flatnonzero(~sure), 1 + len(x) // 50_000):  # rounding may have moved these
        sure[i] = ((ask["e"][x[i]] - have["e"][y[i]]) ** 2).sum(1) <= eps * eps
    sure &= ask["id"][x] != have["id"][y]
    return x[sure], y[sure]


def nearest(ask: dict, have: dict, plan):
    """The nearest point of every query, as far as it lies within its reach: (place of the query, distance^2, id), ties by id."""
    frame = Frame(have["e"], ask["e"])
    n, dims = len(ask["id"]), have["e"].shape[1]
    best = np.full(n, -np.inf)  # greatest product so far, from below: what lies beyond the reach is not asked for
    best[:] = -0.5 * ((ask["reach"] * (1 + 1e-9) + 1e-9) * frame.scale) ** 2
    x, t, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    held = 0

    def least():  # of what is left, the nearest of each query
        q, p, g = (np.concatenate(v) for v in (x, t, d))
        far = np.concatenate([np.zeros(0)] + [((ask["e"][q[i:i + 50_000]] - have["e"][p[i:i + 50_000]]) ** 2).sum(1) for i in range(0, len(q), 50_000)])
        ok = far == far
        q, p, g, far = q[ok], p[ok], g[ok], far[ok]
        order = np.lexsort((have["id"][p], far, q))
        q, p, g, far = q[order], p[order], g[order], far[order]
        head = np.flatnonzero(np.concatenate((np.ones(min(1, len(q)), bool), q[1:] != q[:-1])))
        return q[head], p[head], g[head], far[head]

    for q, some, G, room in blocks(frame, ask, have, plan):
        top = G.max(1)
        rows = np.flatnonzero((top >= best[q] - 2 * room) & np.isfinite(top))
        if not len(rows):
            continue
        now = np.maximum(best[q[rows]], top[rows])
        i, j = np.nonzero(G[rows] >= (now - 2 * room[rows])[:, None])
        best[q[rows]] = now
        x.append(q[rows[i]])
        t.append(some[j])
        d.append(G[rows[i], j] + 2.0 * room[rows[i]])
        held += len(i)
        if held > MOST_PAIRS // 2 // max(1, dims // 64) or held > 4 * n + MOST_PAIRS // 8:
            late = [np.concatenate(v) for v in (x, t, d)]
            ok = late[2] >= best[late[0]]  # others have been surpassed
            x, t, d = ([v[ok]] for v in late)
            if ok.sum() > n:  # many ties
                x, t, d = ([v] for v in least()[:3])
            held = len(x[0])
    late = [np.concatenate(v) for v in (x, t, d)]
    ok = late[2] >= best[late[0]]
    x, t, d = ([v[ok]] for v in late)
    q, p, _, far = least()
    return q, far, have["id"][p]


def _nearest(got: dict, k: int):
    """The k nearest points of every query, itself left out: (q, id, d), ties by id."""
    near, room = squared(got)
    near[got["q_id"][:, None] == got["t_id"][None]] = np.inf
    k = min(k, near.shape[1])
    edge = np.partition(near, k - 1, axis=1)[:, k - 1]
    x, y = np.nonzero((near <= edge[:, None] + room) & np.isfinite(near))
    d = np.sqrt(((got["q_e"][x] - got["t_e"][y]) ** 2).sum(1))
    ids = got["t_id"][y]
    order = np.lexsort((ids, d, x))
    x, d, ids = x[order], d[order], ids[order]
    first = np.concatenate(([0], np.cumsum(np.bincount(x, minlength=len(near)))))[x]
    keep = (np.arange(len(x)) - first < k) & (d <= got["q_reach"][x] + 1e-9)
    return x[keep], ids[keep], d[keep]


def k_nearest(points: DataFrame, k: int, most_cells: int = MOST_CELLS, block_rows: int = BLOCK_ROWS,
              extra: tuple[str, ...] = ()) -> tuple[Directory, DataFrame, DataFrame]:
    """Directory, placed points and (id, near): the exact k nearest other points of each as an ordered array of (d, id).

    ``points`` has id (bigint) and e (array of double); fewer than k other points give all of them.
    """
    import pyarrow as pa

    where, placed = build(points, extra, most_cells, block_rows)

    def compare(got):
        x, ids, d = _nearest(got, k)
        yield pa.RecordBatch.from_arrays([pa.array(got["q_id"][x]), pa.array(ids), pa.array(d)], names=["q", "t", "d"])

    def merged(found: DataFrame) -> DataFrame:  # at most k entries of every slice met
        return found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "t"))), 1, k).alias("near"))

    schema = "q bigint, t bigint, d double"
    anywhere = placed.withColumn("reach", F.lit(float("inf")))
    home = cut_lineage(merged(meet(anywhere, placed, where, compare, schema, True, block_rows)))
    kth = F.when(F.size("near") >= k, F.try_element_at("near", F.lit(k))["d"])
    bounded = cut_lineage(placed.join(home.select(F.col("q").alias("id"), kth.alias("reach")), "id", "left").withColumn(
        "reach", F.coalesce("reach", F.lit(float("inf")))))
    return where, placed, cut_lineage(merged(meet(bounded, placed, where, compare, schema, False, block_rows)).withColumnRenamed("q", "id"))
