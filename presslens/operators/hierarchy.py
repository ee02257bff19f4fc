"""Density clusters without a distance threshold (M06): the density hierarchy on Spark.

1. Core distances: the distance within which ``min_pts`` rows lie, by an exact search in cells.
2. A spanning tree of the mutual reachability distance (the largest of both core distances and the distance) in Boruvka rounds.
   Every component takes its cheapest known edge to another one; it is certain if no unseen point can be nearer, and only
   points for which that cannot be said search the cells that are near enough.
3. The hierarchy of components by rising level, bottom up.  Components that hold at most ``group_rows`` nodes below a
   level are independent of each other and folded in parallel, one group each; every one becomes a single node with its size and the state
   of its cluster, and the next round goes on above that level.  No task sees the whole tree.
4. A cluster is a component of ``min_size`` rows or more; it ends where two such components meet.  Its stability is the sum over its rows of
   1/level when they joined, less 1/level at its end.  Of a cluster and its descendants those with the larger sum of stabilities are chosen.

Equal levels are one event (a merge of any number of components), so that the answer does not depend on which of several
cheapest trees was found.  Rows of one vector are one point with a weight; they count as joined at the least level of the tree.

Defined results: null vectors are noise; a table whose components never split (one point, no point, one blob) is all noise unless
``allow_single`` is set; cluster ids are the smallest key of a member.  All edges of one level within one component are folded together, however many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.operators import cells
from presslens.operators.clustering import connected_components
from presslens.session import cut_lineage

#: Nodes of a component that one task folds.
GROUP_ROWS = 500_000


def core_points(points: DataFrame, min_pts: int, **search) -> tuple[cells.Directory, DataFrame, DataFrame]:
    """Directory, points (id, e, weight, cell, sub, core, reach) and known neighbours (a, b, d).

    ``reach``: every point that is not among the known neighbours lies at least that far away.
    """
    where, placed, near = cells.k_nearest(points, max(1, min_pts - 1), extra=("weight",), **search)
    known = cut_lineage(near.select(F.col("id").alias("a"), F.explode("near").alias("n")).select("a", F.col("n.t").alias("b"), F.col("n.d").alias("d")))
    weight = placed.select(F.col("id").alias("b"), F.col("weight").alias("w"))
    ordered = known.join(weight, "b").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("d", "b", "w"))).alias("l"))
    # the first neighbour with which the weights reach min_pts
    start = F.struct(F.col("weight").cast("bigint").alias("have"), F.lit(None).cast("double").alias("core"))
    step = lambda s, x: F.struct((s["have"] + x["w"]).alias("have"), F.coalesce(
        s["core"], F.when((s["have"] < min_pts) & (s["have"] + x["w"] >= min_pts), x["d"])).alias("core"))
    last = F.try_element_at("l", F.lit(-1))["d"]
    joined = placed.join(ordered.withColumnRenamed("a", "id"), "id", "left").withColumn("l", F.coalesce("l", F.array().cast("array<struct<d:double,b:bigint,w:bigint>>")))
    scanned = joined.withColumn("s", F.aggregate("l", start, step))
    # fewer than min_pts rows in the whole table: the farthest counts
    core = F.when(F.col("weight") >= min_pts, F.lit(0.0)).otherwise(F.coalesce(F.col("s.core"), last, F.lit(0.0)))
    reach = F.when(F.size("l") >= max(1, min_pts - 1), last).otherwise(F.lit(float("inf")))
    return where, cut_lineage(scanned.select("id", "e", "weight", "cell", "sub", core.alias("core"), reach.alias("far"))), known


def spanning_edges(points: DataFrame, min_pts: int, rounds: int = 60, **search) -> tuple[DataFrame, DataFrame]:
    """Points with core distances, and edges (a, b, w) that connect them as a least spanning tree does at every level."""
    import numpy as np
    import pyarrow as pa

    where, placed, known = core_points(points, min_pts, **search)
    core = placed.select("id", "core")
    edges = cut_lineage(known.join(core.select(F.col("id").alias("a"), F.col("core").alias("ca")), "a").join(
        core.select(F.col("id").alias("b"), F.col("core").alias("cb")), "b").select("a", "b", F.greatest("d", "ca", "cb").alias("w")))
    part = cut_lineage(placed.select("id", F.col("id").alias("part")))
    tree: DataFrame | None = None

    def outside(got):
        near, room = cells.squared(got)
        least = np.maximum(got["q_core"][:, None], got["t_core"][None])
        cost = np.maximum(near, least ** 2)
        cost[got["q_part"][:, None] == got["t_part"][None]] = np.inf
        x, y = np.nonzero((cost <= cost.min(axis=1, keepdims=True) + room) & np.isfinite(cost))
        if not len(x):
            return
        w = np.maximum(np.sqrt(((got["q_e"][x] - got["t_e"][y]) ** 2).sum(1)), least[x, y])
        order = np.lexsort((got["t_id"][y], w, x))
        x, y, w = x[order], y[order], w[order]
        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        yield pa.RecordBatch.from_arrays([pa.array(got["q_id"][x[first]]), pa.array(got["t_id"][y[first]]), pa.array(w[first])], names=["a", "b", "w"])

    for _ in range(rounds):
        if part.select("part").distinct().limit(2).count() < 2:
            empty = edges.limit(0)
            return placed, tree if tree is not None else empty
        pa_, pb = part.select(F.col("id").alias("a"), F.col("part").alias("pa")), part.select(F.col("id").alias("b"), F.col("part").alias("pb"))
        crossing = edges.join(pa_, "a").join(pb, "b").filter("pa <> pb")
        both = crossing.select("pa", "w", "a", "b").unionByName(crossing.select(F.col("pb").alias("pa"), "w", "a", "b"))
        best = cut_lineage(both.groupBy("pa").agg(F.min(F.struct("w", "a", "b")).alias("x")))
        asked = placed.join(part, "id").join(best.select(F.col("pa").alias("part"), F.col("x.w").alias("reach")), "part", "left").withColumn(
            "reach", F.coalesce("reach", F.lit(float("inf"))))
        here = cut_lineage(asked)
        unsure = here.filter(F.greatest("core", "far") < F.col("reach"))
        found = cells.meet(unsure, here, where, outside, "a bigint, b bigint, w double", extra=("core", "part"),
                           **({"block_rows": search["block_rows"]} if "block_rows" in search else {}))
        more = found.join(pa_, "a").select("pa", F.struct("w", "a", "b").alias("x"))
        chosen = cut_lineage(best.unionByName(more).groupBy("pa").agg(F.min("x").alias("x")).select("x.a", "x.b", "x.w").distinct())
        tree = chosen if tree is None else tree.unionByName(chosen)
        links = chosen.join(pa_, "a").join(pb, "b").select("pa", "pb")
        both_ways = links.select(F.col("pa").alias("a"), F.col("pb").alias("b")).union(links.select("pb", "pa"))
        merged = connected_components(both_ways, part.select("part").distinct(), "part")
        part = cut_lineage(part.join(merged, "part").select("id", F.col("label").alias("part")))
    raise RuntimeError(f"the spanning tree is not whole after {rounds} rounds")


NODE = "node bigint, size bigint, cluster string, joined double, best double, leaf boolean"
FOLDED = "kind string, node bigint, top bigint, size bigint, cluster string, joined double, best double, leaf boolean, parent string, stability double, chosen boolean"


def fold(nodes: list[tuple], edges: list[tuple], min_size: int) -> tuple[dict, list[tuple], list[tuple]]:
    """Merge the nodes of a component along its edges, level by level.

    ``nodes``: (node, size, cluster or None, joined, best, leaf); ``edges``: (a, b, level).  Returns the state of
    every remaining component, the (node, cluster) of nodes that joined one, and the clusters that ended.
    """
    from itertools import groupby

    top = {n[0]: n[0] for n in nodes}
    state = {n[0]: list(n[1:]) for n in nodes}
    members = {n[0]: [n[0]] if n[2] is None else [] for n in nodes}  # nodes that belong to no cluster yet
    joined_to: list[tuple] = []
    ended: list[tuple] = []

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for level, some in groupby(sorted(edges, key=lambda e: e[2]), key=lambda e: e[2]):
        groups: dict[int, set[int]] = {}
        for a, b, _ in some:
            x, y = find(a), find(b)
            if x != y:
                root, gone = min(x, y), max(x, y)
                groups[root] = groups.pop(root, {root}) | groups.pop(gone, {gone})
                top[gone] = root
        for root, parts in groups.items():
            size = sum(state[p][0] for p in parts)
            big = sorted(p for p in parts if state[p][1] is not None)
            loose = [m for p in parts if state[p][1] is None for m in members[p]]
            small = sum(state[p][0] for p in parts if state[p][1] is None)
            if len(big) == 1:
                _, cluster, joined, best, leaf = state[big[0]]
                new = [size, cluster, joined + small / level, best, leaf]
            elif big or size >= min_size:
                cluster = f"{root}@{level!r}"
                best = 0.0
                for p in big:
                    s, c, joined, under, leaf = state[p]
                    stable = joined - s / level
                    chosen = leaf or stable >= under
                    ended.append((c, cluster, stable, chosen))
                    best += stable if chosen else under
                new = [size, cluster, size / level, best, not big]
            else:
                new = [size, None, 0.0, 0.0, True]
            for p in parts:
                if p != root:
                    members.pop(p)
                    state.pop(p)
            state[root] = new
            if new[1] is None:
                members[root] = loose
            else:
                joined_to += [(m, new[1]) for m in loose]
                members[root] = []
    return {r: (*s, members[r]) for r, s in state.items()}, joined_to, ended


def _fold_group(edges: DataFrame, nodes: DataFrame, min_size: int) -> DataFrame:
    """Every component's fold; ``edges`` (top, a, b, w) and ``nodes`` (top, node, ...) meet by component."""
    import pandas as pd

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(r.node), int(r.size_), r.cluster if isinstance(r.cluster, str) else None, float(r.joined), float(r.best), bool(r.leaf))
                for r in n.rename(columns={"size": "size_"}).itertuples()]
        left, joined, ended = fold(rows, list(zip(e["a"].tolist(), e["b"].tolist(), e["w"].tolist(), strict=True)), min_size)
        (root, (size, cluster, total, best, leaf, _)), = left.items()  # the edges connect the group
        of = dict(joined)
        out = [("node", node, root, 0, of.get(node), 0.0, 0.0, False, None, 0.0, False) for node, *_ in rows]
        out.append(("state", root, root, size, cluster, total, best, leaf, None, 0.0, False))
        out += [("end", root, root, 0, c, 0.0, 0.0, False, parent, stable, chosen) for c, parent, stable, chosen in ended]
        return pd.DataFrame(out, columns=[f.split()[0] for f in FOLDED.split(", ")])

    return nodes.groupBy("top").cogroup(edges.groupBy("top")).applyInPandas(run, FOLDED)


def hierarchy_clusters(df: DataFrame, min_pts: int = 5, min_size: int = 5, key: str = "orig_index", emb_col: str = "embedding",
                       out: str = "cluster", noise: int = -1, allow_single: bool = False, group_rows: int = GROUP_ROWS, **search) -> DataFrame:
    """M06 without eps: (key, ``out``), the most stable clusters of the density hierarchy, ``noise`` for all other rows."""
    src = df.select(F.col(key).cast("bigint").alias("key"), F.col(emb_col).cast("array<double>").alias("e"))
    points = cut_lineage(src.filter(F.col("e").isNotNull()).groupBy("e").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("weight")))
    placed, edges = spanning_edges(points, min_pts, **search)
    edges = cut_lineage(edges)
    least = edges.agg(F.min("w")).first()[0] or 1.0
    big = F.col("weight") >= min_size
    nodes = cut_lineage(placed.select(
        F.col("id").alias("node"), F.col("weight").cast("bigint").alias("size"), F.when(big, F.concat(F.col("id").cast("string"), F.lit("@0"))).alias("cluster"),
        F.when(big, F.col("weight") / F.lit(least)).otherwise(F.lit(0.0)).alias("joined"), F.lit(0.0).alias("best"), F.lit(True).alias("leaf")))
    # each point: the node that it is part of, and the cluster that it joined first
    at = cut_lineage(nodes.select(F.col("node").alias("id"), "node", "cluster"))
    left, ended = edges, None
    while (todo := left.count()):
        some, limit = left, todo
        while True:
            tops = connected_components(some.select("a", "b").union(some.select("b", "a")), nodes.select("node"), "node")
            largest = tops.groupBy("label").count().agg(F.max("count")).first()[0]
            if largest <= group_rows:
                break
            # as many of the lowest edges as may fit; all of one level go together
            limit = max(1, limit // 2)
            lowest = left.select("w").orderBy("w").limit(limit).agg(F.max("w")).first()[0]
            some = left.filter(F.col("w") <= F.lit(lowest))
            if limit == 1:
                tops = connected_components(some.select("a", "b").union(some.select("b", "a")), nodes.select("node"), "node")
                break
        tops = tops.withColumnRenamed("label", "top")
        many = tops.groupBy("top").count().filter("count > 1").select("top")
        group = tops.join(many, "top")
        inside = some.join(group.select(F.col("node").alias("a"), "top"), "a").select("top", "a", "b", "w")
        folded = cut_lineage(_fold_group(inside, nodes.join(group, "node").select(F.col("top").alias("top"), *nodes.columns), min_size))
        moved = folded.filter("kind = 'node'").select("node", "top", F.col("cluster").alias("now"))
        at = cut_lineage(at.join(moved, "node", "left").select("id", F.coalesce("top", "node").alias("node"), F.coalesce("cluster", "now").alias("cluster")))
        state = folded.filter("kind = 'state'").select(*nodes.columns)
        nodes = cut_lineage(nodes.join(group.select("node"), "node", "left_anti").unionByName(state))
        more = folded.filter("kind = 'end'").select("cluster", "parent", "stability", "chosen")
        ended = more if ended is None else ended.unionByName(more)
        rest = left.join(some.select("a", "b", "w"), ["a", "b", "w"], "left_anti")
        a, b = (moved.select(F.col("node").alias(c), F.col("top").alias(f"t{c}")) for c in "ab")
        left = cut_lineage(rest.join(a, "a", "left").join(b, "b", "left").select(
            F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"), "w").filter("a <> b"))
    labels = _chosen(ended, nodes, allow_single, df.sparkSession)
    named = at.join(labels, "cluster").select("id", "label")
    ids = named.groupBy("label").agg(F.min("id").alias("name"))
    final = placed.select("id", "e").join(named.join(ids, "label").select("id", "name"), "id").select("e", "name")
    rows = src.join(final, "e", "left")
    return rows.select(F.col("key").cast(df.schema[key].dataType).alias(key), F.coalesce("name", F.lit(noise)).cast("long").alias(out))


def _chosen(ended: DataFrame | None, nodes: DataFrame, allow_single: bool, spark) -> DataFrame:
    """(cluster, label): for every cluster the topmost chosen one above it or itself, by pointer doubling."""
    root = nodes.filter("cluster IS NOT NULL").select("cluster", F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("stability"),
                                                      (F.lit(allow_single) & F.col("leaf")).alias("chosen"))
    table = root if ended is None else root.unionByName(ended)
    walk = cut_lineage(table.select("cluster", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("cluster")).alias("label")))
    while walk.filter("up IS NOT NULL").limit(1).count():
        above = walk.select(F.col("cluster").alias("up"), F.col("up").alias("up2"), F.col("label").alias("label2"))
        walk = cut_lineage(walk.join(above, "up", "left").select("cluster", F.col("up2").alias("up"), F.coalesce("label2", "label").alias("label")))
    return walk.filter("label IS NOT NULL").select("cluster", "label")
