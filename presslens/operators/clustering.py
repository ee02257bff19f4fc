"""Clustering and reduction (M01-M10) with Spark ML and DataFrame joins.

* k-means, PCA and the elbow curve use ``pyspark.ml`` (k-means|| initialisation,
  distributed Gram matrix); vectors are converted with ``array_to_vector``.
* Density clusters (the study used HDBSCAN on a UMAP map, both single-machine)
  are re-aimed as exact DBSCAN: identical vectors are collapsed first (weights),
  an exact epsilon-join finds neighbours through a grid on an orthonormal
  projection (projected distance never exceeds the true one, so adjacent cells
  hold every true neighbour), compared in blocks of bounded size by matrix
  product, and connected components of core points come from min-label
  propagation, one lineage cut per round into the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslens.functions import vectors as VF
from presslens.operators import cells
from presslens.session import cut_lineage


def _features(df: DataFrame, emb_col: str, out: str = "_features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(out, array_to_vector(F.col(emb_col).cast("array<double>")))


def kmeans(df: DataFrame, k: int, seed: int = 42, emb_col: str = "embedding", out: str = "cluster",
           max_iter: int = 20):
    """K-means (k-means|| init).  Returns (rows with ``out``, centres as (cluster, centroid))."""
    from pyspark.ml.clustering import KMeans

    feats = _features(df, emb_col)
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol=out, maxIter=max_iter).fit(feats)
    pred = model.transform(feats).drop("_features")
    spark = df.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
                                    f"{out} int, centroid array<double>")
    return pred, centres


def column_means(df: DataFrame, emb_col: str = "embedding") -> list[float]:
    """Mean vector (one value per dimension; a bounded result) by a partial aggregate."""
    rows = (df.select(F.posexplode(emb_col).alias("_i", "_x")).groupBy("_i")
              .agg(F.avg(F.col("_x").cast("double")).alias("_m")).orderBy("_i").collect())
    return [float(r["_m"]) for r in rows]


def pca(df: DataFrame, k: int, emb_col: str = "embedding", out: str = "pca", center: bool = True) -> DataFrame:
    """Project on the top-k principal components.  Spark's PCA does not subtract the mean in
    ``transform``; with ``center=True`` the mean is removed first (sklearn's convention)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    src = df
    if center:
        mean = VF.vector_literal(column_means(df, emb_col))
        src = df.withColumn("_c", F.zip_with(F.col(emb_col), mean, lambda x, m: x.cast("double") - m))
    else:
        src = df.withColumn("_c", F.col(emb_col).cast("array<double>"))
    feats = _features(src, "_c")
    model = PCA(k=k, inputCol="_features", outputCol="_pca").fit(feats)
    return model.transform(feats).withColumn(out, vector_to_array("_pca")).drop("_features", "_pca", "_c")


def total_sse(df: DataFrame, emb_col: str = "embedding") -> float:
    """Sum of squared distances to the mean (the inertia of k = 1)."""
    mean = VF.vector_literal(column_means(df, emb_col))
    return float(df.agg(F.sum(VF.sq_distance(F.col(emb_col), mean))).first()[0] or 0.0)


def elbow_curve(df: DataFrame, ks: Sequence[int], seed: int = 42, emb_col: str = "embedding") -> DataFrame:
    """(k, inertia) for every k; k = 1 is the total variance (Spark k-means needs k >= 2).

    The vectors are cached once for the loop of fits (a bounded list of k)."""
    from pyspark.ml.clustering import KMeans

    feats = _features(df.select(emb_col), emb_col).select("_features").persist()
    rows = []
    try:
        for k in ks:
            if k == 1:
                rows.append((1, total_sse(df, emb_col)))
                continue
            model = KMeans(k=k, seed=seed, featuresCol="_features").fit(feats)
            rows.append((int(k), float(model.summary.trainingCost)))
    finally:
        feats.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def elbow_pick(curve: DataFrame, k_col: str = "k", inertia_col: str = "inertia") -> DataFrame:
    """K whose log inertia lies farthest from the chord between the ends of the curve.

    The gap is measured straight up or down at the same k: it differs from the perpendicular
    distance by one factor for the whole curve, so the pick is the same.  Ties go to the smaller k.
    The chord ends are scalars read from one aggregate.  An inertia of 0 (as many centres as points) has no logarithm and
    is left out; a curve without any other point has no pick (null)."""
    c = curve.filter(F.col(inertia_col) > 0).select(F.col(k_col), F.log(F.col(inertia_col)).alias("y"))
    lo, y_lo, hi, y_hi = c.agg(F.min(k_col), F.min_by("y", k_col), F.max(k_col), F.max_by("y", k_col)).first()
    if lo is None:
        return c.agg(F.max(k_col).alias("best_k"), F.max("y").alias("max_gap"))
    slope = (y_hi - y_lo) / (hi - lo) if hi > lo else 0.0
    gap = F.abs(F.col("y") - (F.lit(y_lo) + (F.col(k_col) - F.lit(lo)) * F.lit(slope)))
    return c.select(k_col, gap.alias("gap")).agg(
        F.max_by(F.col(k_col), F.struct(F.col("gap"), -F.col(k_col))).alias("best_k"), F.max("gap").alias("max_gap"))


# ---- density clusters --------------------------------------------------------------------------

#: Core points that all others meet to connect the parts of slices; they travel with the tasks.
HUBS = 1024


def _projection(df: DataFrame, emb_col: str, dims: int = 2) -> list[list[float]]:
    """The top ``dims`` principal axes (orthonormal) as Python lists (dims x d, bounded)."""
    from pyspark.ml.feature import PCA

    some = df.filter(F.col(emb_col).isNotNull())
    first = some.select(emb_col).first()
    if first is None or some.select(emb_col).limit(2).count() < 2:  # no axes: one cell holds all
        return [[0.0] * len(first[0])] if first else [[0.0]]
    dims = max(1, min(dims, len(first[0])))
    feats = _features(some, emb_col)
    model = PCA(k=dims, inputCol="_features", outputCol="_p").fit(feats)
    m = model.pc.toArray()  # d x dims, orthonormal columns
    return [[float(m[i][j]) for i in range(m.shape[0])] for j in range(dims)]


def _grid_blocks(points: DataFrame, eps: float, emb_col: str, id_col: str, weight_col: str, grid_dims: int,
                 block_rows: int) -> DataFrame:
    """Points packed into blocks of about ``block_rows`` vectors: (cell, sub, n_subs, ids, vecs, weights).

    The cell is the point's place in a grid of width ``eps`` on the top principal axes; a cell with
    more rows is split by a hash of the id, so no block grows with the data."""
    axes = _projection(points, emb_col, grid_dims)
    cell = F.array(*[F.floor(VF.dot(F.col(emb_col), VF.vector_literal(a)) / F.lit(eps)).cast("long") for a in axes])
    return _packed(points.select(id_col, emb_col, weight_col, cell.alias("cell")), emb_col, id_col, weight_col, block_rows)


def _packed(pts: DataFrame, emb_col: str, id_col: str, weight_col: str, block_rows: int, codes: str | None = None) -> DataFrame:
    """Blocks of the rows of one ``cell``; ``codes`` names an array column (one length) that goes along, flat."""
    subs = pts.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("n_subs"))
    # the salt keeps a hot cell's rows apart in the join that tells them their cell's size
    salts = 32
    salted = subs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = (pts.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
               .join(salted, ["cell", "_salt"])
               .withColumn("sub", F.pmod(F.xxhash64(id_col, F.lit(1)), F.col("n_subs")).cast("int")))
    along = [F.col(codes).alias("c")] if codes else []
    block = F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(emb_col).cast("array<double>").alias("e"),
                                    F.col(weight_col).cast("long").alias("w"), *along))
    return (rows.groupBy("cell", "sub", "n_subs").agg(block.alias("_b"))
                .select("cell", "sub", "n_subs", F.transform("_b", lambda r: r["i"]).alias("ids"),
                        F.flatten(F.transform("_b", lambda r: r["e"])).alias("vecs"),
                        F.transform("_b", lambda r: r["w"]).alias("weights"),
                        *([F.flatten(F.transform("_b", lambda r: r["c"])).alias("codes")] if codes else [])))


def _block_pairs(blocks: DataFrame, grid_dims: int, reach: Sequence[int] = (-1, 0, 1)) -> DataFrame:
    """Every pair of blocks from the same or adjacent cells, each pair once (smaller (cell, sub) first).

    The join key is one block, (cell, sub): a hot cell's blocks spread over many tasks."""
    import itertools

    offs = F.array(*[F.array(*[F.lit(d) for d in o]) for o in itertools.product(reach, repeat=grid_dims)])
    cells = blocks.groupBy("cell").agg(F.max("n_subs").alias("n"))
    own = [c for c in blocks.columns if c not in ("cell", "sub", "n_subs")]
    probe = (blocks.select(F.col("cell").alias("cell_a"), F.col("sub").alias("sub_a"), *[F.col(c).alias(f"{c}_a") for c in own],
                           F.explode(offs).alias("_o"))
                   .withColumn("cell", F.zip_with("cell_a", "_o", lambda c, o: c + o)).drop("_o")
                   .filter(F.col("cell_a") <= F.col("cell"))
                   .join(cells, "cell")
                   .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
                   .filter((F.col("cell_a") < F.col("cell")) | (F.col("sub_a") <= F.col("sub"))))
    return probe.join(blocks.drop("n_subs"), ["cell", "sub"])


def epsilon_neighbours(points: DataFrame, eps: float, emb_col: str = "embedding", id_col: str = "vid",
                       weight_col: str = "weight", grid_dims: int = 2, block_rows: int = 512) -> DataFrame:
    """All pairs (a, b, weight of b), a != b, with Euclidean distance <= eps (exact).

    Blocking: a grid of width ``eps`` on the top ``grid_dims`` principal axes (orthonormal, so a
    projected distance never exceeds the true one): a true neighbour lies in the same or an
    adjacent cell.  Cells are packed into blocks of about ``block_rows`` vectors and compared block
    by block with one matrix product; only true neighbours become rows.  More axes cut more
    comparisons when the vectors spread over them.
    """
    dims = len(_projection(points, emb_col, grid_dims))
    blocks = cut_lineage(_grid_blocks(points, eps, emb_col, id_col, weight_col, grid_dims, block_rows))
    key = points.schema[id_col].dataType.simpleString()
    return _block_pairs(blocks, dims).mapInArrow(_comparer(eps), f"a {key}, b {key}, wb long")


def _comparer(eps: float):
    """Arrow function from pairs of blocks to their neighbours within ``eps``: (a, b, wb).

    Blocks with ``codes`` (the bucket of each row in every table) name a pair only in the first table that it shares."""

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def flat(col, i):
            return col[i].values.to_numpy(zero_copy_only=False)

        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                ia, ib = flat(col["ids_a"], i), flat(col["ids"], i)
                wa, wb = flat(col["weights_a"], i), flat(col["weights"], i)
                A, B = flat(col["vecs_a"], i).reshape(len(ia), -1), flat(col["vecs"], i).reshape(len(ib), -1)
                # the product only proposes (with room for rounding); the difference decides
                near = (A * A).sum(1)[:, None] + (B * B).sum(1)[None, :] - 2 * (A @ B.T)
                room = 1e-9 * (1.0 + eps * eps + float((A * A).sum(1).max()) + float((B * B).sum(1).max()))
                x, y = np.nonzero(near <= eps * eps + room)
                hit = (((A[x] - B[y]) ** 2).sum(1) <= eps * eps) & (ia[x] != ib[y])
                x, y = x[hit], y[hit]
                if "codes" in col and len(x):
                    ca, cb = (flat(col[c], i).reshape(n, -1)[z] for c, n, z in (("codes_a", len(ia), x), ("codes", len(ib), y)))
                    first = (ca == cb).argmax(axis=1) == col["cell"][i][0].as_py()
                    x, y = x[first], y[first]
                a, b, w = ia[x], ib[y], wb[y]
                same = col["sub_a"][i].as_py() == col["sub"][i].as_py() and \
                    col["cell_a"][i].as_py() == col["cell"][i].as_py()
                if not same:  # a block against itself already holds both directions
                    a, b, w = np.concatenate([a, ib[y]]), np.concatenate([b, ia[x]]), np.concatenate([w, wa[x]])
                ids = batch.schema.field("ids").type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(a, ids), pa.array(b, ids), pa.array(w, pa.int64())],
                                                 names=["a", "b", "wb"])

    return compare


def _bucket_blocks(points: DataFrame, tables: int, bits: int, emb_col: str, id_col: str, weight_col: str, block_rows: int,
                   seed: int) -> DataFrame:
    """Blocks of the buckets (table, code) of random hyperplanes through the mean; every row is in one bucket of each table."""
    import numpy as np
    import pyarrow as pa

    middle = np.array(column_means(points, emb_col))
    planes = np.random.default_rng(seed).normal(size=(len(middle), tables * bits))
    power = 1 << np.arange(bits, dtype=np.int64)
    rows = points.select(id_col, F.col(emb_col).cast("array<double>").alias(emb_col), weight_col)

    def codes(batches):
        for b in batches:
            if not b.num_rows:
                continue
            X = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) - middle
            code = ((X @ planes > 0).reshape(len(X), tables, bits) * power).sum(2).astype(np.int64)
            ends = pa.array(np.arange(0, code.size + 1, tables), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(code.ravel()))],
                                             names=[*b.schema.names, "codes"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    coded = rows.mapInArrow(codes, f"{kinds}, codes array<bigint>")
    placed = coded.select("*", F.posexplode("codes").alias("_table", "_code")).withColumn(
        "cell", F.array(F.col("_table").cast("long"), F.col("_code"))).drop("_table", "_code")
    return _packed(placed, emb_col, id_col, weight_col, block_rows, "codes")


def likely_neighbours(points: DataFrame, eps: float, tables: int = 12, bits: int = 8, emb_col: str = "embedding", id_col: str = "vid",
                      weight_col: str = "weight", block_rows: int = 512, seed: int = 42) -> DataFrame:
    """Pairs as :func:`epsilon_neighbours`, but only those that share a bucket of one of ``tables`` tables.

    A bucket is the side of ``bits`` random hyperplanes through the mean.  A pair at the angle t (seen from the mean) is found with
    the probability 1 - (1 - (1 - t / pi)^bits)^tables; what is found is verified by its true distance, so no pair is wrong and
    each is named once.  Buckets have no cap: a large one is compared in blocks over many tasks.  Every vector is shuffled
    ``tables`` times.  It pays where neighbours are much closer than other rows; evenly spread vectors need the exact join.
    An empty table has no pairs.
    """
    key = points.schema[id_col].dataType.simpleString()
    if not points.head(1):
        return points.sparkSession.createDataFrame([], f"a {key}, b {key}, wb long")
    blocks = cut_lineage(_bucket_blocks(points, tables, bits, emb_col, id_col, weight_col, block_rows, seed))
    return _block_pairs(blocks, 2, (0,)).mapInArrow(_comparer(eps), f"a {key}, b {key}, wb long")


def likely_compared(points: DataFrame, tables: int = 12, bits: int = 8, emb_col: str = "embedding", id_col: str = "vid",
                    weight_col: str = "weight", block_rows: int = 512, seed: int = 42) -> int:
    """How many pairs :func:`likely_neighbours` compares (in every table, pairs inside a block both ways)."""
    pairs = _block_pairs(_bucket_blocks(points, tables, bits, emb_col, id_col, weight_col, block_rows, seed), 2, (0,))
    return pairs.agg(F.sum(F.size("ids_a").cast("long") * F.size("ids"))).first()[0] or 0


def compared_pairs(points: DataFrame, eps: float, emb_col: str = "embedding", id_col: str = "vid",
                   weight_col: str = "weight", grid_dims: int = 2, block_rows: int = 512) -> int:
    """How many pairs :func:`epsilon_neighbours` compares (each once, pairs inside a block both ways)."""
    blocks = _grid_blocks(points, eps, emb_col, id_col, weight_col, grid_dims, block_rows)
    pairs = _block_pairs(blocks, len(_projection(points, emb_col, grid_dims)))
    return pairs.agg(F.sum(F.size("ids_a").cast("long") * F.size("ids"))).first()[0] or 0


def _hits(got: dict, eps: float):
    """Which queries (rows) and points (columns) are different ids within ``eps``."""
    import numpy as np

    near, room = cells.squared(got)
    hit = near <= eps * eps - room * (1 + eps * eps)
    # the product only proposes; near the edge the difference decides
    x, y = np.nonzero((near <= eps * eps + room * (1 + eps * eps)) & ~hit)
    for i in range(0, len(x), 100_000):
        p, q = x[i:i + 100_000], y[i:i + 100_000]
        hit[p, q] = ((got["q_e"][p] - got["t_e"][q]) ** 2).sum(1) <= eps * eps
    hit[got["q_id"][:, None] == got["t_id"][None]] = False
    return hit


def _linked(chunks, eps: float):
    """(a, b, core): of the core queries and points of a task, edges that connect what all their neighbours connect (core 1), at
    most one a row; of the other queries, all their core neighbours (core 0), fewer than the density asks for."""
    import numpy as np
    import pyarrow as pa

    def batch(a, b, core):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), core, np.int32))], names=["a", "b", "core"])

    parent = ids = None
    for got in chunks:
        n = got["n"]
        if parent is None:
            parent, ids = np.arange(sum(n)), np.zeros(sum(n), np.int64)
        q_at, t_at = got["q_at"], n[0] + got["t_at"]
        ids[q_at], ids[t_at] = got["q_id"], got["t_id"]
        hit = _hits(got, eps)
        hit[:, got["t_core"] == 0] = False
        core = got["q_core"] == 1
        x, y = np.nonzero(hit[~core])
        yield batch(got["q_id"][~core][x], got["t_id"][y], 0)
        for i in np.flatnonzero(core):
            some = np.append(t_at[hit[i]], q_at[i])
            top = parent[some]
            while ((up := parent[top]) != top).any():
                top = up
            parent[top] = parent[some] = top.min()
    if parent is not None:
        while ((up := parent[parent]) != parent).any():
            parent = up
        a, b = ids, ids[parent]
        yield batch(a[a != b], b[a != b], 1)


def _density_links(points: DataFrame, eps: float, min_pts: int, emb_col: str) -> tuple[DataFrame, DataFrame]:
    """(vid, core), and (a, b) both ways: links that connect core points as all neighbours do, and those of other points to theirs.
    Points that share a vid count as one; where none do, :func:`_density_labels` does with far fewer comparisons.

    Every point meets the cells within ``eps`` (:mod:`presslens.operators.cells`) twice: to be counted, and to be linked.  Neighbours
    are told by matrix products of bounded size and never become rows, so what is written follows the points and not their pairs."""
    import numpy as np
    import pyarrow as pa

    where, placed = cells.build(points.select(F.col("vid").cast("bigint").alias("id"), F.col(emb_col).alias("e"), F.col("weight").cast("double").alias("weight")), ("weight",))
    asked = cut_lineage(placed.withColumn("reach", F.lit(float(eps))))

    def count(got):
        n = _hits(got, eps) @ got["t_weight"]
        yield pa.RecordBatch.from_arrays([pa.array(got["q_id"][n > 0]), pa.array(n[n > 0].astype(np.int64))], names=["a", "n"])

    counts = cells.meet(asked, asked, where, count, "a bigint, n bigint", extra=("weight",)).groupBy("a").agg(F.sum("n").alias("_nw"))
    known = cut_lineage(asked.join(counts.withColumnRenamed("a", "id"), "id", "left").withColumn(
        "core", (F.col("weight") + F.coalesce("_nw", F.lit(0)) >= min_pts).cast("int")).drop("_nw"))
    links = cut_lineage(cells.meet(known, known.filter("core = 1"), where, lambda ask, have, plan: _linked(
        ({f"q_{n}": v[q] for n, v in ask.items()} | {f"t_{n}": v[t] for n, v in have.items()} | {
            "q_at": q, "t_at": t, "n": (len(ask["id"]), len(have["id"]))} for q, t in plan), eps), "a bigint, b bigint, core int",
                                   extra=("core",), whole=True).distinct())
    back = links.filter("core = 1").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return known.select(F.col("id").alias("vid"), (F.col("core") == 1).alias("core")), links.select("a", "b").unionByName(back)


def _roots(parent, v):
    """The roots of ``v`` in a forest in which no parent is greater than its child."""
    top = parent[v]
    while ((up := parent[top]) != top).any():
        top = up
    parent[v] = top
    return top


def _unite(parent, a, b) -> None:
    """Hang the trees of ``a`` and ``b`` together, pair by pair, the greater root under the smaller."""
    import numpy as np

    a, b = _roots(parent, a), _roots(parent, b)
    while (some := a != b).any():
        pairs = np.unique(np.stack((np.maximum(a, b)[some], np.minimum(a, b)[some])), axis=1)
        np.minimum.at(parent, *pairs)
        a, b = _roots(parent, pairs[0]), _roots(parent, pairs[1])


def _forest(pairs):
    """(a, b): for arrays of pairs of numbers, the numbers that hang under a smaller one of their tree."""
    import numpy as np

    names, parent = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a, b in pairs:
        more = np.union1d(names, np.concatenate((a, b)))
        grown = np.arange(len(more))
        grown[np.searchsorted(more, names)] = np.searchsorted(more, names[parent])
        names, parent = more, grown
        _unite(parent, np.searchsorted(names, a), np.searchsorted(names, b))
    top = _roots(parent, np.arange(len(names)))
    return names[top != np.arange(len(names))], names[top[top != np.arange(len(names))]]


def _turned(n: int, at: int, step: int) -> list:
    """The ranges of so many rows below ``n``, first the one that holds ``at``."""
    starts = list(range(0, n, step))
    return [slice(i, i + step) for i in starts[at // step:] + starts[:at // step]]


def _inside(got: dict, eps: float, min_pts: int):
    """(core, part) of the points of a slice (in the order of their cells), as far as it tells: whether ``min_pts`` rows lie within ``eps``, and the least
    id of the core points that core points of the slice connect with each.

    A point is counted until it is core.  Core points that are connected with the largest part need not meet the others of it."""
    import numpy as np

    n, rows, wide = len(got["id"]), cells.BLOCK_ROWS, cells.BLOCK_POINTS
    frame = cells.Frame(got["e"])
    A, sq = frame.sides(got["e"], False)
    B, _ = frame.sides(got["e"], True)
    room = frame.unit * (sq + float(sq.max()))

    def hits(q, t):
        return cells.within(got, got, q, t, A[q] @ B[t].T, room[q], frame, eps)

    total = got["weight"].astype("float64")
    for i in range(0, n, rows):
        q = np.arange(i, min(i + rows, n))
        for t in _turned(n, i, wide):
            q = q[total[q] < min_pts]
            if not len(q):
                break
            x, y = hits(q, np.arange(n)[t])
            total += np.bincount(x, got["weight"][y], n)
    core = np.flatnonzero(total >= min_pts)
    parent = np.arange(n)
    for i in range(0, len(core), rows):
        _unite(parent, *hits(core[i:i + rows], core[_turned(len(core), i, wide)[0]]))
    if len(core):
        of = _roots(parent, core)
        most = np.bincount(of).argmax()
        rest = core[of != most]
        for i in range(0, len(rest), rows):
            q = rest[i:i + rows]
            for t in _turned(len(core), int(np.searchsorted(core, q[0])), wide):
                q = q[_roots(parent, q) != _roots(parent, np.array([most]))]
                if not len(q):
                    break
                _unite(parent, *hits(q, core[t]))
    top = _roots(parent, np.arange(n))
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, top[core], got["id"][core])
    return total >= min_pts, least[top]


def _density_labels(points: DataFrame, eps: float, min_pts: int, emb_col: str, max_rounds: int) -> DataFrame:
    """(vid, label): the least id of the core points of its cluster, for core points and for others near one (the least such label).

    Points are counted and connected in their own slice (:mod:`presslens.operators.cells`), each only until it is told.  A point that is not
    core there is counted in all slices that it can reach.  The parts of core points that slices have found are connected by a few hubs,
    and whatever is not connected with the largest part then meets all cells that hold another part.  Neighbours never
    become rows, so what is written follows the points and not their pairs."""
    import numpy as np
    import pyarrow as pa

    where, placed = cells.build(points.select(F.col("vid").cast("bigint").alias("id"), F.col(emb_col).alias("e"), F.col("weight").cast("double").alias("weight")), ("weight",))
    placed = placed.select("id", "e", "weight", "cell", "sub", where.slice_of(F.col("cell"), F.col("sub")).alias("slice"))

    def inside(table):
        table = table.sort_by([("cell", "ascending"), ("id", "ascending")])
        got = {c: table[c].to_numpy() for c in ("id", "weight")} | {"e": cells._matrix(table["e"].combine_chunks(), table.num_rows)}
        core, part = _inside(got, eps, min_pts)
        return table.drop_columns(["slice"]).append_column("core", pa.array(core.astype(np.int32))).append_column(
            "part", pa.array(np.where(core, part, got["id"])))

    told = placed.groupBy("slice").applyInArrow(inside, "id bigint, e array<double>, weight double, cell int, sub int, core int, part bigint")
    known = cut_lineage(told.withColumn("reach", F.lit(float(eps))))
    several = where.slices().shape[1] > 1
    if several:  # what a slice has not told
        unsure = cut_lineage(known.filter("core = 0"))

        def counted(ask, have, plan):
            frame, n = cells.Frame(have["e"], ask["e"]), np.zeros(len(ask["id"]))
            for q, t, G, room in cells.blocks(frame, ask, have, plan):
                x, y = cells.within(ask, have, q, t, G, room, frame, eps)
                n += np.bincount(x, have["weight"][y], len(n))
            yield pa.RecordBatch.from_arrays([pa.array(ask["id"][n > 0]), pa.array(n[n > 0])], names=["id", "n"])

        more = cells.meet(unsure, known, where, counted, "id bigint, n double", extra=("weight",), whole=True).groupBy("id").agg(F.sum("n").alias("_nw"))
        late = cut_lineage(unsure.join(more, "id").filter(F.col("weight") + F.col("_nw") >= min_pts).select("id", F.lit(1).alias("_late")))
        known = cut_lineage(known.join(late, "id", "left").withColumn("core", F.coalesce("_late", "core")).drop("_late"))
    core = known.filter("core = 1")
    links = None

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))

    if several:
        hubs = core.select("e", "part", "id").orderBy(F.xxhash64("id"), "id").limit(HUBS).collect()
        if hubs:
            H = {"e": np.array([r["e"] for r in hubs], "float64"), "part": np.array([r["part"] for r in hubs]), "id": np.array([r["id"] for r in hubs])}

            def to_hubs(batches):
                for b in batches:
                    if not b.num_rows:
                        continue
                    x = {"id": b.column("id").to_numpy(), "part": b.column("part").to_numpy(), "e": cells._matrix(b.column("e"), b.num_rows)}
                    frame = cells.Frame(H["e"], x["e"])
                    plan = [(np.arange(i, min(i + 512, b.num_rows)), np.arange(len(hubs))) for i in range(0, b.num_rows, 512)]
                    found = (cells.within(x, H, q, t, G, room, frame, eps) for q, t, G, room in cells.blocks(frame, x, H, plan))
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in _forest((x["part"][q], H["part"][t]) for q, t in found)], names=["a", "b"])

            links = cut_lineage(core.select("id", "part", "e").mapInArrow(to_hubs, "a bigint, b bigint").distinct())
            comp = connected_components(both(links), core.select(F.col("part").alias("vid")).distinct(), max_rounds=max_rounds)
            known = cut_lineage(known.join(comp.withColumnRenamed("vid", "part"), "part", "left").withColumn(
                "part", F.coalesce("label", "part")).drop("label"))
            core = known.filter("core = 1")
    largest = core.groupBy("part").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "part").limit(1).collect()
    alike, whole = np.zeros(len(where.subs), np.int64), np.zeros(len(where.subs), bool)
    for r in core.groupBy("cell").agg(F.min("part").alias("low"), F.max("part").alias("high")).collect():  # a row per pivot
        alike[r["cell"]], whole[r["cell"]] = r["low"], r["low"] == r["high"]

    def spare(x, some):  # a cell of a core point's own part tells nothing
        return (x["core"] == 1)[:, None] & (whole[some][None] & (x["part"][:, None] == alike[some][None]))

    def met(ask, have, plan):
        frame, joins = cells.Frame(have["e"], ask["e"]), []
        for q, t, G, room in cells.blocks(frame, ask, have, plan):
            x, y = cells.within(ask, have, q, t, G, room, frame, eps)
            edge = ask["core"][x] == 0
            a, b = ask["id"][x[edge]], have["part"][y[edge]]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int32))], names=["a", "b", "core"])
            a, b = ask["part"][x[~edge]], have["part"][y[~edge]]
            joins.append(np.unique(np.stack((a, b))[:, a != b], axis=1))
            if len(joins) == 64:
                joins = [np.stack(_forest(joins))]
        a, b = _forest(joins)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.ones(len(a), np.int32))], names=["a", "b", "core"])

    asked = known.filter((F.col("core") == 0) | (F.col("part") != F.lit(largest[0]["part"] if largest else 0)) if several else F.col("core") == 0)
    found = cut_lineage(cells.meet(cut_lineage(asked), core, where, met, "a bigint, b bigint, core int", extra=("core", "part"), whole=True, spare=spare).distinct())
    parts = core.select(F.col("part").alias("vid")).distinct()
    comp = connected_components(both(found.filter("core = 1")), parts, max_rounds=max_rounds) if several else parts.withColumn("label", F.col("vid"))
    comp = comp.withColumnRenamed("vid", "part")
    edge = found.filter("core = 0").join(comp.withColumnRenamed("part", "b"), "b").groupBy("a").agg(F.min("label").alias("label"))
    return core.join(comp, "part").select(F.col("id").alias("vid"), "label").unionByName(edge.withColumnRenamed("a", "vid"))


def connected_components(edges: DataFrame, nodes: DataFrame, node_col: str = "vid", max_rounds: int = 100) -> DataFrame:
    """Smallest node id of each connected component: min-label propagation with hooking and pointer jumping.

    ``edges`` (a, b) hold both directions.  Each round a node takes the smallest label's label among its own and its
    neighbours' and hands it on to the label that it had, so that whole trees hang themselves under smaller ones: long
    chains settle in a logarithmic number of rounds whatever the order of their ids.  The edges meet the labels once a round; the rest are joins of
    nodes.  Labels are checkpointed into the shared checkpoint folder every round, so lineage stays one round long.
    Raises when the labels have not settled after ``max_rounds`` rounds (never returns a partial answer).
    """
    labels = cut_lineage(nodes.select(F.col(node_col).alias("n"), F.col(node_col).alias("label")))
    e = cut_lineage(edges.select("a", "b"))
    for _ in range(max_rounds):
        above = labels.select(F.col("n").alias("label"), F.col("label").alias("_up"))
        up = labels.join(above, "label", "left").select("n", "label", F.coalesce("_up", "label").alias("_up"))
        near = e.join(up.select(F.col("n").alias("a"), "_up"), "a").groupBy("b").agg(F.min("_up").alias("_near"))
        seen = up.join(near, F.col("n") == F.col("b"), "left").select("n", "label", F.least("_up", "_near").alias("_least"))
        hooked = seen.filter(F.col("_least") < F.col("label")).select(F.col("label").alias("n"), F.col("_least").alias("label"))
        new = cut_lineage(seen.select("n", F.least("label", "_least").alias("label")).unionByName(hooked)
                              .groupBy("n").agg(F.min("label").alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "old"), "n").filter(F.col("label") != F.col("old"))
        labels = new
        if changed.limit(1).count() == 0:
            return labels.withColumnRenamed("n", node_col)
    raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")


def density_clusters(df: DataFrame, eps: float, min_pts: int = 5, min_size: int = 2, key: str = "orig_index",
                     emb_col: str = "embedding", out: str = "cluster", noise: int = -1,
                     max_rounds: int = 100, grid_dims: int = 2, tables: int = 0, bits: int = 8) -> DataFrame:
    """Exact DBSCAN labels (Euclidean ``eps``), clusters smaller than ``min_size`` -> noise.

    Cluster ids are the smallest key of a core point in the cluster (deterministic).  Core point:
    at least ``min_pts`` rows (itself and copies included) within ``eps``.  Border points take the
    smallest label among their core neighbours.  With ``tables`` > 0 neighbours come from
    :func:`likely_neighbours` (``bits`` hyperplanes a table), which may miss some; 0 is exact.  Exact neighbours are counted and linked where they
    are found and are not listed; only keys that are no whole numbers list them, by the grid of ``grid_dims`` axes.
    """
    # 1. identical vectors collapse to one weighted point (copies never produce pair rows)
    src = df.select(key, F.col(emb_col).cast("array<double>").alias("_e"))
    # null vectors are noise
    points = cut_lineage(src.filter(F.col("_e").isNotNull()).groupBy("_e").agg(F.min(key).alias("vid"), F.count(F.lit(1)).alias("weight"))
                            .withColumnRenamed("_e", emb_col))
    whole_numbers = points.schema["vid"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if whole_numbers and not tables and not points.filter("vid IS NOT NULL").groupBy("vid").count().filter("count > 1").head(1):
        labels = cut_lineage(_density_labels(points.filter("vid IS NOT NULL"), eps, min_pts, emb_col, max_rounds))
    else:
        if whole_numbers and not tables:
            core, nb = _density_links(points.filter("vid IS NOT NULL"), eps, min_pts, emb_col)
        else:
            near = (likely_neighbours(points, eps, tables, bits, emb_col) if tables else
                    epsilon_neighbours(points, eps, emb_col, grid_dims=grid_dims))
            nb = cut_lineage(near)   # used four times below: computed once
            counts = nb.groupBy("a").agg(F.sum("wb").alias("_nw"))
            core = cut_lineage(points.join(counts.withColumnRenamed("a", "vid"), "vid", "left")
                               .select("vid", (F.col("weight") + F.coalesce(F.col("_nw"), F.lit(0)) >= min_pts).alias("core")))
        core_ids = core.filter("core").select("vid")
        core_edges = (nb.join(core_ids.withColumnRenamed("vid", "a"), "a", "left_semi")
                        .join(core_ids.withColumnRenamed("vid", "b"), "b", "left_semi"))
        comp = connected_components(core_edges, core_ids, max_rounds=max_rounds)
        # border points: smallest label among core neighbours
        border = (nb.join(core.filter(~F.col("core")).select(F.col("vid").alias("a")), "a", "left_semi")
                    .join(comp.withColumnRenamed("vid", "b"), "b")
                    .groupBy("a").agg(F.min("label").alias("label")).withColumnRenamed("a", "vid"))
        labels = comp.unionByName(border)
    sizes = (labels.join(points.select("vid", "weight"), "vid").groupBy("label")
                   .agg(F.sum("weight").alias("_size")))
    keep = sizes.filter(F.col("_size") >= min_size).select("label")
    final = labels.join(keep, "label", "left_semi")
    # 3. back to every row: rows of one vector share its label (join on the vector)
    lab_vec = points.join(final, "vid", "left").select(F.col(emb_col).alias("_e"), "label")
    res = src.join(lab_vec, "_e", "left")
    return res.select(key, F.coalesce(F.col("label"), F.lit(noise)).cast("long").alias(out))


def cluster_profile(df: DataFrame, k: int = 5, cluster: str = "cluster", key: str = "orig_index",
                    emb_col: str = "embedding", text_col: str = "title", noise: int = -1) -> DataFrame:
    """Centroids -> similarity to own centroid -> k representatives -> summary
    (cluster, size, representatives, label_sentence = first representative)."""
    from presslens.operators.aggregates import cluster_summary
    from presslens.operators.vectors import cluster_centroids, representatives, similarity_to_centroid

    cen = cluster_centroids(df, cluster, emb_col, noise=noise)
    sims = similarity_to_centroid(df.filter(F.col(cluster) != noise), cen, cluster, emb_col)
    reps = representatives(sims, k, cluster, "sim", key)
    sizes = cen.select(cluster, "size")
    return cluster_summary(reps.select(cluster, text_col, "rank"), sizes, cluster, text_col, "rank", k)


def _numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """Gapless numbers from 0 in the order of ``key`` (one row per key): a distributed sort, a row
    number inside each sorted partition, and one offset per partition."""
    rows = cut_lineage(df.orderBy(key).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return (rows.withColumn("_row", inside).join(F.broadcast(offsets), "_part")
                .withColumn(out, (F.col("_offset") + F.col("_row") - 1).cast("long")).drop("_part", "_row", "_offset"))


def label_clusters(labels: DataFrame, col: str, eps: float, min_pts: int = 5, min_size: int = 20,
                   dims: int = 64, pca_k: int | None = 5, none_label: str = "none", encoder=None,
                   vectors: DataFrame | None = None, tables: int = 0, bits: int = 8) -> DataFrame:
    """Cluster the distinct free-text labels; returns the mapping table
    (raw_label, cluster_id, cluster_label, freq).

    Labels are normalised (strip + lower, null -> 'nan'); 'none' and '' are left out.  Distinct
    labels are embedded once each: given ``vectors`` (raw_label, embedding), an ``encoder`` callable
    or the hashing default (V11).  They are reduced (PCA in place of UMAP; ``pca_k=None`` keeps the
    vectors) and density-clustered (M06, with its candidate tables if ``tables`` > 0); a label without a vector is noise.  Each cluster is named
    by its label with the highest frequency over all articles (ties: the smaller label); noise keeps
    id -1 and the name 'other'.  Ids are dense ranks of the labels, so no two labels share one."""
    from presslens.operators.labelling import normalise_label
    from presslens.operators.vectors import embed

    norm = labels.select(normalise_label(F.col(col)).alias("raw_label"))
    norm = norm.filter((F.col("raw_label") != none_label) & (F.col("raw_label") != ""))
    uniq = cut_lineage(_numbered(norm.groupBy("raw_label").agg(F.count(F.lit(1)).alias("freq")), "raw_label", "_id"))
    if vectors is not None:
        vec = uniq.join(vectors.select("raw_label", "embedding"), "raw_label").filter(F.col("embedding").isNotNull())
    else:
        vec = embed(uniq, "raw_label", "embedding", dims, encoder)
    red = pca(vec, pca_k, "embedding", "reduced") if pca_k else vec.withColumnRenamed("embedding", "reduced")
    cl = density_clusters(red, eps, min_pts, min_size, key="_id", emb_col="reduced", out="cluster_id", tables=tables, bits=bits)
    lab = uniq.join(cl, "_id", "left").select("raw_label", "freq", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))
    reps = (lab.filter(F.col("cluster_id") != -1).groupBy("cluster_id")
               .agg(F.min_by("raw_label", F.struct((-F.col("freq")).alias("a"), F.col("raw_label").alias("b")))
                    .alias("_rep")))
    out = lab.join(reps, "cluster_id", "left")
    return out.select("raw_label", "cluster_id",
                      F.when(F.col("cluster_id") == -1, F.lit("other")).otherwise(F.col("_rep")).alias("cluster_label"),
                      "freq")


def two_level_topics(sentences: DataFrame, k: int = 7, top: int = 5, seed: int = 42, text_col: str = "text",
                     emb_col: str = "embedding") -> DataFrame:
    """Cluster the cluster sentences into k topics, then the ``top`` sentences of all closest to
    each topic centroid."""
    from presslens.operators.vectors import topic_top_sentences

    pred, _ = kmeans(sentences, k, seed, emb_col, "topic")
    return topic_top_sentences(pred, top, "topic", text_col, emb_col)


def plot_points(df: DataFrame, max_pts: int, top_k: int, cluster: str = "cluster", key: str = "orig_index",
                emb_col: str = "embedding", seed: int = 42) -> DataFrame:
    """Up to ``max_pts`` sampled points of the ``top_k`` largest clusters with x, y
    (first two coordinates of the 2-D map)."""
    from presslens.operators.evaluation import sample_n
    from presslens.operators.windows import keep_top_categories

    kept = keep_top_categories(df, cluster, top_k)
    pts = sample_n(kept, max_pts, seed, key)
    return pts.select(key, cluster, F.col(emb_col)[0].cast("double").alias("x"),
                      F.col(emb_col)[1].cast("double").alias("y"))
