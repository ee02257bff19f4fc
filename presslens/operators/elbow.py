"""k-means for many values of k at once.

One scan of the rows serves every k: a task compares each Arrow batch with the centres of all k and keeps, per (k, centre),
the number of rows, their sum and their squared distances.  Only these partial sums leave the task, and they are merged
by mergeable aggregates.  So 49 values of k cost as many scans as the slowest of them needs steps.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.operators.windows import hash_order


def _starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k rows with the smallest seeded hashes of their key; every k starts from a prefix of them."""
    first = rows.orderBy(hash_order(F.col("id"), seed), F.col("id")).limit(k).collect()
    return np.array([r["e"] for r in first], dtype="float64").reshape(len(first), -1 if first else 1)


def _pass(rows: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """One scan: for every k the row counts and vector sums of its centres, and the inertia before any move."""
    import pyarrow as pa
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def assign(batches):
        held = {k: [np.zeros(len(c), np.int64), np.zeros(c.shape), np.zeros(len(c))] for k, c in centres.items()}
        for b in batches:
            if not b.num_rows:
                continue
            X = b.column("e").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for k, c in centres.items():
                own = ((c * c).sum(1)[None] - 2 * (X @ c.T)).argmin(1)  # |x|^2 is the same for every centre
                n, s, sse = held[k]
                n += np.bincount(own, minlength=len(c))
                np.add.at(s, own, X)
                sse += np.bincount(own, weights=((X - c[own]) ** 2).sum(1), minlength=len(c))
        found = [(k, i, int(n[i]), float(sse[i]), s[i]) for k, (n, s, sse) in held.items() for i in range(len(n)) if n[i]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()),
             pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.float64()),
             pa.array([f[4] for f in found], pa.list_(pa.float64()))], names=["k", "c", "n", "sse", "s"])

    parts = rows.select("e").mapInArrow(assign, "k int, c int, n bigint, sse double, s array<double>")
    merged = parts.groupBy("k", "c").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"),
                                         vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    out = {k: (np.zeros(len(c), np.int64), np.zeros(c.shape), [0.0] * len(c)) for k, c in centres.items()}
    for r in merged.collect():  # one row a centre: bounded by the sum of all k
        n, s, sse = out[r["k"]]
        n[r["c"]], s[r["c"]], sse[r["c"]] = r["n"], r["s"], r["sse"]
    return {k: (n, s, float(sum(sse))) for k, (n, s, sse) in out.items()}


def elbow_one_scan(df: DataFrame, ks: Sequence[int], key: str = "orig_index", emb_col: str = "embedding", seed: int = 42,
                   max_iter: int = 20, tol: float = 1e-4, batches: int = 1) -> DataFrame:
    """(k, inertia, steps) for every distinct k of ``ks``, all from the same scans.

    Every k starts at the first k rows in the seeded hash order of ``key`` and makes Lloyd steps until no centre moves by
    more than ``tol`` (Euclidean) or ``max_iter`` steps are done; a centre without rows stays.  With ``batches`` above 1 each
    step reads one of so many hashed shares of the rows and moves a centre by a falling rate (one over the rows it has seen), as
    mini-batch fits do; all ``max_iter`` steps are made then.  The inertia is always that of all rows.

    Rows with a null vector, a null element or NaN are left out; equal rows count as often as they occur.  An empty table gives
    inertia 0 for every k, and so does a k above the number of distinct vectors if its starts reach all of them.  The sum of all k, times
    the width, travels with the tasks: 49 values up to 50 are 1,275 vectors.
    """
    wanted = sorted({int(k) for k in ks})
    if not wanted or wanted[0] < 1:
        raise ValueError("every k must be at least 1")
    vector = F.col(emb_col).cast("array<double>")
    rows = df.select(F.col(key).alias("id"), vector.alias("e")).filter(
        F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull() | F.isnan(x)))
    first = _starts(rows, wanted[-1], seed)
    spark = df.sparkSession
    schema = "k int, inertia double, steps int"
    if not len(first):
        return spark.createDataFrame([(k, 0.0, 0) for k in wanted], schema)
    centres = {k: first[:k].copy() for k in wanted}
    seen = {k: np.zeros(len(c), np.int64) for k, c in centres.items()}
    steps = dict.fromkeys(wanted, 0)
    inertia: dict[int, float] = {}
    moving = set(wanted)
    for step in range(max_iter):
        share = rows if batches == 1 else rows.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == step % batches)
        for k, (n, s, sse) in _pass(share, {k: centres[k] for k in sorted(moving)}).items():
            old = centres[k]
            seen[k] = n if batches == 1 else seen[k] + n
            change = (s - n[:, None] * old) / np.maximum(seen[k], 1)[:, None]
            steps[k] += 1
            if batches == 1 and not np.sqrt((change ** 2).sum(1)).max() > tol:
                inertia[k] = sse  # at rest: the scan has measured these centres
                moving.discard(k)
            else:
                centres[k] = old + change
        if not moving:
            break
    if moving:
        inertia |= {k: sse for k, (_, _, sse) in _pass(rows, {k: centres[k] for k in sorted(moving)}).items()}
    return spark.createDataFrame([(k, inertia[k], steps[k]) for k in wanted], schema)
