"""Order statistics and running totals without gathering a column into one task.

Spark's ``percentile`` keeps every distinct value of the column in one
aggregation buffer for a global quantile, and a window without a partition key
runs in one task.  Both are avoided here:

1. the column is collapsed to (value, count) with a partial aggregate, so hot
   values shrink to one row per input partition;
2. a bounded sketch (``percentile_approx``) cuts the value axis into ranges;
   it only spreads the work and never decides an answer;
3. running counts are a window partitioned by range, plus a tiny per-range
   offset table (one row per range).

Results are exact: quantiles interpolate linearly between the order
statistics at ``p * (n - 1)`` (as ``percentile`` / DuckDB ``quantile_cont``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Most value ranges, whatever the number of shuffle partitions.
MAX_RANGES = 1024


def _ranges(spark, ranges: int | None) -> int:
    if ranges is None:
        ranges = min(max(16, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))), MAX_RANGES)
    return ranges


def _ranged(df: DataFrame, order_col: str, sum_cols: Sequence[str], group: str | None, ranges: int | None):
    """(rows with range id ``_r`` and exclusive prefix sums ``_b_<c>``, per-range table with
    offsets ``_o_<c>`` and totals ``_t_<c>``).  ``df`` must hold one row per (group, order value)."""
    ranges = _ranges(df.sparkSession, ranges)
    edges_p = [i / ranges for i in range(1, ranges)]
    v = F.col(order_col).cast("double")
    if group is None:
        # one global set of range edges: ranges - 1 numbers, read once and used as a literal
        found = df.agg(F.percentile_approx(v, edges_p, 10 * ranges)).first()[0] or []
        # range id = number of edges below the value; the edges are data, not part of the expression
        edges = np.array(found, dtype=float)

        @F.pandas_udf(IntegerType())
        def range_of(x: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(edges, x.to_numpy(dtype=float), side="left").astype(np.int32))

        ranged = df.withColumn("_g", F.lit(0)).withColumn("_r", range_of(v))
    else:
        src = df.withColumn("_g", F.col(group))
        edges = src.groupBy("_g").agg(F.percentile_approx(v, edges_p, 10 * ranges).alias("_edges"))
        ranged = (src.join(edges, "_g").withColumn("_r", F.size(F.filter(F.col("_edges"), lambda e: e < v)))
                     .drop("_edges"))

    def small(d: DataFrame) -> DataFrame:
        # without groups the per-range table has at most ``ranges`` rows
        return F.broadcast(d) if group is None else d

    w = Window.partitionBy("_g", "_r").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_l_{c}") for c in sum_cols])
    tot = ranged.groupBy("_g", "_r").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    before = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_g", "_r", *[F.col(f"_t_{c}") for c in sum_cols],
                      *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
    rows = local.join(small(offs.select("_g", "_r", *[f"_o_{c}" for c in sum_cols])), ["_g", "_r"])
    rows = rows.select("*", *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"_b_{c}") for c in sum_cols])
    return rows, offs


def running_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str], group: str | None = None,
                 ranges: int | None = None) -> DataFrame:
    """Add ``<c>_before``: the sum of ``c`` over all rows with a smaller ``order_col`` (per group).

    ``df`` must hold one row per (group, order value) - an aggregated table.  The prefix sums are
    computed per value range and shifted by the totals of the preceding ranges."""
    rows, _ = _ranged(df, order_col, sum_cols, group, ranges)
    return rows.select(*df.columns, *[F.col(f"_b_{c}").alias(f"{c}_before") for c in sum_cols])


def exact_quantiles(df: DataFrame, col: str | Column, probs: Sequence[float], ranges: int | None = None,
                    group: str | None = None) -> DataFrame:
    """Exact quantiles ``(p, value)`` of a numeric column (nulls and NaN ignored).

    With ``group`` the quantiles are per group (one row per group and p).  The wanted ranks are
    placed in their value range through the small per-range table first, so the final lookup is
    an equi-join on (group, range): no group's values meet in one task."""
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    spark = df.sparkSession
    if group is None:
        vals = (df.select(x.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
                  .groupBy("_v").agg(F.count(F.lit(1)).alias("_c")))
        # the collapsed (value, count) table feeds three short steps (edges, range table, lookup):
        # it is kept once instead of scanning the input three times, and the answer (one row per
        # p) is returned as a small table
        vals = vals.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return _global_quantiles(spark, vals, probs, ranges)
        finally:
            vals.unpersist()
    else:
        g = F.col(group)
        vals = (df.select(g.alias("_grp"), x.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
                  .groupBy("_grp", "_v").agg(F.count(F.lit(1)).alias("_c")))
        rows, offs = _ranged(vals, "_v", ["_c"], "_grp", ranges)
        totals = offs.groupBy("_g").agg(F.sum("_t__c").alias("_n"))
        ps = F.array(*[F.lit(float(p)) for p in probs])
        targets = (totals.select("_g", F.posexplode(ps).alias("_pi", "_p"), "_n")
                         .withColumn("_pos", F.col("_p") * (F.col("_n") - 1))
                         .select("_g", "_pi", "_p", "_pos",
                                 F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))).alias("_k")))
        # the range holding each wanted rank (per group: ranges rows x two ranks per p)
        o = offs.select("_g", "_r", F.col("_o__c").alias("_lo"), (F.col("_o__c") + F.col("_t__c")).alias("_hi"))
        t = (targets.join(o, "_g").filter((F.col("_lo") <= F.col("_k")) & (F.col("_k") < F.col("_hi")))
                    .select("_g", "_r", "_pi", "_p", "_pos", "_k"))
    return _lookup(rows, t, group)


def _lookup(rows: DataFrame, t: DataFrame, group: str | None) -> DataFrame:
    """Values at the placed ranks (equi-join on group and range), interpolated per p."""
    t = t.alias("t")
    r = rows.select("_g", "_r", "_v", F.col("_b__c").alias("_start"), (F.col("_b__c") + F.col("_c")).alias("_end")) \
        .alias("r")
    hit = (r.join(t, (F.col("t._g") == F.col("r._g")) & (F.col("t._r") == F.col("r._r"))
                  & (F.col("r._start") <= F.col("t._k")) & (F.col("t._k") < F.col("r._end")))
            .select(F.col("t._g").alias("_g"), "t._pi", "t._p", "t._pos", "t._k", "r._v"))
    out = (hit.groupBy("_g", "_pi", "_p", "_pos")
              .agg(F.min_by("_v", "_k").alias("_a"), F.max_by("_v", "_k").alias("_b"), F.min("_k").alias("_k0"))
              .select("_g", F.col("_p").alias("p"),
                      (F.col("_a") + (F.col("_pos") - F.col("_k0")) * (F.col("_b") - F.col("_a"))).alias("value")))
    if group:
        return out.withColumnRenamed("_g", group)
    return out.drop("_g")


def _global_quantiles(spark, vals: DataFrame, probs: Sequence[float], ranges: int | None) -> DataFrame:
    rows, offs = _ranged(vals, "_v", ["_c"], None, ranges)
    # the per-range table is small (one row per range): the wanted ranks are placed here
    table = sorted((int(r["_r"]), int(r["_o__c"]), int(r["_t__c"])) for r in offs.collect())
    n = sum(t for _, _, t in table)
    placed = []
    for pi, p in enumerate(probs):
        if n == 0:
            break
        pos = float(p) * (n - 1)
        for k in sorted({math.floor(pos), math.ceil(pos)}):
            rng = next(r for r, lo, t in table if lo <= k < lo + t)
            placed.append((0, rng, pi, float(p), pos, int(k)))
    t = F.broadcast(spark.createDataFrame(placed, "_g int, _r int, _pi int, _p double, _pos double, _k long"))
    result = [(float(r["p"]), float(r["value"])) for r in _lookup(rows, t, None).collect()]
    return spark.createDataFrame(result, "p double, value double")


def linspace(start: float, stop: float, n: int) -> list[float]:
    """numpy.linspace: evenly spaced, last value exactly ``stop``."""
    if n == 1:
        return [float(start)]
    step = (stop - start) / (n - 1)
    out = [start + i * step for i in range(n)]
    out[-1] = float(stop)
    return out


def quantiles(df: DataFrame, col: str, probs: Sequence[float], exact: bool = True, accuracy: int = 10000,
              group: str | None = None) -> DataFrame:
    """``(p, value)`` per (group and) p: exact by default (:func:`exact_quantiles`), or the bounded
    sketch ``percentile_approx`` (one partial aggregate, rank error about n / accuracy)."""
    if exact:
        return exact_quantiles(df, col, probs, group=group)
    keys = [group] if group else []
    est = df.groupBy(*keys).agg(F.percentile_approx(F.col(col).cast("double"), list(probs), accuracy).alias("_q"))
    ps = F.array(*[F.lit(float(p)) for p in probs])
    return est.select(*keys, F.inline(F.arrays_zip(ps.alias("p"), F.col("_q").alias("value"))))
