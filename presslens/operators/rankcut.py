"""The first n rows of an order for any n, without merging n rows in one task.

A plain ``orderBy().limit(n)`` merges up to n rows of every partition in one task.  Here the row at rank n is narrowed down by
scans that return only counts: a bounded sketch proposes edges, every row is counted in the range between two edges or at
an edge itself, and the range that holds rank n is cut again.  Rows before it are kept where they lie; only the last range,
at most ``LEFT`` rows unless they tie in every cut, is sorted.  The sketch spreads the work and never decides an answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which the last range is sorted.
LEFT = 10_000
#: Edges proposed for each scan.
EDGES = 63


def _numbers(cut: Column, descending: bool) -> list[Column]:
    """Two ascending numbers for one sort key: its class (null, number, NaN in Spark's order) and its value."""
    x = cut.cast("double")
    odd = F.when(x.isNull(), -1).when(F.isnan(x), 1).otherwise(0)
    value = F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)
    return [-odd.cast("double"), -value] if descending else [odd.cast("double"), value]


def first_rows(df: DataFrame, cuts: Sequence[tuple[Column, bool]], order: Sequence[Column], n: int,
               left: int = LEFT) -> DataFrame:
    """Exactly the rows of ``df.orderBy(*order).limit(n)``, in no order.

    ``cuts`` are (numeric sort key, descending) for the leading keys of ``order``; longs must lie within 2**53.  ``df`` must give the
    same rows whenever it is read.  Rows that tie in all cuts and hold rank n are sorted by ``order`` in one step, so the last cut
    should tell rows apart; n of 0 or less gives no rows and n above their number all of them.
    """
    if n <= 0:
        return df.limit(0)
    keys = [x for cut, descending in cuts for x in _numbers(cut, descending)]
    kept: list[Column] = []
    here: list[Column] = []  # what confines the rows that may hold rank n
    rest, at = n, 0
    while at < len(keys):
        x = keys[at]
        inside = df.filter(reduce(lambda a, b: a & b, here)) if here else df
        probs = [i / (EDGES + 1) for i in range(1, EDGES + 1)]
        rows, low, high, found = inside.select(x.alias("_x")).agg(
            F.count("*"), F.min("_x"), F.max("_x"), F.percentile_approx("_x", probs, 20 * EDGES)).first()
        if rows <= rest:  # all of them are wanted
            kept.append(reduce(lambda a, b: a & b, here, F.lit(True)))
            return df.filter(reduce(lambda a, b: a | b, kept))
        if rows <= left:
            break
        if low == high:
            at += 1
            continue
        edges = sorted({float(e) for e in found})
        points = F.array(*[F.lit(e) for e in edges])
        place = (2 * F.size(F.filter(points, lambda e: e < F.col("_x"))) + F.array_contains(points, F.col("_x")).cast("int")).alias("_p")
        counts = sorted((r["_p"], r["n"]) for r in inside.select(x.alias("_x")).groupBy(place).agg(F.count("*").alias("n")).collect())
        for p, c in counts:  # at most 2 * EDGES + 1
            if c >= rest:
                break
            rest -= c
        i, exact = divmod(p, 2)  # p = 2 i: between edge i - 1 and edge i; 2 i + 1: at edge i
        before = (x < F.lit(edges[i])) if exact else (x <= F.lit(edges[i - 1])) if i else None
        if before is not None:
            kept.append(reduce(lambda a, b: a & b, [*here, before]))
        if exact:
            here = [*here, x == F.lit(edges[i])]
            at += 1
        else:
            here = [*here, *([x > F.lit(edges[i - 1])] if i else []), *([x < F.lit(edges[i])] if i < len(edges) else [])]
    last = (df.filter(reduce(lambda a, b: a & b, here)) if here else df).orderBy(*order).limit(rest)
    return df.filter(reduce(lambda a, b: a | b, kept)).unionByName(last) if kept else last


def numeric(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.typeName() in {"byte", "short", "integer", "long", "float", "double"}
