"""Aggregations (A01-A43): the yearly / publisher / topic / entity tables.

All of them are ``groupBy`` + built-in aggregates, so Spark combines partial
results map-side before the shuffle: a key holding a third of the rows costs
one partial row per input partition, not a third of the data in one task.
Windows are applied only to the already-aggregated (small) tables.
pandas semantics kept: null group keys are dropped unless asked otherwise;
ties in top-n are broken by the label, ascending.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.functions import parse as P
from presslens.functions import text as T
from presslens.session import cut_lineage


def _flag(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("boolean"), F.lit(False))


def flag_trend(df: DataFrame, flag: str = "is_ai", by: str = "year", out: str = "n_flagged") -> DataFrame:
    """Flagged rows per year; years without flags stay with 0."""
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count_if(_flag(flag)).alias(out))


def yearly_share(df: DataFrame, flag: str = "is_ai", by: str = "year") -> DataFrame:
    """Total, flagged (null = False) and share per key (null keys dropped)."""
    return (df.filter(F.col(by).isNotNull()).groupBy(by)
              .agg(F.count(F.lit(1)).alias("total"), F.count_if(_flag(flag)).alias("ai_count"))
              .withColumn("share", F.try_divide(F.col("ai_count").cast("double"), F.col("total"))))


def publisher_share(df: DataFrame, flag: str = "is_ai", by: str = "publisher", min_articles: int = 500,
                    top: int = 20) -> DataFrame:
    """A02 per publisher, HAVING total >= min_articles, top by share (ties: publisher)."""
    return (yearly_share(df, flag, by).filter(F.col("total") >= min_articles)
            .orderBy(F.col("share").desc(), F.col(by).asc()).limit(top))


def publisher_year_share(df: DataFrame, flag: str = "is_ai", min_total: int = 50,
                         count_col: str = "title") -> DataFrame:
    """Publishers with >= min_total rows; per (publisher, year) total (non-null ``count_col``),
    flagged and ratio.  Aggregated first; the publisher total is a window over the small result."""
    per = (df.filter(F.col("publisher").isNotNull() & F.col("year").isNotNull())
             .groupBy("publisher", "year")
             .agg(F.count(F.lit(1)).alias("_rows"), F.count(count_col).alias("total_articles"),
                  F.count_if(_flag(flag)).alias("ai_articles")))
    pub_rows = df.filter(F.col("publisher").isNotNull()).groupBy("publisher").agg(F.count(F.lit(1)).alias("_pub"))
    return (per.join(pub_rows.filter(F.col("_pub") >= min_total).select("publisher"), "publisher", "left_semi")
               .withColumn("ai_ratio", F.try_divide(F.col("ai_articles").cast("double"), F.col("total_articles")))
               .drop("_rows"))


def share_within(df: DataFrame, n: str, by: Sequence[str], out: str = "pct", scale: float = 100.0) -> DataFrame:
    """Value / group total * scale (on an aggregated table)."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return df.withColumn(out, F.col(n) * F.lit(scale) / F.sum(F.col(n)).over(w))


def category_share(df: DataFrame, keys: Sequence[str] = ("year", "category"), out: str = "pct") -> DataFrame:
    """Count per (group, category) and its percent within the group."""
    keys = list(keys)
    counts = df.filter(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return share_within(counts, "n", keys[:1], out)


def value_counts(df: DataFrame, col: str, dropna: bool = True, top: int | None = None,
                 out: str = "count") -> DataFrame:
    """Frequency table, count desc then value asc; ``top`` keeps the first rows."""
    src = df.filter(F.col(col).isNotNull()) if dropna else df
    counts = src.groupBy(col).agg(F.count(F.lit(1)).alias(out))
    if top:
        return counts.orderBy(F.col(out).desc(), F.col(col).asc_nulls_last()).limit(top)
    return counts


def count_by(df: DataFrame, keys: Sequence[str], out: str = "count", dropna: bool = True) -> DataFrame:
    """Rows per key set (rows with a null key dropped, as pandas does)."""
    src = df
    if dropna:
        for k in keys:
            src = src.filter(F.col(k).isNotNull())
    return src.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def missing_ratio(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of nulls per column as a long table (column, missing_ratio, n_missing)."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"r_{i}") for i, c in enumerate(cols)],
                  *[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r_{i}").alias("missing_ratio"),
                              F.col(f"n_{i}").alias("n_missing")) for i, c in enumerate(cols)])
    return wide.select(F.inline(rows))


def dup_ratio(df: DataFrame, keys: Sequence[str] = ("title", "publisher"), by: str = "publisher") -> DataFrame:
    """A10: per publisher, rows whose (title, publisher) repeats, total rows and their ratio.

    Two aggregations (per key tuple, then per publisher); no row-level join back.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = (per_key.filter(F.col(by).isNotNull()).groupBy(by)
           .agg(F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(F.lit(0))).alias("duplicated_count"),
                F.sum("_n").alias("total_count")))
    return (out.filter(F.col("duplicated_count") > 0)
               .withColumn("duplicated_ratio", F.col("duplicated_count") / F.col("total_count")))


def company_combo_counts(df: DataFrame, flag: str = "is_ai", col: str = "company") -> DataFrame:
    """Count per joined company string among flagged rows with a company."""
    return (df.filter(_flag(flag) & (F.col(col) != "")).groupBy(col).agg(F.count(F.lit(1)).alias("count")))


def company_counts(df: DataFrame, flag: str | None = "is_ai", col: str = "company", sep: str = ", ") -> DataFrame:
    """Count per single company (the joined string split back)."""
    src = df.filter(_flag(flag)) if flag else df
    single = src.select(F.explode(F.split(F.col(col), sep)).alias(col)).filter(F.col(col) != "")
    return single.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def company_year(df: DataFrame, col: str = "company", by: str = "year", flag: str | None = "is_ai") -> DataFrame:
    """Count per (company, year) over single companies."""
    src = df.filter(_flag(flag)) if flag else df
    single = src.select(F.col(by), F.explode(F.split(F.col(col), ", ")).alias(col)).filter(F.col(col) != "")
    return single.filter(F.col(by).isNotNull()).groupBy(col, by).agg(F.count(F.lit(1)).alias("count"))


def company_mentions(df: DataFrame, text_col: str = "plain_text", key: str = "orig_index",
                     max_chars: int | None = None, out: str = "organisation") -> DataFrame:
    """(key, organisation) rows: distinct capitalised phrases per article that look like companies.

    Phrases are exploded first and filtered as a plain column expression (one factored regex per
    name), the fast form of exploding :func:`organisations`.
    """
    ex = df.select(key, F.explode(T.organisation_mentions(F.col(text_col), max_chars)).alias(out))
    return ex.filter((F.length(out) >= 3) & T.likely_company(F.col(out)))


def distinct_entities(df: DataFrame, col: str = "organisations", out_col: str = "organisation") -> DataFrame:
    """Number of distinct entities over all rows (exact; partial de-dup before the shuffle)."""
    ex = df.select(F.col(out_col).alias("_e")) if out_col in df.columns and col not in df.columns else \
        df.select(F.explode(col).alias("_e"))
    return ex.agg(F.count_distinct("_e").alias("n_distinct"))


def entity_counts(df: DataFrame, col: str = "organisations", top: int | None = 30, out_col: str = "organisation"):
    """Mentions per entity (one per article, since each article's list is distinct).

    ``df`` holds either an array column ``col`` or already exploded ``out_col`` rows."""
    ex = df.select(out_col) if out_col in df.columns and col not in df.columns else \
        df.select(F.explode(col).alias(out_col))
    return value_counts(ex, out_col, top=top)


def actor_table(df: DataFrame, col: str = "organisations", top: int | None = 30) -> DataFrame:
    """Organisation, count and actor type."""
    counts = entity_counts(df, col, top)
    return counts.withColumn("actor_type", T.actor_type(F.col("organisation")))


def majority_label(df: DataFrame, group: str = "cluster", label: str = "topic", fill: str | None = None) -> DataFrame:
    """Most frequent label per group (ties: smaller label) with its count and share.

    ``fill`` turns null labels into a text label first (the study used 'nan' and 'NA');
    without it null labels are left out."""
    src = df.filter(F.col(group).isNotNull())
    if fill is not None:
        src = src.withColumn(label, F.coalesce(F.col(label).cast("string"), F.lit(fill)))
    counts = src.filter(F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    return (counts.groupBy(group)
            .agg(F.min_by(F.col(label), F.struct((-F.col("_n")).alias("a"), F.col(label).alias("b")))
                 .alias("majority_label"),
                 F.max("_n").alias("majority_count"), F.sum("_n").alias("size"))
            .withColumn("majority_share", F.col("majority_count") / F.col("size")))


def cluster_centers(df: DataFrame, group: str = "cluster", x: str = "x", y: str = "y") -> DataFrame:
    """Mean x, y and size per cluster."""
    return df.groupBy(group).agg(F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"),
                                 F.count(F.lit(1)).alias("size"))


def cluster_sizes(df: DataFrame, group: str = "cluster", n: int = 20, largest: bool = True) -> DataFrame:
    """Size per cluster, biggest (or smallest) n (ties: cluster asc)."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    order = F.col("size").desc() if largest else F.col("size").asc()
    return sizes.orderBy(order, F.col(group).asc()).limit(n)


def cluster_mean(df: DataFrame, col: str, group: str = "cluster") -> DataFrame:
    """Mean of a score per cluster (descending order is applied by the caller / top_n)."""
    return df.groupBy(group).agg(F.avg(col).alias(f"mean_{col}"), F.count(F.lit(1)).alias("size"))


def clusters_above(df: DataFrame, col: str, t: float, group: str = "cluster") -> DataFrame:
    """Rows of clusters whose mean ``col`` exceeds ``t`` (aggregate + semi join, no row window)."""
    keep = df.groupBy(group).agg(F.avg(col).alias("_m")).filter(F.col("_m") > t).select(group)
    return df.join(keep, group, "left_semi")


def topic_mix(df: DataFrame, group_col: str, label_col: str, rank: int = 2, fill: str = "NA") -> DataFrame:
    """Label distribution inside the group of the given size rank (1 = biggest; the null group
    counts as a group; ties: key asc, null last).  Null labels become ``fill``; ``share`` is the
    fraction of the group.  Sizes are aggregated first; the rank pick is a window over that small
    table only."""
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_size"))
    w = Window.orderBy(F.col("_size").desc(), F.col(group_col).asc_nulls_last())
    picked = sizes.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == rank).select(group_col)
    sub = df.join(picked, df[group_col].eqNullSafe(picked[group_col]), "left_semi")
    lab = F.coalesce(F.col(label_col).cast("string"), F.lit(fill)).alias(label_col)
    counts = sub.select(group_col, lab).groupBy(group_col, label_col).agg(F.count(F.lit(1)).alias("count"))
    return share_within(counts, "count", [group_col], "share", scale=1.0)


def contains_count(df: DataFrame, col: str, needle: str) -> DataFrame:
    """Rows whose label contains ``needle`` case-insensitively (null = no)."""
    return df.agg(F.count_if(F.coalesce(F.lower(F.col(col)).contains(needle.lower()), F.lit(False)))
                  .alias("n_contains"))


def crosstab(df: DataFrame, r: str, c: str, values: Sequence | None = None) -> DataFrame:
    """Contingency table.  With explicit column values it is one aggregate of conditional
    counts (fixed layout, one shuffle); without, Spark's pivot finds the values first."""
    src = df.filter(F.col(r).isNotNull() & F.col(c).isNotNull())
    if values is None:
        return src.groupBy(r).pivot(c).count().na.fill(0)
    return src.groupBy(r).agg(*[F.count_if(F.col(c) == F.lit(v)).alias(str(v)) for v in values])


def pivot_counts(df: DataFrame, index: str, col: str, values: Sequence, fill: int = 0) -> DataFrame:
    """Index x fixed label order, counts, zero columns kept (one aggregate of conditional
    counts: a single shuffle, partial counts combined map-side)."""
    src = df.filter(F.col(index).isNotNull())
    out = src.groupBy(index).agg(*[F.count_if(F.col(col) == F.lit(v)).alias(str(v)) for v in values])
    return out.na.fill(fill) if fill else out


def pivot_top(df: DataFrame, index: str, col: str, k: int = 20, where: Column | None = None) -> DataFrame:
    """A25 (heatmap form): index x the k most frequent values of ``col`` (ties: value asc), counts
    with zero cells.  The k values are a bounded list read first; the table is one aggregate."""
    src = df.filter(where) if where is not None else df
    src = src.filter(F.col(index).isNotNull() & F.col(col).isNotNull())
    top = [r[0] for r in src.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.col("_n").desc(), F.col(col).asc()).limit(k).collect()]
    return pivot_counts(src.filter(F.col(col).isin(top)), index, col, top)


def top_counts(df: DataFrame, index: str, col: str, k: int = 20, where: Column | None = None) -> DataFrame:
    """A25 in long form: (index, value, n) for every index and the k most frequent values, zeros included."""
    wide = pivot_top(df, index, col, k, where)
    return unpivot(wide, [index], [c for c in wide.columns if c != index], col, "n")


def unpivot(df: DataFrame, ids: Sequence[str], value_cols: Sequence[str], var: str = "variable",
            val: str = "value") -> DataFrame:
    """Wide -> long."""
    return df.unpivot(list(ids), list(value_cols), var, val)


def row_pct(df: DataFrame, ids: Sequence[str], value_cols: Sequence[str], scale: float = 100.0) -> DataFrame:
    """Each value as a percent of its row total (row-wise, no shuffle)."""
    total = F.lit(0)
    for c in value_cols:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return df.select(*ids, *[F.try_divide(F.col(c) * F.lit(scale), total).alias(c) for c in value_cols])


def _pearson(a: str, b: str) -> Column:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    # a constant column has no deviation; F.corr would divide by it
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def corr_wide(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A29 for many columns: (x, y, corr) from one mergeable matrix of co-moments.

    Every batch gives its counts, sums and products of all column pairs by matrix products, as one row per
    column, and rows of a column are added up by a vector aggregate: the data are read once, whatever the number of columns.
    Values are first moved by the column means, so that sums of squares do not cancel.  Nulls (and NaN) are left out pair by pair.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    c = len(cols)
    if c < 2:
        return df.sparkSession.createDataFrame([], "x string, y string, corr double")
    num = df.select(*[F.nanvl(F.col(f"`{x}`").cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, x in enumerate(cols)])
    means = num.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(c)]).first()
    shift = np.array([m if m is not None else 0.0 for m in means])

    def moments(batches):
        total = np.zeros((c, 6 * c))
        for b in batches:
            X = np.stack([x.to_numpy(zero_copy_only=False).astype(float) for x in b.columns], axis=1)
            M = (~np.isnan(X)).astype(float)
            X = np.where(M > 0, X - shift, 0.0)
            # for every pair, over the rows that have both: number, sums, sums of squares, sum of products
            total += np.concatenate((M.T @ M, X.T @ M, M.T @ X, (X * X).T @ M, M.T @ (X * X), X.T @ X), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(c, dtype=np.int32)), pa.array(list(total))], names=["i", "m"])

    parts = num.mapInArrow(moments, "i int, m array<double>")
    added = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("m"))).alias("m"))
    pair = added.select("i", F.explode(F.sequence(F.lit(0), F.lit(c - 1))).alias("j"), "m").filter("j > i")
    n, sx, sy, xx, yy, xy = (F.try_element_at("m", F.col("j") + F.lit(k * c + 1)) for k in range(6))
    top = n * xy - sx * sy
    # what rounding leaves of a constant column is not a deviation
    spread = lambda s, q: F.when(n * q - s * s > 1e-12 * n * q, n * q - s * s)
    names = F.array(*[F.lit(x) for x in cols])
    value = F.try_divide(top, F.sqrt(spread(sx, xx)) * F.sqrt(spread(sy, yy)))
    return pair.select(F.try_element_at(names, F.col("i") + 1).alias("x"), F.try_element_at(names, F.col("j") + 1).alias("y"), value.alias("corr"))


def corr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair (booleans as 0/1), long table (x, y, corr).

    Rows with both values count; null where a column is constant there or fewer than two rows are left.  One column
    has no pair.  For hundreds of columns see :func:`corr_wide`."""
    num = [F.col(c).cast("double").alias(c) for c in cols]
    src = df.select(*num)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "x string, y string, corr double")
    wide = src.agg(*[_pearson(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("corr"))
                     for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between min and max, last bin closed (numpy / matplotlib rule).

    One aggregate gives the two scalars min / max; the bin is then computed per row and
    counted with a partial aggregate.
    """
    x = F.col(col).cast("double")
    src = df.select(x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    lo, hi = src.agg(F.min("_x"), F.max("_x")).first()
    if lo is None:
        return src.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, count bigint")
    width = (hi - lo) / bins
    raw = F.floor((F.col("_x") - F.lit(lo)) / F.lit(width)) if width > 0 else F.lit(0)
    b = F.least(raw, F.lit(bins - 1)).cast("int")
    counts = src.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return counts.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"), "count")


def density(df: DataFrame, col: str, grid: Sequence[float]) -> DataFrame:
    """Gaussian kernel density on a fixed grid, Scott's bandwidth n^(-1/5) * std.

    Per row the kernel is evaluated at every grid point (a literal array) and summed per grid
    point: one partial aggregate, no pair table.  Nulls and NaN are left out; without a spread (no row, one
    row, equal values) every density is null.  :func:`density_binned` costs a row once, whatever the grid.
    """
    x = F.col(col).cast("double")
    src = df.select(x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    n, sd = src.agg(F.count(F.lit(1)), F.stddev_samp("_x")).first()
    if not sd:
        return _no_density(df, grid)
    bw = float(sd) * float(n) ** -0.2
    g = F.array(*[F.lit(float(v)) for v in grid])
    kern = F.transform(g, lambda gv: F.exp(-F.pow((gv - F.col("_x")) / F.lit(bw), 2) / 2))
    per = src.select(F.posexplode(kern).alias("_i", "_k"))
    norm = n * bw * (2 * 3.141592653589793) ** 0.5
    return (per.groupBy("_i").agg(F.sum("_k").alias("_s"))
            .select(F.col("_i").alias("grid_index"), F.try_element_at(g, F.col("_i") + 1).alias("x"),
                    (F.col("_s") / F.lit(norm)).alias("density")))


def _no_density(df: DataFrame, grid: Sequence[float]) -> DataFrame:
    rows = [(i, float(v), None) for i, v in enumerate(grid)]
    return df.sparkSession.createDataFrame(rows, "grid_index int, x double, density double")


#: Bins between the least and the greatest value; with the bandwidth b the error of a density is below (width / b)^2 / 8 of its peak.
DENSITY_BINS = 4096


def density_binned(df: DataFrame, cols: Sequence[str], points: int = 100, bins: int = DENSITY_BINS) -> DataFrame:
    """A31 for several columns: (column, grid_index, x, density) on ``points`` places between each column's least and greatest value.

    Every value is split between the two nearest of ``bins`` + 1 equally spaced places (linear binning), which is one partial aggregate
    for all columns; the Gaussian kernel (Scott's bandwidth) is then summed over places instead of rows.  Nulls and NaN
    are left out; a column without a spread has null densities at its value, one without a value has no rows.
    """
    stats = [a for c in cols for x in [_number(c)] for a in (F.count(x), F.stddev_samp(x), F.min(x), F.max(x))]
    flat = df.agg(*stats).first()
    known = {c: flat[4 * i:4 * i + 4] for i, c in enumerate(cols)}
    wide = {c: k for c, k in known.items() if k[1] and k[3] > k[2]}
    spark = df.sparkSession
    schema = "column string, grid_index int, x double, density double"
    flat_rows = [(c, 0, float(k[2]), None) for c, k in known.items() if k[0] and c not in wide]
    out = spark.createDataFrame(flat_rows, schema)
    if not wide:
        return out
    places = []
    for c, (_, _, lo, hi) in wide.items():
        at = (_number(c) - F.lit(lo)) / F.lit((hi - lo) / bins)
        low = F.least(F.floor(at), F.lit(bins - 1)).cast("int")
        places += [F.struct(F.lit(c).alias("column"), low.alias("bin"), (F.lit(1.0) - (at - low)).alias("share")),
                   F.struct(F.lit(c).alias("column"), (low + 1).alias("bin"), (at - low).alias("share"))]
    binned = df.select(F.inline(F.array(*places))).filter("bin IS NOT NULL").groupBy("column", "bin").agg(F.sum("share").alias("weight"))
    laws = spark.createDataFrame([(c, i, lo + (hi - lo) * i / max(1, points - 1), lo, (hi - lo) / bins, float(sd) * float(n) ** -0.2, float(n))
                                  for c, (n, sd, lo, hi) in wide.items() for i in range(points)],
                                 "column string, grid_index int, x double, lo double, width double, bw double, n double")
    # bins x points rows a column, independent of the data
    z = (F.col("x") - (F.col("lo") + F.col("bin") * F.col("width"))) / F.col("bw")
    kernel = F.exp(-z * z / 2) * F.col("weight") / (F.col("n") * F.col("bw") * F.lit((2 * 3.141592653589793) ** 0.5))
    return out.unionByName(binned.join(F.broadcast(laws), "column").groupBy("column", "grid_index", "x").agg(F.sum(kernel).alias("density")))


def _number(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def minmax(df: DataFrame, col: str, out: str | None = None, eps: float | None = 1e-10) -> DataFrame:
    """(x - min) / (max - min + eps), min and max taken as two scalars first; null if that is a division by zero."""
    mn, mx = df.agg(F.min(col), F.max(col)).first()
    den = (mx - mn if mx is not None else 0.0) + (eps or 0.0)
    return df.withColumn(out or f"{col}_norm", F.try_divide((F.col(col) - F.lit(mn)).cast("double"), F.lit(float(den))))


def score_means(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """Means of score columns (optionally of the rows meeting ``where``)."""
    src = df.filter(where) if where is not None else df
    return src.agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def industry_weighted_mean(df: DataFrame, list_col: str = "industries_llm", rel: str = "ai_relevance_llm",
                           score: str = "ai_score", top: int = 20, key: str = "orig_index") -> DataFrame:
    """mean(relevance x score) per industry over the rows that have the industry and a
    product; industries are the comma items stripped and lowered (duplicates merged, a null or
    'none' list has none, blank items dropped); top 20 by mean (ties: industry)."""
    items = F.when(F.col(list_col).isNull() | (F.col(list_col) == "none"), F.array().cast("array<string>")) \
        .otherwise(F.split(F.col(list_col), ","))
    inds = F.array_distinct(F.filter(F.transform(items, lambda s: F.lower(P.strip(s))), lambda s: s != ""))
    ex = df.select(key, (P.to_number(F.col(rel)) * F.col(score).cast("double")).alias("_p"),
                   F.explode(inds).alias("industry"))
    agg = (ex.filter(F.col("_p").isNotNull() & ~F.isnan("_p")).groupBy("industry")
             .agg(F.avg("_p").alias("weighted_mean"), F.count(F.lit(1)).alias("n")))
    return agg.orderBy(F.col("weighted_mean").desc(), F.col("industry").asc()).limit(top)


def text_length_stats(df: DataFrame, col: str = "plain_text", bins: int = 50) -> DataFrame:
    """Histogram of character lengths (null texts excluded)."""
    return histogram(df.select(F.length(col).alias("text_len")), "text_len", bins)


def word_counts(df: DataFrame, col: str = "plain_text", stop: Sequence[str] = (), top: int | None = 20,
                keep_pattern: str = r"^[a-z]{3,}$") -> DataFrame:
    """Lower-case ASCII words of >= 3 letters, minus stop words, counted (top n)."""
    # explode the word runs first: the per-token test is then a code-generated filter
    toks = df.select(F.explode(T.word_runs(F.col(col))).alias("word")).filter(F.col("word").rlike(keep_pattern))
    if stop:
        toks = toks.filter(~F.col("word").isin(list(stop)))
    return value_counts(toks, "word", top=top)


def frequent_word_counts(df: DataFrame, col: str = "plain_text", stop: Sequence[str] = (), top: int = 20,
                         keep_pattern: str = r"^[a-z]{3,}$", support: float = 1e-4) -> DataFrame:
    """A36 for very large vocabularies: the rows of :func:`word_counts`, of which only candidates shuffle; the texts are read twice.

    A first scan keeps a sketch of frequent items a partition and merges them: at most 1 / ``support`` words (1e-4 at least), every
    word above that share of all words among them.  A second scan counts these exactly and all others together.  The answer is
    proven if the last of the top words lies above the share; otherwise (a flat vocabulary, fewer words than ``top``) all are counted.
    """
    toks = df.select(F.explode(T.word_runs(F.col(col))).alias("word")).filter(F.col("word").rlike(keep_pattern))
    if stop:
        toks = toks.filter(~F.col("word").isin(list(stop)))
    known = cut_lineage(toks.stat.freqItems(["word"], support).select(F.explode("word_freqItems").alias("known")))
    held = cut_lineage(toks.join(F.broadcast(known), F.col("word") == F.col("known"), "left")  # 1 / support rows at most
                       .groupBy(F.col("known").alias("word")).agg(F.count(F.lit(1)).alias("count")))
    best = held.filter(F.col("word").isNotNull()).orderBy(F.col("count").desc(), "word").limit(top)
    n, last = best.agg(F.count(F.lit(1)), F.min("count")).first()
    total = held.agg(F.sum("count")).first()[0] or 0
    if n == top and last > support * total:
        return best.select("word", "count")
    return word_counts(df, col, stop, top, keep_pattern)


def grouped_word_counts(df: DataFrame, by: str, col: str = "plain_text", stop: Sequence[str] = (), top: int = 20,
                        vocab: int = 5000, keep_pattern: str = r"^[a-z]{3,}$") -> DataFrame:
    """(by, word, count): the top n words of every group among the ``vocab`` most frequent words of all rows.

    Ties go to the smaller word, in the vocabulary and in the groups; rows with a null group count for neither.  The texts are
    counted once by (group, word), with partial sums; the vocabulary (``vocab`` rows at most) is joined to these counts.
    """
    toks = df.filter(F.col(by).isNotNull()).select(by, F.explode(T.word_runs(F.col(col))).alias("word")).filter(F.col("word").rlike(keep_pattern))
    if stop:
        toks = toks.filter(~F.col("word").isin(list(stop)))
    counts = toks.groupBy(by, "word").agg(F.count(F.lit(1)).alias("count"))
    known = counts.groupBy("word").agg(F.sum("count").alias("_n")).orderBy(F.col("_n").desc(), "word").limit(vocab).select("word")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("count").desc(), "word"))
    return counts.join(known, "word", "left_semi").withColumn("_rn", rank).filter(F.col("_rn") <= top).select(by, "word", "count")


def keyword_word_counts(df: DataFrame, keywords: Sequence[str], col: str = "plain_text", flag: str | None = None,
                        top: int = 30) -> DataFrame:
    """Whitespace tokens of (flagged) text, top n by count, then only those in the keyword list."""
    src = df.filter(_flag(flag)) if flag else df
    toks = (src.select(F.explode(F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), P.BLANK + "+")).alias("word"))
               .filter(F.col("word") != ""))
    top_words = value_counts(toks, "word", top=top)
    return top_words.filter(F.col("word").isin([k.lower() for k in keywords]))


def one_hot_sums(df: DataFrame, list_col: str = "industries_llm", key: str = "orig_index", top: int = 10,
                 raw: bool = False):
    """Articles per value of a comma list (stripped, lowered, 'none' and blanks out), top n.

    Values are de-duplicated inside each row, so counting rows per value counts articles (one row
    per article key): a plain partial count, no distinct aggregation across the shuffle."""
    from presslens.operators.labelling import list_values

    vals = F.array_distinct(list_values(F.col(list_col), raw=raw))
    ex = df.select(key, F.explode(vals).alias("value"))
    agg = ex.groupBy("value").agg(F.count(F.lit(1)).alias("n_articles"))
    return agg.orderBy(F.col("n_articles").desc(), F.col("value").asc()).limit(top)


def sentiment_by_year(df: DataFrame, label_col: str = "sentiment_label", by: str = "year",
                      labels: Sequence[str] = ("Negative", "Neutral", "Positive")) -> DataFrame:
    """Count per (year, label) as a year x label table with fixed label order."""
    return pivot_counts(df, by, label_col, labels)


def flag_by_year(df: DataFrame, flag: str, by: str = "year") -> DataFrame:
    """Rows with the flag per year (years without such rows are absent, as in the study)."""
    return df.filter(_flag(flag) & F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("count"))


def publisher_event(df: DataFrame, pub: str = "publisher", event: str = "event_type") -> DataFrame:
    """Count per (publisher, event type)."""
    return count_by(df, [pub, event])


def cluster_summary(df: DataFrame, sizes: DataFrame, group: str = "cluster", text_col: str = "text",
                    order_col: str = "rank", k: int = 5) -> DataFrame:
    """Id, size, label sentence (first representative) and the k representatives in order.

    ``df`` holds ranked representatives, ``sizes`` one row (group, size) per cluster with the number of its
    members; only the k best per cluster are gathered (bounded array).
    """
    ranked = df.filter(F.col(order_col) <= k)
    reps = ranked.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("r"), F.col(text_col).alias("t")))),
                    lambda s: s["t"]).alias("representatives"))
    return (sizes.select(group, "size").join(reps, group, "left")
                 .withColumn("label_sentence", F.try_element_at(F.col("representatives"), F.lit(1))))


def flag_total(df: DataFrame, cond: Column) -> DataFrame:
    """Rows meeting a condition and all rows."""
    return df.agg(F.count_if(F.coalesce(cond, F.lit(False))).alias("n_true"), F.count(F.lit(1)).alias("n_rows"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, 25%, 50%, 75%, max per numeric column, as a long table
    (column, statistic, value).

    One aggregate gives the moments of every column; one grouped exact-quantile pass over the
    (column, value) long form gives all quartiles (no one-task gather of a column)."""
    from presslens.operators.stats import exact_quantiles

    stats = ("count", "mean", "std", "min", "max")
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"count_{i}"), F.avg(x).alias(f"mean_{i}"),
                 F.stddev_samp(x).alias(f"std_{i}"), F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(s).alias("statistic"), F.col(f"{s}_{i}").alias("value"))
                     for i, c in enumerate(cols) for s in stats])
    nums = cut_lineage(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))  # the input is read once
    base = nums.agg(*aggs).select(F.inline(rows))
    long = nums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                                        for c in cols])))
    q = exact_quantiles(long, "v", [0.25, 0.5, 0.75], group="column")
    quart = q.select("column", F.concat((F.col("p") * 100).cast("int").cast("string"), F.lit("%")).alias("statistic"),
                     "value")
    return base.unionByName(quart)


def describe_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A09 for text columns: (column, count, distinct, top, freq); nulls left out, ties: the smaller value.

    Counts per (column, value) come first, so no column's values meet in one task."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"))
                                        for c in cols])))
    counts = long.filter(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("distinct"),
        F.min_by("v", F.struct((-F.col("n")).alias("a"), F.col("v").alias("b"))).alias("top"), F.max("n").alias("freq"))


def _as_text_label(c: Column, empty_as: str = "unknown") -> Column:
    """pandas ``astype(str).str.strip()`` then '' -> ``empty_as`` (null becomes the text 'nan')."""
    t = F.when(c.isNull(), F.lit("nan")).otherwise(P.strip(c.cast("string")))
    return F.when(t == "", F.lit(empty_as)).otherwise(t)


def topic_barrier_matrix(df: DataFrame, topic: str = "ai_topic_llm", barrier: str = "barrier_cluster_label",
                         top_topics: int = 20, top_barriers: int = 10,
                         drop_barriers: Sequence[str] = ("other", "none", "unknown"),
                         drop_topics: Sequence[str] = ("unknown",)) -> DataFrame:
    """Clean both labels, drop non-informative ones, keep the top topics and the top barriers
    (both ranked on the same cleaned rows), and give every (topic, barrier) cell of that grid its
    count and its percent of the topic's row (zero cells included, long form).

    The two top lists are bounded (k values each); the grid is built from them by explode, and the
    counts are one partial aggregate joined onto it."""
    src = (df.select(_as_text_label(F.col(topic)).alias("topic"), _as_text_label(F.col(barrier)).alias("barrier"))
             .filter(~F.col("barrier").isin(list(drop_barriers)) & ~F.col("topic").isin(list(drop_topics))))

    def top(col: str, k: int) -> list[str]:
        rows = (src.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
                   .orderBy(F.col("_n").desc(), F.col(col).asc()).limit(k).collect())
        return [r[col] for r in rows]

    topics, barriers = top("topic", top_topics), top("barrier", top_barriers)
    spark = df.sparkSession
    grid = (spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in topics] or [F.lit(None).cast("string")]))
                                  .alias("topic"))
                 .select("topic", F.explode(F.array(*[F.lit(b) for b in barriers] or [F.lit(None).cast("string")]))
                         .alias("barrier"))
                 .filter(F.col("topic").isNotNull() & F.col("barrier").isNotNull()))
    counts = (src.filter(F.col("topic").isin(topics) & F.col("barrier").isin(barriers))
                 .groupBy("topic", "barrier").agg(F.count(F.lit(1)).alias("n_articles")))
    cells = grid.join(counts, ["topic", "barrier"], "left").withColumn(
        "n_articles", F.coalesce(F.col("n_articles"), F.lit(0)).cast("long"))
    w = Window.partitionBy("topic")
    return cells.withColumn("row_pct", F.try_divide(F.col("n_articles") * F.lit(100.0), F.sum("n_articles").over(w)))
