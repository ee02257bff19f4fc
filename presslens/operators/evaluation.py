"""Sampling and evaluation.

Samples are deterministic and engine-independent: rows are ordered by
``md5('<key>:<seed>')``, so the same rows are drawn in Spark and DuckDB and on
every rerun.  A sample size ``n`` is the feature of these operators (the study
judges a fixed number of rows), not a cap on work.  Metrics are aggregates
over the judged rows; AUC uses the rank-sum formula on per-score counts with a
distributed running sum (no one-task window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.operators.rankcut import first_rows, numeric
from presslens.operators.stats import exact_quantiles, linspace, running_sums
from presslens.operators.windows import hash_order, sample_per_group

REPORT_COLUMNS = ["subset", "method", "bucket", "metric", "value", "n_samples"]


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "orig_index", direct_below: int = 1000) -> DataFrame:
    """Exactly min(n, rows) rows: the n smallest seeded hashes ``md5('<key>:<seed>')``.

    Small n is a plain top-n.  For larger n the rank is cut on the leading 48 bits of the hash
    (:func:`first_rows`), so no task merges n rows; the rows are the same.
    """
    h = hash_order(F.col(key), seed)
    if n < direct_below:
        return df.orderBy(h, F.col(key)).limit(n)
    prefix = F.conv(F.substring(h, 1, 12), 16, 10).cast("long")
    return first_rows(df, [(prefix, False)], [h, F.col(key)], n)


def sample_top_k(df: DataFrame, col: str, top_k: int = 500, n: int = 100, seed: int = 42,
                 key: str = "orig_index") -> DataFrame:
    """N random rows of the top_k by ``col`` (ties: key), tagged source / bucket."""
    order = [F.col(col).desc(), F.col(key).asc()]
    if top_k < 1000 or not numeric(df, col):
        top = df.orderBy(*order).limit(top_k)
    else:
        top = first_rows(df, [(F.col(col), True)] + ([(F.col(key), False)] if numeric(df, key) else []), order, top_k)
    return (sample_n(top, n, seed, key).withColumn("score_source", F.lit(col))
            .withColumn("score_bucket", F.lit(f"top{top_k}")))


def quantile_buckets(df: DataFrame, col: str, bins: int = 5) -> tuple[Column, list[float]]:
    """``qcut``: bucket label Column from exact quantile edges (right-closed, lowest included,
    equal edges dropped; labels follow the kept edges, e.g. '0-20%')."""
    probs = linspace(0.0, 1.0, bins + 1)
    rows = exact_quantiles(df, col, probs).collect()
    by_p = {float(r["p"]): float(r["value"]) for r in rows}
    edges: list[tuple[float, float]] = []
    for p in probs:
        v = by_p.get(float(p))
        if v is None:
            continue
        if not edges or v != edges[-1][1]:
            edges.append((p, v))
    x = F.col(col)
    out = F.lit(None).cast("string")
    if len(edges) < 2:
        return out, [e[1] for e in edges]
    for i in range(len(edges) - 1, 0, -1):
        (p0, _), (p1, v1) = edges[i - 1], edges[i]
        label = f"{int(100 * p0)}-{int(100 * p1)}%"
        out = F.when(x <= F.lit(v1), F.lit(label)).otherwise(out)
    return F.when(x >= F.lit(edges[0][1]), out), [e[1] for e in edges]


def stratified_by_quantile(df: DataFrame, col: str, bins: int = 5, n: int = 60, seed: int = 42,
                           key: str = "orig_index") -> DataFrame:
    """Qcut buckets on exact quantiles, up to n rows per bucket."""
    bucket, _ = quantile_buckets(df, col, bins)
    b = df.withColumn("score_bucket", bucket).filter(F.col("score_bucket").isNotNull())
    return sample_per_group(b, ["score_bucket"], n, seed, key).withColumn("score_source", F.lit(col))


def sample_disagree(df: DataFrame, a: str = "ai_score", b: str = "ai_score_simple", hi: float = 0.08,
                    lo: float = 0.0, n: int = 80, seed: int = 999, key: str = "orig_index") -> DataFrame:
    """Rows where one score is high and the other low, up to n per zone."""
    zone = (F.when((F.col(a) > hi) & (F.col(b) <= lo), F.lit(f"{a}_high_{b}_low"))
             .when((F.col(a) <= lo) & (F.col(b) > hi), F.lit(f"{a}_low_{b}_high")))
    z = df.withColumn("zone", zone).filter(F.col("zone").isNotNull())
    return (sample_per_group(z, ["zone"], n, seed, key).withColumn("score_source", F.lit("both"))
            .withColumn("score_bucket", F.lit("disagree_zone")))


def quantile_thresholds(df: DataFrame, col: str, n: int = 7, trim: bool = True) -> DataFrame:
    """Distinct exact quantiles at linspace(.1, .9, n), or n interior points of 0..1."""
    probs = linspace(0.1, 0.9, n) if trim else linspace(0.0, 1.0, n + 2)[1:-1]
    return exact_quantiles(df, col, probs).select(F.col("value").alias("threshold")).distinct()


def accuracy_at(df: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Share of rows where (score > t) equals the label, for each threshold (one aggregate)."""
    lab = F.col(label).cast("boolean")
    aggs = [F.avg(((F.col(score) > F.lit(float(t))) == lab).cast("double")).alias(f"a{i}")
            for i, t in enumerate(thresholds)]
    wide = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).agg(*aggs, F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"a{i}").alias("accuracy"))
                     for i, t in enumerate(thresholds)])
    return wide.select(F.inline(rows), F.col("n").alias("n_samples"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC AUC with average ranks for ties (Mann-Whitney), one row (auc, n_pos, n_neg)."""
    lab = F.col(label).cast("boolean")
    per = (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
             .groupBy(F.col(score).cast("double").alias("_s"))
             .agg(F.count_if(lab).alias("pos"), F.count_if(~lab).alias("neg"))
             .withColumn("n", F.col("pos") + F.col("neg")))
    ranked = running_sums(per, "_s", ["n"])
    avg_rank = F.col("n_before") + (F.col("n") + 1) / 2.0
    s = ranked.agg(F.sum(F.col("pos") * avg_rank).alias("_rs"), F.sum("pos").alias("n_pos"),
                   F.sum("neg").alias("n_neg"))
    p, q = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    # null when one class is missing
    return s.select(F.try_divide(F.col("_rs") - p * (p + 1) / 2, p * q).alias("auc"), "n_pos", "n_neg")


def accuracy_by_bucket(df: DataFrame, bucket: str, pred: Column, label: str) -> DataFrame:
    """Accuracy and n per bucket."""
    correct = (pred == F.col(label).cast("boolean")).cast("double")
    return df.groupBy(bucket).agg(F.avg(correct).alias("accuracy"), F.count(F.lit(1)).alias("n_samples"))


def accuracy_by_source(df: DataFrame, source_col: str, source: str, pred: Column, label: str) -> DataFrame:
    """Accuracy within the rows drawn by one method."""
    correct = (pred == F.col(label).cast("boolean")).cast("double")
    return (df.filter(F.col(source_col) == source)
              .agg(F.avg(correct).alias("accuracy"), F.count(F.lit(1)).alias("n_samples")))


def accuracy_by_zone(df: DataFrame, score: str, label: str, t: float, zone: str = "zone") -> DataFrame:
    """Accuracy over all disagreement rows ('all') and per zone."""
    correct = ((F.col(score) > F.lit(t)) == F.col(label).cast("boolean")).cast("double")
    per = df.groupBy(zone).agg(F.avg(correct).alias("accuracy"), F.count(F.lit(1)).alias("n_samples"))
    tot = df.agg(F.lit("all").alias(zone), F.avg(correct).alias("accuracy"), F.count(F.lit(1)).alias("n_samples"))
    return per.unionByName(tot)


def metric_rows(df: DataFrame, subset: str, method: str, metric: str, value_col: str, n_col: str,
                bucket: str | Column = "all") -> DataFrame:
    """Rows of the long metric report from an aggregated table."""
    b = F.lit(bucket) if isinstance(bucket, str) and bucket not in df.columns else \
        (F.col(bucket) if isinstance(bucket, str) else bucket)
    return df.select(F.lit(subset).alias("subset"), F.lit(method).alias("method"), b.cast("string").alias("bucket"),
                     F.lit(metric).alias("metric"), F.col(value_col).cast("double").alias("value"),
                     F.col(n_col).cast("long").alias("n_samples"))


def metric_report(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of metric rows with the fixed schema."""
    out = parts[0].select(*REPORT_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*REPORT_COLUMNS))
    return out


def label_sample(df: DataFrame, labels: DataFrame, subset: str, key: str = "orig_index", answer_col: str = "answer",
                 out: str = "is_ai_label") -> DataFrame:
    """Attach the model's yes/no label and the subset name; missing source / bucket / zone get
    the study's defaults ('both', 'all', 'all')."""
    from presslens.functions.parse import yes_no

    j = df.drop(out).join(labels.select(key, yes_no(F.col(answer_col)).alias(out)), key, "left")
    j = j.withColumn(out, F.coalesce(F.col(out), F.lit(False))).withColumn("subset", F.lit(subset))
    for c, d in (("score_source", "both"), ("score_bucket", "all"), ("zone", "all")):
        j = j.withColumn(c, F.coalesce(F.col(c), F.lit(d))) if c in j.columns else j.withColumn(c, F.lit(d))
    return j


def label_pool(df: DataFrame, mode: str = "stratified", n: int = 2000, col: str = "ai_score", seed: int = 42,
               key: str = "orig_index", **kw) -> DataFrame:
    """Candidate pool for manual labelling: 'stratified' (10 quantile bins, n/10 each) or
    'priority' (O05).  Repeated keys count once; a pool of at most n candidates comes back whole."""
    if mode == "stratified":
        cand = df.filter(F.col(col) > 0).dropDuplicates([key])
        bucket, edges = quantile_buckets(cand, col, 10)
        per_bin = max(1, n // max(1, len(edges) - 1))     # bins left after equal edges are dropped
        b = cand.withColumn("score_bucket", bucket)
        if cand.limit(n + 1).count() <= n:
            return b.withColumn("score_source", F.lit(col))
        b = b.filter(F.col("score_bucket").isNotNull())
        return sample_per_group(b, ["score_bucket"], per_bin, seed, key).withColumn("score_source", F.lit(col))
    from presslens.operators.windows import priority_pool

    return priority_pool(df, n, score=col, key=key, **kw)


def precision_recall_subsets(df: DataFrame, col: str, thresholds: Sequence[float] = (0.40, 0.30)) -> DataFrame:
    """Sizes of the nested subsets ``col > t`` (one aggregate)."""
    aggs = [F.count_if(F.col(col) > F.lit(float(t))).alias(f"n{i}") for i, t in enumerate(thresholds)]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n"))
                     for i, t in enumerate(thresholds)])
    return df.agg(*aggs).select(F.inline(rows))


def sample_two_sided(df: DataFrame, col: str, hi: float = 0.1, lo: float = -0.1, n: int = 100, seed: int = 42,
                     key: str = "orig_index") -> DataFrame:
    """N random rows above ``hi`` plus n at or below ``lo``, tagged 'pos' / 'neg'."""
    side = F.when(F.col(col) > hi, F.lit("pos")).when(F.col(col) <= lo, F.lit("neg"))
    return sample_per_group(df.withColumn("side", side).filter(F.col("side").isNotNull()), ["side"], n, seed, key)
