"""Window operators (W01-W09) and ordering (O01-O06) and set operators.

Ranking windows are used as per-key top-k (``row_number() <= k``), which Spark
pre-limits inside every input partition before the shuffle.  Windows without a
partition key run only on aggregated tables (a few rows per distinct value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.functions.parse import strip
from presslens.operators.clean import first_per_key
from presslens.operators.rankcut import first_rows, numeric


def first_by_priority(df: DataFrame, key: str = "orig_index", order: Sequence[str] = ("src_priority",)):
    """After a union, the row of the first listed source wins (ties: remaining columns)."""
    tie = [F.col(c).asc_nulls_last() for c in df.columns if c not in (key, *order)
           and not str(df.schema[c].dataType).startswith(("Array", "Map", "Struct"))]
    return first_per_key(df, [key], [*(F.col(c).asc() for c in order), *tie])


def dup_flag(df: DataFrame, keys: Sequence[str], out: str = "is_dup") -> DataFrame:
    """Every member of a repeated key tuple (pandas ``keep=False``).

    Counted with a partial aggregate and joined back on the keys (null-safe), so a hot key is
    pre-counted map-side; the join side is one row per key.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) \
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n")
    cond = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        cond = c if cond is None else cond & c
    j = df.join(counts, cond, "left")
    return j.select(*df.columns, (F.col("_n") > 1).alias(out))


def rank_pick(df: DataFrame, by: str, label: str, rank: int = 2) -> DataFrame:
    """The row of the n-th biggest ``by`` (ties: label asc) of an aggregated table."""
    w = Window.orderBy(F.col(by).desc(), F.col(label).asc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == rank).drop("_r")


def representative_label(labels: DataFrame, cluster: str = "cluster", label: str = "raw_label",
                         out: str = "repr_label") -> DataFrame:
    """Per cluster the most frequent label, ties to the smaller label (noise included as is)."""
    freq = labels.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("_f"))
    return (freq.groupBy(cluster)
                .agg(F.min_by(F.col(label), F.struct((-F.col("_f")).alias("a"), F.col(label).alias("b")))
                     .alias(out)))


def hash_order(key: Column, seed: int) -> Column:
    """Deterministic pseudo-random order, identical in DuckDB: md5('<key>:<seed>')."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def sample_per_group(df: DataFrame, by: Sequence[str], n: int, seed: int = 42, key: str = "orig_index"):
    """Up to n rows per group in a seeded hash order (partial top-k per partition)."""
    w = Window.partitionBy(*by).orderBy(hash_order(F.col(key), seed), F.col(key))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def auc_ranks(df: DataFrame, score: str, label: str) -> DataFrame:
    """Average rank of every distinct score with its positive / negative counts.

    Rows are collapsed to one row per distinct score first (partial aggregate); the running
    count over the sorted scores is computed per value range (no one-task window).
    """
    from presslens.operators.stats import running_sums

    per = (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
             .groupBy(score).agg(F.count_if(F.col(label).cast("boolean")).alias("pos"),
                                 F.count_if(~F.col(label).cast("boolean")).alias("neg"))
             .withColumn("_n", F.col("pos") + F.col("neg")))
    ranked = running_sums(per, score, ["_n"])
    return ranked.select(score, "pos", "neg", (F.col("_n_before") + (F.col("_n") + 1) / 2.0).alias("avg_rank"))


# ---- ordering ----------------------------------------------------------------------------------

def top_n(df: DataFrame, by: str, n: int, label: str | None = None, ascending: bool = False) -> DataFrame:
    """First n rows after sorting ``by`` (ties: ``label`` asc) - a TakeOrdered."""
    o = F.col(by).asc() if ascending else F.col(by).desc()
    order = [o] + ([F.col(label).asc()] if label else [])
    return df.orderBy(*order).limit(n)


def bottom_n(df: DataFrame, by: str, n: int, label: str | None = None) -> DataFrame:
    return top_n(df, by, n, label, ascending=True)


def keep_top_categories(df: DataFrame, col: str, k: int) -> DataFrame:
    """Rows whose category is among the k most frequent (ties: category asc).

    The k categories are a bounded table (k rows) joined with a left-semi join.
    """
    top = (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
             .orderBy(F.col("_n").desc(), F.col(col).asc()).limit(k).select(col))
    return df.join(F.broadcast(top), col, "left_semi")


def sort_by(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """O04."""
    return df.orderBy(*cols)


def priority_pool(df: DataFrame, n: int = 2000, score: str = "ai_score", kw: str = "keyword_score",
                  noise_col: str = "cluster", target: float = 0.15, key: str = "orig_index") -> DataFrame:
    """Candidates with score > 0; noise first, then low keyword score, then closeness of the
    score to ``target``; the first n (beyond 1,000 by a rank cut, in no order)."""
    cand = df.filter(F.col(score) > 0)
    # missing keyword score / cluster count as 0, as in the study
    is_noise = F.coalesce((F.col(noise_col) == -1).cast("int"), F.lit(0))
    keys = [(is_noise, True), (F.coalesce(F.col(kw), F.lit(0)), False), (F.abs(F.col(score) - F.lit(target)), False)]
    order = [*[c.desc() if down else c.asc() for c, down in keys], F.col(key).asc()]
    if n < 1000:
        return cand.orderBy(*order).limit(n)
    return first_rows(cand, keys + ([(F.col(key), False)] if numeric(df, key) else []), order, n)


# ---- sets ----------------------------------------------------------------------------------------

def subset_complement(df: DataFrame, ids: DataFrame, key: str = "orig_index", negate: bool = True):
    """Rows (not) in a set of ids: anti / semi join."""
    return df.join(ids.select(key), key, "left_anti" if negate else "left_semi")


def distinct_labels(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-empty (stripped) label strings."""
    s = strip(F.col(col).cast("string"))
    return df.select(s.alias(col)).filter(F.col(col).isNotNull() & (F.col(col) != "")).distinct()
