"""Projections, filters and predicates over the article table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Candidate names of the column-guessing step, and the publisher the cleaning drops.
COLUMN_CANDIDATES = {
    "published_date": ["published_date", "date", "publish_date", "pub_date", "published", "time", "timestamp"],
    "plain_text": ["plain_text", "text", "content", "body", "article"],
    "publisher": ["publisher", "source", "site", "sitename", "domain"],
}
DROP_PUBLISHERS = ["sn.dk"]


def map_columns(df: DataFrame, candidates: Mapping[str, Sequence[str]] = COLUMN_CANDIDATES) -> DataFrame:
    """Rename the first existing candidate of each target (driver-side lookup in ``df.columns``)."""
    lower = {c.lower(): c for c in df.columns}
    for target, names in candidates.items():
        if target in df.columns:
            continue
        for n in names:
            if n.lower() in lower:
                df = df.withColumnRenamed(lower[n.lower()], target)
                break
    return df


def select_existing(df: DataFrame, cols: Sequence[str], n: int | None = None) -> DataFrame:
    """Keep the listed columns that exist; ``n`` previews the first rows, in the order of those columns."""
    out = df.select([c for c in cols if c in df.columns])
    return out.orderBy(*out.columns).limit(n) if n else out


def with_year(df: DataFrame, col: str = "published_date", out: str = "year") -> DataFrame:
    """Year of a free-text date; unparsable dates give null (never fail the query)."""
    return df.withColumn(out, F.year(F.try_to_timestamp(F.col(col).cast("string"))).cast("int"))


def year_between(df: DataFrame, lo: int | None = 2016, hi: int | None = None, col: str = "year") -> DataFrame:
    c = F.col(col)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c >= lo)
    if hi is not None:
        cond = cond & (c <= hi)
    return df.filter(cond)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in ``order`` (pandas ``drop_duplicates`` keep='first').

    ``row_number() = 1`` lets Spark put a partial group-limit before the shuffle, so a key
    that holds a third of all rows is cut to one row per input partition first.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def unique_rows(df: DataFrame, keys: Sequence[str] = ("publisher", "title"), order_col: str = "orig_index"):
    """Keep the first row of each key tuple, first = smallest ``order_col``."""
    return first_per_key(df, list(keys), [F.col(order_col).asc()])


def clean_news(df: DataFrame, drop_publishers: Sequence[str] = DROP_PUBLISHERS,
               keys: Sequence[str] = ("publisher", "title"), order_col: str = "orig_index") -> DataFrame:
    """Drop listed publishers (null publishers stay), then one row per (publisher, title)."""
    kept = df.filter(F.col("publisher").isNull() | ~F.col("publisher").isin(list(drop_publishers)))
    return unique_rows(kept, keys, order_col)


def date_floor_text(df: DataFrame, floor: str = "2016", col: str = "published_date") -> DataFrame:
    """Lexicographic ``col >= floor`` on the date text (kept on purpose; not a date test)."""
    return df.filter(F.col(col).cast("string") >= F.lit(floor))


def drop_unlabeled(df: DataFrame, col: str = "is_ai_llm") -> DataFrame:
    return df.na.drop(subset=[col])


def score_above(df: DataFrame, col: str, t: float) -> DataFrame:
    return df.filter(F.col(col) > F.lit(t))


def flag_ai(df: DataFrame, rule: str = "both", score_col: str = "ai_score", kw_col: str = "keyword_score",
            threshold: float = 0.32, out: str = "is_ai") -> DataFrame:
    """``is_ai`` by one of the study's rules.

    ``semantic``: score > threshold; ``both``: score > 0 and keyword score > 0;
    ``positive``: score > 0; ``keyword``: keyword score > 0.  Nulls give False.
    """
    s, k = F.col(score_col), F.col(kw_col)
    cond = {
        "semantic": lambda: s > F.lit(threshold),
        "both": lambda: (s > 0) & (k > 0),
        "positive": lambda: s > 0,
        "keyword": lambda: k > 0,
    }[rule]()
    return df.withColumn(out, F.coalesce(cond, F.lit(False)))


def flag_disagreement(df: DataFrame, label_col: str = "is_ai_llm", kw_col: str = "keyword_score") -> DataFrame:
    """Rows the model called not-AI although a keyword hit."""
    return df.filter((F.col(label_col) == F.lit(False)) & (F.col(kw_col) > 0))


def exclude_labels(df: DataFrame, col: str, labels: Sequence[str], case_insensitive: bool = True) -> DataFrame:
    """Drop rows whose label is in ``labels`` (null labels are dropped too)."""
    c = F.col(col).cast("string")
    if case_insensitive:
        return df.filter(c.isNotNull() & ~F.lower(c).isin([x.lower() for x in labels]))
    return df.filter(c.isNotNull() & ~c.isin(list(labels)))


def label_case(c: Column, mapping: Mapping[object, str], default: str | None = None) -> Column:
    """Map boolean (or other) values to display categories."""
    out = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


def in_clusters(df: DataFrame, names: Sequence[str], col: str = "cluster_name") -> DataFrame:
    return df.filter(F.col(col).isin(list(names)))


def shard_filter(df: DataFrame, n: int, i: int | None, start: int = 0, limit: int = 0,
                 key: str = "orig_index") -> DataFrame:
    """Rows of shard ``i`` (``key % n == i``) from ``start`` on, the first ``limit`` by key.

    ``i=None`` returns every shard with its ``shard_id``; the per-shard limit is a top-k per
    group (``row_number <= limit``), which Spark pre-limits on each partition.
    """
    out = df.filter(F.col(key) >= start).withColumn("shard_id", F.pmod(F.col(key), F.lit(n)).cast("int"))
    if i is not None:
        out = out.filter(F.col("shard_id") == i)
    if limit and limit > 0:
        w = Window.partitionBy("shard_id").orderBy(F.col(key).asc())
        out = out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")
    return out


def pending_rows(df: DataFrame, out_cols: Sequence[str]) -> DataFrame:
    """Rows with any output column still null (resume: finished rows are skipped)."""
    cond = F.lit(False)
    for c in out_cols:
        cond = cond | F.col(c).isNull()
    return df.filter(cond)
