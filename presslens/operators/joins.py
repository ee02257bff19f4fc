"""Joins (J01-J11).  Strategy is left to Catalyst / AQE: small sides become broadcast joins at
run time from their measured size; no side is hinted unless its row count was checked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only after proving the table has at most ``max_rows`` rows."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def attach_scores(df: DataFrame, scores: DataFrame, key: str = "orig_index",
                  cols: Sequence[str] = ("ai_score", "keyword_score")) -> DataFrame:
    """Left join of score columns by key."""
    return df.join(scores.select(key, *cols), key, "left")


def attach_vectors(df: DataFrame, emb: DataFrame, key: str = "orig_index", emb_col: str = "embedding"):
    """Vectors of the kept rows (inner equi-join on the key)."""
    return df.join(emb.select(key, emb_col), key, "inner")


def attach_totals(counts: DataFrame, totals: DataFrame, key: str = "year", n: str = "count",
                  total: str = "total", out: str = "share") -> DataFrame:
    """J03 (join form): group totals joined back on the key, then share."""
    return (counts.join(totals.select(key, total), key, "left")
                  .withColumn(out, F.try_divide(F.col(n).cast("double"), F.col(total))))


def prominence_join(totals: DataFrame, flagged: DataFrame, key: str = "year", how: str = "inner",
                    total: str = "total_articles", ai: str = "ai_articles", out: str = "ai_ratio") -> DataFrame:
    """Totals and flagged counts per key; ``how='outer'`` fills missing counts with 0.
    The ratio is 0 when the total is 0."""
    j = totals.join(flagged, key, "full" if how == "outer" else "inner")
    if how == "outer":
        j = j.withColumn(total, F.coalesce(F.col(total), F.lit(0))).withColumn(ai, F.coalesce(F.col(ai), F.lit(0)))
    return j.withColumn(out, F.when(F.col(total) > 0, F.col(ai).cast("double") / F.col(total))
                        .otherwise(F.lit(0.0)))


def todo_queue(pool: DataFrame, labels: DataFrame, key: str = "orig_index") -> DataFrame:
    """Pool rows not yet labelled (anti join)."""
    return pool.join(labels.select(key), key, "left_anti")


def org_in_set(df: DataFrame, actors: DataFrame, org_col: str = "organisation", type_col: str = "actor_type",
               keep_type: str | Sequence[str] = "Company") -> DataFrame:
    """Keep exploded organisations whose actor type is ``keep_type``, or one of several (semi join)."""
    types = [keep_type] if isinstance(keep_type, str) else list(keep_type)
    wanted = actors.filter(F.col(type_col).isin(types)).select(org_col)
    return df.join(wanted, org_col, "left_semi")


def map_lookup(df: DataFrame, col: str, mapping: Mapping | DataFrame, default=None, out: str | None = None,
               key_col: str = "key", value_col: str = "value") -> DataFrame:
    """Dictionary lookup with a default.  A dict becomes a literal map; a table is joined."""
    out = out or f"{col}_mapped"
    if isinstance(mapping, Mapping):
        m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
        looked = F.try_element_at(m, F.col(col))
    else:
        tbl = mapping.select(F.col(key_col).alias("_k"), F.col(value_col).alias("_v"))
        df = df.join(tbl, F.col(col).eqNullSafe(F.col("_k")), "left").drop("_k")
        looked = F.col("_v")
    res = F.coalesce(looked, F.lit(default)) if default is not None else looked
    out_df = df.withColumn(out, res)
    return out_df.drop("_v") if "_v" in out_df.columns and out != "_v" else out_df


def cluster_name_join(df: DataFrame, names: DataFrame, cluster: str = "cluster", name_col: str = "majority_label",
                      out: str = "cluster_name", noise: int = -1) -> DataFrame:
    """Cluster id -> its majority topic; the noise id stays as the text '-1'."""
    j = df.join(names.select(cluster, F.col(name_col).alias("_name")), cluster, "left")
    return j.withColumn(out, F.when(F.col(cluster) == noise, F.lit(str(noise))).otherwise(F.col("_name"))) \
        .drop("_name")


def repr_label_join(labels: DataFrame, reps: DataFrame, cluster: str = "cluster", rep_col: str = "repr_label",
                    noise: int = -1, noise_label: str = "other") -> DataFrame:
    """Attach each raw label's cluster representative; noise -> 'other'."""
    j = labels.join(reps.select(cluster, F.col(rep_col).alias("_rep")), cluster, "left")
    return j.withColumn(rep_col, F.when(F.col(cluster) == noise, F.lit(noise_label)).otherwise(F.col("_rep"))) \
        .drop("_rep")


def score_dedupe_join(df: DataFrame, scores: DataFrame, key: str = "orig_index", value: str = "ai_score"):
    """Duplicate keys in the score table are averaged first, then left-joined."""
    uniq = scores.groupBy(key).agg(F.avg(value).alias(value))
    return df.join(uniq, key, "left")


def rejoin_by_score(samples: DataFrame, df: DataFrame, keys: Sequence[str] = ("ai_score", "ai_score_simple"),
                    cols: Sequence[str] = ("keyword_score",)) -> DataFrame:
    """Re-attach columns by equality on score columns (fans out on ties, as the study did)."""
    return samples.join(df.select(*keys, *cols), list(keys), "left")
