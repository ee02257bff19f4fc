"""Sinks (S05-S07, S09): stage tables, JSON maps and the append-only label log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite", max_rows: int = 0) -> str:
    """Store one stage (Parquet by default; ``partition_by=['year']`` enables pruning; ``max_rows`` > 0 bounds each file)."""
    w = df.write.mode(mode).format(fmt)
    if max_rows:
        w = w.option("maxRecordsPerFile", max_rows)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_json_map(df: DataFrame, key: str, val: str, path: str) -> str:
    """One JSON object per key, ``{"key": ..., "value": [...]}`` lines."""
    (df.select(F.to_json(F.struct(F.col(key).alias("key"), F.col(val).alias("value"))).alias("value"))
       .write.mode("overwrite").text(path))
    return path


def append_labels(df: DataFrame, path: str, partition_by: Sequence[str] = ("day",), ts_col: str = "ts") -> str:
    """Append rows to a label log partitioned by day (header/schema written once by Parquet)."""
    out = df
    if "day" in partition_by and "day" not in df.columns:
        out = out.withColumn("day", F.to_date(F.timestamp_seconds(F.col(ts_col))))
    out.write.mode("append").partitionBy(*partition_by).parquet(path)
    return path


def embedding_table_write(df: DataFrame, path: str, key: str = "orig_index", emb_col: str = "embedding") -> str:
    """Vectors next to their ids."""
    df.select(key, emb_col).write.mode("overwrite").parquet(path)
    return path
