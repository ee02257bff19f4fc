"""Shared helpers of the training-data operators: staged tables, Arrow batch size, worker caches."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.session import ensure_checkpoint_dir

#: ASCII white space, as a character class shared by every contract of this folder.
BLANKS = r"[\x20\x09-\x0D]+"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below ``spark.checkpoint.dir`` and return the written table.

    Cuts the lineage: a lost executor costs a re-read of shared files, and later plans do not run the
    (often Python-backed) producer again.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the Arrow batch size to ``rows`` so that a batch of long texts fits a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def unused(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that ``df`` does not have, so that no caller's column is overwritten."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while f"__{name}" in taken:
            name += "_"
        out.append(f"__{name}")
    return out


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """An object kept for the life of a Python worker (a loaded tokenizer, a word cache).

    Package code is pickled by value, so its module globals live for one task only; the object is
    therefore held in a module registered in ``sys.modules``.
    """
    holder = sys.modules.get("_presslens_worker")
    if holder is None:
        holder = sys.modules["_presslens_worker"] = types.ModuleType("_presslens_worker")
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))
