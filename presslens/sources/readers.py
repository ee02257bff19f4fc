"""Sources (S01-S04, S08): article tables, vectors and label shards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEWS_SCHEMA = T.StructType([
    T.StructField("orig_index", T.LongType()),
    T.StructField("plain_text", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("publisher", T.StringType()),
    T.StructField("sitename", T.StringType()),
    T.StructField("published_date", T.StringType()),
    T.StructField("url", T.StringType()),
])


def read_news(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet",
              schema: T.StructType | None = None) -> DataFrame:
    """The article table.  CSV is read with an explicit schema and multi-line quoting
    (article text holds newlines); Parquet keeps its own schema and pushes filters down."""
    if fmt == "csv":
        return (spark.read.schema(schema or NEWS_SCHEMA).option("header", True).option("multiLine", True)
                .option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(fmt).load(path)


def fill_text(df: DataFrame, col: str = "plain_text") -> DataFrame:
    """Null text -> ''."""
    return df.na.fill("", [col])


def read_embeddings(spark: SparkSession, path: str, key: str = "vec_id", out_key: str = "orig_index") -> DataFrame:
    """``(orig_index, embedding ARRAY<FLOAT>)`` keyed explicitly (never aligned by position)."""
    df = spark.read.parquet(path)
    return df.withColumnRenamed(key, out_key) if key != out_key and key in df.columns else df


def read_shards(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet",
                schema: T.StructType | None = None) -> DataFrame:
    """Several shard files (or folders) stacked by column name; ``src_priority`` = position of
    the path in ``paths`` (the first listed path wins later de-duplication).

    Columns that only some shards have are null in the others."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    shards = [reader.format(fmt).load(p).withColumn("src_priority", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def _strip_scheme(p: str) -> str:
    """'file:/x', 'file:///x', 'hdfs://nn/x' -> the path part."""
    if "://" in p:
        rest = p.split("://", 1)[1]
        return rest if rest.startswith("/") else "/" + rest.split("/", 1)[1] if "/" in rest else rest
    if p.startswith("file:"):
        return p[5:]
    return p


def stack_frames(dfs: Sequence[DataFrame], priority_col: str | None = "src_priority") -> DataFrame:
    """Vertical union by column name (missing columns null); optional priority tag."""
    out = None
    for i, d in enumerate(dfs):
        if priority_col:
            d = d.withColumn(priority_col, F.lit(i))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def load_columnset(spark: SparkSession, paths: Sequence[str], cleaner=None, fmt: str = "parquet") -> list:
    """Load many stage outputs and clean each (returns lazy DataFrames)."""
    out = []
    for p in paths:
        d = read_news(spark, p, fmt)
        out.append(cleaner(d) if cleaner else d)
    return out
