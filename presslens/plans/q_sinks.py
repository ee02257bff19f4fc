"""Registered queries: sources and sinks that write (S04-S09) and the streaming label job.

Each writes under the session's checkpoint folder (the shared folder the cluster names) in a
fresh sub-folder and returns what it reads back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from presslens.operators.labelling import build_prompt
from presslens.plans import sqlgen as S
from presslens.plans.registry import query
from presslens.plans.rules import KeywordRules, answer_sql, hits_sql
from presslens.plans.trends import FIXTURE_KEYWORDS
from presslens.session import checkpoint_path
from presslens.sources import readers as R
from presslens.sources import sinks as K
from presslens.sources.fixtures import view


def _folder(spark, name: str) -> str:
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("s04_read_shards", ["llm_out"], """
SELECT orig_index, is_ai_llm, ai_relevance_llm, ai_topic_llm, ai_barrier_llm, ai_barrier_type_llm, industries_llm,
       CAST(orig_index % 2 AS INT) AS src_priority FROM llm_out""")
def s04_read_shards(spark, sf):
    base = _folder(spark, "shards")
    d = view(spark, sf, "llm_out")
    paths = []
    for i in range(2):
        p = f"{base}/shard_{i}"
        K.write_stage(d.filter(F.pmod(F.col("orig_index"), F.lit(2)) == i), p)
        paths.append(p)
    return R.read_shards(spark, paths)


@query("s05_write_stage", ["news"], f"SELECT orig_index, {S.year_sql()} AS year, publisher FROM news")
def s05_write_stage(spark, sf):
    from presslens.operators.clean import with_year

    p = _folder(spark, "stage")
    K.write_stage(with_year(view(spark, sf, "news")).select("orig_index", "year", "publisher"), p,
                  partition_by=["year"])
    return spark.read.parquet(p)


@query("s06_write_json_map", ["clustered"], """
SELECT CAST(cluster AS BIGINT) AS key, list(CAST(orig_index AS BIGINT) ORDER BY orig_index) AS value FROM (
  SELECT cluster, orig_index, row_number() OVER (PARTITION BY cluster ORDER BY orig_index) AS r FROM clustered)
WHERE r <= 5 GROUP BY cluster""")
def s06_write_json_map(spark, sf):
    p = _folder(spark, "json-map")
    from pyspark.sql import Window

    first5 = (view(spark, sf, "clustered")
              .withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy("orig_index")))
              .filter(F.col("_r") <= 5))
    reps = first5.groupBy("cluster").agg(F.array_sort(F.collect_list("orig_index")).alias("members"))
    K.write_json_map(reps, "cluster", "members", p)
    return spark.read.json(p)


@query("s07_append_labels", ["human_labels"],
       "SELECT *, CAST(CAST(to_timestamp(ts) AS DATE) AS VARCHAR) AS day FROM human_labels")
def s07_append_labels(spark, sf):
    p = _folder(spark, "label-log")
    h = view(spark, sf, "human_labels")
    K.append_labels(h.filter(F.col("human_is_ai") == 1), p)
    K.append_labels(h.filter(F.col("human_is_ai") != 1), p)
    return spark.read.parquet(p).withColumn("day", F.col("day").cast("string"))


@query("s08_load_columnset", ["news"], """
SELECT orig_index, plain_text, title, publisher, sitename, published_date, lang, src_priority FROM (
  SELECT *, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INT) AS src_priority,
         row_number() OVER (PARTITION BY lang, publisher, title ORDER BY orig_index) AS rn
  FROM news WHERE lang IS NOT NULL AND (publisher IS NULL OR publisher NOT IN ('sn.dk'))) WHERE rn = 1""")
def s08_load_columnset(spark, sf):
    from presslens.operators.clean import clean_news

    base = _folder(spark, "columnset")
    n = view(spark, sf, "news")
    paths = []
    for lang in sorted(r["lang"] for r in n.select("lang").distinct().collect() if r["lang"]):  # a few languages
        p = f"{base}/{lang}"
        K.write_stage(n.filter(F.col("lang") == lang), p)
        paths.append(p)
    frames = R.load_columnset(spark, paths, cleaner=clean_news)
    return R.stack_frames(frames)


@query("s09_embedding_table_write", ["clustered"], "SELECT orig_index, embedding FROM clustered")
def s09_embedding_table_write(spark, sf):
    p = _folder(spark, "vectors")
    K.embedding_table_write(view(spark, sf, "clustered"), p)
    return R.read_embeddings(spark, p)


@query("st01_stream_labels", ["news"], f"""
SELECT orig_index, {answer_sql(FIXTURE_KEYWORDS)} AS answer, {hits_sql(FIXTURE_KEYWORDS)} > 0 AS is_ai_llm,
       CAST(least(100, 10 * {hits_sql(FIXTURE_KEYWORDS)}) AS DOUBLE) AS ai_relevance_llm,
       CASE WHEN {hits_sql(FIXTURE_KEYWORDS)} > 0 THEN 'licensing' ELSE 'other' END AS ai_topic_llm FROM news""")
def st01_stream_labels(spark, sf):
    from presslens.streaming.labelling import stream_labels

    base = _folder(spark, "stream")
    news = build_prompt(view(spark, sf, "news")).select("orig_index", "prompt")
    # files of bounded size, written where the rows are read; a trigger takes a few for every core
    K.write_stage(news, f"{base}/incoming", max_rows=20_000)
    stream_labels(spark, f"{base}/incoming", news.schema, KeywordRules(FIXTURE_KEYWORDS), f"{base}/labels",
                  f"{base}/state", max_files_per_trigger=4 * spark.sparkContext.defaultParallelism)
    return (spark.read.parquet(f"{base}/labels")
            .select("orig_index", "answer", "is_ai_llm", "ai_relevance_llm", "ai_topic_llm"))
