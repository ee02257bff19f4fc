"""Registered queries: sources, projections, filters, predicates, sets, de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslens.functions import parse as P
from presslens.operators import clean as C
from presslens.operators import windows as W
from presslens.plans import sqlgen as S
from presslens.plans.registry import query
from presslens.plans.trends import scored_news
from presslens.plans.q_trends import SCORED_SQL
from presslens.sources import readers as R
from presslens.sources.fixtures import view


@query("s01_read_news", [], "SELECT doc_id, text, lang, source, n_chars FROM documents")
def s01_read_news(spark, sf):
    return R.read_news(spark, f"{sf}/documents.parquet")


@query("s02_fill_text", ["news_raw"], "SELECT orig_index, coalesce(plain_text, '') AS plain_text FROM news_raw")
def s02_fill_text(spark, sf):
    return R.fill_text(view(spark, sf, "news_raw")).select("orig_index", "plain_text")


@query("s03_read_embeddings", [], "SELECT vec_id AS orig_index, embedding, label FROM embeddings")
def s03_read_embeddings(spark, sf):
    return R.read_embeddings(spark, f"{sf}/embeddings.parquet")


@query("p01_map_columns", [], "SELECT doc_id, text AS plain_text, lang, source AS publisher, n_chars FROM documents")
def p01_map_columns(spark, sf):
    return C.map_columns(view(spark, sf, "documents"))


@query("p02_select_existing", ["news"], "SELECT orig_index, title, publisher FROM news")
def p02_select_existing(spark, sf):
    return C.select_existing(view(spark, sf, "news"), ["orig_index", "title", "url", "publisher"])


@query("p03_with_year", ["news"], f"SELECT orig_index, {S.year_sql()} AS year FROM news")
def p03_with_year(spark, sf):
    return C.with_year(view(spark, sf, "news")).select("orig_index", "year")


@query("p04_year_between", ["news"],
       f"SELECT orig_index, year FROM (SELECT orig_index, {S.year_sql()} AS year FROM news) "
       "WHERE year >= 2016 AND year <= 2024")
def p04_year_between(spark, sf):
    return C.year_between(C.with_year(view(spark, sf, "news")), 2016, 2024).select("orig_index", "year")


@query("p05_clean_news", ["news"], """
SELECT orig_index, publisher, title FROM (
  SELECT *, row_number() OVER (PARTITION BY publisher, title ORDER BY orig_index) AS rn
  FROM news WHERE publisher IS NULL OR publisher NOT IN ('src3')) WHERE rn = 1""")
def p05_clean_news(spark, sf):
    return C.clean_news(view(spark, sf, "news"), ["src3"]).select("orig_index", "publisher", "title")


@query("p06_date_floor_text", ["news"], "SELECT orig_index, published_date FROM news WHERE published_date >= '2019'")
def p06_date_floor_text(spark, sf):
    return C.date_floor_text(view(spark, sf, "news"), "2019").select("orig_index", "published_date")


@query("p07_drop_unlabeled", ["llm_out"], "SELECT orig_index, is_ai_llm FROM llm_out WHERE is_ai_llm IS NOT NULL")
def p07_drop_unlabeled(spark, sf):
    return C.drop_unlabeled(view(spark, sf, "llm_out")).select("orig_index", "is_ai_llm")


@query("p08_score_above", ["judged"], "SELECT orig_index, ai_score FROM judged WHERE ai_score > 0.25")
def p08_score_above(spark, sf):
    return C.score_above(view(spark, sf, "judged"), "ai_score", 0.25).select("orig_index", "ai_score")


@query("p09_flag_ai", ["judged"], """
SELECT orig_index,
  coalesce(ai_score > 0.32, FALSE) AS is_ai_semantic,
  coalesce(ai_score > 0 AND ai_score_simple > 0, FALSE) AS is_ai_both,
  coalesce(ai_score > 0, FALSE) AS is_ai_positive
FROM judged""")
def p09_flag_ai(spark, sf):
    j = view(spark, sf, "judged")
    j = C.flag_ai(j, "semantic", out="is_ai_semantic")
    j = C.flag_ai(j, "both", kw_col="ai_score_simple", out="is_ai_both")
    j = C.flag_ai(j, "positive", out="is_ai_positive")
    return j.select("orig_index", "is_ai_semantic", "is_ai_both", "is_ai_positive")


@query("p10_flag_disagreement", ["news", "llm_out"], f"""
WITH {SCORED_SQL}
SELECT s.orig_index, s.keyword_score FROM scored s JOIN llm_out l ON s.orig_index = l.orig_index
WHERE {S.to_bool_sql('l.is_ai_llm')} = FALSE AND s.keyword_score > 0""")
def p10_flag_disagreement(spark, sf):
    lab = view(spark, sf, "llm_out").select("orig_index", P.to_bool(F.col("is_ai_llm")).alias("is_ai_llm"))
    j = scored_news(view(spark, sf, "news")).join(lab, "orig_index")
    return C.flag_disagreement(j).select("orig_index", "keyword_score")


@query("p11_to_bool", ["llm_out"], f"""
SELECT orig_index, {S.to_bool_sql('is_ai_llm')} AS is_ai_llm_flag, {S.to_bool_sql('ai_barrier_llm')} AS barrier_flag
FROM llm_out""")
def p11_to_bool(spark, sf):
    d = view(spark, sf, "llm_out")
    return d.select("orig_index", P.to_bool(F.col("is_ai_llm")).alias("is_ai_llm_flag"),
                    P.to_bool(F.col("ai_barrier_llm")).alias("barrier_flag"))


@query("p12_to_number", ["llm_out"],
       "SELECT orig_index, try_cast(ai_relevance_llm AS DOUBLE) AS ai_relevance FROM llm_out")
def p12_to_number(spark, sf):
    d = view(spark, sf, "llm_out")
    return d.select("orig_index", P.to_number(F.col("ai_relevance_llm")).alias("ai_relevance"))


@query("p13_clean_label", ["llm_out"], f"""
SELECT orig_index, coalesce(nullif(lower({S.strip_sql('ai_topic_llm')}), ''), 'unknown') AS topic,
       nullif({S.strip_sql('ai_barrier_type_llm')}, '') AS barrier_type
FROM llm_out""")
def p13_clean_label(spark, sf):
    d = view(spark, sf, "llm_out")
    return d.select("orig_index", P.clean_label(F.col("ai_topic_llm"), "unknown", lower=True).alias("topic"),
                    P.clean_label(F.col("ai_barrier_type_llm")).alias("barrier_type"))


@query("p14_exclude_labels", ["llm_out"], """
SELECT orig_index, ai_topic_llm FROM llm_out
WHERE ai_topic_llm IS NOT NULL AND lower(ai_topic_llm) NOT IN ('none', 'nan', 'other', 'unknown')""")
def p14_exclude_labels(spark, sf):
    d = view(spark, sf, "llm_out")
    return C.exclude_labels(d, "ai_topic_llm", ["none", "nan", "other", "unknown"]).select("orig_index", "ai_topic_llm")


@query("p15_label_case", ["llm_out"], f"""
SELECT orig_index, CASE WHEN {S.to_bool_sql('is_ai_llm')} = TRUE THEN 'AI'
                        WHEN {S.to_bool_sql('is_ai_llm')} = FALSE THEN 'Not AI' ELSE 'Unknown' END AS ai_category
FROM llm_out""")
def p15_label_case(spark, sf):
    d = view(spark, sf, "llm_out")
    return d.select("orig_index", C.label_case(P.to_bool(F.col("is_ai_llm")), {True: "AI", False: "Not AI"},
                                               "Unknown").alias("ai_category"))


@query("p16_in_clusters", ["news"], "SELECT orig_index, lang AS cluster_name FROM news WHERE lang IN ('de', 'es')")
def p16_in_clusters(spark, sf):
    d = view(spark, sf, "news").select("orig_index", F.col("lang").alias("cluster_name"))
    return C.in_clusters(d, ["de", "es"])


@query("p17_shard_filter", ["news"], """
SELECT orig_index, shard_id FROM (
  SELECT orig_index, CAST(orig_index % 4 AS INT) AS shard_id,
         row_number() OVER (PARTITION BY orig_index % 4 ORDER BY orig_index) AS rn
  FROM news WHERE orig_index >= 100) WHERE rn <= 50""")
def p17_shard_filter(spark, sf):
    return C.shard_filter(view(spark, sf, "news"), 4, None, start=100, limit=50).select("orig_index", "shard_id")


@query("p18_pending_rows", ["llm_out"], """
SELECT orig_index FROM llm_out WHERE is_ai_llm IS NULL OR ai_barrier_llm IS NULL OR industries_llm IS NULL""")
def p18_pending_rows(spark, sf):
    return C.pending_rows(view(spark, sf, "llm_out"), ["is_ai_llm", "ai_barrier_llm", "industries_llm"]) \
        .select("orig_index")


@query("u01_stack_frames", ["llm_out"], """
SELECT orig_index, is_ai_llm, src_priority FROM (
  SELECT orig_index, is_ai_llm, 0 AS src_priority FROM llm_out
  UNION ALL SELECT orig_index, 'ja' AS is_ai_llm, 1 AS src_priority FROM llm_out WHERE ai_barrier_llm = 'yes')""")
def u01_stack_frames(spark, sf):
    d = view(spark, sf, "llm_out")
    extra = d.filter(F.col("ai_barrier_llm") == "yes").select("orig_index", F.lit("ja").alias("is_ai_llm"))
    return R.stack_frames([d.select("orig_index", "is_ai_llm"), extra])


@query("u02_subset_complement", ["news", "human_labels"], """
SELECT orig_index FROM news WHERE orig_index NOT IN (SELECT orig_index FROM human_labels)""")
def u02_subset_complement(spark, sf):
    return W.subset_complement(view(spark, sf, "news"), view(spark, sf, "human_labels")).select("orig_index")


@query("u03_distinct_labels", ["llm_out"], f"""
SELECT DISTINCT {S.strip_sql('ai_topic_llm')} AS ai_topic_llm FROM llm_out
WHERE ai_topic_llm IS NOT NULL AND {S.strip_sql('ai_topic_llm')} <> ''""")
def u03_distinct_labels(spark, sf):
    return W.distinct_labels(view(spark, sf, "llm_out"), "ai_topic_llm")


@query("w01_first_by_priority", ["shard_union"], """
SELECT orig_index, is_ai_llm, ai_topic_llm, src_priority FROM (
  SELECT *, row_number() OVER (PARTITION BY orig_index ORDER BY src_priority) AS rn FROM shard_union) WHERE rn = 1""")
def w01_first_by_priority(spark, sf):
    return W.first_by_priority(view(spark, sf, "shard_union")).select("orig_index", "is_ai_llm", "ai_topic_llm",
                                                                      "src_priority")


@query("w02_unique_rows", ["news"], """
SELECT orig_index, publisher, title FROM (
  SELECT *, row_number() OVER (PARTITION BY publisher, title ORDER BY orig_index) AS rn FROM news) WHERE rn = 1""")
def w02_unique_rows(spark, sf):
    return C.unique_rows(view(spark, sf, "news")).select("orig_index", "publisher", "title")
