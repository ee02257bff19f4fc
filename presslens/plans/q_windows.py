"""Registered queries: windows W03-W09 and ordering O01-O06."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslens.operators import aggregates as A
from presslens.operators import vectors as V
from presslens.operators import windows as W
from presslens.operators.rankcut import first_rows
from presslens.plans import sqlgen as S
from presslens.plans.q_trends import SCORED_SQL
from presslens.plans.registry import query
from presslens.plans.trends import scored_news
from presslens.sources.fixtures import view


def _scored(spark, sf):
    return scored_news(view(spark, sf, "news"))


@query("w03_share_within", ["news"], """
SELECT publisher, lang, n, CAST(n AS DOUBLE) * 100 / sum(n) OVER (PARTITION BY publisher) AS pct FROM (
  SELECT publisher, lang, count(*) AS n FROM news GROUP BY 1, 2)""", rounded=["pct"])
def w03_share_within(spark, sf):
    counts = view(spark, sf, "news").groupBy("publisher", "lang").agg(F.count(F.lit(1)).alias("n"))
    return A.share_within(counts, "n", ["publisher"])


@query("w04_rank_pick", ["clustered"], """
SELECT cluster, size FROM (
  SELECT cluster, size, row_number() OVER (ORDER BY size DESC, cluster ASC) AS r FROM (
    SELECT cluster, count(*) AS size FROM clustered GROUP BY 1)) WHERE r = 2""")
def w04_rank_pick(spark, sf):
    sizes = view(spark, sf, "clustered").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return W.rank_pick(sizes, "size", "cluster", 2)


@query("w05_dup_flag", ["news"], """
SELECT orig_index, count(*) OVER (PARTITION BY publisher, title) > 1 AS is_dup FROM news""")
def w05_dup_flag(spark, sf):
    return W.dup_flag(view(spark, sf, "news"), ["publisher", "title"]).select("orig_index", "is_dup")


@query("w07_representative_label", ["clustered", "llm_out"], """
WITH c AS (SELECT c.cluster, l.ai_topic_llm AS raw_label, count(*) AS f
           FROM clustered c JOIN llm_out l ON c.orig_index = l.orig_index WHERE l.ai_topic_llm IS NOT NULL GROUP BY 1, 2)
SELECT cluster, raw_label AS repr_label FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY f DESC, raw_label ASC) AS rn FROM c) WHERE rn = 1""")
def w07_representative_label(spark, sf):
    lab = view(spark, sf, "llm_out").filter(F.col("ai_topic_llm").isNotNull()) \
        .select("orig_index", F.col("ai_topic_llm").alias("raw_label"))
    d = view(spark, sf, "clustered").select("orig_index", "cluster").join(lab, "orig_index")
    return W.representative_label(d)


@query("w08_sample_per_group", ["news"], """
SELECT orig_index, lang FROM (
  SELECT orig_index, lang, row_number() OVER (PARTITION BY lang
         ORDER BY md5(concat_ws(':', CAST(orig_index AS VARCHAR), '42')), orig_index) AS rn FROM news) WHERE rn <= 5""")
def w08_sample_per_group(spark, sf):
    return W.sample_per_group(view(spark, sf, "news"), ["lang"], 5, 42).select("orig_index", "lang")


@query("w09_auc_ranks", ["judged"], """
WITH per AS (SELECT ai_score_simple, count_if(is_ai_label) AS pos, count_if(NOT is_ai_label) AS neg
             FROM judged WHERE ai_score_simple IS NOT NULL AND is_ai_label IS NOT NULL GROUP BY 1)
SELECT *, coalesce(sum(pos + neg) OVER (ORDER BY ai_score_simple ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          + (pos + neg + 1) / 2.0 AS avg_rank FROM per""", rounded=["avg_rank"])
def w09_auc_ranks(spark, sf):
    return W.auc_ranks(view(spark, sf, "judged"), "ai_score_simple", "is_ai_label")


@query("o01_top_n", ["news"], f"""
WITH {SCORED_SQL}
SELECT orig_index, keyword_score FROM scored ORDER BY keyword_score DESC, orig_index ASC LIMIT 10""")
def o01_top_n(spark, sf):
    return W.top_n(_scored(spark, sf).select("orig_index", "keyword_score"), "keyword_score", 10, "orig_index")


@query("o02_bottom_n", ["news"], """
SELECT publisher, count FROM (SELECT publisher, count(*) AS count FROM news GROUP BY 1)
ORDER BY count ASC, publisher ASC LIMIT 5""")
def o02_bottom_n(spark, sf):
    counts = A.value_counts(view(spark, sf, "news"), "publisher")
    return W.bottom_n(counts, "count", 5, "publisher")


@query("o03_keep_top_categories", ["news_vec"], """
SELECT orig_index, label FROM news_vec WHERE label IN (
  SELECT label FROM news_vec WHERE label IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, label ASC LIMIT 3)""")
def o03_keep_top_categories(spark, sf):
    return W.keep_top_categories(view(spark, sf, "news_vec"), "label", 3).select("orig_index", "label")


@query("o04_sort_by", ["news"], f"""
WITH {SCORED_SQL}
SELECT year, publisher, count(*) AS count FROM scored WHERE year IS NOT NULL AND publisher IS NOT NULL
GROUP BY 1, 2 ORDER BY year, publisher""")
def o04_sort_by(spark, sf):
    return W.sort_by(A.count_by(_scored(spark, sf), ["year", "publisher"]), ["year", "publisher"])


@query("o05_priority_pool", ["news", "judged", "clustered"], f"""
WITH {SCORED_SQL},
d AS (SELECT j.orig_index, j.ai_score, s.keyword_score, c.cluster FROM judged j
      JOIN scored s ON j.orig_index = s.orig_index JOIN clustered c ON j.orig_index = c.orig_index)
SELECT orig_index, ai_score, keyword_score, cluster FROM d WHERE ai_score > 0
ORDER BY coalesce(CAST(cluster = -1 AS INT), 0) DESC, coalesce(keyword_score, 0) ASC, abs(ai_score - 0.15) ASC,
         orig_index ASC LIMIT 50""")
def o05_priority_pool(spark, sf):
    j = view(spark, sf, "judged").select("orig_index", "ai_score")
    d = (j.join(_scored(spark, sf).select("orig_index", "keyword_score"), "orig_index")
          .join(view(spark, sf, "clustered").select("orig_index", "cluster"), "orig_index"))
    return W.priority_pool(d, n=50)


@query("o06_top_k_by_score_per_query", ["news_vec", "protos"], f"""
WITH s AS (SELECT n.orig_index, avg({S.cosine_sql('n.embedding', 'p.embedding')}) AS score_event_2
           FROM news_vec n, protos p WHERE p.name = 'event_2' GROUP BY n.orig_index)
SELECT orig_index, score_event_2 FROM s ORDER BY score_event_2 DESC, orig_index LIMIT 10""",
       rounded=["score_event_2"])
def o06_top_k_by_score_per_query(spark, sf):
    d = V.multi_phrase_scores(view(spark, sf, "news_vec").select("orig_index", "embedding"),
                              view(spark, sf, "protos"))
    return W.top_n(d.select("orig_index", "score_event_2"), "score_event_2", 10, "orig_index")


@query("o05b_rank_cut", ["orders"], """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1200""")
def o05b_rank_cut(spark, sf):
    """The first 1,200 orders by price, cut by counts down to 100 rows and only those sorted."""
    orders = view(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return first_rows(orders, [(price, True), (key, False)], [price.desc(), key.asc()], 1200, left=100)
