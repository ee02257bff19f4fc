"""Registered queries: joins J01-J12."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslens.functions import parse as P
from presslens.operators import aggregates as A
from presslens.operators import joins as J
from presslens.operators import text as TX
from presslens.operators import vectors as V
from presslens.plans import sqlgen as S
from presslens.plans.q_aggregates import EVENT_SQL, ORGS_SQL
from presslens.plans.q_trends import SCORED_SQL
from presslens.plans.registry import query
from presslens.plans.trends import scored_news
from presslens.sources.fixtures import view


def _scored(spark, sf):
    return scored_news(view(spark, sf, "news"))


@query("j01_attach_scores", ["llm_out", "judged"], """
SELECT l.orig_index, l.is_ai_llm, j.ai_score, j.ai_score_simple FROM llm_out l LEFT JOIN judged j ON l.orig_index = j.orig_index""")
def j01_attach_scores(spark, sf):
    d = view(spark, sf, "llm_out").select("orig_index", "is_ai_llm")
    return J.attach_scores(d, view(spark, sf, "judged"), cols=["ai_score", "ai_score_simple"])


@query("j02_attach_vectors", ["judged", "clustered"], """
SELECT j.orig_index, j.ai_score, c.embedding FROM judged j JOIN clustered c ON j.orig_index = c.orig_index""")
def j02_attach_vectors(spark, sf):
    return J.attach_vectors(view(spark, sf, "judged").select("orig_index", "ai_score"), view(spark, sf, "clustered"))


@query("j03_attach_totals", ["news"], f"""
WITH {SCORED_SQL},
c AS (SELECT year, lang, count(*) AS count FROM scored WHERE year IS NOT NULL GROUP BY 1, 2),
t AS (SELECT year, count(*) AS total FROM scored WHERE year IS NOT NULL GROUP BY 1)
SELECT c.year, c.lang, c.count, t.total, CAST(c.count AS DOUBLE) / t.total AS share
FROM c LEFT JOIN t ON c.year = t.year""")
def j03_attach_totals(spark, sf):
    s = _scored(spark, sf)
    counts = A.count_by(s, ["year", "lang"])
    totals = A.count_by(s, ["year"], out="total")
    return J.attach_totals(counts, totals)


@query("j04_prominence_join", ["news"], f"""
WITH {SCORED_SQL},
t AS (SELECT year, count(*) AS total_articles FROM scored WHERE year IS NOT NULL GROUP BY 1),
a AS (SELECT year, count(*) AS ai_articles FROM scored WHERE year IS NOT NULL AND keyword_score >= 2 GROUP BY 1)
SELECT coalesce(t.year, a.year) AS year, coalesce(t.total_articles, 0) AS total_articles,
       coalesce(a.ai_articles, 0) AS ai_articles,
       CASE WHEN coalesce(t.total_articles, 0) > 0 THEN CAST(coalesce(a.ai_articles, 0) AS DOUBLE) / t.total_articles
            ELSE 0.0 END AS ai_ratio
FROM t FULL OUTER JOIN a ON t.year = a.year""")
def j04_prominence_join(spark, sf):
    s = _scored(spark, sf)
    totals = A.count_by(s, ["year"], out="total_articles")
    flagged = A.count_by(s.filter(F.col("keyword_score") >= 2), ["year"], out="ai_articles")
    return J.prominence_join(totals, flagged, how="outer")


@query("j04b_prominence_inner", ["news"], f"""
WITH {SCORED_SQL},
t AS (SELECT year, count(*) AS total_articles FROM scored WHERE year IS NOT NULL GROUP BY 1),
a AS (SELECT year, count(*) AS ai_articles FROM scored WHERE year IS NOT NULL AND keyword_score >= 2 GROUP BY 1)
SELECT t.year, total_articles, ai_articles, CAST(ai_articles AS DOUBLE) / total_articles AS ai_ratio
FROM t JOIN a ON t.year = a.year""")
def j04b_prominence_inner(spark, sf):
    s = _scored(spark, sf)
    totals = A.count_by(s, ["year"], out="total_articles")
    flagged = A.count_by(s.filter(F.col("keyword_score") >= 2), ["year"], out="ai_articles")
    return J.prominence_join(totals, flagged)


@query("j05_todo_queue", ["news", "human_labels"], """
SELECT n.orig_index FROM news n ANTI JOIN human_labels h ON n.orig_index = h.orig_index""")
def j05_todo_queue(spark, sf):
    return J.todo_queue(view(spark, sf, "news"), view(spark, sf, "human_labels")).select("orig_index")


@query("j06_org_in_set", ["news"], f"""
WITH {ORGS_SQL},
ex AS (SELECT orig_index, unnest(organisations) AS organisation FROM orgs),
act AS (SELECT organisation, {S.actor_type_sql('organisation')} AS actor_type FROM (SELECT DISTINCT organisation FROM ex))
SELECT orig_index, organisation FROM ex WHERE organisation IN (SELECT organisation FROM act WHERE actor_type = 'Company')""")
def j06_org_in_set(spark, sf):
    ex = A.company_mentions(view(spark, sf, "news"))
    actors = TX.actor_type(ex.select("organisation").distinct())
    return J.org_in_set(ex, actors)


@query("j06b_org_in_types", ["news"], f"""
WITH {ORGS_SQL},
ex AS (SELECT orig_index, unnest(organisations) AS organisation FROM orgs)
SELECT orig_index, organisation FROM ex WHERE {S.actor_type_sql('organisation')} IN ('Company', 'Media')""")
def j06b_org_in_types(spark, sf):
    ex = A.company_mentions(view(spark, sf, "news"))
    actors = TX.actor_type(ex.select("organisation").distinct())
    return J.org_in_set(ex, actors, keep_type=["Company", "Media"])


LANG_NAMES = {"en": "English", "de": "German", "fr": "French"}


@query("j07_map_lookup", ["news"], """
SELECT orig_index, lang, coalesce(CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' END,
                                  'Other') AS lang_name FROM news""")
def j07_map_lookup(spark, sf):
    return J.map_lookup(view(spark, sf, "news").select("orig_index", "lang"), "lang", LANG_NAMES, "Other", "lang_name")


@query("j08_cluster_name_join", ["clustered", "news_vec"], """
WITH c AS (SELECT label AS cluster, lang, count(*) AS n FROM news_vec WHERE label IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2),
m AS (SELECT cluster, lang AS majority_label FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, lang ASC) AS rn FROM c) WHERE rn = 1)
SELECT cl.orig_index, cl.cluster, CASE WHEN cl.cluster = -1 THEN '-1' ELSE m.majority_label END AS cluster_name
FROM clustered cl LEFT JOIN m ON cl.cluster = m.cluster""")
def j08_cluster_name_join(spark, sf):
    names = A.majority_label(view(spark, sf, "news_vec").select(F.col("label").alias("cluster"), "lang"), "cluster", "lang")
    return J.cluster_name_join(view(spark, sf, "clustered").select("orig_index", "cluster"), names)


@query("j09_repr_label_join", ["clustered", "llm_out"], """
WITH lab AS (SELECT c.orig_index, c.cluster, l.ai_topic_llm AS raw_label
             FROM clustered c JOIN llm_out l ON c.orig_index = l.orig_index WHERE l.ai_topic_llm IS NOT NULL),
f AS (SELECT cluster, raw_label, count(*) AS f FROM lab GROUP BY 1, 2),
r AS (SELECT cluster, raw_label AS repr_label FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY f DESC, raw_label ASC) AS rn FROM f) WHERE rn = 1)
SELECT lab.orig_index, lab.cluster, lab.raw_label, CASE WHEN lab.cluster = -1 THEN 'other' ELSE r.repr_label END AS repr_label
FROM lab LEFT JOIN r ON lab.cluster = r.cluster""")
def j09_repr_label_join(spark, sf):
    from presslens.operators.windows import representative_label

    lab = view(spark, sf, "llm_out").filter(F.col("ai_topic_llm").isNotNull()) \
        .select("orig_index", F.col("ai_topic_llm").alias("raw_label"))
    d = view(spark, sf, "clustered").select("orig_index", "cluster").join(lab, "orig_index")
    return J.repr_label_join(d, representative_label(d))


@query("j10_score_dedupe_join", ["news", "shard_union"], """
SELECT n.orig_index, s.ai_relevance FROM news n LEFT JOIN (
  SELECT orig_index, avg(try_cast(ai_relevance_llm AS DOUBLE)) AS ai_relevance FROM shard_union GROUP BY 1) s
ON n.orig_index = s.orig_index""", rounded=["ai_relevance"])
def j10_score_dedupe_join(spark, sf):
    scores = view(spark, sf, "shard_union").select("orig_index",
                                                   P.to_number(F.col("ai_relevance_llm")).alias("ai_relevance"))
    return J.score_dedupe_join(view(spark, sf, "news").select("orig_index"), scores, value="ai_relevance")


@query("j11_rejoin_by_score", ["judged"], """
WITH s AS (SELECT orig_index, ai_score, ai_score_simple FROM judged WHERE is_ai_label),
k AS (SELECT ai_score, ai_score_simple, orig_index % 7 AS keyword_score FROM judged)
SELECT s.orig_index, s.ai_score, s.ai_score_simple, k.keyword_score FROM s
LEFT JOIN k ON s.ai_score = k.ai_score AND s.ai_score_simple = k.ai_score_simple""")
def j11_rejoin_by_score(spark, sf):
    j = view(spark, sf, "judged")
    samples = j.filter(F.col("is_ai_label")).select("orig_index", "ai_score", "ai_score_simple")
    scored = j.select("ai_score", "ai_score_simple", F.pmod(F.col("orig_index"), F.lit(7)).alias("keyword_score"))
    return J.rejoin_by_score(samples, scored)


@query("j12_nearest_prototype", ["news_vec", "protos"], f"""
WITH {EVENT_SQL}
SELECT orig_index, event_type FROM ev""")
def j12_nearest_prototype(spark, sf):
    d = V.nearest_prototype(view(spark, sf, "news_vec").select("orig_index", "embedding"), view(spark, sf, "protos"))
    return d.select("orig_index", "event_type")
