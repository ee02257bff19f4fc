"""Registered queries: the flagship yearly share (minimum slice and semantic form)."""

from __future__ import annotations

from presslens.plans import sqlgen as S
from presslens.plans import trends
from presslens.plans.registry import query
from presslens.sources.fixtures import view

KW = trends.FIXTURE_KEYWORDS
SCORED_SQL = f"""scored AS (
  SELECT *, {S.year_sql()} AS year, {S.keyword_score_sql('plain_text', KW)} AS keyword_score,
         {S.keyword_score_sql('plain_text', KW)} > 0 AS is_ai
  FROM news)"""


@query("a02_yearly_share", ["news"], f"""
WITH {SCORED_SQL}
SELECT year, count(*) AS total, count_if(is_ai) AS ai_count, CAST(count_if(is_ai) AS DOUBLE) / count(*) AS share
FROM scored WHERE year IS NOT NULL GROUP BY year""")
def a02_yearly_share(spark, sf):
    return trends.ai_share_by_year(view(spark, sf, "news"))


SEMANTIC_SQL = f"""q AS (SELECT embedding FROM protos WHERE name = 'event_0'),
sem AS (
  SELECT n.orig_index, any_value(n.published_date) AS published_date, any_value(n.plain_text) AS plain_text,
         avg({S.cosine_sql('n.embedding', 'q.embedding')}) AS ai_score
  FROM news_vec n, q GROUP BY n.orig_index)"""


@query("flagship_semantic_share_by_year", ["news_vec", "protos"], f"""
WITH {SEMANTIC_SQL}
SELECT year, count(*) AS total, count_if(is_ai) AS ai_count, CAST(count_if(is_ai) AS DOUBLE) / count(*) AS share
FROM (SELECT {S.year_sql()} AS year,
             coalesce(ai_score > 0 AND {S.keyword_score_sql('plain_text', KW)} > 0, FALSE) AS is_ai FROM sem)
WHERE year IS NOT NULL GROUP BY year""")
def flagship_semantic_share_by_year(spark, sf):
    return trends.semantic_share_by_year(view(spark, sf, "news_vec"), view(spark, sf, "protos"))
