"""The flagship plan: AI share of articles per year.

news -> year -> keyword score -> semantic score against the query phrases -> flag -> share by year.
One scan of the article table, one projection for all scores, one partial aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.operators import aggregates as A
from presslens.operators import clean as C
from presslens.operators import text as TX
from presslens.operators import vectors as V

# Keywords that occur in the driver's invented prose (one short, three long; see FIXTURES.md).
FIXTURE_KEYWORDS = ["ai", "license", "keit", "tion"]


def scored_news(news: DataFrame, keywords: Sequence[str] = FIXTURE_KEYWORDS) -> DataFrame:
    """Year, keyword score and keyword flag (``is_ai``) of every article."""
    out = C.with_year(news)
    out = TX.keyword_score(out, keywords)
    return C.flag_ai(out, rule="keyword")


def ai_share_by_year(news: DataFrame, keywords: Sequence[str] = FIXTURE_KEYWORDS) -> DataFrame:
    """Minimum slice: share of keyword-flagged articles per year."""
    return A.yearly_share(scored_news(news, keywords))


def semantic_share_by_year(news_vec: DataFrame, protos: DataFrame, query_name: str = "event_0",
                           keywords: Sequence[str] = FIXTURE_KEYWORDS) -> DataFrame:
    """Flagship: mean cosine to the query phrases > 0 and keyword score > 0, share per year."""
    queries = protos.filter(F.col("name") == query_name)
    out = C.with_year(news_vec)
    out = TX.keyword_score(out, keywords)
    out = V.semantic_score(out, queries)
    out = C.flag_ai(out, rule="both")
    return A.yearly_share(out)
