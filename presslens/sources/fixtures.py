"""Input views derived from the driver's tables.

The same SQL text is used twice: Spark registers it as temp views, and the
DuckDB oracle gets it as a ``WITH`` prefix.  The text therefore sticks to the
dialect both engines accept (see FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# view name -> (SQL text, views it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "news_raw": ("""
SELECT doc_id AS orig_index,
       CASE WHEN doc_id % 53 = 0 THEN NULL ELSE text END AS plain_text,
       substring(split_part(text, chr(10), 1), 1, 60) AS title,
       source AS publisher, concat(source, '.example') AS sitename,
       CASE WHEN doc_id % 97 = 0 THEN 'not a date'
            WHEN doc_id % 89 = 0 THEN '2015-06-01'
            ELSE CAST(DATE '2016-01-01' + CAST((doc_id * 37) % 3288 AS INT) AS STRING) END AS published_date,
       lang
FROM documents""", ("documents",)),
    "news": ("""
SELECT orig_index, coalesce(plain_text, '') AS plain_text, title, publisher, sitename, published_date, lang
FROM news_raw""", ("news_raw",)),
    "news_vec": ("""
SELECT n.orig_index, n.plain_text, n.title, n.publisher, n.sitename, n.published_date, n.lang, e.embedding, e.label
FROM (SELECT *, orig_index % (SELECT count(*) FROM embeddings) AS vec_no FROM news) n JOIN embeddings e ON e.vec_id = n.vec_no""",
                 ("news", "embeddings")),
    "protos": ("""
SELECT concat('event_', CAST(label AS STRING)) AS name, CAST(r - 1 AS INT) AS phrase_no, embedding
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS STRING)), vec_id) AS r FROM embeddings) e
WHERE r <= 3""", ("embeddings",)),
    "llm_raw": ("""
SELECT orig_index, CASE orig_index % 8
  WHEN 0 THEN concat_ws(chr(10), 'ja', CAST(orig_index % 101 AS STRING), 'AI policy', 'Regulation', 'Rules slow it.', 'Denmark, Germany', 'Aarhus', 'finance, Healthcare,finance', 'AI, ai', 'et  citat')
  WHEN 1 THEN concat_ws(chr(10), 'nej', '0', 'sports', 'none', 'none')
  WHEN 2 THEN ''
  WHEN 3 THEN concat_ws(chr(10), ' Ja ', '', '72.5', '', 'AI research', 'No barriers', 'text')
  WHEN 4 THEN concat_ws(chr(10), 'ja', 'high', 'automation')
  WHEN 5 THEN concat_ws(chr(10), 'nej', '250', 'economy', 'Costs', 'Too dear.')
  WHEN 6 THEN concat_ws(chr(10), 'maybe 7', '-5', 'ethics', 'No AI barrier', 'x')
  ELSE concat_ws(chr(10), 'ja', '88', 'AI safety', 'Trust', 'Low trust.', 'none', 'n/a', 'media', 'none', 'none') END AS answer
FROM news
UNION ALL
SELECT -1 - (conv_id * 1000 + turn) AS orig_index,
       CASE WHEN turn % 3 = 0 THEN text WHEN role = 'assistant' THEN concat('ja', chr(10), replace(text, '. ', chr(10)))
            ELSE concat('Nej', chr(10), CAST(length(text) AS STRING), chr(10), replace(text, ', ', chr(10))) END AS answer
FROM conversations""", ("news", "conversations")),
    "llm_out": ("""
SELECT orig_index,
  CASE orig_index % 7 WHEN 0 THEN '1' WHEN 1 THEN 'True' WHEN 2 THEN ' ja ' WHEN 3 THEN '0' WHEN 4 THEN 'nej' WHEN 5 THEN 'maybe' ELSE NULL END AS is_ai_llm,
  CASE WHEN orig_index % 11 = 0 THEN 'n/a' ELSE CAST((orig_index * 13) % 101 AS STRING) END AS ai_relevance_llm,
  CASE WHEN orig_index % 19 = 0 THEN 'None' WHEN orig_index % 23 = 0 THEN '' ELSE concat('topic ', CAST((orig_index * orig_index) % 9 AS STRING)) END AS ai_topic_llm,
  CASE WHEN orig_index % 3 = 0 THEN 'yes' WHEN orig_index % 3 = 1 THEN 'no' ELSE NULL END AS ai_barrier_llm,
  CASE WHEN orig_index % 4 = 0 THEN 'none' ELSE concat(' Barrier ', CAST((orig_index * 7) % 6 AS STRING)) END AS ai_barrier_type_llm,
  CASE orig_index % 5 WHEN 0 THEN 'finance, media' WHEN 1 THEN 'Finance,aarhus' WHEN 2 THEN 'none' WHEN 3 THEN NULL ELSE 'IT/software, media,media' END AS industries_llm,
  CAST(orig_index % 4 AS INT) AS src_priority
FROM news""", ("news",)),
    "shard_union": ("""
SELECT * FROM llm_out
UNION ALL
SELECT orig_index, 'ja' AS is_ai_llm, '99' AS ai_relevance_llm, 'late' AS ai_topic_llm, 'no' AS ai_barrier_llm, 'none' AS ai_barrier_type_llm, NULL AS industries_llm, 9 AS src_priority
FROM llm_out WHERE orig_index % 10 = 3""", ("llm_out",)),
    "clustered": ("""
SELECT orig_index, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster, embedding FROM news_vec""",
                  ("news_vec",)),
    "human_labels": ("""
SELECT doc_id AS orig_index, quality AS human_is_ai, 'other' AS human_topic, toxic AS human_has_barrier, 'none' AS human_barrier_type, '' AS notes, CAST(0 AS BIGINT) AS ts FROM labels""",
                     ("labels",)),
    "judged": ("""
SELECT doc_id AS orig_index, CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000 - 0.5 AS ai_score,
       CAST((doc_id * 104729) % 50 AS DOUBLE) / 50 - 0.5 AS ai_score_simple, quality = 1 AS is_ai_label FROM labels""",
               ("labels",)),
    "lexicon": ("""
SELECT * FROM (VALUES ('the', CAST(0.5 AS DOUBLE)), ('that', CAST(-0.8 AS DOUBLE)), ('keit', CAST(1.5 AS DOUBLE)), ('tion', CAST(-1.2 AS DOUBLE))) AS t(word, polarity)""",
                ()),
}


def _closure(names) -> list[str]:
    """Views in dependency order (base tables left out)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order or n not in VIEWS:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    return order


def base_tables_of(names) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in BASE_TABLES:
            if n not in seen:
                seen.append(n)
            return
        for dep in VIEWS[n][1]:
            visit(dep)

    for n in names:
        visit(n)
    return seen


def register(spark: SparkSession, sf_dir: str, names) -> None:
    """Register base tables and the named views (with their dependencies)."""
    for t in base_tables_of(names):
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet").createOrReplaceTempView(t)
    for n in names:
        if n in BASE_TABLES and n not in VIEWS:
            spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet").createOrReplaceTempView(n)
    for v in _closure(names):
        spark.sql(VIEWS[v][0]).createOrReplaceTempView(v)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view (or base table) as a DataFrame."""
    register(spark, sf_dir, [name])
    return spark.table(name)


def with_views(sql: str, names) -> str:
    """Prefix ``sql`` with the named views (and dependencies) as CTEs."""
    order = _closure(names)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEWS[v][0].strip()})" for v in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
