"""Registered queries: aggregations A01-A43 (A42 lives with the cluster profile)."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslens.functions import parse as P
from presslens.functions import text as T
from presslens.operators import aggregates as A
from presslens.operators import clean as C
from presslens.operators import text as TX
from presslens.operators import vectors as V
from presslens.plans import sqlgen as S
from presslens.plans.q_trends import SCORED_SQL
from presslens.plans.registry import query
from presslens.plans.trends import scored_news
from presslens.sources.fixtures import view

COMPANY_WORDS = ["Apache", "License"]
LANGS = ["de", "en", "es", "fr", "xx"]
YEARS = list(range(2015, 2025))


def _scored(spark, sf):
    return scored_news(view(spark, sf, "news"))


def _companies(spark, sf):
    return TX.companies(_scored(spark, sf), COMPANY_WORDS)


COMPANIES_SQL = f"""{SCORED_SQL},
comp AS (SELECT *, {S.companies_sql('plain_text', COMPANY_WORDS)} AS company FROM scored)"""


@query("a01_flag_trend", ["news"], f"""
WITH {SCORED_SQL}
SELECT year, count_if(is_ai) AS n_flagged FROM scored WHERE year IS NOT NULL GROUP BY year""")
def a01_flag_trend(spark, sf):
    return A.flag_trend(_scored(spark, sf))


@query("a03_publisher_share", ["news"], f"""
WITH {SCORED_SQL}
SELECT * FROM (
  SELECT publisher, count(*) AS total, count_if(is_ai) AS ai_count,
         CAST(count_if(is_ai) AS DOUBLE) / count(*) AS share
  FROM scored WHERE publisher IS NOT NULL GROUP BY publisher)
WHERE total >= 40 ORDER BY share DESC, publisher ASC LIMIT 10""")
def a03_publisher_share(spark, sf):
    return A.publisher_share(_scored(spark, sf), min_articles=40, top=10)


@query("a04_publisher_year_share", ["news"], f"""
WITH {SCORED_SQL},
per AS (SELECT publisher, year, count(title) AS total_articles, count_if(is_ai) AS ai_articles
        FROM scored WHERE publisher IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2),
pub AS (SELECT publisher FROM scored WHERE publisher IS NOT NULL GROUP BY 1 HAVING count(*) >= 50)
SELECT per.*, CASE WHEN total_articles = 0 THEN NULL ELSE CAST(ai_articles AS DOUBLE) / total_articles END AS ai_ratio
FROM per WHERE publisher IN (SELECT publisher FROM pub)""")
def a04_publisher_year_share(spark, sf):
    return A.publisher_year_share(_scored(spark, sf), min_total=50)


@query("a05_category_share", ["news"], f"""
WITH {SCORED_SQL}
SELECT year, lang, n, CAST(n AS DOUBLE) * 100 / sum(n) OVER (PARTITION BY year) AS pct
FROM (SELECT year, lang, count(*) AS n FROM scored WHERE year IS NOT NULL GROUP BY 1, 2)""", rounded=["pct"])
def a05_category_share(spark, sf):
    return A.category_share(_scored(spark, sf), ["year", "lang"])


@query("a06_value_counts", ["llm_out"], """
SELECT ai_topic_llm, count(*) AS count FROM llm_out WHERE ai_topic_llm IS NOT NULL GROUP BY 1""")
def a06_value_counts(spark, sf):
    return A.value_counts(view(spark, sf, "llm_out"), "ai_topic_llm")


@query("a06b_value_counts_keep_null", ["llm_out"], f"""
SELECT barrier_flag, count(*) AS count FROM (SELECT {S.to_bool_sql('ai_barrier_llm')} AS barrier_flag FROM llm_out)
GROUP BY 1""")
def a06b_value_counts_keep_null(spark, sf):
    d = view(spark, sf, "llm_out").select(P.to_bool(F.col("ai_barrier_llm")).alias("barrier_flag"))
    return A.value_counts(d, "barrier_flag", dropna=False)


@query("a07_count_by", ["news"], f"""
WITH {SCORED_SQL}
SELECT publisher, year, count(*) AS count FROM scored WHERE publisher IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2""")
def a07_count_by(spark, sf):
    return A.count_by(_scored(spark, sf), ["publisher", "year"])


_MISSING_COLS = ["orig_index", "plain_text", "title", "publisher", "sitename", "published_date", "lang", "year"]


@query("a08_missing_ratio", ["news_raw"], f"""
WITH nr AS (SELECT *, {S.year_sql()} AS year FROM news_raw)
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, avg(CAST({c} IS NULL AS DOUBLE)) AS missing_ratio, count_if({c} IS NULL) AS n_missing "
    f"FROM nr" for c in _MISSING_COLS), rounded=["missing_ratio"])
def a08_missing_ratio(spark, sf):
    from presslens.operators.clean import with_year

    return A.missing_ratio(with_year(view(spark, sf, "news_raw")), _MISSING_COLS)


_DESC = ["keyword_score", "text_len"]


@query("a09_describe", ["news"], f"""
WITH {SCORED_SQL}, d AS (SELECT keyword_score, length(plain_text) AS text_len FROM scored)
""" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column, s AS statistic, v AS value FROM (
  SELECT unnest(['count', 'mean', 'std', 'min', 'max', '25%', '50%', '75%']) AS s,
         unnest([CAST(count({c}) AS DOUBLE), avg({c}), stddev_samp({c}), min({c}), max({c}),
                 quantile_cont({c}, 0.25), quantile_cont({c}, 0.5), quantile_cont({c}, 0.75)]) AS v FROM d)"""
    for c in _DESC), rounded=["value"])
def a09_describe(spark, sf):
    d = _scored(spark, sf).select("keyword_score", F.length("plain_text").alias("text_len"))
    return A.describe(d, _DESC)


_TEXTS = ["title", "publisher", "lang"]


@query("a09b_describe_text", ["news"], "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column, CAST(sum(n) AS BIGINT) AS count, count(*) AS distinct, arg_min(v, struct_pack(a := -n, b := v)) AS top,
       max(n) AS freq FROM (SELECT {c} AS v, count(*) AS n FROM news WHERE {c} IS NOT NULL GROUP BY 1)""" for c in _TEXTS))
def a09b_describe_text(spark, sf):
    return A.describe_text(view(spark, sf, "news"), _TEXTS)


@query("a10_dup_ratio", ["news"], """
WITH k AS (SELECT title, publisher, count(*) AS n FROM news GROUP BY 1, 2),
p AS (SELECT publisher, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicated_count,
             CAST(sum(n) AS BIGINT) AS total_count FROM k WHERE publisher IS NOT NULL GROUP BY 1)
SELECT *, CAST(duplicated_count AS DOUBLE) / total_count AS duplicated_ratio FROM p WHERE duplicated_count > 0""")
def a10_dup_ratio(spark, sf):
    return A.dup_ratio(view(spark, sf, "news"))


@query("a11_company_combo_counts", ["news"], f"""
WITH {COMPANIES_SQL}
SELECT company, count(*) AS count FROM comp WHERE is_ai AND company <> '' GROUP BY 1""")
def a11_company_combo_counts(spark, sf):
    return A.company_combo_counts(_companies(spark, sf))


@query("a12_company_counts", ["news"], f"""
WITH {COMPANIES_SQL}
SELECT company, count(*) AS count FROM (SELECT unnest(string_split(company, ', ')) AS company FROM comp WHERE is_ai)
WHERE company <> '' GROUP BY 1""")
def a12_company_counts(spark, sf):
    return A.company_counts(_companies(spark, sf))


@query("a13_company_year", ["news"], f"""
WITH {COMPANIES_SQL}
SELECT company, year, count(*) AS count FROM (
  SELECT year, unnest(string_split(company, ', ')) AS company FROM comp WHERE is_ai)
WHERE company <> '' AND year IS NOT NULL GROUP BY 1, 2""")
def a13_company_year(spark, sf):
    return A.company_year(_companies(spark, sf))


ORGS_SQL = f"orgs AS (SELECT orig_index, {S.organisations_sql('plain_text')} AS organisations FROM news)"


def _orgs(spark, sf):
    return A.company_mentions(view(spark, sf, "news"))


@query("a14_distinct_entities", ["news"], f"""
WITH {ORGS_SQL}
SELECT count(DISTINCT e) AS n_distinct FROM (SELECT unnest(organisations) AS e FROM orgs)""")
def a14_distinct_entities(spark, sf):
    return A.distinct_entities(_orgs(spark, sf))


@query("a15_entity_counts", ["news"], f"""
WITH {ORGS_SQL}
SELECT organisation, count(*) AS count FROM (SELECT unnest(organisations) AS organisation FROM orgs)
GROUP BY 1 ORDER BY count DESC, organisation ASC LIMIT 30""")
def a15_entity_counts(spark, sf):
    return A.entity_counts(_orgs(spark, sf), top=30)


@query("a16_actor_table", ["news"], f"""
WITH {ORGS_SQL},
c AS (SELECT organisation, count(*) AS count FROM (SELECT unnest(organisations) AS organisation FROM orgs)
      GROUP BY 1 ORDER BY count DESC, organisation ASC LIMIT 30)
SELECT organisation, count, {S.actor_type_sql('organisation')} AS actor_type FROM c""")
def a16_actor_table(spark, sf):
    return A.actor_table(_orgs(spark, sf), top=30)


@query("a17_majority_label", ["news_vec"], """
WITH c AS (SELECT label AS cluster, lang, count(*) AS n FROM news_vec
           WHERE label IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2)
SELECT cluster, lang AS majority_label, n AS majority_count, size, CAST(n AS DOUBLE) / size AS majority_share FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, lang ASC) AS rn,
         CAST(sum(n) OVER (PARTITION BY cluster) AS BIGINT) AS size FROM c) WHERE rn = 1""")
def a17_majority_label(spark, sf):
    d = view(spark, sf, "news_vec").select(F.col("label").alias("cluster"), "lang")
    return A.majority_label(d, "cluster", "lang")


@query("a18_cluster_centers", ["clustered"], """
SELECT cluster, avg(embedding[1]) AS x_mean, avg(embedding[2]) AS y_mean, count(*) AS size FROM clustered GROUP BY 1""",
       rounded=["x_mean", "y_mean"])
def a18_cluster_centers(spark, sf):
    d = view(spark, sf, "clustered").select("cluster", F.col("embedding")[0].cast("double").alias("x"),
                                            F.col("embedding")[1].cast("double").alias("y"))
    return A.cluster_centers(d)


@query("a19_cluster_sizes", ["clustered"], """
SELECT * FROM (SELECT cluster, count(*) AS size FROM clustered GROUP BY 1 ORDER BY size ASC, cluster ASC LIMIT 3)""")
def a19_cluster_sizes(spark, sf):
    return A.cluster_sizes(view(spark, sf, "clustered"), n=3, largest=False)


CLUSTER_SCORE_SQL = f"""{SCORED_SQL},
cs AS (SELECT c.orig_index, c.cluster, s.keyword_score FROM clustered c JOIN scored s ON c.orig_index = s.orig_index)"""


def _cluster_scores(spark, sf):
    cl = view(spark, sf, "clustered").select("orig_index", "cluster")
    return cl.join(_scored(spark, sf).select("orig_index", "keyword_score"), "orig_index")


@query("a20_cluster_mean", ["news", "clustered"], f"""
WITH {CLUSTER_SCORE_SQL}
SELECT cluster, avg(keyword_score) AS mean_keyword_score, count(*) AS size FROM cs GROUP BY 1""",
       rounded=["mean_keyword_score"])
def a20_cluster_mean(spark, sf):
    return A.cluster_mean(_cluster_scores(spark, sf), "keyword_score")


@query("a21_clusters_above", ["news", "clustered"], f"""
WITH {CLUSTER_SCORE_SQL}
SELECT orig_index, cluster FROM cs WHERE cluster IN (SELECT cluster FROM cs GROUP BY 1 HAVING avg(keyword_score) > 0.99)""")
def a21_clusters_above(spark, sf):
    return A.clusters_above(_cluster_scores(spark, sf), "keyword_score", 0.99).select("orig_index", "cluster")


@query("a22_topic_mix", ["news_vec", "llm_out"], """
WITH d AS (SELECT n.label, l.ai_topic_llm FROM news_vec n JOIN llm_out l ON n.orig_index = l.orig_index),
s AS (SELECT label, count(*) AS size FROM d GROUP BY 1),
p AS (SELECT label FROM (SELECT label, row_number() OVER (ORDER BY size DESC, label ASC NULLS LAST) AS r FROM s) WHERE r = 2),
c AS (SELECT label, coalesce(ai_topic_llm, 'NA') AS ai_topic_llm, count(*) AS count FROM d
      WHERE label IS NOT DISTINCT FROM (SELECT label FROM p) GROUP BY 1, 2)
SELECT label, ai_topic_llm, count, CAST(count AS DOUBLE) * 1.0 / sum(count) OVER (PARTITION BY label) AS share FROM c""",
       rounded=["share"])
def a22_topic_mix(spark, sf):
    d = view(spark, sf, "news_vec").select("orig_index", "label") \
        .join(view(spark, sf, "llm_out").select("orig_index", "ai_topic_llm"), "orig_index")
    return A.topic_mix(d, "label", "ai_topic_llm", rank=2)


@query("a23_contains_count", ["llm_out"], """
SELECT count_if(coalesce(contains(lower(ai_topic_llm), 'topic 1'), FALSE)) AS n_contains FROM llm_out""")
def a23_contains_count(spark, sf):
    return A.contains_count(view(spark, sf, "llm_out"), "ai_topic_llm", "Topic 1")


@query("a24_crosstab", ["news"], f"""
WITH {SCORED_SQL}
SELECT lang, {', '.join(f'count_if(year = {y}) AS "{y}"' for y in YEARS)}
FROM scored WHERE lang IS NOT NULL AND year IS NOT NULL GROUP BY lang""")
def a24_crosstab(spark, sf):
    return A.crosstab(_scored(spark, sf), "lang", "year", YEARS)


PIVOT_SQL = f"""{SCORED_SQL},
pv AS (SELECT year, {', '.join(f"count_if(lang = '{lg}') AS {lg}" for lg in LANGS)}
       FROM scored WHERE year IS NOT NULL GROUP BY year)"""


def _pivot(spark, sf):
    return A.pivot_counts(_scored(spark, sf), "year", "lang", LANGS)


@query("a25_pivot_counts", ["news"], f"WITH {PIVOT_SQL} SELECT * FROM pv")
def a25_pivot_counts(spark, sf):
    return _pivot(spark, sf)


@query("a25b_pivot_top", ["llm_out", "news"], f"""
WITH d AS (SELECT {S.year_sql('n.published_date')} AS year, l.ai_topic_llm
           FROM llm_out l JOIN news n ON l.orig_index = n.orig_index
           WHERE coalesce({S.to_bool_sql('l.is_ai_llm')}, FALSE)),
f AS (SELECT * FROM d WHERE year IS NOT NULL AND ai_topic_llm IS NOT NULL),
t AS (SELECT ai_topic_llm FROM f GROUP BY 1 ORDER BY count(*) DESC, ai_topic_llm LIMIT 4)
SELECT y.year, t.ai_topic_llm, count(f.year) AS n
FROM (SELECT DISTINCT year FROM f WHERE ai_topic_llm IN (SELECT ai_topic_llm FROM t)) y CROSS JOIN t
LEFT JOIN f ON f.year = y.year AND f.ai_topic_llm = t.ai_topic_llm GROUP BY 1, 2""")
def a25b_pivot_top(spark, sf):
    from presslens.operators.clean import with_year

    lab = view(spark, sf, "llm_out").select("orig_index", "ai_topic_llm", P.to_bool(F.col("is_ai_llm")).alias("is_ai"))
    d = with_year(view(spark, sf, "news")).select("orig_index", "year").join(lab, "orig_index")
    return A.top_counts(d, "year", "ai_topic_llm", 4, where=F.coalesce(F.col("is_ai"), F.lit(False)))


@query("a26_unpivot", ["news"], f"WITH {PIVOT_SQL}\n" + "\nUNION ALL\n".join(
    f"SELECT year, '{lg}' AS variable, {lg} AS value FROM pv" for lg in LANGS))
def a26_unpivot(spark, sf):
    return A.unpivot(_pivot(spark, sf), ["year"], LANGS)


@query("a27_row_pct", ["news"], f"""
WITH {PIVOT_SQL}
SELECT year, {', '.join(f"CAST({lg} AS DOUBLE) * 100 / ({' + '.join(LANGS)}) AS {lg}" for lg in LANGS)} FROM pv""",
       rounded=LANGS)
def a27_row_pct(spark, sf):
    return A.row_pct(_pivot(spark, sf), ["year"], LANGS)


_BARRIER_CASE = " ".join(f"WHEN {S.lit(k)} THEN {S.lit(v)}" for k, (_, v) in {
    "barrier 1": (1, "barrier one"), "barrier 2": (2, "barrier two"), "barrier 4": (4, "barrier four")}.items())
_NB_INNER = "coalesce(CAST(ai_barrier_type_llm AS VARCHAR), 'nan')"
_NB = f"lower({S.strip_sql(_NB_INNER)})"


def _text_label_sql(c: str) -> str:
    t = f"CASE WHEN {c} IS NULL THEN 'nan' ELSE {S.strip_sql(f'CAST({c} AS VARCHAR)')} END"
    return f"CASE WHEN ({t}) = '' THEN 'unknown' ELSE ({t}) END"


@query("a28_topic_barrier_matrix", ["llm_out"], f"""
WITH m AS (SELECT ai_topic_llm,
  CASE WHEN {_NB} = 'none' THEN 'none'
       ELSE coalesce(CASE {_NB} {_BARRIER_CASE} END, 'other') END AS barrier_cluster_label FROM llm_out),
src AS (SELECT {_text_label_sql('ai_topic_llm')} AS topic, {_text_label_sql('barrier_cluster_label')} AS barrier FROM m),
f AS (SELECT * FROM src WHERE barrier NOT IN ('other', 'none', 'unknown') AND topic NOT IN ('unknown')),
tt AS (SELECT topic FROM f GROUP BY 1 ORDER BY count(*) DESC, topic LIMIT 8),
tb AS (SELECT barrier FROM f GROUP BY 1 ORDER BY count(*) DESC, barrier LIMIT 2),
c AS (SELECT topic, barrier, count(*) AS n FROM f WHERE topic IN (SELECT topic FROM tt)
      AND barrier IN (SELECT barrier FROM tb) GROUP BY 1, 2),
g AS (SELECT tt.topic, tb.barrier, CAST(coalesce(c.n, 0) AS BIGINT) AS n_articles FROM tt CROSS JOIN tb
      LEFT JOIN c ON tt.topic = c.topic AND tb.barrier = c.barrier)
SELECT *, CASE WHEN sum(n_articles) OVER (PARTITION BY topic) = 0 THEN NULL
               ELSE n_articles * 100.0 / sum(n_articles) OVER (PARTITION BY topic) END AS row_pct FROM g""",
       rounded=["row_pct"])
def a28_topic_barrier_matrix(spark, sf):
    from presslens.operators.labelling import barrier_label_mapping
    from presslens.plans.q_labels import BARRIER_MAP

    m = barrier_label_mapping(view(spark, sf, "llm_out"), "ai_barrier_type_llm", BARRIER_MAP)
    return A.topic_barrier_matrix(m, top_topics=8, top_barriers=2)


@query("a29_corr", ["news"], f"""
WITH {SCORED_SQL}, d AS (SELECT CAST(keyword_score AS DOUBLE) AS keyword_score, CAST(is_ai AS DOUBLE) AS is_ai,
                               CAST(length(plain_text) AS DOUBLE) AS text_len FROM scored)
SELECT 'keyword_score' AS x, 'is_ai' AS y, corr(keyword_score, is_ai) AS corr FROM d
UNION ALL SELECT 'keyword_score', 'text_len', corr(keyword_score, text_len) FROM d
UNION ALL SELECT 'is_ai', 'text_len', corr(is_ai, text_len) FROM d""", rounded=["corr"])
def a29_corr(spark, sf):
    d = _scored(spark, sf).withColumn("text_len", F.length("plain_text"))
    return A.corr(d, ["keyword_score", "is_ai", "text_len"])


@query("a30_histogram", ["news"], f"""
WITH {SCORED_SQL}, {S.histogram_sql('scored', 'keyword_score', 30)}""", rounded=["bin_lo", "bin_hi"])
def a30_histogram(spark, sf):
    return A.histogram(_scored(spark, sf), "keyword_score", 30)


GRID = [0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0]


@query("a31_density", ["news"], f"""
WITH {SCORED_SQL},
src AS (SELECT CAST(keyword_score AS DOUBLE) AS x FROM scored WHERE keyword_score IS NOT NULL),
st AS (SELECT count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS bw FROM src),
g AS (SELECT * FROM (VALUES {', '.join(f'({i}, {v})' for i, v in enumerate(GRID))}) AS t(grid_index, gx))
SELECT g.grid_index, CAST(g.gx AS DOUBLE) AS x,
       sum(exp(-pow((g.gx - src.x) / st.bw, 2) / 2)) / (st.n * st.bw * sqrt(2 * pi())) AS density
FROM g, src, st GROUP BY g.grid_index, g.gx, st.n, st.bw""", rounded=["density"])
def a31_density(spark, sf):
    return A.density(_scored(spark, sf), "keyword_score", GRID)


@query("a32_minmax", ["judged"], """
SELECT orig_index, (ai_score - mn) / (mx - mn + 1e-10) AS ai_score_norm
FROM judged, (SELECT min(ai_score) AS mn, max(ai_score) AS mx FROM judged)""", rounded=["ai_score_norm"])
def a32_minmax(spark, sf):
    return A.minmax(view(spark, sf, "judged"), "ai_score").select("orig_index", "ai_score_norm")


@query("a33_score_means", ["judged"], """
SELECT avg(ai_score) AS mean_ai_score, avg(ai_score_simple) AS mean_ai_score_simple FROM judged WHERE is_ai_label""",
       rounded=["mean_ai_score", "mean_ai_score_simple"])
def a33_score_means(spark, sf):
    return A.score_means(view(spark, sf, "judged"), ["ai_score", "ai_score_simple"], F.col("is_ai_label"))


@query("a34_industry_weighted_mean", ["llm_out", "judged"], f"""
WITH j AS (SELECT l.orig_index, try_cast(l.ai_relevance_llm AS DOUBLE) * j.ai_score AS p, l.industries_llm
           FROM llm_out l JOIN judged j ON l.orig_index = j.orig_index),
e AS (SELECT orig_index, p, unnest(list_distinct(list_filter(
        list_transform(CASE WHEN industries_llm IS NULL OR industries_llm = 'none' THEN []::VARCHAR[]
                            ELSE string_split(industries_llm, ',') END, lambda s: lower({S.strip_sql('s')})),
        lambda s: s <> ''))) AS industry FROM j)
SELECT industry, avg(p) AS weighted_mean, count(*) AS n FROM e WHERE p IS NOT NULL AND NOT isnan(p)
GROUP BY 1 ORDER BY weighted_mean DESC, industry LIMIT 20""", rounded=["weighted_mean"])
def a34_industry_weighted_mean(spark, sf):
    d = view(spark, sf, "llm_out").join(view(spark, sf, "judged").select("orig_index", "ai_score"), "orig_index")
    return A.industry_weighted_mean(d)


@query("a35_text_length_stats", ["news_raw"], f"""
WITH ln AS (SELECT length(plain_text) AS text_len FROM news_raw), {S.histogram_sql('ln', 'text_len', 50)}""",
       rounded=["bin_lo", "bin_hi"])
def a35_text_length_stats(spark, sf):
    return A.text_length_stats(view(spark, sf, "news_raw"))


STOP = ["the", "and", "that"]


@query("a36_word_counts", ["news"], f"""
SELECT word, count(*) AS count FROM (
  SELECT unnest(regexp_extract_all(lower(coalesce(plain_text, '')), '[\\p{{L}}\\p{{N}}_]+', 0)) AS word FROM news)
WHERE regexp_matches(word, '^[a-z]{{3,}}$') AND word NOT IN ('the', 'and', 'that')
GROUP BY 1 ORDER BY count DESC, word LIMIT 20""")
def a36_word_counts(spark, sf):
    return A.word_counts(view(spark, sf, "news"), stop=STOP, top=20)


@query("a36b_word_counts_unicode", ["news"], f"""
SELECT word, count(*) AS count FROM (
  SELECT unnest(regexp_extract_all(lower(coalesce(plain_text, '')), '[\\p{{L}}\\p{{N}}_]+', 0)) AS word FROM news)
WHERE regexp_matches(word, '^[\\p{{L}}_]{{3,}}$') AND word NOT IN ('the', 'and', 'that')
GROUP BY 1 ORDER BY count DESC, word LIMIT 50""")
def a36b_word_counts_unicode(spark, sf):
    # letters of any script (and '_'), at least 3, no digits: the vectorizer rule of the topic words
    return A.word_counts(view(spark, sf, "news"), stop=STOP, top=50, keep_pattern=r"^[\p{L}_]{3,}$")


@query("a36c_grouped_word_counts", ["news"], f"""
WITH c AS (SELECT publisher, word, count(*) AS count FROM (
  SELECT publisher, unnest(regexp_extract_all(lower(coalesce(plain_text, '')), '[\\p{{L}}\\p{{N}}_]+', 0)) AS word FROM news WHERE publisher IS NOT NULL)
  WHERE regexp_matches(word, '^[a-z]{{3,}}$') AND word NOT IN ('the', 'and', 'that') GROUP BY 1, 2),
v AS (SELECT word FROM c GROUP BY word ORDER BY sum(count) DESC, word LIMIT 30)
SELECT publisher, word, count FROM c WHERE word IN (SELECT word FROM v)
QUALIFY row_number() OVER (PARTITION BY publisher ORDER BY count DESC, word) <= 10""")
def a36c_grouped_word_counts(spark, sf):
    return A.grouped_word_counts(view(spark, sf, "news"), "publisher", stop=STOP, top=10, vocab=30)


@query("a36d_frequent_word_counts", ["news"], f"""
SELECT word, count(*) AS count FROM (
  SELECT unnest(regexp_extract_all(lower(coalesce(plain_text, '')), '[\\p{{L}}\\p{{N}}_]+', 0)) AS word FROM news)
WHERE regexp_matches(word, '^[a-z]{{3,}}$') AND word NOT IN ('the', 'and', 'that')
GROUP BY 1 ORDER BY count DESC, word LIMIT 20""")
def a36d_frequent_word_counts(spark, sf):
    return A.frequent_word_counts(view(spark, sf, "news"), stop=STOP, top=20)


KW_WORDS = ["the", "and", "der", "und", "les", "des", "license", "de", "la", "el"]


@query("a37_keyword_word_counts", ["news"], f"""
WITH {SCORED_SQL},
t AS (SELECT word, count(*) AS count FROM (
        SELECT unnest(list_filter(regexp_split_to_array(lower(coalesce(plain_text, '')), '{S.BLANK}+'), lambda w: w <> ''))
               AS word FROM scored WHERE is_ai)
      GROUP BY 1 ORDER BY count DESC, word LIMIT 30)
SELECT * FROM t WHERE word IN ({', '.join(S.lit(w) for w in KW_WORDS)})""")
def a37_keyword_word_counts(spark, sf):
    return A.keyword_word_counts(_scored(spark, sf), KW_WORDS, flag="is_ai", top=30)


@query("a38_one_hot_sums", ["llm_out"], f"""
SELECT value, count(DISTINCT orig_index) AS n_articles FROM (
  SELECT orig_index, unnest(list_filter(list_transform(string_split(industries_llm, ','),
                                                       lambda s: lower({S.strip_sql('s')})),
                                        lambda s: s <> '' AND s <> 'none')) AS value FROM llm_out)
GROUP BY 1 ORDER BY n_articles DESC, value LIMIT 10""")
def a38_one_hot_sums(spark, sf):
    return A.one_hot_sums(view(spark, sf, "llm_out"))


SENTIMENT_SQL = f"""{SCORED_SQL},
tok AS (SELECT orig_index, unnest(regexp_extract_all(lower(coalesce(plain_text, '')), '[\\p{{L}}\\p{{N}}_]+', 0)) AS word
        FROM scored),
sums AS (SELECT tok.orig_index, sum(coalesce(l.polarity, 0)) AS s FROM tok LEFT JOIN lexicon l ON tok.word = l.word
         GROUP BY 1),
sent AS (SELECT sc.*, CASE WHEN length(sc.plain_text) >= 50 THEN coalesce(sums.s, 0) / sqrt(coalesce(sums.s, 0) * coalesce(sums.s, 0) + 15) END
                AS sentiment
         FROM scored sc LEFT JOIN sums ON sc.orig_index = sums.orig_index),
lab AS (SELECT *, CASE WHEN sentiment > 0.05 THEN 'Positive' WHEN sentiment < -0.05 THEN 'Negative' ELSE 'Neutral' END
               AS sentiment_label FROM sent)"""


def _sentiment(spark, sf):
    s = TX.sentiment_score(_scored(spark, sf), view(spark, sf, "lexicon"))
    return TX.sentiment_label(s)


@query("a39_sentiment_by_year", ["news", "lexicon"], f"""
WITH {SENTIMENT_SQL}
SELECT year, count_if(sentiment_label = 'Negative') AS Negative, count_if(sentiment_label = 'Neutral') AS Neutral,
       count_if(sentiment_label = 'Positive') AS Positive FROM lab WHERE year IS NOT NULL GROUP BY year""")
def a39_sentiment_by_year(spark, sf):
    return A.sentiment_by_year(_sentiment(spark, sf))


@query("a40_flag_by_year", ["news"], f"""
WITH {SCORED_SQL}
SELECT year, count(*) AS count FROM scored WHERE is_ai AND year IS NOT NULL GROUP BY year""")
def a40_flag_by_year(spark, sf):
    return A.flag_by_year(_scored(spark, sf), "is_ai")


BARRIERS = [*T.BARRIER_KEYWORDS, "license", "keit"]  # the study's list and two words of the given prose


@query("a40b_barrier_by_year", ["news"], f"""
SELECT {S.year_sql()} AS year, count(*) AS count FROM news
WHERE regexp_matches(lower(plain_text), {S.lit(T.alternation(BARRIERS))}) AND {S.year_sql()} IS NOT NULL GROUP BY 1""")
def a40b_barrier_by_year(spark, sf):
    flagged = TX.regex_flag(C.with_year(view(spark, sf, "news")), BARRIERS, out="has_barrier")
    return A.flag_by_year(flagged, "has_barrier")


EVENT_SQL = f"""p AS (SELECT name, phrase_no, embedding, row_number() OVER (ORDER BY name, phrase_no) AS pos FROM protos),
ev AS (SELECT orig_index, publisher, name AS event_type FROM (
  SELECT n.orig_index, n.publisher, p.name,
         row_number() OVER (PARTITION BY n.orig_index ORDER BY {S.cosine_sql('n.embedding', 'p.embedding')} DESC, p.pos)
           AS rn
  FROM news_vec n, p) WHERE rn = 1)"""


@query("a41_publisher_event", ["news_vec", "protos"], f"""
WITH {EVENT_SQL}
SELECT publisher, event_type, count(*) AS count FROM ev WHERE publisher IS NOT NULL GROUP BY 1, 2""")
def a41_publisher_event(spark, sf):
    d = V.classify_by_prototype(view(spark, sf, "news_vec"), view(spark, sf, "protos"))
    return A.publisher_event(d)


@query("a43_flag_total", ["news"], f"""
WITH {SCORED_SQL}
SELECT count_if(coalesce(is_ai, FALSE)) AS n_true, count(*) AS n_rows FROM scored""")
def a43_flag_total(spark, sf):
    return A.flag_total(_scored(spark, sf), F.col("is_ai"))


@query("a02b_yearly_share_llm", ["llm_out", "news"], f"""
SELECT {S.year_sql('n.published_date')} AS year, count(*) AS total,
       count_if(coalesce({S.to_bool_sql('l.is_ai_llm')}, FALSE)) AS ai_count,
       CAST(count_if(coalesce({S.to_bool_sql('l.is_ai_llm')}, FALSE)) AS DOUBLE) / count(*) AS share
FROM llm_out l JOIN news n ON l.orig_index = n.orig_index
WHERE {S.year_sql('n.published_date')} IS NOT NULL GROUP BY 1""")
def a02b_yearly_share_llm(spark, sf):
    from presslens.operators.clean import with_year

    lab = view(spark, sf, "llm_out").select("orig_index", P.to_bool(F.col("is_ai_llm")).alias("is_ai_llm"))
    d = with_year(view(spark, sf, "news")).join(lab, "orig_index")
    return A.yearly_share(d, "is_ai_llm")


WIDE = 40  # every element of the vectors and some numbers beside them, 42 columns


@query("a29b_corr_wide", ["news_vec"], f"""
WITH v AS (SELECT CAST(orig_index AS DOUBLE) AS n0, CAST(length(plain_text) AS DOUBLE) AS n1,
                  {", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(WIDE))} FROM news_vec),
c AS (SELECT unnest([{", ".join(f"struct_pack(x := '{a}', y := '{b}', corr := corr({a}, {b}))" for cs in [["n0", "n1", *(f"e{i}" for i in range(WIDE))]]
                                for k, a in enumerate(cs) for b in cs[k + 1:])}]) AS r FROM v)
SELECT r.x AS x, r.y AS y, r.corr AS corr FROM c""", rounded=["corr"])
def a29b_corr_wide(spark, sf):
    news = view(spark, sf, "news_vec")
    cols = [F.col("orig_index").cast("double").alias("n0"), F.length("plain_text").cast("double").alias("n1"),
            *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(WIDE))]
    return A.corr_wide(news.select(*cols), ["n0", "n1", *(f"e{i}" for i in range(WIDE))])


@query("a31b_density_binned", ["judged"], f"""
WITH long AS (SELECT 'ai_score' AS col, ai_score AS v FROM judged UNION ALL SELECT 'ai_score_simple', ai_score_simple FROM judged),
law AS (SELECT col, min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / {A.DENSITY_BINS} AS width, count(v) AS n,
               stddev_samp(v) * pow(count(v), -0.2) AS bw FROM long GROUP BY col),
place AS (SELECT long.col, least(floor((v - lo) / width), {A.DENSITY_BINS} - 1) AS b, (v - lo) / width AS pos FROM long JOIN law ON long.col = law.col),
binned AS (SELECT col, b, sum(share) AS weight FROM (SELECT col, b, 1 - (pos - b) AS share FROM place UNION ALL SELECT col, b + 1, pos - b FROM place) s GROUP BY col, b),
grid AS (SELECT *, lo + (hi - lo) * i / 49 AS x FROM law, range(0, 50) r(i))
SELECT g.col AS "column", CAST(i AS INT) AS grid_index, x,
       sum(exp(-pow((x - (lo + b * width)) / bw, 2) / 2) * weight) / (n * bw * sqrt(2 * pi())) AS density
FROM grid g JOIN binned ON g.col = binned.col GROUP BY g.col, i, x, n, bw""", rounded=["x", "density"])
def a31b_density_binned(spark, sf):
    return A.density_binned(view(spark, sf, "judged"), ["ai_score", "ai_score_simple"], points=50)
