"""Registered queries: text operators T01-T19."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from presslens.functions import text as T
from presslens.operators import aggregates as A
from presslens.operators import text as TX
from presslens.plans import sqlgen as S
from presslens.plans.q_aggregates import SENTIMENT_SQL, _sentiment
from presslens.plans.q_trends import SCORED_SQL
from presslens.plans.registry import query
from presslens.plans.trends import scored_news
from presslens.sources.fixtures import view

KEYWORDS = ["ai", "de", "license", "keit", "tion"]


def _news(spark, sf):
    return view(spark, sf, "news")


@query("t01_keyword_score", ["news"], f"""
SELECT orig_index, {S.keyword_score_sql('plain_text', KEYWORDS)} AS keyword_score FROM news""")
def t01_keyword_score(spark, sf):
    return TX.keyword_score(_news(spark, sf), KEYWORDS).select("orig_index", "keyword_score")


@query("t01b_subject_keywords", ["news"], f"""
SELECT orig_index, {S.keyword_score_sql('plain_text', T.AI_KEYWORDS)} AS keyword_score FROM news""")
def t01b_subject_keywords(spark, sf):
    """The study's whole keyword list."""
    return TX.keyword_score(_news(spark, sf)).select("orig_index", "keyword_score")


@query("t02_keyword_score_plain", ["news"], "SELECT orig_index, " + " + ".join(
    f"CAST(contains(lower(coalesce(plain_text, '')), '{k}') AS INT)" for k in KEYWORDS) + " AS keyword_score FROM news")
def t02_keyword_score_plain(spark, sf):
    return TX.keyword_score_plain(_news(spark, sf), KEYWORDS).select("orig_index", "keyword_score")


@query("t03_keyword_flag", ["news_raw"], """
SELECT orig_index,
  coalesce(contains(lower(plain_text), 'license') OR contains(lower(plain_text), 'keit'), FALSE) AS is_ai_folded,
  coalesce(contains(lower(plain_text), 'License') OR contains(lower(plain_text), 'keit'), FALSE) AS is_ai_case_trap
FROM news_raw""")
def t03_keyword_flag(spark, sf):
    d = TX.keyword_flag(view(spark, sf, "news_raw"), ["License", "keit"], True, out="is_ai_folded")
    d = TX.keyword_flag(d, ["License", "keit"], False, out="is_ai_case_trap")
    return d.select("orig_index", "is_ai_folded", "is_ai_case_trap")


REGEX_WORDS = ["license", "keit", "a+b", "tion."]


@query("t04_regex_flag", ["news_raw"], f"""
SELECT orig_index, coalesce(regexp_matches(lower(plain_text), {S.lit(T.alternation(REGEX_WORDS))}), FALSE) AS is_ai
FROM news_raw""")
def t04_regex_flag(spark, sf):
    return TX.regex_flag(view(spark, sf, "news_raw"), REGEX_WORDS).select("orig_index", "is_ai")


PATTERNS = [r"licen[cs]e[sd]?", r"ai", r"apache (software )?foundation"]


@query("t05_regex_filter", ["news_raw"], f"""
SELECT orig_index FROM news_raw WHERE coalesce(regexp_matches(lower(plain_text),
  {S.lit('(^|' + T.NON_WORD + ')(' + '|'.join(f'(?:{p})' for p in PATTERNS) + ')($|' + T.NON_WORD + ')')}), FALSE)""")
def t05_regex_filter(spark, sf):
    return TX.regex_filter(view(spark, sf, "news_raw"), PATTERNS).select("orig_index")


CITIES = ["Version", "Apache", "License"]


@query("t06_first_city", ["news"], f"""
SELECT orig_index, city, city IS NOT NULL AS has_city FROM (
  SELECT orig_index, CASE WHEN h <> '' THEN concat(upper(substring(h, 1, 1)), lower(substring(h, 2))) END AS city
  FROM (SELECT orig_index, regexp_extract(lower(plain_text), {S.lit(T.alternation(CITIES))}, 1) AS h FROM news))""")
def t06_first_city(spark, sf):
    return TX.first_city(_news(spark, sf), CITIES).select("orig_index", "city", "has_city")


COMPANIES = ["Apache", "License", "Software Foundation"]


@query("t07_companies", ["news"], f"""
SELECT orig_index, company, company <> '' AS has_company FROM (
  SELECT orig_index, {S.companies_sql('plain_text', COMPANIES)} AS company FROM news)""")
def t07_companies(spark, sf):
    return TX.companies(_news(spark, sf), COMPANIES).select("orig_index", "company", "has_company")


PHRASES_SQL = f"""ph AS (SELECT DISTINCT trim(o) AS organisation FROM (
  SELECT unnest(regexp_extract_all(coalesce(plain_text, ''), {S.lit(T.ORG_PATTERN)}, 0)) AS o FROM news))"""


def _phrases(spark, sf):
    found = F.regexp_extract_all(F.coalesce(F.col("plain_text"), F.lit("")), F.lit(T.ORG_PATTERN), 0)
    return _news(spark, sf).select(F.explode(found).alias("o")).select(F.trim("o").alias("organisation")).distinct()


@query("t08_actor_type", ["news"], f"""
WITH {PHRASES_SQL}
SELECT organisation, {S.actor_type_sql('organisation')} AS actor_type FROM ph""")
def t08_actor_type(spark, sf):
    return TX.actor_type(_phrases(spark, sf))


@query("t09_likely_company", ["news"], f"""
WITH {PHRASES_SQL}
SELECT organisation, {S.likely_company_sql('organisation')} AS likely_company FROM ph""")
def t09_likely_company(spark, sf):
    return TX.likely_company(_phrases(spark, sf))


@query("t10_organisations", ["news"], f"""
SELECT orig_index, list_sort({S.organisations_sql('plain_text')}) AS organisations FROM news""")
def t10_organisations(spark, sf):
    d = TX.organisations(_news(spark, sf))
    return d.select("orig_index", F.array_sort("organisations").alias("organisations"))


def capital_words(texts):
    return [re.findall("[A-Z][a-z]+", t) for t in texts]


@query("t10b_injected_extractor", ["news"], f"""
SELECT orig_index, list_sort(list_distinct(list_filter(regexp_extract_all(plain_text, '[A-Z][a-z]+'),
       lambda s: length(s) >= 3 AND {S.likely_company_sql('s')}))) AS organisations FROM news""")
def t10b_injected_extractor(spark, sf):
    d = TX.organisations(_news(spark, sf), extractor=capital_words)
    return d.select("orig_index", F.array_sort("organisations").alias("organisations"))


def vowel_scorer(texts):
    return [(t.count("a") / len(t), t.count("e") / len(t)) for t in texts]


@query("t11b_injected_scorer", ["news"], f"""
WITH c AS (SELECT *, length(plain_text) AS n FROM news)
SELECT orig_index, CASE WHEN n >= {TX.SENTIMENT_MIN_CHARS}
  THEN CAST(n - length(replace(plain_text, 'a', '')) AS DOUBLE) / n - CAST(n - length(replace(plain_text, 'e', '')) AS DOUBLE) / n
  END AS sentiment FROM c""", rounded=["sentiment"])
def t11b_injected_scorer(spark, sf):
    return TX.sentiment_by_scorer(_news(spark, sf), vowel_scorer).select("orig_index", "sentiment")


@query("t11_sentiment_score", ["news", "lexicon"], f"""
WITH {SENTIMENT_SQL}
SELECT orig_index, sentiment FROM lab""", rounded=["sentiment"])
def t11_sentiment_score(spark, sf):
    return _sentiment(spark, sf).select("orig_index", "sentiment")


@query("t12_sentiment_label", ["news", "lexicon"], f"""
WITH {SENTIMENT_SQL}
SELECT orig_index, sentiment_label FROM lab""")
def t12_sentiment_label(spark, sf):
    return _sentiment(spark, sf).select("orig_index", "sentiment_label")


@query("t13_truncate", ["llm_out"], """
SELECT orig_index, CASE WHEN length(ai_topic_llm) > 6 THEN concat(substring(ai_topic_llm, 1, 6), '…')
                        ELSE ai_topic_llm END AS topic_short FROM llm_out""")
def t13_truncate(spark, sf):
    return TX.truncate(view(spark, sf, "llm_out"), "ai_topic_llm", 6, "…", out="topic_short") \
        .select("orig_index", "topic_short")


@query("t14_shorten_words", ["news"], rf"""
SELECT orig_index, CASE WHEN len(w) > 3 THEN concat(array_to_string(w[1:3], ' '), '…') ELSE array_to_string(w, ' ') END
       AS title_short
FROM (SELECT orig_index, list_filter(regexp_split_to_array(title, '{S.BLANK}+'), lambda x: x <> '') AS w FROM news)""")
def t14_shorten_words(spark, sf):
    return TX.shorten_words(_news(spark, sf), "title", 3, out="title_short").select("orig_index", "title_short")


@query("t15_month_key", ["news"], """
SELECT orig_index, strftime(try_cast(published_date AS TIMESTAMP), '%Y-%m') AS month FROM news""")
def t15_month_key(spark, sf):
    return TX.month_key(_news(spark, sf)).select("orig_index", "month")


GLOSS = {"der": "the", "und": "and", "les": "the", "des": "of the", "die": "the", "los": "the", "las": "the"}


@query("t16_translate_terms", ["news"], f"""
WITH w AS (SELECT word, count(*) AS count FROM (
  SELECT unnest(regexp_extract_all(lower(coalesce(plain_text, '')), '[\\p{{L}}\\p{{N}}_]+', 0)) AS word FROM news)
  WHERE regexp_matches(word, '^[a-z]{{3,}}$') GROUP BY 1 ORDER BY count DESC, word LIMIT 40)
SELECT word, count, coalesce(CASE word {' '.join(f"WHEN {S.lit(k)} THEN {S.lit(v)}" for k, v in GLOSS.items())} END,
                             word) AS english FROM w""")
def t16_translate_terms(spark, sf):
    words = A.word_counts(_news(spark, sf), top=40)
    out = TX.translate_terms(words, "word", GLOSS, "english")
    return out.withColumn("english", F.coalesce(F.col("english"), F.col("word")))


@query("t17_tokens_text", ["news"], f"""
WITH {SCORED_SQL}
SELECT word, count(*) AS count FROM (
  SELECT unnest(regexp_extract_all(lower(coalesce(plain_text, '')), '[\\p{{L}}\\p{{N}}_]+', 0)) AS word
  FROM scored WHERE is_ai) WHERE regexp_matches(word, '^[a-z]{{3,}}$') GROUP BY 1""")
def t17_tokens_text(spark, sf):
    return A.word_counts(scored_news(_news(spark, sf)).filter("is_ai"), top=None)


@query("t19_text_len", ["news_raw"], "SELECT orig_index, CAST(length(plain_text) AS INT) AS text_len FROM news_raw")
def t19_text_len(spark, sf):
    return TX.text_len(view(spark, sf, "news_raw")).select("orig_index", "text_len")


@query("t18_snippets", ["news"], """
SELECT orig_index, substring(plain_text, 1, 800) AS snippet FROM news
ORDER BY md5(concat_ws(':', CAST(orig_index AS VARCHAR), '42')), orig_index LIMIT 20""")
def t18_snippets(spark, sf):
    return TX.snippets(_news(spark, sf), 20, 800, 42).select("orig_index", "snippet")


#: Names of one to three words that the corpus itself uses: the beginnings of the titles.
NAMES_SQL = f"""names AS (SELECT DISTINCT array_to_string(t[1:n], ' ') AS name, n FROM (
  SELECT regexp_extract_all(lower(coalesce(title, '')), '{T.WORD}+', 0) AS t FROM news) x, range(1, 4) r(n) WHERE len(t) >= n)"""


@query("t10c_gazetteer", ["news"], f"""
WITH {NAMES_SQL},
words AS (SELECT orig_index, regexp_extract_all(lower(plain_text), '{T.WORD}+', 0) AS w FROM news),
grams AS (SELECT orig_index, i, n, array_to_string(w[i:i + n - 1], ' ') AS name
          FROM (SELECT orig_index, w, unnest(range(1, len(w) + 1)) AS i FROM words) x, range(1, 4) r(n) WHERE i + n - 1 <= len(w)),
longest AS (SELECT orig_index, i, max(grams.n) AS n FROM grams JOIN names USING (name, n) GROUP BY orig_index, i)
SELECT g.name, count(*) AS mentions, count(DISTINCT g.orig_index) AS articles, CAST(sum(g.i - 1) AS BIGINT) AS positions
FROM grams g JOIN longest l ON g.orig_index = l.orig_index AND g.i = l.i AND g.n = l.n GROUP BY g.name""")
def t10c_gazetteer(spark, sf):
    """Every place where a name of the corpus's own list begins, the longest name of each place."""
    news = _news(spark, sf)
    tokens = news.select(T.word_runs(F.col("title")).alias("t"))
    names = tokens.select(F.explode(F.expr("filter(sequence(1, 3), n -> n <= size(t))")).alias("n"), "t").select(
        F.array_join(F.slice("t", F.lit(1), F.col("n")), " ").alias("name")).distinct()
    found = TX.gazetteer_mentions(news, names, overlapping=True, numbered=True)
    first = F.when((F.col("nth") == 1) & F.col("orig_index").isNotNull(), 1)  # one a text: no pair of name and text is shuffled
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("mentions"), F.count(first).alias("articles"),
                                     F.sum("position").alias("positions"))


#: A lexicon of the size of the corpus vocabulary: a valence for every word of it.
LEXICON_SQL = f"""words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(plain_text), '{T.WORD}+', 0)) AS word FROM news),
lex AS (SELECT word, CAST(length(word) % 7 AS DOUBLE) - 3 AS polarity FROM words WHERE word NOT IN ('and', 'the'))"""
#: Words of the given prose in the part of negations, words of degree and "but".
RULE_WORDS = {"negations": ("no", "not", "ne"), "degrees": {"the": 0.293, "de": -0.293}, "but": "and"}
_LIST = ", ".join(f"'{w}'" for w in RULE_WORDS["negations"])
_DEGREE = "(CASE l[i - {n}] " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in RULE_WORDS["degrees"].items()) + " ELSE 0 END)"


@query("t11c_sentiment_rules", ["news"], f"""
WITH {LEXICON_SQL},
sent AS (SELECT orig_index, upper(plain_text) <> plain_text AND lower(plain_text) <> plain_text AS mixed,
                unnest(regexp_extract_all(plain_text, '[^.!?\n]+[.!?]*', 0)) AS s
         FROM news WHERE length(plain_text) >= {TX.SENTIMENT_MIN_CHARS}),
cut AS (SELECT *, least(length(s) - length(replace(s, '!', '')), {TX.MOST_EXCLAMATIONS}) * {TX.EXCLAMATION} AS marks,
               regexp_extract_all(s, '{T.WORD}+', 0) AS w FROM sent),
low AS (SELECT *, list_transform(w, lambda x: lower(x)) AS l FROM cut),
tok AS (SELECT *, coalesce(list_position(l, '{RULE_WORDS["but"]}'), 0) AS b, unnest(range(1, len(w) + 1)) AS i FROM low),
val AS (SELECT orig_index, (polarity + sign(polarity) * (
                 {" + ".join(f"CASE WHEN i > {n} THEN {_DEGREE.format(n=n)} * {f} ELSE 0 END" for n, f in zip((1, 2, 3), TX.DEGREE_FADE))} + marks
                 + CASE WHEN mixed AND upper(w[i]) = w[i] AND lower(w[i]) <> w[i] THEN {TX.CAPITALS} ELSE 0 END))
               * CASE WHEN len(list_filter(l[greatest(i - 3, 1):i - 1], lambda x: x IN ({_LIST}))) > 0 AND i > 1 THEN {TX.NEGATION_FACTOR} ELSE 1 END
               * CASE WHEN b = 0 OR b = i THEN 1 WHEN i < b THEN {TX.BEFORE_BUT} ELSE {TX.AFTER_BUT} END AS v
        FROM tok JOIN lex ON lex.word = tok.l[tok.i]),
sums AS (SELECT orig_index, sum(v) AS s FROM val GROUP BY orig_index)
SELECT n.orig_index, CASE WHEN length(n.plain_text) >= {TX.SENTIMENT_MIN_CHARS}
  THEN coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + {TX.SENTIMENT_ALPHA}) END AS sentiment
FROM news n LEFT JOIN sums ON n.orig_index = sums.orig_index""", rounded=["sentiment"])
def t11c_sentiment_rules(spark, sf):
    """Sentence rules with a valence for every word of the corpus."""
    news = _news(spark, sf)
    words = news.select(F.explode(T.word_runs(F.col("plain_text"))).alias("word")).distinct().filter("word NOT IN ('and', 'the')")
    lexicon = words.select("word", (F.length("word") % 7 - 3).cast("double").alias("polarity"))
    return TX.sentiment_rules(news, lexicon, **RULE_WORDS).select("orig_index", "sentiment")
