"""Registered queries: labelling L01-L15."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslens.functions import parse as P
from presslens.operators import labelling as L
from presslens.plans import sqlgen as S
from presslens.plans.registry import query
from presslens.plans.rules import KeywordRules, answer_sql
from presslens.plans.trends import FIXTURE_KEYWORDS
from presslens.session import cut_lineage
from presslens.sources.fixtures import view

ST = S.strip_sql
NUMBER = P.NUMBER
NO_BARRIER = "('none', 'no barrier', 'no ai barrier', 'no barriers')"
NONE_VARIANTS = "('none', 'no', 'n/a', 'na')"

LINES_SQL = f"""a AS (SELECT orig_index, answer, {ST("coalesce(answer, '')")} AS raw FROM llm_raw),
b AS (SELECT *, list_filter(list_transform(regexp_split_to_array(raw, '\\r\\n|\\r|\\n'), lambda x: {ST('x')}),
                            lambda x: x <> '') AS lines FROM a)"""


@query("l01_build_prompt", ["news"], f"""
SELECT orig_index, concat({S.lit(L.PROMPT_HEAD)}, coalesce(plain_text, ''), {S.lit(L.PROMPT_TAIL)}) AS prompt FROM news""")
def l01_build_prompt(spark, sf):
    return L.build_prompt(view(spark, sf, "news")).select("orig_index", "prompt")


@query("l02_label_batches", ["news"], f"SELECT orig_index, {answer_sql(FIXTURE_KEYWORDS)} AS answer FROM news")
def l02_label_batches(spark, sf):
    return L.label_batches(L.build_prompt(view(spark, sf, "news")), KeywordRules(FIXTURE_KEYWORDS))


@query("l03_yes_no", ["llm_raw"], f"""
SELECT orig_index, coalesce(starts_with(lower({ST('answer')}), 'ja'), FALSE) AS is_ai_label FROM llm_raw""")
def l03_yes_no(spark, sf):
    return L.yes_no(view(spark, sf, "llm_raw")).select("orig_index", "is_ai_label")


@query("l04_parse_answer5", ["llm_raw"], f"""
WITH {LINES_SQL},
c AS (SELECT *, coalesce(starts_with(lower(lines[1]), 'ja'), FALSE) AS label,
             nullif(regexp_extract(lower(raw), {S.lit(NUMBER)}, 2), '') AS num,
             CASE WHEN len(lines) >= 3 THEN lines[3] ELSE 'unknown' END AS topic,
             CASE WHEN len(lines) >= 4 THEN lines[4] ELSE 'none' END AS btype,
             CASE WHEN len(lines) >= 5 THEN lines[5] ELSE 'none' END AS summ FROM b),
d AS (SELECT *, lower(btype) NOT IN {NO_BARRIER} AS has_b FROM c)
SELECT orig_index, label AS is_ai_llm,
  CAST(CASE WHEN num IS NOT NULL THEN least(greatest(CAST(num AS DOUBLE), 0.0), 100.0) WHEN label THEN 100.0 ELSE 0.0 END
       AS DOUBLE) AS ai_relevance_llm,
  topic AS ai_topic_llm, has_b AS ai_barrier_llm, CASE WHEN has_b THEN btype ELSE 'none' END AS ai_barrier_type_llm,
  CASE WHEN has_b THEN summ ELSE 'none' END AS ai_barrier_summary_llm FROM d""")
def l04_parse_answer5(spark, sf):
    return L.parse_answers(view(spark, sf, "llm_raw")).drop("answer")


def norm_list_sql(s: str) -> str:
    parts = f"list_filter(list_transform(string_split({ST(s)}, ','), lambda p: {ST('p')}), lambda p: p <> '')"
    uniq = (f"list_filter({parts}, lambda p, i: NOT list_contains(list_transform(({parts})[1:i - 1], "
            f"lambda q: lower(q)), lower(p)))")
    return (f"(CASE WHEN {s} IS NULL OR {s} = '' THEN 'none' WHEN lower({ST(s)}) IN {NONE_VARIANTS} THEN 'none' "
            f"ELSE coalesce(nullif(array_to_string({uniq}, ', '), ''), 'none') END)")


def norm_evidence_sql(s: str) -> str:
    col = ST(f"regexp_replace({ST(s)}, '\\s+', ' ', 'g')")
    return (f"(CASE WHEN {s} IS NULL OR {s} = '' THEN 'none' WHEN lower({ST(s)}) IN {NONE_VARIANTS} THEN 'none' "
            f"WHEN {col} = '' THEN 'none' ELSE {col} END)")


def _listed(i: int) -> str:
    return f"(CASE WHEN len(lines) >= {i} THEN {norm_list_sql(f'lines[{i}]')} ELSE 'none' END)"


@query("l05_parse_answer10", ["llm_raw"], f"""
WITH {LINES_SQL},
c AS (SELECT *, coalesce(starts_with(lower(lines[1]), 'ja'), FALSE) AS label,
             nullif(regexp_extract(lines[2], {S.lit(NUMBER)}, 2), '') AS num,
             CASE WHEN len(lines) >= 3 THEN lines[3] ELSE 'unknown' END AS topic,
             CASE WHEN len(lines) >= 4 THEN lines[4] ELSE 'none' END AS btype,
             CASE WHEN len(lines) >= 5 THEN lines[5] ELSE 'none' END AS summ,
             {_listed(6)} AS countries, {_listed(7)} AS cities, {_listed(8)} AS industries, {_listed(9)} AS terms,
             CASE WHEN len(lines) >= 10 THEN {norm_evidence_sql('lines[10]')} ELSE 'none' END AS evidence FROM b),
d AS (SELECT *, lower(btype) NOT IN {NO_BARRIER} AS has_b,
             label AND (terms = 'none' OR evidence = 'none') AS flip FROM c)
SELECT orig_index, label AND NOT flip AS is_ai_llm,
  CASE WHEN flip THEN 0.0 ELSE CAST(CASE WHEN num IS NOT NULL THEN least(greatest(CAST(num AS DOUBLE), 0.0), 100.0)
       WHEN label THEN 100.0 ELSE 0.0 END AS DOUBLE) END AS ai_relevance_llm,
  CASE WHEN flip THEN 'unknown' ELSE topic END AS ai_topic_llm,
  CASE WHEN flip THEN FALSE ELSE has_b END AS ai_barrier_llm,
  CASE WHEN flip OR NOT has_b THEN 'none' ELSE btype END AS ai_barrier_type_llm,
  CASE WHEN flip OR NOT has_b THEN 'none' ELSE summ END AS ai_barrier_summary_llm,
  CASE WHEN flip THEN 'none' ELSE countries END AS countries_llm,
  CASE WHEN flip THEN 'none' ELSE cities END AS cities_llm,
  CASE WHEN flip THEN 'none' ELSE industries END AS industries_llm,
  CASE WHEN label AND NOT flip THEN terms ELSE 'none' END AS ai_terms_llm,
  CASE WHEN label AND NOT flip THEN evidence ELSE 'none' END AS ai_evidence_llm
FROM d""")
def l05_parse_answer10(spark, sf):
    return L.parse_answers(view(spark, sf, "llm_raw"), ten_lines=True).drop("answer")


@query("l06_norm_list", ["llm_out"], f"""
SELECT orig_index, {norm_list_sql('industries_llm')} AS industries FROM llm_out""")
def l06_norm_list(spark, sf):
    return view(spark, sf, "llm_out").select("orig_index", P.norm_list(F.col("industries_llm")).alias("industries"))


@query("l07_norm_evidence", ["llm_raw"], f"""
SELECT orig_index, {norm_evidence_sql('answer')} AS evidence FROM llm_raw""")
def l07_norm_evidence(spark, sf):
    return view(spark, sf, "llm_raw").select("orig_index", P.norm_evidence(F.col("answer")).alias("evidence"))


@query("l08_valid_format", ["llm_raw"], f"""
WITH {LINES_SQL}
SELECT orig_index, coalesce(len(lines) >= 10 AND (starts_with(lower(lines[1]), 'ja') OR starts_with(lower(lines[1]), 'nej'))
       AND regexp_extract(lines[2], {S.lit(NUMBER)}, 2) <> '' AND answer <> '', FALSE) AS valid FROM b""")
def l08_valid_format(spark, sf):
    return view(spark, sf, "llm_raw").select("orig_index", P.valid_format(F.col("answer")).alias("valid"))


@query("l09_retry_invalid", ["news"], f"""
SELECT orig_index, CASE WHEN length(plain_text) % 9 = 0 THEN '' ELSE {answer_sql(FIXTURE_KEYWORDS, 10)} END AS answer
FROM news""")
def l09_retry_invalid(spark, sf):
    news = L.build_prompt(view(spark, sf, "news")).select("orig_index", "prompt")
    rules = KeywordRules(FIXTURE_KEYWORDS, lines=10, short_every=3)
    # the first answers are kept, as a labelling run keeps them: the retry asks about the malformed ones only
    first = cut_lineage(L.label_batches(news, rules))
    return L.retry_invalid(news.join(first, "orig_index"), rules).select("orig_index", "answer")


@query("l10_checkpointed_labels", ["news"], f"SELECT orig_index, {answer_sql(FIXTURE_KEYWORDS)} AS answer FROM news")
def l10_checkpointed_labels(spark, sf):
    import uuid

    news = L.build_prompt(view(spark, sf, "news"))
    path = L.label_log_path(news, f"label-log-{uuid.uuid4().hex}")
    return L.checkpointed_labels(news, KeywordRules(FIXTURE_KEYWORDS), path)


@query("l11_merge_labels", ["shard_union", "judged", "news"], f"""
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY orig_index ORDER BY src_priority) AS rn
                          FROM shard_union) WHERE rn = 1),
j AS (SELECT f.orig_index, f.is_ai_llm, f.src_priority, s.ai_score, n.published_date
      FROM f LEFT JOIN judged s ON f.orig_index = s.orig_index LEFT JOIN news n ON f.orig_index = n.orig_index
      WHERE f.is_ai_llm IS NOT NULL)
SELECT orig_index, is_ai_llm, src_priority, ai_score, {S.year_sql()} AS year FROM j WHERE {S.year_sql()} >= 2016""")
def l11_merge_labels(spark, sf):
    scores = view(spark, sf, "judged").select("orig_index", "ai_score")
    out = L.merge_labels(view(spark, sf, "shard_union"), scores, view(spark, sf, "news"))
    return out.select("orig_index", "is_ai_llm", "src_priority", "ai_score", "year")


INDUSTRIES = ["finance", "media", "it/software", "aarhus", "health"]


def _vals_sql(c: str, drop_none: bool = True) -> str:
    cond = "s <> '' AND s <> 'none'" if drop_none else "s <> ''"
    return f"list_filter(list_transform(string_split({c}, ','), lambda s: lower({ST('s')})), lambda s: {cond})"


@query("l12_one_hot", ["llm_out"], f"""
SELECT orig_index, {', '.join(f"CAST(list_contains({_vals_sql('industries_llm')}, '{v}') AS INT) AS \"{v}\""
                             for v in INDUSTRIES)} FROM llm_out""")
def l12_one_hot(spark, sf):
    return L.one_hot(view(spark, sf, "llm_out"), "industries_llm", INDUSTRIES)


RAW_VALUES = [" media", "media", "finance", "aarhus", "IT/software"]


@query("l12b_one_hot_raw", ["llm_out"], f"""
SELECT orig_index, {', '.join(f"CAST(list_contains(CASE WHEN industries_llm IS NULL OR industries_llm = 'none' THEN []::VARCHAR[] ELSE string_split(industries_llm, ',') END, {S.lit(v)}) AS INT) AS \"{v}\"" for v in RAW_VALUES)}
FROM llm_out""")
def l12b_one_hot_raw(spark, sf):
    return L.one_hot(view(spark, sf, "llm_out"), "industries_llm", RAW_VALUES, raw=True)


@query("l13_drop_noise_labels", ["llm_out"], f"""
SELECT orig_index, value FROM (SELECT orig_index, unnest(list_distinct({_vals_sql('industries_llm')})) AS value FROM llm_out)
WHERE NOT regexp_matches(lower(value), {S.lit('^(?:' + '|'.join(L.CITY_PATTERNS) + ')$')})""")
def l13_drop_noise_labels(spark, sf):
    long = L.one_hot_long(view(spark, sf, "llm_out"), "industries_llm")
    return L.drop_noise_labels(long, "value")


@query("l14_merge_labels_normalised", ["llm_out"], f"""
SELECT orig_index, list_sort(list_distinct({_vals_sql('industries_llm', False)})) AS industries FROM llm_out""")
def l14_merge_labels_normalised(spark, sf):
    d = L.merge_labels_normalised(view(spark, sf, "llm_out"), "industries_llm", "industries")
    return d.select("orig_index", F.array_sort("industries").alias("industries"))


BARRIER_MAP = {"barrier 1": (1, "barrier one"), "barrier 2": (2, "barrier two"), "barrier 4": (4, "barrier four")}
_NB_INNER = "coalesce(CAST(ai_barrier_type_llm AS VARCHAR), 'nan')"
NORM_BARRIER = f"lower({ST(_NB_INNER)})"


@query("l15_barrier_label_mapping", ["llm_out"], f"""
SELECT orig_index, ai_barrier_type_llm,
  CASE WHEN {NORM_BARRIER} = 'none' THEN -999
       ELSE coalesce(CASE {NORM_BARRIER} {' '.join(f"WHEN {S.lit(k)} THEN {i}" for k, (i, _) in BARRIER_MAP.items())} END, -1)
  END AS barrier_cluster_id,
  CASE WHEN {NORM_BARRIER} = 'none' THEN 'none'
       ELSE coalesce(CASE {NORM_BARRIER} {' '.join(f"WHEN {S.lit(k)} THEN {S.lit(v)}" for k, (_, v) in BARRIER_MAP.items())} END, 'other')
  END AS barrier_cluster_label
FROM llm_out""")
def l15_barrier_label_mapping(spark, sf):
    d = view(spark, sf, "llm_out").select("orig_index", "ai_barrier_type_llm")
    return L.barrier_label_mapping(d, "ai_barrier_type_llm", BARRIER_MAP)
