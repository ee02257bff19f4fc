"""Registered queries: sampling and evaluation E01-E15."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslens.operators import evaluation as E
from presslens.operators.stats import linspace
from presslens.plans import sqlgen as S
from presslens.plans.registry import query
from presslens.session import cut_lineage
from presslens.sources.fixtures import view


def H(seed: int, key: str = "orig_index") -> str:
    return f"md5(concat_ws(':', CAST({key} AS VARCHAR), '{seed}'))"


def _judged(spark, sf):
    return view(spark, sf, "judged")


@query("e01_sample_n", ["judged"], f"SELECT orig_index FROM judged ORDER BY {H(42)}, orig_index LIMIT 50")
def e01_sample_n(spark, sf):
    return E.sample_n(_judged(spark, sf), 50, 42).select("orig_index")


TOPK_SQL = f"""tk AS (SELECT *, 'ai_score' AS score_source, 'top100' AS score_bucket FROM (
  SELECT * FROM (SELECT * FROM judged ORDER BY ai_score DESC, orig_index LIMIT 100) ORDER BY {H(7)}, orig_index LIMIT 20))"""


def _topk(spark, sf):
    return E.sample_top_k(_judged(spark, sf), "ai_score", 100, 20, seed=7)


@query("e02_sample_top_k", ["judged"], f"WITH {TOPK_SQL} SELECT orig_index, score_source, score_bucket FROM tk")
def e02_sample_top_k(spark, sf):
    return _topk(spark, sf).select("orig_index", "score_source", "score_bucket")


_P = linspace(0.0, 1.0, 6)
_LABELS = [f"{int(100 * _P[i])}-{int(100 * _P[i + 1])}%" for i in range(5)]
STRAT_SQL = f"""q AS (SELECT quantile_cont(ai_score_simple, [{', '.join(repr(p) for p in _P)}]) AS e FROM judged),
bk AS (SELECT j.*, CASE WHEN ai_score_simple < e[1] THEN NULL
  {' '.join(f"WHEN ai_score_simple <= e[{i + 2}] THEN '{_LABELS[i]}'" for i in range(5))} END AS score_bucket
  FROM judged j, q),
st AS (SELECT *, 'ai_score_simple' AS score_source FROM (
  SELECT *, row_number() OVER (PARTITION BY score_bucket ORDER BY {H(42)}, orig_index) AS rn
  FROM bk WHERE score_bucket IS NOT NULL) WHERE rn <= 10)"""


def _strat(spark, sf):
    return E.stratified_by_quantile(_judged(spark, sf), "ai_score_simple", 5, 10, 42)


@query("e03_stratified_by_quantile", ["judged"], f"WITH {STRAT_SQL} SELECT orig_index, score_bucket, score_source FROM st")
def e03_stratified_by_quantile(spark, sf):
    return _strat(spark, sf).select("orig_index", "score_bucket", "score_source")


DIS_SQL = f"""dz AS (SELECT *, CASE WHEN ai_score > 0.08 AND ai_score_simple <= 0.0 THEN 'ai_score_high_ai_score_simple_low'
                        WHEN ai_score <= 0.0 AND ai_score_simple > 0.08 THEN 'ai_score_low_ai_score_simple_high' END AS zone
             FROM judged),
ds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY {H(999)}, orig_index) AS rn
                      FROM dz WHERE zone IS NOT NULL) WHERE rn <= 30)"""


def _disagree(spark, sf):
    return E.sample_disagree(_judged(spark, sf), n=30)


@query("e04_sample_disagree", ["judged"], f"WITH {DIS_SQL} SELECT orig_index, zone FROM ds")
def e04_sample_disagree(spark, sf):
    return _disagree(spark, sf).select("orig_index", "zone")


@query("e05_quantile_thresholds", ["judged"], f"""
SELECT DISTINCT unnest(quantile_cont(ai_score, [{', '.join(repr(p) for p in linspace(0.1, 0.9, 7))}])) AS threshold
FROM judged""", rounded=["threshold"])
def e05_quantile_thresholds(spark, sf):
    return E.quantile_thresholds(_judged(spark, sf), "ai_score", 7)


THR = [-0.2, 0.0, 0.2]


@query("e06_accuracy_at", ["judged"], "\nUNION ALL\n".join(
    f"SELECT CAST({t} AS DOUBLE) AS threshold, avg(CAST((ai_score > {t}) = is_ai_label AS DOUBLE)) AS accuracy, "
    f"count(*) AS n_samples FROM judged WHERE is_ai_label IS NOT NULL AND ai_score IS NOT NULL" for t in THR),
    rounded=["accuracy"])
def e06_accuracy_at(spark, sf):
    return E.accuracy_at(_judged(spark, sf), "ai_score", "is_ai_label", THR)


AUC_SQL = """per AS (SELECT ai_score_simple AS s, count_if(is_ai_label) AS pos, count_if(NOT is_ai_label) AS neg
            FROM judged WHERE ai_score_simple IS NOT NULL AND is_ai_label IS NOT NULL GROUP BY 1),
rk AS (SELECT *, coalesce(sum(pos + neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               + (pos + neg + 1) / 2.0 AS avg_rank FROM per),
auc AS (SELECT (sum(pos * avg_rank) - sum(pos) * (sum(pos) + 1) / 2.0) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc,
               CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM rk)"""


@query("e07_auc", ["judged"], f"WITH {AUC_SQL} SELECT * FROM auc", rounded=["auc"])
def e07_auc(spark, sf):
    return E.auc(_judged(spark, sf), "ai_score_simple", "is_ai_label")


@query("e08_accuracy_by_bucket", ["judged"], f"""
WITH {STRAT_SQL}
SELECT score_bucket, avg(CAST((ai_score_simple > 0) = is_ai_label AS DOUBLE)) AS accuracy, count(*) AS n_samples
FROM st GROUP BY 1""", rounded=["accuracy"])
def e08_accuracy_by_bucket(spark, sf):
    return E.accuracy_by_bucket(_strat(spark, sf), "score_bucket", F.col("ai_score_simple") > 0, "is_ai_label")


@query("e09_accuracy_by_source", ["judged"], f"""
WITH {TOPK_SQL}
SELECT avg(CAST((ai_score > 0) = is_ai_label AS DOUBLE)) AS accuracy, count(*) AS n_samples FROM tk
WHERE score_source = 'ai_score'""", rounded=["accuracy"])
def e09_accuracy_by_source(spark, sf):
    return E.accuracy_by_source(_topk(spark, sf), "score_source", "ai_score", F.col("ai_score") > 0, "is_ai_label")


@query("e10_accuracy_by_zone", ["judged"], f"""
WITH {DIS_SQL}
SELECT zone, avg(CAST((ai_score > 0.08) = is_ai_label AS DOUBLE)) AS accuracy, count(*) AS n_samples FROM ds GROUP BY 1
UNION ALL
SELECT 'all', avg(CAST((ai_score > 0.08) = is_ai_label AS DOUBLE)), count(*) FROM ds""", rounded=["accuracy"])
def e10_accuracy_by_zone(spark, sf):
    return E.accuracy_by_zone(_disagree(spark, sf), "ai_score", "is_ai_label", 0.08)


@query("e11_metric_report", ["judged"], f"""
WITH {AUC_SQL}, {STRAT_SQL}
SELECT 'global' AS subset, 'ai_score_simple' AS method, 'all' AS bucket, 'auc' AS metric, auc AS value,
       CAST(n_pos + n_neg AS BIGINT) AS n_samples FROM auc
UNION ALL
SELECT 'stratified_quintile', 'ai_score_simple', score_bucket, 'accuracy_thr>0.00',
       avg(CAST((ai_score_simple > 0) = is_ai_label AS DOUBLE)), count(*) FROM st GROUP BY score_bucket""",
       rounded=["value"])
def e11_metric_report(spark, sf):
    a = E.auc(_judged(spark, sf), "ai_score_simple", "is_ai_label").withColumn("n", F.col("n_pos") + F.col("n_neg"))
    b = E.accuracy_by_bucket(_strat(spark, sf), "score_bucket", F.col("ai_score_simple") > 0, "is_ai_label")
    return E.metric_report([
        E.metric_rows(a, "global", "ai_score_simple", "auc", "auc", "n"),
        E.metric_rows(b, "stratified_quintile", "ai_score_simple", "accuracy_thr>0.00", "accuracy", "n_samples",
                      bucket="score_bucket"),
    ])


@query("e12_label_sample", ["judged", "llm_raw"], f"""
WITH s AS (SELECT orig_index FROM judged ORDER BY {H(42)}, orig_index LIMIT 50)
SELECT s.orig_index, coalesce(starts_with(lower({S.strip_sql('l.answer')}), 'ja'), FALSE) AS is_ai_label,
       'global_random' AS subset, 'both' AS score_source, 'all' AS score_bucket, 'all' AS zone
FROM s LEFT JOIN llm_raw l ON s.orig_index = l.orig_index""")
def e12_label_sample(spark, sf):
    s = E.sample_n(_judged(spark, sf).select("orig_index"), 50, 42)
    return E.label_sample(s, view(spark, sf, "llm_raw"), "global_random")


@query("e13_label_pool", ["judged"], f"""
WITH pos AS (SELECT * FROM judged WHERE ai_score > 0),
q AS (SELECT quantile_cont(ai_score, [{', '.join(repr(p) for p in linspace(0.0, 1.0, 11))}]) AS e FROM pos),
bk AS (SELECT p.*, CASE WHEN ai_score < e[1] THEN NULL
  {' '.join(f"WHEN ai_score <= e[{i + 2}] THEN '{int(100 * linspace(0.0, 1.0, 11)[i])}-{int(100 * linspace(0.0, 1.0, 11)[i + 1])}%'" for i in range(10))}
  END AS score_bucket FROM pos p, q)
SELECT orig_index, score_bucket FROM (
  SELECT *, row_number() OVER (PARTITION BY score_bucket ORDER BY {H(42)}, orig_index) AS rn
  FROM bk) WHERE rn <= 10 AND score_bucket IS NOT NULL OR (SELECT count(*) FROM pos) <= 100""")
def e13_label_pool(spark, sf):
    return E.label_pool(_judged(spark, sf), "stratified", 100).select("orig_index", "score_bucket")


@query("e14_precision_recall_subsets", ["judged"], """
SELECT CAST(0.4 AS DOUBLE) AS threshold, count_if(ai_score > 0.4) AS n FROM judged
UNION ALL SELECT CAST(0.3 AS DOUBLE), count_if(ai_score > 0.3) FROM judged""")
def e14_precision_recall_subsets(spark, sf):
    return E.precision_recall_subsets(_judged(spark, sf), "ai_score")


@query("e15_sample_two_sided", ["judged"], f"""
SELECT orig_index, side FROM (
  SELECT *, row_number() OVER (PARTITION BY side ORDER BY {H(42)}, orig_index) AS rn FROM (
    SELECT *, CASE WHEN ai_score > 0.1 THEN 'pos' WHEN ai_score <= -0.1 THEN 'neg' END AS side FROM judged)
  WHERE side IS NOT NULL) WHERE rn <= 20""")
def e15_sample_two_sided(spark, sf):
    return E.sample_two_sided(_judged(spark, sf), "ai_score", n=20).select("orig_index", "side")


_T = linspace(0.1, 0.9, 7)


@query("e16_score_quality", ["judged", "llm_raw"], f"""
WITH {TOPK_SQL}, {STRAT_SQL},
sub AS (SELECT 'global_random' AS subset, orig_index, ai_score FROM (SELECT * FROM judged ORDER BY {H(42)}, orig_index LIMIT 50)
        UNION ALL SELECT 'top', orig_index, ai_score FROM tk UNION ALL SELECT 'stratified', orig_index, ai_score FROM st),
lab AS (SELECT s.*, coalesce(starts_with(lower({S.strip_sql('l.answer')}), 'ja'), FALSE) AS label
        FROM sub s LEFT JOIN llm_raw l ON s.orig_index = l.orig_index),
thr AS (SELECT unnest(quantile_cont(ai_score, [{', '.join(repr(p) for p in _T)}])) AS t,
               unnest(range(1, 8)) AS i FROM judged)
SELECT subset, 'ai_score' AS method, concat('t', CAST(i AS VARCHAR)) AS bucket, 'accuracy' AS metric,
       avg(CASE WHEN (ai_score > t) = label THEN 1.0 ELSE 0.0 END) AS value, count(*) AS n_samples
FROM lab, thr GROUP BY subset, i
UNION ALL
SELECT a.subset, 'ai_score', 'all', 'auc', avg(CASE WHEN a.ai_score > b.ai_score THEN 1.0 WHEN a.ai_score = b.ai_score THEN 0.5
       ELSE 0.0 END), (SELECT count(*) FROM lab c WHERE c.subset = a.subset)
FROM lab a JOIN lab b ON a.subset = b.subset AND a.label AND NOT b.label GROUP BY a.subset""", rounded=["value"])
def e16_score_quality(spark, sf):
    """The whole check of a score: three samples, model labels, thresholds of all rows, one metric table."""
    judged, answers = _judged(spark, sf), view(spark, sf, "llm_raw")
    thresholds = sorted(r["threshold"] for r in E.quantile_thresholds(judged, "ai_score", 7).collect())
    place = F.array(*[F.lit(t) for t in thresholds])
    samples = {"global_random": E.sample_n(judged, 50, 42), "top": _topk(spark, sf), "stratified": _strat(spark, sf)}
    parts = []
    for name, sample in samples.items():
        labelled = cut_lineage(E.label_sample(sample, answers, name))  # drawn once, measured several times
        at = E.accuracy_at(labelled, "ai_score", "is_ai_label", thresholds)
        at = at.withColumn("bucket", F.concat(F.lit("t"), F.array_position(place, F.col("threshold")).cast("string")))
        parts.append(E.metric_rows(at, name, "ai_score", "accuracy", "accuracy", "n_samples", "bucket"))
        area = E.auc(labelled, "ai_score", "is_ai_label").withColumn("n", F.col("n_pos") + F.col("n_neg"))
        parts.append(E.metric_rows(area, name, "ai_score", "auc", "auc", "n"))
    return E.metric_report(parts)
