"""Rank cut against a plain sort and limit."""

import math
import random

import pytest
from presslens.operators import rankcut
from presslens.operators.evaluation import sample_n, sample_top_k
from presslens.operators.windows import priority_pool
from pyspark.sql import functions as F


def table(spark, n=900):
    rnd = random.Random(4)
    odd = [None, float("nan"), math.inf, -math.inf, 0.0, -0.0]
    rows = [(i, rnd.choice(odd) if rnd.random() < .1 else 5.0 if rnd.random() < .4 else round(rnd.gauss(0, 3), 2)) for i in range(n)]
    return spark.createDataFrame(rows, "orig_index bigint, v double").repartition(5).cache()


@pytest.mark.parametrize("down", [True, False])
def test_equal_to_sort_and_limit(spark, down):
    df = table(spark)
    v, key = F.col("v"), F.col("orig_index")
    order = [v.desc() if down else v.asc(), key.asc()]
    ranked = [r["orig_index"] for r in df.orderBy(*order).collect()]
    for n in (0, 1, 37, 333, 620, 899, 900, 5000):
        got = [r["orig_index"] for r in rankcut.first_rows(df, [(v, down), (key, False)], order, n, left=9).collect()]
        assert sorted(got) == sorted(ranked[:n]), n


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, 2.0)] * 40 + [(2, 3.0)] * 3, "orig_index bigint, v double")
    cut = [(F.col("v"), False), (F.col("orig_index"), False)]
    order = [F.col("v"), F.col("orig_index")]
    assert [r["v"] for r in rankcut.first_rows(df, cut, order, 25, left=4).collect()] == [2.0] * 25
    assert sorted(r["v"] for r in rankcut.first_rows(df, cut, order, 42, left=1).collect()) == [2.0] * 40 + [3.0] * 2
    assert rankcut.first_rows(df.limit(0), cut, order, 5).count() == 0


def test_large_samples_and_pools(spark, monkeypatch):
    df = table(spark, 4000).withColumns({"ai_score": F.abs("v"), "keyword_score": F.col("orig_index") % 3, "cluster": F.col("orig_index") % 5 - 1})
    cut = rankcut.first_rows
    small = lambda *a, **k: cut(*a, **(k | {"left": 50}))
    monkeypatch.setattr("presslens.operators.evaluation.first_rows", small)
    monkeypatch.setattr("presslens.operators.windows.first_rows", small)
    ids = lambda d: sorted(r["orig_index"] for r in d.select("orig_index").collect())
    assert ids(sample_n(df, 1500, 3)) == ids(sample_n(df, 1500, 3, direct_below=10 ** 9))
    top = df.orderBy(F.col("v").desc(), "orig_index").limit(1400)
    assert ids(sample_top_k(df, "v", 1400, 1200)) == ids(sample_n(top, 1200, direct_below=10 ** 9))
    noise = (F.col("cluster") == -1).cast("int").desc()
    pool = df.filter("ai_score > 0").orderBy(noise, "keyword_score", F.abs(F.col("ai_score") - 0.15), "orig_index").limit(1300)
    assert ids(priority_pool(df, 1300)) == ids(pool)
