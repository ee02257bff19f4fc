import numpy as np
import pytest
from pyspark.sql import functions as F

from presslens.operators import evaluation as E
from presslens.operators.stats import exact_quantiles, linspace, running_sums


def _np_quantile(x, p):
    return float(np.quantile(np.asarray(x, dtype=float), p))


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_exact_quantiles_match_numpy_with_hot_value(spark, ranges):
    rng = np.random.default_rng(0)
    x = list(rng.normal(size=600)) + [0.25] * 300 + [None] * 5   # a third of rows share one value
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in x], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["p"]: r["value"] for r in exact_quantiles(df, "v", probs, ranges=ranges).collect()}
    vals = [v for v in x if v is not None]
    for p in probs:
        assert got[p] == pytest.approx(_np_quantile(vals, p), abs=1e-12)


def test_exact_quantiles_grouped(spark):
    data = [("a", float(i)) for i in range(1, 11)] + [("b", 5.0)] * 3
    df = spark.createDataFrame(data, "g string, v double")
    got = {(r["g"], r["p"]): r["value"] for r in exact_quantiles(df, "v", [0.5, 0.25], group="g", ranges=3).collect()}
    assert got[("a", 0.5)] == 5.5 and got[("a", 0.25)] == pytest.approx(3.25) and got[("b", 0.5)] == 5.0


def test_running_sums_exclusive(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(50)], "k double, n long")
    out = {r["k"]: r["n_before"] for r in running_sums(df, "k", ["n"], ranges=5).collect()}
    assert all(out[float(i)] == sum(range(i)) for i in range(50))


def test_linspace_matches_numpy():
    assert linspace(0.1, 0.9, 7) == list(np.linspace(0.1, 0.9, 7))
    assert linspace(0.0, 1.0, 6) == list(np.linspace(0.0, 1.0, 6))


def test_auc_with_ties_matches_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(3)
    rows = [(float(np.round(rng.normal(), 1)) + 0.0, bool(rng.random() < 0.4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    got = E.auc(df, "s", "y").first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="yd", numBins=0)
    want = ev.evaluate(df.withColumn("yd", F.col("y").cast("double")))
    # brute force Mann-Whitney
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    bf = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(bf, abs=1e-12)
    assert got == pytest.approx(want, abs=1e-9)


def test_qcut_edges(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(range(1, 11))], "orig_index long, s double")
    bucket, edges = E.quantile_buckets(df, "s", 5)
    got = sorted(r[0] for r in df.select(bucket).collect())
    assert sorted(set(got)) == ["0-20%", "20-40%", "40-60%", "60-80%", "80-100%"]
    assert all(got.count(b) == 2 for b in set(got))
    same = spark.createDataFrame([(i, 3.0) for i in range(6)], "orig_index long, s double")
    b2, e2 = E.quantile_buckets(same, "s", 5)
    assert e2 == [3.0]
    assert [r[0] for r in same.select(b2).collect()] == [None] * 6


def test_sample_is_deterministic_and_exact_size(spark):
    df = spark.range(1000).withColumnRenamed("id", "orig_index")
    a = [r[0] for r in E.sample_n(df, 37, 42).collect()]
    b = [r[0] for r in E.sample_n(df.repartition(7), 37, 42).collect()]
    assert len(a) == 37 and sorted(a) == sorted(b)


def test_large_sample_prefilter_is_exact(spark):
    df = spark.range(20000).withColumnRenamed("id", "orig_index")
    a = sorted(r[0] for r in E.sample_n(df, 1500, 7).collect())
    b = sorted(r[0] for r in E.sample_n(df, 1500, 7, direct_below=10 ** 9).collect())
    assert len(a) == 1500 and a == b


def test_approx_quantiles_close_to_exact(spark):
    from presslens.operators.stats import quantiles

    df = spark.range(10001).selectExpr("cast(id as double) as v")
    ex = {r["p"]: r["value"] for r in quantiles(df, "v", [0.1, 0.5, 0.9]).collect()}
    ap = {r["p"]: r["value"] for r in quantiles(df, "v", [0.1, 0.5, 0.9], exact=False).collect()}
    assert ex == {0.1: 1000.0, 0.5: 5000.0, 0.9: 9000.0}
    assert all(abs(ap[p] - ex[p]) <= 2 for p in ex)
