"""Corrections: one sentiment path, range edges as data, member counts, whole pools, uneven shards, Unicode blanks."""

import numpy as np
import pytest
from conftest import SF01
from presslens.functions import parse as P
from presslens.operators import aggregates as A
from presslens.operators import evaluation as E
from presslens.operators import stats
from presslens.operators import text as T
from presslens.sources import readers as R
from presslens.sources.fixtures import view
from pyspark.sql import functions as F


def test_vectors_of_every_article_cover_the_table(spark):
    n = spark.read.parquet(f"{SF01}/embeddings.parquet").count()
    assert view(spark, SF01, "news_vec").select("embedding").distinct().count() == n
    assert view(spark, SF01, "protos").select("name").distinct().count() == 10


@pytest.mark.parametrize("more", [0, 7000])
def test_one_sentiment_result_for_any_lexicon(spark, more):
    text = "good and bad and good news for everybody who reads this long enough text"
    df = spark.createDataFrame([(1, text), (1, text), (2, "good"), (3, None)], "orig_index bigint, plain_text string")
    lexicon = {"good": 1.0, "bad": -0.5} | {f"word{i}": 1.0 for i in range(more)}
    table = spark.createDataFrame([*lexicon.items(), ("good", 0.25)], "word string, polarity double")
    for source, s in ((lexicon, 1.5), (table, 2.0)):
        out = T.sentiment_score(df, source)
        assert out.columns == ["orig_index", "plain_text", "sentiment"]
        got = sorted((r["orig_index"], r["sentiment"]) for r in out.collect() if r["sentiment"] is not None)
        assert got == [(1, pytest.approx(s / (s * s + 15) ** 0.5))] * 2 and out.count() == 4


@pytest.mark.parametrize("partitions", [1000])
def test_quantiles_with_many_shuffle_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    values = [float((i * 37) % 1009) for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        got = {r["p"]: r["value"] for r in stats.exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.99]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(values, p))


def test_cluster_summary_counts_members(spark):
    reps = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "cluster int, text string, rank int")
    sizes = spark.createDataFrame([(1, 40), (2, 7)], "cluster int, size bigint")
    got = {r["cluster"]: (r["size"], r["representatives"], r["label_sentence"]) for r in A.cluster_summary(reps, sizes, k=2).collect()}
    assert got == {1: (40, ["a", "b"], "a"), 2: (7, ["c"], "c")}


def test_small_pool_comes_back_whole_and_without_repeats(spark):
    df = spark.range(1, 101).selectExpr("id AS orig_index", "id / 100.0D AS ai_score")
    assert E.label_pool(df.union(df), "stratified", 100).count() == 100
    assert E.label_pool(df, "stratified", 50).count() <= 50


def test_shards_with_different_columns_and_a_blank_in_the_path(spark, tmp_path):
    one, two = str(tmp_path / "first shard"), str(tmp_path / "second")
    spark.createDataFrame([(1, "x")], "orig_index bigint, a string").write.parquet(one)
    spark.createDataFrame([(2, 5)], "orig_index bigint, b int").write.parquet(two)
    got = sorted(tuple(r[c] for c in ("orig_index", "a", "b", "src_priority")) for r in R.read_shards(spark, [one, two]).collect())
    assert got == [(1, "x", None, 0), (2, None, 5, 1)]


def test_unicode_blanks_are_stripped(spark):
    df = spark.createDataFrame([("\xa0ja ",), ("　 nej\x85",)], "s string")
    assert [r[0] for r in df.select(P.to_bool(F.col("s"))).collect()] == [True, False]
    assert [r[0] for r in df.select(P.clean_label(F.col("s"))).collect()] == ["ja", "nej"]
    text = spark.createDataFrame([("ja 80\x0bAI",)], "s string")
    assert text.select(F.size(F.split("s", P.LINE_BREAK))).first()[0] == 3
