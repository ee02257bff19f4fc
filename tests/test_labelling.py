import uuid

import pytest
from pyspark.sql import functions as F

from presslens.operators import labelling as L
from presslens.plans.rules import KeywordRules
from presslens.plans.trends import FIXTURE_KEYWORDS
from presslens.session import checkpoint_path
from presslens.sources.fixtures import view

SF = "/root/testdata/sf0.001"


def test_label_batches_one_answer_per_row(spark):
    news = L.build_prompt(view(spark, SF, "news"))
    out = L.label_batches(news.repartition(3), KeywordRules(FIXTURE_KEYWORDS), batch_size=7)
    assert out.count() == news.count()
    assert out.select("orig_index").distinct().count() == news.count()


def test_retry_never_loses_an_id(spark):
    news = L.build_prompt(view(spark, SF, "news")).select("orig_index", "prompt")
    model = KeywordRules(FIXTURE_KEYWORDS, lines=10, short_every=2)
    first = news.join(L.label_batches(news, model), "orig_index")
    assert first.filter(~L.P.valid_format(F.col("answer"))).count() > 0
    out = L.retry_invalid(first, model)
    assert sorted(r[0] for r in out.select("orig_index").collect()) == sorted(r[0] for r in news.select("orig_index").collect())
    # the stricter prompt mends every row but those that stay malformed, which end empty
    stay = F.length(F.col("plain_text")) % 6 == 0
    texts = view(spark, SF, "news").select("orig_index", "plain_text")
    assert out.join(texts, "orig_index").filter((F.col("answer") == "") != stay).count() == 0


def test_resume_is_idempotent(spark):
    news = L.build_prompt(view(spark, SF, "news"))
    path = checkpoint_path(spark, f"resume-{uuid.uuid4().hex}")
    model = KeywordRules(FIXTURE_KEYWORDS)
    # first run stops after half of the rows (simulated), second run completes, third adds nothing
    half = news.filter(F.col("orig_index") % 2 == 0)
    L.checkpointed_labels(half, model, path)
    a = L.checkpointed_labels(news, model, path).count()
    b = L.checkpointed_labels(news, model, path).count()
    assert a == b == news.count()


def test_killed_between_write_and_commit_leaves_no_duplicates(spark, monkeypatch):
    news = L.build_prompt(view(spark, SF, "news"))
    path = checkpoint_path(spark, f"killed-{uuid.uuid4().hex}")
    model = KeywordRules(FIXTURE_KEYWORDS)
    real, calls = L._commit, []

    def dies(df, p, attempt, chunk):
        calls.append(chunk)
        if len(calls) == 2:
            raise KeyboardInterrupt
        real(df, p, attempt, chunk)

    monkeypatch.setattr(L, "_commit", dies)
    with pytest.raises(KeyboardInterrupt):
        L.checkpointed_labels(news, model, path)
    assert spark.read.parquet(f"{path}/rows").select("chunk").distinct().count() == 2  # two chunks written, one committed
    first = L.read_label_log(news, path)
    pending = news.join(first, "orig_index", "left_anti").count()
    assert 0 < first.count() == news.count() - pending
    monkeypatch.setattr(L, "_commit", real)
    out = L.checkpointed_labels(news, model, path)
    assert out.count() == out.select("orig_index").distinct().count() == news.count()


def test_no_rows_to_label(spark):
    none = L.build_prompt(view(spark, SF, "news")).limit(0)
    path = checkpoint_path(spark, f"none-{uuid.uuid4().hex}")
    assert L.checkpointed_labels(none, KeywordRules(FIXTURE_KEYWORDS), path).count() == 0


def test_merge_labels_priority(spark):
    out = L.merge_labels(view(spark, SF, "shard_union"), view(spark, SF, "judged").select("orig_index", "ai_score"),
                         view(spark, SF, "news"))
    assert out.groupBy("orig_index").count().filter("count > 1").count() == 0
    assert out.filter(F.col("src_priority") == 9).count() == 0
    assert out.filter(F.col("year") < 2016).count() == 0


def test_barrier_mapping(spark):
    df = spark.createDataFrame([("None",), (" Costs",), ("x",), (None,)], "b string")
    out = L.barrier_label_mapping(df, "b", {"costs": (3, "cost")}).collect()
    assert [(r["barrier_cluster_id"], r["barrier_cluster_label"]) for r in out] == \
        [(-999, "none"), (3, "cost"), (-1, "other"), (-1, "other")]
    table = spark.createDataFrame([("costs", 3, "cost")], "raw_label string, cluster_id int, cluster_label string")
    out2 = L.barrier_label_mapping(df, "b", table).collect()
    assert sorted((r["b"] or "", r["barrier_cluster_id"]) for r in out2) == [("", -1), (" Costs", 3), ("None", -999), ("x", -1)]


def test_label_clusters_representative_by_frequency(spark):
    from presslens.operators.clustering import label_clusters

    rows = [("Skills gap",)] * 3 + [("skills gap ",)] * 2 + [("skills gaps",)] * 4 + [("none",)] * 5 + [(None,)]
    df = spark.createDataFrame(rows, "b string")
    m = {r["raw_label"]: (r["cluster_label"], r["freq"]) for r in label_clusters(df, "b", eps=2.0, min_pts=1,
                                                                               min_size=1).collect()}
    assert "none" not in m and m["skills gap"][1] == 5 and m["skills gaps"][1] == 4
    assert m["skills gap"][0] == m["skills gaps"][0] == "skills gap"
