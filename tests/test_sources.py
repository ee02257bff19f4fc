import uuid

import pandas as pd
from pyspark.sql import functions as F

from presslens.operators.windows import first_by_priority
from presslens.session import checkpoint_path
from presslens.sources import readers as R
from presslens.sources import sinks as K


def _csv(spark, rows, name):
    folder = checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")
    import os

    local = R._strip_scheme(folder)
    os.makedirs(local, exist_ok=True)
    path = f"{local}/part.csv"
    pd.DataFrame(rows).to_csv(path, index=False)
    return folder


def test_read_news_csv_multiline(spark):
    rows = [{"orig_index": 1, "plain_text": 'line one\nline "two", quoted', "title": "T1", "publisher": "p",
             "sitename": "s", "published_date": "2020-01-02", "url": "u"},
            {"orig_index": 2, "plain_text": None, "title": "T2", "publisher": "p", "sitename": "s",
             "published_date": "not a date", "url": "u"}]
    folder = _csv(spark, rows, "csv-news")
    df = R.fill_text(R.read_news(spark, folder, fmt="csv"))
    got = {r["orig_index"]: r["plain_text"] for r in df.collect()}
    assert got == {1: 'line one\nline "two", quoted', 2: ""}


def test_read_shards_priority_and_merge(spark):
    a = _csv(spark, [{"orig_index": 1, "is_ai_llm": "ja"}, {"orig_index": 2, "is_ai_llm": "nej"}], "shard-a")
    b = _csv(spark, [{"orig_index": 1, "is_ai_llm": "nej"}, {"orig_index": 3, "is_ai_llm": "ja"}], "shard-b")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("orig_index", T.LongType()), T.StructField("is_ai_llm", T.StringType())])
    stacked = R.read_shards(spark, [b, a], fmt="csv", schema=schema)
    prio = {(r["orig_index"], r["is_ai_llm"]): r["src_priority"] for r in stacked.collect()}
    assert prio == {(1, "nej"): 0, (3, "ja"): 0, (1, "ja"): 1, (2, "nej"): 1}
    merged = {r["orig_index"]: r["is_ai_llm"] for r in first_by_priority(stacked).collect()}
    assert merged == {1: "nej", 2: "nej", 3: "ja"}


def test_write_stage_partitioned_and_json_map(spark):
    df = spark.createDataFrame([(1, 2020, "a"), (2, 2021, "b"), (3, None, "c")], "orig_index long, year int, p string")
    path = checkpoint_path(spark, f"stage-{uuid.uuid4().hex}")
    K.write_stage(df, path, partition_by=["year"])
    back = spark.read.parquet(path)
    assert sorted((r["orig_index"], r["year"]) for r in back.collect()) == [(1, 2020), (2, 2021), (3, None)]
    assert back.filter(F.col("year") == 2020).count() == 1
    jpath = checkpoint_path(spark, f"json-{uuid.uuid4().hex}")
    reps = spark.createDataFrame([(0, ["x", "y"])], "cluster int, reps array<string>")
    K.write_json_map(reps, "cluster", "reps", jpath)
    assert [tuple(r) for r in spark.read.json(jpath).select("key", "value").collect()] == [(0, ["x", "y"])]


def test_stage_files_are_bounded_by_rows(spark, tmp_path):
    from presslens.sources.sinks import write_stage

    path = write_stage(spark.range(0, 1000, 1, 2), str(tmp_path / "stage"), max_rows=100)
    assert spark.read.parquet(path).groupBy(F.input_file_name()).count().agg(F.max("count"), F.count("*")).first()[:] == (100, 10)


def test_the_stream_job_deals_its_input_by_size(spark, monkeypatch):
    from presslens.plans import registry
    from pyspark.sql.classic.dataframe import DataFrame

    registry.load_all()
    fixed, deal = [], DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda df, *a: fixed.append(a) or deal(df, *a))
    got = registry.QUERIES["st01_stream_labels"](spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count() and not fixed
