import uuid

from pyspark.sql import functions as F

from presslens.operators.labelling import build_prompt
from presslens.plans.rules import KeywordRules
from presslens.plans.trends import FIXTURE_KEYWORDS
from presslens.session import checkpoint_path
from presslens.sources.fixtures import view
from presslens.streaming.labelling import stream_labels

SF = "/root/testdata/sf0.001"


def test_stream_labels_resume_exactly_once(spark):
    base = checkpoint_path(spark, f"stream-test-{uuid.uuid4().hex}")
    news = build_prompt(view(spark, SF, "news")).select("orig_index", "prompt")
    first = news.filter(F.col("orig_index") < 100)
    later = news.filter(F.col("orig_index") >= 100)
    first.repartition(2).write.mode("append").parquet(f"{base}/in")
    model = KeywordRules(FIXTURE_KEYWORDS)
    args = (f"{base}/in", news.schema, model, f"{base}/out", f"{base}/state")
    stream_labels(spark, *args)
    n1 = spark.read.parquet(f"{base}/out").count()
    stream_labels(spark, *args)                      # nothing new: nothing added
    n2 = spark.read.parquet(f"{base}/out").count()
    later.repartition(2).write.mode("append").parquet(f"{base}/in")
    stream_labels(spark, *args)                      # only the new file is labelled
    out = spark.read.parquet(f"{base}/out")
    assert n1 == first.count() and n2 == n1
    assert out.count() == news.count()
    assert out.select("orig_index").distinct().count() == news.count()
