"""Plan checks: no query plans a pair product or a one-task exact percentile."""

import pytest

from presslens.plans import registry

SF = "/root/testdata/sf0.001"
# queries that write and read back (their plan is a file scan) or run ML fits are skipped here
SKIP = {"l10_checkpointed_labels", "st01_stream_labels", "s04_read_shards", "s05_write_stage", "s06_write_json_map",
        "s07_append_labels", "s08_load_columnset", "s09_embedding_table_write"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in (registry.load_all() or registry.QUERIES) if n not in SKIP))
def test_no_pair_products(spark, name):
    plan = _plan((registry.load_all() or registry.QUERIES)[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "percentile(" not in plan.replace("percentile_approx(", "")


def test_first_row_per_key_is_limited_before_the_shuffle(spark):
    plan = _plan((registry.load_all() or registry.QUERIES)["w02_unique_rows"](spark, SF))
    assert plan.count("WindowGroupLimit") >= 1
