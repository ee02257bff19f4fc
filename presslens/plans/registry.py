"""Registry of checked queries: one Spark callable and (when SQL can state it) one oracle SQL text.

Every query reads the driver's tables (through the fixture views) at whatever scale
``sf_dir`` points to; no row caps, id subsets or samples are applied to make a check cheap.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: Sequence[str] = (), sql: str | None = None, rounded: Sequence[str] = (),
          digits: int = 6, rounded_arrays: Sequence[str] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL.

    ``rounded`` names DOUBLE columns whose last bits depend on summation order; both sides round
    them to ``digits`` decimals so the value hashes compare the numbers, not the order of adding.
    """

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if rounded or rounded_arrays:
            def run(spark, sf, _fn=fn):
                df = _fn(spark, sf)

                def rnd(c):
                    if c in rounded:
                        return F.round(F.col(c), digits).alias(c)
                    if c in rounded_arrays:
                        return F.transform(F.col(c), lambda x: F.round(x.cast("double"), digits)).alias(c)
                    return F.col(c)

                return df.select(*[rnd(c) for c in df.columns])
            QUERIES[name] = run
        else:
            QUERIES[name] = fn
        if sql is not None:
            text = _bigint_counts(fixtures.with_views(sql, views))
            if rounded or rounded_arrays:
                reps = ", ".join([f"round({c}, {digits}) AS {c}" for c in rounded]
                                 + [f"list_transform({c}, lambda x: round(CAST(x AS DOUBLE), {digits})) AS {c}"
                                    for c in rounded_arrays])
                text = f"SELECT * REPLACE ({reps}) FROM (\n{text}\n) AS q"
            ORACLES[name] = text
        return fn

    return deco


def _bigint_counts(sql: str) -> str:
    """Wrap every ``count_if(...)`` in ``CAST(... AS BIGINT)``: DuckDB returns HUGEINT, Spark BIGINT."""
    out, i, tag = [], 0, "count_if("
    while True:
        j = sql.find(tag, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(tag)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "CAST(" + tag + _bigint_counts(sql[j + len(tag):k]) + " AS BIGINT)")
        i = k


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib

    for mod in ("q_trends", "q_clean", "q_aggregates", "q_windows", "q_joins", "q_text", "q_vectors",
                "q_labels", "q_evaluation", "q_cluster", "q_sinks"):
        importlib.import_module(f"presslens.plans.{mod}")
