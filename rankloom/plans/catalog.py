"""Query registry used by ``__spark_entry__`` and ``bench.py``.

Each entry: ``name -> (fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
Oracle SQL runs in DuckDB over the raw driver tables; views are inlined as CTEs.
"""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

REGISTRY: dict[str, tuple[Callable, str | None]] = {}

_MODULES = (
    "rankloom.plans.q_serving",
    "rankloom.plans.q_features",
    "rankloom.plans.q_pairs",
    "rankloom.plans.q_retrieval",
    "rankloom.plans.q_eda",
    "rankloom.plans.q_metrics",
    "rankloom.plans.q_drift",
    "rankloom.plans.q_telemetry",
    "rankloom.plans.q_store",
    "rankloom.plans.q_ranker",
    "rankloom.plans.q_models",
    "rankloom.plans.q_trained",
    "rankloom.plans.q_streaming",
)


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            from rankloom.session import DEFAULT_CONF, ensure_checkpoint_dir, ship_package
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            for key in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.sources.fileCompressionFactor", "spark.sql.codegen.hugeMethodLimit"):
                spark.conf.set(key, DEFAULT_CONF[key])
            return fn(spark, sf_dir)

        REGISTRY[name] = (run, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Callable, str | None]]:
    for m in _MODULES:
        importlib.import_module(m)
    return REGISTRY


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column so two engines compare on stable digits."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
