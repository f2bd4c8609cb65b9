"""Registered queries: each entry pairs a Spark plan with the SQL that checks it, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.xsection import position_percentile
from tidemark.plans import analytics, builds, markets, reads, runs, stores  # noqa: F401  (their queries register on import)
from tidemark.plans.bindings import REGISTRY, bars, sectors
from tidemark.plans.features import newest_price_features


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-in-time price features of every security at its newest bar, with sector percentiles."""
    rows = newest_price_features(bars(spark, sf_dir)).join(sectors(spark, sf_dir), "security_id")
    ranked = {f"{n}_sector_percentile": position_percentile(F.col(n), ["sector"]) for n in ("momentum_12_1", "realized_vol_20d")}
    return rows.withColumns(ranked)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTRY.items()} | {"price_features": flagship}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
