"""Session construction shared by tests, the benchmark and applications."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: The library compares aware instants only, so sessions run in UTC.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session; clusters pass their own builder settings on top of CONF."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    own = {"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": str(partitions or cpus)}
    return SparkSession.builder.config(map=CONF | own | conf).getOrCreate()
