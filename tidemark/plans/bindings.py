"""Bindings of the library's inputs to the star-schema test tables, in Spark and as SQL for the checks.

events are bitemporal facts, lineitem gives daily bars of suppliers, suppliers' regions are sectors, orders
are quarterly fundamentals of customers, labels with documents are forecast histories.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query with the SQL that gives the same rows, if SQL can."""

    def add(f: Query) -> Query:
        REGISTRY[name] = (f, sql)
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def r6(c: Column) -> Column:
    return F.round(c, 6)


AS_OF = "2024-01-12 00:00:00"

FACTS = """facts AS (SELECT user_id AS security_id, strftime(ts, '%Y-%m-%d') AS day, ts AS event_time, ts + to_minutes(CAST(event_id % 5000 AS INTEGER)) AS available_at,
  lpad(CAST(event_id AS VARCHAR), 12, '0') AS source_version, event_id, event_type, value FROM events)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("security_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("ts").alias("event_time"),
        (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 5000).cast("int"))).alias("available_at"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("source_version"), "event_id", "event_type", "value",
    )


BARS = """bars AS (SELECT l_suppkey AS security_id, l_shipdate AS event_time, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  (max(l_extendedprice / l_quantity) + min(l_extendedprice / l_quantity)) / 2 AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    grouped = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("security_id"), F.col("l_shipdate").alias("event_time"))
    return grouped.agg(F.max(price).alias("high"), F.min(price).alias("low"), ((F.max(price) + F.min(price)) / 2).alias("close"), F.sum("l_quantity").alias("volume")).withColumn("source_version", F.lit("sip"))


SECTORS = """sectors AS (SELECT s_suppkey AS security_id, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    # nations and regions are fixed lists of 25 and 5 rows
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("security_id"), F.col("r_name").alias("sector"))


SNAPSHOT = f"""{BARS}, {SECTORS}, newest AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY event_time DESC) = 1),
 snap AS (SELECT n.security_id, sector, close, volume FROM newest n JOIN sectors s ON n.security_id = s.security_id)"""


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each security's newest bar with its sector."""
    from tidemark.operators.asof import first_by

    newest = first_by(bars(spark, sf_dir), ["security_id"], [F.desc("event_time")])
    return newest.join(sectors(spark, sf_dir), "security_id").select("security_id", "sector", "close", "volume")


QUARTERS = """quarters AS (SELECT o_custkey AS security_id, CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS DATE) AS period_end, sum(o_totalprice) AS revenue,
  count(*) AS n FROM orders GROUP BY 1, 2)"""


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    return load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("security_id"), end.alias("period_end")).agg(F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("n"))


HISTORY = """history AS (SELECT a.agent, l.doc_id AS instance, ((l.doc_id * a.step + 13) % 97 + 1) / 98.0 AS forecast, l.quality AS outcome
  FROM labels l CROSS JOIN (VALUES ('alpha', 31), ('beta', 57), ('gamma', 31 * 2)) AS a(agent, step) WHERE l.quality IS NOT NULL)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of three agents on each labelled document."""
    agents = F.explode(F.array(*(F.struct(F.lit(a).alias("agent"), F.lit(s).alias("step")) for a, s in (("alpha", 31), ("beta", 57), ("gamma", 62)))))
    l = load(spark, sf_dir, "labels").filter(F.col("quality").isNotNull()).withColumn("a", agents)
    return l.select(F.lit(21).alias("horizon"), "a.agent", F.col("doc_id").alias("instance"), (((F.col("doc_id") * F.col("a.step") + 13) % 97 + 1) / F.lit(98.0)).alias("forecast"), F.col("quality").alias("outcome"))
