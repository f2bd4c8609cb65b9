"""Column expressions for instants, exchange time and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXCHANGE = "America/New_York"


def at_exchange(day: Column, clock: str) -> Column:
    """The instant at which exchange clocks show the time on the day."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.lit(clock))), EXCHANGE)


def exchange_date(instant: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, EXCHANGE))


def session_close(day: Column) -> Column:
    return at_exchange(day, "16:00:00")


def end_of_day(day: Column) -> Column:
    return at_exchange(day, "23:59:59")


def snapshot_time(day: Column) -> Column:
    return at_exchange(day, "23:59:00")


def parse_utc(text: Column) -> Column:
    """An RFC 3339 text with a zone, cut to microseconds; null where there is no zone."""
    cut = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(cut))


def parse_acceptance(text: Column) -> Column:
    """Filing acceptance stamps hold exchange digits, whatever their zone says; whole seconds."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", 1)), EXCHANGE)


def parse_compact_exchange(text: Column) -> Column:
    """20240102T133000 in exchange time."""
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss")), EXCHANGE)


def canonical_utc(instant: Column) -> Column:
    """2024-01-02T03:04:05.000006+00:00, in a session whose zone is UTC."""
    return F.concat(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def elapsed_seconds(later: Column, earlier: Column) -> Column:
    """Exact seconds between two instants, as a double; microseconds count."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def relative_days(instant: Column, as_of: Column) -> Column:
    """t-Nd in whole days before as_of; null for an instant after it, which would be look-ahead."""
    seconds = elapsed_seconds(as_of, instant)
    return F.when(seconds >= 0, F.concat(F.lit("t-"), F.floor(seconds / 86_400).cast("string"), F.lit("d")))


def quarter_number(day: Column) -> Column:
    return F.year(day) * 4 + F.quarter(day)


def fiscal_index(period_end: Column, as_of: Column, oldest: int = 20) -> Column:
    """Q-1 is the latest completed quarter, and a period that ends in the running one; null if later or too old."""
    behind = F.greatest(F.lit(1), quarter_number(as_of) - quarter_number(period_end))
    usable = (period_end <= F.to_date(as_of)) & (behind <= oldest)
    return F.when(usable, F.concat(F.lit("Q-"), behind.cast("string")))


def last_weekday(day: Column) -> Column:
    """The last Monday to Friday of the day's month."""
    end = F.last_day(day)
    back = F.greatest(F.lit(0), F.weekday(end) - 4)
    return F.date_sub(end, back)


def month_ends(spark: SparkSession, start: str, end: str) -> DataFrame:
    """snapshot_date: each month's last weekday within [start, end]."""
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.to_date(F.lit(start)), "month"), F.to_date(F.lit(end)), F.expr("interval 1 month"))).alias("month"))
    day = last_weekday(F.col("month"))
    return months.select(day.alias("snapshot_date")).filter((F.col("snapshot_date") >= F.to_date(F.lit(start))) & (F.col("snapshot_date") <= F.to_date(F.lit(end))))


def weekly_steps(spark: SparkSession, start: str, end: str, days: int = 7) -> DataFrame:
    steps = F.sequence(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)), F.expr(f"interval {days} days"))
    return spark.range(1).select(F.explode(steps).alias("as_of"))


def iso_week(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)


def is_quarterly(period_start: Column, period_end: Column, least: int = 80, most: int = 100) -> Column:
    """Instants count, and spans of 80 to 100 days."""
    return period_start.isNull() | F.datediff(period_end, period_start).between(least, most)
