"""Trading calendars, session steps and vintage rates.

A calendar is known only inside confirmed coverage: stepping over an uncovered day gives null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import canonical_utc, exchange_date, iso_week
from tidemark.operators.asof import asof_join, first_by


def session_line() -> Column:
    return F.concat_ws("|", F.col("session_date").cast("string"), canonical_utc(F.col("open_at")), canonical_utc(F.col("close_at")), "source_version")


def set_digest(lines: Column) -> Column:
    """SHA-256 of the distinct or repeated lines in order, joined by line feeds. A calendar's or symbol list's size."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), "\n"), 256)


def calendar_digest(sessions: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("session_date", "source_version", session_line().alias("line"))))
    return sessions.groupBy(*group).agg(F.count(F.lit(1)).alias("session_count"), F.sha2(F.array_join(F.transform(ordered, lambda r: r.line), "\n"), 256).alias("sessions_sha256"))


def newest_coverage(coverage: DataFrame) -> DataFrame:
    return first_by(coverage, ["source", "range_start", "range_end"], [F.desc("available_at"), F.desc("source_version")])


def coverage_faults(sessions: DataFrame, coverage: DataFrame) -> DataFrame:
    """Newest coverage rows whose count or digest is not that of the session versions visible when they were written."""
    own = newest_coverage(coverage).select("source", "range_start", "range_end", F.col("available_at").alias("covered_at"), F.col("session_count").alias("stated_count"), F.col("sessions_sha256").alias("stated_sha256"))
    # ranges are a handful: each session goes to those that hold it
    held = own.join(sessions, (F.col("session_date") >= F.col("range_start")) & (F.col("session_date") <= F.col("range_end")) & (F.col("available_at") <= F.col("covered_at")), "left")
    key = ["source", "range_start", "range_end"]
    newest = first_by(held, [*key, "session_date"], [F.desc("available_at"), F.desc("source_version")])
    present = newest.filter(F.col("session_date").isNotNull())
    found = own.join(calendar_digest(present, key), key, "left")
    empty = F.sha2(F.lit(""), 256)
    return found.filter((F.coalesce("session_count", F.lit(0)) != F.col("stated_count")) | (F.coalesce("sessions_sha256", empty) != F.col("stated_sha256")))


def revised_without_coverage(sessions: DataFrame, coverage: DataFrame) -> DataFrame:
    """Covered dates whose newest session version is newer than every coverage row over them."""
    newest = sessions.groupBy("session_date").agg(F.max("available_at").alias("revised_at"))
    own = newest_coverage(coverage).select("range_start", "range_end", F.col("available_at").alias("covered_at"))
    held = newest.join(own, (F.col("session_date") >= F.col("range_start")) & (F.col("session_date") <= F.col("range_end")))
    return held.groupBy("session_date", "revised_at").agg(F.max("covered_at").alias("covered_at")).filter("covered_at < revised_at")


def build_calendar(sessions: DataFrame, coverage: DataFrame) -> DataFrame:
    """Each covered date's newest session version. Raise on coverage_faults and revised_without_coverage before use."""
    newest = first_by(sessions, ["session_date"], [F.desc("available_at"), F.desc("source_version")])
    own = newest_coverage(coverage).select("range_start", "range_end")
    return newest.join(own, (F.col("session_date") >= F.col("range_start")) & (F.col("session_date") <= F.col("range_end")), "left_semi")


def merged_ranges(coverage: DataFrame) -> DataFrame:
    """Ranges (range_start, range_end) that touch or overlap joined to islands."""
    w = Window.orderBy("range_start", "range_end")
    ended = F.max("range_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = coverage.select("range_start", "range_end").distinct().withColumn("_new", F.coalesce(F.col("range_start") > F.date_add(ended, 1), F.lit(True)).cast("int"))
    return marked.withColumn("_island", F.sum("_new").over(w)).groupBy("_island").agg(F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end")).drop("_island")


def step_sessions(sessions: DataFrame, coverage: DataFrame, steps: int) -> DataFrame:
    """session_date, target: the session that many steps later (negative: earlier), null where any day between is uncovered.

    A calendar has a row for each day of some decades, so one ordered window over it is small by nature.
    """
    w = Window.orderBy("session_date")
    days = sessions.select("session_date").distinct()
    target = (F.lead("session_date", steps) if steps >= 0 else F.lag("session_date", -steps)).over(w)
    islands = merged_ranges(coverage).agg(F.collect_list(F.struct("range_start", "range_end"))).scalar()
    stepped = days.withColumn("_target", target).withColumn("_islands", islands)
    lo, hi = F.least("session_date", "_target"), F.greatest("session_date", "_target")
    whole = F.exists("_islands", lambda r: (r.range_start <= lo) & (hi <= r.range_end))
    return stepped.select("session_date", F.when(whole, F.col("_target")).alias("target"))


def week_final(sessions: DataFrame) -> DataFrame:
    """sessions with is_week_final: the next session lies in another ISO week. The last known session is undecided (null)."""
    after = F.lead("session_date").over(Window.orderBy("session_date"))
    return sessions.withColumn("is_week_final", iso_week(after) != iso_week(F.col("session_date")))


def with_execution_window(runs: DataFrame, sessions: DataFrame, as_of: str = "as_of", delay: str = "30 minutes") -> DataFrame:
    """runs with window_start and window_end: the next session after as_of's exchange date, from delay after its open to its close."""
    table = sessions.agg(F.array_sort(F.collect_list(F.struct("session_date", "open_at", "close_at")))).scalar()
    day = exchange_date(F.col(as_of))
    later = F.try_element_at(F.filter("_sessions", lambda s: s.session_date > day), F.lit(1))
    found = runs.withColumn("_sessions", table).withColumn("_next", later)
    return found.withColumn("window_start", F.col("_next.open_at") + F.expr(f"interval {delay}")).withColumn("window_end", F.col("_next.close_at")).drop("_sessions", "_next")


def window_state(now: Column, start: Column, end: Column) -> Column:
    return F.when(now < start, "early").when(now < end, "open").otherwise("expired")


def select_rates(accruals: DataFrame, rates: DataFrame, coverage: DataFrame, previous: DataFrame) -> DataFrame:
    """accruals (series, accrual_date) with the rate known before that date, or the reason why there is none.

    previous (session_date, target) gives the session before each date. Of the observations up to it the
    newest counts, in its newest vintage strictly before the accrual date.
    """
    asked = accruals.join(coverage.groupBy("series").agg(F.max_by("earliest_vintage", "established_at").alias("earliest_vintage")), "series", "left").join(previous.select(F.col("session_date").alias("accrual_date"), F.col("target").alias("previous_session")), "accrual_date", "left")
    # a rate counts from the first accrual date after its vintage whose previous session has reached it: one date,
    # as both grow with the accrual date, so the newest rate is a running value over both in order of date
    steps = previous.filter("target is not null").select("session_date", "target")
    seen = asof_join(rates.select("observation_date").distinct().withColumn("_k", F.lit(1)), steps.withColumn("_k", F.lit(1)), ["_k"], "observation_date", "target", ["session_date"], "forward")
    starts = rates.join(seen.select("observation_date", F.col("session_date").alias("_reached")), "observation_date").filter("_reached is not null")
    rate = F.struct("observation_date", "vintage_date", "yield_pct")
    known = starts.select("series", F.greatest(F.date_add("vintage_date", 1), "_reached").alias("_at"), rate.alias("_rate"), F.lit(None).cast("date").alias("accrual_date"))
    marks = asked.select("series", F.col("accrual_date").alias("_at"), F.lit(None).cast(known.schema["_rate"].dataType).alias("_rate"), "accrual_date").distinct()
    running = Window.partitionBy("series").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    best = known.unionByName(marks).withColumn("_rate", F.max("_rate").over(running)).filter("accrual_date is not null").select("series", "accrual_date", "_rate")
    reason = (
        F.when(F.col("earliest_vintage").isNull(), "no_vintage_coverage")
        .when(F.col("accrual_date") <= F.col("earliest_vintage"), "before_earliest_vintage")
        .when(F.col("previous_session").isNull(), "calendar_uncovered")
        .when(F.col("_rate").isNull(), "no_usable_rate")
    )
    return asked.join(best, ["series", "accrual_date"], "left").withColumn("reason", reason).select("series", "accrual_date", "reason", *(F.when(F.col("reason").isNull(), F.col(f"_rate.{c}")).alias(c) for c in ("observation_date", "vintage_date", "yield_pct")))


#: Run states before a commitment, and order states that are final. Fixed values.
STARTED = ("PENDING", "INGEST_OK", "FEATURES_OK", "GATED", "AGENTS_OK")


def work_queue(runs: DataFrame, orders: DataFrame, sessions: DataFrame, now: Column, final: Sequence[str], stale_after: str = "45 minutes") -> DataFrame:
    """run_id, task: what is to be done again after a crash, from the stored state alone.

    Live runs advance when committed, or unfinished for stale_after; anchored ones execute while their window
    is open; every run with an order that isn't final is reconciled.
    """
    live = with_execution_window(runs.filter(F.col("mode") == "live"), sessions)
    stale = F.col("status").isin(*STARTED) & (now >= F.col("started_at") + F.expr(f"interval {stale_after}"))
    is_open = window_state(now, F.col("window_start"), F.col("window_end")) == "open"
    task = F.when(stale | (F.col("status") == "COMMITTED"), "advance").when((F.col("status") == "ANCHORED") & F.col("window_end").isNotNull() & is_open, "execute")
    working = orders.filter(~F.col("status").isin(*final)).select("run_id").distinct().withColumn("task", F.lit("reconcile"))
    return live.select("run_id", task.alias("task")).filter("task is not null").unionByName(working)
