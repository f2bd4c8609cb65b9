"""Outcomes of verdicts, filled in as their horizons end, and agents' scores from them.

An outcome is known from the instant at which both its prices are. Each step looks at the verdicts that have no outcome
yet and at those whose prices were revised since the last step, and adds rows; nothing is ever changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import first_by, latest_version

KEY = ("run_id", "security_id", "horizon")
OUTCOME = "run_id string, security_id long, horizon int, entry_day date, end_day date, ret double, resolved_at timestamp_ntz, revision_id string"


def horizon_ends(verdicts: DataFrame, sessions: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """verdicts (run_id, security_id, entry_day) with horizon and end_day, the session that many after the entry's.

    sessions (session_date, number) numbers the sessions without gaps. Pairs whose end the calendar lacks are left out.
    """
    asked = verdicts.join(sessions.select(F.col("session_date").alias("entry_day"), F.col("number").alias("_from")), "entry_day").withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    ends = sessions.select(F.col("session_date").alias("end_day"), F.col("number").alias("_to"))
    return asked.withColumn("_to", F.col("_from") + F.col("horizon")).join(ends, "_to").drop("_from", "_to")


def newly_resolved(stored: DataFrame, pairs: DataFrame, prices: DataFrame, since: Column | None, as_of: Column) -> DataFrame:
    """Rows of OUTCOME to append: pairs that have become computable by as_of, and revised ones.

    stored holds what earlier steps appended, the last of them at since (null: none was). prices (security_id, day,
    close, available_at, source_version) are versions. A pair is looked at only if it has no outcome, or if a version of one of
    its prices became visible in (since, as_of]; a revision that changes nothing adds no row.
    """
    seen = latest_version(prices, ["security_id", "day"], as_of).filter(F.col("close") > 0)
    price = lambda d, name: seen.select("security_id", F.col("day").alias(d), F.col("close").alias(name), F.col("available_at").alias(f"{name}_at"))
    joined = pairs.join(price("entry_day", "_p0"), ["security_id", "entry_day"]).join(price("end_day", "_p1"), ["security_id", "end_day"])
    made = joined.select(*KEY, "entry_day", "end_day", (F.col("_p1") / F.col("_p0") - 1).alias("ret"), F.greatest("_p0_at", "_p1_at").alias("resolved_at"), F.sha2(F.concat_ws("|", "run_id", F.col("security_id").cast("string"), F.col("horizon").cast("string"), F.col("_p0").cast("string"), F.col("_p1").cast("string")), 256).alias("revision_id"))
    # a pair's revisions are few; of a day's visible versions the newest tells whether one came after since, so resolved_at does for both days
    known = stored.groupBy(*KEY).agg(F.collect_set("revision_id").alias("_known"))
    fresh = F.col("_known").isNull()
    if since is not None:
        fresh = fresh | ((F.col("resolved_at") > since) & ~F.array_contains("_known", F.col("revision_id")))
    return made.join(known, list(KEY), "left").filter(fresh).drop("_known")


def append_resolved(store, pairs: DataFrame, prices: DataFrame, since: Column | None, as_of: Column, name: str = "outcomes") -> int:
    """newly_resolved rows committed to a store; how many there were. A repeated step appends nothing."""
    from tidemark.sources.writes import append_new

    stored = store.read(name, OUTCOME)
    return append_new(store, name, newly_resolved(stored, pairs, prices, since, as_of).select(*(c.split()[0] for c in OUTCOME.split(", "))), [*KEY, "revision_id"])


def resolved_outcomes(outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Of each pair the newest revision resolved by as_of."""
    return first_by(outcomes.filter(F.col("resolved_at") <= as_of), list(KEY), [F.desc("resolved_at"), F.desc("revision_id")])


def agent_scores(outcomes: DataFrame, forecasts: DataFrame, hit: Column, as_of: Column) -> DataFrame:
    """agent, horizon, n, brier, base_rate, hit_rate from the outcomes that are resolved by as_of.

    forecasts (agent, run_id, security_id, horizon, p); hit says whether an outcome is a success.
    """
    scored = resolved_outcomes(outcomes, as_of).withColumn("_y", hit.cast("double")).join(forecasts, list(KEY))
    right = ((F.col("p") >= 0.5) == (F.col("_y") == 1)).cast("double")
    return scored.groupBy("agent", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("p") - F.col("_y"), F.lit(2.0))).alias("brier"), F.avg("_y").alias("base_rate"), F.avg(right).alias("hit_rate"))
