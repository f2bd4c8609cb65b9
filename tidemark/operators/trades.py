"""Trade eligibility by condition codes, and reference prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import first_by

# What each sale condition does to the consolidated last price: yes, no, first (only if it is the first or only
# qualifying trade), first3 (and more that isn't known here), open (the specification leaves it open).
# Tapes A and B, then tape C; from the public consolidated-tape specifications. Fixed values.
TAPE_AB = {
    " ": "yes", "B": "no", "C": "no", "E": "yes", "F": "yes", "H": "no", "I": "no", "K": "yes", "L": "first3", "M": "no", "N": "no", "O": "yes", "P": "first",
    "Q": "no", "R": "no", "T": "no", "U": "no", "V": "no", "X": "yes", "Z": "first", "4": "first", "5": "yes", "6": "yes", "7": "no", "8": "no", "9": "yes",
}
TAPE_C = {
    "@": "yes", "A": "yes", "B": "yes", "C": "no", "D": "yes", "E": "open", "F": "yes", "G": "first", "H": "no", "I": "no", "K": "yes", "L": "yes", "M": "no",
    "N": "no", "O": "yes", "P": "first", "Q": "no", "R": "no", "S": "yes", "T": "no", "U": "no", "V": "no", "W": "no", "X": "yes", "Y": "yes", "Z": "first",
    "1": "yes", "4": "first", "5": "yes", "6": "yes", "7": "no", "8": "open", "9": "yes",
}


def _table(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in entries.items() for x in kv))


def code_effects(tape: Column, codes: Column, provider_map: dict[tuple[str, str], tuple[str, bool]]) -> Column:
    """The effect of each provider code: provider_map gives (specification code, validated) of (tape, code)."""
    spec = F.create_map(*(F.lit(x) for (t, c), (s, ok) in provider_map.items() for x in (f"{t}:{c}", s if ok else "\0unvalidated")))

    def effect(code: Column) -> Column:
        found = F.try_element_at(spec, F.concat_ws(":", tape, code))
        own = F.when(tape == "C", F.try_element_at(_table(TAPE_C), found)).otherwise(F.try_element_at(_table(TAPE_AB), found))
        return F.when(found.isNull(), "unknown").when(found == "\0unvalidated", "unvalidated").when(own.isNull() | (own == "open"), "unknown").otherwise(own)

    return F.transform(codes, effect)


def condition_verdict(effects: Column) -> tuple[Column, Column, Column]:
    """(status, reason, needs_more): all codes must qualify; any no disqualifies, then doubt, then a first-only code."""
    has = lambda e: F.array_contains(effects, e)
    nothing = F.size(effects) <= 0
    status = (
        F.when(nothing, "unknown").when(has("no"), "ineligible").when(has("unknown") | has("unvalidated"), "unknown")
        .when(has("first") | has("first3"), "conditional").otherwise("eligible")
    )
    reason = F.when(status == "unknown", F.when(nothing | has("unknown"), "unknown_condition").otherwise("mapping_unvalidated"))
    return status, reason, has("first3")


def sequence_verdicts(trades: DataFrame, group: Sequence[str] = ("symbol", "session_date")) -> DataFrame:
    """trades (group, time, status, reason, needs_more) with kind (qualifies, not, unknown) and why.

    A conditional trade qualifies if no earlier one did. Trades of one instant can't be ordered: they see
    only what came strictly before. A group is one symbol's regular session.
    """
    w = Window.partitionBy(*group).orderBy("_at")
    before = w.rangeBetween(Window.unboundedPreceding, -1)
    instant = Window.partitionBy(*group, "_at")
    timed = trades.withColumn("_at", F.unix_micros(F.col("time").cast("timestamp")))
    others = F.count_if(F.col("status") != "ineligible").over(instant) - (F.col("status") != "ineligible").cast("int")
    timed = timed.withColumn("_tied", others > 0)
    # A conditional trade can be the first qualifying one only if nothing before it qualified or was in doubt,
    # so the first instant that holds a trade that isn't ineligible settles what conditional ones find before them.
    plain = F.coalesce(F.max(F.col("status") == "eligible").over(before), F.lit(False))
    doubt = F.coalesce(F.max(F.col("status") == "unknown").over(before), F.lit(False))
    conditional = F.col("status") == "conditional"
    timed = timed.withColumn("_plain", plain).withColumn("_doubt", doubt)
    alone = conditional & ~F.col("_plain") & ~F.col("_tied") & ~F.col("_doubt")
    earlier_alone = F.coalesce(F.max(F.col("_alone")).over(before), F.lit(False))
    tied_doubt = F.coalesce(F.max(F.col("_conditional_tied")).over(before), F.lit(False))
    timed = timed.withColumn("_conditional_tied", conditional & ~F.col("_plain") & F.col("_tied"))
    timed = timed.withColumn("_in_doubt", F.col("_doubt") | tied_doubt).withColumn("_alone", alone & ~tied_doubt)
    qualified = F.col("_plain") | earlier_alone
    timed = timed.withColumn("_qualified", qualified)
    kind = (
        F.when(F.col("status") == "eligible", "qualifies").when(F.col("status") == "ineligible", "not").when(F.col("status") == "unknown", "unknown")
        .when(F.col("_qualified"), F.when(F.col("needs_more"), "unknown").otherwise("not"))
        .when(F.col("_tied") | F.col("_in_doubt"), "unknown").otherwise("qualifies")
    )
    why = F.when(F.col("status") == "unknown", F.col("reason")).when(F.col("_qualified"), "unknown_condition").when(F.col("_tied"), "ambiguous_order").otherwise("unknown_condition")
    return timed.withColumn("kind", kind).withColumn("why", F.when(F.col("kind") == "unknown", why)).drop("_at", "_tied", "_plain", "_doubt", "_conditional_tied", "_in_doubt", "_alone", "_qualified")


def reference_price(verdicts: DataFrame, direction: str, group: Sequence[str] = ("symbol", "session_date")) -> DataFrame:
    """group, status, price, trade_time, reason: the latest (backward) or first (forward) deciding instant.

    An instant decides if a trade of it qualifies or is in doubt; any doubt leaves it unresolved, and so do
    unequal prices.
    """
    instants = verdicts.filter(F.col("kind") != "not").groupBy(*group, "time").agg(
        F.min(F.when(F.col("kind") == "unknown", F.col("why"))).alias("doubt"), F.min("price").alias("lo"), F.max("price").alias("hi")
    )
    order = F.desc("time") if direction == "backward" else F.asc("time")
    decided = first_by(instants, list(group), [order])
    reason = F.when(F.col("doubt").isNotNull(), F.col("doubt")).when(F.col("lo") != F.col("hi"), "ambiguous_order")
    every = verdicts.select(*group).distinct()
    out = every.join(decided.withColumn("reason", reason), list(group), "left")
    resolved = F.col("time").isNotNull() & F.col("reason").isNull()
    return out.select(
        *group, F.when(resolved, "resolved").otherwise("unresolved").alias("status"), F.when(resolved, F.col("lo")).alias("price"),
        F.when(resolved, F.col("time")).alias("trade_time"), F.when(~resolved, F.coalesce("reason", F.lit("no_eligible_trade"))).alias("reason"),
    )


def regular_until(trades: DataFrame, sessions: DataFrame, until: str) -> DataFrame:
    """trades of each regular session from its open to the session's column until."""
    joined = trades.join(sessions.select("session_date", "open_at", until), "session_date")
    return joined.filter((F.col("time") >= F.col("open_at")) & (F.col("time") <= F.col(until))).drop("open_at", until)


def compare_conditions(mapped: DataFrame, live: DataFrame) -> DataFrame:
    """tape, code, kind: live codes without a mapping, names that differ, and mapped codes that aren't live."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    both = mapped.withColumn("_m", F.lit(1)).join(live.withColumn("_l", F.lit(1)), ["tape", "code"], "full_outer")
    kind = F.when(F.col("_m").isNull(), "unmapped_live_code").when(F.col("_l").isNull(), "missing_live_code").when(plain(F.col("expected_name")) != plain(F.col("name")), "name_mismatch")
    return both.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("tape", "code", "kind")
