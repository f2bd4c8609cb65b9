"""Hashes of canonical records, scorability and order records."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from datetime import UTC, date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(value: object) -> object:
    """JSON values with sorted keys in mind: instants in UTC to the microsecond; floats must be finite."""
    if isinstance(value, dict):
        return {str(k): canonical(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    if isinstance(value, datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=UTC)
        return value.astimezone(UTC).isoformat(timespec="microseconds")
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("a committed number must be finite")
    return value


def canonical_bytes(value: object) -> bytes:
    return json.dumps(canonical(value), sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode("ascii")


COMMITMENT = "group string, sha256 string"


def commitments(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The group column as text and sha256 of the group's rows in canonical JSON in order. A group is one run's book; floats are written as
    shortest round-trip decimals, which built-in JSON writers don't do alike."""
    columns = [c for c in rows.columns if c != group]

    def digest(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values(list(order), kind="stable")
        records = [{c: _plain(v) for c, v in zip(columns, r, strict=True)} for r in ordered[columns].itertuples(index=False, name=None)]
        return pd.DataFrame([{"group": str(frame[group].iloc[0]), "sha256": hashlib.sha256(canonical_bytes({"run": str(frame[group].iloc[0]), "rows": records})).hexdigest()}])

    return rows.groupBy(group).applyInPandas(digest, COMMITMENT).withColumnRenamed("group", group)


def _plain(v: object) -> object:
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    return v.item() if hasattr(v, "item") else v


def verify_commitments(stored: DataFrame, rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Stored (group, sha256) rows that differ from the rows' digest, or have no rows."""
    now = commitments(rows, group, order).withColumnRenamed("sha256", "found")
    return stored.join(now, group, "left").filter(~F.col("sha256").eqNullSafe(F.col("found")))


#: Statuses in which a run of a mode is complete. Fixed values.
COMPLETE = {"live": ("EXECUTED", "SCORED"), "backtest": ("ANCHORED", "SCORED"), "ablation": ("ANCHORED", "SCORED")}
_COMPLETE = " or ".join(f"(mode = '{m}' and status in {s})" for m, s in COMPLETE.items())
_HALTED = "(status = 'PARTIAL' and startswith(status_reason, 'kill_switch'))"
#: Reasons to refuse a run's score, in order of precedence: (name, condition over the evidence columns). Fixed order.
REFUSALS = (
    ("evidence_unavailable", "read_failed"),
    ("run_missing", "status is null"),
    ("no_commitment", "commitment_sha256 is null"),
    ("halt_evidence_missing", f"{_HALTED} and kill_events = 0"),
    ("not_scorable_status", f"not ({_COMPLETE}) and not coalesce({_HALTED}, false)"),
    ("material_incomplete", "defects > 0 or not has_snapshot"),
    ("commitment_mismatch", "not (commitment_sha256 <=> material_sha256)"),
    ("anchor_missing", "anchor_sha256 is null or not has_proof or git_commit is null"),
    ("anchor_invalid", "anchor_sha256 <> material_sha256 or not proof_binds"),
    ("ots_not_confirmed", "not proof_confirmed"),
    ("header_verification_failed", "not header_verified"),
    ("git_unreachable", "not git_reachable"),
    ("anchor_timing", "committed_at > anchored_at or anchored_at > requested_at or block_time > requested_at or (mode = 'live' and (earliest_resolution_at is null or block_time >= earliest_resolution_at))"),
)


def scorability(evidence: DataFrame) -> DataFrame:
    """evidence with refusal: the first reason that holds, or null for a run that may be scored."""
    refusal = F.lit(None).cast("string")
    for name, condition in reversed(REFUSALS):
        refusal = F.when(F.coalesce(F.expr(condition), F.lit(False)), F.lit(name)).otherwise(refusal)
    return evidence.withColumn("refusal", refusal)


def valid_backtest(as_of: Column, cutoff: Column, buffer_days: int) -> Column:
    """A model's forecast of a past date counts only if the date lies beyond its training cutoff and a buffer."""
    return F.to_date(as_of) > F.date_add(F.to_date(cutoff), buffer_days)


def unprovided_evidence(cited: Column, provided: Column) -> Column:
    return F.array_sort(F.array_except(cited, provided))


#: Columns of an order that may change after it was placed. Fixed values.
MUTABLE = ("status", "filled_qty", "avg_fill_price", "broker_order_id", "updated_at", "reject_reason")


def changed_orders(stored: DataFrame, now: DataFrame, mutable: Sequence[str] = MUTABLE) -> DataFrame:
    """Orders of which a mutable column differs, in their new state."""
    own = [c for c in mutable if c in stored.columns and c in now.columns]
    joined = stored.alias("s").join(now.alias("n"), "client_order_id")
    differs = F.lit(False)
    for c in own:
        differs = differs | ~F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}"))
    return joined.filter(differs).select("client_order_id", *(F.col(f"n.{c}").alias(c) for c in own))


def capture_state(required: DataFrame, written: DataFrame, committed_at: Column, now: Column, deadline: Column) -> DataFrame:
    """run_id, symbol, state: what is missing is deferred until the deadline and uncovered after it; then whole runs are complete."""
    joined = required.join(written.select("run_id", "symbol", F.lit(True).alias("_w")).distinct(), ["run_id", "symbol"], "left")
    state = F.when(F.col("_w"), "written").when(now < committed_at, "early").when(now <= deadline, "deferred").otherwise("uncovered")
    return joined.withColumn("state", state).drop("_w")


def symbol_set(*sources: DataFrame) -> DataFrame:
    """run_id, symbols: the sorted distinct union, trimmed and upper-cased, without empty ones."""
    union = sources[0].select("run_id", "symbol")
    for s in sources[1:]:
        union = union.unionByName(s.select("run_id", "symbol"))
    plain = union.select("run_id", F.upper(F.trim("symbol")).alias("symbol")).filter("symbol <> ''").distinct()
    return plain.groupBy("run_id").agg(F.array_sort(F.collect_list("symbol")).alias("symbols"))
