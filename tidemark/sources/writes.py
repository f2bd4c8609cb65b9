"""Append-only, conflict-checked and merged writes to tables of Parquet files.

A table is a folder of committed batches: `_manifest` lists them by one small file for each commit, and
readers take only listed batches, so a commit of several tables shows whole or not at all. There is one
writer at a time, as with any plain-file table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns that say when a row was written and not what it says. Fixed values.
WRITE_TIME = ("ingested_at", "written_at", "updated_at", "available_at")


class ConflictError(ValueError):
    """An immutable key came again with another payload."""


class Store:
    """Named tables under one folder of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def batches(self, name: str) -> list[str]:
        """Committed batch folders of a table, the oldest first."""
        listed = self._manifest()
        if listed is None:
            return []
        return [r.batch for r in listed.filter(F.col("name") == name).orderBy("at", "batch").collect()]

    def _manifest(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema("name string, batch string, at timestamp, replaces boolean").json(f"{self.root}/_manifest")

    def read(self, name: str, schema: StructType | str) -> DataFrame:
        """All committed rows; an empty table before the first commit."""
        listed = self._manifest()
        if listed is None:
            return self.spark.createDataFrame([], schema)
        rows = listed.filter(F.col("name") == name).orderBy("at", "batch").collect()
        last = max((k for k, r in enumerate(rows) if r.replaces), default=0)
        paths = [f"{self.root}/{name}/{r.batch}" for r in rows[last:]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, tables: dict[str, DataFrame], replace: Sequence[str] = ()) -> None:
        """Write all tables' batches, then list them in one manifest file."""
        entries = []
        for name, df in tables.items():
            batch = f"batch={uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{name}/{batch}")
            entries.append((name, batch, name in replace))
        made = self.spark.createDataFrame(entries, "name string, batch string, replaces boolean").withColumn("at", F.current_timestamp())
        made.coalesce(1).write.mode("append").json(f"{self.root}/_manifest")


def new_rows(existing: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key isn't there yet, one of each key. Null key values are equal."""
    one = rows.dropDuplicates(list(key))
    known = existing.select(*(F.col(k).alias(f"_k_{k}") for k in key)).distinct()
    match = F.lit(True)
    for k in key:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return one.join(known, match, "left_anti")


def append_new(store: Store, name: str, rows: DataFrame, key: Sequence[str]) -> int:
    """Idempotent append: keys that exist are left alone. Returns how many rows were new."""
    fresh = new_rows(store.read(name, rows.schema), rows, key).persist()
    n = fresh.count()
    if n:
        store.commit({name: fresh})
    fresh.unpersist()
    return n


def conflicts(existing: DataFrame, rows: DataFrame, key: Sequence[str], write_time: Sequence[str] = WRITE_TIME) -> DataFrame:
    """Rows whose key exists, or comes twice in rows, with another payload. Columns of write time don't count."""
    payload = [c for c in rows.columns if c not in key and c not in write_time]
    both = existing.select(*key, *payload).unionByName(rows.select(*key, *payload))
    digest = F.sha2(F.to_json(F.struct(*key, *payload), {"ignoreNullFields": "false"}), 256)
    counted = both.withColumn("_digest", digest).groupBy(*key).agg(F.count_distinct("_digest").alias("payloads")).filter("payloads > 1")
    match = F.lit(True)
    for k in key:
        match = match & rows[k].eqNullSafe(counted[k])
    return rows.join(counted, match, "left_semi")


def append_immutable(store: Store, name: str, rows: DataFrame, key: Sequence[str], write_time: Sequence[str] = WRITE_TIME) -> int:
    """Exact replays change nothing, another payload under a key raises, new keys are appended."""
    existing = store.read(name, rows.schema)
    bad = conflicts(existing, rows, key, write_time).select(*key).limit(5).collect()
    if bad:
        raise ConflictError(f"{name}: stored keys with another payload, such as {[r.asDict() for r in bad]}")
    return append_new(store, name, rows, key)


def with_dedupe_key(rows: DataFrame) -> DataFrame:
    """rows with dedupe_key, the hash of their whole content."""
    return rows.withColumn("dedupe_key", F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256))


def append_by_content(store: Store, name: str, rows: DataFrame, scope: Sequence[str] = ("run_id",)) -> int:
    return append_new(store, name, with_dedupe_key(rows), [*scope, "dedupe_key"])


def merged(existing: DataFrame, changes: DataFrame, key: Sequence[str], rules: dict[str, Column] | None = None) -> DataFrame:
    """Existing rows with changes by key (one each): rules give columns from old.* and new.*, others take the new value.

    A rule is an expression over columns `old.c`, `new.c`, `old.present` and `new.present`.
    """
    rules = rules or {}
    old = existing.withColumn("present", F.lit(True)).alias("old")
    new = changes.withColumn("present", F.lit(True)).alias("new")
    match = F.lit(True)
    for k in key:
        match = match & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
    both = old.join(new, match, "full_outer")
    out = []
    for c in existing.columns:
        if c in key:
            out.append(F.coalesce(f"old.{c}", f"new.{c}").alias(c))
        else:
            plain = F.col(f"new.{c}") if c in changes.columns else F.col(f"old.{c}")
            value = F.when(F.col("new.present").isNull(), F.col(f"old.{c}")).when(F.col("old.present").isNull(), F.col(f"new.{c}") if c in changes.columns else F.lit(None)).otherwise(rules.get(c, plain))
            out.append(value.alias(c))
    return both.select(*out)


def with_new_ids(existing: DataFrame, changes: DataFrame, key: Sequence[str], id_col: str = "security_id") -> DataFrame:
    """changes with the existing id of their key, or the next free ones in order of the key. A dimension's size."""
    from pyspark.sql import Window

    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    found = changes.drop(id_col).join(existing.select(*key, id_col), list(key), "left")
    fresh = F.row_number().over(Window.partitionBy(F.col(id_col).isNull()).orderBy(*key))
    return found.withColumn(id_col, F.coalesce(F.col(id_col), (top + fresh).cast(dict(existing.dtypes)[id_col])))


def upsert_securities(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """Name, sector and industry follow the change; listings stay."""
    return merged(existing, with_new_ids(existing, changes, ["cik", "ticker"]), ["cik", "ticker"])


def widen_listing(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """listed_from becomes the earliest seen, listed_to what the change says, null too."""
    return merged(existing, changes, ["security_id"], {"listed_from": F.least(F.col("old.listed_from"), F.col("new.listed_from"))})


def record_feed_runs(health: DataFrame, attempts: DataFrame) -> DataFrame:
    """One attempt for each feed: failures keep the last success, rows add up, availability never goes back."""
    failed = F.col("new.last_error").isNotNull()
    return merged(health, attempts.withColumn("last_success_at", F.when(F.col("last_error").isNull(), F.col("updated_at"))), ["feed"], {
        "last_success_at": F.when(failed, F.col("old.last_success_at")).otherwise(F.col("new.updated_at")),
        "last_available_at": F.greatest("old.last_available_at", "new.last_available_at"),
        "rows": F.col("old.rows") + F.col("new.rows"),
    })


#: Run states from which a run never goes back, and those that would be going back. Fixed values.
ADVANCED, REGRESSIVE = ("COMMITTED", "ANCHORED", "EXECUTED", "SCORED"), ("PENDING", "PARTIAL", "FAILED")
RUN_MUTABLE = ("status", "ended_at", "status_reason", "total_cost_usd")


def upsert_runs(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """Status, end, reason and cost move forward; a committed run is never demoted, a halted one never changed."""
    halted = (F.col("old.status") == "PARTIAL") & F.coalesce(F.startswith(F.col("old.status_reason"), F.lit("kill_switch")), F.lit(False))
    blocked = (F.col("old.status").isin(*ADVANCED) & F.col("new.status").isin(*REGRESSIVE)) | halted
    rules = {c: F.when(blocked, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")) if c in RUN_MUTABLE else F.col(f"old.{c}") for c in runs.columns if c != "run_id"}
    return merged(runs, changes, ["run_id"], rules)


def advance(runs: DataFrame, run_ids: DataFrame, before: str, after: str) -> DataFrame:
    """Compare and set: runs in state before go to after."""
    marked = runs.join(run_ids.select("run_id", F.lit(True).alias("_go")).distinct(), "run_id", "left")
    return marked.withColumn("status", F.when(F.col("_go") & (F.col("status") == before), after).otherwise(F.col("status"))).drop("_go").select(*runs.columns)


#: Run states that a halt moves, and how its reason and its request are written. Fixed values.
HALTABLE, HALT_REASON, HALT_REQUEST = ("COMMITTED", "ANCHORED", "EXECUTED"), "kill_switch:", "halt_request_v1"


def halted_runs(runs: DataFrame, events: DataFrame) -> DataFrame:
    """runs after the events (run_id, trigger, triggered_at): the earliest event of a haltable run makes it PARTIAL."""
    from tidemark.operators.asof import first_by

    first = first_by(events, ["run_id"], [F.asc("triggered_at"), F.asc("trigger")]).select("run_id", F.col("trigger").alias("_why"), F.col("triggered_at").alias("_at"))
    moves = F.col("_why").isNotNull() & F.col("status").isin(*HALTABLE)
    moved = {"status": F.lit("PARTIAL"), "status_reason": F.concat(F.lit(HALT_REASON), "_why"), "ended_at": F.col("_at")}
    return runs.join(first, "run_id", "left").withColumns({c: F.when(moves, v).otherwise(F.col(c)) for c, v in moved.items()}).select(*runs.columns)


def record_halts(store: Store, runs: DataFrame, events: DataFrame) -> None:
    """The events, the requests for references that they raise, and the runs that they move, in one commit.

    Replays change nothing; a request for another instant under a known (run_id, trigger) raises.
    """
    keyed = with_dedupe_key(events)
    requests = events.select("run_id", "trigger", F.col("triggered_at").alias("tau"), F.col("triggered_at").alias("requested_at"), F.lit(HALT_REQUEST).alias("source_version"))
    known, asked = store.read("kill_switch_events", keyed.schema), store.read("halt_reference_requests", requests.schema)
    bad = conflicts(asked, requests, ["run_id", "trigger"]).limit(5).collect()
    if bad:
        raise ConflictError(f"halt_reference_requests: stored keys with another payload, such as {[r.asDict() for r in bad]}")
    store.commit({
        "kill_switch_events": new_rows(known, keyed, ["run_id", "dedupe_key"]), "halt_reference_requests": new_rows(asked, requests, ["run_id", "trigger"]),
        "runs": halted_runs(runs, events),
    }, replace=["runs"])


def upsert_anchors(anchors: DataFrame, changes: DataFrame) -> DataFrame:
    """New values where there are any. Raise on anchor_mismatches first."""
    return merged(anchors, changes, ["run_id"], {c: F.coalesce(f"new.{c}", f"old.{c}") for c in changes.columns if c != "run_id"})


def anchor_mismatches(anchors: DataFrame, changes: DataFrame) -> DataFrame:
    return anchors.select("run_id", F.col("sha256").alias("_was")).join(changes, "run_id").filter(F.col("_was") != F.col("sha256")).select("run_id")


def upsert_orders(orders: DataFrame, changes: DataFrame, mutable: Sequence[str]) -> DataFrame:
    rules = {c: F.col(f"old.{c}") for c in orders.columns if c not in mutable and c != "client_order_id"}
    return merged(orders, changes, ["client_order_id"], rules)


def claim_run(runs: DataFrame, mode: str, as_of: Column, config_hash: str) -> DataFrame:
    """The newest run of (mode, as_of, config) that didn't fail, with halted; no row if a new one may start."""
    from tidemark.operators.asof import first_by

    own = runs.filter((F.col("mode") == mode) & (F.col("as_of") == as_of) & (F.col("config_hash") == config_hash) & (F.col("status") != "FAILED"))
    halted = (F.col("status") == "PARTIAL") & F.coalesce(F.startswith("status_reason", F.lit("kill_switch")), F.lit(False))
    return first_by(own, ["mode"], [F.desc("started_at"), F.desc("run_id")]).withColumn("halted", halted)


def reset_archive(run_id: str, tables: dict[str, DataFrame]) -> DataFrame:
    """One row: the run's rows of each table as JSON, to be stored before they go. A run's rows are few."""
    out = None
    for name, df in tables.items():
        own = df.filter(F.col("run_id") == run_id).agg(F.array_sort(F.collect_list(F.to_json(F.struct(*df.columns)))).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = own if out is None else out.unionByName(own)
    return out.agg(F.map_from_entries(F.collect_list(F.struct("name", "rows"))).alias("archive")).select(F.lit(run_id).alias("run_id"), "archive")


def reset_refusals(run_id: str, evidence: dict[str, DataFrame]) -> list[str]:
    """Names of evidence tables that hold the run and so forbid a reset."""
    return [name for name, df in evidence.items() if not df.filter(F.col("run_id") == run_id).limit(1).isEmpty()]


def range_faults(sessions: DataFrame, coverage: DataFrame) -> DataFrame:
    """Coverage rows of a batch whose sessions lie outside the range, have another stamp, or another digest."""
    from tidemark.operators.calendars import calendar_digest

    found = calendar_digest(sessions).withColumnsRenamed({"session_count": "_n", "sessions_sha256": "_d"})
    span = sessions.agg(F.min("session_date").alias("_lo"), F.max("session_date").alias("_hi"), F.count_distinct("available_at").alias("_stamps"), F.max("available_at").alias("_at"))
    one = coverage.withColumn("_one", F.lit(1)).join(found.withColumn("_one", F.lit(1)), "_one", "left").join(span.withColumn("_one", F.lit(1)), "_one", "left")
    bad = (F.col("_n") != F.col("session_count")) | (F.col("_d") != F.col("sessions_sha256")) | (F.col("_lo") < F.col("range_start")) | (F.col("_hi") > F.col("range_end")) | (F.col("_stamps") > 1) | (F.col("_at") != F.col("available_at"))
    return one.filter(bad).select(*coverage.columns)


def insert_calendar_range(store: Store, sessions: DataFrame, coverage: DataFrame) -> None:
    """Sessions and the coverage that describes them, in one commit."""
    if not range_faults(sessions, coverage).isEmpty():
        raise ConflictError("the coverage does not describe its sessions")
    have = store.read("trading_calendar", sessions.schema), store.read("calendar_coverage", coverage.schema)
    keys = ["session_date", "source_version"], ["source", "range_start", "range_end", "source_version"]
    for old, new, key in zip(have, (sessions, coverage), keys, strict=True):
        if not conflicts(old, new, key).isEmpty():
            raise ConflictError(f"stored rows differ under {key}")
    store.commit({"trading_calendar": new_rows(have[0], sessions, keys[0]), "calendar_coverage": new_rows(have[1], coverage, keys[1])})


#: Row checks by table: rows that fail are set apart. Fixed rules.
CHECKS = {
    "price_bars": "open > 0 and high >= greatest(open, close, low) and low <= least(open, close) and low > 0 and volume >= 0 and source_version = feed",
    "fundamentals_asfiled": "period_start is null or period_start <= period_end",
    "insider_txns": "shares >= 0 and (price is null or price >= 0) and source_version = accession",
    "trading_calendar": "open_at < close_at and event_time = open_at",
    "tbill_rates": "observation_date <= vintage_date",
    "execution_references": """if(status = 'resolved', price is not null and source is not null and reason is null, reason is not null and price is null and source is null)
        and if(ref_time is null or session_date is null, status <> 'resolved' and reason = 'calendar_uncovered', true)
        and if(mode = 'backtest' and status = 'resolved', source = 'sip_last' and trade_time is not null and trade_tape is not null, true)""",
}


def checked(name: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound rows, rows set apart)."""
    sound = F.coalesce(F.expr(CHECKS[name]), F.lit(False))
    return rows.filter(sound), rows.filter(~sound)
