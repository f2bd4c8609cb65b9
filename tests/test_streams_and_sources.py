"""Freshness timers, windowed streams, page chains, table wrappers and the operators that no query covers."""

import datetime as dt
import hashlib
import json
import math
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import asof, calendars, committee, evidence, fundamentals, gate, sizing, xsection
from tidemark.sources import pages, payloads, tables, writes
from tidemark.streaming import freshness, ingest

NOW = dt.datetime(2024, 3, 1, 12)


def at(spark, text):
    return F.to_timestamp_ntz(F.lit(text))


# ---- streams
def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))


def wait(condition, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if condition():
            return True
        time.sleep(0.3)
    return False


def test_silence_makes_a_feed_stale_and_restarts_keep_the_timers(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", freshness.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    schema = "feed string, success_ms long, limit_ms long"
    source, seen = tmp_path / "in", []

    def start():
        changes = freshness.freshness_changes(spark.readStream.schema(schema).json(str(source)))
        sink = changes.writeStream.foreachBatch(lambda b, _: seen.extend((r.feed, r.state) for r in b.collect())).outputMode("update")
        return sink.option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()

    try:
        ms = lambda: int(time.time() * 1000)
        land(spark, source, [("bars", ms(), 12_000), ("news", ms() - 900_000, 60_000), ("facts", ms(), 3_600_000)], schema)
        query = start()
        assert wait(lambda: len(seen) >= 3) and set(seen) == {("bars", "fresh"), ("news", "stale"), ("facts", "fresh")}
        assert wait(lambda: query.lastProgress is not None)  # the batch is committed
        query.stop()
        query = start()  # the timer of bars is in the checkpoint
        assert wait(lambda: ("bars", "stale") in seen), seen  # nothing has arrived
        land(spark, source, [("bars", ms(), 3_600_000), ("facts", 5, 1)], schema)  # an old success changes nothing
        assert wait(lambda: seen[-1] == ("bars", "fresh"))
        query.stop()
        assert [s for f, s in seen if f == "bars"] == ["fresh", "stale", "fresh"] and len(seen) == 5
    finally:
        for q in spark.streams.active:
            q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_windows_close_by_watermark(spark, tmp_path):
    schema = "k string, ts timestamp, v double"
    stamp = lambda m: NOW + dt.timedelta(minutes=m)
    land(spark, tmp_path / "in", [("a", stamp(0), 1.0), ("a", stamp(4), 2.0), ("b", stamp(3), 5.0), ("a", stamp(11), 4.0)], schema)
    land(spark, tmp_path / "in", [("a", stamp(60), 0.0)], schema)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    total = F.sum("v").alias("v")

    def run(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    got = {(r.k, r.window.start, r.v) for r in run(ingest.tumbling(events, "ts", "10 minutes", "5 minutes", ["k"], total), "tumbled").collect()}
    assert got == {("a", stamp(0), 3.0), ("b", stamp(0), 5.0), ("a", stamp(10), 4.0)}
    got = {(r.k, r.session_window.start, r.session_window.end, r.v) for r in run(ingest.sessions(events, "ts", "5 minutes", "5 minutes", ["k"], total), "sessioned").collect()}
    assert got == {("a", stamp(0), stamp(9), 3.0), ("b", stamp(3), stamp(8), 5.0), ("a", stamp(11), stamp(16), 4.0)}


# ---- page chains
def page(bars, token):
    return json.dumps({"bars": [{"t": t, "o": 1.0, "h": 2.0, "l": 0.5, "c": 1.5, "v": 10.0} for t in bars], "next_page_token": token})


@pytest.fixture
def chains(spark, tmp_path):
    root = str(tmp_path / "pages")
    pages.record(root, "AAA", [(None, page(["2024-02-28T05:00:00Z"], "t1")), ("t1", page(["2024-02-29T05:00:00Z"], "t2")), ("t2", page(["2024-03-01T05:00:00Z"], None))])
    pages.record(root, "BBB", [(None, page(["2024-02-28T05:00:00Z"], None))])
    pages.register(spark)
    return root


def test_chains_are_read_whole_a_partition_each(spark, chains):
    df = spark.read.format("recorded_pages").load(chains)
    assert [(r.request, r.page, r.token) for r in df.orderBy("request", "page").collect()] == [("AAA", 0, None), ("AAA", 1, "t1"), ("AAA", 2, "t2"), ("BBB", 0, None)]
    assert df.rdd.getNumPartitions() == 2
    one = spark.read.format("recorded_pages").option("requests", "BBB, C*").load(chains)
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1 and df.count() == 4
    assert spark.read.format("recorded_pages").option("requests", "none").load(chains).count() == 0
    assert df.filter("request in ('AAA', 'x') and page > 0").count() == 2
    # bars known by noon of March 1st: that day's close is still to come
    rows = df.select(F.when(F.col("request") == "AAA", 1).otherwise(2).alias("security_id"), F.lit(NOW).alias("received_at"), "payload")
    assert {(r.security_id, r.event_time.day) for r in payloads.bar_history(rows, F.lit(NOW)).collect()} == {(1, 28), (1, 29), (2, 28)}


@pytest.mark.parametrize(("recorded", "message"), [
    ([(None, page([], "gone"))], "page 1 is missing"), ([(None, "[not json")], "page 0 is no page"), ([(None, page([], "x")), ("x", page([], "y")), ("y", page([], "x"))], "names an earlier one"),
])
def test_broken_chains_fail_the_read_and_others_can_still_be_asked_for(spark, chains, recorded, message):
    pages.record(chains, "CCC", recorded)
    df = spark.read.format("recorded_pages").load(chains)
    with pytest.raises(Exception, match=message):
        df.collect()
    assert spark.read.format("recorded_pages").option("requests", "AA*").load(chains).count() == 3


def test_endless_chains_are_refused(spark, chains):
    with pytest.raises(Exception, match="more than 2 pages"):
        spark.read.format("recorded_pages").option("most_pages", 2).load(chains).collect()


# ---- tables
def test_table_wrappers(spark, tmp_path):
    store = writes.Store(spark, str(tmp_path / "s"))
    bar = "security_id int, event_time timestamp_ntz, source_version string, feed string, open double, high double, low double, close double, volume double"
    good = [(1, NOW, "sip", "sip", 1.0, 2.0, 0.5, 1.5, 3.0)]
    assert tables.insert(store, "price_bars", spark.createDataFrame(good, bar)) == 1
    assert tables.insert(store, "price_bars", spark.createDataFrame([*good, (2, *good[0][1:])], bar)) == 1
    with pytest.raises(writes.ConflictError, match="breaks a check"):
        tables.insert(store, "price_bars", spark.createDataFrame([(3, NOW, "sip", "sip", 1.0, 0.9, 0.5, 1.5, 3.0)], bar))
    rate = "series string, observation_date date, vintage_date date, yield_pct double"
    day = dt.date(2024, 1, 2)
    assert tables.insert(store, "tbill_rates", spark.createDataFrame([("x", day, day, 5.0)], rate)) == 1
    assert tables.insert(store, "tbill_rates", spark.createDataFrame([("x", day, day, 5.0)], rate)) == 0
    with pytest.raises(writes.ConflictError, match="another payload"):
        tables.insert(store, "tbill_rates", spark.createDataFrame([("x", day, day, 5.1)], rate))


def test_dimension_reads(spark):
    rows = [(1, "equity", dt.date(2020, 1, 1), None), (2, "equity", None, dt.date(2023, 1, 1)), (3, "etf", None, None)]
    d = spark.createDataFrame(rows, "security_id int, kind string, listed_from date, listed_to date")
    assert [r.security_id for r in tables.reference_instruments(d).collect()] == [3]
    assert [r.security_id for r in tables.securities(d).orderBy("security_id").collect()] == [1, 2]
    assert [r.security_id for r in tables.securities(d, F.lit(dt.date(2024, 1, 1))).collect()] == [1]
    refs = spark.createDataFrame([("r", "B", NOW), ("r", "A", NOW), ("r", "C", NOW + dt.timedelta(1)), ("q", "A", NOW)], "run_id string, symbol_ref string, available_at timestamp")
    assert [r.symbol_ref for r in tables.run_references(refs, "r").collect()] == ["A", "B", "C"]
    assert [r.symbol_ref for r in tables.run_references(refs, "r", F.lit(NOW)).collect()] == ["A", "B"]


# ---- operators without a query
def test_condition_map_and_metadata(spark):
    entries = [{"tape": "A", "provider_code": 4, "spec_code": "4", "expected_provider_name": "Derived", "validated": False}]
    assert [tuple(r) for r in payloads.condition_map(spark, entries).collect()] == [("A", "4", "4", "Derived", False)]


def test_broker_calendar_versions(spark):
    days = spark.createDataFrame([(dt.date(2024, 3, 1), NOW, NOW + dt.timedelta(hours=6)), (dt.date(2024, 3, 4), NOW, NOW + dt.timedelta(hours=3))], "session_date date, open_at timestamp, close_at timestamp")
    got = payloads.trading_sessions(days, F.lit(NOW)).orderBy("session_date").collect()
    raw = "2024-03-01|2024-03-01T12:00:00+00:00|2024-03-01T18:00:00+00:00"
    assert got[0].source_version == "alpaca_calendar:" + hashlib.sha256(raw.encode()).hexdigest()[:8] and got[0].source_version != got[1].source_version
    again = payloads.trading_sessions(days.withColumn("close_at", F.col("close_at") + F.expr("interval 1 hour")), F.lit(NOW)).orderBy("session_date").collect()
    assert all(a.source_version != b.source_version for a, b in zip(got, again, strict=True))
    coverage = payloads.calendar_coverage(payloads.trading_sessions(days, F.lit(NOW)), "2024-03-01", "2024-03-04", F.lit(NOW))
    sessions = payloads.trading_sessions(days, F.lit(NOW))
    assert calendars.coverage_faults(sessions, coverage).count() == 0 and calendars.newest_coverage(coverage.unionByName(coverage.withColumn("available_at", F.col("available_at") - F.expr("interval 1 day")))).first().available_at == NOW


def test_resets_are_refused_where_evidence_exists(spark):
    t = lambda rows: spark.createDataFrame(rows, "run_id string, k int")
    found = {"decision_commitments": t([("a", 1)]), "orders": t([("b", 1)]), "anchors": t([])}
    assert writes.reset_refusals("a", found) == ["decision_commitments"] and writes.reset_refusals("c", found) == []
    archived = writes.reset_archive("a", {"gate": t([("a", 2), ("a", 1), ("b", 3)]), "books": t([])}).first()
    assert archived.archive == {"gate": ['{"run_id":"a","k":1}', '{"run_id":"a","k":2}'], "books": []}


def test_scorability_precedence(spark):
    sound = {
        "read_failed": False, "status": "EXECUTED", "status_reason": None, "mode": "live", "commitment_sha256": "h", "material_sha256": "h", "anchor_sha256": "h", "kill_events": 0, "defects": 0, "has_snapshot": True,
        "has_proof": True, "git_commit": "g", "proof_binds": True, "proof_confirmed": True, "header_verified": True, "git_reachable": True,
        "committed_at": NOW, "anchored_at": NOW, "requested_at": NOW, "block_time": NOW, "earliest_resolution_at": NOW + dt.timedelta(1),
    }
    schema = (
        "read_failed boolean, status string, status_reason string, mode string, commitment_sha256 string, material_sha256 string, anchor_sha256 string, kill_events int, defects int, has_snapshot boolean, has_proof boolean, git_commit string, "
        "proof_binds boolean, proof_confirmed boolean, header_verified boolean, git_reachable boolean, committed_at timestamp, anchored_at timestamp, requested_at timestamp, block_time timestamp, earliest_resolution_at timestamp"
    )
    worse = [
        ({}, None), ({"earliest_resolution_at": NOW}, "anchor_timing"), ({"git_reachable": False}, "git_unreachable"), ({"header_verified": False}, "header_verification_failed"), ({"proof_confirmed": False}, "ots_not_confirmed"),
        ({"proof_binds": False}, "anchor_invalid"), ({"git_commit": None}, "anchor_missing"), ({"material_sha256": "x"}, "commitment_mismatch"), ({"defects": 1}, "material_incomplete"), ({"status": "PENDING"}, "not_scorable_status"),
        ({"status": "PARTIAL", "status_reason": "kill_switch:x"}, "halt_evidence_missing"), ({"commitment_sha256": None}, "no_commitment"), ({"status": None}, "run_missing"), ({"read_failed": True}, "evidence_unavailable"),
    ]
    rows, state = [], dict(sound)
    for change, _ in worse:
        state |= change  # each keeps the faults before it, and precedes them
        if change.get("status") == "PARTIAL":
            state["status_reason"] = "kill_switch:x"
        rows.append(tuple(state.values()))
    got = [r.refusal for r in evidence.scorability(spark.createDataFrame(rows, schema)).collect()]
    assert got == [w for _, w in worse]
    assert evidence.scorability(spark.createDataFrame([tuple((sound | {"mode": "backtest", "status": "ANCHORED", "earliest_resolution_at": None}).values())], schema)).first().refusal is None


def test_instants(spark):
    one = spark.range(1).select(dates.snapshot_time(F.lit(dt.date(2024, 7, 1))), dates.snapshot_time(F.lit(dt.date(2024, 12, 2))), dates.session_close(F.lit(dt.date(2024, 7, 1))), dates.exchange_date(F.lit(dt.datetime(2024, 7, 2, 3))), dates.exchange_date(F.lit(dt.datetime(2024, 7, 2, 5)))).first()
    assert list(one) == [dt.datetime(2024, 7, 2, 3, 59), dt.datetime(2024, 12, 3, 4, 59), dt.datetime(2024, 7, 1, 20), dt.date(2024, 7, 1), dt.date(2024, 7, 2)]


def test_small_operators(spark):
    got = spark.createDataFrame([(20,), (30,), (56,)], "n int").select(committee.shrinkage(F.col("n"))).collect()
    assert [round(r[0], 9) for r in got] == [0.0, 0.0, round(1 - math.exp(-1), 9)]
    values = spark.createDataFrame([({"a": 1.0, "b": float("nan")},), ({"c": None, "d": float("inf"), "e": -2.0},)], "values map<string,double>")
    assert gate.feature_names(values) == ["a", "e"]
    book = spark.createDataFrame([("r", 1, 0.3)], "run_id string, security_id int, weight double")
    decided = spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, security_id int")
    assert {(r.security_id, r.target_weight) for r in sizing.with_target_weights(decided, book).collect()} == {(1, 0.3), (2, 0.0)}
    ranges = spark.createDataFrame([(1, 5, "a"), (6, 9, "b"), (8, 12, "c")], "lo int, hi int, sector string")
    assert [r.sector for r in xsection.overlapping_ranges(ranges).collect()] == ["c"]
    assert xsection.overlapping_ranges(ranges.filter("lo < 8")).count() == 0
    rows = spark.createDataFrame([(1, i, NOW - dt.timedelta(days=d, hours=1), p) for i, (d, p) in enumerate([(0, "x"), (1, "y"), (2, "x"), (8, "z"), (16, "z"), (16, "z")])], "security_id int, item_id int, event_time timestamp, publisher string")
    f = fundamentals.news_features(rows, F.lit(NOW)).first()
    weeks = [1, 2, 0, 0, 0, 0, 0]
    mean = sum(weeks) / 7
    sd = math.sqrt(sum((w - mean) ** 2 for w in weeks) / 6)
    assert math.isclose(f.news_count_zscore_7d, (3 - mean) / sd) and f.news_source_diversity_7d == 2
    assert asof.vintages_before(spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),)], "vintage_date date"), F.lit(dt.date(2024, 1, 2))).count() == 1
