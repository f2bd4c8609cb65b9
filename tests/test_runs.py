"""Agents' texts, halts, the work queue and row checks on small literal tables."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import calendars, partitions
from tidemark.sources import writes

NOW = dt.datetime(2024, 3, 1, 12, tzinfo=dt.UTC)


def ago(days, hours=0):
    return NOW - dt.timedelta(days=days, hours=hours)


def day(days):
    return ago(days).date()


@pytest.fixture(scope="module")
def shown(spark):
    entities = spark.createDataFrame([(1, "TICKER_01", 77, "Tech", "mid", 1000.0), (9, "TICKER_02", 78, "Tech", "small", None)], "security_id int, entity_token string, cik int, sector string, mcap_tier string, adv30_usd double")
    universe = spark.createDataFrame(
        [(1, "Tech", {"p": 1.0, "f": 0.126}, True), (2, "Tech", {"p": 2.0}, True), (3, "Tech", {"p": 3.0}, True), (4, "Tech", {"p": 90.0}, False), (5, "Bank", {"p": 7.0}, True)],
        "security_id int, sector string, values map<string,double>, included boolean",
    )
    facts = spark.createDataFrame(
        [(1, "us-gaap:Revenues", day(62), day(152), 200.0, ago(30), "a"), (1, "us-gaap:NetIncomeLoss", day(62), day(152), 50.0, ago(30), "a"), (1, "us-gaap:Revenues", day(62), day(152), 1.0, ago(-1), "later"), (1, "us-gaap:Revenues", day(62), day(420), 9.0, ago(20), "year")],
        "security_id int, concept string, period_end date, period_start date, value double, available_at timestamp, source_version string",
    )
    txns = spark.createDataFrame(
        [(1, "DOE JANE", "officer", "CFO", day(10), "P", True, 10.0, 5.0, 30.0, False, ago(8), "x1", 0), (1, "ROE RIK", "director", None, day(20), "P", True, 1.0, None, None, True, ago(19), "x0", 0), (1, "ROE RIK", "director", None, day(1500), "S", False, 1.0, 1.0, 1.0, False, ago(1400), "w", 0), (1, "ROE RIK", "other", None, day(5), "M", True, 1.0, 1.0, 1.0, False, ago(-2), "z", 0)],
        "security_id int, filer string, role string, officer_title string, txn_date date, code string, acquired boolean, shares double, price double, post_holdings double, is_10b5_1 boolean, available_at timestamp, accession string, seq int",
    )
    news = spark.createDataFrame(
        [(1, "i1", "Acme  gains 5 million dollars", "On 2024-02-01\tAcme grew", ago(3), ago(3)), (1, "i1", "Acme revised", None, ago(3), ago(2)), (1, "i2", "Analyst upgrades Acme", "s", ago(2), ago(2)), (1, "i3", "Old", "s", ago(40), ago(40)), (1, "i4", "$4 for Acme", "s", ago(1, 1), ago(1))],
        "security_id int, item_id string, headline string, summary string, event_time timestamp, available_at timestamp",
    )
    regime = spark.createDataFrame([("yield_3m_pct", None), ("spy_return_3m", 0.0456)], "feature string, value double")
    mask = text.Masker([("TICKER_01", "name", "Acme")]).column
    rows = partitions.agent_partitions(F.lit(NOW), entities, universe, facts, txns, news, regime, mask, ["f"], ["p"]).collect()
    return {(r.agent, r.security_id): r for r in rows}


def person(name, cik):
    return "EXEC_" + hashlib.sha256(f"{name.casefold()}||{cik}".encode()).hexdigest()[:8].upper()


HEAD = "## entity\nentity\tTICKER_01\nsector\tTech\nsize\tMid-Cap"
LOW = "## fundamentals_summary\nevidence_id\tfeature\tvalue\tsector_z\tsector_pct\nFIN_SUM_1\tf\t0.13\tNA\tNA"
HISTORY = "## fundamentals_history\n" + partitions.HEADERS["history"] + "\nFIN_Q1\tQ-1\tt-62d\tNA\tNA\t0.25\tNA\tNA\tNA\tNA"
HIGH = "## price_features\nevidence_id\tfeature\tvalue\tsector_z\tsector_pct\n{}_1\tp\t1\t-1.2\t0"
NEWS = "## news\nevidence_id\tage\theadline\tsummary\nNEWS_1\tt-1d\t[AMOUNT] for TICKER_01\ts\nNEWS_2\tt-3d\tTICKER_01 revised\t"
REGIME = "## market_regime\nevidence_id\tfeature\tvalue\nMACRO_R_2\tspy_return_3m\t0.046\nMACRO_R_8\tyield_3m_pct\tNA"


def insiders():
    rows = [
        ["INS_1", person("DOE JANE", 77), "ROLE_CFO", "buy", "P", "t-10d", "t-8d", "0.50", "0.050", "0", "OPPORTUNISTIC", "2", "1"],
        ["INS_2", person("ROE RIK", 77), "ROLE_DIRECTOR", "buy", "P", "t-20d", "t-19d", "NA", "NA", "1", "OPPORTUNISTIC", "2", "0"],
    ]
    return "\n".join(["## insider_trades", partitions.HEADERS["insiders"], *("\t".join(r) for r in rows)])


def numbers(body):
    """Texts with figures as numbers: 0.5 and 0.50 are one."""
    return [[float(c) if c.replace(".", "").lstrip("-").isdigit() else c for c in line.split("\t")] for line in body.split("\n")]


def test_each_agent_sees_its_sections_only(shown):
    want = {
        "value": [LOW, HISTORY], "quality_catalyst": [LOW, HISTORY, NEWS], "insider": [LOW, insiders()], "technical": [HIGH.format("TECH")],
        "macro_narrative": [REGIME, HIGH.format("MACRO_P"), NEWS], "red_team": [LOW, HISTORY, insiders(), NEWS, HIGH.format("TECH"), REGIME],
    }
    for agent, sections in want.items():
        got = shown[agent, 1]
        assert numbers(got.text) == numbers("\n\n".join([HEAD, *sections])), agent
        assert got.input_hash == hashlib.sha256(got.text.encode()).hexdigest()
    assert [tuple(e) for e in shown["macro_narrative", 1].evidence] == [("regime", "MACRO_R_2"), ("regime", "MACRO_R_8"), ("regime", "MACRO_P_1"), ("news", "NEWS_1"), ("news", "NEWS_2")]


def test_a_security_without_rows_shows_headers(shown):
    assert len(shown) == 12
    text = shown["red_team", 9].text
    for name in ("history", "insiders", "news"):
        assert f"## {partitions.TITLES[name]}\n{partitions.HEADERS[name]}\n\n" in text
    assert "FIN_SUM_1\tf\tNA\tNA\tNA" in text


def test_unknown_sizes_and_regimes_raise(spark):
    entities = spark.createDataFrame([(1, "T", 7, "Tech", None, 1.0)], "security_id int, entity_token string, cik int, sector string, mcap_tier string, adv30_usd double")
    with pytest.raises(Exception, match="no regime feature: oil"):
        spark.range(1).select(partitions.regime_body(spark.createDataFrame([("oil", 1.0)], "feature string, value double"))).collect()
    universe = spark.createDataFrame([], "security_id int, sector string, values map<string,double>, included boolean")
    empty = {
        "facts": "security_id int, concept string, period_end date, period_start date, value double, available_at timestamp, source_version string",
        "txns": "security_id int, filer string, role string, officer_title string, txn_date date, code string, acquired boolean, shares double, price double, post_holdings double, is_10b5_1 boolean, available_at timestamp, accession string, seq int",
        "news": "security_id int, item_id string, headline string, summary string, event_time timestamp, available_at timestamp",
    }
    tables = [spark.createDataFrame([], schema) for schema in empty.values()]
    out = partitions.agent_partitions(F.lit(NOW), entities, universe, *tables, spark.createDataFrame([], "feature string, value double"), lambda c: c, ["f"], ["p"])
    with pytest.raises(Exception, match="no known size"):
        out.collect()


def test_halts_are_one_commit(spark, tmp_path):
    store = writes.Store(spark, str(tmp_path / "s"))
    runs = spark.createDataFrame([("a", "COMMITTED", None, None), ("b", "PENDING", None, None), ("c", "EXECUTED", None, None)], "run_id string, status string, status_reason string, ended_at timestamp")
    schema = "run_id string, trigger string, triggered_at timestamp"
    events = spark.createDataFrame([("a", "loss", ago(2)), ("a", "feed", ago(3)), ("b", "loss", ago(2))], schema)
    writes.record_halts(store, runs, events)
    now = store.read("runs", runs.schema)
    assert sorted((r.run_id, r.status, r.status_reason) for r in now.collect()) == [("a", "PARTIAL", "kill_switch:feed"), ("b", "PENDING", None), ("c", "EXECUTED", None)]
    writes.record_halts(store, now, events)
    assert store.read("halt_reference_requests", "run_id string, trigger string, tau timestamp, requested_at timestamp, source_version string").count() == 3
    assert store.read("kill_switch_events", schema + ", dedupe_key string").count() == 3
    with pytest.raises(writes.ConflictError, match="halt_reference_requests"):
        writes.record_halts(store, now, spark.createDataFrame([("a", "loss", ago(1))], schema))


def test_work_queue(spark):
    runs = spark.createDataFrame(
        [("old", "GATED", "live", ago(0, 1), ago(1)), ("new", "PENDING", "live", ago(0), ago(1)), ("done", "COMMITTED", "live", ago(0), ago(1)), ("test", "COMMITTED", "backtest", ago(9), ago(1)), ("open", "ANCHORED", "live", ago(1), ago(1)), ("uncovered", "ANCHORED", "live", ago(1), ago(-5)), ("sent", "EXECUTED", "live", ago(1), ago(1))],
        "run_id string, status string, mode string, started_at timestamp, as_of timestamp",
    )
    sessions = spark.createDataFrame([(NOW.date(), ago(0, 2), ago(0, -6))], "session_date date, open_at timestamp, close_at timestamp")
    orders = spark.createDataFrame([("sent", "new"), ("sent", "new"), ("old", "filled")], "run_id string, status string")
    got = sorted(map(tuple, calendars.work_queue(runs, orders, sessions, F.lit(NOW), ["filled"]).collect()))
    assert got == [("done", "advance"), ("old", "advance"), ("open", "execute"), ("sent", "reconcile")]


def test_reference_checks(spark):
    schema = "k int, status string, price double, source string, reason string, ref_time timestamp, session_date date, mode string, trade_time timestamp, trade_tape string"
    ok = ("resolved", 1.0, "sip_last", None, NOW, NOW.date(), "backtest", NOW, "A")
    rows = [(1, *ok), (2, "resolved", None, *ok[2:]), (3, "unresolved", None, None, None, NOW, NOW.date(), "live", None, None), (4, "unresolved", None, None, "calendar_uncovered", None, None, "live", None, None)]
    rows += [(5, "unresolved", None, None, "no_eligible_trade", None, None, "live", None, None), (6, "resolved", 1.0, "iex_mid", None, NOW, NOW.date(), "live", None, None), (7, "resolved", 1.0, "iex_mid", *ok[3:])]
    sound, apart = writes.checked("execution_references", spark.createDataFrame(rows, schema))
    assert sorted(r.k for r in sound.collect()) == [1, 4, 6] and sorted(r.k for r in apart.collect()) == [2, 3, 5, 7]
