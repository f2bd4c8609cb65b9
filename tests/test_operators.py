"""Small literal cases for what the catalog's tables don't show."""

import datetime as dt
import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers, text
from tidemark.operators import asof, calendars, committee, evidence, gate, sequential, sizing, trades
from tidemark.operators import fundamentals as fu
from tidemark.sources import payloads
from tidemark.sources import writes as w
from tidemark.streaming import ingest

UTC = dt.UTC


def ts(day, hour=0, minute=0, second=0, micro=0):
    return dt.datetime(2024, 1, day, hour, minute, second, micro, tzinfo=UTC)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_latest_version_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 3), rng.randint(0, 40), f"v{k:02d}") for k in range(80)]
    df = spark.createDataFrame([(k, ts(1) + dt.timedelta(minutes=m), v) for k, m, v in rows], "key int, available_at timestamp, source_version string")
    for minutes in (-1, 5, 20, 60):
        at = F.lit(ts(1) + dt.timedelta(minutes=minutes))
        want = {}
        for k, m, v in rows:
            if m <= minutes:
                want[k] = max(want.get(k, (m, v)), (m, v))
        got = {r.key: r.source_version for r in asof.latest_version(df, ["key"], at).collect()}
        assert got == {k: v for k, (_, v) in want.items()}


def test_asof_join_ties_and_misses(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 3, "x", 1), ("a", 5, "y", 1), ("a", 5, "z", 2), ("c", 1, "q", 1)], "k string, at int, v string, n int")
    back = {(r.k, r.t): r.v for r in asof.asof_join(left, right, ["k"], "t", "at", ["v"], ties=["n"]).collect()}
    assert back == {("a", 5): "z", ("a", 1): None, ("b", 9): None}
    ahead = {(r.k, r.t): r.v for r in asof.asof_join(left, right, ["k"], "t", "at", ["v"], "forward", ties=["n"]).collect()}
    assert ahead == {("a", 5): "y", ("a", 1): "x", ("b", 9): None}


def test_numbers(spark):
    assert one(spark, numbers.safe_div(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, numbers.sigmoid(F.lit(-800.0))) == 0.0
    assert math.isclose(one(spark, numbers.softplus(F.lit(3.0))), math.log1p(math.exp(3)))
    assert one(spark, numbers.collar_price(F.lit("buy"), F.lit(10.0), F.lit(50.0))) == 10.05
    assert one(spark, numbers.collar_price(F.lit("sell"), F.lit(10.0), F.lit(50.0))) == 9.95
    assert one(spark, numbers.cube_root_growth(F.lit(-1.0))) is None
    assert one(spark, numbers.max_vetoes(F.lit(5), 0.2)) == 1
    assert abs(numbers.binomial_upper(454, 20000) - 0.0253) < 1e-4
    assert numbers.binomial_upper(3, 3) == 1.0


def test_two_figures(spark):
    values = [0.0, 0.125, 1234.0, 1e-7, -99.5, 2.5e9, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.s for r in df.select(text.sig2("v").alias("s")).collect()] == [None if v != v else "0" if v == 0 else format(Decimal(f"{v:.2g}"), "f") for v in values]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("paid $1,200 million on 2021-03-04", "paid [AMOUNT] on [DATE]"),
        ("3 billion shares and 5 million dollars, 7 trillion", "[SHARES] and [AMOUNT], [NUM]"),
        ("sold 500 shares in FY 2021, Q2 2020 and March 2019", "sold [SHARES] in [DATE], [DATE] and [DATE]"),
        ("rose 12% to 123 or 12,345 or 1234.5", "rose 12% to 123 or [NUM] or [NUM]"),
        ("v1.2345 stays", "v1.2345 stays"),
        ("version 1.2.3.4 and 1.2345 or 12.34 or 12.3", "version 1.2.3.4 and [NUM] or [NUM] or 12.3"),
        ("é1234 and 1,23.4 and 1,,2,3 4", "é1234 and [NUM] and 1,,2,3 4"),
    ],
)
def test_scrub(spark, raw, want):
    assert one(spark, text.scrub(F.lit(raw))) == want


def test_names(spark):
    assert one(spark, text.short_name(F.lit("Acme Robotics Corp."))) == "Acme Robotics"
    assert one(spark, text.short_name(F.lit("Acme"))) is None
    assert one(spark, text.colloquial_name(F.lit("Zephyr Dynamics Corp."))) == "Zephyr"
    assert one(spark, text.colloquial_name(F.lit("Texas Goods Inc"))) is None
    assert one(spark, text.name_variants(F.lit("SMITH JOHN A"))) == ["SMITH JOHN A", "JOHN SMITH", "JOHN A SMITH", "JOHN A. SMITH", "SMITH"]
    assert one(spark, text.name_variants(F.lit("Cook, Tim"))) == ["Cook, Tim", "Tim Cook"]
    assert one(spark, text.redact_url(F.lit("https://u:p@h/x?api_key=abc&q=1"))) == "https://***@h/x?api_key=***&q=1"
    assert one(spark, text.evidence_ids(F.lit("FIN_1\tx\nno\tz\nNEWS_22\ty"))) == ["FIN_1", "NEWS_22"]


def test_masker():
    m = text.Masker([("TICKER_01", "name", "Acme Robotics"), ("TICKER_01", "ticker", "AR"), ("TICKER_02", "ticker", "BRK.B"), ("TICKER_01", "brand", "Zed"), ("TICKER_02", "brand", "zed"), ("TICKER_03", "cik", "320193")])
    assert m.mask("acme  robotics and $AR, not ar; brk-b; ZED; CIK 0000320193") == "TICKER_01 and TICKER_01, not ar; TICKER_02; ENTITY_00; TICKER_03"
    assert m.mask("Acmes") == "Acmes" and m.mask(None) is None


def test_masker_reads_texts_as_people_write_them():
    m = text.Masker([("T1", "ticker", "IBM"), ("T2", "ticker", "BRK.B"), ("T3", "name", "Lowe's Companies"), ("T4", "ticker", "AR"), ("T5", "name", "Acme"), ("T5", "name", "Acme Robotics"), ("T6", "brand", "AT&T"), ("T7", "person", "José Cruz"), ("T8", "cik", "42"), ("T9", "name", "acme"), ("T10", "ticker", "V")])
    for raw, want in {
        "ibm rose; BRK/B fell; Lowe\u2019s Companies up": "T1 rose; T2 fell; T3 up",
        "$ibm $AR ar AR. V v": "T1 T4 ar T4. T10 v",
        "ACME  ROBOTICS acme Acmes": "T5 ENTITY_00 Acmes",
        "at&t at & t xAT&T": "T6 at & t xAT&T",
        "jose\u0301 CRUZ and ＡＲ": "T7 and T4",
        "CIK no. 0042, cik: 42x, 0000000042 42": "T8, cik: 42x, T8 42",
        "": "",
        "BRK.BX BRK.B.": "BRK.BX T2.",
    }.items():
        assert m.mask(raw) == want, raw
    assert text.Masker([]).mask("a\u2019b") == "a'b"


def test_masker_against_one_pattern(spark):
    """Names alone are what one alternation of all of them, the longest first, finds."""
    import re

    names = ["for the", "the", "and that", "The of ea", "re", "Sch in", "un"]
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(r"\s+".join(map(re.escape, n.split())) for n in sorted(names, key=len, reverse=True)) + r")(?!\w)", re.I)
    token = {" ".join(n.split()).casefold(): f"T{k}" for k, n in enumerate(names)}
    m = text.Masker([(f"T{k}", "name", n) for k, n in enumerate(names)])
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").filter("text is not null").collect():
        plain = text.plain_text(r.text)
        assert m.mask(r.text) == pattern.sub(lambda f: token[" ".join(f[0].split()).casefold()], plain)


def test_pseudonyms_and_alias_rows(spark):
    token = lambda n: one(spark, text.pseudonym(F.lit(n), F.lit(7)))
    assert token("O\u2019Neil  Straße") == token("o'neil STRASSE") == token("Ｏ'Neil Straße") != token("Oneil Strasse")
    securities = spark.createDataFrame([(1, "Acme Robotics Corp.", "ACME", 42), (2, "Plain", "P", 43)], "security_id int, name string, ticker string, cik long")
    brands = spark.createDataFrame([(42, "acme robotics"), (42, "Zed "), (43, "")], "cik long, brand string")
    people = spark.createDataFrame([(2, "SMITH JOHN A")], "security_id int, name string")
    got = sorted((r.security_id, r.kind, r.text, r.person) for r in text.alias_rows(securities, brands, people).collect())
    who = "SMITH JOHN A"
    assert got == [(1, "brand", "Zed", None), (1, "brand", "acme robotics", None), (1, "cik", "42", None), (1, "name", "Acme Robotics", None), (1, "name", "Acme Robotics Corp.", None), (1, "ticker", "ACME", None),
                   (2, "cik", "43", None), (2, "name", "Plain", None), *((2, "person", f, who) for f in ("JOHN A SMITH", "JOHN A. SMITH", "JOHN SMITH", "SMITH", "SMITH JOHN A")), (2, "ticker", "P", None)]


def test_scrub_against_counted_matches(spark):
    """Long numbers of real texts, against a plain search that counts the digits of each match."""
    import re

    number = re.compile(r"(?<![\w.])" + text.NUMBER)
    scrubbed = text.LONG_NUMBER
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", F.regexp_replace("text", scrubbed, "[NUM]").alias("got")).filter("text is not null").collect():
        assert r.got == number.sub(lambda m: "[NUM]" if sum(c.isdigit() for c in m[0]) >= 4 else m[0], r.text)


def test_processes_have_their_moments():
    for k, (name, p) in enumerate(sequential.PROCESSES.items()):
        x = sequential.draw(name, np.random.default_rng(k), 4000, 100) / sequential.WEEKLY_SD
        if p.innovation != "gamma2":
            assert abs(x.mean()) < 0.02
        if p.innovation != "t3":
            assert abs(x.std() - 1) < 0.05
        assert abs((x[:, 1:] * x[:, :-1]).mean() / x.var() - p.phi) < 0.03
        square = x**2 - (x**2).mean()
        assert ((square[:, 1:] * square[:, :-1]).mean() / (square**2).mean() > 0.1) == (p.arch > 0)


def test_power_is_that_of_the_published_run(spark):
    for edge, share in ((0.003, 0.23), (0.005, 0.75), (0.0075, 0.99)):
        r = sequential.simulate(spark, ["iid_normal"], 2000, edge=edge).first()
        assert abs(r.passes / r.n - share) < 0.035


def test_weight_floor(spark):
    def loop(raw, floor):
        pinned = {k for k, x in enumerate(raw) if x < floor}
        while True:
            free = sum(x for k, x in enumerate(raw) if k not in pinned)
            if free <= 0:
                return [1 / len(raw)] * len(raw)
            scaled = [floor if k in pinned else x * (1 - floor * len(pinned)) / free for k, x in enumerate(raw)]
            more = {k for k, x in enumerate(scaled) if k not in pinned and x < floor}
            if not more:
                return scaled
            pinned |= more

    for raw in ([0.5, 0.3, 0.2], [0.97, 0.02, 0.01], [0.9, 0.051, 0.049], [0.0, 0.0, 1.0], [0.26, 0.25, 0.25, 0.24]):
        for floor in (0.02, 0.05, 0.25):
            got = one(spark, committee.floored(F.array(*map(F.lit, raw)), floor))
            assert np.allclose(got, loop(raw, floor)), (raw, floor)


def test_stacker(spark):
    rows = [(21, x / 4, int((x * 7) % 5 < 2), 1.0, p) for p in (12,) for x in range(-12, 13)]
    fit = committee.fit_stacker(spark.createDataFrame(rows, "horizon int, logit double, outcome int, weight double, periods int")).first()
    z, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    base = y.mean()
    p = 1 / (1 + np.exp(-(fit.alpha + fit.beta * z)))
    assert abs((p - y).mean() + fit.alpha - math.log(base / (1 - base))) < 1e-8
    assert abs(((p - y) * z).mean() + 10 * (fit.beta - 1)) < 1e-8
    early = committee.fit_stacker(spark.createDataFrame([(5, 1.0, 1, 1.0, 3)], "horizon int, logit double, outcome int, weight double, periods int")).first()
    assert (early.alpha, early.beta, early.active) == (0.0, 1.0, False)


def test_sizing_limits(spark):
    rng = random.Random(3)
    rows = [("r", k, f"s{k % 4}", rng.gauss(0, 1), rng.random(), rng.choice([None, "low", "med", "high"]), rng.choice([None, 0.0, 0.2, 0.5])) for k in range(40)]
    df = spark.createDataFrame(rows, "run_id string, security_id int, sector string, logit double, dispersion double, bear_severity string, sigma double")
    for base in (None, 0.4):
        book = [r for r in sizing.size_committee_book(df, base_rate=base).collect() if r.weight > 0]
        limits = sizing.Limits()
        assert all(limits.min_position <= r.weight <= limits.max_position + 1e-12 and r.sigma for r in book)
        assert sum(r.weight for r in book) <= 1 + 1e-9
        for s in {r.sector for r in book}:
            assert sum(r.weight for r in book if r.sector == s) <= limits.max_sector + 1e-9
        assert sum((r.weight * r.sigma) ** 2 for r in book) <= limits.vol_target**2 + 1e-9


def sequence(groups):
    """The sequential rule over instants, one trade after the other."""
    seen_q = seen_u = False
    out = []
    for group in groups:
        kinds = []
        for i, (status, more) in enumerate(group):
            tied = any(s != "ineligible" for j, (s, _) in enumerate(group) if j != i)
            if status in ("eligible", "ineligible", "unknown"):
                kinds.append({"eligible": "qualifies", "ineligible": "not", "unknown": "unknown"}[status])
            elif seen_q:
                kinds.append("unknown" if more else "not")
            else:
                kinds.append("unknown" if tied or seen_u else "qualifies")
        seen_q, seen_u = seen_q or "qualifies" in kinds, seen_u or "unknown" in kinds
        out.append(kinds)
    return out


def test_trade_sequences_against_a_loop(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for day in range(60):
        groups = [[(rng.choice(["eligible", "ineligible", "unknown", "conditional", "conditional", "ineligible"]), rng.random() < 0.3) for _ in range(rng.choice([1, 1, 2]))] for _ in range(rng.randint(1, 6))]
        for g, (group, kinds) in enumerate(zip(groups, sequence(groups), strict=True)):
            for k, ((status, more), kind) in enumerate(zip(group, kinds, strict=True)):
                rows.append(("X", day, ts(1, second=g), 1.0, status, None, more, f"{day}/{g}/{k}"))
                want[f"{day}/{g}/{k}"] = kind
    df = spark.createDataFrame(rows, "symbol string, session_date int, time timestamp, price double, status string, reason string, needs_more boolean, id string")
    assert {r.id: r.kind for r in trades.sequence_verdicts(df).collect()} == want


def test_sequential_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(t, k, rng.gauss(m, 0.01), rng.gauss(m, 0.01)) for t, m in enumerate((0.02, -0.02, 0.0, 0.006)) for k in range(1, 105)]
    weeks = spark.createDataFrame(rows, "test_id int, week int, vs_index double, vs_quant double")
    got = {r.test_id: (r.week, r.status) for r in sequential.sequential_decisions(weeks).collect()}
    for t in range(4):
        x = np.array([[r[2], r[3]] for r in rows if r[0] == t]).T
        y = np.clip(x, -0.05, 0.05) / 0.05
        a, b, m = sequential.wealth_rows(np.array([y[0], y[1], -y[1]]))
        status, week = "INCONCLUSIVE", 104
        for k in range(25, 104):
            p, f = a[k] >= 20 and b[k] >= 20, m[k] >= 20
            if p or f:
                status, week = ("INCONCLUSIVE" if p and f else "PASS" if p else "FAIL"), k + 1
                break
        assert got[t] == (week, status)


def test_simulation_keeps_its_size(spark):
    rows = {r.null: r for r in sequential.simulate(spark, ["iid_t3", "ar1_0.3"], 1500).collect()}
    assert all(r.n == 1500 and r.passes / r.n < 0.05 and r.fails / r.n < 0.05 for r in rows.values())
    assert rows == {r.null: r for r in sequential.simulate(spark, ["ar1_0.3", "iid_t3"], 1500).collect()}


def test_calendar_checks(spark):
    sessions = spark.createDataFrame([(dt.date(2024, 1, d), ts(d, 14, 30), ts(d, 21), ts(1), "v1") for d in (2, 3, 4)], "session_date date, open_at timestamp, close_at timestamp, available_at timestamp, source_version string").withColumn("event_time", F.col("open_at"))
    cover = payloads.calendar_coverage(sessions, "2024-01-01", "2024-01-05", F.lit(ts(1)))
    assert calendars.coverage_faults(sessions, cover).isEmpty() and calendars.revised_without_coverage(sessions, cover).isEmpty()
    revised = sessions.unionByName(sessions.filter("day(session_date) = 3").withColumn("available_at", F.lit(ts(9))).withColumn("source_version", F.lit("v2")))
    assert calendars.revised_without_coverage(revised, cover).count() == 1
    assert calendars.build_calendar(revised, cover).count() == 3
    assert not calendars.coverage_faults(sessions.filter("day(session_date) <> 3"), cover).isEmpty()
    assert not w.range_faults(sessions.filter("day(session_date) <> 3"), cover).isEmpty()
    assert w.range_faults(sessions, cover).isEmpty()
    runs = spark.createDataFrame([(ts(2, 22),), (ts(4, 22),)], "as_of timestamp")
    got = {r.as_of.day: r.window_start and r.window_start.replace(tzinfo=UTC) for r in calendars.with_execution_window(runs, sessions).collect()}
    assert got[4] is None and got[2] is not None


def test_writes(spark, tmp_path):
    store = w.Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(1, None, 2.0), (2, "a", 3.0)], "k int, part string, v double")
    assert w.append_new(store, "t", rows, ["k", "part"]) == 2
    assert w.append_new(store, "t", rows, ["k", "part"]) == 0
    assert w.append_immutable(store, "t", rows.unionByName(spark.createDataFrame([(3, None, 1.0)], rows.schema)), ["k", "part"]) == 1
    with pytest.raises(w.ConflictError):
        w.append_immutable(store, "t", spark.createDataFrame([(1, None, 9.0)], rows.schema), ["k", "part"])
    assert store.read("t", rows.schema).count() == 3
    assert store.read("missing", "a int").count() == 0
    assert w.append_by_content(store, "dlq", spark.createDataFrame([("r", "x"), ("r", "x")], "run_id string, what string")) == 1


def test_merges(spark):
    runs = spark.createDataFrame([("a", "COMMITTED", None), ("b", "PARTIAL", "kill_switch: loss"), ("c", "PENDING", None)], "run_id string, status string, status_reason string")
    changes = spark.createDataFrame([("a", "FAILED", "late"), ("b", "EXECUTED", None), ("c", "COMMITTED", None), ("d", "PENDING", None)], runs.schema)
    got = {r.run_id: r.status for r in w.upsert_runs(runs, changes).collect()}
    assert got == {"a": "COMMITTED", "b": "PARTIAL", "c": "COMMITTED", "d": "PENDING"}
    assert {r.run_id: r.status for r in w.advance(runs, runs.select("run_id"), "COMMITTED", "ANCHORED").collect()}["a"] == "ANCHORED"
    health = spark.createDataFrame([("f", ts(1), ts(1), 5, None, ts(1))], "feed string, last_success_at timestamp, last_available_at timestamp, rows long, last_error string, updated_at timestamp")
    bad = spark.createDataFrame([("f", None, 2, "boom", ts(2))], "feed string, last_available_at timestamp, rows long, last_error string, updated_at timestamp")
    r = w.record_feed_runs(health, bad).first()
    assert (r.last_success_at.day, r.last_available_at.day, r.rows, r.last_error) == (1, 1, 7, "boom")
    dim = spark.createDataFrame([(1, 10, "AA", "old")], "security_id int, cik int, ticker string, name string")
    ids = {r.ticker: (r.security_id, r.name) for r in w.upsert_securities(dim, spark.createDataFrame([(10, "AA", "new"), (11, "BB", "b")], "cik int, ticker string, name string")).collect()}
    assert ids == {"AA": (1, "new"), "BB": (2, "b")}


FORM4 = """<ownershipDocument><aff10b5One>0</aff10b5One><reportingOwner><reportingOwnerId><rptOwnerName>DOE JANE</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>true</isOfficer><officerTitle>CEO</officerTitle></reportingOwnerRelationship></reportingOwner>
<nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2024-01-02</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>100</value></transactionShares><transactionPricePerShare><value>2.5</value><footnoteId id="F1"/></transactionPricePerShare><transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>
<nonDerivativeTransaction><transactionDate><value>2024-01-03</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>7</value></transactionShares><transactionAcquiredDisposedCode><value>D</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable>
<footnotes><footnote id="F1">Under a Rule 10b5-1 plan.</footnote></footnotes></ownershipDocument>"""


def test_payloads(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    bars = payloads.bars(df([(1, None, '{"bars":[{"t":"2024-01-02T05:00:00Z","o":1,"h":2,"l":0.5,"c":1.5,"v":10}]}')], "security_id int, received_at timestamp, payload string"), "sip").first()
    assert bars.available_at.replace(tzinfo=None) == dt.datetime.fromtimestamp(ts(2, 21, 15).timestamp()) and bars.close == 1.5
    t = payloads.trades(df([('{"symbol":"X","trades":[{"t":"2024-01-02T15:00:00.123456789Z","p":1.5,"s":3,"c":["@"],"i":7,"z":"C"}]}',)], "payload string")).first()
    assert (t.time.microsecond, t.conditions, t.trade_id) == (123456, ["@"], "7")
    facts = '{"facts":{"us-gaap":{"Assets":{"units":{"USD":[{"end":"2023-12-31","val":5,"accn":"a1","fp":"FY","form":"10-K","filed":"2024-01-05"},{"end":"2023-12-31","val":6,"accn":"a1","filed":"2024-01-05"}]}}}}}'
    f = payloads.company_facts(df([(1, facts)], "security_id int, payload string"), df([], "accession string, accepted_at timestamp")).collect()
    assert [(r.concept, r.value) for r in f] == [("us-gaap:Assets", 5.0)]
    lines = payloads.form4(df([(1, "acc", ts(4), FORM4)], "security_id int, accession string, accepted_at timestamp, payload string")).orderBy("seq").collect()
    assert [(r.filer, r.role, r.code, r.acquired, r.shares, r.price, r.is_10b5_1) for r in lines] == [("DOE JANE", "officer", "P", True, 100.0, 2.5, True), ("DOE JANE", "officer", "S", False, 7.0, None, False)]
    index = '{"cik":"7","name":"N","sic":"","filings":{"recent":{"accessionNumber":["a","b"],"form":["4","8-K"],"filingDate":["2024-01-02","2024-01-03"],"acceptanceDateTime":["2024-01-02T18:03:26.000Z","2024-01-03T10:00:00.000Z"],"primaryDocument":["x","y"]},"files":[]}}'
    filed = payloads.filings(df([(index,)], "payload string"))
    assert payloads.insider_filings(filed, F.lit(ts(1)), F.lit(ts(9))).count() == 1
    assert payloads.companies(df([(index,)], "payload string")).first().sic is None
    with pytest.raises(Exception, match="differ in length"):
        payloads.filings(df([(index.replace('"form":["4","8-K"]', '"form":["4"]'),)], "payload string")).collect()
    assert payloads.tickers(df([('{"fields":["cik","name","ticker","exchange"],"data":[["5","Co","brk-b","NYSE"]]}',)], "payload string")).first().ticker == "BRK.B"
    names = df([("AA", 3), ("BB", 2)], "ticker string, security_id int")
    a = payloads.news_a(df([(None, '{"news":[{"id":9,"headline":"H","created_at":"2024-01-02T00:00:00Z","updated_at":"2024-01-03T00:00:00Z","symbols":["aa","bb","zz"],"source":"s"},{"id":1,"headline":"x","created_at":"2024-01-02T00:00:00Z","symbols":["zz"]}]}')], "received_at timestamp, payload string"), names).collect()
    assert [(r.item_id, r.security_ids) for r in a] == [("alpaca:9", [2, 3])] and a[0].source_version.startswith("20240103T000000Z:")
    b = payloads.news_b(df([(None, '{"feed":[{"title":"T","summary":"s","url":"http://u","time_published":"20240102T133000","ticker_sentiment":[{"ticker":"AA"}]}]}')], "received_at timestamp, payload string"), names).first()
    assert b.security_ids == [3] and b.item_id.startswith("av:")
    v = payloads.rate_vintages(df([("s", '{"observations":[{"realtime_start":"2024-01-02","date":"2024-01-01","value":"."},{"realtime_start":"2024-01-02","date":"2023-12-29","value":"5.1"}]}')], "series string, payload string"))
    assert [(r.yield_pct, r.source_version) for r in v.collect()] == [(5.1, "alfred:2024-01-02")]
    assert payloads.vintage_coverage(v, F.lit(ts(5))).first().vintage_count == 1
    pages = df([("q", 1, '{"next_page_token":"n"}'), ("q", 2, '{"next_page_token":null}'), ("z", 1, '{"next_page_token":"m"}')], "request_id string, page int, payload string")
    assert [r.request_id for r in payloads.incomplete_pages(pages).collect()] == ["z"]
    items = df([("i", ts(2), ts(1), "h1"), ("i", ts(2), ts(9), "h2"), ("j", ts(20), ts(20), "h")], "item_id string, published_at timestamp, available_at timestamp, body_hash string")
    assert sorted((r.item_id, r.issue) for r in payloads.stamp_audit(items, F.lit(ts(10))).collect()) == [("i", "available_before_publication"), ("i", "several_texts"), ("j", "future")]


def test_streams(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    store = w.Store(spark, f"file://{tmp_path}/store")
    body = '{"observations":[{"realtime_start":"2024-01-02","date":"2024-01-01","value":"5"}]}'
    parse = lambda b: payloads.rate_vintages(b.withColumn("series", F.lit("x")))
    for k in range(2):
        (landing / f"{k}.json").write_text(body)
        ingest.ingest(ingest.landed_stream(spark, str(landing)), parse, store, "rates", ["series", "observation_date", "vintage_date"], f"{tmp_path}/cp").awaitTermination(60)
    assert store.read("rates", parse(payloads.landed(spark, str(landing))).schema).count() == 1
    weeks = tmp_path / "weeks"
    rows = spark.createDataFrame([("t", k, 0.02, 0.02) for k in range(1, 105)], "test_id string, week int, vs_index double, vs_quant double")
    rows.coalesce(1).write.parquet(str(weeks))
    out = ingest.sequential_stream(spark.readStream.schema(rows.schema).parquet(str(weeks)))
    out.writeStream.format("memory").queryName("weekly").outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
    last = spark.table("weekly").orderBy(F.desc("week")).first()
    batch = sequential.sequential_decisions(rows).first()
    assert (last.week, last.status) == (batch.week, batch.status) and math.isclose(last.wealth_quant, batch.wealth_quant)


def test_fundamentals(spark):
    rows = [(1, "us-gaap:Revenues", dt.date(2020 + k // 4, 3 * (k % 4) + 3, 28), float(100 + k)) for k in range(14)]
    rows += [(1, "us-gaap:GrossProfit", dt.date(2020 + k // 4, 3 * (k % 4) + 3, 28), float(40 + 2 * k)) for k in range(14)]
    df = spark.createDataFrame(rows, "security_id int, concept string, period_end date, value double")
    df = df.withColumn("available_at", F.to_timestamp(F.date_add("period_end", 40))).withColumn("source_version", F.lit("v")).withColumn("period_start", F.date_sub("period_end", 90)).withColumn("unit", F.lit("USD"))
    r = fu.ratios(fu.recent_values(fu.to_series(df)).withColumn("market_cap", F.lit(1000.0))).first()
    assert math.isclose(r.revenue_growth_yoy, 113 / 109 - 1) and math.isclose(r.revenue_growth_3y_cagr, (113 / 101) ** (1 / 3) - 1)
    assert math.isclose(r.gross_margin_trend, 66 / 113 - 58 / 109) and math.isclose(r.ev_sales, 1000 / 113) and r.ev_ebit is None
    q = fu.quarterly_history(df, F.lit(dt.datetime(2023, 8, 10, tzinfo=UTC)))  # the last quarter became known on August 7
    q = q.orderBy(F.desc("period_end")).collect()
    assert q[0].label == "Q-1" and math.isclose(q[0].gross_margin, 66 / 113) and math.isclose(q[0].revenue_growth_yoy, 113 / 109 - 1)


def test_gate_fit_matches_plain_descent(spark):
    rng = random.Random(4)
    rows = [("g", {"a": rng.gauss(0, 1), "b": rng.gauss(3, 2)} if k % 5 else {"a": rng.gauss(0, 1)}, int(rng.random() < 0.4)) for k in range(40)]
    m = gate.fit_logistic(spark.createDataFrame(rows, "g string, values map<string,double>, target int"), ["a", "b"], "g").first()
    seen = [r[1]["b"] for r in rows if "b" in r[1]]
    assert math.isclose(m.means[1], np.mean(seen)) and math.isclose(m.scales[1], np.std(seen))
    rate = sum(r[2] for r in rows) / len(rows)
    wts, b0 = [0.0, 0.0], math.log(rate / (1 - rate))
    x = [[(r[1].get(n, m.means[j]) - m.means[j]) / m.scales[j] for j, n in enumerate("ab")] for r in rows]
    for _ in range(300):
        e = [1 / (1 + math.exp(-(b0 + sum(p * q for p, q in zip(wts, v, strict=True))))) - r[2] for v, r in zip(x, rows, strict=True)]
        b0 -= 0.08 * sum(e) / len(e)
        wts = [p - 0.08 * (sum(ei * v[j] for ei, v in zip(e, x, strict=True)) / len(e) + 0.01 * p) for j, p in enumerate(wts)]
    assert np.allclose(m.coefficients, wts) and math.isclose(m.intercept, b0)


def test_evidence(spark):
    rows = spark.createDataFrame([("r", 1, 0.1, None), ("r", 2, 1e-7, "é")], "run string, k int, x double, s string")
    digest = evidence.commitments(rows, "run", ["k"]).first().sha256
    import hashlib

    want = b'{"rows":[{"k":1,"s":null,"x":0.1},{"k":2,"s":"\\u00e9","x":1e-07}],"run":"r"}'
    assert digest == hashlib.sha256(want).hexdigest()
    stored = spark.createDataFrame([("r", digest), ("q", "x")], "run string, sha256 string")
    assert [r.run for r in evidence.verify_commitments(stored, rows, "run", ["k"]).collect()] == ["q"]
    orders = spark.createDataFrame([("o", "new", 0.0), ("p", "new", 0.0)], "client_order_id string, status string, filled_qty double")
    now = spark.createDataFrame([("o", "filled", 1.0), ("p", "new", 0.0)], orders.schema)
    assert [r.client_order_id for r in evidence.changed_orders(orders, now).collect()] == ["o"]


def test_newest_features_are_those_of_the_newest_bar(spark):
    from tidemark.operators import series
    from tidemark.operators.asof import first_by

    rng = random.Random(5)
    rows = []
    for key, n in ((1, 400), (2, 253), (3, 252), (4, 64), (5, 21), (6, 2), (7, 1)):
        price = 50.0
        for k in range(n):
            price = max(1.0, price * (1 + rng.gauss(0, 0.03)))
            rows.append((key, k, "a", price * 1.01, price * 0.98, price, float(rng.randint(0, 9) if key != 4 else 3)))
    bars = spark.createDataFrame(rows, "security_id int, event_time int, source_version string, high double, low double, close double, volume double")
    every = first_by(series.price_features(bars), ["security_id"], [F.desc("event_time")])
    got = {r.security_id: r for r in series.newest_features(bars).collect()}
    for r in every.collect():
        for c in got[r.security_id].asDict():
            assert (r[c] is None) == (got[r.security_id][c] is None) and (r[c] is None or math.isclose(r[c], got[r.security_id][c], rel_tol=1e-9, abs_tol=1e-12)), (r.security_id, c)
    for n in (1, 2, 5, 63, 64):
        for r in series.with_drawdown(bars, "d", n).filter("security_id in (1, 6)").collect():
            closes = [x[5] for x in rows if x[0] == r.security_id and r.event_time - n < x[1] <= r.event_time]
            assert math.isclose(r.d, min(c / max(closes[: k + 1]) - 1 for k, c in enumerate(closes)), abs_tol=1e-12)


def test_tost_of_any_length(spark):
    rows = [(g, t, x) for g, xs in (("one", [0.1]), ("flat", [0.0] * 5), ("long", [((t * 37) % 11 - 5) / 5000 for t in range(300)])) for t, x in enumerate(xs)]
    got = {r.group: r for r in sequential.tost(spark.createDataFrame(rows, "g string, t int, v double"), "g", "t", "v").collect()}
    assert got["one"].n == 1 and not got["one"].equivalent and got["flat"].equivalent
    x = [r[2] for r in rows if r[0] == "long"]
    n, m, mean = len(x), math.floor(4 * 3 ** (2 / 9)), sum(x) / len(x)
    d = [v - mean for v in x]
    lrv = sum(v * v for v in d) / n + sum(2 * (1 - j / m) * sum(d[k] * d[k - j] for k in range(j, n)) / n for j in range(1, m))
    assert got["long"].bandwidth == m and math.isclose(got["long"].t_lower, (mean + sequential.MARGIN) / math.sqrt(lrv / n), rel_tol=1e-9)


def test_rates_are_those_of_all_pairs(spark):
    from tidemark.operators import calendars

    rng = random.Random(1)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    sessions = sorted(rng.sample(range(120), 70))
    previous = {b: a for a, b in zip(sessions, sessions[1:])}
    rates = [(s, day(o := rng.randrange(120)), day(o + rng.randrange(20)), float(k)) for k, s in enumerate(rng.choice("xy") for _ in range(150))]
    schema = "series string, observation_date date, vintage_date date, yield_pct double"
    asked = spark.createDataFrame([(s, day(k)) for s in "xyz" for k in sessions], "series string, accrual_date date")
    cover = spark.createDataFrame([("x", day(-9), 1), ("y", day(10), 1)], "series string, earliest_vintage date, established_at int")
    before = spark.createDataFrame([(day(k), day(previous[k]) if k in previous else None) for k in sessions], "session_date date, target date")
    for r in calendars.select_rates(asked, spark.createDataFrame(rates, schema), cover, before).collect():
        k = (r.accrual_date - day(0)).days
        usable = [x[1:] for x in rates if x[0] == r.series and x[2] < r.accrual_date and k in previous and x[1] <= day(previous[k])]
        if r.reason is None:
            assert (r.observation_date, r.vintage_date, r.yield_pct) == max(usable)
        else:
            assert not usable or r.series == "z" or (r.series == "y" and r.accrual_date <= day(10))
