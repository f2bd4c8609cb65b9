"""Work that mustn't grow with windows, or be done several times."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from tidemark.functions import text
from tidemark.operators import asof, fundamentals, metrics, outcomes, series

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["sma_distance", "dist_52w_high"])
def test_no_window_is_added_up_row_by_row(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" in plan and "currentrow" not in plan


def test_stretches_against_lists(spark):
    nan = float("nan")
    closes = [3.0, None, 5.0, nan, *(float((i * 37) % 101) for i in range(40)), None, None, None, float("inf"), *(float(i) for i in range(30))]
    rows = [(s, i, "v", c if s else 1.0) for s in (0, 1) for i, c in enumerate(closes)] + [(2, 0, "v", 4.0)]
    bars = spark.createDataFrame(rows, "security_id long, event_time long, source_version string, close double")
    out = series.with_full_means(bars, "close", {1: "m1", 3: "m3", 13: "m13"})
    out = series.with_trailing_max(out, "close", 13, "high")
    out = out.withColumns({f"w{n}": series.full_mean("close", n) for n in (1, 3, 13)}).withColumn("whigh", F.max("close").over(series.trailing(13)))
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        for a, b in (("m1", "w1"), ("m3", "w3"), ("m13", "w13"), ("high", "whigh")):
            x, y = r[a], r[b]
            assert (x is None) == (y is None) and (x is None or x == y or math.isclose(x, y, rel_tol=1e-12) or (math.isnan(x) and math.isnan(y))), (r, a)


def test_rank_ic_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(i % 3, i, float(i * 7 % 11), float(i * 5 % 13)) for i in range(300)]
    df = spark.createDataFrame(rows, "run long, security_id long, p double, ret double")
    assert metrics.rank_ic(df.mapInArrow(run, df.schema), ["run"], "p", "ret", "security_id").count() == 3
    assert seen.value == 300


def test_masker_looks_up_only_where_an_alias_can_begin(monkeypatch):
    looked, found = [], text.Masker._found
    monkeypatch.setattr(text.Masker, "_found", lambda self, t, row, *rest: looked.append(t) or found(self, t, row, *rest))
    m = text.Masker([("T1", "name", "Acme Robotics"), ("T2", "ticker", "BRK.B"), ("T3", "cik", "320193"), ("T4", "name", "Straße")])
    prose = "plain words, 100 of them; " * 100
    assert m.mask(prose + "acme robotics, $brk-b, CIK 0000320193 and STRASSE. Acme") == prose + "T1, T2, T3 and T4. Acme"
    assert len(looked) == 5


def test_clusters_are_counted_without_sets(spark):
    rng = random.Random(4)
    rows = [(k, rng.randint(0, 2), f"F{rng.randint(0, 9)}" if rng.random() < 0.9 else None, dt.date(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 60)), rng.choice("PPS"), rng.random() < 0.8) for k in range(400)]
    rows += [(400, 0, "F1", None, "P", True), (401, None, "F1", dt.date(2024, 1, 5), "P", True)]
    txns = spark.createDataFrame(rows, "id long, security_id long, filer string, txn_date date, code string, acquired boolean")
    for days in (0, 2, 14):
        out = fundamentals.buyer_clusters(txns, days)
        assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {r.id: r.cluster for r in out.collect()}
        assert len(got) == len(rows) and got[400] == got[401] == 0
        for i, s, _, d, _, _ in rows[:400]:
            assert got[i] == len({f for _, s2, f, d2, c, a in rows[:400] if s2 == s and c == "P" and a and f and abs((d2 - d).days) <= days})


def test_nearest_meets_no_pairs(spark):
    rng = random.Random(6)
    day = lambda k: None if k is None else dt.date(1999, 12, 1) + dt.timedelta(days=k)
    some = lambda hi: None if rng.random() < 0.05 else rng.randint(0, hi)
    lefts = [(i, some(2), some(3000)) for i in range(500)]
    rights = [(k, d, None if rng.random() < 0.1 else float(d)) for k in (None, 0, 1) for d in sorted(rng.sample(range(3000), 200))]
    left = spark.createDataFrame([(i, k, day(d)) for i, k, d in lefts], "id int, k int, asked date")
    right = spark.createDataFrame([(k, day(d), v) for k, d, v in [*rights, (0, None, 1.0)]], "k int, at date, v double")
    for days in (0, 3, 40):
        out = asof.nearest_within(left, right, ["k"], F.col("asked"), "at", days, "v", "found")
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {r.id: r.found for r in out.collect()}
        assert len(got) == len(lefts)
        for i, k, d in lefts:
            near = [] if None in (k, d) else sorted((abs(e - d), e, v) for k2, e, v in rights if k2 == k and abs(e - d) <= days)[:1]
            assert got[i] == (near[0][2] if near else None), (i, k, d)


def test_outcomes_read_pairs_and_stored_once(spark):
    read = {"pairs": spark.sparkContext.accumulator(0), "stored": spark.sparkContext.accumulator(0)}

    def counted(df, what):
        def run(batches, seen=read[what]):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    t = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    at = lambda k: F.to_timestamp_ntz(F.lit(str(t(k))))
    pairs = spark.createDataFrame([("r", s, 5, t(0).date(), t(5).date()) for s in range(40)], "run_id string, security_id long, horizon int, entry_day date, end_day date")
    # odd securities' ends are revised on day 9, every third to the same price
    rows = [(s, t(d).date(), 10.0 + d, t(d), "a") for s in range(40) for d in (0, 5)] + [(s, t(5).date(), 15.0 if s % 3 == 0 else 20.0, t(9), "b") for s in range(1, 40, 2)]
    prices = spark.createDataFrame(rows, "security_id long, day date, close double, available_at timestamp_ntz, source_version string")
    stored = outcomes.newly_resolved(spark.createDataFrame([], outcomes.OUTCOME), pairs.filter("security_id < 30"), prices, None, at(6)).localCheckpoint()
    got = outcomes.newly_resolved(counted(stored, "stored"), counted(pairs, "pairs"), prices, at(6), at(10)).collect()
    assert sorted(r.security_id for r in got) == [s for s in range(40) if s >= 30 or (s % 2 and s % 3)]
    assert read["pairs"].value == 40 and read["stored"].value == 30
    assert not [r for r in outcomes.newly_resolved(stored, pairs.filter("security_id < 30"), prices, None, at(10)).collect()]


def test_adjusted_prices_are_sorted_once(spark):
    plan = registry.queries()["adjusted_prices"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "_split" in line]
    assert windows and not any("DESC" in line for line in windows)


def test_walk_forward_computes_features_once(spark):
    from tidemark.plans.features import walk_forward

    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    t = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    rows = [(s, t(k), {"a": float((s * 7 + k) % 5)}) for s in range(6) for k in (0, 10)]
    features = spark.createDataFrame(rows, "security_id long, event_time timestamp_ntz, values map<string,double>")
    # labels end after the date, so that there is nothing to fit
    labels = spark.createDataFrame([(s, t(0), t(40), s > 2) for s in range(6)], "security_id long, feature_time timestamp_ntz, label_end timestamp_ntz, is_top_tercile boolean")
    sectors = spark.createDataFrame([(s, "x") for s in range(6)], "security_id long, sector string")
    vols = spark.createDataFrame([(str(t(10)), s, 0.2) for s in range(6)], "as_of string, security_id long, sigma double")
    counted = features.mapInArrow(run, features.schema)
    assert walk_forward(counted, labels, [F.to_timestamp_ntz(F.lit(str(t(10))))], sectors, vols, 2).count() == 6
    assert seen.value == 12


WORDS = (
    "Acme", "robotics", "acme robotics", "cik", "CIK", "no", "nono", "ciknono", "0000320193", "320193", "$brk-b", "BRK.B", "brk", "5", "5,000", "2024", "2024-02-01", "12", "3.14159", "$", "usd", "million", "Million",
    "shares", "sharesmay", "dollars", "dollarsmay", "usdmay", "euros", "may", "sept.", "March", "Q1", "FY", "fiscal", "year", "k", "mm", "bn", "t", "café", "café", "́", " ", " ", "ﬁne", "٥", "K",
    "plain", "words", "Here", "is", "prose", ",", ".", ":", ";", "-", "/", "(", "\U0001f600",
)


def test_an_opening_is_shown_as_the_whole_text_is(spark):
    rng = random.Random(7)
    m = text.Masker([("TICKER_000123", "name", "Acme Robotics"), ("5 million", "name", "is prose"), ("T2", "ticker", "BRK.B"), ("T3", "cik", "320193")])
    odd = lambda: "".join(rng.choice((*WORDS, *("goes", "with", "them", "along") * 6)) + rng.choice((" ", " ", " ", " ", "  ", "\n", "\t", "\r\n", "", " ")) for _ in range(rng.randint(0, 60)))
    plain = "some plain text of it 5 million dollarsmay 7 2024 here "
    texts = [odd() for _ in range(1500)] + [plain * 100, "x" * 5000, "9" * 300 + " end of it" * 400, "", None]
    shown = lambda c, n: text.clean(text.scrub(m.column(F.coalesce(c, F.lit("")))), n)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for n in (1, 12, 400):
        got = df.select("i", "t", m.opening(F.col("t"), n).alias("o")).select("i", "t", "o", shown(F.col("t"), n).alias("whole"), shown(F.col("o"), n).alias("own")).collect()
        assert len(got) == len(texts)
        for r in got:
            assert r.own == r.whole and ((r.o is None and r.t is None) or r.t.startswith(r.o)), (n, r.t, r.o)
        by = {r.i: r.o for r in got}
        assert by[1501] == "x" * 5000
        assert n == 1 or len(by[1500]) < 2 * n + 60
        assert n != 12 or sum(by[i] != texts[i] for i in range(1500)) > 100


def test_every_word_of_a_pattern_is_known_to_scrub():
    patterns = (text.AMOUNT, text.MAGNITUDE, text.SHARES, *text.DATES, text.LONG_NUMBER)
    assert all(r"\d" in p or "[0-9]" in p or "19|20" in p or "[1-4]" in p for p in patterns)
    for word in "USD EUR GBP thousand trillion bn mm shares dollars euros usd January jun june July sept Dec Q FY fiscal year".split():
        assert word.lower() in text.SCRUBBED
    assert all(w in text.SCRUBBED for w in text.SCRUBBED_FRONTS)


def test_summaries_are_masked_as_far_as_they_are_shown(spark):
    from tidemark.operators import partitions

    seen, m, now = spark.sparkContext.accumulator(0), text.Masker([("T1", "name", "Acme")]), dt.datetime(2024, 3, 1)

    def mask(c):
        @F.pandas_udf("string")
        def counted(values):
            seen.add(int(values.str.len().sum()))
            return values.map(m.mask)

        return counted(c)

    rows = [(1, f"i{k}", "Acme", "Acme makes plain things and 5 million words of it. " * 200, now - dt.timedelta(hours=k)) for k in range(5)]
    news = spark.createDataFrame(rows, "security_id int, item_id string, headline string, summary string, event_time timestamp").withColumn("available_at", F.col("event_time"))
    tables = [partitions.news_table(news, F.lit(now), mask, *more).collect() for more in ((m.opening,), ())]
    assert tables[0] == tables[1] and len(tables[0]) == 1
    assert seen.value < 5 * (10_200 + 4) + 5 * (1_000 + 4)


def test_insider_trades_are_chosen_before_they_are_judged(spark):
    from tidemark.operators import partitions

    rng = random.Random(8)
    now = dt.datetime(2024, 3, 1, 12)
    date = lambda k: None if k is None else now.date() - dt.timedelta(days=k)
    rows = []
    for k in range(6000):
        d = rng.choice([None, *range(-3, 260)] if rng.random() < 0.4 else range(1500))
        rows.append((rng.choice((None, 1, 2, 3)) if k % 50 == 0 else rng.randint(1, 3), rng.choice(("a", "b", "c", "d", None)), date(d), rng.choice("PPSM"), rng.random() < 0.8, now - dt.timedelta(days=(d or 0) - rng.choice((0, 1, 40))), f"{k:05}", 0))
    txns = spark.createDataFrame(rows, "security_id int, filer string, txn_date date, code string, acquired boolean, available_at timestamp, accession string, seq int")
    visible = txns.filter(F.col("available_at") <= F.lit(now))
    today = F.to_date(F.lit(now))
    chosen = visible.filter(F.datediff(today, "txn_date").between(0, 180)).filter("accession % 3 = 0")
    span = (F.date_sub(today, 180), today)
    keys = ["accession", "tag", "cluster"]
    want = fundamentals.buyer_clusters(fundamentals.trade_tags(visible, 3)).join(chosen.filter("security_id is not null").select("accession"), "accession").select(keys)
    got = fundamentals.trade_tags(fundamentals.buyer_clusters(chosen, 14, visible, span), 3, visible, span).select(keys)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    tags = {r.tag for r in got.collect()}
    assert tags >= {"ROUTINE", "OPPORTUNISTIC"}

    # a span of more than a year
    chosen, span = visible.filter(F.datediff(today, "txn_date").between(0, 500)), (F.date_sub(today, 500), today)
    want = fundamentals.trade_tags(visible, 2).join(chosen.filter("security_id is not null").select("accession"), "accession").select("accession", "tag")
    got = fundamentals.trade_tags(chosen, 2, visible, span).select("accession", "tag")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    entities = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)], "security_id int, cik int, adv30_usd double")
    full = txns.withColumns({"role": F.lit("officer"), "officer_title": F.lit("CEO"), "shares": F.lit(1.0), "price": F.lit(1.0), "post_holdings": F.lit(1.0), "is_10b5_1": F.lit(False)})
    plan = partitions.insider_table(entities, full, F.lit(now))._jdf.queryExecution().optimizedPlan().toString()
    # no months are collected of all trades
    assert "collect_set" not in plan and "bit_or" in plan


def test_texts_of_revisions_out_of_the_last_days_are_not_read(spark):
    from tidemark.operators import partitions

    seen, now = spark.sparkContext.accumulator(0), dt.datetime(2024, 3, 1)

    def opening(c, n):
        @F.pandas_udf("string")
        def counted(values):
            seen.add(int(values.notna().sum()))
            return values

        return counted(c)

    ago = lambda d: now - dt.timedelta(days=d)
    rows = [(1, "a", "h a", "s a", ago(1), ago(1)), (1, "b", "h b", "s b", ago(2), ago(2)), (1, "b", "h old", "s old", ago(50), ago(1)), (1, "c", None, None, ago(3), ago(3)), (1, "d", "h d", "s d", ago(90), ago(90))]
    news = spark.createDataFrame(rows, "security_id int, item_id string, headline string, summary string, event_time timestamp, available_at timestamp")
    body = partitions.news_table(news, F.lit(now), lambda c: c, opening).collect()[0].body
    # an item without a headline can't be told from an analyst's, and isn't shown
    assert body.splitlines()[1:] == ["NEWS_1\tt-1d\th a\ts a"] and seen.value == 2
