"""Queries over a run's life: agents' texts, aliases, halts, the work queue, row checks, and landed provider pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import calendars, partitions
from tidemark.plans.bindings import load, query
from tidemark.plans.features import FUNDAMENTAL, PRICE
from tidemark.sources import payloads, writes


@query("agent_partitions")
def agent_partitions(spark, sf_dir):
    """Suppliers as securities: orders give facts, line items give trades, documents give news."""
    s, o, l, d = (load(spark, sf_dir, t) for t in ("supplier", "orders", "lineitem", "documents"))
    i = F.col("s_suppkey")
    n = s.agg(F.count(F.lit(1))).scalar()
    sector = F.concat(F.lit("S"), (i % 5).cast("string"))
    entities = s.select(i.alias("security_id"), F.concat(F.lit("TICKER_"), F.lpad(i.cast("string"), 6, "0")).alias("entity_token"), i.alias("cik"), sector.alias("sector"), F.element_at(F.array(*map(F.lit, ("small", "mid", "large"))), (i % 3 + 1).cast("int")).alias("mcap_tier"), (i * 1000.0).alias("adv30_usd"))
    named = F.map_from_entries(F.array(*(F.struct(F.lit(name), ((i * (k + 7)) % 101 / 100.0).alias("v")) for k, name in enumerate((*PRICE, *FUNDAMENTAL)))))
    universe = s.select(i.alias("security_id"), sector.alias("sector"), (i % 4 != 0).alias("included"), named.alias("values"))
    owner = lambda c: (F.pmod(c, n) + 1).alias("security_id")
    end = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    facts = o.select(
        owner(F.col("o_custkey")), F.element_at(F.array(*map(F.lit, ("us-gaap:Revenues", "us-gaap:NetIncomeLoss"))), (F.col("o_orderkey") % 2 + 1).cast("int")).alias("concept"), end.alias("period_end"),
        F.date_sub(end, 90).alias("period_start"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").cast("timestamp").alias("available_at"), F.col("o_orderkey").cast("string").alias("source_version"),
    )
    txns = l.select(
        F.col("l_suppkey").alias("security_id"), F.concat(F.lit("PERSON "), F.col("l_partkey") % 40).alias("filer"), F.lit("officer").alias("role"), F.when(F.col("l_linenumber") == 1, "CEO").alias("officer_title"),
        F.to_date("l_shipdate").alias("txn_date"), F.when(F.col("l_linestatus") == "O", "P").otherwise("S").alias("code"), (F.col("l_linestatus") == "O").alias("acquired"), F.col("l_quantity").alias("shares"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_quantity") * 3).alias("post_holdings"), (F.col("l_returnflag") == "A").alias("is_10b5_1"),
        F.col("l_shipdate").cast("timestamp").alias("available_at"), F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("seq"),
    )
    day = F.timestamp_seconds(F.lit(899_251_200) - F.col("doc_id") % 4_000_000)
    news = d.select(owner(F.col("doc_id")), F.col("doc_id").cast("string").alias("item_id"), F.substring_index("text", "\n", 1).alias("headline"), F.col("text").alias("summary"), day.alias("event_time"), day.alias("available_at"))
    regime = spark.createDataFrame([("spy_return_1m", 0.0123), ("yield_10y_pct", None)], "feature string, value double")
    masker = text.Masker([("ENTITY_01", "name", "for the")])
    return partitions.agent_partitions(F.to_timestamp(F.lit("1998-07-01 00:00:00")), entities, universe, facts, txns, news, regime, masker.column, FUNDAMENTAL, PRICE, masker.opening).select("agent", "security_id", "text", "input_hash", F.size("evidence").alias("cited"))


@query("alias_list", "SELECT * FROM (SELECT s_suppkey AS security_id, 'name' AS kind, s_name || ' Holdings Inc.' AS text FROM supplier UNION ALL SELECT s_suppkey, 'name', s_name || ' Holdings' FROM supplier UNION ALL SELECT s_suppkey, 'ticker', 'T' || s_suppkey FROM supplier UNION ALL SELECT s_suppkey, 'cik', CAST(1000 + s_nationkey AS VARCHAR) FROM supplier UNION ALL SELECT s_suppkey, 'brand', n_name || ' Best' FROM supplier JOIN nation ON s_nationkey = n_nationkey)")
def alias_list(spark, sf_dir):
    """Names, tickers, filer numbers and brands; spellings that differ in case only count once."""
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    securities = s.select(F.col("s_suppkey").alias("security_id"), F.concat(F.lit(" "), "s_name", F.lit(" Holdings Inc.")).alias("name"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"), (1000 + F.col("s_nationkey")).alias("cik"))
    brands = n.select((1000 + F.col("n_nationkey")).alias("cik"), F.explode(F.array(F.concat("n_name", F.lit(" Best ")), F.concat("n_name", F.lit(" BEST")))).alias("brand"))
    return text.alias_rows(securities, brands).select("security_id", "kind", F.when(F.col("kind") == "brand", F.concat(F.regexp_replace("text", "(?i) best$", ""), F.lit(" Best"))).otherwise(F.col("text")).alias("text"))


_STATES = "['PENDING', 'COMMITTED', 'ANCHORED', 'EXECUTED', 'FAILED', 'GATED']"


def _states(spark, sf_dir):
    i = F.col("o_orderkey")
    state = F.element_at(F.array(*map(F.lit, ("PENDING", "COMMITTED", "ANCHORED", "EXECUTED", "FAILED", "GATED"))), (i % 6 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select(i.alias("run_id"), state.alias("status"), F.lit(None).cast("string").alias("status_reason"), F.lit(None).cast("string").alias("ended_at"), F.when(i % 4 != 0, "live").otherwise("backtest").alias("mode"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.col("o_orderdate").cast("timestamp").alias("as_of"))


@query("halted_runs", f"""WITH e AS (SELECT l_orderkey AS run_id, arg_min(l_linenumber, l_shipdate::VARCHAR || l_linenumber) AS why, strftime(min(l_shipdate), '%Y-%m-%d') AS halt_day FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), r AS (SELECT o_orderkey AS run_id, {_STATES}[CAST(o_orderkey % 6 AS INTEGER) + 1] AS status FROM orders)
  SELECT r.run_id, CASE WHEN why IS NOT NULL AND status IN ('COMMITTED', 'ANCHORED', 'EXECUTED') THEN 'PARTIAL' ELSE status END AS status, CASE WHEN why IS NOT NULL AND status IN ('COMMITTED', 'ANCHORED', 'EXECUTED') THEN 'kill_switch:' || why END AS status_reason, CASE WHEN why IS NOT NULL AND status IN ('COMMITTED', 'ANCHORED', 'EXECUTED') THEN halt_day END AS ended_at FROM r LEFT JOIN e ON r.run_id = e.run_id""")
def halted_runs(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    events = l.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("string").alias("trigger"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("triggered_at"))
    return writes.halted_runs(_states(spark, sf_dir), events).select("run_id", "status", "status_reason", "ended_at")


@query("work_queue", f"""WITH r AS (SELECT o_orderkey AS run_id, {_STATES}[CAST(o_orderkey % 6 AS INTEGER) + 1] AS status, CAST(o_orderdate AS DATE) AS d, o_orderkey % 4 <> 0 AS live FROM orders)
  SELECT run_id, CASE status WHEN 'ANCHORED' THEN 'execute' ELSE 'advance' END AS task FROM r WHERE live AND (status IN ('COMMITTED') OR (status IN ('PENDING', 'GATED') AND d < DATE '1996-06-12') OR (status = 'ANCHORED' AND d - 1 BETWEEN DATE '1996-06-01' AND DATE '1996-06-10'))
  UNION ALL SELECT DISTINCT o_orderkey, 'reconcile' FROM orders WHERE o_orderstatus = 'P'""")
def work_queue(spark, sf_dir):
    """One long session, to which the runs of ten dates lead."""
    session = spark.createDataFrame([("1996-06-01", "1996-06-01 14:00:00", "1996-06-01 21:00:00"), ("1996-06-11", "1996-06-11 14:00:00", "1996-06-13 21:00:00")], "d string, a string, b string")
    sessions = session.select(F.to_date("d").alias("session_date"), F.to_timestamp("a").alias("open_at"), F.to_timestamp("b").alias("close_at"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    return calendars.work_queue(_states(spark, sf_dir), orders, sessions, F.to_timestamp(F.lit("1996-06-12 00:30:00")), ["F", "O"])


@query("row_checks", "SELECT l_orderkey, l_linenumber, l_quantity < 5 OR (l_suppkey % 6 = 0) AS apart FROM lineitem")
def row_checks(spark, sf_dir):
    """Bars that break the order of their prices, or came from another feed, are set apart."""
    price = F.col("l_extendedprice")
    b = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", price.alias("open"), (price + 1).alias("high"), F.when(F.col("l_quantity") < 5, price + 2).otherwise(price).alias("low"), price.alias("close"),
        F.col("l_quantity").alias("volume"), F.lit("sip").alias("feed"), F.when(F.col("l_suppkey") % 6 == 0, "iex").otherwise("sip").alias("source_version"),
    )
    sound, apart = writes.checked("price_bars", b)
    return sound.withColumn("apart", F.lit(False)).unionByName(apart.withColumn("apart", F.lit(True))).select("l_orderkey", "l_linenumber", "apart")


@query("period_checks", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def period_checks(spark, sf_dir):
    """Facts whose period starts after its end; one without a start is sound."""
    day, i = F.to_date("o_orderdate"), F.col("o_orderkey")
    start = F.when(i % 5 == 0, F.date_add(day, 1)).when(i % 7 != 0, day)
    f = load(spark, sf_dir, "orders").select("o_orderkey", start.alias("period_start"), day.alias("period_end"))
    return writes.checked("fundamentals_asfiled", f)[1].select("o_orderkey")


@query("source_tickers", "SELECT c_custkey AS cik, c_name AS name, replace(upper('ab-' || c_nationkey), '-', '.') AS ticker FROM customer")
def source_tickers(spark, sf_dir):
    """A header and a matrix for each nation."""
    row = F.array(F.concat(F.lit("ab-"), F.col("c_nationkey").cast("string")), F.col("c_custkey").cast("string"), F.col("c_name"), F.lit("X"))
    pages = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(row).alias("data")).select(F.to_json(F.struct(F.array(*map(F.lit, ("ticker", "cik", "name", "exchange"))).alias("fields"), "data")).alias("payload"))
    return payloads.tickers(pages).select("cik", "name", "ticker")


@query("source_filings", "SELECT o_custkey AS cik, CAST(o_orderkey AS VARCHAR) AS accession, '4' AS form, strftime(o_orderdate, '%Y-%m-%d') AS filed FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def source_filings(spark, sf_dir):
    """Insider filings of two years out of submission indexes, which hold their columns as parallel arrays."""
    o = load(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    row = F.struct(F.col("o_orderkey").cast("string").alias("a"), F.when(F.col("o_orderstatus") == "F", "4").otherwise("10-Q").alias("b"), F.col("day").alias("c"), F.concat("day", F.lit("T12:00:00.000Z")).alias("d"))
    rows = o.groupBy("o_custkey").agg(F.collect_list(row).alias("r"))
    recent = F.struct(F.col("r.a").alias("accessionNumber"), F.col("r.b").alias("form"), F.col("r.c").alias("filingDate"), F.col("r.d").alias("acceptanceDateTime"), F.col("r.a").alias("primaryDocument"))
    pages = rows.select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))).alias("payload"))
    found = payloads.insider_filings(payloads.filings(pages), F.to_timestamp(F.lit("1994-01-01 00:00:00")), F.to_timestamp(F.lit("1996-01-01 00:00:00")))
    return found.select("cik", "accession", "form", F.date_format("filing_date", "yyyy-MM-dd").alias("filed"))


@query("source_facts", "SELECT o_custkey AS security_id, 'us-gaap:' || o_orderstatus AS concept, CAST(o_orderkey AS VARCHAR) AS source_version, o_totalprice AS value, strftime(o_orderdate, '%Y-%m-%d') AS period_end FROM orders WHERE o_orderstatus <> 'P'")
def source_facts(spark, sf_dir):
    """Facts out of maps of taxonomies, names and units."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    entry = F.struct(day.alias("end"), F.col("o_totalprice").alias("val"), F.col("o_orderkey").cast("string").alias("accn"), day.alias("filed"))
    named = load(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.struct(F.create_map(F.lit("USD"), F.collect_list(entry)).alias("units")).alias("body"))
    pages = named.groupBy(F.col("o_custkey").alias("security_id")).agg(F.to_json(F.struct(F.create_map(F.lit("us-gaap"), F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "body")))).alias("facts"))).alias("payload"))
    accepted = spark.createDataFrame([], "accession string, accepted_at timestamp")
    return payloads.company_facts(pages, accepted, ["us-gaap:F", "us-gaap:O"]).select("security_id", "concept", "source_version", "value", F.date_format("period_end", "yyyy-MM-dd").alias("period_end"))


@query("source_vintages", "SELECT 's' || c_nationkey AS series, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1")
def source_vintages(spark, sf_dir):
    """Observations of rate series; a point stands for none."""
    c = load(spark, sf_dir, "customer")
    value = F.when(F.col("c_custkey") % 5 == 0, ".").otherwise(F.col("c_acctbal").cast("string"))
    pages = c.groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.lit("2024-01-03").alias("realtime_start"), F.lit("2024-01-02").alias("date"), value.alias("value"))).alias("observations"))).alias("payload"))
    found = payloads.rate_vintages(pages.withColumn("series", F.concat(F.lit("s"), F.col("c_nationkey").cast("string"))))
    return found.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("yield_pct"), 2).alias("total"))


@query("vintage_coverage", "SELECT CAST(o_custkey AS VARCHAR) AS series, count(DISTINCT CAST(o_orderdate AS DATE)) AS n, sha256(string_agg(DISTINCT strftime(o_orderdate, '%Y-%m-%d'), chr(10) ORDER BY strftime(o_orderdate, '%Y-%m-%d'))) AS digest FROM orders GROUP BY 1")
def vintage_coverage(spark, sf_dir):
    v = load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("series"), F.to_date("o_orderdate").alias("vintage_date"))
    return payloads.vintage_coverage(v, F.current_timestamp()).select("series", F.col("vintage_count").alias("n"), F.col("vintage_dates_sha256").alias("digest"))


@query("source_news", "SELECT 'alpaca:' || doc_id AS item_id, CAST(1 + doc_id % 3 AS VARCHAR) AS ids, substr(coalesce(text, ''), 1, 20000) AS summary, source AS publisher FROM documents WHERE doc_id % 4 <> 3")
def source_news(spark, sf_dir):
    """News pages whose symbols are partly known; items without a known one go."""
    i = F.col("doc_id")
    symbol = F.when(i % 4 != 3, F.concat(F.lit("k"), (1 + i % 3).cast("string"))).otherwise("zz")
    item = F.struct(i.cast("string").alias("id"), F.lit("h").alias("headline"), F.lit("2024-01-02T03:04:05Z").alias("created_at"), F.col("text").alias("summary"), F.array(symbol, symbol).alias("symbols"), F.col("source").alias("source"))
    pages = load(spark, sf_dir, "documents").select(F.to_json(F.struct(F.array(item).alias("news"))).alias("payload"), F.to_timestamp(F.lit("2024-01-03 00:00:00")).alias("received_at"))
    securities = spark.createDataFrame([("K1", 1), ("K2", 2), ("K3", 3)], "ticker string, security_id int")
    return payloads.news_a(pages, securities).select("item_id", F.array_join(F.col("security_ids").cast("array<string>"), ",").alias("ids"), "summary", "publisher")


@query("stamp_audit", """SELECT CAST(event_id AS VARCHAR) AS item_id, issue FROM (SELECT event_id, 'future' AS issue FROM events WHERE ts > TIMESTAMP '2024-01-20' UNION ALL SELECT event_id, 'available_before_publication' FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'late_revision' FROM events WHERE event_id % 3 = 1)""")
def stamp_audit(spark, sf_dir):
    days = F.element_at(F.array(F.lit(-1), F.lit(31), F.lit(2)), (F.col("event_id") % 3 + 1).cast("int"))
    items = load(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("item_id"), F.col("ts").alias("published_at"), (F.col("ts") + F.make_dt_interval(days=days)).alias("available_at"), F.lit("b").alias("body_hash"))
    return payloads.stamp_audit(items, F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))).select("item_id", "issue")
