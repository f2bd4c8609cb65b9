"""Queries over sources, writes, lookups and small rules, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, text
from tidemark.operators import asof, committee, evidence
from tidemark.operators import fundamentals as fu
from tidemark.plans.bindings import load, query, r6
from tidemark.sources import payloads, writes


@query("source_bars", "SELECT l_suppkey AS security_id, strftime(l_shipdate, '%Y-%m-%d') AS day, l_quantity AS volume, l_extendedprice AS close, 'iex' AS feed FROM lineitem")
def source_bars(spark, sf_dir):
    """Bars of one JSON page for each supplier, read back."""
    bar = F.struct(F.date_format("l_shipdate", "yyyy-MM-dd'T'05:00:00'Z'").alias("t"), *(F.col("l_extendedprice").alias(c) for c in "ohlc"), F.col("l_quantity").alias("v"))
    pages = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("security_id"), F.pmod("l_orderkey", F.lit(50)).alias("page")).agg(F.to_json(F.struct(F.collect_list(bar).alias("bars"))).alias("payload"))
    got = payloads.bars(pages.withColumn("received_at", F.current_timestamp()), "iex")
    return got.select("security_id", F.date_format("event_time", "yyyy-MM-dd").alias("day"), "volume", "close", "feed")


@query("source_trades", "SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, value AS price, CAST(event_id AS VARCHAR) AS trade_id, epoch_us(ts) AS micros FROM events")
def source_trades(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    tick = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'123Z'").alias("t"), F.col("value").alias("p"), F.lit(1).alias("s"), F.lit("A").alias("z"), F.array(F.lit("@")).alias("c"), F.col("event_id").alias("i"))
    symbol = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    pages = e.groupBy(symbol.alias("symbol"), F.pmod("event_id", F.lit(40)).alias("page")).agg(F.collect_list(tick).alias("trades")).select(F.to_json(F.struct("symbol", "trades")).alias("payload"))
    return payloads.trades(pages).select("symbol", "price", F.col("trade_id").cast("string").alias("trade_id"), F.unix_micros("time").alias("micros"))


@query("widen_listing", """WITH o AS (SELECT l_suppkey AS k, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), n AS (SELECT l_suppkey AS k, min(l_shipdate) AS a, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE max(l_shipdate) END AS b FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
  SELECT coalesce(o.k, n.k) AS security_id, strftime(least(o.a, n.a), '%Y-%m-%d') AS listed_from, strftime(CASE WHEN n.k IS NULL THEN o.b ELSE n.b END, '%Y-%m-%d') AS listed_to FROM o FULL JOIN n ON o.k = n.k""")
def widen_listing(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")
    spans = lambda status: l.filter(F.col("l_linestatus") == status).groupBy(F.col("l_suppkey").alias("security_id")).agg(F.min("l_shipdate").alias("listed_from"), F.max("l_shipdate").alias("listed_to"))
    changes = spans("O").withColumn("listed_to", F.when(F.col("security_id") % 3 != 0, F.col("listed_to")))
    out = writes.widen_listing(spans("F"), changes)
    return out.select("security_id", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("listed_from", "listed_to")))


_RUNS = """runs AS (SELECT o_orderkey AS run_id, ['PENDING', 'COMMITTED', 'PARTIAL', 'ANCHORED', 'FAILED'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS status, CASE WHEN o_orderkey % 10 = 2 THEN 'kill_switch: loss' END AS status_reason, o_totalprice AS total_cost_usd, o_custkey AS owner FROM orders)"""


def _runs(spark, sf_dir):
    i = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ["PENDING", "COMMITTED", "PARTIAL", "ANCHORED", "FAILED"])), (i % 5).cast("int") + 1)
    return load(spark, sf_dir, "orders").select(i.alias("run_id"), status.alias("status"), F.when(i % 10 == 2, "kill_switch: loss").alias("status_reason"), F.col("o_totalprice").alias("total_cost_usd"), F.col("o_custkey").alias("owner"))


@query("upsert_runs", f"""WITH {_RUNS}, n AS (SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'PARTIAL' ELSE 'EXECUTED' END AS status, owner + 1 AS owner, total_cost_usd + 1 AS total_cost_usd FROM runs WHERE run_id % 3 = 0),
  b AS (SELECT r.*, n.status AS s2, n.total_cost_usd AS c2, n.run_id IS NULL OR (r.status IN ('COMMITTED', 'ANCHORED') AND n.status = 'PARTIAL') OR (r.status = 'PARTIAL' AND r.status_reason IS NOT NULL) AS stays FROM runs r LEFT JOIN n ON r.run_id = n.run_id)
  SELECT run_id, CASE WHEN stays THEN status ELSE s2 END AS status, round(CASE WHEN stays THEN total_cost_usd ELSE c2 END, 4) AS cost, owner FROM b""")
def upsert_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    changes = runs.filter("run_id % 3 = 0").withColumns({"status": F.when(F.col("run_id") % 2 == 0, "PARTIAL").otherwise("EXECUTED"), "owner": F.col("owner") + 1, "total_cost_usd": F.col("total_cost_usd") + 1})
    return writes.upsert_runs(runs, changes).select("run_id", "status", F.round("total_cost_usd", 4).alias("cost"), "owner")


@query("advance_runs", f"WITH {_RUNS} SELECT run_id, CASE WHEN owner % 4 = 1 AND status = 'COMMITTED' THEN 'ANCHORED' ELSE status END AS status FROM runs")
def advance_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return writes.advance(runs, runs.filter("owner % 4 = 1").select("run_id"), "COMMITTED", "ANCHORED").select("run_id", "status")


@query("anchor_mismatches", "SELECT c_custkey AS run_id FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 3 = 0")
def anchor_mismatches(spark, sf_dir):
    a = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.sha2("c_name", 256).alias("sha256"))
    again = a.filter("run_id % 4 = 0").withColumn("sha256", F.when(F.col("run_id") % 3 == 0, F.lit("other")).otherwise(F.col("sha256")))
    return writes.anchor_mismatches(a, again)


@query("upsert_anchors", "SELECT c_custkey AS run_id, CASE WHEN c_custkey % 4 = 0 AND c_nationkey <> 3 THEN 'seen' ELSE c_mktsegment END AS state FROM customer")
def upsert_anchors(spark, sf_dir):
    a = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("state"), "c_nationkey")
    changes = a.filter("run_id % 4 = 0").select("run_id", F.when(F.col("c_nationkey") != 3, "seen").alias("state"))
    return writes.upsert_anchors(a.drop("c_nationkey"), changes)


@query("upsert_orders", "SELECT o_orderkey AS client_order_id, CASE WHEN o_orderkey % 5 = 0 THEN 'filled' ELSE o_orderstatus END AS status, o_custkey AS symbol FROM orders")
def upsert_orders(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("client_order_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("symbol"))
    changes = o.filter("client_order_id % 5 = 0").withColumns({"status": F.lit("filled"), "symbol": F.col("symbol") + 7})
    return writes.upsert_orders(o, changes, evidence.MUTABLE)


@query("changed_orders", "SELECT o_orderkey AS client_order_id, 'filled' AS status FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0")
def changed_orders(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("client_order_id"), F.when(F.col("o_orderkey") % 3 == 0, "filled").otherwise(F.col("o_orderstatus")).alias("status"))
    return evidence.changed_orders(o, o.withColumn("status", F.when(F.col("client_order_id") % 5 == 0, "filled").otherwise(F.col("status"))))


@query("runs_by_status", f"WITH {_RUNS} SELECT status, count(*) AS n, round(sum(total_cost_usd), 2) AS cost FROM runs WHERE status IN ('COMMITTED', 'PARTIAL') GROUP BY 1")
def runs_by_status(spark, sf_dir):
    own = _runs(spark, sf_dir).filter(F.col("status").isin("COMMITTED", "PARTIAL"))
    return own.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total_cost_usd"), 2).alias("cost"))


@query("point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END FROM customer WHERE c_acctbal > 0)")
def point_lookup(spark, sf_dir):
    """Rows whose composite key is among those of another table."""
    keys = load(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O").alias("o_orderstatus"))
    return load(spark, sf_dir, "orders").join(keys, ["o_custkey", "o_orderstatus"], "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("identifier_maps", "SELECT c_nationkey AS cik, array_to_string(list_sort(list(c_custkey)), ',') AS ids FROM customer GROUP BY 1")
def identifier_maps(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("cik")).agg(F.array_join(F.array_sort(F.collect_list("c_custkey")).cast("array<string>"), ",").alias("ids"))


@query("array_membership_join", "SELECT d.doc_id, s_suppkey FROM (SELECT doc_id, unnest([doc_id % 7, doc_id % 11, 100 + doc_id % 3]) AS id FROM documents) d JOIN supplier ON s_suppkey = id")
def array_membership_join(spark, sf_dir):
    i = F.col("doc_id")
    tagged = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(i % 7, i % 11, 100 + i % 3)).alias("s_suppkey"))
    return tagged.join(load(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select("doc_id", "s_suppkey")


@query("ordered_distinct", "SELECT user_id, array_to_string(list(event_type ORDER BY first_id), ',') AS types FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark, sf_dir):
    """Each user's event types in the order in which they first came."""
    first = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x.event_type), ",").alias("types"))


@query("filtered_median", "SELECT o_custkey, round(median(o_totalprice) FILTER (o_orderstatus <> 'P'), 4) AS mid FROM orders GROUP BY 1")
def filtered_median(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.median(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))), 4).alias("mid"))


@query("projection_without", "SELECT * EXCLUDE (n_name) FROM nation")
def projection_without(spark, sf_dir):
    return load(spark, sf_dir, "nation").drop("n_name")


@query("visible_versions", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-30' AND o_orderdate > TIMESTAMP '1997-06-30' - INTERVAL 400 DAY")
def visible_versions(spark, sf_dir):
    """All versions that an instant sees, none left out as superseded."""
    as_of = F.to_timestamp_ntz(F.lit("1997-06-30 00:00:00"))
    return load(spark, sf_dir, "orders").filter(asof.within("o_orderdate", as_of, "400 days")).select("o_custkey", "o_orderkey")


@query("canonical_instants", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at FROM events")
def canonical_instants(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", dates.canonical_utc(F.col("ts")).alias("at"))


@query("quarterly_periods", "SELECT o_orderkey, o_orderkey % 7 = 0 OR o_orderkey % 150 BETWEEN 80 AND 100 AS quarterly FROM orders")
def quarterly_periods(spark, sf_dir):
    end = F.to_date("o_orderdate")
    start = F.when(F.col("o_orderkey") % 7 != 0, F.date_sub(end, (F.col("o_orderkey") % 150).cast("int")))
    return load(spark, sf_dir, "orders").select("o_orderkey", dates.is_quarterly(start, end).alias("quarterly"))


@query("weekly_grid", "SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(TIMESTAMP '2023-01-06', TIMESTAMP '2024-12-27', INTERVAL 7 DAY)) AS d)")
def weekly_grid(spark, sf_dir):
    return dates.weekly_steps(spark, "2023-01-06", "2024-12-27").select(F.date_format("as_of", "yyyy-MM-dd").alias("day"))


@query("clean_text", r"SELECT doc_id, substr(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'), ' '), 1, 80) AS t FROM documents")
def clean_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text"), 80).alias("t"))


@query("clean_text_whole", r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ') AS t FROM documents")
def clean_text_whole(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("t"))


@query("role_tokens", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN 'ROLE_CEO' WHEN o_orderkey % 12 = 0 THEN 'ROLE_CFO' ELSE 'ROLE_OFFICER' END WHEN 1 THEN 'ROLE_DIRECTOR' WHEN 2 THEN 'ROLE_10PCT' ELSE 'ROLE_OTHER' END AS token FROM orders")
def role_tokens(spark, sf_dir):
    i = F.col("o_orderkey")
    role = F.element_at(F.array(*map(F.lit, ["officer", "director", "ten_percent_owner", "other"])), (i % 4).cast("int") + 1)
    title = F.when(i % 8 == 0, "President and Chief Executive Officer").when(i % 12 == 0, "Evp, CFO").when(i % 16 == 4, "Counsel")
    return load(spark, sf_dir, "orders").select("o_orderkey", text.role_token(role, title).alias("token"))


@query("text_digests", "SELECT doc_id, sha256(coalesce(text, '') || chr(31) || coalesce(lang, '') || chr(31) || source) AS digest FROM documents")
def text_digests(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.text_digest(F.col("text"), F.col("lang"), F.col("source")).alias("digest"))


@query("small_rules", """SELECT o_orderkey, round(CASE WHEN o_orderkey % 9 > 0 THEN (o_orderkey % 9 - o_orderkey % 4) / (o_orderkey % 9)::DOUBLE END, 6) AS loss, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE (o_custkey * 3.0 + o_orderkey * 15.0) / 1e6 END, 6) AS cost,
  CAST(floor(4 * pow((o_orderkey % 300 + 1) / 100.0, 2.0 / 9)) AS BIGINT) AS lag, round(CASE WHEN 50 + o_orderkey % 5 - CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 60 ELSE -(o_orderkey % 60) END > 0 THEN (o_orderkey % 60) / (50 + o_orderkey % 5 - CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 60 ELSE -(o_orderkey % 60) END)::DOUBLE END, 6) AS change,
  CAST(o_orderdate AS DATE) > DATE '1996-01-31' + 30 AS counts FROM orders""")
def small_rules(spark, sf_dir):
    """Daily loss, cost of a call, lag rule, change of a position and validity of a back test for each order."""
    i, d = F.col("o_orderkey"), lambda c: c.cast("double")
    change = fu.position_change(d(i % 60), i % 2 == 0, d(50 + i % 5))
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", r6(numbers.daily_loss(d(i % 4), d(i % 9))).alias("loss"), r6(numbers.call_cost(F.when(i % 3 == 0, F.col("o_totalprice")), d(F.col("o_custkey")), d(i), F.lit(3.0), F.lit(15.0))).alias("cost"),
        numbers.bartlett_lag(d(i % 300 + 1)).cast("long").alias("lag"), r6(change).alias("change"), evidence.valid_backtest(F.col("o_orderdate"), F.lit("1996-01-31"), 30).alias("counts"),
    )


@query("duplicate_verdicts", "SELECT o_custkey AS entity, o_orderstatus AS agent FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_verdicts(spark, sf_dir):
    v = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("agent"))
    return committee.duplicate_verdicts(v).select("entity", "agent").distinct()


@query("capture_states", f"WITH {_RUNS} SELECT run_id, owner AS symbol, CASE WHEN run_id % 3 = 0 THEN 'written' WHEN run_id % 5 < 2 THEN 'deferred' ELSE 'uncovered' END AS state FROM runs")
def capture_states(spark, sf_dir):
    required = _runs(spark, sf_dir).select("run_id", F.col("owner").alias("symbol"), (10 + F.col("run_id") % 5).alias("now"))
    out = evidence.capture_state(required, required.filter("run_id % 3 = 0"), F.lit(5), F.col("now"), F.lit(11))
    return out.select("run_id", "symbol", "state")


@query("claim_runs", f"WITH {_RUNS} SELECT run_id, false AS halted FROM runs WHERE owner = (SELECT min(owner) FROM runs WHERE status <> 'FAILED') AND status <> 'FAILED' AND status <> 'PARTIAL' ORDER BY total_cost_usd DESC, run_id DESC LIMIT 1")
def claim_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir).filter("status <> 'PARTIAL'")
    first = _runs(spark, sf_dir).filter("status <> 'FAILED'").agg(F.min("owner")).scalar()
    own = runs.withColumns({"mode": F.lit("live"), "as_of": F.col("owner"), "config_hash": F.lit("h"), "started_at": F.col("total_cost_usd")})
    return writes.claim_run(own, "live", first, "h").select("run_id", F.coalesce("halted", F.lit(False)).alias("halted"))


