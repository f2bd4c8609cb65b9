"""Whole builds as queries: features of a universe as of an instant, universe snapshots, and the walk-forward."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import gate
from tidemark.operators.series import price_features
from tidemark.plans.analytics import _FEATURES, W
from tidemark.plans.bindings import BARS, SECTORS, bars, load, query, r6, sectors
from tidemark.plans.features import FUNDAMENTAL, PRICE, build_features, universe_snapshots, walk_forward

# ---- the feature build: bars known a day later, quarters of orders known 30 days later, and events moved back to where the
# bars are as filings and news
_AS_OF = "2001-02-01 00:00:00"
_QUARTERS = """q AS (SELECT o_custkey % 100 AS security_id, CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS DATE) AS p, sum(o_totalprice) AS revenue, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS gross,
    coalesce(sum(o_totalprice) FILTER (o_orderpriority = '2-HIGH'), 0) AS income, coalesce(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 0) AS cash, count(*) * 100000.0 AS assets FROM orders GROUP BY 1, 2)"""
_EVENTS = "e AS (SELECT event_id, user_id, event_type, value, ts - INTERVAL 8400 DAY AS event_time, ts - INTERVAL 8400 DAY + to_minutes(CAST(event_id % 5000 AS INTEGER)) AS available_at FROM events)"


def _percentile(name: str) -> str:
    return f"CASE WHEN {name} IS NOT NULL THEN (row_number() OVER (PARTITION BY sector, {name} IS NULL ORDER BY {name}, security_id) - 1) / greatest(count(*) OVER (PARTITION BY sector, {name} IS NULL) - 1, 1) END"


_ALL = {
    **{n: n for n in PRICE}, **{n: n for n in FUNDAMENTAL},
    **{n: f"coalesce({n}, 0)" for n in ("insider_net_open_market_buy_usd_90d", "insider_distinct_buyers_90d", "insider_ceo_cfo_buy_flag_90d", "news_count_zscore_7d", "news_source_diversity_7d")},
    **{f"{n}_sector_percentile": f"{n}_sector_percentile" for n in FUNDAMENTAL},
}


@query("feature_build", f"""WITH {BARS}, {SECTORS}, {_QUARTERS}, {_EVENTS}, vb AS (SELECT * FROM bars WHERE event_time + INTERVAL 1 DAY <= TIMESTAMP '{_AS_OF}' AND event_time > TIMESTAMP '{_AS_OF}' - INTERVAL 400 DAY),
  r AS (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret, row_number() OVER (PARTITION BY security_id ORDER BY event_time DESC) AS place, greatest(high - low, abs(high - coalesce(lag(close) OVER {W}, close)), abs(low - coalesce(lag(close) OVER {W}, close))) AS tr FROM vb),
  f AS (SELECT security_id, place, """ + ", ".join(f"{sql} AS {name}" for name, sql in _FEATURES.items()) + f""" FROM r), t AS (SELECT security_id, close, max(close) OVER (PARTITION BY security_id ORDER BY place DESC) AS peak FROM r WHERE place <= 63), d AS (SELECT security_id, min(close / peak - 1) AS max_drawdown_63d FROM t GROUP BY 1),
  price AS (SELECT f.*, max_drawdown_63d FROM f JOIN d ON f.security_id = d.security_id WHERE place = 1), k AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY p DESC) AS i FROM q WHERE p + INTERVAL 30 DAY <= TIMESTAMP '{_AS_OF}'),
  x AS (SELECT security_id, """ + ", ".join(f"max({c}) FILTER (i = {i}) AS {c}{i}" for c in ("revenue", "gross", "income", "cash", "assets") for i in (1, 5, 13)) + """, arg_min(gross / revenue, i) FILTER (i <= 5) AS m1, arg_max(gross / revenue, i) FILTER (i <= 5) AS m5, count(*) FILTER (i <= 5) AS m FROM k GROUP BY 1),
  cap AS (SELECT security_id, sector, 1e9 * (1 + security_id % 7) AS market_cap FROM sectors),
  fund AS (SELECT c.security_id, c.sector, market_cap / revenue1 AS ev_sales, CAST(NULL AS DOUBLE) AS ev_ebit, CAST(NULL AS DOUBLE) AS fcf_yield, CASE WHEN m >= 2 THEN m1 - m5 END AS gross_margin_trend, revenue1 / revenue5 - 1 AS revenue_growth_yoy, pow(revenue1 / revenue13, 1.0 / 3) - 1 AS revenue_growth_3y_cagr,
    CAST(NULL AS DOUBLE) AS net_debt_ebitda, CAST(NULL AS DOUBLE) AS share_count_change, (income1 - cash1) / assets1 AS accruals_ratio FROM cap c LEFT JOIN x ON x.security_id = c.security_id),""" + f"""
  ins AS (SELECT user_id % 100 AS security_id, sum(value * 2.0) AS insider_net_open_market_buy_usd_90d, count(DISTINCT user_id) AS insider_distinct_buyers_90d, max(CAST(user_id % 4 = 0 AND user_id % 8 = 0 AS INTEGER)) AS insider_ceo_cfo_buy_flag_90d FROM e WHERE available_at <= TIMESTAMP '{_AS_OF}' AND available_at > TIMESTAMP '{_AS_OF}' - INTERVAL 90 DAY AND event_type = 'purchase' AND event_id % 3 <> 0 GROUP BY 1),
  l AS (SELECT * FROM e WHERE available_at <= TIMESTAMP '{_AS_OF}' QUALIFY row_number() OVER (PARTITION BY event_id // 2 ORDER BY available_at DESC, event_id DESC) = 1),
  n AS (SELECT unnest([user_id % 100, (user_id + 1) % 100]) AS security_id, event_type, event_time, floor((epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(event_time)) / 1e6 / 604800) AS w FROM l WHERE event_time > TIMESTAMP '{_AS_OF}' - INTERVAL 56 DAY AND event_time <= TIMESTAMP '{_AS_OF}'),
  c AS (SELECT security_id, count(*) FILTER (w = 0) AS c0, [""" + ", ".join(f"count(*) FILTER (w = {i})" for i in range(1, 8)) + f"""] AS h, count(DISTINCT event_type) FILTER (event_time > TIMESTAMP '{_AS_OF}' - INTERVAL 7 DAY) AS news_source_diversity_7d FROM n GROUP BY 1),
  news AS (SELECT security_id, news_source_diversity_7d, CASE WHEN list_stddev_samp(h) > 0 THEN (c0 - list_avg(h)) / list_stddev_samp(h) ELSE 0.0 END AS news_count_zscore_7d FROM c),
  wide AS (SELECT fund.*, """ + ", ".join(f"{_percentile(n)} AS {n}_sector_percentile" for n in FUNDAMENTAL) + " FROM fund), a AS (SELECT * FROM wide LEFT JOIN price USING (security_id) LEFT JOIN ins USING (security_id) LEFT JOIN news USING (security_id)) SELECT security_id, unnest([" + ", ".join(f"'{n}'" for n in _ALL) + "]) AS name, round(unnest([" + ", ".join(f"CAST({sql} AS DOUBLE)" for sql in _ALL.values()) + "]), 5) AS value FROM a")
def feature_build(spark, sf_dir):
    day = lambda n: F.make_dt_interval(days=F.lit(n))
    s = sectors(spark, sf_dir)
    members = s.withColumn("market_cap", F.lit(1e9) * (1 + F.col("security_id") % 7))
    known = bars(spark, sf_dir).withColumn("available_at", F.col("event_time") + day(1))
    o = load(spark, sf_dir, "orders")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("o_totalprice"))), F.lit(0.0))
    quarters = o.groupBy((F.col("o_custkey") % 100).alias("security_id"), F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)).alias("period_end")).agg(
        F.sum("o_totalprice").alias("us-gaap:Revenues"), some(F.col("o_orderstatus") == "F").alias("us-gaap:GrossProfit"), some(F.col("o_orderpriority") == "2-HIGH").alias("us-gaap:NetIncomeLoss"),
        some(F.col("o_orderpriority") == "1-URGENT").alias("us-gaap:NetCashProvidedByUsedInOperatingActivities"), (F.count(F.lit(1)) * 100000.0).alias("us-gaap:Assets"),
    )
    concepts = [c for c in quarters.columns if c.startswith("us-gaap:")]
    facts = quarters.unpivot(["security_id", "period_end"], concepts, "concept", "value").withColumns({
        "unit": F.lit("USD"), "period_start": F.date_sub("period_end", 91), "available_at": F.to_timestamp_ntz(F.col("period_end").cast("string")) + day(30), "source_version": F.lit("a"),
    })
    e = load(spark, sf_dir, "events").withColumn("event_time", F.col("ts") - day(8400))
    e = e.withColumn("available_at", F.col("event_time") + F.make_dt_interval(mins=(F.col("event_id") % 5000).cast("int"))).withColumn("source_version", F.lpad(F.col("event_id").cast("string"), 12, "0"))
    i = F.col("user_id")
    insiders = e.select(
        (i % 100).alias("security_id"), i.cast("string").alias("filer"), F.when(F.col("event_type") == "purchase", "P").otherwise("S").alias("code"), F.lit(True).alias("acquired"), F.col("value").alias("shares"), F.lit(2.0).alias("price"), (F.col("event_id") % 3 == 0).alias("is_10b5_1"),
        F.when(i % 4 == 0, "officer").otherwise("director").alias("role"), F.when(i % 8 == 0, "Chief Executive Officer").alias("officer_title"), F.col("event_id").alias("accession"), F.lit(0).alias("seq"), "available_at", "source_version",
    )
    news = e.select(F.floor(F.col("event_id") / 2).alias("item_id"), F.array(i % 100, (i + 1) % 100).alias("security_ids"), F.col("event_type").alias("publisher"), "event_time", "available_at", "source_version")
    out = build_features(F.to_timestamp_ntz(F.lit(_AS_OF)), members, known, facts, insiders, news)
    return out.select("security_id", F.explode("values").alias("name", "value")).select("security_id", "name", F.round("value", 5).alias("value"))


# ---- universe snapshots on three dates
_SNAPSHOTS = ("1997-06-30", "1998-06-30", "1999-06-30")


@query("universe_snapshots", f"""WITH {BARS}, days AS (SELECT unnest([{', '.join(f"DATE '{d}'" for d in _SNAPSHOTS)}]) AS day), p AS (SELECT day, CAST(day AS TIMESTAMP) + INTERVAL 28 HOUR - INTERVAL 1 MINUTE AS instant FROM days),
  t AS (SELECT p.day, b.*, row_number() OVER (PARTITION BY p.day, security_id ORDER BY event_time DESC) AS i FROM p JOIN bars b ON b.event_time + INTERVAL 1 DAY <= p.instant AND b.event_time > p.instant - INTERVAL 45 DAY),
  s AS (SELECT p.day, s_suppkey AS security_id, max(close) FILTER (i = 1) AS price, avg(close * volume) FILTER (i <= 20) AS adv, count(*) FILTER (i <= 20) AS n_bars FROM p CROSS JOIN supplier LEFT JOIN t ON t.security_id = s_suppkey AND t.day = p.day GROUP BY 1, 2),
  h AS (SELECT p.day, o_custkey % 100 AS security_id, arg_max(v, e) AS shares FROM p JOIN (SELECT o_custkey, CAST(o_orderdate AS DATE) AS e, max(o_totalprice) AS v FROM (SELECT o_custkey % 100 AS o_custkey, o_orderdate, o_totalprice FROM orders) GROUP BY 1, 2) ON e + INTERVAL 30 DAY <= p.instant GROUP BY 1, 2),
  m AS (SELECT s.*, price * shares * 10 AS mcap FROM s LEFT JOIN h ON h.day = s.day AND h.security_id = s.security_id), r AS (SELECT *, CASE WHEN price IS NULL THEN 'no_price' WHEN n_bars < 8 THEN 'insufficient_history' WHEN price < 1400 THEN 'price' WHEN mcap IS NULL THEN 'no_shares' WHEN NOT (mcap BETWEEN 1e9 AND 9e9) THEN 'mcap' WHEN adv < 30000 THEN 'adv' ELSE 'ok' END AS why FROM m),
  k AS (SELECT *, CASE WHEN why = 'ok' THEN row_number() OVER (PARTITION BY day, why = 'ok' ORDER BY adv DESC NULLS LAST, security_id) END AS rank FROM r)
  SELECT CAST(day AS VARCHAR) AS day, security_id, rank, coalesce(rank <= 15, false) AS included, CASE WHEN rank <= 15 THEN 'included' WHEN why = 'ok' THEN 'rank' ELSE why END AS reason FROM k""")
def universe_snapshots_at(spark, sf_dir):
    from tidemark.functions.dates import snapshot_time

    days = [F.to_date(F.lit(d)) for d in _SNAPSHOTS]
    known = bars(spark, sf_dir).withColumn("available_at", F.col("event_time") + F.expr("interval 1 day"))
    o = load(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("security_id"), F.to_date("o_orderdate").alias("period_end")).agg((F.max("o_totalprice") * 10).alias("value"))
    shares = o.withColumn("available_at", F.to_timestamp_ntz(F.col("period_end").cast("string")) + F.expr("interval 30 days")).withColumn("source_version", F.lit("a"))
    names = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("security_id"))
    times = [(d, snapshot_time(d).cast("timestamp_ntz")) for d in days]
    out = universe_snapshots(times, known, shares, names, price_min=1400, cap_min=1e9, cap_max=9e9, volume_min=30000, top_n=15, days=8)
    return out.select(F.col("snapshot_date").cast("string").alias("day"), "security_id", F.col("rank").cast("long").alias("rank"), "included", "reason")


_WALK = ("1997-01-31", "1998-01-30", "1999-01-29", "2000-01-31")


@query("walk_forward")
def walk_forward_dates(spark, sf_dir):
    """Four yearly dates: features of the newest bar by each, trained on the terciles of earlier ones. Tested by brute force."""
    from tidemark.operators.asof import asof_join
    from tidemark.sources.interim import written

    times = [F.to_timestamp_ntz(F.lit(d)) for d in _WALK]
    s = sectors(spark, sf_dir)
    names = ("return_1m", "realized_vol_20d", "sma_20d_distance", "distance_52w_high")
    asked = s.select("security_id").withColumn("event_time", F.explode(F.array(*times)))
    at = price_features(bars(spark, sf_dir)).withColumnRenamed("event_time", "bar_time")
    # a row for each security and date, for features and volatilities
    found = written(asof_join(asked, at, ["security_id"], "event_time", "bar_time", list(names)))
    values = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.col, names)))
    features = found.select("security_id", "event_time", values.alias("values"))
    labelled = gate.labels(asked.select(F.col("event_time").alias("feature_time")).distinct(), bars(spark, sf_dir), s)
    vol = found.select(F.col("event_time").cast("string").alias("as_of"), "security_id", F.col("realized_vol_20d").alias("sigma"))
    out = walk_forward(features, labelled, times, s, vol, 20)
    return out.select("as_of", "security_id", r6(F.col("score")).alias("score"), "passed", r6(F.col("weight")).alias("weight"))
