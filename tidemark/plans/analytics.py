"""Queries over series, cross-sections, labels, committees, sizing, calendars, trades and tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, text
from tidemark.operators import calendars, committee, evidence, gate, sequential, series, sizing, trades, xsection
from tidemark.operators import fundamentals as fu
from tidemark.plans.bindings import BARS, FACTS, HISTORY, QUARTERS, SECTORS, SNAPSHOT, bars, facts, history, load, quarters, query, r6, sectors, snapshot

DAY = "strftime(event_time, '%Y-%m-%d') AS day"


def _day():
    return F.date_format("event_time", "yyyy-MM-dd").alias("day")


W = "(PARTITION BY security_id ORDER BY event_time)"


def trail(n: int) -> str:
    return f"(PARTITION BY security_id ORDER BY event_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("bars_daily", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, round(arg_min(value, ts), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, ts), 6) AS close, count(*) AS n FROM events GROUP BY 1, 2")
def bars_daily(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        r6(F.min_by("value", "ts")).alias("open"), r6(F.max("value")).alias("high"), r6(F.min("value")).alias("low"), r6(F.max_by("value", "ts")).alias("close"), F.count(F.lit(1)).alias("n")
    )


@query("returns_multi", f"WITH {BARS} SELECT security_id, {DAY}, " + ", ".join(f"round(close / nullif(lag(close, {n}) OVER {W}, 0) - 1, 6) AS r{n}" for n in (21, 63, 126)) + " FROM bars")
def returns_multi(spark, sf_dir):
    return bars(spark, sf_dir).select("security_id", _day(), *(r6(series.trailing_return(n)).alias(f"r{n}") for n in (21, 63, 126)))


@query("momentum_skip", f"WITH {BARS} SELECT security_id, {DAY}, round(lag(close, 21) OVER {W} / nullif(lag(close, 252) OVER {W}, 0) - 1, 6) AS momentum FROM bars")
def momentum_skip(spark, sf_dir):
    return bars(spark, sf_dir).select("security_id", _day(), r6(series.trailing_return(231, 21)).alias("momentum"))


@query("sma_distance", f"WITH {BARS} SELECT security_id, {DAY}, " + ", ".join(f"CASE WHEN count(*) OVER {trail(n)} = {n} THEN round((close - avg(close) OVER {trail(n)}) / avg(close) OVER {trail(n)}, 6) END AS d{n}" for n in (20, 50, 200)) + " FROM bars")
def sma_distance(spark, sf_dir):
    rows = series.with_full_means(bars(spark, sf_dir), "close", {n: f"mean{n}" for n in (20, 50, 200)})
    return rows.select("security_id", _day(), *(r6(series.distance_from(F.col(f"mean{n}"))).alias(f"d{n}") for n in (20, 50, 200)))


@query("realized_vol", f"WITH {BARS}, r AS (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret FROM bars) SELECT security_id, {DAY}, round(stddev_samp(ret) OVER {trail(20)} * sqrt(252), 5) AS vol FROM r")
def realized_vol(spark, sf_dir):
    r = bars(spark, sf_dir).withColumn("ret_1d", series.trailing_return(1))
    return r.select("security_id", _day(), F.round(series.realized_vol(), 5).alias("vol"))


@query("atr_pct", f"""WITH {BARS}, t AS (SELECT *, greatest(high - low, abs(high - coalesce(lag(close) OVER {W}, close)), abs(low - coalesce(lag(close) OVER {W}, close))) AS tr FROM bars)
  SELECT security_id, {DAY}, CASE WHEN count(*) OVER {trail(20)} = 20 THEN round(avg(tr) OVER {trail(20)} / close, 6) END AS atr FROM t""")
def atr_pct(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("true_range", series.true_range()).select("security_id", _day(), r6(series.atr_pct()).alias("atr"))


@query("max_drawdown_window", f"""WITH {BARS}, n AS (SELECT *, row_number() OVER {W} AS k FROM bars), p AS (SELECT a.security_id, a.event_time, a.k, b.k AS j, b.close,
  max(b.close) OVER (PARTITION BY a.security_id, a.k ORDER BY b.k) AS peak FROM n a JOIN n b ON a.security_id = b.security_id AND b.k BETWEEN a.k - 62 AND a.k)
  SELECT security_id, {DAY}, round(min(close / peak - 1), 6) AS drawdown FROM p GROUP BY security_id, event_time""")
def max_drawdown_window(spark, sf_dir):
    return series.with_drawdown(bars(spark, sf_dir), "drawdown", w=series.over(order=("event_time",))).select("security_id", _day(), r6(F.col("drawdown")).alias("drawdown"))


_FEATURES = {
    "return_1m": f"close / nullif(lag(close, 21) OVER {W}, 0) - 1", "return_3m": f"close / nullif(lag(close, 63) OVER {W}, 0) - 1", "return_6m": f"close / nullif(lag(close, 126) OVER {W}, 0) - 1",
    "momentum_12_1": f"lag(close, 21) OVER {W} / nullif(lag(close, 252) OVER {W}, 0) - 1",
    **{f"sma_{n}d_distance": f"CASE WHEN count(*) OVER {trail(n)} = {n} THEN close / avg(close) OVER {trail(n)} - 1 END" for n in (20, 50, 200)},
    "realized_vol_20d": f"stddev_samp(ret) OVER {trail(20)} * sqrt(252)", "atr_20d_pct": f"CASE WHEN count(*) OVER {trail(20)} = 20 THEN avg(tr) OVER {trail(20)} / close END",
    "volume_zscore_20d": f"CASE WHEN stddev_samp(volume) OVER {trail(20)} > 0 THEN (volume - avg(volume) OVER {trail(20)}) / stddev_samp(volume) OVER {trail(20)} END", "distance_52w_high": f"close / max(close) OVER {trail(252)} - 1",
}


@query("price_features_newest", f"""WITH {BARS}, r AS (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret, row_number() OVER (PARTITION BY security_id ORDER BY event_time DESC) AS place,
  greatest(high - low, abs(high - coalesce(lag(close) OVER {W}, close)), abs(low - coalesce(lag(close) OVER {W}, close))) AS tr FROM bars), f AS (SELECT security_id, place, """ + ", ".join(f"round({sql}, 5) AS {name}" for name, sql in _FEATURES.items()) + f""" FROM r),
  t AS (SELECT security_id, place, close, max(close) OVER (PARTITION BY security_id ORDER BY place DESC) AS peak FROM r WHERE place <= 63), d AS (SELECT security_id, round(min(close / peak - 1), 5) AS max_drawdown_63d FROM t GROUP BY 1)
  SELECT f.* EXCLUDE (place), max_drawdown_63d FROM f JOIN d ON f.security_id = d.security_id WHERE place = 1""")
def price_features_newest(spark, sf_dir):
    out = series.newest_features(bars(spark, sf_dir))
    return out.select("security_id", *(F.round(c, 5).alias(c) for c in out.columns if c != "security_id"))


@query("volume_z", f"WITH {BARS} SELECT security_id, {DAY}, CASE WHEN stddev_samp(volume) OVER {trail(20)} > 0 THEN round((volume - avg(volume) OVER {trail(20)}) / stddev_samp(volume) OVER {trail(20)}, 5) END AS z FROM bars")
def volume_z(spark, sf_dir):
    return bars(spark, sf_dir).select("security_id", _day(), F.round(series.volume_z(), 5).alias("z"))


@query("dist_52w_high", f"WITH {BARS} SELECT security_id, {DAY}, round((close - max(close) OVER {trail(252)}) / max(close) OVER {trail(252)}, 6) AS distance FROM bars")
def dist_52w_high(spark, sf_dir):
    rows = series.with_trailing_max(bars(spark, sf_dir), "close", 252, "high252")
    return rows.select("security_id", _day(), r6(series.distance_from(F.col("high252"))).alias("distance"))


@query("adv_windows", f"WITH {BARS}, v AS (SELECT security_id, event_time, floor(close * volume) AS d FROM bars) SELECT security_id, {DAY}, round(avg(d) OVER {trail(20)}, 4) AS adv20, CASE WHEN count(*) OVER {trail(30)} >= 30 THEN round(avg(d) OVER {trail(30)}, 4) END AS adv30 FROM v")
def adv_windows(spark, sf_dir):
    v = bars(spark, sf_dir).withColumn("close", F.floor(F.col("close") * F.col("volume")).cast("double")).withColumn("volume", F.lit(1.0))
    return v.select("security_id", _day(), F.round(series.mean_dollar_volume(20, 1), 4).alias("adv20"), F.round(series.mean_dollar_volume(30, 30), 4).alias("adv30"))


@query("sector_position_pct", f"WITH {SNAPSHOT} SELECT security_id, round((row_number() OVER (PARTITION BY sector ORDER BY close, security_id) - 1) / greatest(count(*) OVER (PARTITION BY sector) - 1, 1), 8) AS pct FROM snap")
def sector_position_pct(spark, sf_dir):
    return snapshot(spark, sf_dir).select("security_id", F.round(xsection.position_percentile(F.col("close"), ["sector"]), 8).alias("pct"))


@query("sector_midrank_pct", f"""WITH {SNAPSHOT}, c AS (SELECT *, round(volume / 10) AS v FROM snap) SELECT security_id, CASE WHEN count(*) OVER (PARTITION BY sector) >= 3 THEN
  round((rank() OVER (PARTITION BY sector ORDER BY v) - 1 + 0.5 * (count(*) OVER (PARTITION BY sector, v) - 1)) / (count(*) OVER (PARTITION BY sector) - 1), 8) END AS pct FROM c""")
def sector_midrank_pct(spark, sf_dir):
    s = snapshot(spark, sf_dir).withColumn("v", F.round(F.col("volume") / 10))
    return s.select("security_id", F.round(xsection.midrank_percentile(F.col("v"), ["sector"], 3), 8).alias("pct"))


@query("sector_zscore", f"""WITH {SNAPSHOT} SELECT security_id, CASE WHEN count(*) OVER p >= 3 THEN CASE WHEN stddev_pop(close) OVER p = 0 THEN 0.0 ELSE round((close - avg(close) OVER p) / stddev_pop(close) OVER p, 5) END END AS z FROM snap WINDOW p AS (PARTITION BY sector)""")
def sector_zscore(spark, sf_dir):
    return snapshot(spark, sf_dir).select("security_id", F.round(xsection.group_zscore(F.col("close"), ["sector"]), 5).alias("z"))


@query("universe_zscore", f"""WITH {SNAPSHOT}, m AS (SELECT security_id, CASE WHEN security_id % 7 = 0 THEN NULL ELSE close END AS v FROM snap), a AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM m) SELECT security_id, round(-(coalesce(v, mu) - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 5) + 0 AS z FROM m, a""")
def universe_zscore(spark, sf_dir):
    s = snapshot(spark, sf_dir).select("security_id", F.when(F.col("security_id") % 7 != 0, F.col("close")).alias("v"), F.lit("run").alias("run_id"))
    return xsection.imputed_zscores(s, ["v"], ["run_id"], ["v"]).select("security_id", (F.round("v", 5) + 0).alias("z"))


_LABELS = f"""{BARS}, {SECTORS}, f AS (SELECT *, close AS c0, lead(close, 21) OVER {W} AS c1, lead(event_time, 21) OVER {W} AS label_end FROM bars), q AS (SELECT unnest([TIMESTAMP '1996-06-28', TIMESTAMP '1997-03-31', TIMESTAMP '1998-01-15']) AS feature_time),
  s AS (SELECT q.feature_time, s.security_id, s.sector, arg_max(c1 / c0 - 1, f.event_time) FILTER (WHERE true) AS x, max(f.event_time) AS at FROM q CROSS JOIN sectors s JOIN f ON f.security_id = s.security_id AND f.event_time <= q.feature_time GROUP BY 1, 2, 3),
  r AS (SELECT s.feature_time, s.security_id, s.sector, f.c1 / f.c0 - 1 AS ret, f.label_end FROM s JOIN f ON f.security_id = s.security_id AND f.event_time = s.at WHERE f.c1 IS NOT NULL AND f.c0 > 0),
  l AS (SELECT *, abs(ret - avg(ret) OVER (PARTITION BY feature_time, sector)) AS relative FROM r),
  labels AS (SELECT *, row_number() OVER (PARTITION BY feature_time ORDER BY relative DESC, security_id) <= ceil(count(*) OVER (PARTITION BY feature_time) / 3.0) AS is_top_tercile FROM l)"""


def _labels(spark, sf_dir):
    times = spark.createDataFrame([("1996-06-28",), ("1997-03-31",), ("1998-01-15",)], "d string").select(F.to_timestamp_ntz(F.col("d")).alias("feature_time"))
    return gate.labels(times, bars(spark, sf_dir), sectors(spark, sf_dir))


@query("forward_label_tercile", f"WITH {_LABELS} SELECT strftime(feature_time, '%Y-%m-%d') AS feature_day, security_id, strftime(label_end, '%Y-%m-%d') AS label_end, is_top_tercile FROM labels")
def forward_label_tercile(spark, sf_dir):
    text_of = lambda c: F.date_format(c, "yyyy-MM-dd")
    return _labels(spark, sf_dir).select(text_of("feature_time").alias("feature_day"), "security_id", text_of("label_end").alias("label_end"), "is_top_tercile")


@query("training_no_leak", f"""WITH {_LABELS}, feat AS (SELECT security_id, event_time, close FROM bars) SELECT f.security_id, strftime(f.event_time, '%Y-%m-%d') AS day, CAST(is_top_tercile AS INTEGER) AS target FROM labels l JOIN feat f ON f.security_id = l.security_id AND f.event_time = l.feature_time WHERE label_end < TIMESTAMP '1998-01-15'""")
def training_no_leak(spark, sf_dir):
    feat = bars(spark, sf_dir).select("security_id", "event_time", "close")
    out = gate.eligible_training_set(feat, _labels(spark, sf_dir), F.to_timestamp_ntz(F.lit("1998-01-15 00:00:00")))
    return out.select("security_id", _day(), "target")


@query("weekly_news_z", """WITH n AS (SELECT max(ts) AS as_of FROM events), a AS (SELECT user_id AS security_id, floor((epoch_us(as_of) - epoch_us(ts)) / 1e6 / 604800) AS w FROM events, n), c AS (SELECT security_id, """ + ", ".join(f"count(*) FILTER (w = {i}) AS c{i}" for i in range(4)) + """ FROM a GROUP BY 1),
  s AS (SELECT security_id, c0, [c1, c2, c3] AS h FROM c) SELECT security_id, CASE WHEN list_stddev_samp(h) > 0 THEN round((c0 - list_avg(h)) / list_stddev_samp(h), 5) ELSE 0.0 END AS z FROM s""")
def weekly_news_z(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("security_id"), F.col("ts").alias("event_time"))
    now = load(spark, sf_dir, "events").agg(F.max("ts")).scalar()
    return series.weekly_counts(e, "security_id", now, 4).select("security_id", F.round(series.latest_week_z(4), 5).alias("z"))


_RATIOS = f"""{QUARTERS}, k AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY period_end DESC) AS i FROM quarters), x AS (SELECT security_id, max(revenue) FILTER (i = 1) AS r1, max(revenue) FILTER (i = 5) AS r5, max(revenue) FILTER (i = 13) AS r13, max(n) FILTER (i = 1) AS n1 FROM k GROUP BY 1)"""


@query("fundamental_ratios", f"""WITH {_RATIOS} SELECT security_id, round(c_acctbal * 1000 / nullif(r1, 0), 6) AS ev_sales, round(r1 / nullif(r5, 0) - 1, 6) AS revenue_growth_yoy,
  CASE WHEN r13 > 0 AND r1 / r13 >= 0 THEN round(pow(r1 / r13, 1.0 / 3) - 1, 6) END AS revenue_growth_3y_cagr FROM x JOIN customer ON c_custkey = security_id""")
def fundamental_ratios(spark, sf_dir):
    q = quarters(spark, sf_dir)
    rows = q.select("security_id", "period_end", F.col("period_end").alias("available_at"), F.lit("us-gaap:Revenues").alias("concept"), F.col("revenue").alias("value"))
    cap = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("security_id"), (F.col("c_acctbal") * 1000).alias("market_cap"))
    out = fu.ratios(fu.recent_values(fu.to_series(rows)).join(cap, "security_id"))
    return out.select("security_id", *(r6(F.col(c)).alias(c) for c in ("ev_sales", "revenue_growth_yoy", "revenue_growth_3y_cagr")))


_TXNS = """txns AS (SELECT user_id % 20 AS security_id, 'F' || CAST(user_id AS VARCHAR) AS filer, CASE event_type WHEN 'purchase' THEN 'P' WHEN 'view' THEN 'S' ELSE 'A' END AS code, event_type = 'purchase' AS acquired, value AS shares, event_id % 3 = 0 AS is_10b5_1,
  CAST(ts AS DATE) AS txn_date, ts + to_minutes(CAST(event_id % 5000 AS INTEGER)) AS available_at, CASE WHEN user_id % 4 = 0 THEN 'officer' ELSE 'director' END AS role, CASE WHEN user_id % 8 = 0 THEN 'Chief Executive Officer' END AS officer_title, event_id FROM events)"""


def _txns(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 20).alias("security_id"), F.concat(F.lit("F"), F.col("user_id").cast("string")).alias("filer"), F.when(F.col("event_type") == "purchase", "P").when(F.col("event_type") == "view", "S").otherwise("A").alias("code"),
        (F.col("event_type") == "purchase").alias("acquired"), F.col("value").alias("shares"), F.lit(2.0).alias("price"), (F.col("event_id") % 3 == 0).alias("is_10b5_1"), F.to_date("ts").alias("txn_date"),
        (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 5000).cast("int"))).alias("available_at"), F.when(F.col("user_id") % 4 == 0, "officer").otherwise("director").alias("role"),
        F.when(F.col("user_id") % 8 == 0, "Chief Executive Officer").alias("officer_title"), "event_id",
    )


@query("insider_90d", f"""WITH {_TXNS} SELECT security_id, round(sum(shares * 2.0), 4) AS usd, count(DISTINCT filer) AS buyers, max(CAST(role = 'officer' AND officer_title IS NOT NULL AS INTEGER)) AS chief FROM txns
  WHERE available_at <= TIMESTAMP '2024-01-15' AND available_at > TIMESTAMP '2024-01-15' - INTERVAL 90 DAY AND code = 'P' AND acquired AND NOT is_10b5_1 GROUP BY 1""")
def insider_90d(spark, sf_dir):
    out = fu.insider_features(_txns(spark, sf_dir), F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")))
    return out.select("security_id", F.round("insider_net_open_market_buy_usd_90d", 4).alias("usd"), F.col("insider_distinct_buyers_90d").alias("buyers"), F.col("insider_ceo_cfo_buy_flag_90d").alias("chief"))


@query("cluster_self_join", f"""WITH {_TXNS}, b AS (SELECT DISTINCT security_id, filer, txn_date FROM txns WHERE code = 'P' AND acquired)
  SELECT t.event_id, count(DISTINCT b.filer) AS cluster FROM txns t LEFT JOIN b ON b.security_id = t.security_id AND abs(b.txn_date - t.txn_date) <= 2 GROUP BY 1""")
def cluster_self_join(spark, sf_dir):
    return fu.buyer_clusters(_txns(spark, sf_dir), 2).select("event_id", F.col("cluster").cast("long").alias("cluster"))


@query("trade_tags", """WITH o AS (SELECT o_custkey % 50 AS security_id, CAST(o_custkey AS VARCHAR) AS filer, CASE WHEN o_orderstatus = 'F' THEN 'P' ELSE 'S' END AS code, CAST(o_orderdate AS DATE) AS txn_date, o_orderkey FROM orders), m AS (SELECT DISTINCT security_id, filer, year(txn_date) * 12 + month(txn_date) AS mm FROM o), e AS (SELECT security_id, min(txn_date) AS first FROM o GROUP BY 1)
  SELECT o_orderkey, CASE WHEN (SELECT count(*) FROM m WHERE m.security_id = o.security_id AND m.filer = o.filer AND mm IN (year(txn_date) * 12 + month(txn_date) - 12, year(txn_date) * 12 + month(txn_date) - 24)) = 2 THEN 'ROUTINE' WHEN first <= CAST(date_trunc('month', txn_date) - INTERVAL 2 YEAR AS DATE) THEN 'OPPORTUNISTIC' ELSE 'UNKNOWN' END AS tag FROM o JOIN e ON o.security_id = e.security_id""")
def trade_tags(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("security_id"), F.col("o_custkey").cast("string").alias("filer"), F.when(F.col("o_orderstatus") == "F", "P").otherwise("S").alias("code"), F.to_date("o_orderdate").alias("txn_date"), "o_orderkey")
    return fu.trade_tags(o, 2).select("o_orderkey", "tag")


@query("universe_rules", f"""WITH {BARS}, t AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY event_time DESC) AS i FROM bars WHERE event_time > TIMESTAMP '1998-06-30' - INTERVAL 45 DAY AND event_time <= TIMESTAMP '1998-06-30'),
  s AS (SELECT s_suppkey AS security_id, max(close) FILTER (i = 1) AS price, avg(close * volume) FILTER (i <= 20) AS adv, count(*) FILTER (i <= 20) AS n_bars FROM supplier LEFT JOIN t ON t.security_id = s_suppkey GROUP BY 1),
  m AS (SELECT *, CASE WHEN security_id % 9 = 0 THEN NULL ELSE price * 1e6 * (1 + security_id % 5) END AS mcap FROM s), r AS (SELECT *, CASE WHEN price IS NULL THEN 'no_price' WHEN n_bars < 15 THEN 'insufficient_history' WHEN price < 1500 THEN 'price' WHEN mcap IS NULL THEN 'no_shares' WHEN NOT (mcap BETWEEN 1e9 AND 9e9) THEN 'mcap' WHEN adv < 30000 THEN 'adv' ELSE 'ok' END AS why FROM m),
  k AS (SELECT *, CASE WHEN why = 'ok' THEN row_number() OVER (PARTITION BY why = 'ok' ORDER BY adv DESC NULLS LAST, security_id) END AS rank FROM r)
  SELECT security_id, rank, coalesce(rank <= 10, false) AS included, CASE WHEN rank <= 10 THEN 'included' WHEN why = 'ok' THEN 'rank' ELSE why END AS reason, CASE WHEN mcap < 2e9 THEN 'small' WHEN mcap < 10e9 THEN 'mid' WHEN mcap IS NOT NULL THEN 'large' END AS mcap_tier FROM k""")
def universe_rules(spark, sf_dir):
    from tidemark.operators.asof import within

    recent = bars(spark, sf_dir).filter(within("event_time", F.to_timestamp_ntz(F.lit("1998-06-30 00:00:00")), "45 days"))
    place = F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("event_time")))
    stats = recent.withColumn("i", place).filter("i <= 20").groupBy("security_id").agg(F.max(F.when(F.col("i") == 1, F.col("close"))).alias("price"), F.avg(F.col("close") * F.col("volume")).alias("adv"), F.count(F.lit(1)).alias("n_bars"))
    c = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("security_id")).join(stats, "security_id", "left").withColumn("mcap", F.when(F.col("security_id") % 9 != 0, F.col("price") * 1e6 * (1 + F.col("security_id") % 5))).withColumn("snapshot_date", F.lit("d"))
    out = xsection.universe_rules(c, price_min=1500, cap_min=1e9, cap_max=9e9, volume_min=30000, top_n=10, days=15)
    return out.select("security_id", F.col("rank").cast("long").alias("rank"), "included", "reason", "mcap_tier")


@query("gate_score_topk", f"""WITH {SNAPSHOT}, s AS (SELECT security_id, 1 / (1 + exp(-greatest(-35.0, least(35.0, -0.2 + 0.7 * (close - 2000) / 500 - 0.3 * (volume - 50) / 25)))) AS score FROM snap) SELECT security_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, security_id) <= 15 AS passed FROM s""")
def gate_score_topk(spark, sf_dir):
    s = snapshot(spark, sf_dir).select("security_id", F.create_map(F.lit("close"), F.col("close"), F.lit("volume"), F.col("volume")).alias("v"), F.lit("run").alias("run_id"))
    scored = s.withColumn("score", gate.gate_score(F.col("v"), ["close", "volume"], [2000, 50], [500, 25], [0.7, -0.3], -0.2))
    return gate.decide(scored, 15).select("security_id", r6(F.col("score")).alias("score"), "passed")


@query("gate_recall", """WITH p AS (SELECT doc_id, quality = 1 AS positive, doc_id % 3 = 0 AS passed FROM labels) SELECT round(count(*) FILTER (positive AND passed) / count(*) FILTER (positive), 8) AS recall FROM p""")
def gate_recall(spark, sf_dir):
    l = load(spark, sf_dir, "labels")
    labelled = l.select(F.col("doc_id").alias("security_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_top_tercile"))
    return gate.recall(l.select(F.col("doc_id").alias("security_id"), (F.col("doc_id") % 3 == 0).alias("passed")), labelled).select(F.round("recall", 8).alias("recall"))


@query("quant_composite", f"""WITH {SNAPSHOT}, a AS (SELECT avg(close) AS mc, stddev_pop(close) AS sc, avg(volume) AS mv, stddev_pop(volume) AS sv FROM snap), z AS (SELECT security_id, (close - mc) / sc AS zc, (volume - mv) / sv AS zv FROM snap, a)
  SELECT security_id, round(1 / (1 + exp(-greatest(-20.0, least(20.0, (-zc + zv + (zv + zc) / 2) / 3)))), 6) AS pooled_p FROM z""")
def quant_composite(spark, sf_dir):
    s = snapshot(spark, sf_dir).withColumn("run_id", F.lit("run")).withColumn("cheap", F.col("close")).withColumn("flow", F.col("volume"))
    out = committee.quant_composite(s, ["run_id"], value=["cheap"], momentum="volume", quality=["flow", "close"], low_is_good=["cheap"])
    return out.select("security_id", r6(F.col("pooled_p")).alias("pooled_p"))


@query("brier_skill", f"WITH {HISTORY}, b AS (SELECT agent, avg(pow(forecast - outcome, 2)) AS own, avg(pow(0.6 - outcome, 2)) AS base FROM history GROUP BY 1) SELECT agent, round(own, 6) AS brier, round(greatest(0, CASE WHEN base > 0 THEN 1 - own / base ELSE 0 END), 6) AS skill FROM b")
def brier_skill(spark, sf_dir):
    return committee.brier_skill(history(spark, sf_dir), F.lit(0.6)).select("agent", r6(F.col("brier")).alias("brier"), r6(F.col("skill")).alias("skill"))


@query("pool_logit", """WITH v AS (SELECT doc_id AS entity, unnest(['alpha', 'beta', 'gamma']) AS agent, unnest([31, 57, 62]) AS step FROM labels), p AS (SELECT entity, agent, unnest([5, 21, 63]) AS horizon, unnest([1, 2, 3]) AS h, step FROM v WHERE (entity + step) % 5 <> 0),
  q AS (SELECT entity, horizon, least(greatest(((entity * step + 13 * h) % 97 + 1) / 98.0, 0.02), 0.98) AS p FROM p) SELECT entity, horizon, round(avg(ln(p / (1 - p))), 6) AS logit, round(CASE WHEN count(*) > 1 THEN stddev_pop(ln(p / (1 - p))) ELSE 0 END, 5) AS dispersion FROM q GROUP BY 1, 2""")
def pool_logit(spark, sf_dir):
    agents = F.explode(F.array(*(F.struct(F.lit(a).alias("agent"), F.lit(s).alias("step")) for a, s in (("alpha", 31), ("beta", 57), ("gamma", 62)))))
    v = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("entity"), agents.alias("a")).select("entity", "a.agent", "a.step")
    p = lambda h: (((F.col("entity") * F.col("step") + 13 * h) % 97 + 1) / F.lit(98.0))
    v = v.select("entity", "agent", p(1).alias("p_5"), p(2).alias("p_21"), p(3).alias("p_63"), ((F.col("entity") + F.col("step")) % 5 != 0).alias("valid"), F.lit(True).alias("sufficient"))
    return committee.pool(v).select("entity", "horizon", r6(F.col("logit")).alias("logit"), F.round("dispersion", 5).alias("dispersion"))


@query("error_corr_neff", f"""WITH {HISTORY}, e AS (SELECT agent, instance, forecast - outcome AS e FROM history), c AS (SELECT a.agent AS x, b.agent AS y, corr(a.e, b.e) AS c FROM e a JOIN e b ON a.instance = b.instance AND a.agent < b.agent GROUP BY 1, 2)
  SELECT 3 AS agents, round(avg(c), 6) AS mean_correlation, round(3 / (1 + 2 * avg(c)), 5) AS n_eff, 3 / (1 + 2 * avg(c)) < 2 AS alert FROM c""")
def error_corr_neff(spark, sf_dir):
    return committee.effective_agents(history(spark, sf_dir)).select(F.col("agents").cast("int").alias("agents"), r6(F.col("mean_correlation")).alias("mean_correlation"), F.round("n_eff", 5).alias("n_eff"), "alert")


_BOOK = f"""{SNAPSHOT}, d AS (SELECT security_id, sector, 0.5 + ((security_id * 37) % 50) / 100.0 AS pooled_p, 0.1 + (security_id % 9) / 20.0 AS sigma, (security_id % 4) / 4.0 AS dispersion, CASE security_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'med' END AS bear FROM snap)"""


def _book(spark, sf_dir):
    i = F.col("security_id")
    return snapshot(spark, sf_dir).select(
        F.lit("run").alias("run_id"), "security_id", "sector", (F.lit(0.5) + ((i * 37) % 50) / 100.0).alias("pooled_p"), (F.lit(0.1) + (i % 9) / 20.0).alias("sigma"), ((i % 4) / 4.0).alias("dispersion"),
        F.when(i % 3 == 0, "low").when(i % 3 == 1, "med").alias("bear_severity"),
    )


@query("size_baseline", f"""WITH {_BOOK}, a AS (SELECT *, CASE WHEN pooled_p >= 0.55 AND sigma > 0 THEN least(0.2 * (pooled_p - 0.5) / sigma * greatest(0.0, 1 - 0.5 * dispersion) * CASE bear WHEN 'med' THEN 0.75 ELSE 1.0 END, 0.08) ELSE 0 END AS w0 FROM d), b AS (SELECT *, CASE WHEN w0 >= 0.01 THEN w0 ELSE 0 END AS w1 FROM a),
  c AS (SELECT *, w1 * CASE WHEN sum(w1) OVER (PARTITION BY sector) > 0 THEN least(1.0, 0.3 / sum(w1) OVER (PARTITION BY sector)) ELSE 1 END AS w2 FROM b), t AS (SELECT sqrt(sum(pow(w2 * sigma, 2))) AS vol, sum(w2) AS gross FROM c),
  s AS (SELECT c.*, w2 * least(CASE WHEN vol > 0 THEN least(1.0, 0.10 / vol) ELSE 1 END, CASE WHEN gross > 0 THEN 1 / gross ELSE 1 END) AS w3 FROM c, t) SELECT security_id, round(CASE WHEN w3 >= 0.01 THEN w3 ELSE 0 END, 6) AS weight FROM s""")
def size_baseline(spark, sf_dir):
    return sizing.size_book(_book(spark, sf_dir), sizing.Limits(k=0.2)).select("security_id", r6(F.col("weight")).alias("weight"))


@query("size_rank_mode", f"""WITH {_BOOK}, k AS (SELECT *, row_number() OVER (ORDER BY ln(pooled_p / (1 - pooled_p)) DESC, security_id) AS i FROM d), a AS (SELECT *, CASE WHEN i <= 8 THEN least((1 / sigma) / sum(CASE WHEN i <= 8 THEN 1 / sigma END) OVER () * CASE bear WHEN 'med' THEN 0.75 ELSE 1.0 END, 0.08) ELSE 0 END AS w0 FROM k),
  c AS (SELECT *, w0 * CASE WHEN sum(w0) OVER (PARTITION BY sector) > 0 THEN least(1.0, 0.3 / sum(w0) OVER (PARTITION BY sector)) ELSE 1 END AS w1 FROM a), b AS (SELECT *, CASE WHEN w1 >= 0.01 THEN w1 ELSE 0 END AS w2 FROM c), t AS (SELECT sqrt(sum(pow(w2 * sigma, 2))) AS vol, sum(w2) AS gross FROM b),
  s AS (SELECT b.*, w2 * least(CASE WHEN vol > 0 THEN least(1.0, 0.10 / vol) ELSE 1 END, CASE WHEN gross > 0 THEN 1 / gross ELSE 1 END) AS w3 FROM b, t) SELECT security_id, round(CASE WHEN w3 >= 0.01 THEN w3 ELSE 0 END, 6) AS weight FROM s""")
def size_rank_mode(spark, sf_dir):
    b = _book(spark, sf_dir).withColumn("logit", F.log(F.col("pooled_p") / (1 - F.col("pooled_p"))))
    return sizing.size_committee_book(b).select("security_id", r6(F.col("weight")).alias("weight"))


@query("sector_cap", f"WITH {_BOOK}, w AS (SELECT security_id, sector, pooled_p / 10 AS w FROM d) SELECT security_id, round(w * least(1.0, 0.3 / sum(w) OVER (PARTITION BY sector)), 6) AS weight FROM w")
def sector_cap(spark, sf_dir):
    return sizing.cap_sectors(_book(spark, sf_dir).withColumn("weight", F.col("pooled_p") / 10), 0.3, ["run_id"]).select("security_id", r6(F.col("weight")).alias("weight"))


@query("cio_veto", f"""WITH {_BOOK}, b AS (SELECT security_id FROM d WHERE pooled_p > 0.8), v AS (SELECT security_id FROM b WHERE security_id % 7 = 3), n AS (SELECT (SELECT count(*) FROM v) <= floor((SELECT count(*) FROM b) * 0.2 + 1e-9) AS ok) SELECT b.security_id FROM b, n WHERE ok AND b.security_id NOT IN (SELECT security_id FROM v)""")
def cio_veto(spark, sf_dir):
    book = _book(spark, sf_dir).filter("pooled_p > 0.8").withColumn("entity", F.col("security_id"))
    decided = book.select("run_id", "entity", F.when(F.col("security_id") % 7 == 3, "veto").otherwise("keep").alias("action"))
    return sizing.apply_vetoes(book, decided).select("security_id")


_SESSIONS = "sessions AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session_date FROM lineitem WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5 AND dayofyear(l_shipdate) % 40 <> 0)"


def _sessions(spark, sf_dir):
    d = F.to_date("l_shipdate")
    return load(spark, sf_dir, "lineitem").filter(F.dayofweek(d).between(2, 6) & (F.dayofyear(d) % 40 != 0)).select(d.alias("session_date")).distinct()


def _ranges(spark):
    return spark.createDataFrame([("1996-01-01", "1997-06-30"), ("1997-09-01", "1998-12-31")], "a string, b string").select(F.to_date("a").alias("range_start"), F.to_date("b").alias("range_end"))


_COVERED = "(SELECT count(*) FROM (VALUES (DATE '1996-01-01', DATE '1997-06-30'), (DATE '1997-09-01', DATE '1998-12-31')) AS r(a, b) WHERE a <= least(session_date, t) AND greatest(session_date, t) <= b) > 0"


@query("calendar_next_session", f"WITH {_SESSIONS}, s AS (SELECT session_date, lead(session_date) OVER (ORDER BY session_date) AS t FROM sessions) SELECT CAST(session_date AS VARCHAR) AS day, CASE WHEN {_COVERED} THEN CAST(t AS VARCHAR) END AS target FROM s")
def calendar_next_session(spark, sf_dir):
    out = calendars.step_sessions(_sessions(spark, sf_dir), _ranges(spark), 1)
    return out.select(F.col("session_date").cast("string").alias("day"), F.col("target").cast("string").alias("target"))


@query("horizon_session", f"WITH {_SESSIONS}, s AS (SELECT session_date, lead(session_date, 21) OVER (ORDER BY session_date) AS t FROM sessions) SELECT CAST(session_date AS VARCHAR) AS day, CASE WHEN {_COVERED} THEN CAST(t AS VARCHAR) END AS target FROM s")
def horizon_session(spark, sf_dir):
    out = calendars.step_sessions(_sessions(spark, sf_dir), _ranges(spark), 21)
    return out.select(F.col("session_date").cast("string").alias("day"), F.col("target").cast("string").alias("target"))


@query("week_final", f"WITH {_SESSIONS}, s AS (SELECT session_date, lead(session_date) OVER (ORDER BY session_date) AS t FROM sessions) SELECT CAST(session_date AS VARCHAR) AS day, (isoyear(t) * 100 + week(t)) <> (isoyear(session_date) * 100 + week(session_date)) AS final FROM s")
def week_final(spark, sf_dir):
    return calendars.week_final(_sessions(spark, sf_dir)).select(F.col("session_date").cast("string").alias("day"), F.col("is_week_final").alias("final"))


_RATES = """rates AS (SELECT CAST(o_orderdate AS DATE) AS observation_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS vintage_date, max(o_totalprice) AS yield_pct FROM orders GROUP BY 1, 2)"""


@query("tbill_vintage", f"""WITH {_RATES}, {_SESSIONS}, p AS (SELECT session_date AS d, lag(session_date) OVER (ORDER BY session_date) AS prev FROM sessions), a AS (SELECT d, prev FROM p),
  j AS (SELECT d, observation_date, vintage_date, yield_pct, row_number() OVER (PARTITION BY d ORDER BY observation_date DESC, vintage_date DESC) AS k FROM a LEFT JOIN rates ON vintage_date < d AND observation_date <= prev)
  SELECT CAST(d AS VARCHAR) AS accrual, CAST(observation_date AS VARCHAR) AS observed, round(yield_pct, 4) AS yield_pct FROM j WHERE k = 1""")
def tbill_vintage(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    rates = o.groupBy(day.alias("observation_date"), F.date_add(day, (F.col("o_orderkey") % 30).cast("int")).alias("vintage_date")).agg(F.max("o_totalprice").alias("yield_pct")).withColumn("series", F.lit("x"))
    s = _sessions(spark, sf_dir)
    wide = spark.createDataFrame([("1900-01-01", "2100-01-01")], "a string, b string").select(F.to_date("a").alias("range_start"), F.to_date("b").alias("range_end"))
    previous = calendars.step_sessions(s, wide, -1)
    asked = s.select(F.lit("x").alias("series"), F.col("session_date").alias("accrual_date"))
    coverage = spark.createDataFrame([("x", "1900-01-01", 1)], "series string, d string, established_at int").select("series", F.to_date("d").alias("earliest_vintage"), "established_at")
    out = calendars.select_rates(asked, rates, coverage, previous)
    return out.select(F.col("accrual_date").cast("string").alias("accrual"), F.col("observation_date").cast("string").alias("observed"), F.round("yield_pct", 4).alias("yield_pct"))


_CODES = {("C", "@"): ("@", True), ("C", "T"): ("T", True), ("C", "4"): ("4", True), ("C", "Q"): ("8", True), ("A", " "): (" ", True), ("A", "Z"): ("Z", True), ("A", "x"): ("B", False)}
_PICK = ["'@'", "'T'", "'4'", "'Q'", "'zz'"]
_TRADES = """tr AS (SELECT user_id AS symbol, strftime(ts, '%Y-%m-%d') AS session_date, date_trunc('minute', ts) AS time, round(value) AS price, ['@', 'T', '4', 'Q', 'zz'][CAST(event_id % 5 AS INTEGER) + 1] AS code, event_id FROM events),
  st AS (SELECT *, CASE code WHEN '@' THEN 'eligible' WHEN 'T' THEN 'ineligible' WHEN '4' THEN 'conditional' ELSE 'unknown' END AS status FROM tr)"""


def _trades(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    pick = F.element_at(F.array(*map(F.lit, ["@", "T", "4", "Q", "zz"])), (F.col("event_id") % 5).cast("int") + 1)
    rows = e.select(F.col("user_id").alias("symbol"), F.date_format("ts", "yyyy-MM-dd").alias("session_date"), F.date_trunc("minute", "ts").alias("time"), F.round("value").alias("price"), F.array(pick).alias("codes"), "event_id")
    effects = trades.code_effects(F.lit("C"), F.col("codes"), _CODES)
    status, reason, more = trades.condition_verdict(effects)
    return rows.withColumn("status", status).withColumn("reason", reason).withColumn("needs_more", more)


@query("trade_eligibility", f"WITH {_TRADES} SELECT event_id, status, CASE WHEN status = 'unknown' THEN 'unknown_condition' END AS reason FROM st")
def trade_eligibility(spark, sf_dir):
    return _trades(spark, sf_dir).select("event_id", "status", "reason")


@query("ref_trade_asof", f"""WITH {_TRADES}, g AS (SELECT *, count(*) FILTER (status <> 'ineligible') OVER (PARTITION BY symbol, session_date, time) AS live, coalesce(bool_or(status = 'eligible') OVER b, false) AS plain, coalesce(bool_or(status = 'unknown') OVER b, false) AS doubt FROM st
   WINDOW b AS (PARTITION BY symbol, session_date ORDER BY epoch_us(time) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  h AS (SELECT *, coalesce(bool_or(status = 'conditional' AND NOT plain AND live > 1) OVER b, false) AS td FROM g WINDOW b AS (PARTITION BY symbol, session_date ORDER BY epoch_us(time) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  i AS (SELECT *, plain OR coalesce(bool_or(status = 'conditional' AND NOT plain AND live <= 1 AND NOT doubt AND NOT td) OVER b, false) AS qualified FROM h WINDOW b AS (PARTITION BY symbol, session_date ORDER BY epoch_us(time) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  k AS (SELECT *, CASE status WHEN 'eligible' THEN 'qualifies' WHEN 'ineligible' THEN 'not' WHEN 'unknown' THEN 'unknown' ELSE CASE WHEN qualified THEN 'not' WHEN live > 1 OR doubt OR td THEN 'unknown' ELSE 'qualifies' END END AS kind FROM i),
  n AS (SELECT symbol, session_date, time, bool_or(kind = 'unknown') AS u, min(price) AS lo, max(price) AS hi FROM k WHERE kind <> 'not' GROUP BY 1, 2, 3), z AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY symbol, session_date ORDER BY time DESC) = 1), e AS (SELECT DISTINCT symbol, session_date FROM tr)
  SELECT e.symbol, e.session_date, CASE WHEN z.symbol IS NOT NULL AND NOT u AND lo = hi THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN NOT u AND lo = hi THEN lo END AS price FROM e LEFT JOIN z ON e.symbol = z.symbol AND e.session_date = z.session_date""")
def ref_trade_asof(spark, sf_dir):
    return trades.reference_price(trades.sequence_verdicts(_trades(spark, sf_dir)), "backward").select("symbol", "session_date", "status", "price")


@query("condition_drift", """WITH m AS (SELECT DISTINCT l_returnflag AS tape, 'L' || CAST(l_linenumber AS VARCHAR) AS code, 'Line ' || CAST(l_linenumber AS VARCHAR) || ' ' || l_returnflag AS name FROM lineitem WHERE l_linestatus = 'F'),
  l AS (SELECT DISTINCT CASE WHEN o_orderstatus = 'P' THEN 'A' ELSE 'N' END AS tape, o_orderpriority AS code, lower(o_orderpriority) AS name FROM orders
    UNION SELECT DISTINCT l_returnflag, 'L' || CAST(l_linenumber AS VARCHAR), CASE WHEN l_linenumber = 3 THEN 'other' ELSE 'line-' || CAST(l_linenumber AS VARCHAR) || l_returnflag END FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber < 6)
  SELECT tape, code, CASE WHEN m.name IS NULL THEN 'unmapped_live_code' WHEN l.name IS NULL THEN 'missing_live_code' ELSE 'name_mismatch' END AS kind FROM m FULL JOIN l USING (tape, code) WHERE m.name IS NULL OR l.name IS NULL OR regexp_replace(lower(m.name), '[^a-z0-9]', '', 'g') <> regexp_replace(lower(l.name), '[^a-z0-9]', '', 'g')""")
def condition_drift(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    number = F.col("l_linenumber").cast("string")
    tape, code = F.col("l_returnflag").alias("tape"), F.concat(F.lit("L"), number).alias("code")
    m = lines.filter("l_linestatus = 'F'").select(tape, code, F.concat(F.lit("Line "), number, F.lit(" "), "l_returnflag").alias("expected_name")).distinct()
    live = lines.filter("l_linestatus = 'O' and l_linenumber < 6").select(tape, code, F.when(F.col("l_linenumber") == 3, "other").otherwise(F.concat(F.lit("line-"), number, "l_returnflag")).alias("name"))
    orders = load(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", "A").otherwise("N").alias("tape"), F.col("o_orderpriority").alias("code"), F.lower("o_orderpriority").alias("name"))
    return trades.compare_conditions(m, live.unionByName(orders).distinct())


_WEEKS = """w AS (SELECT user_id AS test_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS week, greatest(-0.05, least(0.05, (value - 30) / 1000)) / 0.05 AS y FROM events)"""


@query("seq_wealth", f"""WITH RECURSIVE {_WEEKS}, r AS (SELECT test_id, 0 AS t, 1.0::DOUBLE AS wealth, 0.0::DOUBLE AS s, 0.0::DOUBLE AS q, 0.0::DOUBLE AS mu, 1.0::DOUBLE AS v FROM (SELECT DISTINCT test_id FROM w) UNION ALL
  SELECT r.test_id, r.t + 1, wealth * (1 + greatest(0.0, least(0.5, mu / (v + mu * mu))) * y), s + y, q + pow(y - (s + y) / (r.t + 2), 2), (s + y) / (r.t + 2), (1 + q + pow(y - (s + y) / (r.t + 2), 2)) / (r.t + 2) FROM r JOIN w ON w.test_id = r.test_id AND w.week = r.t + 1 WHERE r.t < 104)
  SELECT test_id, t AS week, round(wealth, 6) AS wealth FROM r WHERE t > 0""")
def seq_wealth(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    w = load(spark, sf_dir, "events").select(F.col("user_id").alias("test_id"), place.alias("week"), numbers.clipped_share((F.col("value") - 30) / 1000, 0.05).alias("y")).filter(F.col("week") <= sequential.LAST_WEEK)
    packed = w.groupBy("test_id").agg(F.array_sort(F.collect_list(F.struct("week", "y"))).alias("w"))
    return packed.select("test_id", F.posexplode(sequential.wealth(F.col("w.y"))).alias("k", "x")).select("test_id", (F.col("k") + 1).alias("week"), r6(F.col("x")).alias("wealth"))


_DECIDE = """w AS (SELECT l_suppkey AS test_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS week, (max(l_discount) - 0.06 + (l_suppkey % 5 - 2) / 100.0) AS a, (max(l_tax) - 0.06 + (l_suppkey % 7 - 3) / 100.0) AS b FROM lineitem GROUP BY l_suppkey, l_shipdate)"""


def _recursion(prefix: str, y: str) -> str:
    s, q, m, v, x = (f"{prefix}{c}" for c in "sqmvx")
    mean = f"({s} + {y}) / (r.t + 2)"
    return f"{x} * (1 + greatest(0.0, least(0.5, {m} / ({v} + {m} * {m}))) * {y}), {s} + {y}, {q} + pow({y} - {mean}, 2), {mean}, (1 + {q} + pow({y} - {mean}, 2)) / (r.t + 2)"


@query("seq_decision", f"""WITH RECURSIVE {_DECIDE}, y AS (SELECT test_id, week, greatest(-0.05, least(0.05, a)) / 0.05 AS ya, greatest(-0.05, least(0.05, b)) / 0.05 AS yb FROM w WHERE week <= 104),
  r AS (SELECT test_id, 0 AS t, """ + ", ".join(f"1.0::DOUBLE AS {p}x, 0.0::DOUBLE AS {p}s, 0.0::DOUBLE AS {p}q, 0.0::DOUBLE AS {p}m, 1.0::DOUBLE AS {p}v" for p in ("e", "k", "z")) + f""" FROM (SELECT DISTINCT test_id FROM w) UNION ALL
  SELECT r.test_id, r.t + 1, {_recursion('e', 'ya')}, {_recursion('k', 'yb')}, {_recursion('z', '(-yb)')} FROM r JOIN y ON y.test_id = r.test_id AND y.week = r.t + 1),
  d AS (SELECT test_id, t, CASE WHEN t >= 26 AND ex >= 20 AND kx >= 20 AND zx >= 20 THEN 'INCONCLUSIVE' WHEN t >= 26 AND ex >= 20 AND kx >= 20 THEN 'PASS' WHEN t >= 26 AND zx >= 20 THEN 'FAIL' WHEN t = 104 THEN 'INCONCLUSIVE' END AS status FROM r WHERE t > 0),
  m AS (SELECT test_id, max(t) AS last, min(t) FILTER (status IS NOT NULL) AS ended FROM d GROUP BY 1) SELECT m.test_id, coalesce(ended, last) AS week, coalesce(d.status, 'RUNNING') AS status FROM m JOIN d ON d.test_id = m.test_id AND d.t = coalesce(ended, last)""")
def seq_decision(spark, sf_dir):
    i = F.col("l_suppkey")
    w = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_shipdate").agg((F.max("l_discount") - 0.06 + (i % 5 - 2) / 100.0).alias("vs_index"), (F.max("l_tax") - 0.06 + (i % 7 - 3) / 100.0).alias("vs_quant"))
    w = w.withColumn("week", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate"))).withColumnRenamed("l_suppkey", "test_id")
    return sequential.sequential_decisions(w).select("test_id", "week", "status")


@query("bartlett_lrv", """WITH v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), d AS (SELECT user_id, k, value - avg(value) OVER (PARTITION BY user_id) AS d FROM v), p AS (SELECT user_id, d * d AS p0, """ + ", ".join(f"d * lag(d, {j}) OVER (PARTITION BY user_id ORDER BY k) AS p{j}" for j in (1, 2, 3)) + """ FROM d)
  SELECT user_id, round((sum(p0) + 2 * 0.75 * coalesce(sum(p1), 0) + 2 * 0.5 * coalesce(sum(p2), 0) + 2 * 0.25 * coalesce(sum(p3), 0)) / count(*), 4) AS lrv FROM p GROUP BY 1""")
def bartlett_lrv(spark, sf_dir):
    v = load(spark, sf_dir, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return series.bartlett_lrv(v, "user_id", "k", "value", 4).select("user_id", F.round("lrv", 4).alias("lrv"))


_TABLE = ", ".join(f"({k}, {v})" for k, v in enumerate(numbers.BARTLETT_95))


@query("critical_values", f"""WITH t AS (SELECT range AS k, 0.02 + range * 0.013 AS b FROM range(0, 75)), v(i, x) AS (VALUES {_TABLE}), p AS (SELECT k, least(greatest(b / 0.02 - 1, 0), 49) AS pos FROM t)
  SELECT k, round(lo.x + (pos - lo.i) * (hi.x - lo.x), 6) AS critical FROM p JOIN v lo ON lo.i = least(floor(pos), 48) JOIN v hi ON hi.i = lo.i + 1""")
def critical_values(spark, sf_dir):
    t = spark.range(0, 75).select(F.col("id").alias("k"), (F.lit(0.02) + F.col("id") * 0.013).alias("b"))
    return t.select("k", r6(numbers.bartlett_critical(F.col("b"))).alias("critical"))


@query("kill_first_trigger", "SELECT user_id AS run_id, arg_min(event_type, ts) AS trigger FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1")
def kill_first_trigger(spark, sf_dir):
    e = load(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "signup")).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("trigger"), F.col("ts").alias("triggered_at"))
    return sizing.first_trigger(e).select("run_id", "trigger")


@query("drawdown_peak", f"WITH {BARS} SELECT security_id, {DAY}, round(max(close) OVER {W}, 9) AS peak, round((max(close) OVER {W} - close) / max(close) OVER {W}, 6) AS drawdown FROM bars")
def drawdown_peak(spark, sf_dir):
    out = series.peak_drawdown(bars(spark, sf_dir).withColumn("equity", F.col("close")), "security_id", "event_time")
    return out.select("security_id", _day(), F.round("peak", 9).alias("peak"), r6(F.col("drawdown")).alias("drawdown"))


@query("slippage", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END * (l_extendedprice * (1 - l_discount) - l_extendedprice) / l_extendedprice * 10000, 5) AS bps FROM lineitem")
def slippage(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_returnflag") == "A", "buy").otherwise("sell")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(numbers.slippage_bps(side, F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))), 5).alias("bps"))


@query("collar", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN floor(p_retailprice * 1.005 * 100 + 1e-6) ELSE ceil(p_retailprice * (1 - 50 / 10000.0) * 100 - 1e-6) END / 100 AS price FROM part")
def collar(spark, sf_dir):
    side = F.when(F.col("p_size") % 2 == 0, "buy").otherwise("sell")
    return load(spark, sf_dir, "part").select("p_partkey", numbers.collar_price(side, F.col("p_retailprice"), F.lit(50.0)).alias("price"))


@query("share_delta", "SELECT c_custkey, floor(0.05 * 1000000 / (abs(c_acctbal) + 1)) - (c_custkey % 40) AS delta FROM customer")
def share_delta(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", numbers.share_delta(F.lit(0.05), F.lit(1_000_000.0), F.abs("c_acctbal") + 1, (F.col("c_custkey") % 40).cast("double")).alias("delta"))


@query("mid_or_trade", "WITH q AS (SELECT p_partkey, p_retailprice AS bid, p_retailprice * (1 + (p_size % 10) / 1000.0) AS ask FROM part) SELECT p_partkey, CASE WHEN (ask - bid) / ((bid + ask) / 2) * 10000 <= 50 THEN 'quote_mid' ELSE 'last_trade' END AS source, round(CASE WHEN (ask - bid) / ((bid + ask) / 2) * 10000 <= 50 THEN (bid + ask) / 2 ELSE bid - 1 END, 6) AS price FROM q")
def mid_or_trade(spark, sf_dir):
    q = load(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("bid"), (F.col("p_retailprice") * (1 + (F.col("p_size") % 10) / 1000.0)).alias("ask"))
    return q.withColumn("x", numbers.mid_or_trade(F.col("bid"), F.col("ask"), F.col("bid") - 1)).select("p_partkey", "x.source", r6(F.col("x.price")).alias("price"))


@query("fiscal_index", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1998-05-15' AND greatest(1, 1998 * 4 + 2 - (year(o_orderdate) * 4 + quarter(o_orderdate))) <= 20 THEN 'Q-' || CAST(greatest(1, 1998 * 4 + 2 - (year(o_orderdate) * 4 + quarter(o_orderdate))) AS VARCHAR) END AS label FROM orders")
def fiscal_index(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", dates.fiscal_index(F.to_date("o_orderdate"), F.to_date(F.lit("1998-05-15"))).alias("label"))


@query("relative_days", "SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-12 06:00:00' THEN 't-' || CAST(CAST(floor((epoch_us(TIMESTAMP '2024-01-12 06:00:00') - epoch_us(ts)) / 86400000000) AS BIGINT) AS VARCHAR) || 'd' END AS age FROM events")
def relative_days(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", dates.relative_days(F.col("ts"), F.to_timestamp_ntz(F.lit("2024-01-12 06:00:00"))).alias("age"))


@query("month_ends", "WITH m AS (SELECT last_day(d) AS e FROM (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2024-12-01', INTERVAL 1 MONTH)) AS d)) SELECT CAST(CAST(e - greatest(0, isodow(e) - 5) AS DATE) AS VARCHAR) AS day FROM (SELECT e::DATE AS e FROM m) WHERE e - CAST(greatest(0, isodow(e) - 5) AS INTEGER) BETWEEN DATE '2020-01-15' AND DATE '2024-12-30'".replace("CAST(CAST(e - greatest(0, isodow(e) - 5) AS DATE) AS VARCHAR)", "CAST(e - CAST(greatest(0, isodow(e) - 5) AS INTEGER) AS VARCHAR)"))
def month_ends(spark, sf_dir):
    return dates.month_ends(spark, "2020-01-15", "2024-12-30").select(F.col("snapshot_date").cast("string").alias("day"))


#: The scrubbing patterns that documents can meet, for an engine without look-around: a match brings the character before it along.
_EDGE = r"(^|[^\pL\pN_])"


def _scrub_sql(column: str) -> str:
    number = r"[0-9]([0-9,]*[0-9])?(\.[0-9]+)?"
    year, month, day = "(19|20)[0-9]{2}", "(0?[1-9]|1[0-2])", "(0?[1-9]|[12][0-9]|3[01])"
    steps = [
        (rf"([$€£¥]|\b(USD|EUR|GBP)\s?){number}(\s?(thousand|million|billion|trillion|bn|mm|[kmbt])\b)?", "[AMOUNT]", "gi"),
        (rf"{number}\s?(thousand|million|billion|trillion)\b", "[NUM]", "gi"),
        (rf"{number}\s+shares\b", "[SHARES]", "gi"),
        (rf"{_EDGE}{year}[-/.]{month}[-/.]{day}\b", r"\1[DATE]", "g"),
        (rf"{_EDGE}{month}[-/.]{day}[-/.]({year}|[0-9]{{2}})\b", r"\1[DATE]", "g"),
    ]
    steps += [(rf"(^|[^0-9]){year}($|[^0-9])", r"\1[DATE]\3", "g")] * 2
    long = r"[0-9](,*[0-9]){3,}(\.[0-9]+)?|[0-9](,*[0-9]){2}\.[0-9]+|[0-9],*[0-9]\.[0-9]{2,}|[0-9]\.[0-9]{3,}"
    steps += [(rf"(^|[^\pL\pN_.])({long})", r"\1[NUM]", "g")]
    for pattern, by, flags in steps:
        column = f"regexp_replace({column}, '{pattern}', '{by}', '{flags}')"
    return column


@query("scrub_text", f"SELECT doc_id, {_scrub_sql('text')} AS t FROM documents")
def scrub_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.scrub(F.col("text")).alias("t"))


@query("analyst_filter", r"""SELECT doc_id, regexp_matches(lower(text), '\b(upgrade[sd]?|downgrade[sd]?|price[- ]targets?|target price|initiat\w+ coverage|reiterat\w+|analyst\w*|overweight|underweight|outperform|underperform|(buy|sell|hold)[- ]rating|rating (of|to|from)|(raise|lower|cut)s? target)\b') AS flagged
  FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' Analysts divided' WHEN doc_id % 3 = 1 THEN ' an overweighted view' ELSE '' END AS text FROM documents)""")
def analyst_filter(spark, sf_dir):
    i = F.col("doc_id")
    h = F.concat(F.coalesce("text", F.lit("")), F.when(i % 3 == 0, " Analysts divided").when(i % 3 == 1, " an overweighted view").otherwise(""))
    return load(spark, sf_dir, "documents").select("doc_id", text.is_analyst_item(h).alias("flagged"))


_ENDINGS = "['', ' Corp.', ' Co., Inc.', ' Limited /DE/', ', L.L.C', ' Holdings PLC']"


@query("short_name", f"""WITH n AS (SELECT c_custkey, replace(c_name, '#', ' ') AS base, {_ENDINGS}[CAST(c_custkey % 6 AS INTEGER) + 1] AS ending FROM customer)
  SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN base || ' Holdings' ELSE base END AS short FROM n""")
def short_name(spark, sf_dir):
    ending = F.element_at(F.array(*map(F.lit, ["", " Corp.", " Co., Inc.", " Limited /DE/", ", L.L.C", " Holdings PLC"])), (F.col("c_custkey") % 6).cast("int") + 1)
    n = F.concat(F.regexp_replace("c_name", "#", " "), ending)
    return load(spark, sf_dir, "customer").select("c_custkey", text.short_name(n).alias("short"))


@query("pseudonym", "SELECT s_suppkey, 'EXEC_' || upper(substr(sha256(lower(trim(s_name)) || '||' || CAST(s_nationkey AS VARCHAR)), 1, 8)) AS token FROM supplier")
def pseudonym(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", text.pseudonym(F.col("s_name"), F.col("s_nationkey")).alias("token"))


@query("render_tsv", "SELECT n_regionkey, 'id\tname\n' || string_agg(CAST(n_nationkey AS VARCHAR) || chr(9) || n_name, chr(10) ORDER BY n_nationkey) AS body FROM nation GROUP BY 1".replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '"))
def render_tsv(spark, sf_dir):
    return text.render_table(load(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], text.tsv_line(F.col("n_nationkey"), F.col("n_name")), "id\tname")


@query("entity_tokens", f"WITH {SNAPSHOT} SELECT security_id, 'TICKER_' || lpad(CAST(dense_rank() OVER (ORDER BY security_id) AS VARCHAR), CAST(greatest(2, length(CAST(dense_rank() OVER (ORDER BY security_id) AS VARCHAR))) AS INTEGER), '0') AS token FROM snap")
def entity_tokens(spark, sf_dir):
    s = snapshot(spark, sf_dir).withColumn("run_id", F.lit("run"))
    return xsection.entity_tokens(s, "security_id", ["run_id"]).select("security_id", "token")


@query("symbol_union", "SELECT 'r' AS run_id, array_to_string(list_sort(list_distinct(list(upper(trim(x))))), ',') AS symbols FROM (SELECT ' ' || s_name AS x FROM supplier UNION ALL SELECT lower(c_name) FROM customer)")
def symbol_union(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    a = s.select(F.lit("r").alias("run_id"), F.concat(F.lit(" "), "s_name").alias("symbol"))
    b = load(spark, sf_dir, "customer").select(F.lit("r").alias("run_id"), F.lower("c_name").alias("symbol"))
    return evidence.symbol_set(a, b).select("run_id", F.array_join("symbols", ",").alias("symbols"))


@query("set_digest", "SELECT n_regionkey, sha256(string_agg(n_name, chr(10) ORDER BY n_name)) AS digest FROM nation GROUP BY 1")
def set_digest(spark, sf_dir):
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(calendars.set_digest(F.col("n_name")).alias("digest"))


@query("evidence_check", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([doc_id % 3, doc_id % 5, doc_id % 7], lambda x: NOT list_contains([0, 1, 4], x)))), ',') AS missing FROM documents")
def evidence_check(spark, sf_dir):
    i = F.col("doc_id")
    missing = evidence.unprovided_evidence(F.array(i % 3, i % 5, i % 7), F.array(*(F.lit(x).cast("long") for x in (0, 1, 4))))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(missing.cast("array<string>"), ",").alias("missing"))


@query("visible_news", f"""WITH {FACTS}, n AS (SELECT security_id % 15 AS security_id, CAST(event_id // 2 AS VARCHAR) AS item_id, event_time, available_at, event_type FROM facts WHERE available_at <= TIMESTAMP '2024-01-12'),
  l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY security_id, item_id ORDER BY available_at DESC) = 1), r AS (SELECT * FROM l WHERE event_time <= TIMESTAMP '2024-01-12' AND event_time >= TIMESTAMP '2024-01-12' - INTERVAL 5 DAY AND event_type <> 'error')
  SELECT security_id, item_id FROM r QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY event_time DESC, item_id DESC) <= 10""")
def visible_news(spark, sf_dir):
    n = facts(spark, sf_dir).select((F.col("security_id") % 15).alias("security_id"), F.floor(F.col("event_id") / 2).cast("string").alias("item_id"), "event_time", "available_at", "event_type")
    return fu.visible_news(n, F.to_timestamp_ntz(F.lit("2024-01-12 00:00:00")), F.col("event_type") == "error", 5).select("security_id", "item_id")


@query("logistic_fit")
def logistic_fit(spark, sf_dir):
    s = snapshot(spark, sf_dir)
    examples = s.select("sector", F.create_map(F.lit("close"), F.col("close"), F.lit("volume"), F.col("volume")).alias("values"), (F.col("security_id") % 3 == 0).cast("int").alias("target"))
    return gate.fit_logistic(examples, ["close", "volume"], "sector").select("group", r6(F.col("intercept")).alias("intercept"), *(F.transform(c, lambda v: F.round(v, 6)).alias(c) for c in ("coefficients", "means", "scales")))


@query("stacker_fit")
def stacker_fit(spark, sf_dir):
    h = history(spark, sf_dir).select("horizon", numbers.clipped_logit(F.col("forecast"), 0.02, 0.98).alias("logit"), "outcome", F.lit(1.0).alias("weight"), F.lit(12).alias("periods"))
    return committee.fit_stacker(h)


@query("mask_aliases")
def mask_aliases(spark, sf_dir):
    masker = text.Masker([("TICKER_01", "name", "for the"), ("TICKER_02", "ticker", "THE"), ("TICKER_03", "brand", "and that")])
    return load(spark, sf_dir, "documents").select("doc_id", masker.column(F.col("text")).alias("masked"))


@query("two_figures")
def two_figures(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.sig2(F.col("p_retailprice")).alias("s"))


@query("mc_type1")
def mc_type1(spark, sf_dir):
    return sequential.upper_bounds(sequential.simulate(spark, ["iid_t3", "garch11", "ar1_0.1", "ar1_0.2", "ar1_0.3", "skewed"], 20_000))


@query("mc_power")
def mc_power(spark, sf_dir):
    """How often the test passes by the last week at weekly edges of 0.3, 0.5 and 0.75 per cent."""
    runs = [sequential.simulate(spark, ["iid_normal"], 2_000, edge=e).withColumn("edge", F.lit(e)) for e in (0.003, 0.005, 0.0075)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query("mc_tost_size")
def mc_tost_size(spark, sf_dir):
    """How often paths whose mean lies on either margin are called equivalent."""
    nulls = ["iid_t3", "garch11", "ar1_0.1", "ar1_0.2", "ar1_0.3"]
    runs = [sequential.simulate(spark, nulls, 20_000, edge=e).withColumn("mean", F.lit(e)) for e in (sequential.MARGIN, -sequential.MARGIN)]
    return sequential.upper_bounds(runs[0].unionByName(runs[1]))


@query("tost_diagnostic")
def tost_diagnostic(spark, sf_dir):
    v = load(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 1000).alias("v"))
    return sequential.tost(v, "user_id", "event_id", "v")


@query("commit_hash")
def commit_hash(spark, sf_dir):
    return evidence.commitments(load(spark, sf_dir, "nation"), "n_regionkey", ["n_nationkey"])
