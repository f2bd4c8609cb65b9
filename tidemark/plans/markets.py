"""Queries over corporate actions, spreads, benchmarks, metrics and outcomes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import numbers
from tidemark.operators import actions, benchmarks, metrics, outcomes, spreads
from tidemark.plans.bindings import BARS, SECTORS, bars, load, query, r6, sectors

# ---- corporate actions: the lines numbered 7 are actions, whose versions become visible up to 90 days late; a few
# suppliers end after the last bar.
_ENDED = "2001-11-20"
_ACTIONS = f"""lines AS (SELECT l_suppkey AS security_id, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS action_id, CAST(l_shipdate AS DATE) AS ex_date,
   CASE l_orderkey % 10 WHEN 0 THEN 'forward_split' WHEN 1 THEN 'reverse_split' WHEN 2 THEN 'stock_dividend' WHEN 9 THEN 'spin_off' ELSE 'cash_dividend' END AS kind,
   CASE l_orderkey % 10 WHEN 0 THEN 2.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.05 WHEN 9 THEN 1.0 ELSE l_quantity / 10 END AS rate, l_shipdate + to_days(CAST(l_partkey % 90 AS INTEGER)) AS available_at,
   lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS source_version, l_tax >= 0.08 AS withdrawn FROM lineitem WHERE l_linenumber = 7
   UNION ALL SELECT s_suppkey, 'end-' || CAST(s_suppkey AS VARCHAR), DATE '{_ENDED}', CASE s_suppkey % 4 WHEN 0 THEN 'worthless_removal' WHEN 1 THEN 'stock_merger' ELSE 'cash_merger' END, CASE WHEN s_suppkey % 4 = 2 THEN 1500.0 END, TIMESTAMP '{_ENDED}', '0', false FROM supplier WHERE s_suppkey % 7 = 0)"""


def _actions(spark, sf_dir):
    l, k, i = load(spark, sf_dir, "lineitem").filter("l_linenumber = 7"), F.col("l_orderkey") % 10, F.col("l_suppkey")
    rows = l.select(
        i.alias("security_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), i.cast("string")).alias("action_id"), F.to_date("l_shipdate").alias("ex_date"),
        F.when(k == 0, "forward_split").when(k == 1, "reverse_split").when(k == 2, "stock_dividend").when(k == 9, "spin_off").otherwise("cash_dividend").alias("kind"),
        F.when(k == 0, 2.0).when(k == 1, 0.5).when(k == 2, 0.05).when(k == 9, 1.0).otherwise(F.col("l_quantity") / 10).alias("rate"),
        (F.col("l_shipdate") + F.make_dt_interval(days=(F.col("l_partkey") % 90).cast("int"))).alias("available_at"), F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("source_version"), (F.col("l_tax") >= 0.08).alias("withdrawn"),
    )
    s = load(spark, sf_dir, "supplier").filter("s_suppkey % 7 = 0")
    j = F.col("s_suppkey") % 4
    ends = s.select(
        F.col("s_suppkey").alias("security_id"), F.concat(F.lit("end-"), F.col("s_suppkey").cast("string")).alias("action_id"), F.to_date(F.lit(_ENDED)).alias("ex_date"),
        F.when(j == 0, "worthless_removal").when(j == 1, "stock_merger").otherwise("cash_merger").alias("kind"), F.when(j == 2, 1500.0).alias("rate"), F.to_timestamp_ntz(F.lit(f"{_ENDED} 00:00:00")).alias("available_at"), F.lit("0").alias("source_version"), F.lit(False).alias("withdrawn"),
    )
    return rows.unionByName(ends)


def _daily_bars(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("day", F.to_date("event_time"))


_DATES = ("1998-07-01 00:00:00", "2002-01-01 00:00:00")
_SEEN = f"""dates AS (SELECT unnest([TIMESTAMP '{_DATES[0]}', TIMESTAMP '{_DATES[1]}']) AS as_of),
  seen AS (SELECT * FROM (SELECT d.as_of, a.* FROM lines a JOIN dates d ON a.available_at <= d.as_of QUALIFY row_number() OVER (PARTITION BY d.as_of, action_id ORDER BY available_at DESC, source_version DESC) = 1) WHERE NOT withdrawn),
  daily AS (SELECT as_of, security_id, ex_date, product(CASE WHEN kind IN ('forward_split', 'reverse_split') THEN rate WHEN kind = 'stock_dividend' THEN 1 + rate ELSE 1 END) AS shares, sum(CASE WHEN kind = 'cash_dividend' THEN rate ELSE 0 END) AS cash,
    count(*) FILTER (kind = 'spin_off') AS unknown FROM seen WHERE kind NOT IN ('worthless_removal', 'stock_merger', 'cash_merger') GROUP BY 1, 2, 3)"""


@query("adjusted_prices", f"""WITH {BARS}, {_ACTIONS}, {_SEEN}, b AS (SELECT security_id, CAST(event_time AS DATE) AS day, close FROM bars),
  f AS (SELECT d.as_of, d.security_id, d.ex_date, ln(1 / any_value(shares)) AS s, any_value(cash) AS cash, any_value(shares) AS shares, arg_max(close, day) AS before FROM daily d LEFT JOIN b ON b.security_id = d.security_id AND b.day < d.ex_date AND b.day <= CAST(d.as_of AS DATE) GROUP BY 1, 2, 3),
  g AS (SELECT *, CASE WHEN before IS NULL OR cash = 0 THEN 1 ELSE 1 - cash * shares / before END AS l FROM f),
  x AS (SELECT d.as_of, b.security_id, b.day, any_value(b.close) AS close, coalesce(sum(s), 0) AS s, coalesce(sum(s + CASE WHEN l > 0 THEN ln(l) ELSE 0 END), 0) AS t, count(*) FILTER (l <= 0) AS lost FROM dates d JOIN b ON b.day <= CAST(d.as_of AS DATE) LEFT JOIN g ON g.as_of = d.as_of AND g.security_id = b.security_id AND g.ex_date > b.day GROUP BY 1, 2, 3)
  SELECT strftime(as_of, '%Y-%m-%d') AS as_of, security_id, CAST(day AS VARCHAR) AS day, round(exp(s), 8) AS split_factor, CASE WHEN lost = 0 THEN round(exp(t), 8) END AS total_factor FROM x""")
def adjusted_prices(spark, sf_dir):
    out = actions.adjusted_prices(_daily_bars(spark, sf_dir), _actions(spark, sf_dir), [F.to_timestamp_ntz(F.lit(d)) for d in _DATES])
    factor = lambda c: F.round(F.col(c) / F.col("close"), 8)
    return out.select(F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "security_id", F.col("day").cast("string").alias("day"), factor("split_close").alias("split_factor"), factor("total_close").alias("total_factor"))


@query("horizon_total_returns", f"""WITH {BARS}, {_ACTIONS}, {_SEEN}, b AS (SELECT security_id, CAST(event_time AS DATE) AS day, close, lead(CAST(event_time AS DATE), 21) OVER (PARTITION BY security_id ORDER BY event_time) AS exit_day, lead(close, 21) OVER (PARTITION BY security_id ORDER BY event_time) AS exit,
    last_value(close) OVER (PARTITION BY security_id ORDER BY event_time ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_close FROM bars),
  e AS (SELECT b.*, t.kind AS end_kind, t.rate AS end_rate, coalesce(exit_day, t.ex_date) AS end_day FROM b LEFT JOIN (SELECT * FROM seen WHERE as_of = TIMESTAMP '{_DATES[1]}' AND action_id LIKE 'end-%') t ON t.security_id = b.security_id),
  a AS (SELECT e.security_id, e.day, d.cash * exp(sum(ln(d.shares)) OVER (PARTITION BY e.security_id, e.day ORDER BY d.ex_date)) AS cash, ln(d.shares) AS s, d.unknown FROM e JOIN daily d ON d.as_of = TIMESTAMP '{_DATES[1]}' AND d.security_id = e.security_id AND d.ex_date > e.day AND d.ex_date <= e.end_day),
  n AS (SELECT security_id, day, sum(cash) AS cash, exp(sum(s)) AS shares, sum(unknown) AS unknown FROM a GROUP BY 1, 2),
  r AS (SELECT e.*, coalesce(n.cash, 0) AS cash, coalesce(n.shares, 1) AS shares, CASE WHEN end_day IS NULL THEN 'no_exit' WHEN n.unknown > 0 THEN 'uninterpreted' WHEN exit_day IS NULL AND end_kind = 'stock_merger' THEN 'acquirer' END AS reason,
    CASE WHEN exit_day IS NOT NULL THEN 'bar' WHEN end_kind = 'worthless_removal' THEN 'worthless' WHEN end_rate IS NOT NULL THEN 'consideration' ELSE 'default' END AS source FROM e LEFT JOIN n ON n.security_id = e.security_id AND n.day = e.day)
  SELECT security_id, CAST(day AS VARCHAR) AS day, CAST(end_day AS VARCHAR) AS end_day, reason, CASE WHEN reason IS NULL THEN source END AS source,
    CASE WHEN reason IS NULL THEN round((CASE source WHEN 'bar' THEN exit WHEN 'worthless' THEN 0 WHEN 'consideration' THEN end_rate ELSE 0.7 * last_close END * shares + cash) / close - 1, 4) END AS ret FROM r""")
def horizon_total_returns(spark, sf_dir):
    visible = actions.visible_actions(_actions(spark, sf_dir), [F.to_timestamp_ntz(F.lit(_DATES[1]))])
    out = actions.horizon_returns(_daily_bars(spark, sf_dir), visible, 21)
    return out.select("security_id", F.col("day").cast("string").alias("day"), F.col("end_day").cast("string").alias("end_day"), "reason", "source", F.round("ret", 4).alias("ret"))


# ---- spreads
_W = "(PARTITION BY security_id ORDER BY event_time)"
_FRAME = "(PARTITION BY security_id ORDER BY event_time ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"


@query("effective_spreads", f"""WITH {BARS}, p AS (SELECT *, lag(high) OVER {_W} AS h0, lag(low) OVER {_W} AS l0, lag(close) OVER {_W} AS c0 FROM bars),
  a AS (SELECT *, CASE WHEN low > c0 THEN low - c0 WHEN high < c0 THEN high - c0 ELSE 0 END AS gap FROM p), g AS (SELECT *, high - gap AS h, low - gap AS l FROM a),
  q AS (SELECT *, pow(ln(h / l), 2) + pow(ln(h0 / l0), 2) AS beta, pow(ln(greatest(h, h0) / least(l, l0)), 2) AS gamma, 4 * (ln(c0) - ln(h0 * l0) / 2) * (ln(c0) - ln(high * low) / 2) AS square FROM g),
  s AS (SELECT *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2))) AS alpha FROM q),
  d AS (SELECT *, CASE WHEN c0 IS NOT NULL THEN greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0) END AS cs, CASE WHEN c0 IS NOT NULL THEN CASE WHEN square > 1e-12 THEN sqrt(square) ELSE 0 END END AS ar FROM s)
  SELECT security_id, strftime(event_time, '%Y-%m-%d') AS day, CASE WHEN count(cs) OVER {_FRAME} = 21 THEN round(avg(cs) OVER {_FRAME}, 6) END AS corwin_schultz, CASE WHEN count(ar) OVER {_FRAME} = 21 THEN round(avg(ar) OVER {_FRAME}, 6) END AS abdi_ranaldo FROM d""")
def effective_spreads(spark, sf_dir):
    out = spreads.effective_spreads(bars(spark, sf_dir))
    return out.select("security_id", F.date_format("event_time", "yyyy-MM-dd").alias("day"), F.round("corwin_schultz", 6).alias("corwin_schultz"), F.round("abdi_ranaldo", 6).alias("abdi_ranaldo"))


# ---- benchmarks: monthly returns of suppliers, rebalanced each quarter, cash at bill yields of order prices
_MONTHLY = f"""{BARS}, {SECTORS}, m AS (SELECT security_id, year(event_time) * 12 + month(event_time) - 1 AS t, arg_max(close, event_time) AS close FROM bars GROUP BY 1, 2),
  monthly AS (SELECT a.security_id, a.t // 3 AS period, a.t, a.close / b.close - 1 AS ret FROM m a JOIN m b ON b.security_id = a.security_id AND b.t = a.t - 1),
  bills AS (SELECT t // 3 AS period, t, pow(1 + y / 100, 30 / 365.0) - 1 AS bill FROM (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS t, avg(o_totalprice) / 100000 AS y FROM orders GROUP BY 1))"""


def _monthly(spark, sf_dir):
    t = (F.year("event_time") * 12 + F.month("event_time") - 1).alias("t")
    m = bars(spark, sf_dir).groupBy("security_id", t).agg(F.max_by("close", "event_time").alias("close"))
    before = m.select("security_id", (F.col("t") + 1).alias("t"), F.col("close").alias("_was"))
    return m.join(before, ["security_id", "t"]).select("security_id", F.floor(F.col("t") / 3).alias("period"), "t", (F.col("close") / F.col("_was") - 1).alias("ret"))


def _bills(spark, sf_dir):
    t = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("t")
    y = load(spark, sf_dir, "orders").groupBy(t).agg((F.avg("o_totalprice") / 100_000).alias("y"))
    return y.select(F.floor(F.col("t") / 3).alias("period"), "t", numbers.bill_accrual(F.col("y"), F.lit(30)).alias("bill"))


# members of a quarter are the names with a return in its first month; the book holds 90 per cent of them in thirds
_TARGETS = "targets AS (SELECT period, security_id, 0.9 / count(*) OVER (PARTITION BY period) AS weight FROM monthly WHERE t % 3 = 0)"
_DRIFT = f"""{_MONTHLY}, {_TARGETS}, g AS (SELECT w.period, r.t, w.security_id, w.weight, exp(sum(ln(1 + r.ret)) OVER (PARTITION BY w.period, w.security_id ORDER BY r.t)) AS g FROM targets w JOIN monthly r ON r.period = w.period AND r.security_id = w.security_id),
  c AS (SELECT period, t, exp(sum(ln(1 + bill)) OVER (PARTITION BY period ORDER BY t)) AS c FROM bills), h AS (SELECT period, t, sum(weight * g) AS held, count(*) AS n FROM g GROUP BY 1, 2), due AS (SELECT period, count(*) AS due FROM targets GROUP BY 1),
  v AS (SELECT h.period, h.t, CASE WHEN min(CAST(n = due AS INTEGER)) OVER (PARTITION BY h.period ORDER BY h.t) = 1 THEN held + 0.1 * c END AS value FROM h JOIN due ON due.period = h.period JOIN c ON c.period = h.period AND c.t = h.t)"""


def _drift(spark, sf_dir):
    monthly = _monthly(spark, sf_dir)
    members = monthly.filter(F.col("t") % 3 == 0).select("period", "security_id")
    targets = benchmarks.equal_weights(members).withColumn("weight", F.col("weight") * 0.9)
    return targets, benchmarks.drifted(targets, monthly, _bills(spark, sf_dir))


@query("benchmark_equal_weight", f"WITH {_DRIFT} SELECT period, t, round(value / CASE WHEN row_number() OVER (PARTITION BY period ORDER BY t) = 1 THEN 1 ELSE lag(value) OVER (PARTITION BY period ORDER BY t) END - 1, 8) AS ret FROM v")
def benchmark_equal_weight(spark, sf_dir):
    return benchmarks.book_returns(_drift(spark, sf_dir)[1]).select("period", "t", F.round("ret", 8).alias("ret"))


@query("benchmark_turnover", f"""WITH {_DRIFT}, d AS (SELECT g.period + 1 AS period, g.security_id, arg_max(weight * g / value, g.t) AS was FROM g JOIN v ON v.period = g.period AND v.t = g.t WHERE value IS NOT NULL GROUP BY 1, 2),
  k AS (SELECT * FROM d WHERE period IN (SELECT period FROM targets)) SELECT coalesce(w.period, k.period) AS period, round(sum(abs(coalesce(w.weight, 0) - coalesce(k.was, 0))), 8) AS turnover FROM targets w FULL JOIN k ON k.period = w.period AND k.security_id = w.security_id GROUP BY 1""")
def benchmark_turnover(spark, sf_dir):
    targets, weights = _drift(spark, sf_dir)
    return benchmarks.turnover(weights.filter(F.col("value").isNotNull()), targets, F.col("period") + 1).select("period", F.round("turnover", 8).alias("turnover"))


_BOOK = f"{_MONTHLY}, book AS (SELECT t AS period, r.security_id, s.sector, 0.002 + (r.security_id % 4) / 1000.0 AS weight, ret FROM monthly r JOIN sectors s ON s.security_id = r.security_id)"


def _matched(spark, sf_dir):
    rows = _monthly(spark, sf_dir).join(sectors(spark, sf_dir), "security_id").select(F.col("t").alias("period"), "security_id", "sector", (F.lit(0.002) + (F.col("security_id") % 4) / 1000.0).alias("weight"), "ret")
    return rows, _bills(spark, sf_dir).select(F.col("t").alias("period"), "bill")


@query("benchmark_sector_matched", f"WITH {_BOOK}, s AS (SELECT period, sector, sum(weight) FILTER (security_id % 3 <> 0) AS w, avg(ret) FILTER (security_id % 5 <> 0) AS r FROM book GROUP BY 1, 2) SELECT s.period, CASE WHEN count(*) FILTER (r IS NULL) = 0 THEN round(sum(w * r) + (1 - sum(w)) * any_value(bill), 8) END AS ret FROM s JOIN bills b ON b.t = s.period WHERE w IS NOT NULL GROUP BY 1")
def benchmark_sector_matched(spark, sf_dir):
    rows, bills = _matched(spark, sf_dir)
    by_sector = rows.filter("security_id % 5 <> 0").groupBy("period", "sector").agg(F.avg("ret").alias("sector_ret"))
    return benchmarks.sector_matched(rows.filter("security_id % 3 <> 0"), by_sector, bills).select("period", F.round("ret", 8).alias("ret"))


@query("benchmark_exposure_matched", f"WITH {_BOOK}, g AS (SELECT period, sum(weight) AS gross, avg(ret) AS r FROM book GROUP BY 1) SELECT period, round(gross * r + (1 - gross) * b.bill, 8) AS ret FROM g JOIN (SELECT t, bill FROM bills) b ON b.t = g.period")
def benchmark_exposure_matched(spark, sf_dir):
    rows, bills = _matched(spark, sf_dir)
    gross, index = rows.groupBy("period").agg(F.sum("weight").alias("gross")), rows.groupBy("period").agg(F.avg("ret").alias("index_ret"))
    return benchmarks.exposure_matched(gross, index, bills).select("period", F.round("ret", 8).alias("ret"))


# ---- metrics: forecasts are rounded closes, so that many are equal; trials are suppliers' monthly returns
_FORECASTS = f"{_MONTHLY}, f AS (SELECT a.t AS run, a.security_id, round(a.close / 400) AS p, b.ret FROM m a JOIN monthly b ON b.security_id = a.security_id AND b.t = a.t + 1)"
_IC = f"""{_FORECASTS}, k AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY p) + (count(*) OVER (PARTITION BY run, p) - 1) / 2.0 AS x, rank() OVER (PARTITION BY run ORDER BY ret) + (count(*) OVER (PARTITION BY run, ret) - 1) / 2.0 AS y FROM f),
  ics AS (SELECT run, count(*) AS n, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS ic FROM k GROUP BY 1)"""


def _ics(spark, sf_dir):
    t = (F.year("event_time") * 12 + F.month("event_time") - 1).alias("run")
    closes = bars(spark, sf_dir).groupBy("security_id", t).agg(F.round(F.max_by("close", "event_time") / 400).alias("p"))
    ahead = _monthly(spark, sf_dir).select("security_id", (F.col("t") - 1).alias("run"), "ret")
    return metrics.rank_ic(closes.join(ahead, ["security_id", "run"]), ["run"], "p", "ret", "security_id")


@query("rank_ic", f"WITH {_IC} SELECT run, n, round(ic, 8) AS ic FROM ics")
def rank_ic(spark, sf_dir):
    return _ics(spark, sf_dir).select("run", "n", F.round("ic", 8).alias("ic"))


@query("ic_by_offset", f"WITH {_IC} SELECT run % 5 AS \"offset\", count(ic) AS n, count(*) FILTER (ic IS NULL) AS undefined, round(avg(ic), 8) AS mean, round(CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) END, 6) AS t FROM ics GROUP BY 1")
def ic_by_offset(spark, sf_dir):
    return metrics.ic_by_offset(_ics(spark, sf_dir), "run", 5).select(F.col("offset").cast("int").alias("offset"), "n", "undefined", F.round("mean", 8).alias("mean"), r6(F.col("t")).alias("t"))


# monthly returns that can be compared with each other: those of a supplier's mean discount, less what is usual
_TRIALS = "trials AS (SELECT l_suppkey AS trial, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS t, avg(l_discount) - 0.05 + (l_suppkey % 7 - 3) / 2000.0 AS ret FROM lineitem GROUP BY l_suppkey, 2)"


def _trials(spark, sf_dir):
    i = F.col("l_suppkey")
    return load(spark, sf_dir, "lineitem").groupBy(i.alias("trial"), (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("t")).agg((F.avg("l_discount") - 0.05 + (F.first(i) % 7 - 3) / 2000.0).alias("ret"))


@query("performance", f"""WITH {_TRIALS}, g AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY trial ORDER BY t) AS g FROM trials), d AS (SELECT *, exp(g - greatest(max(g) OVER (PARTITION BY trial ORDER BY t), 0)) - 1 AS d FROM g)
  SELECT trial, count(*) AS n, round(exp(sum(ln(1 + ret)) * 12 / count(*)) - 1, 6) AS cagr, round(avg(ret) / stddev_samp(ret) * sqrt(12), 6) AS sharpe, round(CASE WHEN sum(CAST(ret < 0 AS INTEGER)) > 0 THEN avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) * sqrt(12) END, 5) AS sortino, round(min(d), 6) AS max_drawdown FROM d GROUP BY 1""")
def performance(spark, sf_dir):
    out = metrics.performance(_trials(spark, sf_dir), "trial", "t", 12)
    return out.select("trial", "n", r6(F.col("cagr")).alias("cagr"), r6(F.col("sharpe")).alias("sharpe"), F.round("sortino", 5).alias("sortino"), r6(F.col("max_drawdown")).alias("max_drawdown"))


def _phi(z: str) -> str:
    """The normal distribution by its power series, which 120 terms settle within 6 deviations; beyond, 0 or 1 to 9 digits."""
    return f"CASE WHEN {z} > 6 THEN 1.0 WHEN {z} < -6 THEN 0.0 ELSE 0.5 + exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(120), lambda k: {z} * coalesce(list_product(list_transform(range(1, k + 1), lambda j: {z} * {z} / (2 * j + 1))), 1))) END"


@query("deflated_sharpe", f"""WITH RECURSIVE {_TRIALS}, mean AS (SELECT *, avg(ret) OVER (PARTITION BY trial) AS mu FROM trials),
  s AS (SELECT trial, count(*) AS n, avg(ret) / stddev_samp(ret) AS sharpe, avg(pow(ret - mu, 3)) / pow(avg(pow(ret - mu, 2)), 1.5) AS g3, avg(pow(ret - mu, 4)) / pow(avg(pow(ret - mu, 2)), 2) AS g4 FROM mean GROUP BY 1),
  x AS (SELECT var_samp(sharpe) AS v, count(*) AS k FROM s), aims AS (SELECT unnest([1 - 1.0 / k, 1 - 1 / (k * exp(1)), 0.9]) AS p, unnest([1, 2, 3]) AS i FROM x),
  half(i, p, lo, hi, step) AS (SELECT i, p, -6.0::DOUBLE, 6.0::DOUBLE, 0 FROM aims UNION ALL SELECT i, p, CASE WHEN {_phi('((lo + hi) / 2)')} < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_phi('((lo + hi) / 2)')} < p THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM half WHERE step < 55),
  z AS (SELECT max((lo + hi) / 2) FILTER (i = 1) AS z1, max((lo + hi) / 2) FILTER (i = 2) AS z2, max((lo + hi) / 2) FILTER (i = 3) AS z3 FROM half WHERE step = 55),
  b AS (SELECT s.*, z3, sqrt(v) * ((1 - 0.5772156649015329) * z1 + 0.5772156649015329 * z2) AS best, 1 - g3 * sharpe + (g4 - 1) / 4 * sharpe * sharpe AS u FROM s, x, z), q AS (SELECT *, (sharpe - best) * sqrt(n - 1) / sqrt(u) AS w FROM b)
  SELECT trial, n, round(sharpe, 8) AS sharpe, round(best, 8) AS expected_best, round({_phi('w')}, 7) AS dsr, CASE WHEN sharpe > 0 THEN round(ln(1 + u * pow(z3 / sharpe, 2)), 6) END AS log_track_record FROM q""")
def deflated_sharpe(spark, sf_dir):
    out = metrics.deflated_sharpe(_trials(spark, sf_dir), "trial")
    return out.select("trial", "n", F.round("sharpe", 8).alias("sharpe"), F.round("expected_best", 8).alias("expected_best"), F.round("dsr", 7).alias("dsr"), r6(F.log("track_record")).alias("log_track_record"))


@query("backtest_overfitting", f"""WITH {_TRIALS}, times AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM trials)), b AS (SELECT trial, (i - n % 16) // (n // 16) AS b, ret, n // 16 * 16 AS due FROM trials JOIN times USING (t) WHERE i >= n % 16),
  whole AS (SELECT trial FROM b GROUP BY 1 HAVING count(*) = any_value(due) AND min(ret) < max(ret)), p AS (SELECT trial, b, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM b WHERE trial IN (SELECT trial FROM whole) GROUP BY 1, 2),
  splits AS (SELECT range AS m FROM range(65536) WHERE bit_count(range) = 8), h AS (SELECT trial, m, (m >> b) & 1 AS inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM p, splits GROUP BY 1, 2, 3),
  r AS (SELECT trial, m, inside, round(s / n / sqrt((q - s * s / n) / (n - 1)), 12) AS x FROM h), o AS (SELECT a.trial, a.m, a.x AS inner_x, c.x AS outer_x FROM r a JOIN r c ON a.trial = c.trial AND a.m = c.m AND a.inside = 1 AND c.inside = 0),
  w AS (SELECT m, arg_min(outer_x, (-inner_x, trial)) AS bar FROM o GROUP BY 1), k AS (SELECT o.m, sum(CASE WHEN outer_x < bar THEN 1 WHEN outer_x = bar THEN 0.5 ELSE 0 END) + 0.5 AS rank, count(*) AS n FROM o JOIN w USING (m) GROUP BY 1)
  SELECT (SELECT count(*) FROM whole) AS trials, count(*) AS splits, round(avg(CASE WHEN rank / (n + 1) <= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS pbo FROM k""")
def backtest_overfitting(spark, sf_dir):
    return metrics.overfitting(_trials(spark, sf_dir), "trial", "t").select("trials", "splits", r6(F.col("pbo")).alias("pbo"))


# ---- outcomes: each line is a version of its day's price, known up to 60 days late; verdicts are the days with a returned line
_STEPS = ("1998-01-01 00:00:00", "1999-06-01 00:00:00")
_OUTCOMES = f"""prices AS (SELECT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS close, l_shipdate + to_days(CAST(l_partkey % 60 AS INTEGER)) AS available_at, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS source_version FROM lineitem),
  sessions AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT day FROM prices)), verdicts AS (SELECT DISTINCT 'r' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS run_id, l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS entry_day FROM lineitem WHERE l_returnflag = 'R'),
  pairs AS (SELECT v.*, h AS horizon, e.day AS end_day FROM verdicts v CROSS JOIN (SELECT unnest([5, 21, 63]) AS h) JOIN sessions s ON s.day = v.entry_day JOIN sessions e ON e.n = s.n + h),
  seen AS (SELECT d.as_of, p.* FROM prices p JOIN (SELECT unnest([TIMESTAMP '{_STEPS[0]}', TIMESTAMP '{_STEPS[1]}']) AS as_of) d ON p.available_at <= d.as_of QUALIFY row_number() OVER (PARTITION BY d.as_of, security_id, day ORDER BY available_at DESC, source_version DESC) = 1),
  made AS (SELECT a.as_of, p.run_id, p.security_id, p.horizon, p.end_day, b.close / a.close - 1 AS ret, a.close AS p0, b.close AS p1, greatest(a.available_at, b.available_at) AS resolved_at FROM pairs p JOIN seen a ON a.security_id = p.security_id AND a.day = p.entry_day JOIN seen b ON b.as_of = a.as_of AND b.security_id = p.security_id AND b.day = p.end_day),
  steps AS (SELECT 1 AS step, * FROM made WHERE as_of = TIMESTAMP '{_STEPS[0]}' UNION ALL SELECT 2, m.* FROM made m ANTI JOIN (SELECT * FROM made WHERE as_of = TIMESTAMP '{_STEPS[0]}') f ON f.run_id = m.run_id AND f.security_id = m.security_id AND f.horizon = m.horizon AND f.p0 = m.p0 AND f.p1 = m.p1 WHERE m.as_of = TIMESTAMP '{_STEPS[1]}')"""


def _matured(spark, sf_dir):
    from tidemark.sources.interim import written

    l = load(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    prices = l.select(
        F.col("l_suppkey").alias("security_id"), day.alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), (F.col("l_shipdate") + F.make_dt_interval(days=(F.col("l_partkey") % 60).cast("int"))).alias("available_at"),
        F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("source_version"),
    )
    # the calendar: a row a day
    sessions = l.select(day.alias("session_date")).distinct().withColumn("number", F.row_number().over(Window.orderBy("session_date")))
    verdicts = l.filter("l_returnflag = 'R'").select(F.concat(F.lit("r"), day.cast("string")).alias("run_id"), F.col("l_suppkey").alias("security_id"), day.alias("entry_day")).distinct()
    pairs = written(outcomes.horizon_ends(verdicts, sessions, [5, 21, 63]))
    one, two = (F.to_timestamp_ntz(F.lit(t)) for t in _STEPS)
    none = spark.createDataFrame([], outcomes.OUTCOME)
    first = written(outcomes.newly_resolved(none, pairs, prices, None, one))
    second = outcomes.newly_resolved(first, pairs, prices, one, two)
    return first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2)))


@query("outcomes_maturing", f"WITH {_OUTCOMES} SELECT step, run_id, security_id, horizon, CAST(end_day AS VARCHAR) AS end_day, round(ret, 8) AS ret, strftime(resolved_at, '%Y-%m-%d') AS resolved FROM steps")
def outcomes_maturing(spark, sf_dir):
    return _matured(spark, sf_dir).select("step", "run_id", "security_id", "horizon", F.col("end_day").cast("string").alias("end_day"), F.round("ret", 8).alias("ret"), F.date_format("resolved_at", "yyyy-MM-dd").alias("resolved"))


@query("agent_scores", f"""WITH {_OUTCOMES}, n AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY run_id, security_id, horizon ORDER BY resolved_at DESC, step DESC) = 1), a AS (SELECT unnest(['alpha', 'beta']) AS agent, unnest([31, 57]) AS k),
  f AS (SELECT a.agent, n.horizon, CAST(ret > 0 AS INTEGER) AS y, ((security_id * k + horizon) % 97 + 1) / 98.0 AS p FROM n, a) SELECT agent, horizon, count(*) AS n, round(avg(pow(p - y, 2)), 8) AS brier, round(avg(y), 8) AS base_rate, round(avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)), 8) AS hit_rate FROM f GROUP BY 1, 2""")
def agent_scores(spark, sf_dir):
    from tidemark.sources.interim import written

    made = written(_matured(spark, sf_dir).drop("step"))
    agents = F.explode(F.array(*(F.struct(F.lit(a).alias("agent"), F.lit(k).alias("k")) for a, k in (("alpha", 31), ("beta", 57)))))
    asked = made.select(*outcomes.KEY).distinct().withColumn("a", agents)
    forecasts = asked.select("a.agent", *outcomes.KEY, (((F.col("security_id") * F.col("a.k") + F.col("horizon")) % 97 + 1) / 98.0).alias("p"))
    out = outcomes.agent_scores(made, forecasts, F.col("ret") > 0, F.to_timestamp_ntz(F.lit(_STEPS[1])))
    return out.select("agent", "horizon", "n", *(F.round(c, 8).alias(c) for c in ("brier", "base_rate", "hit_rate")))
