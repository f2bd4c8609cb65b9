"""Queries over point-in-time reads, joins, sets and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.operators.xsection import SIC_SECTORS
from tidemark.plans.bindings import AS_OF, BARS, FACTS, QUARTERS, SECTORS, at, bars, facts, load, quarters, query, r6, sectors
from tidemark.sources.writes import conflicts, new_rows

DATES = ("2024-01-05 00:00:00", "2024-01-10 00:00:00", "2024-01-15 12:00:00")


@query("asof_latest", f"""WITH {FACTS} SELECT security_id, day, event_id, round(value, 6) AS value FROM facts WHERE available_at <= TIMESTAMP '{AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY security_id, day ORDER BY available_at DESC, source_version DESC) = 1""")
def asof_latest(spark, sf_dir):
    return asof.latest_version(facts(spark, sf_dir), ["security_id", "day"], at(AS_OF)).select("security_id", "day", "event_id", r6(F.col("value")).alias("value"))


@query("asof_prices_lookback", f"""WITH {FACTS} SELECT security_id, day, event_id FROM facts WHERE available_at <= TIMESTAMP '{AS_OF}' AND security_id IN (SELECT s_suppkey FROM supplier)
  AND event_time > TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY AND event_time <= TIMESTAMP '{AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY security_id, day ORDER BY available_at DESC, source_version DESC) = 1""")
def asof_prices_lookback(spark, sf_dir):
    listed = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("security_id"))
    asked = facts(spark, sf_dir).join(listed, "security_id", "left_semi")
    return asof.latest_version(asked, ["security_id", "day"], at(AS_OF), asof.within("event_time", at(AS_OF), "3 days")).select("security_id", "day", "event_id")


@query("asof_two_dates", f"""WITH {FACTS}, d AS (SELECT unnest([{', '.join(f"TIMESTAMP '{d}'" for d in DATES)}]) AS as_of)
  SELECT strftime(as_of, '%Y-%m-%d %H:%M:%S') AS as_of, security_id, count(*) AS keys, sum(event_id) AS ids FROM (SELECT * FROM facts, d WHERE available_at <= as_of
  QUALIFY row_number() OVER (PARTITION BY as_of, security_id, day ORDER BY available_at DESC, source_version DESC) = 1) GROUP BY 1, 2""")
def asof_two_dates(spark, sf_dir):
    seen = asof.at_dates(facts(spark, sf_dir), [at(d) for d in DATES], ["security_id", "day"])
    return seen.groupBy(F.date_format("as_of", "yyyy-MM-dd HH:mm:ss").alias("as_of"), "security_id").agg(F.count(F.lit(1)).alias("keys"), F.sum("event_id").cast("decimal(38,0)").cast("long").alias("ids"))


@query("asof_nullable_key", f"""WITH {FACTS}, k AS (SELECT *, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS part FROM facts)
  SELECT security_id, part, event_id FROM k WHERE available_at <= TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY security_id, part ORDER BY available_at DESC, source_version DESC) = 1""")
def asof_nullable_key(spark, sf_dir):
    keyed = facts(spark, sf_dir).withColumn("part", F.when(F.col("event_type") != "view", F.col("event_type")))
    return asof.latest_version(keyed, ["security_id", "part"], at(AS_OF)).select("security_id", "part", "event_id")


@query("asof_available_lookback", f"""WITH {FACTS} SELECT security_id, event_id FROM facts WHERE available_at <= TIMESTAMP '{AS_OF}' AND available_at > TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY
  QUALIFY row_number() OVER (PARTITION BY security_id, event_id ORDER BY available_at DESC, source_version DESC) = 1""")
def asof_available_lookback(spark, sf_dir):
    return asof.latest_version(facts(spark, sf_dir), ["security_id", "event_id"], at(AS_OF), asof.after("available_at", at(AS_OF), "2 days")).select("security_id", "event_id")


@query("newest_vector", f"""WITH {FACTS} SELECT security_id, event_id, round(value, 6) AS value FROM facts WHERE available_at <= TIMESTAMP '{AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY event_time DESC, available_at DESC, source_version DESC) = 1""")
def newest_vector(spark, sf_dir):
    return asof.newest_vectors(facts(spark, sf_dir), at(AS_OF)).select("security_id", "event_id", r6(F.col("value")).alias("value"))


@query("universe_snapshot_latest", f"""WITH {FACTS}, m AS (SELECT *, day AS snapshot_date FROM facts WHERE available_at <= TIMESTAMP '{AS_OF}')
  SELECT snapshot_date, security_id, event_id FROM m WHERE snapshot_date = (SELECT max(snapshot_date) FROM m) QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY available_at DESC, source_version DESC) = 1""")
def universe_snapshot_latest(spark, sf_dir):
    members = facts(spark, sf_dir).withColumn("snapshot_date", F.col("day"))
    return asof.newest_snapshot(members, at(AS_OF)).select("snapshot_date", "security_id", "event_id")


_LISTED = "SELECT l_suppkey AS security_id, min(l_shipdate) AS listed_from, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE max(l_shipdate) END AS listed_to FROM lineitem GROUP BY l_suppkey"


@query("valid_on_date", f"""SELECT security_id, strftime(listed_from, '%Y-%m-%d') AS listed_from, strftime(listed_to, '%Y-%m-%d') AS listed_to FROM ({_LISTED})
  WHERE (listed_from IS NULL OR listed_from <= TIMESTAMP '1998-01-20') AND (listed_to IS NULL OR listed_to >= TIMESTAMP '1998-01-20')""")
def valid_on_date(spark, sf_dir):
    spans = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("security_id")).agg(F.min("l_shipdate").alias("listed_from"), F.max("l_shipdate").alias("_to"))
    spans = spans.withColumn("listed_to", F.when(F.col("security_id") % 4 != 0, F.col("_to")))
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return asof.valid_on(spans, at("1998-01-20 00:00:00")).select("security_id", text("listed_from"), text("listed_to"))


@query("pending_work", """SELECT o.o_orderkey, o.expected FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 6 END AS expected FROM orders) o
  WHERE o.expected IS NULL OR (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) < o.expected""")
def pending_work(spark, sf_dir):
    requests = load(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 6).alias("expected"))
    done = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return asof.unfinished(requests, done, ["o_orderkey"], "expected").select("o_orderkey", "expected")


@query("feed_staleness", """WITH sla AS (SELECT * FROM (VALUES ('view', 0.5), ('click', 2.0), ('error', 0.001), ('missing', 24.0)) AS s(feed, sla_hours)), h AS (SELECT event_type AS feed, max(ts) AS last_success FROM events GROUP BY 1),
  n AS (SELECT max(ts) + INTERVAL 1 HOUR AS now FROM events), j AS (SELECT s.feed, sla_hours, CASE WHEN last_success IS NULL THEN NULL ELSE greatest(epoch_us(now) - epoch_us(last_success), 0) / 1e6 / 3600 END AS age FROM sla s LEFT JOIN h ON s.feed = h.feed, n)
  SELECT feed, round(age, 6) AS age_hours, (age IS NULL OR age > sla_hours) AS stale FROM j""")
def feed_staleness(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    limits = spark.createDataFrame([("view", 0.5), ("click", 2.0), ("error", 0.001), ("missing", 24.0)], "feed string, sla_hours double")
    health = e.groupBy(F.col("event_type").alias("feed")).agg(F.max("ts").alias("last_success"))
    now = e.agg(F.max("ts") + F.expr("interval 1 hour")).scalar()
    return asof.staleness(health, limits, now).select("feed", r6(F.col("age_hours")).alias("age_hours"), "stale")


@query("array_overlap_news", """SELECT doc_id, source FROM (SELECT doc_id, source, [doc_id % 7, doc_id % 11, 100 + doc_id % 3] AS ids FROM documents) WHERE list_has_any(ids, [3, 5, 101])""")
def array_overlap_news(spark, sf_dir):
    i = F.col("doc_id")
    tagged = load(spark, sf_dir, "documents").select("doc_id", "source", F.array(i % 7, i % 11, 100 + i % 3).alias("ids"))
    return asof.overlapping(tagged, "ids", [3, 5, 101]).select("doc_id", "source")


@query("join_inner", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def join_inner(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    return o.filter("o_totalprice > 300000").join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_mktsegment")


@query("join_left_null_test", "SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def join_left_null_test(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), load(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").filter("o_orderkey is null").select("c_custkey")


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def join_semi(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), load(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("join_anti", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'A')")
def join_anti(spark, sf_dir):
    s, l = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "lineitem").filter("l_quantity > 49 and l_returnflag = 'A'")
    return s.join(l, s.s_suppkey == l.l_suppkey, "left_anti").select("s_suppkey")


@query("join_full_diff", """WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000)
  SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k""")
def join_full_diff(spark, sf_dir):
    a = load(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), F.lit(1).alias("a"))
    b = load(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("k"), F.lit(1).alias("b")).distinct()
    return a.join(b, "k", "full_outer").select("k", F.when(F.col("a").isNull(), "right").when(F.col("b").isNull(), "left").otherwise("both").alias("side"))


_ASKED = "SELECT l_suppkey AS security_id, l_orderkey AS ask, l_linenumber AS line, l_shipdate + INTERVAL 1 DAY * (l_orderkey % 5 - 2) AS asked_at FROM lineitem"


def _asked(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")
    shifted = F.col("l_shipdate") + F.make_dt_interval(days=(F.col("l_orderkey") % 5 - 2).cast("int"))
    return l.select(F.col("l_suppkey").alias("security_id"), F.col("l_orderkey").alias("ask"), F.col("l_linenumber").alias("line"), shifted.alias("asked_at"))


@query("asof_join_backward", f"""WITH {BARS}, q AS ({_ASKED}) SELECT q.security_id, ask, line, strftime(b.event_time, '%Y-%m-%d') AS bar_day, round(close, 9) AS close FROM q ASOF LEFT JOIN bars b ON q.security_id = b.security_id AND q.asked_at >= b.event_time""")
def asof_join_backward(spark, sf_dir):
    out = asof.asof_join(_asked(spark, sf_dir), bars(spark, sf_dir), ["security_id"], "asked_at", "event_time", ["close"])
    return out.select("security_id", "ask", "line", F.date_format("matched_event_time", "yyyy-MM-dd").alias("bar_day"), F.round("close", 9).alias("close"))


@query("asof_join_forward", f"""WITH {BARS}, q AS ({_ASKED}) SELECT q.security_id, ask, line, strftime(b.event_time, '%Y-%m-%d') AS bar_day, round(close, 9) AS close FROM q ASOF LEFT JOIN bars b ON q.security_id = b.security_id AND q.asked_at <= b.event_time""")
def asof_join_forward(spark, sf_dir):
    out = asof.asof_join(_asked(spark, sf_dir), bars(spark, sf_dir), ["security_id"], "asked_at", "event_time", ["close"], "forward")
    return out.select("security_id", "ask", "line", F.date_format("matched_event_time", "yyyy-MM-dd").alias("bar_day"), F.round("close", 9).alias("close"))


@query("nearest_within_tolerance", f"""WITH {BARS}, d AS (SELECT DISTINCT security_id, CAST(event_time AS DATE) AS day, close FROM bars), j AS (
  SELECT a.security_id, a.day, b.close AS near, row_number() OVER (PARTITION BY a.security_id, a.day ORDER BY abs(b.day - (a.day - 365)) NULLS LAST, b.day) AS k
  FROM d a LEFT JOIN d b ON a.security_id = b.security_id AND abs(b.day - (a.day - 365)) <= 10) SELECT security_id, CAST(day AS VARCHAR) AS day, round(near, 9) AS near FROM j WHERE k = 1""")
def nearest_within_tolerance(spark, sf_dir):
    days = bars(spark, sf_dir).select("security_id", F.to_date("event_time").alias("day"), "close")
    out = asof.nearest_within(days.select("security_id", "day"), days, ["security_id"], F.date_sub("day", 365), "day", 10, "close", "near")
    return out.select("security_id", F.col("day").cast("string").alias("day"), F.round("near", 9).alias("near"))


_RANGES = ", ".join(f"({k}, {lo}, {hi}, '{s}')" for k, (lo, hi, s) in enumerate(SIC_SECTORS))


@query("range_lookup_first_match", f"""WITH r AS (SELECT * FROM (VALUES {_RANGES}) AS r(k, lo, hi, sector)), p AS (SELECT p_partkey, CAST((p_partkey * 37) % 9000 AS INTEGER) AS sic FROM part)
  SELECT p_partkey, sic, (SELECT arg_min(sector, k) FROM r WHERE sic BETWEEN lo AND hi) AS sector FROM p""")
def range_lookup_first_match(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 37) % 9000).cast("int").alias("sic"))
    return p.withColumn("sector", asof.first_range(F.col("sic"), SIC_SECTORS))


@query("interval_containment", """WITH r(a, b) AS (VALUES (DATE '1996-01-01', DATE '1996-06-30'), (DATE '1997-03-01', DATE '1999-02-28')) SELECT o_orderkey, EXISTS (SELECT 1 FROM r WHERE CAST(o_orderdate AS DATE) BETWEEN a AND b) AS covered FROM orders""")
def interval_containment(spark, sf_dir):
    ranges = spark.createDataFrame([("1996-01-01", "1996-06-30"), ("1997-03-01", "1999-02-28")], "a string, b string").select(F.to_date("a").alias("range_start"), F.to_date("b").alias("range_end"))
    return asof.covered(load(spark, sf_dir, "orders"), F.to_date("o_orderdate"), ranges).select("o_orderkey", "covered")


@query("series_alias_fallback", """WITH f AS (SELECT user_id AS security_id, event_type, value, ts FROM events), a(event_type, k) AS (VALUES ('purchase', 0), ('signup', 1), ('click', 2)), g AS (SELECT f.*, k FROM f JOIN a ON f.event_type = a.event_type WHERE NOT (f.event_type = 'purchase' AND security_id % 2 = 0)),
  m AS (SELECT *, min(k) OVER (PARTITION BY security_id) AS best FROM g) SELECT security_id, event_type, count(*) AS n FROM m WHERE k = best GROUP BY 1, 2""")
def series_alias_fallback(spark, sf_dir):
    from tidemark.operators.fundamentals import to_series

    f = load(spark, sf_dir, "events").select(F.col("user_id").alias("security_id"), F.col("event_type").alias("concept"), "value").filter("not (concept = 'purchase' and security_id % 2 = 0)")
    return to_series(f, {"activity": ("purchase", "signup", "click")}).groupBy("security_id", F.col("concept").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("step_read", f"""WITH {FACTS}, {BARS}, {SECTORS}, f AS (SELECT security_id, count(*) AS items FROM (SELECT * FROM facts WHERE available_at <= TIMESTAMP '{AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY security_id, day ORDER BY available_at DESC, source_version DESC) = 1) GROUP BY 1),
  b AS (SELECT security_id, avg(close * volume) AS adv, count(*) AS n FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY event_time DESC) <= 30) GROUP BY 1)
  SELECT s.security_id, sector, coalesce(items, 0) AS items, CASE WHEN n >= 30 THEN round(adv, 6) END AS adv30 FROM sectors s JOIN b ON s.security_id = b.security_id LEFT JOIN f ON s.security_id = f.security_id""")
def step_read(spark, sf_dir):
    from tidemark.plans.features import step_inputs

    out = step_inputs(facts(spark, sf_dir), bars(spark, sf_dir), sectors(spark, sf_dir), at(AS_OF))
    return out.select("security_id", "sector", "items", F.round("adv30", 6).alias("adv30"))


@query("last_price_and_holdings", f"""WITH {BARS}, p AS (SELECT security_id, arg_max(close, event_time) AS price FROM bars WHERE event_time > TIMESTAMP '1998-06-30' - INTERVAL 10 DAY AND event_time <= TIMESTAMP '1998-06-30' GROUP BY 1),
  w AS (SELECT s_suppkey AS security_id FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) SELECT w.security_id, round(price, 9) AS price FROM w LEFT JOIN p ON w.security_id = p.security_id""")
def last_price_and_holdings(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("security_id"))
    wanted = s.filter("security_id % 2 = 0").unionByName(s.filter("security_id % 3 = 0")).distinct()
    recent = bars(spark, sf_dir).filter(asof.within("event_time", at("1998-06-30 00:00:00"), "10 days"))
    priced = recent.groupBy("security_id").agg(F.max_by("close", "event_time").alias("price"))
    return wanted.join(priced, "security_id", "left").select("security_id", F.round("price", 9).alias("price"))


@query("distinct_open_runs", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def distinct_open_runs(spark, sf_dir):
    return load(spark, sf_dir, "orders").filter(~F.col("o_orderstatus").isin("F", "O")).select("o_custkey").distinct()


@query("group_to_list", "SELECT n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY 1".replace("list_sort(list(n_name)) AS names", "array_to_string(list_sort(list(n_name)), ',') AS names"))
def group_to_list(spark, sf_dir):
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("top_k_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def top_k_global(spark, sf_dir):
    return load(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey", "o_totalprice")


@query("top_n_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def top_n_per_group(spark, sf_dir):
    return asof.first_by(load(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("set_operations", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
  SELECT 'intersect' AS op, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def set_operations(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    a, b = (o.filter(c).select(F.col("o_custkey").alias("k")).distinct() for c in ("o_orderpriority = '1-URGENT'", "o_orderstatus = 'F'"))
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("op"), "n")
    return count(a.intersect(b), "intersect").unionByName(count(a.subtract(b), "except")).unionByName(count(a.union(b).distinct(), "union"))


@query("prefix_match", r"SELECT s_suppkey, s_name FROM supplier WHERE s_name LIKE 'Supplier#00000001%'")
def prefix_match(spark, sf_dir):
    return load(spark, sf_dir, "supplier").filter(F.col("s_name").startswith("Supplier#00000001")).select("s_suppkey", "s_name")


@query("append_new_count", "SELECT count(*) AS added FROM (SELECT DISTINCT o_custkey FROM orders) n WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = n.o_custkey AND c.c_acctbal > 4000)")
def append_new_count(spark, sf_dir):
    existing = load(spark, sf_dir, "customer").filter("c_acctbal > 4000").select(F.col("c_custkey").alias("k"))
    return new_rows(existing, load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"]).agg(F.count(F.lit(1)).alias("added"))


@query("immutable_conflicts", "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment IS DISTINCT FROM (CASE WHEN c_custkey % 2 = 0 THEN 'BUILDING' ELSE c_mktsegment END)")
def immutable_conflicts(spark, sf_dir):
    stored = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit("then").alias("written_at"))
    again = stored.filter("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "BUILDING").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.lit("now").alias("written_at"))
    return conflicts(stored, again, ["c_custkey"]).select("c_custkey")


@query("merge_dimension", """WITH o AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey, upper(c_name) AS c_name FROM customer WHERE c_custkey % 3 = 0)
  SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def merge_dimension(spark, sf_dir):
    from tidemark.sources.writes import merged

    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return merged(c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 3 = 0").withColumn("c_name", F.upper("c_name")), ["c_custkey"])


@query("json_explode", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 90")
def json_explode(spark, sf_dir):
    parsed = load(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("name", "k"))
    return parsed.filter("name = 'k' and k > 90").select("event_id", "k")


@query("arrays_zip_rows", """WITH g AS (SELECT user_id, list(event_id ORDER BY event_id) AS a, list(event_type ORDER BY event_id) AS b FROM events GROUP BY 1) SELECT user_id, unnest(a) AS event_id, unnest(b) AS event_type FROM g""")
def arrays_zip_rows(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("r"))
    columns = e.select("user_id", F.col("r.event_id").alias("event_id"), F.col("r.event_type").alias("event_type"))
    return columns.select("user_id", F.inline(F.arrays_zip("event_id", "event_type")))


@query("yoy_positional", f"""WITH {QUARTERS} SELECT security_id, CAST(period_end AS VARCHAR) AS period_end, round(revenue / nullif(lag(revenue, 4) OVER w, 0) - 1, 6) AS yoy FROM quarters WINDOW w AS (PARTITION BY security_id ORDER BY period_end)""")
def yoy_positional(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("revenue", 4).over(Window.partitionBy("security_id").orderBy("period_end"))
    return quarters(spark, sf_dir).select("security_id", F.col("period_end").cast("string").alias("period_end"), r6(F.try_divide("revenue", before) - 1).alias("yoy"))


@query("yoy_calendar", f"""WITH {QUARTERS}, j AS (SELECT a.security_id, a.period_end, a.revenue, b.revenue AS before, row_number() OVER (PARTITION BY a.security_id, a.period_end ORDER BY abs(b.period_end - (a.period_end - 365)) NULLS LAST, b.period_end) AS k
  FROM quarters a LEFT JOIN quarters b ON a.security_id = b.security_id AND abs(b.period_end - (a.period_end - 365)) <= 10) SELECT security_id, CAST(period_end AS VARCHAR) AS period_end, round(revenue / nullif(before, 0) - 1, 6) AS yoy FROM j WHERE k = 1""")
def yoy_calendar(spark, sf_dir):
    q = quarters(spark, sf_dir)
    other = q.select("security_id", F.col("period_end").alias("_e"), F.col("revenue").alias("_r"))
    joined = asof.nearest_within(q, other, ["security_id"], F.date_sub("period_end", 365), "_e", 10, "_r", "before")
    return joined.select("security_id", F.col("period_end").cast("string").alias("period_end"), r6(F.try_divide("revenue", "before") - 1).alias("yoy"))
