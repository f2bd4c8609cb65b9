"""Landed provider payloads (JSON and XML texts, one for each row) as versioned facts.

Sources read files that a collector landed; each parser is a plan over a column with the payload's text and
the columns that its location gives (security_id, received_at, ...). Malformed payloads give no rows here
and are found by `rejected`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import end_of_day, exchange_date, parse_acceptance, parse_compact_exchange, parse_utc, session_close
from tidemark.functions.numbers import finite
from tidemark.functions.text import PLAN_10B5_1, text_digest
from tidemark.operators.asof import first_by

BARS = "struct<bars:array<struct<t:string,o:double,h:double,l:double,c:double,v:double>>,next_page_token:string>"
TRADES = "struct<symbol:string,trades:array<struct<t:string,p:double,s:double,c:array<string>,i:string,z:string>>,next_page_token:string>"
FACTS = "struct<facts:map<string,map<string,struct<units:map<string,array<struct<start:string,end:string,val:double,accn:string,fp:string,form:string,filed:string>>>>>>>"
SUBMISSIONS = (
    "struct<cik:string,name:string,sic:string,sicDescription:string,filings:struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,"
    "acceptanceDateTime:array<string>,primaryDocument:array<string>>,files:array<struct<name:string,filingTo:string>>>>"
)
FILING_COLUMNS = "struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,acceptanceDateTime:array<string>,primaryDocument:array<string>>"
TICKERS = "struct<fields:array<string>,data:array<array<string>>>"
NEWS_A = "struct<news:array<struct<id:string,headline:string,created_at:string,updated_at:string,summary:string,content:string,url:string,symbols:array<string>,source:string>>>"
NEWS_B = "struct<feed:array<struct<title:string,summary:string,url:string,time_published:string,source:string,ticker_sentiment:array<struct<ticker:string>>>>>"
VINTAGES = "struct<observations:array<struct<realtime_start:string,date:string,value:string>>>"
FORM4 = (
    "struct<reportingOwner:array<struct<reportingOwnerId:struct<rptOwnerName:string>,reportingOwnerRelationship:struct<isOfficer:string,isDirector:string,isTenPercentOwner:string,officerTitle:string>>>,"
    "aff10b5One:string,footnotes:struct<footnote:array<struct<_id:string,_VALUE:string>>>,"
    "nonDerivativeTable:struct<nonDerivativeTransaction:array<struct<transactionDate:struct<value:string,footnoteId:array<struct<_id:string>>>,"
    "transactionCoding:struct<transactionCode:string,footnoteId:array<struct<_id:string>>>,"
    "transactionAmounts:struct<transactionShares:struct<value:double,footnoteId:array<struct<_id:string>>>,transactionPricePerShare:struct<value:double,footnoteId:array<struct<_id:string>>>,transactionAcquiredDisposedCode:struct<value:string>>,"
    "postTransactionAmounts:struct<sharesOwnedFollowingTransaction:struct<value:double,footnoteId:array<struct<_id:string>>>>>>>>"
)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as path and payload."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def rejected(payloads: DataFrame, schema: str, column: str = "payload") -> DataFrame:
    """Payloads that aren't JSON of the schema."""
    return payloads.filter(F.from_json(column, schema).isNull())


def bars(payloads: DataFrame, feed: str) -> DataFrame:
    """Daily bars of (security_id, received_at, payload). Consolidated bars are known 15 minutes after the close,
    live ones at receipt."""
    rows = payloads.select("security_id", "received_at", F.explode(F.from_json("payload", BARS)["bars"]).alias("b"))
    start = parse_utc(F.col("b.t"))
    available = session_close(exchange_date(start)) + F.expr("interval 15 minutes") if feed == "sip" else F.col("received_at")
    return rows.select(
        "security_id", start.alias("event_time"), available.alias("available_at"), F.lit(feed).alias("source_version"),
        F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"), F.lit(feed).alias("feed"),
    )


def bar_history(payloads: DataFrame, now: Column) -> DataFrame:
    """Consolidated bars that are knowable at now."""
    return bars(payloads, "sip").filter(F.col("available_at") <= now)


def trades(payloads: DataFrame) -> DataFrame:
    """Ticks, with times cut to microseconds. All pages of a symbol must have landed: see incomplete_pages."""
    rows = payloads.select(F.from_json("payload", TRADES).alias("j")).select("j.symbol", F.explode("j.trades").alias("t"))
    return rows.select("symbol", parse_utc(F.col("t.t")).alias("time"), F.col("t.p").alias("price"), F.coalesce("t.s", F.lit(0.0)).alias("size"), F.col("t.z").alias("tape"), F.coalesce("t.c", F.array().cast("array<string>")).alias("conditions"), F.col("t.i").alias("trade_id"))


def incomplete_pages(payloads: DataFrame, schema: str = TRADES) -> DataFrame:
    """Requests (request_id, page) whose last page still names a next one, or whose tokens repeat."""
    pages = payloads.select("request_id", "page", F.from_json("payload", schema)["next_page_token"].alias("token"))
    return pages.groupBy("request_id").agg(F.max_by("token", "page").alias("next"), F.count("token").alias("named"), F.count_distinct("token").alias("distinct")).filter("next is not null or named <> distinct")


def company_facts(payloads: DataFrame, acceptance: DataFrame, concepts: Sequence[str] | None = None, taxonomies: Sequence[str] = ("us-gaap", "dei")) -> DataFrame:
    """Long facts of (security_id, payload): known at the filing's acceptance, else at the end of the filed day."""
    level = payloads.select("security_id", F.explode(F.from_json("payload", FACTS)["facts"]).alias("taxonomy", "names")).filter(F.col("taxonomy").isin(*taxonomies))
    level = level.select("security_id", "taxonomy", F.explode("names").alias("name", "body")).withColumn("concept", F.concat_ws(":", "taxonomy", "name"))
    if concepts is not None:
        level = level.filter(F.col("concept").isin(*concepts))
    level = level.select("security_id", "concept", F.explode("body.units").alias("unit", "entries")).select("security_id", "concept", "unit", F.posexplode("entries").alias("place", "e"))
    rows = level.filter(finite(F.col("e.val")).isNotNull() & F.col("e.end").isNotNull()).join(acceptance.select(F.col("accession").alias("_a"), "accepted_at"), F.col("e.accn") == F.col("_a"), "left")
    out = rows.select(
        "security_id", "concept", F.substring("unit", 1, 32).alias("unit"), F.to_date("e.start").alias("period_start"), F.to_date("e.end").alias("period_end"),
        F.col("e.fp").alias("fiscal_period"), F.col("e.form").alias("form"), F.col("e.val").alias("value"), F.to_timestamp(F.to_date("e.end")).alias("event_time"),
        F.coalesce("accepted_at", end_of_day(F.to_date("e.filed"))).alias("available_at"), F.col("e.accn").alias("source_version"), "place",
    )
    # a fact can repeat within a filing: the first one counts
    return first_by(out, ["security_id", "concept", "unit", "period_start", "period_end", "source_version"], [F.asc("place")]).drop("place")


def _zipped(block: Column) -> Column:
    names = ("accessionNumber", "form", "filingDate", "acceptanceDateTime", "primaryDocument")
    return F.arrays_zip(*(block[n].alias(n) for n in names))


def _filing(row: str) -> list[Column]:
    return [
        F.col(f"{row}.accessionNumber").alias("accession"), F.col(f"{row}.form").alias("form"), F.to_date(F.col(f"{row}.filingDate")).alias("filing_date"),
        parse_acceptance(F.col(f"{row}.acceptanceDateTime")).alias("accepted_at"), F.col(f"{row}.primaryDocument").alias("primary_document"),
    ]


def _same_length(block: Column) -> Column:
    sizes = [F.size(block[n]) for n in ("form", "filingDate", "acceptanceDateTime", "primaryDocument")]
    out = F.lit(True)
    for s in sizes:
        out = out & (s == F.size(block["accessionNumber"]))
    return out


def filings(payloads: DataFrame, older: DataFrame | None = None) -> DataFrame:
    """cik and filings of submission indexes (payload) and of older pages (cik, payload). Columns of unequal length raise."""
    parsed = payloads.select(F.from_json("payload", SUBMISSIONS).alias("j"))
    recent = parsed.select(F.col("j.cik").cast("long").alias("cik"), F.col("j.filings.recent").alias("b"))
    if older is not None:
        recent = recent.unionByName(older.select(F.col("cik").cast("long"), F.from_json("payload", FILING_COLUMNS).alias("b")))
    checked = recent.withColumn("b", F.when(_same_length(F.col("b")), F.col("b")).otherwise(F.raise_error(F.lit("filing columns differ in length")).cast(FILING_COLUMNS)))
    return checked.select("cik", F.explode(_zipped(F.col("b"))).alias("f")).select("cik", *_filing("f"))


def older_pages(payloads: DataFrame, since: Column) -> DataFrame:
    """Names of older pages that reach back to since."""
    return payloads.select(F.explode(F.from_json("payload", SUBMISSIONS)["filings"]["files"]).alias("f")).filter(F.to_date("f.filingTo") >= since).select("f.name")


def companies(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.from_json("payload", SUBMISSIONS).alias("j")).select(F.col("j.cik").cast("long").alias("cik"), "j.name", F.expr("try_cast(j.sic as int)").alias("sic"), F.expr("nullif(j.sicDescription, '')").alias("sic_description"))


def insider_filings(filed: DataFrame, start: Column, end: Column) -> DataFrame:
    return filed.filter(F.col("form").isin("4", "4/A") & F.col("accepted_at").between(start, end))


def form4(documents: DataFrame) -> DataFrame:
    """Lines of (security_id, accession, accepted_at, payload): one for each non-derivative transaction."""
    yes = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("1", "true")
    parsed = documents.withColumn("x", F.from_xml("payload", FORM4))
    owner = F.try_element_at(F.col("x.reportingOwner"), F.lit(1))["reportingOwnerRelationship"]
    names = F.filter(F.col("x.reportingOwner.reportingOwnerId.rptOwnerName"), lambda n: n.isNotNull())
    plans = F.transform(F.filter(F.coalesce("x.footnotes.footnote", F.array().cast("array<struct<_id:string,_VALUE:string>>")), lambda f: f["_VALUE"].rlike(PLAN_10B5_1)), lambda f: f["_id"])
    role = F.when(yes(owner["isOfficer"]), "officer").when(yes(owner["isDirector"]), "director").when(yes(owner["isTenPercentOwner"]), "ten_percent_owner").otherwise("other")
    rows = parsed.select(
        "security_id", "accession", "accepted_at", F.substring(F.coalesce(F.when(F.size(names) > 0, F.array_join(names, "; ")), F.lit("unknown")), 1, 256).alias("filer"),
        role.alias("role"), owner["officerTitle"].alias("officer_title"), yes(F.col("x.aff10b5One")).alias("plan_box"), plans.alias("plans"),
        F.posexplode("x.nonDerivativeTable.nonDerivativeTransaction").alias("seq", "t"),
    )
    notes = [F.transform(F.coalesce(F.col(f"t.{p}.footnoteId"), F.array().cast("array<struct<_id:string>>")), lambda f: f["_id"]) for p in ("transactionDate", "transactionCoding", "transactionAmounts.transactionShares", "transactionAmounts.transactionPricePerShare", "postTransactionAmounts.sharesOwnedFollowingTransaction")]
    day = F.to_date(F.substring("t.transactionDate.value", 1, 10))
    kept = rows.filter(F.col("t.transactionCoding.transactionCode").isNotNull() & F.col("t.transactionDate.value").isNotNull() & F.col("t.transactionAmounts.transactionShares.value").isNotNull())
    return kept.select(
        "security_id", "accession", "seq", "filer", "role", "officer_title", day.alias("txn_date"), F.col("t.transactionCoding.transactionCode").alias("code"),
        (F.coalesce("t.transactionAmounts.transactionAcquiredDisposedCode.value", F.lit("")) == "A").alias("acquired"), F.col("t.transactionAmounts.transactionShares.value").alias("shares"),
        F.col("t.transactionAmounts.transactionPricePerShare.value").alias("price"), F.col("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value").alias("post_holdings"),
        (F.col("plan_box") | F.arrays_overlap(F.concat(*notes), "plans")).alias("is_10b5_1"), F.to_timestamp(day).alias("event_time"), F.col("accepted_at").alias("available_at"), F.col("accession").alias("source_version"),
    )


def tickers(payloads: DataFrame) -> DataFrame:
    """cik, name, ticker, exchange of a header and a matrix, whatever the header's order."""
    rows = payloads.select(F.from_json("payload", TICKERS).alias("j")).select("j.fields", F.explode("j.data").alias("r"))
    at = lambda n: F.try_element_at("r", F.array_position("fields", n).cast("int"))
    return rows.select(at("cik").cast("long").alias("cik"), at("name").alias("name"), F.replace(F.upper(at("ticker")), F.lit("-"), F.lit(".")).alias("ticker"), at("exchange").alias("exchange"))


def _news(rows: DataFrame, symbols: Column, securities: DataFrame, key: list[str]) -> DataFrame:
    """rows with the sorted ids of the known symbols; rows without any go."""
    each = rows.withColumn("_symbol", F.explode(symbols)).withColumn("_symbol", F.upper("_symbol"))
    known = each.join(F.broadcast(securities.select(F.upper("ticker").alias("_symbol"), "security_id")), "_symbol")
    return known.groupBy(*key).agg(F.array_sort(F.collect_set("security_id")).alias("security_ids"), F.first(F.struct(*rows.columns)).alias("r"))


def news_a(payloads: DataFrame, securities: DataFrame) -> DataFrame:
    """Items of (received_at, payload); a revision is known from its update on, and at receipt when polled live."""
    rows = payloads.select("received_at", F.explode(F.from_json("payload", NEWS_A)["news"]).alias("n")).filter(F.coalesce(F.col("n.headline") != "", F.lit(False)))
    rows = rows.select("received_at", "n.*").withColumn("created", parse_utc(F.col("created_at"))).withColumn("updated", F.coalesce(parse_utc(F.col("updated_at")), F.col("created")))
    rows = rows.withColumn("stamp", F.greatest("created", "updated")).withColumn("body_hash", text_digest(F.col("headline"), F.col("summary"), F.col("content")))
    found = _news(rows, F.col("symbols"), securities, ["id", "body_hash", "stamp"]).select("security_ids", "r.*")
    return _items(found, F.concat(F.lit("alpaca:"), "id"), "headline", "created", "stamp", "alpaca")


def news_b(payloads: DataFrame, securities: DataFrame) -> DataFrame:
    """Items of (received_at, payload); stamps without a zone are exchange time."""
    rows = payloads.select("received_at", F.explode(F.from_json("payload", NEWS_B)["feed"]).alias("n")).filter(F.coalesce(F.col("n.title") != "", F.lit(False)))
    rows = rows.select("received_at", "n.*").withColumn("created", parse_compact_exchange(F.col("time_published"))).withColumn("stamp", F.col("created")).withColumn("body_hash", text_digest(F.col("title"), F.col("summary")))
    found = _news(rows, F.col("ticker_sentiment.ticker"), securities, ["url", "body_hash", "stamp"]).select("security_ids", "r.*")
    return _items(found, F.concat(F.lit("av:"), F.substring(F.sha2("url", 256), 1, 24)), "title", "created", "stamp", "alphavantage")


def _items(rows: DataFrame, item_id: Column, headline: str, created: str, stamp: str, source: str) -> DataFrame:
    some = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    return rows.select(
        item_id.alias("item_id"), "security_ids", F.col(created).alias("published_at"), some(headline, 1000).alias("headline"), some("summary", 20000).alias("summary"), "body_hash",
        F.lit(source).alias("source"), some("source", 256).alias("publisher"), some("url", 2048).alias("url"), F.col(created).alias("event_time"),
        F.greatest(F.col(stamp), F.col("received_at")).alias("available_at"), F.concat(F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'"), F.lit(":"), F.substring("body_hash", 1, 12)).alias("source_version"),
    )


def rate_vintages(payloads: DataFrame) -> DataFrame:
    """Observations of (series, payload) in all vintages; a point stands for no value."""
    rows = payloads.select("series", F.explode(F.from_json("payload", VINTAGES)["observations"]).alias("o")).filter(F.col("o.value") != ".")
    return rows.select("series", F.to_date("o.date").alias("observation_date"), F.col("o.value").cast("double").alias("yield_pct"), F.to_date("o.realtime_start").alias("vintage_date"), F.concat(F.lit("alfred:"), F.to_date("o.realtime_start").cast("string")).alias("source_version"))


def vintage_coverage(vintages: DataFrame, now: Column) -> DataFrame:
    """What the fetched list of vintage dates (series, vintage_date) establishes."""
    lines = F.array_join(F.array_sort(F.collect_set(F.col("vintage_date").cast("string"))), "\n")
    out = vintages.groupBy("series").agg(F.min("vintage_date").alias("earliest_vintage"), F.max("vintage_date").alias("latest_vintage"), F.count_distinct("vintage_date").alias("vintage_count"), F.sha2(lines, 256).alias("vintage_dates_sha256"))
    return out.withColumn("established_at", now).withColumn("source_version", F.concat(F.lit("alfred_vintages:"), F.substring("vintage_dates_sha256", 1, 16)))


def trading_sessions(days: DataFrame, fetched_at: Column, source: str = "alpaca_calendar") -> DataFrame:
    """Broker sessions (session_date, open_at, close_at) as versioned rows; a changed session is a new version."""
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    raw = F.concat_ws("|", F.col("session_date").cast("string"), iso("open_at"), iso("close_at"))
    return days.select(F.col("open_at").alias("event_time"), fetched_at.alias("available_at"), F.concat(F.lit(f"{source}:"), F.substring(F.sha2(raw, 256), 1, 8)).alias("source_version"), "session_date", "open_at", "close_at")


def calendar_coverage(sessions: DataFrame, start: str, end: str, fetched_at: Column, source: str = "alpaca_calendar") -> DataFrame:
    from tidemark.operators.calendars import calendar_digest

    out = calendar_digest(sessions).withColumn("source", F.lit(source)).withColumn("range_start", F.to_date(F.lit(start))).withColumn("range_end", F.to_date(F.lit(end)))
    return out.withColumn("available_at", fetched_at).withColumn("source_version", F.concat(F.lit("calendar_coverage:"), F.substring("sessions_sha256", 1, 16)))


def stamp_audit(items: DataFrame, now: Column) -> DataFrame:
    """item_id, issue: stamps in the future, known before published, revised late, several texts of one item."""
    late = F.col("published_at") + F.expr("interval 30 days")
    issue = F.array_compact(F.array(
        F.when(F.col("published_at") > now, "future"), F.when(F.col("available_at") < F.col("published_at"), "available_before_publication"), F.when(F.col("available_at") > late, "late_revision"),
    ))
    rows = items.select("item_id", F.explode(issue).alias("issue"))
    several = items.groupBy("item_id").agg(F.count_distinct("body_hash").alias("n")).filter("n > 1").select("item_id", F.lit("several_texts").alias("issue"))
    return rows.unionByName(several)


def condition_map(spark: SparkSession, entries: Sequence[dict]) -> DataFrame:
    """A configured provider map (tape, code, spec_code, expected_name, validated) as a table."""
    return spark.createDataFrame([(e["tape"], str(e["provider_code"]), str(e["spec_code"]), str(e["expected_provider_name"]), bool(e["validated"])) for e in entries], "tape string, code string, spec_code string, expected_name string, validated boolean")
