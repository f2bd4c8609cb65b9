"""What each agent of a run is shown: one text for each (agent, security), made of that agent's sections only.

Every section is a plan of its own that gives (security_id, body); the bodies of a security, at most seven and
each a report of bounded length, meet in one row, from which the agents' texts are put together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.functions.numbers import finite
from tidemark.operators import fundamentals as fu
from tidemark.operators.asof import first_by
from tidemark.operators.xsection import LEAST_GROUP, group_zscore, midrank_percentile

# The sections of each agent, headers, market-wide features, sizes, and the feed of a cited row.
VIEWS = {
    "value": ("summary", "history"),
    "quality_catalyst": ("summary", "history", "news"),
    "insider": ("summary", "insiders"),
    "technical": ("technical",),
    "macro_narrative": ("regime", "market", "news"),
    "red_team": ("summary", "history", "insiders", "news", "technical", "regime"),
}
TITLES = {
    "summary": "fundamentals_summary", "history": "fundamentals_history", "news": "news", "insiders": "insider_trades",
    "technical": "price_features", "market": "price_features", "regime": "market_regime",
}
FEATURES = "evidence_id\tfeature\tvalue\tsector_z\tsector_pct"
RATIOS = ("gross_margin", "operating_margin", "net_margin", "cfo_margin", "revenue_growth_yoy", "share_change_yoy", "accruals_ratio")
HEADERS = {
    "summary": FEATURES, "technical": FEATURES, "market": FEATURES,
    "history": "\t".join(("evidence_id", "fiscal_period", "period_age", *RATIOS)),
    "news": "evidence_id\tage\theadline\tsummary",
    "insiders": "evidence_id\texec\trole\tdirection\tcode\ttxn_age\tfiled_age\tpct_of_holdings\tadv_intensity\tplan_10b5_1\ttag\tcluster\tsignal",
    "regime": "evidence_id\tfeature\tvalue",
}
REGIME = ("spy_return_1m", "spy_return_3m", "spy_sma_50d_distance", "spy_sma_200d_distance", "spy_realized_vol_20d", "vix_proxy_zscore", "yield_10y_pct", "yield_3m_pct")
SIZES = {"small": "Small-Cap", "mid": "Mid-Cap", "large": "Large-Cap"}
FEEDS = {"FIN": "fundamentals", "INS": "insider_trades", "NEWS": "news", "TECH": "features", "MACRO": "regime"}


def two_figures(value: Column) -> Column:
    return F.coalesce(text.sig2(finite(value)), F.lit("NA"))


def numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("security_id").orderBy(*order)))


def bodies(rows: DataFrame, section: str, line: Column) -> DataFrame:
    """security_id, section, body of rows with their place n."""
    return text.render_table(rows, ["security_id"], ["n"], line, HEADERS[section]).select("security_id", F.lit(section).alias("section"), "body")


def feature_lines(universe: DataFrame, names: Sequence[str]) -> DataFrame:
    """security_id, n, cells: each named ratio of universe (security_id, sector, values, included) with its standing.

    Scores and percentiles are those among the included members of the sector that have the value, of which
    there must be three.
    """
    listed = F.array(*(F.struct(F.lit(k + 1).alias("n"), F.lit(name).alias("name")) for k, name in enumerate(names)))
    long = universe.select("security_id", "sector", "included", "values", F.inline(listed))
    long = long.withColumn("value", finite(F.try_element_at("values", F.col("name")))).withColumn("ranked", F.when(F.col("included"), F.col("value")))
    group = ["sector", "name"]
    long = long.withColumn("z", group_zscore(F.col("ranked"), group)).withColumn("pct", midrank_percentile(F.col("ranked"), group, LEAST_GROUP))
    return long.select("security_id", "n", F.concat_ws("\t", "name", *(two_figures(F.col(c)) for c in ("value", "z", "pct"))).alias("cells"))


def feature_table(lines: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """A table for each section from the same lines, under the section's prefix."""
    packed = lines.groupBy("security_id").agg(F.array_sort(F.collect_list(F.struct("n", "cells"))).alias("_rows"))

    def body(section: str, prefix: str) -> Column:
        shown = F.transform("_rows", lambda r: F.concat(F.lit(prefix + "_"), r.n.cast("string"), F.lit("\t"), r.cells))
        return F.struct(F.lit(section).alias("section"), F.concat_ws("\n", F.lit(HEADERS[section]), F.array_join(shown, "\n")).alias("body"))

    return packed.select("security_id", F.inline(F.array(*(body(s, p) for s, p in prefixes.items()))))


def history_table(facts: DataFrame, as_of: Column) -> DataFrame:
    rows = numbered(fu.quarterly_history(facts, as_of), [F.desc("period_end")])
    age = dates.relative_days(F.to_timestamp("period_end"), as_of)
    return bodies(rows, "history", text.tsv_line(F.concat(F.lit("FIN_"), F.replace("label", F.lit("-"))), F.col("label"), age, *(two_figures(F.col(c)) for c in RATIOS)))


def insider_table(entities: DataFrame, txns: DataFrame, as_of: Column, days: int = 180, most: int = 25, cluster_days: int = 14) -> DataFrame:
    """The newest trades of the last days; tags and clusters are judged on all that is visible, once they are chosen."""
    visible = txns.filter(F.col("available_at") <= as_of)
    today = F.to_date(as_of)
    span = (F.date_sub(today, days), today)
    newest = [F.desc("available_at"), F.desc("accession"), F.desc("seq")]
    recent = first_by(visible.filter(F.datediff(today, "txn_date").between(0, days)), ["security_id"], newest, most)
    recent = fu.trade_tags(fu.buyer_clusters(recent, cluster_days, visible, span), history=visible, span=span)
    rows = numbered(recent.join(entities.select("security_id", "cik", "adv30_usd"), "security_id"), newest)
    buy, sell = (F.col("code") == "P") & F.col("acquired"), (F.col("code") == "S") & ~F.col("acquired")
    flag = lambda c: c.cast("int")
    line = text.tsv_line(
        F.concat(F.lit("INS_"), "n"), text.pseudonym(F.col("filer"), F.col("cik")), text.role_token(F.col("role"), F.col("officer_title")),
        F.when(buy, "buy").when(sell, "sell").otherwise(F.concat(F.lit("other_"), "code")), F.col("code"),
        dates.relative_days(F.to_timestamp("txn_date"), as_of), dates.relative_days(F.col("available_at"), as_of),
        two_figures(fu.position_change(F.col("shares"), F.col("acquired"), F.col("post_holdings"))), two_figures(fu.volume_intensity(F.col("shares"), F.col("price"), F.col("adv30_usd"))),
        flag(F.col("is_10b5_1")), F.col("tag"), F.when(buy, F.col("cluster")).otherwise(0), flag(buy & ~F.col("is_10b5_1") & (F.col("tag") == "OPPORTUNISTIC")),
    )
    return bodies(rows, "insiders", line)


def news_table(news: DataFrame, as_of: Column, mask: Callable[[Column], Column], opening: Callable[[Column, int], Column] | None = None, most: int = 400) -> DataFrame:
    """Headlines and summaries without names, amounts and dates; news has a row for each (security_id, item).

    opening gives as much of a summary's start as what is shown of it rests on; without it summaries are read to their ends.
    """
    # a revision that takes an item out of the last days counts, but its texts aren't shown
    news = news.withColumns({c: F.when(fu.in_news(as_of), F.col(c)) for c in ("headline", "summary")})
    if opening is not None:
        news = news.withColumn("summary", opening(F.col("summary"), most))
    rows = numbered(fu.visible_news(news, as_of, text.is_analyst_item(F.col("headline"))), [F.desc("event_time"), F.desc("item_id")])
    shown = lambda c, n=None: text.clean(text.scrub(mask(F.coalesce(F.col(c), F.lit("")))), n)
    return bodies(rows, "news", text.tsv_line(F.concat(F.lit("NEWS_"), "n"), dates.relative_days(F.col("event_time"), as_of), shown("headline"), shown("summary", most)))


def regime_body(regime: DataFrame) -> Column:
    """The market's table from regime (feature, value), a few rows; a feature that isn't among the known ones raises."""
    place = F.array_position(F.array(*map(F.lit, REGIME)), F.col("feature"))
    known = F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("no regime feature: "), "feature")).cast("bigint"))
    rows = regime.select(F.lit(0).alias("security_id"), known.alias("n"), "feature", two_figures(F.col("value")).alias("value"))
    body = bodies(rows, "regime", F.concat(F.lit("MACRO_R_"), F.col("n").cast("string"), F.lit("\t"), F.concat_ws("\t", "feature", "value")))
    return F.coalesce(body.select(F.max("body")).scalar(), F.lit(HEADERS["regime"]))


def agent_partitions(as_of: Column, entities: DataFrame, universe: DataFrame, facts: DataFrame, txns: DataFrame, news: DataFrame, regime: DataFrame, mask: Callable[[Column], Column], fundamental: Sequence[str], price: Sequence[str], opening: Callable[[Column, int], Column] | None = None) -> DataFrame:
    """agent, security_id, entity_token, as_of, text, input_hash, evidence of every entity.

    entities (security_id, entity_token, cik, sector, mcap_tier, adv30_usd) has one row for each security; one
    without a sector or a known size raises. A section without rows shows its header. evidence lists the rows
    that the agent may cite, as (feed, evidence_id).
    """
    own = entities.select("security_id")
    # an entity outside the universe has no features, and shows so
    ranked = universe.select("security_id", "sector", "values", "included").join(own, "security_id", "full_outer")
    low, high = (feature_lines(ranked, names).join(own, "security_id", "left_semi") for names in (fundamental, price))
    tables = [
        feature_table(low, {"summary": "FIN_SUM"}), feature_table(high, {"technical": "TECH", "market": "MACRO_P"}),
        history_table(facts, as_of), insider_table(entities, txns, as_of), news_table(news, as_of, mask, opening),
    ]
    long = tables[0]
    for table in tables[1:]:
        long = long.unionByName(table)
    packed = long.groupBy("security_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "body"))).alias("bodies"))
    rows = entities.join(packed, "security_id", "left").withColumn("regime", regime_body(regime))

    def section(name: str) -> Column:
        body = F.col("regime") if name == "regime" else F.coalesce(F.try_element_at("bodies", F.lit(name)), F.lit(HEADERS[name]))
        return F.concat(F.lit(f"## {TITLES[name]}\n"), body)

    def required(value: Column, what: str) -> Column:
        return F.coalesce(value, F.raise_error(F.lit(f"a security has no {what}")).cast("string"))

    size = F.try_element_at(F.create_map(*(F.lit(x) for pair in SIZES.items() for x in pair)), F.col("mcap_tier"))
    head = F.concat(F.lit("## entity\nentity\t"), "entity_token", F.lit("\nsector\t"), required(F.col("sector"), "sector"), F.lit("\nsize\t"), required(size, "known size"))
    texts = F.array(*(F.struct(F.lit(agent).alias("agent"), F.concat_ws("\n\n", F.col("head"), *map(section, names)).alias("text")) for agent, names in VIEWS.items()))
    out = rows.withColumn("head", head).select("security_id", "entity_token", F.inline(texts))
    feeds = F.create_map(*(F.lit(x) for pair in FEEDS.items() for x in pair))
    cited = F.transform(text.evidence_ids(F.col("text")), lambda e: F.struct(feeds[F.substring_index(e, "_", 1)].alias("feed"), e.alias("evidence_id")))
    return out.select("agent", "security_id", "entity_token", as_of.alias("as_of"), "text", F.sha2("text", 256).alias("input_hash"), cited.alias("evidence"))
