"""Portfolio sizing under position, sector, volatility and gross limits. Weights within one book (group)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import max_vetoes, sigmoid
from tidemark.operators.ranks import with_best, with_group


@dataclass(frozen=True)
class Limits:
    max_position: float = 0.08
    max_sector: float = 0.30
    min_position: float = 0.01
    vol_target: float = 0.10
    entry_threshold: float = 0.55
    k: float = 0.02
    dispersion_lambda: float = 0.5
    rank_top_m: int = 8
    edge_hurdle: float = 0.04
    committee_k: float = 0.5
    committee_dispersion_lambda: float = 0.0
    bear: dict[str, float] = field(default_factory=lambda: {"low": 1.0, "med": 0.75, "high": 0.5})


def bear_factor(severity: Column, limits: Limits) -> Column:
    """The severity's factor; unknown counts as low."""
    table = F.create_map(*(F.lit(x) for kv in limits.bear.items() for x in kv))
    return F.coalesce(F.try_element_at(table, severity), F.lit(limits.bear["low"]))


def cap_sectors(book: DataFrame, cap: float, group: Sequence[str], weight: str = "weight") -> DataFrame:
    """Sectors over the cap scaled down pro rata; what is trimmed becomes cash."""
    total = F.col("_total")
    known = with_group(book, [*group, "sector"], {"_total": F.sum(weight)})
    return known.withColumn(weight, F.when(total > 0, F.col(weight) * F.least(F.lit(1.0), F.lit(cap) / total)).otherwise(F.col(weight))).drop("_total")


def floor_weights(book: DataFrame, least: float, weight: str = "weight") -> DataFrame:
    return book.withColumn(weight, F.when(F.col(weight) >= least, F.col(weight)).otherwise(0.0))


def scale_to_target(book: DataFrame, target: float, group: Sequence[str], weight: str = "weight") -> DataFrame:
    """Weights scaled so that the diagonal volatility meets the target at most and the gross is at most 1."""
    squares = F.sum(F.pow(F.col(weight) * F.coalesce("sigma", F.lit(0.0)), F.lit(2.0)))
    known = with_group(book, group, {"_vol": F.sqrt(squares), "_gross": F.sum(weight)})
    vol, gross = F.col("_vol"), F.col("_gross")
    by_vol = F.when(vol > 0, F.least(F.lit(1.0), F.lit(target) / vol)).otherwise(1.0)
    scale = F.when(gross > 0, F.least(by_vol, 1 / gross)).otherwise(by_vol)
    return known.withColumn(weight, F.col(weight) * scale).drop("_vol", "_gross")


def size_book(decisions: DataFrame, limits: Limits = Limits(), group: Sequence[str] = ("run_id",)) -> DataFrame:
    """decisions (group, security_id, sector, pooled_p, dispersion, bear_severity, sigma) with weight.

    A name without a positive sigma gets 0. Order: position cap, floor, sector cap, volatility and gross, floor.
    """
    edge = F.col("pooled_p") - 0.5
    raw = limits.k * edge / F.col("sigma") * F.greatest(F.lit(0.0), 1 - limits.dispersion_lambda * F.col("dispersion")) * bear_factor(F.col("bear_severity"), limits)
    enters = (F.col("pooled_p") >= limits.entry_threshold) & (F.col("sigma") > 0) & (edge > 0)
    book = decisions.withColumn("weight", F.when(F.coalesce(enters, F.lit(False)), F.least(raw, F.lit(limits.max_position))).otherwise(0.0))
    book = cap_sectors(floor_weights(book, limits.min_position), limits.max_sector, group)
    return floor_weights(scale_to_target(book, limits.vol_target, group), limits.min_position)


def size_committee_book(pooled: DataFrame, limits: Limits = Limits(), group: Sequence[str] = ("run_id",), alpha: float = 0.0, beta: float = 1.0, base_rate: float | None = None) -> DataFrame:
    """pooled (group, security_id, sector, logit, dispersion, bear_severity, sigma) with weight and pooled_p.

    Without a base rate the calibration is inactive: the best rank_top_m by logit, by inverse volatility.
    With one: the edge over it against the hurdle. Then position cap, sector cap, floor, scale, floor.
    """
    usable = F.coalesce(F.col("sigma") > 0, F.lit(False))
    if base_rate is None:
        # names that can't be sized come after all others, and are not taken even so
        best = with_best(pooled, group, F.when(usable, F.col("logit")), "security_id", limits.rank_top_m, "_in")
        chosen = with_group(best.withColumn("_inverse", F.when(F.col("_in") & usable, 1.0 / F.col("sigma"))), group, {"_all": F.sum("_inverse")})
        raw = F.col("_inverse") / F.col("_all") * bear_factor(F.col("bear_severity"), limits)
        book = chosen.withColumn("weight", F.coalesce(raw, F.lit(0.0))).drop("_in", "_inverse", "_all")
    else:
        edge = sigmoid(alpha + beta * F.col("logit")) - base_rate
        raw = limits.committee_k * edge / F.col("sigma") * F.greatest(F.lit(0.0), 1 - limits.committee_dispersion_lambda * F.col("dispersion")) * bear_factor(F.col("bear_severity"), limits)
        book = pooled.withColumn("weight", F.when(usable & (edge >= limits.edge_hurdle), raw).otherwise(0.0))
    book = book.withColumn("weight", F.least(F.greatest("weight", F.lit(0.0)), F.lit(limits.max_position)))
    book = floor_weights(cap_sectors(book, limits.max_sector, group), limits.min_position)
    book = floor_weights(scale_to_target(book, limits.vol_target, group), limits.min_position)
    return book.withColumn("pooled_p", sigmoid(alpha + beta * F.col("logit")))


def with_target_weights(decisions: DataFrame, book: DataFrame, on: Sequence[str] = ("run_id", "security_id")) -> DataFrame:
    return decisions.join(book.select(*on, F.col("weight").alias("target_weight")), list(on), "left").fillna(0.0, ["target_weight"])


def veto_faults(book: DataFrame, decisions: DataFrame, budget: float, group: Sequence[str] = ("run_id",)) -> DataFrame:
    """Books whose decisions don't cover exactly their names, or veto more than the budget: missing, unknown, vetoes, limit."""
    both = book.select(*group, "entity", F.lit(1).alias("proposed")).join(decisions.select(*group, "entity", F.lit(1).alias("decided"), "action"), [*group, "entity"], "full_outer")
    counted = both.groupBy(*group).agg(
        F.count_if(F.col("decided").isNull()).alias("missing"), F.count_if(F.col("proposed").isNull()).alias("unknown"),
        F.count_if((F.col("action") == "veto") & F.col("proposed").isNotNull()).alias("vetoes"), F.count("proposed").alias("names"),
    )
    return counted.withColumn("limit", max_vetoes(F.col("names"), budget)).filter("missing > 0 or unknown > 0 or vetoes > limit")


def apply_vetoes(book: DataFrame, decisions: DataFrame, budget: float = 0.20, group: Sequence[str] = ("run_id",)) -> DataFrame:
    """The book without vetoed names, other weights unchanged; books with faults are left out (see veto_faults)."""
    vetoed = decisions.filter(F.col("action") == "veto").select(*group, "entity")
    sound = book.join(veto_faults(book, decisions, budget, group).select(*group), list(group), "left_anti")
    return sound.join(vetoed, [*group, "entity"], "left_anti")


def first_trigger(events: DataFrame, group: Sequence[str] = ("run_id",)) -> DataFrame:
    """The first trigger of each run stays."""
    return events.groupBy(*group).agg(F.min_by("trigger", "triggered_at").alias("trigger"), F.min("triggered_at").alias("triggered_at"))


def kill_trigger(loss: Column, limit: Column, any_stale: Column) -> Column:
    return F.when(loss > limit, "daily_loss").when(any_stale, "stale_feed")
