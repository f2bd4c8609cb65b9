"""Pooling of probability forecasts, skill weights, calibration and error correlation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clipped_logit, safe_div
from tidemark.operators.fits import damped_newton
from tidemark.operators.xsection import imputed_zscores

HORIZONS = (5, 21, 63)
LOGIT_CLIP = (0.02, 0.98)
WEIGHT_FLOOR = 0.02
SHRINK_FROM, SHRINK_TAU = 30, 26.0

# The quant composite's parts and the ones for which low is good. Fixed values.
VALUE = ("ev_sales_sector_percentile", "ev_ebit_sector_percentile", "fcf_yield_sector_percentile")
QUALITY = (
    "gross_margin_trend_sector_percentile", "revenue_growth_yoy_sector_percentile", "revenue_growth_3y_cagr_sector_percentile",
    "net_debt_ebitda_sector_percentile", "share_count_change_sector_percentile", "accruals_ratio_sector_percentile",
)
LOW_IS_GOOD = ("ev_sales_sector_percentile", "ev_ebit_sector_percentile", "net_debt_ebitda_sector_percentile", "share_count_change_sector_percentile", "accruals_ratio_sector_percentile")


def mean_of(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total / len(columns)


def quant_composite(rows: DataFrame, group: Sequence[str], value: Sequence[str] = VALUE, momentum: str = "momentum_12_1", quality: Sequence[str] = QUALITY, low_is_good: Sequence[str] = LOW_IS_GOOD) -> DataFrame:
    """rows with composite and pooled_p: the mean of value, momentum and quality scores."""
    names = (*value, momentum, *quality)
    apart = rows.withColumns({f"_z_{n}": F.col(n) for n in names})
    scored = imputed_zscores(apart, [f"_z_{n}" for n in names], group, [f"_z_{n}" for n in low_is_good])
    z = lambda n: F.col(f"_z_{n}")
    composite = mean_of([mean_of([z(n) for n in value]), z(momentum), mean_of([z(n) for n in quality])])
    clamped = F.least(F.greatest(F.col("composite"), F.lit(-20.0)), F.lit(20.0))
    return scored.withColumn("composite", composite).withColumn("pooled_p", 1 / (1 + F.exp(-clamped))).drop(*(f"_z_{n}" for n in names))


def shrinkage(periods: Column, start: int = SHRINK_FROM, tau: float = SHRINK_TAU) -> Column:
    """How far weights move from equal to skill: 0 up to start independent periods of the weakest agent."""
    return F.when(periods > start, 1 - F.exp(-(periods - start) / tau)).otherwise(0.0)


def brier_skill(history: DataFrame, base_rate: Column, keys: Sequence[str] = ("horizon", "agent")) -> DataFrame:
    """keys, skill: max(0, 1 - Brier / the base rate's Brier). Overlap weights cancel and are left out."""
    own = F.avg(F.pow(F.col("forecast") - F.col("outcome"), F.lit(2.0)))
    base = F.avg(F.pow(base_rate - F.col("outcome"), F.lit(2.0)))
    return history.groupBy(*keys).agg(own.alias("brier"), base.alias("base_brier")).withColumn("skill", F.greatest(F.lit(0.0), F.when(F.col("base_brier") > 0, 1 - F.col("brier") / F.col("base_brier")).otherwise(0.0)))


def floored(weights: Column, floor: float, most: int = 6) -> Column:
    """An array of weights of few agents, none below floor, of sum 1.

    Those below are pinned to the floor and the others scaled to what is left, as often as there can be new
    ones. Weights that can't be scaled are equal.
    """
    n = F.size(weights)
    shares = lambda pinned: _scaled(weights, pinned, 1.0 - floor * F.size(F.filter(pinned, lambda p: p)), _free(weights, pinned), floor)
    start = F.transform(weights, lambda w: w < floor)
    # a fold over the rounds, so that the expression grows with neither rounds nor agents
    rounds = F.sequence(F.lit(1), F.lit(most))
    pinned = F.aggregate(rounds, start, lambda p, _: F.zip_with(p, shares(p), lambda q, s: q | F.coalesce(s < floor, F.lit(False))))
    return F.when(_free(weights, pinned) > 0, shares(pinned)).otherwise(F.transform(weights, lambda w: 1.0 / n))


def _free(weights: Column, pinned: Column) -> Column:
    return F.aggregate(F.zip_with(weights, pinned, lambda w, p: F.when(p, 0.0).otherwise(w)), F.lit(0.0), lambda a, x: a + x)


def _scaled(weights: Column, pinned: Column, left: Column, free: Column, floor: float) -> Column:
    return F.zip_with(weights, pinned, lambda w, p: F.when(p, F.lit(floor)).otherwise(F.try_divide(w * left, free)))


def pool(verdicts: DataFrame, skills: DataFrame | None = None, clip: tuple[float, float] = LOGIT_CLIP, floor: float = WEIGHT_FLOOR) -> DataFrame:
    """entity, horizon, logit, lambda_t, dispersion, weights: one row for each entity and horizon.

    verdicts (entity, agent, p_5, p_21, p_63, valid, sufficient) has at most one row for each agent; agents
    that are invalid or insufficient don't vote. skills (horizon, agent, skill, periods) moves the weights.
    """
    voters = verdicts.filter("valid and sufficient")
    stacked = ", ".join(f"{h}, p_{h}" for h in HORIZONS)
    long = voters.select("entity", "agent", F.expr(f"stack({len(HORIZONS)}, {stacked}) as (horizon, p)")).withColumn("z", clipped_logit(F.col("p"), *clip))
    w = Window.partitionBy("entity", "horizon")
    if skills is None:
        long = long.withColumn("skill", F.lit(0.0)).withColumn("_lambda", F.lit(0.0))
    else:
        # some agent without a history keeps the weights equal
        long = long.join(F.broadcast(skills.select("horizon", "agent", "skill", "periods")), ["horizon", "agent"], "left")
        known = F.min(F.coalesce("periods", F.lit(0))).over(w)
        long = long.withColumn("_lambda", shrinkage(known))
    total, n = F.sum(F.coalesce("skill", F.lit(0.0))).over(w), F.count(F.lit(1)).over(w)
    share = F.when(total > 0, F.coalesce("skill", F.lit(0.0)) / total).otherwise(1.0 / n)
    raw = (1 - F.col("_lambda")) / n + F.col("_lambda") * share
    packed = long.withColumn("raw", raw).groupBy("entity", "horizon").agg(
        F.array_sort(F.collect_list(F.struct("agent", "z", "raw"))).alias("a"), F.max("_lambda").alias("lambda_t"), F.coalesce(F.stddev_pop("z"), F.lit(0.0)).alias("dispersion")
    )
    packed = packed.withColumn("w", floored(F.col("a.raw"), floor))
    logit = F.aggregate(F.zip_with("w", "a", lambda x, a: x * a.z), F.lit(0.0), lambda t, x: t + x)
    return packed.select("entity", "horizon", logit.alias("logit"), "lambda_t", "dispersion", F.map_from_arrays("a.agent", "w").alias("weights"))


def duplicate_verdicts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("entity", "agent").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


FIT = "horizon int, alpha double, beta double, active boolean, observations long, base_rate double"


def fit_stacker(observations: DataFrame, pull_alpha: float = 1.0, pull_beta: float = 10.0, activation: int = 8, clip: tuple[float, float] = LOGIT_CLIP) -> DataFrame:
    """p = sigmoid(alpha + beta * logit) of each horizon from (horizon, logit, outcome, weight, periods).

    Ridge-logistic with alpha drawn to the base rate's logit and beta to 1; passes forecasts through (0, 1)
    before activation independent periods. All horizons, which are few, are fitted together by rounds of sums.
    """
    spark = observations.sparkSession
    sums = observations.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("outcome")).alias("wy"), F.min("periods").alias("periods")).orderBy("horizon").collect()
    if not sums:
        return spark.createDataFrame([], FIT)
    active = np.array([s.periods >= activation and s.w > 0 for s in sums])
    base = np.array([min(max(s.wy / s.w, clip[0]), clip[1]) if a else 0.5 for s, a in zip(sums, active, strict=True)])
    codes = spark.createDataFrame([(s.horizon, k) for k, s in enumerate(sums)], "horizon int, first int")
    rows = observations.join(F.broadcast(codes), "horizon").select(*(F.col(c).cast("double").alias(c) for c in ("logit", "outcome", "weight")), "first", F.col("first").alias("last"))
    theta = damped_newton(rows, np.log(base / (1 - base)), np.array([pull_alpha, pull_beta]), active)
    made = [(s.horizon, *((float(t[0]), float(t[1]), True, s.n, float(b)) if a else (0.0, 1.0, False, s.n, None))) for s, t, b, a in zip(sums, theta, base, active, strict=True)]
    return spark.createDataFrame(made, FIT)


def effective_agents(history: DataFrame, alert_below: float = 2.0) -> DataFrame:
    """horizon, agents, mean_correlation, n_eff, alert from (horizon, agent, instance, forecast, outcome).

    Errors of all agents on an instance meet in one row of the pivot by a group of few agents; pairs of
    agents, not of rows, are correlated.
    """
    errors = history.withColumn("e", F.col("forecast") - F.col("outcome"))
    pairs = errors.alias("a").join(errors.alias("b"), (F.col("a.horizon") == F.col("b.horizon")) & (F.col("a.instance") == F.col("b.instance")) & (F.col("a.agent") < F.col("b.agent")))
    each = pairs.groupBy(F.col("a.horizon").alias("horizon"), F.col("a.agent").alias("x"), F.col("b.agent").alias("y")).agg(F.corr("a.e", "b.e").alias("c"))
    mean = each.groupBy("horizon").agg(F.avg(F.least(F.greatest("c", F.lit(-1.0)), F.lit(1.0))).alias("mean_correlation"))
    sizes = errors.groupBy("horizon").agg(F.count_distinct("agent").alias("agents"))
    under = 1 + (F.col("agents") - 1) * F.col("mean_correlation")
    joined = mean.join(sizes, "horizon").withColumn("n_eff", F.when(under > 0, safe_div(F.col("agents"), under)))
    return joined.withColumn("alert", F.col("n_eff") < alert_below)
