"""How good forecasts and return series are: information coefficients, ratios, and what search for the best one explains."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import normal_cdf, normal_ppf
from tidemark.operators.ranks import with_average_rank
from tidemark.sources.interim import written

EULER = 0.5772156649015329
BLOCKS = 16


def rank_ic(df: DataFrame, group: Sequence[str], forecast: str, outcome: str, tie: str) -> DataFrame:
    """group, n, ic: Spearman's correlation with average ranks over the rows that have both; null where one is constant.

    Ranks come from range partitions, so that a cross-section of any size is ranked by all tasks. Each ranking reads
    its rows several times, so they are written before it.
    """
    both = written(df.filter(F.col(forecast).isNotNull() & F.col(outcome).isNotNull()).select(*group, forecast, outcome, tie))
    once = written(with_average_rank(both, group, forecast, tie, "_x"))
    ranked = with_average_rank(once, group, outcome, tie, "_y")
    return ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y")).alias("ic"))


def ic_by_offset(ics: DataFrame, period: str, step: int, by: Sequence[str] = ()) -> DataFrame:
    """by, offset, n, undefined, mean, t of the ics of every step-th period, for each of the step offsets."""
    return ics.groupBy(*by, F.pmod(period, F.lit(step)).alias("offset")).agg(
        F.count("ic").alias("n"), F.count_if(F.col("ic").isNull()).alias("undefined"), F.avg("ic").alias("mean"),
        F.when(F.stddev_samp("ic") > 0, F.avg("ic") / (F.stddev_samp("ic") / F.sqrt(F.count("ic")))).alias("t"),
    )


def performance(returns: DataFrame, key: str, order: str, per_year: float) -> DataFrame:
    """key, n, cagr, sharpe, sortino, max_drawdown of each series of simple returns (key, order, ret)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("_g", F.sum(F.log1p("ret")).over(w))
    fallen = grown.withColumn("_d", F.exp(F.col("_g") - F.greatest(F.max("_g").over(w), F.lit(0.0))) - 1)
    mean, n = F.avg("ret"), F.count("ret")
    downside = F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), F.lit(2.0))))
    year = F.sqrt(F.lit(float(per_year)))
    return fallen.groupBy(key).agg(
        n.alias("n"), (F.exp(F.sum(F.log1p("ret")) * per_year / n) - 1).alias("cagr"), F.when(F.stddev_samp("ret") > 0, mean / F.stddev_samp("ret") * year).alias("sharpe"),
        F.when(downside > 0, mean / downside * year).alias("sortino"), F.min("_d").alias("max_drawdown"),
    )


def _moments(returns: DataFrame, key: str) -> DataFrame:
    spread = F.stddev_samp("ret")
    return returns.groupBy(key).agg(F.count("ret").alias("n"), F.when(spread > 0, F.avg("ret") / spread).alias("sharpe"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurtosis"))


def _uncertainty() -> Column:
    """The variance of a Sharpe ratio's estimate, times the periods less one."""
    s = F.col("sharpe")
    return 1 - F.col("skew") * s + (F.col("kurtosis") - 1) / 4 * s * s


def deflated_sharpe(returns: DataFrame, key: str, trials: int | None = None, confidence: float = 0.9) -> DataFrame:
    """key, n, sharpe, expected_best, dsr, track_record for each trial's series (key, ret); ratios are for a period.

    expected_best is the Sharpe ratio that the best of all trials has by luck: of `trials`, or of those that are here,
    with the variance of the ratios here; 0 for a lone one. dsr is the probability that the true ratio exceeds it.
    track_record is how many periods show a ratio above 0 at the confidence; null (unbounded) for ratios not above 0.
    """
    scored = _moments(returns, key)
    known = F.struct(F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("v"), (F.lit(trials) if trials else F.count("sharpe")).cast("double").alias("n"))
    across = scored.agg(known.alias("x"))
    # one row of aggregates over the trials
    joined = scored.withColumn("_x", across.scalar())
    n, v = F.col("_x.n"), F.col("_x.v")
    best = F.when(n > 1, F.sqrt(v) * ((1 - EULER) * normal_ppf(1 - 1 / n) + EULER * normal_ppf(1 - 1 / (n * float(np.e))))).otherwise(0.0)
    out = joined.withColumn("expected_best", best)
    dsr = normal_cdf((F.col("sharpe") - F.col("expected_best")) * F.sqrt(F.col("n") - 1) / F.sqrt(_uncertainty()))
    record = F.when(F.col("sharpe") > 0, 1 + _uncertainty() * F.pow(normal_ppf(F.lit(confidence)) / F.col("sharpe"), F.lit(2.0)))
    return out.select(key, "n", "sharpe", "expected_best", dsr.alias("dsr"), record.alias("track_record"))


def _sharpes(sums: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """trials x splits: Sharpe ratios over the blocks of each split, from sums (trials x blocks x 3) of n, r and r * r."""
    n, s, q = (sums[:, :, k] @ masks.T for k in range(3))
    mean = s / n
    # rounded, so that a trial has the same ratio whatever others it is computed with
    return np.round(mean / np.sqrt(np.maximum(q - s * mean, 1e-300) / (n - 1)), 12)


def overfitting(returns: DataFrame, key: str, time: str, blocks: int = BLOCKS) -> DataFrame:
    """trials, splits, pbo: how often the best trial of one half of the blocks is no better than the median of the other half.

    returns has one ret for each key and time. Times are cut into equal blocks, the earliest that don't fit being
    dropped; every choice of half the blocks is a split. Of equally good trials the smallest key is the best, and equal ranks are
    averaged. Trials that lack a time or whose returns are constant are left out; pbo is null for fewer than two.

    A trial is three sums a block, whatever its length. Tasks hold a few trials against all splits; what is shuffled is a
    row for each task and split. No row of returns is copied.
    """
    times = returns.agg(F.sort_array(F.collect_set(time)).alias("t"))  # a series' length
    length = times.select(F.size("t")).first()[0]
    size, dropped = max(1, length // blocks), length % blocks
    place = F.array_position(times.scalar(), F.col(time)) - 1 - dropped
    block = F.floor(place / size).cast("int")
    whole = returns.withColumn("_b", block).filter(F.col("_b") >= 0)
    parts = whole.groupBy(key, "_b").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"), F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    packed = parts.groupBy(F.col(key).alias("k")).agg(F.array_sort(F.collect_list(F.struct("_b", F.array(F.col("n").cast("double"), "s", "q").alias("x")))).alias("a"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    trials = written(packed.filter((F.col("n") == size * blocks) & (F.col("lo") < F.col("hi"))).select("k", F.flatten("a.x").alias("x")))
    many = trials.count()
    masks = np.array([[m >> b & 1 for b in range(blocks)] for m in range(1 << blocks) if m.bit_count() == blocks // 2], np.float64)
    spark = returns.sparkSession
    result = "trials long, splits long, pbo double"
    if many < 2 or length < blocks:
        return spark.createDataFrame([(many, len(masks), None)], result)

    def halves(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        sums = b.column(1).flatten().to_numpy().reshape(b.num_rows, blocks, 3)
        return _sharpes(sums, masks), _sharpes(sums, 1 - masks)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for b in (whole_batch.slice(at, 256) for at in range(0, whole_batch.num_rows, 256)):
                b = b.take(pa.compute.sort_indices(b.column(0)))
                inside, outside = halves(b)
                top, split = inside.argmax(axis=0), np.arange(len(masks))
                yield pa.RecordBatch.from_arrays([pa.array(split), pa.array(inside[top, split]), b.column(0).take(pa.array(top)), pa.array(outside[top, split])], names=["split", "inside", "k", "outside"])

    kind = trials.schema["k"].dataType.simpleString()
    found = trials.mapInArrow(best, f"split long, inside double, k {kind}, outside double")
    winners = found.groupBy("split").agg(F.min_by("outside", F.struct(-F.col("inside"), "k")).alias("outside")).orderBy("split").toArrow()
    bar = winners["outside"].to_numpy()  # a number for each split

    def beaten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(len(masks))
        for whole_batch in batches:
            for b in (whole_batch.slice(at, 256) for at in range(0, whole_batch.num_rows, 256)):
                outside = halves(b)[1]
                below += (outside < bar).sum(axis=0) + 0.5 * (outside == bar).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(masks))), pa.array(below)], names=["split", "below"])

    # the winner counts as half of itself here, which makes the average rank below + 1/2
    ranks = trials.mapInArrow(beaten, "split long, below double").groupBy("split").agg((F.sum("below") + 0.5).alias("rank"))
    return ranks.agg(F.lit(many).alias("trials"), F.count(F.lit(1)).alias("splits"), F.avg((F.col("rank") / (many + 1) <= 0.5).cast("double")).alias("pbo")).select(F.col("trials").cast("long").alias("trials"), "splits", "pbo")
