"""Forward-return labels, training sets and the logistic gate."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import finite, sigmoid
from tidemark.operators.asof import asof_join
from tidemark.operators.fits import descend
from tidemark.operators.ranks import with_best
from tidemark.operators.series import forward_return
from tidemark.operators.xsection import tercile_labels


def labels(feature_times: DataFrame, bars: DataFrame, sectors: DataFrame, horizon: int = 21) -> DataFrame:
    """feature_time, security_id, label_end, is_top_tercile: the return from the last bar at or before each time.

    Every security meets every feature time (a few parameters), and then one backward as-of join.
    """
    ret, end = forward_return(horizon)
    ahead = bars.withColumn("ret", ret).withColumn("label_end", end)
    times = feature_times.agg(F.collect_set("feature_time")).scalar()
    asked = sectors.select("security_id", "sector").withColumn("feature_time", F.explode(times))
    found = asof_join(asked, ahead, ["security_id"], "feature_time", "event_time", ["ret", "label_end"])
    return tercile_labels(found.filter(F.col("ret").isNotNull() & F.col("label_end").isNotNull()))


def eligible_training_set(features: DataFrame, labelled: DataFrame, as_of: Column) -> DataFrame:
    """Features joined to labels that ended strictly before as_of."""
    usable = labelled.filter(F.col("label_end") < as_of).select("security_id", F.col("feature_time").alias("event_time"), "label_end", F.col("is_top_tercile").cast("int").alias("target"))
    return features.join(usable, ["security_id", "event_time"])


def feature_names(features: DataFrame, column: str = "values") -> list[str]:
    """Names of the finite features of a map column; a schema's worth."""
    pairs = features.select(F.explode(column).alias("name", "value")).filter(finite(F.col("value")).isNotNull())
    return sorted(r.name for r in pairs.select("name").distinct().collect())


MODEL = "group string, names array<string>, means array<double>, scales array<double>, coefficients array<double>, intercept double"


def _wide(examples: DataFrame, names: Sequence[str], *more: Column) -> DataFrame:
    return examples.select(F.col("target").cast("double").alias("target"), *(finite(F.col("values")[n]).alias(f"f{k}") for k, n in enumerate(names)), *more)


def _models(spark: SparkSession, groups: Sequence[str], names: Sequence[str], fitted: Sequence[dict]) -> DataFrame:
    return spark.createDataFrame([(g, list(names), m["means"], m["scales"], m["coefficients"], m["intercept"]) for g, m in zip(groups, fitted, strict=True)], MODEL)


def fit_logistic(examples: DataFrame, names: Sequence[str], group: str, iterations: int = 300, rate: float = 0.08, l2: float = 0.01) -> DataFrame:
    """One model for each group (a sector or run) of examples (group, values, target), by full-batch descent.

    Missing features take the mean; scales are population deviations, 1 where there is none. The groups' names
    and models are the driver's; the rows never are.
    """
    spark, names = examples.sparkSession, list(names)
    groups = sorted((r[0] for r in examples.select(F.col(group).cast("string")).distinct().collect()), key=lambda g: (g is not None, g))
    if not groups:
        return spark.createDataFrame([], MODEL)
    codes = spark.createDataFrame([(g, k) for k, g in enumerate(groups)], "_group string, first int")
    # a row for each model, which the driver holds
    coded = examples.join(F.broadcast(codes), F.col(group).cast("string").eqNullSafe(F.col("_group")))
    fitted = descend(_wide(coded, names, F.col("first"), F.col("first").alias("last")), [f"f{k}" for k in range(len(names))], "target", len(groups), iterations, rate, l2)
    return _models(spark, groups, names, fitted)


def fit_logistic_dates(features: DataFrame, labelled: DataFrame, dates: Sequence[Column], names: Sequence[str], iterations: int = 300, rate: float = 0.08, l2: float = 0.01) -> DataFrame:
    """One model for each of the dates, in order of time, fitted on the labels that ended strictly before it.

    A row serves every date from the first after its label's end on, so that training sets overlap without a
    copy of any row. A date without labels has a model of zeros.
    """
    spark, names = features.sparkSession, list(names)
    usable = labelled.filter(F.col("label_end").isNotNull()).select("security_id", F.col("feature_time").alias("event_time"), "label_end", F.col("is_top_tercile").cast("int").alias("target"))
    first = F.lit(0)
    for d in dates:
        first = first + (F.col("label_end") >= d).cast("int")
    examples = features.join(usable, ["security_id", "event_time"]).withColumn("first", first).filter(F.col("first") < len(dates))
    fitted = descend(_wide(examples, names, F.col("first"), F.lit(len(dates) - 1).alias("last")), [f"f{k}" for k in range(len(names))], "target", len(dates), iterations, rate, l2)
    groups = spark.range(1).select(*(d.cast("string") for d in dates)).first()
    return _models(spark, list(groups), names, fitted)


def gate_score(values: Column, names: Sequence[str], means: Sequence[float], scales: Sequence[float], coefficients: Sequence[float], intercept: float) -> Column:
    """The model's probability from a map of values; missing ones count as the mean."""
    total = F.lit(float(intercept))
    for name, mean, scale, coefficient in zip(names, means, scales, coefficients, strict=True):
        total = total + F.lit(float(coefficient)) * (F.coalesce(finite(values[name]), F.lit(float(mean))) - mean) / scale
    return sigmoid(total, 35.0)


def decide(scored: DataFrame, top_k: int, group: Sequence[str] = ("run_id",)) -> DataFrame:
    """scored with passed for the best top_k of each run, ties to the smaller security_id; all rows stay."""
    return with_best(scored, group, F.col("score"), "security_id", top_k, "passed")


def recall(decisions: DataFrame, labelled: DataFrame, on: Sequence[str] = ("security_id",)) -> DataFrame:
    """The share of top-tercile names that passed; null without any."""
    positives = labelled.filter("is_top_tercile").select(*on).distinct()
    passed = decisions.filter("passed").select(*on, F.lit(1).alias("hit")).distinct()
    return positives.join(passed, list(on), "left").agg(F.try_divide(F.count("hit"), F.count(F.lit(1))).alias("recall"))


def score_batches(model: dict) -> callable:
    """A mapInPandas function for models whose coefficients are too many for one expression."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        means, scales, weights = (np.asarray(model[k]) for k in ("means", "scales", "coefficients"))
        for f in frames:
            x = np.array([[v.get(n, np.nan) for n in model["names"]] for v in f["values"].map(dict)], np.float64)
            x = np.where(np.isfinite(x), x, means)
            f = f.assign(score=1 / (1 + np.exp(-np.clip(model["intercept"] + ((x - means) / scales) @ weights, -35, 35))))
            yield f[["security_id", "score"]]

    return run
