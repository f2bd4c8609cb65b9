"""Trailing-window operators over bars (one row for each security and event_time)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.numbers import safe_div

BY = ("security_id",)
ORDER = ("event_time", "source_version")


def over(by: tuple[str, ...] = BY, order: tuple[str, ...] = ORDER) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def trailing(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or over()).rowsBetween(-(n - 1), 0)


def trailing_return(n: int, skip: int = 0, w: WindowSpec | None = None) -> Column:
    """close[t - skip] / close[t - skip - n] - 1; null where the series is too short or the base isn't positive."""
    w = w or over()
    base = F.lag("close", n + skip).over(w)
    return F.when(base > 0, F.lag("close", skip).over(w) / base - 1) if skip else F.when(base > 0, F.col("close") / base - 1)


def full_mean(column: str, n: int, w: WindowSpec | None = None) -> Column:
    """The mean of the last n rows, null with fewer."""
    frame = trailing(n, w)
    return F.when(F.count(F.lit(1)).over(frame) == n, F.avg(column).over(frame))


def sma_distance(n: int, w: WindowSpec | None = None) -> Column:
    mean = full_mean("close", n, w)
    return F.when((F.col("close") != 0) & (mean != 0), (F.col("close") - mean) / mean)


def with_full_means(bars: DataFrame, column: str, names: Mapping[int, str], w: WindowSpec | None = None) -> DataFrame:
    """bars with the mean of the last n rows for each n of names, null with fewer rows: full_mean for long windows.

    Sums and counts are put together from stretches of doubling length, each an earlier row's, so that a row costs a few
    lags and not n additions.
    """
    w = w or over()
    known = F.col(column).isNotNull()
    out = bars.withColumns({"_s0": F.coalesce(F.col(column).cast("double"), F.lit(0.0)), "_n0": F.when(known, 1).otherwise(0)})
    levels = max(names).bit_length() - 1
    back = lambda c, rows: F.coalesce(F.lag(c, rows).over(w), F.lit(0)) if rows else F.col(c)
    for k in range(levels):
        out = out.withColumns({f"{c}{k + 1}": F.col(f"{c}{k}") + back(f"{c}{k}", 1 << k) for c in ("_s", "_n")})

    def total(c: str, n: int) -> Column:
        bits = [k for k in reversed(range(levels + 1)) if n >> k & 1]
        return reduce(lambda a, b: a + b, (back(f"{c}{k}", sum(1 << j for j in bits if j > k)) for k in bits))

    whole = lambda n: F.lit(True) if n == 1 else F.lag(F.lit(True), n - 1).over(w).isNotNull()
    out = out.withColumns({name: F.when(whole(n), F.try_divide(total("_s", n), total("_n", n))) for n, name in names.items()})
    return out.drop(*(f"{c}{k}" for c in ("_s", "_n") for k in range(levels + 1)))


def with_trailing_max(bars: DataFrame, column: str, n: int, name: str, w: WindowSpec | None = None) -> DataFrame:
    """bars with the largest of up to n last values, from stretches of doubling length that overlap."""
    w = w or over()
    out, levels = bars.withColumn("_m0", F.col(column)), n.bit_length() - 1
    for k in range(levels):
        out = out.withColumn(f"_m{k + 1}", F.greatest(f"_m{k}", F.lag(f"_m{k}", 1 << k).over(w)))
    rest = n - (1 << levels)
    top = F.greatest(f"_m{levels}", F.lag(f"_m{levels}", rest).over(w)) if rest else F.col(f"_m{levels}")
    return out.withColumn(name, top).drop(*(f"_m{k}" for k in range(levels + 1)))


def distance_from(level: Column) -> Column:
    """Of close from a level, in shares of it; null where either is zero."""
    return F.when((F.col("close") != 0) & (level != 0), (F.col("close") - level) / level)


def realized_vol(returns: str = "ret_1d", n: int = 20, w: WindowSpec | None = None) -> Column:
    """Annualised sample deviation of up to n simple returns."""
    return F.stddev_samp(returns).over(trailing(n, w)) * F.sqrt(F.lit(252.0))


def true_range(w: WindowSpec | None = None) -> Column:
    before = F.coalesce(F.lag("close").over(w or over()), F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr_pct(ranges: str = "true_range", n: int = 20, w: WindowSpec | None = None) -> Column:
    return F.when(F.col("close") != 0, full_mean(ranges, n, w) / F.col("close"))


def with_drawdown(bars: DataFrame, name: str, n: int = 63, w: WindowSpec | None = None) -> DataFrame:
    """bars with the deepest fall from a running peak inside the last n closes.

    A stretch of closes is its highest, its lowest and its deepest fall; two neighbouring ones make one. The
    window is put together from stretches of doubling length, each an earlier row's: a few lags over one sort.
    """
    w = w or over()
    parts = ("_hi", "_lo", "_fall")

    def joined(older: dict[str, Column], newer: dict[str, Column]) -> dict[str, Column]:
        both = F.least(older["_fall"], newer["_fall"], newer["_lo"] / older["_hi"] - 1)
        new = {"_hi": F.greatest(older["_hi"], newer["_hi"]), "_lo": F.least(older["_lo"], newer["_lo"]), "_fall": both}
        return {c: F.when(older["_hi"].isNull(), newer[c]).otherwise(new[c]) for c in parts}

    at = lambda level: {c: F.col(f"{c}{level}") for c in parts}
    before = lambda level, back: {c: F.lag(f"{c}{level}", back).over(w) for c in parts}
    out = bars.withColumns({"_hi0": F.col("close"), "_lo0": F.col("close"), "_fall0": F.when(F.col("close").isNotNull(), 0.0)})
    levels = n.bit_length() - 1
    for k in range(levels):
        out = out.withColumns({f"{c}{k + 1}": v for c, v in joined(before(k, 1 << k), at(k)).items()})
    out, seen = out.withColumns({f"{c}_all": v for c, v in at(levels).items()}), 1 << levels
    for k in reversed(range(levels)):
        if n >> k & 1:
            out = out.withColumns({f"{c}_all": v for c, v in joined(before(k, seen), at("_all")).items()})
            seen += 1 << k
    return out.withColumn(name, F.col("_fall_all")).drop(*(f"{c}{k}" for c in parts for k in (*range(levels + 1), "_all")))


def volume_z(n: int = 20, w: WindowSpec | None = None) -> Column:
    frame = trailing(n, w)
    spread = F.stddev_samp("volume").over(frame)
    return F.when(spread > 0, (F.col("volume") - F.avg("volume").over(frame)) / spread)


def high_distance(n: int = 252, w: WindowSpec | None = None) -> Column:
    high = F.max("close").over(trailing(n, w))
    return F.when((F.col("close") != 0) & (high != 0), (F.col("close") - high) / high)


def price_features(bars: DataFrame) -> DataFrame:
    """Every bar with the price features as of it: one sort by key feeds all windows."""
    base = F.lag("close").over(over())
    stepped = bars.withColumn("ret_1d", F.when(base > 0, F.col("close") / base - 1)).withColumn("true_range", true_range())
    return with_drawdown(stepped, "max_drawdown_63d").withColumns({
        "return_1m": trailing_return(21),
        "return_3m": trailing_return(63),
        "return_6m": trailing_return(126),
        "momentum_12_1": trailing_return(231, skip=21),
        "sma_20d_distance": sma_distance(20),
        "sma_50d_distance": sma_distance(50),
        "sma_200d_distance": sma_distance(200),
        "realized_vol_20d": realized_vol(),
        "atr_20d_pct": atr_pct(),
        "volume_zscore_20d": volume_z(),
        "distance_52w_high": high_distance(),
    }).drop("ret_1d", "true_range")


#: Bars that the longest feature looks at.
LONGEST = 253


def newest_features(bars: DataFrame) -> DataFrame:
    """security_id and the price features as of each security's newest bar.

    Of a key the newest LONGEST bars are packed, newest first, into one row, and every feature is computed
    once from that array: one shuffle, in which earlier bars don't take part.
    """
    place = F.row_number().over(Window.partitionBy(*BY).orderBy(*(F.desc(c) for c in ORDER)))
    tail = bars.withColumn("_place", place).filter(F.col("_place") <= LONGEST)
    packed = tail.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("_place", "close", "high", "low", "volume"))).alias("b"))
    rows = packed.select(*BY, *(F.col(f"b.{c}").alias(c) for c in ("close", "high", "low", "volume")))
    get = lambda c, i: F.get(F.col(c) if isinstance(c, str) else c, F.lit(i))
    close, bars_seen = get("close", 0), F.size("close")

    def change(new: int, old: int) -> Column:
        return F.when(get("close", old) > 0, get("close", new) / get("close", old) - 1)

    def mean(values: Column) -> Column:
        known = F.filter(values, lambda v: v.isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))

    def deviation(values: Column) -> Column:
        # values and mean are bound to names, as a lambda would compute them anew for each element
        known = F.transform(F.array(F.filter(values, lambda v: v.isNotNull())), lambda k: F.struct(k.alias("k"), F.try_divide(F.aggregate(k, F.lit(0.0), lambda a, v: a + v), F.size(k)).alias("m")))
        squares = lambda x: F.aggregate(x.k, F.lit(0.0), lambda a, v: a + (v - x.m) * (v - x.m))
        return F.element_at(F.transform(known, lambda x: F.when(F.size(x.k) > 1, F.sqrt(squares(x) / (F.size(x.k) - 1)))), 1)

    def distance(n: int) -> Column:
        m = F.when(bars_seen >= n, mean(F.slice("close", 1, n)))
        return F.when((close != 0) & (m != 0), (close - m) / m)

    twenty = F.sequence(F.lit(0), F.lit(19))
    before = lambda i: F.get("close", i + 1)
    returns = F.transform(twenty, lambda i: F.when(before(i) > 0, F.get("close", i) / before(i) - 1))
    last = lambda i: F.coalesce(before(i), F.get("close", i))
    ranges = F.transform(twenty, lambda i: F.greatest(F.get("high", i) - F.get("low", i), F.abs(F.get("high", i) - last(i)), F.abs(F.get("low", i) - last(i))))
    fall = F.aggregate(
        F.reverse(F.slice("close", 1, 63)), F.struct(F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("worst")),
        lambda s, v: F.struct(F.greatest(s.peak, v).alias("peak"), F.least(s.worst, v / F.greatest(s.peak, v) - 1).alias("worst")), lambda s: s.worst,
    )
    high = F.array_max(F.slice("close", 1, 252))
    volumes = F.slice("volume", 1, 20)
    return rows.select(
        *BY, change(0, 21).alias("return_1m"), change(0, 63).alias("return_3m"), change(0, 126).alias("return_6m"), change(21, 252).alias("momentum_12_1"),
        *(distance(n).alias(f"sma_{n}d_distance") for n in (20, 50, 200)), (deviation(returns) * F.sqrt(F.lit(252.0))).alias("realized_vol_20d"),
        F.when((bars_seen >= 20) & (close != 0), mean(ranges) / close).alias("atr_20d_pct"), fall.alias("max_drawdown_63d"),
        F.when(deviation(volumes) > 0, (get("volume", 0) - mean(volumes)) / deviation(volumes)).alias("volume_zscore_20d"),
        F.when((close != 0) & (high != 0), (close - high) / high).alias("distance_52w_high"),
    )


def forward_return(horizon: int = 21, w: WindowSpec | None = None) -> tuple[Column, Column]:
    """(return, end) of the bar horizon rows later; null without one or a positive base."""
    w = w or Window.partitionBy(*BY).orderBy("event_time")
    usable = F.col("close") > 0
    end = F.lead("event_time", horizon).over(w)
    return F.when(usable, F.lead("close", horizon).over(w) / F.col("close") - 1), F.when(usable, end)


def mean_dollar_volume(n: int, least: int, w: WindowSpec | None = None) -> Column:
    """The mean of close times volume over up to n bars; null with fewer than least."""
    frame = trailing(n, w)
    return F.when(F.count(F.lit(1)).over(frame) >= least, F.avg(F.col("close") * F.col("volume")).over(frame))


def weekly_counts(items: DataFrame, key: str, as_of: Column, weeks: int = 8) -> DataFrame:
    """key, count_0 (latest) .. for weeks of (as_of - 7(i+1) d, as_of - 7i d]; items after as_of count in none."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("event_time").cast("timestamp"))) / 1e6
    week = F.floor(age / 604_800)
    return items.groupBy(key).agg(*(F.count_if((age >= 0) & (week == i)).alias(f"count_{i}") for i in range(weeks)))


def latest_week_z(weeks: int = 8) -> Column:
    """The latest week's count against the earlier ones: sample deviation, 0 where that is 0."""
    earlier = [F.col(f"count_{i}").cast("double") for i in range(1, weeks)]
    mean = reduce(lambda a, b: a + b, earlier) / len(earlier)
    spread = F.sqrt(reduce(lambda a, b: a + b, [(c - mean) * (c - mean) for c in earlier]) / (len(earlier) - 1))
    return F.when(spread > 0, (F.col("count_0") - mean) / spread).otherwise(0.0)


def bartlett_lrv(series: DataFrame, key: str, order: str, value: str, bandwidth: int) -> DataFrame:
    """key, lrv: long-run variance with weights 1 - j / bandwidth for lags below it; each lag is a shifted product."""
    centred = series.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(key)))
    w = Window.partitionBy(key).orderBy(order)
    lags = centred.withColumns({f"_p{j}": F.col("_d") * F.lag("_d", j).over(w) for j in range(1, bandwidth)})
    total = F.sum(F.col("_d") * F.col("_d"))
    for j in range(1, bandwidth):
        total = total + 2.0 * (1.0 - j / bandwidth) * F.coalesce(F.sum(f"_p{j}"), F.lit(0.0))
    return lags.groupBy(key).agg((total / F.count(F.lit(1))).alias("lrv"))


def peak_drawdown(equity: DataFrame, key: str, order: str) -> DataFrame:
    """equity with peak and drawdown up to each row; null where a value so far isn't positive and finite."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sound = F.min((F.col("equity") > 0) & ~F.isnan("equity") & (F.col("equity") < float("inf"))).over(w)
    peak = F.max("equity").over(w)
    return equity.withColumn("peak", F.when(sound, peak)).withColumn("drawdown", safe_div(F.col("peak") - F.col("equity"), F.col("peak")))
