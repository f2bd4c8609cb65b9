"""Effective spreads from daily high, low and close, each day judged with the session before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import over

SESSIONS = 21
NOISE = 1e-12
_ROOT = 3 - 2 * 2**0.5


def corwin_schultz(high: Column, low: Column, high_before: Column, low_before: Column, close_before: Column) -> Column:
    """The spread of two sessions from their ranges, negative ones as zero.

    A session that lies wholly above or below the close before it is moved by the gap, as that much of the
    two-day range is overnight movement.
    """
    gap = F.greatest(low - close_before, F.lit(0.0)) + F.least(high - close_before, F.lit(0.0))
    h, l = high - gap, low - gap  # noqa: E741
    square = lambda a, b: F.pow(F.log(a / b), F.lit(2.0))
    beta = square(h, l) + square(high_before, low_before)
    gamma = square(F.greatest(h, high_before), F.least(l, low_before))
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / _ROOT - F.sqrt(gamma / _ROOT)
    return F.greatest(2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)), F.lit(0.0))


def abdi_ranaldo(high: Column, low: Column, close_before: Column, high_before: Column, low_before: Column) -> Column:
    """The spread of two sessions from the earlier close and both mid-ranges, negative squares as zero, and what rounding leaves of zero too."""
    mid = lambda a, b: (F.log(a) + F.log(b)) / 2
    c, before, now = F.log(close_before), mid(high_before, low_before), mid(high, low)
    square = 4 * (c - before) * (c - now)
    return F.when(square > NOISE, F.sqrt(square)).when(square.isNotNull(), 0.0)


def effective_spreads(bars: DataFrame, sessions: int = SESSIONS) -> DataFrame:
    """security_id, event_time, corwin_schultz, abdi_ranaldo, half_spread: means of the last `sessions` daily estimates.

    An estimate needs as many valid days (positive prices, low <= close <= high, and a session before), else it is
    null; half_spread, a trade's cost, needs both and is half their mean. Nothing later than a bar is used for it.
    """
    w = over(order=("event_time",))
    sound = (F.col("low") > 0) & (F.col("low") <= F.col("close")) & (F.col("close") <= F.col("high"))
    before = {f"_{c}": F.lag(F.when(sound, F.col(c))).over(w) for c in ("high", "low", "close")}
    rows = bars.withColumns(before)
    usable = sound & F.col("_close").isNotNull()
    col = F.col
    daily = {
        "_cs": F.when(usable, corwin_schultz(col("high"), col("low"), col("_high"), col("_low"), col("_close"))),
        "_ar": F.when(usable, abdi_ranaldo(col("high"), col("low"), col("_close"), col("_high"), col("_low"))),
    }
    frame = w.rowsBetween(-(sessions - 1), Window.currentRow)
    full = lambda c: F.when(F.count(c).over(frame) == sessions, F.avg(c).over(frame))
    out = rows.withColumns(daily).withColumns({"corwin_schultz": full("_cs"), "abdi_ranaldo": full("_ar")})
    return out.select("security_id", "event_time", "corwin_schultz", "abdi_ranaldo", ((col("corwin_schultz") + col("abdi_ranaldo")) / 4).alias("half_spread"))
