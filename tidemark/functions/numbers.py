"""Column expressions for ratios, probabilities, prices and critical values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null for a null operand or a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clipped_logit(p: Column, lo: float, hi: float) -> Column:
    q = F.least(F.greatest(p, F.lit(lo)), F.lit(hi))
    return F.log(q / (1 - q))


def sigmoid(x: Column, clamp: float | None = None) -> Column:
    """The logistic function; clamped, or written so that exp never overflows."""
    if clamp is not None:
        x = F.least(F.greatest(x, F.lit(-clamp)), F.lit(clamp))
        return 1 / (1 + F.exp(-x))
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def cube_root_growth(ratio: Column) -> Column:
    """Growth a year from a ratio over three years; null for a negative ratio."""
    return F.when(ratio >= 0, F.pow(ratio, F.lit(1 / 3)) - 1)


def slippage_bps(side: Column, reference: Column, fill: Column) -> Column:
    """Positive is worse than the reference."""
    sign = F.when(side == "buy", 1.0).otherwise(-1.0)
    return sign * safe_div(fill - reference, reference) * 10_000


def collar_price(side: Column, reference: Column, collar_bps: Column) -> Column:
    """A limit at the collar, to the cent inside it: buys are floored and sells ceiled, with a slack of 1e-6."""
    buy = side == "buy"
    cents = reference * F.when(buy, 1 + collar_bps / 10_000).otherwise(1 - collar_bps / 10_000) * 100
    return F.when(buy, F.floor(cents + 1e-6)).otherwise(F.ceil(cents - 1e-6)).cast("double") / 100


def share_delta(weight: Column, equity: Column, price: Column, held: Column) -> Column:
    """Whole shares to trade from what is held to the target; null without a usable price."""
    wanted = F.when(weight > 0, F.floor(weight * equity / price)).otherwise(F.lit(0)).cast("double")
    return F.when((price > 0) & (finite(price).isNotNull()), F.round(wanted - F.coalesce(held, F.lit(0.0)), 6))


def max_vetoes(names: Column, budget: float) -> Column:
    return F.floor(names * F.lit(budget) + 1e-9).cast("long")


def daily_loss(equity: Column, prior: Column) -> Column:
    """Loss as a positive fraction of the prior close's equity; null where that is no positive number."""
    return F.when(finite(prior) > 0, (prior - finite(equity)) / prior)


def mid_or_trade(bid: Column, ask: Column, trade: Column, max_spread_bps: float = 50.0) -> Column:
    """struct(price, source): the quote's middle if its spread is tight enough, else the delayed trade."""
    mid = (bid + ask) / 2
    usable = (finite(bid) > 0) & (finite(ask) > 0) & (ask >= bid) & ((ask - bid) / mid * 10_000 <= max_spread_bps)
    usable = F.coalesce(usable, F.lit(False))
    traded = F.coalesce(finite(trade) > 0, F.lit(False))
    return F.struct(
        F.when(usable, mid).when(traded, trade).alias("price"),
        F.when(usable, F.lit("quote_mid")).when(traded, F.lit("last_trade")).alias("source"),
    )


def call_cost(reported: Column, prompt: Column, completion: Column, in_price: Column, out_price: Column) -> Column:
    """The provider's cost, or the tokens' at prices a million."""
    return F.coalesce(reported, (prompt * in_price + completion * out_price) / 1e6)


#: 95 % critical values of the Bartlett fixed-b t statistic for b = 0.02, 0.04 .. 1.00
#: (Kiefer and Vogelsang 2005, table I). Fixed values.
BARTLETT_95 = (
    1.690, 1.731, 1.772, 1.813, 1.861, 1.902, 1.944, 1.988, 2.030, 2.081,
    2.124, 2.179, 2.222, 2.274, 2.324, 2.367, 2.412, 2.459, 2.505, 2.556,
    2.601, 2.651, 2.696, 2.739, 2.781, 2.828, 2.872, 2.913, 2.956, 3.007,
    3.048, 3.082, 3.124, 3.162, 3.198, 3.245, 3.291, 3.330, 3.367, 3.408,
    3.444, 3.494, 3.537, 3.579, 3.616, 3.654, 3.692, 3.727, 3.764, 3.764,
)


def bartlett_critical(b: Column) -> Column:
    """The table's value at b, interpolated; null outside [0.02, 1]."""
    at = F.least(F.greatest(b / 0.02 - 1, F.lit(0.0)), F.lit(len(BARTLETT_95) - 1.0))
    low = F.least(F.floor(at), F.lit(len(BARTLETT_95) - 2)).cast("int")
    table = F.array(*(F.lit(v) for v in BARTLETT_95))
    under, over = F.element_at(table, low + 1), F.element_at(table, low + 2)
    return F.when((b >= 0.02 - 1e-12) & (b <= 1 + 1e-12), under + (at - low) * (over - under))


def bartlett_lag(n: Column) -> Column:
    return F.floor(4 * F.pow(n / 100.0, F.lit(2 / 9))).cast("int")


def clipped_share(x: Column, bound: float) -> Column:
    """x clipped to [-bound, bound], as a share of bound."""
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), x)) / bound


def binomial_upper(k: int, n: int, confidence: float = 0.99) -> float:
    """The exact one-sided upper bound on a rate of which k of n were seen: P(X <= k) falls to 1 - confidence."""
    if k >= n:
        return 1.0
    log_choose = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def below(p: float) -> float:
        return sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(log_choose))

    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) > 1 - confidence else (lo, mid)
    return (lo + hi) / 2


# The normal distribution by rational approximations: Hart's for the probability, algorithm AS 241 for its inverse. Fixed values.
_CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_CDF_LOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_PPF_MIDDLE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
_PPF_NEAR = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
_PPF_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(z: Column) -> Column:
    """The probability of a standard normal value up to z."""
    x = F.abs(z)
    e = F.exp(-x * x / 2)
    tail = x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))
    p = F.when(x < 7.07106781186547, e * _polynomial(x, _CDF_TOP) / _polynomial(x, _CDF_LOW)).otherwise(e / (tail * 2.506628274631))
    return F.when(z > 0, 1 - p).otherwise(p)


def normal_ppf(p: Column) -> Column:
    """The z with normal_cdf(z) = p; null outside of (0, 1)."""
    q = p - 0.5
    ratio = lambda r, pair: _polynomial(r, pair[0]) / _polynomial(r, pair[1])
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    far = F.when(r <= 5, ratio(r - 1.6, _PPF_NEAR)).otherwise(ratio(r - 5, _PPF_FAR))
    middle = q * ratio(0.180625 - q * q, _PPF_MIDDLE)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, middle).otherwise(F.signum(q) * far))


def bill_accrual(yield_pct: Column, days: Column) -> Column:
    """What a bill of that annual yield earns in so many days."""
    return F.pow(1 + yield_pct / 100, days / 365) - 1
