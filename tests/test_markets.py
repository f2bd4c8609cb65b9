"""Actions, spreads, benchmarks, metrics, outcomes, ranks and fits against plain computations on small tables."""

import datetime as dt
import itertools
import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers
from tidemark.operators import actions, benchmarks, fits, gate, metrics, outcomes, ranks, spreads
from tidemark.sources import interim, writes

DAY0 = dt.date(2024, 1, 1)


def day(k):
    return DAY0 + dt.timedelta(days=k)


def at(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=k)


def test_normal_functions(spark):
    norm = statistics.NormalDist()
    z = [-9.0, -7.2, -3.0, -0.7, 0.0, 0.3, 1.96, 5.5, 8.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(numbers.normal_cdf(F.col("z"))).collect()
    assert all(math.isclose(r[0], norm.cdf(x), rel_tol=1e-9, abs_tol=1e-15) for r, x in zip(got, z, strict=True))
    p = [1e-12, 1e-6, 0.01, 0.2, 0.5, 0.8, 0.99, 1 - 1e-9]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(numbers.normal_ppf(F.col("p"))).collect()
    assert all(math.isclose(r[0], norm.inv_cdf(x), rel_tol=1e-12, abs_tol=1e-15) for r, x in zip(got, p, strict=True))
    assert spark.range(1).select(numbers.normal_ppf(F.lit(1.0))).first()[0] is None
    assert math.isclose(spark.range(1).select(numbers.bill_accrual(F.lit(5.0), F.lit(7))).first()[0], 1.05 ** (7 / 365) - 1)


# ---- ranks
RANKED = "g string, v double, k long"


@pytest.fixture(scope="module")
def ranked(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1.0, 1.0, 2.0, None, rng.random()]), k) for k in range(400)]
    return spark.createDataFrame(rows, RANKED).repartition(5), pd.DataFrame(rows, columns=["g", "v", "k"])


def test_ranks_are_those_of_one_sort(spark, ranked):
    df, p = ranked
    got = ranks.with_average_rank(df, ["g"], "v", "k", "r").toPandas().set_index("k").r.sort_index()
    want = p.assign(g=p.g.fillna("-")).groupby("g").v.rank(method="average")
    assert np.allclose(got, want, equal_nan=True)
    got = ranks.with_dense_rank(df.filter("v is not null"), ["g"], "v", "r").toPandas().set_index("k").r.sort_index()
    want = p.dropna(subset="v").assign(g=p.g.fillna("-")).groupby("g").v.rank(method="dense")
    assert (got.to_numpy() == want.to_numpy()).all()
    got = ranks.with_place(df, ["g"], [F.desc_nulls_last("v"), F.asc("k")], "r").toPandas().set_index("k").r.sort_index()
    want = p.assign(g=p.g.fillna("-"), v=-p.v).sort_values(["v", "k"]).groupby("g").cumcount().sort_index() + 1
    assert (got.to_numpy() == want.to_numpy()).all()
    got = ranks.with_best(df, ["g"], F.col("v"), "k", 7, "best").toPandas().set_index("k").best.sort_index()
    assert (got.to_numpy() == (want <= 7).to_numpy()).all()


def test_ranks_use_no_window_over_a_group(spark, ranked):
    df = ranked[0]
    for made in (ranks.with_average_rank(df, ["g"], "v", "k", "r"), ranks.with_place(df, ["g"], [F.asc("k")], "r"), ranks.with_group(df, ["g"], {"m": F.avg("v")})):
        assert "Window" not in made._jdf.queryExecution().executedPlan().toString()


def test_interim_tables_are_cleared(spark):
    t = interim.written(spark.range(5))
    assert t.count() == 5
    interim.clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(interim.folder(spark)).count()


# ---- actions
def plainly_adjusted(bars, acts, last):
    """{day: (split factor, total factor)} of one security."""
    out = {}
    for d, _ in bars:
        s = t = 1.0
        for ex in sorted({a[0] for a in acts if a[0] > d}):
            shares, cash = 1.0, 0.0
            for e, kind, rate in acts:
                if e == ex:
                    shares *= rate if "split" in kind else 1 + rate if kind == "stock_dividend" else 1
                    cash += rate if kind == "cash_dividend" else 0
            before = max(((b, c) for b, c in bars if b < ex), default=(None, None))[1]
            s /= shares
            t *= (1 / shares) * (1 - cash * shares / before)
        out[d] = (s, t)
    return out


def test_late_corrections_reprice_the_past_for_later_readers_only(spark):
    closes = [100.0, 102.0, 51.0, 52.0, 50.0]
    bars = spark.createDataFrame([(1, day(k), c) for k, c in enumerate(closes)], "security_id long, day date, close double")
    schema = "action_id string, security_id long, ex_date date, kind string, rate double, available_at timestamp_ntz, source_version string, withdrawn boolean"
    acts = [
        ("a", 1, day(2), "forward_split", 2.0, at(2), "1", False), ("b", 1, day(4), "cash_dividend", 1.0, at(4), "1", False), ("b", 1, day(4), "cash_dividend", 2.0, at(9), "2", None),
        ("c", 1, day(3), "stock_dividend", 0.1, at(3), "1", False), ("c", 1, day(3), "stock_dividend", 0.1, at(9), "2", True), ("d", 1, day(2), "cash_dividend", 0.5, at(2), "1", False),
    ]
    dates = [F.to_timestamp_ntz(F.lit(str(at(k)))) for k in (3, 5, 10)]
    got = {(r.as_of, r.day): r for r in actions.adjusted_prices(bars, spark.createDataFrame(acts, schema), dates).collect()}
    rows = list(zip(map(day, range(5)), closes, strict=True))
    seen = {
        3: [(day(2), "forward_split", 2.0), (day(3), "stock_dividend", 0.1), (day(2), "cash_dividend", 0.5)],
        5: [(day(2), "forward_split", 2.0), (day(3), "stock_dividend", 0.1), (day(2), "cash_dividend", 0.5), (day(4), "cash_dividend", 1.0)],
        10: [(day(2), "forward_split", 2.0), (day(2), "cash_dividend", 0.5), (day(4), "cash_dividend", 2.0)],
    }
    for k, known in seen.items():
        mine = [r for r in rows if r[0] <= day(k)]
        for d, (s, t) in plainly_adjusted(mine, known, k).items():
            r = got.pop((at(k), d))
            assert math.isclose(r.split_close, r.close * s) and math.isclose(r.total_close, r.close * t)
    assert not got


def test_horizon_returns(spark):
    bars = [(1, day(k), 10.0 + k) for k in range(6)] + [(s, day(k), 20.0) for s in (2, 3, 4, 5) for k in range(3)] + [(6, day(k), 5.0) for k in range(2)]
    acts = [(1, day(1), "forward_split", 2.0), (1, day(2), "cash_dividend", 1.0), (1, day(5), "spin_off", 1.0), (2, day(4), "worthless_removal", None), (2, day(3), "cash_dividend", 1.0), (3, day(4), "cash_merger", 25.0), (4, day(4), "cash_merger", None), (5, day(4), "stock_merger", 1.0)]
    out = actions.horizon_returns(spark.createDataFrame(bars, "security_id long, day date, close double"), spark.createDataFrame(acts, "security_id long, ex_date date, kind string, rate double"), 3)
    got = {(r.security_id, r.day): r for r in out.collect()}
    assert math.isclose(got[1, day(0)].ret, (13 * 2 + 2 * 1.0) / 10 - 1) and got[1, day(0)].source == "bar" and got[1, day(0)].end_day == day(3)
    assert math.isclose(got[1, day(1)].ret, (14 + 1.0) / 11 - 1)  # entered on the split's day: already in new shares
    assert (got[1, day(2)].ret, got[1, day(2)].reason) == (None, "uninterpreted")
    assert got[1, day(3)].reason == "no_exit" and got[6, day(0)].reason == "no_exit"
    assert math.isclose(got[2, day(2)].ret, 1 / 20 - 1) and got[2, day(2)].source == "worthless" and got[2, day(2)].end_day == day(4)
    assert math.isclose(got[3, day(1)].ret, 0.25) and got[3, day(1)].source == "consideration"
    assert math.isclose(got[4, day(1)].ret, -0.3) and got[4, day(1)].source == "default"
    assert (got[5, day(1)].ret, got[5, day(1)].reason) == (None, "acquirer")


def test_spreads(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(30):
        low = 100 + 8 * rng.random()
        high = low * (1 + 0.03 * rng.random())
        rows.append((1, at(k), float(high), float(low), float(low + (high - low) * rng.random())))
    rows[7] = (1, at(7), 90.0, 95.0, 93.0)  # not a session's range
    got = spreads.effective_spreads(spark.createDataFrame(rows, "security_id long, event_time timestamp_ntz, high double, low double, close double"), 5).orderBy("event_time").collect()
    daily = [(None, None)]
    for (_, _, h0, l0, c0), (_, _, h, l, c) in itertools.pairwise(rows):  # noqa: E741
        if not (l <= c <= h and l0 <= c0 <= h0):
            daily.append((None, None))
            continue
        gap = l - c0 if l > c0 else h - c0 if h < c0 else 0
        beta, gamma = math.log((h - gap) / (l - gap)) ** 2 + math.log(h0 / l0) ** 2, math.log(max(h - gap, h0) / min(l - gap, l0)) ** 2
        k = 3 - 2 * math.sqrt(2)
        alpha = (math.sqrt(2 * beta) - math.sqrt(beta)) / k - math.sqrt(gamma / k)
        square = 4 * (math.log(c0) - math.log(h0 * l0) / 2) * (math.log(c0) - math.log(h * l) / 2)
        daily.append((max(0.0, 2 * (math.exp(alpha) - 1) / (1 + math.exp(alpha))), math.sqrt(max(square, 0.0))))
    for k, r in enumerate(got):
        tail = daily[max(0, k - 4) : k + 1]
        if len(tail) < 5 or any(t[0] is None for t in tail):
            assert r.corwin_schultz is None and r.half_spread is None
        else:
            cs, ar = (sum(t[j] for t in tail) / 5 for j in (0, 1))
            assert math.isclose(r.corwin_schultz, cs, abs_tol=1e-12) and math.isclose(r.abdi_ranaldo, ar, abs_tol=1e-12) and math.isclose(r.half_spread, (cs + ar) / 4, abs_tol=1e-12)


def test_drifting_weights(spark):
    returns = [(p, 10 * p + k, s, r) for p in (0, 1) for k, rs in enumerate([(0.1, -0.1), (0.2, 0.0)]) for s, r in zip((1, 2), rs, strict=True)]
    returns = [r for r in returns if r[1:3] != (11, 2)]  # a name without a return in the second period
    targets = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.3), (1, 1, 0.4), (1, 2, 0.4)], "period long, security_id long, weight double")
    bills = spark.createDataFrame([(p, 10 * p + k, 0.01) for p in (0, 1) for k in (0, 1)], "period long, t long, bill double")
    weights = benchmarks.drifted(targets, spark.createDataFrame(returns, "period long, t long, security_id long, ret double"), bills)
    got = {(r.period, r.t): r.ret for r in benchmarks.book_returns(weights).collect()}
    one = 0.5 * 1.1 + 0.3 * 0.9 + 0.2 * 1.01
    two = 0.5 * 1.1 * 1.2 + 0.3 * 0.9 + 0.2 * 1.01**2
    assert math.isclose(got[0, 0], one - 1) and math.isclose(got[0, 1], two / one - 1) and got[1, 11] is None and got[1, 10] is not None
    turn = {r.period: r.turnover for r in benchmarks.turnover(weights, targets, F.col("period") + 1).collect()}
    assert math.isclose(turn[0], 0.8) and math.isclose(turn[1], abs(0.4 - 0.5 * 1.32 / two) + abs(0.4 - 0.27 / two))


def test_rank_ic(spark):
    rng = random.Random(4)
    rows = [(g, k, float(rng.randint(0, 5)), rng.choice([None, rng.random(), 0.5])) for g in ("x", "y") for k in range(60)] + [("flat", k, 1.0, float(k)) for k in range(5)]
    got = {r.g: r for r in metrics.rank_ic(spark.createDataFrame(rows, "g string, k long, p double, y double"), ["g"], "p", "y", "k").collect()}
    p = pd.DataFrame(rows, columns=["g", "k", "p", "y"]).dropna()
    for g in ("x", "y"):
        one = p[p.g == g]
        assert math.isclose(got[g].ic, one.p.rank().corr(one.y.rank())) and got[g].n == len(one)
    assert got["flat"].ic is None and got["flat"].n == 5


def test_deflated_sharpe_of_one_and_many(spark):
    rng = np.random.default_rng(0)
    series = {k: rng.normal(0.05 * k, 1, 80) for k in range(4)}
    df = spark.createDataFrame([(k, float(x)) for k, s in series.items() for x in s], "trial long, ret double")
    norm = statistics.NormalDist()

    def by_hand(k, ratios, n):
        x = series[k]
        s, m = x.mean() / x.std(ddof=1), x - x.mean()
        g3, g4 = (m**3).mean() / x.std() ** 3, (m**4).mean() / x.std() ** 4
        best = 0.0 if n == 1 else np.std(ratios, ddof=1) * ((1 - metrics.EULER) * norm.inv_cdf(1 - 1 / n) + metrics.EULER * norm.inv_cdf(1 - 1 / (n * math.e)))
        u = 1 - g3 * s + (g4 - 1) / 4 * s * s
        return best, norm.cdf((s - best) * math.sqrt(len(x) - 1) / math.sqrt(u)), 1 + u * (norm.inv_cdf(0.9) / s) ** 2 if s > 0 else None

    ratios = [x.mean() / x.std(ddof=1) for x in series.values()]
    for r in metrics.deflated_sharpe(df, "trial", trials=9).collect():
        want = by_hand(r.trial, ratios, 9)
        assert np.allclose([r.expected_best, r.dsr], want[:2]) and ((r.track_record is None) == (want[2] is None)) and (want[2] is None or math.isclose(r.track_record, want[2]))
    lone = metrics.deflated_sharpe(df.filter("trial = 2"), "trial").first()
    assert np.allclose([lone.expected_best, lone.dsr], by_hand(2, [], 1)[:2])


def test_overfitting_over_all_splits(spark):
    rng = np.random.default_rng(7)
    trials, blocks, length = 9, 6, 27  # three times don't fit
    x = np.round(rng.normal(0, 1, (trials, length)), 1)
    x[3] = x[5]  # a tie
    rows = [(k, t, float(x[k, t])) for k in range(trials) for t in range(length)] + [(77, t, 0.5) for t in range(length)] + [(88, 3, 0.1)]
    got = metrics.overfitting(spark.createDataFrame(rows, "trial long, t long, ret double").repartition(3), "trial", "t", blocks).first()
    parts = x[:, length % blocks :].reshape(trials, blocks, -1)
    low = 0
    splits = list(itertools.combinations(range(blocks), blocks // 2))
    ratio = lambda chosen: np.round([p.mean() / p.std(ddof=1) for p in parts[:, list(chosen)].reshape(trials, -1)], 12)
    for s in splits:
        inside, outside = ratio(s), ratio([b for b in range(blocks) if b not in s])
        w = int(inside.argmax())
        rank = (outside < outside[w]).sum() + ((outside == outside[w]).sum() + 1) / 2
        low += rank / (trials + 1) <= 0.5
    assert (got.trials, got.splits) == (trials, len(splits)) and math.isclose(got.pbo, low / len(splits))
    few = metrics.overfitting(spark.createDataFrame(rows[:length], "trial long, t long, ret double"), "trial", "t", blocks).first()
    assert (few.trials, few.pbo) == (1, None)


def test_outcomes_mature_once_and_by_revision(spark, tmp_path):
    price = "security_id long, day date, close double, available_at timestamp_ntz, source_version string"
    prices = spark.createDataFrame([(1, day(0), 10.0, at(0), "1"), (1, day(1), 11.0, at(1), "1"), (1, day(2), 12.0, at(6), "1"), (1, day(1), 11.5, at(5), "2"), (1, day(0), 10.0, at(7), "2")], price)
    sessions = spark.createDataFrame([(day(k), k) for k in range(3)], "session_date date, number long")
    verdicts = spark.createDataFrame([("r", 1, day(0))], "run_id string, security_id long, entry_day date")
    pairs = outcomes.horizon_ends(verdicts, sessions, [1, 2, 5])
    store = writes.Store(spark, str(tmp_path / "s"))
    t = lambda k: F.to_timestamp_ntz(F.lit(str(at(k))))
    added = [outcomes.append_resolved(store, pairs, prices, None, t(2)), outcomes.append_resolved(store, pairs, prices, t(2), t(2)), outcomes.append_resolved(store, pairs, prices, t(2), t(6)), outcomes.append_resolved(store, pairs, prices, t(6), t(8))]
    assert added == [1, 0, 2, 0]  # at 2 the first; by 6 its revision and the second; at 8 a version with the same price
    rows = store.read("outcomes", outcomes.OUTCOME)
    newest = {r.horizon: round(r.ret, 6) for r in outcomes.resolved_outcomes(rows, t(9)).collect()}
    assert newest == {1: 0.15, 2: 0.2} and [round(r.ret, 6) for r in outcomes.resolved_outcomes(rows, t(3)).collect()] == [0.1]
    forecasts = spark.createDataFrame([("a", "r", 1, 1, 0.8), ("a", "r", 1, 2, 0.4)], "agent string, run_id string, security_id long, horizon int, p double")
    got = {r.horizon: (r.n, round(r.brier, 6), r.hit_rate) for r in outcomes.agent_scores(rows, forecasts, F.col("ret") > 0, t(9)).collect()}
    assert got == {1: (1, 0.04, 1.0), 2: (1, 0.36, 0.0)}


def test_dates_are_fitted_together_without_leaks(spark):
    rng = np.random.default_rng(5)
    rows = [(s, at(k), {"a": float(rng.normal()), **({"b": float(rng.normal())} if s % 3 else {})}) for s in range(20) for k in (0, 5, 10)]
    labelled = [(s, e, e + dt.timedelta(days=3), bool(rng.random() < 0.4 + 0.1 * (v["a"] > 0))) for s, e, v in rows]
    features = spark.createDataFrame(rows, "security_id long, event_time timestamp_ntz, values map<string,double>")
    labels = spark.createDataFrame(labelled, "security_id long, feature_time timestamp_ntz, label_end timestamp_ntz, is_top_tercile boolean")
    dates = [F.to_timestamp_ntz(F.lit(str(at(k)))) for k in (2, 8, 20)]
    got = gate.fit_logistic_dates(features, labels, dates, ["a", "b"], iterations=25).collect()
    for m, k in zip(got, (2, 8, 20), strict=True):
        mine = [(v, y) for (_, _, v), (_, _, end, y) in zip(rows, labelled, strict=True) if end < at(k)]
        if not mine:
            assert m.intercept == 0 and m.coefficients == [0.0, 0.0]
            continue
        x = np.array([[v.get(n, np.nan) for n in "ab"] for v, _ in mine])
        y = np.array([float(t) for _, t in mine])
        mean, scale = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
        z = np.where(np.isnan(x), 0, (x - mean) / scale)
        b, w = math.log(y.mean() / (1 - y.mean())), np.zeros(2)
        for _ in range(25):
            e = 1 / (1 + np.exp(-(b + z @ w))) - y
            b, w = b - 0.08 * e.mean(), w - 0.08 * (z.T @ e / len(y) + 0.01 * w)
        assert np.allclose(m.coefficients, w, atol=1e-9) and math.isclose(m.intercept, b, abs_tol=1e-9) and np.allclose(m.means, mean) and np.allclose(m.scales, scale)


def test_partial_sums_are_added_in_spark_where_they_are_many(spark, monkeypatch):
    rows = spark.range(0, 100, 1, 6).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("int").alias("first"), F.lit(2).alias("last"))
    want = fits.summed(rows, ["x"], lambda m, x: x.sum(axis=0), 1, 3)
    monkeypatch.setattr(fits, "DRIVER_NUMBERS", 1)
    assert (fits.summed(rows, ["x"], lambda m, x: x.sum(axis=0), 1, 3) == want).all()
    assert want[:, 0].tolist() == [sum(i for i in range(100) if i % 3 <= m) for m in range(3)]


def test_walk_forward(spark):
    """Each date's model, scores, choice and weights by hand."""
    from tidemark.operators.sizing import Limits
    from tidemark.plans.features import walk_forward

    rng = np.random.default_rng(11)
    rows = [(s, at(k), {"a": float(rng.normal()), "b": float(rng.normal())}) for s in range(12) for k in (0, 10, 20)]
    labelled = [(s, e, e + dt.timedelta(days=5), bool(v["a"] + rng.normal() > 0)) for s, e, v in rows]
    features = spark.createDataFrame(rows, "security_id long, event_time timestamp_ntz, values map<string,double>")
    labels = spark.createDataFrame(labelled, "security_id long, feature_time timestamp_ntz, label_end timestamp_ntz, is_top_tercile boolean")
    sectors = spark.createDataFrame([(s, f"s{s % 5}") for s in range(12)], "security_id long, sector string")
    vols = spark.createDataFrame([(str(at(k)), s, 0.2) for s in range(12) for k in (10, 20)], "as_of string, security_id long, sigma double")
    dates = [F.to_timestamp_ntz(F.lit(str(at(k)))) for k in (10, 20)]
    limits = Limits(k=0.1)
    out = walk_forward(features, labels, dates, sectors, vols, 4, limits).collect()
    assert len(out) == 24
    for k in (10, 20):
        mine = [(v, y) for (_, _, v), (_, _, end, y) in zip(rows, labelled, strict=True) if end < at(k)]
        x, y = np.array([[v["a"], v["b"]] for v, _ in mine]), np.array([float(t) for _, t in mine])
        mean, scale = x.mean(axis=0), x.std(axis=0)
        z, b, w = (x - mean) / scale, math.log(y.mean() / (1 - y.mean())), np.zeros(2)
        for _ in range(300):
            e = 1 / (1 + np.exp(-(b + z @ w))) - y
            b, w = b - 0.08 * e.mean(), w - 0.08 * (z.T @ e / len(y) + 0.01 * w)
        score = {s: 1 / (1 + math.exp(-(b + ((np.array([v["a"], v["b"]]) - mean) / scale) @ w))) for s, e, v in rows if e == at(k)}
        got = {r.security_id: r for r in out if r.as_of == str(at(k))}
        best = sorted(score, key=lambda s: (-score[s], s))[:4]
        assert all(math.isclose(got[s].score, score[s], rel_tol=1e-9) for s in score) and {s for s in got if got[s].passed} == set(best)
        raw = {s: min(limits.k * (score[s] - 0.5) / 0.2, limits.max_position) if s in best and score[s] >= limits.entry_threshold else 0.0 for s in score}
        raw = {s: r if r >= limits.min_position else 0.0 for s, r in raw.items()}
        assert all(got[s].weight <= raw[s] + 1e-12 for s in score) and sum(r > 0 for r in raw.values()) >= sum(got[s].weight > 0 for s in score) > 0


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_join_over_split_keys(spark, direction):
    """A key with most of the rows, on both sides, gives what one window over it gives."""
    from tidemark.operators.asof import asof_join, asof_join_split

    rng = random.Random(9)
    side = lambda n, hot: [(rng.choice(["a", "b", "c"]) if rng.random() > hot else "hot", rng.randint(0, 400), k) for k in range(n)]
    left = spark.createDataFrame(side(500, 0.8), "k string, t int, l int")
    right = spark.createDataFrame(side(60, 0.6), "k string, u int, r int")
    run = lambda f: sorted(map(tuple, f(left, right, ["k"], "t", "u", ["r"], direction, ["r"]).collect()), key=str)
    assert run(asof_join_split) == run(asof_join)
