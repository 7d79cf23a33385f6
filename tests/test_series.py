"""Series operators and backtests on small series, with look-ahead and chunking checks."""
from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gapscope.operators import backtests as B
from gapscope.operators import controls as C
from gapscope.operators import metrics as M
from gapscope.operators import series as S

DAY = 86_400_000


def premium(spark, values, instrument="X"):
    rows = [(instrument, i * DAY, 100.0 + v, 100.0, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "instrument string, ts long, token_close double, perp_close double, premium_pct double")


def bars(spark, pairs, name="X"):
    return spark.createDataFrame([(name, t, float(c), i) for i, (t, c) in enumerate(pairs)], "instrument string, ts long, close double, seq long")


def test_premium_series_last_perp_wins_and_bad_closes_drop(spark):
    token = bars(spark, [(1, 101), (2, 0), (3, 103)])
    perp = bars(spark, [(1, 90), (1, 100), (2, 100), (3, -1)])
    rows = S.premium_series(token, perp, "seq").collect()
    assert [(r["ts"], r["premium_pct"]) for r in rows] == [(1, pytest.approx(1.0))]


def test_capture_counts_only_points_with_a_future(spark):
    r = S.capture(premium(spark, [1.0, 0.2, 0.9, 1.5]), 0.5, 1).first()
    assert (r["events"], r["captured"]) == (2, 1)
    assert r["avg_narrowing_pct"] == pytest.approx((0.8 + -0.6) / 2)


def test_basis_trades_close_at_stop_and_at_end(spark):
    trades = B.basis_trades(premium(spark, [-2, -1.5, -0.1, 3, 2.5, 2, 1.9]), 1.0, 0.3, 3).orderBy("entry_idx").collect()
    assert [(t["entry_idx"], t["exit_idx"], t["side"], t["forced"]) for t in trades] == [(0, 2, 1, False), (3, 6, -1, True)]
    assert trades[0]["gross_pct"] == pytest.approx(1.9)
    assert trades[1]["gross_pct"] == pytest.approx(1.1)


def loop_backtest(values, entry, exit_, hold):
    pos, out = None, []
    for i, p in enumerate(values):
        if pos is None:
            if abs(p) >= entry:
                pos = (1 if p < 0 else -1, p, i)
        else:
            side, p0, i0 = pos
            conv = p >= -exit_ if side == 1 else p <= exit_
            if conv or i - i0 >= hold:
                out.append((i0, i, side, round(side * (p - p0), 9), not conv))
                pos = None
    if pos is not None:
        out.append((pos[2], len(values) - 1, pos[0], round(pos[0] * (values[-1] - pos[1]), 9), True))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_episodes_equal_the_sequential_walk(spark, seed):
    rng = random.Random(seed)
    values = [rng.gauss(0, 1.2) for _ in range(400)]
    got = B.basis_trades(premium(spark, values), 1.0, 0.3, 5).orderBy("entry_idx").collect()
    assert [(t["entry_idx"], t["exit_idx"], t["side"], round(t["gross_pct"], 9), t["forced"]) for t in got] == loop_backtest(values, 1.0, 0.3, 5)


def loop_clairvoyant(values, entry, fee, hold):
    busy, n, total = -1, 0, 0.0
    for i, p in enumerate(values):
        ahead = [(abs(q), j) for j, q in enumerate(values) if i < j <= i + hold]
        if i > busy and abs(p) >= entry and ahead and abs(p) - min(ahead)[0] - fee > 0:
            n, total, busy = n + 1, total + abs(p) - min(ahead)[0] - fee, min(ahead)[1]
    return n, round(total, 9)


@pytest.mark.parametrize("chunk_bars, group", [(5, 2), (7, 3), (16, 1024), (1024, 1024)])
@pytest.mark.parametrize("shape", ["noise", "never_in_band", "flips"])
def test_chunked_walks_equal_the_sequential_ones(spark, shape, chunk_bars, group):
    """Also on a series without one bar inside the exit band, where nothing but the time stop ends a trade."""
    rng = random.Random(chunk_bars)
    make = {"noise": lambda: rng.gauss(0, 1.2), "never_in_band": lambda: 1.5 + rng.random(), "flips": lambda: rng.choice([-1, 1]) * (0.5 + rng.random())}[shape]
    values, other = [make() for _ in range(203)], [make() for _ in range(chunk_bars)]
    both = premium(spark, values).unionByName(premium(spark, other).withColumn("instrument", F.lit("other")))
    got = B.basis_trades(both, 1.0, 0.3, 5, chunk_bars=chunk_bars, group=group).orderBy("instrument", "entry_idx").collect()
    for name, series in (("X", values), ("other", other)):
        mine = [t for t in got if (t["instrument"] == "other") == (name == "other")]
        assert [(t["entry_idx"], t["exit_idx"], t["side"], round(t["gross_pct"], 9), t["forced"]) for t in mine] == loop_backtest(series, 1.0, 0.3, 5)
    bound = {r["instrument"] == "other": (r["opportunities"], round(r["max_pnl_pct"], 9)) for r in B.clairvoyant(both, 1.0, 0.1, 5, chunk_bars=chunk_bars, group=group).collect()}
    want = {name == "other": loop_clairvoyant(series, 1.0, 0.1, 5) for name, series in (("X", values), ("other", other))}
    assert bound == {k: v for k, v in want.items() if v[0]}


def test_perp_trades_drop_an_open_position(spark):
    df = spark.createDataFrame([("X", i * DAY, px, d) for i, (px, d) in enumerate([(100.0, 2.0), (98.0, 0.1), (97.0, -1.5), (99.0, -0.9)])],
                               "instrument string, ts long, perp_close double, deviation_pct double")
    t = B.perp_trades(df, 1.0, 0.3).collect()
    assert [(x["entry_idx"], x["exit_idx"], x["side"]) for x in t] == [(0, 1, -1)]
    assert t[0]["gross_pct"] == pytest.approx(2.0)


def test_clairvoyant_never_overlaps(spark):
    r = B.clairvoyant(premium(spark, [2, 1.8, 0.1, 2, 0.0, 0.2]), 1.0, 0.5, 10).first()
    assert r["opportunities"] == 1  # the first entry already reaches the best exit at bar 4
    assert r["max_pnl_pct"] == pytest.approx(2 - 0.0 - 0.5)


def test_future_values_do_not_move_causal_columns(spark):
    rng = random.Random(3)
    a = [rng.gauss(0, 1) for _ in range(60)]
    b = a[:40] + [9e3] * 20
    z = lambda v: [r["z"] for r in S.causal_zscore(premium(spark, v), 10).orderBy("ts").collect()][:40]
    assert z(a) == pytest.approx(z(b), abs=1e-9, nan_ok=True)


def test_split_rows_gives_the_same_columns(spark):
    rng = random.Random(5)
    p = premium(spark, [rng.gauss(0, 1) for _ in range(200)])
    assert S.capture(p, 0.5, 6).collect() == S.capture(p, 0.5, 6, split_rows=16).collect()
    plain = [r["z"] for r in S.causal_zscore(p, 8).orderBy("ts").collect()]
    assert plain == pytest.approx([r["z"] for r in S.causal_zscore(p, 8, split_rows=20).orderBy("ts").collect()], nan_ok=True)


def test_gap_reversion_anchors_on_the_previous_close(spark):
    token, stock = bars(spark, [(i * DAY, c) for i, c in enumerate([100, 97, 99, 104, 101])]), bars(spark, [(i * DAY, 100) for i in range(5)])
    r = S.gap_reversion(S.daily_alignment(token, stock, False), 1.0).first()
    assert r["n"] == 3
    assert r["cheap_next_ret_pct"] > 0 > r["rich_next_ret_pct"]


def test_tracking_needs_three_returns_for_correlation(spark):
    token, stock = bars(spark, [(i * DAY, 100 + i) for i in range(3)]), bars(spark, [(i * DAY, 100) for i in range(3)])
    t = M.tracking_error(S.daily_alignment(token, stock, True))
    r = t.first()
    assert r["n_days"] == 3 and r["return_correlation"] is None
    assert r["max_abs_premium_pct"] == pytest.approx(2.0)
    assert M.token_quality(t).first()["grade"] == "n/a"


def test_risk_figures_use_null_for_infinity(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, -1.0), ("b", 2, 0.5)], "k string, i long, r double")
    rows = {r["k"]: r for r in M.risk_adjusted(df, ["k"], ["i"], "r").collect()}
    assert rows["a"]["profit_factor"] is None and rows["a"]["sortino"] is None and rows["a"]["max_drawdown"] == 0
    assert rows["b"]["profit_factor"] == pytest.approx(0.5) and rows["b"]["max_drawdown"] == pytest.approx(1.0)


def test_moments_small_samples(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("b", 4.0), ("b", 9.0)], "k string, x double")
    rows = {r["k"]: r for r in M.moments(df, ["k"], "x").collect()}
    assert (rows["a"]["skew"], rows["a"]["kurtosis"]) == (0.0, 3.0)
    assert rows["b"]["kurtosis"] == pytest.approx(2.0)


def test_reliability_last_bucket_is_closed(spark):
    df = spark.createDataFrame([(1.0, True), (0.8, False), (0.1, True)], "p double, o boolean")
    rows = M.reliability_buckets(df, "p", F.col("o")).orderBy("bucket").collect()
    assert [r["n"] for r in rows] == [1, 0, 0, 0, 2]


def python_draws(seed, count):
    out, a = [], seed & 0xFFFFFFFF
    imul = lambda x, y: (x * y) & 0xFFFFFFFF
    for _ in range(count):
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = imul(a ^ (a >> 15), 1 | a)
        t = ((t + imul(t ^ (t >> 7), 61 | t)) & 0xFFFFFFFF) ^ t
        out.append(((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296)
    return out


def test_bootstrap_equals_the_sequential_generator(spark):
    xs = [0.5, -0.2, 1.5, 0.7, 0.1, -1.0, 2.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")
    r = C.bootstrap_mean_ci(df, "x", ["i"], None, iters=200, seed=99).first()
    draws = iter(python_draws(99, 200 * len(xs)))
    means = sorted(sum(xs[int(next(draws) * len(xs))] for _ in xs) / len(xs) for _ in range(200))
    assert (r["lo"], r["hi"]) == (pytest.approx(means[5]), pytest.approx(means[195]))


def test_overfitting_of_a_dominant_strategy_is_zero(spark):
    rows = [(c, f"s{t:02d}", 10.0 if c == "good" else float((hash((c, t)) % 7) - 3)) for c in ("good", "b", "c", "d") for t in range(10)]
    df = spark.createDataFrame(rows, "config_id string, session string, net_pnl double")
    r = C.backtest_overfitting(df, 10).first()
    assert (r["status"], r["pbo"], r["splits"]) == ("computed", 0.0, 252)
    assert C.backtest_overfitting(df, 7).first()["status"] == "insufficient_slices"
