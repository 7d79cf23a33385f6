"""Queries of the historical gap study."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtests as B
from ..operators import metrics as M
from ..operators import series as S
from ..sources import adapters as A
from . import sqlbase as Q
from .core import query

H = 6


def leg(spark, sf, name):
    return A.bars(spark, sf, name)


def aligned(spark, sf, per_day):
    return S.daily_alignment(leg(spark, sf, "token"), leg(spark, sf, "equity"), per_day)


@query("premium_series", Q.with_(Q.PREMIUM) + " SELECT instrument, ts, token_close, perp_close, premium_pct FROM premium",
       "token_close perp_close premium_pct", 8)
def _(spark, sf):
    return S.premium_series(leg(spark, sf, "token"), leg(spark, sf, "perp"))


@query("deviation_series", Q.with_(Q.BARS) + """
  SELECT p.instrument, p.ts, p.close AS perp_close, t.close AS fair_value, (p.close - t.close) / t.close * 100 AS deviation_pct
  FROM bars p JOIN bars t ON p.instrument = t.instrument AND p.ts = t.ts
  WHERE p.leg = 'perp' AND t.leg = 'token' AND t.close > 0 AND p.close > 0""", "perp_close fair_value deviation_pct", 8)
def _(spark, sf):
    return S.deviation_series(leg(spark, sf, "perp"), leg(spark, sf, "token"))


ALIGNED = Q.BARS + """, aligned AS (
  SELECT t.instrument, t.ts, t.ts // 86400000 AS day, t.close AS token_close, e.close AS equity_close
  FROM bars t JOIN bars e ON t.instrument = e.instrument AND t.ts // 86400000 = e.ts // 86400000
  WHERE t.leg = 'token' AND e.leg = 'equity' AND t.close > 0 AND e.close > 0)"""


@query("daily_alignment", Q.with_(ALIGNED) + " SELECT instrument, day, ts, token_close, equity_close FROM aligned",
       "token_close equity_close", 8)
def _(spark, sf):
    return aligned(spark, sf, True)


CAPTURE = """ahead AS (
  SELECT *, abs(premium_pct) AS now_abs, abs(lead(premium_pct, 6) OVER (PARTITION BY instrument ORDER BY ts)) AS later
  FROM premium)"""
CAPTURE_COLS = """count(*) AS events, CAST(sum(CASE WHEN later < now_abs THEN 1 ELSE 0 END) AS BIGINT) AS captured,
  sum(CASE WHEN later < now_abs THEN 1.0::DOUBLE ELSE 0 END) / count(*) * 100 AS rate_pct, avg(now_abs - later) AS avg_narrowing_pct"""


@query("capture_by_instrument", Q.with_(Q.PREMIUM, CAPTURE) + f"""
  SELECT instrument, {CAPTURE_COLS} FROM ahead WHERE later IS NOT NULL AND now_abs >= 0.5 GROUP BY instrument""",
       "rate_pct avg_narrowing_pct")
def _(spark, sf):
    return S.capture(A.premium(spark, sf), 0.5, H)


@query("perp_convergence", Q.with_(Q.PREMIUM) + """, dev AS (
  SELECT instrument, ts, (perp_close - token_close) / token_close * 100 AS d FROM premium), ahead AS (
  SELECT instrument, abs(d) AS now_abs, abs(lead(d, 6) OVER (PARTITION BY instrument ORDER BY ts)) AS later FROM dev)
  SELECT instrument, """ + CAPTURE_COLS + """ FROM ahead WHERE later IS NOT NULL AND now_abs >= 0.5 GROUP BY instrument""",
       "rate_pct avg_narrowing_pct")
def _(spark, sf):
    return S.capture(deviation(spark, sf), 0.5, H, value="deviation_pct")


def deviation(spark, sf):
    p = A.premium(spark, sf)
    return p.select("instrument", "ts", "perp_close", F.col("token_close").alias("fair_value"),
                    ((F.col("perp_close") - F.col("token_close")) / F.col("token_close") * 100).alias("deviation_pct"))


@query("peg_tracking_error", Q.with_(Q.PREMIUM) + """, ahead AS (
  SELECT *, lead(token_close, 6) OVER (PARTITION BY instrument ORDER BY ts) AS f FROM premium)
  SELECT instrument, count(*) AS n, avg(abs(perp_close - f)) AS model_mae, avg(abs(token_close - f)) AS baseline_mae,
         coalesce((1 - avg(abs(perp_close - f)) / nullif(avg(abs(token_close - f)), 0)) * 100, 0) AS improvement_pct
  FROM ahead WHERE f IS NOT NULL GROUP BY instrument""", "model_mae baseline_mae improvement_pct")
def _(spark, sf):
    return S.peg_tracking(A.premium(spark, sf), H)


REVERSION = ALIGNED + """, rev0 AS (
  SELECT *, lag(equity_close) OVER w AS anchor, lead(token_close) OVER w AS nxt FROM aligned
  WINDOW w AS (PARTITION BY instrument ORDER BY ts)), rev AS (
  SELECT instrument, (token_close - anchor) / anchor AS gap, (nxt - token_close) / token_close AS ret,
         -(nxt - token_close) / token_close * sign((token_close - anchor) / anchor) AS reversion
  FROM rev0 WHERE anchor IS NOT NULL AND nxt IS NOT NULL)"""


@query("gap_reversion", Q.with_(REVERSION) + """
  SELECT instrument, CAST(sum(CASE WHEN abs(gap) * 100 >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS n,
    coalesce(avg(CASE WHEN abs(gap) * 100 >= 1 THEN reversion END) * 100, 0) AS reversion_return_pct,
    coalesce(avg(CASE WHEN abs(gap) * 100 >= 1 THEN CASE WHEN reversion > 0 THEN 1.0 ELSE 0 END END) * 100, 0) AS corrective_rate_pct,
    coalesce(avg(CASE WHEN abs(gap) * 100 >= 1 AND gap < 0 THEN ret END) * 100, 0) AS cheap_next_ret_pct,
    coalesce(avg(CASE WHEN abs(gap) * 100 >= 1 AND gap >= 0 THEN ret END) * 100, 0) AS rich_next_ret_pct,
    coalesce(avg(CASE WHEN NOT (abs(gap) * 100 >= 1) THEN abs(ret) END) * 100, 0) AS baseline_abs_ret_pct
  FROM rev GROUP BY instrument""",
       "reversion_return_pct corrective_rate_pct cheap_next_ret_pct rich_next_ret_pct baseline_abs_ret_pct")
def _(spark, sf):
    return S.gap_reversion(aligned(spark, sf, False), 1.0)


@query("gap_reversion_buckets", Q.with_(REVERSION) + """, labelled AS (
  SELECT CASE WHEN abs(gap) * 100 >= 4 THEN '4%+' WHEN abs(gap) * 100 >= 2 THEN '2-4%' WHEN abs(gap) * 100 >= 1 THEN '1-2%'
              WHEN abs(gap) * 100 >= 0.5 THEN '0.5-1%' END AS label, reversion FROM rev)
  SELECT b.label, count(l.label) AS n, coalesce(CAST(sum(CASE WHEN reversion > 0 THEN 1 ELSE 0 END) AS BIGINT), 0) AS corrective,
         coalesce(sum(reversion * 100), 0) AS reversion_sum_pct,
         CASE WHEN count(l.label) > 0 THEN sum(CASE WHEN reversion > 0 THEN 1.0::DOUBLE ELSE 0 END) / count(l.label) * 100 ELSE 0 END AS corrective_rate_pct,
         CASE WHEN count(l.label) > 0 THEN sum(reversion * 100) / count(l.label) ELSE 0 END AS reversion_return_pct
  FROM (VALUES ('0.5-1%'), ('1-2%'), ('2-4%'), ('4%+')) b(label) LEFT JOIN labelled l ON b.label = l.label GROUP BY b.label""",
       "reversion_sum_pct corrective_rate_pct reversion_return_pct")
def _(spark, sf):
    return S.gap_reversion_buckets(aligned(spark, sf, False))


@query("causal_zscore", Q.with_(Q.PREMIUM) + """
  SELECT instrument, ts, CASE WHEN count(*) OVER w < 20 THEN NULL WHEN max(premium_pct) OVER w = min(premium_pct) OVER w THEN 0
         ELSE (premium_pct - avg(premium_pct) OVER w) / stddev_pop(premium_pct) OVER w END AS z
  FROM premium WINDOW w AS (PARTITION BY instrument ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "z")
def _(spark, sf):
    return S.causal_zscore(A.premium(spark, sf), 20).select("instrument", "ts", "z")


@query("time_split_capture", Q.with_(Q.PREMIUM) + """, part AS (
  SELECT *, CASE WHEN idx < floor(n * 0.6) THEN 'in_sample' ELSE 'out_of_sample' END AS part FROM premium), ahead AS (
  SELECT part, abs(premium_pct) AS now_abs, abs(lead(premium_pct, 6) OVER (PARTITION BY instrument, part ORDER BY ts)) AS later FROM part)
  SELECT part, """ + CAPTURE_COLS + " FROM ahead WHERE later IS NOT NULL AND now_abs >= 0.5 GROUP BY part",
       "rate_pct avg_narrowing_pct")
def _(spark, sf):
    return S.capture(S.time_split(A.premium(spark, sf)), 0.5, H, by=["part"], keys=["instrument", "part"])


@query("fold_capture", Q.with_(Q.PREMIUM) + """, part AS (
  SELECT *, 1 + CASE WHEN idx >= floor(n * 1 / 4.0) THEN 1 ELSE 0 END + CASE WHEN idx >= floor(n * 2 / 4.0) THEN 1 ELSE 0 END
             + CASE WHEN idx >= floor(n * 3 / 4.0) THEN 1 ELSE 0 END AS fold FROM premium), ahead AS (
  SELECT fold, abs(premium_pct) AS now_abs, abs(lead(premium_pct, 6) OVER (PARTITION BY instrument, fold ORDER BY ts)) AS later FROM part)
  SELECT fold, """ + CAPTURE_COLS + " FROM ahead WHERE later IS NOT NULL AND now_abs >= 0.5 GROUP BY fold",
       "rate_pct avg_narrowing_pct")
def _(spark, sf):
    return S.capture(S.folds(A.premium(spark, sf), 4), 0.5, H, by=["fold"], keys=["instrument", "fold"])


HALF_LIFE = """hl AS (
  SELECT instrument, count(*) AS n, CASE WHEN count(*) >= 3 THEN regr_slope(premium_pct, x) END AS slope
  FROM (SELECT instrument, premium_pct, lag(premium_pct) OVER (PARTITION BY instrument ORDER BY ts) AS x FROM premium) GROUP BY instrument)"""


@query("half_life", Q.with_(Q.PREMIUM, HALF_LIFE) + """
  SELECT instrument, n, slope, CASE WHEN slope > 0 AND slope < 1 THEN -ln(2.0) / ln(slope) END AS half_life_bars FROM hl""",
       "slope half_life_bars")
def _(spark, sf):
    return S.half_life(A.premium(spark, sf))


@query("cross_sectional_stress", Q.with_(Q.PREMIUM) +
       " SELECT ts, avg(abs(premium_pct)) AS stress, count(*) AS tickers FROM premium GROUP BY ts", "stress")
def _(spark, sf):
    return S.cross_sectional_stress(A.premium(spark, sf))


@query("cross_section_map", Q.with_(Q.PREMIUM) + """
  SELECT ts, instrument, premium_pct FROM premium""", "premium_pct")
def _(spark, sf):
    wide = S.cross_section(A.premium(spark, sf))
    return wide.select("ts", F.explode("premiums").alias("instrument", "premium_pct"))


@query("stress_split", Q.with_(Q.PREMIUM, CAPTURE) + """, st AS (
  SELECT ts, avg(abs(premium_pct)) AS stress FROM premium GROUP BY ts), md AS (SELECT median(stress) AS m FROM st)
  SELECT CASE WHEN stress >= m THEN 'high' ELSE 'low' END AS stress_side, max(m) AS median_stress, count(*) AS events,
         CAST(sum(CASE WHEN later < now_abs THEN 1 ELSE 0 END) AS BIGINT) AS captured
  FROM ahead JOIN st USING (ts), md WHERE later IS NOT NULL AND now_abs >= 0.5 GROUP BY 1""", "median_stress")
def _(spark, sf):
    return S.stress_split(A.premium(spark, sf), 0.5, H)


@query("tracking_error", Q.with_(ALIGNED) + """, r AS (
  SELECT instrument, (token_close - equity_close) / equity_close * 100 AS prem,
         token_close / lag(token_close) OVER w - 1 AS tr, equity_close / lag(equity_close) OVER w - 1 AS er
  FROM aligned WINDOW w AS (PARTITION BY instrument ORDER BY day))
  SELECT instrument, count(*) AS n_days, avg(abs(prem)) AS mean_abs_premium_pct, stddev_pop(prem) AS stdev_premium_pct,
         max(abs(prem)) AS max_abs_premium_pct, CASE WHEN count(tr) >= 3 THEN corr(tr, er) END AS return_correlation
  FROM r GROUP BY instrument""", "mean_abs_premium_pct stdev_premium_pct max_abs_premium_pct return_correlation")
def _(spark, sf):
    return M.tracking_error(aligned(spark, sf, True))


TOKEN_QUALITY = Q.with_(ALIGNED) + """, tq AS (
  SELECT instrument, count(*) AS n_days, avg(abs((token_close - equity_close) / equity_close * 100)) AS ma,
         stddev_pop((token_close - equity_close) / equity_close * 100) AS sd FROM aligned GROUP BY instrument), sc AS (
  SELECT *, CASE WHEN n_days < 5 THEN 0 ELSE greatest(0, least(100, 100 - ma * 25)) END AS tracking_component,
         CASE WHEN n_days < 5 THEN 0 ELSE greatest(0, least(100, 100 - sd * 25)) END AS stability_component, 40.0::DOUBLE AS liquidity_component FROM tq), fin AS (
  SELECT *, CASE WHEN n_days < 5 THEN 0 ELSE 0.5 * tracking_component + 0.3 * stability_component + 0.2 * liquidity_component END AS quality_score FROM sc)
  SELECT instrument, n_days, CASE WHEN n_days < 5 THEN 'n/a' WHEN quality_score >= 85 THEN 'A' WHEN quality_score >= 70 THEN 'B'
         WHEN quality_score >= 55 THEN 'C' ELSE 'D' END AS grade, quality_score,
         CASE WHEN n_days < 5 THEN 'n/a' WHEN ma < 1.5 THEN 'tight' WHEN ma < 3 THEN 'loose' ELSE 'poor' END AS tracking_grade,
         tracking_component, stability_component, liquidity_component FROM fin"""


@query("token_quality", TOKEN_QUALITY,
       "quality_score tracking_component stability_component liquidity_component")
def _(spark, sf):
    return M.token_quality(M.tracking_error(aligned(spark, sf, True)))


WALK = Q.PREMIUM.replace("premium AS (", "premium AS MATERIALIZED (") + """, walk AS (
  SELECT instrument, -1::BIGINT AS idx, 0 AS side, 0.0::DOUBLE AS entry_p, 0::BIGINT AS entry_i,
         NULL::DOUBLE AS gross, NULL::BOOLEAN AS forced, NULL::BIGINT AS held, 0 AS was FROM (SELECT DISTINCT instrument FROM premium)
  UNION ALL
  SELECT s.instrument, s.idx,
    CASE WHEN s.side <> 0 THEN CASE WHEN s.conv OR s.late OR s.ends THEN 0 ELSE s.side END
         WHEN s.ends THEN 0 WHEN abs(s.p) >= 1.0 THEN CASE WHEN s.p < 0 THEN 1 ELSE -1 END ELSE 0 END,
    CASE WHEN s.side = 0 AND abs(s.p) >= 1.0 THEN s.p ELSE s.entry_p END,
    CASE WHEN s.side = 0 AND abs(s.p) >= 1.0 THEN s.idx ELSE s.entry_i END,
    CASE WHEN s.side <> 0 AND (s.conv OR s.late OR s.ends) THEN CASE WHEN s.side = 1 THEN s.p - s.entry_p ELSE s.entry_p - s.p END
         WHEN s.side = 0 AND s.ends AND abs(s.p) >= 1.0 THEN 0 END,
    CASE WHEN s.side <> 0 AND (s.conv OR s.late OR s.ends) THEN NOT s.conv WHEN s.side = 0 AND s.ends AND abs(s.p) >= 1.0 THEN true END,
    CASE WHEN s.side <> 0 AND (s.conv OR s.late OR s.ends) THEN s.idx - s.entry_i WHEN s.side = 0 AND s.ends AND abs(s.p) >= 1.0 THEN 0 END,
    s.side
  FROM (SELECT w.instrument, p.idx, w.side, w.entry_p, w.entry_i, p.premium_pct AS p, p.idx = p.n - 1 AS ends,
               CASE WHEN w.side = 1 THEN p.premium_pct >= -0.3 ELSE p.premium_pct <= 0.3 END AS conv, p.idx - w.entry_i >= 48 AS late
        FROM walk w JOIN premium p ON p.instrument = w.instrument AND p.idx = w.idx + 1) s)"""


@query("basis_backtest", "WITH RECURSIVE " + WALK + """
  SELECT instrument, count(*) AS trades, CAST(sum(CASE WHEN gross - 0.5 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins,
         CAST(sum(CASE WHEN gross - 0.5 > 0 THEN 0 ELSE 1 END) AS BIGINT) AS losses,
         CAST(sum(CASE WHEN forced THEN 1 ELSE 0 END) AS BIGINT) AS forced_exits,
         sum(CASE WHEN gross - 0.5 > 0 THEN 1.0::DOUBLE ELSE 0 END) / count(*) * 100 AS win_rate_pct,
         sum(gross - 0.5) AS total_pnl_pct, avg(gross - 0.5) AS avg_pnl_pct, avg(held) AS avg_hold_bars
  FROM walk WHERE gross IS NOT NULL GROUP BY instrument""", "win_rate_pct total_pnl_pct avg_pnl_pct avg_hold_bars")
def _(spark, sf):
    return B.basis_summary(B.basis_trades(A.premium(spark, sf)))


@query("cost_sweep", "WITH RECURSIVE " + WALK + """
  SELECT fee_pct, count(*) AS trades, avg(CASE WHEN gross - fee_pct > 0 THEN 100.0::DOUBLE ELSE 0 END) AS win_rate_pct,
         sum(gross - fee_pct) AS total_pnl_pct FROM walk, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE)) f(fee_pct) WHERE gross IS NOT NULL GROUP BY fee_pct""",
       "win_rate_pct total_pnl_pct", 5)
def _(spark, sf):
    return B.cost_sweep(B.basis_trades(A.premium(spark, sf)))


PERP_WALK = Q.PREMIUM.replace("premium AS (", "premium AS MATERIALIZED (") + """, dev AS MATERIALIZED (
  SELECT instrument, idx, perp_close AS px, (perp_close - token_close) / token_close * 100 AS d FROM premium), pwalk AS (
  SELECT instrument, -1::BIGINT AS idx, 0 AS side, 0.0::DOUBLE AS entry_px, 0::BIGINT AS entry_i, NULL::DOUBLE AS gross, NULL::BIGINT AS held
  FROM (SELECT DISTINCT instrument FROM dev)
  UNION ALL
  SELECT w.instrument, p.idx,
    CASE WHEN w.side = 0 THEN CASE WHEN p.d <= -1 THEN 1 WHEN p.d >= 1 THEN -1 ELSE 0 END WHEN abs(p.d) <= 0.3 THEN 0 ELSE w.side END,
    CASE WHEN w.side = 0 AND abs(p.d) >= 1 THEN p.px ELSE w.entry_px END,
    CASE WHEN w.side = 0 AND abs(p.d) >= 1 THEN p.idx ELSE w.entry_i END,
    CASE WHEN w.side <> 0 AND abs(p.d) <= 0.3 THEN w.side * (p.px - w.entry_px) / w.entry_px * 100 END,
    CASE WHEN w.side <> 0 AND abs(p.d) <= 0.3 THEN p.idx - w.entry_i END
  FROM pwalk w JOIN dev p ON p.instrument = w.instrument AND p.idx = w.idx + 1)"""


@query("perp_backtest", "WITH RECURSIVE " + PERP_WALK + """
  SELECT instrument, count(*) AS trades, CAST(sum(CASE WHEN gross - 0.12 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins,
         sum(CASE WHEN gross - 0.12 > 0 THEN 1.0::DOUBLE ELSE 0 END) / count(*) * 100 AS win_rate_pct,
         sum(gross - 0.12) AS total_pnl_pct, avg(gross - 0.12) AS avg_pnl_pct, avg(held) AS avg_hold_bars
  FROM pwalk WHERE gross IS NOT NULL GROUP BY instrument""", "win_rate_pct total_pnl_pct avg_pnl_pct avg_hold_bars")
def _(spark, sf):
    return B.basis_summary(B.perp_trades(deviation(spark, sf)), 0.12).drop("losses", "forced_exits")


CLAIR = Q.PREMIUM.replace("premium AS (", "premium AS MATERIALIZED (") + """, best AS (
  SELECT a.instrument, a.idx, abs(a.premium_pct) AS p0, min_by(b.idx, struct_pack(v := abs(b.premium_pct), i := b.idx)) AS j, min(abs(b.premium_pct)) AS pj
  FROM premium a JOIN premium b ON a.instrument = b.instrument AND b.idx BETWEEN a.idx + 1 AND a.idx + 48
  WHERE abs(a.premium_pct) >= 1.0 GROUP BY ALL), jumps AS MATERIALIZED (
  SELECT instrument, idx, j, p0 - pj - 0.5 AS net, row_number() OVER (PARTITION BY instrument ORDER BY idx) AS r FROM best WHERE p0 - pj - 0.5 > 0), cwalk AS (
  SELECT instrument, 0::BIGINT AS r, -1::BIGINT AS busy, 0::BIGINT AS n, 0.0::DOUBLE AS pnl FROM (SELECT DISTINCT instrument FROM jumps)
  UNION ALL
  SELECT w.instrument, x.r, CASE WHEN x.idx > w.busy THEN x.j ELSE w.busy END, CASE WHEN x.idx > w.busy THEN w.n + 1 ELSE w.n END,
         CASE WHEN x.idx > w.busy THEN w.pnl + x.net ELSE w.pnl END
  FROM cwalk w JOIN jumps x ON x.instrument = w.instrument AND x.r = w.r + 1)"""


@query("clairvoyant_bound", "WITH RECURSIVE " + CLAIR + """
  SELECT instrument, max(n) AS opportunities, max_by(pnl, r) AS max_pnl_pct FROM cwalk GROUP BY instrument""", "max_pnl_pct")
def _(spark, sf):
    return B.clairvoyant(A.premium(spark, sf))


@query("clairvoyant_share", "WITH RECURSIVE " + WALK + ", " + CLAIR.split(", best AS", 1)[1].join([" best AS", ""]) + """
  SELECT w.instrument, w.pnl / c.pnl * 100 AS captured_pct_of_max FROM
   (SELECT instrument, sum(gross - 0.5) AS pnl FROM walk WHERE gross IS NOT NULL GROUP BY instrument) w JOIN
   (SELECT instrument, max_by(pnl, r) AS pnl FROM cwalk GROUP BY instrument) c USING (instrument) WHERE c.pnl > 0""",
       "captured_pct_of_max")
def _(spark, sf):
    p = A.premium(spark, sf)
    real = B.basis_summary(B.basis_trades(p)).select("instrument", "total_pnl_pct")
    return real.join(B.clairvoyant(p), "instrument").filter(F.col("max_pnl_pct") > 0).select(
        "instrument", (F.col("total_pnl_pct") / F.col("max_pnl_pct") * 100).alias("captured_pct_of_max"))
