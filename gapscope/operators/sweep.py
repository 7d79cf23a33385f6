"""Strategy search: rule sweeps over session ticks, aggregation, selection and robustness."""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import product
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.numeric import clamp
from .ordered import with_row

START_BALANCE = 1000.0
FEE = 0.001

# The standard search grid.
STANDARD_GRID = {
    "source": ["equity_gap", "perp_gap"], "direction": ["momentum", "fade"], "entry_pct": [0.1, 0.2, 0.35, 0.5, 0.75],
    "exit_pct": [0.0, 0.1], "take_profit_pct": [0.75, 1.25, 2.0], "stop_loss_pct": [0.75, 1.25, 2.5], "max_hold": [15, 30, 9999],
}
SIZING_GRID = {"notional_pct": [0.2, 0.35, 0.5], "max_concurrent": [2, 5, 8]}


def with_grid(df: DataFrame, axes: Mapping[str, Sequence], index: str = "grid_index") -> DataFrame:
    """Repeat each row for every combination of the axes.

    One generated index is decoded into the axis values, so no second table is joined.
    """
    size = prod(len(v) for v in axes.values())
    out = df.withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    rest = F.col(index)
    columns = {}
    for name, values in reversed(list(axes.items())):
        columns[name] = F.get(F.array(*[F.lit(v) for v in values]), (rest % len(values)).cast("int"))
        rest = F.floor(rest / len(values))
    return out.select("*", *[columns[n].alias(n) for n in axes])


def config_id(*names: str) -> Column:
    return F.concat_ws("_", *[F.concat(F.lit(n[:2]), F.regexp_replace(F.col(n).cast("string"), r"\.", "p")) for n in names])


RULE_COLUMNS = ("source", "direction", "entry_pct", "exit_pct", "take_profit_pct", "stop_loss_pct", "max_hold")
RULE_TYPES = {"source": "string", "direction": "string", "max_hold": "long"}
CONFIGS_PER_TASK = 2000


def grid_configs(axes: Mapping[str, Sequence]) -> pd.DataFrame:
    """All combinations of the axes that keep the exit within the entry, numbered in axis order."""
    rows = pd.DataFrame(list(product(*axes.values())), columns=list(axes))
    rows.insert(0, "grid_index", np.arange(len(rows), dtype="int64"))
    return rows[rows["exit_pct"] <= rows["entry_pct"]].reset_index(drop=True)


def session_series(ticks: DataFrame) -> DataFrame:
    """Ticks of each (session, ticker) in order as arrays, with the session's last tick.

    One row per snapshot, so the arrays are bounded by the length of a session.
    """
    bar = F.struct(F.col("tick").alias("i"), "true_gap_pct", "premium_pct", "price")
    ends = ticks.groupBy("session").agg(F.max("tick").alias("session_end"))
    series = ticks.groupBy("session", "ticker").agg(F.array_sort(F.collect_list(bar)).alias("b")).join(ends, "session")
    return series.select("session", "ticker", "session_end", *[F.col(f"b.{c}").alias(c) for c in ("i", "true_gap_pct", "premium_pct", "price")])


def _walk(bars: tuple, end: int, c: dict) -> pd.DataFrame:
    """Trades of all rule sets over one series: a loop over ticks, vectors over rule sets."""
    ticks, true_gap, perp_gap, prices = bars
    n = len(c["entry_pct"])
    is_open, entry, entry_i = np.zeros(n, bool), np.zeros(n), np.zeros(n, "int64")
    traded = np.zeros(n, bool)
    found = []

    def note(mask, exit_i, ratio, reason):
        at = np.flatnonzero(mask)
        traded[at] = True
        found.append(pd.DataFrame({"__c": at, "entry_i": entry_i[at], "exit_i": exit_i, "ratio": ratio[at], "reason": reason[at]}))

    with np.errstate(invalid="ignore", divide="ignore"):
        for i, tg, pg, price in zip(ticks, true_gap, perp_gap, prices):
            if not price > 0:
                continue
            g = np.where(c["equity"], tg, pg)
            pnl = (price - entry) / entry * 100
            rules = [pnl >= c["take_profit_pct"], pnl <= -c["stop_loss_pct"], i - entry_i >= c["max_hold"],
                     np.where(c["momentum"], g <= c["exit_pct"], g >= -c["exit_pct"])]
            closes = is_open & np.logical_or.reduce(rules)
            if closes.any():
                note(closes, i, price / entry, np.select(rules, ["take_profit", "stop_loss", "max_hold", "signal_exit"], ""))
            opens = np.where(c["momentum"], g >= c["entry_pct"], g <= -c["entry_pct"]) & (~is_open | closes)
            is_open = opens | (is_open & ~closes)
            entry, entry_i = np.where(opens, price, entry), np.where(opens, i, entry_i)
        if is_open.any():
            last = prices[-1] if ticks[-1] == end else np.nan
            note(is_open, end, np.where(np.isnan(last), entry, last) / entry, np.full(n, "final_close", dtype=object))
    idle = np.flatnonzero(~traded)
    found.append(pd.DataFrame({"__c": idle, "entry_i": pd.array([None] * len(idle), "Int64"), "exit_i": pd.array([None] * len(idle), "Int64"),
                               "ratio": np.nan, "reason": None}))
    return pd.concat([f.astype({"entry_i": "Int64", "exit_i": "Int64"}) for f in found], ignore_index=True)


def anchored_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks of snapshots in which some row has an anchor, numbered anew within their session from 0."""
    kept = ticks.filter(F.col("equity_price").isNotNull()).select("session", "tick").distinct()
    place = F.row_number().over(Window.partitionBy("session").orderBy("tick")) - 1  # one row per snapshot of a session
    return ticks.join(kept.withColumn("__i", place.cast(ticks.schema["tick"].dataType)), ["session", "tick"]).withColumn("tick", F.col("__i")).drop("__i")


def sweep_trades(ticks: DataFrame, configs: pd.DataFrame | Mapping[str, Sequence] = STANDARD_GRID, config: Sequence[str] = ("grid_index",)) -> DataFrame:
    """Trades of every rule set on every (session, ticker), as independent sleeves.

    ``ticks``: session, ticker, tick, true_gap_pct, premium_pct, price. ``configs``: axes of a grid, or a small
    table of rule columns named by ``config``. Spark spreads (session, ticker, block of rule sets); inside,
    rule sets are numpy vectors. ``ratio`` is exit over entry price; a rule set without trades on a series
    keeps one row without a ratio. Rows name their rule set only; ``with_rules`` adds its columns. Where ``ticks`` has
    an ``equity_price``, snapshots in which no row has one are dropped first, and holds count the snapshots that stay.
    """
    if "equity_price" in ticks.columns:
        ticks = anchored_ticks(ticks)
    table = configs if isinstance(configs, pd.DataFrame) else grid_configs(configs)
    table = table[[*config, *RULE_COLUMNS]].reset_index(drop=True)
    blocks = range(0, len(table), CONFIGS_PER_TASK)
    runs = session_series(ticks).withColumn("__block", F.explode(F.array(*[F.lit(b) for b in blocks])))
    runs = runs.repartition(F.col("session"), F.col("ticker"), F.col("__block"))
    kinds = {c: "long" if str(table[c].dtype).startswith("int") else "string" for c in config}
    schema = ("session string, ticker string, " + ", ".join(f"{c} {kinds[c]}" for c in config)
              + ", entry_i long, exit_i long, ratio double, reason string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                part = table.iloc[row[-1]:row[-1] + CONFIGS_PER_TASK].reset_index(drop=True)
                c = {k: part[k].to_numpy("float64") for k in RULE_COLUMNS if k not in ("source", "direction")}
                c["equity"], c["momentum"] = (part["source"] == "equity_gap").to_numpy(), (part["direction"] == "momentum").to_numpy()
                bars = (np.asarray(row.i, "int64"), *[np.asarray(x, "float64") for x in (row.true_gap_pct, row.premium_pct, row.price)])
                trades = _walk(bars, int(row.session_end), c)
                out = part[list(config)].take(trades.pop("__c")).reset_index(drop=True)
                yield pd.concat([out, trades], axis=1).assign(session=row.session, ticker=row.ticker)[
                    ["session", "ticker", *config, "entry_i", "exit_i", "ratio", "reason"]]

    out = runs.select("session", "ticker", "session_end", "i", "true_gap_pct", "premium_pct", "price", "__block").mapInPandas(run, schema)
    return out.withColumn("ratio", F.when(~F.isnan("ratio"), F.col("ratio")))


def with_rules(df: DataFrame, configs: pd.DataFrame | Mapping[str, Sequence] = STANDARD_GRID, config: Sequence[str] = ("grid_index",)) -> DataFrame:
    """Add the rule columns of each rule set; the table is a parameter of the search."""
    table = configs if isinstance(configs, pd.DataFrame) else grid_configs(configs)
    rules = df.sparkSession.createDataFrame(table[[*config, *RULE_COLUMNS]])
    return df.join(F.broadcast(rules), list(config))


def sweep_trials(trades: DataFrame, config: Sequence[str] = ("grid_index",)) -> DataFrame:
    """One row per (rule set, session) on a unit notional: counts, return, fees, realised drawdown."""
    net = F.col("ratio") * (1 - FEE) - (1 + FEE)
    keys = [*config, "session"]
    rows = trades.select(*keys, "exit_i", F.coalesce(net, F.lit(0.0)).alias("net"), F.col("ratio").isNotNull().cast("int").alias("trade"),
                         F.when(F.col("ratio") * (1 - FEE) >= 1, 1).otherwise(0).alias("win"),
                         F.coalesce((1 + F.col("ratio")) * FEE, F.lit(0.0)).alias("fee"))
    steps = rows.groupBy(*keys, "exit_i").agg(*[F.sum(c).alias(c) for c in ("net", "trade", "win", "fee")])
    # One row per (rule set, session, tick): bounded by the length of a session.
    w = Window.partitionBy(*keys).orderBy("exit_i").rowsBetween(Window.unboundedPreceding, 0)
    path = steps.withColumn("eq", F.sum("net").over(w))
    path = path.withColumn("fall", F.greatest(F.lit(0.0), F.max("eq").over(w)) - F.col("eq"))
    return path.groupBy(*keys).agg(
        F.sum("trade").alias("trades"), F.sum("win").alias("wins"), (F.sum("trade") - F.sum("win")).alias("losses"),
        F.sum("net").alias("unit_return"), F.sum("fee").alias("unit_fees"), F.max("fall").alias("unit_drawdown"))


def size_trials(trials: DataFrame, sizing: Mapping[str, Sequence] = SIZING_GRID) -> DataFrame:
    """Trials of every sizing. Sleeves are independent, so PnL scales with the notional and is not run again."""
    sized = with_grid(trials, sizing, "size_index")
    scale = START_BALANCE * F.col("notional_pct")
    order = F.col("grid_index") * prod(len(v) for v in sizing.values()) + F.col("size_index")
    return sized.select(
        order.cast("long").alias("config_order"), F.format_string("cfg_%06d", order.cast("long")).alias("config_id"), "grid_index", *sizing,
        F.lit(FEE * 100).alias("fee_pct"), "session", "trades", "wins", "losses", F.round(F.col("unit_return") * scale, 6).alias("net_pnl"),
        F.round(F.col("unit_drawdown") * scale, 6).alias("max_drawdown"), F.round(F.col("unit_fees") * scale, 6).alias("fees"))


def strategy_aggregate(trials: DataFrame, by: Sequence[str] = ("config_id",)) -> DataFrame:
    """Totals, stability, robustness and reject reasons per configuration."""
    p = F.col("net_pnl")
    agg = trials.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(F.when(F.col("trades") > 0, 1).otherwise(0)).alias("active"),
        F.sum(F.when(p > 0, 1).otherwise(0)).alias("positive"), F.round(F.sum(p), 6).alias("total_pnl"), F.avg(p).alias("avg_pnl"),
        F.median(p).alias("median_pnl"), F.min(p).alias("worst_pnl"), F.max("max_drawdown").alias("max_drawdown"),
        F.sum("trades").alias("total_trades"), F.sum("wins").alias("total_wins"), F.sum("losses").alias("total_losses"),
        F.when(F.count(p) >= 2, F.stddev_samp(p)).otherwise(0.0).alias("__vol"), (F.max(p) == F.min(p)).alias("__flat"))
    total, dd = F.col("total_pnl"), F.col("max_drawdown")
    vol = F.when(F.col("__flat"), 0.0).otherwise(F.col("__vol"))
    stability = F.when(vol == 0, F.when(total >= 0, 100.0).otherwise(0.0)).otherwise(clamp(50 + total / vol, 0, 100))
    penalty = F.when(dd > 0, F.least(F.lit(40.0), dd * 2)).otherwise(0.0) + F.when(F.col("active") == 0, 40.0).otherwise(0.0)
    reasons = F.array_compact(F.array(
        F.when(F.col("total_trades") == 0, F.lit("NO_TRADES")), F.when(total <= 0, F.lit("NON_POSITIVE_TOTAL_PNL")),
        F.when(F.col("worst_pnl") < -5, F.lit("WORST_SESSION_LOSS_GT_5_USDT")),
        F.when(dd > F.greatest(F.lit(10.0), F.abs(total) * 0.75), F.lit("DRAWDOWN_TOO_LARGE_VS_PNL")),
        F.when((F.col("active") > 1) & (F.col("positive") / F.col("active") < 0.5), F.lit("LOW_ACTIVE_SESSION_HIT_RATE"))))
    out = agg.withColumn("stability_score", stability)
    robust = F.greatest(F.lit(0.0), total + F.col("positive") * 5 + F.col("stability_score") * 0.2 - penalty)
    decided = F.col("total_wins") + F.col("total_losses")
    return out.select(
        *by, "sessions", "active", "positive", "total_pnl", "avg_pnl", "median_pnl", "worst_pnl", "max_drawdown", "total_trades",
        F.coalesce(F.when(decided > 0, F.col("total_wins") / decided), F.lit(0.0)).alias("win_rate"), "stability_score",
        robust.alias("robustness_score"), F.when(F.size(reasons) > 0, "REJECT").otherwise("PASS").alias("verdict"),
        F.concat_ws("|", reasons).alias("reasons"))


def session_index(trials: DataFrame) -> DataFrame:
    """Position of each session; sessions are a small dimension."""
    return trials.select("session").distinct().withColumn("pos", F.row_number().over(Window.orderBy("session")) - 1)


def leave_one_out(trials: DataFrame, embargo: int = 1) -> DataFrame:
    """Best configuration per held-out session, trained on the sessions outside the embargo around it.

    Training totals are the configuration's total minus the embargoed sessions, so nothing is joined
    pairwise. A configuration has at most one trial per session and may lack some; sessions are a small
    dimension. Configurations without training trades are skipped and the earliest wins ties.
    """
    pos = session_index(trials)
    rows = trials.select("config_order", "config_id", "session", "net_pnl", "trades").join(F.broadcast(pos), "session")
    cell = F.struct("pos", F.struct("net_pnl", "trades").alias("t"))
    per = rows.groupBy("config_order", "config_id").agg(
        F.sum("net_pnl").alias("total_pnl"), F.sum("trades").alias("total_trades"), F.map_from_entries(F.collect_list(cell)).alias("by_pos"))
    held = pos.agg(F.sort_array(F.collect_list(F.struct("pos", "session"))).alias("held"))
    folds = with_row(per, held).withColumn("h", F.explode("held"))
    at = lambda d, f: F.coalesce(F.col("by_pos")[F.col("h.pos") + d][f], F.lit(0))
    near = lambda f: sum((at(d, f) for d in range(-embargo, embargo + 1)), F.lit(0))
    train = folds.select(
        "config_order", "config_id", F.col("h.session").alias("session"), F.round(F.col("total_pnl") - near("net_pnl"), 6).alias("train_pnl"),
        (F.col("total_trades") - near("trades")).alias("train_trades"), at(0, "net_pnl").alias("test_pnl"), at(0, "trades").alias("test_trades"))
    pick = F.max_by(F.struct("config_id", "train_pnl", "train_trades", "test_pnl", "test_trades"),
                    F.when(F.col("train_trades") > 0, F.struct("train_pnl", -F.col("config_order"))))
    return train.groupBy("session").agg(pick.alias("p")).select("session", F.col("p.config_id").alias("selected_config"), "p.train_pnl",
                                                                 "p.train_trades", "p.test_pnl", "p.test_trades")


def session_best(trials: DataFrame) -> DataFrame:
    """Best configuration of each session; the earliest wins ties."""
    best = F.max_by(F.struct("config_id", "net_pnl", "trades"), F.struct("net_pnl", -F.col("config_order")))
    return trials.groupBy("session").agg(best.alias("b")).select("session", "b.*")


def leaderboard(trials: DataFrame, n: int = 250) -> DataFrame:
    return trials.orderBy(F.col("net_pnl").desc(), "config_order", "session").limit(n)


def championship(trials: DataFrame, token_pnl: DataFrame, universe_size: int = 19) -> DataFrame:
    """Objective scores and stress figures per configuration.

    ``token_pnl``: config_id, ticker, pnl. Leave-one-out minima come from the total minus the largest part.
    """
    p = F.col("net_pnl")
    agg = trials.groupBy("config_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(p).alias("net"), F.greatest(F.lit(0.0), F.max("max_drawdown")).alias("max_dd"),
        F.sum("fees").alias("fees"), F.sum("trades").alias("trades"), F.max(p).alias("__best"))
    tokens = token_pnl.groupBy("config_id").agg(F.max("pnl").alias("__token"))
    rows = agg.join(tokens, "config_id", "left")
    net, fees = F.col("net"), F.col("fees")
    rows = rows.withColumn("blocks", F.greatest(F.lit(0), F.col("sessions") * universe_size - F.col("trades")))
    scores = R.objective_scores(net, F.col("max_dd"), fees, F.col("trades"), F.col("blocks") * 0.03, F.col("blocks") * 0.005, F.lit(0.0))
    out = rows.select(
        "config_id", "sessions", "trades", "blocks", "net", "max_dd", "fees", *[c.alias(f"score_{n}") for n, c in scores.items()],
        (net - fees * 0.2).alias("cost_stress_pnl"), (net - F.col("__best")).alias("min_leave_one_session_pnl"),
        (net - F.coalesce("__token", F.lit(0.0))).alias("leave_one_token_out_pnl"),
        (net - F.abs(net) * 0.08 - fees * 0.05).alias("threshold_minus_10_pnl"),
        (net - F.abs(net) * 0.12 - fees * 0.05).alias("threshold_plus_10_pnl"),
        F.when(net > 0, F.greatest(F.lit(0.0), F.col("__best") / net)).otherwise(1.0).alias("profit_concentration"))
    return out.withColumn("overfit_status", R.robustness_label(F.col("score_pnl"), F.col("score_safety"),
                                                               F.col("min_leave_one_session_pnl"), F.col("cost_stress_pnl")))


def champion_lanes(scored: DataFrame, safe: Column, locks: Mapping[str, str] | None = None) -> DataFrame:
    """Best safe candidate per objective; a locked lane keeps its champion."""
    lanes = ("pnl", "safety", "capital", "liquidity")
    picks = [F.coalesce(F.lit((locks or {}).get(lane)), F.min_by("config_id", F.when(safe, F.struct(-F.round(f"score_{lane}", 9), "config_id")))).alias(lane)
             for lane in lanes]
    wide = scored.agg(*picks)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("lane"), F.col(n).alias("champion")) for n in lanes])).alias("l")).select("l.*")


def expected_vs_actual(sessions: DataFrame) -> DataFrame:
    """Mean PnL of the earlier sessions (0 before the first) against each session's own."""
    w = Window.orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    expected = F.coalesce(F.avg("net_pnl").over(w), F.lit(0.0))
    return sessions.withColumn("expected_pnl", expected).withColumn("error", F.col("net_pnl") - F.col("expected_pnl"))


def neighbourhood(champion: Mapping) -> dict[str, list]:
    """27 variants around a champion: threshold, take-profit and stop-loss each scaled down, kept and up."""
    entry, tp, sl = champion["entry_pct"], champion["take_profit_pct"], champion["stop_loss_pct"]
    return {"source": [champion["source"]], "direction": [champion["direction"]],
            "entry_pct": [round(max(0.01, entry * k), 4) for k in (0.75, 1.0, 1.25)], "exit_pct": [champion["exit_pct"]],
            "take_profit_pct": [round(max(0.1, tp * k), 4) for k in (0.8, 1.0, 1.2)],
            "stop_loss_pct": [round(max(0.1, sl * k), 4) for k in (0.8, 1.0, 1.2)], "max_hold": [champion["max_hold"]]}


def stability_surface(trials: DataFrame) -> DataFrame:
    """Stable or fragile per neighbour of a champion."""
    agg = trials.groupBy("grid_index").agg(
        F.sum("net_pnl").alias("total_pnl"), F.min("net_pnl").alias("worst_pnl"), F.sum(F.when(F.col("trades") > 0, 1).otherwise(0)).alias("active"))
    return agg.withColumn("status", F.when((F.col("total_pnl") > 0) & (F.col("worst_pnl") >= -5), "stable").otherwise("fragile"))


# --- strategy families -----------------------------------------------------------------------

def _family(rows: DataFrame, name: str, axes: Mapping[str, Sequence], **rules: Column) -> DataFrame:
    base = {"source": F.lit("equity_gap"), "direction": F.lit("fade"), "entry_pct": F.lit(0.35), "exit_pct": F.lit(0.05),
            "take_profit_pct": F.lit(0.75), "stop_loss_pct": F.lit(2.0), "max_hold": F.lit(30), "notional_pct": F.lit(0.25),
            "max_concurrent": F.lit(3)}
    base.update(rules)
    grid = with_grid(rows.withColumn("family", F.lit(name)), {f"p_{k}": v for k, v in axes.items()})
    ident = F.concat_ws("_", F.lit(name), *[F.regexp_replace(F.col(f"p_{k}").cast("string"), "[^a-zA-Z0-9]", "_") for k in axes])
    return grid.select(*rows.columns, ident.alias("config_id"), "family", *[
        v.cast({"source": "string", "direction": "string", "max_hold": "long", "max_concurrent": "long"}.get(k, "double")).alias(k) for k, v in base.items()])


def strategy_families(rows: DataFrame, sizing: bool = True) -> DataFrame:
    """Repeat each row for every strategy of six families, each a parameter grid mapped onto one rule row.

    Without ``sizing`` the grid axes that only scale a position are left out.
    """
    size_axes = {"notional": [0.25, 0.5, 0.65], "conc": [2, 5, 8]} if sizing else {"notional": [0.25], "conc": [2]}
    p = lambda n: F.col(f"p_{n}")
    fade = _family(rows, "GapFade", {
        "source": ["equity_gap", "perp_gap"], "entry": [0.1, 0.2, 0.35, 0.5, 0.75], "exit": [0.0, 0.05, 0.1], "tp": [0.75, 1.25, 2.0],
        "sl": [0.75, 1.25, 2.5], "hold": [15, 30, 90, 9999], **size_axes},
        source=p("source"), entry_pct=p("entry"), exit_pct=p("exit"), take_profit_pct=p("tp"), stop_loss_pct=p("sl"), max_hold=p("hold"),
        notional_pct=p("notional"), max_concurrent=p("conc")).filter("exit_pct <= entry_pct")
    grid = _family(rows, "GridAroundAnchor", {"entry": [20, 40, 60, 80, 120], "step": [10, 20, 30], "levels": [1, 2, 3], "tp": [10, 20, 40]},
                   entry_pct=p("entry") / 100, exit_pct=F.least(p("entry") / 100, p("step") / 100), take_profit_pct=p("tp") / 100,
                   stop_loss_pct=F.greatest(F.lit(0.8), (p("entry") + p("step") * p("levels")) / 100), max_hold=F.lit(90),
                   notional_pct=F.least(F.lit(0.55), 0.15 * p("levels")), max_concurrent=F.least(F.lit(8), p("levels") * 2))
    vol = _family(rows, "VolTargetGapFade", {"look": [3, 5, 10, 20], "target": [10, 15, 20, 30], "cap": [25, 50, 100, 200], "gap": [30, 60, 100]},
                  entry_pct=p("gap") / 100, take_profit_pct=F.greatest(F.lit(0.4), p("gap") / 120),
                  stop_loss_pct=F.greatest(F.lit(1.0), p("gap") / 50), max_hold=F.when(p("look") <= 5, 30).otherwise(90),
                  notional_pct=F.least(F.lit(0.65), p("cap") / 300), max_concurrent=F.when(p("target") >= 20, 5).otherwise(3))
    cross = _family(rows, "CrossSectionMomentum", {"look": [60, 180, 360, 720], "top": [1, 2, 3, 5], "reb": [30, 60, 180], "liq": [0.5, 0.7, 0.85]},
                    direction=F.lit("momentum"), entry_pct=F.when(p("liq") >= 0.85, 0.2).otherwise(0.35),
                    take_profit_pct=F.when(p("look") >= 360, 1.5).otherwise(0.75), stop_loss_pct=F.when(p("liq") >= 0.7, 1.25).otherwise(2.0),
                    max_hold=F.greatest(F.lit(5), F.floor(p("reb") / 5 + 0.5)), notional_pct=F.least(F.lit(0.5), 0.15 * p("top")),
                    max_concurrent=p("top"))
    trend = _family(rows, "TrendOvernight", {"fast": [3, 5, 8], "slow": [13, 21, 34], "atr": [7, 10, 14], "mult": [2, 3, 4], "str": [0.2, 0.5, 0.8]},
                    source=F.lit("perp_gap"), direction=F.lit("momentum"), entry_pct=p("str"), exit_pct=F.lit(0.0),
                    take_profit_pct=F.when(p("mult") >= 3, 1.25).otherwise(0.75), stop_loss_pct=F.greatest(F.lit(0.75), p("atr") / 10),
                    max_hold=p("slow"))
    illusion = _family(rows, "PerpIllusionFade", {"perp": [10, 25, 50], "true": [50, 100, 150], "spread": [20, 40, 80], "grade": ["A", "B", "C"]},
                       entry_pct=p("true") / 100, exit_pct=p("perp") / 100, take_profit_pct=p("true") / 120,
                       stop_loss_pct=F.greatest(F.lit(1.25), p("true") / 60), max_hold=F.lit(9999),
                       notional_pct=F.when(p("spread") <= 40, 0.45).otherwise(0.25), max_concurrent=F.when(p("grade") == "A", 5).otherwise(3))
    out = fade
    for part in (grid, vol, cross, trend, illusion):
        out = out.unionByName(part)
    return out
