"""Policies over session ticks: first entries, last exits, guarded twins, session studies, stress."""
from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pricing as P
from ..functions import rules as R
from .peg import certify, without_events

COST = 0.35
STRETCH = 0.5


def unpivot_signals(ticks: DataFrame, signals: Mapping[str, Column]) -> DataFrame:
    """One row per tick and policy that wants to trade. ``signals`` maps a policy name to a side column."""
    wanted = F.array_compact(F.array(*[
        F.when(s.isNotNull(), F.struct(F.lit(n).alias("policy"), s.alias("side"))) for n, s in signals.items()]))
    return ticks.withColumn("__w", F.explode(wanted)).select(*ticks.columns, "__w.policy", "__w.side")


def with_verdict(rows: DataFrame, size: float, side: Column, cap_now: Column | None = None) -> DataFrame:
    """Verdict of an intent of ``size`` under the certificate that each row itself carries."""
    v = R.intent_verdict(F.lit(True), F.lit(True), F.col("ticker"), F.col("ticker"), F.col("allowed_policy"), side, F.lit(size), F.col("max_size_usd"))
    return rows.withColumn("verdict", v["verdict"])


def certified(ticks: DataFrame) -> DataFrame:
    """Ticks with the certificate of a context without events."""
    return certify(without_events(ticks)).drop("policy")


def first_entries(rows: DataFrame) -> DataFrame:
    """First qualifying tick per (policy, session, ticker); later ticks never open a second position."""
    leg = F.when(F.col("side") == "buy", F.col("token_mid")).otherwise(F.col("perp_mid"))
    return rows.withColumn("leg_price", leg).filter(F.col("leg_price") > 0).groupBy("policy", "session", "ticker").agg(
        F.min_by(F.struct("side", "leg_price", "gap", "gap_kind", F.col("tick").alias("entry_tick")), F.col("tick")).alias("e")).select(
        "policy", "session", "ticker", "e.*")


def settle(entries: DataFrame, ticks: DataFrame, cost: float = COST) -> DataFrame:
    """Exit each position at its session's last tick; a leg that is missing there exits at entry."""
    ends = ticks.groupBy("session").agg(F.max("tick").alias("tick"))
    last = ticks.join(F.broadcast(ends), ["session", "tick"]).select(
        "session", "ticker", F.col("token_mid").alias("__t"), F.col("perp_mid").alias("__p"), F.col("true_gap_pct").alias("__tg"),
        F.col("premium_pct").alias("__pg"))
    joined = entries.join(last, ["session", "ticker"], "left")
    buy = F.col("side") == "buy"
    exit_price = F.coalesce(F.when(buy, F.col("__t")).otherwise(F.col("__p")), F.col("leg_price"))
    exit_gap = F.coalesce(F.when(F.col("gap_kind") == "equity", F.col("__tg")).otherwise(F.col("__pg")), F.col("gap"))
    net = F.when(buy, 1.0).otherwise(-1.0) * (exit_price - F.col("leg_price")) / F.col("leg_price") * 100 - cost
    return joined.select(*entries.columns, exit_price.alias("exit_price"), exit_gap.alias("exit_gap"), net.alias("net_pct"))


def policy_result(settled: DataFrame) -> DataFrame:
    net = F.col("net_pct")
    return settled.groupBy("policy").agg(
        F.count(F.lit(1)).alias("trades"), F.sum(F.when(net > 0, 1).otherwise(0)).alias("wins"), F.sum(F.when(net > 0, 0).otherwise(1)).alias("losses"),
        F.avg(F.when(F.abs("exit_gap") < F.abs("gap"), 100.0).otherwise(0.0)).alias("converged_pct"), F.avg(net).alias("avg_net_pct"),
        F.sum(net).alias("total_net_pct"))


def _gapped(ticks: DataFrame, policy_kind: Mapping[str, str] | None = None) -> DataFrame:
    """Gap a policy acts on, and which reference it is measured against."""
    perp_only = F.col("policy").isin("perp_trust", "perp_trust_agent")
    gap = F.when(perp_only, F.col("premium_pct")).otherwise(F.coalesce("true_gap_pct", "premium_pct"))
    kind = F.when(perp_only | F.col("true_gap_pct").isNull(), "perp").otherwise("equity")
    return ticks.withColumn("gap", gap).withColumn("gap_kind", kind)


def arena(ticks: DataFrame, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Every rule policy over the same ticks and costs."""
    signals = R.agent_signals(F.col("true_gap_pct"), F.col("premium_pct"))
    rows = _gapped(unpivot_signals(ticks, {**signals, **(extra or {})}))
    return policy_result(settle(first_entries(rows), ticks))


def gauntlet(ticks: DataFrame, size: float = 1000.0) -> DataFrame:
    """Reckless policies unguarded against the same policies behind certificates."""
    signals = R.agent_signals(F.col("true_gap_pct"), F.col("premium_pct"))
    reckless = {n: signals[n] for n in ("naive_gap", "perp_trust", "momentum")}
    rows = with_verdict(_gapped(unpivot_signals(certified(ticks), reckless)), size, F.col("side"))
    leg = F.when(F.col("side") == "buy", F.col("token_mid")).otherwise(F.col("perp_mid"))
    ok = F.col("verdict") != "REJECT"
    twins = F.array(F.lit("unguarded"), F.when(ok, F.lit("guarded")))
    both = rows.withColumn("mode", F.explode(F.array_compact(twins))).withColumn("policy", F.concat_ws(":", "policy", "mode"))
    results = policy_result(settle(first_entries(both), ticks))
    split = F.split("policy", ":")
    sides = results.select(F.get(split, F.lit(0)).alias("policy"), F.get(split, F.lit(1)).alias("mode"), "trades", "losses", "total_net_pct")
    wide = sides.groupBy("policy").agg(*[
        F.coalesce(F.max(F.when(F.col("mode") == m, F.col(c))), F.lit(0)).alias(f"{m}_{c}") for m in ("unguarded", "guarded")
        for c in ("trades", "losses", "total_net_pct")])
    tried = rows.filter(leg > 0).groupBy("policy", "session", "ticker").agg(F.max(ok.cast("int")).alias("any_ok"))
    blocked = tried.groupBy("policy").agg(F.sum(1 - F.col("any_ok")).alias("blocked"))
    return wide.join(blocked, "policy")


def liquidity_drop(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("token_levels", F.when(F.col("token_levels").isNotNull(), 0).cast("long"))


def stale_anchor(ticks: DataFrame) -> DataFrame:
    gone = {"equity_price": "double", "market_state": "string", "true_gap_pct": "double", "true_state": "string"}
    return ticks.select(*[F.lit(None).cast(gone[c]).alias(c) if c in gone else F.col(c) for c in ticks.columns])


def price_shock(ticks: DataFrame, pct: float = 0.3) -> DataFrame:
    """The token jumps against an unchanged anchor; the gap and its state follow."""
    shocked = ticks.withColumn("token_mid", F.col("token_mid") * (1 + pct))
    gap = F.coalesce(P.premium_pct(F.col("token_mid"), F.col("equity_price")), F.col("true_gap_pct"))
    shocked = shocked.withColumn("true_gap_pct", gap)
    return shocked.withColumn("true_state", P.classify_depeg(F.abs("true_gap_pct")))


def stress(ticks: DataFrame) -> DataFrame:
    """The naive policy, unguarded and guarded, in four scenarios; scenarios are rows, not reruns."""
    named = [("baseline", ticks), ("liquidity-drop", liquidity_drop(ticks)), ("stale-anchor", stale_anchor(ticks)), ("price-shock+30%", price_shock(ticks))]
    out = None
    for name, rows in named:
        tagged = rows.withColumn("session", F.concat_ws("|", F.lit(name), "session"))
        out = tagged if out is None else out.unionByName(tagged)
    signals = {"naive_gap": R.agent_signals(F.col("true_gap_pct"), F.col("premium_pct"))["naive_gap"]}
    rows = with_verdict(_gapped(unpivot_signals(certified(out), signals)), 1000.0, F.col("side"))
    ok = F.col("verdict") != "REJECT"
    leg = F.when(F.col("side") == "buy", F.col("token_mid")).otherwise(F.col("perp_mid"))
    both = rows.withColumn("mode", F.explode(F.array_compact(F.array(F.lit("unguarded"), F.when(ok, F.lit("guarded"))))))
    settled = settle(first_entries(both.withColumn("policy", F.col("mode"))), out)
    scenario = F.get(F.split("session", r"\|"), F.lit(0)).alias("scenario")
    net = F.col("net_pct")
    sums = settled.groupBy(scenario).agg(
        F.coalesce(F.sum(F.when(F.col("policy") == "unguarded", net)), F.lit(0.0)).alias("unguarded_net_pct"),
        F.sum(F.when((F.col("policy") == "unguarded") & (net <= 0), 1).otherwise(0)).alias("unguarded_losers"),
        F.coalesce(F.sum(F.when(F.col("policy") == "guarded", net)), F.lit(0.0)).alias("guarded_net_pct"))
    tried = rows.filter(leg > 0).groupBy("session", "ticker").agg(F.max(ok.cast("int")).alias("any_ok"))
    blocked = tried.groupBy(scenario).agg(F.sum(1 - F.col("any_ok")).alias("guarded_blocked"))
    return sums.join(blocked, "scenario")


NOTIONAL = 50.0


def session_study(ticks: DataFrame, cost_pct: float = 0.1, minimum: float = 0.2) -> DataFrame:
    """Intents, trades, blocks and PnL per session, behind certificates and without them.

    Every qualifying tick up to a ticker's entry counts as an intent. Only snapshots in which some row has
    an anchor take part. Cash never binds at this notional.
    """
    anchored = ticks.filter(F.col("equity_price").isNotNull()).select("session", "tick").distinct()
    used = ticks.join(anchored, ["session", "tick"], "left_semi")
    bounds = used.groupBy("session").agg(F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"), F.min("snap_ts").alias("start_ts"),
                                         F.max("snap_ts").alias("end_ts"))
    width = used.groupBy("session", "tick").agg(F.count(F.lit(1)).alias("c")).groupBy("session").agg(F.max("c").alias("tokens"))
    gap = F.coalesce("true_gap_pct", "premium_pct")
    side = F.when(F.abs(gap) >= minimum, F.when(gap < 0, "buy").otherwise("sell"))
    rows = with_verdict(certified(used).withColumn("side", side).filter(F.col("side").isNotNull()), NOTIONAL, F.col("side"))
    last = used.join(F.broadcast(bounds.select("session", F.col("last_tick").alias("tick"))), ["session", "tick"]).select(
        "session", "ticker", F.col("token_mid").alias("final_mid"))
    rows = rows.join(last, ["session", "ticker"], "left")
    priced = F.coalesce(F.col("token_mid") > 0, F.lit(False))
    buy = F.col("side") == "buy"
    rows = rows.withColumn("mode", F.explode(F.array(F.lit("guarded"), F.lit("unguarded"))))
    allowed = priced & buy & ((F.col("mode") == "unguarded") | (F.col("verdict") != "REJECT"))
    rows = rows.withColumn("priced", priced).withColumn("allowed", allowed)
    # A (session, ticker) holds one row per snapshot, so this window is bounded by the session length.
    w = Window.partitionBy("mode", "session", "ticker")
    rows = rows.withColumn("entry_tick", F.min(F.when(F.col("allowed"), F.col("tick"))).over(w))
    rows = rows.filter(F.col("entry_tick").isNull() | (F.col("tick") <= F.col("entry_tick")))
    ret = (F.coalesce("final_mid", "token_mid") - F.col("token_mid")) / F.col("token_mid")
    fee = NOTIONAL * cost_pct / 100
    would = F.when(buy, 1.0).otherwise(-1.0) * ret * NOTIONAL - 2 * fee
    stopped = F.col("priced") & ~F.col("allowed")
    agg = rows.groupBy("session").agg(*[
        c for m in ("guarded", "unguarded") for c in (
            F.sum(F.when(F.col("mode") == m, 1).otherwise(0)).alias(f"{m}_intents"),
            F.sum(F.when((F.col("mode") == m) & F.col("allowed"), 1).otherwise(0)).alias(f"{m}_trades"),
            F.sum(F.when((F.col("mode") == m) & stopped, 1).otherwise(0)).alias(f"{m}_blocks"),
            F.coalesce(F.sum(F.when((F.col("mode") == m) & F.col("allowed"), ret * NOTIONAL - 2 * fee)), F.lit(0.0)).alias(f"{m}_pnl"),
            F.coalesce(F.sum(F.when((F.col("mode") == m) & stopped, F.least(F.lit(0.0), would))), F.lit(0.0)).alias(f"{m}_blocked_loss"))])
    base = bounds.join(width, "session").join(agg, "session", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return base.select(
        "session", "start_ts", "end_ts", "tokens", n("guarded_intents").alias("intents"), n("guarded_trades").alias("trades"),
        n("guarded_blocks").alias("blocks"),
        F.greatest(F.lit(0), n("guarded_intents") - n("guarded_trades") - n("guarded_blocks")).alias("abstains"),
        n("guarded_pnl").alias("guarded_pnl"), n("unguarded_pnl").alias("unguarded_pnl"), n("guarded_blocked_loss").alias("blocked_loss"))


def walk_forward(study: DataFrame) -> DataFrame:
    """Leave-one-session-out totals: the grand total minus the own session. Sessions are a small table."""
    whole = Window.partitionBy(F.lit(0))
    g, u = F.col("guarded_pnl"), F.col("unguarded_pnl")
    return study.select(
        "session", (F.count(F.lit(1)).over(whole) - 1).alias("train_sessions"), (F.sum(g).over(whole) - g).alias("train_guarded_pnl"),
        (F.sum(u).over(whole) - u).alias("train_unguarded_pnl"), g.alias("test_guarded_pnl"), u.alias("test_unguarded_pnl"),
        (g - u).alias("guarded_delta"), F.col("blocks").alias("test_blocks"), F.col("trades").alias("test_trades"))


def cost_grid(study: DataFrame, costs=(0.0, 0.05, 0.1, 0.25, 0.5, 1.0), base: float = 0.1) -> DataFrame:
    """Session PnL re-priced linearly at other costs."""
    rows = study.withColumn("cost_pct", F.explode(F.array(*[F.lit(c) for c in costs])))
    shift = NOTIONAL * (F.col("cost_pct") - base) / 100
    return rows.groupBy("cost_pct").agg(
        F.sum(F.col("guarded_pnl") - F.col("trades") * shift).alias("guarded_pnl"),
        F.sum(F.col("unguarded_pnl") - F.greatest(F.col("trades"), F.lit(1)) * shift).alias("unguarded_pnl"),
        F.sum("blocked_loss").alias("blocked_loss"))


def dominant_state(ticks: DataFrame) -> DataFrame:
    """Most frequent market state per session; the alphabetically first wins ties."""
    counts = ticks.groupBy("session", F.coalesce("market_state", F.lit("UNKNOWN")).alias("state")).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("session").agg(F.min_by("state", F.struct(-F.col("c"), "state")).alias("dominant_state"))


def second_arena(ticks: DataFrame, start_balance: float = 1000.0, fee_pct: float = 0.1) -> DataFrame:
    """The second agent set with guarded twins: fills, blocks and net PnL of long entries.

    Sells are always blocked; a fill holds to the end of its session. ``max_drawdown`` is the largest fall of an
    agent's equity below its high water in any session, seen after every fill and every closing sale.
    """
    signals = R.second_agent_signals(F.col("true_gap_pct"), F.col("premium_pct"), F.col("tick"))
    rows = with_verdict(unpivot_signals(certified(ticks), signals), NOTIONAL, F.col("side")).filter(F.col("token_mid") > 0)
    rows = rows.withColumn("agent", F.explode(F.array("policy", F.concat("policy", F.lit("_guarded")))))
    guarded = F.col("agent").endswith("_guarded")
    blocked = (F.col("side") == "sell") | (guarded & (F.col("verdict") == "REJECT"))
    rows = rows.withColumn("ok", ~blocked).withColumn(
        "size", F.when(guarded & (F.col("verdict") == "ALLOW_CAPPED"), F.col("max_size_usd").cast("double")).otherwise(NOTIONAL))
    w = Window.partitionBy("agent", "session", "ticker")
    rows = rows.withColumn("entry_tick", F.min(F.when(F.col("ok"), F.col("tick"))).over(w))
    rows = rows.filter(F.col("entry_tick").isNull() | (F.col("tick") <= F.col("entry_tick")))
    ends = ticks.groupBy("session").agg(F.max("tick").alias("tick"))
    last = ticks.join(F.broadcast(ends), ["session", "tick"]).select("session", "ticker", F.col("token_mid").alias("final_mid"))
    rows = rows.join(last, ["session", "ticker"], "left")
    ret = F.coalesce("final_mid", "token_mid") / F.col("token_mid") - 1
    fee = F.col("size") * fee_pct / 100
    pnl = F.when(F.col("ok"), F.col("size") * ret - fee - F.col("size") * (1 + ret) * fee_pct / 100)
    opened = rows.filter(F.col("ok")).select("agent", "session", "ticker", "tick", "size", F.col("token_mid").alias("entry"), F.coalesce("final_mid", "token_mid").alias("final"))
    falls = drawdowns(opened, ticks, fee_pct).groupBy("agent").agg(F.max("drawdown").alias("max_drawdown"))
    totals = rows.groupBy("agent").agg(F.sum(F.col("ok").cast("int")).alias("fills"), F.sum((~F.col("ok")).cast("int")).alias("blocks"), F.coalesce(F.sum(pnl), F.lit(0.0)).alias("net_pnl"))
    return totals.join(falls, "agent", "left").withColumn("max_drawdown", F.coalesce("max_drawdown", F.lit(0.0)))


def drawdowns(opened: DataFrame, ticks: DataFrame, fee_pct: float) -> DataFrame:
    """Largest fall below the high water of each (agent, session), from its positions.

    ``opened``: agent, session, ticker, tick, size, entry, final. After each opening, all positions opened so far are
    marked at that tick (at their entry where there is no quote); at the end they are sold in opening order. A session
    has at most one position per ticker, so the pairs of positions are bounded by the square of the universe.
    """
    rate = fee_pct / 100
    one = opened.select("agent", "session", F.col("ticker").alias("at_ticker"), F.col("tick").alias("at_tick"))
    earlier = one.join(opened, ["agent", "session"]).filter((F.col("tick") < F.col("at_tick")) | ((F.col("tick") == F.col("at_tick")) & (F.col("ticker") <= F.col("at_ticker"))))
    marks = ticks.select("session", "ticker", F.col("tick").alias("at_tick"), F.col("token_mid").alias("mark"))
    marked = earlier.join(marks, ["session", "ticker", "at_tick"], "left")
    value = F.sum(F.col("size") * (F.coalesce("mark", "entry") / F.col("entry") - 1 - rate)).alias("equity")
    opening = marked.groupBy("agent", "session", F.lit(0).alias("phase"), F.col("at_tick").alias("tick"), F.col("at_ticker").alias("ticker")).agg(value)
    all_rows = Window.partitionBy("agent", "session")
    so_far = all_rows.orderBy("tick", "ticker").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = F.sum(F.col("size") * (F.col("final") / F.col("entry") - 1 - rate)).over(all_rows) - F.sum(F.col("size") * F.col("final") / F.col("entry") * rate).over(so_far)
    closing = opened.select("agent", "session", F.lit(1).alias("phase"), "tick", "ticker", kept.alias("equity"))
    path = opening.unionByName(closing)
    high = F.greatest(F.lit(0.0), F.max("equity").over(all_rows.orderBy("phase", "tick", "ticker").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return path.withColumn("fall", high - F.col("equity")).groupBy("agent", "session").agg(F.max("fall").alias("drawdown"))


def guard_delta(results: DataFrame) -> DataFrame:
    """Each agent against its ``_guarded`` twin."""
    base = results.filter(~F.col("agent").endswith("_guarded"))
    twin = results.filter(F.col("agent").endswith("_guarded")).select(
        F.regexp_replace("agent", "_guarded$", "").alias("agent"), *[F.col(c).alias(f"g_{c}") for c in ("fills", "blocks", "net_pnl", "max_drawdown")])
    rows = base.join(twin, "agent")
    d, dd = F.col("g_net_pnl") - F.col("net_pnl"), F.col("g_max_drawdown") - F.col("max_drawdown")
    return rows.select(
        "agent", F.col("net_pnl").alias("actual_pnl"), F.col("g_net_pnl").alias("guarded_pnl"), d.alias("pnl_delta"), dd.alias("drawdown_delta"),
        F.greatest(F.lit(0), F.col("g_blocks") - F.col("blocks")).alias("blocks_added"), F.greatest(F.lit(0.0), -d).alias("missed_profit"),
        F.greatest(F.lit(0.0), d).alias("blocked_loss"),
        F.when((d >= 0) | (dd < 0), "helped_or_reduced_risk").otherwise("reduced_profit").alias("verdict"))


def threshold_sweep(ticks: DataFrame, thresholds=(0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0), fee_pct: float = 0.1) -> DataFrame:
    """Guarded replay at several gap thresholds: fills, blocks and PnL of each.

    Discounts are bought and rich gaps are sells; rejected intents and all sells are blocked, a capped one fills at its
    cap. Each (session, ticker) is a sleeve of its own: it stops at its first fill, which holds to the session's end.
    """
    side = F.when(F.col("true_gap_pct") < 0, "buy").otherwise("sell")
    rows = with_verdict(certified(ticks).filter((F.col("token_mid") > 0) & F.col("true_gap_pct").isNotNull()), NOTIONAL, side).withColumn("side", side)
    rows = rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).filter(F.abs("true_gap_pct") >= F.col("threshold"))
    size = F.when(F.col("verdict") == "ALLOW_CAPPED", F.col("max_size_usd").cast("double")).otherwise(F.lit(NOTIONAL).cast("double"))
    rows = rows.withColumn("blocked", (F.col("verdict") == "REJECT") | (F.col("side") == "sell")).withColumn("size", size)
    rows = rows.withColumn("ok", ~F.col("blocked") & (F.col("size") > 0))
    w = Window.partitionBy("threshold", "session", "ticker")
    rows = rows.withColumn("entry_tick", F.min(F.when(F.col("ok"), F.col("tick"))).over(w)).filter(
        F.col("entry_tick").isNull() | (F.col("tick") <= F.col("entry_tick")))
    ends = ticks.groupBy("session").agg(F.max("tick").alias("tick"))
    last = ticks.join(ends, ["session", "tick"]).select("session", "ticker", F.col("token_mid").alias("final_mid"))
    ret = F.coalesce("final_mid", "token_mid") / F.col("token_mid") - 1
    pnl = F.col("size") * ret - F.col("size") * fee_pct / 100 * (2 + ret)
    return rows.join(last, ["session", "ticker"], "left").groupBy("threshold").agg(
        F.sum(F.col("ok").cast("int")).alias("fills"), F.sum(F.col("blocked").cast("int")).alias("blocks"),
        F.coalesce(F.sum(F.when(F.col("ok"), pnl)), F.lit(0.0)).alias("net_pnl"))


UNSAFE_LABELS = ("STALE", "LIQUIDITY-TRAP", "NEWS-DRIVEN", "MACRO-RISK", "ISSUER-RISK", "UNTRADEABLE")


def safe_agent(size_limit: float = 1000.0) -> Column:
    """Block unsafe labels, oversize and shorts; allow the rest."""
    bad = F.col("classification").isin(*UNSAFE_LABELS) | (F.col("size_usd") <= 0) | (F.col("size_usd") > size_limit) | (F.col("side") == "sell")
    return F.when(bad, "REJECT").otherwise("ALLOW")


def bench_score(tasks: DataFrame, agents: Mapping[str, Column], threshold: float = 0.5) -> DataFrame:
    """Safety and economic capture of agents; ``agents`` maps a name to a verdict column over the tasks."""
    rows = tasks.withColumn("__a", F.explode(F.array(*[F.struct(F.lit(n).alias("agent"), v.alias("verdict")) for n, v in agents.items()])))
    rows = rows.select("kind", "__a.*")
    unsafe = F.col("kind") == "unsafe"
    agg = rows.groupBy("agent").agg(
        F.coalesce(F.avg(F.when(unsafe, F.when(F.col("verdict") == "REJECT", 1.0).otherwise(0.0))), F.lit(1.0)).alias("safety"),
        F.coalesce(F.avg(F.when(~unsafe, F.when(F.col("verdict") == "ALLOW", 1.0).otherwise(0.0))), F.lit(0.0)).alias("economic"),
        F.sum(F.when(unsafe & (F.col("verdict") != "REJECT"), 1).otherwise(0)).alias("unsafe_allowed"))
    return agg.withColumn("passed", (F.col("safety") == 1) & (F.col("economic") >= threshold))
