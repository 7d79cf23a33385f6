"""Deterministic views of the given tables as ticks, bars, peg rows, events, news and ledgers.

Each adapter is a plain projection or one aggregation, so filters and column selection reach the
parquet scan. ``catalog/sqlbase.py`` states the same rules in SQL for the oracle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pricing as P
from ..session import configure

HOUR_MS = 3_600_000
DAY_MS = 86_400_000
SNAPSHOT_MS = 6 * HOUR_MS
SESSION_MS = 3 * DAY_MS
EPOCH_2024 = 1_704_067_200_000
DESKS = 25
TICKERS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_ms(ts: str) -> Column:
    """Epoch milliseconds of a zone-free timestamp column, whatever the session zone is."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quote per event: ticker, leg, price around 100, and ``k`` (0..99) from the properties."""
    e = table(spark, sf_dir, "events")
    leg = (F.when(F.col("event_type") == "purchase", "token").when(F.col("event_type") == "view", "perp")
           .when(F.col("event_type") == "signup", "listed").when(F.col("event_type") == "click", "equity")
           .otherwise("other"))
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    return e.select(
        "event_id", epoch_ms("ts").alias("ts"),
        F.concat(F.lit("I"), (F.col("user_id") % TICKERS).cast("string")).alias("ticker"),
        leg.alias("leg"), (100 + (F.col("value") - 50) / 50).alias("price"), "value", k.alias("k"),
        "event_type", "user_id",
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided quotes with holes: no bid where k % 17 = 0, no ask where k % 19 = 0, some crossed."""
    t = ticks(spark, sf_dir).filter(F.col("event_type").isin("purchase", "view", "signup", "click"))
    half = F.col("price") * F.col("k") / 20_000.0
    sign = F.when(F.col("k") % 23 == 0, -1.0).otherwise(1.0)
    return t.select(
        "event_id", "ts", "ticker", "leg", "k",
        F.concat_ws("-", "ticker", "leg").alias("symbol"),
        F.when(F.col("k") % 17 != 0, F.col("price") - half * sign).alias("bid"),
        F.when(F.col("k") % 19 != 0, F.col("price") + half * sign).alias("ask"),
        F.col("price").alias("last"),
        (1.0 + F.col("k") % 7).alias("bid_size"), (1.0 + F.col("k") % 5).alias("ask_size"),
    )


def legs(spark: SparkSession, sf_dir: str, bucket_ms: int = SNAPSHOT_MS) -> DataFrame:
    """Latest quote of each leg per snapshot: one long row per (snapshot, ticker, leg)."""
    q = quotes(spark, sf_dir).withColumn("snap_ts", (F.floor(F.col("ts") / bucket_ms) + 1) * bucket_ms)
    latest = F.max_by(F.struct("symbol", "bid", "ask", "last", "bid_size", "ask_size", "k", "ts"),
                      F.struct("ts", "event_id"))
    return (q.groupBy("snap_ts", "ticker", "leg").agg(latest.alias("q"))
            .select("snap_ts", "ticker", "leg", "q.*").withColumn("mid", P.mid(F.col("bid"), F.col("ask"), F.col("last"))))


TRIPLE_LISTED = ("I0", "I1", "I2", "I3")


def assembled(spark: SparkSession, sf_dir: str, bucket_ms: int = SNAPSHOT_MS) -> DataFrame:
    """Snapshot rows with all legs, from one aggregation: the latest quote of each leg per cell."""
    q = quotes(spark, sf_dir)
    at = F.struct("ts", "event_id")
    rec = F.struct("symbol", "bid", "ask", "last", "k", "ts")
    pick = lambda leg: F.max_by(rec, F.when(F.col("leg") == leg, at)).alias(leg)
    cells = q.groupBy(((F.floor(F.col("ts") / bucket_ms) + 1) * bucket_ms).alias("snap_ts"), "ticker").agg(
        pick("token"), pick("perp"), pick("listed"), pick("equity"))
    mid = lambda leg: P.mid(F.col(f"{leg}.bid"), F.col(f"{leg}.ask"), F.col(f"{leg}.last")).alias(f"{leg}_mid")
    k = F.col("equity.k") % 4
    state = F.when(k == 0, "REGULAR").when(k == 1, "POST").when(k == 2, "CLOSED").when(k == 3, "PRE")
    return cells.select(
        "snap_ts", "ticker", F.col("token.symbol").alias("token_symbol"), mid("token"), (F.col("token.k") % 3).alias("token_levels"),
        mid("perp"), mid("listed"), F.col("equity.last").alias("equity_price"), state.alias("market_state"),
        F.col("ticker").isin(*TRIPLE_LISTED).alias("triple_listed"))


def peg(spark: SparkSession, sf_dir: str, bucket_ms: int = SNAPSHOT_MS) -> DataFrame:
    from ..operators.peg import derive
    return derive(assembled(spark, sf_dir, bucket_ms))


def bars(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """Daily closes per desk and leg; at most one row per (instrument, leg, day). ``only`` picks one leg
    by a filter that reaches the scan."""
    li = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    if only is not None:
        li = li.filter(~flag.isin("A", "N") if only == "equity" else flag == {"token": "A", "perp": "N"}[only])
    leg = (F.when(F.col("l_returnflag") == "A", "token").when(F.col("l_returnflag") == "N", "perp")
           .otherwise("equity"))
    unit = 100 + (F.col("l_extendedprice") / F.col("l_quantity") - 1500) / 299.7
    return (li.select(
        F.concat(F.lit("D"), (F.col("l_suppkey") % DESKS).cast("string")).alias("instrument"),
        leg.alias("leg"), epoch_ms("l_shipdate").alias("ts"), unit.alias("unit"))
        .groupBy("instrument", "leg", "ts").agg(F.avg("unit").alias("close")))


def wide_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars with the three legs side by side, from one scan and one shuffle."""
    li = table(spark, sf_dir, "lineitem")
    unit = 100 + (F.col("l_extendedprice") / F.col("l_quantity") - 1500) / 299.7
    flag = F.col("l_returnflag")
    return (li.select(
        F.concat(F.lit("D"), (F.col("l_suppkey") % DESKS).cast("string")).alias("instrument"),
        epoch_ms("l_shipdate").alias("ts"),
        F.when(flag == "A", unit).alias("t"), F.when(flag == "N", unit).alias("p"),
        F.when(~flag.isin("A", "N"), unit).alias("e"))
        .groupBy("instrument", "ts")
        .agg(F.avg("t").alias("token_close"), F.avg("p").alias("perp_close"), F.avg("e").alias("equity_close")))


def premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token over perp premium per desk and day."""
    w = wide_bars(spark, sf_dir).filter((F.col("token_close") > 0) & (F.col("perp_close") > 0))
    return w.select("instrument", "ts", "token_close", "perp_close",
                    P.premium_pct(F.col("token_close"), F.col("perp_close")).alias("premium_pct"))


def events_prov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance events: received ``k`` minutes after they took effect, some with bad prices."""
    t = ticks(spark, sf_dir)
    kind = (F.when(F.col("event_type").isin("purchase", "view", "signup"), "market.quote")
            .when(F.col("event_type") == "click", "equity.quote").otherwise("market.trade"))
    bad = F.col("k") % 31 == 0
    half = F.col("price") * F.col("k") / 20_000.0
    sign = F.when(F.col("k") % 23 == 0, -1.0).otherwise(1.0)
    return t.select(
        F.concat_ws(":", F.col("ts").cast("string"), "event_type", F.col("event_id").cast("string")).alias("event_id"),
        kind.alias("kind"), F.col("event_type").alias("source"), F.col("ticker").alias("instrument"),
        F.col("ts").alias("effective_at"), (F.col("ts") + F.col("k") * 60_000).alias("observed_at"),
        (F.col("ts") + F.col("k") * 60_000).alias("received_at"),
        F.floor(F.col("ts") / 7_200_000).alias("sequence"),
        F.struct(
            F.when(~bad & (F.col("k") % 17 != 0), F.col("price") - half * sign).alias("bid"),
            F.when(~bad & (F.col("k") % 19 != 0), F.col("price") + half * sign).alias("ask"),
            F.when(~bad, F.col("price")).alias("last")).alias("payload"),
    )


def account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills per (account, symbol) in a total order; ``R`` lines sell and even parts are perps."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", epoch_ms("o_orderdate").alias("ts"))
    price = F.col("l_extendedprice") / F.col("l_quantity") / 0.9973
    fills = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        epoch_ms("l_shipdate").alias("ship"), (F.col("l_partkey") % 5).alias("sym"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("qty"), price.alias("price"))
    joined = fills.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    order_key = F.format_string("%015d:%04d:%012d:%012d:%012.2f:%05.2f", "l_orderkey", "l_linenumber", "l_partkey",
                                "l_suppkey", "l_extendedprice", "l_discount")
    return joined.select(
        F.col("o_custkey").alias("account_id"), F.concat(F.lit("P"), F.col("sym").cast("string")).alias("symbol"),
        F.when(F.col("sym") % 2 == 0, "perp").otherwise("spot").alias("market"), "side", "qty", "price", "ts",
        order_key.alias("event_key"), "ship")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts as headlines, spread over the thirty days of the event stream."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("news_id"), F.col("text").alias("title"), F.col("source").alias("publisher"),
                    (F.lit(EPOCH_2024) + (F.col("doc_id") * 37 % 43_200) * 60_000).alias("published_at"))


def macro_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dated macro event list per nation row (25 rows at every scale)."""
    n = table(spark, sf_dir, "nation")
    name = (F.when(F.col("n_regionkey") == 0, "FOMC rate decision").when(F.col("n_regionkey") == 1, "PPI release")
            .when(F.col("n_regionkey") == 2, "Retail sales").when(F.col("n_regionkey") == 4, "CPI print")
            .otherwise(F.col("n_name")))
    date = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey")), "yyyy-MM-dd")
    return n.select(date.alias("date"), F.array(name, F.col("n_name")).alias("events"))


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade intents from orders, spread over the thirty days of the event stream."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("intent_id"),
        F.concat(F.lit("I"), (F.col("o_custkey") % TICKERS).cast("string")).alias("ticker"),
        (F.lit(EPOCH_2024) + (F.col("o_orderkey") * 7919 % 2_592_000) * 1000).alias("ts"),
        F.when(F.col("o_orderkey") % 3 == 0, "sell").otherwise("buy").alias("side"),
        ((F.col("o_totalprice") - 1000) / 2000).alias("size_usd"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision log from orders: outcome, grade, counterfactual, gates, token use, predicted odds."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    outcome = (F.when(k % 7 == 0, "no_trade").when(k % 7 == 1, "abstained").when(k % 7 == 2, "gated")
               .when(k % 7 < 6, "trade").otherwise("open"))
    grade = F.when(outcome == "trade", (F.col("o_totalprice") % 1000 - 480) / 100)
    return o.select(
        k.alias("cycle_id"), epoch_ms("o_orderdate").alias("ts"),
        F.concat(F.lit("I"), (F.col("o_custkey") % TICKERS).cast("string")).alias("ticker"),
        outcome.alias("outcome"), grade.alias("grade_pnl"),
        F.when(grade.isNotNull(), k % 5 < 3).alias("captured"),
        F.when(k % 11 != 0, (k % 101) / 100.0).alias("p_converge"),
        F.when(outcome.isin("abstained", "gated"), (F.col("o_totalprice") % 500 - 260) / 100).alias("would_pnl"),
        F.when(outcome.isin("abstained", "gated"), k % 4 == 0).alias("would_converge"),
        F.array(*[F.struct(F.lit(g).alias("gate"), (k % m != 0).alias("passed"))
                  for g, m in (("max_position", 3), ("stale_data", 4), ("net_edge", 5))]).alias("gates"),
        (k % 900).alias("prompt_tokens"), (k % 300).alias("completion_tokens"))


def session_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peg rows with their three-day session and the snapshot's position in it."""
    rows = peg(spark, sf_dir)
    at = F.col("snap_ts") - EPOCH_2024 - SNAPSHOT_MS
    return rows.select("*", F.format_string("s%03d", F.floor(at / SESSION_MS)).alias("session"),
                       F.floor(at % SESSION_MS / SNAPSHOT_MS).alias("tick"), F.col("token_mid").alias("price"))


def order_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second trial table: one configuration per customer bucket, one session per quarter."""
    o = table(spark, sf_dir, "orders")
    session = F.format_string("%04d-q%d", F.year("o_orderdate"), F.quarter("o_orderdate"))
    cfg = F.col("o_custkey") % 40
    pnl = (F.col("o_totalprice") - 250_000) / 99_991
    return o.groupBy(cfg.alias("config_order"), session.alias("session")).agg(
        F.round(F.sum(pnl), 6).alias("net_pnl"), F.count(F.lit(1)).alias("trades"), F.sum(F.when(pnl > 0, 1).otherwise(0)).alias("wins"),
        F.sum(F.when(pnl > 0, 0).otherwise(1)).alias("losses"), F.round(-F.min(F.least(pnl, F.lit(0.0))), 6).alias("max_drawdown"),
        F.round(F.sum(F.col("o_totalprice") / 9_999_991), 6).alias("fees")).withColumn("config_id", F.format_string("C%02d", "config_order"))


def order_token_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pnl = (F.col("o_totalprice") - 250_000) / 99_991
    return o.groupBy(F.format_string("C%02d", F.col("o_custkey") % 40).alias("config_id"), F.col("o_orderpriority").alias("ticker")).agg(
        F.sum(pnl).alias("pnl"))


def trade_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading-log rows from orders: fills, blocks, running balances with a few broken rows."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    direction = F.when(k % 5 < 2, "BUY").when(k % 5 == 2, "SELL").otherwise("BLOCK")
    before = 1000.0 + (k * 37 % 5000) / 100.0
    change = F.when(direction == "BLOCK", 0.0).otherwise((F.col("o_totalprice") % 100 - 55) / 100)
    return o.select(
        epoch_ms("o_orderdate").alias("ts"), k.alias("seq"), F.concat(F.lit("run"), (F.col("o_custkey") % 6).cast("string")).alias("run_id"),
        F.concat(F.lit("I"), (F.col("o_custkey") % TICKERS).cast("string")).alias("asset"), direction.alias("direction"),
        F.when(direction == "BLOCK", 0.0).otherwise(F.col("o_totalprice") / 1000).alias("price"),
        F.when(direction == "BLOCK", 0.0).otherwise(1.0 + k % 3).alias("quantity"),
        F.when(direction == "BLOCK", 0.0).otherwise(F.col("o_totalprice") / 1000 * (1.0 + k % 3)).alias("notional"),
        before.alias("balance_before"), (before + change + F.when(k % 97 == 0, 0.01).otherwise(0.0)).alias("balance_after"), change.alias("balance_change"),
        F.when(k % 89 != 0, F.lit("cert")).otherwise("").alias("certificate_id"), F.when(direction == "BLOCK", "REJECT").otherwise("ALLOW").alias("verdict"),
        F.when(k % 83 != 0, "rule").otherwise("").alias("reason"), F.when(k % 79 != 0, F.sha2(k.cast("string"), 256)).otherwise("bad").alias("ledger_hash"),
        F.when(direction == "BLOCK", F.when(k % 73 != 0, F.concat(F.lit("DENY_"), (k % 4).cast("string"))).otherwise("")).otherwise("").alias("denied_reason"),
        F.when(direction != "BLOCK", "size_aware").otherwise("").alias("fill_model"))


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account events with funding rows: perp lines with line number 7 settle funding at the mark."""
    fills = account_events(spark, sf_dir)
    seventh = F.col("event_key").substr(17, 4) == "0007"
    return fills.withColumn("rate", F.when((F.col("market") == "perp") & seventh, 0.0001))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order event logs: submission, reply, one fill per line item, and an end that depends on the status."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ev = lambda seq, kind: F.struct(F.lit(seq).cast("long").alias("seq"), kind.alias("type"))
    status = F.col("o_orderstatus")
    head = F.array_compact(F.array(
        ev(0, F.when(k % 11 == 0, "Deny").otherwise("Submit")), ev(1, F.when(k % 13 == 0, "Reject").otherwise("Accept")),
        F.when(status == "F", ev(10**15, F.lit("CancelRequest"))), F.when(status == "F", ev(10**15 + 1, F.lit("CancelAck"))), F.when(status == "O", ev(10**15, F.lit("Expire")))))
    own = o.select(k.alias("order_id"), F.explode(head).alias("e")).select("order_id", "e.seq", "e.type", F.lit(None).cast("double").alias("fill_qty"))
    li = table(spark, sf_dir, "lineitem")
    seq = 2 + F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**5 + F.col("l_quantity").cast("long") * 100 + (F.col("l_discount") * 100).cast("long")
    fills = li.select(F.col("l_orderkey").alias("order_id"), seq.alias("seq"), F.lit("Fill").alias("type"), F.col("l_quantity").alias("fill_qty"))
    out = own.unionByName(fills)
    return out.select("order_id", "seq", "type", F.when((F.col("type") == "Deny") & (F.col("order_id") % 2 == 0), "STALE_ANCHOR").alias("reason"), "fill_qty",
                      (60.0 + F.col("order_id") % 100).alias("order_qty"))


def queue_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggressor trades (line items) against one resting order per order key."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    seq = F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**5 + F.col("l_quantity").cast("long") * 100 + (F.col("l_discount") * 100).cast("long")
    return li.select(k.alias("order_id"), seq.alias("seq"), F.when(k % 2 == 0, "buy").otherwise("sell").alias("order_side"), F.lit(1500.0).alias("order_price"),
                     (30.0 + k % 40).alias("order_qty"), (k % 35).cast("double").alias("ahead_qty"), F.when(F.col("l_returnflag") == "R", "buy").otherwise("sell").alias("trade_side"),
                     (F.col("l_extendedprice") / F.col("l_quantity")).alias("trade_price"), F.col("l_quantity").alias("trade_qty"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded outcomes of the decision log."""
    d = decisions(spark, sf_dir).filter(F.col("grade_pnl").isNotNull())
    g = F.col("grade_pnl")
    return d.select("ticker", "ts", P.premium_bucket(g).alias("bucket"), g.alias("premium_pct"), (g / 2).alias("pnl_pct"), (F.abs(g) / 3).alias("narrowing_pp"),
                    (F.col("prompt_tokens") % 48).alias("hold_bars"), F.col("captured").alias("converged"), (F.col("ts") + 365 * DAY_MS).alias("expires_at"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade proposals with the scalar inputs of the gates."""
    o = table(spark, sf_dir, "orders")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return o.select(
        k.alias("proposal_id"), (k % 12).cast("double").alias("size_pct"), (p % 200 / 100).alias("expected_edge_pct"), (k % 5).cast("double").alias("leverage"),
        (k % 9 == 0).alias("is_basis"), (k % 6).cast("double").alias("existing_pct"), (k % 55).cast("double").alias("gross_pct"),
        F.when(k % 4 == 0, "DISLOCATED").when(k % 4 == 1, "STRETCHED").when(k % 4 == 2, "NORMAL").alias("peg_state"), (k % 45 / 100.0).alias("slippage_pct"),
        (k % 100 / 100.0).alias("confidence"), (k % 10 != 0).alias("grounded"), (k % 4).alias("correlated_open"), F.lit(0.32).alias("fee_round_trip_pct"),
        (k % 75).cast("double").alias("data_age_sec"), (k % 50 == 0).alias("kill_switch"), F.when(k % 3 != 0, (k % 20).cast("double")).alias("vol_pct"),
        F.when(k % 8 != 0, (k % 60 - 30).cast("double")).alias("anchor_deviation_pct"), F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"),
        (95 + k % 10).cast("double").alias("mark"), F.when(k % 7 != 0, F.lit(99.0)).alias("stop"), (k % 37 == 0).alias("pre_open_cutoff"),
        (p % 500 / 100 - 3.2).alias("daily_pnl_pct"))


def order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their quote, cap, cash, position and venue rules."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(k % 3 == 0, "sell").otherwise("buy").alias("side"), F.when(k % 2 == 0, "spot").otherwise("perp").alias("market"),
        (F.col("l_quantity") - F.when(k % 41 == 0, F.col("l_quantity")).otherwise(0.0)).alias("qty"), F.when(k % 5 != 0, price * 0.999).alias("bid"),
        F.when(k % 7 != 0, price * 1.001).alias("ask"), F.when(k % 35 != 0, price).alias("last"), F.when(k % 4 == 0, price).alias("limit_price"), price.alias("reference_price"),
        F.when(k % 29 == 0, "HALTED").otherwise("ACTIVE").alias("trading_state"), F.lit(70_000.0).alias("max_notional_usd"), (k % 90_000).cast("double").alias("cash"),
        (k % 30).cast("double").alias("position_units"), (k % 6 == 0).alias("reduce_only"), F.lit(0.05).alias("tick_size"), F.when(k % 3 == 0, 2.0).otherwise(1.0).alias("lot_size"),
        F.lit(2.0).alias("min_qty"), F.when(k % 2 == 0, 45.0).alias("max_qty"), F.lit(5_000.0).alias("min_notional"), F.lit(80_000.0).alias("max_notional"))
