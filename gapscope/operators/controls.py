"""Statistical controls: bootstrap, random and shuffled baselines, selection-bias corrections."""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .metrics import moments
from .ordered import dense_index, with_row


def bootstrap_mean_ci(samples: DataFrame, value: str, order: Sequence[str], slice_by: Column | None, iters: int = 2000,
                      seed: int = 1234567, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of a mean from seeded resamples, bit-equal to the sequential generator.

    Draw ``it * n + i + 1`` picks the i-th sample of resample ``it``, so draws are independent rows: they
    join the samples on position and never depend on each other.
    """
    base = samples.select(F.lit(0).alias("g"), *order, F.col(value).alias("v"))
    indexed = dense_index(base, ["g"], order, slice_by, "pos").select("pos", "v")
    total = indexed.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    drawn = with_row(indexed.select("pos"), total)
    drawn = drawn.select("pos", "n", F.explode(F.sequence(F.lit(0), F.lit(iters - 1))).alias("it"))
    u = N.seeded_uniform(F.lit(seed), F.col("it").cast("long") * F.col("n") + F.col("pos") + 1)
    picks = drawn.select("it", F.floor(u * F.col("n")).alias("pos")).groupBy("it", "pos").agg(F.count(F.lit(1)).alias("c"))
    means = picks.join(indexed, "pos").groupBy("it").agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("m"))
    ranked = means.withColumn("r", F.row_number().over(Window.orderBy("m")) - 1)  # iters rows
    lo, hi = int(alpha / 2 * iters), min(iters - 1, int((1 - alpha / 2) * iters))
    ends = ranked.agg(F.max(F.when(F.col("r") == lo, F.col("m"))).alias("lo"), F.max(F.when(F.col("r") == hi, F.col("m"))).alias("hi"))
    return with_row(total, ends).select("n", "mean", "lo", "hi", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_zero"))


def random_capture(indexed: DataFrame, draws: DataFrame, horizon: int, iters: int, seed: int, value: str = "premium_pct") -> DataFrame:
    """Narrowing rate at random bars, as many per instrument and iteration as in ``draws`` (instrument, n_entries).

    ``indexed``: instrument, idx, n, value. Only bars with a bar ``horizon`` ahead can be drawn.
    """
    w = Window.partitionBy("instrument").orderBy("idx")
    pairs = indexed.select("instrument", "idx", "n", F.abs(value).alias("a"), F.abs(F.lead(value, horizon).over(w)).alias("b"))
    sizes = pairs.select("instrument", "n").distinct().filter(F.col("n") >= horizon + 2).join(draws.filter("n_entries > 0"), "instrument")
    picks = sizes.select("instrument", "n", "n_entries", F.explode(F.sequence(F.lit(0), F.lit(iters - 1))).alias("it"))
    picks = picks.select("instrument", "n", "n_entries", "it", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_entries"))).alias("j"))
    u = N.seeded_uniform(F.lit(seed), F.col("it").cast("long") * F.col("n_entries") + F.col("j"))
    hit = picks.select("instrument", F.floor(u * (F.col("n") - horizon)).alias("idx")).groupBy("instrument", "idx").agg(F.count(F.lit(1)).alias("c"))
    joined = hit.join(pairs, ["instrument", "idx"])
    return joined.groupBy("instrument").agg(
        F.sum(F.when(F.col("b") < F.col("a"), F.col("c")).otherwise(0)).alias("cap_hits"), F.sum("c").alias("cap_total"))


def random_entry_pnl(indexed: DataFrame, draws: DataFrame, exit_: float, fee: float, max_hold: int, iters: int, seed: int,
                     value: str = "premium_pct") -> DataFrame:
    """Mean PnL of random entries on random sides under the real exit rules.

    Entries come from per-(iteration, bar) hashed draws, so the result matches the sequential version in
    distribution only. Series are bounded by their bar count.
    """
    bars = indexed.join(draws.filter("n_entries > 0"), "instrument")
    k = F.col("idx") * 2 + 1
    series = bars.groupBy("instrument", "n", "n_entries").agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), F.col(value).alias("p")))).alias("bars"))
    runs = series.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(iters - 1))))
    prob = F.least(F.lit(1.0), F.col("n_entries") / F.col("n"))
    start = F.struct(F.lit(0).alias("side"), F.lit(0.0).alias("ep"), F.lit(0).cast("long").alias("ei"), F.col("n_entries").cast("long").alias("left"),
                     F.lit(0.0).alias("pnl"), F.lit(0).cast("long").alias("trades"))

    def step(acc: Column, x: Column) -> Column:
        key = F.col("it").cast("long") * F.col("n") * 2 + x["i"] * 2 + 1
        opens = (acc["side"] == 0) & (acc["left"] > 0) & (N.seeded_uniform(F.lit(seed), key) < prob)
        side = F.when(N.seeded_uniform(F.lit(seed), key + 1) < 0.5, 1).otherwise(-1)
        converged = F.when(acc["side"] == 1, x["p"] >= -exit_).otherwise(x["p"] <= exit_)
        closes = (acc["side"] != 0) & (converged | (x["i"] - acc["ei"] >= max_hold))
        gross = acc["side"] * (x["p"] - acc["ep"])
        return F.struct(
            F.when(closes, 0).when(opens, side).otherwise(acc["side"]).alias("side"), F.when(opens, x["p"]).otherwise(acc["ep"]).alias("ep"),
            F.when(opens, x["i"]).otherwise(acc["ei"]).alias("ei"), (acc["left"] - F.when(opens, 1).otherwise(0)).alias("left"),
            (acc["pnl"] + F.when(closes, gross - fee).otherwise(0.0)).alias("pnl"), (acc["trades"] + F.when(closes, 1).otherwise(0)).alias("trades"))

    done = runs.select("instrument", "it", F.aggregate("bars", start, step).alias("s"), F.element_at("bars", -1).alias("last"))
    still = F.col("s.side") != 0
    pnl = F.col("s.pnl") + F.when(still, F.col("s.side") * (F.col("last.p") - F.col("s.ep")) - fee).otherwise(0.0)
    return done.groupBy("instrument").agg(F.avg(pnl).alias("basis_pnl_pct"), F.avg(F.col("s.trades") + still.cast("int")).alias("basis_trades"))


def shuffled_capture(indexed: DataFrame, stretch: float, horizon: int, iters: int, seed: int, value: str = "premium_pct") -> DataFrame:
    """Capture after permuting each series: bars are reordered by a seeded key per iteration."""
    spread = indexed.select("instrument", "idx", "n", F.abs(value).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(iters - 1))).alias("it"))
    key = N.seeded_uniform(F.lit(seed), F.col("it").cast("long") * F.col("n") + F.col("idx") + 1)
    w = Window.partitionBy("instrument", "it").orderBy("u", "idx")
    ahead = spread.withColumn("u", key).withColumn("b", F.lead("a", horizon).over(w))
    return ahead.filter(F.col("b").isNotNull() & (F.col("a") >= stretch)).groupBy("instrument").agg(
        F.sum(F.when(F.col("b") < F.col("a"), 1).otherwise(0)).alias("cap_hits"), F.count(F.lit(1)).alias("cap_total"))


# --- selection bias --------------------------------------------------------------------------

def complete_matrix(trials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-configuration Sharpe with missing sessions as 0, and the configurations present in all sessions."""
    sessions = trials.select("session").distinct().agg(F.count(F.lit(1)).alias("t"))
    # A missing session adds a 0: it changes the count but neither sum, so no dense table is built.
    agg = trials.groupBy("config_id").agg(F.countDistinct("session").alias("have"), F.sum("net_pnl").alias("s"),
                                          F.sum(F.pow("net_pnl", F.lit(2.0))).alias("ss"), F.min("net_pnl").alias("lo"), F.max("net_pnl").alias("hi"))
    rows = with_row(agg, sessions)
    mean = F.col("s") / F.col("t")
    var = (F.col("ss") - F.col("s") * mean) / (F.col("t") - 1)
    flat = ((F.col("lo") == F.col("hi")) & ((F.col("have") == F.col("t")) | (F.col("lo") == 0))) | (F.col("t") < 2)
    sharpe = F.when(flat | (var <= 0), 0.0).otherwise(mean / F.sqrt(var))
    return rows.select("config_id", sharpe.alias("sharpe")), rows.filter(F.col("have") == F.col("t")).select("config_id")


def overfit_stats(champion: DataFrame, sharpes: DataFrame, start_balance: float = 1000.0, confidence: float = 0.95) -> DataFrame:
    """Expected best-of-N Sharpe, probabilistic and deflated Sharpe, minimum track record."""
    r = champion.select((F.col("net_pnl") / start_balance).alias("r"), F.lit(0).alias("g"))
    m = moments(r, ["g"], "r").drop("g")
    search = sharpes.agg(F.count(F.lit(1)).alias("n_trials"), F.var_samp(F.when(F.col("sharpe") != 0, F.col("sharpe"))).alias("v"))
    rows = with_row(m, search).withColumn("sr", F.when(F.col("stdev_samp") == 0, 0.0).otherwise(F.col("mean") / F.col("stdev_samp")))
    rows = rows.withColumn("sr0", N.expected_max_sharpe(F.coalesce("v", F.lit(0.0)), F.col("n_trials")))
    args = (F.col("n"), F.col("skew"), F.col("kurtosis"))
    out = rows.select(
        "n_trials", F.col("n").alias("n_observations"), F.col("sr").alias("raw_sharpe"), "skew", "kurtosis",
        F.sqrt(F.coalesce("v", F.lit(0.0))).alias("trial_sharpe_stdev"), F.col("sr0").alias("expected_max_sharpe"),
        N.probabilistic_sharpe(F.col("sr"), F.lit(0.0), *args).alias("probabilistic_sharpe"),
        N.probabilistic_sharpe(F.col("sr"), F.col("sr0"), *args).alias("deflated_sharpe"),
        N.min_track_record(F.col("sr"), F.lit(0.0), F.col("skew"), F.col("kurtosis"), confidence).alias("min_track_record"))
    d = F.col("deflated_sharpe")
    return out.withColumn("significant", d >= confidence).withColumn(
        "verdict", F.when(d >= confidence, "survives_selection").when(F.col("raw_sharpe") <= F.col("expected_max_sharpe"), "below_luck_bar")
        .otherwise("too_short_to_confirm"))


def pbo_splits(groups: int) -> list[int]:
    """Bit masks of all in-sample halves; at most C(10, 5) = 252."""
    return [sum(1 << g for g in chosen) for chosen in combinations(range(groups), groups // 2)]


def backtest_overfitting(trials: DataFrame, slices: int, min_slices: int = 8, max_groups: int = 10) -> DataFrame:
    """Probability that the in-sample best ranks below the median out of sample (CSCV).

    Slices are cut into contiguous groups; a configuration is one small array of group sums, and each
    configuration is scored on every split in place. ``slices`` is the number of sessions.
    """
    groups = min(max_groups, slices - slices % 2)
    spark = trials.sparkSession
    if slices < min_slices:
        return spark.createDataFrame([("insufficient_slices", None, slices, 0, 0)], "status string, pbo double, slices int, groups int, splits int")
    pos = trials.select("session").distinct().withColumn("grp", F.ntile(groups).over(Window.orderBy("session")) - 1)
    sums = trials.join(F.broadcast(pos), "session").groupBy("config_id").agg(
        *[F.sum(F.when(F.col("grp") == g, F.col("net_pnl")).otherwise(0.0)).alias(f"g{g}") for g in range(groups)])
    masks = pbo_splits(groups)
    scored = sums.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks])))
    bit = lambda g: F.col("mask").bitwiseAND(F.lit(1 << g)) != 0
    total = lambda want: F.round(sum((F.when(bit(g) if want else ~bit(g), F.col(f"g{g}")).otherwise(0.0) for g in range(groups)), F.lit(0.0)), 6)
    scored = scored.select("config_id", "mask", total(True).alias("ins"), total(False).alias("oos"))
    best = scored.groupBy("mask").agg(F.min_by("oos", F.struct(-F.col("ins"), "config_id")).alias("best_oos"), F.count(F.lit(1)).alias("n"))
    ranks = scored.join(F.broadcast(best), "mask").groupBy("mask").agg(  # at most 252 rows
        F.sum(F.when(F.col("oos") < F.col("best_oos"), 1).otherwise(0)).alias("beaten"), F.max("n").alias("n"))
    omega = (F.col("beaten") + 1) / (F.col("n") + 1)
    return ranks.agg(F.avg(F.when(F.ln(omega / (1 - omega)) <= 0, 1.0).otherwise(0.0)).alias("pbo")).select(
        F.lit("computed").alias("status"), "pbo", F.lit(slices).alias("slices"), F.lit(groups).alias("groups"), F.lit(len(masks)).alias("splits"))


def ablation(decisions: DataFrame) -> DataFrame:
    """Trade everything against abstaining on events: counts, convergence and a verdict."""
    traded, idle = F.col("outcome") == "trade", F.col("outcome") == "abstained"
    agg = decisions.agg(
        F.count(F.lit(1)).alias("cycles"), F.sum((traded | idle).cast("int")).alias("threshold_trades"), F.sum(traded.cast("int")).alias("policy_trades"),
        F.sum(idle.cast("int")).alias("abstained"),
        F.coalesce(F.avg(F.when(traded, F.col("captured").cast("double"))) * 100, F.lit(0.0)).alias("policy_converged_pct"),
        F.coalesce(F.avg(F.when(traded, F.col("captured").cast("double")).when(idle, F.col("would_converge").cast("double"))) * 100, F.lit(0.0)).alias("threshold_converged_pct"),
        F.coalesce(F.avg(F.when(idle, F.col("would_converge").cast("double"))) * 100, F.lit(0.0)).alias("abstained_would_converge_pct"))
    return agg.withColumn("verdict", F.when(F.col("abstained") == 0, "no_events")
                          .when(F.col("abstained_would_converge_pct") < F.col("threshold_converged_pct"), "good_judgment").otherwise("over_cautious"))
