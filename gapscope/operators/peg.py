"""Instrument ticks: leg assembly, derived gap columns, event cards, perception, certificates."""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock as K
from ..functions import pricing as P
from ..functions import rules as R
from ..session import cut_lineage
from .ordered import running

HOUR_MS = 3_600_000


def fill_quote(df: DataFrame) -> DataFrame:
    """Fill a missing bid or ask from mid then last, and a missing last from mid."""
    spare = F.coalesce(F.col("mid"), F.col("last"))
    return (df.withColumn("bid", F.coalesce("bid", spare)).withColumn("ask", F.coalesce("ask", spare))
            .withColumn("last", F.coalesce("last", "mid")))


def explode_snapshots(snapshots: DataFrame) -> DataFrame:
    """One row per (ts, ticker) from snapshot records."""
    return snapshots.select("ts", F.explode("rows").alias("row")).select("ts", "row.*")


def snapshot_quotes(rows: DataFrame, legs: Mapping[str, str]) -> DataFrame:
    """Long quotes of the legs that exist (``{leg name: struct column}``), holes filled."""
    parts = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(
            F.lit(name).alias("leg"), F.col(f"{c}.symbol").alias("symbol"), F.col(f"{c}.bid").alias("bid"),
            F.col(f"{c}.ask").alias("ask"), F.col(f"{c}.last").alias("last"), F.col(f"{c}.mid").alias("mid")))
        for name, c in legs.items()]))
    return fill_quote(rows.select("ts", "ticker", F.explode(parts).alias("q")).select("ts", "ticker", "q.*"))


def assemble_legs(universe: DataFrame, at: Sequence[str], legs: Mapping[str, DataFrame]) -> DataFrame:
    """Left-join each leg to the (time, ticker) grid; a leg that did not quote stays NULL."""
    out = universe
    for name, leg in legs.items():
        renamed = leg.select(*at, *[F.col(c).alias(f"{name}_{c}") for c in leg.columns if c not in at])
        out = out.join(renamed, list(at), "left")
    return out


def derive(df: DataFrame, multiplier: Column | None = None) -> DataFrame:
    """Gap columns of assembled legs; triangulation only where all three venues list the ticker."""
    m = multiplier if multiplier is not None else F.lit(1.0)
    token, perp, anchor = F.col("token_mid"), F.col("perp_mid"), F.col("equity_price")
    listed = P.total_return_adjust(F.col("listed_mid"), m)
    gap, true_gap = P.premium_pct(token, perp), P.premium_pct(token, anchor)
    tri = P.triangulate(token, perp, listed)
    out = df.select("*", listed.alias("listed_adj"), gap.alias("premium_pct"), true_gap.alias("true_gap_pct"), tri.alias("__tri"))
    only = lambda c: F.when(F.col("triple_listed"), F.col(f"__tri.{c}"))
    return out.select(
        *df.columns, "listed_adj", "premium_pct", P.classify_depeg(F.abs("premium_pct")).alias("state"),
        P.is_tradeable(F.abs("premium_pct")).alias("tradeable"), "true_gap_pct",
        P.classify_depeg(F.abs("true_gap_pct")).alias("true_state"),
        only("max_disagreement_pct").alias("max_disagreement_pct"),
        F.coalesce(only("flagged"), F.lit(False)).alias("flagged"))


def event_cards(peg: DataFrame, floor: float = P.FEE_FLOOR_PCT) -> DataFrame:
    """Cards for tradeable, stretched gaps: the gap to the real price first, the perp gap otherwise."""
    use_true = F.col("true_gap_pct").isNotNull()
    gap = F.when(use_true, F.col("true_gap_pct")).otherwise(F.col("premium_pct"))
    state = F.when(use_true, F.col("true_state")).otherwise(F.col("state"))
    has_book = F.coalesce(F.col("token_levels"), F.lit(0)) > 0
    rows = peg.withColumn("gap_pct", gap).withColumn("gap_state", state)
    rows = rows.filter((F.col("gap_state") != "NORMAL") & (F.abs("gap_pct") > floor))
    return rows.select(
        F.concat_ws("-", F.lit("basis"), "ticker", F.col("snap_ts").cast("string")).alias("event_id"), "ticker",
        F.col("snap_ts").alias("ts"), F.when(F.col("gap_pct") < 0, "long").otherwise("short").alias("direction"),
        F.abs("gap_pct").alias("magnitude"), P.event_confidence(F.abs("gap_pct"), has_book, floor).alias("confidence"),
        F.lit(120).alias("half_life_min"), F.when(use_true, "equity").otherwise("perp").alias("gap_kind"), "gap_pct",
        "gap_state", "premium_pct", F.col("equity_price").alias("fair_value"), F.col("token_mid").alias("price"))


def merge_cards(*lists: DataFrame) -> DataFrame:
    """Union of card lists; the first list that holds an id wins."""
    out = None
    for i, cards in enumerate(lists):
        ranked = cards.withColumn("__list", F.lit(i))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in ("event_id", "__list")]
    best = F.min_by(F.struct(*rest), F.col("__list")).alias("__r")
    return out.groupBy("event_id").agg(best).select("event_id", *[F.col(f"__r.{c}").alias(c) for c in rest])


# --- perception ------------------------------------------------------------------------------

def interval_counts(points: DataFrame, events: DataFrame, keys: Sequence[str], flags: Sequence[str],
                    slice_rows: int | None = None, include_lo: bool = True, dtype: str = "long") -> DataFrame:
    """Running totals of the flagged events up to ``lo`` and up to ``hi`` of each point.

    Two readings of one running sum; no (point, event) pair is formed. ``points`` holds the keys, ``lo``
    and ``hi``, unique on all three. Their difference covers [lo, hi], or (lo, hi] without ``include_lo``.
    """
    k = list(keys)
    lo_side = 0 if include_lo else 2
    zero = [F.lit(0).cast(dtype).alias(f) for f in flags]
    axis = events.select(*k, "t", F.lit(1).alias("side"), *[F.col(f).cast(dtype).alias(f) for f in flags])
    pid = F.struct("lo", "hi").alias("p")
    axis = axis.unionByName(points.select(*k, F.col("lo").alias("t"), F.lit(lo_side).alias("side"), F.lit("lo").alias("end"), *zero, pid), allowMissingColumns=True)
    axis = axis.unionByName(points.select(*k, F.col("hi").alias("t"), F.lit(2).alias("side"), F.lit("hi").alias("end"), *zero, pid), allowMissingColumns=True)
    summed = running(axis, k, ["t", "side"], {f"__{f}": ("sum", F.col(f)) for f in flags}, F.col("t"), slice_rows=slice_rows)
    ends = summed.filter(F.col("p").isNotNull()).groupBy(*k, "p").agg(
        *[F.max(F.when(F.col("end") == n, F.col(f"__{f}"))).alias(f"{f}_{n}") for f in flags for n in ("lo", "hi")])
    return ends.select(*k, "p.lo", "p.hi", *[f"{f}_{n}" for f in flags for n in ("lo", "hi")])


def mention_pattern(alias: str) -> str:
    """Whole-word pattern of a plain word, substring pattern of anything else; case is ignored."""
    esc = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", alias)
    return f"(?i)(^|[^A-Za-z0-9_]){esc}($|[^A-Za-z0-9_])" if re.fullmatch(r"[A-Za-z0-9]+", alias) else f"(?i){esc}"


def mentions(news: DataFrame, aliases: Mapping[str, Sequence[str]], catalyst: str = R.CATALYST,
             earnings: str = R.EARNINGS) -> DataFrame:
    """One row per headline and ticker it names, by its symbol or one of its names; the alias list is a fixed dimension.

    All plain words are found in one pass over each text, however many tickers there are: whole words never
    overlap, so one alternation misses none. Names with other characters are searched as phrases.
    """
    owners: dict[str, list[str]] = {}
    phrases = []
    for ticker, names in aliases.items():
        for a in dict.fromkeys((ticker, *names)):
            if re.fullmatch(r"[A-Za-z0-9]+", a):
                owners.setdefault(a.lower(), []).append(ticker)
            else:
                phrases.append(F.when(F.col("title").rlike(mention_pattern(a)), F.lit(ticker)))
    found = F.array().cast("array<string>")
    if owners:
        pattern = rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(sorted(owners))})(?![A-Za-z0-9_])"
        lookup = F.create_map(*[x for w, ts in owners.items() for x in (F.lit(w), F.array(*[F.lit(t) for t in ts]))])
        words = F.array_distinct(F.regexp_extract_all("title", F.lit(pattern), F.lit(0)))
        found = F.flatten(F.transform(words, lambda w: F.element_at(lookup, F.lower(w))))
    if phrases:
        found = F.concat(found, F.array_compact(F.array(*phrases)))
    # Every search runs once per text, before the texts are repeated per ticker.
    marked = news.filter(F.col("published_at") > 0).select(
        F.array_distinct(found).alias("__f"), F.col("published_at").alias("t"), "news_id", "title",
        F.col("title").rlike(catalyst).alias("catalyst"), F.col("title").rlike(earnings).alias("earnings"))
    # The outer explode keeps the search expression in one place; a plain one would add a filter that repeats it.
    rows = marked.select(F.explode_outer("__f").alias("ticker"), "t", "news_id", "title", "catalyst", "earnings")
    return rows.filter(F.col("ticker").isNotNull())


def news_context(points: DataFrame, news: DataFrame, aliases: Mapping[str, Sequence[str]], window_ms: int = 24 * HOUR_MS,
                 catalyst: str = R.CATALYST, earnings: str = R.EARNINGS, top: int = 3) -> DataFrame:
    """News in the look-back of each (ticker, now): counts, freshness, latest headline, newest catalysts.

    Headlines published after ``now`` never count.
    """
    asked = points.select("ticker", (F.col("now") - window_ms).alias("lo"), F.col("now").alias("hi")).distinct()
    # One pass over the texts; the narrow mention table is kept in the shared folder for its four readers.
    named = cut_lineage(mentions(news, aliases, catalyst, earnings).drop("title"))
    counted = running(named, ["ticker"], ["t", "news_id"], {
        "rel_i": ("sum", F.lit(1).cast("long")), "cat_i": ("sum", F.col("catalyst").cast("long"))}, F.col("t"))
    flagged = named.select("ticker", "t", F.lit(1).alias("rel"), F.col("catalyst").cast("int").alias("cat"))
    own = interval_counts(asked, flagged, ["ticker"], ["rel", "cat"])
    every = interval_counts(
        asked.select(F.lit(0).alias("g"), "lo", "hi").distinct(),
        news.filter(F.col("published_at") > 0).select(F.lit(0).alias("g"), F.col("published_at").alias("t"), F.lit(1).alias("any")),
        ["g"], ["any"]).drop("g")

    # Positions of the wanted headlines: the newest mention and up to ``top`` newest catalysts.
    newest = F.sequence(F.greatest(F.col("cat_lo"), F.col("cat_hi") - top) + 1, F.col("cat_hi"))
    picks = F.concat(
        F.when(F.col("rel_hi") > F.col("rel_lo"), F.array(F.struct(F.lit("rel").alias("list"), F.col("rel_hi").alias("i"))))
        .otherwise(F.array().cast("array<struct<list:string,i:bigint>>")),
        F.when(F.col("cat_hi") > F.col("cat_lo"), F.transform(newest, lambda x: F.struct(F.lit("cat").alias("list"), x.alias("i"))))
        .otherwise(F.array().cast("array<struct<list:string,i:bigint>>")))
    wanted = own.select("ticker", "lo", "hi", F.explode(picks).alias("w")).select("ticker", "lo", "hi", "w.*")
    places = counted.select("ticker", "news_id", "earnings", F.explode(F.array_compact(F.array(
        F.struct(F.lit("rel").alias("list"), F.col("rel_i").alias("i")),
        F.when(F.col("catalyst"), F.struct(F.lit("cat").alias("list"), F.col("cat_i").alias("i")))))).alias("p")).select(
        "ticker", "news_id", "earnings", "p.*")
    found = wanted.join(places, ["ticker", "list", "i"]).join(news.select("news_id", "title"), "news_id")
    in_cat = F.col("list") == "cat"
    lists = found.groupBy("ticker", "lo", "hi").agg(
        F.collect_list(F.when(in_cat, F.struct("i", "title"))).alias("__cats"), F.max(F.when(in_cat, F.col("earnings"))).alias("earnings"),
        F.max(F.when(~in_cat, F.col("title"))).alias("latest_title"))
    out = own.join(every, ["lo", "hi"]).join(lists, ["ticker", "lo", "hi"], "left")
    matched = F.transform(F.sort_array("__cats", asc=False), lambda x: x["title"])
    return out.select(
        "ticker", F.col("hi").alias("now"), (F.col("any_hi") - F.col("any_lo")).alias("recent_count"),
        (F.col("rel_hi") - F.col("rel_lo")).alias("relevant_count"), (F.col("cat_hi") > F.col("cat_lo")).alias("fresh"),
        F.coalesce(matched, F.array().cast("array<string>")).alias("matched"),
        F.coalesce("earnings", F.lit(False)).alias("earnings"), "latest_title")


def macro_context(points: DataFrame, calendar: DataFrame, fixed_offset: bool = True) -> DataFrame:
    """Macro severity of the Eastern date of each point. The calendar has one row per date."""
    date = F.date_format(K.eastern_date(F.col("now"), fixed_offset), "yyyy-MM-dd")
    days = calendar.select("date", R.day_severity(F.col("events")).alias("macro_severity"))
    joined = points.withColumn("date", date).join(days, "date", "left")
    severity = F.coalesce("macro_severity", F.lit("low"))
    return joined.withColumn("macro_severity", severity).withColumn("macro_active", severity == "high")


def classify(peg: DataFrame, news: DataFrame, macro: DataFrame) -> DataFrame:
    """Gap cause and action of each instrument tick, with its perception context."""
    n = news.select("ticker", F.col("now").alias("snap_ts"), "fresh", "earnings")
    m = macro.select("ticker", F.col("now").alias("snap_ts"), "macro_active", "macro_severity")
    rows = peg.join(n, ["ticker", "snap_ts"], "left").join(m, ["ticker", "snap_ts"], "left")
    return add_cause(rows.fillna({"fresh": False, "earnings": False, "macro_active": False, "macro_severity": "low"}))


def without_events(peg: DataFrame) -> DataFrame:
    """The context in which nothing happened, for replays that must stay offline."""
    return add_cause(peg.select("*", F.lit(False).alias("fresh"), F.lit(False).alias("earnings"),
                                F.lit(False).alias("macro_active"), F.lit("low").alias("macro_severity")))


def add_cause(rows: DataFrame) -> DataFrame:
    cause = R.classify_gap(F.col("true_gap_pct"), F.col("premium_pct"), F.col("token_levels"), F.col("token_mid"),
                           F.col("fresh"), F.col("earnings"), F.col("macro_active"), F.col("flagged"))
    return rows.withColumn("__c", cause).select(*rows.columns, "__c.*")


def certify(classified: DataFrame, grades: DataFrame | None = None, ttl_sec: int = 3600) -> DataFrame:
    """Certificate of every tick; unknown quality grades count as '?'."""
    rows = classified.join(grades, "ticker", "left") if grades is not None else classified.withColumn(
        "grade", F.lit(None).cast("string"))
    rows = rows.withColumn("grade", F.coalesce("grade", F.lit("?")))
    cert = R.certify(F.col("cause"), F.col("action"), F.col("true_gap_pct"), F.col("grade"), F.col("token_levels"),
                     F.col("token_mid"), F.col("market_state"), F.col("equity_price"), F.col("fresh"), F.col("macro_active"))
    rows = rows.withColumn("__t", cert)
    payload = R.certificate_payload(F.col("__t.classification"), F.col("__t.policy"), F.col("__t.safety_score"),
                                    F.col("equity_price").isNull(), F.col("snap_ts"), ttl_sec)
    return rows.select("*", F.col("__t.policy").alias("policy"), payload.alias("__p")).select(
        *[c for c in rows.columns if c != "__t"], "policy", "__p.*")
