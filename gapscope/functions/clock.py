"""Exchange calendar and Eastern clock as expressions over dates and epoch milliseconds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN_MINUTE, CLOSE_MINUTE, EARLY_MINUTE = 570, 960, 780

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def eastern(ms: Column) -> Column:
    """New York wall time of an epoch-millisecond column, daylight saving included."""
    utc = F.timestamp_millis(ms.cast("long"))
    return F.from_utc_timestamp(utc, "America/New_York")


def eastern_date(ms: Column, fixed_offset: bool = False) -> Column:
    """New York date; ``fixed_offset`` uses UTC-4 all year, as older macro calendars do."""
    local = F.timestamp_millis(ms.cast("long") - 4 * 3_600_000) if fixed_offset else eastern(ms)
    return F.to_date(local)


def eastern_minute(ms: Column) -> Column:
    local = eastern(ms)
    return F.hour(local) * 60 + F.minute(local)


def weekday(date: Column) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return F.dayofweek(date) - 1


def _date(year: Column, month: int, day: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))


def nth_weekday(year: Column, month: int, wanted: int, nth: int) -> Column:
    first = _date(year, month, 1)
    return F.date_add(first, (F.lit(wanted) - weekday(first) + 7) % 7 + (nth - 1) * 7)


def last_weekday(year: Column, month: int, wanted: int) -> Column:
    last = F.last_day(_date(year, month, 1))
    return F.date_sub(last, (weekday(last) - wanted + 7) % 7)


def observed(date: Column) -> Column:
    wd = weekday(date)
    return F.when(wd == 6, F.date_sub(date, 1)).when(wd == 0, F.date_add(date, 1)).otherwise(date)


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the anonymous computus."""
    div = lambda x, n: F.floor(x / n)
    golden, century, rest = year % 19, div(year, 100), year % 100
    leap_skip, leap_rest = div(century, 4), century % 4
    correction = div(century - div(century + 8, 25) + 1, 3)
    epact = (19 * golden + century - leap_skip - correction + 15) % 30
    sunday = (32 + 2 * leap_rest + 2 * div(rest, 4) - epact - rest % 4) % 7
    late = div(golden + 11 * epact + 22 * sunday, 451)
    n = epact + sunday - 7 * late + 114
    return F.make_date(year, div(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def closures(year: Column) -> list[tuple[Column, str]]:
    return [
        (observed(_date(year, 1, 1)), "New Year's Day"), (nth_weekday(year, 1, 1, 3), "Martin Luther King Jr. Day"),
        (nth_weekday(year, 2, 1, 3), "Washington's Birthday"), (F.date_sub(easter_sunday(year), 2), "Good Friday"),
        (last_weekday(year, 5, 1), "Memorial Day"), (observed(_date(year, 6, 19)), "Juneteenth National Independence Day"),
        (observed(_date(year, 7, 4)), "Independence Day"), (nth_weekday(year, 9, 1, 1), "Labor Day"),
        (nth_weekday(year, 11, 4, 4), "Thanksgiving Day"), (observed(_date(year, 12, 25)), "Christmas Day")]


def exchange_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per date: state, open and close minute, reason. Its size is the number of days asked for."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    d, y = F.col("date"), F.year("date")
    holiday = None
    for when, name in closures(y):
        holiday = F.when(d == when, name) if holiday is None else holiday.when(d == when, name)
    july = observed(_date(y, 7, 4))
    # The trading day before the July closure: no other closure falls between June 20 and July 3.
    before_july = F.date_sub(july, F.when(weekday(july) == 1, 3).otherwise(1))
    friday = F.date_add(nth_weekday(y, 11, 4, 4), 1)
    eve = _date(y, 12, 24)
    early = (F.when(d == before_july, "Day before Independence Day closure").when(d == friday, "Day after Thanksgiving")
             .when(d == eve, "Christmas Eve"))
    weekend = weekday(d).isin(0, 6)
    marked = days.select("date", F.when(weekend, "Weekend").otherwise(F.coalesce(holiday, early)).alias("reason"),
                         F.when(weekend, "weekend").when(holiday.isNotNull(), "holiday").when(early.isNotNull(), "early_close")
                         .otherwise("regular").alias("state"))
    close = (F.when(F.col("state").isin("weekend", "holiday"), 0).when(F.col("state") == "early_close", EARLY_MINUTE)
             .otherwise(CLOSE_MINUTE))
    return marked.select("date", "state", F.lit(OPEN_MINUTE).alias("open_minute"), close.alias("close_minute"), "reason")


def session_phase(df: DataFrame, calendar: DataFrame, ts: str = "ts") -> DataFrame:
    """Trading phase of each row from the Eastern clock and the calendar day (a small dimension)."""
    minute = eastern_minute(F.col(ts))
    rows = df.withColumn("et_date", eastern_date(F.col(ts))).withColumn("et_minute", minute)
    cal = calendar.select(F.col("date").alias("et_date"), F.col("state").alias("day_state"), "close_minute")
    m = F.col("et_minute")
    close = F.when(F.col("close_minute") > 0, F.col("close_minute")).otherwise(CLOSE_MINUTE)
    phase = (F.when(F.col("day_state") == "weekend", "WEEKEND").when(F.col("day_state") == "holiday", "HOLIDAY")
             .when((m >= OPEN_MINUTE) & (m < close), "STAND_DOWN").when((m >= close) & (m < 1200), "EARNINGS_SPRINT")
             .when((m >= 1200) | (m < 240), "OVERNIGHT").otherwise("PRE_OPEN"))
    trading_day = ~F.col("day_state").isin("weekend", "holiday")
    out = rows.join(F.broadcast(cal), "et_date", "left").withColumn("phase", phase)
    return out.withColumn("pre_open_cutoff", trading_day & (m >= 565) & (m < 570)).withColumn(
        "entries_allowed", F.col("phase").isin("WEEKEND", "HOLIDAY", "EARNINGS_SPRINT", "OVERNIGHT"))
