"""The last full hour against the same site's own history, and a window's typical hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions import columns as C

DAYS, MIN_DAYS, FACTOR, FLOOR = 28, 14, 3.0, 10


def hourly(visits: DataFrame) -> DataFrame:
    """(hour, requests, probing_addresses) of hours that have requests."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    one = visits.groupBy(hour.alias("hour"), "ip").agg(F.count("*").alias("n"), C.count_where(C.is_probe_404()).alias("probes"))
    return one.groupBy("hour").agg(F.sum("n").cast("long").alias("requests"), C.count_where(F.col("probes") > 0).alias("probing_addresses"))


def padded_median(column: str, slots: Column) -> Column:
    """Median of a column over ``slots`` values of which those without a row are zero; over all rows where there are more, as with a first hour that isn't whole."""
    values = F.array_sort(F.collect_list(column))
    n = F.greatest(slots.cast("int"), F.size(values))
    nth = lambda i: F.coalesce(F.get(values, i - (n - F.size(values))), F.lit(0))
    return F.when(n > 0, (nth(F.floor((n - 1) / 2).cast("int")) + nth(F.floor(n / 2).cast("int"))) / 2.0)


def hourly_baseline(visits: DataFrame, now: str, days: int = DAYS, min_days: int = MIN_DAYS) -> DataFrame:
    """One row: figures of the last full hour, the median of the hours before it, factors and verdicts."""
    start, end = _last_hour(now)
    recent = visits.filter((F.col("ts") < end) & (F.col("ts") >= start - F.expr(f"interval {days} days")))
    return against_history(hourly(recent), visits.agg(F.min("ts").alias("first")), now, days, min_days)


def _last_hour(now: str) -> tuple[Column, Column]:
    end = F.date_trunc("hour", F.lit(now).cast("timestamp_ntz")).cast("timestamp_ntz")
    return end - F.expr("interval 1 hour"), end


def against_history(hours: DataFrame, first: DataFrame, now: str, days: int = DAYS, min_days: int = MIN_DAYS) -> DataFrame:
    """The last full hour of (hour, requests, probing_addresses) against those before it; first is one row, the time of the first visit.

    At most 24 * days hours count, whatever the traffic.
    """
    start, end = _last_hour(now)
    hours = hours.filter((F.col("hour") < end) & (F.col("hour") >= start - F.expr(f"interval {days} days")))
    have = F.greatest(F.timestamp_diff("SECOND", F.col("first"), start) / 86400.0, F.lit(0.0))
    slots = F.floor(F.least(have, F.lit(float(days))) * 24)
    marked = hours.join(first, how="cross").withColumns({"_have": have, "_slots": slots, "_last": F.col("hour") == start})  # first is one row
    past = lambda c: F.when(~F.col("_last"), F.col(c))
    one = marked.withColumns({"_r": past("requests"), "_p": past("probing_addresses")}).groupBy().agg(
        F.max("_have").alias("have_days"),
        F.coalesce(F.max(F.when(F.col("_last"), F.col("requests"))), F.lit(0)).alias("requests"),
        F.coalesce(F.max(F.when(F.col("_last"), F.col("probing_addresses"))), F.lit(0)).alias("probing_addresses"),
        padded_median("_r", F.max("_slots")).alias("typical_requests"),
        padded_median("_p", F.max("_slots")).alias("typical_probing"),
    )
    factor = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 1)
    odd = lambda a, b: F.coalesce((F.col(a) >= FLOOR) & (F.col(a) >= FACTOR * F.col(b)) & F.col("enough_history"), F.lit(False))
    one = one.withColumns({"have_days": F.round("have_days", 2), "enough_history": F.coalesce(F.col("have_days") >= min_days, F.lit(False)), "requests_factor": factor("requests", "typical_requests"), "probing_factor": factor("probing_addresses", "typical_probing")})
    return one.withColumns({"requests_unusual": odd("requests", "typical_requests"), "probing_unusual": odd("probing_addresses", "typical_probing")})


def typical_hour(visits: DataFrame) -> DataFrame:
    """One row: median requests and probing addresses an hour between the first and the last visit, empty hours included."""
    hours = hourly(visits)
    slots = F.floor(F.timestamp_diff("HOUR", F.min("hour"), F.max("hour")) + 1)
    return hours.groupBy().agg(slots.cast("long").alias("hours"), padded_median("requests", slots).alias("requests"), padded_median("probing_addresses", slots).alias("probing_addresses"))
