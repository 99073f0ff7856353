"""Series over time: by group, by status, by day; gap filling, overlays, heatmaps, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions import columns as C
from visitlens.functions import needles as N

FORMATS = {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH:00"}


def bucket(unit: str) -> Column:
    return F.date_format("ts", FORMATS[unit])


def activity(rows: DataFrame, unit: str = "day") -> DataFrame:
    """Requests per bucket and group."""
    return rows.groupBy(bucket(unit).alias("bucket")).agg(*[C.count_where(F.col("grp") == g).alias(g) for g in N.GROUPS], F.count("*").alias("total"))


def addresses(rows: DataFrame, unit: str = "day") -> DataFrame:
    """Distinct addresses per bucket and group: an address is one row a bucket before it is counted."""
    one = rows.groupBy(bucket(unit).alias("bucket"), "ip").agg(F.max("grp").alias("grp"))
    return one.groupBy("bucket").agg(*[C.count_where(F.col("grp") == g).alias(g) for g in N.GROUPS], F.count("*").alias("total"))


def filled(series: DataFrame, since: str, until: str, unit: str = "day") -> DataFrame:
    """The series with a zero row for each bucket of the window that has none; an empty series stays empty."""
    step = F.expr(f"interval 1 {unit}")
    start, end = F.lit(since[:10]).cast("timestamp_ntz"), F.date_add(F.lit(until[:10]).cast("date"), 1).cast("timestamp_ntz") - step
    spine = series.sparkSession.range(1).select(F.explode(F.sequence(start, end, step)).alias("ts")).select(bucket(unit).alias("bucket"))
    spine = spine.join(series.limit(1).select(F.lit(1).alias("_some")), how="cross").drop("_some")  # one row at most
    return spine.join(series, "bucket", "left").na.fill(0)


def overlay(every: DataFrame, new: DataFrame) -> DataFrame:
    """Each count with the same count of new addresses beside it."""
    keys = [c for c in every.columns if c != "bucket"]
    return every.join(new.select("bucket", *[F.col(k).alias(f"{k}_new") for k in keys]), "bucket", "left").na.fill(0)


def heatmap(rows: DataFrame) -> DataFrame:
    """Requests by weekday (Sunday 0) and hour."""
    return rows.groupBy((F.dayofweek("ts") - 1).alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("count"))


def heatmap_grid(cells: DataFrame) -> DataFrame:
    """All 7 x 24 cells, Monday first, with a logarithmic level between the least and the most of the filled ones."""
    spine = cells.sparkSession.range(168).select((F.col("id") / 24).cast("int").alias("row"), (F.col("id") % 24).cast("int").alias("hour")).withColumn("weekday", (F.col("row") + 1) % 7)
    ends = cells.agg(F.min("count").alias("low"), F.max("count").alias("high"))
    grid = spine.join(cells, ["weekday", "hour"], "left").join(ends, how="cross")  # ends is one row
    ramp = F.when(F.col("high") > F.col("low"), (F.ln("count") - F.ln("low")) / (F.ln("high") - F.ln("low"))).otherwise(1.0)
    return grid.select("row", "weekday", "hour", F.coalesce("count", F.lit(0)).alias("count"), F.when(F.col("count").isNull(), 0.0).otherwise(F.round(ramp, 4)).alias("level"))


def rate_limits(rows: DataFrame) -> DataFrame:
    kept = rows.filter(F.col("limit_req_status").isin("DELAYED", "REJECTED"))
    return kept.groupBy(bucket("day").alias("day")).agg(F.count("*").alias("total"), C.count_where(F.col("limit_req_status") == "REJECTED").alias("rejected"), C.count_where(F.col("limit_req_status") == "DELAYED").alias("delayed"))


def statuses(rows: DataFrame) -> DataFrame:
    return rows.groupBy(bucket("day").alias("day")).agg(*C.status_bands())


def daily(rows: DataFrame) -> DataFrame:
    """Visits, errors, bytes and error share per day."""
    errors = C.count_where(F.col("status") >= 400)
    return rows.groupBy(bucket("day").alias("day")).agg(F.count("*").alias("visits"), errors.alias("errors"), F.sum("bytes_sent").cast("long").alias("bytes"), F.round(100.0 * errors / F.count("*"), 1).alias("error_rate"))


def delta(visits: DataFrame, since: str, until: str, days: int) -> DataFrame:
    """Figures of a window and of the equal one before it, with the change in percent, null where there was nothing."""
    start, end = F.lit(since[:10]).cast("timestamp_ntz"), F.date_add(F.lit(until[:10]).cast("date"), 1).cast("timestamp_ntz")
    before = F.date_sub(F.lit(since[:10]).cast("date"), days).cast("timestamp_ntz")
    marked = visits.filter((F.col("ts") >= before) & (F.col("ts") < end)).withColumn("now", F.col("ts") >= start)
    one = marked.groupBy("ip").agg(C.count_where(F.col("now")).alias("n"), C.count_where(~F.col("now")).alias("p"))
    both = one.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("visits"), F.coalesce(F.sum("p"), F.lit(0)).cast("long").alias("visits_before"), C.count_where(F.col("n") > 0).alias("ips"), C.count_where(F.col("p") > 0).alias("ips_before"))
    change = lambda a, b: F.round(F.try_divide(100.0 * (F.col(a) - F.col(b)), F.col(b)), 1)
    return both.withColumns({"visits_delta": change("visits", "visits_before"), "ips_delta": change("ips", "ips_before")})
