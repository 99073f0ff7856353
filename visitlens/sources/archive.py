"""Stored visits: export, months, archives, retention, restoring, deleting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.functions import columns as C


def months(visits: DataFrame) -> DataFrame:
    return visits.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("visits"), F.countDistinct("ip").alias("unique_ips"))


def earliest_day(visits: DataFrame) -> DataFrame:
    return visits.agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("day"))


def write_visits(visits: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by month, so a window reads its months alone."""
    visits.withColumn("month", F.date_format("ts", "yyyy-MM")).write.mode(mode).partitionBy("month").parquet(path)


def export_rows(visits: DataFrame, columns: list[str], since: str | None = None, until: str | None = None, after: tuple[str, int] | None = None, limit: int | None = None) -> DataFrame:
    """Visits newest first; after is the (time, id) that the last page ended with. Cells can't start a formula."""
    rows = C.windowed(visits, since, until)
    if after:
        rows = rows.filter(F.struct("ts", "id") < F.struct(F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1]).cast("long")))
    rows = rows.orderBy(F.col("ts").desc(), F.col("id").desc())
    return (rows.limit(limit) if limit else rows).select(*[safe_cell(c).alias(c) if dict(visits.dtypes)[c] == "string" else F.col(c) for c in columns])


def safe_cell(c: str):
    text = F.replace(F.replace(F.col(c), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def write_export(rows: DataFrame, path: str, kind: str = "csv") -> None:
    writer = rows.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def archived_intel(visits: DataFrame, intel: DataFrame, values: DataFrame) -> DataFrame:
    """Intel of the addresses in these visits, their values as lists by kind."""
    lists = values.groupBy("ip").pivot("kind", ["port", "vuln", "tag", "cpe", "hostname"]).agg(F.array_sort(F.collect_set("value")))
    return intel.join(visits.select("ip").distinct(), "ip", "left_semi").join(lists, "ip", "left")


def archive_month(visits: DataFrame, intel: DataFrame, values: DataFrame, month: str, path: str) -> DataFrame:
    """Write a month's visits, intel and one row of counts under path/month; returns that row. Spark's _SUCCESS file marks each part whole."""
    rows = visits.filter(C.month_of(visits) == month)
    rows.orderBy("id").write.json(f"{path}/{month}/visits")
    archived_intel(rows, intel, values).write.json(f"{path}/{month}/intel")
    meta = rows.agg(F.lit(month).alias("month"), F.count("*").alias("visits"), F.countDistinct("ip").alias("addresses"), F.min("ts").cast("string").alias("first"), F.max("ts").cast("string").alias("last"))
    meta.write.json(f"{path}/{month}/meta")
    return meta


def restore_month(spark: SparkSession, visits: DataFrame, intel: DataFrame, path: str, month: str) -> tuple[DataFrame, DataFrame]:
    """Stored visits and intel with an archived month back in: original ids, nothing that is there replaced."""
    back = spark.read.schema(visits.schema).json(f"{path}/{month}/visits")
    more = spark.read.schema(intel.schema).json(f"{path}/{month}/intel")
    return (
        visits.unionByName(back.join(visits.select("id"), "id", "left_anti"), allowMissingColumns=True),
        intel.unionByName(more.join(intel.select("ip"), "ip", "left_anti"), allowMissingColumns=True),
    )


def retention_plan(inventory: DataFrame, now: str, keep_months: int = 2, pinned: list[str] = (), archive_months: int = 0) -> DataFrame:
    """(month, action) per month: keep, archive (older than the rolling months and not pinned) or expire (past the archive's time, 0: never)."""
    keep = max(0, min(24, keep_months))
    until = lambda n: F.date_format(F.add_months(F.trunc(F.lit(now).cast("date"), "MM"), -n), "yyyy-MM")
    pins = F.col("month").isin(list(pinned))
    archive = min(120, max(archive_months, keep + 1)) if archive_months else 0
    expired = (F.col("month") < until(archive)) if archive else F.lit(False)
    return inventory.withColumn("action", F.when(pins, "keep").when(expired, "expire").when(F.col("month") < until(keep), "archive").otherwise("keep"))


def delete_months(visits: DataFrame, gone: list[str]) -> DataFrame:
    return visits.filter(~C.month_of(visits).isin(gone))


def purge_orphans(intel: DataFrame, visits: DataFrame) -> DataFrame:
    """Intel of addresses that still have a visit."""
    return intel.join(visits.select("ip").distinct(), "ip", "left_semi")
