"""Stored months as transactions: archive, release, delete and restore of visits and of what is known about their addresses.

Visits lie in a folder a month; intel and host values are snapshots. An archive is written beside what it shall replace, read back, and held against the live
month (rows, addresses, first and last time, a sum of row hashes) before its line goes into the manifest; only a month whose line is there is ever
dropped for it. Every step can run again: what is done already changes nothing, and a crash leaves either the live month or a whole archive, or both.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.sources.archive import purge_orphans

_LINE = "month string, folder string, visits long, addresses long, first string, last string, hash decimal(38,0), at long, gone boolean"
_CHECKED = ["visits", "addresses", "first", "last", "hash"]


class NoArchive(FileNotFoundError):
    """The month has no archive, so its rows aren't dropped."""


class NotWhole(ValueError):
    """An archive doesn't hold what its month holds."""


@dataclass(frozen=True)
class Snapshot:
    """A table that is replaced as a whole: each version has a folder, the last line says which one counts."""

    spark: SparkSession
    path: str
    schema: str

    def _version(self) -> int:
        self.spark.createDataFrame([(0,)], "version long").coalesce(1).write.mode("ignore").json(f"{self.path}/lines/0")
        return self.spark.read.schema("version long").json(f"{self.path}/lines/*").agg(F.max("version")).first()[0]

    def read(self) -> DataFrame:
        at = f"{self.path}/version-{self._version()}"
        self.spark.createDataFrame([], self.schema).write.mode("ignore").parquet(at)
        return self.spark.read.schema(self.schema).parquet(at)

    def replace(self, rows: DataFrame) -> None:
        new = self._version() + 1
        columns = self.spark.createDataFrame([], self.schema).columns
        rows.select(columns).write.mode("overwrite").parquet(f"{self.path}/version-{new}")
        self.spark.createDataFrame([(new,)], "version long").coalesce(1).write.mode("overwrite").json(f"{self.path}/lines/{new}")


class MonthStore:
    """Visits by month, intel and host values under ``root``; archives under ``archive``; pins keep restored months from going again."""

    def __init__(self, spark: SparkSession, root: str, archive: str, visits: str, intel: str):
        self.spark, self.root, self.archives, self.schema = spark, root, archive, visits
        self.intel = Snapshot(spark, f"{root}/intel", intel)
        self.values = Snapshot(spark, f"{root}/values", "ip string, kind string, value string")
        self.pins = Snapshot(spark, f"{root}/pins", "month string, until string")

    # ---- what is there ------------------------------------------------------------------------

    def add(self, visits: DataFrame) -> None:
        visits.select(self._columns).withColumn("month", F.date_format("ts", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(f"{self.root}/visits")

    @property
    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def visits(self, month: str | None = None) -> DataFrame:
        """All live visits with their month, or one month's, of which the folder alone is read."""
        self.spark.createDataFrame([], f"{self.schema}, month string").write.mode("ignore").partitionBy("month").parquet(f"{self.root}/visits")
        rows = self.spark.read.schema(f"{self.schema}, month string").parquet(f"{self.root}/visits")
        return rows if month is None else rows.filter(F.col("month") == month).drop("month")

    def _lines(self) -> DataFrame:
        self.spark.createDataFrame([], _LINE).write.mode("ignore").json(f"{self.archives}/lines/none")
        lines = self.spark.read.schema(_LINE).json(f"{self.archives}/lines/*")
        return lines.groupBy("month").agg(F.max_by(F.struct(*lines.columns[1:]), "at").alias("x")).select("month", "x.*").filter("not gone")

    def archived(self, month: str) -> dict | None:
        """The line of a month's archive, or nothing."""
        found = self._lines().filter(F.col("month") == month).first()
        return found.asDict() if found else None

    def _say(self, month: str, line: dict, gone: bool) -> None:
        after = (self.spark.read.schema(_LINE).json(f"{self.archives}/lines/*").agg(F.max("at")).first()[0] or 0) + 1
        row = (month, line["folder"], *[line[c] for c in _CHECKED], after, gone)
        self.spark.createDataFrame([row], _LINE).coalesce(1).write.mode("overwrite").json(f"{self.archives}/lines/{after}-{uuid.uuid4()}")

    def _fingerprint(self, visits: DataFrame) -> dict:
        """Counts and ends of some visits, and a sum of their hashes that no order changes."""
        row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in self._columns]).cast("decimal(20,0)")
        return visits.agg(F.count("*").alias("visits"), F.countDistinct("ip").alias("addresses"), F.min("ts").cast("string").alias("first"), F.max("ts").cast("string").alias("last"), F.coalesce(F.sum(row), F.lit(0)).cast("decimal(38,0)").alias("hash")).first().asDict()

    # ---- steps --------------------------------------------------------------------------------

    def archive(self, month: str) -> dict:
        """Write a month's archive and, once it is known to be whole, drop the month. A month without visits keeps the archive it has."""
        live = self.visits(month)
        print_ = self._fingerprint(live)
        have = self.archived(month)
        if not print_["visits"]:
            return have or {}
        if have is None or any(have[c] != print_[c] for c in _CHECKED):
            folder = f"{month}-{uuid.uuid4()}"
            at = f"{self.archives}/{folder}"
            live.write.json(f"{at}/visits")
            of_month = live.select("ip").distinct().persist()
            self.intel.read().join(of_month, "ip", "left_semi").write.json(f"{at}/intel")
            self.values.read().join(of_month, "ip", "left_semi").write.json(f"{at}/values")
            of_month.unpersist()
            self._publish(month, folder, print_)
        self._drop(month)
        return self.archived(month)

    def _publish(self, month: str, folder: str, want: dict) -> None:
        """The archive's line, if what was written reads back as what the month held."""
        got = self._fingerprint(self.spark.read.schema(self.schema).json(f"{self.archives}/{folder}/visits"))
        if got != want:
            raise NotWhole(f"the archive of {month} holds {got}, the month {want}")
        self._say(month, {"folder": folder, **got}, False)

    def _drop(self, month: str) -> None:
        """Replace a month's folder by an empty one, take its pin away, and forget addresses without a visit."""
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.root}/visits/month={month}")
        pins = self.pins.read()
        if not pins.filter(F.col("month") == month).isEmpty():
            self.pins.replace(pins.filter(F.col("month") != month))
        seen = self.visits().select("ip").distinct().persist()  # the visits are read once for both tables
        for table in (self.intel, self.values):
            rows = table.read()
            if not rows.join(seen, "ip", "left_anti").isEmpty():
                table.replace(purge_orphans(rows, seen))
        seen.unpersist()

    def restore(self, month: str, until: str) -> dict:
        """Put an archived month back, original ids, and pin it: nothing that is there is replaced, and a second run adds nothing."""
        line = self.archived(month)
        if line is None:
            raise NoArchive(month)
        at = f"{self.archives}/{line['folder']}"
        back = self.spark.read.schema(self.schema).json(f"{at}/visits")
        if any(self._fingerprint(back)[c] != line[c] for c in _CHECKED):
            raise NotWhole(f"the archive of {month} is not what was written")
        missing = back.join(self.visits(month).select("id"), "id", "left_anti").persist()
        added = missing.count()
        if added:
            self.add(missing)
        missing.unpersist()
        for table, name in ((self.intel, "intel"), (self.values, "values")):
            have = table.read()
            more = self.spark.read.schema(table.schema).json(f"{at}/{name}").join(have.select("ip").distinct(), "ip", "left_anti")
            if not more.isEmpty():
                table.replace(have.unionByName(more))
        if self.pins.read().filter((F.col("month") == month) & (F.col("until") == until)).isEmpty():
            self.pins.replace(self.pins.read().filter(F.col("month") != month).union(self.spark.createDataFrame([(month, until)], self.pins.schema)))
        return {"month": month, "visits": added, "until": until}

    def release(self, month: str) -> int:
        """Drop a restored month again. Its archive must be there; rows that the archive lacks keep the month."""
        line = self.archived(month)
        if line is None:
            raise NoArchive(month)
        live = self.visits(month)
        kept = self.spark.read.schema(self.schema).json(f"{self.archives}/{line['folder']}/visits").select("id")
        if not live.join(kept, "id", "left_anti").isEmpty():
            raise NotWhole(f"{month} has visits that its archive lacks; archive it instead")
        n = live.count()
        self._drop(month)
        return n

    def delete(self, month: str) -> int:
        """Drop a month, archived or not."""
        n = self.visits(month).count()
        self._drop(month)
        return n

    def delete_archive(self, month: str) -> None:
        """Forget a month's archive; live rows and the pin's end stay what they are: ordinary visits."""
        line = self.archived(month)
        if line is None:
            raise NoArchive(month)
        self._say(month, line, True)
        self.pins.replace(self.pins.read().filter(F.col("month") != month))

    def settle(self, now: str, plan: DataFrame) -> None:
        """Do what a retention plan says: archive or expire months; a pin that is over releases its month, one that holds keeps it."""
        over = {r.month: r.until < now for r in self.pins.read().collect()}  # one row a restored month
        for month, past in sorted(over.items()):
            if past:
                self.release(month)
        for r in plan.filter(F.col("action") != "keep").orderBy("month").collect():  # one row a month
            if r.action == "archive" and not (r.month in over and not over[r.month]):
                self.archive(r.month)
            elif r.action == "expire" and self.archived(r.month):
                self.delete_archive(r.month)
