"""State that streams keep between batches as tables of facts that add up, so that a batch reads itself and what it touches, never the visits before.

A ``Facts`` table is a folder of parts: each batch adds the fold of its own rows, under its number, and readers fold the parts they need. A batch that
runs again overwrites its own part. From time to time parts are folded into a new generation; readers turn to it when its line in the
manifest is there, which is written last, so a crash at any point leaves the old generation or the new one, and batches that a
generation holds are not added again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.functions import columns as C
from visitlens.operators import baseline, classify

BUCKETS = 256


@dataclass(frozen=True)
class Facts:
    """A table of facts: keys, how each other column folds (sum, min, max, bit_or), and the column (of whole numbers or text) its folders are cut by."""

    spark: SparkSession
    path: str
    schema: str
    folds: tuple[tuple[str, str], ...]
    part: str

    @property
    def keys(self) -> list[str]:
        folded = dict(self.folds)
        return [x.split()[0] for x in self.schema.split(", ") if x.split()[0] not in folded]

    def fold(self, rows: DataFrame) -> DataFrame:
        kinds = dict(x.split() for x in self.schema.split(", "))
        return rows.groupBy(*self.keys).agg(*[getattr(F, how)(c).cast(kinds[c]).alias(c) for c, how in self.folds])

    def _generation(self) -> tuple[int, int]:
        """The generation in use, and the last batch that it holds folded."""
        self.spark.createDataFrame([(0, -1)], "gen long, upto long").coalesce(1).write.mode("ignore").json(f"{self.path}/manifest/0")
        found = self.spark.read.schema("gen long, upto long").json(f"{self.path}/manifest/*").orderBy(F.col("gen").desc()).first()
        return found.gen, found.upto

    def _at(self, generation: int) -> str:
        return f"{self.path}/parts-{generation}"

    def _write(self, rows: DataFrame, generation: int, number: int) -> None:
        rows.repartition(self.part).write.mode("overwrite").partitionBy(self.part).parquet(f"{self._at(generation)}/batch={number}")

    def add(self, rows: DataFrame, number: int) -> None:
        """A batch's own rows, folded or not."""
        generation, upto = self._generation()
        if number > upto:
            self._write(self.fold(rows), generation, number)

    def read(self, parts: list | None = None) -> DataFrame:
        """One row a key; of some parts where these are given, whose folders alone are read."""
        generation, _ = self._generation()
        self._empty(generation)
        rows = self.spark.read.schema(f"{self.schema}, batch long").option("basePath", self._at(generation)).parquet(self._at(generation))
        return self.fold(rows if parts is None else rows.filter(F.col(self.part).isin(parts)))

    def _empty(self, generation: int) -> None:
        self.spark.createDataFrame([], self.schema).write.mode("ignore").partitionBy(self.part).parquet(f"{self._at(generation)}/batch=-1")

    def compact(self, upto: int) -> None:
        """Fold all parts into a new generation. Run it between batches, after the batch ``upto`` was added."""
        generation, held = self._generation()
        if upto > held:
            self._write(self.read(), generation + 1, upto)
            self.spark.createDataFrame([(generation + 1, upto)], "gen long, upto long").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{generation + 1}")


def bucket_of(ip: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ip), F.lit(buckets)).cast("int")


# ---- evidence -------------------------------------------------------------------------------

_COUNTERS = ["total", "content_requests", "non_http", "browser_navigate", "has_zstd", "http2_visits", "err404", "bot_device", "internal_nav", "cross_site_nav", "bad_requests"]


class EvidenceState:
    """What the classifier has to know of every address: counters by path and agent masks, in folders by a hash of the address."""

    def __init__(self, spark: SparkSession, path: str, host: str = "", js_prefixes: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.host, self.js_prefixes, self.buckets = host, js_prefixes, buckets
        counters = ", ".join(f"{c} long" for c in _COUNTERS)
        self.paths = Facts(spark, f"{path}/paths", f"ip string, path string, last_id long, {counters}, bucket int", (("last_id", "max"), *((c, "sum") for c in _COUNTERS)), "bucket")
        self.agents = Facts(spark, f"{path}/agents", "ip string, agent_mask long, bucket int", (("agent_mask", "bit_or"),), "bucket")

    def add(self, visits: DataFrame, number: int) -> None:
        bucket = bucket_of(F.col("ip"), self.buckets)
        self.paths.add(classify.path_facts(visits, self.host).withColumn("bucket", bucket), number)
        self.agents.add(classify.agent_facts(visits).withColumn("bucket", bucket), number)

    def evidence(self, addresses: DataFrame, dim: DataFrame) -> DataFrame:
        """Evidence of these addresses on all that was added, from the folders of their buckets."""
        some = addresses.select("ip").distinct()
        touched = [r.b for r in some.select(bucket_of(F.col("ip"), self.buckets).alias("b")).distinct().collect()]  # ``buckets`` numbers at most
        of_them = lambda facts: facts.read(touched).join(some, "ip", "left_semi").drop("bucket")
        return classify.evidence_of(of_them(self.paths), of_them(self.agents), dim, self.js_prefixes)

    def compact(self, upto: int) -> None:
        self.paths.compact(upto)
        self.agents.compact(upto)


# ---- hours ----------------------------------------------------------------------------------


class HourlyRollup:
    """Requests and probing addresses of every hour, kept up batch by batch. Late rows replace the hours they fall in.

    Distinct addresses don't add up, so the rows by (hour, address) stay, in folders by day; the hours' totals are what alarms read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.totals = spark, f"{path}/hours"
        self.addresses = Facts(spark, f"{path}/addresses", "hour timestamp_ntz, ip string, n long, probes long, first timestamp_ntz, day string", (("n", "sum"), ("probes", "sum"), ("first", "min")), "day")

    def add(self, visits: DataFrame, number: int) -> None:
        """Add a batch, and write the totals of the days it touches anew."""
        hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
        rows = visits.groupBy(hour.alias("hour"), "ip").agg(F.count("*").alias("n"), C.count_where(C.is_probe_404()).alias("probes"), F.min("ts").alias("first"))
        self.addresses.add(rows.withColumn("day", F.date_format("hour", "yyyy-MM-dd")), number)
        days = [r.day for r in visits.select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct().collect()]
        if days:
            found = self.addresses.read(days).groupBy("hour", "day").agg(F.sum("n").cast("long").alias("requests"), C.count_where(F.col("probes") > 0).alias("probing_addresses"), F.min("first").alias("first"))
            found.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.totals)

    def hours(self) -> DataFrame:
        """(hour, requests, probing_addresses, first, day)."""
        schema = "hour timestamp_ntz, requests long, probing_addresses long, first timestamp_ntz, day string"
        self.spark.createDataFrame([], schema).write.mode("ignore").partitionBy("day").parquet(self.totals)
        return self.spark.read.schema(schema).parquet(self.totals)

    def baseline(self, now: str, **how) -> DataFrame:
        """The last full hour against the hours before it, as ``baseline.hourly_baseline`` finds it on all visits."""
        hours = self.hours()
        return baseline.against_history(hours.select("hour", "requests", "probing_addresses"), hours.agg(F.min("first").alias("first")), now, **how)
