"""Continuous jobs over access logs: ingest, replays, hourly counts, sessions, classes, alarms, newcomers, quality.

Each builds a stream or starts one; the caller picks the trigger. State is bounded by the watermark:
rows later than it no longer change derived results, while the raw append keeps them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from visitlens.functions import columns as C
from visitlens.functions import needles as N
from visitlens.operators import baseline, classify
from visitlens.sources import logs
from visitlens.streaming.state import EvidenceState, HourlyRollup

LATE = "10 minutes"


def clocked(visits: DataFrame) -> DataFrame:
    """Visits with event_time, which watermarks need as an instant."""
    return visits.withColumn("event_time", F.col("ts").cast("timestamp"))


def ingest(lines: DataFrame, late: str = LATE, **how) -> DataFrame:
    """Log lines to visits without replays that arrive within the watermark."""
    return clocked(logs.to_visits(lines, **how)).withWatermark("event_time", late).dropDuplicatesWithinWatermark(["identity"])


def store(visits: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append visits by month; the checkpoint holds the restart position, so each line is stored once."""
    by_month = visits.drop("event_time").withColumn("month", F.date_format("ts", "yyyy-MM"))
    return by_month.writeStream.format("parquet").partitionBy("month").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def once(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """Per batch: append the visits that aren't stored yet, by month. A batch that runs again, whole or after a crash at any point, adds nothing twice.

    What is compared are identities, of the batch's months and span of time alone; requests without a connection number have an identity
    that is the same when their batch runs again. Identities are shuffled first; rows are only where a part of the batch is stored or repeated.
    A batch is read for its span, its identities and its new rows: one that is costly to work out is better held.
    """

    def work(batch: DataFrame, number: int) -> None:
        visits = batch.drop("event_time")
        schema = ", ".join(f"{c} {k}" for c, k in visits.dtypes) + ", month string"
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("month").parquet(path)
        text = lambda c: c.cast("string")
        spans = visits.groupBy(F.trunc("ts", "MM").alias("at")).agg(text(F.min("ts")).alias("first"), text(F.max("ts")).alias("last")).select(F.date_format("at", "yyyy-MM").alias("month"), "first", "last").collect()  # the months of one batch
        if not spans:
            return
        moment = lambda x: F.lit(x).cast("timestamp_ntz")
        within = [(F.col("month") == s.month) & F.col("ts").between(moment(s.first), moment(s.last)) if s.month else F.col("month").isNull() for s in spans]
        stored = spark.read.schema(schema).parquet(path).filter(reduce(or_, within))
        rows = logs.with_repeatable_identity(visits, number)
        both = rows.select("identity", F.lit(0).alias("old")).unionAll(stored.select("identity", F.lit(1).alias("old")))
        marks = both.groupBy("identity").agg(F.count_if(F.col("old") == 0).alias("n"), F.max("old").alias("old")).filter("n > 0")
        fresh, repeated, odd = (marks.filter(w) for w in (FRESH, REPEATED, ODD))
        found = marks.agg(*[F.count_if(F.expr(w)).alias(k) for k, w in (("fresh", FRESH), ("repeated", REPEATED), ("odd", ODD))]).first()
        near = lambda ids, n: F.broadcast(ids.select("identity")) if n <= NEAR else ids.select("identity")
        if not found.fresh:
            return
        if found.fresh < found.odd:
            rows = rows.join(near(fresh, found.fresh), "identity", "left_semi").dropDuplicates(["identity"])
        elif found.odd:
            single = rows.join(near(odd, found.odd), "identity", "left_anti")
            rows = single.unionByName(rows.join(near(repeated, found.repeated), "identity", "left_semi").dropDuplicates(["identity"])) if found.repeated else single
        by_month(rows.select(*visits.columns, F.date_format("ts", "yyyy-MM").alias("month")), path)

    return work


#: Of a batch's identities: not stored yet; of these, several times in the batch; those whose rows can't all be written as they are.
FRESH, REPEATED, ODD = "old = 0", "old = 0 and n > 1", "old = 1 or n > 1"
#: So many identities are sent to all tasks at most (some 10 MB).
NEAR = 100_000


def by_month(rows: DataFrame, path: str) -> None:
    """Append rows by their month. A task keeps the files of a few months open at once, so rows of few months aren't sorted by it."""
    conf, name = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, "3")
    try:
        rows.write.mode("append").partitionBy("month").parquet(path)
    finally:
        conf.set(name, before)


def counts(rows: DataFrame, unit: str = "1 hour", late: str = LATE) -> DataFrame:
    """Requests per tumbling window and group; rows are visits with their group."""
    per = rows.withWatermark("event_time", late).groupBy(F.window("event_time", unit).alias("w"))
    return per.agg(*[C.count_where(F.col("grp") == g).alias(g) for g in N.GROUPS], F.count("*").alias("total")).select(F.col("w.start").alias("bucket"), *N.GROUPS, "total")


def session_spans(visits: DataFrame, gap: int = 1800, late: str = LATE) -> DataFrame:
    """Sessions of each address: a gap of more than ``gap`` seconds ends one, as in the batch operator."""
    per = visits.withWatermark("event_time", late).groupBy("ip", F.session_window("event_time", f"{gap} seconds").alias("w"))
    return per.agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("requests"), C.count_where(C.is_probe_404()).alias("probe_404"), C.count_where(C.is_ok()).alias("ok_requests")).drop("w")


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.foreachBatch(work).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "15 minutes"})).start()


def reclassify_active(read_visits: Callable[[], DataFrame], read_dim: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], **how) -> Callable[[DataFrame, int], None]:
    """Per batch: judge the addresses that were active in it anew, on all their stored visits, which are read again: for histories that are short. See ``judge_active``."""

    def work(batch: DataFrame, number: int) -> None:
        active = batch.select("ip").distinct()
        judged = classify.classify(classify.evidence(read_visits().join(active, "ip", "left_semi"), read_dim(), **how))
        write(judged.select("ip", "visitor_class", "why", "source", "last_id"), number)

    return work


def alarm(read_visits: Callable[[], DataFrame], now: Callable[[], str], write: Callable[[DataFrame, int], None], **how) -> Callable[[DataFrame, int], None]:
    """Per batch: the last full hour against the stored visits, written where it is unusual. See ``hourly_alarm`` for long histories."""

    def work(batch: DataFrame, number: int) -> None:
        write(baseline.hourly_baseline(read_visits(), now(), **how).filter("requests_unusual or probing_unusual"), number)

    return work


def judge_active(state: EvidenceState, read_dim: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], compact_every: int = 50) -> Callable[[DataFrame, int], None]:
    """Per batch: judge the addresses that were active in it anew, on all their visits so far.

    The visits before aren't read: a batch adds to the state, and what is read of the state are the folders of the batch's
    addresses. A batch that is run again writes the same. Of a batch, what the rules read is held alone.
    """

    def work(batch: DataFrame, number: int) -> None:
        held = batch.select(*classify.READS).persist()
        state.add(held, number)
        judged = classify.classify(state.evidence(held, read_dim()))
        write(judged.select("ip", "visitor_class", "why", "source", "last_id"), number)
        held.unpersist()
        if number % compact_every == compact_every - 1:
            state.compact(number)

    return work


def hourly_alarm(rollup: HourlyRollup, now: Callable[[], str], write: Callable[[DataFrame, int], None], **how) -> Callable[[DataFrame, int], None]:
    """Per batch: add it to the hours, then the last full hour against the hours before it, written where it is unusual."""

    def work(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        rollup.add(held, number)
        write(rollup.baseline(now(), **how).filter("requests_unusual or probing_unusual"), number)
        held.unpersist()

    return work


def newcomers(read_known: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Per batch: addresses never seen before, with their first request."""

    def work(batch: DataFrame, number: int) -> None:
        first = batch.groupBy("ip").agg(F.min("ts").alias("first_seen"))
        write(first.join(read_known().select("ip").distinct(), "ip", "left_anti"), number)

    return work


def observed(lines: DataFrame, name: str = "ingest_quality") -> DataFrame:
    """Parsed lines that report lines, rejects and non-UTC clocks of each batch in the query's progress."""
    utc = F.col("time").rlike(r"(?:Z|[+-]00:?00)$")
    return logs.parse(lines).observe(name, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("rejected") == "unparseable").alias("unparseable"), F.count_if(F.col("rejected").isNull() & ~utc).alias("non_utc"))


def tail(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """New log files of a folder as lines, a bounded number of files a batch."""
    return spark.readStream.option("maxFilesPerTrigger", per_batch).text(folder)
