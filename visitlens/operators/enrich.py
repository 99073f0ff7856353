"""Merging what providers answered into intel. Null in an update means the provider did not answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions import columns as C


def upsert(intel: DataFrame, answers: DataFrame, fetched_at: str) -> DataFrame:
    """Answered columns replace stored ones, others stay; new addresses get defaults; fetched_at moves for each address answered for."""
    given = [c for c in answers.columns if c != "ip" and c in intel.columns]
    both = intel.withColumn("_old", F.lit(True)).join(answers.select("ip", *[F.col(c).alias(f"_{c}") for c in given]).withColumn("_new", F.lit(True)), "ip", "full_outer")
    defaults = {f.name: F.lit("" if f.dataType.simpleString() == "string" else None).cast(f.dataType) for f in intel.schema.fields}

    def value(c: str) -> Column:
        stored = F.when(F.col("_old"), F.col(c)).otherwise(defaults[c])
        if c == "fetched_at":
            return F.when(F.col("_new"), F.lit(fetched_at).cast(intel.schema[c].dataType)).otherwise(stored)
        return F.coalesce(F.col(f"_{c}"), stored) if c in given else stored

    return both.select("ip", *[value(c).alias(c) for c in intel.columns if c != "ip"])


def mark_failed(intel: DataFrame, failed: DataFrame, fetched_at: str) -> DataFrame:
    """Addresses that no provider answered for: a stub for new ones, a later fetched_at for known ones."""
    return upsert(intel, failed.select("ip").distinct(), fetched_at)


def replace_values(values: DataFrame, answered: DataFrame, new: DataFrame) -> DataFrame:
    """Values of (ip, kind) pairs that a source answered for are those of the answer; an empty answer clears them."""
    return values.join(answered.select("ip", "kind").distinct(), ["ip", "kind"], "left_anti").unionByName(new.select("ip", "kind", "value").distinct())


def normal_values(raw: DataFrame, column: str, kind: str) -> DataFrame:
    """(ip, kind, value) from a comma-separated column: trimmed, blanks dropped, ports whole numbers only."""
    parts = raw.select("ip", F.explode(F.split(column, ",")).alias("value")).select("ip", F.lit(kind).alias("kind"), F.trim("value").alias("value")).filter("value <> ''")
    if kind == "port":
        parts = parts.withColumn("value", F.col("value").try_cast("int").cast("string")).filter("value is not null")
    return parts.dropDuplicates(["ip", "kind", "value"])


def candidates(visits: DataFrame, intel: DataFrame, now: str, ttl_days: int = 30, batch: int | None = None) -> DataFrame:
    """(ip, priority): addresses never enriched (0), then those fetched longer ago than the ttl (1), oldest first."""
    never = visits.select("ip").distinct().join(intel.select("ip"), "ip", "left_anti").select("ip", F.lit(0).alias("priority"), F.lit(None).cast("timestamp_ntz").alias("fetched_at"))
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {ttl_days} days")
    stale = intel.filter(F.col("fetched_at") < limit).select("ip", F.lit(1).alias("priority"), "fetched_at")
    found = never.unionByName(stale).orderBy("priority", F.col("fetched_at").asc_nulls_first(), "ip")
    return (found.limit(batch) if batch else found).select("ip", "priority")


def backlog(visits: DataFrame, intel: DataFrame, now: str, ttl_days: int = 30) -> DataFrame:
    """One row: addresses never enriched and stale ones."""
    return candidates(visits, intel, now, ttl_days).agg(C.count_where(F.col("priority") == 0).alias("never"), C.count_where(F.col("priority") == 1).alias("stale"))


def blocklist_verdicts(answers: DataFrame) -> DataFrame:
    """From (ip, provider, answer): listed by any provider that gave 127.* other than the error range; null if all failed."""
    error = F.col("answer").startswith("127.255.255.")
    listed = F.col("answer").startswith("127.") & ~error
    clear = F.col("answer") == ""
    return answers.groupBy("ip").agg(
        F.when(F.bool_or(F.coalesce(listed, F.lit(False))), True).when(F.bool_or(F.coalesce(clear, F.lit(False))), False).alias("dnsbl_listed"),
        F.array_join(F.array_sort(F.collect_set(F.when(listed, F.col("provider")))), ",").alias("dnsbl_sources"),
    )


def confirmed_names(ptr: DataFrame, forward: DataFrame) -> DataFrame:
    """(ip, name) pointers whose name resolves back to the address."""
    return ptr.join(forward.select("name", "ip").distinct(), ["name", "ip"], "left_semi").select("ip", "name")


def geo_answers(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers for addresses that were asked for, with failed for those that did not succeed."""
    return answers.join(asked.select("ip").distinct(), "ip", "left_semi").withColumn("failed", ~F.col("status").eqNullSafe("success"))


def tor_flags(intel: DataFrame, exits: DataFrame | None) -> DataFrame:
    """is_tor by the exit list; unset where there is no list."""
    if exits is None:
        return intel.withColumn("is_tor", F.lit(None).cast("boolean"))
    marked = exits.select("ip").distinct().withColumn("_exit", F.lit(True))
    return intel.join(marked, "ip", "left").withColumn("is_tor", F.coalesce("_exit", F.lit(False))).drop("_exit")


def reopen_names(intel: DataFrame, values: DataFrame) -> DataFrame:
    """Names never checked by a pointer lookup, where a host name is on record, are cleared and due for a check."""
    named = values.filter("kind = 'hostname'").select("ip").distinct().withColumn("_named", F.lit(True))
    due = F.col("_named") & F.col("rdns_checked_at").isNull()
    return intel.join(named, "ip", "left").withColumn("reverse_dns", F.when(due, "").otherwise(F.col("reverse_dns"))).drop("_named")


def unchecked_names(intel: DataFrame, batch: int) -> DataFrame:
    return intel.filter("rdns_checked_at is null").select("ip").orderBy("ip").limit(batch)


def lookup(asked: DataFrame, intel: DataFrame) -> DataFrame:
    """Every address asked for, with its intel or nulls."""
    return asked.select("ip").distinct().join(intel, "ip", "left")
