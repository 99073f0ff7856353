"""Findings that need attention, and the monthly report, as tidy tables."""

from __future__ import annotations

import calendar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions import columns as C
from visitlens.functions import needles as N
from visitlens.operators import exposure, overview, sessions
from visitlens.operators.baseline import padded_median
from visitlens.operators.filters import Filters


def attention(visits: DataFrame, dim: DataFrame, values: DataFrame, now: str, baseline: DataFrame | None = None) -> DataFrame:
    """(tag, subject, value): one row for each finding that holds at ``now``."""
    moment = F.lit(now).cast("timestamp_ntz")
    today = F.date_trunc("day", moment).cast("timestamp_ntz")
    back = lambda **k: moment - F.expr("interval " + " ".join(f"{v} {u}" for u, v in k.items()))
    ts, rows = F.col("ts"), visits.filter(F.col("ts") <= moment)

    def item(df: DataFrame, tag: str, subject, value) -> DataFrame:
        return df.select(F.lit(tag).alias("tag"), subject.cast("string").alias("subject"), value.cast("double").alias("value"))

    throttled = overview.rate_limited(rows.filter(ts >= back(hours=6)), 1)
    threats = dim.filter(F.col("visitor_class").startswith("threats/")).select("ip")
    fresh = rows.join(threats, "ip", "left_semi").groupBy("ip").agg(F.min("ts").alias("first")).filter(F.col("first") >= today).agg(F.count("*").alias("n")).filter("n > 0")
    cve = values.filter("kind = 'vuln'").groupBy("value").agg(F.countDistinct("ip").alias("hosts")).orderBy(F.col("hosts").desc(), "value").limit(1)
    tor = rows.filter(ts >= back(days=7)).join(dim.filter("is_tor").select("ip"), "ip", "left_semi")
    days = tor.groupBy(F.when(ts >= today, F.lit("today")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day")).agg(F.count("*").alias("n"))
    days = days.withColumn("past", F.when(F.col("day") != "today", F.col("n")))
    tor = days.groupBy().agg(F.max(F.when(F.col("day") == "today", F.col("n"))).alias("now"), padded_median("past", F.lit(7)).alias("typical")).filter("typical > 0 and now >= 2 * typical")
    probed = rows.filter((ts >= back(days=1)) & C.like_any(F.col("path"), N.SCANNER_PATHS)).groupBy("path").agg(F.countDistinct("ip").alias("ips"), F.count("*").alias("hits")).orderBy(F.col("ips").desc(), F.col("hits").desc(), "path").limit(1)
    out = item(throttled, "Rate limit", F.col("ip"), F.col("events"))
    for part in (
        item(fresh, "New", F.lit("threat addresses first seen today"), F.col("n")),
        item(cve, "CVE", F.col("value"), F.col("hosts")),
        item(tor, "Tor", F.lit("requests today"), F.col("now")),
        item(probed, "Probe", F.col("path"), F.col("ips")),
    ):
        out = out.unionByName(part)
    if baseline is not None:
        hour = baseline.filter("probing_unusual or requests_unusual")
        out = out.unionByName(item(hour, "This hour", F.when(F.col("probing_unusual"), "probing addresses").otherwise("requests"), F.when(F.col("probing_unusual"), F.col("probing_addresses")).otherwise(F.col("requests"))))
    return out


def month_bounds(month: str) -> tuple[str, str]:
    y, m = map(int, month.split("-"))
    return f"{month}-01", f"{month}-{calendar.monthrange(y, m)[1]:02d}"


def month_before(month: str) -> str:
    y, m = map(int, month.split("-"))
    return f"{y - 1}-12" if m == 1 else f"{y}-{m - 1:02d}"


def monthly_report(visits: DataFrame, dim: DataFrame, month: str, shown: int = 5, **incident_params) -> DataFrame:
    """(section, key, value): totals and their change, composition and its change, incidents, findings new this month."""
    (a, b), (c, d) = month_bounds(month), month_bounds(month_before(month))
    now, before = Filters(since=a, until=b).apply(visits, dim), Filters(since=c, until=d).apply(visits, dim)

    def tall(df: DataFrame, section: str) -> DataFrame:
        names = F.array(*[F.lit(x) for x in df.columns])
        return df.select(F.lit(section).alias("section"), F.explode(F.map_from_arrays(names, F.array(*[F.col(x).cast("double") for x in df.columns]))).alias("key", "value"))

    totals, past = overview.totals(now), overview.totals(before)
    pair = totals.select("visits", "unique_ips").join(past.select(F.col("visits").alias("v0"), F.col("unique_ips").alias("u0")), how="cross")  # one row each
    change = lambda x, y: F.round(F.try_divide(100.0 * (F.col(x) - F.col(y)), F.col(y)), 1)
    deltas = pair.select(change("visits", "v0").alias("visits"), change("unique_ips", "u0").alias("unique_ips"))

    def mix(rows: DataFrame, name: str) -> DataFrame:
        one = rows.select("ip", "grp").distinct()
        groups = rows.sparkSession.createDataFrame([(g,) for g in N.GROUPS], "grp string").join(one.groupBy("grp").count(), "grp", "left")
        return groups.join(one.agg(F.count("*").alias("all")), how="cross").select("grp", F.round(F.try_divide(100.0 * F.coalesce("count", F.lit(0)), F.col("all")), 1).alias(name))  # one row

    shares = mix(now, "share").join(mix(before, "past"), "grp")
    found = sessions.incidents(now, dim, **incident_params)
    worst = found.limit(shown)
    counted = found.agg(F.count("*").alias("incidents"), F.countDistinct("digest").alias("programs"))
    month_findings = exposure.exposures(visits, dim, a, b)
    ever = exposure.served(visits, dim).select("path", F.col("first_seen").alias("first_ever"))
    new = month_findings.join(ever, "path").agg(F.count("*").alias("findings"), C.count_where(F.col("first_ever") >= a).alias("new_findings"))
    parts = [
        tall(totals, "totals"), tall(deltas, "delta"), tall(counted, "incidents"), tall(new, "findings"),
        shares.select(F.lit("share").alias("section"), F.col("grp").alias("key"), F.col("share").alias("value")),
        shares.select(F.lit("share_delta").alias("section"), F.col("grp").alias("key"), F.round(F.col("share") - F.col("past"), 1).alias("value")),
        worst.select(F.lit("incident_score").alias("section"), F.concat_ws("/", "digest", F.col("incident_no").cast("string")).alias("key"), F.col("score").cast("double").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
