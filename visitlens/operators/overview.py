"""Totals, shares, top lists, chips and the identity by signal matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions import columns as C
from visitlens.functions import needles as N

TOP = 10


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(100.0 * part, whole), 1), F.lit(0.0))


def totals(rows: DataFrame) -> DataFrame:
    """One row: visits, addresses, countries, error, HTTPS and bounce shares, mean response time, bandwidth.

    Rows fold by address first; every figure is then a sum over addresses.
    """
    timed = F.col("request_time") > 0
    folded = rows.groupBy("ip").agg(
        F.count("*").alias("n"),
        C.count_where(F.col("status") >= 400).alias("errors"),
        C.count_where(F.col("ssl_protocol") != "").alias("https"),
        F.sum(F.when(timed, F.col("request_time"))).alias("seconds"),
        C.count_where(timed).alias("timed"),
        F.sum("bytes_sent").alias("bytes"),
        F.max(F.nullif("country_code", F.lit(""))).alias("country_code"),
    )
    n, ips = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return folded.agg(
        n.cast("long").alias("visits"),
        ips.alias("unique_ips"),
        F.countDistinct("country_code").alias("countries"),
        percent(F.sum("errors"), n).alias("error_rate"),
        percent(F.sum("https"), n).alias("https_rate"),
        percent(C.count_where(F.col("n") == 1), ips).alias("bounce_rate"),
        F.coalesce(F.round(F.try_divide(F.sum("seconds"), F.sum("timed")), 3), F.lit(0.0)).alias("avg_response_time"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bandwidth"),
    )


def top(rows: DataFrame, key: str, extra: tuple[str, ...] = (), n: int = TOP, exclude: list[str] = ()) -> DataFrame:
    """The most frequent values of a column; ties by the value."""
    kept = rows.filter(F.col(key).isNotNull() & ~F.col(key).isin([*exclude, ""]))
    counts = kept.groupBy(key).agg(F.count("*").alias("count"), *[F.max(c).alias(c) for c in extra])
    return counts.orderBy(F.col("count").desc(), key).limit(n)


def top_referrers(rows: DataFrame, n: int = TOP, raw: int | None = None) -> DataFrame:
    """The most frequent domains of referrers; with raw, of the raw most frequent referrers alone."""
    counts = rows.filter("referer <> '' and referer <> '-'").groupBy("referer").agg(F.count("*").alias("n"))
    if raw:
        counts = counts.orderBy(F.col("n").desc(), "referer").limit(raw)
    domains = counts.groupBy(C.referrer_domain(F.col("referer")).alias("domain")).agg(F.sum("n").cast("long").alias("count"))
    return domains.orderBy(F.col("count").desc(), "domain").limit(n)


def class_counts(rows: DataFrame) -> DataFrame:
    """Addresses per class, per group and in all, for the filter chips."""
    label = F.coalesce(F.nullif("visitor_class", F.lit("")), F.lit("unknown"))
    one = rows.groupBy("ip").agg(F.max(label).alias("cls"), F.max("grp").alias("grp"))
    both = one.select(F.explode(F.array(F.struct(F.lit("class").alias("level"), F.col("cls").alias("key")), F.struct(F.lit("group").alias("level"), F.col("grp").alias("key")), F.struct(F.lit("all").alias("level"), F.lit("all").alias("key")))).alias("x"))
    return both.groupBy("x.level", "x.key").agg(F.count("*").alias("addresses"))


def signal_matrix(rows: DataFrame) -> DataFrame:
    """Per group: addresses, and addresses with each signal."""
    one = rows.groupBy("ip").agg(F.max("grp").alias("grp"), *[F.bool_or(s).alias(s) for s in N.SIGNALS])
    return one.groupBy("grp").agg(F.count("*").alias("addresses"), *[C.count_where(F.col(s)).alias(s) for s in N.SIGNALS])


def analysis(rows: DataFrame, today: str) -> DataFrame:
    """(section, key, value): enriched addresses, statuses, rate limits (today's too), bot signals."""
    limited = F.col("limit_req_status").isin("DELAYED", "REJECTED")
    now = F.col("ts") >= F.lit(today).cast("timestamp_ntz")
    status = rows.groupBy(F.col("status").cast("string").alias("key")).agg(F.count("*").alias("value")).withColumn("section", F.lit("status"))
    facts = {
        ("rate", "delayed"): F.col("limit_req_status") == "DELAYED", ("rate", "rejected"): F.col("limit_req_status") == "REJECTED", ("rate", "today"): limited & now,
        ("bots", "bot_device"): F.col("device") == "Bot", ("bots", "no_user_agent"): F.col("user_agent") == "", ("bots", "no_language"): F.col("accept_language") == "",
    }
    one = rows.agg(*[C.count_where(c).alias(f"{s}:{k}") for (s, k), c in facts.items()], F.countDistinct(F.when(F.col("known"), F.col("ip"))).alias("intel:enriched"))
    tall = one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in one.columns]), F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long") for c in one.columns]))))
    tall = tall.select(F.split_part("key", F.lit(":"), F.lit(1)).alias("section"), F.split_part("key", F.lit(":"), F.lit(2)).alias("key"), "value")
    return tall.unionByName(status)


def http_versions(rows: DataFrame) -> DataFrame:
    """HTTP versions among traffic of flagged addresses."""
    flagged = rows.filter("known and (is_tor or is_proxy or is_hosting or dnsbl_listed)")
    return flagged.groupBy("http_version").agg(F.count("*").alias("visits"), F.countDistinct("ip").alias("unique_ips"))


def unusual_methods(rows: DataFrame, n: int = 12) -> DataFrame:
    odd = rows.filter(~F.col("method").isin("GET", "HEAD", "POST", "OPTIONS"))
    return odd.groupBy("method").agg(F.count("*").alias("count"), F.countDistinct("ip").alias("unique_ips")).orderBy(F.col("count").desc(), "method").limit(n)


def rate_limited(rows: DataFrame, n: int = TOP) -> DataFrame:
    """Addresses with the most throttled requests."""
    kept = rows.filter(F.col("limit_req_status").isin("DELAYED", "REJECTED"))
    return kept.groupBy("ip").agg(F.count("*").alias("events"), C.count_where(F.col("limit_req_status") == "REJECTED").alias("rejected")).orderBy(F.col("events").desc(), "ip").limit(n)


def seen_groups(visits: DataFrame, dim: DataFrame) -> DataFrame:
    """Enriched addresses seen in the given visits, per group."""
    return dim.join(visits.select("ip").distinct(), "ip", "left_semi").groupBy("grp").agg(F.count("*").alias("addresses"))
