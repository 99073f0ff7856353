"""Tables of visitors, and of networks, countries, clients and paths with their mix of groups and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions import columns as C
from visitlens.functions import needles as N


def joined_set(c: Column | str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")))), ",")


def breakdown(rows: DataFrame, dims: list[str], per_address: list[Column] = (), totals: list[Column] = ()) -> DataFrame:
    """Per dimension: addresses, visits, last seen, addresses per group and per signal.

    Group and signals belong to the address, so rows fold to (dimension, address) first and plain sums
    follow: two small shuffles, no row per distinct count.
    """
    marks = [F.first(s).alias(s) for s in N.SIGNALS]
    folded = rows.groupBy(*dims, "ip").agg(F.count("*").alias("_n"), F.max("ts").alias("_last"), F.first("grp").alias("grp"), *marks, *per_address)
    return folded.groupBy(*dims).agg(
        F.count("*").alias("unique_ips"),
        F.sum("_n").cast("long").alias("visits"),
        F.max("_last").cast("string").alias("last_seen"),
        *[C.count_where(F.col("grp") == g).alias(f"{g}_ips") for g in N.GROUPS],
        *[C.count_where(F.col(s)).alias(f"{s}_ips") for s in N.SIGNALS],
        *totals,
    )


def networks(rows: DataFrame) -> DataFrame:
    names = [F.max(c).alias(f"_{c}") for c in ("org", "isp")] + [F.max("country_code").alias("_cc")]
    return breakdown(rows.filter("asn <> ''"), ["asn"], names, [F.max("_org").alias("org"), F.max("_isp").alias("isp"), F.countDistinct("_cc").alias("countries")])


def countries(rows: DataFrame) -> DataFrame:
    return breakdown(rows.filter("country_code <> ''"), ["country_code"], [F.max("country").alias("_country")], [F.max("_country").alias("country")])


def clients(rows: DataFrame) -> DataFrame:
    return breakdown(rows.filter("browser <> '' or os <> '' or device <> ''"), ["browser", "os", "device"])


def paths(rows: DataFrame, band: int | None = None) -> DataFrame:
    """Paths with their mix of status bands; with a band, requests of that band alone."""
    if band:
        rows = rows.filter(F.col("status").between(band * 100, band * 100 + 99 if band < 5 else 9999))
    bands = C.status_bands()
    names = [f"s{k}xx" for k in (2, 3, 4, 5)]
    return breakdown(rows, ["path"], bands, [F.sum(n).cast("long").alias(n) for n in names])


def visitors(rows: DataFrame, values: DataFrame) -> DataFrame:
    """One row an address: span, visits, pages, clients, intel and tags."""
    tags = values.filter("kind = 'tag'").groupBy("ip").agg(joined_set("value").alias("tags"))
    found = rows.groupBy("ip").agg(
        F.min("ts").cast("string").alias("first_seen"),
        F.max("ts").cast("string").alias("last_seen"),
        F.count("*").alias("visits"),
        F.countDistinct("path").alias("unique_pages"),
        joined_set("browser").alias("browsers"),
        joined_set("os").alias("oses"),
        joined_set("device").alias("devices"),
        joined_set(F.col("server_port").cast("string")).alias("ports"),
        F.max("country_code").alias("country_code"),
        F.max("asn").alias("asn"),
        F.max("visitor_class").alias("visitor_class"),
        F.coalesce(F.bool_or("known"), F.lit(False)).alias("enriched"),
    )
    return found.join(tags, "ip", "left").withColumn("tags", F.coalesce("tags", F.lit("")))


def visitor_detail(rows: DataFrame) -> DataFrame:
    """Every address with the figures of its detail page."""
    n = F.count("*")
    share = lambda c: F.round(100.0 * C.count_where(c) / n, 1)
    return rows.groupBy("ip").agg(
        n.alias("visits"),
        F.min("ts").cast("string").alias("first_seen"),
        F.max("ts").cast("string").alias("last_seen"),
        F.countDistinct("path").alias("unique_pages"),
        F.sum("bytes_sent").cast("long").alias("bytes_sent"),
        F.round(F.avg("request_time"), 4).alias("avg_request_time"),
        F.round(F.avg("request_length"), 2).alias("avg_request_length"),
        F.max("request_length").cast("long").alias("max_request_length"),
        C.count_where(F.col("limit_req_status").isin("DELAYED", "REJECTED")).alias("rate_limited"),
        C.count_where(F.col("status").between(400, 499)).alias("client_errors"),
        share(F.col("sec_fetch_mode") != "").alias("sec_fetch_rate"),
        share(F.col("ssl_protocol") != "").alias("https_rate"),
        joined_set("method").alias("methods"),
        joined_set("http_version").alias("http_versions"),
        joined_set("accept_language").alias("languages"),
    )


def requests_of(visits: DataFrame, ip: str, sort: str = "ts", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of one address's requests, newest first by the sort key, then by id."""
    found = visits.filter(F.col("ip") == ip)
    return found.orderBy(F.col(sort).desc_nulls_last(), F.col("id").desc()).offset(offset).limit(limit)


def visit_page(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of visits with their intel, newest first."""
    return rows.orderBy(F.col("ts").desc(), F.col("id").desc()).offset(offset).limit(limit)


def neighbourhood(rows: DataFrame, dim: DataFrame, min_peers: int = 5, share: float = 0.5) -> DataFrame:
    """For every address and scope (network: /24 or /64, asn): its peers by group, and the dominant group if there is one.

    Peers are counted once per scope value and an address's own group taken off, so no pairs are made.
    """
    seen = rows.select("ip", "grp", "asn").distinct()
    seen = seen.withColumn("network", F.coalesce(C.v4_network(F.col("ip")), C.v6_facts("ip")["network"]))
    scoped = seen.select("ip", "grp", F.expr("stack(2, 'network', network, 'asn', asn) as (scope, value)")).filter("value <> ''")
    per = scoped.groupBy("scope", "value").agg(F.count("*").alias("n"), *[C.count_where(F.col("grp") == g).alias(g) for g in N.GROUPS])
    own = scoped.join(per, ["scope", "value"])
    peers = own.select("ip", "scope", "value", (F.col("n") - 1).alias("peers"), *[(F.col(g) - C.flag(F.col("grp") == g)).alias(g) for g in N.GROUPS]).filter("peers > 0")
    top = F.greatest(*N.GROUPS)
    best = F.coalesce(*[F.when(F.col(g) == top, F.lit(g)) for g in N.GROUPS])
    return peers.withColumn("dominant", F.when((F.col("peers") >= min_peers) & (top > share * F.col("peers")), best))
