"""Sorted pages of any table: named sort keys, rows without a value last in either direction, and how many pages there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Sort keys by table: name and column.
VISITS = {k: k for k in ("ts", "ip", "path", "status", "country_code", "visitor_class")}
REQUESTS = VISITS | {k: k for k in ("method", "server_port", "bytes_sent", "request_time", "request_length", "referer", "user_agent", "http_version", "browser", "os")}
VISITORS = {k: k for k in ("ip", "visits", "first_seen", "last_seen", "unique_pages", "browsers", "oses", "devices", "ports", "country_code", "asn", "visitor_class", "tags", "enriched")}

_BREAKDOWN = {k: k for k in ("unique_ips", "visits", "last_seen")}
NETWORKS = _BREAKDOWN | {k: k for k in ("asn", "org", "isp", "countries")}
COUNTRIES = _BREAKDOWN | {"country": "country", "country_code": "country_code"}
CLIENTS = _BREAKDOWN | {k: k for k in ("browser", "os", "device")}
PATHS = _BREAKDOWN | {k: k for k in ("path", "s2xx", "s3xx", "s4xx", "s5xx")}
EXPOSURES = {"path": "path", "addresses": "ips", "requests": "hits", "size": "bytes_sent", "first": "first_seen", "last": "last_seen"}
SERVED = EXPOSURES | {"benign": "benign_ips", "kind": "is_finding"}
INCIDENTS = {"started": "started", "duration": "duration", "addresses": "addresses", "asns": "asns", "probes": "probe_404", "listed": "blocklisted", "score": "score"}
INCIDENT_PATHS = {"arrival": "first_id", "path": "path", "addresses": "addresses", "requests": "requests"}
INCIDENT_SESSIONS = {"started": "started", "ip": "ip", "probes": "probe_404"}
DECISIONS = {k: k for k in ("ip", "requests", "probes", "first_seen", "last_seen", "visitor_class", "asn", "country_code")}


def key_of(df: DataFrame, keys: dict[str, str], name: str) -> Column:
    """A sort key; an empty text has no value."""
    column = keys[name]
    return F.nullif(F.col(column), F.lit("")) if dict(df.dtypes)[column] == "string" else F.col(column)


def page(df: DataFrame, keys: dict[str, str], sort: str, ties: list[str], descending: bool = True, number: int = 1, size: int = 50) -> DataFrame:
    """Page ``number`` (from 1) of a table with position and pages; ``ties`` make the order total.

    Spark keeps the first rows of each task only, so a page near the start needs no full sort.
    """
    by = key_of(df, keys, sort)
    order = [by.desc_nulls_last() if descending else by.asc_nulls_last(), *ties]
    total = df.agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).alias("pages"))
    found = df.orderBy(*order).offset((number - 1) * size).limit(size)
    # a page is one short list, so its positions are counted in one place
    first = (number - 1) * size + 1
    listed = found.agg(F.collect_list(F.struct(*df.columns)).alias("rows")).select(F.posexplode("rows").alias("at", "row"))
    return listed.select((F.col("at") + first).cast("long").alias("position"), "row.*").join(total, how="cross")  # one row


def after(df: DataFrame, keys: dict[str, str], sort: str, ties: list[str], row: Row | None = None, descending: bool = True, size: int = 50) -> DataFrame:
    """The rows that follow ``row`` (the last one of the page before; the first page without), in the order of ``page``.

    What is sorted are the first ``size`` rows of each task beyond the row, so a page deep in a table costs what the first one does; nothing is counted.
    """
    by = key_of(df, keys, sort)
    if row is not None:
        tied = F.struct(*ties) > F.struct(*[F.lit(row[t]).cast(dict(df.dtypes)[t]) for t in ties])
        held = row[keys[sort]]
        if held in (None, ""):
            df = df.filter(by.isNull() & tied)
        else:
            value = F.lit(held).cast(dict(df.dtypes)[keys[sort]])
            beyond = by < value if descending else by > value
            df = df.filter(beyond | by.isNull() | ((by == value) & tied))
    return df.orderBy(by.desc_nulls_last() if descending else by.asc_nulls_last(), *ties).limit(size)


def requests(visits: DataFrame, ip: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Requests of one address between two instants, both included."""
    found = visits.filter(F.col("ip") == ip)
    for bound, test in ((since, Column.__ge__), (until, Column.__le__)):
        found = found.filter(test(F.col("ts"), F.lit(bound).cast("timestamp_ntz"))) if bound else found
    return found
