"""The intel dimension with its flags, and the filters that all visitor tables share."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions import columns as C
from visitlens.functions import needles as N

#: Search fields: kind of match and columns. Fields of an address come from intel, the others from its visits.
INTEL_FIELDS = {"country": "country_code", "city": "city", "isp": "isp", "org": "org", "asn": "asn", "rdns": "reverse_dns", "class": "visitor_class"}
VISIT_FIELDS = {"ip": "ip", "path": "path", "method": "method", "ua": "user_agent", "referer": "referer", "browser": "browser", "os": "os", "device": "device", "status": "status", "port": "server_port"}
BROAD = ["ip", "path", "user_agent", "referer", "browser", "os"]


def dimension(intel: DataFrame, values: DataFrame) -> DataFrame:
    """intel with has_tags, clean, grp and known: one row an address. An address without a row is neither clean nor known."""
    tagged = values.filter("kind = 'tag'").select("ip").distinct().withColumn("has_tags", F.lit(True))
    flags = ["is_tor", "is_proxy", "is_hosting", "dnsbl_listed"]
    d = intel.join(tagged, "ip", "left").withColumn("has_tags", F.coalesce("has_tags", F.lit(False)))
    d = d.withColumns({c: F.col(c).cast("boolean") for c in [*flags, "is_mobile"]})
    clean = reduce(and_, [~F.col(c) for c in flags]) & ~F.col("has_tags")
    return d.withColumns({"clean": F.coalesce(clean, F.lit(False)), "grp": C.group_of(F.col("visitor_class")), "known": F.lit(True)})


@dataclass(frozen=True)
class Term:
    """One structured search term; match is exact, prefix, substring, number or broad."""

    field: str
    value: str
    match: str = "substring"

    def column(self) -> str | None:
        return {**INTEL_FIELDS, **VISIT_FIELDS}.get(self.field)

    def predicate(self) -> Column:
        if self.field == "broad":
            return reduce(or_, [Term(self.field, self.value)._on(F.col(c)) for c in BROAD])
        return self._on(F.col(self.column()))

    def _on(self, c: Column) -> Column:
        text, value = F.lower(F.coalesce(c.cast("string"), F.lit(""))), self.value.lower()
        if self.match in ("exact", "number"):
            return text == value
        return text.startswith(value) if self.match == "prefix" else F.contains(text, F.lit(value))


@dataclass(frozen=True)
class Filters:
    """What a table is narrowed to. Reading order: window, rows, addresses."""

    since: str | None = None
    until: str | None = None
    seen: str = "total"
    classes: tuple[str, ...] = ()
    signals: tuple[str, ...] = ()
    country: str | None = None
    ip: str | None = None
    port: int | None = None
    asn: str | None = None
    path: str | None = None
    browser: str | None = None
    min_visits: int = 1
    terms: tuple[Term, ...] = ()
    row_terms: tuple[Term, ...] = ()

    def apply(self, visits: DataFrame, dim: DataFrame) -> DataFrame:
        """visits LEFT JOIN the dimension, narrowed. Small dimensions are broadcast where Spark's size threshold allows."""
        v = C.windowed(visits, self.since, self.until)
        for column, value in (("ip", self.ip), ("server_port", self.port), ("path", self.path), ("browser", self.browser)):
            if value is not None:
                v = v.filter(F.col(column) == value)
        if self.seen == "new" and self.since:
            v = v.join(visits.filter(F.col("ts") < F.lit(self.since).cast("timestamp_ntz")).select("ip").distinct(), "ip", "left_anti")
        v = v.join(dim, "ip", "left").withColumns({"grp": F.coalesce("grp", F.lit("unknown")), **{s: F.coalesce(s, F.lit(False)) for s in N.SIGNALS}})
        for column, value in (("country_code", self.country), ("asn", self.asn)):
            if value is not None:
                v = v.filter(F.col(column) == value)
        if self.classes:
            v = v.filter(reduce(or_, [self._class(c) for c in self.classes]))
        if self.signals:
            v = v.filter(reduce(or_, [F.col(s) for s in self.signals]))
        for term in self.row_terms:
            v = v.filter(term.predicate())
        for term in self.terms:
            # a term on visits selects addresses, so that their aggregates stay whole
            hit = v.filter(term.predicate()).select("ip").distinct()
            v = v.filter(term.predicate()) if term.field in INTEL_FIELDS else v.join(hit, "ip", "left_semi")
        if self.min_visits > 1:
            v = v.join(v.groupBy("ip").count().filter(F.col("count") >= self.min_visits).select("ip"), "ip", "left_semi")
        return v

    @staticmethod
    def _class(c: str) -> Column:
        return F.col("visitor_class") == c if "/" in c else F.col("grp") == c
