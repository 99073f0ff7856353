"""Structured search: a registry of fields, terms compiled to bits, and one bit mask an address.

All terms of a search must hold. A visitor search selects addresses: every term is a bit; the bits that an address's requests meet fold by or in one grouping for
all terms, its intel and its host values add theirs, and an address is found if no bit is missing. So requests are read once however many terms
there are, and the aggregates of the addresses found stay whole. A row search keeps the requests for which all terms hold themselves, for tables that count requests.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions import needles as N


@dataclass(frozen=True)
class Field:
    """Where a field's values stand (requests, intel, or host values of a kind) and how a term meets them."""

    side: str
    match: str
    source: str


#: Fixed names: fields of a search, in the order of the help.
REGISTRY = {
    "ip": Field("visit", "prefix", "ip"), "country": Field("intel", "country", "country"), "city": Field("intel", "substring", "city"), "asn": Field("intel", "substring", "asn"),
    "org": Field("intel", "substring", "org"), "isp": Field("intel", "substring", "isp"), "rdns": Field("intel", "substring", "reverse_dns"), "path": Field("visit", "substring", "path"),
    "ua": Field("visit", "substring", "user_agent"), "browser": Field("visit", "substring", "browser"), "os": Field("visit", "substring", "os"), "device": Field("visit", "exact", "device"),
    "referer": Field("visit", "substring", "referer"), "class": Field("intel", "class", "visitor_class"), "signal": Field("intel", "signal", ""), "tag": Field("value", "exact", "tag"),
    "vuln": Field("value", "substring", "vuln"), "port": Field("value", "number", "port"), "serverport": Field("visit", "number", "server_port"), "status": Field("visit", "status", "status"),
    "method": Field("visit", "exact", "method"), "http": Field("visit", "substring", "http_version"),
}
ALIASES = {"cc": "country", "host": "rdns", "url": "path", "agent": "ua", "client": "browser", "ref": "referer", "cve": "vuln", "httpversion": "http"}
#: What a term without a field is looked for in, for visitors and for each table of requests.
BROAD = ["ip", "country", "city", "asn", "org", "isp", "rdns", "path", "ua", "browser", "os"]
TABLES = {"networks": ["org", "isp", "asn"], "countries": ["country", "country_code"], "clients": ["browser", "os", "device"], "paths": ["path", "user_agent"]}
MOST = 8


class UnknownTerm(ValueError):
    """A field that isn't there, or a value that a field with a fixed list doesn't have."""


@dataclass(frozen=True)
class Term:
    """A value, of a field or of any."""

    value: str
    field: str | None = None

    def of(self) -> Field | None:
        if self.field is None:
            return None
        name = ALIASES.get(self.field.lower(), self.field.lower())
        if name not in REGISTRY:
            raise UnknownTerm(self.field)
        return REGISTRY[name]


def _text(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))


def _has(column: str, value: str) -> Column:
    return F.contains(_text(column), F.lit(value.lower()))


def signal_of(value: str) -> str:
    """The signal's column, by its name or a short form of it."""
    short = {s.removeprefix("is_").removeprefix("has_").removesuffix("_listed"): s for s in N.SIGNALS}
    key = value.lower()
    found = key if key in N.SIGNALS else short.get(key.removeprefix("is_"))
    if found is None:
        raise UnknownTerm(f"signal:{value}")
    return found


def _meets(how: Field, column: str, value: str) -> Column:
    """Whether a field's column meets a value."""
    low = value.lower()
    if how.match == "exact":
        return _text(column) == low
    if how.match == "prefix":
        return _text(column).startswith(low)
    if how.match == "number":
        return _text(column) == (str(int(value)) if value.isascii() and value.isdigit() else "no number")
    if how.match == "status":
        if len(low) == 3 and low[0] in "2345" and low[1:] == "xx":
            first = int(low[0]) * 100
            return F.col(column).between(first, first + 99 if first < 500 else 9999)
        return _meets(Field("", "number", ""), column, value)
    if how.match == "country":
        return _text("country_code") == low if len(value) == 2 else _has("country", value)
    if how.match == "signal":
        return F.coalesce(F.col(signal_of(value)), F.lit(False))
    if how.match == "class":
        of = F.coalesce(F.col(column), F.lit(""))
        if "/" in value:
            return of == value
        if value not in N.GROUPS:
            raise UnknownTerm(f"class:{value}")
        return of.isin("unknown", "") if value == "unknown" else F.lower(of).startswith(f"{low}/")
    return _has(column, value)


def _on(term: Term, side: str) -> Column | None:
    """The term's predicate on one side, or null where it has nothing to say there."""
    how = term.of()
    if how is None:
        found = [_has(REGISTRY[f].source, term.value) for f in BROAD if REGISTRY[f].side == side]
        return reduce(or_, found) if found else None
    if how.side != side:
        return None
    if side == "value":
        return (F.col("kind") == how.source) & _meets(how, "value", term.value)
    return _meets(how, how.source, term.value)


def _mask(terms: tuple[Term, ...], side: str) -> Column:
    bits = [(i, _on(t, side)) for i, t in enumerate(terms)]
    parts = [F.when(p, F.lit(1 << i)).otherwise(F.lit(0)) for i, p in bits if p is not None]
    return reduce(Column.bitwiseOR, parts, F.lit(0)).cast("int")


def _checked(terms: tuple[Term, ...]) -> tuple[Term, ...]:
    if len(terms) > MOST:
        raise ValueError(f"more than {MOST} terms")
    return tuple(terms)


def _masks_of_values(values: DataFrame, terms: tuple[Term, ...]) -> DataFrame | None:
    """(ip, _values): bits that an address's host values meet, from the rows of the kinds that are asked for."""
    kinds = {t.of().source for t in terms if t.of() is not None and t.of().side == "value"}
    if not kinds:
        return None
    return values.filter(F.col("kind").isin(sorted(kinds))).groupBy("ip").agg(F.bit_or(_mask(terms, "value")).alias("_values"))


def find_visitors(visits: DataFrame, dim: DataFrame, values: DataFrame, *terms: Term) -> DataFrame:
    """(ip): addresses of these visits that meet all terms, each by any of its requests, its intel or its values."""
    terms = _checked(terms)
    per = visits.groupBy("ip").agg(F.bit_or(_mask(terms, "visit")).alias("_visits")).join(dim, "ip", "left").withColumn("_intel", _mask(terms, "intel")).select("ip", "_visits", "_intel")
    of_values = _masks_of_values(values, terms)
    per = per.withColumn("_values", F.lit(0)) if of_values is None else per.join(of_values, "ip", "left")
    met = F.col("_visits").bitwiseOR(F.col("_intel")).bitwiseOR(F.coalesce("_values", F.lit(0)))
    return per.filter(met == (1 << len(terms)) - 1).select("ip")


def search_visitors(visits: DataFrame, dim: DataFrame, values: DataFrame, *terms: Term) -> DataFrame:
    """All visits of the addresses found."""
    return visits.join(find_visitors(visits, dim, values, *terms), "ip", "left_semi")


def search_rows(rows: DataFrame, values: DataFrame, table: str, *terms: Term) -> DataFrame:
    """Of visits joined with the dimension, those that meet all terms; a term without a field is looked for in the table's own columns."""
    terms = _checked(terms)
    of_values = _masks_of_values(values, terms)
    found = rows if of_values is None else rows.join(of_values, "ip", "left")
    for i, term in enumerate(terms):
        if term.of() is None:
            found = found.filter(reduce(or_, [_has(c, term.value) for c in TABLES[table]]))
        elif term.of().side == "value":
            found = found.filter(F.coalesce("_values", F.lit(0)).bitwiseAND(1 << i) != 0)
        else:
            found = found.filter(_on(term, term.of().side))
    return found if of_values is None else found.drop("_values")
