"""Column expressions that the operators share, all of them JVM expressions."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import needles as N


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (null too)."""
    return F.when(condition, 1).otherwise(0)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def like_any(column: Column, patterns: list[str]) -> Column:
    """Any of the SQL LIKE patterns, ASCII case ignored, as one regular expression."""

    def regex(p: str) -> str:
        core = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in p.strip("%"))
        return ("" if p.startswith("%") else "^") + core + ("" if p.endswith("%") else r"\z")

    return F.coalesce(column, F.lit("")).rlike("(?is)" + "|".join(map(regex, patterns)))


def first_needle(column: Column, needles: list[str]) -> Column:
    """The first needle in list order that the text contains, or null."""
    return F.coalesce(*[F.when(F.contains(column, F.lit(n)), F.lit(n)) for n in needles])


def group_of(visitor_class: Column) -> Column:
    """Identity group of a class; anything without a known group is unknown."""
    head = F.substring_index(visitor_class, "/", 1)
    return F.when(head.isin(N.GROUPS[:-1]) & F.contains(visitor_class, F.lit("/")), head).otherwise("unknown")


def group_order(group: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, N.GROUPS)), group)


def page_of(path: Column) -> Column:
    """The path up to the query."""
    return F.substring_index(path, "?", 1)


def is_pseudo(path: Column) -> Column:
    return path.isin(N.PSEUDO_PATHS)


def is_content() -> Column:
    """Not the permanent redirect from the plain port."""
    return ~(F.col("status").isin(301, 308) & (F.col("server_port") == 80))


def is_convention(path: Column) -> Column:
    return like_any(path, N.CONVENTIONS)


def is_probe_404() -> Column:
    return (F.col("status") == 404) & ~is_convention(F.col("path"))


def is_ok() -> Column:
    return F.col("status").between(200, 299)


def status_bands() -> list[Column]:
    s = F.col("status")
    return [count_where(s.between(a, b)).alias(f"s{k}xx") for k, a, b in ((2, 200, 299), (3, 300, 399), (4, 400, 499), (5, 500, 9999))]


def is_internal_nav(host: str) -> Column:
    """A same-origin header, or a referrer on the site (bare or www) that is followed by another path."""
    same = F.coalesce(F.col("sec_fetch_site") == "same-origin", F.lit(False))
    if not host:
        return same
    ref = F.coalesce(F.col("referer"), F.lit(""))
    rest = F.regexp_extract(ref, "(?i)^https?://(?:www\\.)?" + re.escape(host) + "(/.*)$", 1)
    return same | ((rest != "") & (rest != F.col("path")))


def canonical_path(path: Column) -> Column:
    """Percent-decoded, with repeated slashes and /./ collapsed; a malformed escape leaves the whole path undecoded."""
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(F.regexp_replace(decoded, r"/(?:\./)+", "/"), "/{2,}", "/")


def referrer_domain(referer: Column) -> Column:
    """Authority of a URL, else the text itself."""
    return F.coalesce(F.nullif(F.regexp_extract(referer, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), referer)


def in_window(since: str | None, until: str | None, column: str = "ts") -> Column:
    """since is inclusive; until covers its whole day."""
    found = F.lit(True)
    if since:
        found = found & (F.col(column) >= F.lit(since).cast("timestamp_ntz"))
    if until:
        found = found & (F.col(column) < F.date_add(F.lit(until[:10]).cast("date"), 1).cast("timestamp_ntz"))
    return found


def month_of(visits: DataFrame) -> Column:
    """Month of a visit as text; where visits are stored by month, that of their folder, so that other folders aren't read."""
    return F.substring(F.col("month").cast("string"), 1, 7) if "month" in visits.columns else F.date_format("ts", "yyyy-MM")


def windowed(visits: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """The visits of a window, from its months alone where they are stored by month."""
    rows = visits.filter(in_window(since, until))
    if "month" in visits.columns:
        for bound, test in ((since, Column.__ge__), (until, Column.__le__)):
            rows = rows.filter(test(month_of(visits), F.lit(bound[:7]))) if bound else rows
    return rows


def in_moment(start: str, end: str, column: str = "ts") -> Column:
    """Exact bounds, both inclusive."""
    return F.col(column).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"


def v4_number(ip: Column) -> Column:
    """An IPv4 address as a number, or null."""
    part = [F.split_part(ip, F.lit("."), F.lit(i)).try_cast("long") for i in range(1, 5)]
    return F.when(ip.rlike(V4), ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3])


def v4_within(number: Column, networks: list[str]) -> Column:
    def inside(network: str) -> Column:
        base, bits = network.split("/")
        low = reduce(lambda a, b: a * 256 + int(b), base.split("."), 0)
        return number.between(low, low + 2 ** (32 - int(bits)) - 1)

    return reduce(or_, map(inside, networks))


#: One group of an IPv6 address; an IPv4 address at its end, as four numbers without leading zeros.
_GROUP = "[0-9a-f]{1,4}"
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TAIL = rf"^(.*:){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _v6_groups(ip: Column) -> Column:
    """An IPv6 address as eight groups without leading zeros of fixed width, 32 hex digits in all; null where the text isn't one.

    A zone after % is left out, an IPv4 address at the end becomes two groups, and :: the groups that are missing.
    """

    def two_groups(text: Column) -> Column:
        octet = [F.regexp_extract(text, _TAIL, i).try_cast("int") for i in range(2, 6)]
        two = F.concat(F.regexp_extract(text, _TAIL, 1), F.hex(octet[0] * 256 + octet[1]), F.lit(":"), F.hex(octet[2] * 256 + octet[3]))
        return F.when(F.contains(text, F.lit(".")), F.lower(two)).otherwise(text)

    def whole(plain: Column, some: Column) -> Column:
        short = plain.rlike(rf"^(?:(?:{_GROUP}:)*{_GROUP})?::(?:(?:{_GROUP}:)*{_GROUP})?$") & (some <= 7)
        filled = F.trim(F.replace(plain, F.lit("::"), F.concat(F.lit(":"), F.repeat(F.lit("0:"), F.lit(8) - some))), F.lit(":"))
        return F.when(short, filled).when(plain.rlike(rf"^(?:{_GROUP}:){{7}}{_GROUP}$"), plain)

    some = lambda plain: F.length(F.regexp_replace(F.regexp_replace(plain, "[0-9a-f]+", "x"), "[^x]", ""))
    digits = lambda text: F.concat(*[F.lpad(F.split_part(text, F.lit(":"), F.lit(i)), 4, "0") for i in range(1, 9)])
    return let(let(let(F.lower(F.regexp_replace(ip, "%[^%/]+$", "")), two_groups), lambda plain: let(some(plain), lambda n: whole(plain, n))), digits)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once and stands once in the plan, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def worked_out(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is worked out once a row: unlike one of a plain select, filters that are pushed down don't repeat it wherever it is named, since Spark leaves what names its task in place."""
    return rows.withColumn(name, F.when(F.spark_partition_id() >= 0, value))


def v6_numbers(ip: Column) -> Column:
    """The two halves of an IPv6 address as 64-bit numbers (high, low), or null."""
    half = lambda digits, at: F.conv(F.substring(digits, at, 16), 16, -10).cast("long")
    return let(_v6_groups(ip), lambda digits: F.when(digits.isNotNull(), F.struct(half(digits, 1).alias("high"), half(digits, 17).alias("low"))))


def v6_network(high: Column) -> Column:
    """The /64 of the high half, as it is written: groups without leading zeros, zeros at the end as ::."""
    digits = F.lpad(F.lower(F.hex(high)), 16, "0")
    groups = [F.regexp_replace(F.substring(digits, i, 4), "^0{1,3}", "") for i in (1, 5, 9, 13)]
    text = F.concat(F.regexp_replace(F.concat_ws(":", *groups), "(?:(?:^|:)0)+$", ""), F.lit("::/64"))
    return F.when(high.isNotNull(), text)


def v6_in(high: Column, low: Column, networks: list[str]) -> Column:
    def inside(network: str) -> Column:
        base = ipaddress.ip_network(network)
        start, bits = int(base.network_address), base.prefixlen
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        top, rest = start >> 64, start & (2**64 - 1)
        if bits <= 64:
            return F.shiftrightunsigned(high, 64 - bits) == (top >> (64 - bits)) if bits else F.lit(True)
        return (high == signed(top)) & (F.shiftrightunsigned(low, 128 - bits) == signed(rest >> (128 - bits)))

    return reduce(or_, map(inside, networks))


def v6_facts(ip: Column | str) -> Column:
    """(network, internal): /64 and internal flag of an IPv6 address, nulls where the text isn't one. Texts without a colon are passed by."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    number = F.when(F.contains(ip, F.lit(":")), v6_numbers(ip))
    return let(number, lambda n: F.struct(v6_network(n["high"]).alias("network"), v6_in(n["high"], n["low"], N.INTERNAL_V6).alias("internal")))


#: An IPv6 address without an IPv4 address or a zone, in one look: eight groups, or seven at most around one ::.
_PLAIN_V6 = rf"(?i)^(?:(?!:*[0-9a-f]+(?::+[0-9a-f]+){{7}})(?:(?:{_GROUP}:)*{_GROUP})?::(?:(?:{_GROUP}:)*{_GROUP})?|(?:{_GROUP}:){{7}}{_GROUP})$"


def v6_may_be_in(ip: Column, networks: list[str]) -> Column:
    """By its first group: false only where a plain IPv6 address is in none of the networks."""
    group = F.coalesce(F.conv(F.substring_index(ip, ":", 1), 16, 10).cast("long"), F.lit(0))
    bases = [ipaddress.ip_network(n) for n in networks]
    return reduce(or_, [group.between(int(n.network_address) >> 112, int(n.broadcast_address) >> 112) for n in bases], F.lit(False))


def address_facts(ip: Column) -> Column:
    """(valid, internal) of an address of either kind; null for null. What has a colon is read as IPv6, all else as IPv4; numbers of IPv6 addresses are worked out only where these say more than their text."""
    facts = lambda valid, internal: F.struct(valid.alias("valid"), F.coalesce(internal, F.lit(False)).alias("internal"))
    v6 = let(v6_numbers(ip), lambda n: facts(n.isNotNull(), v6_in(n["high"], n["low"], N.INTERNAL_V6)))
    plain = ~F.contains(ip, F.lit(".")) & ~F.contains(ip, F.lit("%"))
    v4 = let(v4_number(ip), lambda n: facts(n.isNotNull(), v4_within(n, N.INTERNAL_V4)))
    outside = F.when(~ip.rlike(_PLAIN_V6), facts(F.lit(False), F.lit(False))).when(~v6_may_be_in(ip, N.INTERNAL_V6), facts(F.lit(True), F.lit(False)))
    return F.when(F.contains(ip, F.lit(":")), F.coalesce(F.when(plain, outside), v6)).when(ip.isNotNull(), v4)


def v4_network(ip: Column) -> Column:
    """The /24 of an IPv4 address, or null."""
    return F.when(ip.rlike(V4), F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24")))
