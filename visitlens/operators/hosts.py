"""Hosts with open ports, vulnerabilities and tags; facets; software; places on a map; decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions import columns as C
from visitlens.functions import needles as N

KINDS = ["port", "vuln", "tag", "cpe", "hostname"]
DECISION_CAP = 5000


def chosen(values: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Addresses that have every wanted value."""
    ips = values.select("ip").distinct()
    for kind, value in wanted.items():
        ips = ips.join(values.filter((F.col("kind") == kind) & (F.col("value") == value)).select("ip").distinct(), "ip", "left_semi")
    return ips


def hosts(visits: DataFrame, dim: DataFrame, values: DataFrame, wanted: dict[str, str] | None = None) -> DataFrame:
    """Addresses with any value on record: the values by kind, and their visits; vulnerable ones first, then tagged ones."""
    sets = values.join(chosen(values, wanted or {}), "ip", "left_semi").groupBy("ip").agg(*[F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("value")))), ",").alias(f"{k}s") for k in KINDS])
    seen = visits.groupBy("ip").agg(F.count("*").alias("visits"))
    found = sets.join(dim.select("ip", "country_code", "org", "visitor_class"), "ip", "left").join(seen, "ip", "left").withColumn("visits", F.coalesce("visits", F.lit(0)))
    return found.orderBy((F.col("vulns") != "").desc(), (F.col("tags") != "").desc(), "ip")


def facets(values: DataFrame, wanted: dict[str, str] | None = None, n: int = 10) -> DataFrame:
    """Most frequent ports, vulnerabilities and tags by host."""
    from pyspark.sql import Window

    kept = values.filter(F.col("kind").isin("port", "vuln", "tag")).join(chosen(values, wanted or {}), "ip", "left_semi")
    counts = kept.groupBy("kind", "value").agg(F.countDistinct("ip").alias("hosts"))
    w = Window.partitionBy("kind").orderBy(F.col("hosts").desc(), "value")
    return counts.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def software(values: DataFrame) -> DataFrame:
    """Products of CPE names (cpe:/part:vendor:product...), operating systems apart, by host."""
    cpe = values.filter("kind = 'cpe'").select("ip", F.split("value", ":").alias("p"))
    name = F.initcap(F.replace(F.get("p", F.lit(3)), F.lit("_"), F.lit(" ")))
    named = cpe.select("ip", F.when(F.get("p", F.lit(1)) == "/o", "os").otherwise("application").alias("part"), name.alias("product")).filter("product is not null")
    return named.groupBy("part", "product").agg(F.countDistinct("ip").alias("hosts"))


# ---- places -----------------------------------------------------------------------------------


def markers(rows: DataFrame) -> DataFrame:
    """Addresses with coordinates: visits, group and signals."""
    placed = rows.filter("lat is not null and lon is not null and (lat <> 0 or lon <> 0)")
    return placed.groupBy("ip").agg(F.max("lat").alias("lat"), F.max("lon").alias("lon"), F.max("country_code").alias("country_code"), F.max("city").alias("city"), F.max("grp").alias("grp"), F.count("*").alias("visits"), *[F.bool_or(s).alias(s) for s in N.SIGNALS])


def marker_stats(rows: DataFrame) -> DataFrame:
    """One row over the markers, with the addresses that have no place."""
    one = markers(rows)
    unplaced = rows.select("ip").distinct().join(one.select("ip"), "ip", "left_anti").agg(F.count("*").alias("unmapped"))
    total = one.agg(F.count("*").alias("ips"), F.countDistinct("country_code").alias("countries"), *[C.count_where(F.col(s)).alias(s) for s in N.SIGNALS], *[C.count_where(F.col("grp") == g).alias(g) for g in N.GROUPS])
    return total.join(unplaced, how="cross")  # one row each


def grid(marks: DataFrame, size: float = 5.0) -> DataFrame:
    """Square cells with their addresses, visits, dominant group and logarithmic weight."""
    cell = lambda c: (F.floor(F.col(c) / size) * size).alias(c)
    counts = marks.groupBy(cell("lat"), cell("lon")).agg(F.count("*").alias("ips"), F.sum("visits").cast("long").alias("visits"), *[C.count_where(F.col("grp") == g).alias(g) for g in N.GROUPS])
    top = F.greatest(*N.GROUPS)
    counts = counts.withColumn("dominant", F.coalesce(*[F.when(F.col(g) == top, F.lit(g)) for g in N.GROUPS]))
    most = counts.agg(F.max("ips").alias("_most"))
    return counts.join(most, how="cross").withColumn("weight", F.round(F.least(F.lit(1.0), F.ln(F.col("ips") + 1) / F.ln(F.col("_most") + 1)), 4)).drop("_most")  # one row


def cell_size(zoom: int) -> float:
    """Degrees of a cell at a zoom level: 20 up to level 2, then half of it each level, 0.05 at least."""
    return max(0.05, 20 / 2 ** max(0, zoom - 2))


def pyramid(marks: DataFrame, zooms: list[int]) -> DataFrame:
    """The grids of several zoom levels in one pass, as ``grid`` gives each: zoom, size, cell, counts, dominant group, weight.

    Markers fold to the cells of the finest level whose size is a half of a half of 20 degrees; what is copied for each level are those cells, whose
    place there is theirs halved as often. Levels of the least size (11 and on) have cells of their own.
    """
    halved = sorted({max(2, z) for z in zooms if cell_size(z) > 0.05})
    least = [z for z in zooms if cell_size(z) <= 0.05]
    sums = [F.count("*").alias("ips"), F.sum("visits").cast("long").alias("visits"), *[C.count_where(F.col("grp") == g).alias(g) for g in N.GROUPS]]
    place = lambda c, size: F.floor(F.col(c) / size).cast("long")
    parts = []
    if halved:
        finest = marks.groupBy(place("lat", cell_size(halved[-1])).alias("y"), place("lon", cell_size(halved[-1])).alias("x")).agg(*sums)
        levels = F.explode(F.array(*[F.struct(F.lit(z).alias("level"), F.shiftright("y", halved[-1] - z).alias("y"), F.shiftright("x", halved[-1] - z).alias("x")) for z in halved]))
        parts.append(finest.select(levels.alias("at"), "ips", "visits", *N.GROUPS).groupBy("at.level", "at.y", "at.x").agg(*[F.sum(c).cast("long").alias(c) for c in ("ips", "visits", *N.GROUPS)]))
    if least:
        parts.append(marks.groupBy(F.lit(11).alias("level"), place("lat", 0.05).alias("y"), place("lon", 0.05).alias("x")).agg(*sums))
    cells = reduce(DataFrame.unionByName, parts)
    # levels at which the size doesn't change share their cells
    asked = F.explode(F.array_compact(F.array(*[F.when(F.col("level") == min(max(2, z), 11), F.lit(z)) for z in zooms])))
    size = F.element_at(F.create_map(*[F.lit(x) for z in zooms for x in (z, cell_size(z))]), F.col("zoom"))
    found = cells.select(asked.alias("zoom"), "y", "x", "ips", "visits", *N.GROUPS).withColumn("size", size)
    top = F.greatest(*N.GROUPS)
    found = found.withColumns({"lat": F.col("y") * F.col("size"), "lon": F.col("x") * F.col("size"), "dominant": F.coalesce(*[F.when(F.col(g) == top, F.lit(g)) for g in N.GROUPS])}).drop("y", "x")
    most = found.groupBy("zoom").agg(F.max("ips").alias("_most"))
    return found.join(most, "zoom").withColumn("weight", F.round(F.least(F.lit(1.0), F.ln(F.col("ips") + 1) / F.ln(F.col("_most") + 1)), 4)).drop("_most")


def selection(marks: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Addresses of a viewport by country and group; a viewport may cross the date line."""
    lon = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
    return marks.filter(F.col("lat").between(south, north) & lon).groupBy("country_code", "grp").agg(F.count("*").alias("ips"))


# ---- decisions --------------------------------------------------------------------------------


def decisions(visits: DataFrame, dim: DataFrame, now: str, selected: tuple[str, ...] = ("threats",), days: int = 7, cap: int = DECISION_CAP) -> DataFrame:
    """Addresses to act on: requests and probes of the last days, most probing first; truncated says whether the cap cut."""
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    wanted = dim.filter(F.col("grp").isin(*selected) | F.col("visitor_class").isin(*selected)).select("ip", "visitor_class", "asn", "country_code", "is_tor", "is_proxy", "is_hosting", "dnsbl_listed")
    one = visits.filter(F.col("ts") >= since).groupBy("ip").agg(F.count("*").alias("requests"), C.count_where(C.is_probe_404()).alias("probes"), F.min("ts").cast("string").alias("first_seen"), F.max("ts").cast("string").alias("last_seen"))
    found = one.join(wanted, "ip")
    total = found.agg((F.count("*") > cap).alias("truncated"))
    return found.orderBy(F.col("probes").desc(), F.col("requests").desc(), "ip").limit(cap).join(total, how="cross")  # one row


def decision_lines(found: DataFrame) -> DataFrame:
    """The text form of the feed: address, then a comment."""
    return found.select(F.concat(F.col("ip"), F.lit(" # "), F.concat_ws(", ", "visitor_class", F.concat(F.col("requests").cast("string"), F.lit(" requests")), F.concat(F.col("probes").cast("string"), F.lit(" probes")))).alias("value"))
