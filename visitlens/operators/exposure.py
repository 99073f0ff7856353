"""What the server gave away: paths that answered and that nobody benign asks for."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions import columns as C
from visitlens.functions import needles as N
from visitlens.sources.shared import written

BENIGN_ADDRESSES = 2


def served(visits: DataFrame, dim: DataFrame, since: str | None = None, until: str | None = None, js_prefixes: tuple[str, ...] = (), benign: int = BENIGN_ADDRESSES) -> DataFrame:
    """Resources answered with 2xx in the window, by decoded path, findings marked.

    Counts are of the window, benign addresses of all time. Every spelling of a resource counts as the resource. The visits are read once: they fold
    to (spelling, address), spellings are decoded after that, and one grouping by resource counts addresses, benign ones and spellings.
    """
    asked = C.in_window(since, until) & ~F.contains("path", F.lit("?"))
    inside = lambda c: F.when(asked, c)
    by_spelling = visits.filter(C.is_ok()).groupBy(F.col("path").alias("spelling"), "ip").agg(
        F.count(inside(F.lit(1))).alias("n"), F.min(inside(F.col("ts"))).alias("a"), F.max(inside(F.col("ts"))).alias("b"), F.max(inside(F.col("bytes_sent"))).alias("bytes_sent")
    )
    trusted = dim.filter(F.col("visitor_class").isin(N.BENIGN_CLASSES)).select("ip").distinct().withColumn("_trusted", F.lit(True))
    of_path = by_spelling.withColumn("path", C.canonical_path(F.col("spelling"))).join(trusted, "ip", "left")
    counted = F.col("n") > 0
    # spellings are as many as clients like: their number and two of them, not a list
    spelling = F.when(counted, F.col("spelling"))
    found = of_path.groupBy("path").agg(
        F.count_distinct(F.when(counted, F.col("ip"))).alias("ips"), F.sum("n").cast("long").alias("hits"), F.min("a").cast("string").alias("first_seen"), F.max("b").cast("string").alias("last_seen"), F.max("bytes_sent").alias("bytes_sent"),
        F.count_distinct(spelling).alias("spellings"), F.min(spelling).alias("first_spelling"), F.max(spelling).alias("last_spelling"), F.count_distinct(F.when(F.col("_trusted"), F.col("ip"))).alias("benign_ips"),
    ).filter("hits > 0")
    site = C.is_convention(F.col("path"))
    for p in js_prefixes:
        site = site | F.col("path").startswith(p)
    return found.withColumn("is_site", site).withColumn("is_finding", ~F.col("is_site") & (F.col("benign_ips") < benign))


def exposures(*args, **how) -> DataFrame:
    return served(*args, **how).filter("is_finding").orderBy(F.col("ips").desc(), F.col("hits").desc(), "path")


def exposure_detail(visits: DataFrame, dim: DataFrame, findings: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """(path, section, key, value) for every finding: answers, methods, what the fetching addresses are, totals, what else they asked for.

    The visits are read once, beside what the findings read: they fold to (path, address, answer), a table in the shared folder. The findings' part of it is
    another, and all sections come from these two: those that add up in one grouping of (section, key), the context from one row for each path
    of a fetching address, not from its requests.
    """
    flags = ["is_tor", "is_proxy", "is_hosting", "dnsbl_listed", "has_tags"]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    fold = C.windowed(visits, since, until).groupBy("path", "ip", "status", "server_port", "method", "user_agent", "browser").agg(
        F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes"), F.min("bytes_sent").alias("smallest"), F.max("bytes_sent").alias("largest"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    by_answer = written(fold.withColumn("canonical", C.canonical_path(F.col("path"))).drop("path"), "answers")
    rows = written(by_answer.join(findings.select(F.col("path").alias("canonical")).distinct(), "canonical", "left_semi"), "findings")
    ok = C.is_ok()
    known = dim.select("ip", "visitor_class", "country", "asn", "org", *flags)
    fetched = rows.filter(ok).groupBy("canonical", "ip").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.min("first").alias("first"), F.max("last").alias("last"), F.collect_set(text("browser")).alias("browsers")
    )
    entry = lambda section, key, value=1: F.struct(F.lit(section).alias("section"), key.alias("key"), F.lit(value).cast("long").alias("value") if isinstance(value, int) else value.cast("long").alias("value"))
    spread = lambda df, entries: df.select("canonical", F.explode(F.array_compact(F.array(*entries))).alias("x")).select("canonical", "x.*")
    answers = spread(rows, [entry("answers", F.concat_ws(":", F.col("status").cast("string"), F.col("server_port").cast("string")), F.col("n")), entry("methods", F.concat("method", F.lit(" "), text("user_agent")), F.col("n"))])
    about = [entry("classes", F.coalesce(F.nullif("visitor_class", F.lit("")), F.lit("unknown"))), entry("countries", text("country")), entry("networks", text("asn")), entry("organisations", text("org"))]
    about += [F.when(F.col(f), entry("signals", F.lit(f))) for f in flags]
    clients = fetched.select("canonical", F.explode("browsers").alias("key")).select("canonical", F.lit("clients").alias("section"), "key", F.lit(1).cast("long").alias("value"))
    summed = reduce(DataFrame.unionByName, [answers, spread(fetched.join(known, "ip", "left"), about), clients]).groupBy("canonical", "section", "key").agg(F.sum("value").alias("value"))
    per = fetched.groupBy("canonical").agg(
        F.sum("bytes").alias("bytes"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.count("*").alias("addresses"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    totals = [entry("totals", F.lit(k), F.col(k)) for k in ("bytes", "smallest", "largest", "addresses")]
    seen = entry("seen", F.concat(F.col("first").cast("string"), F.lit(" to "), F.col("last").cast("string")), F.col("n"))
    refused = rows.filter("status = 404").groupBy("canonical").agg(F.max("last").alias("last"), F.sum("n").alias("n"))
    # what the addresses asked for besides: totals of an address less its own part, and its distinct paths
    asked = by_answer.join(fetched.select("ip").distinct(), "ip", "left_semi").groupBy("ip", F.col("canonical").alias("other")).agg(F.sum("n").alias("n"))
    context = fetched.select("canonical", "ip").join(asked, "ip").filter("other <> canonical").groupBy("canonical", "other").agg(F.sum("n").alias("n"))
    context = context.groupBy("canonical").agg(F.count("*").alias("paths"), F.sum("n").alias("hits"))
    parts = [
        summed,
        spread(per, [*totals, seen]),
        spread(refused, [entry("refused", F.concat(F.lit("last "), F.col("last").cast("string")), F.col("n"))]),
        spread(context, [entry("context", F.lit(k), F.col(k)) for k in ("paths", "hits")]),
    ]
    return reduce(DataFrame.unionByName, parts).select(F.col("canonical").alias("path"), "section", "key", "value")


def probe_echo(visits: DataFrame, dim: DataFrame) -> DataFrame:
    """One row: URLs with a query that answered 2xx and that no benign address fetched, and the sum of their addresses."""
    benign = dim.select("ip", F.col("visitor_class").isin(N.BENIGN_CLASSES).alias("benign"))
    rows = visits.filter(C.is_ok() & F.contains("path", F.lit("?"))).join(benign, "ip", "left")
    one = rows.groupBy("path", "ip").agg(F.bool_or(F.coalesce("benign", F.lit(False))).alias("benign"))
    per = one.groupBy("path").agg(F.count("*").alias("ips"), C.count_where(F.col("benign")).alias("benign_ips"))
    return per.filter("benign_ips = 0").agg(F.count("*").alias("urls"), F.coalesce(F.sum("ips"), F.lit(0)).cast("long").alias("addresses"))


def with_family(df: DataFrame) -> DataFrame:
    """family of each path, or null; and a shell command that fetches it, quotes escaped."""
    path = F.lower("path")
    own, parts = F.substring_index(path, "/", -1), F.split(path, "/")

    def is_of(names, starts, endings, folders):
        tests = [own.isin(names)] * bool(names) + [F.arrays_overlap(parts, F.array(*map(F.lit, folders)))] * bool(folders)
        return reduce(or_, tests + [own.startswith(x) for x in starts] + [own.endswith(x) for x in endings])

    family = F.coalesce(*[F.when(is_of(*how), F.lit(key)) for key, *how in N.FAMILIES])
    quoted = F.concat(F.lit("'https://$SITE"), F.replace("path", F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return df.withColumns({"family": family, "check": F.concat(F.lit("curl -sI "), quoted)})


def families(findings: DataFrame) -> DataFrame:
    """Findings by family; those that no family describes stand alone under their own path."""
    marked = with_family(findings)
    return marked.groupBy(F.coalesce("family", F.concat(F.lit("? "), F.col("path"))).alias("family")).agg(F.count("*").alias("paths"), F.max("ips").alias("most_ips"), F.sum("hits").cast("long").alias("hits"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
