"""Sessions of an address, their facts and behaviour, and coordinated incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlens.functions import columns as C

SESSION_GAP = 1800
SIGNATURE_PATHS = 5
INCIDENT_GAP = 86_400
MIN_ADDRESSES = 3
#: Seconds of a block of a key's rows.
BLOCK = 21_600


def segmented(rows: DataFrame, key: str, at: str, order: list[str], gap: int, name: str, block: int = BLOCK) -> DataFrame:
    """Rows with ``name``: runs of a key, numbered from 1, where a gap of more than ``gap`` seconds in column ``at`` starts the next.

    A segmented scan: rows are put in order within (key, block of time), so a key with any number of rows spreads over its blocks; what a block passes on
    is one row, its ends and how many runs begin inside, and the blocks of a key are stitched at their edges.
    """
    gone = lambda a, b: F.timestamp_diff("SECOND", a, b)
    w = Window.partitionBy(key, "_block").orderBy(*order)
    before = F.lag(at).over(w)
    blocked = rows.withColumn("_block", F.floor(gone(F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at)) / block))
    marked = blocked.withColumn("_new", C.flag(F.lag(F.lit(1)).over(w).isNotNull() & (before.isNull() | F.col(at).isNull() | (gone(before, F.col(at)) > gap))))
    edges = marked.groupBy(key, "_block").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.sum("_new").alias("_inside"))
    b = Window.partitionBy(key).orderBy("_block")
    apart = gone(F.lag("_last").over(b), F.col("_first"))
    edges = edges.withColumn("_starts", C.flag(apart.isNull() | (apart > gap)))
    earlier = F.coalesce(F.sum(F.col("_starts") + F.col("_inside")).over(b.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), (earlier + F.col("_starts")).alias("_offset"))
    inner = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = inner.join(edges, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_at")))
    return both.withColumn(name, (F.col("_offset") + F.col("_run")).cast("long")).drop("_block", "_new", "_run", "_key", "_at", "_offset")


def sessionize(rows: DataFrame, gap: int = SESSION_GAP, block: int = BLOCK) -> DataFrame:
    """session_no per address: a gap of more than ``gap`` seconds starts the next."""
    return segmented(rows, "ip", "ts", ["ts", "id"], gap, "session_no", block)


def session_facts(rows: DataFrame, gap: int = SESSION_GAP, host: str = "") -> DataFrame:
    """One row a session: rows fold by path first, so distinct paths are plain counts of rows."""
    page, ok = C.page_of(F.col("path")), C.is_ok()
    marked = sessionize(rows, gap)
    by_path = marked.groupBy("ip", "session_no", "path").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"), C.count_where(C.is_probe_404()).alias("probe_404"), C.count_where(ok).alias("ok"),
        C.count_where(C.is_content()).alias("content"), C.count_where(C.is_internal_nav(host)).alias("nav"), C.count_where(F.col("method") == "POST").alias("posts"),
        C.count_where(F.col("status").isin(401, 403)).alias("refused"), F.min(F.struct("id", "path", "referer")).alias("entry"),
    )
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    facts = by_path.groupBy("ip", "session_no").agg(
        F.min("started").alias("started"), F.max("ended").alias("ended"), total("n", "requests"),
        F.countDistinct(F.when(~C.is_pseudo(F.col("path")), page)).alias("unique_paths"), total("probe_404", "probe_404"),
        C.count_where(F.col("probe_404") > 0).alias("distinct_404_paths"), total("ok", "ok_requests"), total("content", "content_requests"),
        F.countDistinct(F.when(F.col("ok") > 0, page)).alias("distinct_2xx_paths"), total("nav", "internal_nav"), total("posts", "post_requests"), total("refused", "refused"),
        F.max("n").alias("max_path_repeats"), F.min("entry").alias("entry"),
    )
    duration = F.timestamp_diff("SECOND", F.col("started"), F.col("ended"))
    return facts.withColumns({"duration": duration, "unserved": F.greatest(F.col("unique_paths") - F.col("distinct_2xx_paths"), F.lit(0)), "entry_path": F.col("entry.path"), "entry_referer": F.col("entry.referer")}).drop("entry")


def behaviour() -> Column:
    """The first label whose test a session passes, else empty."""
    c = F.col
    return (
        F.when(F.greatest("unique_paths", "content_requests") < 2, "")
        .when((c("max_path_repeats") >= 5) & ((c("post_requests") >= 5) | (c("refused") >= 5)), "brute-force")
        .when((c("unserved") >= 8) & (c("unserved") > 0.5 * c("unique_paths")), "enumeration")
        .when((c("probe_404") > 0) & c("content_requests").between(1, 8), "recon")
        .when((c("distinct_2xx_paths") >= 8) & (c("internal_nav") == 0), "scraping")
        .when((c("internal_nav") > 0) | (c("ok_requests") >= 2), "browsing")
        .otherwise("")
    )


# ---- incidents ------------------------------------------------------------------------------


def probe_sessions(visits: DataFrame, gap: int = SESSION_GAP, paths: int = SIGNATURE_PATHS) -> DataFrame:
    """(ip, session_no, signature, started, ended, probe_404) of sessions over probing requests alone, with a full signature.

    The signature is the first paths of a session in the order of their first hits.
    """
    marked = sessionize(visits.filter(C.is_probe_404()), gap)
    hits = marked.groupBy("ip", "session_no", "path").agg(F.min("id").alias("first_id"), F.count("*").alias("hits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    order = F.array_sort(F.collect_list(F.struct("first_id", "path")))
    spans = hits.groupBy("ip", "session_no").agg(
        F.transform(F.slice(order, 1, paths), lambda x: x["path"]).alias("first_paths"), F.min("first_ts").alias("started"), F.max("last_ts").alias("ended"), F.sum("hits").cast("long").alias("probe_404")
    )
    return spans.filter(F.size("first_paths") == paths).withColumn("signature", F.array_join("first_paths", "\n")).drop("first_paths")


def chained(spans: DataFrame, gap: int = INCIDENT_GAP, block: int = BLOCK) -> DataFrame:
    """Spans with incident_no: sessions of one signature whose starts are at most ``gap`` seconds apart."""
    return segmented(spans, "signature", "started", ["started", "ip"], gap, "incident_no", block)


def incidents(visits: DataFrame, dim: DataFrame, session_gap: int = SESSION_GAP, paths: int = SIGNATURE_PATHS, incident_gap: int = INCIDENT_GAP, min_addresses: int = MIN_ADDRESSES, limit: int | None = None) -> DataFrame:
    """Runs of one program over several addresses with their score, worst first; a limit cuts after the order."""
    chain = chained(probe_sessions(visits, session_gap, paths), incident_gap).join(dim.select("ip", "asn", "is_hosting", "dnsbl_listed"), "ip", "left")
    one = chain.groupBy("signature", "incident_no", "ip").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.max("started").alias("last_started"), F.sum("probe_404").alias("probe_404"), F.max("asn").alias("asn"), F.bool_or("is_hosting").alias("is_hosting"), F.bool_or("dnsbl_listed").alias("dnsbl_listed"))
    found = one.groupBy("signature", "incident_no").agg(
        F.min("started").alias("started"), F.max("ended").alias("ended"), F.max("last_started").alias("last_started"), F.count("*").alias("addresses"),
        F.countDistinct(F.nullif("asn", F.lit(""))).alias("asns"), F.sum("probe_404").cast("long").alias("probe_404"), C.count_where(F.col("is_hosting")).alias("hosting"),
        C.count_where(F.col("dnsbl_listed")).alias("blocklisted"), F.array_join(F.array_sort(F.collect_list("ip")), ",").alias("members"),
    ).filter(F.col("addresses") >= min_addresses)
    parts = {"score_addresses": 3 * F.col("addresses"), "score_asns": 2 * F.col("asns"), "score_blocklisted": 4 * F.col("blocklisted"), "score_probes": F.least(F.floor(F.col("probe_404") / 50), F.lit(10)).cast("long")}
    found = found.withColumns(parts).withColumns({"score": sum((F.col(k) for k in list(parts)[1:]), F.col("score_addresses")), "digest": F.substring(F.sha2("signature", 256), 1, 16), "duration": F.timestamp_diff("SECOND", F.col("started"), F.col("ended"))})
    found = found.orderBy(F.col("score").desc(), "started", "digest")
    return found.limit(limit) if limit else found


def members(visits: DataFrame, dim: DataFrame, **how) -> DataFrame:
    """(digest, incident_no, ip, session_no, started, ended, probe_404): the sessions of every incident, by their start."""
    worst = incidents(visits, dim, **how).select("signature", "incident_no", "digest", F.col("started").alias("incident_started"))
    gaps = {k: how[k] for k in ("session_gap", "paths") if k in how}
    chain = chained(probe_sessions(visits, *[gaps.get("session_gap", SESSION_GAP), gaps.get("paths", SIGNATURE_PATHS)]), how.get("incident_gap", INCIDENT_GAP))
    return chain.join(worst, ["signature", "incident_no"]).select("digest", "incident_no", "incident_started", "signature", "ip", "session_no", "started", "ended", "probe_404")


def incident_paths(visits: DataFrame, dim: DataFrame, **how) -> DataFrame:
    """Paths of every incident: first request, requests, addresses, and whether the path is in the signature."""
    marked = sessionize(visits.filter(C.is_probe_404()), how.get("session_gap", SESSION_GAP))
    rows = marked.join(members(visits, dim, **how).select("digest", "incident_no", "signature", "ip", "session_no"), ["ip", "session_no"])
    found = rows.groupBy("digest", "incident_no", "path").agg(F.min("id").alias("first_id"), F.count("*").alias("requests"), F.countDistinct("ip").alias("addresses"), F.first("signature").alias("signature"))
    return found.withColumn("in_signature", F.array_contains(F.split("signature", "\n"), F.col("path"))).drop("signature")


def against_normal(found: DataFrame, typical: DataFrame) -> DataFrame:
    """Incidents with their addresses as a multiple of a typical hour's probing addresses (one row)."""
    both = found.join(typical.select(F.col("probing_addresses").alias("_typical")), how="cross")
    return both.withColumn("against_normal", F.round(F.try_divide(F.col("addresses").cast("double"), F.col("_typical")), 1)).drop("_typical")
