"""Access logs: JSON lines to visits, with rejects, skip reasons and replays left out. Works on batches and streams."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.functions import columns as C
from visitlens.functions import needles as N

REQUIRED = ["time", "remote_addr", "request", "status", "body_bytes_sent"]
_NUMBERS = {"status": "int", "body_bytes_sent": "long", "request_time": "double", "server_port": "int", "request_length": "int", "connection": "long", "connection_requests": "long"}
FIELDS = [
    "time", "remote_addr", "request", "status", "body_bytes_sent", "http_referer", "http_user_agent", "request_time", "ssl_protocol", "request_method", "request_uri", "server_port", "http_accept_language", "request_length",
    "http_x_forwarded_for", "ssl_cipher", "connection", "connection_requests", "limit_req_status", "http_version", "sec_fetch_dest", "sec_fetch_mode", "sec_fetch_site", "accept_encoding", "ssl_session_reused",
]
LOG_SCHEMA = ", ".join(f"{f} {_NUMBERS.get(f, 'string')}" for f in FIELDS) + ", corrupt string"
#: Longest stored values.
CAPS = {"path": 2048, "user_agent": 1024, "referer": 2048, "accept_language": 256, "http_x_forwarded_for": 512}


def parse(lines: DataFrame) -> DataFrame:
    """Lines (value) to log fields; rejected says why a line is none: unparseable or a required field missing."""
    parsed = C.worked_out(lines.select("value"), "e", F.from_json("value", LOG_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})).select("value", "e.*")
    missing = reduce(or_, [F.col(c).isNull() for c in REQUIRED])
    texts = [f for f in FIELDS if f not in REQUIRED and f not in _NUMBERS]
    found = parsed.withColumn("rejected", F.when(F.col("corrupt").isNotNull(), "unparseable").when(missing, "missing-field"))
    found = found.withColumns({f: F.coalesce(f, F.lit("")) for f in texts})
    return found.withColumns({f: F.coalesce(f, F.lit(0).cast(t)) for f, t in _NUMBERS.items() if f not in REQUIRED}).drop("corrupt")


def with_address_facts(entries: DataFrame, column: str = "remote_addr") -> DataFrame:
    """is_address and is_internal, worked out once a row. Texts with a colon are expanded to two numbers, the others are plain arithmetic."""
    out = C.worked_out(entries, "_a", C.address_facts(F.col(column)))
    return out.withColumns({"is_address": F.col("_a.valid"), "is_internal": F.coalesce("_a.internal", F.lit(False))}).drop("_a")


def request_fields(entries: DataFrame) -> DataFrame:
    """method and path, recovered from the request line where the server could not parse it."""
    method, path, raw = F.trim("request_method"), F.trim("request_uri"), F.trim("request")
    line = r"^([A-Z]+)\s+(\S+)(?:\s+HTTP/\d(?:\.\d)?)?$"
    clean = F.trim(F.regexp_replace(F.left(raw, F.lit(80)), r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]", "?"))
    tls = raw.startswith("\x16\x03") | F.left(raw, F.lit(12)).rlike(r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]")

    def pick(have: Column, empty: Column, group: int, handshake: str, other: Column) -> Column:
        matched = F.regexp_extract(raw, line, group)  # no group of the line is empty
        read = C.let(matched, lambda m: F.when(m != "", m).when(tls, handshake).otherwise(other))
        return F.when((method != "") & (path != ""), have).when(raw == "", empty).otherwise(read)

    found = F.struct(
        pick(method, F.when(method != "", method).otherwise("UNKNOWN"), 1, "TLS", F.lit("NON-HTTP")).alias("method"),
        pick(path, F.when(path != "", path).otherwise("[empty request]"), 2, "[handshake on HTTP port]", F.when(clean == "", "[binary payload]").otherwise(clean)).alias("path"),
    )
    return C.worked_out(entries, "_r", found).withColumns({"method": F.col("_r.method"), "path": F.col("_r.path")}).drop("_r")


def is_static(path: Column, data_prefixes: tuple[str, ...] = ()) -> Column:
    """A static suffix; data suffixes count only under the given prefixes."""
    page = F.lower(C.page_of(path))
    suffix = F.regexp_extract(page, r"(\.[^./]+)$", 1)
    plain = suffix.isin([s for s in N.STATIC_SUFFIXES if s not in N.SITE_DATA_SUFFIXES])
    under = reduce(or_, [page.startswith(p.lower()) for p in data_prefixes], F.lit(False))
    return plain | (suffix.isin(N.SITE_DATA_SUFFIXES) & under)


def is_health_check(user_agent: Column) -> Column:
    return reduce(or_, [F.contains(F.lower(user_agent), F.lit(x)) for x in N.HEALTH_CHECKS])


def with_skip_reason(entries: DataFrame, data_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """skip_reason: the first that holds, or null for a visit."""
    reason = F.when(~F.col("is_address"), "invalid-ip").when(F.col("is_internal"), "internal-ip").when(is_static(F.col("path"), data_prefixes), "static-asset").when(is_health_check(F.col("http_user_agent")), "health-check")
    return C.worked_out(entries, "skip_reason", reason)


def to_visits(lines: DataFrame, data_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Lines to visits: parsed, kept, typed; identity is the key by which a replay is known."""
    kept = with_skip_reason(request_fields(with_address_facts(parse(lines).filter("rejected is null"))), data_prefixes).filter("skip_reason is null")
    port = F.when(F.col("server_port") > 0, F.col("server_port")).when(F.trim("ssl_protocol") != "", 443).otherwise(80)
    v = kept.select(
        F.col("remote_addr").alias("ip"), F.col("time").alias("timestamp"), F.expr("cast(try_to_timestamp(time) as timestamp_ntz)").alias("ts"), "method", "path", port.alias("server_port"), "status",
        F.col("body_bytes_sent").alias("bytes_sent"), F.col("http_user_agent").alias("user_agent"), F.col("http_referer").alias("referer"), "request_time", "ssl_protocol", F.col("http_accept_language").alias("accept_language"),
        "request_length", "http_x_forwarded_for", "ssl_cipher", "connection", "connection_requests", "limit_req_status", "http_version", "sec_fetch_dest", "sec_fetch_mode", "sec_fetch_site", "accept_encoding", "ssl_session_reused",
    )
    return with_identity(v.withColumns({c: F.left(c, F.lit(n)) for c, n in CAPS.items()}))


def with_identity(visits: DataFrame) -> DataFrame:
    """The request's identity: time, connection and its counter; its own where there is no connection number."""
    same = F.concat_ws("|", F.col("timestamp"), F.col("connection").cast("string"), F.col("connection_requests").cast("string"))
    return visits.withColumn("identity", F.when(F.col("connection") > 0, same).otherwise(F.expr("uuid()")))


def with_repeatable_identity(visits: DataFrame, batch: int) -> DataFrame:
    """The identity, such that a batch that runs again gives its requests the same: where there is no connection number, the batch, a code of the request, and how many equal ones of the batch came before."""
    columns = [c for c in visits.columns if c != "identity"]
    code = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    known = F.col("connection") > 0
    own = visits.filter(~F.coalesce(known, F.lit(False))).withColumn("_code", code)
    nth = F.row_number().over(Window.partitionBy("_code").orderBy("_code"))
    own = own.withColumn("identity", F.concat_ws("|", F.lit(f"batch {batch}"), F.col("_code").cast("string"), nth.cast("string"))).drop("_code")
    return visits.filter(known).unionByName(own)


def new_visits(visits: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Visits without replays of each other or of stored ones."""
    once = visits.dropDuplicates(["identity"])
    return once if stored is None else once.join(stored.select("identity"), "identity", "left_anti")


def quality(lines: DataFrame) -> DataFrame:
    """One row: lines, shares of unparseable, invalid-address and non-UTC ones, each flagged from a half on."""
    e = with_address_facts(parse(lines))
    utc = F.col("time").rlike(r"(?:Z|[+-]00:?00)$")
    counts = e.agg(F.count("*").alias("lines"), C.count_where(F.col("rejected") == "unparseable").alias("unparseable"), C.count_where(F.col("rejected").isNull() & ~F.col("is_address")).alias("invalid"), C.count_where(F.col("rejected").isNull() & ~utc).alias("non_utc"))
    shares = {f"{c}_share": F.coalesce(F.round(F.try_divide(F.col(c).cast("double"), F.col("lines")), 4), F.lit(0.0)) for c in ("unparseable", "invalid", "non_utc")}
    return counts.withColumns(shares).withColumns({f"{c}_flagged": F.col(f"{c}_share") >= 0.5 for c in ("unparseable", "invalid", "non_utc")})


def missing_fields(lines: DataFrame) -> DataFrame:
    """(field, present): how many lines carry each field at all."""
    keys = lines.select(F.explode(F.json_object_keys("value")).alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    return lines.sparkSession.createDataFrame([(f,) for f in FIELDS], "field string").join(keys, "field", "left").select("field", F.coalesce("n", F.lit(0)).alias("present"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


# ---- clients ---------------------------------------------------------------------------------

#: Tools by the head of their user agent; then systems and browsers, first match wins.
TOOLS = ["curl", "Wget", "python-requests", "Python-urllib", "Go-http-client", "okhttp", "Java", "libwww-perl"]
SYSTEMS = [("Windows", "windows nt"), ("iOS", "iphone|ipad|ipod"), ("Android", "android"), ("macOS", "mac os x|macintosh"), ("Chrome OS", r"\bcros\b"), ("Linux", "linux|x11")]
BROWSERS = [("Edge", r"\bedg(?:e|a|ios)?/"), ("Opera", r"\bopr/|\bopera"), ("Samsung Internet", "samsungbrowser"), ("Firefox", "firefox/|fxios/"), ("Chrome", "chrome/|crios/"), ("Safari", r"version/\S+ (?:mobile/\S+ )?safari")]


def with_client(visits: DataFrame) -> DataFrame:
    """browser, os and device, worked out once for each distinct user agent."""
    ua = F.col("user_agent")
    bot = F.lower(ua).rlike(r"bot\b|crawl|spider|slurp|scan|\+https?://")
    tool = F.coalesce(*[F.when(ua.rlike(f"(?i)^{t}[/ ]?"), F.lit(t)) for t in TOOLS])
    first = lambda table: F.coalesce(*[F.when(F.lower(ua).rlike(p), F.lit(n)) for n, p in table], F.lit("Unknown"))
    phone = F.lower(ua).rlike(r"mobile|iphone|android(?!.*tablet)")
    agents = visits.select("user_agent").distinct().select(
        "user_agent",
        F.when(F.trim(ua) == "", "No User-Agent").when(tool.isNotNull(), tool).when(bot, "Bot").otherwise(first(BROWSERS)).alias("browser"),
        F.when(F.trim(ua) == "", "No User-Agent").otherwise(first(SYSTEMS)).alias("os"),
        F.when(F.trim(ua) == "", "Unknown").when(bot, "Bot").when(tool.isNotNull(), "Tool").when(F.lower(ua).rlike("ipad|tablet"), "Tablet").when(phone, "Mobile").otherwise("Desktop").alias("device"),
    )
    return visits.drop("browser", "os", "device").join(agents, "user_agent", "left")
