"""Visits, intel and host values derived from the driver's tables.

Every column is one expression that Spark and DuckDB evaluate alike, so the queries and their SQL
twins start from the same rows. The only difference is the clock column's type cast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.operators.filters import dimension

PATHS = [
    "/", "/index.html", "/pages/about.html", "/?utm_source=a", "/.env", "/.git/config", "/wp-login.php", "/phpinfo.php", "/.DS_Store", "/%2eDS_Store",
    "/robots.txt", "//robots%2etxt", "/admin/", "/backup.sql", "/index.php?page=../../etc/passwd", "/pages/cv.html", "/x.arm7", "/favicon.ico", "/login", "/pages/projects.html",
]
#: What the other addresses ask for: readers pages of the site, guessers pages of any name, scanners known places, attackers shells too.
PAGES = ["/", "/index.html", "/pages/about.html", "/?utm_source=a", "/robots.txt", "/pages/cv.html", "/favicon.ico", "/pages/projects.html", "/news", "/notes/a", "/notes/b", "/notes/c"]
GUESSES = ["/", "/old", "/new", "/test", "/data", "/files/", "/shop", "/store", "/blog", "/forum", "/home", "/api/v1"]
SCANS = ["/.env", "/.git/config", "/wp-login.php", "/phpinfo.php", "/.DS_Store", "/%2eDS_Store", "/admin/", "/backup.sql", "/login"]
SHELLS = ["/shell?wget+x", "/", "/cgi-bin/x", "/.env", "/.aws/credentials"]
AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/126.0 Safari/537.36", "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", "curl/8.5.0", "",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_5) Version/17.5 Safari/605.1.15", "zgrab/0.x", "Mozilla/5.0 AppleWebKit/537.36; compatible; GPTBot/1.2", "Mozilla/5.0 (X11; Linux x86_64; rv:127.0) Gecko/20100101 Firefox/127.0",
    "Mozilla/5.0 (compatible; AhrefsBot/7.0; +http://ahrefs.com/robot/)", "SomeCrawler/1.0 (a bot of its own)", "Mozilla/4.0 (compatible; Odd)", "CensysInspect/1.1", "Screaming Frog SEO Spider/20.0",
]
REFERERS = ["", "-", "https://example.org/pages/about.html", "https://search.example.com/q?a=1", "https://www.example.org/", "news.example.net", "http://blog.example.com:8080/post"]
ISPS = ["Amazon.com", "Comcast Cable", "Hetzner Online", "Deutsche Telekom", "OVH SAS", "Orange", "Akamai Technologies"]
CLASSES = ["humans/browser-direct", "bots/vulnerability-probers", "threats/exploit-probers", "bots/search-crawlers", "automated/datacenter", "unknown", "", "humans/browser-internal-nav", "threats/protocol-abusers"]
NAMES = ["", "crawl-1.googlebot.com", "host.example.net", "scan-7.shodan.io", "", "ec2-1.compute.amazonaws.com"]
COUNTRIES = ["CH", "DE", "FR", "US", "BR", "CN", "NL", "AU", ""]
HOST = "example.org"


def case(number: str, values: list[str]) -> str:
    """The text at ``number`` modulo the length of the list: an index into one constant, in either engine's words."""
    listed = ", ".join(f"'{v}'" for v in values)
    return f"{{at}}({{list}}({listed}), CAST(({number}) % {len(values)} + 1 AS INT))"


def whole(a: str, b: int) -> str:
    return f"CAST(floor(({a}) / {b}) AS BIGINT)"


def address(key: str) -> str:
    return f"'198.18.' || CAST({whole(key, 20)} AS STRING) || '.' || CAST({key} % 20 + 1 AS STRING)"


#: The number in props, computed once a row below everything that reads it.
NUMBER, K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)", "k"
READER = "floor(user_id / 2) % 3 <> 2"
STATUS = f"CASE event_type WHEN 'error' THEN CASE WHEN {READER} THEN 304 ELSE 404 END WHEN 'signup' THEN CASE {K} % 3 WHEN 0 THEN 301 ELSE 400 END WHEN 'purchase' THEN CASE {K} % 4 WHEN 0 THEN 503 ELSE 403 END ELSE 200 END"
VISITS = {
    "id": "event_id", "ip": address("user_id"), "ts": "{clock}", "method": f"CASE WHEN {K} = 13 THEN 'PROPFIND' WHEN {K} = 14 AND user_id % 7 = 5 OR {K} % 5 = 0 AND user_id % 18 = 16 THEN 'TLS' WHEN event_type IN ('signup', 'purchase') THEN 'POST' WHEN {K} % 7 = 0 THEN 'HEAD' ELSE 'GET' END",
    "path": f"CASE WHEN {READER} THEN {case(K, PAGES)} WHEN user_id % 18 = 4 THEN {case(K, PATHS)} WHEN user_id % 18 = 16 THEN {case(K, SHELLS)} WHEN user_id % 18 IN (5, 10) THEN {case(K, SCANS)} ELSE {case(K, GUESSES)} END", "server_port": f"CASE WHEN event_type = 'signup' THEN 80 WHEN {K} % 11 = 0 THEN 8443 ELSE 443 END", "status": STATUS, "bytes_sent": "CAST(floor(abs(value) * 100) AS BIGINT)",
    "user_agent": case("user_id", AGENTS), "referer": case(f"user_id + {K}", REFERERS), "request_time": f"CAST({K} % 32 AS DOUBLE) / 64", "ssl_protocol": "CASE WHEN event_type = 'signup' THEN '' ELSE 'TLSv1.3' END",
    "browser": case("user_id", ["Chrome", "Bot", "curl", "No User-Agent", "Safari", "Unknown", "Bot", "Firefox", "Bot", "Bot", "Unknown", "Bot", "Bot"]), "os": case("user_id", ["Windows", "Unknown", "Unknown", "No User-Agent", "macOS", "Unknown", "Unknown", "Linux", "Unknown", "Unknown", "Unknown", "Unknown", "Unknown"]),
    "device": case("user_id", ["Desktop", "Bot", "Tool", "Unknown", "Desktop", "Tool", "Bot", "Desktop", "Bot", "Bot", "Unknown", "Bot", "Bot"]), "accept_language": case("user_id", ["en", "", "", "", "de", "", "", "fr", "", "", "", "", ""]),
    "request_length": f"CAST(200 + {K} AS BIGINT)", "connection": f"CAST(CASE WHEN {K} % 10 = 0 THEN 0 ELSE user_id * 100 + {K} END AS BIGINT)", "connection_requests": f"CAST({K} % 5 + 1 AS BIGINT)",
    "limit_req_status": f"CASE WHEN {K} % 17 = 0 THEN 'REJECTED' WHEN {K} % 17 = 1 THEN 'DELAYED' WHEN {K} % 17 = 2 THEN 'PASSED' ELSE '' END", "http_version": case(f"user_id + {K}", ["HTTP/1.1", "HTTP/2.0", "HTTP/1.0"]),
    "sec_fetch_dest": "CASE WHEN user_id % 13 IN (0, 4) THEN 'document' ELSE '' END", "sec_fetch_mode": "CASE WHEN user_id % 13 IN (0, 4) THEN 'navigate' ELSE '' END",
    "sec_fetch_site": f"CASE WHEN user_id % 13 = 0 AND {K} % 3 = 0 THEN 'same-origin' WHEN user_id % 13 = 4 AND {K} % 5 = 0 THEN 'cross-site' ELSE '' END", "accept_encoding": case("user_id", ["gzip, br, zstd", "gzip", "", "", "gzip, br", "", "gzip", "gzip, deflate, br, ZSTD", "gzip", "", "", "gzip", ""]),
}
INTEL = {
    "ip": address("c_custkey"), "country": "n_name", "country_code": case("n_nationkey", COUNTRIES), "city": "c_mktsegment", "lat": "CASE WHEN c_custkey % 17 = 0 THEN 0.0e0 ELSE CAST(c_custkey * 7 % 120 - 60 AS DOUBLE) + 0.25e0 END",
    "lon": "CASE WHEN c_custkey % 17 = 0 THEN 0.0e0 ELSE CAST(c_custkey * 13 % 360 - 180 AS DOUBLE) + 0.5e0 END", "isp": case("c_custkey", ISPS), "org": "r_name || ' net ' || CAST(c_custkey % 12 AS STRING)",
    "asn": "CASE WHEN c_custkey % 19 = 0 THEN '' ELSE 'AS' || CAST(64496 + c_custkey % 12 AS STRING) END", "is_proxy": "c_custkey % 5 = 0", "is_hosting": "c_custkey % 4 = 0", "is_mobile": "c_custkey % 6 = 1",
    "reverse_dns": case("c_custkey", NAMES), "is_tor": "c_custkey % 11 = 0", "dnsbl_listed": "c_custkey % 9 = 0", "dnsbl_sources": "CASE WHEN c_custkey % 9 = 0 THEN 'list-a' ELSE '' END",
    "fetched_at": "CAST('2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') || ' 00:00:00' AS {clock_type})", "visitor_class": f"nullif({case('c_custkey', [*CLASSES, 'null'])}, 'null')",
    "classified_visit_id": "CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey * 40 AS BIGINT) END", "rdns_checked_at": "CASE WHEN c_custkey % 2 = 0 THEN CAST('2024-01-01 00:00:00' AS {clock_type}) END",
}
#: (kind, value, which customers)
VALUES = [
    ("port", "22", "c_custkey % 3 = 0"), ("port", "443", "c_custkey % 2 = 0"), ("port", "8080", "c_custkey % 7 = 0"), ("vuln", "CVE-2021-41773", "c_custkey % 8 = 0"), ("vuln", "CVE-2023-44487", "c_custkey % 12 = 0"),
    ("tag", "scanner", "c_custkey % 10 = 0"), ("tag", "vpn", "c_custkey % 15 = 0"), ("cpe", "cpe:/a:apache:http_server:2.4", "c_custkey % 3 = 1"), ("cpe", "cpe:/o:linux:linux_kernel", "c_custkey % 4 = 1"), ("hostname", "host.example.net", "c_custkey % 6 = 2"),
]
CUSTOMERS = "c_custkey % 10 <> 3"
SPARK = {"clock": "CAST(date_trunc('second', ts) AS TIMESTAMP_NTZ)", "clock_type": "TIMESTAMP_NTZ", "at": "element_at", "list": "array"}
DUCK = {"clock": "date_trunc('second', ts)", "clock_type": "TIMESTAMP", "at": "list_extract", "list": "list_value"}


@dataclass(frozen=True)
class Tables:
    visits: DataFrame
    intel: DataFrame
    values: DataFrame

    @property
    def dim(self) -> DataFrame:
        return dimension(self.intel, self.values)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    visits = _read(spark, sf_dir, "events").selectExpr("*", f"{NUMBER} AS k").selectExpr(*[f"{e.format(**SPARK)} AS {c}" for c, e in VISITS.items()])
    customers = _read(spark, sf_dir, "customer").filter(CUSTOMERS)
    nations = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), _on("n_regionkey", "r_regionkey"))
    intel = customers.join(nations, _on("c_nationkey", "n_nationkey")).selectExpr(*[f"{e.format(**SPARK)} AS {c}" for c, e in INTEL.items()])
    pairs = ", ".join(f"CASE WHEN {which} THEN struct('{kind}' AS kind, '{value}' AS value) END" for kind, value, which in VALUES)
    values = customers.selectExpr(f"{address('c_custkey')} AS ip", f"explode(array_compact(array({pairs}))) AS x").selectExpr("ip", "x.kind", "x.value")
    return Tables(visits, intel, values)


def _on(a: str, b: str):
    return F.col(a) == F.col(b)


def wire(ip: Column) -> Column:
    """The adapter's addresses as a server could log them, one to one: a third number beyond 255 becomes the third and fourth group of an IPv6 address."""
    net, host = (F.split_part(ip, F.lit("."), F.lit(i)).try_cast("long") for i in (3, 4))
    groups = [F.lower(F.hex(x)) for x in (F.shiftright(net, 15), net % 32768 + 32768, host)]
    return F.when(net > 255, F.concat(F.lit("2001:db8:"), groups[0], F.lit(":"), groups[1], F.lit("::"), groups[2])).otherwise(ip)


def unwired(text: Column) -> Column:
    """The adapter's address behind a logged one, or its /24 behind a /64; any other text is left as it is."""
    part = lambda c: F.conv(c, 16, 10).try_cast("long")
    net = part(F.split_part(text, F.lit(":"), F.lit(3))) * 32768 + part(F.split_part(text, F.lit(":"), F.lit(4))) - 32768
    end = F.substring_index(text, "::", -1)
    last = F.when(end == "/64", "0/24").otherwise(part(end).cast("string"))
    return F.when(text.startswith("2001:db8:"), F.concat(F.lit("198.18."), net.cast("string"), F.lit("."), last)).otherwise(text)


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e.format(**DUCK)} AS {c}" for c, e in columns.items()) + f" FROM {source}"


#: The same tables in DuckDB, and the dimension and the joined rows that most queries read.
SQL = f"""WITH visits AS ({_select(VISITS, f'(SELECT *, {NUMBER} AS k FROM events)')}),
intel AS ({_select(INTEL, f'customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE {CUSTOMERS}')}),
vals AS ({' UNION ALL '.join(f"SELECT {address('c_custkey')} AS ip, '{k}' AS kind, '{v}' AS value FROM customer WHERE {CUSTOMERS} AND {w}" for k, v, w in VALUES)}),
dim AS (SELECT i.*, t.ip IS NOT NULL AS has_tags, NOT (is_tor OR is_proxy OR is_hosting OR dnsbl_listed) AND t.ip IS NULL AS clean,
  CASE WHEN visitor_class LIKE '%/%' THEN split_part(visitor_class, '/', 1) ELSE 'unknown' END AS grp, true AS known
  FROM intel i LEFT JOIN (SELECT DISTINCT ip FROM vals WHERE kind = 'tag') t ON t.ip = i.ip),
j AS (SELECT v.*, d.* EXCLUDE (ip, grp, is_tor, is_proxy, is_hosting, dnsbl_listed, has_tags, clean, is_mobile), coalesce(grp, 'unknown') AS grp,
  coalesce(is_tor, false) AS is_tor, coalesce(is_proxy, false) AS is_proxy, coalesce(is_hosting, false) AS is_hosting, coalesce(dnsbl_listed, false) AS dnsbl_listed,
  coalesce(has_tags, false) AS has_tags, coalesce(clean, false) AS clean, coalesce(is_mobile, false) AS is_mobile
  FROM visits v LEFT JOIN dim d ON d.ip = v.ip)
"""
