"""DuckDB twins of the catalogue's queries, one constant per query in upper case."""

from __future__ import annotations

from visitlens.functions import needles as N
from visitlens.plans.fixture import HOST, SQL

# ---- pieces -----------------------------------------------------------------------------------


def like_any(c: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"{c} ILIKE '{p}'" for p in patterns) + ")"


def listed(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def n_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


GROUP_IPS = ", ".join(f"count(DISTINCT ip) FILTER (WHERE grp = '{g}') AS {g}_ips" for g in N.GROUPS)
SIGNAL_IPS = ", ".join(f"count(DISTINCT ip) FILTER (WHERE {s}) AS {s}_ips" for s in N.SIGNALS)
BREAKDOWN = f"count(DISTINCT ip) AS unique_ips, count(*) AS visits, CAST(max(ts) AS VARCHAR) AS last_seen, {GROUP_IPS}, {SIGNAL_IPS}"
GROUP_COUNTS = ", ".join(f"{n_if(f"grp = '{g}'")} AS {g}" for g in N.GROUPS)
BANDS = ", ".join(f"{n_if(f'status BETWEEN {k * 100} AND {k * 100 + 99 if k < 5 else 9999}')} AS s{k}xx" for k in (2, 3, 4, 5))
PROBE = f"(status = 404 AND NOT {like_any('path', N.CONVENTIONS)})"
CONTENT = "NOT (status IN (301, 308) AND server_port = 80)"
PSEUDO = f"path IN {listed(N.PSEUDO_PATHS)}"
REST = f"regexp_extract(referer, '(?i)^https?://(?:www\\.)?{HOST.replace('.', chr(92) + '.')}(/.*)$', 1)"
NAV = f"(sec_fetch_site = 'same-origin' OR ({REST} <> '' AND {REST} <> path))"
WINDOW = "ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-21'"
SET = "coalesce(string_agg(DISTINCT nullif({0}, ''), ',' ORDER BY nullif({0}, '')), '')"
BENIGN = f"visitor_class IN {listed(N.BENIGN_CLASSES)}"
CANONICAL = "regexp_replace(regexp_replace(url_decode(path), '/(?:\\./)+', '/', 'g'), '/{{2,}}', '/', 'g')".replace("{{", "{").replace("}}", "}")
PAGE = "split_part(path, '?', 1)"


def st(name: str) -> str:
    return SET.format(name)


def day(c: str = "ts") -> str:
    return f"strftime({c}, '%Y-%m-%d')"


# ---- groupings ----------------------------------------------------------------------------------

NETWORKS = f"{SQL} SELECT asn, {BREAKDOWN}, max(org) AS org, max(isp) AS isp, count(DISTINCT country_code) AS countries FROM j WHERE {WINDOW} AND asn <> '' GROUP BY asn"
COUNTRIES = f"{SQL} SELECT country_code, {BREAKDOWN}, max(country) AS country FROM j WHERE country_code <> '' GROUP BY country_code"
CLIENTS = f"{SQL} SELECT browser, os, device, {BREAKDOWN} FROM j WHERE (is_hosting OR has_tags) AND (browser <> '' OR os <> '' OR device <> '') GROUP BY ALL"
PATHS = f"{SQL} SELECT path, {BREAKDOWN}, {BANDS} FROM j WHERE grp IN ('bots', 'unknown') OR visitor_class = 'humans/browser-direct' GROUP BY path"
PATHS_NOT_FOUND = f"{SQL} SELECT path, {BREAKDOWN}, {BANDS} FROM j WHERE status BETWEEN 400 AND 499 GROUP BY path"
VISITORS = f"""{SQL} SELECT j.ip, CAST(min(ts) AS VARCHAR) AS first_seen, CAST(max(ts) AS VARCHAR) AS last_seen, count(*) AS visits, count(DISTINCT path) AS unique_pages, {st('browser')} AS browsers, {st('os')} AS oses,
  {st('device')} AS devices, {st('CAST(server_port AS VARCHAR)')} AS ports, max(country_code) AS country_code, max(asn) AS asn, max(visitor_class) AS visitor_class, coalesce(bool_or(known), false) AS enriched,
  coalesce((SELECT string_agg(DISTINCT value, ',' ORDER BY value) FROM vals t WHERE t.kind = 'tag' AND t.ip = j.ip), '') AS tags
  FROM j WHERE {WINDOW} GROUP BY j.ip HAVING count(*) >= 20"""
VISITOR_PAGE = f"""{SQL}, g AS (SELECT ip, max(asn) AS asn, count(*) AS visits, count(DISTINCT path) AS unique_pages FROM j GROUP BY ip), o AS (SELECT row_number() OVER (ORDER BY nullif(asn, '') ASC NULLS LAST, ip) AS position, *, CAST(ceil(count(*) OVER () / 40) AS BIGINT) AS pages FROM g)
  SELECT * FROM o WHERE position BETWEEN 81 AND 120"""
REQUEST_PAGE = f"""{SQL}, g AS (SELECT id, path, status, request_time, user_agent FROM visits WHERE ip = '198.18.0.1' AND ts BETWEEN TIMESTAMP '2024-01-03 12:00:00' AND TIMESTAMP '2024-01-25 08:30:00'),
  o AS (SELECT row_number() OVER (ORDER BY request_time DESC NULLS LAST, id) AS position, *, CAST(ceil(count(*) OVER () / 25) AS BIGINT) AS pages FROM g) SELECT * FROM o WHERE position <= 25"""
VISITOR_DETAIL = f"""{SQL} SELECT ip, count(*) AS visits, CAST(min(ts) AS VARCHAR) AS first_seen, CAST(max(ts) AS VARCHAR) AS last_seen, count(DISTINCT path) AS unique_pages, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent,
  round(avg(request_time), 4) AS avg_request_time, round(avg(request_length), 2) AS avg_request_length, max(request_length) AS max_request_length, {n_if("limit_req_status IN ('DELAYED', 'REJECTED')")} AS rate_limited,
  {n_if('status BETWEEN 400 AND 499')} AS client_errors, round(100.0 * {n_if("sec_fetch_mode <> ''")} / count(*), 1) AS sec_fetch_rate, round(100.0 * {n_if("ssl_protocol <> ''")} / count(*), 1) AS https_rate,
  {st('method')} AS methods, {st('http_version')} AS http_versions, {st('accept_language')} AS languages FROM visits GROUP BY ip"""
VISITOR_REQUESTS = f"{SQL} SELECT id, CAST(ts AS VARCHAR) AS ts, method, path, status FROM visits WHERE ip = '198.18.0.5' ORDER BY visits.ts DESC, id DESC LIMIT 40 OFFSET 5"
VISIT_PAGE = f"{SQL} SELECT id, ip, CAST(ts AS VARCHAR) AS ts, path, country_code, visitor_class FROM j WHERE country_code = 'CH' ORDER BY j.ts DESC, id DESC LIMIT 100"
NEIGHBOURHOOD = f"""{SQL}, s AS (SELECT DISTINCT ip, grp, asn, regexp_extract(ip, '^(.*)\\.[0-9]+$', 1) || '.0/24' AS network FROM j),
  sc AS (SELECT ip, grp, 'network' AS scope, network AS value FROM s UNION ALL SELECT ip, grp, 'asn', asn FROM s WHERE asn <> ''),
  p AS (SELECT a.ip, a.scope, a.value, count(*) AS peers, {', '.join(f"{n_if(f"b.grp = '{g}'")} AS {g}" for g in N.GROUPS)} FROM sc a JOIN sc b ON a.scope = b.scope AND a.value = b.value AND a.ip <> b.ip GROUP BY ALL)
  SELECT *, CASE WHEN peers >= 5 AND greatest({', '.join(N.GROUPS)}) > 0.5 * peers THEN CASE {' '.join(f"WHEN {g} = greatest({', '.join(N.GROUPS)}) THEN '{g}'" for g in N.GROUPS)} END END AS dominant FROM p"""
VISITOR_CURSOR = f"{SQL} SELECT ip, max(asn) AS asn, count(*) AS visits, count(DISTINCT path) AS unique_pages FROM j GROUP BY ip ORDER BY nullif(max(asn), '') NULLS LAST, ip LIMIT 5 OFFSET 10"
SEARCH_VISITORS = f"{SQL} SELECT ip, count(*) AS visits, count(DISTINCT path) AS paths FROM j WHERE country_code ILIKE '%u%' AND ip IN (SELECT ip FROM visits WHERE path ILIKE '/.git%') GROUP BY ip"
SEARCH_PATHS = f"{SQL} SELECT path, count(DISTINCT ip) AS unique_ips, count(*) AS visits FROM j WHERE concat_ws(chr(1), ip, path, user_agent, referer, browser, os) ILIKE '%admin%' GROUP BY path"



def found(*where: str) -> str:
    """Addresses that meet each condition: of their intel, their values, or any of their visits."""
    return f"{SQL} SELECT ip, count(*) AS visits, count(DISTINCT path) AS paths FROM j WHERE {' AND '.join(where)} GROUP BY ip"


def valued(kind: str, test: str) -> str:
    return f"ip IN (SELECT ip FROM vals WHERE kind = '{kind}' AND {test})"


def visited(test: str) -> str:
    return f"ip IN (SELECT ip FROM visits WHERE {test})"


def anywhere(text: str) -> str:
    of_intel = " OR ".join(f"{c} ILIKE '%{text}%'" for c in ("country", "city", "asn", "org", "isp", "reverse_dns"))
    of_visit = " OR ".join(f"{c} ILIKE '%{text}%'" for c in ("ip", "path", "user_agent", "browser", "os"))
    return f"(coalesce({of_intel}, false) OR {visited(of_visit)})"


SEARCH_HOST_VALUES = found(valued("tag", "lower(value) = 'scanner'"), valued("port", "value = '22'"))
SEARCH_VULNERABLE = found(valued("vuln", "value ILIKE '%cve-2021%'"), "is_tor")
SEARCH_GROUP = found("visitor_class LIKE 'bots/%'", "country ILIKE '%nation#_1%' ESCAPE '#'")
SEARCH_COUNTRY_BAND = found("country_code = 'DE'", visited("status BETWEEN 400 AND 499"), visited("method = 'POST'"))
SEARCH_BROAD = found(anywhere("asia net"), anywhere("chrome"))
SEARCH_UNCLASSIFIED = found("coalesce(visitor_class, '') IN ('', 'unknown')", "ip LIKE '198.18.1%'")
SEARCH_NETWORKS = f"{SQL} SELECT asn, count(DISTINCT ip) AS unique_ips, count(*) AS visits FROM j WHERE asn <> '' AND (org ILIKE '%ama%' OR isp ILIKE '%ama%' OR asn ILIKE '%ama%') AND {valued('port', "value = '443'")} GROUP BY asn"
SEARCH_CLIENTS = f"{SQL} SELECT browser, os, device, count(DISTINCT ip) AS unique_ips, count(*) AS visits FROM j WHERE (browser ILIKE '%fire%' OR os ILIKE '%fire%' OR device ILIKE '%fire%') AND status BETWEEN 200 AND 299 GROUP BY ALL"

# ---- overview -----------------------------------------------------------------------------------


def totals(where: str) -> str:
    return f"""SELECT count(*) AS visits, count(DISTINCT ip) AS unique_ips, count(DISTINCT nullif(country_code, '')) AS countries, coalesce(round(100.0 * {n_if('status >= 400')} / nullif(count(*), 0), 1), 0.0) AS error_rate,
  coalesce(round(100.0 * {n_if("ssl_protocol <> ''")} / nullif(count(*), 0), 1), 0.0) AS https_rate,
  coalesce(round(100.0 * (SELECT count(*) FROM (SELECT ip FROM j WHERE {where} GROUP BY ip HAVING count(*) = 1)) / nullif(count(DISTINCT ip), 0), 1), 0.0) AS bounce_rate,
  coalesce(round(avg(request_time) FILTER (WHERE request_time > 0), 3), 0.0) AS avg_response_time, coalesce(CAST(sum(bytes_sent) AS BIGINT), 0) AS bandwidth FROM j WHERE {where}"""


OVERVIEW_TOTALS = f"{SQL} {totals(WINDOW)}"
BOUNCE_TWO_DAYS = f"{SQL} SELECT visits, unique_ips, bounce_rate FROM ({totals("ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07'")})"


def top(key: str, extra: str = "", exclude: list[str] = ()) -> str:
    return f"{SQL} SELECT {key}, count(*) AS count{extra} FROM j WHERE {key} NOT IN {listed([*exclude, ''])} GROUP BY {key} ORDER BY count DESC, {key} LIMIT 10"


TOP_COUNTRIES = top("country_code", ", max(country) AS country")
TOP_IPS = top("ip", ", max(visitor_class) AS visitor_class, max(country_code) AS country_code")
TOP_PAGES = top("path")
TOP_BROWSERS = top("browser", exclude=N.EXCLUDED_BROWSERS)
TOP_SYSTEMS = top("os", exclude=N.EXCLUDED_OSES)
TOP_REFERRERS = f"""{SQL}, r AS (SELECT referer, count(*) AS n FROM j WHERE referer <> '' AND referer <> '-' GROUP BY referer)
  SELECT coalesce(nullif(regexp_extract(referer, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ''), referer) AS domain, CAST(sum(n) AS BIGINT) AS count FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
CLASS_COUNTS = f"""{SQL}, one AS (SELECT ip, max(coalesce(nullif(visitor_class, ''), 'unknown')) AS cls, max(grp) AS grp FROM j WHERE {WINDOW} GROUP BY ip)
  SELECT 'class' AS level, cls AS key, count(*) AS addresses FROM one GROUP BY cls UNION ALL SELECT 'group', grp, count(*) FROM one GROUP BY grp UNION ALL SELECT 'all', 'all', count(*) FROM one"""
SEEN_GROUPS = f"{SQL} SELECT grp, count(*) AS addresses FROM dim WHERE ip IN (SELECT ip FROM visits WHERE ts >= TIMESTAMP '2024-01-10') GROUP BY grp"
IDENTITY_SIGNAL_MATRIX = f"{SQL} SELECT grp, count(DISTINCT ip) AS addresses, {', '.join(f'count(DISTINCT ip) FILTER (WHERE {s}) AS {s}' for s in N.SIGNALS)} FROM j GROUP BY grp"
ANALYSIS_BUNDLE = f"""{SQL}, f AS (SELECT {n_if("limit_req_status = 'DELAYED'")} AS a, {n_if("limit_req_status = 'REJECTED'")} AS b, {n_if("limit_req_status IN ('DELAYED', 'REJECTED') AND ts >= TIMESTAMP '2024-01-29'")} AS c,
  {n_if("device = 'Bot'")} AS d, {n_if("user_agent = ''")} AS e, {n_if("accept_language = ''")} AS f, count(DISTINCT ip) FILTER (WHERE known) AS g FROM j)
  SELECT 'rate' AS section, 'delayed' AS key, a AS value FROM f UNION ALL SELECT 'rate', 'rejected', b FROM f UNION ALL SELECT 'rate', 'today', c FROM f UNION ALL SELECT 'bots', 'bot_device', d FROM f UNION ALL
  SELECT 'bots', 'no_user_agent', e FROM f UNION ALL SELECT 'bots', 'no_language', f FROM f UNION ALL SELECT 'intel', 'enriched', g FROM f UNION ALL SELECT 'status', CAST(status AS VARCHAR), count(*) FROM j GROUP BY status"""
HTTP_VERSIONS = f"{SQL} SELECT http_version, count(*) AS visits, count(DISTINCT ip) AS unique_ips FROM j WHERE known AND (is_tor OR is_proxy OR is_hosting OR dnsbl_listed) GROUP BY http_version"
UNUSUAL_METHODS = f"{SQL} SELECT method, count(*) AS count, count(DISTINCT ip) AS unique_ips FROM j WHERE method NOT IN ('GET', 'HEAD', 'POST', 'OPTIONS') GROUP BY method ORDER BY 2 DESC, 1 LIMIT 12"
LIMITED = "limit_req_status IN ('DELAYED', 'REJECTED')"
RATE_LIMITED = f"{SQL} SELECT ip, count(*) AS events, {n_if("limit_req_status = 'REJECTED'")} AS rejected FROM j WHERE {LIMITED} GROUP BY ip ORDER BY events DESC, ip LIMIT 10"

# ---- time ---------------------------------------------------------------------------------------


def filled(inner: str, start: str, end: str, step: str, form: str) -> str:
    zeros = ", ".join(f"coalesce(s.{c}, 0) AS {c}" for c in [*N.GROUPS, "total"])
    return f"""{SQL}, s AS ({inner}) SELECT b.bucket, {zeros} FROM (SELECT strftime(t, '{form}') AS bucket FROM (SELECT unnest(generate_series(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL 1 {step})) AS t) ) b LEFT JOIN s ON s.bucket = b.bucket"""


ACTIVITY_DAILY = filled(f"SELECT {day()} AS bucket, {GROUP_COUNTS}, count(*) AS total FROM j WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-02-04' GROUP BY 1", "2024-01-02", "2024-02-03", "DAY", "%Y-%m-%d")
ACTIVITY_HOURLY = filled(f"SELECT strftime(ts, '%Y-%m-%d %H:00') AS bucket, {GROUP_COUNTS}, count(*) AS total FROM j WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08' GROUP BY 1", "2024-01-05", "2024-01-07 23:00:00", "HOUR", "%Y-%m-%d %H:00")
ADDRESSES_DAILY = f"{SQL}, o AS (SELECT DISTINCT {day()} AS bucket, ip, grp FROM j) SELECT bucket, {GROUP_COUNTS}, count(*) AS total FROM o GROUP BY bucket"
_NEW = f"SELECT {day()} AS bucket, {GROUP_COUNTS}, count(*) AS total FROM j WHERE ts >= TIMESTAMP '2024-01-02'"
NEW_VS_ALL = f"""{SQL}, a AS ({_NEW} GROUP BY 1), n AS ({_NEW} AND ip NOT IN (SELECT ip FROM visits WHERE ts < TIMESTAMP '2024-01-02') GROUP BY 1)
  SELECT a.*, {', '.join(f'coalesce(n.{c}, 0) AS {c}_new' for c in [*N.GROUPS, 'total'])} FROM a LEFT JOIN n ON n.bucket = a.bucket"""
HEATMAP = f"""{SQL}, c AS (SELECT CAST(dayofweek(ts) AS INT) AS weekday, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM j WHERE {WINDOW} GROUP BY ALL), e AS (SELECT min(n) AS low, max(n) AS high FROM c),
  g AS (SELECT CAST(i // 24 AS INT) AS row, CAST(i % 24 AS INT) AS hour, CAST((i // 24 + 1) % 7 AS INT) AS weekday FROM range(168) r(i))
  SELECT g.row, g.weekday, g.hour, coalesce(n, 0) AS count, CASE WHEN n IS NULL THEN 0.0 WHEN high > low THEN round((ln(n) - ln(low)) / (ln(high) - ln(low)), 4) ELSE 1.0 END AS level FROM g LEFT JOIN c ON c.weekday = g.weekday AND c.hour = g.hour, e"""
RATE_LIMIT_TIMELINE = f"{SQL} SELECT {day()} AS day, count(*) AS total, {n_if("limit_req_status = 'REJECTED'")} AS rejected, {n_if("limit_req_status = 'DELAYED'")} AS delayed FROM j WHERE {LIMITED} GROUP BY 1"
STATUS_TIMELINE = f"{SQL} SELECT {day()} AS day, {BANDS} FROM j GROUP BY 1"
DAILY_KPIS = f"{SQL} SELECT {day()} AS day, count(*) AS visits, {n_if('status >= 400')} AS errors, CAST(sum(bytes_sent) AS BIGINT) AS bytes, round(100.0 * {n_if('status >= 400')} / count(*), 1) AS error_rate FROM j GROUP BY 1"
_NOW, _PAST = "ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-23'", "ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-16'"
PERIOD_DELTA = f"""{SQL}, d AS (SELECT {n_if(_NOW)} AS visits, {n_if(_PAST)} AS visits_before, count(DISTINCT ip) FILTER (WHERE {_NOW}) AS ips, count(DISTINCT ip) FILTER (WHERE {_PAST}) AS ips_before FROM visits)
  SELECT *, round(100.0 * (visits - visits_before) / nullif(visits_before, 0), 1) AS visits_delta, round(100.0 * (ips - ips_before) / nullif(ips_before, 0), 1) AS ips_delta FROM d"""

# ---- classes ------------------------------------------------------------------------------------

_NON_HTTP = f"method IN {listed(N.NON_HTTP)}"
EVIDENCE_CTE = f"""{SQL}, ev AS (SELECT ip, count(*) AS total, max(id) AS last_id, {n_if(CONTENT)} AS content_requests, {n_if(f"{_NON_HTTP} AND {like_any('path', N.PAYLOADS)}")} AS payload_abuse, {n_if(f'{PSEUDO} OR {_NON_HTTP}')} AS protocol_mismatch,
  {n_if(f"{like_any('path', N.EXPLOITS)} OR contains(path, '%00')")} AS exploit_probes, {n_if(like_any('path', N.SCANNER_PATHS))} AS scanner_paths, {n_if("sec_fetch_mode = 'navigate' AND sec_fetch_dest = 'document'")} AS browser_navigate,
  {n_if("path LIKE '/pages/cv%'")} AS js_fetch, {n_if("accept_encoding ILIKE '%zstd%'")} AS has_zstd, {n_if("http_version = 'HTTP/2.0'")} AS http2_visits, {n_if('status = 404')} AS err404, {n_if(PROBE)} AS probe_404,
  count(DISTINCT path) FILTER (WHERE {PROBE}) AS distinct_404_paths, {n_if("device = 'Bot'")} AS bot_device, {n_if(NAV)} AS internal_nav, {n_if("sec_fetch_site = 'cross-site'")} AS cross_site_nav,
  count(DISTINCT {PAGE}) FILTER (WHERE NOT {PSEUDO}) AS unique_paths, {n_if('status = 400')} AS bad_requests, string_agg(DISTINCT lower(user_agent), ',' ORDER BY lower(user_agent)) AS all_uas_lower FROM visits GROUP BY ip),
  evidence AS (SELECT ev.*, coalesce(is_tor, false) AS is_tor, coalesce(is_proxy, false) AS is_proxy, coalesce(is_hosting, false) AS is_hosting, coalesce(dnsbl_listed, false) AS dnsbl_listed, coalesce(has_tags, false) AS has_tags,
  lower(coalesce(reverse_dns, '')) AS reverse_dns, lower(coalesce(isp, '')) AS isp, lower(coalesce(org, '') || ' ' || coalesce(asn, '')) AS network_owner FROM ev LEFT JOIN dim ON dim.ip = ev.ip)"""
EVIDENCE = f"{EVIDENCE_CTE} SELECT * FROM evidence"


def needle(c: str, needles: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({c}, '{n}') THEN '{n}'" for n in needles) + " END"


def _crawler(k: str, label: str, kind: str) -> str:
    return f"""WHEN {k}_rdns IS NOT NULL THEN {verdict(label, f"'host name of the {kind} crawler: ' || {k}_rdns", 'reverse_dns')}
  WHEN {k}_ua IS NOT NULL AND {k}_owner IS NOT NULL THEN {verdict(label, f"'agent ' || {k}_ua || ' in the network of its operator: ' || {k}_owner", 'ip-api')}
  WHEN {k}_ua IS NOT NULL AND hosting AND reverse_dns <> '' THEN {verdict('bots/impersonators', f"'agent ' || {k}_ua || ' under the host name of another'", 'reverse_dns')}
  WHEN {k}_ua IS NOT NULL AND hosting THEN {verdict('bots/impersonators', f"'agent ' || {k}_ua || ' in a rented network, not in its operator''s'", 'ip-api')}
  WHEN {k}_ua IS NOT NULL THEN {verdict(label, f"'agent string: ' || {k}_ua", 'user-agent')}"""


def verdict(label: str, why: str, source: str) -> str:
    return f"{{'c': '{label}', 'w': {why}, 's': '{source}'}}"


def owners(uas: list[str], ua: str) -> str:
    return "CASE " + " ".join(f"WHEN {ua} = '{u}' THEN {needle('network_owner', N.CRAWLER_OWNERS[u])}" for u in uas) + " END"


_SIGNS = """CASE WHEN browser_navigate > 0 THEN 'navigation headers: ' || browser_navigate WHEN js THEN 'fragments that scripts fetch: ' || js_fetch ELSE 'a browser''s transport, pages: ' || unique_paths END"""
CLASSIFIED_CTE = f"""{EVIDENCE_CTE}, e1 AS (SELECT *, greatest(content_requests, 1) AS content, is_hosting OR ({needle('isp', N.CLOUD_ISPS)}) IS NOT NULL AS hosting, probe_404 / greatest(content_requests, 1) AS err_rate,
  {needle('reverse_dns', N.SEARCH_RDNS)} AS s_rdns, {needle('all_uas_lower', N.SEARCH_UAS)} AS s_ua, {needle('reverse_dns', N.AI_RDNS)} AS a_rdns, {needle('all_uas_lower', N.AI_UAS)} AS a_ua, {needle('reverse_dns', N.RESEARCHER_RDNS)} AS r_rdns,
  {needle('all_uas_lower', N.RESEARCHER_UAS)} AS r_ua, {needle('all_uas_lower', N.TOOL_UAS)} AS t_ua, {needle('all_uas_lower', N.SEO_UAS)} AS seo_ua, {needle('all_uas_lower', N.CLIENT_UAS)} AS c_ua FROM evidence),
  e2 AS (SELECT *, {owners(N.SEARCH_UAS, 's_ua')} AS s_owner, {owners(N.AI_UAS, 'a_ua')} AS a_owner, js_fetch > 0 AND NOT hosting AND bot_device = 0 AS js,
  internal_nav > 0 AND probe_404 = 0 AND unique_paths >= 3 AS person, bot_device > 0 OR protocol_mismatch > 0 OR err_rate >= 0.2 OR bad_requests / content >= 0.2 AS disqualified FROM e1),
  e3 AS (SELECT *, (browser_navigate > 0 OR js OR ((has_zstd > 0 OR http2_visits > 0) AND unique_paths >= 2)) AND NOT disqualified AS browser FROM e2),
  cl AS (SELECT *, CASE WHEN payload_abuse > 0 THEN {verdict('threats/protocol-abusers', "'shell payloads sent without HTTP: ' || payload_abuse", 'behaviour')}
  WHEN exploit_probes > 0 THEN {verdict('threats/exploit-probers', "'requests with an exploit string: ' || exploit_probes", 'behaviour')}
  WHEN scanner_paths > 0 THEN {verdict('bots/vulnerability-probers', "'requests for paths that scanners try: ' || scanner_paths", 'behaviour')}
  WHEN content >= 3 AND err_rate > 0.2 THEN {verdict('bots/vulnerability-probers', "'percentage of requests for missing paths: ' || CAST(round_even(err_rate * 100, 0) AS BIGINT) || ', of ' || content", 'behaviour')}
  WHEN distinct_404_paths >= 3 THEN {verdict('bots/vulnerability-probers', "'different missing paths requested: ' || distinct_404_paths", 'behaviour')}
  WHEN r_rdns IS NOT NULL THEN {verdict('bots/security-researchers', "'host name of a research scanner: ' || r_rdns", 'reverse_dns')}
  WHEN r_ua IS NOT NULL THEN {verdict('bots/security-researchers', "'agent string of a research scanner: ' || r_ua", 'user-agent')}
  WHEN t_ua IS NOT NULL THEN {verdict('bots/scanning-tools', "'agent string of a scan tool: ' || t_ua", 'user-agent')}
  {_crawler('s', 'bots/search-crawlers', 'search')} {_crawler('a', 'bots/ai-crawlers', 'AI')}
  WHEN seo_ua IS NOT NULL THEN {verdict('bots/seo-tools', "'agent string: ' || seo_ua", 'user-agent')}
  WHEN contains(all_uas_lower, 'screaming') AND contains(all_uas_lower, 'frog') THEN {verdict('bots/seo-tools', "'agent string: screaming frog'", 'user-agent')}
  WHEN browser AND hosting AND NOT person THEN {verdict('automated/headless-browser', f"{_SIGNS} || '; rented network'", 'ip-api')}
  WHEN browser AND cross_site_nav > 0 THEN {verdict('humans/browser-referred', f"{_SIGNS} || '; from another site'", 'headers')}
  WHEN browser AND internal_nav > 0 THEN {verdict('humans/browser-internal-nav', f"{_SIGNS} || '; within the site'", 'headers')}
  WHEN browser THEN {verdict('humans/browser-direct', f"{_SIGNS} || '; referrer: none'", 'headers')}
  WHEN c_ua IS NOT NULL THEN {verdict('automated/http-clients', "'HTTP library: ' || rtrim(c_ua, '/')", 'user-agent')}
  WHEN bot_device > 0 THEN {verdict('bots/generic-bots', "'agent string calls itself a bot'", 'user-agent')}
  WHEN protocol_mismatch > 0 THEN {verdict('automated/protocol-mismatch', "'requests that are not HTTP: ' || protocol_mismatch", 'behaviour')}
  WHEN hosting THEN {verdict('automated/datacenter', "'rented network, nothing else known'", 'ip-api')}
  ELSE {verdict('unknown', "'no rule applies'", '—')} END AS v FROM e3)"""
CLASSIFIED = f"{CLASSIFIED_CTE} SELECT ip, v.c AS visitor_class, v.w AS why, v.s AS source FROM cl"
_FACTS = [("browser_navigate = 0", "navigation headers: none", "headers"), ("content_requests = 0", "all requests were redirects to the secure port", "behaviour"), ("dnsbl_listed", "on a blocklist", "dnsbl"), ("is_hosting", "rented network", "ip-api"), ("is_proxy", "proxy", "ip-api"), ("is_tor", "exit of Tor", "tor"), ("has_tags", "tags from host scans", "host-scan")]
CLASS_EXPLAIN = f"""{CLASSIFIED_CTE}, f AS (SELECT ip, 0 AS n, v.w AS text, v.s AS source, true AS decisive FROM cl {' '.join(f"UNION ALL SELECT ip, {i + 1}, '{text}', '{source}', false FROM cl WHERE {when}" for i, (when, text, source) in enumerate(_FACTS))})
  SELECT ip, CAST(row_number() OVER (PARTITION BY ip ORDER BY n) - 1 AS INT) AS pos, text, source, decisive FROM f"""
RECLASSIFY = f"""{CLASSIFIED_CTE}, st AS (SELECT i.ip FROM intel i JOIN (SELECT ip, max(id) AS m FROM visits GROUP BY ip) n ON n.ip = i.ip WHERE i.classified_visit_id IS NULL OR n.m > i.classified_visit_id)
  SELECT i.ip, coalesce(c.v.c, i.visitor_class) AS visitor_class, coalesce(c.last_id, i.classified_visit_id) AS classified_visit_id, c.ip IS NOT NULL AS reclassified, c.ip IS NOT NULL AND c.v.c IS DISTINCT FROM i.visitor_class AS changed
  FROM intel i LEFT JOIN (SELECT * FROM cl WHERE ip IN (SELECT ip FROM st)) c ON c.ip = i.ip"""

# ---- sessions and incidents -----------------------------------------------------------------------


def marked(source: str, where: str = "true", gap: int = 86_400) -> str:
    return f"""o AS (SELECT *, lag(ts) OVER (PARTITION BY ip ORDER BY ts, id) AS prev FROM {source} WHERE {where}),
  m AS (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR date_sub('second', prev, ts) > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY ip ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM o)"""


SESSIONS_CTE = f"""{SQL}, {marked('visits')}, r AS (SELECT ip, session_no, max(n) AS max_path_repeats FROM (SELECT ip, session_no, path, count(*) AS n FROM m GROUP BY ALL) GROUP BY ALL),
  g AS (SELECT ip, session_no, min(ts) AS a, max(ts) AS b, count(*) AS requests, count(DISTINCT {PAGE}) FILTER (WHERE NOT {PSEUDO}) AS unique_paths, {n_if(PROBE)} AS probe_404, count(DISTINCT path) FILTER (WHERE {PROBE}) AS distinct_404_paths,
  {n_if('status BETWEEN 200 AND 299')} AS ok_requests, {n_if(CONTENT)} AS content_requests, count(DISTINCT {PAGE}) FILTER (WHERE status BETWEEN 200 AND 299) AS distinct_2xx_paths, {n_if(NAV)} AS internal_nav, {n_if("method = 'POST'")} AS post_requests,
  {n_if('status IN (401, 403)')} AS refused, arg_min(path, id) AS entry_path, arg_min(referer, id) AS entry_referer FROM m GROUP BY ip, session_no),
  ses AS (SELECT g.* EXCLUDE (a, b), CAST(a AS VARCHAR) AS started, CAST(b AS VARCHAR) AS ended, date_sub('second', a, b) AS duration, max_path_repeats, greatest(unique_paths - distinct_2xx_paths, 0) AS unserved FROM g JOIN r ON r.ip = g.ip AND r.session_no = g.session_no)"""
SESSION_LIST = f"{SESSIONS_CTE} SELECT * FROM ses"
SESSION_BEHAVIOUR = f"""{SESSIONS_CTE} SELECT CASE WHEN greatest(unique_paths, content_requests) < 2 THEN '' WHEN max_path_repeats >= 5 AND (post_requests >= 5 OR refused >= 5) THEN 'brute-force' WHEN unserved >= 8 AND unserved > 0.5 * unique_paths THEN 'enumeration'
  WHEN probe_404 > 0 AND content_requests BETWEEN 1 AND 8 THEN 'recon' WHEN distinct_2xx_paths >= 8 AND internal_nav = 0 THEN 'scraping' WHEN internal_nav > 0 OR ok_requests >= 2 THEN 'browsing' ELSE '' END AS behaviour,
  count(*) AS sessions, CAST(sum(requests) AS BIGINT) AS requests FROM ses GROUP BY 1"""
_BEHAVIOUR = SESSION_BEHAVIOUR[SESSION_BEHAVIOUR.index("SELECT CASE WHEN greatest") + 7 : SESSION_BEHAVIOUR.index("AS behaviour")]
STREAM_SESSION_FACTS = f"{SESSIONS_CTE} SELECT *, {_BEHAVIOUR} AS behaviour FROM ses"
INCIDENTS_CTE = f"""{SQL}, {marked('visits', PROBE)}, h AS (SELECT ip, session_no, path, min(id) AS first_id, count(*) AS hits, min(ts) AS a, max(ts) AS b FROM m GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY ip, session_no ORDER BY first_id) AS rn FROM h),
  sp AS (SELECT ip, session_no, string_agg(path, chr(10) ORDER BY rn) FILTER (WHERE rn <= 2) AS signature, min(a) AS a, max(b) AS b, CAST(sum(hits) AS BIGINT) AS probe_404 FROM k GROUP BY ip, session_no HAVING count(*) >= 2),
  c0 AS (SELECT *, lag(a) OVER (PARTITION BY signature ORDER BY a, ip) AS prev FROM sp),
  ch AS (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR date_sub('second', prev, a) > {7 * 86_400} THEN 1 ELSE 0 END) OVER (PARTITION BY signature ORDER BY a, ip ROWS UNBOUNDED PRECEDING) AS BIGINT) AS incident_no FROM c0),
  inc AS (SELECT signature, incident_no, min(a) AS started, max(b) AS ended, max(a) AS last_started, count(DISTINCT ch.ip) AS addresses, count(DISTINCT nullif(asn, '')) AS asns, CAST(sum(probe_404) AS BIGINT) AS probe_404,
  count(DISTINCT ch.ip) FILTER (WHERE is_hosting) AS hosting, count(DISTINCT ch.ip) FILTER (WHERE dnsbl_listed) AS blocklisted, string_agg(DISTINCT ch.ip, ',' ORDER BY ch.ip) AS members FROM ch LEFT JOIN dim ON dim.ip = ch.ip
  GROUP BY signature, incident_no HAVING count(DISTINCT ch.ip) >= 3), scored AS (SELECT *, 3 * addresses AS score_addresses, 2 * asns AS score_asns, 4 * blocklisted AS score_blocklisted, least(probe_404 // 50, 10) AS score_probes,
  3 * addresses + 2 * asns + 4 * blocklisted + least(probe_404 // 50, 10) AS score, substr(sha256(signature), 1, 16) AS digest, date_sub('second', started, ended) AS duration FROM inc)"""
INCIDENTS = f"{INCIDENTS_CTE} SELECT * REPLACE (CAST(started AS VARCHAR) AS started, CAST(ended AS VARCHAR) AS ended, CAST(last_started AS VARCHAR) AS last_started) FROM scored"
INCIDENT_SESSIONS = f"""{INCIDENTS_CTE} SELECT digest, s.incident_no, CAST(started AS VARCHAR) AS incident_started, ip, session_no, CAST(a AS VARCHAR) AS started, CAST(b AS VARCHAR) AS ended, ch.probe_404
  FROM ch JOIN scored s ON s.signature = ch.signature AND s.incident_no = ch.incident_no"""
INCIDENT_PATHS = f"""{INCIDENTS_CTE} SELECT digest, s.incident_no, m.path, min(m.id) AS first_id, count(*) AS requests, count(DISTINCT m.ip) AS addresses, list_contains(string_split(any_value(s.signature), chr(10)), m.path) AS in_signature
  FROM ch JOIN scored s ON s.signature = ch.signature AND s.incident_no = ch.incident_no JOIN m ON m.ip = ch.ip AND m.session_no = ch.session_no GROUP BY digest, s.incident_no, m.path"""
_HOURS = f"hours AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, count(DISTINCT ip) FILTER (WHERE {PROBE}) AS probes FROM visits WHERE {{where}} GROUP BY 1)"
_TYPICAL = f"""{_HOURS.format(where='true')}, spine AS (SELECT unnest(generate_series((SELECT min(hour) FROM hours), (SELECT max(hour) FROM hours), INTERVAL 1 HOUR)) AS hour),
  typ AS (SELECT count(*) AS hours, median(coalesce(requests, 0)) AS requests, median(coalesce(probes, 0)) AS probing_addresses FROM spine LEFT JOIN hours ON hours.hour = spine.hour)"""
TYPICAL_HOUR = f"{SQL}, {_TYPICAL} SELECT * FROM typ"
INCIDENTS_AGAINST_NORMAL = f"{INCIDENTS_CTE}, {_TYPICAL} SELECT digest, incident_no, addresses, round(addresses / nullif(probing_addresses, 0), 1) AS against_normal FROM scored, typ"
_BASE = f"""{_HOURS.format(where="ts < TIMESTAMP '2024-01-20 12:00:00' AND ts >= TIMESTAMP '2024-01-20 11:00:00' - INTERVAL 28 DAY")},
  hv AS (SELECT date_diff('second', min(ts), TIMESTAMP '2024-01-20 11:00:00') / 86400.0 AS have, CAST(floor(least(date_diff('second', min(ts), TIMESTAMP '2024-01-20 11:00:00') / 86400.0, 28.0) * 24) AS BIGINT) AS slots FROM visits),
  pad AS (SELECT requests, probes FROM hours WHERE hour < TIMESTAMP '2024-01-20 11:00:00' UNION ALL SELECT 0, 0 FROM range((SELECT slots FROM hv) - (SELECT count(*) FROM hours WHERE hour < TIMESTAMP '2024-01-20 11:00:00'))),
  b0 AS (SELECT round(have, 2) AS have_days, coalesce((SELECT requests FROM hours WHERE hour = TIMESTAMP '2024-01-20 11:00:00'), 0) AS requests, coalesce((SELECT probes FROM hours WHERE hour = TIMESTAMP '2024-01-20 11:00:00'), 0) AS probing_addresses,
  (SELECT median(requests) FROM pad) AS typical_requests, (SELECT median(probes) FROM pad) AS typical_probing, have >= 14 AS enough_history FROM hv),
  base AS (SELECT *, round(requests / nullif(typical_requests, 0), 1) AS requests_factor, round(probing_addresses / nullif(typical_probing, 0), 1) AS probing_factor, requests >= 10 AND requests >= 3 * typical_requests AND enough_history AS requests_unusual,
  probing_addresses >= 10 AND probing_addresses >= 3 * typical_probing AND enough_history AS probing_unusual FROM b0)"""
HOURLY_BASELINE = f"{SQL}, {_BASE} SELECT * FROM base"
STREAM_CLASSIFIED = CLASSIFIED
#: Every 40th visit falls into one hour and probes.
STREAM_ALARM = f"""{SQL}, calm AS (SELECT * FROM visits), spiked AS (SELECT * REPLACE (CASE WHEN id % 40 = 0 THEN TIMESTAMP '2024-01-20 11:00:00' + to_seconds(id % 3600) ELSE ts END AS ts,
  CASE WHEN id % 40 = 0 THEN '/.env' ELSE path END AS path, CASE WHEN id % 40 = 0 THEN 404 ELSE status END AS status) FROM calm), {_BASE.replace('FROM visits', 'FROM spiked')} SELECT * FROM base WHERE requests_unusual OR probing_unusual"""

# ---- exposure, hosts, places ------------------------------------------------------------------------


def served(where: str, benign: int = 2) -> str:
    return f"""ok AS (SELECT visits.* EXCLUDE (path), path AS spelling, {CANONICAL} AS path FROM visits WHERE status BETWEEN 200 AND 299), ben AS (SELECT path, count(DISTINCT ip) AS n FROM ok WHERE ip IN (SELECT ip FROM dim WHERE {BENIGN}) GROUP BY path),
  sv0 AS (SELECT path, count(DISTINCT ip) AS ips, count(*) AS hits, CAST(min(ts) AS VARCHAR) AS first_seen, CAST(max(ts) AS VARCHAR) AS last_seen, max(bytes_sent) AS bytes_sent, count(DISTINCT spelling) AS spellings, min(spelling) AS first_spelling, max(spelling) AS last_spelling
  FROM ok WHERE NOT contains(spelling, '?') AND {where} GROUP BY path), sv1 AS (SELECT sv0.*, coalesce(ben.n, 0) AS benign_ips, {like_any('sv0.path', N.CONVENTIONS)} AS is_site FROM sv0 LEFT JOIN ben ON ben.path = sv0.path),
  served AS (SELECT *, NOT is_site AND benign_ips < {benign} AS is_finding FROM sv1)"""


SERVED_PATHS = f"{SQL}, {served(WINDOW)} SELECT * FROM served"
EXPOSURES = f"{SQL}, {served('true', 60)} SELECT * FROM served WHERE is_finding"
EXPOSURE_DETAIL = f"""{SQL}, {served('true', 60)}, al AS (SELECT j.*, {CANONICAL} AS c FROM j), r AS (SELECT * FROM al WHERE c IN (SELECT path FROM served WHERE is_finding)), h AS (SELECT * FROM r WHERE status BETWEEN 200 AND 299),
  f AS (SELECT DISTINCT c, ip FROM h), cx AS (SELECT f.c, al.c AS other FROM al JOIN f ON f.ip = al.ip AND al.c <> f.c)
  SELECT c AS path, 'answers' AS section, status || ':' || server_port AS key, count(*) AS value FROM r GROUP BY ALL UNION ALL SELECT c, 'classes', coalesce(nullif(visitor_class, ''), 'unknown') AS k, count(DISTINCT ip) FROM h GROUP BY c, k
  {' '.join(f"UNION ALL SELECT c, '{name}', coalesce({column}, '') AS k, count(DISTINCT ip) FROM h GROUP BY c, k" for name, column in (('clients', 'browser'), ('countries', 'country'), ('networks', 'asn'), ('organisations', 'org')))}
  {' '.join(f"UNION ALL SELECT c, 'signals', '{x}', count(DISTINCT ip) FROM h WHERE {x} GROUP BY c" for x in ('is_tor', 'is_proxy', 'is_hosting', 'dnsbl_listed', 'has_tags'))}
  UNION ALL SELECT c, 'methods', method || ' ' || coalesce(user_agent, ''), count(*) FROM r GROUP BY ALL UNION ALL SELECT c, 'seen', CAST(min(ts) AS VARCHAR) || ' to ' || CAST(max(ts) AS VARCHAR), count(*) FROM h GROUP BY c
  {' '.join(f"UNION ALL SELECT c, 'totals', '{name}', CAST({value} AS BIGINT) FROM h GROUP BY c" for name, value in (('bytes', 'sum(bytes_sent)'), ('smallest', 'min(bytes_sent)'), ('largest', 'max(bytes_sent)'), ('addresses', 'count(DISTINCT ip)')))}
  UNION ALL SELECT c, 'refused', 'last ' || CAST(max(ts) AS VARCHAR), count(*) FROM r WHERE status = 404 GROUP BY c
  UNION ALL SELECT c, 'context', 'paths', count(DISTINCT other) FROM cx GROUP BY c UNION ALL SELECT c, 'context', 'hits', count(*) FROM cx GROUP BY c"""
PROBE_ECHO = f"""{SQL}, p AS (SELECT path, count(DISTINCT v.ip) AS ips, count(DISTINCT v.ip) FILTER (WHERE {BENIGN}) AS b FROM visits v LEFT JOIN dim ON dim.ip = v.ip WHERE status BETWEEN 200 AND 299 AND contains(path, '?') GROUP BY path)
  SELECT count(*) AS urls, coalesce(CAST(sum(ips) AS BIGINT), 0) AS addresses FROM p WHERE b = 0"""


def family_of(names: list[str], starts: list[str], endings: list[str], folders: list[str]) -> str:
    parts, own = "string_split(lower(path), '/')", "regexp_extract(lower(path), '[^/]*$')"
    tests = [f"{own} = '{x}'" for x in names] + [f"list_contains({parts}, '{x}')" for x in folders]
    return " OR ".join(tests + [f"starts_with({own}, '{x}')" for x in starts] + [f"ends_with({own}, '{x}')" for x in endings])


EXPOSURE_FAMILIES = f"""{SQL}, {served('true')} SELECT CASE {' '.join(f"WHEN {family_of(*f)} THEN '{k}'" for k, *f in N.FAMILIES)} ELSE '? ' || path END AS family, count(*) AS paths, max(ips) AS most_ips, CAST(sum(hits) AS BIGINT) AS hits, min(path) AS first_path, max(path) AS last_path FROM served GROUP BY 1"""
KINDS = ["port", "vuln", "tag", "cpe", "hostname"]
HOST_TABLE = f"""{SQL}, w AS (SELECT ip FROM vals WHERE kind = 'port' AND value = '443' INTERSECT SELECT ip FROM vals WHERE kind = 'tag' AND value = 'scanner')
  SELECT s.*, country_code, org, visitor_class, (SELECT count(*) FROM visits v WHERE v.ip = s.ip) AS visits FROM (SELECT ip, {', '.join(f"coalesce(string_agg(DISTINCT value, ',' ORDER BY value) FILTER (WHERE kind = '{k}'), '') AS {k}s" for k in KINDS)} FROM vals WHERE ip IN (SELECT ip FROM w) GROUP BY ip) s LEFT JOIN dim ON dim.ip = s.ip"""
HOST_FACETS = f"{SQL}, c AS (SELECT kind, value, count(DISTINCT ip) AS hosts FROM vals WHERE kind IN ('port', 'vuln', 'tag') GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY hosts DESC, value) AS INT) AS nth FROM c QUALIFY nth <= 10"
SOFTWARE_INVENTORY = f"""{SQL} SELECT CASE WHEN split_part(value, ':', 2) = '/o' THEN 'os' ELSE 'application' END AS part, array_to_string(list_transform(string_split(replace(split_part(value, ':', 4), '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS product,
  count(DISTINCT ip) AS hosts FROM vals WHERE kind = 'cpe' GROUP BY ALL"""
MARKERS = f"""{SQL}, mk AS (SELECT ip, max(lat) AS lat, max(lon) AS lon, max(country_code) AS country_code, max(city) AS city, max(grp) AS grp, count(*) AS visits, {', '.join(f'bool_or({s}) AS {s}' for s in N.SIGNALS)} FROM j WHERE lat IS NOT NULL AND lon IS NOT NULL AND (lat <> 0 OR lon <> 0) GROUP BY ip)"""
GEO_MARKERS = f"{MARKERS} SELECT * FROM mk"
GEO_STATS = f"{MARKERS} SELECT count(*) AS ips, count(DISTINCT country_code) AS countries, {', '.join(f'{n_if(s)} AS {s}' for s in N.SIGNALS)}, {GROUP_COUNTS}, (SELECT count(DISTINCT ip) FROM visits WHERE ip NOT IN (SELECT ip FROM mk)) AS unmapped FROM mk"
GEO_GRID = f"""{MARKERS}, c AS (SELECT floor(lat / 10) * 10 AS la, floor(lon / 10) * 10 AS lo, count(*) AS ips, CAST(sum(visits) AS BIGINT) AS visits, {GROUP_COUNTS} FROM mk GROUP BY ALL)
  SELECT la AS lat, lo AS lon, c.* EXCLUDE (la, lo), CASE {' '.join(f"WHEN {g} = greatest({', '.join(N.GROUPS)}) THEN '{g}'" for g in N.GROUPS)} END AS dominant, round(least(1.0, ln(ips + 1) / ln((SELECT max(ips) FROM c) + 1)), 4) AS weight FROM c"""
_LEVELS = [(0, 20.0), (2, 20.0), (3, 10.0), (5, 2.5), (12, 0.05)]
_CELLS = " UNION ALL ".join(f"SELECT {z} AS zoom, CAST({size} AS DOUBLE) AS size, CAST(floor(lat / CAST({size} AS DOUBLE)) AS BIGINT) * CAST({size} AS DOUBLE) AS lat, CAST(floor(lon / CAST({size} AS DOUBLE)) AS BIGINT) * CAST({size} AS DOUBLE) AS lon, count(*) AS ips, CAST(sum(visits) AS BIGINT) AS visits, {GROUP_COUNTS} FROM mk GROUP BY ALL" for z, size in _LEVELS)
GEO_PYRAMID = f"""{MARKERS}, c AS ({_CELLS})
  SELECT c.*, CASE {' '.join(f"WHEN {g} = greatest({', '.join(N.GROUPS)}) THEN '{g}'" for g in N.GROUPS)} END AS dominant, round(least(1.0, ln(ips + 1) / ln(max(ips) OVER (PARTITION BY zoom) + 1)), 4) AS weight FROM c"""
GEO_SELECTION = f"{MARKERS} SELECT country_code, grp, count(*) AS ips FROM mk WHERE lat BETWEEN -40 AND 50 AND lon BETWEEN -90 AND 120 GROUP BY ALL"
_DECIDED = f"""{SQL}, d0 AS (SELECT ip, count(*) AS requests, {n_if(PROBE)} AS probes, CAST(min(ts) AS VARCHAR) AS first_seen, CAST(max(ts) AS VARCHAR) AS last_seen FROM visits WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY ip),
  dec AS (SELECT d0.*, visitor_class, asn, country_code, is_tor, is_proxy, is_hosting, dnsbl_listed FROM d0 JOIN dim ON dim.ip = d0.ip WHERE grp = 'threats')"""
DECISIONS = f"{_DECIDED} SELECT *, (SELECT count(*) > 5000 FROM dec) AS truncated FROM dec ORDER BY probes DESC, requests DESC, ip LIMIT 5000"
DECISION_TEXT = f"{_DECIDED} SELECT ip || ' # ' || visitor_class || ', ' || requests || ' requests, ' || probes || ' probes' AS value FROM dec ORDER BY probes DESC, requests DESC, ip LIMIT 5000"
ATTENTION = f"""{SQL}, v AS (SELECT * FROM visits WHERE ts <= TIMESTAMP '2024-01-20 12:30:00'), td AS (SELECT CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'today' ELSE {day()} END AS d, count(*) AS n FROM v WHERE ts >= TIMESTAMP '2024-01-13 12:30:00' AND ip IN (SELECT ip FROM dim WHERE is_tor) GROUP BY 1),
  ty AS (SELECT median(coalesce(n, 0)) AS t FROM range(7) r(i) LEFT JOIN (SELECT n, row_number() OVER (ORDER BY n DESC) - 1 AS i FROM td WHERE d <> 'today') x ON x.i = r.i)
  (SELECT 'Rate limit' AS tag, ip AS subject, CAST(count(*) AS DOUBLE) AS value FROM v WHERE {LIMITED} AND ts >= TIMESTAMP '2024-01-20 06:30:00' GROUP BY ip ORDER BY count(*) DESC, ip LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'New', 'threat addresses first seen today', CAST(count(*) AS DOUBLE) AS n FROM (SELECT ip FROM v WHERE ip IN (SELECT ip FROM dim WHERE grp = 'threats') GROUP BY ip HAVING min(ts) >= TIMESTAMP '2024-01-20')) WHERE n > 0
  UNION ALL (SELECT 'CVE', value, CAST(count(DISTINCT ip) AS DOUBLE) FROM vals WHERE kind = 'vuln' GROUP BY value ORDER BY count(DISTINCT ip) DESC, value LIMIT 1)
  UNION ALL SELECT 'Tor', 'requests today', CAST(n AS DOUBLE) FROM td, ty WHERE d = 'today' AND t > 0 AND n >= 2 * t
  UNION ALL (SELECT 'Probe', path, CAST(count(DISTINCT ip) AS DOUBLE) FROM v WHERE ts >= TIMESTAMP '2024-01-19 12:30:00' AND {like_any('path', N.SCANNER_PATHS)} GROUP BY path ORDER BY count(DISTINCT ip) DESC, count(*) DESC, path LIMIT 1)"""
MONTHLY_REPORT = f"""{INCIDENTS_CTE}, {served('true')}, t AS ({totals('true')}), mx AS (SELECT grp, count(DISTINCT ip) AS n FROM j GROUP BY grp), al AS (SELECT count(DISTINCT ip) AS n FROM j), gs AS (SELECT unnest({[*N.GROUPS]}) AS grp)
  SELECT 'totals' AS section, key, value FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM t) ON COLUMNS(*) INTO NAME key VALUE value) UNION ALL SELECT 'delta', 'visits', NULL UNION ALL SELECT 'delta', 'unique_ips', NULL
  UNION ALL SELECT 'incidents', 'incidents', (SELECT CAST(count(*) AS DOUBLE) FROM scored) UNION ALL SELECT 'incidents', 'programs', (SELECT CAST(count(DISTINCT digest) AS DOUBLE) FROM scored)
  UNION ALL SELECT 'findings', 'findings', (SELECT CAST(count(*) AS DOUBLE) FROM served WHERE is_finding) UNION ALL SELECT 'findings', 'new_findings', (SELECT CAST(count(*) AS DOUBLE) FROM served WHERE is_finding AND first_seen >= '2024-01-01')
  UNION ALL SELECT 'share', gs.grp, round(100.0 * coalesce(mx.n, 0) / al.n, 1) FROM gs LEFT JOIN mx ON mx.grp = gs.grp, al UNION ALL SELECT 'share_delta', grp, NULL FROM gs
  UNION ALL (SELECT 'incident_score', digest || '/' || incident_no, CAST(score AS DOUBLE) FROM scored ORDER BY score DESC, started, digest LIMIT 5)"""

# ---- storage and merges -------------------------------------------------------------------------------

MONTH_INVENTORY = f"{SQL} SELECT strftime(ts, '%Y-%m') AS month, count(*) AS visits, count(DISTINCT ip) AS unique_ips FROM visits GROUP BY 1"
EARLIEST_DAY = f"{SQL} SELECT strftime(min(ts), '%Y-%m-%d') AS day FROM visits"
RETENTION_PLAN = f"""{SQL} SELECT '2023-' || lpad(CAST(id % 12 + 1 AS VARCHAR), 2, '0') AS month, count(*) AS visits, CASE WHEN month = '2023-03' THEN 'keep' WHEN month < '2023-03' THEN 'expire' WHEN month < '2023-09' THEN 'archive' ELSE 'keep' END AS action FROM visits GROUP BY month"""
EXPORT_PAGE = f"""{SQL} SELECT id, ip, path, CASE WHEN regexp_matches(r, '^[=+\\-@]') THEN '''' || r ELSE r END AS referer FROM (SELECT *, CASE WHEN id % 3 = 0 THEN '=1+' ELSE '' END || referer AS r FROM visits WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12')"""
RESTORED_VISITS = f"{SQL} SELECT ip, count(*) AS visits FROM visits WHERE id % 3 <> 0 OR strftime(ts, '%Y-%m') = '2024-01' GROUP BY ip"
MONTH_CYCLE = f"""{SQL}, mv AS (SELECT ip, strftime(CASE WHEN id % 3 = 0 THEN ts - INTERVAL 31 DAY ELSE ts END, '%Y-%m') AS month FROM visits), steps(step, gone) AS (VALUES ('stored', ''), ('archived', '2023-12'), ('restored', ''), ('released', '2023-12'), ('deleted', '2024-01')),
  left_ AS (SELECT step, mv.* FROM mv JOIN steps ON month <> gone),
  -- with the first archive, addresses of that month alone are forgotten, and they return with it; addresses without any visit are forgotten for good
  k AS (SELECT step, count(DISTINCT intel.ip) AS known FROM left_ JOIN intel ON intel.ip = left_.ip WHERE step <> 'stored' GROUP BY step UNION ALL SELECT 'stored', count(*) FROM intel)
  SELECT left_.step, month, count(*) AS visits, count(DISTINCT ip) AS addresses, known FROM left_ JOIN k ON k.step = left_.step GROUP BY left_.step, month, known"""
PURGED_INTEL = f"{SQL} SELECT ip, country_code FROM intel WHERE ip IN (SELECT ip FROM visits)"
DEDUPE_VISITS = f"""{SQL}, k AS (SELECT *, CASE WHEN connection > 0 THEN {day()} || '|' || connection || '|' || connection_requests ELSE 'id' || id END AS identity FROM visits)
  SELECT ip, count(DISTINCT identity) AS visits, count(DISTINCT identity) AS identities FROM k WHERE identity NOT IN (SELECT identity FROM k WHERE ts < TIMESTAMP '2024-01-05') GROUP BY ip"""
SKIP_REASONS = f"""{SQL} SELECT CASE WHEN id % 10 = 1 THEN 'invalid-ip' WHEN id % 10 IN (0, 2) THEN 'internal-ip' WHEN id % 7 = 0 OR (id % 7 <> 1 AND regexp_matches(lower({PAGE}), '\\.(css|js|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|eot)$')) THEN 'static-asset' WHEN id % 11 = 0 THEN 'health-check' END AS skip_reason, count(*) AS n FROM visits GROUP BY 1"""
INGEST_QUALITY = f"""{SQL}, q AS (SELECT count(*) AS lines, {n_if('id % 20 = 0')} AS unparseable, {n_if('id % 20 <> 0 AND id % 13 = 0')} AS invalid, {n_if('id % 20 <> 0 AND id % 9 = 0')} AS non_utc FROM visits)
  SELECT *, {', '.join(f'coalesce(round({c} / nullif(lines, 0), 4), 0.0) AS {c}_share, coalesce(round({c} / nullif(lines, 0), 4), 0.0) >= 0.5 AS {c}_flagged' for c in ('unparseable', 'invalid', 'non_utc'))} FROM q"""
INGESTED_VISITS = f"""{SQL} SELECT ip, CASE WHEN method = '' THEN 'GET' ELSE method END AS method, status, count(*) AS visits, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent FROM visits
  WHERE id % 20 <> 0 AND id % 13 <> 0 AND NOT regexp_matches(lower({PAGE}), '\\.(css|js|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|eot)$') GROUP BY ALL"""
CLIENT_ENRICHMENT = f"""{SQL} SELECT user_agent, CASE user_id WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Bot' WHEN 2 THEN 'curl' WHEN 3 THEN 'No User-Agent' WHEN 4 THEN 'Safari' WHEN 5 THEN 'Unknown' WHEN 6 THEN 'Bot' WHEN 7 THEN 'Firefox' WHEN 10 THEN 'Unknown' WHEN 11 THEN 'Unknown' ELSE 'Bot' END AS browser,
  CASE user_id WHEN 0 THEN 'Windows' WHEN 3 THEN 'No User-Agent' WHEN 4 THEN 'macOS' WHEN 7 THEN 'Linux' ELSE 'Unknown' END AS os, CASE user_id WHEN 1 THEN 'Bot' WHEN 6 THEN 'Bot' WHEN 2 THEN 'Tool' WHEN 3 THEN 'Unknown' WHEN 0 THEN 'Desktop' WHEN 4 THEN 'Desktop' WHEN 5 THEN 'Desktop' WHEN 7 THEN 'Desktop' WHEN 10 THEN 'Desktop' WHEN 11 THEN 'Desktop' ELSE 'Bot' END AS device, visits
  FROM (SELECT user_agent, any_value(k) AS user_id, count(*) AS visits FROM (SELECT v.user_agent, e.user_id % 13 AS k FROM visits v JOIN events e ON e.event_id = v.id) GROUP BY user_agent)"""
INTEL_UPSERT = f"""{SQL}, a AS (SELECT ip, CASE WHEN is_tor THEN NULL ELSE lower(country) END AS country, 'new org' AS org FROM intel WHERE is_proxy UNION ALL SELECT DISTINCT ip, 'somewhere', NULL FROM visits WHERE ip NOT IN (SELECT ip FROM intel))
  SELECT coalesce(i.ip, a.ip) AS ip, coalesce(a.country, i.country, '') AS country, coalesce(a.org, i.org, '') AS org, coalesce(i.city, '') AS city, CAST(CASE WHEN a.ip IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE i.fetched_at END AS VARCHAR) AS fetched_at FROM intel i FULL JOIN a ON a.ip = i.ip"""
CHILD_REPLACE = f"""{SQL}, a AS (SELECT DISTINCT ip FROM vals WHERE kind = 'port' AND ip LIKE '%.1') SELECT ip, kind, value FROM vals WHERE NOT (kind = 'port' AND ip IN (SELECT ip FROM a)) UNION ALL SELECT ip, 'port', '9999' FROM a WHERE ip LIKE '198.18.1%'"""
NORMAL_VALUES = f"{SQL} SELECT DISTINCT ip, 'port' AS kind, unnest(['22', CAST(length(org) AS VARCHAR), '443']) AS value FROM intel"
_CANDIDATES = f"{SQL}, c AS (SELECT DISTINCT ip, 0 AS priority FROM visits WHERE ip NOT IN (SELECT ip FROM intel) UNION ALL SELECT ip, 1 FROM intel WHERE fetched_at < TIMESTAMP '2024-01-12')"
ENRICH_CANDIDATES = f"{_CANDIDATES} SELECT ip, priority FROM c"
ENRICH_BACKLOG = f"{_CANDIDATES} SELECT {n_if('priority = 0')} AS never, {n_if('priority = 1')} AS stale FROM c"
DNSBL_VERDICT = f"""{SQL}, a AS (SELECT ip, p AS provider, CASE WHEN p = 'b' AND is_tor THEN '127.0.0.4' WHEN length(org) % 4 = 0 THEN '127.255.255.254' WHEN dnsbl_listed THEN '127.0.0.2' WHEN is_mobile THEN NULL ELSE '' END AS answer FROM intel, (VALUES ('a'), ('b')) t(p))
  SELECT ip, CASE WHEN bool_or(coalesce(answer LIKE '127.0%', false)) THEN true WHEN bool_or(coalesce(answer = '', false)) THEN false END AS dnsbl_listed, coalesce(string_agg(DISTINCT provider, ',' ORDER BY provider) FILTER (WHERE answer LIKE '127.0%'), '') AS dnsbl_sources FROM a GROUP BY ip"""
FCRDNS = f"{SQL} SELECT ip, reverse_dns AS name FROM intel WHERE reverse_dns <> '' AND NOT is_proxy"
GEO_ANSWERS = f"{SQL} SELECT ip, country, CASE WHEN is_mobile THEN 'fail' ELSE 'success' END AS status, is_mobile AS failed FROM intel WHERE ip IN (SELECT ip FROM visits)"
TOR_FLAGS = f"{SQL} SELECT ip, is_hosting AS is_tor FROM intel"
REOPENED_NAMES = f"{SQL} SELECT ip, CASE WHEN rdns_checked_at IS NULL AND ip IN (SELECT ip FROM vals WHERE kind = 'hostname') THEN '' ELSE reverse_dns END AS reverse_dns FROM intel"
UNCHECKED_NAMES = f"{SQL} SELECT ip FROM intel WHERE rdns_checked_at IS NULL ORDER BY ip LIMIT 50"
BULK_LOOKUP = f"{SQL} SELECT v.ip, country_code, asn FROM (SELECT DISTINCT ip FROM visits) v LEFT JOIN intel i ON i.ip = v.ip"
FAILED_ENRICHMENT = f"""{SQL}, f AS (SELECT DISTINCT ip FROM visits WHERE status = 404) SELECT coalesce(i.ip, f.ip) AS ip, coalesce(i.country, '') AS country, CAST(CASE WHEN f.ip IS NOT NULL THEN TIMESTAMP '2024-03-01' ELSE fetched_at END AS VARCHAR) AS fetched_at FROM intel i FULL JOIN f ON f.ip = i.ip"""

# ---- streams: what the stream over all rows must come to ------------------------------------------------

STREAM_HOURLY = f"{SQL} SELECT strftime(ts, '%Y-%m-%d %H:00') AS bucket, {GROUP_COUNTS}, count(*) AS total FROM j GROUP BY 1"
STREAM_SESSIONS = f"{SQL}, {marked('visits')} SELECT ip, CAST(min(ts) AS VARCHAR) AS started, CAST(max(ts) AS VARCHAR) AS ended, count(*) AS requests, {n_if(PROBE)} AS probe_404, {n_if('status BETWEEN 200 AND 299')} AS ok_requests FROM m GROUP BY ip, session_no"
STREAM_STORE_ONCE = INGESTED_VISITS
STREAM_INGEST = INGESTED_VISITS.replace("SELECT ip, CASE", "SELECT ip, CASE", 1)
STREAM_NEWCOMERS = f"{SQL} SELECT ip, CAST(min(ts) AS VARCHAR) AS first_seen FROM visits WHERE ip NOT IN (SELECT ip FROM visits WHERE ts < TIMESTAMP '2024-01-02') GROUP BY ip"
