"""Every field of the search, and how terms combine."""

import pytest
from pyspark.sql import functions as F

from tests.test_operators import dimension, intel, values, visits
from visitlens.operators.search import ALIASES, REGISTRY, Term, UnknownTerm, find_visitors, search_rows, search_visitors, signal_of


@pytest.fixture(scope="module")
def tables(spark):
    v = visits(spark, [
        {"ip": "198.51.100.1", "path": "/.env", "status": 404, "method": "POST", "user_agent": "Wget/1.2", "browser": "Wget", "device": "Tool", "referer": "https://Google.example/", "http_version": "HTTP/2.0", "server_port": 80},
        {"ip": "198.51.100.1", "path": "/a", "status": 200},
        {"ip": "198.51.100.2", "path": "/100%_x", "status": 503, "device": "Bot"},
        {"ip": "203.0.113.9", "path": "/", "status": 302},
    ]).withColumn("os", F.when(F.col("browser") == "Wget", "Linux").otherwise(""))
    i = intel(spark, [
        {"ip": "198.51.100.1", "country": "Germany", "country_code": "DE", "city": "Berlin", "asn": "AS24940", "org": "Hetzner", "isp": "DataCamp", "reverse_dns": "crawl.example", "visitor_class": "threats/exploit-probers", "is_tor": True},
        {"ip": "198.51.100.2", "country": "Denmark", "country_code": "DK", "visitor_class": "", "is_mobile": True},
    ])
    c = values(spark, [("198.51.100.1", "port", "22"), ("198.51.100.1", "tag", "scanner"), ("198.51.100.2", "vuln", "CVE-2021-41773"), ("198.51.100.2", "port", "2222")])
    return v, dimension(i, c), c


ONE, TWO, NINE = "198.51.100.1", "198.51.100.2", "203.0.113.9"
CASES = [
    ("ip", "198.51.100.", {ONE, TWO}), ("ip", "51.100", set()), ("country", "de", {ONE}), ("country", "EN", set()), ("country", "den", {TWO}), ("country", "German", {ONE}), ("city", "berl", {ONE}), ("asn", "as2494", {ONE}), ("org", "HETZ", {ONE}), ("isp", "camp", {ONE}), ("rdns", "crawl", {ONE}),
    ("path", ".ENV", {ONE}), ("path", "%_", {TWO}), ("path", "0_", set()), ("ua", "wget", {ONE}), ("browser", "wge", {ONE}), ("os", "linux", {ONE}), ("device", "tool", {ONE}), ("device", "too", set()), ("referer", "google", {ONE}), ("class", "threats", {ONE}), ("class", "threats/exploit-probers", {ONE}),
    ("class", "bots", set()), ("class", "unknown", {TWO, NINE}), ("signal", "tor", {ONE}), ("signal", "is_tor", {ONE}), ("signal", "has_tags", {ONE}), ("signal", "tags", {ONE}), ("signal", "mobile", {TWO}), ("tag", "Scanner", {ONE}), ("tag", "scan", set()), ("vuln", "cve-2021", {TWO}), ("port", "22", {ONE}), ("port", "x", set()),
    ("serverport", "80", {ONE}), ("status", "404", {ONE}), ("status", "4XX", {ONE}), ("status", "5xx", {TWO}), ("status", "2xx", {ONE}), ("method", "post", {ONE}), ("http", "2", {ONE}), (None, "german", {ONE}), (None, "hetzner", {ONE}), (None, "wget", {ONE}), (None, "198.51", {ONE, TWO}), (None, "post", set()),
]


@pytest.mark.parametrize(("field", "value", "want"), CASES)
def test_fields(tables, field, value, want):
    assert {r.ip for r in find_visitors(*tables, Term(value, field)).collect()} == want


def test_every_field_has_a_case():
    assert {f for f, *_ in CASES if f} == set(REGISTRY) and set(ALIASES.values()) <= set(REGISTRY)


def test_terms_meet_in_different_requests_and_keep_aggregates_whole(tables):
    both = (Term("/.env", "path"), Term("200", "status"))
    assert {r.ip for r in find_visitors(*tables, *both).collect()} == {ONE}
    assert search_visitors(*tables, *both).count() == 2
    v, dim, c = tables
    rows = v.join(dim, "ip", "left")
    assert search_rows(rows, c, "paths", *both).count() == 0
    assert [r.path for r in search_rows(rows, c, "paths", Term("wget"), Term("22", "port")).collect()] == ["/.env"]
    assert search_rows(rows, c, "networks", Term("wget")).count() == 0
    assert search_rows(rows, c, "paths", Term("22", "port"), Term("scanner", "tag")).count() == 2


def test_requests_are_grouped_once_for_all_terms(tables):
    terms = (Term("/", "path"), Term("2xx", "status"), Term("linux"), Term("post", "method"), Term("22", "port"), Term("tor", "signal"))
    plan = find_visitors(*tables, *terms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bit_or") <= 4 and plan.count("Aggregate [ip") <= 3


def test_unknown_names_are_refused(tables):
    for term in (Term("x", "nope"), Term("tornado", "signal"), Term("robots", "class")):
        with pytest.raises(UnknownTerm):
            find_visitors(*tables, term)
    with pytest.raises(ValueError):
        find_visitors(*tables, *[Term("x")] * 9)
    assert signal_of("dnsbl") == signal_of("dnsbl_listed") == "dnsbl_listed"
