"""Addresses as expressions, against the standard library."""

import ipaddress
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from visitlens.functions import columns as C
from visitlens.functions import needles as N
from visitlens.plans import catalogue
from visitlens.plans.fixture import tables
from visitlens.sources import logs

FIXED = [
    "::", "::1", "1::", "2001:db8::", "2001:db8:0:1::", "0:0:0:1:0:0:0:0", "1:0:0:0:1:0:0:0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4",
    "::1.2.3", "::1.2.3.256", "::01.2.3.4", "::1.2.3.4.5", "1.2.3.4::", "1::2::3", ":::", ":", "1:", ":1", "12345::", "g::", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "::1/64", "FC00::1", "fdff::", "fe7f::1", "febf:ffff::1", "fec0::", "::2", "0::1", "0000:0000:0000:0000:0000:0000:0000:0001", "", "1.2.3.4", "a:b", " ::1", "::1 ", "ABCD:EF01:2345:6789:abcd:ef01:2345:6789", "ffff:ffff:ffff:ffff::", "8000::",
]
NETS = [ipaddress.ip_network(n) for n in N.INTERNAL_V6]


def want(text):
    try:
        a = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    n = int(a)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    plain = ipaddress.IPv6Address(n)
    return str(ipaddress.ip_network((n, 64), strict=False)), any(plain in net for net in NETS), signed(n >> 64), signed(n & (2**64 - 1))


def got(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    rows = df.select("ip", C.v6_facts("ip").alias("f"), C.v6_numbers(df.ip).alias("n")).collect()
    return {r.ip: (r.f.network, r.f.internal, r.n.high, r.n.low) if r.f.network is not None else None for r in rows}


def test_fixed_addresses(spark):
    assert got(spark, FIXED) == {t: want(t) for t in FIXED}


def test_random_addresses(spark):
    r = random.Random(5)
    texts = set()
    for _ in range(1500):
        groups = [r.choice(["0", "0000", "1", "ff", "DB8", "%x" % r.randrange(65536), "fe80", "fc00"]) for _ in range(r.choice([8, 8, 8, 7, 9, 4]))]
        text = ":".join(groups)
        if r.random() < 0.6:
            i = r.randrange(len(text) + 1)
            text = text[:i] + "::" + text[r.randrange(i, len(text) + 1) :]
        if r.random() < 0.2:
            text += r.choice([":1.2.3.4", ".1", "%z", ":", ":0.0.0.0"])
        texts.add(text)
    assert got(spark, sorted(texts)) == {t: want(t) for t in texts}


def test_hypothesis_addresses(spark):
    seen = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.one_of(st.ip_addresses(v=6).map(str), st.ip_addresses(v=6).map(lambda a: a.exploded), st.text("0123456789abcdefABCDEF:.%", max_size=40)))
    def collect(text):
        seen.append(text)

    collect()
    assert got(spark, sorted(set(seen))) == {t: want(t) for t in seen}


def test_no_python_in_the_ingest_plan(spark):
    lines = spark.createDataFrame([("{}",)], "value string")
    plan = logs.to_visits(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_facts_of_lines_are_those_of_the_standard_library(spark):
    r = random.Random(6)
    texts = {*FIXED, "10.1.2.3", "172.32.0.1", "192.168.0.1", "256.1.1.1", "1.2.3", "01.2.3.4", "x", "0:0:0:0:0:0:0:1", "::0001", "fe80::", "FDAB::2", "fbff::", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "fc00::g"}
    for _ in range(1500):
        groups = [r.choice(["0", "0000", "1", "DB8", "%x" % r.randrange(65536), "fe80", "fcff", "12345"]) for _ in range(r.choice([8, 7, 9, 4, 1]))]
        text = ":".join(groups)
        i = r.randrange(len(text) + 1)
        texts.add(r.choice([text, text[:i] + "::" + text[r.randrange(i, len(text) + 1) :], "::" + text, text + "::", text + ":1.2.3.4", text + "%z"]))

    def facts(text):
        if ":" in text:
            return (True, want(text)[1]) if want(text) else (False, False)
        try:
            a = ipaddress.IPv4Address(text.replace("01.", "1."))  # zeros in front are let pass
        except ValueError:
            return False, False
        return True, any(a in ipaddress.ip_network(n) for n in N.INTERNAL_V4)

    rows = logs.with_address_facts(spark.createDataFrame([(t,) for t in sorted(texts)], "remote_addr string")).collect()
    assert {r.remote_addr: (r.is_address, r.is_internal) for r in rows} == {t: facts(t) for t in texts}


def test_filters_do_not_repeat_what_is_worked_out(spark):
    """One look at each address and each line of text, whatever is filtered above them."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        visits = plan(logs.to_visits(spark.createDataFrame([("{}",)], "value string")))
        lines = plan(catalogue.log_lines(tables(spark, "/root/testdata/sf0.001")).filter("value like '%a%' and value not like '%b%'"))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert visits.count("from_json") == 1 and visits.count("{3}") == 1 and visits.count("HTTP/") == 2
    assert lines.count("StructsToJsonEvaluator") == 1
