"""What must spread over tasks, read little, or survive a replay."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.test_operators import dimension, intel, values, visits
from visitlens.functions import columns as C
from visitlens.operators import baseline, classify, pages, sessions
from visitlens.streaming.state import EvidenceState, HourlyRollup


def timed(spark, n, seed=1, addresses=("a",), longest=4000):
    r = random.Random(seed)
    at, out = 0, []
    for i in range(n):
        at += r.choice([0, 1, 30, 1800, 1801, longest])
        out.append((i, r.choice(addresses), at))
    return spark.createDataFrame(out, "id long, ip string, at long").withColumn("ts", F.timestamp_seconds("at").cast("timestamp_ntz")).drop("at").repartition(3)


@pytest.mark.parametrize("block", [1, 600, 3600, 10**7])
def test_segmented_sessions_equal_one_window(spark, block):
    rows = timed(spark, 700, addresses=("a", "b", "c")).union(spark.createDataFrame([(5000 + i, ip, None) for i, ip in enumerate("abb")], "id long, ip string, ts timestamp_ntz"))
    w = Window.partitionBy("ip").orderBy("ts", "id")
    apart = F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts"))
    plain = rows.withColumn("n", C.flag(apart.isNull() | (apart > 1800))).withColumn("session_no", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    key = lambda df: sorted((r.id, r.session_no) for r in df.collect())
    assert key(sessions.sessionize(rows, 1800, block)) == key(plain)


def test_one_address_and_one_signature_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = timed(spark, 4000)
        found = sessions.sessionize(rows, 1800, 3600).groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(found) > 1 and max(r["count"] for r in found) < 0.6 * 4000
        spans = rows.select(F.lit("s").alias("signature"), "ip", F.col("ts").alias("started"))
        found = sessions.chained(spans, 3600, 3600).groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(found) > 1 and max(r["count"] for r in found) < 0.6 * 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def requests(spark):
    paths = ["/", "/.env", "/a", "/b?x=1", "/robots.txt", "/login"]
    agents = ["curl/8", "Mozilla/5.0 Googlebot", "Screaming", "Frog", "zgrab", ""]
    rows = [{"ip": f"198.51.100.{i % 5}", "at": 60 * i, "path": paths[i * i % 6], "status": [200, 404, 301][i % 3], "user_agent": agents[i % 6]} for i in range(120)]
    return visits(spark, rows).withColumn("id", F.col("id").cast("long"))


def test_evidence_from_batches_equals_evidence_of_all(spark, tmp_path):
    v, dim = requests(spark).cache(), dimension(intel(spark, [{"ip": "198.51.100.1", "is_hosting": True}]), values(spark))
    state = EvidenceState(spark, str(tmp_path / "state"), "example.org", ("/a",), buckets=8)
    part = lambda i: v.filter(F.col("id") % 4 == i)
    state.add(part(0), 0)
    state.add(part(1), 1)
    state.add(part(1), 1)  # the batch ran again
    state.compact(1)
    state.add(part(1), 1)  # and again, after it was folded
    state.add(part(2), 2)
    state.compact(2)
    state.add(part(3), 3)
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    want = classify.evidence(v, dim, "example.org", ("/a",))
    assert rows(state.evidence(v, dim)) == rows(want)
    one = v.filter("ip = '198.51.100.1'")
    assert rows(state.evidence(one, dim)) == rows(want.filter("ip = '198.51.100.1'"))
    bucket = state.paths.read().filter("ip = '198.51.100.1'").first().bucket
    plan = state.paths.read([bucket])._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(bucket" in scan and f"= {bucket})]" in scan.split("PushedFilters")[0]


def test_a_generation_without_its_line_is_not_read(spark, tmp_path):
    """A crash while a new generation is written leaves the old one in use."""
    state = EvidenceState(spark, str(tmp_path / "state"), buckets=2)
    v = requests(spark)
    state.add(v.filter("id < 50"), 0)
    state.paths._write(state.paths.read().limit(1), 1, 0)
    assert state.paths.read().agg(F.sum("total")).first()[0] == v.filter("id < 50").count()
    state.paths.compact(0)
    assert state.paths.read().agg(F.sum("total")).first()[0] == v.filter("id < 50").count()


def test_hours_from_batches_equal_hours_of_all(spark, tmp_path):
    v = requests(spark).select("id", "ip", "ts", "path", "status").cache()
    rollup = HourlyRollup(spark, str(tmp_path / "hours"))
    assert rollup.hours().count() == 0
    late = v.filter("id % 3 = 0")
    for number, batch in enumerate([v.filter("id % 3 = 1 and id < 60"), v.filter("id % 3 = 1 and id >= 60"), late, v.filter("id % 3 = 2")]):
        rollup.add(batch, number)
    rollup.add(late, 2)  # ran again
    rows = lambda df: sorted(tuple(r) for r in df.select("hour", "requests", "probing_addresses").collect())
    assert rows(rollup.hours()) == rows(baseline.hourly(v))
    now = str(v.agg(F.max("ts")).first()[0])
    for how in ({"min_days": 0}, {"days": 1}):
        assert rollup.baseline(now, **how).collect() == baseline.hourly_baseline(v, now, **how).collect()


@pytest.mark.parametrize("descending", [True, False])
def test_pages_by_cursor_hold_every_row_once(spark, descending):
    r = random.Random(2)
    df = spark.createDataFrame([(i, r.choice([None, "", "a", "b", "c"]), r.choice([None, 1, 2])) for i in range(23)], "id long, name string, n int")
    keys = {"name": "name", "n": "n"}
    for sort in keys:
        seen, last = [], None
        while page := pages.after(df, keys, sort, ["id"], last, descending, 4).collect():
            seen += page
            last = page[-1]
        plain = [tuple(x)[1 : 1 + len(df.columns)] for k in range(1, 8) for x in pages.page(df, keys, sort, ["id"], descending, k, 4).collect()]
        assert [tuple(x) for x in seen] == plain and len(seen) == 23
