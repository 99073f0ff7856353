"""Months go and come back whole."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from visitlens.sources.archive import retention_plan
from visitlens.sources.months import MonthStore, NoArchive, NotWhole, Snapshot

VISITS = "id long, ip string, ts timestamp_ntz, path string"
INTEL = "ip string, country string"


@pytest.fixture
def store(spark, tmp_path):
    s = MonthStore(spark, str(tmp_path / "live"), str(tmp_path / "archive"), VISITS, INTEL)
    rows = [(i, f"198.51.100.{i % 3}", datetime(2024, 1, 1 + i, 5), f"/{i}") for i in range(9)] + [(100 + i, f"198.51.100.{2 + i % 2}", datetime(2024, 2, 3, i), None) for i in range(4)]
    s.add(spark.createDataFrame(rows, VISITS))
    s.intel.replace(spark.createDataFrame([(f"198.51.100.{i}", f"c{i}") for i in range(4)], INTEL))
    s.values.replace(spark.createDataFrame([("198.51.100.0", "port", "22"), ("198.51.100.2", "tag", "x")], "ip string, kind string, value string"))
    return s


def state(s):
    rows = lambda df: sorted(map(repr, df.collect()))
    return rows(s.visits()), rows(s.intel.read()), rows(s.values.read())


def test_archive_and_restore_are_a_round_trip(store):
    before = state(store)
    line = store.archive("2024-01")
    assert (line["visits"], line["addresses"], line["first"], line["last"]) == (9, 3, "2024-01-01 05:00:00", "2024-01-09 05:00:00")
    gone = state(store)
    assert len(gone[0]) == 4 and [r.ip for r in store.intel.read().orderBy("ip").collect()] == ["198.51.100.2", "198.51.100.3"] and len(gone[2]) == 1
    store.archive("2024-01")  # nothing is left to archive; the archive stays
    assert state(store) == gone and store.archived("2024-01") == line
    assert store.restore("2024-01", "2024-06-01")["visits"] == 9
    assert state(store) == before and [r.month for r in store.pins.read().collect()] == ["2024-01"]
    assert store.restore("2024-01", "2024-06-01")["visits"] == 0
    assert state(store) == before
    assert store.release("2024-01") == 9 and state(store) == gone and store.pins.read().isEmpty()
    assert store.release("2024-01") == 0 and state(store) == gone


def test_restore_replaces_nothing(spark, store):
    store.archive("2024-01")
    store.add(spark.createDataFrame([(3, "198.51.100.9", datetime(2024, 1, 4, 5), "/mine"), (50, "198.51.100.0", datetime(2024, 1, 30), "/new")], VISITS))
    store.intel.replace(store.intel.read().union(spark.createDataFrame([("198.51.100.0", "newer")], INTEL)))
    assert store.restore("2024-01", "x")["visits"] == 8
    assert store.visits("2024-01").filter("id = 3").first().path == "/mine"
    assert store.intel.read().filter("ip = '198.51.100.0'").collect() == [("198.51.100.0", "newer")]
    with pytest.raises(NotWhole):
        store.release("2024-01")  # the archive lacks visit 50
    assert store.visits("2024-01").count() == 10
    assert store.archive("2024-01")["visits"] == 10 and store.visits("2024-01").isEmpty()


def test_nothing_is_dropped_without_a_whole_archive(store, monkeypatch):
    before = state(store)
    for step in (store.release, store.delete_archive):
        with pytest.raises(NoArchive):
            step("2024-01")
    with pytest.raises(NoArchive):
        store.restore("2024-01", "x")
    whole = store._fingerprint
    monkeypatch.setattr(store, "_fingerprint", lambda df: whole(df if "month" in df._jdf.queryExecution().toString() else df.limit(1)))
    with pytest.raises(NotWhole):
        store.archive("2024-01")
    assert state(store) == before and store.archived("2024-01") is None


def test_a_crash_between_archive_and_drop_is_made_good(store, monkeypatch):
    before = state(store)
    drop = store._drop
    monkeypatch.setattr(store, "_drop", lambda month: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.archive("2024-01")
    line = store.archived("2024-01")
    assert state(store) == before and line["visits"] == 9
    monkeypatch.setattr(store, "_drop", drop)
    assert store.archive("2024-01") == line and store.visits("2024-01").isEmpty()


def test_delete_and_a_changed_archive(spark, store):
    assert store.delete("2024-02") == 4 and store.delete("2024-02") == 0 and store.visits().count() == 9
    line = store.archive("2024-01")
    spark.createDataFrame([(1, "x", datetime(2024, 1, 1), "/")], VISITS).write.mode("append").json(f"{store.archives}/{line['folder']}/visits")
    with pytest.raises(NotWhole):
        store.restore("2024-01", "x")
    store.delete_archive("2024-01")
    assert store.archived("2024-01") is None


def test_a_month_alone_is_read(store):
    plan = store.visits("2024-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2024-02" in plan.split("PartitionFilters")[1]


def test_a_plan_is_settled(store):
    inventory = store.visits().groupBy("month").agg(F.count("*").alias("visits"))
    plan = retention_plan(inventory, "2024-03-10", keep_months=1)
    store.settle("2024-03-10", plan)
    assert [r.month for r in store.visits().select("month").distinct().collect()] == ["2024-02"]
    store.restore("2024-01", "2024-03-20")
    store.settle("2024-03-11", retention_plan(store.visits().groupBy("month").agg(F.count("*").alias("visits")), "2024-03-11", keep_months=1))
    assert store.visits("2024-01").count() == 9  # pinned
    store.settle("2024-03-21", plan.limit(0))
    assert store.visits("2024-01").isEmpty() and store.archived("2024-01")["visits"] == 9


def test_dropping_a_month_reads_the_visits_once_for_both_tables(store, monkeypatch):
    plans, replace = [], Snapshot.replace

    def seen(self, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        replace(self, rows)

    monkeypatch.setattr(Snapshot, "replace", seen)
    store.delete("2024-01")
    assert len(plans) == 2 and all("InMemoryTableScan" in p for p in plans)
