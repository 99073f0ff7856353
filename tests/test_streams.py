"""Stream jobs over files that arrive."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_operators import dimension, intel, values
from visitlens.operators import classify
from visitlens.plans import catalogue
from visitlens.sources import logs
from visitlens.streaming import jobs, sessions


def line(ip, second, path="/", status=200):
    return json.dumps({"time": f"2026-08-20T03:12:{second:02d}+00:00", "remote_addr": ip, "request": f"GET {path} HTTP/1.1", "status": status, "body_bytes_sent": 5, "http_user_agent": "curl/8", "connection": second, "connection_requests": 1})


def put(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(rows) + "\n")


ONCE = {"availableNow": True}


def test_stored_visits_restart_where_they_were(spark, tmp_path):
    logs_at, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        jobs.store(jobs.ingest(jobs.tail(spark, str(logs_at))), out, mark, ONCE).awaitTermination()

    put(logs_at, "a.log", line("198.51.100.1", 1), line("198.51.100.1", 1), line("198.51.100.2", 2), "broken")
    run()
    put(logs_at, "b.log", line("198.51.100.3", 30, "/x"))
    run()
    run()
    rows = spark.read.parquet(out)
    assert sorted(r.ip for r in rows.collect()) == ["198.51.100.1", "198.51.100.2", "198.51.100.3"] and {str(r.month)[:7] for r in rows.select("month").collect()} == {"2026-08"}


def test_batches_reclassify_alarm_and_find_newcomers(spark, tmp_path):
    logs_at, written = tmp_path / "in", {"class": [], "alarm": [], "new": []}
    put(logs_at, "a.log", line("198.51.100.1", 1, "/.env", 404), line("198.51.100.2", 2))
    known = intel(spark, [{"ip": "198.51.100.2"}])

    def stored():
        return logs.with_client(logs.to_visits(spark.read.text(str(logs_at)))).withColumn("id", F.monotonically_increasing_id())

    def keep(kind):
        return lambda df, number: written[kind].append([tuple(r) for r in df.collect()])

    judge = jobs.reclassify_active(stored, lambda: dimension(known, values(spark)), keep("class"))
    alarm = jobs.alarm(stored, lambda: "2026-08-20 04:30:00", keep("alarm"))
    fresh = jobs.newcomers(lambda: known, keep("new"))

    def work(batch, number):
        for job in (judge, alarm, fresh):
            job(batch, number)

    jobs.each_batch(logs.to_visits(jobs.tail(spark, str(logs_at))), work, str(tmp_path / "mark"), ONCE).awaitTermination()
    assert {(ip, c) for ip, c, *_ in written["class"][0]} == {("198.51.100.1", "bots/vulnerability-probers"), ("198.51.100.2", "automated/http-clients")}
    assert [ip for ip, _ in written["new"][0]] == ["198.51.100.1"] and written["alarm"] == [[]]


def test_quality_is_observed(spark, tmp_path):
    logs_at = tmp_path / "in"
    put(logs_at, "a.log", line("198.51.100.1", 1), "broken", line("198.51.100.2", 2).replace("+00:00", "+02:00"))
    q = jobs.observed(jobs.tail(spark, str(logs_at))).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "mark")).trigger(**ONCE).start()
    q.awaitTermination()
    seen = [p.observedMetrics["ingest_quality"] for p in q.recentProgress if p.numInputRows]
    assert [(r.lines, r.unparseable, r.non_utc) for r in seen] == [(3, 1, 1)]


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    logs_at, path = tmp_path / "in", str(tmp_path / "out")
    bare = line("198.51.100.7", 9).replace('"connection": 9', '"connection": 0')
    put(logs_at, "a.log", line("198.51.100.1", 1), line("198.51.100.1", 1), bare, bare, line("198.51.100.2", 2))
    store = jobs.once(spark, path)
    visits = logs.to_visits(spark.read.text(str(logs_at)))
    count = lambda: spark.read.parquet(path).count()
    store(visits, 0)
    assert count() == 4  # a replay goes, requests without a connection stay
    store(visits, 0)
    assert count() == 4
    store(visits, 1)
    assert count() == 6  # in another batch, those without a connection are requests of their own
    spark.read.parquet(path).createOrReplaceTempView("stored")
    assert spark.sql("select count(distinct identity) n from stored").first().n == 6


def test_a_crash_between_write_and_commit_adds_nothing(spark, tmp_path):
    logs_at, path, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    bare = line("198.51.100.7", 9).replace('"connection": 9', '"connection": 0')
    put(logs_at, "a.log", line("198.51.100.1", 1), bare, bare)
    store = jobs.once(spark, path)

    def run(work):
        jobs.each_batch(logs.to_visits(jobs.tail(spark, str(logs_at))), work, mark, ONCE).awaitTermination()

    def dies(batch, number):
        store(batch, number)
        raise OSError("the driver is gone")

    with pytest.raises(Exception, match="the driver is gone"):
        run(dies)
    assert spark.read.parquet(path).count() == 3
    run(store)
    put(logs_at, "b.log", line("198.51.100.1", 1), line("198.51.100.3", 3))
    run(store)
    assert spark.read.parquet(path).count() == 4


def test_a_batch_without_a_clock_adds_nothing_twice(spark, tmp_path):
    put(tmp_path / "in", "a.log", line("198.51.100.1", 1).replace("2026-08-20T03:12:01+00:00", "yesterday"), line("198.51.100.2", 2))
    visits, path = logs.to_visits(spark.read.text(str(tmp_path / "in"))), str(tmp_path / "out")
    store = jobs.once(spark, path)
    for _ in range(2):
        store(visits, 0)
        assert spark.read.parquet(path).count() == 2
    store(visits.filter("ts is null"), 1)
    store(visits.filter("false"), 2)
    assert spark.read.parquet(path).count() == 2


@pytest.mark.parametrize("near", [0, 100_000])
def test_batches_of_new_stored_and_repeated_requests(spark, tmp_path, monkeypatch, near):
    """Few or many of a batch are new, with identities sent to all tasks or shuffled."""
    monkeypatch.setattr(jobs, "NEAR", near)
    path, n = str(tmp_path / "out"), 0
    store, stored = jobs.once(spark, path), set()
    bare = line("198.51.100.7", 9).replace('"connection": 9', '"connection": 0')
    for seconds, others in (([1, 2, 2, 3], 0), ([1, 2, 3, 4, 4], 1), ([4, 5, 6, 7, 8, 8], 2), ([1, 2, 3], 2), ([11, 11], 0)):
        put(tmp_path / f"in{n}", "a.log", *[line("198.51.100.1", s) for s in seconds], *[bare] * others)
        before = spark.read.parquet(path).count() if n else 0
        new = len(set(seconds) - stored) + others
        stored |= set(seconds)
        for _ in range(2):
            store(logs.to_visits(spark.read.text(str(tmp_path / f"in{n}"))), n)
            assert spark.read.parquet(path).count() == before + new
        n += 1
    rows = spark.read.parquet(path)
    assert sorted(r.connection for r in rows.filter("connection > 0").collect()) == sorted(stored)
    assert rows.select("identity").distinct().count() == rows.count()


def test_only_identities_of_a_new_batch_are_shuffled(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", "a.log", line("198.51.100.1", 1), line("198.51.100.2", 2))
    visits, plans = logs.to_visits(spark.read.text(str(tmp_path / "in"))).filter("connection > 0"), []
    write = jobs.by_month
    monkeypatch.setattr(jobs, "by_month", lambda rows, path: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), write(rows, path)))
    store = jobs.once(spark, str(tmp_path / "out"))
    store(visits, 0)
    store(visits, 0)
    assert len(plans) == 1 and "Join" not in plans[0] and "Aggregate" not in plans[0]


class Held:
    """The state of one address, as Spark hands it over."""

    def __init__(self):
        self.exists, self.get, self.mark, self.timeout = False, None, 0, None

    def update(self, value):
        self.exists, self.get = True, value

    def getCurrentWatermarkMs(self):
        return self.mark

    def setTimeoutTimestamp(self, at):
        self.timeout = at


def request(second, path="/a", id=1, referer=""):
    return {"at": second * sessions.SECOND, "path": path, "page": path, "pseudo": False, **dict.fromkeys(sessions._COUNTS, 1), "entry_id": id, "entry_referer": referer}


def test_late_rows_join_open_sessions_and_closed_ones_are_numbered():
    work, state = sessions.open_sessions(10), Held()
    give = lambda *rows: [tuple(r) for f in work(("198.51.100.1",), iter([pd.DataFrame(list(rows))] if rows else []), state) for r in f.itertuples(index=False)]
    assert give(request(0, id=5, referer="late"), request(20, "/b", 6)) == [] and state.timeout == 11_000
    assert give(request(10, id=2, referer="first")) == [] and state.timeout == 31_000
    assert give(request(40, id=9)) == []
    state.mark = 31_000
    (one,) = give()
    assert one[:6] == ("198.51.100.1", 1, 0, 20 * sessions.SECOND, 3, 2) and one[-3:] == (2, "/a", "first") and state.timeout == 51_000
    state.mark = 60_000
    assert [r[1] for r in give()] == [2] and json.loads(state.get[0]) == []


def test_an_address_costs_little():
    """Many addresses of few requests: less than 5 ms each."""
    work, rows = sessions.open_sessions(10), pd.DataFrame([request(i * 7, f"/{i}", i) for i in range(20)])
    begun = time.time()
    for _ in range(1000):
        list(work(("198.51.100.1",), iter([rows]), Held()))
    assert time.time() - begun < 5


def test_a_batch_is_held_without_what_no_rule_reads(spark, tmp_path):
    logs_at = tmp_path / "in"
    put(logs_at, "a.log", line("198.51.100.1", 1, "/.env", 404), line("198.51.100.2", 2))
    batch = logs.with_client(logs.to_visits(spark.read.text(str(logs_at)))).withColumn("id", F.monotonically_increasing_id())
    judged = []

    class Noted:
        def add(self, rows, number):
            self.held = rows

        def evidence(self, rows, dim):
            return classify.evidence(rows, dim)

    state = Noted()
    jobs.judge_active(state, lambda: dimension(intel(spark, [{"ip": "198.51.100.2"}]), values(spark)), lambda df, n: judged.extend(df.collect()))(batch, 0)
    assert {(r.ip, r.visitor_class) for r in judged} == {("198.51.100.1", "bots/vulnerability-probers"), ("198.51.100.2", "automated/http-clients")}
    assert "request_time" in batch.columns and "request_time" not in state.held.columns and len(state.held.columns) == 14


def test_batches_are_written_by_all_tasks(spark):
    seen = {}

    def work(batch, number):
        seen[number] = (batch.count(), batch.select(F.input_file_name()).distinct().count())

    catalogue.in_batches(catalogue.dealt(spark.range(0, 30, 1, 3), 2), "many", lambda s: s, work)
    assert {n: x[0] for n, x in seen.items()} == {0: 15, 1: 15}
    assert all(files == 3 for _, files in seen.values())
