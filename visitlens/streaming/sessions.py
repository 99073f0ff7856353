"""Sessions with all their facts and their behaviour, kept as state of each address and given out when the watermark has passed their end."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from visitlens.functions import columns as C
from visitlens.operators.sessions import SESSION_GAP, behaviour

#: Keeps the state of many addresses on disk.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_COUNTS = ["n", "probe_404", "ok", "content", "nav", "posts", "refused"]
#: What comes in of each request. What is kept of each path of an open session, in this order: start, path, page, pseudo, first and last time in microseconds, counters, id and referer of its first request.
_GIVEN = ["at", "path", "page", "pseudo", *_COUNTS[1:], "entry_id", "entry_referer"]
_STATE = "open string, closed long"
_FACTS = "ip string, session_no long, started_us long, ended_us long, requests long, unique_paths long, probe_404 long, distinct_404_paths long, ok_requests long, content_requests long, distinct_2xx_paths long, internal_nav long, post_requests long, refused long, max_path_repeats long, entry_path string, entry_referer string"
SECOND = 1_000_000


def joined(rows: list[list], gap: int) -> list[list]:
    """Rows with the start of their session anew, one a (session, path): spans (rows of one start, or single requests) that lie at most ``gap`` seconds apart are one session.

    Counters add up; the first request of a path is the one with the least id.
    """
    spans: dict[int, list[int]] = {}
    for start, _, _, _, first, last, *_ in rows:
        span = spans.setdefault(start, [first, last])
        span[:] = min(span[0], first), max(span[1], last)
    begins, begin, reach = {}, None, None
    for start, (first, last) in sorted(spans.items(), key=lambda x: x[1][0]):
        if reach is None or (first - reach) // SECOND > gap:
            begin, reach = first, last
        begins[start], reach = begin, max(reach, last)
    found: dict[tuple, list] = {}
    for row in rows:
        key = (begins[row[0]], row[1])
        have = found.get(key)
        if have is None:
            found[key] = [key[0], *row[1:]]
            continue
        have[4], have[5] = min(have[4], row[4]), max(have[5], row[5])
        for i in range(6, 6 + len(_COUNTS)):
            have[i] += row[i]
        if row[-2] < have[-2]:
            have[-2:] = row[-2:]
    return list(found.values())


def facts(ip: str, number: int, rows: list[list]) -> tuple:
    _, paths, pages, pseudo, first, last, n, probe_404, ok, content, nav, posts, refused, _, _ = zip(*rows)
    entry = min(rows, key=lambda r: r[-2])
    distinct = lambda some: len({p for p, s in zip(pages, some) if s and p is not None})
    return (
        ip, number, min(first), max(last), sum(n), distinct(not p for p in pseudo), sum(probe_404), sum(x > 0 for x in probe_404), sum(ok), sum(content),
        distinct(x > 0 for x in ok), sum(nav), sum(posts), sum(refused), max(n), entry[1], entry[-1],
    )


def open_sessions(gap: int):
    """The open sessions of an address as rows by path, and how many it had. Late rows within the watermark may extend or join sessions.

    Sessions whose end lies more than the gap before the watermark are done: no row that still counts can reach them.
    """

    def over(last: int) -> int:
        return last // 1000 + (gap + 1) * 1000

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, closed = state.get if state.exists else ("[]", 0)
        rows = json.loads(held)
        for new in batches:
            # each request begins as a span of its own
            rows += [[at, path, page, pseudo, at, at, 1, *rest] for at, path, page, pseudo, *rest in zip(*[new[c].tolist() for c in _GIVEN])]
        found: dict[int, list[list]] = {}
        for row in joined(rows, gap):
            found.setdefault(row[0], []).append(row)
        mark = state.getCurrentWatermarkMs()
        ends = {start: over(max(r[5] for r in s)) for start, s in found.items()}
        done = sorted(start for start, end in ends.items() if end <= mark)
        out = [facts(key[0], closed + i + 1, found.pop(start)) for i, start in enumerate(done)]
        state.update((json.dumps([r for s in found.values() for r in s]), closed + len(done)))
        if found:
            state.setTimeoutTimestamp(min(ends[start] for start in found))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _FACTS.split(", ")])

    return work


def session_facts(visits: DataFrame, gap: int = SESSION_GAP, host: str = "", late: str = "10 minutes") -> DataFrame:
    """A stream of closed sessions with the facts of the batch operator and their behaviour; visits have event_time. See ``STATE_STORE`` for many addresses.

    What a row counts for is decided by expressions before; Python adds rows of one path up. Only open sessions are kept.
    """
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    flags = {"probe_404": C.is_probe_404(), "ok": C.is_ok(), "content": C.is_content(), "nav": C.is_internal_nav(host), "posts": F.col("method") == "POST", "refused": F.col("status").isin(401, 403)}
    rows = visits.withWatermark("event_time", late).select(
        "ip", "event_time", at.alias("at"), "path", C.page_of(F.col("path")).alias("page"), C.is_pseudo(F.col("path")).alias("pseudo"), F.col("id").alias("entry_id"), F.col("referer").alias("entry_referer"), *[C.flag(c).cast("long").alias(k) for k, c in flags.items()]
    )
    found = rows.groupBy("ip").applyInPandasWithState(open_sessions(gap), _FACTS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    time = lambda c: F.timestamp_add("MICROSECOND", F.col(c), F.lit("1970-01-01").cast("timestamp_ntz"))
    whole = found.withColumns({"started": time("started_us"), "ended": time("ended_us")}).drop("started_us", "ended_us")
    whole = whole.withColumns({"duration": F.timestamp_diff("SECOND", F.col("started"), F.col("ended")), "unserved": F.greatest(F.col("unique_paths") - F.col("distinct_2xx_paths"), F.lit(0).cast("long"))})
    return whole.withColumn("behaviour", behaviour())
