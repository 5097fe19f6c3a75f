"""Streaming jobs: interrupted and resumed runs, late corrections, timers of the ledger."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from meridian.sources.workspace import scratch
from meridian.streaming import jobs

BAR = "ticker string, trading_date date, adjusted_close double, volume bigint, loaded int"
EVENT = "event_key string, kind string, at bigint, deadline bigint, value double"


def land(spark, path, rows, kind):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)


def break_after(monkeypatch, name, batches):
    """The named step of the jobs fails once `batches` of its calls are done."""
    real, calls = getattr(jobs, name), []

    def step(*args, **kw):
        if len(calls) == batches:
            raise RuntimeError("power cut")
        calls.append(1)
        return real(*args, **kw)

    monkeypatch.setattr(jobs, name, step)
    return lambda: monkeypatch.setattr(jobs, name, real)


def test_refresh_goes_on_after_a_failure_and_reads_new_files_only(spark, monkeypatch):
    landed, place = scratch(spark, "landed"), jobs.Place.fresh(spark, "bars")
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    for load in range(4):  # each load repeats two days of the one before
        land(spark, landed, [("A", day(k), 100.0 + 10 * load + k, load, load) for k in range(2 * load, 2 * load + 4)], BAR)
    mend = break_after(monkeypatch, "upsert", 2)
    with pytest.raises(StreamingQueryException, match="power cut"):
        jobs.refresh_bars(spark, landed, BAR, place, 1)
    assert {r.loaded for r in spark.read.parquet(place.table).collect()} == {0, 1}
    mend()
    want = {day(k): min(3, k // 2) for k in range(10)}
    assert {r.trading_date: r.volume for r in jobs.refresh_bars(spark, landed, BAR, place, 1).collect()} == want
    assert jobs.refresh_bars(spark, landed, BAR, place, 1).count() == 10  # nothing new
    land(spark, landed, [("A", day(0), 1.0, 99, 0), ("B", day(0), 1.0, 99, 0), ("A", day(9), 1.0, 99, 9)], BAR)  # an old file, late
    got = {(r.ticker, r.trading_date): r.volume for r in jobs.refresh_bars(spark, landed, BAR, place, 1).collect()}
    assert len(got) == 11 and got["B", day(0)] == 99 and got["A", day(9)] == 99
    reads = [p for p in spark.read.parquet(place.table).select(F.col("loaded")).distinct().collect()]
    assert {r.loaded for r in reads} <= {0, 1, 2, 3, 9}


def test_alerts_once_each_over_a_failure_and_a_second_call(spark, monkeypatch):
    landed, place, kind = scratch(spark, "records"), jobs.Place.fresh(spark, "alerts"), "event_id bigint, created_at timestamp, ticker string, event_type string, source_record_id string"
    at = dt.datetime(2024, 1, 1)
    for k in range(4):  # files repeat records of each other
        land(spark, landed, [(10 * k + i, at, "T1" if i else "T9", "filing", f"r{k + i}") for i in range(4)], kind)
    watched = spark.createDataFrame([("T1",), ("T1",)], "ticker string")
    mend = break_after(monkeypatch, "write_batch", 2)
    with pytest.raises(StreamingQueryException, match="power cut"):
        jobs.new_alerts(spark, jobs.read_files(spark, landed, kind), watched, place)
    mend()
    run = lambda: sorted(r.source_record_id for r in jobs.new_alerts(spark, jobs.read_files(spark, landed, kind), watched, place).collect())
    assert run() == [f"r{k}" for k in range(1, 7)]
    land(spark, landed, [(99, at, "T1", "filing", "r3"), (98, at, "T1", "filing", "r50")], kind)
    assert run() == sorted([f"r{k}" for k in range(1, 7)] + ["r50"])


def test_bounded_memory_of_alerts(spark, monkeypatch):
    """Each day brings five new records and repeats of the day before and of thirty days ago; a week is remembered, two at most."""
    landed, place, kind = scratch(spark, "records"), jobs.Place.fresh(spark, "alerts"), "event_id bigint, created_at timestamp, ticker string, event_type string, source_record_id string"
    day, kept, run = dt.datetime(2024, 1, 1), [], jobs.run_available
    monkeypatch.setattr(jobs, "run_available", lambda *a, **kw: kept.append(run(*a, **kw)))
    watched = spark.createDataFrame([("T1",)], "ticker string")
    records = lambda d, at: [(100 * at + i, day + dt.timedelta(days=at), "T1" if i < 5 else "T9", "filing", f"r{d}-{i}") for i in range(6)]
    for k in range(40):
        land(spark, landed, [*records(k, k), *(records(k - 1, k) if k else []), *(records(k - 30, k) if k >= 30 else [])], kind)
    got = jobs.alerts_within(spark, jobs.read_files(spark, landed, kind, 3), watched, place, 7).collect()
    assert len(got) == 5 * 40 + 5 * 10 and {r.ticker for r in got} == {"T1"}
    state = [p["stateOperators"][0]["numRowsTotal"] for p in kept[0].recentProgress if p["stateOperators"]]
    assert max(state) <= 5 * (7 + 7 + 4 * 3)  # a batch has three days and the clock is a batch late; the table has 250


def test_backlog_scores_each_item_once(spark, monkeypatch):
    landed, place, kind = scratch(spark, "turns"), jobs.Place.fresh(spark, "scores"), "turn_id bigint, content string"
    for k in range(3):
        land(spark, landed, [(k, "strong growth"), (10 + k, "weak"), (20 + k, None)], kind)
    done = spark.createDataFrame([(10,), (11,)], "turn_id bigint")
    mend = break_after(monkeypatch, "write_batch", 1)
    with pytest.raises(StreamingQueryException, match="power cut"):
        jobs.score_backlog(spark, jobs.read_files(spark, landed, kind), done, "turn_id", "content", place)
    mend()
    got = jobs.score_backlog(spark, jobs.read_files(spark, landed, kind), done, "turn_id", "content", place)
    assert sorted(r.turn_id for r in got.collect()) == [0, 1, 2, 12, 20, 21, 22]


def test_jobs_without_any_rows(spark):
    landed, place = scratch(spark, "none"), jobs.Place.fresh(spark, "none")
    land(spark, landed, [], BAR)
    assert jobs.refresh_bars(spark, landed, BAR, place).count() == 0
    landed = scratch(spark, "none")
    land(spark, landed, [], EVENT)
    assert jobs.ledger_stream(spark, jobs.read_files(spark, landed, EVENT), jobs.Place.fresh(spark, "none")).count() == 0


def test_ledger_timers(spark, monkeypatch):
    """Lateness 30 days; the last event is of day 400, so deadlines before day 370 have passed."""
    landed, place = scratch(spark, "ledger"), jobs.Place.fresh(spark, "ledger")
    forecast = lambda k, at, value=0.5: (k, "forecast", at, at + 60, value)
    outcome = lambda k, at, value=0.25: (k, "outcome", at, None, value)
    land(spark, landed, [forecast("matured", 100), forecast("late", 100), forecast("silent", 100), forecast("same-day", 100), forecast("twice", 100), forecast("twice", 101, 9.0), outcome("unknown", 90)], EVENT)
    land(spark, landed, [outcome("matured", 160), outcome("late", 161), outcome("same-day", 100), outcome("twice", 110), outcome("twice", 120, 7.0)], EVENT)
    land(spark, landed, [forecast("pending", 330), forecast("edge", 309)], EVENT)
    land(spark, landed, [outcome("silent", 400), forecast("open", 400)], EVENT)
    mend = break_after(monkeypatch, "write_batch", 2)
    with pytest.raises(StreamingQueryException, match="power cut"):
        jobs.ledger_stream(spark, jobs.read_files(spark, landed, EVENT), place, 30)
    mend()
    got = {r.event_key: (r.status, r.realized) for r in jobs.ledger_stream(spark, jobs.read_files(spark, landed, EVENT), place, 30).collect()}
    want = {"matured": ("MATURED", 0.25), "late": ("EXPIRED", None), "silent": ("EXPIRED", None), "same-day": ("INVALID", None), "twice": ("MATURED", 0.25), "pending": ("PENDING", None), "edge": ("EXPIRED", None), "open": ("PENDING", None)}
    assert got == want
    land(spark, landed, [forecast("new", 500)], EVENT)  # passes all deadlines
    again = {r.event_key: r.status for r in jobs.ledger_stream(spark, jobs.read_files(spark, landed, EVENT), place, 30).collect()}
    assert again == {**{k: s for k, (s, _) in want.items()}, "pending": "EXPIRED", "open": "EXPIRED", "new": "PENDING"}


def test_ledger_whatever_the_order_of_files(spark):
    """Outcomes that land before their forecast, and a first forecast that lands after a second one."""
    landed, place = scratch(spark, "ledger"), jobs.Place.fresh(spark, "ledger")
    land(spark, landed, [("a", "outcome", 110, None, 0.25), ("b", "forecast", 101, 161, 9.0), ("c", "outcome", 90, None, 1.0), ("d", "outcome", 95, None, 1.0)], EVENT)
    land(spark, landed, [("a", "forecast", 100, 160, 0.5), ("b", "forecast", 100, 160, 0.5), ("c", "forecast", 100, 160, 0.5)], EVENT)
    land(spark, landed, [("a", "outcome", 105, None, 0.75), ("b", "outcome", 120, None, 0.25)], EVENT)
    got = {r.event_key: (r.status, r.forecast, r.realized) for r in jobs.ledger_stream(spark, jobs.read_files(spark, landed, EVENT), place, 30).collect()}
    assert got == {"a": ("MATURED", 0.5, 0.75), "b": ("MATURED", 0.5, 0.25), "c": ("PENDING", 0.5, None)}
    land(spark, landed, [("e", "forecast", 500, 560, 0.5)], EVENT)
    got = {r.event_key: r.status for r in jobs.ledger_stream(spark, jobs.read_files(spark, landed, EVENT), place, 30).collect()}
    assert got == {"a": "MATURED", "b": "MATURED", "c": "EXPIRED", "e": "PENDING"}
