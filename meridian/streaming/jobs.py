"""Incremental jobs as Structured Streaming queries that stop when the available input is done."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions.udfs import score_texts
from meridian.sources.workspace import few, latest_wins, read_if_there, scratch, upsert, written


@dataclass(frozen=True)
class Place:
    """Where a job keeps its table and its progress; whoever calls it again with the same place goes on from there."""

    table: str
    progress: str

    @classmethod
    def fresh(cls, spark: SparkSession, name: str) -> Place:
        """A place for a job that starts from nothing."""
        return cls(scratch(spark, name), scratch(spark, f"{name}-progress"))


def read_files(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_available(stream: DataFrame, each_batch, progress: str, mode: str = "append"):
    """Process all input that `progress` does not know yet, batch by batch; returns the ended query.

    A batch that was cut off is run again with the same rows and number before any new one.
    """
    out = stream.writeStream.outputMode(mode).foreachBatch(each_batch).option("checkpointLocation", progress)
    query = out.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def write_batch(rows: DataFrame, table: str, n: int) -> None:
    """The rows of one micro-batch; a batch that is run again after a failure writes over its first try."""
    rows.write.mode("overwrite").parquet(f"{table}/batch={n}")


def rows_of_table(spark: SparkSession, place: Place, kind: str) -> DataFrame:
    """What the batches have written so far; no rows before the first."""
    found = read_if_there(spark, place.table, f"{kind}, batch bigint")
    return spark.createDataFrame([], f"{kind}, batch bigint") if found is None else found


def refresh_bars(spark: SparkSession, landed: str, schema, place: Place, per_trigger: int = 8) -> DataFrame:
    """Landed price files (with a column `loaded`) upserted into a table; of a bar the row loaded last wins.

    A load may repeat days of earlier ones, so late corrections win. Files landed since the last call
    are the only ones read; a repeated batch leaves the table as it is. `loaded` stays in the table,
    so an old file that comes late does not undo a correction.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert(place.table, batch.withColumn("year", F.year("trading_date")), ["ticker", "trading_date"], "year", by="loaded")

    run_available(read_files(spark, landed, schema, per_trigger), merge, place.progress)
    found = read_if_there(spark, place.table)
    return spark.createDataFrame([], schema) if found is None else found


ALERT = "event_type string, source_record_id string, created_at timestamp, event_id bigint, ticker string"


def new_alerts(spark: SparkSession, records: DataFrame, watched: DataFrame, place: Place) -> DataFrame:
    """One alert per (type, source record) of watched tickers from a stream of records, for ever; known ones are left out.

    The table of alerts is what the job remembers: records are compared with it by a join on their
    key, also after a restart.
    """
    kept = records.join(few(written(watched.distinct(), "watched")), "ticker", "left_semi")

    def insert(batch: DataFrame, n: int) -> None:
        fresh = batch.groupBy("event_type", "source_record_id").agg(F.min(F.struct("created_at", "event_id", "ticker")).alias("x")).select("event_type", "source_record_id", "x.*")
        known = rows_of_table(spark, place, ALERT).where(F.col("batch") < n)
        write_batch(fresh.join(known, ["event_type", "source_record_id"], "left_anti"), place.table, n)

    run_available(kept, insert, place.progress)
    return rows_of_table(spark, place, ALERT).drop("batch")


def alerts_within(spark: SparkSession, records: DataFrame, watched: DataFrame, place: Place, days: int) -> DataFrame:
    """As `new_alerts`, but what is remembered is bounded: a record alerts once more when over twice `days` have passed, and not within `days`.

    The keys of that span are kept as state; nothing is joined with the table. Records that come later than
    that behind the newest one are left out.
    """
    kept = records.join(few(written(watched.distinct(), "watched")), "ticker", "left_semi").withWatermark("created_at", f"{days} days")
    once = kept.dropDuplicatesWithinWatermark(["event_type", "source_record_id"]).select("event_type", "source_record_id", "created_at", "event_id", "ticker")
    run_available(once, lambda batch, n: write_batch(batch, place.table, n), place.progress)
    return rows_of_table(spark, place, ALERT).drop("batch")


def score_backlog(spark: SparkSession, items: DataFrame, done: DataFrame, key: str, text: str, place: Place) -> DataFrame:
    """Scores a stream of items that have no result yet, batch by batch, into a result table."""

    def score(batch: DataFrame, n: int) -> None:
        waiting = batch.join(done.select(key), key, "left_anti")
        write_batch(score_texts(waiting, key, text), place.table, n)

    run_available(items, score, place.progress)
    return rows_of_table(spark, place, f"{key} bigint, label string, score double, confidence double, tokens int, segments int, status string").drop("batch")


def ledger_stream(spark: SparkSession, events: DataFrame, place: Place, lateness_days: int = 366) -> DataFrame:
    """State by event key of a stream (event_key, kind, at, deadline, value); `at` and `deadline` are days since 1970.

    A forecast is PENDING until an outcome comes: MATURED, INVALID where the outcome is not later than
    the forecast, EXPIRED where it is later than the deadline. Without any outcome a timer makes
    it EXPIRED when event time passes the deadline, that is, when an event of any key has come that is
    more than `lateness_days` later. Of a key the first forecast counts and the first outcome that is not
    before it, by their days and not as they come: events within the lateness may come in any order, and outcomes wait
    for a forecast that long. Events that come later than that behind the newest are left out.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    day = 86_400_000

    def step(key, frames, state: GroupState):
        forecast, at, deadline, status, realized, whens, values = state.get if state.exists else (None, None, None, "NEW", None, [], [])
        clock, outcomes = state.getCurrentWatermarkMs(), list(zip(whens, values))
        if state.hasTimedOut:
            if status == "NEW":  # no forecast before these outcomes can come any more
                state.remove()
                return
            status = "EXPIRED"
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "kind", "value"])
            for kind, when, limit, value in rows[["kind", "at", "deadline", "value"]].itertuples(index=False):
                if kind == "outcome":
                    outcomes.append((int(when), float(value)))
                elif kind == "forecast" and (at is None or when < at):
                    forecast, at, deadline = float(value), int(when), int(limit)
            outcomes.sort()
            first = next((x for x in outcomes if at is not None and x[0] >= at), None)
            if first is not None:
                status = "INVALID" if first[0] <= at else "MATURED" if first[0] <= deadline else "EXPIRED"
                realized = first[1] if status == "MATURED" else None
            elif at is not None:
                status = "EXPIRED" if deadline * day < clock else "PENDING"
            early = [x for x in outcomes if (at is None or x[0] < at) and x[0] * day >= clock]
            outcomes = early if first is None else [*early, first]
            if status == "NEW" and not outcomes:
                if state.exists:
                    state.remove()
                return
        state.update((forecast, at, deadline, status, realized, [x[0] for x in outcomes], [x[1] for x in outcomes]))
        if status in ("PENDING", "NEW"):
            state.setTimeoutTimestamp(max((deadline if status == "PENDING" else outcomes[-1][0]) * day, clock + 1))
        if status != "NEW":
            yield pd.DataFrame({"event_key": [key[0]], "status": [status], "forecast": [forecast], "realized": [realized]})

    out = "event_key string, status string, forecast double, realized double"
    kept = "forecast double, at long, deadline long, status string, realized double, whens array<long>, values array<double>"
    timed = events.withColumn("_time", F.timestamp_seconds(F.col("at") * 86_400)).withWatermark("_time", f"{lateness_days} days")
    states = timed.groupBy("event_key").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.EventTimeTimeout)
    run_available(states, lambda batch, n: write_batch(batch, place.table, n), place.progress, "update")
    return latest_wins(rows_of_table(spark, place, out), ["event_key"], "batch")
