"""Event streams: storing, call and stage folds, totals, rates and stale projects.

Folds are by key and by windows of an hour, in update mode: a window's state goes once the watermark has passed it, so that what is held grows with the events of the
last hour and not with all calls ever made. Each update replaces its row in a table that is kept in place (upserted); folding a key's windows on read
gives the outcome. Events that come later than the watermark are left out, and counted (`late_rows`). Jobs take batches as well, and give what the stream gives
when all is in."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.clean import persistable
from ..sources.buckets import read_buckets, upsert_in_place

P = "project_id"
LATE = "10 minutes"
STALE_MINUTES = 12
LIFE = "1 hour"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _marked(events: DataFrame) -> DataFrame:
    return events.withWatermark("created_at", LATE)


def events_sink(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Storable events, appended to Parquet exactly once."""
    return persistable(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def to_folder(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows of an append-mode job, as Parquet."""
    return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upserted(result: DataFrame, path: str, keys: list[str], checkpoint: str, by: list[str] | None = None) -> StreamingQuery:
    """Rows of an update-mode job replace those of their keys in the table at path. Batches are loads: one that comes again changes nothing."""

    def save(batch: DataFrame, number: int) -> None:
        upsert_in_place(batch, path, keys, f"batch-{number}", by)

    return result.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were left out, by the query's progress reports."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


CALL_KEYS = [P, "call_id", "hour"]
STAGE_KEYS = [P, "stage", "hour"]
TOTAL_KEYS = [P, "hour"]


def _hourly(events: DataFrame, *keys: str):
    return _marked(events).groupBy(*keys, F.window("created_at", LIFE).alias("w"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "w"], F.col("w.start").alias("hour"))


def calls(events: DataFrame) -> DataFrame:
    """A call's events of an hour: the first end and its phase, and the first start. A repeated event changes nothing."""
    end = F.col("phase").isin("completed", "failed")
    return _flat(
        _hourly(events.filter("kind = 'ai_call'"), P, "call_id").agg(
            F.min(F.when(end, F.struct("created_at", "id", "phase"))).alias("ended"), F.min(F.when(F.col("phase") == "started", F.col("created_at"))).alias("started_at")
        )
    )


def fold_calls(hours: DataFrame) -> DataFrame:
    """(project_id, call_id, status, started_at, ended_at): an end outranks a start."""
    own = hours.groupBy(P, "call_id").agg(F.min("ended").alias("ended"), F.min("started_at").alias("started_at"))
    return own.select(P, "call_id", F.coalesce("ended.phase", F.lit("started")).alias("status"), "started_at", F.col("ended.created_at").alias("ended_at"))


def stages(events: DataFrame) -> DataFrame:
    """A stage's events of an hour: first start, last completion, last event."""
    at = lambda phase: F.when(F.col("phase") == phase, F.col("created_at"))
    return _flat(
        _hourly(events.filter("kind = 'stage'"), P, "stage").agg(F.min(at("started")).alias("started_at"), F.max(at("completed")).alias("completed_at"), F.max(F.struct("created_at", "id", "phase")).alias("last"))
    )


def fold_stages(hours: DataFrame) -> DataFrame:
    """(project_id, stage, started_at, completed_at, last_phase)."""
    own = hours.groupBy(P, "stage").agg(F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"), F.max("last").alias("last"))
    return own.select(P, "stage", "started_at", "completed_at", F.col("last.phase").alias("last_phase"))


def running_totals(events: DataFrame) -> DataFrame:
    """A project's events of an hour: how many, tokens, first and last time."""
    return _flat(_hourly(events, P).agg(F.count(F.lit(1)).alias("events"), F.sum("in_tokens").alias("tokens"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")))


def fold_totals(hours: DataFrame) -> DataFrame:
    return hours.groupBy(P).agg(F.sum("events").alias("events"), F.sum("tokens").alias("tokens"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


JOBS = {"calls": (calls, CALL_KEYS, fold_calls), "stages": (stages, STAGE_KEYS, fold_stages), "totals": (running_totals, TOTAL_KEYS, fold_totals)}


def run_fold(spark: SparkSession, name: str, events: DataFrame, folder: str) -> DataFrame:
    """The job over all events that the stream has by now, resumed where it stopped, and what its table then says."""
    job, keys, fold = JOBS[name]
    result = job(events)
    upserted(result, f"{folder}/table", keys, f"{folder}/state", [P]).awaitTermination()
    return fold(read_buckets(spark, f"{folder}/table", result.schema))


def stale_projects(events: DataFrame) -> DataFrame:
    """(project_id, last_at) of a batch: sessions ended by 12 silent minutes whose last stage event isn't a completion or failure. Event time."""
    own = _marked(events).groupBy(P, F.session_window("created_at", f"{STALE_MINUTES} minutes").alias("s")).agg(
        F.max_by("phase", F.struct("created_at", "id")).alias("last_phase"), F.max("created_at").alias("last_at")
    )
    return own.filter("last_phase = 'started'").select(P, "last_at")


class Silence(StatefulProcessor):
    """Per project its last event, and one event-time timer 12 minutes after it. The timer gives a project whose last event was a start, and ends its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, number long, phase string")

    @staticmethod
    def due(at: int) -> int:
        """Milliseconds; timers fire at the watermark, which must have passed the whole of the 12 minutes."""
        return at // 1000 + STALE_MINUTES * 60_000

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.last.get() if self.last.exists() else None
        at, number, phase = before if before else (-1, -1, "")
        for row in rows:
            if (row.at, row.id) > (at, number):
                at, number, phase = row.at, row.id, row.phase
        if before is None or before[0] != at:
            if before is not None:
                self.handle.deleteTimer(self.due(before[0]))
            self.handle.registerTimer(self.due(at))
        self.last.update((at, number, phase))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, _, phase = self.last.get()
        self.last.clear()
        if phase == "started":
            yield Row(project_id=key[0], at=at)

    def close(self) -> None:
        pass


def stale_by_timeout(events: DataFrame) -> DataFrame:
    """(project_id, last_at) of a stream: a project comes as soon as the watermark is 12 minutes past its last event, if that was a start; later events begin anew. Events
    without a time or project don't count."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own = _marked(events).filter(f"{P} IS NOT NULL AND created_at IS NOT NULL").select(P, "id", F.coalesce("phase", F.lit("")).alias("phase"), F.unix_micros("created_at").alias("at"), "created_at")
    silent = own.groupBy(P).transformWithState(Silence(), "project_id long, at long", "append", "eventTime")
    return silent.select(P, F.timestamp_micros("at").alias("last_at"))


def event_rates(events: DataFrame, slide: str | None = None) -> DataFrame:
    """(start, kind, n, tokens): events and tokens by kind in windows of 10 minutes, tumbling or sliding; a stream gives each window once, when the watermark has passed its end."""
    w = F.window("created_at", "10 minutes", slide) if slide else F.window("created_at", "10 minutes")
    return _marked(events).groupBy(w.alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("in_tokens").alias("tokens")).select(F.col("w.start").alias("start"), "kind", "n", "tokens")
