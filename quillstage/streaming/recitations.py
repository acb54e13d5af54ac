"""Recitation events as a stream: the newest entries and the streak of every key, exactly as in batch, and statuses that lapse.

State is a list of at most ten entries per key, so it is bounded by the number of keys. ``progress_stream`` gives figures from which
a status is derived when it is read. ``status_stream`` gives the status itself, at every event and again when a mastered key
falls due, by a timer of event time that is set anew with every recitation; entries and timers outlive a restart.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import TimestampNTZType

from quillstage.operators.rehearsal import DAY, INTERVALS, KEPT, MASTERY, SUCCESS
from quillstage.sources.folder import shared_folder

OUT = "user_id long, attempts int, streak int, successes int, last_at long, last_score double"
STATE = "at array<bigint>, score array<double>, tie array<bigint>"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    entries = list(zip(*state.get, strict=True)) if state.exists else []
    for frame in frames:
        entries += list(zip(frame["at"].tolist(), frame["score"].tolist(), frame["tie"].tolist(), strict=True))
    entries = sorted(entries, key=lambda e: (-e[0], -e[2]))[:KEPT]
    state.update(tuple(list(c) for c in zip(*entries, strict=True)))
    ok = [e[1] >= SUCCESS for e in entries]
    streak = ok.index(False) if False in ok else len(ok)
    yield pd.DataFrame(
        [(key[0], len(entries), streak, sum(ok), entries[0][0], entries[0][1])],
        columns=["user_id", "attempts", "streak", "successes", "last_at", "last_score"]
    )


def progress_stream(events: DataFrame) -> DataFrame:
    """Per update of a key its progress; ``events`` has user_id, ts, value, event_id."""
    rows = events.select(
        "user_id", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("at"),
        F.least(F.lit(100.0), F.col("value")).alias("score"), F.col("event_id").alias("tie")
    )
    return rows.groupBy("user_id").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


#: Where state of several parts and timers is kept.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT_STATE = f"{STATE}, timer bigint"
#: Entries of a key that wait before all but the newest are given up.
WAITING = 256
#: Rows of a stretch whose older entries are left out before the shuffle, and of the batches that it gives.
STRETCH, BATCH = 500_000, 10_000
STATUS = "user_id long, at long, status string, streak int, successes int, attempts int, due_at long"


def state_of(entries: list[tuple[int, float, int]], now: int | None = None) -> tuple[str, int, int, int | None]:
    """(status, streak, successes, due time) of a key's entries, the newest first, at the time of the newest or ``now``."""
    ok = [score >= SUCCESS for _, score, _ in entries]
    streak = ok.index(False) if False in ok else len(ok)
    due = entries[0][0] + INTERVALS[min(streak - MASTERY, len(INTERVALS) - 1)] * DAY if streak >= MASTERY else None
    if due is not None:
        status = "maitrisee" if (entries[0][0] if now is None else now) <= due else "a_reviser"
    else:
        status = "a_reviser" if sum(ok) >= MASTERY else "en_cours"
    return status, streak, sum(ok), due


class Lapsing(StatefulProcessor):
    """Keeps the newest entries of a key, and a timer for the time at which it falls due.

    Entries and the timer's time are one value, read once and written once a batch and key, and rows come and go as tuples: a
    call of the state store or a frame for every step took most of the time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", KEPT_STATE)

    def _stored(self) -> tuple[list[tuple[int, float, int]], int | None]:
        """The newest entries and the time of the key's only timer."""
        value = self.kept.get()
        return (list(zip(*value[:3], strict=True)), value[3]) if value else ([], None)

    def _store(self, entries: list[tuple[int, float, int]], timer: int | None) -> None:
        self.kept.update((*(list(c) for c in zip(*entries, strict=True)), timer))

    def _row(self, key: tuple, at: int, entries: list[tuple[int, float, int]], now: int | None) -> Row:
        status, streak, successes, due = state_of(entries, now)
        return Row(user_id=key[0], at=at, status=status, streak=streak, successes=successes, attempts=len(entries), due_at=due)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        entries, timer = self._stored()
        newest = lambda e: (-e[0], -e[2])
        for row in rows:
            entries.append((row["at"], row["score"], row["tie"]))
            if len(entries) >= WAITING:
                entries = heapq.nsmallest(KEPT, entries, newest)
        entries = sorted(entries, key=newest)[:KEPT]
        due, passed = state_of(entries)[3], timerValues.getCurrentWatermarkInMs()
        # what is due already at this time lapses with the event itself
        wanted = due if due is not None and due >= passed else None
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self._store(entries, wanted)
        yield self._row(key, entries[0][0], entries, max(passed, entries[0][0]))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        entries = self._stored()[0]
        self._store(entries, None)  # a timer is gone when it has expired
        yield self._row(key, due + 1, entries, due + 1)

    def close(self) -> None:
        pass


def newest_of_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest entries of every key among each stretch of rows (user_id, at, score, tie), before the shuffle.

    What is older than ten of its key in one stretch is in no list of the newest ten, late rows among them or not; so it need
    not be handed to the processor, which takes rows one by one.
    """

    def newest(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(waiting).sort_by([("user_id", "ascending"), ("at", "descending"), ("tie", "descending")])
        keys = table.column("user_id").combine_chunks()
        # a row of no key begins a group of its own, so all of them stay
        begins = np.concatenate([[True], pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)), True).to_numpy(zero_copy_only=False)])
        place = np.arange(len(keys))
        rank = place - np.maximum.accumulate(np.where(begins, place, 0))
        yield from table.filter(pa.array(rank < KEPT)).to_batches(max_chunksize=BATCH)

    waiting, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            rows += batch.num_rows
        if rows >= STRETCH:
            yield from newest(waiting)
            waiting, rows = [], 0
    if waiting:
        yield from newest(waiting)


def status_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(user_id, at, status, …): the status of a key after each batch that recites it, and once more when it lapses.

    What is later than ``late`` is left out. A key without recitations to come lapses when the events of others, which move the
    watermark, have passed its due time. Needs STATE_STORE as the session's provider of state.
    """
    plain = isinstance(events.schema["ts"].dataType, TimestampNTZType)  # of no time zone: as if of UTC
    at = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") if plain else F.unix_millis("ts")
    rows = events.select("user_id", at.alias("at"), F.least(F.lit(100.0), F.col("value")).alias("score"), F.col("event_id").alias("tie"))
    rows = rows.mapInArrow(newest_of_stretches, rows.schema)
    return rows.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", late).groupBy("user_id").transformWithState(Lapsing(), STATUS, "Update", "EventTime")


def settled(spark: SparkSession, events: DataFrame, late: str = "1 day") -> DataFrame:
    """The last status of every key after the stream ``events`` has been read to its present end, as a table in the shared folder."""
    key, folder = "spark.sql.streaming.stateStore.providerClass", shared_folder(spark, "status")
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_STORE)
    try:
        writer = status_stream(events, late).writeStream.outputMode("update").option("checkpointLocation", f"{folder}-state")
        # a batch that is run again replaces what it has written
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/batch={n}")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    said = spark.read.option("basePath", folder).schema(f"{STATUS}, batch long").parquet(folder)
    last = F.max_by(F.struct(*(c.split()[0] for c in STATUS.split(", ")[1:])), F.struct("batch", "at"))
    return said.groupBy("user_id").agg(last.alias("s")).select("user_id", "s.*")


def windowed(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their mean, summed as decimals, by window and type; what is later than ``late`` is left out of closed windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(
        F.count("*").alias("events"), F.round(F.avg(F.col("value").cast("decimal(18,6)")), 6).alias("mean")
    )
