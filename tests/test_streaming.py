import random

import pyarrow as pa
from pyspark.sql import functions as F

from quillstage.operators import rehearsal
from quillstage.plans import rehearsing
from quillstage.streaming import recitations
from tests.conftest import SF


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    query = recitations.progress_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.append({r.user_id: r for r in df.collect()})).start()
    query.processAllAvailable()
    query.stop()
    last = {}
    for batch in seen:
        last |= batch
    for r in rehearsing.QUERIES["progress"](spark, SF).collect():
        s = last[r.user_id]
        assert (s.attempts, s.streak, s.successes, s.last_at) == (r.attempts, r.streak, r.successes, r.last_at)


def test_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    query = recitations.windowed(stream, "30 days", "400 days").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("windows").agg(F.sum("events")).first()[0] == events.count()


def test_a_mastered_speech_lapses_when_it_falls_due(spark, tmp_path):
    day = recitations.DAY
    rng = random.Random(4)
    # (key, day, score): key 1 is mastered and left alone, 2 recites again before it is due, 3 fails, the others are mixed; 99 moves time on
    events = [(1, d, 95.0) for d in (1, 2, 3)] + [(2, d, 95.0) for d in (1, 2, 3, 8, 20)] + [(3, d, x) for d, x in ((1, 95.0), (2, 95.0), (3, 95.0), (9, 10.0))]
    events += [(k, rng.randint(1, 58), rng.choice([95.0, 95.0, 95.0, 40.0])) for k in range(10, 30) for _ in range(rng.randint(1, 14))]
    events += [(99, d, 50.0) for d in range(1, 61)]
    rows = [(k, d * day + n, x, n) for n, (k, d, x) in enumerate(sorted(events, key=lambda e: e[1]))]
    frame = spark.createDataFrame(rows, "user_id long, ms long, value double, event_id long").withColumn("ts", F.timestamp_millis("ms"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", recitations.STATE_STORE)
    last = {}

    def run(to):
        """What the stream says until all files are read; a run begins where the one before it ended."""
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        keep = lambda df, n: [last.update({r.user_id: r}) for r in sorted(df.collect(), key=lambda r: r.at)]
        query = recitations.status_stream(stream, "1 hour").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).start()
        query.processAllAvailable()
        query.stop()
        # the watermark is an hour behind the newest event
        now = max(r[1] for r in rows if r[1] < to * day) - 3_600_000
        seen = {}
        for k, at, x, n in rows:
            if at < to * day:
                seen.setdefault(k, []).append((at, x, n))
        for k, own in seen.items():
            own = sorted(own, key=lambda e: (-e[0], -e[2]))[:10]
            status, streak, successes, due = recitations.state_of(own, max(now, own[0][0]))
            assert (last[k].status, last[k].streak, last[k].successes, last[k].due_at, last[k].attempts) == (status, streak, successes, due, len(own)), k
        return seen

    try:
        for low, high in ((0, 10), (10, 25), (25, 70)):
            frame.filter((F.col("ms") >= low * day) & (F.col("ms") < high * day)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            run(high)
            if high == 10:
                assert last[1].status == "maitrisee"
        assert last[1].status == "a_reviser" and last[1].at == last[1].due_at + 1
        # an event behind the watermark is left out
        late = spark.createDataFrame([(1, 2 * day + 5, 10.0, 10**6)], "user_id long, ms long, value double, event_id long").withColumn("ts", F.timestamp_millis("ms"))
        late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(70)
        assert last[1].attempts == 3
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_states_equal_the_batch(spark):
    rng, day = random.Random(5), recitations.DAY
    rows = [(k, rng.randint(1, 60) * day, float(rng.choice([95, 90, 89, 20])), n) for n, k in enumerate(k for k in range(40) for _ in range(rng.randint(1, 13)))]
    history = spark.createDataFrame(rows, "user_id long, at long, score double, tie long")
    for now in (20, 45, 61, 200):
        per = rehearsal.progress(rehearsal.newest(history, ["user_id"], "at", "tie"), ["user_id"], "at", "score", F.lit(now * day))
        for r in per.collect():
            own = sorted(((at, x, n) for k, at, x, n in rows if k == r.user_id), key=lambda e: (-e[0], -e[2]))[:10]
            status, streak, successes, due = recitations.state_of(own, now * day)
            assert (r.status, r.streak, r.successes, r.due_at) == (status, streak, successes, due)


def test_older_entries_are_left_out_before_the_shuffle(monkeypatch):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, 3, 2**60, 2**60 + 1]), rng.randint(1, 40), float(rng.randint(0, 100)), n) for n in range(500)]
    names = ["user_id", "at", "score", "tie"]
    table = pa.table([list(c) for c in zip(*rows, strict=True)], schema=pa.schema([("user_id", pa.int64()), ("at", pa.int64()), ("score", pa.float64()), ("tie", pa.int64())]))
    newest = lambda own: sorted(own, key=lambda e: (-e[1], -e[3]))[:10]
    for stretch in (10_000, 60):
        monkeypatch.setattr(recitations, "STRETCH", stretch)
        kept = [tuple(r[c] for c in names) for b in recitations.newest_of_stretches(iter(table.to_batches(max_chunksize=37))) for r in b.to_pylist()]
        assert sum(r[0] is None for r in kept) == sum(r[0] is None for r in rows)
        for key in {r[0] for r in rows} - {None}:
            assert newest([r for r in kept if r[0] == key]) == newest([r for r in rows if r[0] == key])
        if stretch == 10_000:
            assert len([r for r in kept if r[0] is not None]) == 50
    assert list(recitations.newest_of_stretches(iter([]))) == []


def test_a_key_is_one_read_and_one_write_of_the_state():
    calls = []

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return State()

        def registerTimer(self, at):  # noqa: N802
            calls.append(("register", at))

        def deleteTimer(self, at):  # noqa: N802
            calls.append(("delete", at))

    class Now:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 0

    day, lapsing = recitations.DAY, recitations.Lapsing()
    lapsing.init(Handle())
    said = lambda *days: list(lapsing.handleInputRows((1,), iter([{"at": d * day, "score": 95.0, "tie": d} for d in days]), Now()))[0]
    assert said(1, 2, 3).due_at == 10 * day and calls == ["get", ("register", 10 * day), "update"]
    calls.clear()
    assert said(1).attempts == 4 and ("delete", 10 * day) in calls  # a fourth success: a longer interval
    calls.clear()
    assert said(*range(4, 400)).attempts == 10 and calls[0] == "get" and calls[-1] == "update" and len(calls) == 4
