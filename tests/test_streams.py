"""Stateful streams over several micro-batches against their batch forms."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import guards, routing
from plumbline.sources import stream_audit
from plumbline.streaming import drift_stream
from plumbline.streaming.guards import breaker_stream, escalation_stream, loops_stream, use_rocksdb

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    use_rocksdb(spark)
    yield spark
    spark.conf.set(key, before)


def parts(spark, tmp_path, frames):
    """A stream that gives each frame as a micro-batch of its own."""
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    paths = [f"{tmp_path}/in/part={i}" for i in range(len(frames))]
    merged = f"{tmp_path}/all"
    for i, p in enumerate(paths):
        spark.read.schema(frames[0].schema).parquet(p).coalesce(1).write.mode("append").parquet(merged)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(merged)


def run(tmp_path, query, name, mode):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return q.recentProgress, query.sparkSession.table(name)


def test_breaker_and_loops_equal_batch(rocks, tmp_path):
    events = rocks.read.parquet(f"{SF}/events.parquet")
    odd = rocks.createDataFrame([(10**6 + i, None, None, None if i % 2 else "x", None, None) for i in range(4)], events.schema)
    few = events.where("user_id <= 4").unionByName(odd).withColumn("user_id", F.nullif("user_id", F.lit(3)))
    cut = few.where("ts is not null").agg(F.percentile_approx("ts", F.array(F.lit(0.3), F.lit(0.6)))).first()[0]
    frames = [few.where((F.col("ts") <= cut[0]) | F.col("ts").isNull()), few.where((F.col("ts") > cut[0]) & (F.col("ts") <= cut[1])), few.where(F.col("ts") > cut[1])]
    ok = F.col("event_type") != "error"
    progress, got = run(tmp_path, breaker_stream(parts(rocks, tmp_path, frames), "user_id", "event_id", ok, "ts", 2, 43_200.0), "breaker_live", "append")
    assert len([p for p in progress if p.numInputRows]) == 3
    want = guards.breaker(few, "user_id", ok, "ts", ["ts", "event_id"], 2, 43_200.0).select("user_id", "event_id", "failures", "is_open", "allowed")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    _, got = run(tmp_path, loops_stream(rocks.readStream.schema(few.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all"), "user_id", "event_id", "event_type", "ts", 4, 2), "loops_live", "append")
    want = guards.loops(few, "user_id", "event_type", ["ts", "event_id"], 4, 2).select("user_id", "event_id", "visits", "violation", "observed", "allowed_count")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert {r.violation for r in got.collect()} == {None, "overvisit", "alternation"}


def test_escalations_time_out_once(rocks, tmp_path):
    schema = "id string, seq long, event string, by string, reason string, s long"
    batches = [
        [("a", 0, "created", None, None, 0), ("b", 0, "created", None, None, 10), ("c", 1, "approved", "early", None, 20), (None, 0, "created", None, None, 20)],
        [("b", 1, "rejected", "bo", "no", 40), ("c", 0, "created", None, None, 30), ("d", 0, "created", None, None, 50)],
        [("e", 0, "created", None, None, 105)],
        [("e", 1, "approved", "ann", None, 110), ("f", 0, "created", None, None, 170), ("a", 1, "approved", "late", None, 171)],
        [("g", 0, "created", None, None, 300)],
    ]
    frames = [rocks.createDataFrame(b, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 1000)).drop("s") for b in batches]
    _, got = run(tmp_path, escalation_stream(parts(rocks, tmp_path, frames), 60.0, "0 seconds"), "cases_live", "update")
    told = {}
    for r in got.collect():
        told.setdefault(r.id, []).append((r.status, r.by))
    assert told["a"] == [("pending", None), ("timed_out", None), ("approved", "late")]
    assert told["b"] == [("pending", None), ("rejected", "bo")] and told["c"] == [("approved", "early")]
    assert told["d"] == [("pending", None), ("timed_out", None)] and told["e"] == [("pending", None), ("approved", "ann")]
    assert told["f"] == [("pending", None), ("timed_out", None)] and told["g"] == [("pending", None)]
    log = rocks.createDataFrame([r for b in batches for r in b if r[0]], schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 1000))
    batch = {r.id: r.status for r in guards.escalation_status(log, F.timestamp_seconds(F.lit(1300)), 60.0).collect()}
    assert batch == {k: v[-1][0] for k, v in told.items()}


def test_drift_windows_equal_batch(spark, tmp_path):
    rows = [(m, d) for m, d in [(1, "Clear"), (3, "Clear"), (8, "Complex"), (12, "Chaotic"), (9, "Clear"), (14, "other"), (15, None), (26, "Clear"), (28, "Complex"), (61, "Clear"), (2, "Chaotic")]]
    frames = [spark.createDataFrame(rows[i : 10 if i == 8 else i + 4], "m int, domain string").withColumn("ts", F.timestamp_seconds(F.col("m") * 60)) for i in (0, 4, 8, 10)]
    reference = spark.createDataFrame([("Clear", 3), ("Complex", 1), ("gone", 9)], "domain string, n long")
    _, got = run(tmp_path, drift_stream(parts(spark, tmp_path, frames), "ts", "domain", reference, "10 minutes", "5 minutes", 0.1), "drift_live", "append")
    told = {r.starts.minute: (r.kl, r.drifted, r.n) for r in got.collect()}
    assert set(told) == {0, 10, 20}  # the last window is still open, minute 2 came too late
    for start in told:
        counts = spark.createDataFrame([r for r in rows[:-1] if start <= r[0] < start + 10], "m int, domain string").groupBy("domain").agg(F.count("*").alias("n"))
        want = routing.drift(counts, reference, 0.1).first()
        assert told[start] == (pytest.approx(want.kl), want.drifted, want.n)


def test_replayed_audit_batch_adds_nothing(spark, tmp_path):
    frames = [spark.createDataFrame([(f"{i}{j}", "go") for j in range(3)], "id string, action string") for i in range(3)]
    live = parts(spark, tmp_path, frames)
    trail, place = f"{tmp_path}/trail", tmp_path / "log"
    stream_audit(live, trail, str(place)).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(trail).count() == 9
    (place / "commits" / "2").unlink()  # as after a crash between writing and committing
    (place / "commits" / ".2.crc").unlink(missing_ok=True)
    again = stream_audit(live, trail, str(place)).trigger(availableNow=True).start()
    again.awaitTermination(120)
    assert [p.batchId for p in again.recentProgress if p.numInputRows] == [2]
    kept = spark.read.parquet(trail)
    assert kept.count() == 9 == kept.select("id").distinct().count() and set(kept.columns) == {"id", "action", "trail", "batch"}
