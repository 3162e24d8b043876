"""Every registered decision query against its DuckDB SQL, and streams against batches."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline import catalog
from plumbline.operators import beliefs, guards
from plumbline.sources import append_audit, audit_json
from plumbline.streaming import beta_stream, dirichlet_stream, domain_counts, gamma_stream, normal_stream, rate_limit_stream, track_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "events", "orders", "customer", "supplier", "nation", "region", "documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(map(tuple, df.select(*names).collect()), key=repr)
    if name not in catalog.oracle_sql():
        assert got
        return
    quoted = ", ".join(f'"{n}"' for n in names)
    want = sorted(con.execute(f"SELECT {quoted} FROM ({catalog.oracle_sql()[name]})").fetchall(), key=repr)
    assert len(got) == len(want) and all(close(a, b) for r, s in zip(got, want) for a, b in zip(r, s))


def streamed(spark, tmp_path, query, mode):
    name = f"s{abs(hash(str(tmp_path)))}"
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def events_stream(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(1).write.mode("overwrite").parquet(f"{tmp_path}/in")
    return batch, spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")


def test_beta_stream_equals_batch(spark, tmp_path):
    batch, stream = events_stream(spark, tmp_path)
    ok = F.col("event_type") != "error"
    got = streamed(spark, tmp_path / "c", beta_stream(stream, ok, ["user_id"]), "complete")
    assert got.exceptAll(beta_stream(batch, ok, ["user_id"])).isEmpty() and got.count() == batch.select("user_id").distinct().count()


def test_windowed_counts_equal_batch(spark, tmp_path):
    batch, stream = events_stream(spark, tmp_path)
    got = streamed(spark, tmp_path / "c", domain_counts(stream, "ts", "event_type", "1 day", "1 hour"), "complete")
    assert got.agg(F.sum("n")).first()[0] == batch.count()


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    batch, stream = events_stream(spark, tmp_path)
    got = streamed(spark, tmp_path / "c", rate_limit_stream(stream, "user_id", "ts", "event_id", 3, 0.00002), "append")
    want = guards.rate_limit(batch, "user_id", "ts", ["ts", "event_id"], 3, 0.00002).select("user_id", "event_id", "allowed")
    assert got.exceptAll(want).isEmpty() and got.count() == batch.count()


def test_other_belief_streams_equal_batches(spark, tmp_path):
    batch, stream = events_stream(spark, tmp_path)
    kinds = ["click", "view"]
    forms = [
        (normal_stream(stream, "value", ["user_id"]), beliefs.normal_posterior(batch, "value", ["user_id"])),
        (gamma_stream(stream, "event_id", ["event_type"]), beliefs.gamma_posterior(batch, "event_id", ["event_type"])),
        (dirichlet_stream(stream, "event_type", ["user_id"], kinds), beliefs.dirichlet_posterior(batch, "event_type", ["user_id"], kinds)),
    ]
    observed = lambda df: df.select(F.col("user_id").cast("string").alias("entity"), F.when(F.col("event_type") == "error", "binary").otherwise("categorical").alias("kind"), F.array(F.lit(1), (F.col("event_id") % 3).cast("int")).cast("array<long>").alias("counts"))
    forms.append((track_stream(observed(stream), "categorical", prior=[1.0, 1.0]), beliefs.track(observed(batch), "categorical", prior=[1.0, 1.0])))
    for i, (live, want) in enumerate(forms):
        place = tmp_path / f"c{i}"
        q = live.writeStream.format("memory").queryName(f"belief{i}").outputMode("complete").option("checkpointLocation", str(place)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted(map(tuple, spark.table(f"belief{i}").collect()), key=repr)
        want = sorted(map(tuple, want.collect()), key=repr)
        assert len(got) == len(want) and all(a == b or close(a, b) for r, s in zip(got, want) for a, b in zip(r, s))


def test_rate_limit_state_ends_when_full(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:00:01"), (3, "b", "2024-01-01 00:00:02"), (4, "a", "2024-01-02 00:00:00"), (5, "a", "2024-01-02 00:00:01"), (6, "a", "2024-01-02 00:00:01")]
    source = str(tmp_path / "in")
    for batch in (rows[:3], rows[3:]):
        spark.createDataFrame(batch, "id int, k string, ts string").coalesce(1).write.mode("append").parquet(source)
    live = spark.readStream.schema("id int, k string, ts string").option("maxFilesPerTrigger", 1).parquet(source)
    got = streamed(spark, tmp_path / "c", rate_limit_stream(live, "k", "ts", "id", 2, 0.5, late="1 hour"), "append")
    assert {r.id: r.allowed for r in got.collect()} == {1: True, 2: True, 3: True, 4: True, 5: True, 6: False}


def test_audit_trail_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([("1", "act", "approve")], "id string, action string, decision string")
    for _ in range(2):
        append_audit(entries, f"{tmp_path}/trail")
    assert spark.read.parquet(f"{tmp_path}/trail").count() == 2
    assert audit_json(entries).first()[0] == '{"id":"1","action":"act","decision":"approve"}'
