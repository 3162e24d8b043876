"""Sequential refuters over more rows than a bucket and more draws than a chunk, and what they shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import refuters
from plumbline.operators.refuters import BUCKET, CHUNK, draws_at, draws_from, left_out_positions


def shuffled_records(spark, work):
    """The result of the given work, and the most records that one of its stages shuffled."""
    sc = spark.sparkContext
    status = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    listed = lambda found: [found.apply(i) for i in range(found.size())]
    stages = lambda: listed(status())
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    before = {s.stageId() for s in stages()}
    got = work()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return got, max(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)


@pytest.mark.parametrize(("place", "many"), [(0, 0), (0, 1), (0, 1000), (12345, 777), (2**40, 9)])
def test_draws_from_a_place(place, many):
    assert (draws_from(789, place, many) == draws_at(789, place + np.arange(many))).all()


def test_left_out_over_buckets_and_chunks(spark):
    n, size = CHUNK + 200_000, CHUNK + 100_000
    got = {}
    for r in left_out_positions(spark, 456, 2, n, size).collect():
        got.setdefault(r.rep, []).append(r.bucket * BUCKET + np.frombuffer(r["at"], np.uint32).astype(np.int64))
    for rep in range(2):
        items, i = list(range(n)), np.arange(size)
        steps = i + (draws_at(456, rep * size + i) * (n - i)).astype(np.int64) % (n - i)
        for i, j in enumerate(steps.tolist()):
            items[i], items[j] = items[j], items[i]
        assert np.array_equal(np.sort(np.concatenate(got[rep])), np.sort(items[size:]))


@pytest.fixture(scope="module")
def units(spark):
    return spark.range(2 * BUCKET + 5).selectExpr("id", "cast(id % 3 = 0 as double) as t", "cast(pmod(id * 7919, 1009) as double) as y").repartition(7)


def effect(t, y, w):
    return np.average(y[t], weights=w[t]) - np.average(y[~t], weights=w[~t])


def test_sequential_tests_shuffle_no_row_a_draw(spark, units):
    n = 2 * BUCKET + 5
    i = np.arange(n)
    t, y = i % 3 == 0, (i * 7919 % 1009).astype(float)
    got, records = shuffled_records(spark, lambda: refuters.bootstrap_sequential(units, "t", "y", 0.3, ["id"], 4).first())
    want = [effect(t, y, np.bincount((draws_at(789, r * n + i) * n).astype(np.int64) % n, minlength=n)) for r in range(4)]
    assert got.refuted_effect == pytest.approx(np.mean(want)) and records <= 1.1 * n
    got, records = shuffled_records(spark, lambda: refuters.subset_sequential(units, "t", "y", 0.3, ["id"], 0.8, 4).first())
    taken = refuters.shuffled_prefix(spark, 456, 4, n, int(n * 0.8)).withColumns({"t": F.col("position") % 3 == 0, "y": F.pmod(F.col("position") * 7919, F.lit(1009))})
    rows = taken.groupBy("rep").agg(F.avg(F.when(F.col("t"), F.col("y"))).alias("a"), F.avg(F.when(~F.col("t"), F.col("y"))).alias("b"), F.count("*").alias("n")).collect()
    assert {r.n for r in rows} == {int(n * 0.8)} and got.refuted_effect == pytest.approx(np.mean([r.a - r.b for r in rows])) and records <= 1.1 * n


def test_a_row_without_weight_does_not_count(spark):
    n = 40
    out = [b"".join(r["at"] for r in left_out_positions(spark, 456, 1, n, 32).collect())]
    absent = int(np.frombuffer(out[0], np.uint32)[0])
    df = spark.range(n).withColumns({"t": (F.col("id") % 2).cast("double"), "y": F.when(F.col("id") == absent, F.lit(float("inf"))).otherwise(F.col("id").cast("double"))})
    assert np.isfinite(refuters.subset_sequential(df, "t", "y", 0.3, ["id"], 0.8, 1).first().refuted_effect)
