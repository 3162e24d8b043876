"""Plans that keep a large table from being shuffled by a few keys, and sums that no order of rows changes."""

import math
from fractions import Fraction

import numpy as np
import pytest

from plumbline.operators.effects import counterfactual_from_data, two_stage_ls


def test_counterfactual_does_not_deal_rows_by_group(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        df = spark.range(20_000).selectExpr("id % 3 as k", "cast(id % 2 as double) as t", "cast(id as double) as y")
        got = counterfactual_from_data(df, "t", "y", 0.0, ["k"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_weak_instruments_keep_their_digits_in_any_order_of_rows(spark):
    # in sorted rows partial sums are large and leave a covariance near zero, so running covariances lose digits
    rng = np.random.default_rng(3)
    n = 20_000
    z, t = np.sort(rng.integers(1, 51, n)), rng.integers(90_000, 10_500_000, n)
    y = t * rng.integers(90, 101, n)
    zc = z - z.mean()
    slope = (zc * t).sum() / (zc * zc).sum()
    t = t - np.rint(0.998 * slope * zc).astype(np.int64)  # a correlation of about 1e-5 is left
    rows = [(float(a), int(b) / 100, int(c) / 10_000) for a, b, c in zip(z, t, y)]
    exact = [[Fraction(v) for v in c] for c in zip(*rows)]
    co = lambda a, b: sum(p * q for p, q in zip(a, b)) - sum(a) * sum(b) / n
    zz, zt, zy, yy = co(exact[0], exact[0]), co(exact[0], exact[1]), co(exact[0], exact[2]), co(exact[2], exact[2])
    want = float(zy / zt), math.sqrt((yy - zy * zy / zz) / (n - 2) / (zt * zt / zz))
    for order in (range(n), np.argsort(t)):
        for parts in (1, 7):
            df = spark.createDataFrame([rows[i] for i in order], "z double, t double, y double").coalesce(parts)
            got = two_stage_ls(df, "t", "y", ["z"]).first()
            assert got[:2] == pytest.approx(want, rel=1e-11)
