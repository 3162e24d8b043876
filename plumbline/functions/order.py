"""Order over whole tables without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import free_names
from plumbline.scratch import materialize


def ranges(df: DataFrame, order: Sequence[str], name: str = "range") -> DataFrame:
    """``df`` dealt into ranges of ``order`` (null first), numbered by ``name``, and written once.

    The ranges are sampled, so they hold only for what was written.
    """
    return materialize(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def running_total(df: DataFrame, value: Column, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each one, in ``order`` (columns without ties, null first).

    A total of sums per range and a sum within the range: no task holds more than a range, and
    what is broadcast has one row a range.
    """
    at, own, before = free_names([*df.columns, name], "range", "own", "before")
    dealt = ranges(df.withColumn(name, value), order, at)
    sums = dealt.groupBy(at).agg(F.sum(name).alias(own))
    earlier = sums.select(at, (F.sum(own).over(Window.orderBy(at)) - F.col(own)).alias(before))
    inside = F.sum(name).over(Window.partitionBy(at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(name, inside).join(F.broadcast(earlier), at).withColumn(name, F.col(name) + F.col(before)).drop(at, before)


def numbered(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """``df`` with each row's place in ``order``, from 0 without gaps.

    Rows are dealt into ranges, sorted and counted where they lie, and written once; what is
    broadcast has one row a range.
    """
    at, own, before = free_names([*df.columns, name], "range", "own", "before")
    dealt = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())).withColumn(at, F.shiftright(name, 33))
    sums = dealt.groupBy(at).agg(F.count("*").alias(own))
    earlier = sums.select(at, (F.sum(own).over(Window.orderBy(at)) - F.col(own)).alias(before))
    return dealt.join(F.broadcast(earlier), at).withColumn(name, F.col(name).bitwiseAND(2**33 - 1) + F.col(before)).drop(at, before)


def epochs(df: DataFrame, keys: Sequence[str], order: Sequence[str], reset: Column, name: str = "epoch") -> DataFrame:
    """``df`` without the rows at which ``reset`` holds, and with the number of resets of their key before each other row.

    Operators that keep state by key (budgets, limits, breakers, loops, beliefs) start anew at
    a reset when they are given ``name`` as a further key.
    """
    (at,) = free_names([*df.columns, name], "reset")
    marked = df.withColumn(at, F.coalesce(reset, F.lit(False)))
    count = F.sum(F.col(at).cast("long")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(name, count).where(~F.col(at)).drop(at)
