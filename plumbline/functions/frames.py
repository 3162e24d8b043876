"""Helper columns that meet no column of a table, and joins that lose no null key."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores in front until no column, in any case of letters, has them."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, where a null key meets a null key; the keys stay once, as the left side has them."""
    names = free_names([*left.columns, *right.columns], *(f"right_{k}" for k in keys))
    other = right.withColumnsRenamed(dict(zip(keys, names)))
    return left.join(other, reduce(and_, (left[k].eqNullSafe(other[n]) for k, n in zip(keys, names))), how).drop(*names)
