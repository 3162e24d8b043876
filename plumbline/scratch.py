"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession

_PREFIX = "plumbline-"
#: Bytes of a compressed table, as the planner sees it, up to which a join may gather it on the driver.
GATHERED = 1 << 16
#: Tables not yet removed: path -> (file system, JVM path), which outlive the session.
_live: dict[str, tuple] = {}
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this process, in local mode only.

    A cluster's executors do not see the driver's disk, so there the setting must be given:
    else RuntimeError. The session's settings are not changed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix=_PREFIX))
    return f"file://{_own[0]}"


def new_table(spark: SparkSession) -> str:
    """A path in the shared folder for a table to be written, which ``release`` and the process's end remove."""
    path = f"{shared_folder(spark)}/{_PREFIX}{uuid.uuid4().hex}"
    _live[path] = _path(spark, path)
    return path


def _path(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def commit_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place and renamed."""
    system, target = _path(spark, path)
    _, draft = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = system.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    system.delete(target, False)
    if not system.rename(draft, target):
        raise OSError(f"{path} could not be committed")


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    system, target = _path(spark, folder)
    return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    system, target = _path(spark, path)
    system.delete(target, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage (a lost executor costs no recomputation) and gives the planner
    true sizes. ``release`` removes the table; what is left goes when the process ends.
    """
    path = new_table(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` that broadcasts a side only if it is small in memory too.

    The planner takes a compressed table's bytes for its size, so a table below the session's
    limit (10 MB) can take much more in the broadcast that the driver gathers: 289 MB for node
    names and their edges at 60 x sf0.1. Here a side that the planner puts above ``GATHERED``
    bytes is not broadcast; the session's own limit holds as well.
    """
    return _ungathered(left).join(_ungathered(right), on, how)


def _ungathered(df: DataFrame) -> DataFrame:
    plan = df._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes() <= GATHERED:
        return df
    jvm = df.sparkSession._jvm
    plans = jvm.org.apache.spark.sql.catalyst.plans.logical
    # no alias of DataFrame.hint gives this one; "merge" would keep a small other side from being broadcast as well
    never = jvm.org.apache.spark.util.Utils.classForName("org.apache.spark.sql.catalyst.plans.logical.NO_BROADCAST_HASH$", True, False).getField("MODULE$").get(None)
    hinted = plans.ResolvedHint(plan, plans.HintInfo(jvm.scala.Some(never)))
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(df._jdf.sparkSession(), hinted), df.sparkSession)


def _tables_of(df: DataFrame) -> set[str]:
    """The intermediate tables that a plan scans, by name. Asks the plan for the folders of its scans, not for files."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            out.update(roots.apply(k).getName() for k in range(roots.size()))
    return {name for name in out if name.startswith(_PREFIX)}


def release(*tables: DataFrame, keep: Iterable[DataFrame] = ()) -> None:
    """Delete the intermediate tables that the plans of ``tables`` read, but for those that ``keep`` reads.

    Call it once a result has been written or collected. Only tables of these plans go, so
    queries that run beside each other do not meet.
    """
    gone = set().union(*map(_tables_of, tables)) - set().union(*map(_tables_of, keep))
    for path in [p for p in list(_live) if p.rsplit("/", 1)[1] in gone]:
        system, target = _live.pop(path)
        system.delete(target, True)


@atexit.register
def _at_exit() -> None:
    for system, target in list(_live.values()):
        with contextlib.suppress(Exception):  # the JVM may be gone; the folder's owner cleans up
            system.delete(target, True)
    for folder in _own:
        shutil.rmtree(folder, ignore_errors=True)
