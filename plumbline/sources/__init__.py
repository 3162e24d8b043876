"""Tables in, audit trails and checkpoints out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def append_audit(entries: DataFrame, path: str) -> None:
    """Append entries to a trail; nothing written is changed again."""
    entries.write.mode("append").parquet(path)


def stream_audit(entries: DataFrame, path: str, checkpoint: str, trail: str = "trail") -> DataStreamWriter:
    """A writer, to be started, that appends a stream of entries to a trail with each row once.

    A micro-batch goes to a folder that its number names and takes the place of whatever is
    there, so a batch that is run again after a crash, in whole or in part, adds nothing.
    ``trail`` tells apart several streams into one path: each needs its own, with one
    ``checkpoint`` for its whole life. Readers see trail and batch as columns.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/trail={trail}/batch={number}")

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def audit_json(entries: DataFrame) -> DataFrame:
    """(json), a JSON object an entry: written as text this is a line-delimited log."""
    return entries.select(F.to_json(F.struct(*entries.columns)).alias("json"))
