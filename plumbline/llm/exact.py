"""Exact dedup by counting quotient filters and byte verification.

A filter of fingerprints is built in every partition (``quotient``) and the filters are merged
segment by segment, which gives the exact count of each fingerprint without moving a text.
Fingerprints that occur once are settled. The others go to byte verification: a bitmap of
their leading bits, of bounded size, is tested in every scanning task, and texts that meet it
are grouped by their bytes with map-side combine, so a group of copies sends one text a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import quotient
from plumbline.llm.tables import arrow_limits, materialize, settled

#: Fingerprints that a filter takes in at most before it is handed on.
FILTER_ROWS = 1 << 21
#: The routing bitmap has 2^28 bits (32 MB) at most.
MAX_ROUTE_BITS = 28


def normalized(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _filters(prints: DataFrame, segment_bits: int) -> DataFrame:
    """(segment, filter): the counting quotient filters of each partition of ``prints`` (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def handed_on() -> pa.RecordBatch:
            found = quotient.split(*quotient.tally(np.concatenate(held)), segment_bits)
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([f for _, f in found], pa.binary())], ["segment", "filter"])

        for batch in batches:
            held.append(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            size += batch.num_rows
            if size >= FILTER_ROWS:
                yield handed_on()
                held, size = [], 0
        if size:
            yield handed_on()

    return prints.select("fp").mapInArrow(settled(run), "segment long, filter binary")


def fingerprint_counts(prints: DataFrame, segment_bits: int) -> DataFrame:
    """(segment, filter): one merged filter of each segment, over all partitions of ``prints`` (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def merged() -> pa.RecordBatch:
            data = quotient.encode(*quotient.merge(held, at), segment_bits)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([data], pa.binary())], ["segment", "filter"])

        for batch in batches:
            for segment, data in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != at and held:
                    yield merged()
                    held = []
                at = segment
                held.append(data)
        if held:
            yield merged()

    dealt = _filters(prints, segment_bits).repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(settled(run), "segment long, filter binary")


def route_bitmap(merged: DataFrame, segment_bits: int, route_bits: int) -> np.ndarray:
    """2^route_bits packed bits: which leading bits a fingerprint has that occurs more than once."""
    width = 1 << (route_bits - segment_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, data in zip(*(c.to_pylist() for c in batch.columns)):
                prints, counts = quotient.decode(data, segment)
                bits = np.zeros(width, bool)
                bits[(prints[counts > 1] >> np.uint64(64 - route_bits)).astype(np.int64) - segment * width] = True
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["segment", "bits"])

    out = np.zeros(1 << (route_bits - 3), np.uint8)
    for segment, bits in merged.mapInArrow(settled(run), "segment long, bits binary").toLocalIterator():
        out[segment * width // 8 : (segment + 1) * width // 8] = np.frombuffer(bits, np.uint8)
    return out


def routed(rows: DataFrame, bitmap: np.ndarray, route_bits: int) -> DataFrame:
    """The ``rows`` (fp, ...) whose leading bits are in the bitmap; only fp leaves the JVM for the test."""

    @F.pandas_udf("boolean")
    def met(fp: pd.Series) -> pd.Series:
        at = (fp.to_numpy().view(np.uint64) >> np.uint64(64 - route_bits)).astype(np.int64)
        return pd.Series((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    return rows.where(met("fp"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for every row of ``docs``.

    Texts are equal if their bytes are, once each run of white space is one space; null counts
    as empty, and so equals an empty text, but a text of blanks is one space. Of equal texts
    the row with the smallest doc_id stays, exactly one of them where that id repeats; one
    without an id only if none has an id (keep_id is null then). Very long texts are hashed
    and compared whole. Other columns do not matter, whatever their names. An empty table
    gives an empty result.

    Rows find their group by fingerprint and SHA-256. Groups are told apart by bytes; should
    two of them ever share both, the query fails instead of joining them.
    """
    arrow_limits(docs.sparkSession)
    text = docs.select("doc_id", normalized(F.col("text")).alias("body"))
    narrow = materialize(text.select("doc_id", F.xxhash64("body").alias("fp"), F.unhex(F.sha2("body", 256)).alias("sha"), F.monotonically_increasing_id().alias("place")))
    rows = max(narrow.count(), 1)
    segment_bits = max(6, math.ceil(math.log2(rows / FILTER_ROWS)))
    route_bits = max(16, min(MAX_ROUTE_BITS, math.ceil(math.log2(4 * rows))), segment_bits + 3)
    merged = fingerprint_counts(narrow, segment_bits)
    bitmap = route_bitmap(merged, segment_bits, route_bits)
    doubted = routed(text.select("body", F.xxhash64("body").alias("fp")), bitmap, route_bits)
    groups = doubted.groupBy("fp", "body").agg(F.count("*").alias("n")).where("n > 1")
    classes = groups.select("fp", F.unhex(F.sha2("body", 256)).alias("sha")).groupBy("fp", "sha").agg(F.count("*").alias("texts"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first")
    # copies are combined before they are shuffled, and only then meet the verified groups
    held = narrow.groupBy("fp", "sha").agg(first, F.count("*").alias("n"))
    kept = materialize(held.where("n > 1").join(classes, ["fp", "sha"]))
    found = narrow.join(kept, ["fp", "sha"], "left")
    alone = F.col("n").isNull()
    size = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share fingerprint and SHA-256")).cast("long")).otherwise(F.coalesce("n", F.lit(1)).cast("long"))
    return found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), size.alias("group_size"),
        (alone | (F.col("place") == F.col("first.place"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
