"""Packing documents into sequences of a fixed capacity.

``best_fit_placements`` packs a whole corpus at once. All a packing needs is how many
pieces there are of each length, at most ``capacity`` numbers whatever the corpus, so the
plan is made on the driver from that histogram and is a table bounded by the capacity:
large pieces (over a third) are matched greedily, two at most per bin, each with the
largest partner that still fits; the smaller ones fill the tightest remaining gap. The
executors then look each piece up by its length and its rank among pieces of that length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import arrow_limits, free_names, materialize, settled, text_slices
from plumbline.llm.vocabulary import byte_encoder

END_ID = 0


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole if they fit, else full pieces after a shorter first."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def encode_pieces(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids) with ids as little-endian unsigned 32-bit values.

    Every row of ``docs`` is encoded whole and ended by id 0 (null and empty texts: only that
    id). Documents over ``capacity`` ids are cut so that all pieces but the first are full.
    Repeated rows give repeated pieces; a null doc_id stays null; other columns are left out; an
    empty table gives an empty result. ``folder`` holds the tokenizer's files (None: the installed ones).
    """
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(folder)
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.array([*encode(text or ""), END_ID], "<u4")
                    rows += [(doc, k, s, n, ids[s : s + n].tobytes()) for k, (s, n) in enumerate(pieces_of(len(ids), capacity))]
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(settled(run), "doc_id long, piece int, start long, length long, ids binary")


def plan_bins(counts: np.ndarray) -> np.ndarray:
    """Histogram of lengths (index 0..capacity) -> segments, rows (length, first rank, bin, per bin, offset).

    Ranks from ``first rank`` on, up to the next segment of that length, go to consecutive
    bins from ``bin``, ``per bin`` in each, side by side from ``offset``.
    """
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    third = capacity // 3
    groups: list[list] = []  # [gap, bins, [(length, per bin), ...]]
    top = capacity
    for long in range(capacity, third, -1):
        while left[long]:
            top = min(capacity - long, long)
            while top > third and not left[top]:
                top -= 1
            if top <= third:
                groups.append([capacity - long, int(left[long]), [(long, 1)]])
                left[long] = 0
            elif top == long:
                if left[long] > 1:
                    groups.append([capacity - 2 * long, int(left[long] // 2), [(long, 2)]])
                left[long] %= 2
                if left[long]:
                    low = long - 1
                    while low > third and not left[low]:
                        low -= 1
                    pair = [(long, 1), (low, 1)] if low > third else [(long, 1)]
                    groups.append([capacity - sum(a for a, _ in pair), 1, pair])
                    left[long] = 0
                    if low > third:
                        left[low] -= 1
            else:
                bins = int(min(left[long], left[top]))
                groups.append([capacity - long - top, bins, [(long, 1), (top, 1)]])
                left[long] -= bins
                left[top] -= bins
    gaps: dict[int, list[list]] = {}
    for g in groups:
        gaps.setdefault(g[0], []).append(g)
    open_gaps = sorted(gaps)

    def put(g: list) -> None:
        if g[0] not in gaps or not gaps[g[0]]:
            if g[0] not in open_gaps:
                insort(open_gaps, g[0])
            gaps[g[0]] = []
        gaps[g[0]].append(g)

    for short in range(third, 0, -1):
        while left[short]:
            i = bisect_left(open_gaps, short)
            while i < len(open_gaps) and not gaps[open_gaps[i]]:
                del open_gaps[i]
            if i == len(open_gaps):
                per = capacity // short
                whole, rest = divmod(int(left[short]), per)
                if whole:
                    put([capacity - per * short, whole, [(short, per)]])
                if rest:
                    put([capacity - rest * short, 1, [(short, rest)]])
                left[short] = 0
                break
            gap = open_gaps[i]
            g = gaps[gap].pop()
            per = gap // short
            whole = min(g[1], int(left[short]) // per)
            if whole:
                put([gap - per * short, whole, [*g[2], (short, per)]])
            rest = min(int(left[short]) - whole * per, per) if whole < g[1] else 0
            if rest:
                put([gap - rest * short, 1, [*g[2], (short, rest)]])
            if g[1] - whole - (rest > 0):
                put([gap, g[1] - whole - (rest > 0), g[2]])
            left[short] -= whole * per + rest
    return segments([g[1:] for at in sorted(gaps) for g in gaps[at]], capacity)


def segments(groups: list, capacity: int) -> np.ndarray:
    """Groups of equal bins, (bins, [(length, per bin), ...]) -> rows (length, first rank, bin, per bin, offset)."""
    rank, out, bin_no = np.zeros(capacity + 1, np.int64), [], 0
    for bins, parts in groups:
        offset = 0
        for length, per in parts:
            out.append((length, rank[length], bin_no, per, offset))
            rank[length] += bins * per
            offset += length * per
        bin_no += bins
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def best_fit_placements(pieces: DataFrame, capacity: int = 2048, length_col: str = "length", tie_cols: tuple = ("doc_id", "piece"), spread: int = 0, plan: Callable[[np.ndarray], np.ndarray] = plan_bins) -> DataFrame:
    """``pieces`` with sequence_id and offset: one packing of the whole table.

    Lengths must lie in 1..capacity, else ValueError. ``pieces`` is written once to the
    shared folder, so give the columns that are wanted only. ``spread`` salts a length's
    pieces (0: twice the shuffle partitions), so that a length with most rows is ranked by
    many tasks. ``tie_cols`` order pieces of one length; rows equal in them are interchangeable,
    so they should tell apart all rows that differ. ``plan`` makes the packing from the counts
    of lengths.

    Repeated rows are packed once each; columns named sequence_id and offset are
    replaced, others may have any names; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    spread = spread or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keep = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    salt, size, n, base, other, local, rank = free_names(keep, "salt", "size", "n", "base", "other", "local", "rank")
    group = F.pmod(F.xxhash64(*tie_cols), F.lit(spread))
    table = materialize(pieces.select(*keep, F.col(length_col).cast("long").alias(size), group.cast("int").alias(salt)))
    per_salt = materialize(table.groupBy(size, salt).agg(F.count("*").alias(n)))
    totals = per_salt.groupBy(size).agg(F.sum(n)).limit(capacity + 2).collect()
    if any(k is None or not 0 < k <= capacity for k, _ in totals):
        raise ValueError(f"a piece's length lies outside 1..{capacity}")
    counts = np.zeros(capacity + 1, np.int64)
    for k, total in totals:
        counts[k] = total
    places = plan(counts)  # at most a few thousand rows for any corpus
    lengths, firsts = np.searchsorted(places[:, 0], np.arange(capacity + 2)), places[:, 1].copy()
    before = per_salt.select(size, F.col(salt).alias(other), (F.sum(n).over(Window.partitionBy(size).orderBy(salt)) - F.col(n)).alias(base))
    ranked = table.withColumn(local, F.row_number().over(Window.partitionBy(size, salt).orderBy(*tie_cols)) - 1)
    ranked = ranked.join(before.withColumnRenamed(size, n), (F.col(size) == F.col(n)) & (F.col(salt) == F.col(other)))
    schema = ranked.select(*keep, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(size).to_numpy(zero_copy_only=False)
            mine = batch.column(rank).to_numpy(zero_copy_only=False)
            at = np.zeros(len(length), np.int64)
            for k in np.unique(length):
                a, b = lengths[k], lengths[k + 1]
                here = length == k
                at[here] = a + np.searchsorted(firsts[a:b], mine[here], "right") - 1
            _, first, bin_no, per, offset = places[at].T
            over = mine - first
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(bin_no + over // per), pa.array(offset + over % per * length)], [*keep, "sequence_id", "offset"])

    return ranked.select(*keep, size, (F.col(base) + F.col(local)).cast("long").alias(rank)).mapInArrow(settled(place), schema)
