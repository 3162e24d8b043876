"""Token ids as packed binary matrices, by best-fit-decreasing with a segment tree.

Documents over the capacity are cut into pieces without loss. All the packing needs is how
many pieces there are of each length, so one packing of the whole table is planned on the
driver from that histogram, bounded by the capacity: longest first, each piece goes into the
open sequence with the least room that still fits, found in a segment tree over capacities.
Equal sequences are kept as one group, so the plan is that of placing pieces one by one. The
executors look up each piece's place by its length and rank and gather the sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.packing import best_fit_placements, segments
from plumbline.llm.tables import arrow_limits, materialize, settled, text_slices
from plumbline.llm.vocabulary import byte_encoder

END_ID = 50256
#: Pieces of one length are ranked in so many groups by hash, at every size.
SPREAD = 256
#: Texts whose ids say which are frequent.
RANKED_TEXTS = 1000


class CapacityTree:
    """Groups of sequences by their room; ``tightest`` finds the least room that is enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.live = bytearray(2 * self.size)
        self.groups: dict[int, list] = {}

    def add(self, room: int, group) -> None:
        self.groups.setdefault(room, []).append(group)
        at = room + self.size
        while at and not self.live[at]:
            self.live[at] = 1
            at >>= 1

    def tightest(self, need: int) -> int:
        """The least room >= need that a group has, or -1."""
        at = need + self.size
        if self.live[at]:
            return need
        while at > 1:
            if not at & 1 and self.live[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.live[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1

    def take(self, room: int):
        mine = self.groups[room]
        group = mine.pop()
        if not mine:
            at = room + self.size
            self.live[at] = 0
            at >>= 1
            while at:
                self.live[at] = self.live[2 * at] | self.live[2 * at + 1]
                at >>= 1
        return group


def plan_decreasing(counts: np.ndarray) -> np.ndarray:
    """Histogram of lengths (index 0..capacity) -> segments, as best-fit-decreasing places piece after piece.

    A piece that leaves room for another of its length makes its sequence the tightest for
    that one, so a sequence takes as many as it holds before the next of its group.
    """
    capacity = len(counts) - 1
    tree = CapacityTree(capacity)
    for n in range(capacity, 0, -1):
        left = int(counts[n])
        while left:
            room = tree.tightest(n)
            bins, parts = tree.take(room) if room >= 0 else (left, [])
            per = (room if room >= 0 else capacity) // n
            whole = min(bins, left // per)
            rest = left - whole * per if whole < bins else 0
            rest = min(rest, per)
            for many, each in ((whole, per), (1, rest)):
                if many and each:
                    tree.add((room if room >= 0 else capacity) - each * n, (many, [*parts, (n, each)]))
            if room >= 0 and bins > whole + (rest > 0):
                tree.add(room, (bins - whole - (rest > 0), parts))
            left -= whole * per + rest
    return segments([g for room in sorted(tree.groups) for g in tree.groups[room]], capacity)


def rank_table(docs: DataFrame, text_col: str, folder: str | None, texts: int = RANKED_TEXTS) -> np.ndarray:
    """The 16-bit ids in the order of their frequency in about ``texts`` texts, chosen by chance.

    Ids travel as places in this order, which compress better; any order of all of them would give the same
    result, so the sample decides bytes only.
    """
    share = min(texts / max(docs.count(), 1), 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = byte_encoder(folder), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    total += np.bincount(np.array(encode(text or ""), np.int64), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    seen = docs.select(F.col(text_col).alias("text")).sample(share, seed=1).mapInArrow(settled(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    total = np.zeros(1 << 16, np.int64)
    for at, n in seen.collect():
        total[at] = n
    return np.argsort(-total, kind="stable").astype("<u2")


def _shrunk(ids: np.ndarray, place: np.ndarray) -> bytes:
    """16-bit ids as places, all low bytes before all high ones, compressed: they are written once and shuffled twice."""
    return pa.compress(place[ids].view(np.uint8).reshape(-1, 2).T.tobytes(), codec="zstd", asbytes=True)


def _grown(data: bytes, n: int, order: np.ndarray) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 2 * n, codec="zstd", asbytes=True), np.uint8)
    return order[np.ascontiguousarray(planes.reshape(2, n).T).view("<u2").ravel()]


def encode_cut(docs: DataFrame, capacity: int, end_id: int, id_col: str, text_col: str, folder: str | None, order: np.ndarray) -> DataFrame:
    """(doc_id, start, length, ids, digest): every document whole, ended by ``end_id``, in pieces of ``capacity`` but for the last.

    ``ids`` is compressed (``order``: see ``rank_table``), ``digest`` a hash of what it holds.
    """
    place = np.argsort(order).astype("<u2")
    names, kinds = ["doc_id", "start", "length", "ids", "digest"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(folder)
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.array([*encode(text or ""), end_id], "<u2")
                    for s in range(0, len(ids), capacity):
                        own = ids[s : s + capacity]
                        rows.append((doc, s, len(own), _shrunk(own, place), xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(settled(run), "doc_id long, start long, length long, ids binary, digest long")


def _rows_of(capacity: int, end_id: int, order: np.ndarray):
    """Gathered pieces, in order of offset -> rows of the id matrix and how to take them apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("s")
            at, own = held.offsets.to_numpy(), held.values
            offset, length = (own.field(c).to_numpy() for c in ("offset", "length"))
            matrix = np.full((batch.num_rows, capacity), end_id, "<u2")
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            for r, o, n, data in zip(row, offset[at[0] : at[-1]], length[at[0] : at[-1]], own.field("ids")[int(at[0]) : int(at[-1])].to_pylist()):
                matrix[r, o : o + n] = _grown(data, n, order)
            spans = [(a, b) for a, b in zip(at, at[1:])]
            ends = [(offset[a:b] + length[a:b]).astype(np.int32) for a, b in spans]
            lists = lambda parts, kind: pa.array([p.tolist() for p in parts], pa.list_(kind))
            doc, start = own.field("doc_id"), own.field("start").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("sequence_id"), pa.array([int(e[-1]) for e in ends], pa.int32()), pa.array([m.tobytes() for m in matrix], pa.binary()),
                    lists([np.concatenate(([0], e)) for e in ends], pa.int32()), lists([offset[a:b] for a, b in spans], pa.int32()),
                    pa.array([doc[int(a) : int(b)].to_pylist() for a, b in spans], pa.list_(pa.int64())), lists([start[a:b] for a, b in spans], pa.int64()),
                ],
                ["sequence_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "starts"],
            )

    return run


def pack_token_ids(docs: DataFrame, capacity: int = 2048, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Packed sequences, a row each: a row of the id matrix and how to take it apart.

    (sequence_id, n_tokens, ids, cu_seqlens, position_resets, doc_ids, starts). ``ids`` is
    ``capacity`` little-endian unsigned 16-bit ids, filled up with ``end_id``; segment k is
    ids[cu_seqlens[k]:cu_seqlens[k + 1]] and holds the tokens of document doc_ids[k] from
    starts[k] on; position ids restart at 0 at each of position_resets. Sequences are numbered
    from 0 without gaps. The rows depend on what ``docs`` holds only, not on its partitions or
    the session: pieces of one length are ranked by id, start and content.

    Every row of ``docs`` is encoded whole and ended by ``end_id`` (null and empty texts: only
    that; very long ones are cut into many pieces), so each has at least one segment, repeated
    rows and null ids included. Other columns do not matter, whatever their names. An empty
    table gives an empty result.
    """
    arrow_limits(docs.sparkSession)
    order = rank_table(docs, text_col, folder)
    pieces = materialize(encode_cut(docs, capacity, end_id, id_col, text_col, folder, order).withColumn("key", F.monotonically_increasing_id()))
    ties = ("doc_id", "start", "length", "digest")
    # ranked without their ids, which are joined once; ``key`` holds for this writing of the pieces
    placed = best_fit_placements(pieces.select(*ties, "key"), capacity, tie_cols=ties, spread=SPREAD, plan=plan_decreasing)
    entry = F.struct("offset", "doc_id", "start", "length", "ids")

    def met(test: Column) -> DataFrame:
        return placed.where(test).select("key", "sequence_id", "offset").join(pieces.where(test).drop("digest"), "key")

    # a piece as long as a sequence is one and is not gathered; of others a sequence has ``capacity`` at most
    alone = met(F.col("length") == capacity).select("sequence_id", F.array(entry).alias("s"))
    rows = alone.unionByName(met(F.col("length") < capacity).groupBy("sequence_id").agg(F.sort_array(F.collect_list(entry)).alias("s")))
    schema = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>"
    return rows.mapInArrow(settled(_rows_of(capacity, end_id, order)), schema)


def write_packed(packed: DataFrame, path: str) -> DataFrame:
    """Write packed sequences as Parquet, a matrix row, its lengths and resets a record; returns what was written.

    Null doc_ids stay null; an empty table is written as one. ``path`` must not exist yet.
    """
    packed.write.option("compression", "zstd").parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)


def unpack_documents(packed: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of each segment: the way back, with ids as array<int>.

    A row a segment, so a document over the capacity has several, told apart by start; null ids
    and repeated rows come back as they went in. Fill is no segment. Further columns do not
    matter; an empty table gives an empty result.
    """
    segments = packed.select("ids", F.explode(F.arrays_zip("doc_ids", "starts", F.slice("cu_seqlens", F.lit(1), F.size("doc_ids")).alias("a"), F.slice("cu_seqlens", F.lit(2), F.size("doc_ids")).alias("b"))).alias("s"))
    pieces = segments.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.starts").alias("start"), F.hex(F.expr("substring(ids, 2 * s.a + 1, 2 * (s.b - s.a))")).alias("h"))
    ids = F.expr("transform(sequence(0, int(length(h) / 4) - 1), i -> int(conv(concat(substring(h, 4 * i + 3, 2), substring(h, 4 * i + 1, 2)), 16, 10)))")
    return pieces.select("doc_id", "start", ids.alias("ids"))
