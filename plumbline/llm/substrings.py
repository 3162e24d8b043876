"""Substring dedup by relative Lempel-Ziv parsing against indexed blocks.

The reference of a document are the texts of all documents with smaller ids. What makes the
parse a shuffle instead of a scan of all pairs are anchors: of the ``window`` consecutive
words of a window, the anchor is the ``gram``-word sequence with the least hash (the leftmost
if equal). It depends on the window's words alone, so equal windows have equal anchors.
Consecutive windows with one anchor position form a block, one row.

1. Each document becomes its blocks: anchor, hash of the whole block, place.
2. Anchors met in one document only are dropped; that is most of the corpus.
3. Indexed blocks: each distinct (anchor, block) with its first place, that is document and
   word, by an aggregate that combines before the shuffle. A block that a smaller document
   holds is wholly part of a factor. Blocks whose anchor has several different blocks lie at
   the ends of factors, where the neighbouring words differ.
4. At those factor boundaries, and only there, the parse goes on window by window, through an
   index of the same kind, so that a factor ends exactly where the last equal window does.
5. Each document is parsed greedily from its first word on. Matches at successive words of
   one reference are one run; at each word the run that reaches furthest becomes the next
   factor, a range of words with the place in the reference that they equal. As every run
   holds a window, it has at least ``window`` words. Factors are cut out.

No step makes pairs of documents: rows are counted in blocks and boundary windows. Blocks and
windows are told apart by two independent 64-bit hashes of their words, within a 64-bit
anchor group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import arrow_limits, join_words, materialize, mix64, release, row_of, settled, split_words, text_slices

#: Odd, so they have an inverse modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, base, np.uint64)
    down = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class _Hashes:
    """Rolling hashes over the flat words of a slice of documents; ``salt`` 0 or 1 gives independent ones."""

    def __init__(self, coded: pa.DictionaryArray, salt: int):
        own = np.array([xxhash.xxh3_64_intdigest(w, salt) for w in coded.dictionary.to_pylist()], np.uint64)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        up, self.down = _powers(_BASES[salt], len(codes))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own[codes] * up[: len(codes)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the words start..end-1."""
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the leftmost least of values[i : i + width]."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        span += step
    return at


def _windows(offsets: np.ndarray, window: int) -> np.ndarray:
    """Flat places at which a whole window starts."""
    n = np.maximum(np.diff(offsets) - window + 1, 0)
    return np.repeat(offsets[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _blocks(offsets: np.ndarray, words: pa.Array, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, block, proof, start, size) of each block: ``size`` windows, the first at word ``start``."""
    if len(words) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.uint64, np.int64, np.int64))
    coded = words.dictionary_encode()
    h = _Hashes(coded, 0)
    places = np.arange(len(words) - gram + 1)
    grams = h.of(places, places + gram)
    starts = _windows(offsets, window)
    anchor = _least(grams, window - gram + 1)[starts]
    row = row_of(offsets)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(starts)))
    begin, at, row = starts[first], anchor[first], row[first]
    end = begin + size + window - 1
    block = mix64(h.of(begin, end) ^ mix64(((at - begin) * (window + 1) + size).astype(np.uint64)))
    return row, grams[at], block, _Hashes(coded, 1).of(begin, end), begin - offsets[row], size


def _block_table(docs: DataFrame, window: int, gram: int) -> DataFrame:
    schema = "doc_id long, text_key long, anchor long, block long, proof long, start int, size int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                row, anchor, block, proof, start, size = _blocks(*split_words(part.column("text")), window, gram)
                ids = [part.column(c).take(pa.array(row)) for c in ("doc_id", "text_key")]
                rest = [anchor.view(np.int64), block.view(np.int64), proof.view(np.int64), start.astype(np.int32), size.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, rest)], ["doc_id", "text_key", "anchor", "block", "proof", "start", "size"])

    return docs.where("doc_id is not null").mapInArrow(settled(run), schema)


def _ragged(column: pa.Array, field: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a field of an array<struct> column; null rows are empty."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column)
    return np.concatenate(([0], np.cumsum(counts))), pc.struct_field(flat, [field]).to_numpy(zero_copy_only=False)


def _boundary_table(docs: DataFrame, ends: DataFrame, window: int) -> DataFrame:
    """The windows of the blocks in ``ends``, one row each."""
    schema = "doc_id long, text_key long, anchor long, block long, proof long, start int"
    lists = ends.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "start", "size")).alias("blocks"))
    once = docs.join(lists, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                offsets, words = split_words(part.column("text"))
                coded = words.dictionary_encode()
                cuts, start = _ragged(part.column("blocks"), 1)
                _, anchor = _ragged(part.column("blocks"), 0)
                _, size = _ragged(part.column("blocks"), 2)
                block = np.repeat(np.arange(len(size)), size)
                at = start[block] + np.arange(len(block)) - (np.cumsum(size) - size)[block]
                row = row_of(cuts)[block]
                win, proof = (_Hashes(coded, salt).of(offsets[row] + at, offsets[row] + at + window).view(np.int64) for salt in (0, 1))
                ids = [part.column(c).take(pa.array(row)) for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, (anchor[block], win, proof, at.astype(np.int32)))], ["doc_id", "text_key", "anchor", "block", "proof", "start"])

    return once.mapInArrow(settled(run), schema)


def _index(parts: DataFrame) -> DataFrame:
    """Each distinct block or window of several places, with its first place and the largest document."""
    place = F.struct("doc_id", "text_key", "start")
    return parts.groupBy("anchor", "block", "proof").agg(F.min(place).alias("first"), F.max("doc_id").alias("last_doc"))


def matches(docs: DataFrame, window: int = 50, gram: int = 12) -> DataFrame:
    """(doc_id, text_key, found): per text with repeats, its matched stretches of windows.

    ``found`` has the first word, the number of windows, and the first place they have in a
    document with a smaller id: ref_doc, ref_key, ref_start. ``docs`` has doc_id, text and
    text_key (``xxhash64(text)``, which tells rows with one doc_id apart).
    """
    blocks = materialize(_block_table(docs, window, gram))
    # each aggregate is written before it is joined, so that the joins are plain shuffled ones
    # whose hot partitions adaptive execution can split
    met = materialize(blocks.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("anchor"))
    shared = materialize(blocks.join(met, "anchor"))
    release(blocks, met)
    index = materialize(_index(shared))
    several = materialize(index.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.lit(True).alias("several")))
    wanted = materialize(index.join(several, "anchor", "left").where("several or first.doc_id <> last_doc"))
    release(index, several)
    ref = ["first.doc_id as ref_doc", "first.text_key as ref_key", "first.start as ref_start"]
    parsed = materialize(shared.join(wanted, ["anchor", "block", "proof"]).where("doc_id > first.doc_id or several").selectExpr("doc_id", "text_key", "anchor", "start", "size", *ref, "doc_id > first.doc_id as whole"))
    release(shared, wanted)
    windows = materialize(_boundary_table(docs, parsed.where("not whole").select("doc_id", "text_key", "anchor", "start", "size").distinct(), window))
    first = materialize(_index(windows).where("first.doc_id <> last_doc").drop("last_doc"))
    late = windows.join(first, ["anchor", "block", "proof"]).selectExpr("doc_id", "text_key", "start", "1 as size", *ref).where("doc_id > ref_doc")
    found = parsed.where("whole").select(*late.columns).unionByName(late)
    out = materialize(found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "size", "ref_doc", "ref_key", "ref_start")).alias("found")))
    release(parsed, windows, first)
    return out


def _runs(row: np.ndarray, start: np.ndarray, size: np.ndarray, ref: np.ndarray, key: np.ndarray, ref_start: np.ndarray, window: int) -> list[np.ndarray]:
    """Matches at successive words of one reference, joined: row, first and end word, ref, ref's first word; by row and first word."""
    line = start - ref_start
    order = np.lexsort((start, line, key, ref, row))
    row, start, size, ref, key, ref_start, line = (x[order] for x in (row, start, size, ref, key, ref_start, line))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (ref[1:] != ref[:-1]) | (key[1:] != key[:-1]) | (line[1:] != line[:-1]) | (start[1:] != start[:-1] + size[:-1])
    first = np.flatnonzero(new)
    last = np.append(first, len(row))[1:] - 1
    out = [row[first], start[first], start[last] + size[last] + window - 1, ref[first], ref_start[first]]
    order = np.lexsort((out[1], out[0]))
    return [x[order] for x in out]


def parse(runs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """The greedy factors (row, start, end, ref_doc, ref_start): at each word the run that reaches furthest."""
    out = []
    row, start, end, ref, ref_start = (x.tolist() for x in runs)
    cuts = [0, *(np.flatnonzero(np.diff(runs[0])) + 1).tolist(), len(row)] if row else []
    for i, stop in zip(cuts, cuts[1:]):
        best, at = i, 0
        while i < stop or end[best] > at:
            while i < stop and start[i] <= at:
                best = i if end[i] > end[best] else best
                i += 1
            if start[best] <= at < end[best]:
                out.append((row[best], at, end[best], ref[best], ref_start[best] + at - start[best]))
                at = end[best]
            elif i < stop:
                best, at = i, start[i]
    return out


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 12, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept_text, factors) for every row of ``docs``; ``carry``: further string columns.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; null and empty texts have none. A word is
    removed if a window of ``window`` words covers it whose word sequence also starts in a
    document with a smaller id; windows are judged on the input. ``kept_text`` is the rest,
    joined by one space; ``factors`` the removed ranges (start, end, ref_doc, ref_start), end
    exclusive and disjoint: their words are those of ref_doc from its word ref_start on.

    Repeated rows: rows with one id never repeat each other, and each gets its own result; a
    reference to such an id is to one of its rows. Ties between places in one document take the
    first. Rows without an id are kept whole and are no reference. A very long text is parsed
    whole, in the task of its row; what it shares is joined block by block. Other columns do not matter,
    whatever their names. An empty table gives an empty result.
    """
    arrow_limits(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("text_key"), *(F.col(c).cast("string").alias(f"_{c}") for c in carry))
    found = matches(docs.select("doc_id", "text", "text_key"), window, gram)
    schema = "".join(f"`{c}` string, " for c in carry) + "doc_id long, text string, n_words long, n_removed long, kept_text string, factors array<struct<start:int,end:int,ref_doc:long,ref_start:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                offsets, words = split_words(part.column("text"))
                cuts, start = _ragged(part.column("found"), 0)
                size, ref, key, ref_start = (_ragged(part.column("found"), k)[1] for k in range(1, 5))
                factors = parse(_runs(row_of(cuts), start, size, ref, key, ref_start, window))
                row, begin, end, ref, ref_start = np.array(factors, np.int64).reshape(-1, 5).T
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, offsets[row] + begin, 1)
                np.add.at(edge, offsets[row] + end, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept_at = np.concatenate(([0], np.cumsum(~gone)))[offsets]
                n = np.diff(offsets)
                kept = join_words(kept_at, words.filter(pa.array(~gone)))
                items = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(ref), pa.array(ref_start.astype(np.int32))], ["start", "end", "ref_doc", "ref_start"])
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(n))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f"_{c}") for c in carry), part.column("doc_id"), part.column("text"), pa.array(n), pa.array(n - np.diff(kept_at)), kept.cast(pa.string()), pa.ListArray.from_arrays(pa.array(ends), items)],
                    [*carry, "doc_id", "text", "n_words", "n_removed", "kept_text", "factors"],
                )

    return docs.join(found, ["doc_id", "text_key"], "left").select("doc_id", "text", "found", *(f"_{c}" for c in carry)).mapInArrow(settled(run), schema)
