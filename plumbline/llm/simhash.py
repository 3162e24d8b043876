"""SimHash near-duplicate detection with a byte-position inverted index.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most two bits
share at least six of them, the guaranteed minimum. Posting lists of single bytes are 256 a
position for any corpus, so tallying pairs in them is quadratic; the index therefore posts
sets of positional bytes, which counts several matches at once:

1. Each distinct fingerprint is posted under the six unions of two of its four byte pairs:
   four positional bytes, 32 bits. Any two changed bytes leave one such union whole. Lists
   with one member are dropped.
2. Members of the others are posted under six positional bytes: the four and two more. Of the
   28 sets of six each belongs to one union. Pairs that meet here have reached the guaranteed
   minimum, all others are filtered out.
3. Fingerprints of a list of step 2 differ in two bytes only, so it has 65,536 members at most.
   They are verified bit by bit against the 136 changes of one or two bits, in time linear in
   the list, and give a spanning forest of their links, never all pairs.

One way for every length of list: nothing is capped and nothing switches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import connected_components
from plumbline.llm.tables import arrow_limits, free_names, join_words, materialize, release, settled, split_words, text_slices

SEED = 42
#: The unions of two byte pairs, by byte; and for each six-byte set (by the two bytes left out) the first union in it.
UNIONS = [(2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(4), 2)]
SIXES = [(next(k for k, u in enumerate(UNIONS) if not {i, j} & set(u)), i, j) for i, j in combinations(range(8), 2)]
#: Changes of one or two of sixteen bits.
CHANGES = np.array([1 << a | 1 << b for a in range(16) for b in range(a, 16)], np.int64)
#: Members of lists that are verified at once.
CHUNK = 1 << 16


def _fingerprints(texts: pa.Array, width: int) -> np.ndarray:
    offsets, words = split_words(pc.ascii_lower(texts.cast(pa.large_string())))
    joined = join_words(offsets, words)
    n = np.diff(offsets)
    out = np.zeros((len(n), 8), np.uint8)
    if not len(words):
        return out
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends_flat = np.cumsum(size)
    at = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
    row = np.repeat(np.arange(len(n)), n)
    first = offsets[:-1][row]
    start = at[row] + (ends_flat - size) - (ends_flat - size)[first] + (np.arange(len(row)) - first)
    end = start + size
    shingles = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    many = np.repeat(np.arange(len(n)), shingles)
    rank = np.arange(len(many)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    i = offsets[:-1][many] + rank
    j = offsets[:-1][many] + np.minimum(rank + width, n[many]) - 1
    raw, digest = joined.buffers()[2].to_pybytes(), xxhash.xxh64_digest
    hashes = b"".join([digest(raw[a:b], SEED) for a, b in zip(start[i].tolist(), end[j].tolist())])
    live = np.flatnonzero(shingles)
    edges = np.concatenate(([0], np.cumsum(shingles[live])))
    table = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    step = 1 << 16
    votes = np.zeros((len(live), 64), np.int64)
    for a in range(0, len(table), step):  # at most 4 MB of bits at a time
        b = min(a + step, len(table))
        lo, hi = np.searchsorted(edges, a, "right") - 1, np.searchsorted(edges, b, "left")
        cut = np.maximum(edges[lo:hi], a) - a
        votes[lo:hi] += np.add.reduceat(np.unpackbits(table[a:b], axis=1), cut, axis=0, dtype=np.int64)
    out[live] = np.packbits(2 * votes > shingles[live][:, None], axis=1)
    return out


def text_key(column: str) -> Column:
    """Tells the texts of rows with one doc_id apart."""
    return F.coalesce(F.xxhash64(column), F.lit(0))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp): the signed 64-bit SimHash of every row of ``docs``; text_key is ``text_key(text)``.

    Text is lower-cased over A-Z, split at ASCII white space, and voted on by the XXH64
    (seed 42) of each shingle of ``width`` words, repeats included; fewer words make one
    shingle, none the fingerprint zero (null and empty texts).
    """
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                fp = _fingerprints(part.column("text"), width).view(">u8").astype(np.uint64).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(fp)], ["doc_id", "text_key", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(text_col).alias("text_key")).mapInArrow(settled(run), "doc_id long, text_key long, fp long")


def _mask(kept) -> Column:
    """A literal with all bits of the kept bytes set, as a signed 64-bit number."""
    m = sum(255 << 8 * i for i in kept)
    return F.lit(m - (1 << 64) if m >> 63 else m).cast("long")


def _forest(lists: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For members of lists, by list and their two bytes that vary, the place of the least member linked, over links."""
    code = lists << 16 | left
    order = np.argsort(code, kind="stable")
    code, at = code[order], np.arange(len(code))
    found = []
    for change in CHANGES.tolist():
        place = np.minimum(np.searchsorted(code, code ^ change), len(code) - 1)
        x = np.flatnonzero((code[place] == code ^ change) & (place > at))
        found.append(np.stack((x, place[x])))
    x, y = np.concatenate(found, axis=1)
    root = at.copy()
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    out = np.empty(len(code), np.int64)
    out[order] = order[root]
    return out


def link_fingerprints(classes: DataFrame) -> DataFrame:
    """Distinct signed fingerprints (fp) -> links (u, v) that connect just those within two bits."""
    unions = F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(_mask(u)).alias("key")) for k, u in enumerate(UNIONS)))
    postings = classes.select("fp", F.explode(unions).alias("k")).select("k.part", "k.key", "fp")
    lists = materialize(postings.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    six = F.array(*(F.struct(F.lit(k).alias("part"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("fp").bitwiseAND(_mask(set(range(8)) - {i, j})).alias("key")) for k, i, j in SIXES))
    met = postings.join(lists, ["part", "key"]).select("part", "fp", F.explode(F.filter(six, lambda x: x["part"] == F.col("part"))).alias("x"))
    held = met.groupBy("x.i", "x.j", "x.key").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("i", "j", "fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("fps")).to_numpy().astype(np.int64)
            fps = pc.list_flatten(batch.column("fps")).to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(size)), size)
            i, j = (batch.column(c).to_numpy().astype(np.uint64)[row] * np.uint64(8) for c in "ij")
            low = np.uint64(255)
            left = (((fps >> i) & low) | ((fps >> j) & low) << np.uint64(8)).astype(np.int64)
            ends = np.cumsum(size)
            a = 0
            while a < len(size):  # whole lists, about CHUNK members at a time
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
                part = slice(ends[a - 1] if a else 0, ends[b - 1])
                mine = fps[part].view(np.int64)
                root = _forest(row[part], left[part])
                hit = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(mine[hit]), pa.array(mine[root[hit]])], ["u", "v"])
                a = b

    return held.mapInArrow(settled(run), "u long, v long")


def simhash_components(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp, component_id, group) for every row.

    ``component_id`` is the smallest doc_id reachable over links of two bits or fewer, null
    if no row reached has one; ``group`` is equal for the rows that reach each other.
    Rows with one fingerprint are one class, named by it, so rows that share a doc_id stay
    apart if their texts are. Repeated rows yield repeated rows. A row without doc_id links
    like any other but is never a name. Null and empty texts have fingerprint zero and link
    like any other. Very long texts are hashed whole, all shingles with their repeats. Other
    columns do not matter, whatever their names. An empty table gives an empty result.
    """
    signed = materialize(fingerprints(docs, width, id_col, text_col))
    classes = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = materialize(link_fingerprints(classes.select("fp")))
    parts = connected_components(edges)
    grouped = materialize(classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("group")))
    # written before it is joined, so that a giant group's rows can be split over tasks
    names = materialize(grouped.groupBy("group").agg(F.min("least").alias("component_id")))
    ids = materialize(grouped.join(names, "group").select("fp", "group", "component_id"))
    release(classes, edges, parts, grouped, names)
    return signed.join(ids, "fp").select("doc_id", "text_key", "fp", "component_id", "group")


def keep_representatives(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row of ``docs`` for each group: the one with the smallest doc_id.

    Among rows with that doc_id, or in a group without any, the text with the least hash
    stays, once however often its row is repeated (of rows that differ in other columns, which
    must be orderable, the least). Null and empty texts are one group, very long texts are read whole. Columns may have any
    names. An empty table gives an empty result.
    """
    found = simhash_components(docs, width)
    least = found.where("doc_id = component_id or component_id is null").groupBy("group", "doc_id", "text_key").agg(F.count("*").alias("rows"))
    stay = materialize(least.groupBy("group").agg(F.min(F.struct("doc_id", "text_key", "rows")).alias("s")).select("s.*"))
    release(found)
    key, an_id, chosen_key = free_names(docs.columns, "text_key", "chosen_id", "chosen_key")
    keyed = docs.withColumn(key, text_key("text"))

    def of(chosen: DataFrame) -> DataFrame:
        names = chosen.select(F.col("doc_id").alias(an_id), F.col("text_key").alias(chosen_key))
        return keyed.join(names, F.col("doc_id").eqNullSafe(F.col(an_id)) & (F.col(key) == F.col(chosen_key)), "left_semi")

    once = of(stay.where("rows > 1")).groupBy("doc_id", key).agg(F.min(F.struct(*docs.columns)).alias(chosen_key)).select(f"{chosen_key}.*")
    return of(stay.where("rows = 1")).select(*docs.columns).unionByName(once)


def hex_digits(fp: str = "fp") -> Column:
    """The 16 lower-case hex digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
