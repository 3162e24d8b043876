"""Quality rules: rule signals, and a hashed n-gram log-likelihood ratio.

Two multinomials over ``buckets`` hashed word 1-grams and 2-grams are counted: one over all
of the raw corpus, one over trusted documents. A document's score is the mean over its
n-grams of log(p_trusted / p_raw), so length does not matter, and a document is kept when
the score reaches a fixed threshold: the same input always gives the same verdict.

The table grows with the trusted n-grams. A bucket then holds about ``PER_BUCKET`` trusted
n-grams by chance at most, and, as the raw counts are scaled to the trusted ones, as many
raw ones, whatever the size of the corpus: n-grams of junk stand out of both alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import arrow_limits, materialize, mix64, packed_counts, release, row_of, settled, split_words, text_slices, unpacked_counts

#: The least number of buckets.
BUCKETS = 1 << 16
#: Trusted n-grams a bucket, on average; more of them make more buckets.
PER_BUCKET = 10
#: Neighbouring buckets whose counts travel as one value.
SEGMENT = 1 << 10
#: At most so many trusted documents (those with the least hash of their id) make the target.
MAX_TRUSTED = 20_000
#: n-grams of trusted texts after which no further one is taken. This bounds the table: 6.7 million
#: buckets, 16 bytes each in a counting task and 8 in a scoring one, but for the last text's own.
MAX_GRAMS = 1 << 26
#: Mean log ratio in nats below which a document is not like the trusted ones.
THRESHOLD = -0.35
SYMBOLS = "[#*$%&|<>]"


class _Words:
    """A slice of documents as coded words."""

    def __init__(self, texts: pa.Array):
        self.offsets, self.words = split_words(texts)
        coded = self.words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        self.hashes = own[self.codes] if len(own) else np.zeros(0, np.uint64)
        self.row = row_of(self.offsets)

    def features(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket) of each 1-gram and 2-gram."""
        h, row = self.hashes, self.row
        pair = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        inside = row[1:] == row[:-1]
        rows = np.concatenate((row, row[1:][inside]))
        return rows, (np.concatenate((h, pair[inside])) % np.uint64(buckets)).astype(np.int64)


def _repeat_words(words: _Words, span: int = 5) -> np.ndarray:
    """Per row, the words within ``span``-word windows that the row holds twice or more."""
    n = len(words.offsets) - 1
    codes, row = words.codes, words.row
    if len(codes) < span:
        return np.zeros(n, np.int64)
    ids = codes
    whole = row[: len(row) - span + 1] == row[span - 1 :]
    # exact identity of windows: grow coded sequences one word at a time
    base = np.int64(codes.max() + 1)
    ids = codes
    for k in range(1, span):
        joined = ids[: len(codes) - k] * base + codes[k:]
        ids = np.unique(joined, return_inverse=True)[1] if int(joined.max(initial=0)) > (1 << 62) // int(base) else joined
    places = np.flatnonzero(whole)
    key = np.unique(ids[places], return_inverse=True)[1].astype(np.int64) * n + row[places]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = places[counts[inverse] > 1]
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + span, -1)
    return np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=n)


def _dup_lines(texts: list) -> list[int]:
    """Per text, the \\n-split lines with a word that equal an earlier line."""
    out = []
    for text in texts:
        lines = text.split("\n") if text else []
        live = [x for x in lines if x.strip(" \t\n\v\f\r")] if len(lines) > 1 else []
        out.append(len(live) - len(set(live)))
    return out


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> DataFrame:
    """The doc_ids labelled good and not toxic, at most ``limit`` of them, chosen by hash."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def trusted_within(docs: DataFrame, trusted: DataFrame, max_grams: int = MAX_GRAMS) -> tuple[DataFrame, int]:
    """The trusted ids up to the one that brings the n-grams of their texts to ``max_grams``, and how many n-grams those are.

    Ids are taken in the order of their hash. There are MAX_TRUSTED at most, so is what is ordered here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                n = np.diff(split_words(part.column("text"))[0])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(2 * n - (n > 0))], ["doc_id", "grams"])

    held = docs.select("doc_id", "text").join(F.broadcast(trusted.select("doc_id")), "doc_id").select("doc_id", "text")
    sizes = held.mapInArrow(settled(run), held.select("doc_id").schema.add("grams", "long")).groupBy("doc_id").agg(F.sum("grams").alias("grams"))
    before = F.sum("grams").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("grams")
    kept = materialize(sizes.withColumn("before", before).where(F.col("before") < max_grams).select("doc_id", "grams"))
    return kept, kept.agg(F.sum("grams")).first()[0] or 0


def table_size(grams: int) -> int:
    """Buckets for PER_BUCKET trusted n-grams each, BUCKETS at least."""
    return max(BUCKETS, -(-grams // PER_BUCKET))


def ngram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """(2, buckets) counts of hashed n-grams: of all documents, and of the trusted ones.

    Tasks count into arrays of fixed size, which are added segment by segment; at most
    2 * buckets numbers reach the driver. ``trusted`` has MAX_TRUSTED ids at most, which
    bounds its broadcast.
    """
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left").select("text", "good")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows, at = _Words(part.column("text")).features(buckets)
                good = part.column("good").is_valid().to_numpy(zero_copy_only=False)[rows]
                np.add.at(total[0], at, 1)
                np.add.at(total[1], at[good], 1)
        live = [k for k in range(-(-buckets // SEGMENT)) if total[0, k * SEGMENT : (k + 1) * SEGMENT].any()]
        raw, good = ([packed_counts(x[k * SEGMENT : (k + 1) * SEGMENT]) for k in live] for x in total)
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int64()), pa.array(raw, pa.binary()), pa.array(good, pa.binary())], ["segment", "raw", "good"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, *pair in zip(*(c.to_pylist() for c in batch.columns)):
                new = [unpacked_counts(x) for x in pair]
                sums[k] = [a + b for a, b in zip(sums[k], new)] if k in sums else new
        raw, good = ([packed_counts(x[i]) for x in sums.values()] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(raw, pa.binary()), pa.array(good, pa.binary())], ["segment", "raw", "good"])

    schema = "segment long, raw binary, good binary"
    table = marked.mapInArrow(settled(run), schema).repartition("segment").mapInArrow(settled(added), schema)
    out = np.zeros((2, buckets), np.int64)
    for k, *pair in table.collect():
        out[:, k * SEGMENT : (k + 1) * SEGMENT] = [unpacked_counts(x) for x in pair]
    return out


def log_ratio(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Per bucket log(p_trusted / p_raw): the trusted count against the one expected from the raw share.

    ``smoothing`` is added to both, so a bucket with little of either says nothing, in a
    table of any size. With no trusted n-gram at all the ratio is 0 everywhere.
    """
    expected = counts[0] * (counts[1].sum() / max(counts[0].sum(), 1))
    return np.log((counts[1] + smoothing) / (expected + smoothing))


def quality_signals(docs: DataFrame, labels: DataFrame, buckets: int | None = None, threshold: float = THRESHOLD, max_trusted: int = MAX_TRUSTED, max_grams: int = MAX_GRAMS, carry: tuple = ()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_ratio, base_failed, kept).

    One row per row of ``docs``, repeated rows included; ``carry`` names further columns to
    pass through, but for those that the result makes itself. Other columns do not matter,
    whatever their names. Null and empty texts have no words: base_failed, not kept, log_ratio
    0. Ties in the threshold are kept. Rows without doc_id are scored like others but are never
    trusted. Repeated labels count once. Without ``buckets`` the table's size follows from the
    trusted texts, which ``max_trusted`` and ``max_grams`` bound; raw counts are of all texts. Very
    long texts are read whole. An empty table gives an empty result; without trusted texts every
    ratio is 0.
    """
    arrow_limits(docs.sparkSession)
    trusted, grams = trusted_within(docs, trusted_ids(labels, max_trusted), max_grams)
    buckets = buckets or table_size(grams)
    weights = log_ratio(ngram_counts(docs, trusted, buckets))
    release(trusted)
    own = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ratio double, base_failed boolean, kept boolean"
    names = [x.split()[0] for x in own.split(", ")]
    rest = [c for c in carry if c.lower() not in ("doc_id", "text", *names)]
    source = docs.select("doc_id", "text", *rest)
    passed = source.select("doc_id", *(["text"] if "text" in carry else []), *rest)
    passing = passed.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passed.schema.fields) + ", " + own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = part.column("text")
                w = _Words(texts)
                n = np.diff(w.offsets)
                chars = np.bincount(w.row, pc.utf8_length(w.words).to_numpy(zero_copy_only=False), len(n)).astype(np.int64)
                symbols = pc.fill_null(pc.count_substring_regex(texts, SYMBOLS), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                lines = np.array(_dup_lines(texts.to_pylist()), np.int64)
                repeats = _repeat_words(w)
                rows, at = w.features(buckets)
                score = np.round(np.bincount(rows, weights[at], len(n)) / np.maximum(np.bincount(rows, minlength=len(n)), 1), 9)
                failed = (n < 10) | (100 * repeats > 20 * n)
                cols = [n, chars, symbols, lines, repeats, score, failed, ~failed & (score >= threshold)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passing), *map(pa.array, cols)], [*passing, *names])

    return source.mapInArrow(settled(run), schema)
