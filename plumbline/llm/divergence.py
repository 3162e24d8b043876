"""Source divergence audit: how far each source's use of terms is from other sources and from its language.

Terms are counted slice by slice of text and summed over (lang, source, term) with map-side
combine. Each kept term of a language is then pivoted into a vector with a place for every
source of the language; higher-order functions turn a vector into its contributions to all
pairs of sources, which are again summed map-side, so that only one number a task and pair is
shuffled. All arithmetic is of whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import arrow_limits, materialize, settled, text_slices

#: A term is in the vocabulary of a language from so many of its documents on.
MIN_DOCS = 3
#: Terms reported of each source.
TOP_TERMS = 200
#: Probabilities are whole numbers of a billionth.
SCALE = 1_000_000_000

#: Per byte: the byte of a term it becomes (A-Z lower-cased, all bytes of non-ASCII characters), 0 between terms.
_BYTES = np.zeros(256, np.uint8)
_BYTES[0x80:] = np.arange(0x80, 0x100)
_BYTES[ord("a") : ord("z") + 1] = _BYTES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def split_terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, term) of every term in the texts, in order; null texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    n = len(texts)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    code = _BYTES[raw]
    live = code > 0
    edge = np.zeros(len(raw) + 1, bool)  # places where one row ends and another begins
    edge[at] = True
    starts = np.flatnonzero(live & (edge[:-1] | ~np.concatenate(([False], live[:-1]))))
    ends = np.flatnonzero(live & (edge[1:] | ~np.concatenate((live[1:], [False])))) + 1
    cuts = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(code[live])])
    return np.searchsorted(at, starts, "right") - 1, terms


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences of each term and documents that hold it; nulls are ''."""
    arrow_limits(docs.sparkSession)
    names = ["lang", "source", "term", "n", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                row, terms = split_terms(part.column("text"))
                coded = terms.dictionary_encode()
                own = len(coded.dictionary)
                if not own:
                    continue
                groups: dict[tuple, int] = {}
                group = np.array([groups.setdefault(g, len(groups)) for g in zip(part.column("lang").to_pylist(), part.column("source").to_pylist())], np.int64)
                in_doc, times = np.unique(row * own + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                cell, back, d = np.unique(group[in_doc // own] * own + in_doc % own, return_inverse=True, return_counts=True)
                n = np.bincount(back, times).astype(np.int64)
                langs, sources = (pa.array([g[k] for g in groups], pa.string()).take(pa.array(cell // own)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([langs, sources, coded.dictionary.take(pa.array(cell % own)).cast(pa.string()), pa.array(n), pa.array(d)], names)

    text = docs.select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    found = text.mapInArrow(settled(run), "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for counts of 18 digits."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, (total + terms).cast("decimal(19,0)"))


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_vectors(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n, by_source): each kept term with its occurrences in the language and a map of those by source."""
    entry = F.collect_list(F.struct("source", "n"))
    pivoted = term_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), entry.alias("entries"))
    return pivoted.where(F.col("d") >= min_docs).select("lang", "term", "n", F.map_from_entries("entries").alias("by_source"))


def language_frames(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(lang, code, sources, totals, total, v): each language's sources in order with their occurrences of kept terms, and its vocabulary's size.

    ``code`` is a number for the language that holds for one writing of the table.
    """
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    held = vectors.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    listed = groups.join(held, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).cast("long").alias("n")))).alias("g"))
    sizes = vectors.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("v"))
    zero = F.lit(0).cast("long")
    return listed.join(sizes, "lang", "left").select("lang", F.monotonically_increasing_id().alias("code"), F.col("g.source").alias("sources"), F.col("g.n").alias("totals"), F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences of each source, largest first.

    Part ``pair`` has every other source of the language and the excess summed over its whole
    vocabulary (0 where that is empty); part ``term`` the first ``top`` terms that the source
    uses more often than its language. Ties are broken by the item's bytes. Null texts have no
    terms, null languages and sources are '', repeated rows count each, a very long text is
    counted whole in one slice. A source without terms has its pairs all the same. Other columns
    do not matter, whatever their names. An empty table gives an empty result.

    A vector has a place for each source of its language, and a term's pairs are the square of
    that: meant for sources by the hundred, not for single hosts.
    """
    vectors = materialize(term_vectors(docs, min_docs))
    frames = materialize(language_frames(docs, vectors))
    met = vectors.join(frames, "lang")
    v = F.col("v")
    own = F.transform("sources", lambda s: F.coalesce(F.try_element_at("by_source", s), F.lit(0).cast("long")))
    wide = met.select("code", F.zip_with(own, "totals", lambda c, n: probability(c, n, v)).alias("p"))
    # a vector without any excess for each language gives the pairs of an empty vocabulary
    flat = frames.select("code", F.transform("sources", lambda s: F.lit(1).cast("long")).alias("p"))
    # rare terms share few vectors: equal ones are multiplied, not repeated
    equal = wide.unionByName(flat).groupBy("code", "p").agg(F.count("*").alias("m"))
    by_one = equal.select("code", "m", "p", F.posexplode("p").alias("i", "x")).withColumn("square", F.col("x") * F.col("x"))
    # (p - q)^2 div q = p^2 div q - 2 p + q: one division a pair; on the diagonal p itself is summed
    by_pair = by_one.select("code", "m", "i", F.posexplode(F.transform("p", lambda q: F.call_function("div", F.col("square"), q))).alias("j", "f"))
    sums = materialize(by_pair.groupBy("code", "i", "j").agg(F.sum(F.col("f") * F.col("m")).alias("s")))
    of = lambda c, name: sums.where("i = j").select("code", F.col("i").alias(c), F.col("s").alias(name))
    value = (F.col("s") - 2 * F.col("p") + F.col("q")).alias("value")
    valued = sums.where("i <> j").join(of("i", "p"), ["code", "i"]).join(of("j", "q"), ["code", "j"]).select("code", "i", "j", value)
    name = lambda c: F.element_at("sources", F.col(c) + 1)
    pairs = valued.join(frames.select("code", "lang", "sources"), "code").select("lang", name("i").alias("source"), F.lit("pair").alias("part"), name("j").alias("item"), "value")

    # made once a term, before its sources become rows
    asked = met.select("lang", "term", "v", probability(F.col("n"), F.col("total"), v).alias("q"), F.map_from_arrays("sources", "totals").alias("t"), "by_source")
    used = asked.select("lang", "term", "v", "q", "t", F.explode("by_source").alias("source", "c"))
    p = probability(F.col("c"), F.element_at("t", F.col("source")), v)
    terms = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "q", p.alias("p")).where("p > q").select("lang", "source", "part", "item", excess(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = F.row_number().over(best)
    return pairs.withColumn("rank", ranked).unionByName(terms.withColumn("rank", ranked).where(F.col("rank") <= top))
