"""Language identification by fusing evidence.

For each text: log p(lang | all) = log host prior + log p(declared markup language | lang)
+ log p(text | lang), up to a constant. Text likelihoods come from hashed byte 3-grams,
counted on labelled documents. Host priors are smoothed in levels, host towards address
suffix towards the whole, from grouped counts of what the texts alone say.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import arrow_limits, materialize, packed_counts, release, settled, text_slices, unpacked_counts
from plumbline.llm.urls import host_of

BUCKETS = 1 << 16
#: At most so many labelled documents of each language (those with the least hash of their id) train the model.
MAX_TRAIN = 1000
#: A column with more languages than this is not one of languages.
MAX_LANGUAGES = 500
#: A 3-gram's log-likelihood if all buckets were alike. Texts that no language explains better are in none of them.
NO_LANGUAGE = -float(np.log(BUCKETS))
#: Neighbouring 3-grams are not independent: a text counts as so many at most.
MAX_EVIDENCE = 60
MIN_GRAMS = 3


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, buckets): hashed byte 3-grams of each text's lower-cased letters, words set off by spaces."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    low = pc.replace_substring_regex(low, r"[^\pL\pM]+", " ")
    low = pc.replace_substring_regex(low, r"^ ?(.*[^ ]) ?$", r" \1 ")
    at = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, low.offset * 8)
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].astype(np.uint32)
    at = at - at[0]
    code = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    n = np.maximum(np.diff(at) - 2, 0)
    inside = np.zeros(len(code) + 1, np.int64)
    np.add.at(inside, at[:-1][n > 0], 1)
    np.add.at(inside, (at[:-1] + n)[n > 0], -1)
    return np.concatenate(([0], np.cumsum(n))), code[np.cumsum(inside[:-1]) > 0]


class LanguageModel:
    """Languages and log p(bucket | language), a matrix of fixed width."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs

    def means(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(3-grams of each text, mean log-likelihood of a 3-gram per language)."""
        offsets, grams = _grams(texts)
        n = np.diff(offsets)
        out = np.zeros((len(n), len(self.languages)))
        live = np.flatnonzero(n)
        for k in range(len(self.languages) if len(live) else 0):
            out[live, k] = np.add.reduceat(self.logs[k][grams], offsets[:-1][live]) / n[live]
        return n, out


def train_languages(docs: DataFrame, max_docs: int = MAX_TRAIN) -> LanguageModel:
    """A model from documents with ``lang``, up to ``max_docs`` of each language, so that rare ones are known too.

    Documents without id, lang or text do not train; without any other, the model knows no
    language. Of more than MAX_LANGUAGES languages those with most documents are known, equals
    by name. Tasks send a language's counts as one compressed array each, and the driver holds
    one array a language.
    """
    arrow_limits(docs.sparkSession)
    named = docs.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = named.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    # a language's ids below this share of all hashes are half as many again as are wanted, so ranking them stays small
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(1.5 * max_docs / max(n, 1))) for lang, n in sizes), F.lit(0.0))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    few = named.where(spot < share * (1 << 31)).select("doc_id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(spot, F.xxhash64("doc_id"), "doc_id"))
    ids = few.withColumn("rank", rank).where(F.col("rank") <= max_docs).select("doc_id", "lang")
    chosen = named.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                offsets, grams = _grams(part.column("text"))
                langs = np.array(part.column("lang").to_pylist(), object)
                row = np.repeat(np.arange(len(langs)), np.diff(offsets))
                for lang in set(langs):
                    total[lang] = total.get(lang, 0) + np.bincount(grams[(langs == lang)[row]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([packed_counts(x) for x in total.values()], pa.binary())], ["lang", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, data in zip(*(c.to_pylist() for c in batch.columns)):
                sums[lang] = sums.get(lang, 0) + unpacked_counts(data)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([packed_counts(x) for x in sums.values()], pa.binary())], ["lang", "counts"])

    schema = "lang string, counts binary"
    rows = sorted(tuple(r) for r in chosen.mapInArrow(settled(run), schema).repartition("lang").mapInArrow(settled(added), schema).collect())
    languages = [lang for lang, _ in rows]
    counts = np.zeros((len(languages), BUCKETS))
    for own, (_, data) in zip(counts, rows):
        own[:] = unpacked_counts(data)
    counts += 0.5
    return LanguageModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def html_text(html: str):
    """The visible text of a page, as a column expression; null stays null.

    A script, style or comment that never ends goes to the end of the page, as in browsers; a
    tag ends at the next < at the latest and is text if it does. So each character is looked at
    a few times, however long the page.
    """
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*+>|\z)|<!--.*?(?:-->|\z)|<[^<>]*+>", " ")
    return F.regexp_replace(bare, r"&#?\w{1,8};", " ")


def page_records(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, host, suffix, declared) of raw pages (url, html): what ``identify`` takes.

    One row a row; null pages have null text, null addresses no host; pages and addresses may
    be of any length. An empty table gives an empty result.
    """
    host = host_of(F.col("url"))
    declared = F.regexp_extract("html", r"(?i)<html[^<>]*\blang\s*=\s*[\"']?([^\"'\s>]*)", 1)
    return pages.select(*keys, html_text("html").alias("text"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"), declared.alias("declared"))


def identify(records: DataFrame, model: LanguageModel, keys: list[str], languages: list[str] | None = None, carry_text: bool = False, sure: float = 0.5, host_weight: float = 20.0, suffix_weight: float = 50.0, honest: float = 0.9) -> DataFrame:
    """``keys`` (and, with ``carry_text``, text) of every record, with lang, posterior, text_lang and kept (keys so named give way).

    ``records`` has the key columns, text, host, suffix and declared; any may be null. A
    text with under MIN_GRAMS 3-grams (null and empty ones), or one that no known language
    explains better than NO_LANGUAGE, is ``und`` with posterior null and is not kept, whatever
    its page declares. Others are kept when their language is one of ``languages`` (default: all
    known) with a posterior of ``sure`` at least. Ties take the first language by name. Repeated
    rows are told each, and counted each; other columns do not matter, whatever their names; an
    empty table gives an empty result. Counts per host and suffix are sums that combine before
    the shuffle.
    """
    known, n = model.languages, len(model.languages)
    means = [f"m{i}" for i in range(n)]
    named = [k for k in keys if k.lower() not in ("lang", "posterior", "text_lang", "kept")]
    keys = [f"k{i}" for i in range(len(named))]
    # inside, only names of our own
    base = records.select(*(F.col(c).alias(k) for c, k in zip(named, keys)), "text", F.coalesce(F.lower("host"), F.lit("")).alias("host"), F.coalesce(F.lower("suffix"), F.lit("")).alias("suffix"), F.lower("declared").alias("declared"))
    carried = [c for c in base.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*carried).schema) + ", grams long" + "".join(f", {m} double" for m in means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                grams, table = model.means(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(grams), *map(pa.array, table.T)], [*carried, "grams", *means])

    arrow_limits(records.sparkSession)
    if carry_text:
        keys, named = [*keys, "text"], [*named, "text"]
        carried, schema = [*carried, "text"], "`text` string, " + schema
        carried = ["text", *carried[:-1]]
    scored = base.mapInArrow(settled(run), schema)
    ours = [F.col(k).alias(c) for c, k in zip(named, keys)]
    if not n:
        return scored.select(*ours, F.lit("und").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit("und").alias("text_lang"), F.lit(False).alias("kept"))
    scored = materialize(scored)
    best = F.greatest(*means) if n > 1 else F.col(means[0])
    first = functools.reduce(lambda rest, i: F.when(F.col(means[i]) == best, F.lit(i)).otherwise(rest), reversed(range(n)), F.lit(None).cast("int"))
    scored = scored.withColumn("first", F.when((F.col("grams") >= MIN_GRAMS) & (best >= NO_LANGUAGE - 1e-9), first))
    hosts = materialize(scored.groupBy("host", "suffix").agg(*(F.count(F.when(F.col("first") == i, 1)).alias(f"h{i}") for i in range(n))))
    suffixes = hosts.groupBy("suffix").agg(*(F.sum(f"h{i}").alias(f"s{i}") for i in range(n)))
    whole = [(x or 0) + 1.0 for x in hosts.agg(*(F.sum(f"h{i}") for i in range(n))).first()]
    share = [x / sum(whole) for x in whole]
    smooth = lambda count, total, weight, up: (F.col(count) + weight * up) / (total + weight)
    of_hosts, of_suffixes = (functools.reduce(add, (F.col(f"{c}{i}") for i in range(n))) for c in "hs")
    priors = hosts.join(suffixes, "suffix").select("host", "suffix", *(F.log(smooth(f"h{i}", of_hosts, host_weight, smooth(f"s{i}", of_suffixes, suffix_weight, F.lit(share[i])))).alias(f"p{i}") for i in range(n)))
    written = materialize(priors)  # so that a hot host's records can be split over tasks
    release(hosts)
    joined = scored.join(written, ["host", "suffix"])
    spread = F.lit(np.log((1 - honest) / max(n - 1, 1)).item())
    said = [F.when(F.substring_index("declared", "-", 1).isin(known), F.when(F.substring_index("declared", "-", 1) == x, F.lit(float(np.log(honest)))).otherwise(spread)).otherwise(0.0) for x in known]
    logs = joined.select(*keys, "first", *((F.col(f"p{i}") + said[i] + F.col(means[i]) * F.least("grams", F.lit(MAX_EVIDENCE))).alias(f"l{i}") for i in range(n)))
    top = F.greatest(*(f"l{i}" for i in range(n))) if n > 1 else F.col("l0")
    lang = functools.reduce(lambda rest, i: F.when(F.col(f"l{i}") == F.col("top"), F.lit(known[i])).otherwise(rest), reversed(range(n)), F.lit("und"))
    text_lang = functools.reduce(lambda rest, i: F.when(F.col("first") == i, F.lit(known[i])).otherwise(rest), range(n), F.lit("und"))
    total = functools.reduce(add, (F.exp(F.col(f"l{i}") - F.col("top")) for i in range(n)))
    out = logs.withColumn("top", top).select(*ours, F.when(F.col("first").isNull(), F.lit("und")).otherwise(lang).alias("lang"), F.when(F.col("first").isNotNull(), 1 / total).alias("posterior"), text_lang.alias("text_lang"))
    return out.withColumn("kept", F.coalesce(F.col("lang").isin(languages if languages is not None else known) & (F.col("posterior") >= sure), F.lit(False)))
