"""A corpus in five stages, each written as Parquet and read again as the next one's documents.

Every stage reads the columns of documents by name, so that others do not matter, whatever
their names; it works on whole texts however long, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import languages, packing, quality, simhash, substrings
from plumbline.scratch import materialize, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose base rules or likelihood ratio reject them go: null and empty texts among them. Repeated rows are judged each."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_signals(docs, labels, carry=tuple(COLUMNS)).where("kept").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the known languages go (null and empty texts are); lang becomes the language found, ties the first by name. Repeated rows are judged each."""
    none = F.lit(None).cast("string")
    records = docs.select(*COLUMNS, F.col("source").alias("host"), none.alias("suffix"), none.alias("declared"))
    found = languages.identify(records, languages.train_languages(docs), ["doc_id", "source", "n_chars"], carry_text=True)
    return found.where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays, once; one without id only if none has an id."""
    return simhash.keep_representatives(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more met before go; a document left without a word goes, one that had none stays (null and empty texts). Rows of one id do not repeat each other."""
    cut = substrings.remove_repeats(docs, carry=("lang", "source"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.where("n_removed < n_words or n_words = 0").select("doc_id", text.alias("text"), "lang", "source", F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens; null and empty texts are one token, repeated rows are placed each."""
    coded = packing.encode_pieces(docs)
    digests = coded.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.best_fit_placements(digests, tie_cols=("doc_id", "piece", "start", "ids_crc32"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", best_fit_packing),
]

#: XXH64, hashed n-grams and tokenizers are not SQL: tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder.

    A stage's own tables, and the stage before it, go as soon as its rows are written; the last
    stage's rows stay until ``plumbline.scratch.release`` of the result, or the process's end.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = materialize(out)
        release(out)
    return docs
