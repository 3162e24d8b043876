"""Registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import binary, chat, divergence, embeddings, exact, interactions, languages, packing, pieces, quality, simhash, substrings, tables, urls
from plumbline.llm.sql import SQL

#: Fixed value: the conversation that the formatting contract adds.
AWKWARD = r"\### Assistant: </turn> ok"
#: Names of spam sites under the pages' three domains.
SPAM = ["casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x"]
#: A dated list for the pages' hosts: (domain, action, date). Spam sites are blocked, with one
#: branch allowed for a while and one for good; the rest has changes of every kind at several depths.
URL_LIST = [
    ("example.net", "block", "2024-02-01"),
    ("example.net", "remove", "2024-08-15"),
    ("tionsh.example.net", "allow", "2024-04-01"),
    ("tionsh.example.net", "remove", "2024-06-01"),
    ("tionsh.example.net", "block", "2024-10-01"),
    ("blog.tionble.example.com", "block", "2024-01-15"),
    ("blog.tionble.example.com", "allow", "2024-07-01"),
    ("tionble.example.com", "block", "2024-05-01"),
    ("m.tiontion.example.com", "block", "2024-03-10"),
    ("m.tiontion.example.com", "block", "2024-09-10"),
    ("m.tiontion.example.com", "remove", "2024-11-11"),
    ("ththth.example.org", "block", "2024-01-01"),
    ("blog.ththth.example.org", "allow", "2024-03-01"),
    ("org", "block", "2024-12-01"),
    *(
        (f"{branch}{site}.example.{top}", action, date)
        for site in SPAM
        for top in ("com", "net", "org")
        for branch, action, date in (("", "block", "2024-01-10"), ("m.", "allow", "2024-04-01"), ("m.", "remove", "2024-07-01"), ("www.", "allow", "2024-10-01"))
    ),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_signals(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.decode_pieces(pieces.encode_pieces(_table(spark, sf_dir, "documents")))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", same.alias("round_trip"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", AWKWARD), (-7, 1, "assistant", AWKWARD)], "conv_id long, turn long, role string, text string")
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.chat_digests(chat.format_chats(chats)).drop("n_tokens", "n_loss_tokens")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (their source is the host) and pages (host, suffix and markup of their own)."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    records = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("source").alias("host"), none.alias("suffix"), none.alias("declared")).unionByName(
        languages.page_records(pages, ["page_id"]).withColumn("doc_id", F.lit(None).cast("long"))
    )
    return languages.identify(records, languages.train_languages(docs), ["doc_id", "page_id"])


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = packing.encode_pieces(_table(spark, sf_dir, "documents"))
    digests = coded.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.best_fit_placements(digests, tie_cols=("doc_id", "piece", "start", "ids_crc32"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    # pages carry no fetch time: the day of 2024 is taken from page_id
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    found = urls.filter_urls(captures, spark.createDataFrame(URL_LIST, "domain string, action string, dated string"))
    return found.withColumn("fetched", F.col("fetched").cast("string"))


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to the shared folder, and read back."""
    packed = binary.pack_token_ids(_table(spark, sf_dir, "documents"))
    written = binary.write_packed(packed, tables.new_table(spark))
    tables.release(packed)
    return written


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.filter_interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_quality_rules, op2_sentencepiece, op3_substring_dedup, op4_simhash, op5_embedding_dedup, op6_chat_format, op7_language_id, op8_best_fit_packing, op9_url_filters, op10_token_binary, op11_filter_audit, op12_source_divergence, op13_exact_dedup, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    listed = ", ".join(f"('{d}', '{a}', DATE '{t}')" for d, a, t in URL_LIST)
    return {name: text.replace("{url_list}", listed) for name, text in SQL.items()}
