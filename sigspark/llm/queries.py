"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import bpe_trie, decontaminate, dom_crf, flac, langid, sharding, simhash, token_count, url_filter, warc
from sigspark.llm.common import table, text_or_empty
from sigspark.llm.oracle import ORACLE as ORACLE

#: Where the tokenizers' files are; a parameter of the operators.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COUNTER = public_tokenizers.path("word_bpe_49k.json")
SHARDS = 16
TOKEN_LIMIT = 2048


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLAC of every whole text, a null one as an empty text. Repeated rows and equal texts give equal values; an empty table gives no rows."""
    stored = flac.store(table(spark, sf_dir, "documents"))
    return flac.features(stored, keep=("doc_id", "n_bytes"))


#: Longest match wins; the rest is the model's.
RULES = [url_filter.Rule("org", "/", True), url_filter.Rule("example.org", "/es/", False), url_filter.Rule("example.org", "/en/1", False), url_filter.Rule("com", "/fr/", True), url_filter.Rule("com", "/de/", False)]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url judged: null, empty and scheme-less urls have an empty host and path, score 0 where empty, and the verdict of the threshold. Ties between rules go to the later one in text order; with no labelled urls of a side the threshold is 0."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null and empty html give an empty text. Repeated rows give a row each."""
    return dom_crf.extract(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every document. Null, empty and wordless texts have no words and are not contaminated; null items are `null`; equal items count each."""
    found = decontaminate.judged(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document placed under the law `bytes`; a null or empty text has size 1. Rows are ordered by doc_id (null first), checksum and size; those equal in all three take neighbouring slots in any order."""
    sized = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text_or_empty("text")) + 1).cast("long").alias("size"), F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"))
    placed = sharding.byte_shards(sized, "size", ["doc_id", "text_crc32", "size"], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written and read back; null html is an empty payload, null urls share one capture key. A null page_id is never the largest: such rows revisit a repeated payload that another page has."""
    pages = table(spark, sf_dir, "pages")
    read = warc.lookup(pages.select("url"), warc.write(pages))
    as_key = lambda c: F.col(c).cast(pages.schema["page_id"].dataType)
    return read.select(as_key("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_key("refers_to").alias("refers_to"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and their decoding; a null text is empty and has none."""
    coded = bpe_trie.transcode(table(spark, sf_dir, "documents"), TOKENIZER)
    return coded.select("doc_id", F.expr("octet_length(token_ids) div 4").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; `und` and 0 for null, empty and letterless texts, and where no training row has a language. Languages are compared as they are written; a null doc_id is in the fold of the empty text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text; a null text is empty and has none."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), COUNTER).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; null and wordless texts have fingerprint 0. Null doc_ids count in no minimum, a component of them alone has a null id; rows that share a doc_id are separate."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_flac, op2_url_filter, op3_main_text, op4_decontaminate, op5_shards, op6_warc, op7_bpe, op8_langid, op9_token_counts, op10_simhash)}
