"""The corpus pipeline: language identification, near-duplicates, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import bpe_trie, decontaminate, langid, simhash
from sigspark.llm.common import apart, cut, shared_folder, table
from sigspark.llm.queries import TOKENIZER

#: Near duplicates: words a shingle, and the least Jaccard similarity, as fingerprints estimate it.
SHINGLE, SIMILARITY = 5, 0.8
#: Least calibrated probability of the predicted language; on the check tables, where all documents have letters, it drops
#: 1 of 51,282 (check_s) and 6 of 256,410 (check_l), by the row counts of CHECK_r01.txt.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null texts among them) and those whose language stays unclear; the model learns from four fifths of docs.

    Where none of these has a language, nothing is learnt, and all documents with letters stay.
    """
    model = langid.train(docs.where(~langid.held_out()))
    named, own = apart(docs, ("lang_pred", "score"))
    if not model.languages:
        return named.where(F.col("text").rlike(r"\p{L}")).select(*own)
    return langid.predict(named, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every component of documents whose 5-word shingles have a estimated similarity of at least 0.8 the one with the smallest doc_id; of rows with equal doc_id and text, one.

    Rows that share the smallest doc_id but not the text all stay, and so do rows without a doc_id, as nothing tells
    them apart.
    """
    named, own = apart(docs, ("text_key", "fp"))
    named = named.withColumn("text_key", F.xxhash64("text"))
    known, key = named.where("doc_id is not null"), ["doc_id", "text_key"]
    groups = cut(simhash.near_duplicates(known, keep=("text_key",), shingle=SHINGLE, similarity=SIMILARITY))
    gone = groups.where("doc_id <> component_id").select(*key).distinct()
    again = groups.where("doc_id = component_id").groupBy(*key).count().where("count > 1").select(*key)
    kept = known.join(gone, key, "left_anti")
    if again.take(1):  # only what is there more than once is shuffled with its texts
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates(key))
    return kept.unionByName(named.where("doc_id is null")).select(*own)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document in which a whole window of a benchmark item occurs, however long the document is.

    Documents without words, null texts among them, stay; repeated rows share one decision; an empty benchmark drops
    nothing; columns that the operator names itself come back as they were.
    """
    named, own = apart(docs, ("n_words", "spans", "items", "_spans", "_items", "n_hit", "n_items", "contaminated"))
    found = decontaminate.contamination(named, table(spark, sf_dir, "benchmark"), keep=tuple(named.columns))
    return found.where(F.size("spans") == 0).select(*own)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids (little-endian unsigned 32-bit) and their count, with what their decoding gives.

    A null text has no ids and the digest of the empty text. Every row of docs gives one row, repeated ones too;
    other columns of docs than doc_id, lang, source and text are not read.
    """
    coded = bpe_trie.transcode(docs, TOKENIZER, keep=("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", F.expr("octet_length(token_ids) div 4").alias("n_tokens"), "token_ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("encoded", encoded)]

#: SQL can express neither the language model nor the shingles; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
