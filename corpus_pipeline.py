"""A corpus from documents: toxic documents out, one of each group of near copies, repeated passages out,
documents with benchmark passages out, and the rest encoded.

Every stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again for the next
one. All but the last keep the columns of documents (and any others). Rows without doc_id pass the stages that
work by id as they are; rows that share a doc_id are told apart by their texts, except that a passage of the
benchmark in one of them takes all of them out."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import bpe, decontaminate, jaccard, substring, toxicity
from riskframe.llm.exchange import shared_folder, written
from riskframe.llm.queries import table, tokenizer


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay; learned from the labels among them."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group of near copies stays (five-word shingles, similarity of 0.8 or more); texts without words stay."""
    return jaccard.one_of_each_group(docs)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that occur earlier; n_chars follows. Other texts stay to the byte.

    A new text belongs to the rows of its doc_id and its old text; rows that repeat both share the one that lost least (none, if one of them lost none)."""
    found = written(substring.substring_dedup(docs, with_text=True).select(F.col("doc_id").alias("№id"), F.col("text_sha256").alias("№old"), "n_removed", "changed", F.when(F.col("changed"), F.col("text")).alias("text")))
    whole = found.filter("not changed").select("№id", "№old").distinct()
    new = found.filter("changed").join(whole, ["№id", "№old"], "left_anti").groupBy("№id", "№old").agg(F.max_by("text", F.struct(-F.col("n_removed"), "text")).alias("№"))
    out = docs.join(new, (F.col("doc_id") == F.col("№id")) & (F.sha2("text", 256) == F.col("№old")), "left")
    fresh = {"text": F.coalesce("№", "text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("№").isNull(), F.col("n_chars")).otherwise(F.length("№")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(fresh).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark stay."""
    leaks = decontaminate.benchmark_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document left."""
    return bpe.encode_decode(docs, tokenizer("word_bpe_49k.json"), with_ids=True)


STAGES = [("toxicity", reject_toxic), ("jaccard", one_of_each_group), ("substring", remove_passages), ("decontamination", decontaminated), ("bpe", encoded)]

#: Compression classifiers and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = os.path.join(shared_folder(spark), f"corpus-{uuid.uuid4().hex}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
