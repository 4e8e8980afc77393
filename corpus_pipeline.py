"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination and packing, one table after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontamination, language_id, line_dedup, packing, simhash
from threadloom.llm.common import Scratch, column, split_by


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go.

    Each row counts on its own, whatever its id; nulls in other columns don't matter. An empty table stays empty.
    """
    return language_id.keep_identified(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; so do documents of which nothing else is left.

    Rows with a null id or text stay as they are. Rows that repeat id and text count as one document, each with its
    result. n_chars follows the text where lines went. Other columns stay, whatever their names. An empty table stays empty.
    """
    out = line_dedup.line_results(docs)
    changed = F.size("removed") > 0
    emptied = changed & (F.trim(F.translate("clean", "\t\n\x0b\x0c\r", "")) == "")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*(new.get(c, column(c, "row")).alias(c) for c in docs.columns))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Null and empty texts are near copies of one another. Of rows that repeat a doc_id all stay or all go;
    those with a null id stay. An empty table stays empty. Texts of documents that stay for certain don't shuffle.
    Other columns stay, whatever their names.
    """
    labels = simhash.simhash_components(docs)
    gone = Scratch(spark, "pipeline").write(labels.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    columns = [column(c) for c in docs.columns]
    plain, maybe = split_by(docs, F.xxhash64("doc_id"), gone.select(F.xxhash64("doc_id").alias("h")))
    return plain.unionByName(maybe.join(gone, "doc_id", "left_anti").select(*columns))


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none. Each row counts on its own, whatever its id. Without items all documents stay.
    Other columns stay, whatever their names.
    """
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens at most; the columns of ``packing.pack``.

    Null and empty texts are a piece of one token. Each row is packed on its own, whatever its id. No documents: no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("simhash_near_dedup", remove_near_copies),
    ("decontamination", remove_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]

#: SQL has neither the string kernels nor XXH64 fingerprints nor the tokenizer; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written once and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, name)
    return docs
