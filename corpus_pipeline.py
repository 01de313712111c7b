"""A training corpus from raw documents: five stages, each one operator over all
that the stage before it kept. Each stage's result is written as Parquet into the
shared folder and read again before the next one.

Every stage takes documents with null, empty and very long texts, null ids,
repeated rows and further columns of any names, as the operator that it calls
describes, and gives an empty table for an empty one. All but the last return the
columns that they were given."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasframe.llm import decontaminate, pieces, quality_crf, similar, substring_dedup
from atlasframe.llm.queries import quality_model
from atlasframe.llm.shared import drop_table, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model scores at 0.5 or more; the model is fitted on
    the labelled rows of docs."""
    return quality_crf.keep_good(docs, quality_model(docs, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near-duplicates."""
    return similar.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that a smaller id has as well."""
    return substring_dedup.remove(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids) and the text decoded from the ids."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", passages),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), "stage-" + name.split(" ")[0].lower())
        if before is not None:
            drop_table(before)
        before = docs
    return docs


#: A conditional random field, verified SimHash groups and a tokenizer are beyond SQL: tested against brute force.
ORACLE_SQL = None
