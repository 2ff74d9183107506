"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared checkpoint
folder and read again as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolary.llm import decontamination, minhash_dedup, quality_qda, sentencepiece_chunks, substring_dedup
from symbolary.sources.shared import ensure_checkpoint_dir
from symbolary.sources.tables import table

#: Words of a shingle for near duplicates.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from all labels but the held-out ones, does not reject."""
    model = quality_qda.fit(docs, table(spark, sf_dir, "labels"))
    return quality_qda.score(docs, model, out="__score").where("__score >= 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate class; one row of it, if it is repeated."""
    found = minhash_dedup.near_duplicates(docs, size=SHINGLE)
    gone = found.where("not kept").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat in one of a smaller id; n_chars is that of the text that is left."""
    return substring_dedup.remove_repeats(docs, substring_dedup.repeats(docs), chars_col="n_chars" if "n_chars" in docs.columns else None)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document with their digests."""
    return sentencepiece_chunks.encode(docs, public_tokenizers.path(sentencepiece_chunks.MODEL), ids=True, keep=("lang", "source"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: SQL can't express the classifier, nor the passages or the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the folder."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store, last = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if last is not None:  # the stage before is not read again
            store.delete(done.suffix(f"/{last}"), True)
        last = name
    return docs
