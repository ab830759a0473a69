"""A training-corpus pipeline over ``documents``: each stage is written and read again as the next one's documents.

1. toxicity       documents that the classifier rejects go
2. exact          one row of each group of equal texts stays
3. near           one document of each group of near copies stays (Jaccard similarity 0.8 of 5-word shingles)
4. benchmark      documents in which a benchmark window occurs go
5. pieces         documents are encoded into sampled SentencePiece segmentations

All stages but the last return the columns of ``documents``. A null text counts as empty; rows with null or repeated ids are rows like
others, told apart by id and text; of ties the smallest id stays, a null id last; an empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import common, decontam, exact, pieces, simhash, toxicity
from pathloom.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, common.table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs, words=5, similarity=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.report(docs, tokenizer_path("piece_bpe_32k.model"), brief=True)


STAGES = [("toxicity", toxicity_stage), ("exact", exact_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("pieces", pieces_stage)]

#: The classifier, min-hashes and sampled segmentations have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes when the next one is written; the last table stays, as the rows are read from it."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = common.scratch(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            if before:
                common.discard(spark, before)
            docs, before = spark.read.parquet(path), path
    return docs
