"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

``run`` writes every stage as Parquet into the shared checkpoint folder and reads it again, so a lost executor costs one stage at most.
Null, empty and repeated rows are treated as the stages' operators say; an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import lines, mixing, neardup, packing, toxicity
from tidewater.llm.common import documents, settle


def toxic_out(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled ones among ``docs``, none that is held out."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines that recur across documents go from all but the first; so do documents that held nothing else."""
    return lines.drop_repeated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: its least doc_id."""
    return neardup.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in training order, as often as their source's target takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence; numbered in training order, which the files of the mix are written in."""
    return packing.pack_in_order(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: Scores of a trained model, XXH64 fingerprints and tokenizer ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
