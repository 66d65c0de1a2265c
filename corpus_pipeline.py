"""The training-corpus pipeline: toxicity, quality rules, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. run() writes each stage's rows to the shared folder and rereads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from akuru.llm import mixing, packing, quality, simhash, toxicity
from akuru.llm.common import discard, materialize, small_batches, table, temporary
from akuru.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on labelled rows of docs, doesn't reject."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules on hosts that do."""
    return quality.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of SimHash links and near copies (Jaccard 0.8 of five-word shingles)."""
    return simhash.keep_first_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their sources' targets ask."""
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its sequence and offset; copies of a document are packed each on its own."""
    pieces = packing.cut(docs, tokenizer()).withColumn("ids_crc32", packing.crc(F.col("ids"))).drop("ids")
    return packing.pack(pieces, docs.count()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("quality_rules", keep_quality), ("simhash_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]
#: The classifier, the fingerprints and the tokenizer have no SQL; tests hold the stages against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with small_batches(spark), temporary(spark) as keep:  # what a stage stores for itself goes with it
            docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
