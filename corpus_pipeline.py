"""The corpus pipeline: documents in, packed training sequences out.

Each stage is a function of (spark, docs, sf_dir); all but the last return the
columns of documents. run() writes each stage's result as Parquet to a folder
under the shared one that the session names, and reads it again.

Defined results, by stage: the rules reject null, empty and blank texts; of rows
without a doc_id none is a copy of another; repeated rows are one; a text that
is nothing but repeated passages becomes empty, and the mix takes nothing of
it; null sources are one source; an empty table gives an empty result; further
columns are carried to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import mixing, neardup, packing, quality, substring
from orrery.llm.entries import tokenizer_path
from orrery.llm.session import checkpoint_folder, prepare

#: Policy of the quality rules, seed of the mix.
POLICY, SEED = "v2", 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return quality.apply_policy(docs, POLICY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat."""
    return substring.deduplicated(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix draws, a row for each document and pass over its source."""
    return mixing.mixed_documents(docs, SEED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("packing", pack),
]
#: Mixing draws at random and packing tokenises; SQL can't express either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's files go when the next has read
    them; those of the result go with the application."""
    prepare(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        if last:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{last}"), True)
        last = name
    return docs
