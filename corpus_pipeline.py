"""A corpus pipeline: classify, join near copies, decontaminate, mix, write tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of documents. Between stages the rows are
written as Parquet and read again, so a lost executor costs no more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.llm import decontaminate, jaccard_join, mixing, token_output, weak_labels
from causeway.llm.registry import tokenizer_path
from causeway.llm.rows import documents
from causeway.shared import table

#: The stages' models and joins have no SQL counterpart; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weak_labels.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.read(*token_output.write(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
