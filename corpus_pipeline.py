"""A training corpus from raw documents, in five stages over Spark.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. ``run`` writes
every stage as Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabbridge.llm.decontamination import clean_documents
from tabbridge.llm.language import keep_known
from tabbridge.llm.mixing import mix
from tabbridge.llm.ngram_join import keep_one_of_each
from tabbridge.llm.staging import result, scratch
from tabbridge.llm.tokens import tokenize_documents
from tabbridge.session import staged_within


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language stay."""
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that with the smallest id."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for: not at all, once or twice."""
    return mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and their index."""
    return tokenize_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", token_ids),
]

#: The fitted language models and the iterated mix have no SQL form; the tests cover each stage's operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the corpus' token files. A stage's table goes once the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    with scratch(spark, "pipeline") as tables:
        for _, stage in STAGES[:-1]:
            with staged_within(spark):
                docs = tables.put(stage(spark, docs, sf_dir))
            if last is not None:
                tables.drop(last)
            last = docs
        _, finish = STAGES[-1]
        return result(finish(spark, docs, sf_dir), "pipeline")
