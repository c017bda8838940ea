"""A training corpus from documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import Scratch, table
from lodestar.llm.contamination import keep_uncontaminated
from lodestar.llm.language import keep_known_language
from lodestar.llm.mixing import take_mix
from lodestar.llm.similarity import keep_one_of_similar
from lodestar.llm.training_order import to_shards

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("language_id", keep_known_language),
    ("ngram_jaccard", keep_one_of_similar),
    ("decontaminate", keep_uncontaminated),
    ("mix_sources", take_mix),
    ("training_order", to_shards),
]

#: SQL can't express naive Bayes, the rounding tree's draws or the tokenizer: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
