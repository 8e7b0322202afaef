"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor kept, written as Parquet in the shared folder. All but the
last return documents with their columns; the last returns the placed pieces.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wanderlens.llm import jaccard, line_dedup, mixture, packing, perplexity
from wanderlens.sources.stored import n_stored, stored_alone


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside the perplexity band of their language go."""
    return perplexity.accepted(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages of three or more lines go."""
    return line_dedup.without_repeats(docs)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return jaccard.one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; at the ends of a shard's share, parts of them."""
    return mixture.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    placed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return placed.withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", remove_repeated_lines),
    ("n-gram jaccard join", keep_one_of_similar),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The language model and the tokenizer have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Of what the stages store only the last documents and the pieces' own table stay."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), n_stored()
    for _, stage in STAGES[:-1]:
        docs = stored_alone(spark, partial(stage, spark, docs, sf_dir), "stage", start)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
