"""Documents to training sequences: quality rules, toxicity, near-duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of its `docs`. All but the last return
the columns of `docs`. `run` writes every stage as a table in the shared folder and reads it back,
so that a later stage never repeats an earlier one and losing executors loses nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelake.llm import mixing, near_texts, packing, quality_rules, toxicity
from cuelake.llm.common import stage_table


def _own(result: DataFrame, docs: DataFrame) -> DataFrame:
    return result.select(*[result[c] for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source."""
    return _own(quality_rules.keep_good(docs), docs)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic; the lexicon is learnt from the labels of what is left."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _own(toxicity.keep_civil(docs, model), docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id: linked by SimHash fingerprints (op10) or at 0.8
    or more of common five-word shingles."""
    return _own(near_texts.keep_first_of_both(docs), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return _own(mixing.repeat_mixed(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keeps_spaces=False, end_id=1)


STAGES = [
    ("quality rules", quality),
    ("toxicity", civil),
    ("near-duplicates", distinct_documents),
    ("mix", mixed),
    ("pack", packed),
]

# The stages learn, hash and tokenize; SQL cannot say the whole. tests/llm checks each by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline_{name.replace(' ', '_')}")
    return STAGES[-1][1](spark, docs, sf_dir)
