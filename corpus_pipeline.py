"""A training corpus from raw documents: toxic ones out, copies out, near copies out, sources mixed, sequences packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrafold.llm import toxicity
from terrafold.llm.exact_dedup import drop_exact_duplicates
from terrafold.llm.mixing import in_mixed_order, mixed
from terrafold.llm.ngram_join import drop_near_duplicates
from terrafold.llm.packing import pack
from terrafold.llm.queries import MIXTURE, word_bpe_file
from terrafold.llm.shared import collected, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of all labels scores below the threshold."""
    collected(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id."""
    collected(spark)
    return drop_exact_duplicates(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word sets at a similarity of 0.8 or more."""
    collected(spark)
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a mixture of all sources by MIXTURE."""
    collected(spark)
    return in_mixed_order(docs, MIXTURE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens, numbered in the order of the mixture.

    Tables don't keep the order of their rows, so positions are computed again: they follow from sources and ids.
    """
    collected(spark)
    return pack(mixed(docs, MIXTURE), word_bpe_file(), order="mix_position")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
