"""From raw documents to packed sequences, one operator of millrace.llm a stage.

Every stage works on all rows that the stage before it kept; results are written as Parquet in the
folder that the cluster shares and read again.  All but the last stage return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, packing, quality, simhash, substrings
from millrace.llm.common import Scratch, documents, tokenizer_path
from millrace.sources.tables import table


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of SimHash near duplicates."""
    return simhash.keep_first(docs, size=3, radius=2)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of a smaller id has as well."""
    return substrings.cut_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for every time a document is taken."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences."""
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", drop_poor),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_passages),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

# A trained classifier, XXH64 and a tokenizer: tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage-{n}")
        scratch.drop(f"stage-{n - 1}")
    return docs
