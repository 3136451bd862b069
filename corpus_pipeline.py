"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before it kept. The tables between stages are Parquet, so a stage that loses
executors starts from files; a table goes when the next one is written. The last stage returns the sequences' texts.

Defined results: null and empty texts pass every stage and end as pieces of 0 words in no bin (the mix takes them as
often as their source's whole copies); null ids come after all others; of rows that repeat id and text one stays, rows
that share an id but not their text are documents of their own; very long texts are scored, compared and cut whole; an
empty table gives an empty result; extra columns are carried as they are up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernglass.llm.common import crc_mod, spent, stored, table
from fernglass.llm.mixing import mix_sources, repeated
from fernglass.llm.packing import pack_texts
from fernglass.llm.stages import without_near_copies, without_repeats, without_toxic
from fernglass.llm.toxicity import fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field, trained on the labelled folds, doesn't find toxic."""
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    return without_toxic(docs, fit_toxicity(docs, labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five words overlap by 0.8 or more."""
    return without_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that earlier ones hold."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return repeated(docs, mix_sources(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, with their texts, in sequences of 512 to 4096 words."""
    return pack_texts(docs)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("repeats", repeats), ("mixing", mixing), ("packing", packing)]

#: No stage before the packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        spent(before)
    return STAGES[-1][1](spark, docs, sf_dir)
