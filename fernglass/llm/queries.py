"""Queries over the test tables that apply each operator with its production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm.common import crc_mod, table
from fernglass.llm.langid import fit_languages, identify_languages
from fernglass.llm.media import document_media
from fernglass.llm.mixing import MIX_SQL, mix_sources
from fernglass.llm.neighbours import search
from fernglass.llm.packing import pack_documents
from fernglass.llm.shingles import link_documents
from fernglass.llm.suffixes import remove_repeats
from fernglass.llm.toxicity import fit_toxicity
from fernglass.llm.urls import judge_urls
from fernglass.llm.warc import WARC_SQL, read_archives, write_archives


def op1_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents")).drop("text_hash", "component")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs, docs.filter(crc_mod("doc_id", 4) != 2).select("doc_id", "lang"))
    out = identify_languages(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source", "text_hash")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages")))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans", "text_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    out = fit_toxicity(docs, labels).score(docs)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


QUERIES = {"op1_shingles": op1_shingles, "op2_langid": op2_langid, "op3_mixing": op3_mixing, "op4_packing": op4_packing, "op5_neighbours": op5_neighbours, "op6_urls": op6_urls, "op7_media": op7_media, "op8_warc": op8_warc, "op9_suffixes": op9_suffixes, "op10_toxicity": op10_toxicity}
SQL = {"op3_mixing": MIX_SQL, "op8_warc": WARC_SQL}
