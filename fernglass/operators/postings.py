"""The inverted index of keyword search: written once, read by term.

A posting says how often a field of a chunk has a term, and how long the field is. The title is the same for all chunks
of a document, so its postings are the document's and stand for n chunks. Postings are range-partitioned and sorted by
term, so a search, whose terms are ranges of values, reads the row groups that hold them and no text. Ranges are cut
within a term as well, so a term that most chunks have is no single task.

Scores are those of operators/ranking.py: Okapi BM25 by field over the whole corpus, whatever the filter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.functions.text import tokens
from fernglass.operators.ranking import B, BOOSTS, K1, KEY, query_terms

POSTINGS = "term string, field string, path string, ordinal int, n int, tf int, length int"
FIELDS = "field string, chunks long, length long"
#: Postings of a field that holds for all chunks of its document have this ordinal.
EVERY = -1


def postings_of(chunks: DataFrame) -> DataFrame:
    """chunks: path, ordinal (0, 1, ... in each document), title, breadcrumb, text."""

    def counted(rows: DataFrame, field: str) -> DataFrame:
        rows = rows.select("path", "ordinal", "n", tokens(F.col(field)).alias("t"))
        rows = rows.select("path", "ordinal", "n", F.size("t").alias("length"), F.explode("t").alias("term"))
        return rows.groupBy("term", "path", "ordinal", "n", "length").agg(F.count("*").cast("int").alias("tf")).select("term", F.lit(field).alias("field"), "path", "ordinal", "n", "tf", "length")

    titles = chunks.groupBy("path").agg(F.min("title").alias("title"), F.count("*").cast("int").alias("n")).withColumn("ordinal", F.lit(EVERY))
    own = chunks.withColumn("n", F.lit(1))
    return counted(titles, "title").unionByName(counted(own, "breadcrumb")).unionByName(counted(own, "text"))


def lengths_of(chunks: DataFrame) -> DataFrame:
    """(field, chunks, length): how many chunks there are, and how many tokens they have in a field."""
    sums = [F.count("*").alias("n"), *(F.coalesce(F.sum(F.size(tokens(F.col(f)))), F.lit(0)).alias(f) for f in BOOSTS)]
    return chunks.agg(*sums).select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col("n").alias("chunks"), F.col(f).alias("length")) for f in BOOSTS))).alias("x")).select("x.*")


def write_index(chunks: DataFrame, path: str) -> None:
    """The index of chunks as two Parquet tables below a folder."""
    postings_of(chunks).repartitionByRange("term", "path").sortWithinPartitions("term", "path", "ordinal").write.parquet(f"{path}/postings")
    lengths_of(chunks).coalesce(1).write.parquet(f"{path}/fields")


@dataclass(frozen=True)
class KeywordIndex:
    """postings, the number of chunks, and the mean length of each field."""

    postings: DataFrame
    chunks: int
    mean: Mapping[str, float]

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> KeywordIndex:
        fields = spark.read.schema(FIELDS).parquet(f"{path}/fields").collect()  # a row per field
        chunks = fields[0].chunks if fields else 0
        return cls(spark.read.schema(POSTINGS).parquet(f"{path}/postings"), chunks, {r.field: r.length / chunks if chunks else 0.0 for r in fields})

    def matches(self, terms: Sequence[str], prefix: bool) -> DataFrame:
        """(q, field, path, ordinal, n, tf, length): how often a field has tokens that term q matches."""
        fits = lambda t: F.startswith(F.col("term"), F.lit(t)) if prefix else F.col("term") == t
        any_: Column = F.lit(False)
        for t in terms:
            any_ = any_ | fits(t)
        which = F.array_compact(F.array(*(F.when(fits(t), F.lit(k)) for k, t in enumerate(terms))))
        rows = self.postings.filter(any_).select(F.explode(which).alias("q"), "field", "path", "ordinal", "n", "tf", "length")
        return rows.groupBy("q", "field", "path", "ordinal").agg(F.max("n").alias("n"), F.sum("tf").alias("tf"), F.max("length").alias("length")) if prefix else rows

    def keyword(self, query: str, *, allowed: DataFrame | None = None, prefix: bool = False, boosts: Mapping[str, float] | None = None) -> DataFrame:
        """(path, ordinal, score) of the chunks with a term of the query; none if the query has no term. allowed: the
        documents (path) that a filter leaves; statistics are those of all."""
        terms = query_terms(query)
        found = self.matches(terms, prefix) if terms else self.postings.limit(0).withColumn("q", F.lit(0))
        df = found.groupBy("q", "field").agg(F.sum("n").cast("double").alias("df"))  # a row per term and field
        if allowed is not None:
            found = found.join(allowed.select("path"), "path", "left_semi")
        pick = lambda values: F.element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(float(v))))), F.col("field"))
        tf = F.col("tf").cast("double")
        idf = F.log(1 + (F.lit(float(self.chunks)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = K1 * (1 - B + B * F.col("length") / pick({f: m or 1.0 for f, m in self.mean.items()}))
        scored = found.join(F.broadcast(df), ["q", "field"]).withColumn("score", pick(dict(boosts or BOOSTS)) * idf * tf * (K1 + 1) / (tf + norm))
        # a document's posting counts for each of its chunks
        whole = scored.filter(F.col("ordinal") == EVERY).groupBy("path", "n").agg(F.sum("score").alias("score")).select("path", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ordinal"), "score")
        own = scored.filter(F.col("ordinal") != EVERY).select("path", "ordinal", "score")
        return own.unionByName(whole).groupBy(*KEY).agg(F.sum("score").alias("score"))
