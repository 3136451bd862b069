"""Unranked operations over documents: overview, listing, whole documents and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fernglass.operators.filters import Filter

#: Of Markdown headings.
DEPTHS = range(1, 7)
SUMMARY = ("path", "title", "tags", "updated_at", "meta")


def summaries(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("path").alias("ref"), *[c for c in SUMMARY if c in docs.columns])


def counts(docs: DataFrame, filter: Filter = Filter()) -> DataFrame:
    """One row: documents and chunks within the filter. docs has n_chunks."""
    return docs.filter(filter.column()).agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).cast("long").alias("chunks"))


def tag_counts(docs: DataFrame, filter: Filter = Filter()) -> DataFrame:
    """(tag, documents) in the order of the tags; a tag that a document repeats counts once."""
    return docs.filter(filter.column()).select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("documents")).orderBy("tag")


def tag_vocabulary(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("tags").alias("tag")).distinct()


def listed(docs: DataFrame, filter: Filter = Filter(), sort: str = "path", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of summaries, by path or newest first (then by path)."""
    order = [F.col("path")] if sort == "path" else [F.desc("updated_at"), F.col("path")]
    return summaries(docs.filter(filter.column())).orderBy(*order).offset(offset).limit(limit)


def section_ends(headings: DataFrame) -> DataFrame:
    """headings: (path, ordinal, depth, start, length). Adds section_end: where the next heading starts that is no
    deeper, or the length of the body."""
    back = W.partitionBy("path").orderBy(F.desc("ordinal")).rowsBetween(W.unboundedPreceding, -1)
    # for each depth, where the next heading of that depth or above starts: running values of one sort
    nearest = [F.last(F.when(F.col("depth") <= d, F.col("start")), ignorenulls=True).over(back) for d in DEPTHS]
    rows = headings.withColumn("_next", F.array(*nearest))
    return rows.select("path", "ordinal", "depth", "start", F.coalesce(F.get("_next", F.col("depth") - 1), F.col("length")).alias("section_end"))
