"""Candidate chunks: keyword (BM25 over fields), semantic (exact cosine) and hybrid.

Keyword scores are Okapi BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)), summed over the fields title, breadcrumb
and text, over the whole corpus whatever the filter. Terms match whole tokens; with prefix=True also their beginnings.
keyword() here reads all chunks, for corpora without an index; operators/postings.py has the same search over one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fernglass.functions.scores import cosine, finite, vector
from fernglass.functions.text import STOPWORDS, tokens
from fernglass.operators.filters import Filter

K1, B = 1.2, 0.75
BOOSTS = {"title": 1.1, "breadcrumb": 1.0, "text": 1.0}
EPSILON = 2.220446049250313e-16
PER_DOCUMENT = 2
KEY = ("path", "ordinal")


def query_terms(query: str) -> list[str]:
    """The query's distinct search tokens, in order."""
    found = re.findall(r"\w+", query.lower())
    return [t for t in dict.fromkeys(found) if t not in STOPWORDS]


@dataclass(frozen=True)
class Statistics:
    """Of the whole corpus: chunks, mean length of each field, and how many chunks have each term, by field."""

    chunks: int
    mean: dict[str, float]
    df: dict[str, dict[str, int]]


def with_tokens(chunks: DataFrame, fields: Sequence[str] = tuple(BOOSTS)) -> DataFrame:
    return chunks.withColumns({f"{f}_tokens": tokens(F.col(f)) for f in fields if f in chunks.columns})


def _tf(field: str, term: str, prefix: bool) -> Column:
    return F.size(F.filter(f"{field}_tokens", lambda t: t.startswith(term) if prefix else t == term))


def statistics(indexed: DataFrame, terms: Sequence[str], prefix: bool = False) -> Statistics:
    """One pass over the tokens; a row of numbers comes back."""
    fields = [f for f in BOOSTS if f"{f}_tokens" in indexed.columns]
    aggs = [F.count("*").alias("n"), *(F.avg(F.size(f"{f}_tokens")).alias(f"mean_{f}") for f in fields)]
    aggs += [F.count(F.when(_tf(f, t, prefix) > 0, 1)).alias(f"df_{f}_{k}") for f in fields for k, t in enumerate(terms)]
    r = indexed.agg(*aggs).first()
    return Statistics(r["n"], {f: r[f"mean_{f}"] or 0.0 for f in fields}, {f: {t: r[f"df_{f}_{k}"] for k, t in enumerate(terms)} for f in fields})


def bm25(stats: Statistics, terms: Sequence[str], prefix: bool = False, boosts: dict[str, float] | None = None) -> Column:
    import math

    score = F.lit(0.0)
    for field in stats.mean:
        size = F.size(f"{field}_tokens")
        for term in terms:
            df = stats.df[field][term]
            if df:
                idf = math.log(1 + (stats.chunks - df + 0.5) / (df + 0.5))
                tf = _tf(field, term, prefix).cast("double")
                norm = K1 * (1 - B + B * size / F.lit(stats.mean[field]))
                score = score + F.when(tf > 0, F.lit((boosts or BOOSTS)[field] * idf) * tf * (K1 + 1) / (tf + norm)).otherwise(0.0)
    return score


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best by score; ties in the order of path and ordinal."""
    return scored.withColumn("score", finite(F.col("score"))).orderBy(F.desc("score"), *KEY).limit(k)


def keyword(chunks: DataFrame, query: str, filter: Filter = Filter(), *, prefix: bool = False, stats: Statistics | None = None) -> DataFrame:
    """(path, ordinal, score) of the chunks with a term of the query; none if the query has no term."""
    indexed, terms = with_tokens(chunks), query_terms(query)
    if not terms:
        return chunks.select(*KEY, F.lit(0.0).alias("score")).limit(0)
    stats = stats or statistics(indexed, terms, prefix)
    return indexed.filter(filter.column()).select(*KEY, bm25(stats, terms, prefix).alias("score")).filter("score > 0")


def semantic(chunks: DataFrame, query: Sequence[float], filter: Filter = Filter(), embedding: str = "embedding") -> DataFrame:
    """(path, ordinal, score) of every chunk."""
    return chunks.filter(filter.column()).select(*KEY, finite(cosine(F.col(embedding), vector(query))).alias("score"))


def hybrid(text: DataFrame, near: DataFrame, text_weight: float = 0.5, near_weight: float = 0.5) -> DataFrame:
    """Both sides as shares of their greatest score, weighted. Of the semantic side only positive scores count."""
    sides = text.select(*KEY, "score", F.lit(True).alias("words")).unionByName(near.filter(F.col("score") >= EPSILON).select(*KEY, "score", F.lit(False).alias("words")))
    most = sides.groupBy("words").agg(F.max("score").alias("most"))  # two rows
    weight = F.when(F.col("words"), float(text_weight)).otherwise(float(near_weight))
    share = F.when(F.col("most") != 0, weight * (F.col("score") / F.col("most"))).otherwise(0.0)
    return sides.join(F.broadcast(most), "words").groupBy(*KEY).agg(F.sum(share).alias("score"))


def capped(candidates: DataFrame, most: int = PER_DOCUMENT) -> DataFrame:
    """Each document's best candidates."""
    order = W.partitionBy("path").orderBy(F.desc("score"), "ordinal")
    return candidates.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")
