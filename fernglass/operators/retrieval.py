"""From candidates to results: relevance, signals, cutoff, merging of neighbours, order and limit."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fernglass.errors import InvalidRequest
from fernglass.functions.scores import blend, logistic, recency, relative, tag_signal
from fernglass.functions.text import is_blank
from fernglass.operators.filters import number, whole

MODES = ("hybrid", "semantic", "keyword")
TAG = "tag:"
MOST_WEIGHT = 0.5
RECENCY_WEIGHT = 0.15


@dataclass(frozen=True)
class Options:
    """Defaults of a search; half_life in days, weights by signal (recency, tag:<name>)."""

    mode: str = "hybrid"
    candidates: int = 30
    limit: int = 3
    min_score: float = 0.0
    expand: int = 0
    weights: Mapping[str, float] = field(default_factory=lambda: {"recency": RECENCY_WEIGHT})
    half_life: float = 90.0
    rerank: bool = True
    hybrid_weights: tuple[float, float] = (0.5, 0.5)

    def checked(self, known_tags: set[str] | None = None) -> Options:
        if self.mode not in MODES:
            raise InvalidRequest(f"mode must be one of {', '.join(MODES)}, not {self.mode!r}")
        whole("candidates", self.candidates, 1)
        whole("limit", self.limit, 1, 10)
        whole("expand", self.expand, 0, 2)
        number("min_score", self.min_score)
        if number("half_life", self.half_life) <= 0:
            raise InvalidRequest("half_life must be above 0")
        if any(number("hybrid weight", w) <= 0 for w in self.hybrid_weights):
            raise InvalidRequest("hybrid weights must be above 0")
        check_weights(self.weights, known_tags)
        return self

    def merged(self, weights: Mapping[str, float | None] | None = None, **changes: Any) -> Options:
        """Key by key; what is None leaves the default."""
        own = {**self.weights, **{k: v for k, v in (weights or {}).items() if v is not None}}
        return replace(self, weights=own, **{k: v for k, v in changes.items() if v is not None})


def tag_weights(weights: Mapping[str, float]) -> dict[str, float]:
    return {k[len(TAG) :]: w for k, w in weights.items() if k.startswith(TAG)}


def greatest_tag_weight(weights: Mapping[str, float]) -> float:
    return max((abs(w) for w in tag_weights(weights).values()), default=0.0)


def check_weights(weights: Mapping[str, float], known_tags: set[str] | None = None) -> None:
    for name, w in weights.items():
        is_tag = name.startswith(TAG) and name != TAG
        if name != "recency" and not is_tag:
            raise InvalidRequest(f'weight "{name}": signals are recency and {TAG}<name>')
        least = -1 if is_tag else 0
        if isinstance(w, bool) or not isinstance(w, (int, float)) or not math.isfinite(w) or not least <= w <= 1:
            raise InvalidRequest(f'weight "{name}" must lie between {least} and 1, not {w}')
        if is_tag and known_tags is not None and name[len(TAG) :] not in known_tags:
            raise InvalidRequest(f'weight "{name}": no document has that tag')
    own, tags = weights.get("recency", 0.0), greatest_tag_weight(weights)
    if own + tags > MOST_WEIGHT:
        hint = " (its default; lower it by setting recency)" if tags and own == RECENCY_WEIGHT else ""
        raise InvalidRequest(f"weights may add up to {MOST_WEIGHT}, not {own + tags}: recency {own}{hint} and the greatest tag weight {tags}")


def relevance_of(hits: DataFrame, rerank: bool) -> DataFrame:
    """hits: score, and with rerank also logit (null where nothing could be ranked). Adds rerank and relevance.
    Without a reranker the best hit sets the scale."""
    if rerank:
        return hits.withColumn("rerank", F.col("logit")).withColumn("relevance", F.when(F.col("logit").isNull(), 0.0).otherwise(logistic(F.col("logit"))))
    most = F.max("score").over(W.partitionBy())
    return hits.withColumn("rerank", F.lit(None).cast("double")).withColumn("relevance", relative(F.col("score"), most))


def with_signals(hits: DataFrame, options: Options, now_ms: int) -> DataFrame:
    """hits: relevance, updated_at, tags. Adds recency, tag_signal, signals (those with a weight) and final."""
    tags = tag_weights(options.weights)
    out = hits.withColumn("recency", recency(F.col("updated_at"), now_ms, options.half_life)).withColumn("tag_signal", tag_signal(F.col("tags"), tags))
    pairs: list[Column] = []
    if "recency" in options.weights:
        pairs += [F.lit("recency"), F.col("recency")]
    if tags:
        pairs += [F.lit("tags"), F.col("tag_signal")]
    out = out.withColumn("signals", F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>"))
    return out.withColumn("final", blend(F.col("relevance"), F.col("recency"), F.col("tag_signal"), options.weights.get("recency", 0.0), greatest_tag_weight(options.weights)))


def merged(hits: DataFrame, last: DataFrame, expand: int) -> DataFrame:
    """Neighbouring hits of a document as one range each.

    hits: path, ordinal, final, reranked, and more; last: (path, last), each document's last ordinal. Ranges of a hit
    and `expand` chunks around it that overlap or touch are one. Returns path, first, last and best, the row of the
    hit that ranks first in it.
    """
    rows = hits.join(last, "path").withColumn("_from", F.greatest(F.lit(0), F.col("ordinal") - expand)).withColumn("_to", F.least(F.col("last"), F.col("ordinal") + expand))
    by_path = W.partitionBy("path").orderBy("ordinal")
    reach = F.max("_to").over(by_path.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("_from") > reach + 1, 1).otherwise(0)).withColumn("_island", F.sum("_new").over(by_path))
    best = F.max_by(F.struct(*hits.columns), F.struct(F.col("reranked"), F.col("final"), -F.col("ordinal")))
    return rows.groupBy("path", "_island").agg(F.min("_from").alias("first"), F.max("_to").alias("last"), best.alias("best")).drop("_island")


def joined_text(ranges: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranges: (path, first, last, ...). Adds text: the chunks of the range as they follow each other."""
    own = chunks.select(F.col("path").alias("_p"), F.col("ordinal").alias("_o"), F.col("text").alias("_t"))
    rows = ranges.join(own, (F.col("path") == F.col("_p")) & F.col("_o").between(F.col("first"), F.col("last")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]), "")
    return rows.groupBy(*ranges.columns).agg(text.alias("text"))


def retrieve(candidates: DataFrame, chunks: DataFrame, options: Options, now_ms: int, rerank: Callable[[Column], Column] | None = None) -> DataFrame:
    """candidates: (path, ordinal, score), capped. chunks: the index with title, tags, updated_at, breadcrumb, anchor,
    text. rerank: logits of passages, as a column. Returns the results in order, with their rank."""
    use = options.rerank and rerank is not None
    # at most options.candidates rows; the scan of the chunks then reads what it has of their documents
    rows = candidates.select("path", "ordinal", "score").limit(options.candidates).collect()
    few = F.broadcast  # what is made of these rows is no longer than they are
    candidates = few(chunks.sparkSession.createDataFrame(rows, "path string, ordinal int, score double"))
    chunks = chunks.filter(F.col("path").isin(sorted({r.path for r in rows})))
    found = chunks.join(candidates, ["path", "ordinal"])
    if use:
        passage = F.concat_ws("\n", "breadcrumb", "text")
        found = found.withColumn("logit", F.when(~is_blank(F.col("text")), rerank(passage)))
    scored = with_signals(relevance_of(found, use), options, now_ms).withColumn("reranked", F.col("rerank").isNotNull())
    kept = scored.filter(F.col("relevance") >= options.min_score).select("path", "ordinal", "final", "reranked", "score", "rerank", "relevance", "signals", "breadcrumb", "anchor")
    last = few(chunks.groupBy("path").agg(F.max("ordinal").alias("last")))
    order = [F.desc("best.reranked"), F.desc("best.final"), F.col("path"), F.col("first")]
    best = merged(kept, last, options.expand).orderBy(*order).limit(options.limit)
    out = joined_text(few(best.select("path", "first", "last", "best")), chunks)
    ref = F.when(F.col("best.anchor") == "", F.col("path")).otherwise(F.concat_ws("#", "path", "best.anchor"))
    scores = F.struct(F.col("best.score").alias("retrieval"), F.col("best.rerank").alias("rerank"), F.col("best.relevance").alias("relevance"), F.col("best.signals").alias("signals"), F.col("best.final").alias("final"))
    ranked = out.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return ranked.select("rank", ref.alias("ref"), "path", F.col("best.breadcrumb").alias("breadcrumb"), F.col("best.anchor").alias("anchor"), "text", "first", "last", scores.alias("scores")).orderBy("rank")


def word_overlap(query: str) -> Callable[[Column], Column]:
    """A plain stand-in for a cross-encoder: how many words of the query a passage holds, less one."""
    words = list(dict.fromkeys(query.lower().split()))

    def logits(passage: Column) -> Column:
        low = F.lower(passage)
        return sum((F.contains(low, F.lit(w)).cast("double") for w in words), F.lit(0.0)) - 1.0

    return logits
