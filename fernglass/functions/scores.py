"""Scores as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def recency(updated_at: Column, now_ms: int, half_life_days: float) -> Column:
    """Halves with every half-life; 1 for the future."""
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - updated_at) / F.lit(DAY_MS))
    return F.pow(F.lit(0.5), age / F.lit(half_life_days))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def finite(x: Column) -> Column:
    """0 in place of what is no finite number."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), 0.0).otherwise(x)


def relative(score: Column, greatest: Column) -> Column:
    """A share of the greatest score; what isn't positive is 0."""
    return F.when((greatest > 0) & (score > 0), score / greatest).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def applied_tag_weight(tags: Column, weights: Mapping[str, float]) -> Column:
    """Of the weights of a document's tags the one of greatest magnitude, the negative one of two such; 0 if none."""
    out = F.lit(0.0)
    # the last branch that is written is the first to be asked
    for tag, w in sorted(weights.items(), key=lambda x: (abs(x[1]), -x[1], x[0])):
        out = F.when(F.array_contains(tags, tag), float(w)).otherwise(out)
    return out


def tag_signal(tags: Column, weights: Mapping[str, float]) -> Column:
    most = max((abs(w) for w in weights.values()), default=0.0)
    return applied_tag_weight(tags, weights) / most if most else F.lit(0.0)


def blend(relevance: Column, recency_: Column, tags: Column, recency_weight: float, tags_weight: float) -> Column:
    return F.lit(1.0 - recency_weight - tags_weight) * relevance + F.lit(recency_weight) * recency_ + F.lit(tags_weight) * tags
