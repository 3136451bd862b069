"""What the engine asks of models, and deterministic stand-ins for tests.

An embedder gives columns of vectors for text columns and one vector for a query; a reranker gives logits of
passages. Real models can wrap an ONNX session in an Arrow function; none is part of this repository.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fernglass.functions.windows import QUERY_TOKENS, WINDOW, check_window, fitted_pair
from fernglass.operators.retrieval import word_overlap

__all__ = ["Embedder", "HashEmbedder", "LengthEmbedder", "QUERY_TOKENS", "Reranker", "TextEmbedder", "WINDOW", "check_window", "constant_reranker", "fitted_pair", "overlap_reranker", "pair_reranker"]

class Embedder(Protocol):
    model: str
    dims: int

    def documents(self, text: Column) -> Column: ...
    def query(self, text: str) -> list[float]: ...


@dataclass(frozen=True)
class TextEmbedder:
    """A model that takes lists of texts. With count_tokens, a text above the model's window is a problem of its
    document, and of a query an error; prefix is put before queries only."""

    model: str
    dims: int
    embed: Callable[[list[str]], list[list[float]]]
    count_tokens: Callable[[str], int] | None = None
    prefix: str = ""

    def query(self, text: str) -> list[float]:
        if self.count_tokens:
            check_window(self.count_tokens(self.prefix + text), "the query")
        return list(self.embed([self.prefix + text])[0])


class Reranker(Protocol):
    def __call__(self, query: str) -> Callable[[Column], Column]: ...


@dataclass(frozen=True)
class LengthEmbedder:
    """The length over 100, then 0.5, 0.25, ...: tells texts of different lengths apart, and nothing else."""

    model: str = "fake/length"
    dims: int = 4

    def documents(self, text: Column) -> Column:
        return F.array((F.length(text) / 100).cast("float"), *[F.lit(0.5 / 2 ** (i - 1)).cast("float") for i in range(1, self.dims)])

    def query(self, text: str) -> list[float]:
        return [len(text) / 100, *[0.5 / 2 ** (i - 1) for i in range(1, self.dims)]]


@dataclass(frozen=True)
class HashEmbedder:
    """Hashed words, of unit length: texts that share words are near."""

    model: str = "fake/words"
    dims: int = 64

    def documents(self, text: Column) -> Column:
        slots = F.transform(F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != ""), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(self.dims)))
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
        length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(counts, lambda x: F.when(length > 0, x / length).otherwise(F.lit(1 / math.sqrt(self.dims))).cast("float"))

    def query(self, text: str) -> list[float]:
        import re
        import zlib

        out = [0.0] * self.dims
        for w in re.split(r"\W+", text.lower()):
            if w:
                out[zlib.crc32(w.encode()) % self.dims] += 1.0
        length = math.sqrt(sum(x * x for x in out))
        return [x / length if length else 1 / math.sqrt(self.dims) for x in out]


def constant_reranker(logit: float) -> Reranker:
    return lambda query: lambda passage: F.lit(logit)


overlap_reranker: Reranker = word_overlap


def pair_reranker(tokenize: Callable[[str], list[int]], score: Callable[[list[tuple[list[int], list[int]]]], list[float]], batch: int = 32) -> Reranker:
    """A reranker over token pairs, each cut to the model's window; score gives logits of a batch of pairs."""

    def of(query: str) -> Callable[[Column], Column]:
        own = tokenize(query)

        @F.pandas_udf("double")
        def logits(passages: pd.Series) -> pd.Series:
            out: list[float] = []
            for lo in range(0, len(passages), batch):
                out += score([fitted_pair(own, tokenize(p)) for p in passages.iloc[lo : lo + batch]])
            return pd.Series(out, dtype="float64")

        return logits

    return of
