"""Language identification by nearest centroid: TF-IDF vectors of hashed byte n-grams, of unit length, are compared
by cosine with several clustered centroids per language; a text far from its nearest centroid is marked rejected.

Training takes at most MAX_TRAIN labelled texts a language, fewer where MAX_TRAIN_TOTAL shared by all languages is less
(but one), chosen by a hash of the id and whole, however long; the inverse document frequencies are part of that fit.
Prediction covers whole texts. Defined results: null texts and texts without a letter are `und` with score 0 and
rejected; without training texts all are; ties go to the language that comes first; of several labels of an id the
first holds; rows with a null id are predicted but not learned from; repeated rows get equal results; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm.common import LOWER, texts
from fernglass.llm.training import sampled

MAX_TRAIN = 600
#: Training texts of all languages together, whatever their number.
MAX_TRAIN_TOTAL = 12_000
DIMS = 4096
#: Texts that are counted at once: a dense row of DIMS numbers each.
ROWS = 256
CENTROIDS = 4
#: A text is rejected if it is further from its centroid than this share of its language's training texts.
REJECT_QUANTILE = 0.999
#: ... and by this much more, in cosine distance.
REJECT_MARGIN = 0.05

FOLD = LOWER.copy()
FOLD[[i for i in range(128) if not (65 <= i <= 90 or 97 <= i <= 122)]] = 0x20
_rng = np.random.default_rng(11)
ONE, TWO, THREE = (_rng.integers(0, 2**32, 256, dtype=np.uint32) for _ in range(3))


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per text, how often each hashed n-gram of 2 and 3 bytes occurs; what is no letter counts as a space."""
    n, rows = len(data), len(off) - 1
    if n < 2:
        return np.zeros((rows, DIMS), np.float32)
    x = FOLD[data]
    base = np.repeat(np.arange(rows, dtype=np.int64) * DIMS, np.diff(off))
    inside = np.ones(n, bool)
    inside[off[1:][off[1:] > 0] - 1] = False  # the last byte of each text begins no n-gram
    inside[-1] = False
    two = ONE[x[:-1]] ^ TWO[x[1:]]
    ok = inside[:-1] & ((x[:-1] != 0x20) | (x[1:] != 0x20))
    out = np.bincount((base[:-1] + ((two * np.uint32(0x9E3779B1)) >> np.uint32(20)))[ok], minlength=rows * DIMS)
    if n > 2:
        three = two[:-1] ^ THREE[x[2:]] ^ np.uint32(0x5BD1E995)
        ok = inside[:-2] & inside[1:-1] & ((x[:-2] != 0x20) | (x[1:-1] != 0x20))
        out += np.bincount((base[:-2] + ((three * np.uint32(0x85EBCA6B)) >> np.uint32(20)))[ok], minlength=rows * DIMS)
    return out.reshape(rows, DIMS).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; each further start is the vector furthest from the ones before."""
    c = unit(x.mean(0, keepdims=True))
    while len(c) < min(k, len(x)):
        c = np.concatenate((c, x[[(x @ c.T).max(1).argmin()]]))
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        c = unit(c)
    return c


class LanguageModel:
    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, reach: np.ndarray):
        self.langs, self.idf, self.centroids, self.owner, self.reach = langs, idf, centroids, owner, reach

    @classmethod
    def fit(cls, tf: np.ndarray, langs: list[str]) -> LanguageModel:
        names = sorted(set(langs))
        idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))).astype(np.float32) + 1
        x, y = unit(np.log1p(tf) * idf), np.array([names.index(v) for v in langs])
        parts = [clustered(x[y == k], CENTROIDS) for k in range(len(names))]
        reach = np.array([np.quantile(1 - (x[y == k] @ c.T).max(1), REJECT_QUANTILE) + REJECT_MARGIN for k, c in enumerate(parts)])
        return cls(names, idf, np.concatenate(parts) if parts else np.zeros((0, DIMS), np.float32), np.repeat(np.arange(len(names)), [len(c) for c in parts]), reach)

    def nearest(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: language, cosine, whether it is rejected."""
        cos = unit(np.log1p(tf) * self.idf) @ self.centroids.T
        best = cos.argmax(1)
        top = np.clip(cos[np.arange(len(cos)), best].astype(float), 0, 1)
        return self.owner[best], top, 1 - top > self.reach[self.owner[best]]


def fit_languages(docs: DataFrame, train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> LanguageModel:
    """train: (id, lang) of the rows to learn from."""
    told = train.select(F.col(id_col).alias("id"), F.col("lang").alias("lang")).filter("id is not null and lang is not null").groupBy("id").agg(F.min("lang").alias("lang"))
    langs = told.select("lang").distinct().count()
    ids = sampled(told, "id", "lang", max(1, min(max_train, MAX_TRAIN_TOTAL // max(1, langs))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").filter(F.col("text").rlike(r"\p{L}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in texts(batch, "text", rows=ROWS):
                tf = counts(data, off)
                held = [np.flatnonzero(x) for x in tf]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo).cast(pa.string()), batch.column("lang").slice(lo, hi - lo), pa.array([x.astype(np.uint16).tobytes() for x in held], pa.binary()), pa.array([row[x].tobytes() for row, x in zip(tf, held, strict=True)], pa.binary())], ["id", "lang", "at", "tf"])

    found = sorted(tuple(r) for r in rows.mapInArrow(run, "id string, lang string, at binary, tf binary").collect())
    tf = np.zeros((len(found), DIMS), np.float32)
    for row, r in zip(tf, found, strict=True):
        row[np.frombuffer(bytes(r[2]), np.uint16)] = np.frombuffer(bytes(r[3]), np.float32)
    return LanguageModel.fit(tf, [r[1] for r in found])


def identify_languages(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score, rejected."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in texts(batch, "text", rows=ROWS):
                own = np.array(batch.column("lettered").slice(lo, hi - lo).to_pylist(), bool)
                if model.langs:
                    lang, cos, far = model.nearest(counts(data, off))
                else:
                    own, lang, cos, far = own & False, np.zeros(hi - lo, int), np.zeros(hi - lo), np.ones(hi - lo, bool)
                pred = [model.langs[k] if ok else "und" for k, ok in zip(lang, own, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(np.where(own, cos, 0.0)), pa.array(far | ~own)], [id_col, "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")
