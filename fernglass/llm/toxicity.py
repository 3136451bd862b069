"""Toxic spans by a linear-chain conditional random field with two states, and document scores from its marginals.

Labels are given by document, so tokens are labelled first: in a toxic training document those words, or word
beginnings, that toxic documents hold far more often than clean ones (a log ratio above TOLD that can't be chance), counted by the different
words that they follow, so that copies and shared passages say no more than one document.
The field has emission weights for a word's and its beginnings' log ratios and a weight for each pair of
neighbouring states, fitted by gradient ascent of the conditional likelihood. Forward-backward gives each token's
probability; their sum, maximum and density make the document's score by logistic regression; runs of tokens of
probability 0.5 or more are the offending spans.

Training takes at most MAX_TRAIN documents a class, chosen by a hash of the id, and of these, in the order of a hash of
their texts, as many as have MAX_TRAIN_CHARS characters together (a text with more than a quarter of that isn't
learned from); the field's weights are fitted on the first of these up to LEARN_TOKENS tokens. Texts are learned from
and scored whole. Defined results: a null or empty text, or one without words, has no spans and the
score of a document with no toxic word; without training documents of both classes every score is the share of
toxic ones (0 if there are none); repeated rows score alike; of several labels of an id the greatest holds; rows with
a null id are scored but not learned from; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fernglass.llm.common import LOWER, SLICE_BYTES, Rolling, texts, words
from fernglass.llm.training import sampled

MAX_TRAIN = 2000
#: Characters of all training texts together: what the driver holds.
MAX_TRAIN_CHARS = 8_000_000
#: Tokens of the training documents that the field's weights are fitted on; all of them count for the log ratios
#: and for the documents' scores.
LEARN_TOKENS = 250_000
TABLE = 1 << 18
BEGINNINGS = (4, 5)
#: Log ratio from which on a word of a toxic training document is labelled toxic.
TOLD = 2.0
RUN = 64
SPAN = "array<struct<start:int,end:int,probability:double>>"

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and, for the word and each of its beginnings, a place in the table of ratios."""
    low = LOWER[data]
    start, end, row = words(low, off, LETTER)
    h = Rolling(low)
    places = [h.ranges(start, end)]
    for n in BEGINNINGS:
        places.append(h.ranges(start, np.minimum(start + n, end)) ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
    return start, end, row, np.stack([(x >> np.uint64(20)) % np.uint64(TABLE) for x in places], 1).astype(np.int64)


class Field:
    """Marginals of a two-state chain over many documents at once. Documents are cut in runs of RUN tokens; the
    product of a run's matrices carries the state from run to run, so the result is exact at any length."""

    def __init__(self, trans: np.ndarray):
        self.m = np.exp(trans)

    def _padded(self, emission: np.ndarray, row: np.ndarray, n_rows: int):
        n = np.bincount(row, minlength=n_rows)
        runs = -(-n // RUN)
        first = np.concatenate(([0], np.cumsum(runs)))
        at = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
        slot = (first[row] + at // RUN) * RUN + at % RUN
        e = np.ones(first[-1] * RUN)
        e[slot] = np.exp(np.clip(emission, -30, 30))
        valid = np.zeros(first[-1] * RUN, bool)
        valid[slot] = True
        return e.reshape(-1, RUN), valid.reshape(-1, RUN), runs, first, slot

    def marginals(self, emission: np.ndarray, row: np.ndarray, n_rows: int, pairs: bool = False):
        """Of each token, the probability of state 1; with pairs, also the expected number of each pair of states."""
        if not len(row):
            return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
        e, valid, runs, first, slot = self._padded(emission, row, n_rows)
        m, k = self.m, len(e)
        # product of each run's matrices M_t[a, b] = m[a, b] * (e_t if b else 1)
        p = np.zeros((4, k))
        p[0] = p[3] = 1
        for t in range(RUN):
            x, ok = e[:, t], valid[:, t]
            q = np.stack([p[0] * m[0, 0] + p[1] * m[1, 0], (p[0] * m[0, 1] + p[1] * m[1, 1]) * x, p[2] * m[0, 0] + p[3] * m[1, 0], (p[2] * m[0, 1] + p[3] * m[1, 1]) * x])
            q /= q.sum(0)
            p = np.where(ok, q, p)
        # states before and behind each run; documents with as many runs go on together
        before, behind = np.zeros((2, k)), np.ones((2, k))
        live = np.flatnonzero(runs > 0)
        before[0, first[live]] = 1.0
        for s in range(1, int(runs.max(initial=0))):
            live = live[runs[live] > s]
            j = first[live] + s
            a = np.stack([before[0, j - 1] * p[0, j - 1] + before[1, j - 1] * p[2, j - 1], before[0, j - 1] * p[1, j - 1] + before[1, j - 1] * p[3, j - 1]])
            before[:, j] = a / a.sum(0)
        live = np.flatnonzero(runs > 1)
        for s in range(2, int(runs.max(initial=0)) + 1):
            live = live[runs[live] >= s]
            j = first[live + 1] - s
            b = np.stack([p[0, j + 1] * behind[0, j + 1] + p[1, j + 1] * behind[1, j + 1], p[2, j + 1] * behind[0, j + 1] + p[3, j + 1] * behind[1, j + 1]])
            behind[:, j] = b / b.sum(0)
        fwd = np.zeros((2, RUN, k))
        a = before
        for t in range(RUN):
            x, ok = e[:, t], valid[:, t]
            n = np.stack([a[0] * m[0, 0] + a[1] * m[1, 0], (a[0] * m[0, 1] + a[1] * m[1, 1]) * x])
            a = np.where(ok, n / n.sum(0), a)
            fwd[:, t] = a
        out, count = np.zeros((RUN, k)), np.zeros((2, 2))
        b = behind
        for t in range(RUN - 1, -1, -1):
            x, ok = e[:, t], valid[:, t]
            g = fwd[:, t] * b
            out[t] = g[1] / g.sum(0)
            if pairs:
                prior = fwd[:, t - 1] if t else before
                joint = np.stack([prior[0] * m[0, 0] * b[0], prior[0] * m[0, 1] * x * b[1], prior[1] * m[1, 0] * b[0], prior[1] * m[1, 1] * x * b[1]])
                count += np.where(ok, joint / joint.sum(0), 0).sum(1).reshape(2, 2)
            n = np.stack([m[0, 0] * b[0] + m[0, 1] * x * b[1], m[1, 0] * b[0] + m[1, 1] * x * b[1]])
            b = np.where(ok, n / n.sum(0), b)
        p1 = out.T.reshape(-1)[slot]
        return (p1, count) if pairs else p1


def summary(p: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Per document: 1, log of 1 + expected toxic tokens, greatest probability, density."""
    total, n = np.bincount(row, p, n_rows), np.bincount(row, minlength=n_rows)
    most = np.zeros(n_rows)
    np.maximum.at(most, row, p)
    return np.stack([np.ones(n_rows), np.log1p(total), most, 10 * total / np.maximum(n, 1)], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton's method."""
    weight = np.ones(len(y))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * len(y) / 100 * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * len(y) / 100 * w)
    return w


def packed(rows: list[tuple[str, int]], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of (text, label) rows, as texts() gives them."""
    lo = 0
    while lo < len(rows):
        raw: list[bytes] = []
        size = 0
        while lo + len(raw) < len(rows) and size < limit:
            raw.append((rows[lo + len(raw)][0] or "").encode())
            size += len(raw[-1])
        yield lo, lo + len(raw), np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        lo += len(raw)


class ToxicityModel:
    """fit() learns from (text, toxic) pairs; scores() and spans need bytes and offsets as texts() yields them."""

    def __init__(self) -> None:
        self.prior: float | None = 0.0
        self.ratios = np.zeros(TABLE, np.float32)

    @classmethod
    def fit(cls, rows: list[tuple[str, int]]) -> ToxicityModel:
        self = cls()
        y = np.array([int(t) for _, t in rows], float)
        if not len(y) or y.mean() in (0.0, 1.0):
            self.prior = float(y.mean()) if len(y) else 0.0
            return self
        self.prior = None
        # how often a place occurs after different words: copies and passages that documents share count once
        met: list[list[np.ndarray]] = [[], []]
        for lo, hi, data, off in packed(rows):
            _, _, row, places = tokens(data, off)
            if not len(row):
                continue
            same = np.concatenate(([False], row[1:] == row[:-1]))
            before = np.where(same, np.concatenate(([0], places[:-1, 0])), TABLE)
            for c in (0, 1):
                own = y[lo:hi][row] == c
                met[c].append(np.unique((places[own] * (TABLE + 1) + before[own, None]).reshape(-1)))
        df = np.stack([np.bincount(np.unique(np.concatenate([np.zeros(0, np.int64), *m])) // (TABLE + 1), minlength=TABLE) for m in met]).astype(float)
        n = np.maximum(df.sum(1), 1)
        ratio = np.log((df[1] + 0.5) / n[1]) - np.log((df[0] + 0.5) / n[0])
        # only what can't be chance among as many places counts: the log-likelihood ratio's bound grows with their number
        both = df.sum(0)
        expected = both * (n[:, None] / n.sum())
        gain = 2 * (df * np.log(np.maximum(df, 1e-9) / np.maximum(expected, 1e-9))).sum(0)
        self.ratios = np.where(gain > 2 * np.log(max(2, (both > 0).sum())), ratio, 0).astype(np.float32)
        held, size = [], 0
        for lo, hi, data, off in packed(rows, 1 << 18):
            _, _, row, places = tokens(data, off)
            x = self.ratios[places].astype(float)
            held.append((x, ((x.max(1) > TOLD) & (y[lo:hi][row] == 1)).astype(float), row + lo))
            size += len(row)
            if size >= LEARN_TOKENS:
                break
        x, told, row = (np.concatenate(v) for v in zip(*held, strict=True))
        self.learn(x, told, row, len(rows))
        parts = []
        for lo, hi, data, off in packed(rows):
            _, _, row, places = tokens(data, off)
            p = Field(self.trans).marginals(self.emission(self.ratios[places].astype(float)), row, hi - lo)
            parts.append(summary(p, row, hi - lo))
        self.final = logistic(np.concatenate(parts), y)
        return self

    def emission(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[1:] + self.weights[0]

    def learn(self, x: np.ndarray, y: np.ndarray, row: np.ndarray, n_rows: int, steps: int = 60) -> None:
        """Gradient ascent (with Adam's step sizes) of the mean conditional log-likelihood of the tokens' labels."""
        theta = np.concatenate(([-4.0], np.full(x.shape[1], 1.0), [0.0, -2.0, -1.0, 0.0]))
        same = np.concatenate(([False], row[1:] == row[:-1]))
        prior = np.where(same, np.concatenate(([0], y[:-1])), 0).astype(int)
        seen = np.bincount(prior * 2 + y.astype(int), minlength=4).astype(float)
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            self.weights, self.trans = theta[: x.shape[1] + 1], theta[x.shape[1] + 1 :].reshape(2, 2)
            p, count = Field(self.trans).marginals(self.emission(x), row, n_rows, pairs=True)
            d = y - p
            grad = np.concatenate(([d.sum()], x.T @ d, seen - count.reshape(-1))) / len(y) - 1e-5 * theta
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            theta = theta + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.weights, self.trans = theta[: x.shape[1] + 1], theta[x.shape[1] + 1 :].reshape(2, 2)

    def tagged(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
        """Score and spans (in characters) of each text of a slice."""
        n = len(off) - 1
        spans: list[list[dict]] = [[] for _ in range(n)]
        if self.prior is not None:
            return np.full(n, self.prior), spans
        start, end, row, places = tokens(data, off)
        p = Field(self.trans).marginals(self.emission(self.ratios[places].astype(float)), row, n)
        score = 1 / (1 + np.exp(-np.clip(summary(p, row, n) @ self.final, -30, 30)))
        hit = np.flatnonzero(p >= 0.5)
        if len(hit):
            new = np.concatenate(([True], (np.diff(hit) > 1) | (np.diff(row[hit]) > 0)))
            a, z = hit[new], hit[np.concatenate((new[1:], [True]))]
            chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            for i, j in zip(a, z, strict=True):
                base = chars[off[row[i]]]
                spans[row[i]].append({"start": int(chars[start[i]] - base), "end": int(chars[end[j]] - base), "probability": float(p[i : j + 1].max())})
        return score, spans

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Per row: id, score, spans."""
        model, kind = self, dict(docs.dtypes)[id_col]
        shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, data, off in texts(batch, text_col):
                    score, spans = model.tagged(data, off)
                    yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(lo, hi - lo), pa.array(score, pa.float64()), pa.array(spans, shape)], [id_col, "score", "spans"])

        return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, spans {SPAN}")


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS) -> ToxicityModel:
    """labels: (id, 0 or 1); rows without a label count for nothing, of several labels the greatest holds."""
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    ids = sampled(told, "id", "y", max_train)
    # at most max_train rows a class: small enough to be sent to every task
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").filter(F.length("text") <= max_chars // 4)
    # in the order of a hash, so classes and languages mix; a window over no more rows than the sample has
    so_far = F.sum(F.length("text")).over(W.orderBy("m", "y", "id").rowsBetween(W.unboundedPreceding, 0))
    found = rows.select("id", F.md5("text").alias("m"), "text", "y").withColumn("so_far", so_far).filter(F.col("so_far") <= max_chars).select("m", "text", "y").collect()
    return ToxicityModel.fit([(r.text, r.y) for r in sorted(found, key=lambda r: (r.m, r.y))])
