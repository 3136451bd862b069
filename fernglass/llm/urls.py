"""URL filters: longest-match rules, and gradient-boosted trees on lexical features for what no rule fits.

The trees are trained from labelled URLs; where a caller has none, the URLs that a rule fits are the labelled
ones. Training takes at most MAX_TRAIN labelled rows, chosen by a hash of the URL; all else sees every row.

Defined results: a null URL, or one without "://", has an empty host and path, fits no rule and is judged by the
trees on its raw text; without labelled URLs of both kinds every such URL gets the only known verdict (allow if
none); equal URLs get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.llm.common import texts

#: (rule, verdict); a rule is a host, then a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Labelled rows that training takes at most.
MAX_TRAIN = 20_000
ROUNDS, DEPTH, BINS, RATE, SHRINK = 80, 4, 32, 0.2, 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F, F
    for k, (rule, says) in enumerate(sorted(rules, key=lambda r: (-len(r[0]), r[0]))):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        name, verdict = name.when(fits, F.lit(rule)), verdict.when(fits, F.lit(says))
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def suffixes(host: str) -> tuple[str, str]:
    parts = host.rsplit(":", 1)[0].split(".")
    return parts[-1], ".".join(parts[-2:])


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical_columns(url: Column, host: Column, path: Column) -> Column:
    """Lengths, depths, digit ratios and counts of parameters and marks, as an array of doubles."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"(?s)^[^?]*\?([^#]*)", 1)
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    size = lambda c: F.length(c).cast("double")
    one = F.lit(1.0)
    values = [
        size(url), size(host), size(path), F.size(steps).cast("double"), _count(host, r"\."), _count(url, "[0-9]") / F.greatest(one, size(url)), _count(path, "[0-9]") / F.greatest(one, size(path)),
        _count(query, "[=&]"), size(query), _count(url, "[-_]"), url.startswith("https").cast("double"), url.contains("#").cast("double"),
        F.coalesce(F.array_max(F.transform(steps, size)), F.lit(0.0)), F.coalesce(size(F.try_element_at(steps, F.lit(1))), F.lit(0.0)),
    ]
    return F.array(*values)


def entropies(column: pa.Array) -> np.ndarray:
    """Entropy of the bytes of each string, in bits."""
    out = np.zeros(len(column))
    batch = pa.RecordBatch.from_arrays([column], ["s"])
    for lo, hi, data, off in texts(batch, "s", rows=4096):
        n = np.diff(off)
        row = np.repeat(np.arange(hi - lo), n)
        seen = np.bincount(row * 256 + data, minlength=(hi - lo) * 256).reshape(-1, 256)
        share = seen / np.maximum(n, 1)[:, None]
        out[lo:hi] = -(share * np.log2(np.where(seen > 0, share, 1))).sum(1)
    return out


def features(batch: pa.RecordBatch, stats: dict) -> np.ndarray:
    """Rows (url, host, lexical): length, depth, digit ratio, entropy, parameter counts and suffix statistics."""
    n = batch.num_rows
    plain = batch.column("lexical").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    hosts = batch.column("host").dictionary_encode()
    names = hosts.dictionary.to_pylist()
    of_host = np.array([[len(last), *stats.get(last, stats[""]), *stats.get(two, stats[""])] for last, two in map(suffixes, names)]).reshape(len(names), 5)
    return np.concatenate([plain, entropies(batch.column("url"))[:, None], entropies(batch.column("host"))[:, None], of_host[hosts.indices.to_numpy()]], 1)


def suffix_stats(hosts: list[str], y: np.ndarray) -> dict[str, tuple[float, float]]:
    """For each suffix its smoothed share of blocked URLs and the log of its count."""
    n, bad = Counter(), Counter()
    for h, b in zip(hosts, y, strict=True):
        for s in set(suffixes(h)):
            n[s] += 1
            bad[s] += int(b)
    prior = float(y.mean()) if len(y) else 0.0
    return {s: ((bad[s] + 4 * prior) / (n[s] + 4), math.log1p(n[s])) for s in n} | {"": (prior, 0.0)}


class Trees:
    """Gradient boosting of the logistic loss with histogram splits; trees are complete, of one depth."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(f, np.linspace(0, 1, BINS + 1)[1:-1])) for f in x.T]
        q = self.binned(x)
        self.base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self.grown(q, p - y, p * (1 - p))
            self.trees.append(tree)
            score += tree[2][leaf]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, f, side="left") for e, f in zip(self.edges, x.T, strict=True)], 1)

    def grown(self, q: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple, np.ndarray]:
        """(feature and bin of every inner node, leaf values), and the leaf of every row."""
        node = np.zeros(len(q), np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
        for level in range(DEPTH):
            width, at = 2**level, 2**level - 1
            best = np.full(width, 1e-9)
            for f in range(q.shape[1]):
                key = node * BINS + q[:, f]
                gs, hs = (np.cumsum(np.bincount(key, w, width * BINS).reshape(width, BINS), 1) for w in (g, h))
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + SHRINK) + (total_g - gs) ** 2 / (total_h - hs + SHRINK) - total_g**2 / (total_h + SHRINK)
                b = gain[:, :-1].argmax(1)
                top = gain[np.arange(width), b]
                better = np.flatnonzero(top > best)
                best[better], feature[at + better], cut[at + better] = top[better], f, b[better]
            node = 2 * node + (q[np.arange(len(q)), feature[at + node]] > cut[at + node])
        gl, hl = np.bincount(node, g, 2**DEPTH), np.bincount(node, h, 2**DEPTH)
        return (feature, cut, -RATE * gl / (hl + SHRINK)), node

    def scores(self, x: np.ndarray) -> np.ndarray:
        q, out = self.binned(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                k = node + 2**level - 1
                node = 2 * node + (q[rows, feature[k]] > cut[k])
            out += value[node]
        return 1 / (1 + np.exp(-out))


def fit_urls(labelled: DataFrame, max_train: int = MAX_TRAIN) -> tuple[dict, Trees | None, float]:
    """labelled: url, host, lexical, blocked (boolean). Rows are chosen by a hash, so that about max_train at most come."""
    n = labelled.count()
    keep = labelled if n <= max_train else labelled.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int((1 << 20) * 0.95 * max_train / n))
    picked = keep.select("url", "host", "lexical", "blocked").limit(2 * max_train).toArrow().combine_chunks()
    picked = picked.sort_by([("url", "ascending"), ("blocked", "ascending")])
    y = picked.column("blocked").to_numpy(zero_copy_only=False).astype(float)
    stats = suffix_stats(picked.column("host").to_pylist(), y)
    share = float(y.mean()) if len(y) else 0.0
    if len(y) == 0 or share in (0.0, 1.0):
        return stats, None, share
    return stats, Trees(features(picked.combine_chunks().to_batches()[0], stats), y), share


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row: id, host, path, rule, verdict, score (the trees' probability that the URL is to be blocked).
    labelled: rows (url, blocked) to train from; without it the trees learn what the rules say, so where no rule fits
    they carry the rules' judgement on to URLs that look like those."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("says", says).withColumn("lexical", lexical_columns(F.col("url"), F.col("host"), F.col("path")))
    if labelled is None:
        labelled = rows.filter("rule is not null").select("url", "host", "lexical", (F.col("says") == "block").alias("blocked"))
    else:
        parts = labelled.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "blocked")
        labelled = parts.withColumn("lexical", lexical_columns(F.col("url"), F.col("host"), F.col("path")))
    stats, trees, share = fit_urls(labelled, max_train)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = trees.scores(features(batch, stats)) if trees and batch.num_rows else np.full(batch.num_rows, share)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (id_col, "host", "path", "rule", "says")), pa.array(p, pa.float64())], [id_col, "host", "path", "rule", "says", "score"])

    kind = dict(pages.dtypes)[id_col]
    out = rows.mapInArrow(score, f"`{id_col}` {kind}, host string, path string, rule string, says string, score double")
    return out.select(id_col, "host", "path", "rule", F.coalesce("says", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
