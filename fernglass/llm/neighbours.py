"""Nearest neighbours by largest inner product with an inverted multi-index.

Each half of a vector is quantised by its own codebook; a cell is a pair of centroids. The codebooks grow with the
square root of the table, so that a cell holds about CELL vectors, up to MOST centroids a half. For a query, pairs are
taken from a heap in order of summed nearness (the sum of the halves' inner products with their centroids) until the
cells hold `budget` candidates. Every entry of the cells taken is reranked exactly.

The budget is measured, not assumed: TRIALS of the queries are compared with all vectors, and as many candidates are
allowed as bring TARGET of their true neighbours. So recall holds at any size, and the share of the table that a query
reranks is as small as the data's own structure lets it be.

Cells are packed into bins of about BIN vectors, and a cell with more is split over several. A query is sent to the bins
whose cells it takes; a bin that more than BLOCK queries visit is copied once per BLOCK of them, so no task holds more
than a bin and BLOCK queries, and no vector moves for a query that doesn't visit its bin. Codebooks use a sample of at
most SAMPLE vectors; all vectors are indexed. Defined results: vectors that are null, zero, of another length than most
rows (the longer of two as frequent), or hold null or non-finite components take no part, as queries or candidates;
rows without an id neither; a query isn't its own neighbour, nor are other rows of its id; ties go to the smaller id; with
fewer than k candidates all are returned; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fernglass.llm.common import stored

CELL = 32
MOST = 1024
SAMPLE = 16_384
TRIALS = 128
TARGET = 0.96
BIN = 4096
BLOCK = 8192


def usable(df: DataFrame, id_col: str, vec_col: str, queries: Column) -> DataFrame:
    """(id, v, asked) of the rows that take part, queries and candidates of one width."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("v") == (width[0].d if width else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly picked distinct starts."""
    own = np.unique(x, axis=0)
    c = own[np.linspace(0, len(own) - 1, min(k, len(own))).astype(int)]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    norm, step = (c * c).sum(1), max(1, (1 << 21) // max(1, len(c)))
    return np.concatenate([np.zeros(0, np.int64), *((norm - 2 * x[lo : lo + step] @ c.T).argmin(1) for lo in range(0, len(x), step))])


class MultiIndex:
    """Codebooks of both halves of the vectors."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2 or 1
        self.books = [codebook(sample[:, : self.half], k), codebook(sample[:, self.half :], k) if sample.shape[1] > 1 else np.zeros((1, 0))]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = nearest(x[:, : self.half], self.books[0]), nearest(x[:, self.half :], self.books[1]) if x.shape[1] > 1 else np.zeros(len(x), np.int64)
        return a * len(self.books[1]) + b

    def sums(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query, the inner products of its halves with their centroids."""
        return q[:, : self.half] @ self.books[0].T, q[:, self.half :] @ self.books[1].T

    def traverse(self, u: np.ndarray, v: np.ndarray, counts: np.ndarray, budget: int) -> list[int]:
        """Cells that hold vectors in order of summed nearness, from a heap over the two sorted lists of centroids,
        until they hold budget vectors."""
        i, j = np.argsort(-u, kind="stable"), np.argsort(-v, kind="stable")
        width, held, out = len(v), 0, []
        u, v = u[i].tolist(), v[j].tolist()
        i, j = i.tolist(), j.tolist()
        heap = [(-(u[0] + v[0]), 0, 0)]
        while heap and held < budget:
            _, a, b = heapq.heappop(heap)
            cell = i[a] * width + j[b]
            if n := int(counts[cell]):
                out.append(cell)
                held += n
            if b + 1 < width:
                heapq.heappush(heap, (-(u[a] + v[b + 1]), a, b + 1))
            if b == 0 and a + 1 < len(u):
                heapq.heappush(heap, (-(u[a + 1] + v[0]), a + 1, 0))
        return out

    def needed(self, q: np.ndarray, own: np.ndarray, cell: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How many vectors lie in cells no further from query own[i] than cell[i]."""
        out = np.zeros(len(own), np.int64)
        u, v = self.sums(q)
        for n in np.unique(own):
            near = (u[n][:, None] + v[n][None, :]).reshape(-1)
            order = np.argsort(-near, kind="stable")
            before = np.cumsum(counts[order])
            mine = own == n
            # all cells of an equal sum count
            out[mine] = before[np.searchsorted(-near[order], -near[cell[mine]] + 1e-9, side="right") - 1]
        return out


def best(q: np.ndarray, q_cells: list[np.ndarray], q_id: np.ndarray, v: np.ndarray, v_cell: np.ndarray, v_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query, its k best among the vectors of the cells that it takes: query's row, vector's row, score. A
    matrix product tells which can be: those no further below the k-th so far than rounding may put them. Only these
    are scored component by component, in order, so that equal vectors score equally."""
    order = np.lexsort((v_id, v_cell))
    v, v_cell, v_id = v[order], v_cell[order], v_id[order]
    takers = np.repeat(np.arange(len(q)), [len(c) for c in q_cells])
    taken = np.concatenate(q_cells) if q_cells else np.zeros(0, int)
    by = np.argsort(taken, kind="stable")
    taken, takers = taken[by], takers[by]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    found = np.full((len(q), k), -np.inf)
    slack = 1e-12 * np.sqrt((q * q).sum(1) * (v * v).sum(1).max(initial=0))
    for cell in np.unique(v_cell):
        lo, hi = np.searchsorted(v_cell, [cell, cell + 1])
        a, z = np.searchsorted(taken, [cell, cell + 1])
        for own in np.array_split(takers[a:z], max(1, (z - a) * (hi - lo) // 2_000_000)):
            s = q[own] @ v[lo:hi].T
            s[q_id[own][:, None] == v_id[None, lo:hi]] = -np.inf
            found[own] = -np.partition(-np.concatenate((found[own], s), 1), k - 1, axis=1)[:, :k]
            n, place = np.nonzero((s >= (found[own].min(1) - slack[own])[:, None]) & (s > -np.inf))
            pairs.append((own[n], lo + place))
    row, at = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    score = np.zeros(len(row))
    for step in range(0, len(row), 1 << 16):
        x, y = q[row[step : step + (1 << 16)]], v[at[step : step + (1 << 16)]]
        for d in range(v.shape[1]):
            score[step : step + (1 << 16)] += x[:, d] * y[:, d]
    o = np.lexsort((v_id[at], -score, row))
    row, at, score = row[o], at[o], score[o]
    keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[keep], order[at[keep]], score[keep]


def neighbours_of(entries: DataFrame, q: np.ndarray, q_id: np.ndarray, k: int) -> DataFrame:
    """The k best of all entries (id, v, cell) for a few queries: (n, cell), n the query's row. A task passes on no
    more than k rows a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = np.full((len(q), k), -np.inf)
        ids, cells = np.zeros((len(q), k), np.int64), np.zeros((len(q), k), np.int64)
        for b in batches:
            i, c = b.column("id").to_numpy(), b.column("cell").to_numpy().astype(np.int64)
            v = matrix(b.column("v")) if b.num_rows else None
            for lo in range(0, b.num_rows, 4096):
                s = q @ v[lo : lo + 4096].T
                s[q_id[:, None] == i[None, lo : lo + 4096]] = -np.inf
                every = np.concatenate((score, s), 1)
                top = np.argpartition(-every, k - 1, axis=1)[:, :k]
                score = np.take_along_axis(every, top, 1)
                ids = np.take_along_axis(np.concatenate((ids, np.broadcast_to(i[lo : lo + 4096], s.shape)), 1), top, 1)
                cells = np.take_along_axis(np.concatenate((cells, np.broadcast_to(c[lo : lo + 4096], s.shape)), 1), top, 1)
        n, at = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(cells[n, at].astype(np.int32)), pa.array(ids[n, at]), pa.array(score[n, at])], ["n", "cell", "id", "score"])

    order = W.partitionBy("n").orderBy(F.desc("score"), "id")
    rows = entries.select("id", "v", "cell").mapInArrow(run, "n int, cell int, id long, score double")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("n", "cell")


def search(df: DataFrame, queries: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, cell: int = CELL, most: int = MOST, max_sample: int = SAMPLE, trials: int = TRIALS, target: float = TARGET) -> DataFrame:
    """queries: which rows are queries. Rows (query_id, rank, vec_id, score)."""
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(df, id_col, vec_col, queries)
    total, n_asked = rows.agg(F.count("*"), F.count_if("asked")).first()
    if not total or not n_asked:
        return spark.createDataFrame([], schema)

    def some(rows: DataFrame, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """About most of n rows and never more than twice that, chosen by a hash: ids, vectors."""
        part = int((1 << 20) * min(1.0, most / n))
        picked = rows.filter(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) < max(1, part)).select("id", "v").limit(2 * most).toArrow()
        if not picked.num_rows:
            picked = rows.select("id", "v").limit(most).toArrow()
        i, v = picked.column("id").to_numpy(), matrix(picked.column("v"))
        order = np.lexsort((i, *v.T[::-1]))
        return i[order], v[order]

    sample = some(rows, total, max_sample)[1]
    centroids = int(max(1, min(most, len(sample) // 4, round((total / cell) ** 0.5))))
    index = MultiIndex(sample, centroids)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "v", "asked")), pa.array(index.cells(matrix(b.column("v"))), pa.int32())], ["id", "v", "asked", "cell"])

    kind = dict(rows.dtypes)["v"]
    entries = stored(rows.mapInArrow(coded, f"id long, v {kind}, asked boolean, cell int"), "neighbours")
    asked = entries.filter("asked")
    counts = np.zeros(len(index.books[0]) * len(index.books[1]), np.int64)
    for r in entries.groupBy("cell").count().collect():  # a row per cell: at most MOST squared
        counts[r["cell"]] = r["count"]

    q_id, q = some(asked, n_asked, trials)
    true = neighbours_of(entries, q, q_id, min(k, total)).collect()  # k rows a trial
    needed = index.needed(q, *(np.array([r[c] for r in true], np.int64) for c in ("n", "cell")), counts) if true else np.zeros(0)
    budget = int(np.quantile(needed, target, method="higher")) if len(needed) else total

    # bins: small cells share one, a large cell gets several
    many = -(-counts // BIN)
    single = np.cumsum(np.where(many <= 1, counts, 0)) // BIN
    n_single = int(single[-1]) + 1
    first = np.where(many <= 1, single, n_single + np.concatenate(([0], np.cumsum(np.where(many > 1, many, 0))))[:-1])
    many = np.maximum(many, 1)

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column("v"))
            for lo in range(0, len(q), 64):
                out: dict[str, list] = {"bin": [], "at": [], "cells": []}
                for n, (u, v) in enumerate(zip(*index.sums(q[lo : lo + 64]), strict=True), lo):
                    cells = np.array(index.traverse(u, v, counts, budget), np.int64)
                    m = many[cells]
                    where = np.repeat(first[cells], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    owner = np.repeat(cells, m)
                    o = np.argsort(where, kind="stable")
                    where, owner = where[o], owner[o]
                    cut = np.flatnonzero(np.concatenate(([True], np.diff(where) > 0))) if len(where) else []
                    for a, z in zip(cut, [*cut[1:], len(where)], strict=True):
                        out["bin"].append(int(where[a]))
                        out["at"].append(n)
                        out["cells"].append(owner[a:z].astype(np.int32))
                at = pa.array(out["at"], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out["bin"], pa.int32()), b.column("id").take(at), b.column("v").take(at), pa.array(out["cells"], pa.list_(pa.int32()))], ["bin", "id", "v", "cells"])

    visits = stored(asked.mapInArrow(planned, f"bin int, id long, v {kind}, cells array<int>"), "neighbours-visits")
    blocks = np.zeros(int((first + many).max()), np.int64)
    for r in visits.groupBy("bin").count().collect():  # a row per bin: no more than cells and BIN-ths of the table
        blocks[r["bin"]] = -(-r["count"] // BLOCK)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, i = b.column("cell").to_numpy(), b.column("id").to_numpy()
                to = first[own] + (i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many[own]
                n = blocks[to]  # none for a bin that no query visits
                at = np.repeat(np.arange(len(i)), n)
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(to[at], pa.int32()), pa.array(block, pa.int32()), *(b.column(c).take(pa.array(at)) for c in ("id", "v", "cell"))], ["bin", "block", "id", "v", "cell"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, i = blocks[b.column("bin").to_numpy()], b.column("id").to_numpy()
                block = (i.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64) % n
                yield pa.RecordBatch.from_arrays([b.column("bin"), pa.array(block, pa.int32()), *(b.column(c) for c in ("id", "v", "cells"))], ["bin", "block", "id", "v", "cells"])

    def meet(vectors: pa.Table, takers: pa.Table) -> pa.Table:
        out = (np.zeros(0, int),) * 2 + (np.zeros(0),)
        v_id = q_id = np.zeros(0, np.int64)
        if vectors.num_rows and takers.num_rows:
            v_id, q_id = vectors.column("id").to_numpy(), takers.column("id").to_numpy()
            lists = takers.column("cells").combine_chunks()
            cut = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()
            cells = [flat[a:z].astype(np.int64) for a, z in zip(cut[:-1], cut[1:], strict=True)]
            out = best(matrix(takers.column("v")), cells, q_id, matrix(vectors.column("v")), vectors.column("cell").to_numpy(), v_id, k)
        return pa.table({"query_id": pa.array(q_id[out[0]], pa.int64()), "vec_id": pa.array(v_id[out[1]], pa.int64()), "score": pa.array(out[2], pa.float64())})

    left = entries.select("id", "v", "cell").mapInArrow(binned, f"bin int, block int, id long, v {kind}, cell int").groupBy("bin", "block")
    right = visits.mapInArrow(dealt, f"bin int, block int, id long, v {kind}, cells array<int>").groupBy("bin", "block")
    near = left.cogroup(right).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    out.reranked_share = budget / total  # measured, for reports and tests
    return out
