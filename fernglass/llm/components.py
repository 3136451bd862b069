"""Connected components of an edge table: forests by task, then alternating large and small stars until what is left
is small enough for one task of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm.common import checkpointed


#: Edges to a file of a round's checkpoint.
FILE_EDGES = 1 << 20


def _kept(edges: DataFrame, n: int | None) -> DataFrame:
    """A checkpoint in as few files as n edges need: rounds are many, and every file costs a task's start and commit."""
    return checkpointed(edges if n is None else edges.coalesce(max(1, -(-n // FILE_EDGES))))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b") % 1_000_003)).first())


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges, and of each the smallest node that is connected."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        low = np.minimum(p, q)
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _stars(limit: int | None):
    """Edges of a task as a star for each component; with a limit, of so many edges at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros((2, 0), np.int64)]

        def out() -> pa.RecordBatch:
            nodes, label = labels_of(*np.concatenate(held, 1))
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], ["node", "label"])

        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            if limit is not None and sum(x.shape[1] for x in held) >= limit:
                yield out()
                held = held[:1]
        yield out()

    return run


def components(edges: DataFrame, most: int = FILE_EDGES) -> DataFrame:
    """edges: (a, b) longs. Returns (node, label), label the smallest node that is connected, for every node met.

    Above `most` edges, each round joins edges with the smallest neighbour of one end, so a node with very many edges
    is an ordinary skewed join and never gathered; rounds grow with the logarithm of the longest path, and go on until
    one changes nothing, which is the case only when all that is left are stars. Up to `most`, one task labels them all.
    Edges of a node with itself count for nothing, repeated ones once; nulls are no nodes; no edges give no rows.
    """
    schema = "node long, label long"
    forest = edges.select("a", "b").filter("a <> b").mapInArrow(_stars(most), schema).filter("node <> label")
    now = _kept(forest.select(F.col("node").alias("a"), F.col("label").alias("b")).distinct(), None)
    last, mark = None, _mark(now)
    while mark[0] > most and mark != last:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # every edge now leads down; the small star joins a node's lower neighbours to the lowest of them
        lowest = large.filter("a <> b").groupBy("a").agg(F.min("b").alias("m"))
        small = large.filter("a <> b").join(lowest, "a")
        now = _kept(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), mark[0])
        last, mark = mark, _mark(now)
    if mark[0] <= most:
        return checkpointed(now.coalesce(1).mapInArrow(_stars(None), schema))
    labels = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    return labels.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct().join(labels.select("node"), "node", "left_anti"))
