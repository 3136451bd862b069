"""Best-fit packing into sequences of several permitted lengths.

Pieces are taken longest first. A piece goes to the open bin that it fills best; if it fits none, a bin is opened of
the length that costs least for it: a bin of c words costs c + OVERHEAD, a word its share of that, and of the room
that is left 1 - FILL is expected to stay empty. At the end each bin shrinks to the shortest permitted length that
holds its contents. A document longer than the longest bin is cut into pieces of that length and a rest.

Documents are dealt to groups of about GROUP by a hash of what they are (id, text, size and, of rows that repeat all
three, their number), and a task packs a group, so bins depend on the rows alone: not on files, partitions or the
size of Arrow's batches. Only ids, hashes and sizes are shuffled; rows that are alike are counted before. A bin's name
holds its group's number.

Defined results: a document without words (null, empty) has one piece of 0 words in no bin; pieces of equal size are
packed in the order of id (null last), text hash and number; repeated rows are packed each, numbered by `copy`; long
texts give several pieces; an empty table gives no piece.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm.common import texts, words
from fernglass.llm.mixing import word_count

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 64
FILL = 0.95
#: Documents that are packed together.
GROUP = 8192
#: Rows that are alike are numbered in runs of so many.
RUN = 4096
LAST = 2**63 - 1


def pieces_of(sizes: Sequence[int], longest: int) -> list[tuple[int, int, int, int]]:
    """(row, number of the piece, first word, words)."""
    return [(row, k, k * longest, min(longest, size - k * longest)) for row, size in enumerate(sizes) for k in range(max(1, -(-size // longest)))]


def opened(words: int, lengths: Sequence[int], overhead: float, fill: float) -> int:
    """The length that costs least for a first piece of so many words."""
    return min((c for c in lengths if c >= words), key=lambda c: ((c + overhead) / c * (words + (1 - fill) * (c - words)), c))


def pack(words: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: float = OVERHEAD, fill: float = FILL) -> tuple[list[int], list[int], list[int]]:
    """Bin of each piece (-1: none) and its place there; the lengths of the bins after they have shrunk."""
    lengths = sorted(lengths)
    bin_of, place = [-1] * len(words), [0] * len(words)
    room: list[tuple[int, int]] = []  # (words left, bin), sorted
    held: list[int] = []
    for i in sorted(range(len(words)), key=lambda i: (-words[i], i)):
        n = words[i]
        if n == 0:
            continue
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = opened(n, lengths, overhead, fill), len(held)
            held.append(0)
        bin_of[i], place[i] = b, held[b]
        held[b] += n
        if left > n:
            bisect.insort(room, (left - n, b))
    return bin_of, place, [lengths[bisect.bisect_left(lengths, n)] for n in held]


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS, group: int = GROUP) -> DataFrame:
    """A row per piece: id, copy (numbers rows of equal id and text), piece, first_word, n_words, bin, place (of its
    first word in the bin), capacity and text_hash (xxhash64 of the text)."""
    kind = dict(docs.dtypes)[id_col]
    longest = max(lengths)
    groups = max(1, -(-docs.count() // group))

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), word_count(text_col).alias("size"))
    alike = rows.groupBy("id", "t", "size").agg(F.count("*").alias("n"))
    run = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN)))
    alike = alike.withColumn("run", run)
    number = F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1))
    rows = alike.select("id", "t", "size", number.alias("copy"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "t", "size", "copy"), F.lit(groups)))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("id", "ascending"), ("t", "ascending"), ("copy", "ascending")])
        found = pieces_of(table.column("size").to_pylist(), longest)
        bins, place, capacity = pack([x[3] for x in found], lengths)
        row, name = pa.array([x[0] for x in found], pa.int64()), table.column("part")[0].as_py()
        return pa.Table.from_arrays(
            [table.column("id").take(row), table.column("copy").take(row), *(pa.array([x[k] for x in found], pa.int64()) for k in (1, 2, 3)), pa.array([None if b < 0 else f"{name}-{b}" for b in bins], pa.string()), pa.array(place, pa.int64()), pa.array([0 if b < 0 else capacity[b] for b in bins], pa.int64()), table.column("t").take(row)],
            [id_col, "copy", "piece", "first_word", "n_words", "bin", "place", "capacity", "text_hash"],
        )

    return rows.groupBy("part").applyInArrow(packed, f"`{id_col}` {kind}, copy long, piece long, first_word long, n_words long, bin string, place long, capacity long, text_hash long")


def text_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """A row per piece: k (the id as text), text_hash, piece and its text. The pieces of a text in order are the text;
    a null text is one null piece."""
    longest = max(lengths)
    names = ["k", "text_hash", "piece", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in texts(batch, "text"):
                start, _, row = words(data, off)
                count = np.bincount(row, minlength=hi - lo)
                if count.max(initial=0) <= longest:
                    own = batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([own.column("k"), own.column("t"), pa.array(np.zeros(hi - lo, np.int64)), own.column("text")], names)
                    continue
                first = np.cumsum(count) - count
                at, piece, out = [], [], []
                for i in range(hi - lo):
                    # each piece begins with its first word, but for the first, which begins with the text
                    cut = [off[i], *start[first[i] + longest : first[i] + count[i] : longest].tolist(), off[i + 1]]
                    null = not batch.column("text")[lo + i].is_valid
                    for p, (a, z) in enumerate(zip(cut, cut[1:], strict=False)):
                        at.append(lo + i)
                        piece.append(p)
                        out.append(None if null else data[a:z].tobytes().decode())
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("k").take(at), batch.column("t").take(at), pa.array(piece, pa.int64()), pa.array(out, pa.string())], names)

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("k"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "k string, text_hash long, piece long, text string")


def pack_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """The rows of pack_documents with the text of each piece: the pieces of a bin by place are its sequence, those of
    an id and copy by piece are the document. Texts are shuffled once; rows that are alike share theirs."""
    pieces = text_pieces(docs, id_col=id_col, text_col=text_col, lengths=lengths).dropDuplicates(["k", "text_hash", "piece"])
    packed = pack_documents(docs, id_col=id_col, text_col=text_col, lengths=lengths)
    packed = packed.withColumn("k", F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return packed.join(pieces, ["k", "text_hash", "piece"]).select(id_col, "copy", "piece", "first_word", "n_words", "bin", "place", "capacity", "text_hash", F.col("text").alias("text"))
