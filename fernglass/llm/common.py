"""Shared pieces: shared-folder storage, Arrow text access and vectorised byte hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.shared import Files, own_dir, shared_dir

#: Bytes of text that a vectorised step handles at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20
#: Bytes of text whose tokens or anchors a step gathers before it passes them on.
PORTION_BYTES = 8 << 20
#: What the operators call white space: fixed by the word definition [^\x20\x09-\x0D]+.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_rng = np.random.default_rng(0x5EED)
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RADIX = np.uint64(0xD6E8FEB86659FD93)
RADIX_INV = np.uint64(pow(int(RADIX), -1, 1 << 64))
IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether Spark deletes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: cuts lineage, survives lost executors. Spark
    deletes the write's shuffle files when it is done; spent() deletes the table."""
    spark, schema = df.sparkSession, df.schema
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._fernglass_path = path
    return out


def spent(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_fernglass_path", None):
            Files(df.sparkSession).delete(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small tables; Spark removes its files when df is no longer used."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: A key with more than one in so many rows is dealt over SALTS parts of a join; there can't be more such keys.
HOT_SHARE = 1000
SALTS = 64


def salted_join(left: DataFrame, right: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """left, cheap to read twice, with the columns of right, which has a row per key (a left join). Rows of left with a
    hot key, or none, are dealt by a hash of the columns `by`; right's row of a hot key goes to each of those parts."""
    n = left.count()
    hot = left.groupBy(key).count().filter(F.col(key).isNotNull() & (F.col("count") > n // HOT_SHARE)).select(key, F.lit(True).alias("__fg_hot"))
    hot = F.broadcast(hot)  # fewer than HOT_SHARE rows
    salt = F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")
    dealt = left.join(hot, key, "left").withColumn("__fg_salt", F.when(F.col("__fg_hot") | F.col(key).isNull(), salt).otherwise(0)).drop("__fg_hot")
    every = F.when(F.col("__fg_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = right.join(hot, key, "left").withColumn("__fg_salt", F.explode(every)).drop("__fg_hot")
    return dealt.join(spread, [key, "__fg_salt"], "left").drop("__fg_salt")


def crc_mod(column: str, n: int):
    """crc32 of the id written as text, modulo n: how folds are told apart."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def texts(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column as (first row, end row, bytes, offsets), of about limit bytes and at most so many
    rows; a null has no bytes."""
    col = batch.column(column)
    if len(col) == 0:
        return
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, buf = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def portions(batches: Iterator[pa.RecordBatch], column: str, limit: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, none with much more than limit bytes of text: what a step gathers stays bounded."""
    for batch in batches:
        for lo, hi, _, _ in texts(batch, column, limit):
            yield batch.slice(lo, hi - lo)
        pa.default_memory_pool().release_unused()


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX**i and RADIX**-i modulo 2**64, i < n."""
    if len(_POWERS["up"]) < n:
        m = max(n, SLICE_BYTES + 4096)
        for k, r in (("up", RADIX), ("down", RADIX_INV)):
            a = np.full(m, r, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of byte ranges of one slice, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, k: int) -> np.ndarray:
        """Of every k bytes."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; inside: the bytes that make words (default: all but white space)."""
    word = ~IS_WHITE[data] if inside is None else inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    before = np.concatenate(([False], word[:-1])) if len(word) else word
    start = np.flatnonzero(word & (~before | first[:-1]))
    after = np.concatenate((word[1:], [False])) if len(word) else word
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def gather(rows: list[pa.RecordBatch | pa.Table]) -> pa.Table:
    return pa.concat_tables([pa.Table.from_batches([x]) if isinstance(x, pa.RecordBatch) else x for x in rows])


def blob_rows(parts: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Rows dealt to parts: the parts that have any, and per array its bytes in each of those. The work follows the
    rows, not how many parts there are."""
    order = np.argsort(parts, kind="stable")
    sorted_ = parts[order]
    cut = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(parts) else np.zeros(0, np.int64)
    ends = [*cut[1:].tolist(), len(parts)]
    return sorted_[cut], [[a[x:y].tobytes() for x, y in zip(cut.tolist(), ends, strict=False)] for a in (a[order] for a in arrays)]
