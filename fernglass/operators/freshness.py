"""Whether stored chunks belong to the documents as they are now."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fernglass.functions.text import digest, is_blank


def statuses(docs: DataFrame, headers: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """docs: (path, doc_hash); headers: (path, stored_hash, ...); failed: (path) of documents that couldn't be read,
    whose stored chunks are no orphans. Returns (path, status): current, stale, missing, orphan or unread."""
    known = docs.select("path", "doc_hash")
    both = known.join(headers.select("path", F.col("stored_hash")), "path", "full_outer")
    if failed is not None:
        both = both.join(failed.select("path", F.lit(True).alias("_failed")).distinct(), "path", "left")
    else:
        both = both.withColumn("_failed", F.lit(None).cast("boolean"))
    status = (
        F.when(F.col("doc_hash").isNull() & F.col("_failed"), "unread").when(F.col("doc_hash").isNull(), "orphan").when(F.col("stored_hash").isNull(), "missing").when(F.col("doc_hash") == F.col("stored_hash"), "current").otherwise("stale")
    )
    return both.select("path", status.alias("status"))


def mixed(headers: DataFrame, column: str) -> DataFrame:
    """(path, reason) for every header, if headers don't agree in a column."""
    values = headers.agg(F.array_sort(F.collect_set(column)).alias("values")).first()["values"]
    if len(values) < 2:
        return headers.select("path", F.lit("").alias("reason")).limit(0)
    return headers.select("path", F.concat(F.lit(f"stored with different values of {column} ({', '.join(map(str, values))}), here "), F.col(column).cast("string")).alias("reason"))


def gaps(chunks: DataFrame, bodies: DataFrame) -> DataFrame:
    """(path, at) where visible text of a body lies in no chunk. chunks: (path, start, end); bodies: (path, body).
    Offsets are code points."""
    by_path = W.partitionBy("path").orderBy("start")
    before = chunks.withColumn("at", F.coalesce(F.lag("end").over(by_path), F.lit(0))).select("path", "at", F.col("start").alias("to"))
    tail = bodies.select("path", F.length("body").alias("to")).join(chunks.groupBy("path").agg(F.max("end").alias("at")), "path", "left").select("path", F.coalesce("at", F.lit(0)).alias("at"), "to")
    between = before.unionByName(tail).filter("to > at").join(bodies, "path")
    return between.filter(~is_blank(F.expr("substring(body, at + 1, to - at)"))).select("path", F.col("at").cast("long").alias("at"))


def uncovered(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, reason) of documents with stored chunks that run past the body or leave text of it out. chunks: (path,
    ordinal, start, end) with offsets in UTF-16 units; docs: (path, body)."""
    ranges = chunks.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "start", "end"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("ranges"))

    def reason(body: str, spans: list[dict]) -> str | None:
        wide, at = body.encode("utf-16-le"), 0
        length = len(wide) // 2
        for k, s in enumerate(spans):
            if s["end"] > length:
                return f"chunk {k} ends at {s['end']}, behind the document's end ({length}); run embed"
        for start, end in (*((s["start"], s["end"]) for s in spans), (length, length)):
            if wide[2 * at : 2 * start].decode("utf-16-le", "replace").strip(" \t\n\r\f\v\ufeff\u2028\u2029\xa0"):
                return f"the text between {at} and {start} is in no chunk; run embed"
            at = max(at, end)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, reason(b, r)) for p, b, r in zip(*(batch.column(c).to_pylist() for c in ("path", "body", "ranges")), strict=True)]
            yield pa.RecordBatch.from_pydict({"path": [p for p, r in found if r], "reason": [r for _, r in found if r]}, schema=pa.schema([("path", pa.string()), ("reason", pa.string())]))

    return docs.select("path", "body").join(ranges, "path").select("path", "body", "ranges").mapInArrow(run, "path string, reason string")


def disordered(chunks: DataFrame) -> DataFrame:
    """Chunks that start before the one before them ends, or that end where they start."""
    by_path = W.partitionBy("path").orderBy("ordinal")
    return chunks.withColumn("_last", F.lag("end").over(by_path)).filter("start < _last or end <= start").drop("_last")


def altered(chunks: DataFrame) -> DataFrame:
    """Chunks whose hash isn't that of their breadcrumb and text."""
    return chunks.filter(F.col("hash") != chunk_hash())


def chunk_hash():
    return digest(F.concat(F.col("breadcrumb"), F.lit("\n"), F.col("text")))
