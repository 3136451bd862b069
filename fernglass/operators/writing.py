"""The write path: which documents need chunks, which chunks need vectors, what is stored and what goes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.functions.windows import check_window


def to_plan(docs: DataFrame, headers: DataFrame, chunker: str, model: str, dims: int, rechunk: bool = False) -> DataFrame:
    """Documents whose stored chunks don't fit, with keep: whether their recorded ranges stay (only the model changed).
    headers: (path, stored_hash, stored_chunker, stored_model, stored_dims)."""
    rows = docs.join(headers, "path", "left")
    same = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    ranges = same("stored_hash", F.col("doc_hash")) & same("stored_chunker", F.lit(chunker))
    fits = ranges & same("stored_model", F.lit(model)) & same("stored_dims", F.lit(dims))
    return rows.filter(F.lit(True) if rechunk else ~fits).withColumn("keep", F.lit(False) if rechunk else ranges).withColumn("same_model", same("stored_model", F.lit(model)) & same("stored_dims", F.lit(dims)))


def with_reuse(planned: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """planned: (path, hash, ...). Adds vector: that of the same chunk of the same document and model, or null."""
    old = stored.filter(F.col("model") == model).select("path", "hash", F.col("embedding").alias("vector")).dropDuplicates(["path", "hash"])
    return planned.join(old, ["path", "hash"], "left")


def pending(planned: DataFrame) -> DataFrame:
    """Chunks without a vector, each text of a document once."""
    return planned.filter("vector is null").select("path", "hash", "text").dropDuplicates(["path", "hash"])


def completed(planned: DataFrame, embed: Callable[[Column], Column], new: DataFrame | None = None) -> DataFrame:
    """planned with every vector: what is pending is embedded once per document and text, by a column or before."""
    if new is None:
        new = pending(planned).select("path", "hash", embed(F.col("text")).alias("fresh"))
    return planned.join(new, ["path", "hash"], "left").withColumn("embedding", F.coalesce("vector", "fresh")).withColumn("reused", F.col("vector").isNotNull()).drop("vector", "fresh")


BATCH = 32


def embedded(new: DataFrame, embed: Callable[[list[str]], list[list[float]]], dims: int, batch: int = BATCH, count: Callable[[str], int] | None = None) -> DataFrame:
    """new: (path, hash, text). Vectors batch by batch: (path, hash, fresh, problem). A batch that fails is tried again
    document by document, so only the documents that fail themselves have a problem. count: tokens of a text, none of
    which may have more than a model reads."""
    schema = pa.schema([("path", pa.string()), ("hash", pa.string()), ("fresh", pa.list_(pa.float32())), ("problem", pa.string())])

    def vectors(texts: list[str]) -> list[list[float]]:
        for t in texts if count else []:
            check_window(count(t), "a chunk")
        out = embed(texts)
        if len(out) != len(texts) or any(len(v) != dims or not all(math.isfinite(x) for x in v) for v in out):
            raise ValueError(f"the embedder gave other than {len(texts)} finite vectors of {dims} numbers")
        return out

    def tried(rows: list[dict]) -> list[dict]:
        try:
            return [{"path": r["path"], "hash": r["hash"], "fresh": v, "problem": None} for r, v in zip(rows, vectors([r["text"] for r in rows]), strict=True)]
        except Exception as e:
            paths = list(dict.fromkeys(r["path"] for r in rows))
            if len(paths) == 1:
                return [{"path": r["path"], "hash": r["hash"], "fresh": None, "problem": f"embedding failed: {e}"} for r in rows]
            return [x for p in paths for x in tried([r for r in rows if r["path"] == p])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                yield pa.RecordBatch.from_pylist(tried(b.slice(lo, batch).to_pylist()), schema)

    return new.mapInArrow(run, "path string, hash string, fresh array<float>, problem string")


def report(done: DataFrame, n_documents: int) -> dict[str, int]:
    r = done.agg(F.count_distinct("path").alias("written"), F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("embedded")).first()
    return {"written": r.written, "up_to_date": n_documents - r.written, "chunks_embedded": r.embedded, "chunks_reused": r.reused}


def replaced(stored: DataFrame, done: DataFrame, known: DataFrame) -> DataFrame:
    """The store after a run: new chunks, and the old ones of documents that are known and weren't written."""
    kept = stored.join(done.select("path").distinct(), "path", "left_anti").join(known.select("path").distinct(), "path", "left_semi")
    return kept.unionByName(done.select(*stored.columns))


def version_rows(chunks: DataFrame) -> DataFrame:
    """(path, doc_hash, chunker, model, dims, hashes), in the order of the paths."""
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "hash"))), lambda x: x["hash"])
    return chunks.groupBy("path", "doc_hash", "chunker", "model", "dims").agg(hashes.alias("hashes")).orderBy("path")


def index_version(chunks: DataFrame) -> str:
    """SHA-256 of the compact JSON list of version_rows, taken row by row."""
    import hashlib
    import json

    out = hashlib.sha256(b"[")
    for k, r in enumerate(version_rows(chunks).toLocalIterator()):
        row = json.dumps([r.path, r.doc_hash, r.chunker, r.model, r.dims, list(r.hashes)], ensure_ascii=False, separators=(",", ":"))
        out.update((("," if k else "") + row).encode())
    out.update(b"]")
    return out.hexdigest()
