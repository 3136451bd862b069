"""Continuous ingestion of Markdown rows, an extension: the batch write path, run for every micro-batch.

files: a stream of (path, content, at). Only the newest content of a path within a batch, by `at`, counts; chunks whose
hash the store has keep their vectors. The store is replaced in one step after each batch, so a batch that is run again
after a failure changes nothing. A document that can't be read, or whose chunks don't cover it, keeps what it had, and a
row (path, reason, batch) in the table `failures` beside the store says why.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fernglass.engine import chunked
from fernglass.models import Embedder
from fernglass.operators import freshness, writing
from fernglass.sources import markdown, store
from fernglass.sources.chunker import Chunker


def ingest_batch(files: DataFrame, target: str, embedder: Embedder, chunker: Chunker, batch: int = 0) -> None:
    spark = files.sparkSession
    newest = files.groupBy("path").agg(F.max_by("content", F.struct("at", "content")).alias("content"))
    parsed = markdown.parse_rows(newest).cache()
    docs = markdown.documents(parsed)
    old = store.read_chunks(spark, target)
    plan = writing.to_plan(docs, store.headers(old), chunker.id, embedder.model, embedder.dims)
    rows = chunked(plan, chunker).cache()
    planned = rows.filter("error is null").drop("error").withColumn("hash", freshness.chunk_hash())
    done = writing.completed(writing.with_reuse(planned, old.filter(F.col("dims") == embedder.dims), embedder.model), embedder.documents)
    done = done.withColumns({"chunker": F.lit(chunker.id), "model": F.lit(embedder.model), "dims": F.lit(embedder.dims)})
    known = old.select("path").unionByName(done.select("path"))
    titles = docs.select("path", "title").unionByName(store.read_titles(spark, target).join(docs, "path", "left_anti"))
    store.write_chunks(writing.replaced(old, done, known), titles, target)
    failed = markdown.load_errors(parsed).unionByName(rows.filter("error is not null").select("path", F.col("error").alias("reason")))
    failed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{target}/failures/batch={batch}")
    for df in (parsed, rows):
        df.unpersist()


def ingest(files: DataFrame, target: str, checkpoint: str, embedder: Embedder, chunker: Chunker) -> StreamingQuery:
    """Until the stream has no more rows."""
    if missing := {"path", "content", "at"} - set(files.columns):
        raise ValueError(f"the stream lacks {', '.join(sorted(missing))}; `at` says which content of a path is newest")
    return files.writeStream.foreachBatch(lambda df, n: ingest_batch(df, target, embedder, chunker, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
