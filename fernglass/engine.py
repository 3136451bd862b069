"""The engine over a folder: embed and check on the write side; overview, search, list and get on the read side."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.errors import InvalidRequest, NotFound, StartupError

from fernglass.models import Embedder, HashEmbedder, Reranker, overlap_reranker
from fernglass.operators import freshness, listing, ranking, retrieval, writing
from fernglass.operators.filters import Filter, strict, whole
from fernglass.operators.postings import KeywordIndex
from fernglass.sources import markdown, store

from fernglass.sources.chunker import Chunker, structural

PLANNED = "path string, doc_hash string, ordinal int, start long, end long, breadcrumb string, anchor string, text string, error string"


def chunked(docs: DataFrame, chunker: Chunker) -> DataFrame:
    """docs: (path, doc_hash, title, body). A row per chunk; of documents whose chunks don't cover their text, one
    row with an error."""
    schema = pa.schema([("path", pa.string()), ("doc_hash", pa.string()), ("ordinal", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("breadcrumb", pa.string()), ("anchor", pa.string()), ("text", pa.string()), ("error", pa.string())])

    def rows_of(path: str, doc_hash: str, title: str, body: str) -> list[dict]:
        spans = chunker.chunk(title, body)
        wide = body.encode("utf-16-le")
        cut = lambda a, z: wide[2 * a : 2 * z].decode("utf-16-le", "replace")
        at, problem = 0, None
        for s in spans:
            if s.start < at or s.end <= s.start or s.end > len(wide) // 2:
                problem = "chunks overlap or leave the body"
            elif not freshly_blank(cut(at, s.start)):
                problem = f"the text at {at} lies in no chunk"
            at = max(at, s.end)
        if not problem and not freshly_blank(cut(at, len(wide) // 2)):
            problem = f"the text at {at} lies in no chunk"
        if problem:
            return [dict.fromkeys(schema.names) | {"path": path, "doc_hash": doc_hash, "error": f"chunker {chunker.id}: {problem}"}]
        return [{"path": path, "doc_hash": doc_hash, "ordinal": k, "start": s.start, "end": s.end, "breadcrumb": s.breadcrumb, "anchor": s.anchor, "text": s.text, "error": None} for k, s in enumerate(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for d in batch.to_pylist() for r in rows_of(d["path"], d["doc_hash"], d["title"], d["body"])]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select("path", "doc_hash", "title", "body").mapInArrow(run, PLANNED)


def freshly_blank(text: str) -> bool:
    import unicodedata

    return all(c.isspace() or unicodedata.category(c)[0] in "ZC" for c in text)


def embed(spark: SparkSession, source: str, target: str, embedder: Embedder | None = None, chunker: Chunker | None = None, rechunk: bool = False) -> dict[str, Any]:
    """Bring the stored chunks up to date; only chunks whose hash is new get a vector. A document that fails keeps
    what it had; what is stored for documents that are gone goes."""
    embedder, chunker = embedder or HashEmbedder(), chunker or structural()
    parsed = markdown.scan(spark, source, target).cache()
    docs, errors = markdown.documents(parsed), markdown.load_errors(parsed)
    old = store.read_chunks(spark, target)
    plan = writing.to_plan(docs, store.headers(old), chunker.id, embedder.model, embedder.dims, rechunk)
    fresh = chunked(plan.filter("not keep"), chunker)
    kept = old.join(plan.filter("keep").select("path"), "path", "left_semi").select("path", "doc_hash", "ordinal", "start", "end", "breadcrumb", "anchor", "text", F.lit(None).cast("string").alias("error"))
    rows = fresh.unionByName(kept).cache()
    failed = [(r.path, r.error) for r in rows.filter("error is not null").collect()]
    planned = rows.filter("error is null").drop("error").withColumn("hash", freshness.chunk_hash())
    reused = writing.with_reuse(planned, old.filter(F.col("dims") == embedder.dims), embedder.model)
    new = None
    if hasattr(embedder, "embed"):
        new = writing.embedded(writing.pending(reused), embedder.embed, embedder.dims, count=embedder.count_tokens).cache()
        broken = new.filter("problem is not null").groupBy("path").agg(F.min("problem").alias("problem")).collect()
        failed += [(r.path, r.problem) for r in broken]
        reused = reused.filter(~F.col("path").isin([r.path for r in broken])) if broken else reused
    documents = None if new is not None else embedder.documents
    done = writing.completed(reused, documents, new).withColumns({"chunker": F.lit(chunker.id), "model": F.lit(embedder.model), "dims": F.lit(embedder.dims)}).cache()
    n = docs.count()
    planned_paths = plan.count()
    counts = writing.report(done, n)
    known = docs.select("path").unionByName(errors.select("path"))
    pruned = old.select("path").distinct().join(known, "path", "left_anti").count()
    store.write_chunks(writing.replaced(old, done, known), docs.select("path", "title"), target)
    for df in (done, rows, parsed, *([new] if new is not None else [])):
        df.unpersist()
    return counts | {"up_to_date": n - planned_paths, "pruned": pruned, "failures": failed}


def problems(docs: DataFrame, errors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, reason) of all that keeps the engine from serving."""
    heads = store.headers(chunks)
    state = freshness.statuses(docs, heads, errors).filter("status not in ('current', 'unread')")
    reason = F.when(F.col("status") == "orphan", "stored chunks without a document").when(F.col("status") == "missing", "no stored chunks; run embed").otherwise("stale: the document has changed; run embed")
    current = heads.join(docs.select("path", "doc_hash"), "path").filter("stored_hash = doc_hash")
    out = errors.unionByName(state.select("path", reason.alias("reason")))
    for column in ("stored_chunker", "stored_model", "stored_dims"):
        out = out.unionByName(freshness.mixed(current, column))
    changed = freshness.altered(chunks).select("path", F.lit("a chunk's text doesn't fit its hash; run embed").alias("reason"))
    odd = freshness.disordered(chunks).select("path", F.lit("chunks out of order").alias("reason"))
    bare = freshness.uncovered(chunks.join(current.select("path"), "path", "left_semi"), docs)
    return out.unionByName(changed).unionByName(odd).unionByName(bare).distinct()


def check(spark: SparkSession, source: str, target: str) -> list[tuple[str, str]]:
    parsed = markdown.scan(spark, source, target)
    docs = _nonblank(markdown.documents(parsed))
    return sorted((r.path, r.reason) for r in problems(docs, markdown.load_errors(parsed), store.read_chunks(spark, target)).collect())


def _nonblank(docs: DataFrame) -> DataFrame:
    """Documents with text; the others have no chunks to be fresh."""
    from fernglass.functions.text import is_blank

    return docs.filter(~is_blank(F.col("body")))


@dataclass
class Engine:
    spark: SparkSession
    documents: DataFrame
    chunks: DataFrame
    version: str
    embedder: Embedder
    reranker: Reranker | None
    options: retrieval.Options
    now_ms: Callable[[], int]
    tags: set[str]
    model: str | None
    words: KeywordIndex | None = None
    dims: int | None = None

    def overview(self, filter: Mapping[str, Any] | None = None) -> dict[str, Any]:
        own = Filter.parse(filter)
        r = listing.counts(self.documents, own).first()
        tags = [{"name": t.tag, "documents": t.documents} for t in listing.tag_counts(self.documents, own).collect()]
        return {"documents": r.documents, "chunks": r.chunks, "tags": tags, "index_version": self.version, "embedding_model": self.model}

    def list_documents(self, request: Mapping[str, Any] | None = None) -> dict[str, Any]:
        request = request or {}
        strict(request, ("filter", "sort", "offset", "limit"), "list request")
        own, sort = Filter.parse(request.get("filter")), request.get("sort", "path")
        if sort not in ("path", "updated_at"):
            raise InvalidRequest("sort must be path or updated_at")
        offset, limit = whole("offset", request.get("offset", 0), 0), whole("limit", request.get("limit", 50), 1, 500)
        rows = listing.listed(self.documents, own, sort, offset, limit).collect()
        return {"total": self.documents.filter(own.column()).count(), "documents": [r.asDict() for r in rows], "index_version": self.version}

    def get_document(self, ref: str, full: bool = False) -> dict[str, Any]:
        """A document, or the section that a reference path#anchor names; the whole reference is tried as a path first."""
        if not isinstance(ref, str) or not ref:
            raise InvalidRequest("a reference must not be empty")
        for path, anchor in ((ref, None), *([tuple(ref.rsplit("#", 1))] if "#" in ref else [])):
            row = self.documents.filter(F.col("path") == path).first()
            if row is None:
                continue
            section = next((h for h in row.headings if h.anchor == anchor), None)
            if anchor is not None and (not anchor or section is None):
                raise NotFound(f"{path} has no section {anchor!r}")
            wide = row.body.encode("utf-16-le")
            text = wide[2 * section.start : 2 * section.end].decode("utf-16-le") if section and not full else row.body
            outline = [{"depth": h.depth, "text": h.text, "anchor": h.anchor} for h in row.headings]
            return {"ref": ref, **{c: row[c] for c in listing.SUMMARY}, "outline": outline, "text": text.strip(), "index_version": self.version}
        raise NotFound(f"no document {ref!r}")

    def search(self, request: Mapping[str, Any]) -> dict[str, Any]:
        strict(request, ("query", "filter", "mode", "limit", "min_score", "weights", "expand"), "search request")
        query = request.get("query")
        if not isinstance(query, str) or freshly_blank(query):
            raise InvalidRequest("the query must not be blank")
        weights = request.get("weights")
        if weights is not None and (not isinstance(weights, Mapping) or any(isinstance(w, bool) or not isinstance(w, (int, float)) for w in weights.values())):
            raise InvalidRequest("weights must map names to numbers")
        own = self.options.merged(weights, **{k: request.get(k) for k in ("mode", "limit", "min_score", "expand")}).checked(self.tags)
        filter = Filter.parse(request.get("filter"))
        began = time.perf_counter()
        vector = None if own.mode == "keyword" else self.embedder.query(query)
        embedded = time.perf_counter()
        if vector is not None:
            check_vector(vector, self.dims)
        found = ranking.capped(ranking.top(self.candidates(own, query, vector, filter), own.candidates)).cache()
        found.count()
        searched = time.perf_counter()
        rerank = self.reranker(query) if own.rerank and self.reranker else None
        rows = retrieval.retrieve(found, self.chunks, own, self.now_ms(), rerank).collect()
        done = time.perf_counter()
        found.unpersist()
        paths = [r.path for r in rows]
        summaries = {r.path: r.asDict() for r in listing.summaries(self.documents.filter(F.col("path").isin(paths))).collect()} if paths else {}
        results = [summaries[r.path] | {"ref": r.ref, "breadcrumb": r.breadcrumb, "text": r.text, "chunks": {"from": r["first"], "to": r["last"]}, "scores": r.scores.asDict()} for r in rows]
        ms = lambda a, z: (z - a) * 1000
        return {"results": results, "timings": {"embed_ms": ms(began, embedded), "search_ms": ms(embedded, searched), "rerank_ms": ms(searched, done), "total_ms": ms(began, done)}, "index_version": self.version}

    def candidates(self, own: retrieval.Options, query: str, vector: list[float] | None, filter: Filter) -> DataFrame:
        # a term finds the words that it begins, as "webhook" does "webhooks"
        if own.mode != "semantic":
            allowed = None if filter == Filter() else self.documents.filter(filter.column())
            text = self.words.keyword(query, allowed=allowed, prefix=True) if self.words else ranking.keyword(self.chunks, query, filter, prefix=True)
            if own.mode == "keyword":
                return text
        near = ranking.semantic(self.chunks, vector, filter)
        # a query without terms says nothing about words
        return near if own.mode == "semantic" or not ranking.query_terms(query) else ranking.hybrid(text, near, *own.hybrid_weights)


def check_vector(vector: list[float], dims: int | None) -> None:
    """A failed embedder may give zeros or no numbers; that must not look like no matches."""
    if not all(isinstance(x, (int, float)) and math.isfinite(x) for x in vector) or not any(vector):
        raise InvalidRequest("the query vector must be finite and not all zeros")
    if dims is not None and len(vector) != dims:
        raise InvalidRequest(f"the query vector has {len(vector)} numbers, the index holds vectors of {dims}")


def create_engine(spark: SparkSession, source: str, target: str, *, embedder: Embedder | None = None, reranker: Reranker | None = overlap_reranker, options: retrieval.Options | None = None, now_ms: Callable[[], int] | None = None) -> Engine:
    """Ready to answer, or an error that names every problem."""
    embedder = embedder or HashEmbedder()
    parsed = markdown.scan(spark, source, target).cache()
    docs, chunks = markdown.documents(parsed), store.read_chunks(spark, target)
    if found := sorted((r.path, r.reason) for r in problems(_nonblank(docs), markdown.load_errors(parsed), chunks).collect()):
        raise StartupError(markdown.report(found))
    heads = chunks.select("model", "dims").distinct().collect()
    models = sorted({r.model for r in heads})
    if models and models != [embedder.model]:
        raise StartupError(f"the index was built with {models[0]}, the embedder is {embedder.model}")
    options = options or retrieval.Options()
    if options.rerank and reranker is None:
        raise StartupError("reranking needs a reranker")
    of_doc = docs.select("path", "title", "tags", "dirs", "updated_at")
    index = chunks.join(of_doc, "path").cache()
    n = chunks.groupBy("path").agg(F.count("*").alias("n_chunks"))
    documents = docs.join(n, "path", "left").fillna({"n_chunks": 0}).cache()
    tags = {r.tag for r in listing.tag_vocabulary(documents).collect()}
    return Engine(spark, documents, index, writing.index_version(chunks), embedder, reranker, options.checked(tags), now_ms or (lambda: int(time.time() * 1000)), tags, models[0] if models else None, store.read_index(spark, target), heads[0].dims if heads else None)
