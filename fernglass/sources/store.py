"""Stored chunks: a Parquet table by default, and the JSON form of one document's chunks for exchange."""

from __future__ import annotations

import json
import os
import re
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.functions.vectors import decode_vector, encode_vector, encoded_length
from fernglass.operators.postings import KeywordIndex, write_index
from fernglass.shared import Files

FORMAT = 1
COLUMNS = ("path", "ordinal", "start", "end", "breadcrumb", "anchor", "hash", "text", "doc_hash", "chunker", "model", "dims", "embedding")
SCHEMA = "path string, ordinal int, start long, end long, breadcrumb string, anchor string, hash string, text string, doc_hash string, chunker string, model string, dims int, embedding array<float>"
TITLES = "path string, title string"
HEX = re.compile(r"[0-9a-f]{64}")


class StoreError(ValueError):
    pass


VERSION = re.compile(r"chunks-(\d{9})")
#: Versions that stay: the newest, and those that a running engine may still read.
KEPT = 2


def prepare(spark: SparkSession, target: str) -> Files:
    """The engine's folder, which version control ignores as a whole."""
    files = Files(spark)
    if not files.exists(f"{target}/.gitignore"):
        files.write(f"{target}/.gitignore", "*\n")
    return files


def _numbers(files: Files, target: str) -> list[int]:
    return [int(m[1]) for m in map(VERSION.fullmatch, files.names(target)) if m]


def versions(files: Files, target: str) -> list[int]:
    """Numbers of the versions that were written to the end, in order. A version is its chunks and its index, whose
    last table Spark marks as complete."""
    return [n for n in _numbers(files, target) if files.exists(f"{target}/index-{n:09d}/fields/_SUCCESS")]


def read_chunks(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of the newest version; empty if there is none yet."""
    found = versions(Files(spark), target)
    return spark.read.schema(SCHEMA).parquet(f"{target}/chunks-{found[-1]:09d}") if found else spark.createDataFrame([], SCHEMA)


def read_index(spark: SparkSession, target: str) -> KeywordIndex | None:
    found = versions(Files(spark), target)
    return KeywordIndex.read(spark, f"{target}/index-{found[-1]:09d}") if found else None


def read_titles(spark: SparkSession, target: str) -> DataFrame:
    """(path, title) of the documents of the newest version."""
    found = versions(Files(spark), target)
    return spark.read.schema(TITLES).parquet(f"{target}/index-{found[-1]:09d}/titles") if found else spark.createDataFrame([], TITLES)


def write_chunks(chunks: DataFrame, titles: DataFrame, target: str) -> None:
    """A new version beside the old ones, of which all but the last go. titles: (path, title). Two writers can't write
    the same version: Spark refuses a folder that is there."""
    spark = chunks.sparkSession
    files = prepare(spark, target)
    n = max(_numbers(files, target), default=0) + 1
    chunks.select(*COLUMNS).repartitionByRange("path", "ordinal").sortWithinPartitions("path", "ordinal").write.parquet(f"{target}/chunks-{n:09d}")
    stored = spark.read.schema(SCHEMA).parquet(f"{target}/chunks-{n:09d}")
    titles.select("path", "title").write.parquet(f"{target}/index-{n:09d}/titles")
    titles = spark.read.schema(TITLES).parquet(f"{target}/index-{n:09d}/titles")
    write_index(stored.join(titles, "path", "left").withColumn("title", F.coalesce("title", F.lit(""))), f"{target}/index-{n:09d}")
    least = versions(files, target)[-KEPT:][0]
    for old in (x for x in _numbers(files, target) if x < least):
        files.delete(f"{target}/chunks-{old:09d}")
        files.delete(f"{target}/index-{old:09d}")


def headers(chunks: DataFrame) -> DataFrame:
    """One row per document: what its chunks were made from and with."""
    return chunks.groupBy("path").agg(F.min("doc_hash").alias("stored_hash"), F.min("chunker").alias("stored_chunker"), F.min("model").alias("stored_model"), F.min("dims").alias("stored_dims"))


def sidecar_path(target: str, path: str) -> str:
    """Where a document's JSON goes; paths that could lead elsewhere are refused."""
    parts = path.split("/")
    if "\\" in path or re.match(r"[A-Za-z]:", path) or any(p in ("", ".", "..") for p in parts):
        raise StoreError(f"{path!r} is no plain relative path")
    return f"{target}/vectors/{path}.vec.json"


def to_json(header: dict[str, Any], chunks: list[dict[str, Any]]) -> str:
    """Keys in a fixed order, no times: equal input gives equal bytes."""
    rows = []
    for c in chunks:
        try:
            vector = encode_vector(c["vector"], header["dims"])
        except ValueError as e:
            raise StoreError(f"chunk at {c['start']}: {e}") from None
        rows.append({k: c[k] for k in ("start", "end", "breadcrumb", "anchor", "hash")} | {"vector": vector})
    out = {"format": FORMAT, **{k: header[k] for k in ("doc_hash", "chunker", "model", "dims")}, "chunks": rows}
    checked(out)
    return json.dumps(out, indent=2, ensure_ascii=False) + "\n"


def checked(raw: Any) -> dict[str, Any]:
    """The whole structure, and the lengths of the vectors; they aren't decoded."""
    def need(ok: bool, what: str) -> None:
        if not ok:
            raise StoreError(f"invalid sidecar: {what}")

    natural = lambda v, least: isinstance(v, int) and not isinstance(v, bool) and v >= least
    need(isinstance(raw, dict), "no object")
    need(raw.get("format") == FORMAT, f"format isn't {FORMAT}")
    need(set(raw) == {"format", "doc_hash", "chunker", "model", "dims", "chunks"}, "unknown or missing keys")
    need(isinstance(raw["doc_hash"], str) and bool(HEX.fullmatch(raw["doc_hash"])), "doc_hash isn't a SHA-256")
    need(all(isinstance(raw[k], str) and raw[k] for k in ("chunker", "model")), "chunker and model must be named")
    need(natural(raw["dims"], 1), "dims must be positive")
    need(isinstance(raw["chunks"], list), "chunks must be a list")
    last = 0
    for c in raw["chunks"]:
        need(isinstance(c, dict) and set(c) == {"start", "end", "breadcrumb", "anchor", "hash", "vector"}, "a chunk has unknown or missing keys")
        need(natural(c["start"], 0) and natural(c["end"], 0) and c["end"] > c["start"], "a chunk must end after its start")
        need(c["start"] >= last, "chunks must be in order and not overlap")
        need(all(isinstance(c[k], str) for k in ("breadcrumb", "anchor", "vector")) and isinstance(c["hash"], str) and bool(HEX.fullmatch(c["hash"])), "a chunk's texts or hash")
        need(len(c["vector"]) == encoded_length(raw["dims"]), f"chunk at {c['start']}: the vector isn't {raw['dims']} numbers")
        last = c["end"]
    return raw


def from_json(text: str) -> tuple[dict[str, Any], list[dict[str, Any]]]:
    """Header and chunks with their vectors."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise StoreError(f"invalid JSON: {e}") from None
    raw = checked(raw)
    chunks = [c | {"vector": v} for c, v in zip(raw["chunks"], vectors_of(raw), strict=True)]
    return {k: raw[k] for k in ("doc_hash", "chunker", "model", "dims")}, chunks


def read_sidecar(target: str, path: str) -> tuple[str, str | dict[str, Any] | None]:
    """What there is of a document's JSON: ("missing", None), ("unreadable", why), ("invalid", why) or ("fine", its
    content with vectors as they are written); vectors_of decodes them when they are needed."""
    at = Path(sidecar_path(target, path))
    try:
        text = at.read_bytes().decode()
    except FileNotFoundError:
        return "missing", None
    except (OSError, UnicodeDecodeError) as e:
        return "unreadable", f"{path}: {e}"
    try:
        return "fine", checked(json.loads(text))
    except ValueError as e:  # StoreError is one
        return "invalid", f"{path}: {e}; run embed"


def vectors_of(sidecar: dict[str, Any]) -> list[list[float]]:
    out = []
    for c in sidecar["chunks"]:
        try:
            out.append(decode_vector(c["vector"], sidecar["dims"]))
        except ValueError as e:
            raise StoreError(f"chunk at {c['start']}: {e}") from None
    return out


def write_sidecar(target: str, path: str, text: str) -> None:
    to = Path(sidecar_path(target, path))
    to.parent.mkdir(parents=True, exist_ok=True)
    fresh = to.with_name(f"{to.name}.{uuid.uuid4().hex}.tmp")
    fresh.write_text(text)
    os.replace(fresh, to)


def delete_sidecar(target: str, path: str) -> None:
    """The file, and folders that it leaves empty, but never vectors/ itself."""
    to, top = Path(sidecar_path(target, path)), Path(target, "vectors")
    to.unlink(missing_ok=True)
    folder = to.parent
    while folder != top and folder.is_dir() and not any(folder.iterdir()):
        folder.rmdir()
        folder = folder.parent


def list_sidecars(target: str) -> tuple[list[str], list[str]]:
    """Paths of documents with JSON, and leftovers of interrupted writes."""
    top = Path(target, "vectors")
    found = sorted(p.relative_to(top).as_posix() for p in top.rglob("*") if p.is_file()) if top.is_dir() else []
    return [p.removesuffix(".vec.json") for p in found if p.endswith(".vec.json")], [p for p in found if p.endswith(".tmp")]


def export_sidecars(chunks: DataFrame, target: str) -> int:
    """One JSON file per document, document by document."""
    prepare(chunks.sparkSession, target)
    n, held, path = 0, [], None

    def flush() -> None:
        nonlocal n
        if held:
            head = {k: held[0][k] for k in ("doc_hash", "chunker", "model", "dims")}
            write_sidecar(target, path, to_json(head, [r.asDict() | {"vector": list(r.embedding)} for r in held]))
            n += 1

    for r in chunks.orderBy("path", "ordinal").toLocalIterator():
        if r.path != path:
            flush()
            held, path = [], r.path
        held.append(r)
    flush()
    return n
